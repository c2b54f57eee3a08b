"""Sorted-string-table shards of token ids (operator 8).

A shard holds documents in ascending key order::

    data blocks | index block | Bloom filter | footer

* data block: zstd frame, then its CRC-32 (4 bytes). Inside, each entry is
  ``varint shared, varint unshared, varint ids, key suffix, ids as uint32 LE``; the key is the first
  ``shared`` bytes of the entry before it plus the suffix (prefix compression).
* index block: for each data block ``varint length of last key, last key, varint offset, varint size``.
* Bloom filter: ``m`` bits with ``k`` probes by double hashing of the key's xxh3.
* footer: offsets and lengths of both, entries, ids, ``m``, ``k`` and a magic word (fixed size).

A key begins with a byte for its kind. Integers follow as 8 bytes, big-endian with the sign bit flipped, so byte order is
number order; strings follow as UTF-8, so the empty string is a key like others. A null key is a byte of its own that sorts first. Repeated keys keep
all their entries. A null or empty text has the end id only; a text longer than a block is one entry of a longer block.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import default_tokenizer_path, encoder_for

MAGIC = b"MMOPSST2"
FOOTER = struct.Struct("<QQQQQQQI8s")
BLOCK_BYTES = 1 << 16
SHARD_BYTES = 64 << 20
BITS_PER_KEY, PROBES = 10, 7


NULL_KEY, INTEGER_KEY, STRING_KEY = b"\x00", b"\x01", b"\x02"


def encode_key(key) -> bytes:
    if key is None:
        return NULL_KEY
    return STRING_KEY + key.encode() if isinstance(key, str) else INTEGER_KEY + struct.pack(">Q", int(key) + (1 << 63))


def decode_key(raw: bytes, kind: str):
    if raw == NULL_KEY:
        return None
    return raw[1:].decode() if kind == "string" else struct.unpack(">Q", raw[1:])[0] - (1 << 63)


def _put_varint(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def _varint(buf: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = buf[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(key: bytes, m: int, k: int) -> Iterator[int]:
    import xxhash

    h = xxhash.xxh3_128_intdigest(key)
    a, b = h & 0xFFFFFFFFFFFFFFFF, h >> 64 | 1
    return ((a + i * b) % m for i in range(k))


class ShardWriter:
    """Writes one shard in a stream: memory holds one block, the index and the keys' Bloom hashes."""

    def __init__(self, sink):
        import zstandard

        self._sink, self._zip = sink, zstandard.ZstdCompressor(level=1)
        self._block, self._last, self._index = bytearray(), b"", bytearray()
        self.offset = self.entries = self.ids = 0
        self.first: bytes | None = None
        self._keys: list[bytes] = []

    def add(self, key: bytes, ids: bytes) -> None:
        shared = 0
        if self._block:
            for x, y in zip(key, self._last, strict=False):
                if x != y:
                    break
                shared += 1
        _put_varint(self._block, shared)
        _put_varint(self._block, len(key) - shared)
        _put_varint(self._block, len(ids) // 4)
        self._block += key[shared:]
        self._block += ids
        self.first = key if self.first is None else self.first
        self._last = key
        self.entries += 1
        self.ids += len(ids) // 4
        self._keys.append(key)
        if len(self._block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if not self._block:
            return
        raw = self._zip.compress(bytes(self._block))
        raw += struct.pack("<I", zlib.crc32(raw))
        self._sink.write(raw)
        _put_varint(self._index, len(self._last))
        self._index += self._last
        _put_varint(self._index, self.offset)
        _put_varint(self._index, len(raw))
        self.offset += len(raw)
        self._block = bytearray()

    @property
    def last(self) -> bytes:
        return self._last

    def close(self) -> int:
        self._flush()
        m = max(64, BITS_PER_KEY * len(self._keys))
        bloom = bytearray((m + 7) // 8)
        for key in self._keys:
            for p in _probes(key, m, PROBES):
                bloom[p >> 3] |= 1 << (p & 7)
        index_at, bloom_at = self.offset, self.offset + len(self._index)
        self._sink.write(bytes(self._index))
        self._sink.write(bytes(bloom))
        self._sink.write(FOOTER.pack(index_at, len(self._index), bloom_at, len(bloom), self.entries, self.ids, m, PROBES, MAGIC))
        self._sink.close()
        return bloom_at + len(bloom) + FOOTER.size


class ShardReader:
    """Reads a shard block by block; :meth:`get` asks the Bloom filter, then searches the sparse index."""

    def __init__(self, source):
        self._f = source
        self._f.seek(0, 2)
        end = self._f.tell()
        self._f.seek(end - FOOTER.size)
        at, size, bloom_at, bloom_size, self.entries, self.ids, self._m, self._k, magic = FOOTER.unpack(self._f.read(FOOTER.size))
        if magic != MAGIC:
            raise ValueError("not a shard of this format")
        self._bloom = self._read(bloom_at, bloom_size)
        raw, i = self._read(at, size), 0
        self._last_keys: list[bytes] = []
        self._where: list[tuple[int, int]] = []
        while i < len(raw):
            n, i = _varint(raw, i)
            self._last_keys.append(raw[i : i + n])
            off, i = _varint(raw, i + n)
            length, i = _varint(raw, i)
            self._where.append((off, length))

    def _read(self, at: int, size: int) -> bytes:
        self._f.seek(at)
        return self._f.read(size)

    def _block(self, n: int) -> Iterator[tuple[bytes, bytes]]:
        import zstandard

        raw = self._read(*self._where[n])
        if struct.unpack("<I", raw[-4:])[0] != zlib.crc32(raw[:-4]):
            raise ValueError("a block's checksum doesn't match")
        block, i, key = zstandard.ZstdDecompressor().decompress(raw[:-4]), 0, b""
        while i < len(block):
            shared, i = _varint(block, i)
            unshared, i = _varint(block, i)
            ids, i = _varint(block, i)
            key = key[:shared] + block[i : i + unshared]
            i += unshared
            yield key, block[i : i + 4 * ids]
            i += 4 * ids

    def __iter__(self) -> Iterator[tuple[bytes, bytes]]:
        for n in range(len(self._where)):
            yield from self._block(n)

    def get(self, key: bytes) -> list[bytes]:
        """The ids of every entry with this key."""
        if not all(self._bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, self._m, self._k)):
            return []
        found: list[bytes] = []
        for n in range(bisect.bisect_left(self._last_keys, key), len(self._where)):
            for k, ids in self._block(n):
                if k == key:
                    found.append(ids)
                elif k > key:
                    return found
        return found


def open_for(uri: str):
    """The Arrow file system and path of a URI; a path without a scheme is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or not uri.startswith("file:") else "file://" + uri[5:])


MANIFEST = "part int, seq int, path string, first_key binary, last_key binary, entries long, ids long, bytes long"


def write_sstables(docs: DataFrame, out_dir: str, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = 2, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """Writes shards below ``out_dir`` in ascending ``id_col`` order; returns the lazy manifest, a row per shard.

    The manifest is what commits: write it once and read it back. A repeated task writes files
    of other names, which no manifest lists. Rows of one id are dealt out by a hash of their
    text as well, so that one id with very many rows doesn't fill one task.
    """
    path = tokenizer_path or default_tokenizer_path()

    def write(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        part, encoder = TaskContext.get().partitionId(), encoder_for(path)
        filesystem, root = open_for(out_dir)
        filesystem.create_dir(root, recursive=True)
        rows, writer, name = [], None, ""

        def finish():
            size = writer.close()
            rows.append((part, len(rows), f"{out_dir}/{name}", writer.first, writer.last, writer.entries, writer.ids, size))

        end = struct.pack("<I", end_id)
        for batch in batches:
            for key, ids in zip(batch.column(0).to_pylist(), encoder.encode_all(batch.column(1).to_pylist()), strict=True):
                if writer is None:
                    name = f"{part:05d}-{len(rows):04d}-{uuid.uuid4().hex}.sst"
                    writer = ShardWriter(filesystem.open_output_stream(f"{root}/{name}"))
                writer.add(encode_key(key), ids + end)
                if writer.offset >= shard_bytes:
                    finish()
                    writer = None
        if writer is not None:
            finish()
        schema = pa.schema([("part", pa.int32()), ("seq", pa.int32()), ("path", pa.string()), ("first_key", pa.binary()), ("last_key", pa.binary()), ("entries", pa.int64()), ("ids", pa.int64()), ("bytes", pa.int64())])
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(schema), schema, strict=True)], schema=schema)

    rows = docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).withColumn("h", F.xxhash64("t"))
    ordered = rows.repartitionByRange("k", "h").sortWithinPartitions("k", "h").select("k", "t")
    return ordered.mapInArrow(write, MANIFEST)


def read_sstables(manifest: DataFrame, kind: str = "bigint") -> DataFrame:
    """Reads shards back in blocks: key, start (ids of all entries before it), n_tokens, ids (binary, uint32 LE)."""
    order = Window.orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    listed = manifest.withColumn("before", F.coalesce(F.sum("ids").over(order), F.lit(0))).select("path", "before")

    def read(batches):
        import pyarrow as pa

        for batch in batches:
            for uri, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                filesystem, path = open_for(uri)
                out, size = [], 0
                with filesystem.open_input_file(path) as f:
                    for key, ids in ShardReader(f):
                        out.append((decode_key(key, kind), start, len(ids) // 4, ids))
                        start += len(ids) // 4
                        size += len(ids)
                        if size > 4 << 20:
                            yield pack(out, pa)
                            out, size = [], 0
                if out:
                    yield pack(out, pa)

    def pack(rows, pa):
        k, s, n, ids = zip(*rows, strict=True)
        return pa.RecordBatch.from_arrays([pa.array(k, pa.string() if kind == "string" else pa.int64()), pa.array(s, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary())], names=["key", "start", "n_tokens", "ids"])

    # So many tasks as shards: a manifest is small, and its size says nothing about the work.
    return listed.repartition(max(1, manifest.count()), "path").mapInArrow(read, f"key {kind}, start long, n_tokens long, ids binary")


def lookup(manifest: DataFrame, keys: Iterable) -> dict:
    """Ids of a few documents: shards by key range, then Bloom filter and binary search in each. Driver-side, for point reads."""
    found: dict = {}
    for key in keys:
        raw = encode_key(key)
        found[key] = []
        for row in manifest.where((F.col("first_key") <= F.lit(raw)) & (F.col("last_key") >= F.lit(raw))).orderBy("part", "seq").collect():
            filesystem, path = open_for(row.path)
            with filesystem.open_input_file(path) as f:
                found[key] += ShardReader(f).get(raw)
    return found


def token_shards(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = 2) -> DataFrame:
    """Writes ``docs`` as shards into the shared folder and returns the manifest as a written table."""
    scratch = Scratch(spark, "sst")
    return scratch.table(write_sstables(docs, scratch.path("shards", keep=True), id_col, text_col, tokenizer_path, end_id), "manifest", keep=True)

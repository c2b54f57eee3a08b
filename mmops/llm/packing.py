"""Sum-of-squares packing of token sequences (operator 3).

A document's ids, with an end id, are cut into pieces of ``capacity`` ids; only the last piece may
be shorter. Let N(g) be how many open sequences have a gap of g ids. A piece goes where the sum of
N(g)**2 over the gaps above 0 is smallest afterwards: into a sequence of some gap, or a new one.
Ties go to the smallest gap left. Pieces over an eighth of the capacity come longest
first, then the short ones in the order of a hash, so they meet sequences of all kinds of gaps.

Groups are packed apart, so tasks never wait for each other: each has about ``group_pieces`` pieces,
dealt out by a hash of the row, whatever its id and text, and leaves a few open sequences, however large the corpus is. Full
pieces are sequences of their own. Lengths decide everything, so only lengths are shuffled unless
``with_ids`` asks for the ids too. Null and empty texts are the end id alone; repeated rows and rows whose id is null are
packed each for itself. Ids are integers; others are refused. Texts are whole, however long: one of n ids is n / capacity pieces.
"""

from __future__ import annotations

import struct
import zlib

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch
from .tokens import default_tokenizer_path, encoder_for

CAPACITY = 2048
GROUP_PIECES = 100_000


class SumOfSquares:
    """Open sequences by gap; :meth:`place` returns (sequence, offset)."""

    def __init__(self, capacity: int):
        import numpy as np

        self.capacity = capacity
        self._n = np.zeros(capacity + 1, dtype=np.int64)  # N(g); index 0 and capacity stay 0
        self._cost = np.zeros(capacity + 1, dtype=np.int64)
        self._open: dict[int, list[int]] = {}
        self.sequences = 0
        self._never = np.iinfo(np.int64).max // 4

    def place(self, size: int) -> tuple[int, int]:
        import numpy as np

        n, cap = self._n, self.capacity
        # A sequence of gap g = size + r becomes one of gap r: N(g) - 1 and, if r > 0, N(r) + 1.
        gaps = n[size : cap + 1]
        change = n[: cap + 1 - size] - gaps
        change[0] = -gaps[0]
        cost = 2 * change + 2
        cost[0] -= 1
        cost[gaps == 0] = self._never
        cost[cap - size] = 2 * n[cap - size] + 1 if size < cap else 0  # a new sequence
        left = int(np.argmin(cost))
        if left == cap - size:
            bin_id, offset = self.sequences, 0
            self.sequences += 1
        else:
            gap = left + size
            bin_id, offset = self._open[gap].pop(), cap - gap
            n[gap] -= 1
        if left:
            n[left] += 1
            self._open.setdefault(left, []).append(bin_id)
        return bin_id, offset


def token_pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = 0, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """A row per piece: the id column, piece, start, length, ids_crc32, row (another for each document), and ids as binary if ``with_ids``."""
    path = tokenizer_path or default_tokenizer_path()

    def cut(batches):
        import pyarrow as pa

        encoder, end = encoder_for(path), struct.pack("<I", end_id)
        names = ["id", "piece", "start", "length", "ids_crc32", "row", *["ids"] * with_ids]
        types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), *[pa.binary()] * with_ids]
        for batch in batches:
            rows = []
            for doc, row, ids in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), encoder.encode_all(batch.column(1).to_pylist()), strict=True):
                ids += end
                for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    rows.append((doc, piece, at // 4, len(part) // 4, zlib.crc32(part), row, *[part] * with_ids))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)], names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    if kind not in ("bigint", "int", "smallint", "tinyint"):
        raise TypeError(f"{id_col} is {kind}; packing takes integer ids")
    rows = docs.select(F.col(id_col).cast("long"), text_col, F.monotonically_increasing_id())
    pieces = rows.mapInArrow(cut, "id long, piece int, start long, length long, ids_crc32 long, row long" + ", ids binary" * with_ids)
    return pieces.select(F.col("id").alias(id_col), *pieces.columns[1:])


def pack_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, end_id: int = 0, capacity: int = CAPACITY, group_pieces: int = GROUP_PIECES, with_ids: bool = False) -> DataFrame:
    """Packs whole documents; a row per piece with its sequence_id and its offset there.

    With ``with_ids``, ``ids`` is the piece's tokens as little-endian unsigned 32-bit numbers, so a
    sequence is its pieces' ids in the order of offset.
    """
    scratch = Scratch(docs.sparkSession, "pack")
    pieces = scratch.table(token_pieces(docs, id_col, text_col, tokenizer_path, end_id, capacity, with_ids), "pieces", keep=True)
    short = pieces.where(F.col("length") < capacity).count()
    groups = max(1, -(-short // group_pieces))
    columns = pieces.columns

    def pack(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        packer, first = SumOfSquares(capacity), TaskContext.get().partitionId() << 32
        at = columns.index("length")
        for batch in batches:
            placed = [packer.place(size) for size in batch.column(at).to_pylist()]
            seqs, offsets = zip(*placed, strict=True) if placed else ((), ())
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([first + s for s in seqs], pa.int64()), pa.array(offsets, pa.int64())], names=[*columns, "sequence_id", "offset"])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    deal = F.xxhash64("row", "piece")
    dealt = pieces.repartition(groups, deal).sortWithinPartitions(F.coalesce(F.when(F.col("length") > capacity // 8, -F.col("length")), F.lit(0)), deal, "row", "piece")
    return dealt.mapInArrow(pack, f"{kinds}, sequence_id long, offset long").drop("row")

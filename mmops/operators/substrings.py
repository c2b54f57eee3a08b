"""Which texts hold which parts, for parts of any length: an inverted index of q-grams keyed by each part's rarest gram, and automata for shorter parts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..scratch import Scratch, bounded_broadcast

GRAM = 8
#: A set of grams as bits, whose size is fixed: 8 MB. What it lets through is joined by the grams themselves.
SET_BITS = 26
#: Parts of so many bytes at most are held by each task; beyond it candidates are joined with them.
PART_BYTES = 64 << 20
#: Short parts of one automaton.
BLOCK_BYTES = 2 << 20
FEW = 64
#: What a task gathers before it gives it away: rows of pairs, bytes of their texts, and grams.
OUT_ROWS = 1 << 16
OUT_BYTES = 16 << 20
OUT_GRAMS = 1 << 20


def gram_hashes(text: str):
    """A 64-bit hash of each GRAM neighbouring characters."""
    import numpy as np

    codes = np.frombuffer(text.encode("utf-32-le"), dtype="<u4").astype(np.uint64)
    n = max(0, len(codes) - GRAM + 1)
    h = np.zeros(n, np.uint64)
    for i in range(GRAM):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += codes[i : i + n]
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ h >> np.uint64(32)


def _bits(grams: DataFrame):
    """The set of the column ``gram`` as an array of 64-bit words. At most 2 ** (SET_BITS - 6) rows come to the driver."""
    import numpy as np

    bit = F.shiftrightunsigned("gram", 64 - SET_BITS)
    found = grams.select(F.shiftright(bit, 6).alias("w"), bit.bitwiseAND(63).cast("int").alias("b"))
    found = found.groupBy("w").agg(F.bit_or(F.expr("shiftleft(1L, b)")).alias("bits")).toArrow()
    words = np.zeros(1 << SET_BITS - 6, np.uint64)
    words[found.column(0).to_numpy().astype(np.int64)] = found.column(1).to_numpy().view(np.uint64)
    return words


def _among(hashes, words):
    import numpy as np

    bit = hashes >> np.uint64(64 - SET_BITS)
    return words[bit >> np.uint64(6)] >> (bit & np.uint64(63)) & np.uint64(1) == 1


def _part_grams(parts: DataFrame) -> DataFrame:
    """pid, gram, place of all grams of (pid, part)."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for pid, part in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                grams = gram_hashes(part).view(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array([pid] * len(grams), pa.binary()), pa.array(grams), pa.array(np.arange(len(grams), dtype=np.int32))], names=["pid", "gram", "place"])

    return parts.mapInArrow(run, "pid binary, gram long, place int")


def _gram_counts(texts: DataFrame, words) -> DataFrame:
    """gram, n over the texts, of the grams that may be among ``words``; summed in each task before they are shuffled."""
    held = texts.sparkSession.sparkContext.broadcast(words)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        def counted(met):
            grams, n = np.unique(np.concatenate(met), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(grams.view(np.int64)), pa.array(n, pa.int64())], names=["gram", "n"])

        for batch in batches:
            met, size = [], 0
            for text in batch.column(0):
                hashes = gram_hashes(text.as_py() or "")
                met.append(hashes[_among(hashes, held.value)])
                size += len(met[-1])
                if size >= OUT_GRAMS:
                    yield counted(met)
                    met, size = [], 0
            if met:
                yield counted(met)

    return texts.mapInArrow(run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n"))


@lru_cache(maxsize=1)
def _automaton(parts: tuple[str, ...]):
    import ahocorasick

    found = ahocorasick.Automaton()
    for i, part in enumerate(parts):
        if part:
            found.add_word(part, i)
    found.make_automaton()
    return found


def _short_found(text: str, parts: tuple[str, ...]) -> Iterator[int]:
    if len(parts) <= FEW:
        return (i for i, p in enumerate(parts) if p in text)
    met = {i for i, p in enumerate(parts) if not p}
    for _, i in _automaton(parts).iter(text):
        met.add(i)
        if len(met) == len(parts):
            break
    return iter(sorted(met))


def pair_batches(batch, at: int, names: list[str], found_in) -> Iterator:
    """The columns ``names`` of an Arrow batch, a row for each digest that ``found_in`` gives for the text in column ``at``, and the digests. A text's pairs
    may be as many as there are parts, so they go on in batches of OUT_ROWS rows and about OUT_BYTES bytes at most."""
    import pyarrow as pa

    columns = [batch.column(batch.schema.get_field_index(n)) for n in names]
    heavy = batch.schema.names[at] in names
    most = max(1, min(OUT_ROWS, OUT_BYTES * max(1, batch.num_rows) // max(1, sum(c.nbytes for c in columns))))

    def given(rows, pids):
        places = pa.array(rows, pa.int64())
        return pa.RecordBatch.from_arrays([*[c.take(places) for c in columns], pa.array(pids, pa.binary())], names=[*names, "__pid"])

    rows, pids = [], []
    for k, value in enumerate(batch.column(at)):
        value = value.as_py()
        if value is None:
            continue
        # Rows that take a long text along are more bytes than the others of its batch.
        room = max(1, min(most, OUT_BYTES // (len(value) + 64))) if heavy else most
        for pid in found_in(value):
            rows.append(k)
            pids.append(pid)
            if len(rows) >= room:
                yield given(rows, pids)
                rows, pids = [], []
    if rows:
        yield given(rows, pids)


def _matched(texts: DataFrame, text: str, keep: list[str], found_in) -> DataFrame:
    """The columns ``keep`` of ``texts`` and ``__pid`` for each of the parts' digests that ``found_in(text)`` gives."""
    at = texts.columns.index(text)

    def run(batches):
        for batch in batches:
            yield from pair_batches(batch, at, keep, found_in)

    return texts.mapInArrow(run, StructType([texts.schema[c] for c in keep]).add("__pid", "binary"))


def substring_pairs(texts: DataFrame, parts: DataFrame, text: str = "text", part: str = "part", part_bytes: int = PART_BYTES, keep: list[str] | None = None) -> DataFrame:
    """J-14 and J-18: rows of ``texts`` with rows of ``parts`` that their text holds, all columns of both, or of ``texts`` those in ``keep``.
    A pair that takes its text along is as large as that text, so leave it out of ``keep`` where nothing reads it.

    Parts of ``GRAM`` characters or more: their grams are counted over all texts, and the rarest of each is its key. A second pass
    over the texts looks for keys alone and compares the part where one is met. While the parts' bytes are within ``part_bytes``
    the tasks hold them, and no text is shuffled; beyond it (row, place, gram) are joined with the keys, and the rows that met with their texts.
    Shorter parts are looked for by automata of blocks of parts, a pass for each block.

    Null texts and parts match nothing, the empty part every text. Repeated texts and parts give their pairs as often as they are there. The columns of both
    must differ in name.
    """
    spark = texts.sparkSession
    keep = texts.columns if keep is None else keep
    scratch = Scratch(spark, "parts")
    owned = parts.where(F.col(part).isNotNull()).withColumn("__pid", F.unhex(F.sha2(F.col(part), 256)))
    distinct = owned.select(F.col("__pid").alias("pid"), F.col(part).alias("part")).distinct()
    long = scratch.table(distinct.where(F.length("part") >= GRAM), "long", keep=True)
    short = scratch.table(distinct.where(F.length("part") < GRAM), "short", keep=True)
    digest = lambda p: hashlib.sha256(p.encode()).digest()
    found = []

    # Blocks of short parts by a hash; a block's bytes are about BLOCK_BYTES.
    n_short, size = short.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("part") + 16), F.lit(0))).first()
    blocks = -(-size // BLOCK_BYTES)
    for block in range(blocks):
        rows = short.where(F.pmod(F.xxhash64("pid"), F.lit(blocks)) == block).select("part").collect()
        own = tuple(sorted(r[0] for r in rows))
        pids = [digest(p) for p in own]
        held = spark.sparkContext.broadcast((own, pids))
        found.append(_matched(texts, text, keep, lambda t, held=held: (held.value[1][i] for i in _short_found(t, held.value[0]))))

    n_long, size = long.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("part") + 64), F.lit(0))).first()
    if n_long:
        grams = scratch.table(_part_grams(long), "grams")
        wanted = grams.select("gram").distinct()
        counts = _gram_counts(texts.select(text), _bits(wanted)).join(wanted, "gram")
        keys = grams.join(counts, "gram", "left").groupBy("pid").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram", "place")).alias("k"))
        # A part with a gram that no text has is in none.
        keys = scratch.table(keys.where("k.n > 0").select("pid", "k.gram", "k.place"), "keys", keep=True)
        words = spark.sparkContext.broadcast(_bits(keys.select("gram")))
        if size <= part_bytes:
            by_gram: dict[int, list] = {}
            for r in keys.join(long, "pid").collect():
                by_gram.setdefault(r.gram, []).append((r.place, r.part, bytes(r.pid)))
            held = spark.sparkContext.broadcast(by_gram)

            def of(value: str):
                import numpy as np

                hashes = gram_hashes(value)
                at = np.flatnonzero(_among(hashes, words.value))
                return dict.fromkeys(pid for gram, i in zip(hashes[at].view(np.int64).tolist(), at.tolist(), strict=True) for place, p, pid in held.value.get(gram, ()) if i >= place and value.startswith(p, i - place))

            found.append(_matched(texts, text, keep, of))
        else:
            found.append(_joined(texts, text, keep, long, keys, words, scratch))
    scratch.close()
    if not found:
        return texts.select(*keep).join(parts.limit(0), F.lit(True), "inner")
    pairs = found[0]
    for more in found[1:]:
        pairs = pairs.unionByName(more)
    own = bounded_broadcast(owned.withColumnRenamed("__pid", "__own"), n_short + n_long, 64 + size // max(1, n_long), part_bytes)
    return pairs.join(own, F.col("__pid") == F.col("__own")).drop("__pid", "__own")


def _joined(texts: DataFrame, text: str, keep: list[str], long: DataFrame, keys: DataFrame, words, scratch: Scratch) -> DataFrame:
    """As :func:`_matched`, for parts that no task holds."""
    rows = scratch.table(texts.withColumn("__row", F.monotonically_increasing_id()), "texts", keep=True)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for row, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                hashes = gram_hashes(value or "")
                at = np.flatnonzero(_among(hashes, words.value))
                if len(at):
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), row)), pa.array(at, pa.int32()), pa.array(hashes[at].view(np.int64))], names=["row", "at", "gram"])

    met = rows.select("__row", text).mapInArrow(run, "row long, at int, gram long").join(keys, "gram").where("at >= place")
    met = scratch.table(met.select("row", "pid", (F.col("at") - F.col("place")).alias("start")), "met", keep=True)
    asked = met.join(long, "pid").select("row", "pid", "start", "part")
    same = F.substring(F.col(text), F.col("start") + 1, F.length("part")) == F.col("part")
    pairs = scratch.table(rows.join(asked, F.col("__row") == F.col("row")).where(same).select("row", "pid").distinct(), "pairs", keep=True)
    return rows.join(pairs, F.col("__row") == F.col("row")).select(*[F.col(c) for c in keep], F.col("pid").alias("__pid"))

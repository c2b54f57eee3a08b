"""Near duplicates by b-bit MinHash (operator 9).

Words are runs of anything but ASCII white space, A-Z lower-cased; a document's set holds its distinct
shingles of five words (a shorter text: all its words as one shingle). Two documents are linked where
their Jaccard similarity is at least 0.75.

1. One pass over the texts gives each row its set's size, a 128-bit digest of the set, and ``BANDS`` band
   keys over full minima.
2. Rows of one set are one class; a class costs one vertex, however many copies it has.
3. Classes that share a band key are candidates. They get a signature of the lowest bit of each of ``BITS`` minima,
   packed into longs; bit counts give the collision-corrected estimate ``(matches - 1/2) / (1/2)``. Pairs whose estimate is
   within ``SLACK`` of the threshold, and whose sizes allow it, are confirmed on their full sets.
4. Large buckets never become all pairs at once: rounds of hubs (each class against its most similar hubs of
   all its buckets, fresh hubs each round) merge most of them first, for as long as a round halves the pairs of
   different components. Then the classes that are still in different components and share a bucket of ``LARGE`` classes at most
   are judged pair by pair in the join itself, and leave it once, in the first such bucket they share, if similar enough to be confirmed.
   In larger buckets, such as of unlike pages of one template, pairs are not made: their classes' shingles are put in one order, the rare
   first, and only classes that share one of the few that a similar pair must share, at places that leave room for enough others, are
   candidates. So no link between components goes unchecked; a pair that has joined already needs no check.
5. Components are found by label propagation with pointer jumping, on written tables.

A pair at similarity s shares a band with probability 1 - (1 - s**ROWS)**BANDS: at 0.75 a pair is missed
once in 50,000, and above that less often.

Null and empty texts have the empty set, are linked with nothing and are kept. Rows whose id is null
take part; a component of null ids only has a null component_id. Repeated rows are one class. Texts are whole, however long: a
set's minima are taken in parts, so memory holds the hashes of one text.
"""

from __future__ import annotations

from functools import reduce
from itertools import count
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, bounded_broadcast

SHINGLE = 5
THRESHOLD_PERCENT = 75
BANDS, ROWS = 40, 5
#: Bits of a signature, one of each minimum; the estimate's deviation at 0.75 is 0.012, and SLACK four of it.
BITS = 3072
SLACK = 0.048
#: Most pairs are told to be unlike by the first bits of their signatures. Their estimate's deviation at 0.75 is 0.029, and FIRST_SLACK five of it.
FIRST_BITS = 512
FIRST_SLACK = 0.147
BEST_HUBS = 2
#: Hub rounds end when so many cross pairs a class with candidates are left at most, or when a round
#: with drawn hubs leaves more than half of them.
PAIRS_PER_CLASS = 4
#: Classes of a bucket whose pairs are judged one by one.
LARGE = 256
#: The order of shingles is that of counts of so many hash classes, 2 MB whatever the corpus; ties by the hash itself. Any order gives the same links.
ORDER_BITS = 18
#: Rows a task of the tables of links, labels and buckets, which are far smaller than the texts.
ROWS_A_TASK = 50_000


def shingle_hashes(data: bytes, size: int = SHINGLE):
    """Sorted distinct 64-bit hashes of the shingles of a UTF-8 text."""
    import numpy as np
    import xxhash

    words = data.lower().split()  # of bytes: A-Z only, ASCII white space only
    if not words:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    n = min(size, len(words))
    out = np.full(len(words) - n + 1, n, np.uint64)
    for i in range(n):
        out = (out ^ h[i : len(words) - n + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    out ^= out >> np.uint64(32)
    return np.unique(out)


class Signer:
    """Minima of a set under ``BANDS * ROWS`` random linear maps."""

    def __init__(self, seed: int = 11):
        import numpy as np

        rng = np.random.default_rng(seed)
        k = BANDS * ROWS
        self._a = rng.integers(1, 1 << 63, k, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._b = rng.integers(0, 1 << 63, k, dtype=np.uint64)
        self._mix = rng.integers(1, 1 << 63, ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._band = rng.integers(0, 1 << 63, BANDS, dtype=np.uint64)

    def minima(self, hashes):
        import numpy as np

        low = None
        for at in range(0, len(hashes), 256):
            m = (hashes[None, at : at + 256] * self._a[:, None] + self._b[:, None]).min(axis=1)
            low = m if low is None else np.minimum(low, m)
        return low

    def bands(self, minima):
        import numpy as np

        x = minima ^ (minima >> np.uint64(31))
        key = self._band.copy()
        for col, mix in zip(x.reshape(BANDS, ROWS).T, self._mix, strict=True):
            key = (key ^ col) * mix
            key ^= key >> np.uint64(30)
        return key.view(np.int64)


class BitSigner:
    """The lowest bit, after mixing, of each of BITS minima, packed into longs."""

    def __init__(self, seed: int = 12):
        import numpy as np

        rng = np.random.default_rng(seed)
        self._a = rng.integers(1, 1 << 63, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self._b = rng.integers(0, 1 << 63, BITS, dtype=np.uint64)

    def bits(self, hashes) -> list[int]:
        import numpy as np

        low = np.full(BITS, np.iinfo(np.uint64).max)
        for at in range(0, len(hashes), 64):
            np.minimum(low, (hashes[at : at + 64, None] * self._a + self._b).min(axis=0), out=low)
        low ^= low >> np.uint64(33)
        low *= np.uint64(0xD6E8FEB86659FD93)
        return np.packbits((low >> np.uint64(63)).astype(np.uint8)).view(np.int64).tolist()


def signatures(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """rid, id, text, n_shingles, cls (digest of the set; null if empty), bands."""

    def sign(batches):
        import pyarrow as pa
        import xxhash

        signer = Signer()
        for batch in batches:
            n, cls, bands = [], [], []
            for text in batch.column(2).cast(pa.binary()):
                hashes = shingle_hashes(text.as_py() or b"")
                n.append(len(hashes))
                if not len(hashes):
                    cls.append(None), bands.append(None)
                    continue
                minima = signer.minima(hashes)
                cls.append(xxhash.xxh3_128_digest(hashes.tobytes()))
                bands.append(signer.bands(minima))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(n, pa.int64()), pa.array(cls, pa.binary()), pa.array(bands, pa.list_(pa.int64()))],
                names=["rid", "id", "text", "n_shingles", "cls", "bands"],
            )

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(sign, f"rid long, id {kind}, text string, n_shingles long, cls binary, bands array<long>")


def bit_signatures(texts: DataFrame) -> DataFrame:
    """rid, n, text to v, n, bits (array<long>)."""

    def sign(batches):
        import pyarrow as pa

        signer = BitSigner()
        for batch in batches:
            bits = [signer.bits(shingle_hashes(t.as_py())) for t in batch.column(2).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.list_(pa.int64()))], names=["v", "n", "bits"])

    return texts.mapInArrow(sign, "v long, n long, bits array<long>")


def estimate(a: str, b: str) -> Column:
    """The collision-corrected similarity of two packed signatures: half of the bits agree by chance."""
    differ = F.aggregate(F.zip_with(a, b, lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    return (1 - differ / F.lit(float(BITS)) - 0.5) / 0.5


def first_estimate(a: str, b: str) -> Column:
    """The same of the first FIRST_BITS bits only, written out: code is generated for this, and not for lambda functions."""
    differ = reduce(add, [F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i)))) for i in range(FIRST_BITS // 64)])
    return (1 - differ / F.lit(float(FIRST_BITS)) - 0.5) / 0.5


def _similar(a: str, b: str) -> Column:
    small, large = F.least(f"{a}n", f"{b}n"), F.greatest(f"{a}n", f"{b}n")
    near, least = (f"{a}bits", f"{b}bits"), THRESHOLD_PERCENT / 100
    return (100 * small >= THRESHOLD_PERCENT * large) & (first_estimate(*near) >= least - FIRST_SLACK) & (estimate(*near) >= least - SLACK)


def _prefixes(rows: DataFrame, counts):
    """Of (v, n, text): v, n, token, left (tokens from it on), low (whether a set of the same size or a larger one must find it here)."""

    def cut(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            out = []
            for v, n, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.binary()), strict=True):
                hashes = shingle_hashes(text.as_py())
                hashes = hashes[np.lexsort((hashes, counts[hashes >> np.uint64(64 - ORDER_BITS)]))]
                # Of sets of n, a set that is similar to one of at most its size shares one of the first n - ceil(t n) + 1
                # tokens with it, and that one has it among its first n - ceil(2t / (1 + t) n) + 1.
                high = n - -(-THRESHOLD_PERCENT * n // 100) + 1
                low = n - -(-2 * THRESHOLD_PERCENT * n // (100 + THRESHOLD_PERCENT)) + 1
                at = np.arange(high)
                out.append((np.full(high, v), np.full(high, n), hashes[:high].view(np.int64), n - at, at < low))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [[]] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=["v", "n", "token", "left", "low"])

    return rows.mapInArrow(cut, "v long, n long, token long, left long, low boolean")


def _token_counts(rows: DataFrame):
    """How often the shingles of (v, n, text) are, by the first ORDER_BITS bits of their hashes: an array of fixed size."""
    import numpy as np

    def count(batches):
        import pyarrow as pa

        for batch in batches:
            sums = np.zeros(1 << ORDER_BITS, np.int64)
            for text in batch.column(2).cast(pa.binary()):
                sums += np.bincount((shingle_hashes(text.as_py()) >> np.uint64(64 - ORDER_BITS)).astype(np.int64), minlength=1 << ORDER_BITS)
            at = np.flatnonzero(sums)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(sums[at], pa.int64())], names=["at", "n"])

    found = rows.mapInArrow(count, "at long, n long").groupBy("at").agg(F.sum("n").alias("n")).toArrow()
    sums = np.zeros(1 << ORDER_BITS, np.int64)
    sums[found.column(0).to_numpy()] = found.column(1).to_numpy()
    return sums


def prefix_pairs(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """(a, b), a > b in size or id, of the (v, n, text) rows that may be similar by the prefixes of their sets and whose labels (v, label) differ."""
    tokens = _prefixes(rows, _token_counts(rows)).join(labels, "v")
    side = lambda s: [F.col("token").alias(f"{s}token"), F.col("v").alias(s), *[F.col(c).alias(f"{s}{c}") for c in ("n", "left", "label")]]
    larger, smaller = tokens.select(side("a")), tokens.where("low").select(side("b"))
    ordered = (F.col("bn") < F.col("an")) | (F.col("bn") == F.col("an")) & (F.col("b") < F.col("a"))
    room = (100 + THRESHOLD_PERCENT) * F.least("aleft", "bleft") >= THRESHOLD_PERCENT * (F.col("an") + F.col("bn"))
    sizes = 100 * F.col("bn") >= THRESHOLD_PERCENT * F.col("an")
    return larger.join(smaller, (F.col("atoken") == F.col("btoken")) & ordered & sizes & room & (F.col("alabel") != F.col("blabel"))).select("a", "b").distinct()


def confirm(pairs: DataFrame, texts: DataFrame, n_pairs: int) -> DataFrame:
    """Those of the pairs (a, b, la, lb) whose full sets are similar enough, as la, lb; texts: rid, text."""

    def exact(batches):
        import numpy as np
        import pyarrow as pa

        last: tuple = (None, None)
        for batch in batches:
            b, ta, tb = batch.column(2).to_pylist(), batch.column(3).cast(pa.binary()), batch.column(4).cast(pa.binary())
            keep = []
            for i in range(batch.num_rows):
                if last[0] != b[i]:
                    last = (b[i], shingle_hashes(tb[i].as_py()))
                x, y = shingle_hashes(ta[i].as_py()), last[1]
                both = len(np.intersect1d(x, y, assume_unique=True))
                if 100 * both >= THRESHOLD_PERCENT * (len(x) + len(y) - both):
                    keep.append(i)
            yield batch.select([0, 1]).take(pa.array(keep, pa.int64()))

    # Only the texts of pairs are shuffled: the others drop out against the broadcast ids, while those are few by their count.
    of = lambda c: texts.join(bounded_broadcast(pairs.select(F.col(c).alias("rid")).distinct(), n_pairs, 24), "rid", "left_semi").select(F.col("rid").alias(c), F.col("text").alias(f"t{c}"))
    with_a = of("a").join(bounded_broadcast(pairs, n_pairs, 48), "a")
    return with_a.join(of("b"), "b").select("la", "lb", "b", "ta", "tb").mapInArrow(exact, "la long, lb long")


def _few(df: DataFrame, rows: int) -> DataFrame:
    """No more tasks than the rows need."""
    return df.coalesce(max(4, -(-rows // ROWS_A_TASK)))


def connected_components(edges: DataFrame, n_edges: int, scratch: Scratch) -> DataFrame:
    """(v, label): the smallest vertex that each vertex of the edges (a, b) reaches. A written table.

    Each round takes the smallest label among a vertex and its neighbours, then the label of that label, so
    the rounds are about the logarithm of the longest path. The labels are broadcast while they are few, by their count.
    """
    n = 2 * n_edges
    both = scratch.table(_few(edges.where("a <> b").select(F.col("a").alias("v"), F.col("b").alias("w")).union(edges.where("a <> b").select("b", "a")).distinct(), n), "edges")
    labels = scratch.table(_few(both.groupBy("v").agg(F.least(F.min("w"), F.col("v")).alias("label")), n), "labels")
    while True:
        near = both.join(bounded_broadcast(labels.withColumnRenamed("v", "w"), n, 40), "w").select("v", "label", F.lit(None).cast("long").alias("old"))
        step = near.unionByName(labels.withColumn("old", F.col("label"))).groupBy("v").agg(F.min("label").alias("label"), F.min("old").alias("old"))
        hop = bounded_broadcast(labels.select(F.col("v").alias("label"), F.col("label").alias("far")), n, 40)
        new = scratch.table(_few(step.join(hop, "label").select("v", "old", F.least("label", "far").alias("label")), n), "labels")
        if not new.where("label <> old").limit(1).count():
            return new.select("v", "label")
        labels = new.select("v", "label")


def _hub(turn: int) -> Column:
    """A bucket's hub: at first the class that meets the most others in all its buckets, as it is the likeliest to be near what
    the others were copied from; in later rounds one drawn with that number as its weight."""
    draw = (F.pmod(F.xxhash64("v", F.lit(turn)), F.lit(1 << 30)) + 1) / float((1 << 30) + 1)
    rank = F.col("met").cast("double") if turn == 0 else F.log(draw) / F.col("met")
    return F.max(F.struct(rank.alias("rank"), "v", "label")).alias("hub")


def _crowded(rows: DataFrame, reps: DataFrame, crowd: DataFrame, n_crowd: int, scratch: Scratch) -> DataFrame:
    """(a, b, la, lb) of the classes (v, label, keys) of large buckets: of different labels, in one bucket, and similar by their signatures."""
    named = rows.select(F.col("rid").alias("v"), F.col("n_shingles").alias("n"), "text")
    members = scratch.table(named.join(bounded_broadcast(crowd.select("v"), n_crowd, 24), "v", "left_semi"), "members")
    pairs = scratch.table(prefix_pairs(members, crowd.select("v", "label")), "prefix")
    vectors = reps.join(crowd, "v")
    of = lambda s: vectors.select(F.col("v").alias(s), F.col("label").alias(f"l{s}"), F.col("n").alias(f"{s}n"), F.col("bits").alias(f"{s}bits"), F.col("keys").alias(f"{s}keys"))
    found = pairs.join(of("a"), "a").join(of("b"), "b").where(F.arrays_overlap("akeys", "bkeys") & _similar("a", "b"))
    swap = F.col("la") > F.col("lb")
    one = lambda x, y: F.when(swap, F.col(y)).otherwise(F.col(x))
    return found.select(one("a", "b").alias("a"), one("b", "a").alias("b"), one("la", "lb").alias("la"), one("lb", "la").alias("lb"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row per document: id, n_shingles, component_id (the smallest id reachable), kept (id = component_id)."""
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = scratch.table(signatures(docs, id_col, text_col), "rows", keep=True)
    grouped = rows.where("cls is not null").groupBy("cls").agg(F.min("rid").alias("v"), F.min("id").alias("least_id"), F.count("*").alias("copies"))
    classes = scratch.table(grouped, "classes", keep=True)
    # A class's first row stands for it. Only classes with copies are needed to tell, so signatures needn't be shuffled.
    copied = classes.where("copies > 1").select("cls", "v")
    firsts = rows.where("cls is not null").join(bounded_broadcast(copied, copied.count(), 80), "cls", "left").where("v is null or v = rid")
    banded = firsts.select(F.col("rid").alias("v"), F.explode("bands").alias("key"))
    shared = scratch.table(banded.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    banded = scratch.table(banded.join(bounded_broadcast(shared, shared.count(), 48), "key"), "met")
    active = scratch.table(banded.groupBy("v").agg(F.sum(F.col("n") - 1).alias("met")), "active")
    n_banded, n_active = banded.count(), active.count()
    banded = scratch.table(banded.select("v", "key").join(bounded_broadcast(active, n_active, 48), "v"), "banded")
    # Only classes that share a band key need their bits.
    active = rows.join(bounded_broadcast(active.select(F.col("v").alias("rid")), n_active, 40), "rid", "left_semi")
    reps = scratch.table(bit_signatures(active.select("rid", "n_shingles", "text")), "reps")
    texts = rows.select("rid", "text")
    side = lambda s: reps.select(F.col("v").alias(s), F.col("n").alias(f"{s}n"), F.col("bits").alias(f"{s}bits"))

    labels, n_labels, before = None, 0, None
    for turn in count():
        if labels is None:
            labelled = banded.withColumn("label", F.col("v"))
            buckets = labelled.groupBy("key").agg((F.count("*") * (F.count("*") - 1) / 2).alias("cross"), _hub(turn), (F.count("*") > LARGE).alias("large"))
        else:
            labelled = banded.join(bounded_broadcast(labels, n_labels, 40), "v", "left").select("v", "key", "met", F.coalesce("label", "v").alias("label"))
            each = labelled.groupBy("key", "label").agg(F.count("*").alias("n"), _hub(turn))
            buckets = each.groupBy("key").agg(((F.sum("n") * F.sum("n") - F.sum(F.col("n") * F.col("n"))) / 2).alias("cross"), F.max("hub").alias("hub"), (F.sum("n") > LARGE).alias("large"))
        buckets = scratch.table(_few(buckets.where("cross > 0"), n_banded), "buckets")
        n_buckets, cross = buckets.agg(F.count("*"), F.coalesce(F.sum("cross"), F.lit(0))).first()
        if not cross:
            break
        last = cross <= PAIRS_PER_CLASS * n_active or (turn > 1 and 2 * cross > before)
        before = cross
        if last:
            # All pairs of different components in a bucket. The estimate and the first shared bucket are part of
            # the join, so no other pair leaves it and none leaves it twice.
            live = scratch.table(labelled.join(bounded_broadcast(buckets.select("key", "large"), n_buckets, 41), "key").select("key", "v", "label", "large"), "live")
            few = live.where("not large")
            vectors = reps.join(few.groupBy("v").agg(F.collect_list("key").alias("keys")), "v")  # at most BANDS keys each
            of = lambda s: few.join(vectors, "v").select(F.col("key").alias(f"{s}key"), F.col("v").alias(s), F.col("label").alias(f"l{s}"), F.col("n").alias(f"{s}n"), F.col("bits").alias(f"{s}bits"), F.col("keys").alias(f"{s}keys"))
            first = F.col("akey") == F.array_min(F.array_intersect("akeys", "bkeys"))
            pairs = of("a").join(of("b"), (F.col("akey") == F.col("bkey")) & (F.col("la") < F.col("lb")) & _similar("a", "b") & first).select("a", "b", "la", "lb")
            crowd = scratch.table(live.where("large").groupBy("v").agg(F.first("label").alias("label"), F.collect_list("key").alias("keys")), "crowd")
            n_crowd = crowd.count()
            if n_crowd:
                pairs = pairs.unionByName(_crowded(rows, reps, crowd, n_crowd, scratch)).distinct()
        else:
            met = labelled.join(bounded_broadcast(buckets.select("key", "hub"), n_buckets, 80), "key").where("label <> hub.label")
            met = met.select(F.col("v").alias("a"), F.col("label").alias("la"), F.col("hub.v").alias("b"), F.col("hub.label").alias("lb")).distinct()
            near = met.join(side("b"), "b").join(side("a"), "a").where(_similar("a", "b"))
            best = Window.partitionBy("a").orderBy(F.desc("likely"), "b")
            pairs = near.select("a", "b", "la", "lb", estimate("abits", "bbits").alias("likely")).withColumn("place", F.row_number().over(best)).where(F.col("place") <= BEST_HUBS).select("a", "b", "la", "lb")
        pairs = scratch.table(_few(pairs, n_banded), "pairs")
        n_pairs = pairs.count()
        if n_pairs:
            found = scratch.table(confirm(pairs, texts, n_pairs), "found").select(F.col("la").alias("a"), F.col("lb").alias("b"))
            merged = connected_components(found, n_pairs, scratch)
            if labels is None:
                labels = merged
            else:
                moved = labels.join(bounded_broadcast(merged.select(F.col("v").alias("label"), F.col("label").alias("to")), 2 * n_pairs, 40), "label", "left").select("v", F.coalesce("to", "label").alias("label"))
                fresh = merged.join(bounded_broadcast(labels.select("v"), n_labels, 24), "v", "left_anti")
                labels = scratch.table(_few(moved.union(fresh), n_labels + 2 * n_pairs), "moved")
            n_labels += 2 * n_pairs
        if last:
            break

    least = classes.select("v", "cls", "least_id")
    if labels is not None:
        least = least.join(labels, "v", "left").withColumn("label", F.coalesce("label", "v"))
        of_label = least.groupBy("label").agg(F.min("least_id").alias("component_id"))
        least = least.join(of_label, "label").select("cls", "component_id")
    else:
        least = least.select("cls", F.col("least_id").alias("component_id"))
    least = scratch.table(least, "least", keep=True)
    scratch.close()
    out = rows.select("id", "n_shingles", "cls").join(least, "cls", "left")
    component = F.when(F.col("cls").isNull(), F.col("id")).otherwise(F.col("component_id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.col("id").eqNullSafe(component).alias("kept"))

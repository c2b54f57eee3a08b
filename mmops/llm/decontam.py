"""Benchmark decontamination by a prefix-filtered set join (operator 2). DataFrame functions only.

Words are runs of letters and digits (everything beyond ASCII counts as a letter), A-Z lower-cased. A
window is ``WINDOW`` consecutive words of an item, or the whole of a shorter item. To find every
occurrence of every window in the documents:

1. Shingles are ``SHINGLE`` consecutive words (all words of a shorter window). A first pass over the texts counts
   how often each of the items' shingles occurs; only counts leave it.
2. The shingles of a window are ordered by rarity. Containment must be complete, so the necessary prefix is one
   shingle, the rarest. A second pass joins the documents' shingles with those prefixes alone; each occurrence
   carries the few words around it. A phrase that is common in the corpus is counted, but never written.
3. Length and positional bounds: with the prefix shingle at place p of the window and at word q of the
   document, the window would start at q - p, which must be at least 0 and leave room for its length.
4. The words there must equal the window's words.

The items' shingles are broadcast only while their counted rows stay within a bound. Beyond it a broadcast set of ``COARSE`` hash classes, whose
size is fixed, lets through the shingles that may be meant; these alone are shuffled, counted before the shuffle in the first pass and as (row,
place, shingle) in the second, and the words around them are cut out of the rows that met, from a written copy of the texts.
Nothing is grouped by shingle with its rows: counts are aggregates.

Null and empty texts have no words: n_words 0, no hits. Texts are whole, however long; a row of a pass is one shingle. Null and empty items have no windows.
An item without an id has windows, which make hits, but it isn't among n_items and items_sha256.
Rows with equal or null ids are told apart inside, so a result row is made for each document row. Windows are told apart by a SHA-256 of their words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_broadcast

#: What separates words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WINDOW = 10
SHINGLE = 3
#: Rows of the set that is broadcast when the shingles themselves are too many: at most 40 MB, however many they are.
COARSE = 1 << 20
BROADCAST_BYTES = 64 << 20


def words_of(text: Column) -> Column:
    """The words of a text. It is split where words end, as that is far cheaper than to look for words; of ASCII texts, too, lower() is cheaper."""
    lowered = F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.array_remove(F.split(lowered, BETWEEN), ""), F.array().cast("array<string>"))


def shingles(words: str, size: int, place: str) -> Column:
    """array<struct<place, shingle>> of all shingles of ``size`` words."""
    parts = lambda w, i: [w, *[F.get(words, i + k) for k in range(1, size)]]
    hashed = F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - (size - 1), F.lit(0))), lambda w, i: F.struct(i.alias(place), F.xxhash64(*parts(w, i), F.lit(size)).alias("shingle")))
    return hashed


def item_windows(items: DataFrame, item_col: str = "item_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """A row per window and item: item_id, length, window (array of words)."""
    words = items.select(F.col(item_col).cast("string").alias("item_id"), words_of(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    length = F.least(F.size("words"), F.lit(window))
    starts = words.select("item_id", "words", length.alias("length"), F.explode(F.sequence(F.lit(1), F.size("words") - length + 1)).alias("at"))
    return starts.select("item_id", "length", F.slice("words", F.col("at"), F.col("length")).alias("window")).distinct()


def _may_be(rows: DataFrame, wanted: DataFrame) -> DataFrame:
    """Those of the rows whose shingle's hash class has a wanted one: all that are wanted, and by chance others."""
    part = F.pmod(F.col("shingle"), F.lit(COARSE)).cast("int").alias("part")
    return rows.withColumn("part", part).join(F.broadcast(wanted.select(part).distinct()), "part", "left_semi").drop("part")


def contamination(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = WINDOW, shingle: int = SHINGLE, broadcast_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """A row per document: the id, n_words, n_hit, n_items, items_sha256, contaminated."""
    scratch = Scratch(docs.sparkSession, "decontam")
    windows = item_windows(items, item_col, item_text_col, window)
    # Windows of equal words are looked for once; which items have them is joined at the end.
    of_items = scratch.table(windows.withColumn("wid", F.unhex(F.sha2(F.array_join("window", " "), 256))), "windows", keep=True)
    distinct = of_items.select("wid", "window", "length").distinct()
    sizes = sorted(r[0] for r in distinct.select(F.least(F.col("length"), F.lit(shingle))).distinct().limit(shingle).collect())
    places = None
    for size in sizes:
        has = distinct.where(F.least(F.col("length"), F.lit(shingle)) == size)
        part = has.select("wid", "window", "length", F.inline(shingles("window", size, "place")))
        places = part if places is None else places.union(part)

    if places is None:
        words = docs.select(F.col(id_col), F.size(words_of(F.col(text_col))).cast("long").alias("n_words"))
        return words.select(id_col, "n_words", F.lit(0).cast("long").alias("n_hit"), F.lit(0).cast("long").alias("n_items"), F.sha2(F.lit(""), 256).alias("items_sha256"), F.lit(False).alias("contaminated"))

    places = scratch.table(places, "places")
    wanted = places.select("shingle").distinct()
    n_wanted = wanted.count()
    few = n_wanted * 40 <= broadcast_bytes
    keyed = docs.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    if not few:  # rows are met again by their ids
        keyed = scratch.table(keyed, "keyed", keep=True)
    words = keyed.select("rid", "id", words_of(F.col("text")).alias("words"))
    cells = [shingles("words", size, "at") for size in sizes]
    cells = F.concat(*cells) if len(cells) > 1 else cells[0]
    spread = words.select(F.inline(cells))
    if few:
        rarity = spread.join(F.broadcast(wanted), "shingle").groupBy("shingle").agg(F.count("*").alias("df"))
    else:
        rarity = _may_be(spread, wanted).groupBy("shingle").agg(F.count("*").alias("df")).join(wanted, "shingle")
    rarity = scratch.table(rarity, "rarity")

    # A window with a shingle that no document has can't occur: it drops out here.
    ranked = places.join(rarity, "shingle", "left").groupBy("wid").agg(F.min(F.struct(F.coalesce("df", F.lit(0)).alias("df"), "shingle", "place")).alias("rarest"), F.first("window").alias("window"), F.first("length").alias("length"))
    prefix = ranked.where("rarest.df > 0").select("wid", "window", "length", F.col("rarest.shingle").alias("shingle"), F.col("rarest.place").alias("place"))
    prefix = scratch.table(prefix, "prefix")
    n_prefix = prefix.count()
    rarest = prefix.select("shingle", F.lit(True).alias("wanted")).distinct()
    around = window - 1
    first = F.greatest(F.col("at") - around, F.lit(0))
    context = F.slice("words", first + 1, F.lit(2 * around + shingle))
    n_words = F.size("words").cast("long").alias("n_words")
    if few:
        # The element at -1 stays for every document and carries its words' count.
        head = F.array(F.struct(F.lit(-1).alias("at"), F.lit(None).cast("long").alias("shingle")))
        met = words.select("rid", "id", "words", F.inline(F.concat(head, cells))).join(F.broadcast(rarest), "shingle", "left").where(F.col("wanted") | (F.col("at") == -1))
        met = met.select("rid", F.when(F.col("at") < 0, F.col("id")).alias("id"), "at", "shingle", n_words, first.alias("first"), F.when(F.col("at") >= 0, context).alias("context"))
        met = scratch.table(met, "met", keep=True)
        counted, found = met.where("at = -1").select("rid", "id", "n_words"), met.where("at >= 0")
    else:
        counted = scratch.table(words.select("rid", "id", n_words), "counted", keep=True)
        places_met = _may_be(words.select("rid", F.inline(cells)), rarest).join(rarest, "shingle")
        of_row = scratch.table(places_met.groupBy("rid").agg(F.collect_list(F.struct("at", "shingle")).alias("met")), "places-met")
        found = words.join(bounded_broadcast(of_row, of_row.agg(F.coalesce(F.sum(F.size("met") + 2), F.lit(0))).first()[0], 24, broadcast_bytes), "rid")
        found = found.select("rid", "words", F.inline("met")).select("rid", "at", "shingle", n_words, first.alias("first"), context.alias("context"))
        found = scratch.table(found, "met")
    hinted = bounded_broadcast(prefix, n_prefix, 400, broadcast_bytes)
    start = F.col("at") - F.col("place")
    candidates = found.join(hinted, "shingle").where((start >= 0) & (start + F.col("length") <= F.col("n_words")))
    hits = candidates.where(F.slice("context", start - F.col("first") + 1, F.col("length")) == F.col("window")).select("rid", "wid", start.alias("start"), "length")
    hits = scratch.table(hits, "hits")

    covered = hits.select("rid", F.explode(F.sequence(F.col("start"), F.col("start") + F.col("length") - 1)).alias("word")).distinct().groupBy("rid").agg(F.count("*").alias("n_hit"))
    named = hits.select("rid", "wid").distinct().join(of_items.select("wid", "item_id"), "wid").select("rid", "item_id").distinct()
    named = named.groupBy("rid").agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    result = scratch.table(covered.join(named, "rid"), "result", keep=True)
    scratch.close()
    out = counted.join(result, "rid", "left")
    items_of = F.coalesce("items", F.array().cast("array<string>"))
    return out.select(
        F.col("id").alias(id_col), "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(items_of).cast("long").alias("n_items"),
        F.sha2(F.array_join(items_of, ","), 256).alias("items_sha256"), (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
    )

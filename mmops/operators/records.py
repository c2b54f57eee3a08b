"""Conversation records: merging, cleaning, sampling and numbering. DataFrame in, DataFrame out."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences
from ..scratch import Scratch

TURN = "struct<from:string,value:string>"


def turns_to_records(turns: DataFrame, key: str, order: str, role: str = "from", text: str = "value") -> DataFrame:
    """A row per conversation with its turns in order as an array of struct<from, value>. A conversation is a row of the result,
    so its turns must fit one."""
    item = F.struct(F.col(order).alias("o"), F.col(role).alias("from"), F.col(text).alias("value"))
    grouped = turns.groupBy(key).agg(F.array_sort(F.collect_list(item)).alias("items"))
    return grouped.select(key, F.transform("items", lambda t: F.struct(t["from"].alias("from"), t["value"].alias("value"))).alias("conversations"))


def merge_items(items: DataFrame, folder: str, image: str, item_no: str, conversations: str) -> DataFrame:
    """P-02: the items of one image as one record: the first item's image, all turns one after another, later images taken out (P-01)."""
    item = F.struct(F.col(item_no).alias("n"), F.col(image).alias("image"), F.col(conversations).alias("turns"))
    merged = items.groupBy(folder, image).agg(F.array_sort(F.collect_list(item)).alias("items"))
    turns = F.flatten(F.transform("items", lambda i: i.turns))
    return merged.select(folder, F.col("items")[0]["image"].alias("image"), sequences.without_later_images(turns).alias("conversations"))


def with_folder(records: DataFrame, folder: str, image: str = "image") -> DataFrame:
    """P-03: image paths below their folder."""
    return records.withColumn(image, F.concat_ws("/", F.col(folder), F.col(image)))


def numbered(df: DataFrame, name: str, order: list[str], within: list[str] | None = None, start: int = 1) -> DataFrame:
    """W-01 to W-04: consecutive numbers, within groups or over all.

    Over all rows no window sees everything: rows are sorted by range and written with their partition and their place in it,
    once, so that the counts and the numbers are of the same partitions; then each partition's offset is added.
    """
    if within:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*within).orderBy(*order)) + (start - 1))
    parts = ranged(df, order)
    counts = parts.groupBy("__p").agg(F.count("*").alias("n"), F.min("__i").alias("first"))  # a row a partition
    before = F.sum("n").over(Window.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1))
    offsets = counts.select("__p", "first", F.coalesce(before, F.lit(0)).alias("before"))
    return parts.join(F.broadcast(offsets), "__p").withColumn(name, F.col("before") + F.col("__i") - F.col("first") + start).drop("__p", "__i", "first", "before")


def ranged(df: DataFrame, order: list) -> DataFrame:
    """The rows in ranges of ``order`` as a written table, with the range ``__p`` and the place ``__i``, which rises within a range.
    Written, because a second run of the same plan may sample other ranges and merge other partitions."""
    parts = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__p", F.spark_partition_id()).withColumn("__i", F.monotonically_increasing_id())
    return Scratch(df.sparkSession, "ranged").table(parts, "ranged", keep=True)


def drop_empty(items: DataFrame, conversations: str = "conversations") -> DataFrame:
    """P-07: items without turns go; the numbers of the others stay."""
    return items.where(F.size(conversations) > 0)


def sampling_rate(name: str) -> tuple[str, float]:
    """L-05: (path, rate) of a name with an optional %N."""
    found = re.match(r"(.*)%(\d+)$", name)
    return (found[1], int(found[2]) / 100) if found else (name, 1.0)


def rate_of(name: Column) -> Column:
    """L-05 as a column."""
    percent = F.regexp_extract(name, r"%([0-9]+)$", 1)
    return F.when(percent != "", percent.cast("double") / 100).otherwise(F.lit(1.0))


def sample_fraction(df: DataFrame, rate: float, key: str, seed: int = 0) -> DataFrame:
    """L-04: int(n * rate) rows without replacement where the rate is under 1, chosen by a hash of the key.

    A threshold on the hash is found from approximate quantiles of it, so that only the rows near the cut are sorted.
    """
    if rate >= 1.0:
        return df
    n = int(df.count() * rate)
    if n <= 0:
        return df.limit(0)
    hashed = df.withColumn("__h", F.xxhash64(F.col(key), F.lit(seed)))
    low, high = (hashed.select("__h").approxQuantile("__h", [max(0.0, rate - 0.02), min(1.0, rate + 0.02)], 0.005) or [None, None])
    sure = hashed.where(F.col("__h") < low)
    left = n - sure.count()
    unsure = hashed.where((F.col("__h") >= low) & (F.col("__h") <= high))
    if left < 0 or left > unsure.count():
        return hashed.orderBy("__h", key).limit(n).drop("__h")
    return sure.unionByName(unsure.orderBy("__h", key).limit(left)).drop("__h")


#: Ranges of the hash that each data set's rows are counted in, and of which the one with the cut is ranked.
SAMPLE_BITS = 16


def sample_mixture(rows: DataFrame, dataset: str, rate: Column, key: str, seed: int = 0) -> DataFrame:
    """L-04 and L-05 for many data sets at once: of each int(n * rate) rows without replacement, all where the rate is 1 or more, chosen by a hash of the key.

    Two scans of the mixture, however many data sets it has: the first counts each one's rows by ranges of the hash, sums that merge; a range in which
    the wanted number is reached is the cut. The second keeps the ranges before it and, of the cut alone, the first rows by hash and key, so
    a data set of any size ranks one in 65,536 of its rows. ``rate`` is the same for all rows of a data set; a null data set is one like others.
    """
    hashed = F.xxhash64(F.col(key), F.lit(seed))
    marked = rows.withColumns({"__rate": rate, "__h": hashed, "__part": F.shiftrightunsigned(hashed, 64 - SAMPLE_BITS).cast("int")})
    counts = marked.groupBy(dataset, "__part").agg(F.count("*").alias("n"), F.max("__rate").alias("rate"))
    upto = Window.partitionBy(dataset).orderBy("__part")
    summed = counts.withColumns({"before": F.sum("n").over(upto) - F.col("n"), "all": F.sum("n").over(Window.partitionBy(dataset))})
    wanted = F.when(F.col("rate") >= 1, F.col("all")).otherwise((F.col("all") * F.col("rate")).cast("long"))
    cut = summed.withColumn("wanted", wanted).where((F.col("before") < F.col("wanted")) & (F.col("before") + F.col("n") >= F.col("wanted")))
    cut = cut.select(F.col(dataset).alias("__d"), F.col("__part").alias("__cut"), (F.col("wanted") - F.col("before")).alias("__left"))  # a row a data set
    joined = marked.join(cut, F.col(dataset).eqNullSafe(F.col("__d")) & (F.col("__part") <= F.col("__cut")))
    sure = joined.where("__part < __cut").select(*rows.columns)
    place = F.row_number().over(Window.partitionBy(dataset).orderBy("__h", key))
    rest = joined.where("__part = __cut").withColumn("__place", place).where("__place <= __left").select(*rows.columns)
    return sure.unionByName(rest)


def union_all(*tables: DataFrame) -> DataFrame:
    """S-01 and S-02: all rows; columns that a table lacks are null."""
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t, allowMissingColumns=True)
    return out


def changed_rows(new: DataFrame, old: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """P-12: the rows of ``new`` that differ from ``old`` in any value, or that it lacks. Nulls are equal."""
    before = old.select(*keys, F.struct(*values).alias("__old"))
    return new.join(before, keys, "left").where(~F.struct(*[F.col(v) for v in values]).eqNullSafe(F.col("__old"))).drop("__old")


def deref_images(rows: DataFrame, index: str = "index", image: str = "image", longest: int = 64) -> DataFrame:
    """P-20 and J-17: an image of at most 64 characters is another row's index. A target that is missing or
    itself short gives null and an error."""
    target = rows.select(F.col(index).cast("string").alias("__k"), F.col(image).alias("__image")).where(F.length("__image") > longest)
    target = target.dropDuplicates(["__k"])
    short = F.length(image) <= longest
    joined = rows.withColumn("__key", F.when(short, F.col(image))).join(target, F.col("__key") == F.col("__k"), "left")
    found = F.when(short, F.col("__image")).otherwise(F.col(image))
    return joined.select(*[F.col(c) for c in rows.columns if c != image], found.alias(image), F.when(short & F.col("__image").isNull(), "image not found").alias("error"))


def lower_column_names(df: DataFrame) -> DataFrame:
    """P-16: lower-case names, but for the option columns A to Z."""
    return df.toDF(*[c if re.fullmatch("[A-Z]", c) else c.lower() for c in df.columns])


def index_as_number(df: DataFrame, index: str = "index") -> DataFrame:
    """P-19: a number where every row's index is digits."""
    if df.where(~F.coalesce(F.col(index).cast("string").rlike("^[0-9]+$"), F.lit(False))).limit(1).count():
        return df
    return df.withColumn(index, F.col(index).cast("long"))


def last_of_duplicates(df: DataFrame, key: str, order: str) -> DataFrame:
    """Of rows with one key the last in order wins (the rule of duplicate keys). An aggregate, so a hot key costs a row a task."""
    return df.groupBy(key).agg(F.max_by(F.struct(*[c for c in df.columns if c != key]), order).alias("__row")).select(key, "__row.*")


def next_sample(df: DataFrame, within: list[str], order: str, value: str, name: str) -> DataFrame:
    """W-10: the next row's value, the last row's own."""
    w = Window.partitionBy(*within).orderBy(order)
    return df.withColumn(name, F.coalesce(F.lead(value).over(w), F.col(value)))

"""Folders of a data set, message content, label groups and configuration."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import chip_key, is_video, words

# Label folders by priority with the name shown for each, and usual image folders.
LABEL_FOLDERS = {"jsons": "jsons", "jsons-segm": "jsons-segm", "jsons-sem": "jsons-segm", "jsons-detect": "jsons-detect", "jsons-det": "jsons-detect"}
IMAGE_FOLDERS = ("images", "image", "imgs", "JPEGImages")
OTHERS = "others"


def shown_folder(name: Column) -> Column:
    """T-22: the name that stands for a label folder; unknown names stay, empty ones are jsons."""
    n = F.regexp_replace(F.trim(F.coalesce(name, F.lit("jsons"))), "^/+|/+$", "")
    alias = F.create_map(*[F.lit(x) for p in LABEL_FOLDERS.items() for x in p])
    return F.when(F.startswith(F.trim(name), F.lit("/")), F.regexp_replace(F.trim(name), "(?<=.)/+$", "")).when(n == "", "jsons").otherwise(F.coalesce(F.try_element_at(alias, n), n))


def geometry_of_folder(name: Column) -> Column:
    """T-22: the geometry that a label folder's name promises; null if none."""
    last = shown_folder(F.regexp_extract(F.regexp_replace(name, "/+$", ""), "([^/]*)$", 1))
    return F.when(last == "jsons-segm", "polygon").when(last == "jsons-detect", "rectangle")


def _first_of_each(options: DataFrame, by: list[str], key: str) -> DataFrame:
    first = options.groupBy(*by, key).agg(F.min(F.struct("rank", "name")).alias("o"))
    place = F.row_number().over(Window.partitionBy(*by).orderBy("o.rank", "o.name"))
    return first.select(*by, F.col("o.name").alias("name"), place.alias("place"))


def label_folder_options(folders: DataFrame, by: list[str]) -> DataFrame:
    """V-05 and V-06: the label folders that hold labels (column ``n_labels``) by priority, once for each shown name."""
    rank = F.create_map(*[x for i, n in enumerate(LABEL_FOLDERS) for x in (F.lit(n), F.lit(i))])
    known = folders.where("n_labels > 0").withColumn("rank", F.try_element_at(rank, F.col("folder"))).where("rank is not null")
    return _first_of_each(known.withColumn("name", shown_folder(F.col("folder"))), by, "name")


def image_folder_options(folders: DataFrame, by: list[str]) -> DataFrame:
    """V-07 and V-08: the root, usual folders, then any other visible folder that holds images (``n_images``); once without regard to case."""
    rank = F.create_map(F.lit("."), F.lit(0), *[x for i, n in enumerate(IMAGE_FOLDERS) for x in (F.lit(n), F.lit(i + 1))])
    seen = folders.where("n_images > 0 and (folder = '.' or not startswith(folder, '.'))")
    ranked = seen.withColumn("rank", F.coalesce(F.try_element_at(rank, F.col("folder")), F.lit(99))).withColumn("name", F.col("folder")).withColumn("low", F.lower("folder"))
    return _first_of_each(ranked, by, "low")


def resolve_folder(folders: DataFrame, wanted: DataFrame, by: list[str]) -> DataFrame:
    """V-06 and V-08: the folder that a wanted name means: the same, else the same without regard to case, else of the same shown name."""
    f = folders.select(*by, F.col("folder").alias("found"))
    joined = wanted.join(f, by, "left")
    place = F.when(F.col("found") == F.col("wanted"), 0).when(F.lower("found") == F.lower("wanted"), 1).when(shown_folder(F.col("found")) == shown_folder(F.col("wanted")), 2)
    best = F.min(F.when(place.isNotNull(), F.struct(place.alias("p"), "found")))
    return joined.groupBy(*by, "wanted").agg(best.alias("b")).select(*by, "wanted", F.col("b.found").alias("found"))


def vision_items(content: Column) -> Column:
    """P-26: the parts of a message (struct<type, text, image, image_url, video>) that are pictures or videos."""
    return F.filter(content, lambda c: c.image.isNotNull() | c.image_url.isNotNull() | c.video.isNotNull() | F.coalesce(c.type.isin("image", "image_url", "video"), F.lit(False)))


def typed_parts(content: Column) -> Column:
    """P-28: each part as struct<type, value>: image before text before video; parts of none go."""
    kind = lambda c: F.when(c.image.isNotNull(), F.struct(F.lit("image").alias("type"), c.image.alias("value"))).when(c.text.isNotNull(), F.struct(F.lit("text").alias("type"), c.text.alias("value"))).when(c.video.isNotNull(), F.struct(F.lit("video").alias("type"), c.video.alias("value")))
    return F.filter(F.transform(content, kind), lambda p: p.isNotNull())


def folder_messages(files: DataFrame, by: str, prompt: str, suffixes: tuple[str, ...], low: int | None = None, high: int | None = None) -> DataFrame:
    """P-27 and P-35: one message a folder: its pictures in the order of names with their pixel limits, then the prompt."""
    media = F.struct("name", F.when(is_video(F.col("path")), "video").otherwise("image").alias("type"), F.col("path").alias("value"), F.lit(low).cast("long").alias("min_pixels"), F.lit(high).cast("long").alias("max_pixels"))
    own = files.where(F.col("suffix").isin(*suffixes) | is_video(F.col("path"))).groupBy(by).agg(F.array_sort(F.collect_list(media)).alias("m"))
    parts = F.transform("m", lambda x: F.struct(x.type.alias("type"), x.value.alias("value"), x.min_pixels.alias("min_pixels"), x.max_pixels.alias("max_pixels")))
    said = F.struct(F.lit("text").alias("type"), F.lit(prompt).alias("value"), F.lit(None).cast("long").alias("min_pixels"), F.lit(None).cast("long").alias("max_pixels"))
    return own.select(by, F.lit("user").alias("role"), F.concat(parts, F.array(said)).alias("content"))


def merge_maps(old: Column, new: Column) -> Column:
    """V-10: the union of two maps; the new one wins."""
    kept = F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: ~F.map_contains_key(F.coalesce(new, F.create_map().cast("map<string,string>")), k))
    return F.map_concat(kept, F.coalesce(new, F.create_map().cast("map<string,string>")))


def with_defaults(arguments: list[str], defaults: dict) -> list[str]:
    """C-CFG-1: defaults before the arguments, but for those that the arguments name, empty ones and nested ones; truth values as text."""
    given = {a.lstrip("-").split("=")[0] for a in arguments if a.startswith("--")}
    out: list[str] = []
    for key, value in defaults.items():
        if key not in given and value not in (None, "") and not isinstance(value, dict):
            out += [f"--{key}", str(value)]
    return out + arguments


def named_argument(arguments: list[str], name: str, default: str | None = None) -> str | None:
    """C-CFG-2: the last value of --name value or --name=value."""
    found = default
    for a, b in zip(arguments, [*arguments, None][1:], strict=True):
        if a == f"--{name}" and b is not None:
            found = b
        elif a.startswith(f"--{name}="):
            found = a.split("=", 1)[1]
    return found


def cluster_chips(chips: DataFrame, groups: DataFrame, by: list[str]) -> DataFrame:
    """S-10: chips (``chip``) with the title of the first group (``group_no``, ``title``, ``keys``) that names them, others under a title of their own."""
    spread = groups.select(*by, "group_no", "title", F.explode("keys").alias("k")).withColumn("chip", chip_key(F.col("k")))
    first = spread.groupBy(*by, "chip").agg(F.min_by("title", "group_no").alias("title"))
    return chips.withColumn("chip", chip_key(F.col("chip"))).distinct().join(first, [*by, "chip"], "left").withColumn("title", F.coalesce(F.nullif(F.trim("title"), F.lit("")), F.lit(OTHERS)))


def merge_clusters(old: Column, new: Column, scope: Column) -> Column:
    """S-09: groups array<struct<title, keys>>: the old ones without the keys in scope, empty ones gone, then the new ones."""
    known = F.transform(scope, chip_key)
    kept = F.transform(old, lambda g: F.struct(g["title"].alias("title"), F.filter(g["keys"], lambda k: ~F.array_contains(known, chip_key(k))).alias("keys")))
    return F.concat(F.filter(kept, lambda g: F.size(g["keys"]) > 0), new)


def lengths_or_ones(records: DataFrame, order: str, lengths: str = "num_tokens") -> DataFrame:
    """A-25: the known lengths if the first record has one, else ones."""
    first = records.agg(F.min_by(lengths, order)).first()[0]
    return records.withColumn("length", F.col(lengths).cast("long") if first is not None else F.lit(1).cast("long"))


def caption_budget(n_phrases: Column) -> Column:
    """E-05: tokens that a caption of so many phrases may take."""
    return F.least(F.lit(1024), F.greatest(F.lit(256), 48 * n_phrases + 64))


def cover_chunk(objects: DataFrame, by: list[str], wanted: str, near: str, order: str, most: int = 10) -> DataFrame:
    """Q-05: of the wanted objects of an image the near ones first, then the others, in order; ten at most."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(near), order))
    return objects.where(F.col(wanted)).withColumn("place", place).where(F.col("place") <= most)


def concat_positions(rows: DataFrame, by: list[str], order: str, positions: str = "positions") -> DataFrame:
    """G-18: the three position lists of the members one after another."""
    grouped = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(positions).alias("p")))).alias("m"))
    return grouped.select(*by, F.array(*[F.flatten(F.transform("m", _axis(i))) for i in range(3)]).alias(positions))


def _axis(i: int):
    return lambda x: x.p[i]


def audit_row(result: DataFrame) -> DataFrame:
    """D-01: with the local time of the check, to the second."""
    return result.withColumn("validated_at", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss"))


def compare_outputs(rows: DataFrame, got: str = "got", want: str = "want") -> DataFrame:
    """G-24: whether two outputs agree: as text without outer space, by lines without empty ones, by words, or as numbers. No code is run."""

    @F.pandas_udf("boolean")
    def same(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([outputs_agree(x, y) for x, y in zip(a, b, strict=True)])

    return rows.withColumn("agree", same(F.col(got), F.col(want)))


def outputs_agree(a: str | None, b: str | None) -> bool:
    if a is None or b is None:
        return a is b
    lines = lambda s: [x.strip() for x in s.strip().split("\n") if x.strip()]
    if lines(a) == lines(b) or a.split() == b.split():
        return True
    x, y = a.split(), b.split()
    try:
        return len(x) == len(y) and all(abs(float(p) - float(q)) <= 1e-6 + 1e-5 * abs(float(q)) for p, q in zip(x, y, strict=True))
    except ValueError:
        return False


def word_count(text: Column) -> Column:
    return F.size(words(text))

"""Drafts of an annotation project: refreshing and saving captions, prompts, work lists, exports, folder probes and small look-ups.

Rows are keyed by image (``stem``); a caption's phrases are array<struct<obj_id, phrase, ...>> and few. Nothing is collected.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..scratch import bounded_broadcast
from .grounding import pick_phrases, used_phrases, with_spans
from .records import numbered
from .workspace import IMAGE_FOLDERS

# Most phrases to avoid and to lock, most modifiers and features, and missing files shown.
MOST_AVOIDED, MOST_LOCKED, MOST_MODIFIERS, MOST_FEATURES = 16, 8, 12, 2
MISSING_SHOWN = 5
CHOSEN = "array<struct<obj_id:long,phrase:string>>"
ITEMS = "array<struct<obj_id:long,phrase:string,keep_source_label:boolean,features:array<string>>>"


# ------------------------------------------------------------------ captions


def chosen_phrases(phrases: Column) -> Column:
    """The phrases of a caption, trimmed, without empty ones and those of no object, once each by object and text without regard to case."""
    clean = F.filter(F.transform(phrases, lambda p: F.struct(p.obj_id.cast("long").alias("obj_id"), text.strip(p.phrase).alias("phrase"))), lambda p: p.obj_id.isNotNull() & (p.phrase != ""))
    low = lambda p: F.struct(p.obj_id, F.lower(p.phrase))
    return F.filter(clean, lambda p, i: F.array_position(F.transform(clean, low), low(p)) == i + 1)


def _written(rows: DataFrame, write: Callable[[Column], Column]) -> DataFrame:
    """Caption and spans of rows with ``phrases``; a caption without phrases is empty."""
    none = F.size("phrases") == 0
    rows = rows.withColumn("caption", F.when(none, "").otherwise(write(F.transform("phrases", lambda p: p.phrase)))).withColumn("__p", F.transform("phrases", lambda p: p.phrase))
    return with_spans(rows, phrases="__p", complete=True).drop("__p")


def phrase_items(df: DataFrame, phrases: str) -> Column:
    """The phrases of a column as ``ITEMS``; fields that its structs lack are false and null."""
    names = df.schema[phrases].dataType.elementType.names
    keep = lambda p: F.coalesce(p.keep_source_label, F.lit(False)) if "keep_source_label" in names else F.lit(False)
    features = lambda p: p.features if "features" in names else F.lit(None).cast("array<string>")
    return F.transform(phrases, lambda p: F.struct(p.obj_id.cast("long").alias("obj_id"), p.phrase.alias("phrase"), keep(p).alias("keep_source_label"), features(p).alias("features")))


def chosen_items(items: Column) -> Column:
    """``ITEMS`` trimmed, with two features at most, without empty phrases and those of no object, once each by object, text without regard to case,
    and whether the label is kept."""
    features = lambda p: F.slice(F.filter(F.transform(p.features, text.strip), lambda f: f != ""), 1, MOST_FEATURES)
    clean = F.transform(items, lambda p: F.struct(p.obj_id.alias("obj_id"), text.strip(p.phrase).alias("phrase"), p.keep_source_label.alias("keep_source_label"), F.when(F.size(features(p)) > 0, features(p)).alias("features")))
    clean = F.filter(clean, lambda p: p.obj_id.isNotNull() & (p.phrase != ""))
    key = lambda p: F.struct(p.obj_id, F.lower(p.phrase), p.keep_source_label)
    # Both arrays are bound once.
    return F.transform(F.array(clean), lambda c: F.transform(F.array(F.transform(c, key)), lambda keys: F.filter(c, lambda p, i: F.array_position(keys, key(p)) == i + 1))[0])[0]


def refresh_captions(captions: DataFrame, requests: DataFrame, descriptions: DataFrame, write: Callable[[Column], Column] = text.template_caption, stem: str = "stem") -> DataFrame:
    """Q-11: the captions asked for in ``requests`` (stem, sentence_id, phrases or null) written anew; the others stay as they are.

    A request's phrases, else the caption's own, are kept; objects are never lost, and those of phrases are added. Phrases given as an empty
    list make an empty caption. A caption whose phrases are null gets fresh ones for its objects that no caption of the image has chosen. All columns stay; of a
    caption written anew the translation ``zh`` is emptied, as it says something else, and a strategy it lacks is refresh. Sentences are numbered anew from 0.
    """
    asked = requests.select(stem, "sentence_id", phrase_items(requests, "phrases").alias("__new"), F.lit(True).alias("__asked"))
    given = captions.withColumn("phrases", phrase_items(captions, "phrases"))
    joined = given.join(asked, [stem, "sentence_id"], "left")
    todo = joined.where("__asked").withColumn("__chosen", chosen_items(F.coalesce("__new", "phrases")))
    bare = captions.where("phrases is null").select(stem, "sentence_id")
    if bare.limit(1).count():  # else none can lack phrases, and no description is read
        need = bare.join(requests.where("phrases is null"), [stem, "sentence_id"], "left_semi").select(stem).distinct()
        spread = todo.where("__chosen is null").select(stem, "sentence_id", F.posexplode("obj_ids").alias("pos", "obj_id"))
        here = captions.join(need, stem, "left_semi")
        fresh = pick_phrases(descriptions.join(need, stem, "left_semi"), used_phrases(here, stem), stem=stem).select(stem, "obj_id", "phrase", "keep_source_label", "features")
        drawn = spread.join(fresh, [stem, "obj_id"]).groupBy(stem, "sentence_id").agg(F.array_sort(F.collect_list(F.struct("pos", "obj_id", "phrase", "keep_source_label", "features"))).alias("__d"))
        drawn = drawn.select(stem, "sentence_id", F.transform("__d", lambda d: F.struct(d.obj_id.cast("long").alias("obj_id"), d.phrase.alias("phrase"), d.keep_source_label.alias("keep_source_label"), d.features.alias("features"))).alias("__drawn"))
        todo = todo.join(drawn, [stem, "sentence_id"], "left")
    else:
        todo = todo.withColumn("__drawn", F.lit(None).cast(ITEMS))
    todo = todo.withColumn("phrases", F.coalesce("__chosen", "__drawn", F.array().cast(ITEMS)))
    todo = todo.withColumn("obj_ids", F.array_distinct(F.concat("obj_ids", F.transform("phrases", lambda p: p.obj_id))))
    if "zh" in captions.columns:
        todo = todo.withColumn("zh", F.lit(""))
    if "strategy" in captions.columns:
        todo = todo.withColumn("strategy", F.when(F.col("__chosen").isNull(), F.col("strategy")).otherwise(F.coalesce("strategy", F.lit("refresh"))))
    done = _written(todo, write).select(*captions.columns)
    both = joined.where("__asked is null").select(*captions.columns).unionByName(done)
    return both.withColumn("sentence_id", F.row_number().over(Window.partitionBy(stem).orderBy("sentence_id")) - 1)


def save_captions(captions: DataFrame) -> DataFrame:
    """P-32: captions as saved: without any chosen phrase the caption, its translation and its phrases are empty; else spans are found anew."""
    rows = captions.withColumn("__any", F.exists(F.coalesce("phrases", F.array().cast(CHOSEN)), lambda p: F.coalesce(text.strip(p.phrase), F.lit("")) != ""))
    rows = rows.withColumn("phrases", F.when(F.col("__any"), F.col("phrases")).otherwise(F.array().cast(captions.schema["phrases"].dataType)))
    rows = rows.withColumns({c: F.when(F.col("__any"), F.col(c)).otherwise("") for c in ("caption", "zh")}).withColumn("__p", F.transform("phrases", lambda p: p.phrase))
    return with_spans(rows, phrases="__p").drop("__p", "__any")


def save_descriptions(old: DataFrame, edits: DataFrame, keys: tuple[str, ...] = ("stem", "obj_id")) -> DataFrame:
    """P-32: the edited descriptions that differ from the old ones: phrases trimmed, empty ones gone."""
    clean = F.filter(F.transform("phrases", text.strip), lambda p: p != "")
    edited = edits.withColumn("phrases", clean)
    return edited.join(old.select(*keys, F.col("phrases").alias("__old")), list(keys), "left").where(~F.col("phrases").eqNullSafe(F.col("__old"))).drop("__old")


# ------------------------------------------------------------------ prompts (own wording)


def phrases_prompt(phrases: Column) -> Column:
    """P-24: a line for each object in the order it is first named; an object's several phrases stand together, as they mean one thing."""
    ids = F.array_distinct(F.transform(phrases, lambda p: F.coalesce(p.obj_id, F.lit(-1).cast("long"))))

    def line(i):
        own = F.transform(F.filter(phrases, lambda p: F.coalesce(p.obj_id, F.lit(-1).cast("long")) == i), lambda p: text.strip(p.phrase))
        name = F.when(i < 0, "object ?").otherwise(F.concat(F.lit("object "), i.cast("string")))
        return F.concat(name, F.when(F.size(own) > 1, F.concat(F.lit(" (one thing, "), F.size(own).cast("string"), F.lit(" phrases): "))).otherwise(": "), F.array_join(own, " | "))

    head = F.concat(F.lit("Write one sentence about "), F.size(ids).cast("string"), F.lit(" objects. Phrases by object:"))
    return F.concat_ws("\n", head, F.array_join(F.transform(ids, line), "\n"))


def code_prompt(question: Column, starter: Column, function: Column) -> Column:
    """P-23: a programming task: by standard input and output, unless it names a function or gives a beginning."""
    given = F.coalesce(starter, F.lit("")) != ""
    io = ~given & (F.coalesce(function, F.lit("")) == "")
    how = F.when(io, "Read standard input and print the answer.").otherwise("Complete the function that is asked for.")
    return F.concat_ws("\n", F.concat(F.lit("Task: "), question), how, F.when(given, F.concat(F.lit("Begin with:\n"), starter)), F.lit("Answer with code."))


def ocr_prompt(languages: Column | None = None) -> Column:
    """P-23: asks for the text of a picture."""
    base = F.lit("Read all text in the image, line by line, and nothing else.")
    return base if languages is None else F.concat_ws(" ", base, F.concat(F.lit("It may be in "), F.array_join(languages, ", "), F.lit(".")))


def video_prompt(question: Column, options: Column, subtitles: Column) -> Column:
    """P-21: a question on a video, with its subtitles if there are any."""
    shown = F.when(F.coalesce(subtitles, F.lit("")) != "", F.concat(F.lit("Subtitles of the video:\n"), subtitles))
    return F.concat_ws("\n", shown, F.lit("Choose the option that answers the question on the video; reply with its letter."), question, F.array_join(options, "\n"))


# ------------------------------------------------------------------ work lists


def translation_jobs(captions: DataFrame, descriptions: DataFrame, mode: str = "all", stem: str = "stem") -> DataFrame:
    """E-04: a row per text without a translation: kind, stem, id (sentence or object), pos, text. Phrases count of objects that a caption names."""
    empty = lambda c: F.coalesce(text.strip(c), F.lit("")) == ""
    of_captions = captions.where(empty(F.col("zh"))).select(F.lit("caption").alias("kind"), stem, F.col("sentence_id").cast("long").alias("id"), F.lit(0).alias("pos"), F.col("caption").alias("text"))
    named = captions.select(stem, F.explode("obj_ids").alias("obj_id")).distinct()
    spread = descriptions.join(named, [stem, "obj_id"], "left_semi").select(stem, "obj_id", "zh", F.posexplode("phrases").alias("pos", "phrase"))
    of_phrases = spread.where(empty(F.get("zh", F.col("pos")))).select(F.lit("phrase").alias("kind"), stem, F.col("obj_id").cast("long").alias("id"), "pos", F.col("phrase").alias("text"))
    return {"captions": of_captions, "descs": of_phrases}.get(mode, of_captions.unionByName(of_phrases))


def apply_translations(descriptions: DataFrame, done: DataFrame, stem: str = "stem") -> DataFrame:
    """E-04: translations (stem, obj_id, phrases, zh) put into descriptions whose phrases are still the same; others stay."""
    new = done.select(stem, "obj_id", F.col("phrases").alias("__p"), F.col("zh").alias("__zh"))
    joined = descriptions.join(new, [stem, "obj_id"], "left")
    return joined.withColumn("zh", F.when(F.col("__p").eqNullSafe(F.col("phrases")) & F.col("__zh").isNotNull(), F.col("__zh")).otherwise(F.col("zh"))).select(*descriptions.columns)


def merge_descriptions(old: DataFrame, fresh: DataFrame, stem: str = "stem") -> DataFrame:
    """E-06: the old rows of objects that weren't described anew, and the fresh ones."""
    return old.join(fresh.select(stem, "obj_id"), [stem, "obj_id"], "left_anti").unionByName(fresh, allowMissingColumns=True)


def capped(avoid: Column, locked: Column, modifiers: Column, features: Column) -> Column:
    """L-07: lists cut to what a request may hold."""
    cut = lambda c, n, name: F.slice(c, 1, n).alias(name)
    return F.struct(cut(avoid, MOST_AVOIDED, "avoid"), cut(locked, MOST_LOCKED, "locked"), cut(modifiers, MOST_MODIFIERS, "modifiers"), cut(features, MOST_FEATURES, "features"))


def missing_sample(missing: DataFrame, by: list[str], path: str = "path", most: int = MISSING_SHOWN) -> DataFrame:
    """L-08: how many files a record lacks, and the first few by name. The place is ranked before the names are brought together."""
    place = F.row_number().over(Window.partitionBy(*by).orderBy(path))
    counts = missing.groupBy(*by).agg(F.count("*").alias("n"))
    shown = missing.withColumn("__n", place).where(F.col("__n") <= most).groupBy(*by).agg(F.array_sort(F.collect_list(path)).alias("shown"))
    return counts.join(shown, by)


# ------------------------------------------------------------------ exports


def first_stems(rows: DataFrame, limit: int | None, stem: str = "stem") -> DataFrame:
    """L-01 and O-OUT-10: the rows of the first ``limit`` images by name; all if there is no limit."""
    if not limit:
        return rows
    return rows.join(bounded_broadcast(rows.select(stem).distinct().orderBy(stem).limit(limit), limit, 64), stem, "left_semi")


def export_count(captions: DataFrame, objects: DataFrame, limit: int | None = None, stem: str = "stem") -> DataFrame:
    """O-OUT-10: one row: how many of the first images have something to export."""
    return first_stems(captions, limit, stem).select(stem).distinct().join(objects.select(stem).distinct(), stem, "left_semi").agg(F.count("*").alias("n"))


def flat_objects(images: DataFrame, order: DataFrame | None = None, stem: str = "stem") -> DataFrame:
    """O-OUT-11: a row an object, numbered in the given order of images (stem, rank), else by name; images that the order lacks go."""
    rows = images.select(stem, F.posexplode("objects").alias("pos", "object"))
    rows = rows.join(order.select(stem, "rank"), stem) if order is not None else rows.withColumn("rank", F.col(stem))
    return numbered(rows, "line", ["rank", stem, "pos"], start=0).select("line", stem, "object")


def export_records(files: DataFrame, file: str = "file", records: str = "records") -> DataFrame:
    """O-OUT-13: the records of all files, by file name and place, with ids from 1; files that hold no list go."""
    rows = files.where(F.col(records).isNotNull()).select(file, F.posexplode(records).alias("pos", "record"))
    return numbered(rows, "id", [file, "pos"])


def image_files(rows: DataFrame, folder: str, index: str = "index") -> DataFrame:
    """E-02: where each image of a row goes: its own names for a list, else the row's index; each path once. A row without images has its paths as they are."""
    many = rows.where(F.size("image") > 1).select(index, F.posexplode(F.arrays_zip("image", "image_path")).alias("pos", "x")).select(index, "pos", F.col("x.image").alias("image"), F.col("x.image_path").alias("name"))
    single = rows.where(F.size("image") == 1).select(index, F.lit(0).alias("pos"), F.col("image")[0].alias("image"), F.concat(F.col(index).cast("string"), F.lit(".jpg")).alias("name"))
    named = many.unionByName(single).withColumn("path", F.concat_ws("/", F.lit(folder), "name"))
    bare = rows.where(F.coalesce(F.size("image"), F.lit(0)) <= 0).select(index, F.posexplode("image_path").alias("pos", "path"))
    named = named.unionByName(bare.withColumn("image", F.lit(None).cast("string")), allowMissingColumns=True)
    return named.groupBy("path").agg(F.min(F.struct(index, "pos", "image")).alias("r")).select("path", f"r.{index}", "r.image")


def ordered_predictions(rows: DataFrame, index: str = "index", prediction: str = "prediction") -> DataFrame:
    """P-18: predictions as text, in the order of their index."""
    return rows.withColumn(prediction, F.col(prediction).cast("string")).orderBy(index)


def absolute_path(folder: Column, path: Column) -> Column:
    """P-05: a path below its folder, unless it is absolute or a URL; links aren't followed."""
    return F.when(path.rlike("^(/|[A-Za-z][A-Za-z0-9+.-]*://)"), path).otherwise(F.concat_ws("/", F.regexp_replace(folder, "/+$", ""), F.regexp_replace(path, r"^(\./)+", "")))


def frame_time(index: Column, fps: Column) -> Column:
    """D-03: a frame's time, or a video's length by its number of frames, in seconds; null without a rate."""
    return F.when(fps > 0, index / fps)


# ------------------------------------------------------------------ look-ups and probes


def with_camera(rows: DataFrame, cameras: DataFrame, image: str = "image") -> DataFrame:
    """O-IN-28: rows with the camera of their image (null if it has none). Cameras are broadcast while they are few."""
    return rows.join(bounded_broadcast(cameras.withColumnRenamed("name", image), cameras.count(), 200), image, "left")


def services(registry: DataFrame) -> DataFrame:
    """O-IN-31: services (name, base_url, default) with their port, and which one is used: the first default one, else the first."""
    rows = registry.withColumns({"name": text.strip(F.coalesce("name", F.lit(""))), "base_url": F.regexp_replace(text.strip(F.coalesce("base_url", F.lit(""))), "/+$", "")})
    best = F.row_number().over(Window.orderBy(F.desc(F.coalesce("default", F.lit(False))), "position"))  # a registry is a few rows
    return rows.withColumn("port", text.port_of(F.col("base_url"))).withColumn("chosen", best == 1)


def rule_file(preferred: Column, fallback: Column, files: Column) -> Column:
    """E-08: the preferred file if it exists, else the fallback if that exists, else whichever is named."""
    named = F.when(F.coalesce(preferred, F.lit("")) != "", preferred)
    return F.when(F.array_contains(files, named), named).when(F.array_contains(files, fallback), fallback).otherwise(F.coalesce(named, fallback))


def dataset_pairs(prefixes: Column, configs: Column) -> Column:
    """E-01: name -> configuration, pairwise up to the shorter list; of a repeated name the last holds. Configurations are data, never run."""
    n = F.least(F.size(prefixes), F.size(configs))
    names = F.slice(prefixes, F.lit(1), n)
    last = F.filter(F.sequence(F.lit(0), n - 1), lambda i: ~F.array_contains(F.slice(names, i + 2, n), F.get(names, i)))
    return F.when(n > 0, F.map_from_arrays(F.transform(last, lambda i: F.get(names, i)), F.transform(last, lambda i: F.get(configs, i)))).otherwise(F.map_from_arrays(F.slice(prefixes, 1, 0), F.slice(configs, 1, 0)))


def label_lines(lines: DataFrame, segment: Callable[[Column], Column], file: str = "file", line: str = "line", value: str = "value") -> DataFrame:
    """O-IN-14: the segments of each label file in the order of its lines; lines that aren't one go."""
    rows = lines.withColumn("__s", segment(F.col(value))).where("__s is not null")
    return rows.groupBy(file).agg(F.transform(F.array_sort(F.collect_list(F.struct(line, "__s"))), lambda x: x["__s"]).alias("segments"))


def folder_counts(listing: DataFrame, folder: str = "folder") -> DataFrame:
    """V-04 and E-12: how many images, labels and other files each folder of a listing (folder, suffix) holds."""
    image, label = F.col("suffix").isin(".jpg", ".jpeg", ".png", ".bmp", ".webp"), F.col("suffix").isin(".json", ".xml")
    return listing.groupBy(folder).agg(F.count_if(image).alias("n_images"), F.count_if(label).alias("n_labels"), F.count_if(~image & ~label).alias("n_other"))


def image_root(folders: DataFrame, root: str = "root") -> DataFrame:
    """V-09: of each root (root, folder, n_images; the root itself is '.') the folder that images come from: a usual one by priority, else the root itself,
    else the first other visible one by name. A root named like an image folder stands for the folder above it."""
    usual = F.create_map(*[x for i, n in enumerate(IMAGE_FOLDERS) for x in (F.lit(n), F.lit(i))])
    rank = F.coalesce(F.try_element_at(usual, F.col("folder")), F.when(F.col("folder") == ".", 50).when(~F.startswith("folder", F.lit(".")), 99))
    best = folders.where("n_images > 0").withColumn("rank", rank).where("rank is not null").groupBy(root).agg(F.min(F.struct("rank", "folder")).alias("b"))
    last = F.regexp_extract(root, "([^/]*)/*$", 1)
    above = (F.col("b.folder") == ".") & F.lower(last).isin(*[n.lower() for n in IMAGE_FOLDERS])
    return best.select(root, F.when(above, F.regexp_replace(root, "/*[^/]*/*$", "")).otherwise(F.col(root)).alias("dataset_root"), F.when(above, last).otherwise(F.col("b.folder")).alias("folder"))


def prior_objects(images: DataFrame, stems: DataFrame, stem: str = "stem") -> DataFrame:
    """V-11: the known objects of the given images."""
    return images.join(stems.select(stem).distinct(), stem, "left_semi")

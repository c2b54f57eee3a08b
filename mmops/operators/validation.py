"""Checks of records and of datasets on disk."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import count_text

# Kinds of media and the marks that stand for them.
MEDIA = {"image": "<image>", "video": "<video>"}
PROBLEM = "struct<kind:string,media:string,expected:int,found:int>"


def media_counts(records: DataFrame, images: str = "image", videos: str = "video") -> DataFrame:
    """G-20: n_images, n_videos and media_type (image, video, mixed, none)."""
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    i, v = n(images), n(videos)
    kind = F.when((i > 0) & (v > 0), "mixed").when(i > 0, "image").when(v > 0, "video").otherwise("none")
    return records.withColumns({"n_images": i, "n_videos": v, "media_type": kind})


def marks_in(conversations: Column, role: str, mark: str) -> Column:
    """T-30 over all turns of one role."""
    return F.aggregate(F.filter(conversations, lambda t: t["from"] == role), F.lit(0), lambda acc, t: acc + count_text(t["value"], mark))


def missing_media(records: DataFrame, files: DataFrame, key: str, media: str, path: str = "path") -> DataFrame:
    """J-20: the key and the media files that the listing lacks, in order."""
    spread = records.select(key, F.posexplode(media).alias("pos", "file"))
    gone = spread.join(files.select(F.col(path).alias("file")).distinct(), "file", "left_anti")
    return gone.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "file"))), lambda x: x.file).alias("missing"))


def check_records(records: DataFrame, missing: DataFrame | None = None, key: str = "id", conversations: str = "conversations") -> DataFrame:
    """G-21: media counts, problems (missing files, the first kind of media whose marks don't fit, marks in answers), is_valid.

    ``missing`` is the result of :func:`missing_media`.
    """
    counted = media_counts(records)
    if missing is not None:
        counted = counted.join(missing, key, "left")
    else:
        counted = counted.withColumn("missing", F.lit(None).cast("array<string>"))
    turns = F.col(conversations)

    def problem(kind, media, expected, found):
        return F.struct(F.lit(kind).alias("kind"), F.lit(media).alias("media"), expected.cast("int").alias("expected"), found.cast("int").alias("found"))

    gone = F.coalesce(F.size("missing"), F.lit(0))
    mismatch = F.lit(None).cast(PROBLEM)
    for media, mark in reversed(MEDIA.items()):
        want, found = F.col(f"n_{media}s"), marks_in(turns, "human", mark)
        mismatch = F.when(want != found, problem("token_mismatch", media, want, found)).otherwise(mismatch)
    answers = sum((marks_in(turns, "gpt", m) for m in MEDIA.values()), F.lit(0))
    found = F.array(
        F.when(gone > 0, problem("missing_files", "", F.lit(0), gone)), mismatch,
        F.when(answers > 0, problem("gpt_media_token", "", F.lit(0), answers)),
    )
    return counted.withColumn("problems", F.filter(found, lambda p: p.isNotNull())).withColumn("is_valid", F.size("problems") == 0)


def validation_statistics(checked: DataFrame) -> DataFrame:
    """A-06: one row of totals; the share is null for no records."""
    of = lambda kind: F.count_if(F.exists("problems", lambda p: p.kind == kind))
    kinds = [F.count_if(F.col("media_type") == k).alias(f"n_{k}") for k in ("image", "video", "mixed", "none")]
    return checked.agg(
        F.count("*").alias("total"), F.count_if("is_valid").alias("valid"), *kinds, of("missing_files").alias("with_missing"), of("token_mismatch").alias("with_mismatch"),
        of("gpt_media_token").alias("with_gpt_token"), F.try_divide(F.count_if("is_valid"), F.count("*")).alias("valid_share"),
    )


def split_valid(checked: DataFrame) -> tuple[DataFrame, DataFrame]:
    """O-OUT-04: (valid, problem) records."""
    return checked.where("is_valid"), checked.where(~F.col("is_valid"))


def shape_statistics(shapes: DataFrame, shape_type: str = "shape_type", file: str = "file", by: list[str] | None = None) -> DataFrame:
    """A-07: files, shapes, kinds of shape, and the geometry: the one kind there is, mixed, or null."""
    kind = F.lower(F.trim(F.col(shape_type)))
    rect, poly = F.count_if(kind == "rectangle"), F.count_if(kind == "polygon")
    geometry = F.when((rect > 0) & (poly > 0), "mixed").when(rect > 0, "rectangle").when(poly > 0, "polygon")
    return shapes.groupBy(*(by or [])).agg(F.count_distinct(file).alias("n_json"), F.count("*").alias("n_shapes"), rect.alias("n_rectangle"), poly.alias("n_polygon"), (F.count("*") - rect - poly).alias("n_other"), geometry.alias("geometry"))


def geometry_of_first(shapes: DataFrame, file: str, shape_type: str = "shape_type", files: int = 80) -> DataFrame:
    """A-08: the same over the first files by name."""
    first = shapes.select(file).distinct().orderBy(file).limit(files)
    return shape_statistics(shapes.join(F.broadcast(first), file, "left_semi"), shape_type, file)


def directory_signature(files: DataFrame, name: str = "name", size: str = "size", mtime: str = "mtime", by: list[str] | None = None) -> DataFrame:
    """A-09: count, bytes, newest, first and last name, and the MD5 of them all."""
    out = files.groupBy(*(by or [])).agg(F.count("*").alias("n"), F.coalesce(F.sum(size), F.lit(0)).alias("bytes"), F.max(mtime).alias("newest"), F.min(name).alias("first"), F.max(name).alias("last"))
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("n", "bytes", "newest", "first", "last")]
    return out.withColumn("signature", F.md5(F.concat_ws(":", *parts).cast("binary")))


def layout(images: DataFrame, labels: DataFrame, stem: str = "stem") -> DataFrame:
    """J-06 and O-IN-18: one row: paired, image_only and label_only stems."""
    a, b = images.select(stem).distinct().withColumn("i", F.lit(1)), labels.select(stem).distinct().withColumn("l", F.lit(1))
    both = a.join(b, stem, "full_outer")
    return both.agg(F.count_if(F.col("i").isNotNull() & F.col("l").isNotNull()).alias("paired"), F.count_if(F.col("l").isNull()).alias("image_only"), F.count_if(F.col("i").isNull()).alias("label_only"))


def restrict_to_images(rows: DataFrame, images: DataFrame, stem: str = "stem") -> DataFrame:
    """J-07: only rows of existing images, unless there is no image at all."""
    if not images.limit(1).count():
        return rows
    return rows.join(images.select(stem).distinct(), stem, "left_semi")


def draft_gaps(images: DataFrame, objects: DataFrame, descriptions: DataFrame, captions: DataFrame, stem: str = "stem", obj: str = "obj_id") -> DataFrame:
    """J-09, A-16 and A-17: one row: what a draft lacks, the stages to run, and whether it is ready."""
    distinct = lambda df: df.select(stem).distinct()
    no_objects = distinct(images).join(distinct(objects), stem, "left_anti").agg(F.count("*").alias("no_objects"))
    no_text = objects.select(stem, obj).distinct().join(descriptions.select(stem, obj).distinct(), [stem, obj], "left_anti").agg(F.count("*").alias("no_description"))
    no_caption = distinct(objects).join(distinct(captions), stem, "left_anti").agg(F.count("*").alias("no_caption"))
    row = no_objects.join(no_text, how="cross").join(no_caption, how="cross")  # three rows of one
    stages = F.array_compact(F.array(F.when(F.col("no_objects") > 0, "crop"), F.when(F.col("no_description") > 0, "describe"), F.when(F.col("no_caption") > 0, "caption")))
    return row.withColumn("stages", stages).withColumn("ready", F.size(stages) == 0)


def progress(images: DataFrame, annotations: DataFrame, stem: str = "stem") -> DataFrame:
    """A-18: total, done, remaining."""
    done = images.select(stem).distinct().join(annotations.select(stem).distinct().withColumn("done", F.lit(True)), stem, "left")
    return done.agg(F.count("*").alias("total"), F.count_if("done").alias("done"), (F.count("*") - F.count_if("done")).alias("remaining"))


def validation_tier(same_resume: Column, same_signature: Column, draft_complete: Column) -> Column:
    """V-01: why a full scan can be skipped, or scan."""
    return F.when(same_resume, "resume").when(same_signature, "signature").when(draft_complete, "draft").otherwise("scan")


def resume_is_enough(log_ok: Column, same_dirs: Column, geometry: Column, n_objects: Column, n_labels: Column, n_images: Column) -> Column:
    """V-02 and V-03: a previous log that holds, known geometry, and at least as many results as there is input."""
    least = F.least(F.nullif(n_labels, F.lit(0)), F.nullif(n_images, F.lit(0)))
    return F.coalesce(log_ok & same_dirs & geometry.isNotNull() & (n_objects >= F.coalesce(least, F.lit(0))), F.lit(False))

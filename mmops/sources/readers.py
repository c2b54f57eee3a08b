"""Readers: JSON records, benchmark tables, label files, subtitles, listings, registries."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators.records import sampling_rate

TURN = "array<struct<from:string,value:string>>"
RECORD = f"id long, image string, video string, conversations {TURN}, num_tokens int, data_path string"
LABELME = "imagePath string, shapes array<struct<label:string,shape_type:string,points:array<array<double>>>>"
SHAPES = "array<struct<label:string,shape_type:string,points:array<array<double>>>>"
POLICY = "scenes array<struct<id:string,label:string,max_phrases:string,ban_vehicle_subtypes:boolean,exhaustive:boolean,caption_cover_all:boolean>>"


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """O-IN-01 and O-IN-10: one JSON value a line; gzip is read by its suffix."""
    reader = spark.read.schema(schema) if schema else spark.read
    return reader.json(path)


def read_json(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """O-IN-02 and O-IN-04: files of one JSON array or value each; a directory's files come with their path as ``file``."""
    reader = spark.read.option("multiLine", True)
    return (reader.schema(schema) if schema else reader).json(path).withColumn("file", F.col("_metadata.file_path"))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """O-IN-03 and P-04: training records by suffix (.json or .jsonl); image and video become arrays, whether they were one or many."""
    if path.endswith((".jsonl", ".jsonl.gz")):
        rows = spark.read.schema(RECORD).json(path)
    elif path.endswith(".json"):
        rows = spark.read.option("multiLine", True).schema(RECORD).json(path)
    else:
        raise ValueError(f"neither .json nor .jsonl: {path}")
    return normalise_media(rows)


def normalise_media(rows: DataFrame) -> DataFrame:
    from ..functions.parsing import to_list

    return rows.withColumns({c: to_list(F.col(c)) for c in ("image", "video") if c in rows.columns})


def read_tsv(spark: SparkSession, path: str) -> DataFrame:
    """O-IN-05 to O-IN-07: a benchmark table; all columns are text, quotes are doubled inside quotes."""
    return spark.read.csv(path, sep="\t", header=True, multiLine=True, quote='"', escape='"')


def checked_tsv(spark: SparkSession, path: str, md5: str) -> DataFrame:
    """O-IN-06: refuses a file of another MD5 sum."""
    found = spark.read.format("binaryFile").load(path).select(F.md5("content").alias("m")).first()
    if found is None or found.m != md5:
        raise ValueError(f"{path} has another checksum")
    return read_tsv(spark, path)


def read_eval_results(spark: SparkSession, path: str) -> DataFrame:
    """O-IN-09: CSV or Parquet."""
    return spark.read.parquet(path) if path.endswith(".parquet") else spark.read.csv(path, header=True, multiLine=True, escape='"')


def read_inference(spark: SparkSession, path: str, annotation: str) -> DataFrame:
    """O-IN-23: JSONL results as the annotation's columns, question_id and prediction."""
    schema = f"question_id string, annotation struct<{annotation}>, task string, result struct<gen:string,gen_raw:string>"
    return spark.read.schema(schema).json(path).select("question_id", "annotation.*", F.col("result.gen").alias("prediction"))


def read_split(spark: SparkSession, path: str, duration: str) -> DataFrame:
    """O-IN-08: the filter reaches the scan."""
    return spark.read.parquet(path).where(F.col("duration") == duration)


def listing(spark: SparkSession, path: str, pattern: str = "*", recursive: bool = False) -> DataFrame:
    """O-IN-15, O-IN-16: files without their content: path, name, stem, suffix, size, mtime (ms)."""
    reader = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    rows = reader.load(path).select("path", F.col("length").alias("size"), (F.col("modificationTime").cast("double") * 1000).cast("long").alias("mtime"))
    return rows.withColumns({"name": F.regexp_extract("path", "([^/]*)$", 1), "stem": text.stem(F.col("path")), "suffix": text.suffix(F.col("path"))})


# Suffixes.
IMAGE_SUFFIXES = (".jpg", ".jpeg", ".png", ".bmp", ".webp", ".tif", ".tiff")
LABEL_SUFFIXES = (".json", ".xml")


def image_stems(files: DataFrame) -> DataFrame:
    """O-IN-16."""
    return files.where(F.col("suffix").isin(*IMAGE_SUFFIXES)).select("stem", "path").dropDuplicates(["stem"])


def label_files(files: DataFrame) -> DataFrame:
    """O-IN-15."""
    return files.where(F.col("suffix").isin(*LABEL_SUFFIXES))


def resolve_images(labels: DataFrame, files: DataFrame, stem: str = "stem", hint: str = "hint") -> DataFrame:
    """O-IN-17: the image of a label file: the file that its hint names, else the one of its stem."""
    f = files.where(F.col("suffix").isin(*IMAGE_SUFFIXES)).select("name", F.col("stem").alias("__s"), F.col("path").alias("image_path"))
    keyed = labels.withColumn("__h", F.regexp_extract(F.coalesce(hint, F.lit("")), r"([^/\\]*)$", 1))
    by_hint = keyed.join(f.select(F.col("name").alias("__h"), F.col("image_path").alias("p1")), "__h", "left")
    by_stem = f.groupBy("__s").agg(F.min("image_path").alias("p2"))
    return by_hint.join(by_stem, by_hint[stem] == by_stem["__s"], "left").withColumn("image_path", F.coalesce("p1", "p2")).drop("__h", "__s", "p1", "p2")


def voc_shapes(xml: Column) -> Column:
    """O-IN-12: rectangles of a Pascal VOC text; nameless objects are unknown, objects without a positive size go."""
    schema = "STRUCT<object: ARRAY<STRUCT<name: STRING, bndbox: STRUCT<xmin: STRING, ymin: STRING, xmax: STRING, ymax: STRING>>>>"
    objects = F.coalesce(F.from_xml(xml, schema)["object"], F.array())
    number = lambda c: F.trim(c).try_cast("double")
    boxes = F.transform(objects, lambda o: F.struct(F.coalesce(F.nullif(F.trim(o["name"]), F.lit("")), F.lit("unknown")).alias("label"), *[number(o["bndbox"][k]).alias(k) for k in ("xmin", "ymin", "xmax", "ymax")]))
    good = F.filter(boxes, lambda b: F.coalesce((b.xmax > b.xmin) & (b.ymax > b.ymin), F.lit(False)))
    return F.transform(good, lambda b: F.struct(b.label.alias("label"), F.lit("rectangle").alias("shape_type"), F.array(F.array(b.xmin, b.ymin), F.array(b.xmax, b.ymax)).alias("points")))


def labelme_shapes(json: Column) -> Column:
    """O-IN-11: shapes of a LabelMe text; empty for what isn't one."""
    parsed = F.from_json(first_json(json), LABELME)
    return F.coalesce(parsed["shapes"], F.array().cast(SHAPES))


def first_json(json: Column) -> Column:
    """O-IN-19: without a byte-order mark; of two objects in one file, the first."""
    body = text.strip(F.regexp_replace(json, "^﻿", ""))
    return text.once(body, lambda b: F.when(F.try_parse_json(b).isNotNull(), b).otherwise(F.concat(F.regexp_extract(b, r"(?s)^(.*?\})\s*\{", 1))))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """O-IN-11: LabelMe and VOC files of a directory by suffix: file, stem, hint (imagePath), shapes."""
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), "value")
    rows = rows.withColumn("suffix", text.suffix(F.col("file"))).where(F.col("suffix").isin(*LABEL_SUFFIXES))
    xml = F.col("suffix") == ".xml"
    hint = F.when(xml, F.regexp_extract("value", r"(?s)<filename>\s*(.*?)\s*</filename>", 1)).otherwise(F.get_json_object(first_json(F.col("value")), "$.imagePath"))
    return rows.select("file", text.stem(F.col("file")).alias("stem"), hint.alias("hint"), F.when(xml, voc_shapes(F.col("value"))).otherwise(labelme_shapes(F.col("value"))).alias("shapes"))


def yolo_segment(line: Column, width: Column, height: Column) -> Column:
    """O-IN-13: struct<class, points> in pixels of ``class x y x y ...``; null with fewer than three points or an odd count."""

    def segment(parts):
        values = F.transform(F.slice(parts, F.lit(2), F.size(parts) - 1), lambda v, i: v.try_cast("double") * F.when(i % 2 == 0, width).otherwise(height))
        good = text.once(values, lambda v: F.when(~F.exists(v, lambda x: x.isNull()), F.struct(parts[0].try_cast("int").alias("class"), v.alias("points"))))
        return F.when((F.size(parts) >= 7) & (F.size(parts) % 2 == 1), good)

    return text.once(text.words(line), segment)


def subtitles(srt: Column) -> Column:
    """O-IN-24: array<struct<start_ms, end_ms, text>> of an SRT text."""
    blocks = F.split(text.strip(F.regexp_replace(srt, "\r\n?", "\n")), r"\n\s*\n")
    stamp = r"(\d+):(\d+):(\d+)[,.](\d+)\s*-->\s*(\d+):(\d+):(\d+)[,.](\d+)"

    def cue(b):
        said = text.strip(F.regexp_replace(b, rf"(?s)^.*?{stamp}[^\n]*\n?", ""))
        ms = lambda n, i: ((n[i] * 60 + n[i + 1]) * 60 + n[i + 2]) * 1000 + n[i + 3]
        timed = lambda n: F.struct(ms(n, 0).alias("start_ms"), ms(n, 4).alias("end_ms"), said.alias("text"))
        # A stamp's eight numbers are what its other characters leave.
        return text.once(F.regexp_extract(b, stamp, 0), lambda at: F.when(at != "", text.once(F.transform(F.split(at, r"\D+"), lambda x: x.try_cast("long")), timed)))

    return F.filter(F.transform(blocks, cue), lambda c: c.isNotNull())


def read_subtitles(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(text.stem(F.col("_metadata.file_path")).alias("stem"), F.inline(subtitles(F.col("value"))))
    return rows


def image_size(rows: DataFrame, content: str = "content") -> DataFrame:
    """O-IN-32: width and height from a PNG or JPEG header; nulls for anything else. The bytes are read in Arrow batches."""

    @F.pandas_udf("width int, height int")
    def size(contents: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([header_size(bytes(c)) if c is not None else (None, None) for c in contents], columns=["width", "height"])

    return rows.withColumn("__s", size(F.col(content))).select(*rows.columns, "__s.width", "__s.height")


def header_size(data: bytes) -> tuple[int | None, int | None]:
    if data[:8] == b"\x89PNG\r\n\x1a\n" and data[12:16] == b"IHDR":
        return struct.unpack(">II", data[16:24])
    if data[:2] == b"\xff\xd8":
        at = 2
        while at + 9 <= len(data):
            if data[at] != 0xFF:
                break
            kind = data[at + 1]
            if 0xC0 <= kind <= 0xCF and kind not in (0xC4, 0xC8, 0xCC):
                height, width = struct.unpack(">HH", data[at + 5 : at + 9])
                return width, height
            at += 2 if kind == 0xFF or 0xD0 <= kind <= 0xD9 else 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None, None


def scene_policies(spark: SparkSession, path: str) -> DataFrame:
    """O-IN-29 and E-07: scene policies with defaults: at least one phrase, 8 if none is said."""
    rows = spark.read.option("multiLine", True).schema(POLICY).json(path).select(F.inline("scenes"))
    return policy_defaults(rows)


def policy_defaults(rows: DataFrame) -> DataFrame:
    most = F.coalesce(F.nullif(F.col("max_phrases").try_cast("int"), F.lit(0)), F.lit(8))
    flags = {c: F.coalesce(c, F.lit(False)) for c in ("ban_vehicle_subtypes", "exhaustive", "caption_cover_all")}
    return rows.withColumns({"max_phrases": F.greatest(F.lit(1), most), "label": F.coalesce("label", "id"), **flags})


def dataset_configs(names: list[str], registry: dict[str, dict] | None = None) -> list[dict]:
    """O-IN-20, O-IN-21 and L-05: annotation_path, data_path and sampling_rate of names, YAML files or JSON files, each with an optional %N."""
    import yaml

    out = []
    for name in names:
        path, rate = sampling_rate(name)
        if path.endswith((".yaml", ".yml")):
            with open(path, encoding="utf-8") as f:
                config = dict(yaml.safe_load(f) or {})
        elif path.endswith((".json", ".jsonl")):
            config = {"annotation_path": path, "data_path": ""}
        elif registry and path in registry:
            config = dict(registry[path])
        else:
            raise ValueError(f"unknown dataset {path}")
        out.append(config | {"sampling_rate": rate})
    return out


def with_policy(rows: DataFrame, policies: DataFrame, scene: str = "scene") -> DataFrame:
    """O-IN-30 and J-19: every row with its scene's policy, or the defaults. Policies are a small dimension table, counted first."""
    few = policies.count() <= 10_000
    p = policies.withColumnRenamed("id", scene).drop("label")
    joined = rows.join(F.broadcast(p) if few else p, scene, "left")
    return joined.withColumns({"max_phrases": F.coalesce("max_phrases", F.lit(8)), **{c: F.coalesce(c, F.lit(False)) for c in ("ban_vehicle_subtypes", "exhaustive", "caption_cover_all")}})

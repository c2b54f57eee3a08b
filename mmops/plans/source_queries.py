"""Queries that write files of the supplied tables' rows and read them back, each with the SQL of the rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..scratch import Scratch
from ..sources import files, readers, sinks
from . import views
from .queries import _l, query
from .views import V_BOX, table


def _label_files(spark, sf):
    """A file a part, of one of four kinds: its boxes as LabelMe, VOC, YOLO or SRT text."""
    b = views.boxes(spark, sf).select("partkey", "label", *[F.col(c).cast("int").alias(c) for c in ("x1", "y1", "x2", "y2")], F.struct("stem", "obj_id").alias("o"))
    g = b.groupBy("partkey").agg(F.sort_array(F.collect_list(F.struct("o", "label", "x1", "y1", "x2", "y2"))).alias("b"))
    def said(form, *cols):
        """Each box as the form's text with its columns put in for %s, by concat, which costs far less than format_string."""
        texts = form.split("%s")
        return F.transform("b", lambda x: F.concat(F.lit(texts[0]), *[p for c, t in zip(cols, texts[1:], strict=True) for p in (F.coalesce(x[c].cast("string"), F.lit("null")), F.lit(t))]))

    labelme = F.concat(F.lit('{"imagePath": "'), F.col("partkey").cast("string"), F.lit('.jpg", "shapes": ['), F.array_join(said('{"label": "%s", "shape_type": "rectangle", "points": [[%s, %s], [%s, %s]]}', "label", "x1", "y1", "x2", "y2"), ", "), F.lit("]}"))
    voc = F.concat(F.lit("<annotation><filename>x</filename>"), F.array_join(said("<object><name>%s</name><bndbox><xmin>%s</xmin><ymin>%s</ymin><xmax>%s</xmax><ymax>%s</ymax></bndbox></object>", "label", "x1", "y1", "x2", "y2"), "\n"), F.lit("</annotation>"))
    line = F.transform("b", lambda x: F.concat_ws(" ", F.lit("3"), *[(x[c] / F.lit(1024.0)).cast("string") for c in ("x1", "y1", "x2", "y1", "x2", "y2")]))
    stamp = lambda ms: F.format_string("%02d:%02d:%02d,%03d", F.floor(ms / 3_600_000).cast("int"), (F.floor(ms / 60_000) % 60).cast("int"), (F.floor(ms / 1000) % 60).cast("int"), (ms % 1000).cast("int"))
    srt = F.transform("b", lambda x, i: F.concat((i + 1).cast("string"), F.lit("\n"), stamp(x.x1 * 1000), F.lit(" --> "), stamp(x.x1 * 1000 + x.y1), F.lit("\nsaid "), x.label))
    k = F.col("partkey") % 4
    content = F.when(k == 0, labelme).when(k == 1, voc).when(k == 2, F.array_join(line, "\n")).otherwise(F.array_join(srt, "\n\n"))
    suffix = F.when(k == 0, ".json").when(k == 1, ".xml").when(k == 2, ".txt").otherwise(".srt")
    return g.select(F.concat(F.col("partkey").cast("string"), suffix).alias("name"), content.alias("content"))


@query("""SELECT partkey AS stem, CASE partkey % 4 WHEN 0 THEN 'json' WHEN 1 THEN 'xml' WHEN 2 THEN 'txt' ELSE 'srt' END AS kind, count(*) AS n, CAST(sum(CASE partkey % 4 WHEN 2 THEN x1 + y1 + x2 + y1 + x2 + y2 WHEN 3 THEN 2000 * x1 + y1 ELSE x1 + y1 + x2 + y2 END) AS BIGINT) AS total,
array_to_string(list(CASE partkey % 4 WHEN 2 THEN '3' WHEN 3 THEN 'said ' || label ELSE label END ORDER BY stem, obj_id), ',') AS labels FROM box GROUP BY partkey""", V_BOX)
def label_folders(spark, sf):
    """O-IN-11 to O-IN-14, O-IN-24, O-OUT-09: four kinds of label files written, read back and parsed."""
    folder = Scratch(spark, "labels").path("files", keep=True)
    files.export_files(_label_files(spark, sf), folder)
    f = files.read_files(spark, folder)
    row = lambda kind, labels, numbers: F.struct(F.lit(kind).alias("kind"), labels.alias("labels"), numbers.alias("numbers"))
    points = lambda shapes: F.flatten(F.flatten(F.transform(shapes, lambda s: s.points)))
    shapes = lambda kind: row(kind, F.transform(kind, lambda s: s.label), points(F.col(kind)))
    content, of = F.col("content"), lambda suffix: F.col("suffix") == suffix
    lines = F.filter(F.transform(F.split(content, "\n"), lambda x: readers.yolo_segment(x, F.lit(1024), F.lit(1024))), lambda s: s.isNotNull())
    # Each text goes to the one parser of its kind, and what that finds is a column, so that it is parsed once.
    parsed = f.withColumns({"json": F.when(of(".json"), readers.labelme_shapes(content)), "xml": F.when(of(".xml"), readers.voc_shapes(content)), "txt": F.when(of(".txt"), lines), "srt": F.when(~of(".json") & ~of(".xml") & ~of(".txt"), readers.subtitles(content))})
    one = F.when(of(".json"), shapes("json")).when(of(".xml"), shapes("xml"))
    one = one.when(of(".txt"), row("txt", F.transform("txt", lambda s: s["class"].cast("string")), F.flatten(F.transform("txt", lambda s: s.points))))
    one = one.otherwise(row("srt", F.transform("srt", lambda c: c.text), F.flatten(F.transform("srt", lambda c: F.array(c.start_ms.cast("double"), c.end_ms.cast("double"))))))
    out = parsed.select(_l("stem").alias("stem"), one.alias("r"))
    total = F.aggregate("r.numbers", F.lit(0.0), lambda a, x: a + x)
    return out.select("stem", "r.kind", _l(F.size("r.labels")).alias("n"), _l(F.round(total)).alias("total"), F.array_join("r.labels", ",").alias("labels"))


@query("""SELECT name, row_number() OVER (ORDER BY name) AS place, 50 AS n_files FROM (SELECT DISTINCT partkey || CASE partkey % 4 WHEN 0 THEN '.json' WHEN 1 THEN '.xml' WHEN 2 THEN '.txt' ELSE '.srt' END AS name FROM box ORDER BY name LIMIT 50)""", V_BOX)
def export_limited(spark, sf):
    """O-OUT-10, L-01: the first 50 files of an export, and what it counted."""
    folder = Scratch(spark, "labels").path("first", keep=True)
    n = files.export_files(_label_files(spark, sf), folder, limit=50)
    names = files.read_files(spark, folder).agg(F.array_sort(F.collect_list("name")).alias("n"))  # 50 at most
    return names.select(F.posexplode("n").alias("i", "name")).select("name", _l(F.col("i") + 1).alias("place"), F.lit(n).alias("n_files"))


_ODD = "'\"' || p_name || '\", é' || chr(10) || p_type || chr(9) || '中'"


@query(f"SELECT p_partkey AS id, {_ODD} AS csv, {_ODD} AS tsv, {_ODD} || chr(1) AS jsonl, p_size AS n FROM part")
def written_tables(spark, sf):
    """O-IN-01, O-IN-05, O-IN-09, O-OUT-01, O-OUT-05, O-OUT-06: quotes, line ends and tabs through CSV, TSV and JSON lines; control characters leave tables only."""
    odd = F.concat(F.lit('"'), F.col("p_name"), F.lit('", é\n'), F.col("p_type"), F.lit("\t中"))
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("id"), F.concat(odd, F.char(F.lit(1))).alias("t"), F.col("p_size").alias("n"))
    scratch = Scratch(spark, "tables")
    csv, tsv, jsonl = (scratch.path(k, keep=True) for k in ("csv", "tsv", "jsonl"))
    sinks.write_table(p, csv)
    sinks.write_table(p, tsv, "\t")
    sinks.write_jsonl(p, jsonl)
    a = readers.read_eval_results(spark, csv).select(_l("id").alias("id"), F.col("t").alias("csv"))
    b = readers.read_tsv(spark, tsv).select(_l("id").alias("id"), F.col("t").alias("tsv"))
    c = readers.read_jsonl(spark, jsonl, "id long, t string, n int").select("id", F.col("t").alias("jsonl"), "n")
    return a.join(b, "id").join(c, "id")


@query("""SELECT conv_id AS id, conv_id || '.png' AS image, CASE WHEN conv_id % 2 = 0 THEN 1 ELSE 2 END AS n_images, n_turns, conv_id % 5 <> 0 AS is_valid, CASE WHEN conv_id % 3 = 0 THEN 'p' || conv_id END AS prediction FROM (SELECT conv_id, count(*) AS n_turns FROM conversations GROUP BY conv_id)""")
def written_records(spark, sf):
    """O-IN-03, O-IN-23, O-OUT-04, P-04: training records with one or several images, the split of valid ones, and inference results of some."""
    turn = F.struct(F.col("turn"), F.col("role").alias("from"), F.col("text").alias("value"))
    c = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.array_sort(F.collect_list(turn)).alias("t"))
    c = c.withColumn("conversations", F.transform("t", lambda t: F.struct(t["from"].alias("from"), t.value.alias("value"))))
    name = F.concat(F.col("id").cast("string"), F.lit(".png"))
    image = F.when(F.col("id") % 2 == 0, name).otherwise(F.to_json(F.array(name, F.lit("b.png"))))
    scratch = Scratch(spark, "records")
    records, split, results = (scratch.path(k, keep=True) for k in ("records.jsonl", "split", "results"))
    sinks.write_jsonl(c.select("id", image.alias("image"), "conversations"), records, nulls=False)
    sinks.write_split(c.select("id", (F.col("id") % 5 != 0).alias("is_valid")), split)
    said = F.struct(F.concat(F.lit("p"), F.col("id").cast("string")).alias("gen"), F.lit("").alias("gen_raw"))
    sinks.write_jsonl(c.where("id % 3 = 0").select(F.col("id").cast("string").alias("question_id"), F.struct("id").alias("annotation"), F.lit("t").alias("task"), said.alias("result")), results)
    found = readers.read_records(spark, records)
    valid = readers.read_jsonl(spark, split, "id long, is_valid boolean")
    predicted = readers.read_inference(spark, results, "id:long").select("id", "prediction")
    out = found.join(valid, "id").join(predicted, "id", "left")
    return out.select("id", F.col("image")[0].alias("image"), F.size("image").alias("n_images"), _l(F.size("conversations")).alias("n_turns"), "is_valid", "prediction")

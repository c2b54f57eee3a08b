"""Queries of the draft operators on the supplied tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import sequences, text
from ..operators import drafts, evaluation
from ..sources import readers
from . import views
from .queries import _l, query
from .views import V_BOX, V_CONV, V_SIZE, table


def _captions(spark, sf):
    """A caption an image, with the phrases of its even objects."""
    chosen = F.struct(F.col("obj_id").alias("obj_id"), F.concat(F.lit(" item "), F.col("obj_id").cast("string"), F.lit(" ")).alias("phrase"))
    g = views.boxes(spark, sf).groupBy("stem").agg(F.array_sort(F.collect_list("obj_id")).alias("obj_ids"), F.array_sort(F.collect_list(F.when(F.col("obj_id") % 2 == 0, chosen))).alias("phrases"))
    return g.withColumn("sentence_id", F.lit(0)).withColumn("caption", F.lit("old item 0 here")).withColumn("zh", F.when(F.col("stem") % 2 == 0, "z"))


@query("""SELECT stem, CASE WHEN stem % 5 = 1 THEN '' WHEN stem % 5 = 2 THEN 'new thing and item 0.' WHEN stem % 5 = 3 THEN 'old item 0 here' ELSE t END AS caption, CASE WHEN stem % 5 = 2 THEN n + 1 ELSE n END AS n_objects FROM
(SELECT stem, count(*) AS n, CASE count(*) FILTER (obj_id % 2 = 0) WHEN 1 THEN 'item 0.' ELSE array_to_string(list('item ' || obj_id ORDER BY obj_id) FILTER (obj_id % 2 = 0)[1 : (count(*) FILTER (obj_id % 2 = 0)) - 1], ', ') || ' and item ' || (max(obj_id) FILTER (obj_id % 2 = 0)) || '.' END AS t FROM box GROUP BY stem)""", V_BOX)
def refresh_captions(spark, sf):
    """Q-11: asked for with own phrases, with none, with others, or not at all."""
    captions = _captions(spark, sf).withColumn("spans", F.array().cast("array<array<int>>"))
    item = lambda i, p: F.struct(F.lit(i).cast("long").alias("obj_id"), F.lit(p).alias("phrase"))
    k = F.col("stem") % 5
    new = F.when(k == 1, F.array().cast(drafts.CHOSEN)).when(k == 2, F.array(item(900, "new thing"), item(0, "item 0 "), item(0, "ITEM 0"), item(1, " ")))
    requests = captions.where("stem % 5 <> 3").select("stem", "sentence_id", new.alias("phrases"))
    described = views.boxes(spark, sf).withColumn("phrases", F.array("label"))
    return drafts.refresh_captions(captions, requests, described).select("stem", "caption", _l(F.size("obj_ids")).alias("n_objects"))


@query("SELECT stem, CASE WHEN stem % 3 = 0 THEN '' ELSE 'old item 0 here' END AS caption, CASE WHEN stem % 3 = 0 THEN '' WHEN stem % 2 = 0 THEN 'z' END AS zh, CASE WHEN stem % 3 = 0 THEN 0 ELSE count(*) FILTER (obj_id % 2 = 0) END AS n_phrases FROM box GROUP BY stem", V_BOX)
def save_captions(spark, sf):
    blank = F.transform("phrases", lambda p: F.struct(p.obj_id.alias("obj_id"), F.lit(" ").alias("phrase")))
    saved = drafts.save_captions(_captions(spark, sf).withColumn("phrases", F.when(F.col("stem") % 3 == 0, blank).otherwise(F.col("phrases"))))
    return saved.select("stem", "caption", "zh", _l(F.size("phrases")).alias("n_phrases"))


@query("SELECT stem, obj_id, 'big ' || lower(label) || CASE WHEN obj_id % 2 = 0 THEN '|x' ELSE '' END AS phrases FROM box WHERE obj_id % 3 <> 0 OR obj_id % 2 = 0", V_BOX)
def save_descriptions(spark, sf):
    b, big = views.boxes(spark, sf), F.concat(F.lit("big "), F.lower("label"))
    old = b.where("obj_id % 3 = 0").select("stem", "obj_id", F.array(big).alias("phrases"))
    edits = b.select("stem", "obj_id", F.array(F.concat(F.lit(" "), big), F.lit(" "), F.when(F.col("obj_id") % 2 == 0, " x ").otherwise("")).alias("phrases"))
    return drafts.save_descriptions(old, edits).select("stem", "obj_id", F.array_join("phrases", "|").alias("phrases"))


@query("SELECT stem, 'Write one sentence about ' || count(*) || ' objects. Phrases by object:' || chr(10) || string_agg('object ' || obj_id || CASE WHEN obj_id % 2 = 0 THEN ' (one thing, 2 phrases): ' || label || ' | even' ELSE ': ' || label END, chr(10) ORDER BY obj_id) AS prompt FROM box GROUP BY stem", V_BOX)
def phrases_prompt(spark, sf):
    said = lambda p: F.struct("obj_id", p.alias("phrase"))
    first = views.boxes(spark, sf).groupBy("stem").agg(F.array_sort(F.collect_list(said(F.col("label")))).alias("a"), F.array_sort(F.collect_list(F.when(F.col("obj_id") % 2 == 0, said(F.lit(" even "))))).alias("b"))
    return first.select("stem", drafts.phrases_prompt(F.concat("a", "b")).alias("prompt"))


@query("""SELECT p_partkey, 'Task: ' || p_name || chr(10) || CASE WHEN p_partkey % 3 = 0 THEN 'Read standard input and print the answer.' ELSE 'Complete the function that is asked for.' END || CASE WHEN p_partkey % 3 = 1 THEN chr(10) || 'Begin with:' || chr(10) || 'def f' ELSE '' END || chr(10) || 'Answer with code.' AS code,
CASE WHEN p_partkey % 2 = 0 THEN 'Subtitles of the video:' || chr(10) || 's' || chr(10) ELSE '' END || 'Choose the option that answers the question on the video; reply with its letter.' || chr(10) || p_name || chr(10) || 'A. x' || chr(10) || 'B. y' AS video FROM part""")
def task_prompts(spark, sf):
    k = F.col("p_partkey")
    code = drafts.code_prompt(F.col("p_name"), F.when(k % 3 == 1, "def f"), F.when(k % 3 == 2, "g"))
    video = drafts.video_prompt(F.col("p_name"), F.array(F.lit("A. x"), F.lit("B. y")), F.when(k % 2 == 0, "s"))
    return table(spark, sf, "part").select("p_partkey", code.alias("code"), video.alias("video"))


@query("SELECT 'caption' AS kind, stem, 0 AS id, 0 AS pos, 'old item 0 here' AS text FROM box WHERE stem % 2 = 1 GROUP BY stem UNION ALL SELECT 'phrase', stem, obj_id, p, CASE p WHEN 0 THEN label ELSE 'b' END FROM box, range(2) r(p) WHERE obj_id % 2 = 0 OR p = 1", V_BOX)
def translation_jobs(spark, sf):
    d = views.boxes(spark, sf).select("stem", "obj_id", F.array("label", F.lit("b")).alias("phrases"), F.when(F.col("obj_id") % 2 == 1, F.array(F.lit("z"))).alias("zh"))
    return drafts.translation_jobs(_captions(spark, sf), d).select("kind", "stem", "id", _l("pos").alias("pos"), "text")


@query("SELECT stem, obj_id, CASE WHEN obj_id % 2 = 0 THEN 'new' ELSE 'old' END AS zh FROM box", V_BOX)
def apply_translations(spark, sf):
    d = views.boxes(spark, sf).select("stem", "obj_id", F.array("label").alias("phrases"), F.array(F.lit("old")).alias("zh"))
    done = d.select("stem", "obj_id", F.array(F.when(F.col("obj_id") % 2 == 0, F.col("phrases")[0]).otherwise("else")).alias("phrases"), F.array(F.lit("new")).alias("zh"))
    return drafts.apply_translations(d, done).select("stem", "obj_id", F.col("zh")[0].alias("zh"))


@query("SELECT stem, obj_id, CASE WHEN obj_id % 3 = 0 THEN 'fresh' ELSE label END AS phrase FROM box", V_BOX)
def merge_descriptions(spark, sf):
    b = views.boxes(spark, sf)
    return drafts.merge_descriptions(b.select("stem", "obj_id", F.col("label").alias("phrase")), b.where("obj_id % 3 = 0").select("stem", "obj_id", F.lit("fresh").alias("phrase")))


@query("SELECT stem, CAST(least(count(*), 16) AS BIGINT) AS avoid, CAST(least(count(*), 8) AS BIGINT) AS locked, CAST(least(count(*), 2) AS BIGINT) AS features, count(*) AS n, array_to_string(list(CAST(obj_id AS VARCHAR) ORDER BY obj_id)[1:5], ',') AS shown FROM box GROUP BY stem", V_BOX)
def list_caps(spark, sf):
    """L-07 and L-08: the caps are the feature."""
    b = views.boxes(spark, sf)
    g = b.groupBy("stem").agg(F.collect_list("obj_id").alias("ids")).withColumn("c", drafts.capped(F.col("ids"), F.col("ids"), F.col("ids"), F.col("ids")))
    shown = drafts.missing_sample(b.select("stem", "obj_id"), ["stem"], "obj_id")
    return g.join(shown, "stem").select("stem", *[_l(F.size(f"c.{c}")).alias(c) for c in ("avoid", "locked", "features")], "n", F.array_join(F.col("shown").cast("array<string>"), ",").alias("shown"))


@query("SELECT count(*) AS n_all, (SELECT count(*) FROM (SELECT DISTINCT stem FROM box WHERE stem % 4 <> 0 OR obj_id > 0) WHERE stem IN (SELECT DISTINCT o_orderkey FROM orders ORDER BY 1 LIMIT 50)) AS n_first FROM (SELECT DISTINCT stem FROM box WHERE stem % 4 <> 0 OR obj_id > 0)", V_BOX)
def export_counts(spark, sf):
    """O-OUT-10: with and without a limit; the limit is the feature."""
    captions, objects = table(spark, sf, "orders").select(F.col("o_orderkey").alias("stem")), views.boxes(spark, sf).where("stem % 4 <> 0 or obj_id > 0")
    both = drafts.export_count(captions, objects).withColumnRenamed("n", "n_all")
    return both.join(drafts.export_count(captions, objects, 50).withColumnRenamed("n", "n_first"), how="cross")  # two rows of one


@query("SELECT row_number() OVER (ORDER BY stem % 7, stem, obj_id) - 1 AS line, stem, label AS object FROM box WHERE stem % 5 <> 0", V_BOX)
def flat_objects(spark, sf):
    images = views.boxes(spark, sf).groupBy("stem").agg(F.transform(F.array_sort(F.collect_list(F.struct("obj_id", "label"))), lambda x: x.label).alias("objects"))
    order = images.where("stem % 5 <> 0").select("stem", (F.col("stem") % 7).alias("rank"))
    return drafts.flat_objects(images, order).select(_l("line").alias("line"), "stem", "object")


@query("SELECT row_number() OVER (ORDER BY conv_id, turn) AS id, conv_id AS file, value AS record FROM conv WHERE conv_id % 6 <> 5", V_CONV)
def export_records(spark, sf):
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "value"))), lambda t: t.value)
    files = views.conversations(spark, sf).groupBy(F.col("conv_id").alias("file")).agg(turns.alias("records")).withColumn("records", F.when(F.col("file") % 6 != 5, F.col("records")))
    return drafts.export_records(files).select(_l("id").alias("id"), "file", "record")


@query("SELECT 'img/' || p_partkey || '.jpg' AS path, p_partkey AS \"index\", p_name AS image FROM part WHERE p_partkey % 2 = 0 UNION ALL SELECT 'img/' || p_brand || '-' || i || '.png', min(p_partkey), CASE i WHEN 0 THEN arg_min(p_name, p_partkey) ELSE arg_min(p_type, p_partkey) END FROM part, range(2) r(i) WHERE p_partkey % 2 = 1 GROUP BY p_brand, i")
def image_files(spark, sf):
    even = F.col("p_partkey") % 2 == 0
    rows = table(spark, sf, "part").select(F.col("p_partkey").alias("index"), F.when(even, F.array("p_name")).otherwise(F.array("p_name", "p_type")).alias("image"), F.array(*[F.concat("p_brand", F.lit(f"-{i}.png")) for i in range(2)]).alias("image_path"))
    return drafts.image_files(rows, "img")


@query("SELECT CASE WHEN p_partkey % 3 = 0 THEN 'at/' || p_name || p_partkey ELSE 'img/' || p_partkey || '.jpg' END AS path, p_partkey AS \"index\", CASE WHEN p_partkey % 3 > 0 THEN p_type END AS image FROM part")
def image_paths(spark, sf):
    """E-02: a third of the rows has paths only."""
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(k.alias("index"), F.when(k % 3 > 0, F.array("p_type")).alias("image"), F.array(F.concat(F.lit("at/"), "p_name", k.cast("string"))).alias("image_path"))
    return drafts.image_files(rows, "img")


@query("SELECT p_partkey AS \"index\", CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE CAST(p_size AS VARCHAR) END AS prediction, CASE p_partkey % 3 WHEN 0 THEN '/abs/x' WHEN 1 THEN 'http://h/x' ELSE '/data/' || p_brand || '/x' END AS path, CASE WHEN p_size > 10 THEN p_partkey / CAST(p_size - 10 AS DOUBLE) END AS seconds FROM part")
def predictions_and_paths(spark, sf):
    k = F.col("p_partkey")
    p = drafts.ordered_predictions(table(spark, sf, "part").withColumns({"index": k, "prediction": F.when(k % 3 != 0, F.col("p_size"))}))
    path = F.when(k % 3 == 0, "/abs/x").when(k % 3 == 1, "http://h/x").otherwise(F.concat(F.lit("./"), F.col("p_brand"), F.lit("/x")))
    return p.select("index", "prediction", drafts.absolute_path(F.lit("/data/"), path).alias("path"), drafts.frame_time(k, F.col("p_size") - 10).alias("seconds"))


@query("SELECT doc_id, CAST(CASE WHEN quality = 1 THEN 500 WHEN quality = 0 THEN 400 END AS DOUBLE) AS fx FROM documents LEFT JOIN labels USING (doc_id)")
def cameras(spark, sf):
    cams = table(spark, sf, "labels").select(F.col("doc_id").alias("name"), F.when(F.col("quality") == 1, 500.0).otherwise(400.0).alias("fx"))
    return drafts.with_camera(table(spark, sf, "documents").select("doc_id"), cams, "doc_id")


@query("SELECT n_name AS name, CASE WHEN n_nationkey % 2 = 0 THEN CAST(8000 + n_nationkey AS INT) END AS port, n_nationkey = 3 AS chosen FROM nation")
def service_registry(spark, sf):
    k = F.col("n_nationkey")
    url = F.when(k % 2 == 0, F.concat(F.lit(" http://h:"), (8000 + k).cast("string"), F.lit("/v1/ "))).otherwise("http://h/")
    rows = table(spark, sf, "nation").select(F.concat(F.lit(" "), "n_name").alias("name"), url.alias("base_url"), (k % 4 == 3).alias("default"), k.alias("position"))
    return drafts.services(rows).select("name", "port", "chosen")


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN 'mine' WHEN 1 THEN 'base' WHEN 2 THEN 'gone' ELSE 'base' END AS rule, p_partkey % 10 AS config FROM part")
def rules_and_configs(spark, sf):
    k = F.col("p_partkey")
    wanted = F.when(k % 4 == 0, "mine").when(k % 4 == 1, "lost").when(k % 4 == 2, "gone").otherwise("")
    files = F.when(k % 4 == 2, F.array(F.lit("x"))).otherwise(F.array(F.lit("mine"), F.lit("base")))
    pairs = drafts.dataset_pairs(F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.array(F.lit(-1).cast("long"), F.lit(-2).cast("long"), k % 10, F.lit(5).cast("long")))
    return table(spark, sf, "part").select("p_partkey", drafts.rule_file(wanted, F.lit("base"), files).alias("rule"), pairs["a"].alias("config"))


@query("SELECT p_brand AS file, count(*) AS n, CAST(sum(p_size * 10) AS DOUBLE) AS total FROM part WHERE p_partkey % 4 <> 0 GROUP BY p_brand")
def label_lines(spark, sf):
    good = F.concat(F.lit("1 0.5 0.5 1 1 0 "), F.lit("0"))
    lines = table(spark, sf, "part").select(F.col("p_brand").alias("file"), F.col("p_partkey").alias("line"), F.col("p_size").alias("size"), F.when(F.col("p_partkey") % 4 != 0, good).otherwise("1 a b").alias("value"))
    sized = drafts.label_lines(lines.withColumn("value", F.concat("value", F.lit("|"), F.col("size").cast("string"))), lambda v: F.when(readers.yolo_segment(F.split_part(v, F.lit("|"), F.lit(1)), F.lit(10), F.lit(20)).isNotNull(), F.struct(F.split_part(v, F.lit("|"), F.lit(2)).cast("double").alias("size"), readers.yolo_segment(F.split_part(v, F.lit("|"), F.lit(1)), F.lit(10), F.lit(20)).alias("s"))))
    return sized.select("file", _l(F.size("segments")).alias("n"), F.aggregate("segments", F.lit(0.0), lambda a, x: a + x["size"] * x["s"]["points"][2]).alias("total"))


@query("SELECT '/r/' || p_brand AS root, count(*) FILTER (p_size % 3 = 0) AS n_images, count(*) FILTER (p_size % 3 = 1) AS n_labels, count(*) FILTER (p_size % 3 = 2) AS n_other FROM part GROUP BY p_brand")
def folder_counts(spark, sf):
    k = F.col("p_size") % 3
    files = table(spark, sf, "part").select(F.concat(F.lit("/r/"), "p_brand").alias("root"), F.when(k == 0, ".jpg").when(k == 1, ".json").otherwise(".txt").alias("suffix"))
    return drafts.folder_counts(files, "root")


@query("SELECT CASE n_nationkey % 5 WHEN 3 THEN '/r' || n_nationkey || '/images' ELSE '/r' || n_nationkey END AS root, '/r' || n_nationkey AS dataset_root, CASE n_nationkey % 5 WHEN 0 THEN 'images' WHEN 1 THEN '.' WHEN 2 THEN 'other' WHEN 3 THEN 'images' ELSE 'imgs' END AS folder FROM nation")
def image_roots(spark, sf):
    k = F.col("n_nationkey")
    root = F.concat(F.lit("/r"), k.cast("string"), F.when(k % 5 == 3, "/images").otherwise(""))
    lit = lambda *v: F.array(*[F.struct(F.lit(f).alias("folder"), F.lit(n).alias("n_images")) for f, n in v])
    own = F.when(k % 5 == 0, lit(("imgs", 1), ("images", 2), (".", 3))).when(k % 5 == 1, lit((".", 1), ("zoo", 4), ("images", 0))).when(k % 5 == 2, lit(("zoo", 1), ("other", 1), (".git", 9), (".", 0))).when(k % 5 == 3, lit((".", 7))).otherwise(lit(("imgs", 2), ("a", 1)))
    return drafts.image_root(table(spark, sf, "nation").select(root.alias("root"), F.inline(own)))


@query("SELECT stem, count(*) AS n FROM box WHERE stem IN (SELECT o_orderkey FROM orders WHERE o_orderpriority LIKE '1%') GROUP BY stem", V_BOX)
def prior_objects(spark, sf):
    wanted = table(spark, sf, "orders").where("o_orderpriority like '1%'").select(F.col("o_orderkey").alias("stem"))
    return drafts.prior_objects(views.boxes(spark, sf), wanted).groupBy("stem").agg(F.count("*").alias("n"))


@query("SELECT conv_id, CAST(21 + sum(length(value)) AS BIGINT) AS by_characters FROM conv GROUP BY conv_id", V_CONV)
def token_totals(spark, sf):
    """A-26 with a tokenizer of one's own; here one of characters."""
    c = views.conversations(spark, sf).groupBy("conv_id").agg(F.collect_list("value").alias("values"))
    return c.select("conv_id", _l(sequences.token_total(F.col("values"), F.lit(0), F.length)).alias("by_characters"))


@query("SELECT p_partkey AS \"index\", CASE p_partkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'B' ELSE 'C' END AS extracted_answer, CASE p_partkey % 3 WHEN 0 THEN 'rule' ELSE 'judge' END AS extraction_method FROM part")
def judge_tries(spark, sf):
    """Q-12: the judge is asked again for what it left open."""
    k = F.col("p_partkey")
    items = table(spark, sf, "part").select(k.alias("index"), F.lit("q").alias("question"), F.lit("first word").alias("A"), F.lit("second word").alias("B"), F.lit("third word").alias("C"), F.lit("A").alias("gt"), F.when(k % 3 == 0, "(A)").when(k % 3 == 1, "hm").otherwise("well").alias("prediction"))

    def judge(prompts, turn):
        return prompts.map(lambda p: None if p is None else "B" if p.endswith("hm") else "C" if turn == 2 else "?")

    return evaluation.extract(items, judge, tries=3).select("index", "extracted_answer", "extraction_method")


@query("SELECT p_partkey, CASE WHEN h % 2 = 0 THEN 'Read all text in the image, line by line, and nothing else. It may be in de, en.' ELSE 'Read all text in the image, line by line, and nothing else.' END AS prompt FROM siz", V_SIZE)
def ocr_prompts(spark, sf):
    with_languages = drafts.ocr_prompt(F.array(F.lit("de"), F.lit("en")))
    return views.sizes(spark, sf).select("p_partkey", text.squeeze(F.when(F.col("h") % 2 == 0, with_languages).otherwise(drafts.ocr_prompt())).alias("prompt"))

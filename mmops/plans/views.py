"""Views of the supplied tables in the shapes that the operators take, for Spark and as common table expressions for SQL.

Only integer arithmetic makes them, so that both sides have equal values.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """conv_id, turn, from, value, h (which human turn), n_media."""
    t = table(spark, sf_dir, "conversations")
    role = F.when(F.col("role") == "user", "human").when(F.col("role") == "assistant", "gpt").otherwise(F.col("role"))
    t = t.withColumn("from", role).withColumn("h", F.sum((F.col("role") == "user").cast("int")).over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    marked = (F.col("from") == "human") & ((F.col("h") == 0) | ((F.col("h") == 1) & (F.col("conv_id") % 2 == 0)))
    return t.select("conv_id", "turn", "from", F.when(marked, F.concat(F.lit("<image>\n"), F.col("text"))).otherwise(F.col("text")).alias("value"), "h", (F.col("conv_id") % 3).alias("n_media"))


V_CONV = """conv AS (SELECT conv_id, turn, "from", CASE WHEN "from" = 'human' AND (h = 0 OR (h = 1 AND conv_id % 2 = 0)) THEN '<image>' || chr(10) || text ELSE text END AS value, h, conv_id % 3 AS n_media FROM
(SELECT *, CASE role WHEN 'user' THEN 'human' WHEN 'assistant' THEN 'gpt' ELSE role END AS "from", CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS BIGINT) AS h FROM conversations))"""


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """stem, obj_id, label, width, height, x1, y1, x2, y2, partkey."""
    t = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey")
    b = t.select(
        F.col("l_orderkey").alias("stem"), (F.row_number().over(order) - 1).cast("long").alias("obj_id"), F.concat("l_returnflag", "l_linestatus").alias("label"),
        (640 + 160 * (F.col("l_orderkey") % 5)).alias("width"), (480 + 120 * (F.col("l_orderkey") % 3)).alias("height"), "l_partkey", "l_suppkey", F.col("l_quantity").cast("long").alias("q"), F.floor("l_extendedprice").alias("p"),
    )
    b = b.withColumn("x1", (F.col("l_partkey") * 7) % (F.col("width") - 64)).withColumn("y1", (F.col("l_suppkey") * 11) % (F.col("height") - 64))
    return b.select("stem", "obj_id", "label", "width", "height", "x1", "y1", (F.col("x1") + 8 + F.col("q")).alias("x2"), (F.col("y1") + 8 + F.col("p") % 50).alias("y2"), F.col("l_partkey").alias("partkey"))


V_BOX = """box AS (SELECT stem, obj_id, label, width, height, x1, y1, x1 + 8 + q AS x2, y1 + 8 + p % 50 AS y2, l_partkey AS partkey FROM (SELECT *, (l_partkey * 7) % (width - 64) AS x1, (l_suppkey * 11) % (height - 64) AS y1 FROM
(SELECT l_orderkey AS stem, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS obj_id, l_returnflag || l_linestatus AS label, 640 + 160 * (l_orderkey % 5) AS width, 480 + 120 * (l_orderkey % 3) AS height, l_partkey, l_suppkey, CAST(trunc(l_quantity) AS BIGINT) AS q, CAST(floor(l_extendedprice) AS BIGINT) AS p FROM lineitem)))"""


def found_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The boxes moved by a few pixels, some of them missing."""
    b, d = boxes(spark, sf_dir).where("partkey % 11 <> 0"), F.col("partkey") % 7 - 3
    return b.withColumns({c: F.col(c) + d for c in ("x1", "y1", "x2", "y2")})


V_DET = """det AS (SELECT stem, obj_id, label, width, height, x1 + d AS x1, y1 + d AS y1, x2 + d AS x2, y2 + d AS y2, partkey FROM (SELECT *, partkey % 7 - 3 AS d FROM box WHERE partkey % 11 <> 0))"""


def choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """index, question, A to D, answer, gt, category, split, prediction."""
    p = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_brand")
    n = p.count()
    rows = p
    for i in (1, 2, 3):
        rows = rows.join(p.select(F.col("p_partkey").alias(f"k{i}"), F.col("p_name").alias(f"n{i}")), (F.col("p_partkey") - 1 + i) % n + 1 == F.col(f"k{i}"))
    k = F.col("p_partkey")
    gt = F.when((k % 4 == 3) & (k % 5 == 0), "A").otherwise(F.char(65 + k % 4))
    said = ["B", "(C).", "The answer is D", "A good choice would be here", None, "Z", "Cannot determine the answer", "A or B"]
    prediction = F.when(k % 8 == 4, F.concat(F.lit("it is "), F.col("n1"), F.lit(" indeed")))
    for i, s in enumerate(said):
        if s:
            prediction = prediction.when(k % 8 == i, s)
    return rows.select(
        k.alias("index"), F.concat(F.lit("which "), F.col("p_brand")).alias("question"), F.col("p_name").alias("A"), F.col("n1").alias("B"), F.col("n2").alias("C"), F.when(k % 5 != 0, F.col("n3")).alias("D"),
        gt.alias("gt"), F.col("p_type").alias("category"), F.when(k % 13 != 0, F.col("p_brand")).alias("split"), prediction.alias("prediction"),
    )


V_MCQ = """mcq AS (SELECT p.p_partkey AS "index", 'which ' || p.p_brand AS question, p.p_name AS "A", b.p_name AS "B", c.p_name AS "C", CASE WHEN p.p_partkey % 5 <> 0 THEN d.p_name END AS "D",
CASE WHEN p.p_partkey % 4 = 3 AND p.p_partkey % 5 = 0 THEN 'A' ELSE chr(CAST(65 + p.p_partkey % 4 AS INT)) END AS gt, p.p_type AS category, CASE WHEN p.p_partkey % 13 <> 0 THEN p.p_brand END AS split,
CASE p.p_partkey % 8 WHEN 0 THEN 'B' WHEN 1 THEN '(C).' WHEN 2 THEN 'The answer is D' WHEN 3 THEN 'A good choice would be here' WHEN 4 THEN 'it is ' || b.p_name || ' indeed' WHEN 5 THEN 'Z' WHEN 6 THEN 'Cannot determine the answer' ELSE 'A or B' END AS prediction
FROM part p, (SELECT count(*) AS n FROM part) JOIN part b ON b.p_partkey = p.p_partkey % n + 1 JOIN part c ON c.p_partkey = (p.p_partkey + 1) % n + 1 JOIN part d ON d.p_partkey = (p.p_partkey + 2) % n + 1),
inferred AS (SELECT *, CASE "index" % 8 WHEN 0 THEN 'B' WHEN 1 THEN 'C' WHEN 2 THEN CASE WHEN "D" IS NOT NULL THEN 'D' ELSE t END WHEN 5 THEN 'Z' WHEN 6 THEN 'Z' ELSE t END AS letter FROM
(SELECT *, CASE WHEN CAST(contains(lower(prediction), lower("A")) AS INT) + CAST(contains(lower(prediction), lower("B")) AS INT) + CAST(contains(lower(prediction), lower("C")) AS INT) + CAST(coalesce(contains(lower(prediction), lower("D")), false) AS INT) = 1
 THEN CASE WHEN contains(lower(prediction), lower("A")) THEN 'A' WHEN contains(lower(prediction), lower("B")) THEN 'B' WHEN contains(lower(prediction), lower("C")) THEN 'C' ELSE 'D' END END AS t FROM mcq))"""


def _runs(words) -> Column:
    """All words in runs of four, the last one shorter."""
    starts = F.when(F.size(words) > 0, F.sequence(F.lit(0), F.size(words) - 1, F.lit(4))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(words, i + 1, F.lit(4)), " "))


def phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, place, lang, source, label, phrase: every text in phrases of four words; ``place`` rises with document and place."""
    d = table(spark, sf_dir, "documents").withColumn("words", F.filter(F.split("text", r"[ \n]+"), lambda w: w != ""))
    p = d.select("doc_id", "lang", "source", F.concat(F.col("lang"), F.lit("Word")).alias("label"), F.posexplode(_runs("words")).alias("k", "phrase"))
    return p.select("doc_id", (F.col("doc_id") * 10_000_000 + F.col("k")).alias("place"), "lang", "source", "label", "phrase")


V_PHRASE = """phr AS (SELECT doc_id, doc_id * 10000000 + unnest(range(len(runs))) AS place, lang, source, lang || 'Word' AS label, unnest(runs) AS phrase FROM (SELECT *, list_transform(range(0, len(w), 4), lambda i: array_to_string(w[i + 1 : i + 4], ' ')) AS runs FROM
(SELECT doc_id, lang, source, list_filter(string_split_regex(text, '[ \\n]+'), lambda x: x <> '') AS w FROM documents)))"""


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, line, caption, runs: every line of every text with its words in runs of four."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line", "caption"))
    words = F.filter(F.split("caption", " +"), lambda w: w != "")
    return d.withColumn("words", words).select("doc_id", F.col("line").cast("long").alias("line"), "caption", _runs("words").alias("runs"))


V_LINE = """lin AS (SELECT doc_id, line, caption, list_transform(range(0, len(w), 4), lambda i: array_to_string(w[i + 1 : i + 4], ' ')) AS runs FROM (SELECT doc_id, line, caption, list_filter(string_split_regex(caption, ' +'), lambda x: x <> '') AS w FROM
(SELECT doc_id, unnest(range(len(l))) AS line, unnest(l) AS caption FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents))))"""


def sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k, (28 + k * 37 % 4000).alias("h"), (28 + k * 53 % 4000).alias("w"))


V_SIZE = "siz AS (SELECT p_partkey, 28 + p_partkey * 37 % 4000 AS h, 28 + p_partkey * 53 % 4000 AS w FROM part)"

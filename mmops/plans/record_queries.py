"""Queries of smaller operators on records, folders, chips, positions and answers, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers, geometry, text
from ..operators import grounding, packing, records, validation, workspace
from . import views
from .queries import _l, query
from .views import V_BOX, V_MCQ, table


@query("SELECT name, n, n_ids FROM (SELECT name, CAST(CASE WHEN rate >= 1 THEN count(*) ELSE trunc(count(*) * rate) END AS BIGINT) AS n, CAST(CASE WHEN rate >= 1 THEN count(*) ELSE trunc(count(*) * rate) END AS BIGINT) AS n_ids FROM (SELECT lang || '%' || (20 + 40 * (doc_id % 3)) AS name, (20 + 40 * (doc_id % 3)) / 100.0::DOUBLE AS rate FROM documents) GROUP BY name, rate) WHERE n > 0")
def sample_mixture(spark, sf):
    """L-04, L-05, O-IN-20: data sets of names with %N, sampled together."""
    name = F.concat("lang", F.lit("%"), (20 + 40 * (F.col("doc_id") % 3)).cast("string"))
    d = table(spark, sf, "documents").select("doc_id", name.alias("name"))
    return records.sample_mixture(d, "name", records.rate_of(F.col("name")), "doc_id").groupBy("name").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_ids"))


@query("SELECT page_id, regexp_extract(url, '://([^/]+)', 1) || '/' || regexp_extract(url, '[^/]*$') AS image, regexp_matches(lower(url), '\\.(mp4|avi|mkv|mov|wmv|flv|webm|mpeg)$') AS video FROM pages")
def folder_images(spark, sf):
    """P-03, E-11."""
    p = table(spark, sf, "pages").select("page_id", F.regexp_extract("url", "://([^/]+)", 1).alias("folder"), F.regexp_extract("url", "([^/]*)$", 1).alias("image"), text.is_video(F.col("url")).alias("video"))
    return records.with_folder(p, "folder").select("page_id", "image", "video")


@query("SELECT conv_id, count(*) AS n_turns FROM conversations WHERE length(text) % 4 = 0 GROUP BY conv_id")
def kept_items(spark, sf):
    """P-07: items whose turns have all gone are dropped."""
    turns = F.array_compact(F.collect_list(F.when(F.length("text") % 4 == 0, F.struct("turn", "text"))))
    items = table(spark, sf, "conversations").groupBy("conv_id").agg(turns.alias("conversations"))
    return records.drop_empty(items).select("conv_id", _l(F.size("conversations")).alias("n_turns"))


@query("""SELECT stem, array_to_string(CASE WHEN len(list_filter(l, lambda x: x LIKE 'A%')) > 0 THEN list_filter(l, lambda x: x LIKE 'A%') WHEN len(list_filter(l, lambda x: x LIKE 'R%')) > 0 THEN list_filter(l, lambda x: x LIKE 'R%') ELSE l END, ',') AS labels, x1, y1, x2, y2
FROM (SELECT stem, list(label ORDER BY obj_id) AS l, min(x1) AS x1, min(y1) AS y1, max(x1) AS x2, max(y1) AS y2 FROM box GROUP BY stem)""", V_BOX)
def selected_shapes(spark, sf):
    """P-08, A-10: polygons, else rectangles, else what there is; and the box around all points."""
    kind = F.when(F.col("label").startswith("A"), " Polygon").when(F.col("label").startswith("R"), "rectangle").otherwise("line")
    shape = F.struct("obj_id", F.col("label"), kind.alias("shape_type"), F.array(F.array("x1", "y1")).alias("points"))
    g = views.boxes(spark, sf).groupBy("stem").agg(F.array_sort(F.collect_list(shape)).alias("s"))
    box = geometry.bounding_box(F.flatten(F.transform("s", lambda s: s.points)))
    return g.select("stem", F.array_join(F.transform(grounding.select_shapes(F.col("s"), "polygon"), lambda s: s.label), ",").alias("labels"), *[box[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


@query("SELECT p_brand, array_to_string(list(p_name ORDER BY first), '|') AS pool FROM (SELECT p_brand, p_name, min(p_partkey) AS first FROM part GROUP BY p_brand, p_name) GROUP BY p_brand")
def brand_pools(spark, sf):
    """A-11: each brand's distinct names as first seen."""
    p = table(spark, sf, "part").select("p_brand", "p_partkey", F.col("p_name").alias("phrase"))
    return grounding.class_pool(p, ["p_brand"], "p_partkey").select("p_brand", F.array_join("pool", "|").alias("pool"))


@query("SELECT stem, CAST(row_number() OVER (PARTITION BY stem ORDER BY obj_id) - 1 AS BIGINT) AS sentence_id, label FROM box WHERE NOT (stem = (SELECT max(stem) FROM box) AND obj_id = 0)", V_BOX)
def deleted_caption(spark, sf):
    """P-33, W-03."""
    b = views.boxes(spark, sf)
    last = b.agg(F.max("stem")).first()[0]
    return grounding.delete_caption(b.select("stem", F.col("obj_id").alias("sentence_id"), "label"), last, 0).select("stem", _l("sentence_id").alias("sentence_id"), "label")


@query("""SELECT stem, 'objects' AS kind, count(*) AS n, '' AS phrases FROM box WHERE NOT (stem = (SELECT min(stem) FROM box) AND obj_id = 0) GROUP BY stem
UNION ALL SELECT stem, 'caption', count(*) FILTER (NOT (stem = (SELECT min(stem) FROM box) AND obj_id = 0)), coalesce(array_to_string(list(label || obj_id ORDER BY obj_id) FILTER (NOT (stem = (SELECT min(stem) FROM box) AND obj_id = 0)), ','), '') FROM box GROUP BY stem""", V_BOX)
def deleted_object(spark, sf):
    """P-31: out of objects and captions; the other phrases and images stay."""
    b = views.boxes(spark, sf)
    first = b.agg(F.min("stem")).first()[0]
    said = F.concat("label", F.col("obj_id").cast("string"))
    g = b.groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("obj_id", said.alias("p")))).alias("m"))
    captions = g.select("stem", F.transform("m", lambda m: m.obj_id).alias("obj_ids"), F.transform("m", lambda m: m.p).alias("phrases"), F.array_join(F.transform("m", lambda m: m.p), " ").alias("caption"), F.array().cast("array<array<int>>").alias("spans"))
    objects, _, kept = grounding.delete_object(b, b, captions, first, 0)
    a = objects.groupBy("stem").agg(F.lit("objects").alias("kind"), F.count("*").alias("n"), F.lit("").alias("phrases"))
    return a.unionByName(kept.select("stem", F.lit("caption").alias("kind"), _l(F.size("obj_ids")).alias("n"), F.array_join("phrases", ",").alias("phrases")))


@query("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE n_chars > 500)")
def restricted_labels(spark, sf):
    """J-07."""
    return validation.restrict_to_images(table(spark, sf, "labels"), table(spark, sf, "documents").where("n_chars > 500"), "doc_id").select("doc_id", "quality")


@query("""SELECT p_brand, p_type AS chip, coalesce(nullif(title, ''), 'others') AS title FROM (SELECT DISTINCT p_brand, lower(p_type) AS p_type FROM part) LEFT JOIN
(SELECT p_brand, k AS p_type, arg_min(title, size) AS title FROM (SELECT p_brand, p_size AS size, CASE WHEN p_size % 3 > 0 THEN 'size ' || p_size ELSE '' END AS title, lower(p_type) AS k FROM part WHERE p_size % 2 = 0 GROUP BY ALL) GROUP BY ALL) USING (p_brand, p_type)""")
def clustered_chips(spark, sf):
    """S-10, T-23: a brand's types under the title of the first size that names them."""
    p = table(spark, sf, "part")
    groups = p.where("p_size % 2 = 0").groupBy("p_brand", F.col("p_size").alias("group_no")).agg(F.collect_set(F.concat(F.lit(" "), F.upper("p_type"))).alias("keys"))
    groups = groups.withColumn("title", F.when(F.col("group_no") % 3 > 0, F.concat(F.lit("size "), F.col("group_no").cast("string"))).otherwise(" "))
    return workspace.cluster_chips(p.select("p_brand", F.col("p_type").alias("chip")), groups, ["p_brand"])


@query("""SELECT p_brand, array_to_string(list_filter(list_transform(g, lambda x: list_filter(x, lambda k: NOT list_contains(s, lower(k)))), lambda x: len(x) > 0).list_transform(lambda x: array_to_string(x, '+')) || ['new'], '|') AS groups FROM
(SELECT p_brand, list(t ORDER BY size) AS g FROM (SELECT p_brand, p_size AS size, list(p_type ORDER BY p_partkey) AS t FROM part GROUP BY ALL) GROUP BY p_brand) JOIN (SELECT p_brand, list(DISTINCT lower(p_type)) AS s FROM part WHERE p_partkey % 5 = 0 GROUP BY p_brand) USING (p_brand)""")
def merged_clusters(spark, sf):
    """S-09: old groups lose what is in scope, empty ones go, the new one follows."""
    p = table(spark, sf, "part")
    old = p.groupBy("p_brand", "p_size").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_partkey", "p_type"))), lambda x: x.p_type).alias("keys"))
    old = old.groupBy("p_brand").agg(F.transform(F.array_sort(F.collect_list(F.struct("p_size", "keys"))), lambda x: F.struct(x.p_size.cast("string").alias("title"), x["keys"].alias("keys"))).alias("old"))
    scope = p.where("p_partkey % 5 = 0").groupBy("p_brand").agg(F.collect_set(F.concat(F.lit(" "), "p_type")).alias("scope"))
    new = F.array(F.struct(F.lit("n").alias("title"), F.array(F.lit("new")).alias("keys")))
    merged = workspace.merge_clusters(F.col("old"), new, F.col("scope"))
    return old.join(scope, "p_brand").select("p_brand", F.array_join(F.transform(merged, lambda g: F.array_join(g["keys"], "+")), "|").alias("groups"))


@query("SELECT p_partkey, chr(CAST(65 + p_size % 26 AS INT)) AS letter, CAST(p_size % 26 AS BIGINT) AS back, least(1024, greatest(256, 48 * p_size + 64)) AS budget FROM part")
def option_letters(spark, sf):
    """M-30, E-05."""
    p = table(spark, sf, "part").withColumn("letter", answers.letter_of(F.col("p_size") % 26))
    return p.select("p_partkey", "letter", _l(answers.index_of(F.col("letter"))).alias("back"), workspace.caption_budget(F.col("p_size")).alias("budget"))


@query("""SELECT p_partkey, a * (a - 1) // 2 + a * m * k + b * s + b * (b - 1) // 2 AS t, a * (a - 1) // 2 + a * m * k + k * m * (m - 1) // 2 + b * s + b * (b - 1) // 2 AS h, a * (a - 1) // 2 + a * m * k + m * k * (k - 1) // 2 + b * s + b * (b - 1) // 2 AS w FROM
(SELECT *, a + greatest(1, m, k) AS s FROM (SELECT p_partkey, p_partkey % 7 AS a, p_partkey % 5 AS b, 1 + p_partkey % 4 AS m, 1 + p_size % 3 AS k FROM part))""")
def rotary_positions(spark, sf):
    """M-31: text, a picture and text; the sums of the three lines of positions."""
    k = F.col("p_partkey")
    m, w = (1 + k % 4).cast("int"), 1 + F.col("p_size") % 3
    one = lambda i, n: F.array_repeat(F.lit(i), n.cast("int"))
    ids = F.concat(one(5, k % 7), one(packing.IMAGE_ID, m * w), one(6, k % 5))
    rows = table(spark, sf, "part").select("p_partkey", ids.alias("input_ids"), F.array(F.array(F.lit(1), 2 * m, 2 * w)).alias("image_grids"), F.array().cast("array<array<int>>").alias("video_grids"))
    total = lambda i: F.aggregate(F.col("positions")[i], F.lit(0).cast("long"), lambda a, x: a + x)
    return packing.with_positions(rows).select("p_partkey", *[total(i).alias(c) for i, c in enumerate(("t", "h", "w"))])


@query("SELECT p_brand, array_to_string(list(p_partkey ORDER BY p_partkey), ',') AS t, array_to_string(list(p_size ORDER BY p_partkey), ',') AS h, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_brand")
def joined_positions(spark, sf):
    """G-18."""
    p = table(spark, sf, "part").select("p_brand", "p_partkey", F.array(F.array("p_partkey"), F.array(_l("p_size")), F.array(F.lit(0).cast("long"))).alias("positions"))
    done = workspace.concat_positions(p, ["p_brand"], "p_partkey")
    return done.select("p_brand", F.array_join(F.col("positions")[0].cast("array<string>"), ",").alias("t"), F.array_join(F.col("positions")[1].cast("array<string>"), ",").alias("h"), _l(F.size(F.col("positions")[2])).alias("n"))


@query("""SELECT a.p_partkey, a.p_size = b.p_size AND abs(a.p_retailprice - b.p_retailprice) <= 1e-6 + 1e-5 * abs(b.p_retailprice) AS agree FROM part a JOIN part b ON b.p_partkey = a.p_partkey + CASE WHEN a.p_partkey % 2 = 0 THEN 0 ELSE 1 END""")
def agreeing_outputs(spark, sf):
    """G-24: a part's size and price against its own or the next part's, laid out in another way."""
    p = table(spark, sf, "part").select("p_partkey", F.col("p_size").cast("string").alias("s"), F.col("p_retailprice").cast("string").alias("r"))
    other = p.select((F.col("p_partkey")).alias("k"), F.concat(F.lit("\n "), "s", F.lit(".0\n\n"), "r", F.lit(" ")).alias("want"))
    rows = p.withColumn("got", F.concat("s", F.lit("  "), "r")).join(other, F.col("k") == F.col("p_partkey") + F.col("p_partkey") % 2)
    return workspace.compare_outputs(rows).select("p_partkey", "agree")


@query("""SELECT "index", letter AS early, coalesce(letter = gt, false) AS late FROM inferred""", V_MCQ)
def post_checks(spark, sf):
    """Q-13: the letter of a first look, and whether it is right in the last."""
    m = views.choices(spark, sf)
    options = F.map_filter(F.create_map(*[x for c in "ABCD" for x in (F.lit(c), F.col(c))]), lambda _, v: v.isNotNull())
    check = lambda early: answers.post_check(F.col("prediction"), F.col("gt"), options, early)
    return m.select("index", check(True).alias("early"), check(False).alias("late"))


_FOLDERS = "['jsons', 'jsons-segm', 'jsons-sem', 'jsons-det', 'images', 'Imgs', '.cache', 'photos', 'PHOTOS']"


@query(f"""WITH f AS (SELECT o_custkey, {_FOLDERS}[1 + o_orderkey % 9] AS folder, count(*) AS n FROM orders GROUP BY ALL), l AS (SELECT o_custkey, min(CASE folder WHEN 'jsons' THEN 0 WHEN 'jsons-segm' THEN 1 WHEN 'jsons-sem' THEN 2 ELSE 4 END) AS r, replace(replace(folder, 'jsons-sem', 'jsons-seg'), 'jsons-segg', 'jsons-seg') AS d,
CASE folder WHEN 'jsons-sem' THEN 'jsons-segm' WHEN 'jsons-det' THEN 'jsons-detect' ELSE folder END AS name FROM f WHERE folder LIKE 'jsons%' GROUP BY o_custkey, folder),
ln AS (SELECT o_custkey, 'label' AS kind, name, min(r) AS r FROM l GROUP BY o_custkey, name), im AS (SELECT o_custkey, 'image' AS kind, min((CASE folder WHEN 'images' THEN 1 ELSE 99 END, folder)) AS b FROM f WHERE folder NOT LIKE '.%' AND n > 0 GROUP BY o_custkey, lower(folder))
SELECT o_custkey, kind, name, row_number() OVER (PARTITION BY o_custkey ORDER BY r, name) AS place FROM ln UNION ALL SELECT o_custkey, kind, b[2], row_number() OVER (PARTITION BY o_custkey ORDER BY b) FROM im""")
def folder_options(spark, sf):
    """V-05 to V-08: label folders once by shown name and priority, image folders once without regard to case."""
    names = F.array(*[F.lit(x) for x in ("jsons", "jsons-segm", "jsons-sem", "jsons-det", "images", "Imgs", ".cache", "photos", "PHOTOS")])
    o = table(spark, sf, "orders").groupBy("o_custkey", F.get(names, (F.col("o_orderkey") % 9).cast("int")).alias("folder")).agg(F.count("*").alias("n_labels"))
    o = o.withColumn("n_images", F.col("n_labels"))
    a = workspace.label_folder_options(o, ["o_custkey"]).withColumn("kind", F.lit("label"))
    b = workspace.image_folder_options(o, ["o_custkey"]).withColumn("kind", F.lit("image"))
    return a.unionByName(b).select("o_custkey", "kind", "name", _l("place").alias("place"))


@query("SELECT p_brand, array_to_string(list(k || '=' || v ORDER BY k), ',') AS config FROM (SELECT p_brand, k, arg_max(v, side) AS v FROM (SELECT p_brand, p_size AS k, min(p_partkey) AS v, p_partkey % 2 AS side FROM part WHERE p_size < 10 GROUP BY ALL) GROUP BY ALL) GROUP BY p_brand")
def merged_configs(spark, sf):
    """V-10: two maps of a brand; the later one wins."""
    p = table(spark, sf, "part").where("p_size < 10").groupBy("p_brand", "p_size", (F.col("p_partkey") % 2).alias("side")).agg(F.min("p_partkey").cast("string").alias("v"))
    entry = lambda side: F.map_from_entries(F.array_compact(F.collect_list(F.when(F.col("side") == side, F.struct(F.lpad(F.col("p_size").cast("string"), 2, "0"), "v"))))).alias(f"m{side}")
    g = p.groupBy("p_brand").agg(entry(0), entry(1))
    merged = F.array_sort(F.map_entries(workspace.merge_maps(F.col("m0"), F.col("m1"))))
    return g.select("p_brand", F.array_join(F.transform(merged, lambda e: F.concat(F.ltrim(e.key, F.lit("0")), F.lit("="), e.value)), ",").alias("config"))


@query("""SELECT p_brand AS "A", p_partkey AS index, p_size AS size FROM part""")
def lowered_names(spark, sf):
    """P-16, P-19: names of columns in lower case but for options, and a text index of digits as a number."""
    p = table(spark, sf, "part").select(F.col("p_brand").alias("A"), F.col("p_partkey").cast("string").alias("Index"), F.col("p_size").alias("SIZE"))
    return records.index_as_number(records.lower_column_names(p))


@query("""SELECT conv_id, array_to_string(list(CASE WHEN role = 'user' THEN 'image:' || turn ELSE 'text:' || turn END ORDER BY turn), ',') AS parts, count(*) FILTER (role = 'user') AS n_vision FROM conversations WHERE role <> 'system' GROUP BY conv_id""")
def message_parts(spark, sf):
    """P-26, P-28: pictures before texts, parts of none gone."""
    user, none = F.col("role") == "user", F.lit(None).cast("string")
    part = F.struct("turn", F.when(user, "image").otherwise("text").alias("type"), F.when(F.col("role") != "system", F.col("turn").cast("string")).alias("text"), F.when(user, F.col("turn").cast("string")).alias("image"), none.alias("image_url"), none.alias("video"))
    g = table(spark, sf, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("content"))
    parts = workspace.typed_parts(F.col("content"))
    g = g.select("conv_id", F.array_join(F.transform(parts, lambda p: F.concat(p.type, F.lit(":"), p.value)), ",").alias("parts"), _l(F.size(workspace.vision_items(F.col("content")))).alias("n_vision"))
    return g.where("parts <> ''")


@query("""SELECT o_custkey, CAST(len(m) + 1 AS BIGINT) AS n, array_to_string(m, '|') || '|say' AS content FROM (SELECT o_custkey, list(CASE WHEN o_orderkey % 3 = 0 THEN 'video:a/' || name ELSE 'image:a/' || name END ORDER BY name) AS m FROM (SELECT *, o_orderkey || CASE o_orderkey % 3 WHEN 0 THEN '.mp4' ELSE '.jpg' END AS name FROM orders WHERE o_orderkey % 4 > 0) GROUP BY o_custkey)""")
def folder_messages(spark, sf):
    """P-27, P-35: a folder's pictures and videos in the order of names, then the prompt."""
    k = F.col("o_orderkey")
    suffix = F.when(k % 4 == 0, ".md").when(k % 3 == 0, ".mp4").otherwise(".jpg")
    f = table(spark, sf, "orders").withColumn("suffix", suffix).withColumn("name", F.concat(k.cast("string"), "suffix")).withColumn("path", F.concat(F.lit("a/"), "name"))
    m = workspace.folder_messages(f, "o_custkey", "say", (".jpg",), 16, 64)
    limits = F.forall(F.slice("content", F.lit(1), F.size("content") - 1), lambda p: (p.min_pixels == 16) & (p.max_pixels == 64))
    said = F.transform("content", lambda p: F.when(p.type == "text", p.value).otherwise(F.concat(p.type, F.lit(":"), p.value)))
    return m.where(limits).select("o_custkey", _l(F.size("content")).alias("n"), F.array_join(said, "|").alias("content"))

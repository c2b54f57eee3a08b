"""Queries of the stages over whole drafts: completion within a class, plug-ins, refreshes, incremental validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import geometry
from ..operators import completion, detection, drafts, grounding, incremental, plugins
from ..scratch import Scratch
from . import views
from .queries import TOKENS, _l, query
from .views import V_BOX, V_DET, table


def _described(spark, sf):
    """Objects with two phrases of their part's name."""
    p = table(spark, sf, "part").select(F.col("p_partkey").alias("partkey"), F.split("p_name", " ").alias("w"))
    two = lambda a, b: F.concat(F.get("w", F.lit(a)), F.lit(" "), F.coalesce(F.get("w", F.lit(b)), F.lit("thing")))
    return views.boxes(spark, sf).join(p, "partkey").select("stem", "obj_id", "label", F.array(two(0, 1), two(1, 0), F.lit(" ")).alias("phrases"))


V_SAID = """said AS (SELECT stem, obj_id, label, [w[1] || ' ' || coalesce(w[2], 'thing'), w[2] || ' ' || coalesce(w[1], 'thing')] AS own FROM box JOIN (SELECT p_partkey AS partkey, string_split(p_name, ' ') AS w FROM part) USING (partkey))"""


def _odd(asked):
    """Holds what isn't of a length that 3 divides."""
    return [[c for c in candidates if len(c) % 3] for _, _, candidates in asked]


@query("""SELECT s.stem, s.obj_id, array_to_string(own || coalesce(added, []), '|') AS phrases, CAST(len(coalesce(added, [])) AS BIGINT) AS n_added FROM said s LEFT JOIN added a ON a.stem = s.stem AND a.obj_id = s.obj_id""", V_BOX, V_SAID,
       f"each_one AS (SELECT stem, obj_id, label, phrase, seen, array_to_string({TOKENS.format('phrase')}, ' ') AS k FROM (SELECT stem, obj_id, label, unnest(own) AS phrase, obj_id * 10 + unnest(range(len(own))) AS seen FROM said))",
       "pool AS (SELECT stem, label, k, min(seen) AS seen, arg_min(phrase, seen) AS phrase FROM each_one WHERE k <> '' GROUP BY ALL)",
       "added AS (SELECT s.stem, s.obj_id, list(p.phrase ORDER BY p.seen) AS added FROM said s JOIN pool p USING (stem, label) WHERE length(p.phrase) % 3 <> 0 AND NOT EXISTS (SELECT 1 FROM each_one e WHERE e.stem = s.stem AND e.obj_id = s.obj_id AND e.k = p.k) GROUP BY ALL)")
def completed_phrases(spark, sf):
    """Q-09."""
    done = completion.complete_phrases(_described(spark, sf), _odd)
    return done.select("stem", "obj_id", F.array_join("phrases", "|").alias("phrases"), _l(F.size("exhaustive_added")).alias("n_added"))


def _registry() -> plugins.Registry:
    def plain(rows):
        return [[t] for t in rows["p_type"]]

    def made(rows):
        return [[n, f"made by {b}"] for n, b in zip(rows["p_name"], rows["p_brand"], strict=True)]

    def small(rows):
        if (rows["p_size"] > 25).any():
            raise ValueError(f"{len(rows)} rows are too large" if len(rows) > 1 else f"size {rows['p_size'].iloc[0]} is too large")
        return [["small"] for _ in range(len(rows))]

    return plugins.Registry(plain).register("Manufacturer#1", made).register("manufacturer 2", small)


@query("""SELECT p_partkey, engine, CASE engine WHEN 'manufacturer_1' THEN p_name || '|made by ' || p_brand WHEN 'manufacturer_2' THEN CASE WHEN p_size <= 25 THEN 'small' END ELSE p_type END AS phrases,
CASE WHEN engine = 'manufacturer_2' AND p_size > 25 THEN 'ValueError: size ' || p_size || ' is too large' END AS error FROM
(SELECT *, CASE WHEN p_size % 11 = 0 THEN 'default' WHEN right(p_brand, 2) LIKE '1%' THEN 'manufacturer_1' WHEN right(p_brand, 2) LIKE '2%' THEN 'manufacturer_2' ELSE 'default' END AS engine FROM part)""")
def scene_plugins(spark, sf):
    """§2.14: two plug-ins and the default; the second fails on some rows."""
    scene = F.when(F.col("p_size") % 11 != 0, F.concat(F.lit(" Manufacturer-"), F.left(F.right("p_brand", F.lit(2)), F.lit(1))))
    rows = table(spark, sf, "part").select("p_partkey", "p_name", "p_type", "p_brand", "p_size", scene.alias("scene"))
    return plugins.describe(rows, _registry()).select("p_partkey", "engine", F.array_join("phrases", "|").alias("phrases"), "error")


_SHAPES = "SELECT l_suppkey AS folder, l_orderkey AS file, CASE l_returnflag WHEN 'R' THEN 'rectangle' WHEN 'A' THEN 'polygon' ELSE ' Rectangle ' END AS shape_type FROM lineitem"


@query(f"""SELECT round, folder, CASE WHEN round = 1 OR folder % 7 = 3 THEN 'scan' WHEN folder % 7 = 4 THEN 'resume' ELSE 'signature' END AS tier, n_json, n_shapes, CASE WHEN round = 2 AND folder % 7 = 3 THEN 0 ELSE n_rectangle END AS n_rectangle, CASE WHEN round = 2 AND folder % 7 = 3 THEN 0 ELSE n_polygon END AS n_polygon,
CASE WHEN round = 1 OR folder % 7 <> 3 THEN CASE WHEN n_rectangle > 0 AND n_polygon > 0 THEN 'mixed' WHEN n_rectangle > 0 THEN 'rectangle' ELSE 'polygon' END END AS geometry FROM
(SELECT folder, count(DISTINCT file) AS n_json, count(*) AS n_shapes, count(*) FILTER (trim(lower(shape_type)) = 'rectangle') AS n_rectangle, count(*) FILTER (shape_type = 'polygon') AS n_polygon FROM ({_SHAPES}) GROUP BY folder), (SELECT unnest([1, 2]) AS round)""")
def incremental_validation(spark, sf):
    """V-01 to V-03: validated twice. The listing of some folders changes in between, and what is read then is of another kind, so rows that weren't scanned show it."""
    kind = F.when(F.col("l_returnflag") == "R", "rectangle").when(F.col("l_returnflag") == "A", "polygon").otherwise(" Rectangle ")
    shapes = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("folder"), F.col("l_orderkey").alias("file"), kind.alias("shape_type"))
    files = shapes.groupBy("folder", "file").agg((F.count("*") * 100).alias("size")).select("folder", F.col("file").cast("string").alias("name"), "size", F.lit(1000).alias("mtime"))
    changed = files.withColumn("mtime", F.when(F.col("folder") % 7 >= 3, F.col("mtime") + F.when(F.col("folder") % 7 <= 4, 1).otherwise(0)).otherwise(F.col("mtime")))
    complete = shapes.select("folder").distinct().where("folder % 7 = 4").select("folder", F.lit("mixed").alias("geometry"), F.lit(9).alias("n_objects"), F.lit(9).alias("n_labels"), F.lit(0).alias("n_images"))
    state = incremental.ValidationState(spark, Scratch(spark, "validation").path("state", keep=True))
    first = incremental.validate(files, lambda asked: shapes.join(asked, "folder", "left_semi"), state)
    second = incremental.validate(changed, lambda asked: shapes.join(asked, "folder", "left_semi").withColumn("shape_type", F.lit("circle")), state, complete)
    both = first.withColumn("round", F.lit(1)).unionByName(second.withColumn("round", F.lit(2)))
    return both.select("round", "folder", "tier", "n_json", "n_shapes", "n_rectangle", "n_polygon", "geometry")


@query("""SELECT stem, sentence_id, CASE WHEN asked THEN '' ELSE 'z' || sentence_id END AS zh, CASE WHEN asked AND sentence_id = 0 THEN 'refresh' WHEN sentence_id = 1 THEN 'grid' END AS strategy, obj_id AS grid_cell,
CASE WHEN asked THEN obj_id || ':Big ' || label || ':true:a,b;' || obj_id || ':Big ' || label || ':false:' ELSE obj_id || ': Big ' || label || ':true:a, b ,,c;' || obj_id || ':big ' || label || ':true:;' || obj_id || ':Big ' || label || ':false:' END AS items,
CASE WHEN asked THEN 'Big ' || label || ' and Big ' || label || '.' ELSE 'old' END AS caption FROM
(SELECT stem, s AS sentence_id, obj_id, label, (stem + s) % 3 = 0 AS asked FROM (SELECT stem, max(obj_id) AS obj_id, arg_max(label, obj_id) AS label FROM box GROUP BY stem), (SELECT unnest([0, 1]) AS s))""", V_BOX)
def refresh_fields(spark, sf):
    """Q-11: fields of captions and phrases through a refresh; numbers that have a gap."""
    b = views.boxes(spark, sf).groupBy("stem").agg(F.max("obj_id").alias("obj_id"), F.max_by("label", "obj_id").alias("label"))
    item = lambda phrase, keep, features: F.struct(F.col("obj_id"), phrase.alias("phrase"), F.lit(keep).alias("keep_source_label"), features.alias("features"))
    none, named = F.lit(None).cast("array<string>"), F.array(*[F.lit(x) for x in ("a", " b ", "", "c")])
    items = F.array(item(F.concat(F.lit(" Big "), "label"), True, named), item(F.concat(F.lit("big "), "label"), True, none), item(F.concat(F.lit("Big "), "label"), False, none))
    captions = b.select("stem", F.explode(F.array(F.lit(2), F.lit(5))).alias("sentence_id"), F.array("obj_id").alias("obj_ids"), items.alias("phrases"), F.col("obj_id").alias("grid_cell"), "label")
    first = F.col("sentence_id") == 2
    captions = captions.withColumns({"caption": F.lit("old"), "zh": F.when(first, "z0").otherwise("z1"), "strategy": F.when(~first, "grid"), "spans": F.array().cast("array<array<int>>")})
    requests = captions.where((F.col("stem") + F.when(first, 0).otherwise(1)) % 3 == 0).select("stem", "sentence_id", F.lit(None).cast(drafts.CHOSEN).alias("phrases"))
    done = drafts.refresh_captions(captions, requests, _described(spark, sf))
    said = F.array_join(F.transform("phrases", lambda p: F.concat(p.obj_id.cast("string"), F.lit(":"), p.phrase, F.lit(":"), p.keep_source_label.cast("string"), F.lit(":"), F.coalesce(F.array_join(p.features, ","), F.lit("")))), ";")
    return done.select("stem", _l("sentence_id").alias("sentence_id"), "zh", "strategy", "grid_cell", said.alias("items"), "caption")


_CAT = "CASE label WHEN 'AF' THEN 0 WHEN 'RF' THEN 1 ELSE 2 END"


@query("SELECT cat AS category_id, thr AS threshold, count(*) FILTER (hit) AS hits, count(*) AS n FROM taking WHERE place > 0 GROUP BY ALL", V_BOX, V_DET, f"truth AS (SELECT *, {_CAT} AS cat FROM box)",
       f"dets AS (SELECT *, {_CAT} AS cat, row_number() OVER (PARTITION BY stem, {_CAT} ORDER BY obj_id) AS place FROM det)",
       """over AS (SELECT stem, cat, place, obj_id, i / ((x2 - x1) * (y2 - y1) + a - i) AS iou, (x1, y1, x2 - x1, y2 - y1) AS k FROM (SELECT t.*, d.place, CAST((least(t.x2, d.x2) - greatest(t.x1, d.x1)) * (least(t.y2, d.y2) - greatest(t.y1, d.y1)) AS DOUBLE) AS i, (d.x2 - d.x1) * (d.y2 - d.y1) AS a
FROM truth t JOIN dets d ON t.stem = d.stem AND t.cat = d.cat WHERE least(t.x2, d.x2) > greatest(t.x1, d.x1) AND least(t.y2, d.y2) > greatest(t.y1, d.y1)))""",
       """taking AS (SELECT stem, cat, thr, CAST(0 AS BIGINT) AS place, false AS hit, CAST([] AS BIGINT[]) AS taken FROM (SELECT DISTINCT stem, cat FROM dets), (SELECT unnest([0.5, 0.75]::DOUBLE[]) AS thr) UNION ALL
SELECT t.stem, t.cat, t.thr, t.place + 1, count(o.obj_id) > 0, CASE WHEN count(o.obj_id) > 0 THEN list_append(t.taken, arg_max(o.obj_id, (o.iou, o.k))) ELSE t.taken END
FROM taking t JOIN dets d ON d.stem = t.stem AND d.cat = t.cat AND d.place = t.place + 1 LEFT JOIN over o ON o.stem = t.stem AND o.cat = t.cat AND o.place = t.place + 1 AND o.iou >= t.thr AND NOT list_contains(t.taken, o.obj_id) GROUP BY t.stem, t.cat, t.thr, t.place, t.taken)""", recursive=True)
def det_hits(spark, sf):
    """A-19: hits and detections of each category at two thresholds, detections taken in order."""
    labels = F.when(F.col("label") == "AF", 0).when(F.col("label") == "RF", 1).otherwise(2)
    shape = lambda b: b.select(F.col("stem").alias("image_id"), labels.alias("category_id"), geometry.xywh(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]).alias("bbox"), "obj_id")
    truth = shape(views.boxes(spark, sf)).withColumn("area", detection.box_area(F.col("bbox"))).withColumn("iscrowd", F.lit(0))
    found = shape(views.found_boxes(spark, sf)).withColumn("score", F.lit(1.0)).withColumnRenamed("obj_id", "ord")
    slots = [("all", 1000, t) for t in (0.5, 0.75)]
    code = lambda s: F.ascii(F.substring("codes", detection.SLOTS.index(s) + 1, 1).cast("string"))
    each = F.explode(F.array(*[F.struct(F.lit(s[2]).alias("threshold"), (code(s) == detection.HIT).alias("hit")) for s in slots])).alias("x")
    return detection.matched_detections(truth, found).select("category_id", each).groupBy("category_id", "x.threshold").agg(F.count_if("x.hit").alias("hits"), F.count("*").alias("n"))


@query("""SELECT stem, count(*) AS n_objects, CAST(sum(len(list_distinct(own))) AS BIGINT) AS n_chosen, true AS numbered, true AS placed, CAST(sum(len(own)) + count(*) AS BIGINT) AS n_known FROM said GROUP BY stem""", V_BOX, V_SAID)
def generated_captions(spark, sf):
    """Q-10, Q-06: every object and phrase of an image is chosen, sentences are numbered without a gap, and each phrase stands at its span."""
    objects, described = views.boxes(spark, sf), _described(spark, sf)
    captions, synced = grounding.generate_captions(objects, described)
    stands = F.forall(F.arrays_zip("phrases", "spans"), lambda x: F.substring(F.col("caption"), x.spans[0] + 1, x.spans[1] - x.spans[0]) == x.phrases)
    chosen = F.transform(F.arrays_zip("obj_ids", "phrases"), lambda p: F.struct(p.obj_ids.alias("obj_id"), F.lower(p.phrases).alias("low")))
    # An image's captions are few: brought together once, they are counted in one shuffle.
    image = captions.groupBy("stem").agg(F.flatten(F.collect_list(chosen)).alias("chosen"), F.collect_list("sentence_id").alias("ids"), F.bool_and(stands).alias("placed")).where(F.size("chosen") > 0)
    distinct = lambda c: _l(F.size(F.array_distinct(c)))
    counted = image.select("stem", distinct("chosen.obj_id").alias("n_objects"), distinct("chosen").alias("n_chosen"), (distinct("ids") == F.array_max("ids") + 1).alias("numbered"), "placed")
    known = synced.groupBy("stem").agg(_l(F.sum(F.size("phrases"))).alias("n_known"))
    return counted.join(known, "stem")

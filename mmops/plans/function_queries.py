"""Queries that apply single functions to the supplied tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import answers, geometry, parsing, sequences, text
from ..operators import detection, evaluation, grounding, packing, records, validation, workspace
from . import views
from .queries import SYNONYM, TOKENS, _l, query
from .views import V_BOX, V_SIZE, table

# ------------------------------------------------------------------ text

_KEY = "array_to_string(" + TOKENS.format("{}") + ", ' ')"


@query(f"""SELECT p_partkey, k <> '' AND list_contains(['red car', 'steel'], k) AS same_content, s <> '' AND list_contains(['helmet', 'phone'], s) AS same_meaning FROM
(SELECT p_partkey, {_KEY.format('p')} AS k, {SYNONYM.format(_KEY.format('p'))} AS s FROM (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN 'the RED car' WHEN 1 THEN 'Hard-hats' WHEN 2 THEN 'of the' WHEN 3 THEN string_split(p_type, ' ')[-1] ELSE 'a cell phone' END AS p FROM part))""")
def duplicate_keys(spark, sf):
    k = F.col("p_partkey") % 5
    said = F.when(k == 0, "the RED car").when(k == 1, "Hard-hats").when(k == 2, "of the").when(k == 3, F.element_at(F.split("p_type", " "), -1)).otherwise("a cell phone")
    lists = lambda *v: F.array(*[F.lit(x) for x in v])
    return table(spark, sf, "part").select("p_partkey", text.is_duplicate(text.content_key(said), lists("red car", "steel")).alias("same_content"), text.is_duplicate(text.synonym_key(said), lists("helmet", "phone")).alias("same_meaning"))


@query("SELECT p_partkey, p_partkey % 4 < 2 OR (p_partkey % 4 = 2 AND p_size % 2 = 0) AS vehicle FROM part")
def vehicle_labels(spark, sf):
    k = F.col("p_partkey") % 4
    label = F.when(k == 0, "Car").when(k == 1, "red_Truck2").when(k == 2, F.when(F.col("p_size") % 2 == 0, "schoolBus").otherwise("busy")).otherwise("carpet")
    return table(spark, sf, "part").select("p_partkey", text.is_vehicle_label(label).alias("vehicle"))


@query("SELECT p_partkey, array_to_string([w1 || ' ' || w2 || ' lamp', 'old lamp ' || w3], '|') AS phrases FROM (SELECT p_partkey, string_split(p_name, ' ')[1] AS w1, p_partkey AS w2, p_size AS w3 FROM part)")
def sanitized_phrases(spark, sf):
    first, key, size = F.split("p_name", " ")[0], F.col("p_partkey").cast("string"), F.col("p_size").cast("string")
    given = F.array(F.concat(F.lit("  "), first, F.lit("  "), key), F.lit("The Lamp."), F.concat(first, F.lit(" of "), key, F.lit(" lamp")), F.lit(None).cast("string"), F.concat(F.lit("old lamp "), size), F.lit("third lamp"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(text.sanitize_phrases(given, F.lit("Lamp"), F.lit(2)), "|").alias("phrases"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN 'big door' ELSE 'green tree|big door' END AS phrases FROM part")
def fresh_phrases(spark, sf):
    avoid = F.when(F.col("p_partkey") % 3 == 0, F.array(F.lit("the green tree"), F.lit("hard hat"))).otherwise(F.array(F.lit("hard hat")))
    given = F.array(F.lit("helmet"), F.lit("green  tree"), F.lit("a blue car"), F.lit("big door"), F.lit("the big door"))
    part = table(spark, sf, "part").select("p_partkey").repartition(4 * spark.sparkContext.defaultParallelism)  # a file is few row groups, and rows are work
    return part.select("p_partkey", F.array_join(text.fresh_phrases(given, avoid, F.array(F.lit("blue truck")), F.lit(9)), "|").alias("phrases"))


@query("SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN 'jsons-segm' WHEN 1 THEN 'jsons-detect' WHEN 2 THEN 'jsons' WHEN 3 THEN 'mine' WHEN 4 THEN '/abs/jsons-sem' ELSE 'jsons' END AS shown, CASE p_partkey % 6 WHEN 0 THEN 'polygon' WHEN 1 THEN 'rectangle' WHEN 4 THEN 'polygon' END AS geometry FROM part")
def folder_names(spark, sf):
    k = F.col("p_partkey") % 6
    name = F.when(k == 0, " jsons-sem/").when(k == 1, "jsons-det").when(k == 2, "").when(k == 3, "mine").when(k == 4, "/abs/jsons-sem/").otherwise(F.lit(None))
    return table(spark, sf, "part").select("p_partkey", workspace.shown_folder(name).alias("shown"), workspace.geometry_of_folder(name).alias("geometry"))


@query("SELECT stem, obj_id, stem || '_obj' || lpad(CAST(obj_id AS VARCHAR), 4, '0') AS object_key, CAST(stem AS VARCHAR) AS back, stem || '_obj' || lpad(CAST(obj_id AS VARCHAR), 4, '0') || '_' || label || '_x.jpg' AS crop FROM box", V_BOX)
def object_keys(spark, sf):
    b, stem = views.boxes(spark, sf), F.col("stem").cast("string")
    key = text.object_key(stem, F.col("obj_id"))
    return b.select("stem", "obj_id", key.alias("object_key"), text.stem_of_object_key(key).alias("back"), text.crop_name(stem, F.col("obj_id"), F.concat("label", F.lit(" x"))).alias("crop"))


@query("SELECT page_id, CASE page_id % 3 WHEN 0 THEN CAST(8000 + page_id % 1000 AS INT) END AS port FROM pages")
def url_ports(spark, sf):
    k = F.col("page_id")
    url = F.when(k % 3 == 0, F.concat(F.lit("http://host:"), (8000 + k % 1000).cast("string"), F.lit("/v1"))).when(k % 3 == 1, "http://host/a:1")
    return table(spark, sf, "pages").select("page_id", text.port_of(url).alias("port"))


@query("SELECT doc_id, trim(text, ' ' || chr(10) || chr(9) || chr(13)) AS answer FROM documents")
def after_thinking(spark, sf):
    said = F.concat(F.lit("<think>a</think> b </think>\n "), F.col("text"), F.lit("\n"))
    return table(spark, sf, "documents").where("text is not null").select("doc_id", text.after_thinking(said).alias("answer"))


@query("SELECT p_partkey, p_name AS \"A\", CASE WHEN p_partkey % 2 = 0 THEN 'x.y' ELSE 'none' END AS \"B\" FROM part")
def video_options(spark, sf):
    second = F.when(F.col("p_partkey") % 2 == 0, "B. x.y ").otherwise("none")
    m = evaluation.video_options(F.array(F.concat(F.lit("A. "), F.col("p_name")), second))
    return table(spark, sf, "part").withColumn("m", m).select("p_partkey", F.col("m")["A"].alias("A"), F.col("m")["B"].alias("B"))


@query("SELECT stem, CASE count(*) WHEN 1 THEN max(label) || '.' ELSE array_to_string(list(label ORDER BY obj_id)[1 : count(*) - 1], ', ') || ' and ' || arg_max(label, obj_id) || '.' END AS caption FROM box GROUP BY stem", V_BOX)
def template_captions(spark, sf):
    g = views.boxes(spark, sf).groupBy("stem").agg(F.array_sort(F.collect_list(F.struct("obj_id", "label"))).alias("o"))
    return g.select("stem", text.template_caption(F.transform("o", lambda x: x.label)).alias("caption"))


@query("SELECT doc_id, n_chars AS n, 'see ' || text || ' end' AS plain FROM documents WHERE text IS NOT NULL AND NOT contains(text, '<')")
def markup_removed(spark, sf):
    said = F.concat(F.lit("see <ref>"), F.col("text"), F.lit("</ref><box>(1,2),\n(3,4)</box> end<box>open"))
    return table(spark, sf, "documents").where("text is not null and not contains(text, '<')").select("doc_id", F.col("n_chars").alias("n"), text.without_markup(said).alias("plain"))


@query("SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'a tree, a house' ELSE 'near a house' END AS caption FROM part")
def phrase_removed(spark, sf):
    phrase = F.concat(F.lit("the "), F.col("p_brand"))
    caption = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("a tree, "), phrase, F.lit(" , a house"))).otherwise(F.concat(phrase, F.lit(", near  a house ,")))
    return table(spark, sf, "part").select("p_partkey", text.without_phrase(caption, phrase).alias("caption"))


# ------------------------------------------------------------------ sizes, boxes, frames


def _resized(p: str) -> str:
    """A side after the training resize, from h, w, hb and wb."""
    return f"CAST(CASE WHEN hb * wb > 1003520 THEN floor({p} / sqrt(CAST(h * w AS DOUBLE) / 1003520) / 28) * 28 WHEN hb * wb < 3136 THEN ceil({p} * sqrt(3136 / CAST(h * w AS DOUBLE)) / 28) * 28 ELSE {p}b END AS BIGINT)"


@query("SELECT p_partkey, " + ", ".join(f"CAST(least(greatest(round_even({v} * (n{s} / CAST({s} AS DOUBLE)), 0), 0), n{s} - 1) AS BIGINT) AS {c}" for c, v, s in (("x1", "3.0", "w"), ("y1", "h / 2.0", "h"), ("x2", "w * 1.0", "w"), ("y2", "h * 2.0", "h")))
       + f" FROM (SELECT p_partkey, h, w, {_resized('h')} AS nh, {_resized('w')} AS nw FROM (SELECT *, CAST(round_even(h / 28, 0) * 28 AS BIGINT) AS hb, CAST(round_even(w / 28, 0) * 28 AS BIGINT) AS wb FROM siz WHERE greatest(h, w) <= 200 * least(h, w)))", V_SIZE)
def box_to_resized(spark, sf):
    box = F.array(F.lit(3.0), F.col("h") / 2, F.col("w") * F.lit(1.0), F.col("h") * F.lit(2.0))
    out = views.sizes(spark, sf).withColumn("b", geometry.box_to_resized(box, F.col("h"), F.col("w"))).where("b is not null")
    return out.select("p_partkey", *[F.col("b")[i].alias(c) for i, c in enumerate(("x1", "y1", "x2", "y2"))])


@query("SELECT p_partkey, least(greatest(CAST(round_even(h / 25.0, 0) AS BIGINT) * 2, 4), 512, CAST(h // 2 AS BIGINT) * 2) AS subtitle_frames, h // 28 * w // 4 AS tokens, round(greatest(least(602112.0, 19267584.0 / h * 2), 105369.0), 4) AS budget FROM siz", V_SIZE)
def frame_budgets(spark, sf):
    h, w = F.col("h"), F.col("w")
    budget = geometry.video_pixel_budget(h, 100352, 602112, 19267584.0)
    return views.sizes(spark, sf).select("p_partkey", geometry.subtitle_frame_count(h, F.lit(25.0)).alias("subtitle_frames"), geometry.visual_tokens(F.floor(h / 28), F.lit(1), w).alias("tokens"), F.round(budget, 4).alias("budget"))


@query("SELECT p_partkey, CAST(len(v) AS BIGINT) AS n, CAST(list_sum(v) AS BIGINT) AS total, v[-1] AS last FROM (SELECT p_partkey, list_distinct(list_transform(range(n), lambda i: CASE WHEN i = n - 1 THEN h - 1 ELSE CAST(trunc(i * ((h - 1) / CAST(greatest(n - 1, 1) AS DOUBLE))) AS BIGINT) END)) AS u, list_sort(u) AS v FROM (SELECT p_partkey, h, least(greatest(CAST(round_even(h / 25.0 / 2.0, 0) AS BIGINT), 4), 8) AS n FROM siz))", V_SIZE)
def packing_frames(spark, sf):
    v = geometry.packing_indices(F.col("h"), F.lit(25.0), 2.0, 4, 8)
    return views.sizes(spark, sf).withColumn("v", v).select("p_partkey", _l(F.size("v")).alias("n"), F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.element_at("v", -1).alias("last"))


@query("SELECT stem, obj_id, CAST(round_even(a / 999.0 * (width - 1), 0) AS BIGINT) AS x, CAST(round_even(b / 999.0 * (height - 1), 0) AS BIGINT) AS y, CAST(round_even(a / 999.0 * width, 0) AS BIGINT) AS px, CAST(round_even(b / 999.0 * height, 0) AS BIGINT) AS py, round(a / 1000.0 * width, 6) AS tx, round(b / 1000.0 * height, 6) AS ty FROM (SELECT *, x1 % 1000 AS a, y1 % 1000 AS b FROM box)", V_BOX)
def grid_pixels(spark, sf):
    p = F.array(F.col("x1") % 1000, F.col("y1") % 1000)
    w, h = F.col("width"), F.col("height")
    b = views.boxes(spark, sf).select("stem", "obj_id", geometry.grid_to_pixels(p, w, h).alias("g"), geometry.grid_point(p, w, h).alias("p"), geometry.thousandths_to_pixels(p, w, h).alias("t"))
    at = lambda c, i: F.col(c)[i]
    return b.select("stem", "obj_id", at("g", 0).alias("x"), at("g", 1).alias("y"), at("p", 0).alias("px"), at("p", 1).alias("py"), F.round(at("t", 0), 6).alias("tx"), F.round(at("t", 1), 6).alias("ty"))


@query("SELECT p_partkey, CASE WHEN w > h THEN 512 ELSE CAST(trunc(w * 512 / h) AS BIGINT) END AS width, CASE WHEN w > h THEN CAST(trunc(h * 512 / w) AS BIGINT) ELSE 512 END AS height, CAST(ceil((w + 1) / 8) AS BIGINT) AS rows, h % (w + 1) // 8 AS \"row\", h % (w + 1) % 8 AS \"column\" FROM siz", V_SIZE)
def contact_sheet(spark, sf):
    h, w = F.col("h"), F.col("w")
    s = views.sizes(spark, sf).select("p_partkey", geometry.thumbnail_size(w, h, 512).alias("t"), geometry.sheet_place(h % (w + 1), w + 1, 8).alias("s"))
    return s.select("p_partkey", "t.width", "t.height", "s.rows", "s.row", "s.column")


_EULER = """turned AS (SELECT p_partkey, i, x2 * cos(r) - y1 * sin(r) AS x3, x2 * sin(r) + y1 * cos(r) AS y3, z2 FROM (SELECT *, px * cos(q) + z1 * sin(q) AS x2, z1 * cos(q) - px * sin(q) AS z2 FROM
(SELECT *, py * cos(p) - pz * sin(p) AS y1, py * sin(p) + pz * cos(p) AS z1 FROM (SELECT p_partkey, h, i, radians(h / 4000.0 * 180) AS p, radians(w / 4000.0 * 180) AS q, radians((h + w) / 9000.0 * 180) AS r,
(1 + h / 2000.0) * CASE WHEN i < 4 THEN 1 ELSE -1 END AS px, CASE WHEN i % 4 < 2 THEN 1.0 ELSE -1.0 END AS py, h / 4000.0 * CASE WHEN i % 2 = 0 THEN 1 ELSE -1 END AS pz FROM siz, range(8) AS c(i)))))"""


@query("SELECT p_partkey, count(*) AS n, round(sum(500 * ((x3 + 0.5) / (z2 + 2.5)) + 320), 3) AS sum_x, round(sum((500 * ((y3 - 0.25) / (z2 + 2.5)) + 240) * (i + 1)), 3) AS sum_iy FROM turned t WHERE z2 + 2.5 > 0 GROUP BY p_partkey HAVING count(*) = 8", V_SIZE, _EULER)
def project_turned(spark, sf):
    """All three angles, all eight corners; boxes that reach behind the camera have fewer and drop out."""
    h, w = F.col("h"), F.col("w")
    box = F.array(F.lit(0.5), F.lit(-0.25), F.lit(2.5), 2 + h / 1000, F.lit(2.0), h / 2000, h / 4000, w / 4000, (h + w) / 9000)
    c = views.sizes(spark, sf).select("p_partkey", geometry.project_box(box, F.lit(500.0), F.lit(500.0), F.lit(320.0), F.lit(240.0)).alias("c")).where("size(c) = 8")
    total = lambda f: F.aggregate(F.transform("c", f), F.lit(0.0), lambda a, x: a + x)
    return c.select("p_partkey", _l(F.size("c")).alias("n"), F.round(total(lambda p: p[0]), 3).alias("sum_x"), F.round(total(lambda p, i: p[1] * (i + 1)), 3).alias("sum_iy"))


@query("SELECT p_partkey, CASE WHEN h % 2 = 0 THEN 12 END AS edges, CASE WHEN h % 2 = 0 THEN h % 100 END AS first_x FROM siz", V_SIZE)
def box_edges(spark, sf):
    h = F.col("h")
    corner = F.array(*[F.array(h % 100 + i + 0.5, h % 50 + i + 0.25) for i in range(8)])
    e = geometry.box_edges(F.when(h % 2 == 0, corner).otherwise(F.slice(corner, 1, 7)))
    return views.sizes(spark, sf).select("p_partkey", F.when(e.isNotNull(), F.size(e)).alias("edges"), _l(e[0]["from"][0]).alias("first_x"))


# ------------------------------------------------------------------ parsing


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, event_id % 3 = 2 AS parse_error, CASE WHEN event_id % 3 = 2 THEN 'k: ' || event_id END AS raw_text FROM events WHERE event_id % 3 <> 2 UNION ALL SELECT event_id, NULL, true, 'k: ' || event_id FROM events WHERE event_id % 3 = 2")
def fenced_or_raw(spark, sf):
    k = F.col("event_id")
    said = F.when(k % 3 == 0, F.concat(F.lit("so:\n```json\n"), F.col("props"), F.lit("\n``` yes"))).when(k % 3 == 1, F.concat(F.lit(" "), F.col("props"), F.lit("\n"))).otherwise(F.concat(F.lit("k: "), k.cast("string")))
    e = table(spark, sf, "events").select("event_id", parsing.fenced_json(said).alias("f"))
    return e.select("event_id", _l(F.get_json_object("f.json", "$.k")).alias("k"), "f.parse_error", "f.raw_text")


@query("SELECT stem, obj_id, label, CAST(x1 AS DOUBLE) AS x, CAST(y1 AS DOUBLE) AS y, 'point_2' AS second, CAST(x2 AS DOUBLE) AS x3d FROM box", V_BOX)
def points_and_boxes(spark, sf):
    num = lambda c: F.col(c).cast("string")
    said = F.concat(F.lit('```json\n[{"point_2d": ['), num("x1"), F.lit(", "), num("y1"), F.lit('], "label": "'), F.col("label"), F.lit('"}, {"point_2d": [1, 2]}, {"point_2d": [1]}]\n```'))
    deep = F.when(F.col("obj_id") % 2 == 0, F.concat(F.lit('it is ```json {"label": "q", "bbox_3d": ['), num("x2"), F.lit(", 1]}```"))).otherwise(F.concat(F.lit('so [{"label": "q", "bbox_3d": ['), num("x2"), F.lit("]}] ok")))
    b = views.boxes(spark, sf).select("stem", "obj_id", parsing.points_2d(said).alias("p"), parsing.boxes_3d(deep).alias("d"))
    return b.select("stem", "obj_id", F.col("p")[0]["label"].alias("label"), F.col("p")[0]["point"][0].alias("x"), F.col("p")[0]["point"][1].alias("y"), F.col("p")[1]["label"].alias("second"), F.col("d")[0]["bbox_3d"][0].alias("x3d"))


@query("SELECT p_partkey, 'print(' || p_partkey || ')' || chr(10) AS last_python, CASE WHEN p_partkey % 2 = 0 THEN 'a' || chr(10) ELSE p_name END AS first, 'click' AS tool, CAST(p_partkey AS VARCHAR) AS argument FROM part")
def code_blocks(spark, sf):
    k = F.col("p_partkey").cast("string")
    said = F.concat(F.lit("x ```python\na\n``` y ```python\nprint("), k, F.lit(")\n``` z ```html\n<p>\n```"))
    tagged = F.when(F.col("p_partkey") % 2 == 0, said).otherwise(F.concat(F.lit("see <code>"), F.col("p_name"), F.lit("</code> and <code>b</code>")))
    call = parsing.tool_call(F.concat(F.lit('ok <tool_call>\n{"name": "click", "arguments": {"at": "'), k, F.lit('"}}\n</tool_call>')))
    return table(spark, sf, "part").select("p_partkey", parsing.last_code_block(said).alias("last_python"), parsing.first_code(tagged).alias("first"), call["name"].alias("tool"), F.get_json_object(call["arguments"], "$.at").alias("argument"))


@query("SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name || '|' || p_brand WHEN 1 THEN p_name WHEN 2 THEN '' ELSE '[' || p_name END AS items FROM part")
def string_lists(spark, sf):
    k = F.col("p_partkey") % 4
    given = F.when(k == 0, F.concat(F.lit("['"), F.col("p_name"), F.lit("', '"), F.col("p_brand"), F.lit("']"))).when(k == 1, F.col("p_name")).when(k == 3, F.concat(F.lit("["), F.col("p_name")))
    return table(spark, sf, "part").select("p_partkey", F.array_join(parsing.to_list(given), "|").alias("items"))


# ------------------------------------------------------------------ arrays and groups


@query("SELECT stem, array_to_string(list_transform(list_sort(list_distinct(list(obj_id))), lambda x: CAST(x AS VARCHAR)), ',') AS ids FROM box GROUP BY stem", V_BOX)
def ordered_unions(spark, sf):
    g = views.boxes(spark, sf).groupBy("stem").agg(F.array_sort(F.collect_list("obj_id")).alias("ids"))
    half = F.slice("ids", 1, 2)
    return g.select("stem", F.array_join(sequences.ordered_union(half, F.col("ids")).cast("array<string>"), ",").alias("ids"))


@query(f"SELECT p_brand, array_to_string(list_sort(list_distinct(list_filter(flatten(list(string_split({SYNONYM.format(_KEY.format('p_name'))}, ' '))), lambda t: t <> '' AND NOT list_contains(['" + "','".join(text.CLASS_HEADS) + "'], t)))), ' ') AS axes FROM part GROUP BY p_brand")
def axis_unions(spark, sf):
    g = table(spark, sf, "part").groupBy("p_brand").agg(F.collect_set("p_name").alias("names"))
    return g.select("p_brand", F.array_join(text.axis_union(F.col("names")), " ").alias("axes"))


@query("SELECT stem, CAST(count(*) AS BIGINT) AS n, array_to_string(list_transform(range(count(*)), lambda i: CASE WHEN i < least(count(*), 2) THEN 'z' || i ELSE '' END), '|') AS zh FROM box GROUP BY stem", V_BOX)
def padded_translations(spark, sf):
    g = views.boxes(spark, sf).groupBy("stem").agg(F.collect_list("label").alias("phrases"))
    given = F.array(F.lit("z0"), F.lit("z1"))
    zh = sequences.padded_translations(given, F.col("phrases"))
    return g.select("stem", _l(F.size(zh)).alias("n"), F.array_join(zh, "|").alias("zh"))


@query("SELECT source, chunk, count(*) AS n FROM (SELECT source, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // CASE WHEN avg(length(text)) OVER (PARTITION BY source) > 1500 THEN 12 ELSE 24 END AS chunk FROM documents) GROUP BY ALL")
def call_chunks(spark, sf):
    d = table(spark, sf, "documents").select("source", "doc_id", F.length("text").alias("n"))
    mean = d.groupBy("source").agg(F.avg("n").alias("mean"))
    rows = records.numbered(d, "pos", ["doc_id"], ["source"], start=0).join(mean, "source")
    return rows.select("source", sequences.chunk_of(F.col("pos"), F.col("mean"), limit=1500).alias("chunk")).groupBy("source", "chunk").agg(F.count("*").alias("n"))


@query("SELECT stem, obj_id, n, CAST(least(m, 6) AS BIGINT) AS padded, CAST(greatest(least(m, 6) - n, 0) AS BIGINT) AS filled FROM (SELECT stem, obj_id, n, max(n) OVER (PARTITION BY stem) AS m FROM (SELECT stem, obj_id, obj_id % 9 + 1 AS n FROM box))", V_BOX)
def padded_batches(spark, sf):
    n = (F.col("obj_id") % 9 + 1).cast("int")
    b = views.boxes(spark, sf).select("stem", "obj_id", _l(n).alias("n"), F.array_repeat(F.lit(7).cast("long"), n).alias("input_ids"), F.array_repeat(F.lit(8).cast("long"), n).alias("labels"))
    p = packing.pad_batch(b, "stem", 0, 6)
    return p.select("stem", "obj_id", "n", _l(F.size("input_ids")).alias("padded"), _l(F.size(F.filter("attention_mask", lambda x: ~x))).alias("filled"))


@query("SELECT stem, CAST(sum(obj_id + 1) AS BIGINT) AS n, '0,' || string_agg(c, ',' ORDER BY obj_id) AS cu FROM (SELECT stem, obj_id, CAST(CAST(sum(obj_id + 1) OVER (PARTITION BY stem ORDER BY obj_id) AS BIGINT) AS VARCHAR) AS c FROM box) GROUP BY stem", V_BOX)
def flattened_batches(spark, sf):
    n = (F.col("obj_id") + 1).cast("int")
    b = views.boxes(spark, sf).select("stem", "obj_id", F.array_repeat(F.lit(7).cast("long"), n).alias("input_ids"), F.array_repeat(F.lit(8).cast("long"), n).alias("labels"))
    f = packing.flatten_members(b, ["stem"], "obj_id")
    return f.select("stem", _l(F.size("input_ids")).alias("n"), F.array_join(F.col("cu_seqlens").cast("array<string>"), ",").alias("cu"))


@query("SELECT o_orderpriority AS dataset, count(*) AS n_jobs FROM orders GROUP BY ALL")
def job_counts(spark, sf):
    return detection.job_counts(table(spark, sf, "orders").select(F.col("o_orderpriority").alias("dataset")))


@query("SELECT o_orderkey, o_custkey AS length FROM orders")
def known_lengths(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("num_tokens"))
    return workspace.lengths_or_ones(o, "o_orderkey").select("o_orderkey", "length")


@query("SELECT stem, max(label) || ', with ' || string_agg('item ' || obj_id, ', ' ORDER BY obj_id) || '.' AS caption, CAST(count(*) AS BIGINT) AS placed FROM box GROUP BY stem", V_BOX)
def completed_captions(spark, sf):
    """G-12: what a caption lacks is put at its end, so that every phrase has a span."""
    g = views.boxes(spark, sf).groupBy("stem").agg(F.concat(F.max("label"), F.lit(" .")).alias("caption"), F.array_sort(F.collect_list("obj_id")).alias("ids"))
    rows = g.select("stem", "caption", F.transform("ids", lambda i: F.concat(F.lit("item "), i.cast("string"))).alias("phrases"))
    done = grounding.with_spans(rows, complete=True)
    return done.select("stem", "caption", _l(F.size(F.filter("spans", lambda s: s.isNotNull()))).alias("placed"))


@query("SELECT stem, obj_id, 'big thing|' || lower(label) || CASE WHEN obj_id % 2 = 0 THEN '|chosen ' || obj_id ELSE '' END AS phrases, CASE WHEN obj_id % 2 = 0 THEN 'g||' ELSE 'g|' END AS zh FROM box", V_BOX)
def synced_descriptions(spark, sf):
    """G-14: phrases that captions chose go back to their objects, and translations are filled up."""
    b = views.boxes(spark, sf)
    d = b.select("stem", "obj_id", F.array(F.lit("big thing"), F.lower("label")).alias("phrases"), F.array(F.lit("g")).alias("zh"))
    even = b.where("obj_id % 2 = 0").groupBy("stem").agg(F.array_sort(F.collect_list("obj_id")).alias("obj_ids"))
    captions = even.withColumn("phrases", F.transform("obj_ids", lambda i: F.concat(F.lit("chosen "), i.cast("string"))))
    return grounding.sync_descriptions(d, captions).select("stem", "obj_id", F.array_join("phrases", "|").alias("phrases"), F.array_join("zh", "|").alias("zh"))


@query("SELECT stem, obj_id, CASE WHEN obj_id % 3 = 1 THEN 'gone' ELSE 'red ' || lower(label) END AS phrase FROM box WHERE obj_id % 3 <> 1 OR obj_id % 2 = 0", V_BOX)
def locked_phrases(spark, sf):
    """G-13: a phrase that its object no longer has is kept only if it keeps the label."""
    b = views.boxes(spark, sf)
    d = b.select("stem", "obj_id", "label", F.array(F.concat(F.lit("Red "), F.col("label"))).alias("phrases"))
    chosen = F.struct("obj_id", F.when(F.col("obj_id") % 3 == 1, "gone").otherwise(F.concat(F.lit("red "), F.lower("label"))).alias("phrase"), (F.col("obj_id") % 2 == 0).alias("keep_source_label"), F.array().cast("array<string>").alias("features"))
    captions = b.groupBy("stem").agg(F.collect_list(chosen).alias("phrases")).withColumn("sentence_id", F.lit(0))
    return grounding.locked_phrases(captions, d).select("stem", "obj_id", "phrase")


@query("SELECT CAST(count(*) AS BIGINT) AS n, CAST(count(DISTINCT (stem, obj_id)) AS BIGINT) AS objects FROM box", V_BOX)
def caption_groups_reach(spark, sf):
    """Q-03 to Q-06: how many objects are in some group of their image; no group holds one twice or more than ten."""
    groups = grounding.caption_groups(views.boxes(spark, sf)).where("size(obj_ids) <= 10 and size(array_distinct(obj_ids)) = size(obj_ids)")
    own = groups.select("stem", F.explode("obj_ids").alias("obj_id")).distinct()
    return own.join(views.boxes(spark, sf), ["stem", "obj_id"]).agg(F.count("*").alias("n"), F.count_distinct("stem", "obj_id").alias("objects"))


@query("""SELECT round(avg(a) FILTER (area = 'all'), 3) AS "mAP", round(coalesce(avg(a) FILTER (area = 'small'), 0), 3) AS "mAP_s", round(coalesce(avg(a) FILTER (area = 'medium'), 0), 3) AS "mAP_m" FROM
(SELECT label, area, CASE WHEN sum(f) = 0 THEN 0 ELSE (floor(100 * sum(f) / count(*) + 1e-9) + 1) / 101 END AS a FROM (SELECT label, CAST(min(partkey) % 11 <> 0 AS INT) AS f, unnest(['all', CASE WHEN (x2 - x1) * (y2 - y1) <= 1024 THEN 'small' ELSE 'medium' END]) AS area FROM box GROUP BY stem, label, x1, y1, x2, y2) GROUP BY label, area)""", V_BOX)
def det_map_recall(spark, sf):
    """A-19 where detections are truths and some are missing: precision is 1 up to the recall of each class."""
    corners = ("x1", "y1", "x2", "y2")
    b = views.boxes(spark, sf).groupBy("stem", "label", *corners).agg(F.min("obj_id").alias("ord"), F.min("partkey").alias("partkey"))
    b = b.select(F.col("stem").alias("image_id"), F.col("label").alias("category_id"), geometry.xywh(*[F.col(c).cast("double") for c in corners]).alias("bbox"), "ord", "partkey")
    truth = b.withColumn("area", detection.box_area(F.col("bbox"))).withColumn("iscrowd", F.lit(0))
    return detection.average_precision(truth, b.where("partkey % 11 <> 0").withColumn("score", F.lit(1.0))).select("mAP", "mAP_s", "mAP_m")


@query("SELECT CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_json, count(*) AS n_shapes, count(*) FILTER (l_linenumber = 1) AS n_rectangle, count(*) FILTER (l_linenumber > 1) AS n_polygon, 'mixed' AS geometry FROM lineitem WHERE l_orderkey IN (SELECT DISTINCT l_orderkey FROM lineitem ORDER BY l_orderkey LIMIT 80)")
def geometry_of_first(spark, sf):
    """A-08: the feature is to look at the first 80 files by name only."""
    s = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("file"), F.when(F.col("l_linenumber") == 1, "Rectangle ").otherwise("polygon").alias("shape_type"))
    return validation.geometry_of_first(s, "file").select("n_json", "n_shapes", "n_rectangle", "n_polygon", "geometry")


@query("SELECT user_id, CAST(3 * count(*) AS BIGINT) AS labelled, CAST(sum(event_id + 200000) AS BIGINT) AS total FROM events GROUP BY user_id")
def label_mask_turns(spark, sf):
    """G-15 with an answer an event: each one's id, its close and the id after that are labelled."""
    lit = lambda *v: F.array(*[F.lit(x).cast("long") for x in v])
    turn = lambda e: F.concat(lit(sequences.OPEN_ID, 198), F.array(e + 200_000), lit(sequences.CLOSE_ID, 198, 5))
    g = table(spark, sf, "events").groupBy("user_id").agg(F.flatten(F.collect_list(turn(F.col("event_id")))).alias("ids"))
    own = F.filter(sequences.label_mask(F.col("ids")), lambda x: x != sequences.IGNORED)
    said = F.filter(own, lambda x: ~x.isin(sequences.CLOSE_ID, 198))
    return g.select("user_id", _l(F.size(own)).alias("labelled"), F.aggregate(said, F.lit(0).cast("long"), lambda a, x: a + x).alias("total"))


@query("SELECT p_partkey, p_partkey % 2 = 0 AS same FROM part")
def answers_equal_mixed(spark, sf):
    """Whole numbers with decimals, neighbours, fractions with their decimals, and texts."""
    k, size = F.col("p_partkey") % 4, F.col("p_size").cast("string")
    other = F.when(k == 0, F.concat(size, F.lit(".0"))).when(k == 1, (F.col("p_size") + 1).cast("string")).when(k == 2, (F.col("p_size") / 2).cast("string")).otherwise(F.concat("p_name", F.lit("x")))
    given = F.when(k == 2, F.concat(size, F.lit("/2"))).when(k == 3, F.col("p_name")).otherwise(size)
    return table(spark, sf, "part").select("p_partkey", answers.answers_equal(given, other).alias("same"))

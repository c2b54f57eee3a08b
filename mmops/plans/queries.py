"""Queries that apply the operators to the supplied tables, each with the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import answers, geometry, parsing, sequences, text
from ..operators import detection, evaluation, grounding, media, packing, records, validation
from ..sources import readers, sinks
from . import views
from .views import V_BOX, V_CONV, V_DET, V_LINE, V_MCQ, V_PHRASE, V_SIZE, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, *ctes: str, recursive: bool = False):
    """Registers a query by its function's name; ``sql`` may use the views named in ``ctes``."""

    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            recursive = "RECURSIVE " if any("taking" in c for c in ctes) else ""
            ORACLE[f.__name__] = (f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} " if ctes else "") + sql
        return f

    return register


def _l(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("long")


TOKENS = "list_filter(regexp_extract_all(lower({}), '[a-z0-9]+'), lambda t: NOT list_contains(['" + "','".join(text.STOP_WORDS) + "'], t))"
_PAIRS_SQL = "{}"
for _name in ("helmet", "shirt", "phone"):
    _PAIRS_SQL = f"regexp_replace({_PAIRS_SQL}, '\\b(?:" + "|".join(f"{a} {b}" for a, b, n in text.WORD_PAIRS if n == _name) + f")\\b', '{_name}', 'g')"
SYNONYM = f"""array_to_string(list_transform(string_split({_PAIRS_SQL}, ' '),
 lambda t: CASE t """ + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in text.TOKEN_SYNONYMS.items()) + " ELSE t END), ' ')"


# ------------------------------------------------------------------ text


@query(f"SELECT doc_id, array_to_string({TOKENS.format('text')}, ' ') AS content_key FROM documents")
def phrase_keys(spark, sf):
    return table(spark, sf, "documents").select("doc_id", text.content_key(F.col("text")).alias("content_key"))


_P = "'A ' || p_name || ' with Hard-Hats and cell phone, tee shirts, safety hat ' || p_type"


@query(f"SELECT p_partkey, {SYNONYM.format('k')} AS synonym_key FROM (SELECT p_partkey, array_to_string({TOKENS.format(_P)}, ' ') AS k FROM part)")
def synonym_keys(spark, sf):
    p = table(spark, sf, "part")
    phrase = F.concat(F.lit("A "), F.col("p_name"), F.lit(" with Hard-Hats and cell phone, tee shirts, safety hat "), F.col("p_type"))
    return p.select("p_partkey", text.synonym_key(phrase).alias("synonym_key"))


@query(f"SELECT p_partkey, array_to_string(list_sort(list_distinct(list_filter(string_split({SYNONYM.format('k')}, ' '), lambda t: t <> '' AND NOT list_contains(['" + "','".join(text.CLASS_HEADS) + f"'], t)))), ' ') AS axis FROM (SELECT p_partkey, array_to_string({TOKENS.format(_P + chr(39) + ' car van' + chr(39) if False else _P)}, ' ') AS k FROM part)")
def axis_tokens(spark, sf):
    p = table(spark, sf, "part")
    phrase = F.concat(F.lit("A "), F.col("p_name"), F.lit(" with Hard-Hats and cell phone, tee shirts, safety hat "), F.col("p_type"))
    return p.select("p_partkey", F.array_join(text.axis_tokens(phrase), " ").alias("axis"))


_READ = "trim(regexp_replace(lower(regexp_replace(regexp_replace(regexp_replace({0}, '[_\\-]+', ' ', 'g'), '([a-z])([A-Z])', '\\1 \\2', 'g'), '([A-Za-z])([0-9])', '\\1 \\2', 'g')), '\\s+', ' ', 'g'))"
_LABEL = "replace(p_type, ' ', '_') || 'BigCar' || p_size"


@query(f"SELECT p_partkey, {_READ.format('(' + _LABEL + ')')} AS reading, array_to_string([{_LABEL}, {_READ.format('(' + _LABEL + ')')}, {_READ.format('(' + _LABEL + ')')} || ' in the scene'], '|') AS fallback FROM part")
def label_reading(spark, sf):
    label = F.concat(F.replace(F.col("p_type"), F.lit(" "), F.lit("_")), F.lit("BigCar"), F.col("p_size").cast("string"))
    return table(spark, sf, "part").select("p_partkey", text.label_reading(label).alias("reading"), F.array_join(text.fallback_phrases(label), "|").alias("fallback"))


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_-]', '_', 'g') AS safe, trim(regexp_replace(lower(url), '[^a-z0-9_]+', '_', 'g'), '_') AS slug, regexp_extract(url, '[^/]*$') AS last_part, lower(regexp_extract(url, '[^/]+(\\.[^./]+)$', 1)) AS suffix FROM pages")
def safe_names(spark, sf):
    u = F.col("url")
    return table(spark, sf, "pages").select("page_id", text.safe_label(u).alias("safe"), text.slug(u).alias("slug"), F.regexp_extract(u, "([^/]*)$", 1).alias("last_part"), text.suffix(u).alias("suffix"))


@query("SELECT doc_id, regexp_replace(text || chr(1) || chr(11) || 'x', '[\\x00-\\x08\\x0B-\\x0C\\x0E-\\x1F]', '', 'g') AS cleaned FROM documents")
def excel_clean(spark, sf):
    t = F.concat(F.col("text"), F.char(F.lit(1)), F.char(F.lit(11)), F.lit("x"))
    return sinks.clean_text_columns(table(spark, sf, "documents").select("doc_id", t.alias("cleaned")))


@query("SELECT doc_id, line, place, instr(caption, p) - 1 AS span_start, instr(caption, p) - 1 + length(p) AS span_end FROM (SELECT doc_id, line, caption, unnest(range(len(runs))) AS place, unnest(runs) AS p FROM lin) WHERE instr(caption, p) > 0", V_LINE)
def span_first(spark, sf):
    rows = views.lines(spark, sf)
    places = F.transform("runs", lambda p, i: F.struct(_l(i).alias("place"), text.first_span(F.col("caption"), p).alias("span")))
    out = rows.select("doc_id", "line", F.inline(F.filter(places, lambda x: x.span.isNotNull())))
    return out.select("doc_id", "line", "place", _l(F.col("span")[0]).alias("span_start"), _l(F.col("span")[1]).alias("span_end"))


@query("SELECT lang, phrase_key, min(place) AS place, arg_min(phrase, place) AS phrase FROM (SELECT *, array_to_string(" + TOKENS.format("phrase") + ", ' ') AS phrase_key FROM phr) WHERE phrase_key <> '' GROUP BY ALL", V_PHRASE)
def phrase_dedup_keep_first(spark, sf):
    return grounding.dedup_phrases(views.phrases(spark, sf), ["lang"], "place").select("lang", "phrase_key", "place", "phrase")


@query("""SELECT lang, source, pool, own, pool - own AS remaining FROM (SELECT lang, count(DISTINCT k) AS pool FROM k WHERE k <> '' GROUP BY lang) JOIN (SELECT lang, source, count(DISTINCT k) AS own FROM k WHERE k <> '' GROUP BY lang, source) USING (lang)""",
       V_PHRASE, "k AS (SELECT lang, source, array_to_string(" + TOKENS.format("phrase") + ", ' ') AS k FROM phr)")
def class_pool_remaining(spark, sf):
    return grounding.remaining_pool(views.phrases(spark, sf), "source", ["lang"], "place").select("lang", "source", _l("pool").alias("pool"), _l("own").alias("own"), _l("remaining").alias("remaining"))


@query("""SELECT source, CAST(count(*) FILTER (w) AS BIGINT) AS n_weak, count(*) AS n, count(*) FILTER (w) * 10 >= count(*) * 4 AS rebuild FROM
(SELECT source, lower(trim(p)) IN ('', 'object', 'in the scene', lower(label), lower(label) || ' object', lower(label) || ' in the scene') AS w FROM (SELECT source, label, CASE WHEN doc_id % 2 = 0 THEN label || ' object' WHEN doc_id % 7 = 0 THEN ' ' ELSE phrase END AS p FROM phr)) GROUP BY source""", V_PHRASE)
def weak_ratio(spark, sf):
    p = views.phrases(spark, sf).withColumn("phrase", F.when(F.col("doc_id") % 2 == 0, F.concat("label", F.lit(" object"))).when(F.col("doc_id") % 7 == 0, " ").otherwise(F.col("phrase")))
    return grounding.weak_share(p, ["source"])


@query("SELECT p_partkey, head || ' ' || c AS phrase FROM (SELECT p_partkey, lower(string_split(p_name, ' ')[1]) AS head, 'car' AS c FROM part)")
def vehicle_phrases(spark, sf):
    first = F.split("p_name", " ")[0]
    return table(spark, sf, "part").select("p_partkey", text.vehicle_phrase(F.concat(first, F.lit(" SUV sedan car")), F.lit("car")).alias("phrase"))


# ------------------------------------------------------------------ answers


@query("""SELECT "index", letter FROM inferred""", V_MCQ)
def mcq_extract(spark, sf):
    m = views.choices(spark, sf)
    return m.select("index", answers.infer(F.col("prediction"), evaluation.options_of(m)).alias("letter"))


def _scored(spark, sf):
    m = views.choices(spark, sf)
    letter = answers.infer(F.col("prediction"), evaluation.options_of(m))
    return m.withColumn("letter", letter).withColumn("hit", F.coalesce(letter == F.col("gt"), F.lit(False)).cast("int"))


_HIT = "CAST(coalesce(letter = gt, false) AS INT)"


@query(f"""SELECT g AS "grouping", v AS "value", count(*) AS n, CAST(sum(h) AS BIGINT) AS correct, round(sum(h) / count(*), 6) AS accuracy FROM (SELECT 'overall' AS g, '' AS v, {_HIT} AS h FROM inferred UNION ALL SELECT 'category', category, {_HIT} FROM inferred UNION ALL SELECT 'split', coalesce(split, 'unknown'), {_HIT} FROM inferred) GROUP BY ALL""", V_MCQ)
def mcq_accuracy_grouping_sets(spark, sf):
    return evaluation.accuracy_grouping_sets(_scored(spark, sf), ["category", "split"]).withColumn("accuracy", F.round("accuracy", 6))


@query(f"""SELECT "Subject", count(*) AS tot, CAST(sum(p) AS BIGINT) AS prefetch, CAST(sum(h) AS BIGINT) AS hit, round(sum(p) / count(*) * 100, 6) AS prefetch_rate, round(sum(h) / count(*) * 100, 6) AS acc,
 CASE WHEN "Subject" = 'Overall' THEN CAST(count(*) FILTER (m = 'rule' AND f) AS BIGINT) ELSE 0 END AS rule_success, CASE WHEN "Subject" = 'Overall' THEN CAST(count(*) FILTER (m = 'rule') AS BIGINT) ELSE 0 END AS rule_all
 FROM (SELECT unnest([category, 'Overall']) AS "Subject", CAST(letter IS NOT NULL AS INT) AS p, {_HIT} AS h, CASE WHEN letter IS NULL THEN 'judge' ELSE 'rule' END AS m, coalesce(letter <> 'Z', false) AS f FROM inferred) GROUP BY "Subject" """, V_MCQ)
def mcq_subject_table(spark, sf):
    s = _scored(spark, sf).withColumns({"log": F.when(F.col("letter").isNotNull(), "Prefetch succeed. ").otherwise("asked"), "extract_model": F.when(F.col("letter").isNull(), "judge").otherwise("rule"), "extract_flag": F.coalesce(F.col("letter") != "Z", F.lit(False))})
    out = evaluation.subject_table(s, ["rule"])
    return out.select("Subject", "tot", "prefetch", "hit", F.round("prefetch_rate", 6).alias("prefetch_rate"), F.round("acc", 6).alias("acc"), _l("rule_success").alias("rule_success"), _l("rule_all").alias("rule_all"))


@query("""SELECT p_partkey AS "index", CASE WHEN p_partkey % 3 = 0 THEN answer ELSE p_name END AS "A", CASE WHEN p_partkey % 3 = 0 THEN 'Other Answers' ELSE p_type END AS "B", CASE WHEN p_partkey % 2 = 1 THEN answer ELSE 'A' END AS gt FROM (SELECT *, CASE WHEN p_partkey % 2 = 1 THEN 'C' ELSE p_size || '.5' END AS answer FROM part)""")
def open_to_choice(spark, sf):
    k = F.col("p_partkey")
    p = table(spark, sf, "part").select(k.alias("index"), F.when(k % 3 != 0, F.col("p_name")).alias("A"), F.when(k % 3 != 0, F.col("p_type")).alias("B"), F.when(k % 2 == 1, "C").otherwise(F.concat(F.col("p_size").cast("string"), F.lit(".5"))).alias("answer"))
    return evaluation.open_to_choice(p).select("index", "A", "B", "gt")


@query("""SELECT "index", 'Question: ' || question || chr(10) || 'A. ' || "A" || chr(10) || 'B. ' || "B" || chr(10) || 'C. ' || "C" || CASE WHEN "D" IS NULL THEN '' ELSE chr(10) || 'D. ' || "D" END || chr(10) || 'Choose one option and answer with its letter.' AS prompt FROM mcq""", V_MCQ)
def option_prompt(spark, sf):
    m = views.choices(spark, sf)
    return m.select("index", evaluation.choice_prompt(F.col("question"), evaluation.options_of(m)).alias("prompt"))


@query("SELECT p_partkey, true AS same, p_partkey % 2 = 0 AS near, false AS other, round(CAST(p_size AS DOUBLE), 6) = 7.5 AS fraction FROM part")
def answer_equal_numeric(spark, sf):
    n = F.col("p_retailprice")
    s = n.cast("string")
    near = F.when(F.col("p_partkey") % 2 == 0, n + 1e-7).otherwise(n + 1).cast("string")
    return table(spark, sf, "part").select("p_partkey", answers.answers_equal(F.concat(F.lit(" "), s), F.concat(s, F.lit(" "))).alias("same"), answers.answers_equal(s, near).alias("near"), answers.answers_equal(s, F.lit("word")).alias("other"), answers.answers_equal(F.concat(F.col("p_size").cast("string")), F.lit("15/2")).alias("fraction"))


@query("SELECT quality AS gt, count(*) AS n FROM documents d JOIN (SELECT * FROM labels UNION ALL SELECT doc_id + 1000000000, quality, toxic FROM labels) USING (doc_id) GROUP BY quality")
def truth_semi_join(spark, sf):
    labels = table(spark, sf, "labels").select("doc_id", F.col("quality").alias("gt"))
    labels = labels.unionByName(labels.withColumn("doc_id", F.col("doc_id") + 1_000_000_000))  # truths of items that nothing was predicted for
    return evaluation.with_truth(table(spark, sf, "documents").select("doc_id"), labels, "doc_id").groupBy("gt").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n_unknown FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def unknown_predictions(spark, sf):
    return evaluation.unknown_predictions(table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels"), "doc_id").agg(F.count("*").alias("n_unknown"))


@query("""SELECT lang, count(*) AS n, CAST(sum(h) AS BIGINT) AS correct, round(avg(h), 6) AS accuracy FROM (SELECT lang, CAST((d.n_chars > 500) = (quality = 1) AS INT) AS h FROM documents d JOIN labels USING (doc_id)) GROUP BY lang""")
def label_accuracy(spark, sf):
    d = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id").withColumn("hit", ((F.col("n_chars") > 500) == (F.col("quality") == 1)).cast("int"))
    return evaluation.accuracy(d, ["lang"]).withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT doc_id, CAST(item_id AS BIGINT) AS item_id FROM documents d JOIN benchmark b ON contains(d.text, b.text)")
def substring_leakage(spark, sf):
    parts = table(spark, sf, "benchmark").select(_l("item_id").alias("item_id"), F.col("text").alias("part"))
    return evaluation.substring_pairs(table(spark, sf, "documents").select("doc_id", "text"), parts, keep=["doc_id"]).select("doc_id", "item_id")


@query("SELECT doc_id, count(*) AS n_parts, CAST(sum(length(w)) AS BIGINT) AS n_chars, min(w) AS first_part FROM documents JOIN (SELECT DISTINCT unnest(string_split(text, ' ') || string_split(left(text, 40), '') || [text]) AS w FROM benchmark) ON contains(text, w) GROUP BY doc_id")
def substring_words(spark, sf):
    b = table(spark, sf, "benchmark")
    words = b.select(F.explode(F.concat(F.split("text", " "), F.split(F.left("text", F.lit(40)), ""), F.array("text"))).alias("w")).distinct()
    found = evaluation.substring_pairs(table(spark, sf, "documents").select("doc_id", "text"), words, part="w", keep=["doc_id"])
    return found.groupBy("doc_id").agg(F.count("*").alias("n_parts"), F.sum(F.length("w")).cast("long").alias("n_chars"), F.min("w").alias("first_part"))


@query("SELECT p_brand AS problem, count(*) FILTER (c = 1) AS passed, count(*) FILTER (c = 0) AS failed, count(*) FILTER (c = -1) AS timeout, count(*) FILTER (c = -2) AS error, round(count(*) FILTER (c = 1) / count(*), 6) AS accuracy, bool_and(c = 1) AS all_passed FROM (SELECT p_brand, p_partkey % 4 - 2 AS c FROM part) GROUP BY p_brand")
def test_tally(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_brand").alias("problem"), (F.col("p_partkey") % 4 - 2).alias("code"))
    return evaluation.test_tally(p).withColumn("accuracy", F.round("accuracy", 6))


@query("SELECT name, round(m, 6) AS m FROM (SELECT p_brand AS name, avg(p_size) AS m FROM part GROUP BY p_brand) UNION ALL SELECT 'Average', round(avg(m), 6) FROM (SELECT avg(p_size) AS m FROM part GROUP BY p_brand)")
def macro_average(spark, sf):
    by = table(spark, sf, "part").groupBy(F.col("p_brand").alias("name")).agg(F.avg("p_size").alias("m"))
    return evaluation.macro_average(by, "name", ["m"]).withColumn("m", F.round("m", 6))


# ------------------------------------------------------------------ conversations

_CLEAN = "CASE WHEN \"from\" = 'human' AND h > 0 THEN trim(regexp_replace(value, '\\n*<image>\\n*', chr(10), 'g'), ' ' || chr(9) || chr(10) || chr(13)) ELSE value END"


def _records(spark, sf):
    c = views.conversations(spark, sf)
    return records.turns_to_records(c, "conv_id", "turn").withColumn("n_media", F.col("conv_id") % 3)


@query(f"""SELECT conv_id, count(*) AS n_turns, md5(string_agg("from" || ':' || {_CLEAN}, '|' ORDER BY turn)) AS digest FROM conv GROUP BY conv_id""", V_CONV)
def conv_first_image_only(spark, sf):
    t = sequences.without_later_images(F.col("conversations"))
    return _records(spark, sf).select("conv_id", _l(F.size(t)).alias("n_turns"), F.md5(F.array_join(F.transform(t, lambda x: F.concat(x["from"], F.lit(":"), x["value"])), "|").cast("binary")).alias("digest"))


@query("""SELECT conv_id % 7 AS folder, CAST(conv_id // 14 AS BIGINT) AS image, count(DISTINCT conv_id) AS n_items, count(*) AS n_turns FROM conv GROUP BY ALL""", V_CONV)
def conv_to_record(spark, sf):
    items = _records(spark, sf).withColumn("folder", F.col("conv_id") % 7).withColumn("image", _l(F.floor(F.col("conv_id") / 14)))
    merged = records.merge_items(items, "folder", "image", "conv_id", "conversations")
    n = items.groupBy("folder", "image").agg(F.count("*").alias("n_items"))
    return merged.join(n, ["folder", "image"]).select("folder", "image", "n_items", _l(F.size("conversations")).alias("n_turns"))


@query("""SELECT conv_id, turn, "from" AS role, CASE WHEN contains(value, '<image>') THEN 2 ELSE 1 END AS n_parts FROM conv""", V_CONV)
def conv_messages(spark, sf):
    r = _records(spark, sf)
    marks = F.size(F.filter("conversations", lambda t: F.contains(t["value"], F.lit("<image>"))))
    msg = sequences.media_messages(F.col("conversations"), F.array_repeat(F.lit("a.jpg"), marks), F.array().cast("array<string>"))
    ok = r.select("conv_id", "conversations", msg.alias("m"))
    rows = ok.select("conv_id", F.posexplode("m.messages").alias("pos", "p"), "conversations")
    turn = table(spark, sf, "conversations").select("conv_id", "turn")
    turn = turn.withColumn("pos", F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1)
    return rows.join(turn, ["conv_id", "pos"]).select("conv_id", "turn", F.col("conversations")[F.col("pos")]["from"].alias("role"), F.size("p.content").alias("n_parts"))


def _checked(spark, sf):
    r = _records(spark, sf)
    image = F.transform(F.sequence(F.lit(0).cast("long"), F.col("n_media")), lambda i: F.concat_ws("/", F.col("conv_id").cast("string"), i.cast("string")))
    r = r.withColumn("image", F.slice(image, F.lit(1), F.col("n_media").cast("int"))).withColumn("video", F.array().cast("array<string>"))
    files = table(spark, sf, "conversations").where("turn = 0 and conv_id % 5 <> 0").select(F.explode(F.array(*[F.concat_ws("/", F.col("conv_id").cast("string"), F.lit(str(i))) for i in range(3)])).alias("path"))
    return validation.check_records(r, validation.missing_media(r, files, "conv_id", "image"), "conv_id")


_CHECK = """c AS (SELECT conv_id, n_media AS n_images, CASE WHEN n_media > 0 THEN 'image' ELSE 'none' END AS media_type, CASE WHEN conv_id % 5 = 0 THEN n_media ELSE 0 END AS gone, sum(CASE WHEN "from" = 'human' AND contains(value, '<image>') THEN 1 ELSE 0 END) AS marks FROM conv GROUP BY conv_id, n_media)"""


@query("SELECT conv_id, CAST(n_images AS BIGINT) AS n_images, media_type, CAST(CAST(gone > 0 AS INT) + CAST(marks <> n_images AS INT) AS BIGINT) AS n_problems, gone = 0 AND marks = n_images AS is_valid FROM c", V_CONV, _CHECK)
def media_validation(spark, sf):
    return _checked(spark, sf).select("conv_id", _l("n_images").alias("n_images"), "media_type", _l(F.size("problems")).alias("n_problems"), "is_valid")


@query("SELECT count(*) AS total, count(*) FILTER (gone = 0 AND marks = n_images) AS valid, count(*) FILTER (n_images > 0) AS n_image, 0 AS n_video, 0 AS n_mixed, count(*) FILTER (n_images = 0) AS n_none, count(*) FILTER (gone > 0) AS with_missing, count(*) FILTER (marks <> n_images) AS with_mismatch, 0 AS with_gpt_token, round(count(*) FILTER (gone = 0 AND marks = n_images) / count(*), 6) AS valid_share FROM c", V_CONV, _CHECK)
def media_stats(spark, sf):
    return validation.validation_statistics(_checked(spark, sf)).withColumn("valid_share", F.round("valid_share", 6))


@query("SELECT 'valid' AS side, count(*) FILTER (gone = 0 AND marks = n_images) AS n FROM c UNION ALL SELECT 'problem', count(*) FILTER (NOT (gone = 0 AND marks = n_images)) FROM c", V_CONV, _CHECK)
def valid_split(spark, sf):
    good, bad = validation.split_valid(_checked(spark, sf))
    return good.agg(F.lit("valid").alias("side"), F.count("*").alias("n")).unionByName(bad.agg(F.lit("problem").alias("side"), F.count("*").alias("n")))


_WORDS = "len(list_filter(string_split_regex(value, '\\s+'), lambda w: w <> ''))"


@query(f"SELECT conv_id, CAST(sum({_WORDS}) + CASE WHEN n_media > 0 THEN 128 ELSE 0 END AS BIGINT) AS length, CAST((sum({_WORDS}) + CASE WHEN n_media > 0 THEN 128 ELSE 0 END) * CASE WHEN n_media > 0 THEN 1 ELSE -1 END AS BIGINT) AS signed FROM conv GROUP BY conv_id, n_media", V_CONV)
def modality_lengths(spark, sf):
    values = F.transform("conversations", lambda t: t["value"])
    has = F.col("n_media") > 0
    length = sequences.word_length(values, has)
    return _records(spark, sf).select("conv_id", _l(length).alias("length"), _l(sequences.signed_length(length, has)).alias("signed"))


@query(f"SELECT conv_id, array_to_string(list_prepend(0, list(c ORDER BY turn)), ',') AS cu FROM (SELECT conv_id, turn, CAST(sum({_WORDS}) OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS c FROM conv) GROUP BY conv_id", V_CONV)
def cu_seqlens(spark, sf):
    lengths = F.transform("conversations", lambda t: F.size(text.words(t["value"])).cast("long"))
    return _records(spark, sf).select("conv_id", F.array_join(sequences.cumulative_lengths(lengths).cast("array<string>"), ",").alias("cu"))


def _packed(spark, sf):
    values = F.transform("conversations", lambda t: t["value"])
    r = _records(spark, sf).select("conv_id", _l(sequences.token_total(values, F.col("n_media") * 300)).alias("num_tokens"))
    return packing.pack_batches(records.numbered(r, "pos", ["conv_id"], start=0), "pos")


@query()
def pack_bins(spark, sf):
    return _packed(spark, sf).select("conv_id", "num_tokens", _l("batch").alias("batch"), "bin")


@query("SELECT count(*) AS items, 0 AS overfull FROM (SELECT DISTINCT conv_id FROM conversations)")
def pack_invariants(spark, sf):
    return packing.pack_invariants(_packed(spark, sf)).select("items", "overfull")


@query("SELECT CAST(trunc(count(*) * 0.37) AS BIGINT) AS n, CAST(trunc(count(*) * 0.37) AS BIGINT) AS n_distinct FROM documents")
def sample_fraction(spark, sf):
    return records.sample_fraction(table(spark, sf, "documents"), 0.37, "doc_id").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_distinct"))


@query("SELECT CAST(row_number() OVER (ORDER BY conv_id % 2, conv_id) AS BIGINT) AS id, conv_id FROM (SELECT DISTINCT conv_id FROM conversations)")
def renumber_union(spark, sf):
    c = table(spark, sf, "conversations").select("conv_id").distinct()
    both = records.union_all(c.where("conv_id % 2 = 0"), c.where("conv_id % 2 = 1")).withColumn("part", F.col("conv_id") % 2)
    return records.numbered(both, "id", ["part", "conv_id"]).select(_l("id").alias("id"), "conv_id")


@query("SELECT conv_id, turn, coalesce(lead(turn) OVER (PARTITION BY conv_id ORDER BY turn), turn) AS next_turn FROM conversations")
def next_sample(spark, sf):
    return records.next_sample(table(spark, sf, "conversations"), ["conv_id"], "turn", "turn", "next_turn").select("conv_id", "turn", "next_turn")


@query("SELECT user_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def last_of_duplicates(spark, sf):
    return records.last_of_duplicates(table(spark, sf, "events").select("user_id", "event_id", "event_type"), "user_id", "event_id").select("user_id", "event_type")


@query("SELECT count(*) AS n_changed FROM documents WHERE doc_id % 10 = 3 OR doc_id % 17 = 5")
def changed_rows(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", "text", "lang")
    new = d.withColumn("lang", F.when(F.col("doc_id") % 10 == 3, F.lit(None)).otherwise(F.col("lang")))
    return records.changed_rows(new, d.where("doc_id % 17 <> 5"), ["doc_id"], ["text", "lang"]).agg(F.count("*").alias("n_changed"))


@query("SELECT p_partkey AS \"index\", CASE WHEN p_partkey % 4 <> 0 THEN repeat('x', 70) || p_partkey WHEN (p_partkey + 1) % 4 <> 0 AND p_partkey < (SELECT count(*) FROM part) THEN repeat('x', 70) || (p_partkey + 1) END AS image FROM part")
def image_deref(spark, sf):
    k = F.col("p_partkey")
    rows = table(spark, sf, "part").select(k.alias("index"), F.when(k % 4 == 0, (k + 1).cast("string")).otherwise(F.concat(F.lit("x" * 70), k.cast("string"))).alias("image"))
    return records.deref_images(rows).select("index", "image")


# ------------------------------------------------------------------ geometry


@query("SELECT stem, obj_id, CAST(least(greatest(round_even(x1 / width * 1000, 0), 0), 1000) AS BIGINT) AS a, CAST(least(greatest(round_even(y1 / height * 1000, 0), 0), 1000) AS BIGINT) AS b, CAST(least(greatest(round_even(x2 / width * 1000, 0), 0), 1000) AS BIGINT) AS c, CAST(least(greatest(round_even(y2 / height * 1000, 0), 0), 1000) AS BIGINT) AS d FROM box", V_BOX)
def bbox_norm_1000(spark, sf):
    b = geometry.box_to_thousandths(F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]), F.col("height"), F.col("width"))
    return views.boxes(spark, sf).withColumn("n", b).select("stem", "obj_id", *[F.col("n")[i].alias(c) for i, c in enumerate("abcd")])


def _resize_sql(low, high, factor, first, ok, hh="h", ww="w"):
    r = f"SELECT *, {first.format('h')} AS hb, {first.format('w')} AS wb FROM (SELECT p_partkey, {hh} AS h, {ww} AS w FROM siz WHERE {ok})"
    down, up = f"sqrt(CAST(h * w AS DOUBLE) / {high})", f"sqrt({low} / CAST(h * w AS DOUBLE))"
    pick = "CASE WHEN hb * wb > {high} THEN floor({0} / {down} / {f}) * {f} WHEN hb * wb < {low} THEN ceil({0} * {up} / {f}) * {f} ELSE {0}b END"
    both = [f"CAST({pick.format(x, high=high, low=low, down=down, up=up, f=factor)} AS BIGINT) AS {n}" for x, n in (("h", "height"), ("w", "width"))]
    return f"SELECT p_partkey, {', '.join(both)} FROM ({r})"


_OK = "greatest(h, w) <= 200 * least(h, w)"


@query(_resize_sql(784, 50176, 32, "greatest(32, CAST(round_even({} / 32, 0) * 32 AS BIGINT))", _OK), V_SIZE)
def smart_resize_utils(spark, sf):
    s = geometry.smart_resize(F.col("h"), F.col("w"), 32, 784, 50176)
    return views.sizes(spark, sf).withColumn("s", s).where("s is not null").select("p_partkey", "s.height", "s.width")


@query(_resize_sql(3136, 1003520, 28, "CAST(round_even({} / 28, 0) * 28 AS BIGINT)", _OK, "CASE WHEN greatest(h, w) > 2000 THEN CAST(trunc(h / (greatest(h, w) / 2000)) AS BIGINT) ELSE h END", "CASE WHEN greatest(h, w) > 2000 THEN CAST(trunc(w / (greatest(h, w) / 2000)) AS BIGINT) ELSE w END"), V_SIZE)
def smart_resize_det(spark, sf):
    s = geometry.smart_resize_detection(F.col("h"), F.col("w"), long_side=2000)
    return views.sizes(spark, sf).withColumn("s", s).where("s is not null").select("p_partkey", "s.height", "s.width")


@query(_resize_sql(3136, 1003520, 28, "CAST(round_even({} / 28, 0) * 28 AS BIGINT)", _OK + " AND least(h, w) >= 28"), V_SIZE)
def smart_resize_train(spark, sf):
    s = geometry.smart_resize_training(F.col("h"), F.col("w"))
    return views.sizes(spark, sf).withColumn("s", s).where("s is not null").select("p_partkey", "s.height", "s.width")


@query("SELECT p_partkey, n FROM (SELECT p_partkey, CAST(floor(least(least(greatest(h / 25.0 * 2.0, 4.0), floor(least(768, h) / 2) * 2), h) / 2) * 2 AS BIGINT) AS n, h FROM siz) WHERE n >= 2 AND n <= h", V_SIZE)
def nframes(spark, sf):
    n = geometry.frame_count(F.col("h"), F.lit(25.0))
    return views.sizes(spark, sf).select("p_partkey", n.alias("n")).where("n is not null")


@query("SELECT p_partkey, s AS start_frame, e AS end_frame, e - s + 1 AS n FROM (SELECT p_partkey, CAST(ceil(least(greatest(w / 100.0, 0), h / 30.0) * 30.0) AS BIGINT) AS s, least(CAST(floor(least(w / 50.0, h / 30.0) * 30.0) AS BIGINT), h - 1) AS e FROM siz) WHERE s < e", V_SIZE)
def frame_range(spark, sf):
    r = geometry.frame_range(F.col("h"), F.lit(30.0), F.col("w") / F.lit(100.0), F.col("w") / F.lit(50.0))
    return views.sizes(spark, sf).withColumn("r", r).where("r is not null").select("p_partkey", F.col("r.start").alias("start_frame"), F.col("r.end").alias("end_frame"), F.col("r.count").alias("n"))


@query("SELECT p_partkey, array_to_string(list_transform(range(5), lambda i: CAST(round_even(i * ((h - 1) / 4.0), 0) AS BIGINT)), ',') AS even, array_to_string(list_transform(range(0, h, 400), lambda i: 'f' || i), ',') AS names FROM siz", V_SIZE)
def linspace(spark, sf):
    five = geometry.spaced_indices(F.lit(0).cast("double"), (F.col("h") - 1).cast("double"), F.lit(5))
    return views.sizes(spark, sf).select("p_partkey", F.array_join(five.cast("array<string>"), ",").alias("even"), F.array_join(geometry.frame_names(F.col("h"), 0.0025, "f%d"), ",").alias("names"))


@query("SELECT stem, obj_id, array_to_string([a, b, c, d], ',') AS crop FROM (SELECT stem, obj_id, greatest(0, CAST(trunc((x1 + x2) / 2.0 - greatest(1.0, (x2 - x1) * 1.5) / 2) AS BIGINT)) AS a, greatest(0, CAST(trunc((y1 + y2) / 2.0 - greatest(1.0, (y2 - y1) * 1.5) / 2) AS BIGINT)) AS b, least(width, CAST(trunc((x1 + x2) / 2.0 + greatest(1.0, (x2 - x1) * 1.5) / 2) AS BIGINT)) AS c, least(height, CAST(trunc((y1 + y2) / 2.0 + greatest(1.0, (y2 - y1) * 1.5) / 2) AS BIGINT)) AS d FROM box) WHERE c > a AND d > b", V_BOX)
def crop_box(spark, sf):
    return grounding.crop_metadata(views.boxes(spark, sf)).select("stem", "obj_id", F.array_join(F.col("crop_box").cast("array<string>"), ",").alias("crop"))


@query("SELECT stem, obj_id, least(2, greatest(0, CAST(trunc((y1 + y2) / 2.0 / height * 3) AS BIGINT))) * 3 + least(2, greatest(0, CAST(trunc((x1 + x2) / 2.0 / width * 3) AS BIGINT))) AS cell FROM box", V_BOX)
def grid_cell(spark, sf):
    c = geometry.centre(*[F.col(x) for x in ("x1", "y1", "x2", "y2")])
    return views.boxes(spark, sf).select("stem", "obj_id", _l(geometry.grid_cell(c["x"], c["y"], F.col("width"), F.col("height"))).alias("cell"))


@query("SELECT stem, obj_id, CAST((x2 - x1) * (y2 - y1) AS DOUBLE) AS area, CAST((x2 - x1) * (y2 - y1) / 2.0 AS DOUBLE) AS half FROM box", V_BOX)
def polygon_area(spark, sf):
    p = F.array(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y1", "x2", "y2", "x1", "y2")])
    return views.boxes(spark, sf).select("stem", "obj_id", geometry.polygon_area(p).alias("area"), geometry.polygon_area(F.slice(p, 1, 6)).alias("half"))


_IOU = "CAST(greatest(least(b.x2, d.x2) - greatest(b.x1, d.x1), 0) * greatest(least(b.y2, d.y2) - greatest(b.y1, d.y1), 0) AS DOUBLE)"
_PAIRS = f"pairs AS (SELECT stem, obj_id, other_id, i / (a - i) AS iou FROM (SELECT b.stem, b.obj_id, d.obj_id AS other_id, {_IOU} AS i, (b.x2 - b.x1) * (b.y2 - b.y1) + (d.x2 - d.x1) * (d.y2 - d.y1) AS a FROM box b JOIN det d ON b.stem = d.stem) WHERE i > 0)"


@query("SELECT stem, obj_id, other_id, round(iou, 6) AS iou FROM pairs WHERE iou >= 0.1", V_BOX, V_DET, _PAIRS)
def iou_pairs(spark, sf):
    return grounding.iou_pairs(views.boxes(spark, sf), views.found_boxes(spark, sf)).withColumn("iou", F.round("iou", 6))


@query("""SELECT stem, obj_id, other_id, round(iou, 6) AS iou FROM taking WHERE other_id IS NOT NULL""", V_BOX, V_DET, _PAIRS,
       """taking AS (SELECT stem, CAST(-1 AS BIGINT) AS obj_id, CAST(NULL AS BIGINT) AS other_id, CAST(NULL AS DOUBLE) AS iou, CAST([] AS BIGINT[]) AS taken FROM (SELECT DISTINCT stem FROM box) UNION ALL
SELECT t.stem, t.obj_id + 1, arg_min(p.other_id, (-p.iou, p.other_id)), max(p.iou), CASE WHEN count(p.other_id) > 0 THEN list_append(t.taken, arg_min(p.other_id, (-p.iou, p.other_id))) ELSE t.taken END
FROM taking t JOIN box o ON o.stem = t.stem AND o.obj_id = t.obj_id + 1 LEFT JOIN pairs p ON p.stem = t.stem AND p.obj_id = t.obj_id + 1 AND p.iou >= 0.1 AND NOT list_contains(t.taken, p.other_id) GROUP BY t.stem, t.obj_id, t.taken)""", recursive=True)
def iou_match_greedy(spark, sf):
    return grounding.match_greedy(grounding.iou_pairs(views.boxes(spark, sf), views.found_boxes(spark, sf))).withColumn("iou", F.round("iou", 6))


@query("""SELECT stem, obj_id, other_id, rank FROM (SELECT a.stem, a.obj_id, b.obj_id AS other_id, row_number() OVER (PARTITION BY a.stem, a.obj_id ORDER BY (b.x1 + b.x2 - a.x1 - a.x2) ** 2 + (b.y1 + b.y2 - a.y1 - a.y2) ** 2, b.obj_id) AS rank FROM box a JOIN box b ON a.stem = b.stem AND a.obj_id <> b.obj_id) WHERE rank <= 2""", V_BOX)
def nearest_group(spark, sf):
    return grounding.nearest(views.boxes(spark, sf), 3).select("stem", "obj_id", "other_id", _l("rank").alias("rank"))


@query("SELECT a.stem, CAST(len(list_intersect(a.i, b.i)) AS DOUBLE) / len(list_distinct(a.i || b.i)) AS overlap FROM (SELECT stem, list(obj_id) FILTER (obj_id % 2 = 0) AS i FROM box GROUP BY stem) a JOIN (SELECT stem, list(obj_id) FILTER (obj_id < 3) AS i FROM box GROUP BY stem) b ON a.stem = b.stem", V_BOX)
def jaccard_pairs(spark, sf):
    g = views.boxes(spark, sf).groupBy("stem").agg(F.collect_list(F.when(F.col("obj_id") % 2 == 0, F.col("obj_id"))).alias("a"), F.collect_list(F.when(F.col("obj_id") < 3, F.col("obj_id"))).alias("b"))
    return g.select("stem", sequences.jaccard(F.col("a"), F.col("b")).alias("overlap"))


@query("SELECT p_partkey, round(fx, 2) AS fx, round(fy, 2) AS fy, w / 2.0 AS cx, h / 2.0 AS cy FROM (SELECT p_partkey, h, w, w / (2 * tan(radians(60.0) / 2)) AS fx, h / (2 * tan(radians(60.0) / 2)) AS fy FROM siz)", V_SIZE)
def pseudo_camera(spark, sf):
    return views.sizes(spark, sf).withColumn("c", geometry.pseudo_camera(F.col("w"), F.col("h"))).select("p_partkey", "c.fx", "c.fy", "c.cx", "c.cy")


@query("SELECT p_partkey, 8 AS n, round(500 * (h / 2000.0 + 1) / (10 + h / 4000.0) + w / 2.0, 4) AS x0 FROM siz", V_SIZE)
def project_3d(spark, sf):
    box = F.array(F.col("h") / 4000, F.lit(0.0), F.lit(10.0) , F.lit(2.0) + F.col("h") / 2000, F.lit(2.0), F.col("h") / 2000, F.lit(0.0), F.lit(0.0), F.lit(0.0))
    corners = geometry.project_box(box, F.lit(500.0), F.lit(500.0), F.col("w") / 2, F.lit(240.0))
    s = views.sizes(spark, sf).withColumn("c", corners)
    return s.select("p_partkey", F.size("c").alias("n"), F.round(F.col("c")[0][0], 4).alias("x0"))


# ------------------------------------------------------------------ layout, drafts, coverage


@query("SELECT count(*) FILTER (d.doc_id IS NOT NULL AND l.doc_id IS NOT NULL) AS paired, count(*) FILTER (l.doc_id IS NULL) AS image_only, count(*) FILTER (d.doc_id IS NULL) AS label_only FROM documents d FULL JOIN (SELECT doc_id FROM labels UNION ALL SELECT doc_id + 1000000000 FROM labels WHERE toxic = 1) l ON d.doc_id = l.doc_id")
def layout_full_outer(spark, sf):
    labels = table(spark, sf, "labels")
    apart = labels.where("toxic = 1").select((F.col("doc_id") + 1_000_000_000).alias("stem"))  # labels beside the real ones that have no document
    return validation.layout(table(spark, sf, "documents").select(F.col("doc_id").alias("stem")), labels.select(F.col("doc_id").alias("stem")).unionByName(apart))


@query("SELECT lang, count(*) AS missing FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) GROUP BY lang")
def missing_anti(spark, sf):
    d = table(spark, sf, "documents").withColumn("obj_id", F.lit(0)).withColumnRenamed("doc_id", "stem").withColumn("label", F.lit("car"))
    done = table(spark, sf, "labels").select(F.col("doc_id").alias("stem"), F.lit(0).alias("obj_id"), F.array(F.lit("white car")).alias("phrases"), F.lit("model").alias("source"))
    return grounding.work_list(d, done).groupBy("lang").agg(F.count("*").alias("missing"))


@query("""SELECT (SELECT count(*) FROM (SELECT DISTINCT o_orderkey AS stem FROM orders) WHERE stem NOT IN (SELECT stem FROM box)) AS no_objects, (SELECT count(*) FROM box WHERE obj_id % 3 = 0) AS no_description, 0 AS no_caption""", V_BOX)
def draft_gaps(spark, sf):
    b = views.boxes(spark, sf)
    gaps = validation.draft_gaps(table(spark, sf, "orders").select(F.col("o_orderkey").alias("stem")), b, b.where("obj_id % 3 <> 0"), b)
    return gaps.select("no_objects", "no_description", "no_caption")


@query("SELECT count(*) AS total, count(*) FILTER (d) AS done, count(*) FILTER (NOT d) AS remaining FROM (SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS d FROM documents)")
def annotation_progress(spark, sf):
    return validation.progress(table(spark, sf, "documents").select(F.col("doc_id").alias("stem")), table(spark, sf, "labels").select(F.col("doc_id").alias("stem")))


def _captions(spark, sf):
    b = views.boxes(spark, sf).where("obj_id % 2 = 0 or stem % 3 = 0")
    return b.groupBy("stem", (F.col("obj_id") % 2).alias("sentence_id")).agg(F.array_sort(F.collect_list("obj_id")).alias("obj_ids"))


@query("SELECT stem, obj_id FROM box WHERE NOT (obj_id % 2 = 0 OR stem % 3 = 0)", V_BOX)
def coverage_uncovered(spark, sf):
    return grounding.uncovered(views.boxes(spark, sf), _captions(spark, sf)).select("stem", "obj_id")


@query("SELECT stem, CAST(sum(n) AS BIGINT) AS uses, max(n) AS most FROM (SELECT stem, obj_id, 1 AS n FROM box WHERE obj_id % 2 = 0 OR stem % 3 = 0) GROUP BY stem", V_BOX)
def caption_frequency(spark, sf):
    return grounding.covered(_captions(spark, sf)).groupBy("stem").agg(F.sum("n_captions").alias("uses"), F.max("n_captions").alias("most"))


@query("SELECT count(*) AS uncovered_images FROM box WHERE false", V_BOX)
def caption_groups_cover(spark, sf):
    b = views.boxes(spark, sf)
    return grounding.uncovered(b, grounding.caption_groups(b)).agg(F.count("*").alias("uncovered_images"))


@query()
def caption_groups(spark, sf):
    return grounding.caption_groups(views.boxes(spark, sf))


def _described(spark, sf):
    b = views.boxes(spark, sf)
    return b.withColumn("phrases", F.array(F.concat_ws(" ", F.lit("shiny"), F.lower("label"), F.col("obj_id").cast("string")), F.col("label"), F.concat_ws(" ", F.lit("big"), F.lower("label"))))


@query("SELECT stem, obj_id, 'shiny ' || lower(label) || ' ' || obj_id AS phrase FROM box UNION ALL SELECT stem, obj_id, 'big ' || lower(label) FROM box WHERE obj_id % 2 = 1", V_BOX)
def phrases_unused(spark, sf):
    used = _described(spark, sf).where("obj_id % 2 = 0").groupBy("stem").agg(F.collect_list(F.struct("obj_id", F.concat_ws(" ", F.lit("Big"), F.lower("label")).alias("phrase"))).alias("phrases"))
    return grounding.unused_phrases(_described(spark, sf), used)


@query("SELECT stem, obj_id, 'shiny ' || lower(label) || ' ' || obj_id AS phrase FROM box", V_BOX)
def phrase_pick(spark, sf):
    d = _described(spark, sf).withColumn("phrases", F.slice("phrases", 1, 2))
    return grounding.pick_phrases(d).select("stem", "obj_id", "phrase")


@query("SELECT stem, CAST(row_number() OVER (PARTITION BY stem ORDER BY obj_id) - 1 AS BIGINT) AS annotation_id, obj_id, CAST((x2 - x1) * (y2 - y1) AS DOUBLE) AS area FROM box", V_BOX)
def export_annotations(spark, sf):
    d = _described(spark, sf)
    groups = d.groupBy("stem").agg(F.array_sort(F.collect_list("obj_id")).alias("obj_ids")).select("stem", F.lit(0).alias("sentence_id"), "obj_ids", F.lit("all").alias("strategy"), F.lit(-1).alias("grid_cell"))
    picked = d.withColumn("phrase", F.col("phrases")[0])
    out = grounding.export_annotations(grounding.write_captions(groups, picked), d)
    return out.select("stem", _l("annotation_id").alias("annotation_id"), "obj_id", "area")


@query()
def span_assign(spark, sf):
    p = views.lines(spark, sf).withColumnRenamed("runs", "phrases")
    return grounding.with_spans(p).select("doc_id", "line", F.to_json("spans").alias("spans"))


@query("SELECT stem, obj_id, CASE WHEN obj_id % 2 = 0 THEN 'model' ELSE 'fallback' END AS source, CASE WHEN obj_id % 2 = 0 THEN 1 ELSE 3 END AS n_phrases FROM box", V_BOX)
def with_descriptions(spark, sf):
    b = views.boxes(spark, sf)
    d = b.where("obj_id % 2 = 0").select("stem", "obj_id", F.array(F.lit("x")).alias("phrases"), F.lit("model").alias("source"))
    return grounding.with_descriptions(b, d).select("stem", "obj_id", "source", F.size("phrases").alias("n_phrases"))


@query("SELECT source, count(*) AS n, CAST(sum(n_chars) AS BIGINT) AS bytes, md5(count(*) || ':' || CAST(sum(n_chars) AS BIGINT) || ':' || max(doc_id) || ':' || min(lang || doc_id) || ':' || max(lang || doc_id)) AS signature FROM documents GROUP BY source")
def signature(spark, sf):
    d = table(spark, sf, "documents").withColumn("name", F.concat("lang", F.col("doc_id").cast("string")))
    return validation.directory_signature(d, "name", "n_chars", "doc_id", ["source"]).select("source", "n", "bytes", "signature")


@query("SELECT l_returnflag AS grp, CAST(count(DISTINCT l_orderkey) AS BIGINT) AS n_json, count(*) AS n_shapes, count(*) FILTER (l_linenumber = 1) AS n_rectangle, count(*) FILTER (l_linenumber = 2) AS n_polygon, count(*) FILTER (l_linenumber > 2) AS n_other, 'mixed' AS geometry FROM lineitem GROUP BY l_returnflag")
def shape_statistics(spark, sf):
    s = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("grp"), F.col("l_orderkey").alias("file"), F.when(F.col("l_linenumber") == 1, " Rectangle").when(F.col("l_linenumber") == 2, "polygon").otherwise("line").alias("shape_type"))
    return validation.shape_statistics(s, by=["grp"])


# ------------------------------------------------------------------ media and parsing


@query("""SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM (SELECT DISTINCT s.event_id, s.user_id FROM sub s JOIN fr f ON s.user_id = f.user_id AND f.t > s.a AND f.t < s.b) GROUP BY user_id""",
       "sub AS (SELECT event_id, user_id, epoch_ms(ts) AS a, epoch_ms(ts) + CAST(floor(\"value\") AS BIGINT) * 1000 AS b FROM events WHERE event_type = 'purchase')", "fr AS (SELECT user_id, epoch_ms(ts) AS t FROM events WHERE event_type IN ('view', 'click'))")
def subtitle_frames(spark, sf):
    e = table(spark, sf, "events")
    ms = F.unix_millis(F.col("ts").cast("timestamp"))
    s = e.where("event_type = 'purchase'").select("user_id", ms.alias("start_ms"), (ms + F.floor("value") * 1000).alias("end_ms"))
    f = e.where("event_type in ('view', 'click')").select("user_id", (ms / 1000).alias("ts"))
    return media.subtitles_at_frames(s, f, "user_id", 60_000).groupBy("user_id").agg(F.count("*").alias("n"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def fence_json(spark, sf):
    said = F.concat(F.lit("<think>{}</think>\n```json\n"), F.col("props"), F.lit("\n```"))
    mixed = F.when(F.col("event_id") % 2 == 0, said).otherwise(F.concat(F.lit("it is "), F.col("props"), F.lit(" I think")))
    return table(spark, sf, "events").select("event_id", _l(F.get_json_object(parsing.json_object_text(mixed), "$.k")).alias("k"))


@query("SELECT stem, obj_id, label, array_to_string([x1 % 1000, y1 % 1000, x2 % 1000, y2 % 1000], ',') AS grid FROM box WHERE obj_id % 4 <> 3", V_BOX)
def grid_tokens(spark, sf):
    nums = F.concat_ws(" ", *[F.concat(F.lit("<"), (F.col(c) % 1000).cast("string"), F.lit(">")) for c in ("x1", "y1", "x2", "y2")])
    said = F.concat(F.lit("see <|object_ref_start|>"), "label", F.lit("<|object_ref_end|><|box_start|>"), F.when(F.col("obj_id") % 4 == 3, "none").otherwise(nums), F.lit("<|box_end|>."))
    b = views.boxes(spark, sf).select("stem", "obj_id", F.explode(parsing.grid_boxes(said)).alias("g"))
    return b.select("stem", "obj_id", F.col("g.label").alias("label"), F.array_join(F.col("g.grid").cast("array<string>"), ",").alias("grid"))


@query("SELECT page_id, CASE WHEN starts_with(url, 'http') THEN 'http' ELSE 'path' END AS kind, md5(url) AS cache_key FROM pages")
def media_sources(spark, sf):
    return table(spark, sf, "pages").select("page_id", parsing.media_kind(F.col("url")).alias("kind"), F.md5(F.col("url").cast("binary")).alias("cache_key"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN 'click needs coordinate' WHEN 1 THEN 'unknown action fly' WHEN 2 THEN 'no action' END AS problem FROM events")
def action_problems(spark, sf):
    k = F.col("event_id") % 4
    args = F.when(k == 0, '{"action":"click"}').when(k == 1, '{"action":"fly"}').when(k == 2, "{}").otherwise('{"action":"type","text":"x"}')
    return table(spark, sf, "events").select("event_id", parsing.action_problem(args).alias("problem"))


@query("SELECT user_id, 77091 AS opened, n, CAST(n + 2 AS BIGINT) AS labelled FROM (SELECT user_id, CAST(count(*) AS BIGINT) AS n FROM events GROUP BY user_id)")
def label_mask(spark, sf):
    g = table(spark, sf, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("event_id")).alias("ids"))
    lit = lambda *v: F.array(*[F.lit(x).cast("long") for x in v])
    ids = F.concat(lit(1, sequences.OPEN_ID, 198), F.transform("ids", lambda x: x + 200_000), lit(sequences.CLOSE_ID, 198, 2))
    mask = F.filter(sequences.label_mask(ids), lambda x: x != sequences.IGNORED)
    return g.select("user_id", F.lit(sequences.OPEN_ID).alias("opened"), _l(F.size("ids")).alias("n"), _l(F.size(mask)).alias("labelled"))


@query("SELECT stem, obj_id, label, round(x1 + d, 6) AS x, round(y1 + d, 6) AS y FROM (SELECT *, 0 AS d FROM box) WHERE label <> 'RF'", V_BOX)
def det_rescale(spark, sf):
    b = views.boxes(spark, sf)
    classes = ["AF", "AO", "NF", "NO", "RO"]
    scaled = F.array(*[F.col(c) / F.col("width" if c[0] == "x" else "height") * 1000 for c in ("x1", "y1", "x2", "y2")])
    answer = F.concat(F.lit("```json\n"), F.to_json(F.array(F.struct(scaled.alias("bbox_2d"), F.lower("label").alias("label")))), F.lit("\n```"))
    jobs = b.select(F.struct("stem", "obj_id", "label").alias("img_id"), "height", "width", F.col("height").alias("resized_h"), F.col("width").alias("resized_w"), answer.alias("answer"))
    d = detection.detections(detection.parse_boxes(jobs), classes, [0, 1, 2, 3, 4], relative=True)
    return d.select("image_id.stem", "image_id.obj_id", "image_id.label", F.round(F.col("bbox")[0], 6).alias("x"), F.round(F.col("bbox")[1], 6).alias("y"))


@query()
def det_map(spark, sf):
    labels = F.when(F.col("label") == "AF", 0).when(F.col("label") == "RF", 1).otherwise(2)
    shape = lambda b: b.select(F.col("stem").alias("image_id"), labels.alias("category_id"), geometry.xywh(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]).alias("bbox"), "obj_id")
    truth = shape(views.boxes(spark, sf)).withColumn("area", detection.box_area(F.col("bbox"))).withColumn("iscrowd", F.lit(0))
    return detection.average_precision(truth, shape(views.found_boxes(spark, sf)).withColumn("score", F.lit(1.0)).withColumnRenamed("obj_id", "ord"))


@query("SELECT 1.0 AS \"mAP\", 1.0 AS \"mAP_50\", 1.0 AS \"mAP_75\"")
def det_map_perfect(spark, sf):
    b = views.boxes(spark, sf).select(F.col("stem").alias("image_id"), F.lit(1).alias("category_id"), geometry.xywh(*[F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2")]).alias("bbox"), "obj_id")
    b = b.dropDuplicates(["image_id", "bbox"])
    truth = b.withColumn("area", detection.box_area(F.col("bbox"))).withColumn("iscrowd", F.lit(0))
    return detection.average_precision(truth, b.withColumn("score", F.lit(1.0)).withColumnRenamed("obj_id", "ord")).select("mAP", "mAP_50", "mAP_75")


@query("SELECT o_orderpriority AS scene, 8 AS max_phrases, count(*) AS n FROM orders WHERE o_orderpriority NOT LIKE '1%' GROUP BY ALL UNION ALL SELECT o_orderpriority, 1, count(*) FROM orders WHERE o_orderpriority LIKE '1%' GROUP BY ALL")
def scene_policy(spark, sf):
    o = table(spark, sf, "orders").select(F.col("o_orderpriority").alias("scene"))
    p = o.where("scene like '1%'").distinct().select(F.col("scene").alias("id"), F.lit(None).cast("string").alias("label"), F.lit("-3").alias("max_phrases"), *[F.lit(None).cast("boolean").alias(c) for c in ("ban_vehicle_subtypes", "exhaustive", "caption_cover_all")])
    return readers.with_policy(o, readers.policy_defaults(p)).groupBy("scene", "max_phrases").agg(F.count("*").alias("n"))

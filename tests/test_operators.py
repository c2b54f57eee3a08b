"""Operators on small tables, and readers and writers on small files."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from mmops.operators import detection, evaluation, grounding, media, packing, records, validation
from mmops.sources import readers, sinks
from mmops.streaming import incremental


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_best_fit():
    weights = [3000, 2000, 1500, 1096, 5000, 96, 1000]
    bins = packing.best_fit(weights, 4096)
    found = {}
    for w, b in zip(weights, bins, strict=True):
        found.setdefault(b, []).append(w)
    assert sorted(sorted(v) for v in found.values()) == [[96, 1500, 2000], [1000], [1096, 3000], [5000]]


def test_pack_batches(spark):
    df = spark.createDataFrame([(i, 100 + i * 37 % 3000) for i in range(600)], "pos long, num_tokens long")
    got = packing.pack_batches(df, "pos")
    assert got.count() == 600 and packing.pack_invariants(got).first().overfull == 0 and got.agg(F.max("batch")).first()[0] == 2
    assert packing.packed_records(got, "pos", ["num_tokens"]).agg(F.sum(F.size("members"))).first()[0] == 600


def test_positions(spark):
    i = packing.IMAGE_ID
    got = packing.rotary_positions([1, 2, i, i, i, i, 3], [(1, 4, 4)], [])
    assert got == [[0, 1, 2, 2, 2, 2, 4], [0, 1, 2, 2, 3, 3, 4], [0, 1, 2, 3, 2, 3, 4]]
    v = packing.VIDEO_ID
    assert packing.rotary_positions([v, v, 9, v, v], [], [(2, 2, 4)])[2] == [0, 1, 2, 3, 4]
    assert packing.rotary_positions([v, v], [], [(2, 2, 2)], "2.5", [1.5])[0] == [0, 3]
    df = spark.createDataFrame([([1, 2], [], [])], "input_ids array<long>, image_grids array<array<int>>, video_grids array<array<int>>")
    assert packing.with_positions(df).first().positions == [[0, 1]] * 3
    assert [list(x) for x in spark.range(1).select(packing.text_positions(F.lit(2)).alias("p")).first().p] == [[0, 1]] * 3


def test_spans(spark):
    assert grounding.assign_spans("green car near car", ["car", "green car"]) == [[15, 18], [0, 9]]
    assert grounding.assign_spans("compact car", ["a"]) == [None]
    assert grounding.assign_spans("红car车", ["car"]) == [[1, 4]]
    caption, spans = grounding.complete_caption("A dog.", ["dog", "red hat"])
    assert caption == "A dog, with red hat." and spans == [[2, 5], [12, 19]]


def test_sampling(spark):
    df = spark.range(1000).withColumnRenamed("id", "k")
    assert [records.sample_fraction(df.limit(7), r, "k").count() for r in (0.5, 0.0, 1.5)] == [3, 0, 7]
    a, b = (rows(records.sample_fraction(df, 0.3, "k"), "k") for _ in range(2))
    assert a == b and len(a) == 300
    assert records.sampling_rate("data/A.yaml%50") == ("data/A.yaml", 0.5) and records.sampling_rate("a%b") == ("a%b", 1.0)
    rates = spark.createDataFrame([("x%50",), ("x",), ("a%b",)], "n string").select(records.rate_of(F.col("n")))
    assert [r[0] for r in rates.collect()] == [0.5, 1.0, 1.0]


def test_validation(spark):
    conv = "array<struct<from:string,value:string>>"
    df = spark.createDataFrame([(1, ["a"], [], [("human", "<image><image>"), ("gpt", "<image>")]), (2, [], [], [("human", "hi")]), (3, ["gone"], ["v"], [("human", "<image> <video>")])], f"id long, image array<string>, video array<string>, conversations {conv}")
    files = spark.createDataFrame([("a",), ("v",)], "path string")
    got = {r.id: r for r in validation.check_records(df, validation.missing_media(df, files, "id", "image")).collect()}
    assert [(p.kind, p.expected, p.found) for p in got[1].problems] == [("token_mismatch", 1, 2), ("gpt_media_token", 0, 1)]
    assert got[2].is_valid and got[3].media_type == "mixed" and [p.kind for p in got[3].problems] == ["missing_files"]


def test_subtitles(spark):
    s = spark.createDataFrame([("u", 1000, 2000), ("u", 500, 90000)], "u string, start_ms long, end_ms long")
    f = lambda *t: spark.createDataFrame([("u", x) for x in t], "u string, ts double")
    assert rows(media.subtitles_at_frames(s, f(1.0, 2.0), "u")) == [("u", 500, 90000)]
    assert len(rows(media.subtitles_at_frames(s, f(1.5, 1.6), "u"))) == 2


def ap(spark, truth, found):
    t = spark.createDataFrame([(i, c, [float(v) for v in b], float(b[2] * b[3]), 0) for i, c, b in truth], "image_id long, category_id long, bbox array<double>, area double, iscrowd int")
    d = spark.createDataFrame([(i, c, [float(v) for v in b], 1.0, n) for n, (i, c, b) in enumerate(found)], "image_id long, category_id long, bbox array<double>, score double, ord int")
    return detection.average_precision(t, d).first()


def test_average_precision(spark):
    truth = [(1, 1, (0, 0, 50, 50)), (1, 1, (100, 100, 50, 50))]
    one, off = (1, 1, (0, 0, 50, 50)), (1, 1, (300, 300, 50, 50))
    assert ap(spark, truth, [one, off]).mAP == pytest.approx(0.505) and ap(spark, truth, [off, one]).mAP == pytest.approx(0.252, abs=1e-3)
    assert ap(spark, truth, truth).mAP == 1.0 and ap(spark, truth, truth).mAP_m == 1.0 and ap(spark, truth, [off]).mAP == 0.0


def test_detection_answers(spark):
    said = ['```json\n[{"bbox_2d":[1,2,3,4],"label":"Car"},{"bbox_2d":[1,2],"label":"x"}]\n```', "[{'bbox_2d': (1, 2, 3, 4), 'label': 'car',}]", '[{"bbox_2d":[1,2,3,4]}]', "__import__('os')", None]
    jobs = spark.createDataFrame([(i, t, 10, 20, 10, 20) for i, t in enumerate(said)], "img_id long, answer string, height int, width int, resized_h int, resized_w int")
    parsed = detection.parse_boxes(jobs)
    assert [len(r.boxes) for r in parsed.orderBy("img_id").collect()] == [1, 1, 0, 0, 0]
    got = detection.detections(parsed, ["bus", "car", "CAR"], [7, 8, 9]).orderBy("image_id").collect()
    assert [(r.image_id, r.category_id, list(r.bbox)) for r in got] == [(0, 8, [1, 2, 2, 2]), (1, 8, [1, 2, 2, 2])]
    assert json.loads(sinks.detection_results(detection.detections(parsed, ["car"], [7])).first().value)["category_id"] == 7


def test_extract_with_judge(spark):
    import pandas as pd

    df = spark.createDataFrame([(1, "q", "cat", "dog", "B", "it is (B)"), (2, "q", "cat", "dog", "A", "hm"), (3, "q", "cat", "dog", "A", "hmm")], "index long, question string, A string, B string, gt string, prediction string")

    def judge(prompts: pd.Series) -> pd.Series:
        return pd.Series([None if p is None else "A" if p.endswith("hm") else "nothing" for p in prompts])

    got = {r["index"]: (r.extracted_answer, r.extraction_method, r.hit) for r in evaluation.extract(df, judge).collect()}
    assert got[1] == ("B", "rule", 1) and got[2] == ("A", "judge", 1) and got[3][1] == "random"
    assert evaluation.accuracy(evaluation.extract(df.limit(0))).count() == 1


def test_captions(spark):
    box = [(s, i, 10 * i, 10 * i, 10 * i + 8, 10 * i + 8, 640, 480, "car") for s in ("a", "b") for i in range(25 if s == "a" else 2)]
    objects = spark.createDataFrame(box, "stem string, obj_id long, x1 long, y1 long, x2 long, y2 long, width long, height long, label string")
    groups = grounding.caption_groups(objects)
    assert grounding.uncovered(objects, groups).count() == 0 and rows(groups, "stem", "sentence_id") == rows(grounding.caption_groups(objects), "stem", "sentence_id")
    assert groups.where(F.size("obj_ids") > 10).count() == 0
    described = objects.withColumn("phrases", F.array(F.lit("white car"), F.concat(F.lit("car number "), F.col("obj_id").cast("string"))))
    captions = grounding.write_captions(groups, grounding.pick_phrases(described))
    assert captions.where(F.exists("spans", lambda s: s.isNull())).count() == 0
    exported = grounding.export_annotations(captions, described)
    assert exported.groupBy("stem").agg((F.max("annotation_id") - F.count("*")).alias("d")).where("d <> -1").count() == 0
    o, d, c = grounding.delete_object(objects, described, captions, "a", 3)
    assert o.count() == 26 and d.count() == 26 and c.where("stem = 'a' and array_contains(obj_ids, 3)").count() == 0
    left = grounding.delete_caption(captions, "b", 0)
    assert [r[0] for r in rows(left.where("stem = 'b'").select("sentence_id"), "sentence_id")] == list(range(left.where("stem = 'b'").count()))
    assert grounding.sync_descriptions(described, captions).where(F.size("phrases") != F.size("zh")).count() == 0
    assert grounding.refresh_merge(["a", "b", "c"], {"b"}, ["x", "b", "y", "z"], 4) == ["x", "b", "y", "z"]


def test_select_shapes(spark):
    shape = lambda k: (k, k, [[0.0, 0.0]] if k != "none" else [])
    df = spark.createDataFrame([([shape(k) for k in ks],) for ks in (["polygon", "rectangle", "none"], ["polygon"], ["line", "none"])], f"s {readers.SHAPES}")
    pick = lambda p: [[x.label for x in r[0]] for r in df.select(grounding.select_shapes(F.col("s"), p)).collect()]
    assert pick("rectangle") == [["rectangle"], ["polygon"], ["line"]] and pick("polygon") == [["polygon"], ["polygon"], ["line"]]


def test_readers(spark, tmp_path):
    p = tmp_path / "r.jsonl"
    p.write_text('{"id":1,"image":"a.jpg","conversations":[{"from":"human","value":"é"}]}\n{"id":2,"image":["a","b"]}\n{"id":3}\n', encoding="utf-8")
    got = rows(readers.read_records(spark, str(p)).select("id", "image"), "id")
    assert got == [(1, ["a.jpg"]), (2, ["a", "b"]), (3, [])]
    (tmp_path / "r.json").write_text('[{"id":1,"image":"x"},{"id":2}]')
    assert readers.read_records(spark, str(tmp_path / "r.json")).count() == 2
    with pytest.raises(ValueError):
        readers.read_records(spark, "x.txt")
    (tmp_path / "t.tsv").write_text('index\tquestion\n1\t"a ""b""\nc"\n')
    assert rows(readers.read_tsv(spark, str(tmp_path / "t.tsv"))) == [("1", 'a "b"\nc')]
    d = tmp_path / "labels"
    d.mkdir()
    (d / "x.json").write_text('﻿{"imagePath":"p/x.png","shapes":[{"label":"car","shape_type":"polygon","points":[[1,2],[3,4],[5,6]]}]}{"y":1}', encoding="utf-8")
    (d / "y.xml").write_text("<annotation><filename>y.jpg</filename><object><name>bus</name><bndbox><xmin>1</xmin><ymin>2</ymin><xmax>5</xmax><ymax>6</ymax></bndbox></object><object><bndbox><xmin>9</xmin><ymin>2</ymin><xmax>5</xmax><ymax>6</ymax></bndbox></object></annotation>")
    labels = {r.stem: r for r in readers.read_labels(spark, str(d)).collect()}
    assert labels["x"].shapes[0].label == "car" and labels["x"].hint == "p/x.png"
    assert [(s.label, s.points) for s in labels["y"].shapes] == [("bus", [[1.0, 2.0], [5.0, 6.0]])] and labels["y"].hint == "y.jpg"
    found = readers.listing(spark, str(d))
    assert rows(readers.label_files(found).select("stem"), "stem") == [("x",), ("y",)]


def test_segments_and_subtitles(spark):
    lines = spark.createDataFrame([("1 0.5 0.5 1 1 0 0",), ("1 0.5 0.5",), ("1 a b c d e f",)], "l string")
    got = [r[0] for r in lines.select(readers.yolo_segment(F.col("l"), F.lit(10), F.lit(20))).collect()]
    assert got[0]["points"] == [5.0, 10.0, 10.0, 20.0, 0.0, 0.0] and got[1] is None and got[2] is None
    srt = "1\n00:00:01,000 --> 00:00:02,500\nhello\nthere\n\n2\n00:01:00,000 --> 00:01:01,000\nx\n"
    got = spark.createDataFrame([(srt,)], "s string").select(F.inline(readers.subtitles(F.col("s")))).collect()
    assert [tuple(r) for r in got] == [(1000, 2500, "hello\nthere"), (60000, 61000, "x")]


def test_image_header():
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 480)
    jpg = b"\xff\xd8\xff\xe0" + struct.pack(">H", 16) + bytes(14) + b"\xff\xc0" + struct.pack(">HBHH", 11, 8, 48, 64) + bytes(4)
    assert readers.header_size(png) == (640, 480) and readers.header_size(jpg) == (64, 48) and readers.header_size(b"GIF") == (None, None)


def test_configs(tmp_path):
    p = tmp_path / "d.yaml"
    sinks.write_manifest(str(p), "a.jsonl", "imgs", incharge="é")
    assert readers.dataset_configs([f"{p}%50", "x.json", "n"], {"n": {"annotation_path": "z", "data_path": ""}}) == [
        {"annotation_path": "a.jsonl", "data_path": "imgs", "incharge": "é", "sampling_rate": 0.5}, {"annotation_path": "x.json", "data_path": "", "sampling_rate": 1.0}, {"annotation_path": "z", "data_path": "", "sampling_rate": 1.0}]
    with pytest.raises(ValueError):
        readers.dataset_configs(["unknown"])


def test_writers_and_stream(spark, tmp_path):
    df = spark.createDataFrame([(1, "é\x01"), (2, None)], "id long, t string")
    sinks.write_jsonl(df, str(tmp_path / "j"))
    assert rows(readers.read_jsonl(spark, str(tmp_path / "j"), "id long, t string"), "id") == [(1, "é\x01"), (2, None)]
    sinks.write_table(df, str(tmp_path / "c"), "\t")
    assert rows(readers.read_tsv(spark, str(tmp_path / "c")), "id") == [("1", "é"), ("2", None)]
    source = tmp_path / "in"
    source.mkdir()
    (source / "a.jsonl").write_text('{"id":1,"image":"x","conversations":[{"from":"human","value":"<image>"}]}\n{"id":2,"image":"x","conversations":[]}\n')
    q = incremental.validate_stream(incremental.stream_records(spark, str(source)), str(tmp_path / "out"), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert rows(spark.read.json(str(tmp_path / "out")).select("id", "is_valid"), "id") == [(1, "true"), (2, "false")]
    events = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:00:00", "a")], "ts string, event_type string")
    assert sorted(r.n for r in incremental.windowed_counts(events).collect()) == [1, 2]


def plain_average_precision(truth, found):
    """The COCO protocol on lists, without Spark: truth (image, category, box, area, crowd), found (image, category, box, score)."""
    import numpy as np

    def overlap(d, t, crowd):
        both = max(min(d[0] + d[2], t[0] + t[2]) - max(d[0], t[0]), 0) * max(min(d[1] + d[3], t[1] + t[3]) - max(d[1], t[1]), 0)
        return both / (d[2] * d[3] + (0 if crowd else t[2] * t[3] - both))

    def one(category, low, high, limit, threshold):
        rows, npos = [], 0
        for image in sorted({x[0] for x in truth} | {x[0] for x in found}):
            ts = [t for t in truth if t[:2] == (image, category)]
            out = [bool(t[4]) or not low <= t[3] <= high for t in ts]
            npos += out.count(False)
            free = set(range(len(ts)))
            ds = sorted((d for d in found if d[:2] == (image, category)), key=lambda d: -d[3])
            for d in ds[:limit]:
                fits = [(i, overlap(d[2], ts[i][2], ts[i][4])) for i in range(len(ts)) if i in free or ts[i][4]]
                fits = [x for x in fits if x[1] >= threshold]
                pool = [x for x in fits if not out[x[0]]] or fits
                if not pool:
                    if low <= d[2][2] * d[2][3] <= high:
                        rows.append((-d[3], len(rows), 0))
                    continue
                i = max(pool, key=lambda x: (x[1], x[0]))[0]
                free.discard(i)
                if not out[i]:
                    rows.append((-d[3], len(rows), 1))
        if not npos:
            return None
        tp = np.cumsum([r[2] for r in sorted(rows)])
        precision, recall = tp / np.arange(1, len(tp) + 1), tp / npos
        return np.mean([max(precision[recall >= level], default=0.0) for level in np.linspace(0, 1, 101)])

    def mean(area, limit, thresholds):
        low, high = detection.AREAS[area]
        values = [one(c, low, high, limit, t) for c in sorted({t[1] for t in truth}) for t in thresholds]
        values = [v for v in values if v is not None]
        return round(float(np.mean(values)), 3) if values else 0.0

    ten = detection.THRESHOLDS
    return [mean("all", 100, ten), mean("all", 1000, [0.5]), mean("all", 1000, [0.75]), *[mean(a, 1000, ten) for a in ("small", "medium", "large")]]


def test_average_precision_equals_plain_version(spark):
    """Crowds, ties in score, areas on both sides of the limits, images with more than 100 detections."""
    import random

    rng = random.Random(5)
    truth, found = [], []
    for image in range(40):
        for _ in range(rng.randint(0, 6)):
            w, h = rng.choice(((20, 20), (60, 50), (150, 130))), rng.choice((1.0, 1.5))
            box = (float(rng.randrange(300)), float(rng.randrange(300)), w[0] * h, float(w[1]))
            category = rng.randrange(3)
            truth.append((image, category, box, box[2] * box[3], int(rng.random() < 0.1)))
            for _ in range(rng.randint(0, 3)):
                moved = tuple(v + rng.choice((0, 1, 3, 9)) for v in box)
                found.append((image, rng.choice((category, category, 2)), moved, rng.choice((0.2, 0.5, 0.9, 1.0))))
    found += [(41, 1, (float(i), 5.0, 40.0, 40.0), 0.3) for i in range(130)]
    truth += [(41, 1, (float(i), 5.0, 40.0, 40.0), 1600.0, 0) for i in (50, 128)]
    t = spark.createDataFrame([(i, c, list(b), a, k) for i, c, b, a, k in truth], "image_id long, category_id int, bbox array<double>, area double, iscrowd int")
    d = spark.createDataFrame([(i, c, list(b), s, n) for n, (i, c, b, s) in enumerate(found)], "image_id long, category_id int, bbox array<double>, score double, ord int")
    got = [float(v) for v in detection.average_precision(t, d).first()]
    assert got == pytest.approx(plain_average_precision(truth, found), abs=1.01e-3)


def test_numbers_have_no_gaps_at_size(spark):
    """A million rows, 64 partitions, a wide column: every number once."""
    df = spark.range(0, 1_000_000, 1, 64).select((F.col("id") * 7919 % 1_000_003).alias("k"), F.repeat(F.col("id").cast("string"), 20).alias("wide"))
    spark.conf.set("spark.sql.shuffle.partitions", "64")
    try:
        got = records.numbered(df, "n", ["k"]).cache()
        n, distinct, low, high = got.agg(F.count("*"), F.count_distinct("n"), F.min("n"), F.max("n")).first()
        falls = got.join(got.select((F.col("n") - 1).alias("n"), F.col("k").alias("next")), "n").where("next <= k").count()
        got.unpersist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert (n, distinct, low, high, falls) == (1_000_000, 1_000_000, 1, 1_000_000, 0)


def test_substring_pairs_both_ways(spark, monkeypatch):
    texts = spark.createDataFrame([(1, "see the red house now"), (2, "red houses"), (3, "a cat; b"), (4, None), (1, "see the red house now")], "id long, text string")
    parts = spark.createDataFrame([(10, "the red house"), (11, "cat"), (12, "green old tree"), (13, "he red ho")], "part_id long, part string")
    want = sorted([(1, 10), (1, 10), (1, 13), (1, 13), (3, 11)])
    pairs = lambda: sorted((r.id, r.part_id) for r in evaluation.substring_pairs(texts, parts).collect())
    assert pairs() == want
    monkeypatch.setattr(evaluation, "PART_BYTES", 0)
    assert pairs() == want


def test_best_precision_counts_by_bounded_chunks(spark):
    hit = [(k // 40, 1.0 - k % 7 / 10, k, 1, bytearray([(k + s) % 3 for s in range(len(detection.SLOTS))])) for k in range(100)]
    matched = spark.createDataFrame(hit, "category_id int, score double, image_id long, place int, codes binary")
    positives = spark.createDataFrame([(c, [40, 40, 40, 40]) for c in range(3)], "category_id int, npos array<long>")
    whole, small = (rows(detection.best_precision(matched, positives, chunk), "category_id", "slot", "level") for chunk in (1 << 15, 4))
    assert whole == small and len(whole) > 1000


def test_drawer_hashes_as_draw():
    for seed in ((0, "7"), (3, None), 5):
        draw = grounding.drawer(seed)
        assert all(draw(*keys) == grounding.draw(seed, *keys) for keys in (("size",), ("anchor", 3), ("all", 4, "again", 12)))


def test_second_try_is_made_only_if_needed(monkeypatch):
    """An image of far objects in cells of their own needs no second group anew: few draws."""
    calls, start = [], grounding.drawer

    def counted(seed):
        draw = start(seed)
        return lambda *keys: calls.append(keys) or draw(*keys)

    monkeypatch.setattr(grounding, "drawer", counted)
    objects = [{"obj_id": i, "cx": float(i % 3 * 100 + i), "cy": float(i // 3 * 100), "cell": i % 9} for i in range(90)]
    groups = grounding.plan_groups(objects, 5, (0, "1"))
    assert len(groups) == 5 and not [k for k in calls if "again" in k]


def test_unused_phrases_read_descriptions_once(spark):
    d = spark.createDataFrame([(1, 1, "car", ["car", " red car "]), (1, 1, "car", ["Blue car"]), (1, 2, "car", ["car"]), (1, None, "car", ["red car"]), (2, 1, "car", ["green car"])], "stem int, obj_id int, label string, phrases array<string>")
    captions = spark.createDataFrame([(1, [(1, "RED car")])], "stem int, phrases array<struct<obj_id:int,phrase:string>>")
    found = grounding.unused_phrases(d, captions)
    assert rows(found, "stem", "obj_id") == [(1, 1, "Blue car"), (1, 2, "car"), (2, 1, "green car")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1


def test_locked_phrases_once_by_one_sort(spark):
    kind = "stem long, sentence_id int, phrases array<struct<obj_id:long,phrase:string,keep_source_label:boolean,features:array<string>>>"
    said = [(1, " Red ", None, None), (1, "red", None, ["a", "b", "c"]), (1, "gone", None, None), (1, "gone", True, None), (2, "x", None, None), (None, "x", None, None), (1, None, None, None), (1, "GONE", None, ["f"]), (1, "gone", None, ["g"])]
    captions = spark.createDataFrame([(7, 0, said), (7, None, said[:2]), (8, 0, said)], kind)
    d = spark.createDataFrame([(7, 1, "car", ["RED "])], "stem long, obj_id long, label string, phrases array<string>")
    out = grounding.locked_phrases(captions, d)
    assert out.columns == ["stem", "sentence_id", "obj_id", "keep", "pos", "phrase", "label", "features"]
    rows = sorted((r.sentence_id is None, r.pos, r.keep, r.phrase, r.label, tuple(r.features)) for r in out.collect())
    assert rows == [(False, 0, False, "Red", "car", ()), (False, 3, True, "gone", "car", ()), (False, 7, False, "GONE", "car", ("f",)), (True, 0, False, "Red", "car", ())]
    assert "SortAggregate" not in out._jdf.queryExecution().executedPlan().toString()


def test_phrase_keys_are_made_once(spark):
    rows = [("en", 3, "s", "The red car"), ("en", 1, "s", "red, CAR"), ("en", 2, "t", "of the"), ("en", 4, "t", None), (None, 5, "t", "x"), ("de", 6, "t", "red car")]
    p = spark.createDataFrame(rows, "lang string, place long, source string, phrase string")
    first = grounding.dedup_phrases(p, ["lang"], "place")
    assert {tuple(r) for r in first.collect()} == {("en", "red car", 1, "red, CAR"), (None, "x", 5, "x"), ("de", "red car", 6, "red car")}
    left = grounding.remaining_pool(p, "source", ["lang"], "place")
    assert {tuple(r) for r in left.collect()} == {("en", "s", 1, 1, 0), ("de", "t", 1, 1, 0)}
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(first).count("[^a-z0-9]+") == 1 and plan(left).count("[^a-z0-9]+") == 2


def test_generated_captions_run_no_step_twice(spark):
    """What is returned reads written tables: neither groups nor spans are made again, whatever is asked of it."""
    objects = spark.createDataFrame([(s, i, 10 * i, 10 * i, 10 * i + 8, 10 * i + 8, 640, 480, "car") for s in (1, 2) for i in range(12 * s)], "stem int, obj_id long, x1 long, y1 long, x2 long, y2 long, width long, height long, label string")
    described = objects.select("stem", "obj_id", "label", F.array(F.lit(" Car "), F.lit("red car"), F.concat(F.lit("car no "), F.col("obj_id").cast("string")), F.lit(" ")).alias("phrases"))
    captions, synced = grounding.generate_captions(objects, described)
    for df in (captions, synced):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "MapInArrow" not in plan and "ArrowEvalPython" not in plan and "Window" not in plan
    chosen = captions.select("stem", F.explode(F.arrays_zip("obj_ids", "phrases")).alias("p")).select("stem", "p.*").distinct()
    assert chosen.count() == 2 * 36 and captions.where(F.exists("spans", lambda s: s.isNull())).count() == 0
    assert synced.where("size(phrases) = 4 and size(chosen) = 2 and size(zh) = 4").count() == 36


def test_spans_of_nulls_and_empty_lists(spark):
    df = spark.createDataFrame([(1, "a red car", ["car", None, "boat", " red "]), (2, None, ["x"]), (3, "y", []), (4, "z", None)], "id int, caption string, phrases array<string>")
    assert [(r.caption, r.spans) for r in grounding.with_spans(df).orderBy("id").collect()] == [("a red car", [[6, 9], None, None, [2, 5]]), (None, [None]), ("y", []), ("z", [])]
    assert [r.caption for r in grounding.with_spans(df, complete=True).orderBy("id").collect()] == ["a red car, with boat.", ", with x.", "y", "z"]


def test_strip_takes_the_pattern_s_characters(spark):
    from mmops.functions import text

    ends = [chr(i) for i in [*range(0x300), *range(0x1600, 0x1900), *range(0x1FF0, 0x2070), *range(0x2FF0, 0x3010), 0xFEFF]]
    df = spark.createDataFrame([(e + " \n" + "a b" + "\t" + e,) for e in ends] + [("",), (" 　",), (None,)], "t string")
    old = F.regexp_replace("t", rf"^[{text._SPACE}]+|[{text._SPACE}]+$", "")
    assert df.where(~old.eqNullSafe(text.strip(F.col("t")))).count() == 0


def test_average_precision_matches_once(spark, monkeypatch):
    """Ranges are sampled from written rows, not from the match itself, and no code is shuffled to be summed."""
    from mmops.operators import detection

    plans, ranged = [], detection.ranged
    monkeypatch.setattr(detection, "ranged", lambda df, order: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or ranged(df, order))
    box = [(i, c, [float(j), 0.0, 10.0 + j, 10.0], j) for i in range(5) for c in ("a", "b") for j in range(3)]
    found = spark.createDataFrame(box, "image_id int, category_id string, bbox array<double>, ord int").withColumn("score", F.lit(0.5))
    truth = found.withColumn("area", F.col("bbox")[2] * 10).withColumn("iscrowd", F.lit(0))
    out = detection.average_precision(truth, found)
    assert len(plans) == 1 and "MapInArrow" not in plans[0]
    assert "FlatMapGroupsInPandas" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert out.select("mAP", "mAP_50").first() == (1.0, 1.0)

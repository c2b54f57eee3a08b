"""Hand-made values for the column functions."""

import pytest
from pyspark.sql import functions as F

from mmops.functions import answers, geometry, parsing, sequences, text


@pytest.fixture(scope="module")
def one(spark):
    return spark.range(1)


@pytest.fixture(scope="module")
def value(one):
    def get(*columns):
        row = one.select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first()
        plain = lambda v: {k: plain(x) for k, x in v.asDict().items()} if hasattr(v, "asDict") else [plain(x) for x in v] if isinstance(v, list) else v
        out = [plain(v) for v in row]
        return out[0] if len(out) == 1 else out

    return get


def strings(*v):
    return F.array(*[F.lit(x) for x in v]) if v else F.array().cast("array<string>")


def test_keys(value):
    assert value(*[text.synonym_key(F.lit(x)) for x in ("A person with Hard-Hats", "safety hard hat", "tee shirt and cell phone")]) == ["person helmet", "safety helmet", "shirt phone"]
    assert value(*[text.label_reading(F.lit(x)) for x in ("specialVehicle_2", "", "car3", "__")]) == ["special vehicle 2", "object", "car 3", "__"]
    assert value(text.label_reading(F.lit(None).cast("string"))) == "object"
    assert value(text.fallback_phrases(F.lit("car")), text.fallback_phrases(F.lit("bigCar"))) == [["car", "car object", "car in the scene"], ["bigCar", "big car", "big car in the scene"]]
    assert value(text.axis_tokens(F.lit("a white car with a Hard Hat"))) == ["helmet", "white"]
    assert value(*[text.is_duplicate(F.lit(k), strings("a b")) for k in ("", "a b", "c")]) == [False, True, False]


def test_vehicle_phrases(value):
    assert value(*[text.vehicle_phrase(F.lit(x), F.lit("car")) for x in ("white SUV", "red sedan car", "black", "!!")]) == ["white car", "red car", "black car", ""]
    got = value(text.sanitize_phrases(strings(" white  SUV", "car", "a car", "White car", None, "red", ""), F.lit("car"), F.lit(5)))
    assert got == ["white car", "red car"]
    assert value(text.sanitize_phrases(strings("with a bag", "the person", "bag with"), F.lit("person"), F.lit(1))) == ["with a bag person"]
    assert value(text.fresh_phrases(strings("red hat", "Blue coat", "blue coat", "green bag", "hard hat man"), strings("a red hat"), strings("green"), F.lit(9))) == ["Blue coat", "hard hat man"]


def test_small_text(value):
    assert value(text.without_markup(F.lit("a <ref>b</ref><box>(1,2)</box> c<box>(3"))) == "a b c"
    assert value(text.without_phrase(F.lit("A red car , with a dog, runs."), F.lit("a dog"))) == "A red car, with, runs."
    assert value(text.stem(F.lit("/a/b.c/d.e.jpg")), text.stem(F.lit("x")), text.suffix(F.lit("/a/d.E.JPG"))) == ["d.e", "x", ".jpg"]
    assert value(text.object_key(F.lit("s"), F.lit(7)), text.object_key(F.lit("s"), F.lit(12345)), text.stem_of_object_key(F.lit("a_obj1_obj0002"))) == ["s_obj0007", "s_obj12345", "a_obj1"]
    assert value(text.port_of(F.lit("http://h:8000/v1")), text.port_of(F.lit("http://h/v1"))) == [8000, None]
    assert value(text.count_text(F.lit("<image>a<image><image"), "<image>"), text.is_video(F.lit("A.MP4"))) == [2, True]
    assert value(text.after_thinking(F.lit("a</think>b </think> c\n")), text.after_thinking(F.lit(" x "))) == ["c", "x"]
    assert value(text.template_caption(strings()), text.template_caption(strings("a")), text.template_caption(strings("a", "b", "c"))) == ["", "a.", "a, b and c."]
    assert value(text.first_span(F.lit("é ab ab"), F.lit("ab")), text.first_span(F.lit("x"), F.lit("y")), text.slug(F.lit(" A b! ")), text.slug(F.lit("!"))) == [[2, 4], None, "a_b", "default"]


OPTIONS = {"A": "cat", "B": "dog", "C": "fish", "D": "bird"}


@pytest.mark.parametrize(("said", "letter"), [("(B).", "B"), ("The answer is D", "D"), ("A good choice would be", None), ("A", "A"), ("A or B", None), ("Z", "Z"), ("Cannot determine the answer", "Z"), ("b", None), ("Failed to obtain answer via API B", None)])
def test_infer_option(value, said, letter):
    options = F.create_map(*[F.lit(x) for p in OPTIONS.items() for x in p])
    assert value(answers.infer_option(F.lit(said), options)) == letter


def test_infer_text(value):
    options = F.create_map(*[F.lit(x) for x in ("A", "cat", "B", "dog")])
    assert value(answers.infer_text(F.lit("It is a DOG"), options), answers.infer_text(F.lit("cat and dog"), options)) == ["B", None]
    pairs = [("1/2", "0.5"), (" X ", "x"), ("0.50000001", "0.5"), ("\\frac{1}{4}", "0.25"), ("a", "b"), ("1", "2")]
    assert value(*[answers.answers_equal(F.lit(a), F.lit(b)) for a, b in pairs]) == [True, True, True, True, False, False]
    assert value(answers.truth_letter(F.lit("12.5")), answers.truth_letter(F.lit("C")), answers.letter_of(F.lit(3)), answers.index_of(F.lit("D"))) == ["A", "C", "D", 3]


def doubles(*v):
    return F.array(*[F.lit(float(x)) for x in v])


def test_boxes(value):
    box, h, w = doubles(146, 137, 615, 415), F.lit(428), F.lit(640)
    assert value(geometry.box_to_thousandths(box, h, w), geometry.box_to_resized(box, h, w)) == [[228, 320, 961, 970], [147, 134, 619, 407]]
    assert value(geometry.polygon_area(doubles(0, 0, 4, 0, 4, 3, 0, 3)), geometry.polygon_area(doubles(0, 0, 1, 1))) == [12.0, 0.0]
    assert value(geometry.crop_box(*[F.lit(v) for v in (10, 20, 30, 60, 100, 80)])) == [5, 10, 35, 70]
    cells = [(0, 0), (89, 59), (90, 60), (45, 10)]
    assert value(*[geometry.grid_cell(F.lit(x), F.lit(y), F.lit(90), F.lit(60)) for x, y in cells]) == [0, 8, 8, 1]
    assert value(geometry.grid_to_pixels(doubles(0, 500, 999, 250), F.lit(640), F.lit(480))) == [0, 240, 639, 120]
    a, b, c = ([F.lit(v) for v in x] for x in ((0, 0, 10, 10), (5, 5, 15, 15), (10, 0, 20, 10)))
    assert value(geometry.iou(a, b), geometry.iou(a, c)) == [pytest.approx(25 / 175), 0.0]
    assert value(geometry.bounding_box(F.array(doubles(3, 9), doubles(1, 10)))) == [1.0, 9.0, 3.0, 10.0]
    assert value(geometry.rescale_box(doubles(100, 100, 200, 200), F.lit(50), F.lit(80), F.lit(100), F.lit(160))) == [50.0, 50.0, 100.0, 100.0]


def test_sizes(value):
    size = lambda f, h, w, *a: f(F.lit(h), F.lit(w), *a)
    plain = lambda *p: [value(size(geometry.smart_resize, h, w, *a)) for h, w, *a in p]
    assert plain((1080, 1920), (100, 50), (3000, 4000), (14, 14)) == [{"height": h, "width": w} for h, w in ((1088, 1920), (96, 64), (3008, 4000), (64, 64))]
    assert plain(*[(h, w, 32, 784, 50176) for h, w in ((1080, 1920), (100, 50), (3000, 4000), (14, 14))]) == [{"height": h, "width": w} for h, w in ((160, 288), (64 + 32, 64), (192, 256), (32, 32))]
    assert value(size(geometry.smart_resize_training, 428, 640)) == {"height": 420, "width": 644}
    assert value(size(geometry.smart_resize_detection, 480, 640, 32, 768 * 1024, 12800 * 1024)) == {"height": 768, "width": 1024}
    assert value(size(geometry.smart_resize, 1, 201), size(geometry.smart_resize_training, 27, 100), size(geometry.smart_resize_detection, 1, 5)) == [None, None, None]
    assert value(geometry.thumbnail_size(F.lit(200), F.lit(100), 50), geometry.sheet_place(F.lit(5), F.lit(7), 3)) == [{"width": 50, "height": 25}, {"rows": 3, "row": 1, "column": 2}]


def test_frames(value):
    assert value(*[geometry.frame_count(F.lit(n), F.lit(float(f))) for n, f in ((300, 30), (10, 30), (100000, 25), (3, 30), (1, 30))]) == [20, 4, 768, 2, None]
    assert value(geometry.frame_range(F.lit(300), F.lit(29.97), F.lit(1.0), F.lit(2.5))) == {"start": 30, "end": 74, "count": 45}
    nothing = F.lit(None).cast("double")
    assert value(geometry.frame_range(F.lit(10), F.lit(5.0), nothing, nothing), geometry.frame_range(F.lit(10), F.lit(5.0), F.lit(1.9), F.lit(1.0))) == [{"start": 0, "end": 9, "count": 10}, None]
    assert value(geometry.spaced_indices(F.lit(0.0), F.lit(299.0), F.lit(5)), geometry.packing_indices(F.lit(300), F.lit(30.0), 2.0, 5, 9)) == [[0, 75, 150, 224, 299], [0, 74, 149, 224, 299]]
    names = value(geometry.frame_names(F.lit(1228), 0.25, "%d"))
    assert names[:2] == ["0", "4"] and names[-1] == "1224" and len(names) == 307
    assert value(geometry.pseudo_camera(F.lit(640), F.lit(480)))["fx"] == 554.26


def test_projection(value):
    corners = value(geometry.project_box(doubles(0, 0, 10, 2, 2, 2, 0, 0, 0), F.lit(500.0), F.lit(500.0), F.lit(320.0), F.lit(240.0)))
    assert corners[0] == pytest.approx([365.4545, 285.4545], abs=1e-3) and corners[1] == pytest.approx([375.5556, 295.5556], abs=1e-3) and len(corners) == 8
    edges = value(geometry.box_edges(geometry.project_box(doubles(0, 0, 10, 2, 2, 2, 0, 0, 0), F.lit(500.0), F.lit(500.0), F.lit(320.0), F.lit(240.0))))
    assert len(edges) == 12 and {"from": [365, 285], "to": [375, 295]} in edges
    assert value(F.size(geometry.project_box(doubles(0, 0, 0, 2, 2, 2, 0, 0, 0), F.lit(1.0), F.lit(1.0), F.lit(0.0), F.lit(0.0)))) == 4


def turns(*pairs):
    return F.array(*[F.struct(F.lit(r).alias("from"), F.lit(v).alias("value")) for r, v in pairs])


def test_conversations(value):
    got = value(sequences.without_later_images(turns(("human", "<image>\nQ1"), ("gpt", "x"), ("human", "Q2\n<image>\nmore"))))
    assert [t["value"] for t in got] == ["<image>\nQ1", "x", "Q2\nmore"]
    one = turns(("human", "<image>\n a <image>"), ("gpt", " b "))
    two = value(sequences.media_messages(one, strings("p", "q"), strings()))
    assert two["error"] is None and two["messages"] == [{"role": "user", "content": [{"type": "image", "value": "p"}, {"type": "text", "value": "a"}, {"type": "image", "value": "q"}]}, {"role": "assistant", "content": [{"type": "text", "value": " b "}]}]
    assert value(sequences.media_messages(one, strings("p"), strings()))["error"] == "more marks than media"
    assert value(sequences.media_messages(one, strings("p", "q", "r"), strings()))["error"] == "unused media"


def longs(*v):
    return F.array(*[F.lit(x).cast("long") for x in v])


def test_masks(value):
    ids = (1, 77091, 198, 5, 6, 151645, 198, 2, 77091, 198, 7)
    assert value(sequences.label_mask(longs(*ids))) == [-100, -100, -100, 5, 6, 151645, 198, -100, -100, -100, -100]
    assert value(sequences.label_mask(longs(77091, 1, 9, 151645))) == [-100, -100, 9, 151645]
    assert value(sequences.pad(longs(1, 2), F.lit(4), 0), sequences.pad(longs(1, 2, 3), F.lit(2), 0), sequences.cumulative_lengths(longs(3, 4))) == [[1, 2, 0, 0], [1, 2], [0, 3, 7]]
    assert value(sequences.jaccard(longs(1, 2, 3), longs(2, 3, 4)), sequences.jaccard(F.array().cast("array<long>"), longs(1))) == [0.5, 0.0]
    assert value(sequences.padded_translations(strings("x"), strings("a", "b"))) == ["x", ""]


def test_parsing(value):
    get = lambda t: parsing.json_object_text(F.lit(t))
    assert value(get('<think>{"x":1}</think> {"a":2}'), get('```json\n{"a": 3}\n```'), get('say {"a":4} ok'), get("none"), get("")) == ['{"a":2}', '{"a": 3}', '{"a":4}', None, None]
    assert value(parsing.fenced_json(F.lit("x ```json {\"a\":1} ``` y"))) == {"json": '{"a":1}', "raw_text": None, "parse_error": False}
    assert value(parsing.fenced_json(F.lit(" no "))) == {"json": None, "raw_text": "no", "parse_error": True}
    assert value(parsing.boxes_3d(F.lit('it is [{"bbox_3d":[1,2],"label":"c"}] .')), parsing.boxes_3d(F.lit("none"))) == [[{"label": "c", "bbox_3d": [1.0, 2.0]}], []]
    assert value(parsing.boxes_3d(F.lit('```json\n{"bbox_3d":[1],"label":"c"}\n```'))) == [{"label": "c", "bbox_3d": [1.0]}]
    assert [p["label"] for p in value(parsing.points_2d(F.lit('[{"point_2d":[1,2]},{"x":1},{"point_2d":[3,4],"label":"b"}]')))] == ["point_1", "b"]
    marks = "<|object_ref_start|>{}<|object_ref_end|><|box_start|>{}<|box_end|>"
    said = marks.format("car", "<1><2><3><4>,<5><6><7><8>") + marks.format("bus", "none") + marks.format("x", "<1><2>")
    assert value(parsing.grid_boxes(F.lit(said))) == [{"label": "car", "grid": [1, 2, 3, 4]}, {"label": "car", "grid": [5, 6, 7, 8]}]
    assert value(parsing.last_code_block(F.lit("```python\na\n```\n```python\nb\n```")), parsing.last_code_block(F.lit("x"))) == ["b\n", None]
    assert value(parsing.tool_call(F.lit('<tool_call>{"name":"m","arguments":{"action":"click"}}</tool_call>'))) == {"name": "m", "arguments": '{"action":"click"}'}
    assert value(parsing.to_list(F.lit("['a', 'b']")), parsing.to_list(F.lit("x")), parsing.to_list(F.lit(None).cast("string"))) == [["a", "b"], ["x"], []]
    assert value(parsing.action_problem(F.lit('{"action":"swipe","coordinate":[1,2]}')), parsing.action_problem(F.lit('{"action":"wait","time":1}'))) == ["swipe needs coordinate2", None]
    assert value(parsing.first_code(F.lit("a <code>x</code>")), parsing.media_kind(F.lit("data:image/png;base64,aGk=")), parsing.data_url_bytes(F.lit("data:image/png;base64,aGk="))) == ["x", "data", bytearray(b"hi")]


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_values_are_computed_once(spark):
    """An expression that is read many times stands in the plan once."""
    rows = spark.range(1).select(F.concat(F.lit("mark"), F.col("id").cast("string")).alias("t"), F.array(*[F.col("id") * 1.5] * 9).alias("b"))
    assert _plan(rows.select(parsing.points_2d(F.reverse("t")).alias("x"))).count("reverse(") == 1
    assert _plan(rows.select(geometry.polygon_area(F.reverse("b")).alias("x"))).count("reverse(") == 1
    turned = _plan(rows.select(geometry.project_box(F.reverse("b"), *[F.lit(1.0)] * 4).alias("x")))
    assert turned.count("reverse(") == 1 and turned.count("COS(") == 3


def test_fresh_phrases_read_each_phrase_once(spark):
    """Keys are computed once for a phrase, whatever uses them, and the rows of a small file are dealt out."""
    phrases, avoid, locked = (F.col(c) for c in ("p", "a", "l"))
    df = spark.createDataFrame([(["The big door", "helmet", "big  door", None, "red van"], ["hard hat"], ["a red truck"])], "p array<string>, a array<string>, l array<string>")
    out = df.select(text.fresh_phrases(phrases, avoid, locked, F.lit(9)).alias("x"))
    assert out.first().x == ["The big door"]
    assert out._jdf.queryExecution().optimizedPlan().toString().count("[^a-z0-9]+") <= 4  # phrases, avoided twice, locked
    import __spark_entry__

    assert __spark_entry__.queries()["fresh_phrases"](spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism

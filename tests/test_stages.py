"""Completion, plug-ins and incremental validation on odd rows."""

import pytest

from pyspark.sql import functions as F

from mmops.functions import text
from mmops.operators import completion, incremental, plugins


def test_completion_of_odd_rows(spark):
    rows = [("a", 0, "Big_Car", ["red one", "Red ONE", None, " "]), ("a", 1, "big car", ["the blue one"]), ("a", 2, "big car", None), ("a", 3, "dog", ["brown"]), (None, 4, "dog", ["x y"]), (None, 5, "dog", [])]
    df = spark.createDataFrame(rows, "stem string, obj_id int, label string, phrases array<string>")
    seen = []
    done = {r.obj_id: (r.stem, r.phrases, r.exhaustive_added) for r in completion.complete_phrases(df, lambda asked: [c[::-1] for _, _, c in asked]).collect()}
    assert done[0] == ("a", ["red one", "Red ONE", "the blue one"], ["the blue one"])
    assert done[1] == ("a", ["the blue one", "red one"], ["red one"])
    assert done[2] == ("a", ["red one", "the blue one"], ["red one", "the blue one"])  # in the pool's order
    assert done[3] == ("a", ["brown"], []) and done[5] == (None, ["x y"], ["x y"]) and not seen
    assert all(r.exhaustive_added == [] for r in completion.complete_phrases(df, None).collect())
    assert completion.complete_phrases(df.limit(0), None).collect() == []


def test_bitmaps():
    pool, masks = completion.class_pools([[("A b", "a b"), ("x", ""), ("c", "c")], [("B", "b"), ("a B", "a b")], []])
    assert pool == ["A b", "c", "B"] and masks == [0b011, 0b101, 0]
    assert [completion.remaining(pool, m) for m in masks] == [["B"], ["c"], pool]


def test_plugins_keep_errors_to_their_rows(spark):
    def short(rows):
        return [["one"]] * (len(rows) - 1) if len(rows) > 1 else [["alone"]]

    def failing(rows):
        if (rows["n"] == 3).any():
            raise KeyError("three")
        return [[str(n)] for n in rows["n"]]

    registry = plugins.Registry(lambda rows: [["plain"]] * len(rows)).register("A b", short).register("bad", failing)
    df = spark.createDataFrame([(n, s, "old", "x") for n, s in enumerate([None, "", "a-B", "A  B!", "BAD", "bad", "nobody"])], "n int, scene string, phrases string, engine string")
    found = plugins.describe(df, registry)
    assert found.columns == ["n", "scene", "engine", "phrases", "error"]
    got = {r.n: (r.engine, r.phrases, r.error) for r in found.coalesce(1).collect()}
    assert got[0] == got[1] == got[6] == ("default", ["plain"], None)
    assert got[2][:2] in (("a_b", ["alone"]), ("a_b", ["one"])) and got[3][0] == "a_b"
    assert got[4] == ("bad", ["4"], None) and got[5] == ("bad", ["5"], None)
    three = plugins.describe(spark.createDataFrame([(3, "bad"), (4, "bad")], "n int, scene string").coalesce(1), registry)
    assert {r.n: (r.phrases, r.error) for r in three.collect()} == {3: (None, "KeyError: 'three'"), 4: (["4"], None)}
    assert [registry.resolve(s)[0] for s in (None, "a-b", "zzz")] == ["default", "a_b", "default"]
    assert plugins.describe(df.limit(0), registry).collect() == []


def test_validation_scans_what_changed(spark, tmp_path):
    listing = lambda rows: spark.createDataFrame(rows, "folder string, name string, size long, mtime long")
    shapes = spark.createDataFrame([("a", "1", "rectangle"), ("a", "2", "Polygon "), ("b", "1", "line")], "folder string, file string, shape_type string")
    asked = []

    def scan(folders):
        asked.append(sorted(r.folder for r in folders.collect()))
        return shapes.join(folders, "folder", "left_semi")

    state = incremental.ValidationState(spark, f"file://{tmp_path}/state")
    files = [("a", "1", 5, 10), ("a", "2", 5, 10), ("b", "1", 5, 10), ("c", "1", 5, None)]
    rows = lambda df: {r.folder: (r.tier, r.n_json, r.n_shapes, r.geometry) for r in df.collect()}
    first = rows(incremental.validate(listing(files), scan, state))
    assert first == {"a": ("scan", 2, 2, "mixed"), "b": ("scan", 1, 1, None), "c": ("scan", 0, 0, None)}
    second = rows(incremental.validate(listing([*files[:2], ("b", "1", 6, 10), ("d", "1", 1, 1)]), scan, state))
    assert {k: v[0] for k, v in second.items()} == {"a": "signature", "b": "scan", "d": "scan"} and second["a"][1:] == first["a"][1:]
    assert rows(incremental.validate(listing(files[:1]), scan, state, force=True))["a"][0] == "scan"
    assert asked == [["a", "b", "c"], ["b", "d"], ["a"]]
    assert incremental.total(state.read()).first().n_shapes == 2
    assert incremental.validate(listing([]), scan, state).collect() == []
    drafts = spark.createDataFrame([("e", "polygon", 4, 4, 0), ("f", "polygon", 3, 4, 9)], "folder string, geometry string, n_objects int, n_labels int, n_images int")
    third = rows(incremental.validate(listing([("e", "1", 1, 1), ("f", "1", 1, 1)]), scan, state, drafts))
    assert third["e"] == ("draft", 0, 0, "polygon") and third["f"][0] == "scan"


def test_a_run_that_dies_leaves_the_last_state(spark, tmp_path):
    state = incremental.ValidationState(spark, f"file://{tmp_path}/state")
    files = spark.createDataFrame([("a", "1", 5, 10)], "folder string, name string, size long, mtime long")
    shapes = spark.createDataFrame([("a", "1", "rectangle")], "folder string, file string, shape_type string")
    incremental.validate(files, lambda f: shapes.join(f, "folder", "left_semi"), state)
    with pytest.raises(Exception, match="boom"):
        incremental.validate(files.withColumn("size", files["size"] + 1), lambda f: shapes.join(f, "folder", "left_semi").selectExpr("folder", "file", "raise_error('boom') AS shape_type"), state)
    assert [r.tier for r in incremental.validate(files, lambda f: shapes.limit(0), state).collect()] == ["signature"]


def test_validation_scans_by_a_written_list_of_folders(spark, tmp_path):
    """The folders to scan are read from a table, not from the listing once more, and few of them don't make the shapes shuffle."""
    files = spark.createDataFrame([("a", "1", 5, 10), ("b", "1", 5, 10)], "folder string, name string, size long, mtime long")
    shapes = spark.createDataFrame([("a", "1", "rectangle"), ("b", "1", "polygon")], "folder string, file string, shape_type string")
    plans = []

    def scan(folders):
        plans.append(folders._jdf.queryExecution().analyzed().toString())
        return shapes.join(folders, "folder", "left_semi")

    done = incremental.validate(files, scan, incremental.ValidationState(spark, f"file://{tmp_path}/state"))
    assert {(r.folder, r.geometry) for r in done.collect()} == {("a", "rectangle"), ("b", "polygon")}
    assert "broadcast" in plans[0] and "Aggregate" not in plans[0]


def test_completion_reads_nested_batches_flat(spark, monkeypatch):
    kind = "stem string, obj_id int, label string, phrases array<string>"
    rows = [(f"s{k}", i, "A_b" if i % 2 else "a b", [f"p {i % 3}", None, " \n", "", "é x"] if i % 4 else None) for k in range(5) for i in range(7)]
    monkeypatch.setattr(completion.pd, "Series", None) if hasattr(completion, "pd") else None  # no pandas value for each nested row
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        out = completion.complete_phrases(spark.createDataFrame(rows, kind), lambda asked: [c for _, _, c in asked])
        found = {(r.stem, r.obj_id): (r.label, r.phrases, r.exhaustive_added) for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    pool = ["p 1", "é x", "p 2", "p 0"]  # in the order of obj_id; 0 and 4 have none
    for stem, i, label, phrases in rows:
        own = [f"p {i % 3}", "é x"] if phrases else []
        more = [p for p in pool if p not in own]
        assert found.pop((stem, i)) == (label, own + more, more)
    assert not found
    blank = spark.createDataFrame([(" \x1c\n\x85 ",), ("",), (" a ",), (None,)], "t string").select(text.has_text(F.col("t")).alias("x"))
    assert [r.x for r in blank.collect()] == [False, False, True, None]

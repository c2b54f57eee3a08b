"""Substring joins against ``in``, for parts of any length, held by the tasks and not."""

import random

import pytest

from mmops.operators import substrings

TEXTS = [(1, "the quick brown fox jumps over the lazy dog"), (2, None), (3, ""), (4, "日本語のテキスト with 中文字 and 😀😀😀"), (5, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (5, "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa"), (6, "long words " * 5000 + "the end of it"), (None, "the end of it")]
PARTS = [(1, "quick brown"), (2, "a"), (3, ""), (4, None), (5, "x"), (6, "の"), (7, "テキスト with 中文字"), (8, "😀😀"), (9, "aaaaaaaa"), (10, "aaaaaaaaab"), (11, "the end of it"), (12, "ds long words long"), (12, "ds long words long"), (13, "zebra"), (14, "fox jumps"), (15, "lazy dog"), (16, "lazy dogs")]


def wanted(texts, parts):
    return sorted(((i, j) for i, t in texts for j, p in parts if t is not None and p is not None and p in t), key=str)


@pytest.mark.parametrize("part_bytes", [substrings.PART_BYTES, 0])
def test_odd_parts(spark, part_bytes, monkeypatch):
    texts = spark.createDataFrame([(*t, "n") for t in TEXTS], "id long, text string, gram string")
    parts = spark.createDataFrame([(*p, "n") for p in PARTS], "part_id long, part string, place string")
    for few, block in ((64, substrings.BLOCK_BYTES), (0, 40)):
        monkeypatch.setattr(substrings, "FEW", few)
        monkeypatch.setattr(substrings, "BLOCK_BYTES", block)
        found = substrings.substring_pairs(texts, parts, part_bytes=part_bytes)
        assert found.columns == ["id", "text", "gram", "part_id", "part", "place"]
        assert sorted(((r.id, r.part_id) for r in found.collect()), key=str) == wanted(TEXTS, PARTS)
    assert substrings.substring_pairs(texts.limit(0), parts, part_bytes=part_bytes).collect() == []
    assert substrings.substring_pairs(texts, parts.limit(0), part_bytes=part_bytes).collect() == []


@pytest.mark.parametrize("part_bytes", [substrings.PART_BYTES, 0])
def test_many_parts(spark, part_bytes):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcde") for _ in range(rng.randrange(1, 6)))
    texts = [(i, " ".join(word() for _ in range(rng.randrange(60)))) for i in range(120)]
    cut = lambda t: t[(at := rng.randrange(len(t) or 1)) : at + rng.randrange(1, 30)]
    parts = [(j, rng.choice([cut(rng.choice(texts)[1]), word(), word() + " " + word() + " " + word()])) for j in range(300)]
    found = substrings.substring_pairs(spark.createDataFrame(texts, "id long, text string"), spark.createDataFrame(parts, "part_id long, part string"), part_bytes=part_bytes)
    assert sorted(((r.id, r.part_id) for r in found.collect()), key=str) == wanted(texts, parts)


def test_plan_has_no_nested_loop(spark):
    texts = spark.createDataFrame(TEXTS, "id long, text string")
    parts = spark.createDataFrame(PARTS, "part_id long, part string")
    for part_bytes in (substrings.PART_BYTES, 0):
        plan = substrings.substring_pairs(texts, parts, part_bytes=part_bytes)._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_pairs_leave_a_task_in_bounded_batches():
    import pyarrow as pa

    texts = ["a" * 1000] * 300 + ["b" * 1_000_000, None]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "text": texts})
    pids = [bytes([i]) for i in range(250)]
    with_text = list(substrings.pair_batches(batch, 1, ["id", "text"], lambda t: pids))
    ids_only = list(substrings.pair_batches(batch, 1, ["id"], lambda t: pids))
    for out in (with_text, ids_only):
        assert [x for b in out for x in b.column(0).to_pylist()] == [i for i in range(301) for _ in pids]
    assert max(b.nbytes for b in with_text) < 2 * substrings.OUT_BYTES and max(b.num_rows for b in ids_only) <= substrings.OUT_ROWS


def test_kept_columns_only(spark):
    texts, parts = spark.createDataFrame(TEXTS, "id long, text string"), spark.createDataFrame(PARTS, "part_id long, part string")
    for part_bytes in (substrings.PART_BYTES, 0):
        found = substrings.substring_pairs(texts, parts, part_bytes=part_bytes, keep=["id"])
        assert found.columns == ["id", "part_id", "part"] and sorted(((r.id, r.part_id) for r in found.collect()), key=str) == wanted(TEXTS, PARTS)

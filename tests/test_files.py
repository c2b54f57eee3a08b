"""The data source of small files: all or none, partitions by bytes, pushed filters."""

import os

import pytest
from pyspark.sql import functions as F

from mmops.sources import files


def test_round_trip(spark, tmp_path):
    df = spark.range(3000).select(F.concat(F.col("id").cast("string"), F.lit(".TXT")).alias("name"), F.concat(F.lit("é "), F.col("id").cast("string")).alias("content"), F.lit("x").alias("size"))
    folder = str(tmp_path / "out")
    assert files.export_files(df, folder) == 3000
    found = files.read_files(spark, folder)
    assert found.rdd.getNumPartitions() > 5
    assert {(r.name, r.stem, r.suffix, r.content) for r in found.collect()} == {(f"{i}.TXT", str(i), ".txt", f"é {i}") for i in range(3000)}
    some = found.where(F.col("stem").isin("7", "8", "x")).select("content")
    assert sorted(r.content for r in some.collect()) == ["é 7", "é 8"] and some.rdd.getNumPartitions() == 1
    assert files.export_files(df, folder, limit=5) == 5 and len([n for n in os.listdir(folder) if n[0] != "_"]) == 5
    assert files.export_files(df.limit(0), folder) == 0 and files.read_files(spark, folder).collect() == []
    assert sorted(os.listdir(tmp_path)) == ["out"]


def test_failed_export_leaves_nothing(spark, tmp_path):
    good = spark.createDataFrame([("a.txt", "1"), ("b.txt", None)], "name string, content string")
    folder = str(tmp_path / "out")
    assert files.export_files(good, folder) == 2
    for bad in ("x/y", "", None):
        with pytest.raises(Exception, match="no file name"):
            files.export_files(good.unionByName(spark.createDataFrame([(bad, "2")], "name string, content string")), folder)
        assert sorted(os.listdir(tmp_path)) == ["out"] and sorted(os.listdir(folder)) == ["_SUCCESS", "a.txt", "b.txt"]
    with pytest.raises(Exception, match="out"):
        good.write.format("small_files").mode("append").save(folder)
    assert sorted(os.listdir(folder)) == ["_SUCCESS", "a.txt", "b.txt"]


def test_large_folders_have_few_partitions(tmp_path, monkeypatch):
    for i in range(300):
        (tmp_path / f"{i}.b.txt").write_text("x")
    monkeypatch.setattr(files, "PART_BYTES", 2 * files.OPEN_BYTES)
    monkeypatch.setattr(files, "PARTS", 10, raising=False)
    reader = files.SmallFileReader(str(tmp_path))
    parts = reader.partitions()
    assert 10 <= len(parts) <= 11 and sorted(f[0] for p in parts for f in p.files) == sorted(f"{i}.b.txt" for i in range(300))
    rows = [r for p in parts for b in reader.read(p) for r in b.to_pylist()]
    assert {(r["name"], r["stem"], r["suffix"], r["size"], r["content"]) for r in rows} == {(f"{i}.b.txt", f"{i}.b", ".txt", 1, "x") for i in range(300)}


def test_texts_are_parsed_once(spark):
    from mmops.sources import readers

    out = spark.createDataFrame([("1:2:3,4 --> 100:00:01.5 x\n a \n\nno cue\n\n0:0:1,2-->0:0:2,3",), ("",), (None,)], "t string")
    cues = out.select(readers.subtitles(F.col("t")).alias("c"))
    assert [[tuple(c) for c in r.c] if r.c is not None else None for r in cues.collect()] == [[(3_723_004, 360_001_005, "a"), (1002, 2003, "")], [], None]
    lines = spark.createDataFrame([("3 .5 .5 1 0 0 1",), ("3 .5 .5 1 0 0",), ("3 .5 .5 1 0 x 1",), ("",), (None,)], "t string").select(readers.yolo_segment(F.col("t"), F.lit(10), F.lit(20)).alias("s"))
    assert [tuple(r.s) if r.s else None for r in lines.collect()] == [(3, [5.0, 10.0, 10.0, 0.0, 0.0, 20.0]), None, None, None, None]
    plan = lambda df: df._jdf.queryExecution().optimizedPlan().toString()
    assert plan(cues).count("-->") <= 2 and plan(lines).count("split(") == 1


def test_listing_holds_few_bytes_a_file(tmp_path):
    """The driver holds compressed blocks of names, and neither Arrow's nor Python's objects for each file."""
    import pickle
    import tracemalloc

    for i in range(20_000):
        (tmp_path / f"{i}.json").write_bytes(b"x")
    reader = files.SmallFileReader(str(tmp_path))
    tracemalloc.start()
    parts = reader.partitions()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * 20_000 and len(pickle.dumps(parts)) < 16 * 20_000
    assert sorted(f[0] for p in parts for f in p.files) == sorted(f"{i}.json" for i in range(20_000))


def test_late_task_makes_no_folder_of_a_failed_export(tmp_path):
    import pyarrow as pa

    writer = files.SmallFileWriter(str(tmp_path / "out"), ["name", "content"], True)
    writer.abort([])
    with pytest.raises(OSError):
        writer.write([pa.RecordBatch.from_pydict({"name": ["a.txt"], "content": ["1"]})])
    assert os.listdir(tmp_path) == []

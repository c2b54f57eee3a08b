"""Refreshes of captions."""

from pyspark.sql import functions as F

from mmops.operators import drafts

_CAPTIONS = "stem string, sentence_id int, obj_ids array<long>, caption string, phrases array<struct<obj_id:long,phrase:string>>, spans array<array<int>>"
_REQUESTS = f"stem string, sentence_id int, phrases {drafts.CHOSEN}"


def _described(spark):
    rows = [("a", 0, "car", ["red car one", "blue car"]), ("a", 1, "dog", ["brown dog"]), ("b", 0, "cat", ["old cat"])]
    return spark.createDataFrame(rows, "stem string, obj_id long, label string, phrases array<string>")


def test_refresh_reads_descriptions_only_for_captions_without_phrases(spark):
    captions = spark.createDataFrame([("a", 3, [0], "old", [(0, "red car one")], []), ("b", 1, [0], "old", [(0, "old cat")], [])], _CAPTIONS)
    requests = spark.createDataFrame([("a", 3, None)], _REQUESTS)
    unread = _described(spark).withColumn("phrases", F.when(F.col("obj_id") >= 0, F.raise_error(F.lit("read")).cast("array<string>")))
    done = {(r.stem, r.sentence_id): r.caption for r in drafts.refresh_captions(captions, requests, unread).collect()}
    assert done == {("a", 0): "red car one.", ("b", 0): "old"}


def test_refresh_draws_for_captions_without_phrases(spark):
    captions = spark.createDataFrame([("a", 0, [0], "old", [(0, "red car one")], []), ("a", 1, [0, 1], "old", None, []), ("b", 0, [0], "old", None, []), ("b", 1, [0], "old", None, [])], _CAPTIONS)
    requests = spark.createDataFrame([("a", 1, None), ("b", 0, [(0, "my cat")]), ("b", 1, [])], _REQUESTS)
    done = {(r.stem, r.sentence_id): (r.caption, [p.phrase for p in r.phrases]) for r in drafts.refresh_captions(captions, requests, _described(spark)).collect()}
    assert done == {("a", 0): ("old", ["red car one"]), ("a", 1): ("blue car and brown dog.", ["blue car", "brown dog"]), ("b", 0): ("my cat.", ["my cat"]), ("b", 1): ("", [])}

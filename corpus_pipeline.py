"""The corpus pipeline: language ID, near-dedup, decontamination, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes as Parquet and
reads again as the next stage's docs. All but the last return the columns of documents.

* language: what language ID rejects goes (null texts, texts without letters, scores under the calibrated threshold).
* near_duplicates: of each group of near duplicates the document of the smallest id stays.
* decontaminate: documents in which a benchmark window occurs go.
* secrets: every secret span is replaced by a mark; the document stays.
* pack: what is left is packed into sequences; a row per piece.

Near-dedup and decontamination write their input with an id for each row and decide by that id, so rows that share
a doc_id, or whose doc_id is null, are decided one by one. In near-dedup the order is that of doc_id, nulls
last, then of the rows: one row of each group stays. Rows without words are near to nothing and stay. Other columns of
documents go along as they are, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mmops.llm import decontam, langid, minhash, packing, secrets
from mmops.llm.common import Scratch, as_one, bounded_broadcast, read_table

def _with_rows(docs: DataFrame, name: str) -> DataFrame:
    """(row, doc): an id for each row, and all its columns as one. A written table, as the ids of a lazy one may change when it is read again."""
    return Scratch(docs.sparkSession, name).table(docs.select(F.monotonically_increasing_id().alias("row"), as_one(docs)), "keyed", keep=True)


def _without(keyed: DataFrame, bad: DataFrame) -> DataFrame:
    """The documents of :func:`_with_rows` without the rows of ``bad``."""
    return keyed.join(bounded_broadcast(bad, bad.count(), 40), "row", "left_anti").select("doc.*")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = langid.fit(docs, ~langid.is_held_out())
    judged = langid.predict(docs.select(as_one(docs), "text"), model)
    return judged.where(~F.col("rejected")).select("doc.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _with_rows(docs, "near_duplicates")
    # Orders as doc_id does, nulls last, and is another for each row.
    order = F.struct(F.col("doc.doc_id").isNull().alias("missing"), F.col("doc.doc_id").alias("id"), F.col("row").alias("row"))
    found = minhash.near_duplicates(keyed.select(order.alias("place"), "doc.text"), "place")
    return _without(keyed, found.where(~F.col("kept")).select("place.row"))


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    keyed = _with_rows(docs, "decontaminate")
    found = decontam.contamination(keyed.select("row", "doc.text"), read_table(spark, sf_dir, "benchmark"), "row")
    return _without(keyed, found.where("contaminated").select("row"))


def scan_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return secrets.redact(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(docs)


STAGES = [("language", language), ("near_duplicates", near_duplicates), ("decontaminate", decontaminate), ("secrets", scan_secrets), ("pack", pack)]

#: SQL can express neither the trained classifier nor the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = scratch.table(stage(spark, docs, sf_dir), name, keep=True)
    return docs

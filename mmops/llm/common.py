"""Shared helpers: scratch tables in the shared folder, bounded training samples, and reading a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, bounded_broadcast, shared_dir

__all__ = ["Scratch", "as_one", "bounded_broadcast", "bounded_sample", "field", "read_table", "shared_dir"]


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field(name: str) -> Column:
    """The column of this very name, whatever characters it has."""
    return F.col("`" + name.replace("`", "``") + "`")


def as_one(df: DataFrame, name: str = "doc") -> Column:
    """All columns as one struct, so that columns added beside it clash with none; ``doc.*`` has them back."""
    return F.struct(*[field(c) for c in df.columns]).alias(name)


def bounded_sample(rows: DataFrame, most_rows: int, most_bytes: int) -> list[Row]:
    """Rows (k, t and others) for training on the driver: at most so many, and so many bytes of text t in all.

    In the order of a hash of the text, then k, so that every run takes the same rows; of rows with one k and text the least. Only keys and sizes
    are sorted; a text that would exceed the bytes is passed over, whole.
    """
    keyed = rows.withColumn("h", F.xxhash64("t", F.lit(41)))
    keys = keyed.select("k", "h", F.coalesce(F.octet_length("t"), F.lit(0)).alias("size")).distinct().orderBy("h", "k", "size").limit(most_rows).collect()
    chosen, size = [], 0
    for r in keys:
        if size + r["size"] <= most_bytes:
            size += r["size"]
            chosen.append((r.k, r.h))
    kind = rows.schema["k"].dataType.simpleString()
    wanted = rows.sparkSession.createDataFrame(chosen, f"wk {kind}, wh long").hint("broadcast")  # most_rows at most
    found = keyed.join(wanted, F.col("k").eqNullSafe(F.col("wk")) & (F.col("h") == F.col("wh")))
    found = found.groupBy("k", "h").agg(F.min(F.struct(*[c for c in rows.columns if c != "k"])).alias("r")).select("k", "r.*").collect()
    return sorted(found, key=lambda r: (r.k is None, r.k, r.t or ""))

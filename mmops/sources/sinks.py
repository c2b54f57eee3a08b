"""Writers: JSON lines, CSV and TSV results, one document per key."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import excel_clean


def write_jsonl(df: DataFrame, path: str, nulls: bool = True) -> None:
    """O-OUT-01 and O-OUT-02: a directory of JSON-lines files, UTF-8, a file a task."""
    df.write.mode("overwrite").option("ignoreNullFields", not nulls).json(path)


def write_split(checked: DataFrame, path: str) -> None:
    """O-OUT-04: valid and problem records side by side."""
    checked.write.mode("overwrite").partitionBy("is_valid").json(path)


def clean_text_columns(df: DataFrame) -> DataFrame:
    """O-OUT-07 and E-03: control characters out of every text column."""
    return df.withColumns({f.name: excel_clean(F.col(f.name)) for f in df.schema if f.dataType.typeName() == "string"})


def write_table(df: DataFrame, path: str, sep: str = ",") -> None:
    """O-OUT-05 and O-OUT-06: CSV or TSV with a header."""
    clean_text_columns(df).write.mode("overwrite").option("escape", '"').csv(path, sep=sep, header=True)


def write_by_key(df: DataFrame, path: str, key: str) -> None:
    """O-OUT-09: a directory of JSON per key value; rows of one key go to few tasks first."""
    df.repartition(key).write.mode("overwrite").partitionBy(key).json(path)


def detection_results(found: DataFrame) -> DataFrame:
    """O-OUT-08: a JSON text per detection in the COCO results form."""
    return found.select(F.to_json(F.struct("image_id", "category_id", "bbox", "score")).alias("value"))


def write_manifest(path: str, annotation_path: str, data_path: str, **extra) -> None:
    """O-OUT-03: a YAML manifest beside a data set; on the driver, as it describes and holds no rows."""
    with open(path, "w", encoding="utf-8") as f:
        for k, v in {"annotation_path": annotation_path, "data_path": data_path, **extra}.items():
            f.write(f"{k}: {json.dumps(v, ensure_ascii=False)}\n")

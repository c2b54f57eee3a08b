"""Written tables in the shared folder, and broadcasts behind a size check."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``. Where it is unset: on a local master a temporary folder, as driver and
    tasks are one process; on a cluster the warehouse, unless that is a folder of one machine: then it is an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base:
        return base.rstrip("/")
    if not re.match(r"local(\[|$)", spark.sparkContext.master):
        warehouse = spark.conf.get("spark.sql.warehouse.dir").rstrip("/")
        if re.match(r"(file:|/)", warehouse) and not re.match("local-cluster", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir: the warehouse is a folder of each machine's own")
        return warehouse
    if "dir" not in _OWN:
        _OWN["dir"] = tempfile.mkdtemp(prefix="mmops-")
        _delete_at_end(spark, "file://" + _OWN["dir"])
    return "file://" + _OWN["dir"]


def _path(spark: SparkSession, path: str):
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(conf)


def _delete_at_end(spark: SparkSession, path: str) -> None:
    p, filesystem = _path(spark, path)
    filesystem.deleteOnExit(p)


class Scratch:
    """Written tables that cut the lineage; a lost executor costs nothing that was written.

    ``keep=True`` marks a table that the returned, lazy result still reads: it goes when the application
    ends. The others go with :meth:`close`.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/mmops/{name}-{uuid.uuid4().hex}"
        self._drop: list[str] = []
        self._n = 0

    def path(self, tag: str, keep: bool = False) -> str:
        if not self._n:
            _delete_at_end(self.spark, self.root)
        self._n += 1
        path = f"{self.root}/{self._n:03d}-{tag}"
        if not keep:
            self._drop.append(path)
        return path

    def table(self, df: DataFrame, tag: str, keep: bool = False) -> DataFrame:
        path = self.path(tag, keep)
        df.write.option("compression", "zstd").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def close(self) -> None:
        for path in self._drop:
            p, filesystem = _path(self.spark, path)
            filesystem.delete(p, True)
        self._drop = []


def bounded_broadcast(df: DataFrame, rows: int, row_bytes: int, limit_bytes: int = 64 << 20) -> DataFrame:
    """``df`` with a broadcast hint where its counted rows are within the limit; else the join shuffles."""
    return df.hint("broadcast") if rows * row_bytes <= limit_bytes else df

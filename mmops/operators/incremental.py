"""Validation that scans only what has changed: a written table of folder signatures and partial counts, which can be merged."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..scratch import Scratch, _path, bounded_broadcast
from .validation import directory_signature, shape_statistics, validation_tier

COUNTS = ("n_json", "n_shapes", "n_rectangle", "n_polygon", "n_other")


@dataclass
class ValidationState:
    """The state's folder: a version each run, of which the last complete one counts. A run that dies leaves none, as Spark marks a complete version."""

    spark: SparkSession
    path: str

    def _versions(self) -> list[int]:
        p, filesystem = _path(self.spark, self.path)
        if not filesystem.exists(p):
            return []
        found = [s.getPath() for s in filesystem.listStatus(p)]
        return sorted(int(x.getName()[2:]) for x in found if x.getName().startswith("v=") and filesystem.exists(_path(self.spark, f"{x}/_SUCCESS")[0]))

    def read(self) -> DataFrame | None:
        versions = self._versions()
        return self.spark.read.parquet(f"{self.path}/v={versions[-1]}") if versions else None

    def write(self, rows: DataFrame) -> DataFrame:
        versions = self._versions()
        target = f"{self.path}/v={(versions[-1] if versions else 0) + 1}"
        rows.write.mode("overwrite").parquet(target)
        return self.spark.read.parquet(target)


def validate(files: DataFrame, scan: Callable[[DataFrame], DataFrame], state: ValidationState, drafts: DataFrame | None = None, force: bool = False) -> DataFrame:
    """V-01 to V-03 with A-07 and A-09: a row per folder: folder, tier, signature, the counts and geometry.

    ``files`` is the listing (folder, name, size, mtime); its signatures are compared with those of the last run. ``drafts`` (folder, geometry, n_objects, n_labels,
    n_images) may tell what drafts hold. The tiers, first that holds: ``resume`` (the last run found the folder valid, of known geometry, and its draft has
    as many objects as there are labels or images; the listing isn't compared), ``signature`` (the listing is as it was), ``draft`` (never validated,
    but the draft is complete and knows the geometry), else ``scan``: only these folders are given to ``scan``, which returns their shapes (folder, file,
    shape_type). Counts of the others come from the state. A new version of the state is written, without folders that are gone. ``force`` scans all.
    A folder without shapes has counts of 0 and no geometry. Folders are grouped by partial sums, so one of very many files is no single task's.
    """
    now = directory_signature(files, by=["folder"]).select("folder", "signature")
    old = state.read()
    if old is None:
        old = now.select("folder", F.lit(None).cast("string").alias("old_signature"), *[F.lit(None).cast("long").alias(c) for c in COUNTS], F.lit(None).cast("string").alias("geometry")).limit(0)
    else:
        old = old.select("folder", F.col("signature").alias("old_signature"), *COUNTS, "geometry")
    joined = now.join(old, "folder", "left")
    if drafts is None:
        joined = joined.withColumns({"draft_geometry": F.lit(None).cast("string"), "enough": F.lit(False)})
    else:
        least = F.coalesce(F.least(F.nullif("n_labels", F.lit(0)), F.nullif("n_images", F.lit(0))), F.lit(0))
        drafts = drafts.select("folder", F.col("geometry").alias("draft_geometry"), ((F.col("n_objects") > 0) & (F.col("n_objects") >= least)).alias("enough"))
        joined = joined.join(drafts, "folder", "left")
    known, enough = F.col("old_signature").isNotNull() & F.col("geometry").isNotNull(), F.coalesce("enough", F.lit(False))
    tier = validation_tier(known & enough, F.coalesce(F.col("old_signature") == F.col("signature"), F.lit(False)), enough & F.col("draft_geometry").isNotNull())
    # Written, as it is a row a folder and read twice: the listing is grouped once, and folders asked for that are few don't make the scan shuffle.
    scratch = Scratch(state.spark, "validation")
    judged = scratch.table(joined.withColumn("tier", F.lit("scan") if force else tier), "judged")
    asked = judged.where("tier = 'scan'").select("folder")
    asked = bounded_broadcast(asked, asked.count(), 256)
    counted = shape_statistics(scan(asked), by=["folder"]).select("folder", *[F.col(c).alias(f"new_{c}") for c in COUNTS], F.col("geometry").alias("new_geometry"))
    done = judged.join(counted, "folder", "left")
    fresh = F.col("tier") == "scan"
    counts = [F.when(fresh, F.coalesce(f"new_{c}", F.lit(0))).otherwise(F.coalesce(c, F.lit(0))).cast("long").alias(c) for c in COUNTS]
    geometry = F.when(fresh, F.col("new_geometry")).otherwise(F.coalesce("geometry", "draft_geometry")).alias("geometry")
    # A folder that resumes keeps the signature that was validated, so that a later change of its draft leads to a scan.
    signature = F.when(F.col("tier") == "resume", F.col("old_signature")).otherwise(F.col("signature")).alias("signature")
    written = state.write(done.select("folder", "tier", signature, *counts, geometry))
    scratch.close()
    return written


def total(folders: DataFrame) -> DataFrame:
    """The counts of all folders, merged: one row, with the geometry of the whole."""
    rect, poly = F.sum("n_rectangle"), F.sum("n_polygon")
    geometry = F.when((rect > 0) & (poly > 0), "mixed").when(rect > 0, "rectangle").when(poly > 0, "polygon")
    return folders.agg(F.count("*").alias("n_folders"), F.count_if(F.col("tier") == "scan").alias("n_scanned"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTS], geometry.alias("geometry"))

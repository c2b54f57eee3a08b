"""Joins of boxes and points within an image by cells of a grid, so that no image's objects all meet in one key."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..scratch import Scratch

SIDES = ("x1", "y1", "x2", "y2")
#: A grid's sides grow by this factor from level to level.
STEP = 4
#: Images of so many points are one cell.
ONE_CELL = 32
#: Rings grow by doubling; after so many doublings of the first side a cell holds any image that doubles can measure out of ONE_CELL points a cell.
ROUNDS = 40


def _cells(low: Column, high: Column, side: Column) -> Column:
    return F.sequence(F.floor(low / side), F.floor(high / side))


def _crowded(rows: DataFrame, stem: str) -> bool:
    """Whether an image has more than ``ONE_CELL`` rows. If none has, all rows of an image can meet in one key."""
    return bool(rows.where(F.col(stem).isNotNull()).groupBy(stem).agg(F.count("*").alias("n")).where(F.col("n") > ONE_CELL).limit(1).count())


def iou_pairs(boxes: DataFrame, others: DataFrame, least: float = 0.1, stem: str = "stem") -> DataFrame:
    """J-12: pairs (obj_id, other_id) of one image whose overlap over union is ``least`` or more; ``least`` is above 0.

    A box is of the level whose side is the first power of ``STEP`` that its longer edge fits in, and is put into the cells it
    touches, of its own level and of the higher ones that a box similar enough can have: the longer edges of two such boxes differ by a factor of 1 / least
    at most. A pair meets at the higher of its levels, and only in the cell of its intersection's upper left corner, so it is made once.
    A box touches four cells of a level at most, whatever the image holds. If no image of ``others`` has more than ``ONE_CELL`` boxes, its boxes are one cell.
    Boxes without an area and those with a null edge overlap none.
    """
    if least <= 0:
        raise ValueError("least must be above 0")
    higher = math.ceil(math.log(1 / least, STEP) + 1e-9) if least < 1 else 1

    def placed(df: DataFrame, names: dict[str, str], mark: str) -> DataFrame:
        df = df.select(F.col(stem).alias(f"{mark}stem"), *[F.col(a).alias(b) for a, b in names.items()])
        x1, y1, x2, y2 = (F.col(list(names.values())[i]) for i in range(1, 5))
        edge = F.greatest(x2 - x1, y2 - y1).cast("double")
        df = df.where((x2 > x1) & (y2 > y1))
        if one_cell:
            return df
        df = df.withColumn(f"{mark}own", F.ceil(F.log(float(STEP), edge) - 1e-9).cast("int"))
        df = df.withColumn(f"{mark}level", F.explode(F.sequence(F.col(f"{mark}own"), F.col(f"{mark}own") + higher)))
        side = F.pow(F.lit(float(STEP)), F.col(f"{mark}level"))
        return df.withColumn(f"{mark}cx", F.explode(_cells(x1, x2, side))).withColumn(f"{mark}cy", F.explode(_cells(y1, y2, side)))

    one_cell = not _crowded(others, stem)
    a = placed(boxes, {"obj_id": "obj_id", **{c: c for c in SIDES}}, "a")
    b = placed(others, {"obj_id": "other_id", **{c: f"o{c}" for c in SIDES}}, "b")
    if one_cell:
        met = F.col("astem") == F.col("bstem")
    else:
        met = (F.col("astem") == F.col("bstem")) & (F.col("alevel") == F.col("blevel")) & (F.col("acx") == F.col("bcx")) & (F.col("acy") == F.col("bcy"))
        side = F.pow(F.lit(float(STEP)), F.col("alevel"))
        left, top = F.greatest("x1", "ox1"), F.greatest("y1", "oy1")
        met &= (F.col("alevel") == F.greatest("aown", "bown")) & (F.floor(left / side) == F.col("acx")) & (F.floor(top / side) == F.col("acy"))
    near = (F.col("x1") < F.col("ox2")) & (F.col("ox1") < F.col("x2")) & (F.col("y1") < F.col("oy2")) & (F.col("oy1") < F.col("y2"))
    iou = geometry.iou([F.col(c) for c in SIDES], [F.col(f"o{c}") for c in SIDES])
    joined = a.join(b, met & near).withColumn("iou", iou).where(F.col("iou") >= least)
    return joined.select(F.col("astem").alias(stem), "obj_id", "other_id", "iou")


def nearest(objects: DataFrame, k: int, stem: str = "stem") -> DataFrame:
    """J-11 and L-02: for each object its k - 1 nearest in the image, by distance of centres, then by id.

    A uniform grid of each image, of about k points a cell at first; an object looks at its own cell and those around it. Where its
    k-th distance isn't below what these cells surely hold, it looks again with sides twice as long, and only such objects do, until
    the cells hold the image. Of points of one centre only the k first by id can be near anything, so the others are looked for, but
    not looked at. An image of ``ONE_CELL`` points is one cell, and in a table of such images only each object has its image's points in a window.
    Objects without a centre have no neighbours and are none.
    """
    c = geometry.centre(*[F.col(x) for x in SIDES])
    points = objects.select(F.col(stem).alias("s"), "obj_id", c["x"].cast("double").alias("cx"), c["y"].cast("double").alias("cy")).where("cx is not null and cy is not null and s is not null")
    order = Window.partitionBy("s", "obj_id").orderBy("distance", "other_id")
    if not _crowded(points, "s"):
        # Each row has its image's points at hand, so that nothing is joined and pairs are never sorted together. Rows of one id look as one.
        here = F.collect_list(F.struct("row", "obj_id", "cx", "cy")).over(Window.partitionBy("s"))
        known = points.withColumn("row", F.monotonically_increasing_id()).withColumn("here", here)
        same = F.filter("here", lambda p: p.obj_id == F.col("obj_id"))
        known = known.withColumn("same", same).where(F.array_min("same.row") == F.col("row"))
        apart = lambda t: F.transform(F.filter("here", lambda p: p.obj_id != F.col("obj_id")), lambda p: F.struct(geometry.distance(t.cx, t.cy, p.cx, p.cy).alias("distance"), p.obj_id.alias("other_id")))
        best = known.select("s", "obj_id", F.posexplode(F.slice(F.sort_array(F.flatten(F.transform("same", apart))), 1, k - 1)).alias("pos", "o"))
        return best.select(F.col("s").alias(stem), "obj_id", "o.other_id", "o.distance", (F.col("pos") + 1).alias("rank"))
    extent = points.groupBy("s").agg(F.count("*").alias("n"), F.min("cx").alias("left"), F.min("cy").alias("top"), (F.max("cx") - F.min("cx")).alias("w"), (F.max("cy") - F.min("cy")).alias("h"))
    span = F.greatest("w", "h")
    side = F.sqrt(F.greatest(F.col("w"), span / F.col("n")) * F.greatest(F.col("h"), span / F.col("n")) * k / F.col("n"))
    # One cell: a side beyond the image's extent.
    extent = extent.withColumn("side", F.when((F.col("n") <= ONE_CELL) | (span == 0), 2 * span + 1).otherwise(side))
    same = Window.partitionBy("s", "cx", "cy").orderBy("obj_id")
    scratch = Scratch(objects.sparkSession, "nearest")

    def place(df: DataFrame) -> DataFrame:
        return df.withColumn("x", F.floor((F.col("cx") - F.col("left")) / F.col("side"))).withColumn("y", F.floor((F.col("cy") - F.col("top")) / F.col("side")))

    sized = scratch.table(points.join(extent, "s"), "points", keep=True)
    ranked = sized.withColumn("of_place", F.row_number().over(same)).where(F.col("of_place") <= k).drop("of_place")
    asking, done = sized, None
    for turn in range(ROUNDS):
        grown = lambda df, turn=turn: place(df.withColumn("side", F.col("side") * float(2**turn)))
        looked = grown(ranked).select(F.col("s").alias("os"), F.col("x").alias("ax"), F.col("y").alias("ay"), F.col("obj_id").alias("other_id"), F.col("cx").alias("ox"), F.col("cy").alias("oy"))
        own = grown(asking)
        around = F.when(F.col("side") > span, F.array(F.lit(0))).otherwise(F.array(F.lit(-1), F.lit(0), F.lit(1)))
        spread = own.withColumn("dx", F.explode(around)).withColumn("dy", F.explode(around)).withColumn("nx", F.col("x") + F.col("dx")).withColumn("ny", F.col("y") + F.col("dy"))
        pairs = spread.join(looked, (F.col("s") == F.col("os")) & (F.col("nx") == F.col("ax")) & (F.col("ny") == F.col("ay")) & (F.col("obj_id") != F.col("other_id")))
        pairs = pairs.withColumn("distance", geometry.distance(F.col("cx"), F.col("cy"), F.col("ox"), F.col("oy")))
        best = pairs.select("s", "obj_id", "other_id", "distance").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k - 1)
        best = scratch.table(best, f"best{turn}", keep=True)
        # Nearer than any point outside of the cells that were looked at; the cells around a side beyond the extent hold the image.
        offset = lambda c, at: F.least(F.col(c) - F.col(at), F.lit(1.0) - (F.col(c) - F.col(at)))
        inside = own.select("s", "obj_id", (F.col("side") > span).alias("all"), ((F.col("cx") - F.col("left")) / F.col("side")).alias("gx"), "x", ((F.col("cy") - F.col("top")) / F.col("side")).alias("gy"), "y", "side")
        inside = inside.select("s", "obj_id", "all", (F.col("side") * (1 + F.greatest(F.least(offset("gx", "x"), offset("gy", "y")), F.lit(0.0))) * (1 - 1e-9)).alias("sure"))
        reach = best.where(F.col("rank") == k - 1).select(F.col("s").alias("rs"), F.col("obj_id").alias("ro"), F.col("distance").alias("reach"))
        told = inside.join(reach, (F.col("s") == F.col("rs")) & (F.col("obj_id") == F.col("ro")), "left").select("s", "obj_id", F.coalesce(F.col("all") | (F.col("reach") < F.col("sure")), F.lit(False)).alias("told"))
        told = scratch.table(told, f"told{turn}", keep=True)
        part = best.join(told.where("told").select("s", "obj_id"), ["s", "obj_id"])
        done = part if done is None else done.unionByName(part)
        asking = scratch.table(asking.join(told.where("not told").select("s", "obj_id"), ["s", "obj_id"]).select(asking.columns), f"asking{turn}", keep=True)
        if not asking.limit(1).count():
            break
    return done.select(F.col("s").alias(stem), "obj_id", "other_id", "distance", "rank")

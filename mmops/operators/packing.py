"""Bins of training records, batches of them, and position ids."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences

CAPACITY, BATCH = 4096, 256


def best_fit(weights: list[int], capacity: int) -> list[int]:
    """C-16: the bin of each item. Items by weight, largest first (stable), go into the fullest bin that still has room; one larger than
    the capacity has a bin of its own."""
    sums: list[int] = []
    bins = [0] * len(weights)
    for i in sorted(range(len(weights)), key=lambda i: -weights[i]):
        fits = [b for b, s in enumerate(sums) if s + weights[i] <= capacity]
        if fits:
            b = max(fits, key=lambda b: sums[b])
            sums[b] += weights[i]
        else:
            b = len(sums)
            sums.append(weights[i])
        bins[i] = b
    return bins


def pack_batches(records: DataFrame, position: str, weight: str = "num_tokens", capacity: int = CAPACITY, batch: int = BATCH) -> DataFrame:
    """Q-01: the records with ``batch`` (256 consecutive positions) and ``bin`` in it. A grouped map of one batch."""
    out = records.withColumn("batch", F.floor(F.col(position) / batch))

    def pack(pdf):
        pdf = pdf.sort_values(position, kind="stable")
        pdf["bin"] = best_fit(pdf[weight].astype("int64").tolist(), capacity)
        return pdf

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in out.schema)
    return out.groupBy("batch").applyInPandas(pack, f"{kinds}, bin int")


def pack_invariants(packed: DataFrame, weight: str = "num_tokens", capacity: int = CAPACITY) -> DataFrame:
    """One row: items, bins, and bins over the capacity that hold more than one item."""
    bins = packed.groupBy("batch", "bin").agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
    return bins.agg(F.sum("n").alias("items"), F.count("*").alias("bins"), F.count_if((F.col("w") > capacity) & (F.col("n") > 1)).alias("overfull"))


def packed_records(packed: DataFrame, position: str, columns: list[str]) -> DataFrame:
    """A row per bin: its members in order, without the weight."""
    member = F.struct(F.col(position).alias("__p"), *columns)
    return packed.groupBy("batch", "bin").agg(F.transform(F.array_sort(F.collect_list(member)), lambda m: F.struct(*[m[c].alias(c) for c in columns])).alias("members"))


def flatten_members(rows: DataFrame, by: list[str], order: str, ids: str = "input_ids", labels: str = "labels") -> DataFrame:
    """G-17 and G-19: the members' ids and labels one after another, with cumulative lengths."""
    grouped = rows.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(ids).alias("i"), F.col(labels).alias("l")))).alias("m"))
    lengths = F.transform("m", lambda x: F.size(x.i).cast("long"))
    return grouped.select(*by, F.flatten(F.transform("m", lambda x: x.i)).alias(ids), F.flatten(F.transform("m", lambda x: x.l)).alias(labels), sequences.cumulative_lengths(lengths).alias("cu_seqlens"))


def pad_batch(rows: DataFrame, batch: str, pad_id: int, longest: int, ids: str = "input_ids", labels: str = "labels") -> DataFrame:
    """G-16: ids and labels filled up to the longest of their batch and cut at ``longest``; attention marks what isn't filling."""
    size = F.least(F.max(F.size(ids)).over(Window.partitionBy(batch)), F.lit(longest))
    out = rows.withColumn("__n", size).withColumn(ids, sequences.pad(F.col(ids), F.col("__n"), pad_id)).withColumn(labels, sequences.pad(F.col(labels), F.col("__n"), sequences.IGNORED))
    return out.withColumn("attention_mask", F.transform(ids, lambda x: x != pad_id)).drop("__n")


def text_positions(length: Column) -> Column:
    """M-31 without media: struct<t, h, w> of 0 ... length - 1 each."""
    line = F.when(length > 0, F.sequence(F.lit(0).cast("long"), length.cast("long") - 1)).otherwise(F.array().cast("array<long>"))
    return F.struct(line.alias("t"), line.alias("h"), line.alias("w"))


# The ids of the vision marks.
IMAGE_ID, VIDEO_ID = 151655, 151656


def rotary_positions(ids: list, image_grids: list, video_grids: list, variant: str = "3", seconds: list | None = None, merge: int = 2) -> list:
    """M-31 of one row: three lists of positions.

    Text counts on; a picture or video of (t, h, w) has, from the next position on, its coordinates in its grid of h / merge by
    w / merge, and the text after it goes on behind the largest. Variant 3 takes a video's frames as pictures of their own,
    2.5 scales time by the seconds of a grid step times 2 (truncated), 2 counts frames.
    """
    if variant == "3":
        video_grids = [(1, h, w) for t, h, w in video_grids for _ in range(t)]
    images, videos, steps = iter(image_grids), iter(video_grids), iter(seconds or [])
    out: list = [[], [], []]
    at, nxt = 0, 0
    while at < len(ids):
        if ids[at] not in (IMAGE_ID, VIDEO_ID):
            for line in out:
                line.append(nxt)
            at, nxt = at + 1, nxt + 1
            continue
        video = ids[at] == VIDEO_ID
        t, h, w = next(videos if video else images)
        h, w = h // merge, w // merge
        scale = next(steps, 1.0) * 2 if variant == "2.5" and video else 0 if variant == "2.5" else 1
        cells = [(int(i * scale), j, k) for i in range(t) for j in range(h) for k in range(w)]
        for line, values in zip(out, zip(*cells, strict=True), strict=True):
            line.extend(nxt + v for v in values)
        nxt = 1 + max(line[-len(cells) :][i] for line in out for i in range(len(cells)))
        at += len(cells)
    return out


def with_positions(rows: DataFrame, variant: str = "3", ids: str = "input_ids") -> DataFrame:
    """M-31 for a table with ``image_grids`` and ``video_grids`` (array<array<int>>): ``positions`` array of three arrays."""

    @F.pandas_udf("array<array<long>>")
    def run(tokens: pd.Series, images: pd.Series, videos: pd.Series) -> pd.Series:
        lists = lambda x: [tuple(int(v) for v in g) for g in x] if x is not None else []
        return pd.Series([rotary_positions(list(i), lists(a), lists(b), variant) for i, a, b in zip(tokens, images, videos, strict=True)])

    return rows.withColumn("positions", run(F.col(ids), F.col("image_grids"), F.col("video_grids")))

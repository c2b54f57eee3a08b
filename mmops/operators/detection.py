"""Detection: jobs from annotation files, parsing of answers, and average precision by the COCO protocol."""

from __future__ import annotations

import ast

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geometry
from ..scratch import Scratch
from .records import ranged

THRESHOLDS = tuple(round(0.5 + 0.05 * i, 2) for i in range(10))
AREAS = {"all": (0.0, 1e10), "small": (0.0, 32.0**2), "medium": (32.0**2, 96.0**2), "large": (96.0**2, 1e10)}
LIMITS = (100, 1000)
BOXES = "array<struct<bbox_2d:array<double>,label:string>>"


def detection_jobs(images: DataFrame, annotations: DataFrame, dataset: str, classes: list[str]) -> DataFrame:
    """O-IN-22: a row per image: question_id, its annotations, the resized size, and the prompt."""
    boxes = annotations.groupBy("image_id").agg(F.array_sort(F.collect_list(F.struct("id", "category_id", "bbox"))).alias("annotation"))
    size = geometry.smart_resize_detection(F.col("height"), F.col("width"))
    prompt = f"Find every object of these classes: {', '.join(classes)}. Answer with JSON: a list of objects with bbox_2d and label."
    jobs = images.join(boxes, images["id"] == boxes["image_id"], "left").drop("image_id")
    return jobs.select(F.lit(dataset).alias("dataset"), F.col("id").alias("img_id"), "height", "width", size["height"].alias("resized_h"), size["width"].alias("resized_w"), F.coalesce("annotation", F.array()).alias("annotation"), F.lit(prompt).alias("prompt"))


def literal_boxes(answer: str | None) -> list | None:
    """The boxes of an answer in Python's literal syntax; None if it isn't a list of boxes with labels. Only literals are read."""
    try:
        out = []
        for item in ast.literal_eval((answer or "").replace("```json", "").replace("```", "").strip()):
            if len(item.get("bbox_2d", [])) == 4:
                out.append(([float(v) for v in item["bbox_2d"]], str(item["label"])))
        return out
    except (ValueError, SyntaxError, TypeError, KeyError, AttributeError, MemoryError, RecursionError):
        return None


def parse_boxes(jobs: DataFrame, answer: str = "answer") -> DataFrame:
    """G-05: ``boxes`` of each answer: its boxes of four numbers; any error empties the whole answer. JSON is parsed
    natively; only other answers go through Python's literal parser."""

    body = F.trim(F.replace(F.replace(F.coalesce(answer, F.lit("")), F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")))
    native = geometry.once(body, lambda t: F.when(F.startswith(t, F.lit("[")) & F.try_parse_json(t).isNotNull(), F.from_json(t, BOXES)))
    bad = lambda b: b.isNull() | ((F.size(b.bbox_2d) == 4) & (b.label.isNull() | F.exists(b.bbox_2d, lambda v: v.isNull())))
    four = lambda boxes: F.filter(boxes, lambda b: F.size(b.bbox_2d) == 4)
    # Null where the answer isn't a list of boxes in JSON.
    read = geometry.once(native, lambda n: F.when(F.coalesce(n.isNotNull() & ~F.exists(n, bad), F.lit(False)), four(n)))

    @F.arrow_udf(BOXES)
    def literal(texts: pa.Array) -> pa.Array:
        if texts.null_count == len(texts):
            return pa.nulls(len(texts), kind)
        return pa.array([[{"bbox_2d": b, "label": n} for b, n in literal_boxes(t) or []] if t is not None else None for t in texts.to_pylist()], kind)

    kind = pa.list_(pa.struct([("bbox_2d", pa.list_(pa.float64())), ("label", pa.string())]))
    rows = jobs.withColumn("__read", read)
    rows = rows.withColumn("boxes", F.coalesce("__read", literal(F.when(F.col("__read").isNull(), F.col(answer))), F.array().cast(BOXES)))
    return rows.drop("__read")


def class_index(labels: DataFrame, classes: list[str], label: str = "label") -> DataFrame:
    """J-15: the place of a label among the classes without regard to case, the first of equal ones; unknown labels go."""
    first: dict[str, int] = {}
    for i, c in enumerate(classes):
        first.setdefault(c.lower(), i)
    names = F.create_map(*[x for k, i in first.items() for x in (F.lit(k), F.lit(i))])
    return labels.withColumn("class_index", F.try_element_at(names, F.lower(label))).where("class_index is not null")


def detections(jobs: DataFrame, classes: list[str], category_ids: list[int], relative: bool = False) -> DataFrame:
    """M-22, J-16 and O-OUT-08: parsed jobs (img_id, boxes, sizes) to a row per detection: image_id, category_id, bbox xywh, score, ord."""
    # Outer, as the filter that Spark infers for the plain one would read and parse all answers a second time; rows of no box have no class.
    rows = jobs.select("img_id", "height", "width", "resized_h", "resized_w", F.posexplode_outer("boxes").alias("pos", "b"))
    rows = class_index(rows.withColumn("label", F.col("b.label")), classes)
    box = geometry.rescale_box(F.col("b.bbox_2d"), F.col("height"), F.col("width"), F.col("resized_h"), F.col("resized_w"), relative)
    ids = F.array(*[F.lit(i) for i in category_ids])
    rows = rows.withColumn("box", box)
    return rows.select(F.col("img_id").alias("image_id"), F.get(ids, F.col("class_index")).alias("category_id"), geometry.xywh(*[F.col("box")[i] for i in range(4)]).alias("bbox"), F.lit(1.0).alias("score"), F.col("pos").alias("ord"))


#: What is counted: an area and how many detections of an image. A slot is one of these at one threshold.
COUNTED = (("all", 100), ("all", 1000), ("small", 1000), ("medium", 1000), ("large", 1000))
SLOTS = tuple((area, limit, t) for area, limit in COUNTED for t in THRESHOLDS)
SKIPPED, MISS, HIT = 0, 1, 2
#: Detections that are counted together: their running counts of all slots are 800 bytes each.
CHUNK = 1 << 15


def match_groups(truth_boxes, truth_areas, truth_crowd, truth_starts, found_boxes, found_starts):
    """Codes (a row a detection, a column a slot) of many groups, each an image's truths and detections of one category, best first.

    Group k's rows are ``starts[k]`` to ``starts[k + 1]``; boxes are xywh. A code is skipped (ignored, or beyond the slot's limit), a miss or a hit. A detection
    takes the free truth of the highest overlap; of equal ones the later. An ignored truth is taken only if no other reaches the threshold.
    All pairs of a group that overlap enough are found at once; then the groups' first detections choose together, then their second ones, and so on, with
    areas and thresholds as axes.
    """
    import numpy as np

    n_groups, n = len(found_starts) - 1, len(found_boxes)
    codes = np.zeros((n, len(SLOTS)), np.uint8)
    if not n:
        return codes
    n_truths, n_found = np.diff(truth_starts), np.diff(found_starts)
    group = np.repeat(np.arange(n_groups), n_found)
    place = np.arange(n) - np.repeat(found_starts[:-1], n_found)
    bounds = np.array(list(AREAS.values()), dtype=float)
    thresholds = np.array(THRESHOLDS)
    size = found_boxes[:, 2] * found_boxes[:, 3]
    outside = ~((bounds[:, 0] <= size[:, None]) & (size[:, None] <= bounds[:, 1]))
    ignored = truth_crowd[:, None] | ~((bounds[:, 0] <= truth_areas[:, None]) & (truth_areas[:, None] <= bounds[:, 1]))

    # Pairs of a detection and each truth of its group, a bounded number of detections at a time, and of these only such as overlap enough for some threshold.
    each = n_truths[group]
    kept = []
    for part in np.split(np.arange(n), np.searchsorted(np.cumsum(each), np.arange(1 << 21, int(each.sum()) + 1, 1 << 21))):
        det = np.repeat(part, each[part])
        own = np.arange(len(det)) - np.repeat(np.cumsum(each[part]) - each[part], each[part]) + truth_starts[:-1][group[det]]
        d, t = found_boxes[det], truth_boxes[own]
        w = np.minimum(d[:, 0] + d[:, 2], t[:, 0] + t[:, 2]) - np.maximum(d[:, 0], t[:, 0])
        h = np.minimum(d[:, 1] + d[:, 3], t[:, 1] + t[:, 3]) - np.maximum(d[:, 1], t[:, 1])
        both = np.maximum(w, 0.0) * np.maximum(h, 0.0)
        union = np.where(truth_crowd[own], d[:, 2] * d[:, 3], d[:, 2] * d[:, 3] + t[:, 2] * t[:, 3] - both)
        over = np.where(union > 0, both / np.where(union > 0, union, 1.0), 0.0)
        near = over >= thresholds.min() - 1e-9
        kept.append((det[near], own[near], over[near]))
    det, own, over = (np.concatenate(c) for c in zip(*kept, strict=True))
    order = np.lexsort((own, over, det))  # of a detection the best pair last
    det, own, over = det[order], own[order], over[order]
    first = np.searchsorted(det, np.arange(n + 1))

    enough = over[:, None] >= np.minimum(thresholds, 1 - 1e-10)
    taken = np.zeros((len(truth_boxes), len(bounds), len(thresholds)), bool)
    slot_area = [list(AREAS).index(area) for area, _ in COUNTED]
    by_place = np.argsort(place, kind="stable")
    for chosen in np.split(by_place, np.searchsorted(place[by_place], np.arange(1, place.max() + 1))):
        result = np.where(outside[chosen], SKIPPED, MISS).astype(np.uint8)[:, :, None].repeat(len(thresholds), axis=2)
        has = chosen[first[chosen + 1] > first[chosen]]
        if len(has):
            counts = first[has + 1] - first[has]
            begins = np.cumsum(counts) - counts
            pairs = np.arange(counts.sum()) - np.repeat(begins, counts) + np.repeat(first[has], counts)
            truth = own[pairs]
            free = enough[pairs][:, None, :] & (~taken[truth] | truth_crowd[truth][:, None, None])
            # The key of a pair: others before ignored ones, then the pair's place.
            key = np.where(free, (~ignored[truth][:, :, None]).astype(np.int64) * len(det) + pairs[:, None, None], -1)
            best = np.maximum.reduceat(key, begins, axis=0)
            k, area, step = np.nonzero(best >= 0)
            met = own[best[k, area, step] % len(det)]
            taken[met, area, step] = True
            at = np.searchsorted(chosen, has) if np.all(np.diff(chosen) > 0) else np.flatnonzero(np.isin(chosen, has))
            result[at[k], area, step] = np.where(ignored[met, area], SKIPPED, HIT)
        here = place[chosen[0]]
        for c, (_, limit) in enumerate(COUNTED):
            if here < limit:
                codes[chosen, c * len(thresholds) : (c + 1) * len(thresholds)] = result[:, slot_area[c]]
    return codes


def match_image(truths: list, found: list) -> list[bytes]:
    """:func:`match_groups` for one image and category: truths [(box xywh, area, crowd)], detections [box xywh] in order, best first."""
    import numpy as np

    boxes = lambda rows: np.array(rows, dtype=float).reshape(-1, 4)
    areas, crowd = np.array([t[1] for t in truths], dtype=float), np.array([bool(t[2]) for t in truths], dtype=bool)
    codes = match_groups(boxes([t[0] for t in truths]), areas, crowd, np.array([0, len(truths)]), boxes(found), np.array([0, len(found)]))
    return [bytes(c) for c in codes]


def _binary(codes):
    """A binary value a row of ``codes``."""
    import numpy as np

    ends = np.arange(len(codes) + 1, dtype=np.int32) * len(SLOTS)
    return pa.Array.from_buffers(pa.binary(), len(codes), [None, pa.py_buffer(ends), pa.py_buffer(codes.tobytes())])


def matched_detections(truth: DataFrame, found: DataFrame) -> DataFrame:
    """category_id, score, image_id, place, codes (a byte a slot of SLOTS) of each detection among its image's and category's first 1,000.

    The limit is taken before an image's detections are brought together; its truths are what an image can hold, in the order of their boxes. A task matches
    all images of an Arrow batch together.
    """
    keys = ["image_id", "category_id"]
    first = Window.partitionBy(*keys).orderBy(F.desc("score"), "ord")
    box = F.transform("bbox", lambda x: x.cast("double")).alias("bbox")
    t = truth.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(box, F.col("area").cast("double").alias("area"), (F.col("iscrowd") != 0).alias("crowd")))).alias("truths"))
    d = found.withColumn("place", F.row_number().over(first)).where(F.col("place") <= max(LIMITS))
    d = d.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("place", F.col("score").cast("double").alias("score"), box))).alias("found"))

    def matched(batches):
        import numpy as np
        import pyarrow as pa

        def spread(lists):
            sizes = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            return lists.flatten(), np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)

        for batch in batches:
            ts, t_starts = spread(batch.column(2))
            ds, d_starts = spread(batch.column(3))
            boxes = lambda rows: rows.field("bbox").flatten().to_numpy(zero_copy_only=False).reshape(-1, 4)
            codes = match_groups(boxes(ts), ts.field("area").to_numpy(zero_copy_only=False), ts.field("crowd").fill_null(False).to_numpy(zero_copy_only=False).astype(bool), t_starts, boxes(ds), d_starts)
            rows = pa.array(np.repeat(np.arange(batch.num_rows), np.diff(d_starts)))
            yield pa.RecordBatch.from_arrays([batch.column(1).take(rows), ds.field("score"), batch.column(0).take(rows), ds.field("place"), _binary(codes)], names=["category_id", "score", "image_id", "place", "codes"])

    both = d.join(t, keys, "left").select(*keys, "truths", "found")
    kind = {c: found.schema[c].dataType.simpleString() for c in keys}
    return both.mapInArrow(matched, f"category_id {kind['category_id']}, score double, image_id {kind['image_id']}, place int, codes binary")


def _codes(values):
    import numpy as np

    return np.frombuffer(b"".join(values), np.uint8).reshape(-1, len(SLOTS))


def best_precision(matched: DataFrame, positives: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """category_id, slot, level (0 to 100), p: the highest precision of a hit at that level of recall.

    Counts run over all detections of a category by falling score. They are dealt out in ranges of that order, and a range in chunks of ``chunk`` rows,
    whatever its size: a chunk's sums first, then the sums of the chunks before it, then the counts inside it. positives: category_id, npos (by place in AREAS).
    """
    # Written, as ranges are sampled from the rows before they are dealt out, which would match them all a second time.
    scratch = Scratch(matched.sparkSession, "precision")
    matched = scratch.table(matched.select("category_id", (-F.col("score")).alias("falling"), "image_id", "place", "codes"), "matched")
    parts = ranged(matched, ["category_id", "falling", "image_id", "place"])
    scratch.close()
    # __i numbers a range's rows upwards from the range's own start, so its high part rises with range and place.
    parts = parts.select("category_id", F.expr(f"__i div {chunk}").alias("__p"), "__i", "codes")
    keys = ["__p", "category_id"]

    def total(batches):
        """The sums of a batch's runs of one chunk and category, so that no code is shuffled for them."""
        import numpy as np

        lists = lambda sums: pa.ListArray.from_arrays(pa.array(np.arange(len(sums) + 1, dtype=np.int32) * len(SLOTS)), pa.array(sums.ravel().astype(np.int64)))
        for batch in batches:
            if batch.num_rows:
                p, category = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
                starts = np.flatnonzero(np.concatenate([[True], (p[1:] != p[:-1]) | (category[1:] != category[:-1])]))
                codes = _codes(batch.column(2).to_pylist())
                hits, counted = (np.add.reduceat(x, starts, axis=0, dtype=np.int64) for x in (codes == HIT, codes != SKIPPED))
                yield pa.RecordBatch.from_arrays([*(batch.column(i).take(pa.array(starts)) for i in (0, 1)), lists(hits), lists(counted)], names=["__p", "category_id", "tp", "n"])

    kind = matched.schema["category_id"].dataType.simpleString()
    totals = parts.select(*keys, "codes").mapInArrow(total, f"`__p` long, category_id {kind}, tp array<long>, n array<long>")
    # A row a batch's part of a chunk, category and slot: small, whatever the detections are.
    by_slot = totals.select(*keys, F.posexplode(F.arrays_zip("tp", "n")).alias("slot", "x")).groupBy(*keys, "slot").agg(F.sum("x.tp").alias("tp"), F.sum("x.n").alias("n"))
    earlier = Window.partitionBy("category_id", "slot").orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    before = by_slot.select(*keys, "slot", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ("tp", "n")])
    before = before.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("slot", "tp", "n"))).alias("slots"))
    before = before.select(*keys, F.col("slots.tp").alias("tp"), F.col("slots.n").alias("n")).join(positives, "category_id")

    def levels(pdf, start):
        import numpy as np

        columns = ["category_id", "slot", "level", "p"]
        if pdf.empty or start.empty:
            return pd.DataFrame({c: [] for c in columns})
        pdf = pdf.sort_values("__i", kind="stable")
        codes, row, out = _codes(pdf["codes"]), start.iloc[0], []
        hits = codes == HIT
        tp, n = hits.cumsum(axis=0) + np.asarray(row["tp"]), (codes != SKIPPED).cumsum(axis=0) + np.asarray(row["n"])
        for slot, (area, _, _) in enumerate(SLOTS):
            npos, at = row["npos"][list(AREAS).index(area)], hits[:, slot]
            if npos and at.any():
                level = np.searchsorted(np.linspace(0, 1, 101), tp[at, slot] / npos, side="right") - 1
                best = pd.Series(tp[at, slot] / n[at, slot]).groupby(level).max()
                out.append(pd.DataFrame({"category_id": row["category_id"], "slot": slot, "level": best.index, "p": best.values}))
        return pd.concat(out) if out else pd.DataFrame({c: [] for c in columns})

    points = parts.groupBy(*keys).cogroup(before.groupBy(*keys)).applyInPandas(levels, f"category_id {kind}, slot int, level int, p double")
    return points.groupBy("category_id", "slot", "level").agg(F.max("p").alias("p"))


def average_precision(truth: DataFrame, found: DataFrame) -> DataFrame:
    """A-19 and W-09: mAP, mAP_50, mAP_75, mAP_s, mAP_m, mAP_l (rounded to 3; 0 where there is nothing to average).

    truth: image_id, category_id, bbox (xywh), area, iscrowd. found: image_id, category_id, bbox, score, ord. The precision at each of 101
    levels of recall is the highest at that level or a later one; a category without truths of an area doesn't count there.
    """
    inside = [F.count_if((F.col("iscrowd") == 0) & F.col("area").between(lo, hi)) for lo, hi in AREAS.values()]
    positives = truth.groupBy("category_id").agg(F.array(*inside).alias("npos"))
    best = best_precision(matched_detections(truth, found), positives)
    later = Window.partitionBy("category_id", "slot").orderBy(F.desc("level"))
    lower = Window.partitionBy("category_id", "slot").orderBy("level")
    steps = best.withColumn("envelope", F.max("p").over(later)).withColumn("width", F.col("level") - F.coalesce(F.lag("level").over(lower), F.lit(-1)))
    ap = steps.groupBy("category_id", "slot").agg((F.sum(F.col("envelope") * F.col("width")) / 101).alias("ap"))
    places = F.array(*[F.lit(list(AREAS).index(area)) for area, _, _ in SLOTS])
    grid = positives.select("category_id", "npos", F.explode(F.sequence(F.lit(0), F.lit(len(SLOTS) - 1))).alias("slot")).where(F.get("npos", F.get(places, F.col("slot"))) > 0)
    full = grid.join(ap, ["category_id", "slot"], "left").withColumn("ap", F.coalesce("ap", F.lit(0.0)))
    slots = lambda area, limit, t=None: [i for i, s in enumerate(SLOTS) if s[:2] == (area, limit) and t in (None, s[2])]
    mean = lambda name, chosen: F.coalesce(F.bround(F.avg(F.when(F.col("slot").isin(chosen), F.col("ap"))), 3), F.lit(0.0)).alias(name)
    return full.agg(
        mean("mAP", slots("all", 100)), mean("mAP_50", slots("all", 1000, 0.5)), mean("mAP_75", slots("all", 1000, 0.75)),
        mean("mAP_s", slots("small", 1000)), mean("mAP_m", slots("medium", 1000)), mean("mAP_l", slots("large", 1000)),
    )


def job_counts(jobs: DataFrame, dataset: str = "dataset") -> DataFrame:
    """A-21."""
    return jobs.groupBy(dataset).agg(F.count("*").alias("n_jobs"))


def box_area(bbox: Column) -> Column:
    return bbox[2] * bbox[3]

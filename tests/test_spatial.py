"""Grid joins against plain versions, on odd rows and on one image with very many objects."""

import random
import time

import pytest

from mmops.operators import grounding, spatial

BOX = "stem long, obj_id long, x1 double, y1 double, x2 double, y2 double"


def boxes_of(rng, n, stem=1, size=30, span=400):
    out = []
    for i in range(n):
        x, y = rng.randrange(-50, span), rng.randrange(-50, span)
        out.append((stem, i, float(x), float(y), float(x + rng.randrange(1, rng.choice([3, size, size * 8]))), float(y + rng.randrange(1, rng.choice([3, size, size * 8])))))
    return out


def plain_iou(a, b, least):
    out = []
    for s, i, ax1, ay1, ax2, ay2 in a:
        for t, j, bx1, by1, bx2, by2 in b:
            w, h = min(ax2, bx2) - max(ax1, bx1), min(ay2, by2) - max(ay1, by1)
            if s == t and w > 0 and h > 0:
                iou = w * h / ((ax2 - ax1) * (ay2 - ay1) + (bx2 - bx1) * (by2 - by1) - w * h)
                if iou >= least:
                    out.append((s, i, j, round(iou, 9)))
    return sorted(out)


@pytest.mark.parametrize("least", [0.02, 0.1, 0.5, 1.0])
def test_iou_pairs(spark, least):
    rng = random.Random(least)
    a, b = (boxes_of(rng, 120) + boxes_of(rng, 40, 2) for _ in range(2))
    b += a[:30] + [(1, 900, 0.5, 0.25, 0.75, 0.26), (1, 901, 5.0, 5.0, 5.0, 9.0), (1, 902, None, 1.0, 2.0, 2.0), (None, 1, 0.0, 0.0, 9.0, 9.0)]
    a += [(1, 900, 0.5, 0.25, 0.75, 0.26), (None, 1, 0.0, 0.0, 9.0, 9.0)]
    got = spatial.iou_pairs(spark.createDataFrame(a, BOX), spark.createDataFrame(b, BOX), least)
    rows = [r for r in b if None not in r]
    assert sorted((r[0], r[1], r[2], round(r.iou, 9)) for r in got.collect()) == plain_iou([r for r in a if None not in r], rows, least)
    assert got.limit(0).collect() == [] and spatial.iou_pairs(got.sparkSession.createDataFrame([], BOX), spark.createDataFrame(b, BOX)).collect() == []
    with pytest.raises(ValueError):
        spatial.iou_pairs(got, got, 0.0)


def plain_nearest(rows, k):
    out = []
    for s, i, *a in rows:
        centre = lambda r: ((r[0] + r[2]) / 2, (r[1] + r[3]) / 2)
        x, y = centre(a)
        near = sorted((((centre(b)[0] - x) ** 2 + (centre(b)[1] - y) ** 2) ** 0.5, j) for t, j, *b in rows if s == t and i != j)
        out += [(s, i, j, rank + 1) for rank, (_, j) in enumerate(near[: k - 1])]
    return sorted(out)


@pytest.mark.parametrize("kind", ["even", "clusters", "line", "one place", "lattice"])
def test_nearest(spark, kind):
    rng, rows = random.Random(kind), []
    for i in range(260):
        x, y = {"even": (rng.random() * 500, rng.random() * 300), "clusters": (rng.choice([0, 0, 0, 9000]) + rng.random() * rng.choice([1, 1, 50]), rng.random() * 5), "line": (i * 1.5, 7.0), "one place": (3.0, 4.0) if i % 9 else (i * 2.0, 4.0), "lattice": (float(i % 16), float(i // 16))}[kind]
        rows.append((7, i, x, y, x + 2, y + 2))
    rows += [(8, i, float(i), 0.0, i + 1.0, 1.0) for i in range(5)] + [(9, 0, 0.0, 0.0, 1.0, 1.0)]
    got = spatial.nearest(spark.createDataFrame(rows, BOX), 5)
    assert sorted(tuple(r) for r in got.select("stem", "obj_id", "other_id", "rank").collect()) == plain_nearest(rows, 5)


def test_image_of_very_many_objects(spark):
    """50,000 objects of one image: each join within a minute, and fewer pairs than objects squared by far."""
    rng = random.Random(1)
    rows = [(1, i, x, y, x + 6 + i % 5, y + 7) for i in range(50_000) for x, y in [(rng.random() * 6000, rng.random() * 4000)]]
    df = spark.createDataFrame(rows, BOX).repartition(4).cache()
    began = time.time()
    near = spatial.nearest(df, 4)
    assert near.count() == 150_000
    assert time.time() - began < 60
    began = time.time()
    pairs = spatial.iou_pairs(df, df)
    assert pairs.where("obj_id = other_id").count() == 50_000
    matched = grounding.match_greedy(pairs)
    assert matched.where("obj_id = other_id").count() == 50_000
    assert time.time() - began < 60
    df.unpersist()


def plain_codes(truths, found):
    """The matching of one image written out for each area, threshold and detection."""
    from mmops.operators.detection import AREAS, COUNTED, HIT, MISS, SKIPPED, SLOTS, THRESHOLDS

    def overlap(d, t, crowd):
        w, h = min(d[0] + d[2], t[0] + t[2]) - max(d[0], t[0]), min(d[1] + d[3], t[1] + t[3]) - max(d[1], t[1])
        both = max(w, 0.0) * max(h, 0.0)
        union = d[2] * d[3] if crowd else d[2] * d[3] + t[2] * t[3] - both
        return both / union if union > 0 else 0.0

    out = [bytearray(len(SLOTS)) for _ in found]
    for slot, (area, limit, threshold) in enumerate(SLOTS):
        low, high = AREAS[area]
        taken = set()
        for place, d in enumerate(found):
            best = None
            for ignored in (False, True):
                for i, (box, size, crowd) in enumerate(truths):
                    o = overlap(d, box, crowd)
                    if bool(crowd or not low <= size <= high) == ignored and (i not in taken or crowd) and o >= min(threshold, 1 - 1e-10) and (best is None or o >= best[0]):
                        best = (o, i, ignored)
                if best:
                    break
            if best:
                taken.add(best[1])
            if place < limit:
                out[place][slot] = (SKIPPED if best[2] else HIT) if best else MISS if low <= d[2] * d[3] <= high else SKIPPED
    assert len(COUNTED) * len(THRESHOLDS) == len(SLOTS)
    return [bytes(x) for x in out]


def test_matching_of_many_images_at_once(spark):
    from mmops.operators import detection

    rng, truth, found, want = random.Random(8), [], [], {}
    for image in range(80):
        side = rng.choice([12.0, 60.0, 300.0])
        box = lambda: [float(rng.randrange(20)), float(rng.randrange(20)), side + rng.randrange(6), side + rng.randrange(6)]  # noqa: E731, B023
        truths = [(b := box(), b[2] * b[3], int(rng.random() < 0.15)) for _ in range(rng.randrange(7))]
        dets = [[x + rng.choice([0, 0, 1, 3]) for x in rng.choice(truths)[0]] if truths and rng.random() < 0.8 else box() for _ in range(rng.choice([0, 1, 4, 9, 130 if image % 20 == 0 else 5]))]
        assert detection.match_image(truths, dets) == plain_codes(truths, dets)
        truth += [(image, 1, *t) for t in truths]
        found += [(image, 1, d, 1.0 - k / 1000, k) for k, d in enumerate(dets)]
        want |= {(image, k + 1): c for k, c in enumerate(plain_codes(truths, dets))}
    t = spark.createDataFrame(truth, "image_id long, category_id int, bbox array<double>, area double, iscrowd int")
    f = spark.createDataFrame(found, "image_id long, category_id int, bbox array<double>, score double, ord int")
    assert {(r.image_id, r.place): bytes(r.codes) for r in detection.matched_detections(t, f).collect()} == want
    assert detection.matched_detections(t, f.limit(0)).collect() == []


def test_nearest_in_small_images_joins_nothing(spark):
    """Repeated ids of an image look as one object; ids that are null are none."""
    rows = [("a", 0, 0.0), ("a", 1, 3.0), ("a", 1, 1.0), ("a", 2, 10.0), ("a", None, 0.5), (None, 1, 0.0), ("b", 7, 0.0)]
    boxes = spark.createDataFrame([(s, i, x, 0.0, x + 2, 2.0) for s, i, x in rows], "stem string, obj_id long, x1 double, y1 double, x2 double, y2 double")
    found = grounding.nearest(boxes, 3)
    assert "Join" not in found._jdf.queryExecution().optimizedPlan().toString()
    got = sorted((r.stem, r.obj_id, r.rank, r.other_id, r.distance) for r in found.collect())
    assert got == [("a", 0, 1, 1, 1.0), ("a", 0, 2, 1, 3.0), ("a", 1, 1, 0, 1.0), ("a", 1, 2, 0, 3.0), ("a", 2, 1, 1, 7.0), ("a", 2, 2, 1, 9.0)]

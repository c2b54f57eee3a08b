"""Boxes, polygons, sizes, frames and cameras: Column in, Column out.

Rounding is half to even and truncation is toward zero, as integers: ``rint`` and casts. A size that
an operator refuses (a side too small, an extreme ratio, an empty range) gives null.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_RATIO = 200


def once(value: Column, f) -> Column:
    """``f(value)`` with the value computed once for a row, however often ``f`` reads it: Spark repeats an expression wherever a lambda or a branch names it."""
    return F.transform(F.array(value), f)[0]


def _int(x: Column) -> Column:
    return x.cast("long")


def _clamp(x: Column, low, high) -> Column:
    return F.least(F.greatest(x, low if isinstance(low, Column) else F.lit(low)), high if isinstance(high, Column) else F.lit(high))


def round_by_factor(n: Column, factor: int) -> Column:
    """M-01."""
    return _int(F.rint(n / factor)) * factor


def ceil_by_factor(n: Column, factor: int) -> Column:
    return _int(F.ceil(n / factor)) * factor


def floor_by_factor(n: Column, factor: int) -> Column:
    return _int(F.floor(n / factor)) * factor


def _size(h: Column, w: Column) -> Column:
    return F.struct(_int(h).alias("height"), _int(w).alias("width"))


def _into_band(h: Column, w: Column, h_bar: Column, w_bar: Column, factor: int, low: int, high: int) -> Column:
    pixels = (h * w).cast("double")
    down, up = F.sqrt(pixels / high), F.sqrt(F.lit(float(low)) / pixels)
    return (
        F.when(h_bar * w_bar > high, _size(floor_by_factor(h / down, factor), floor_by_factor(w / down, factor)))
        .when(h_bar * w_bar < low, _size(ceil_by_factor(h * up, factor), ceil_by_factor(w * up, factor)))
        .otherwise(_size(h_bar, w_bar))
    )


def _ratio_ok(h: Column, w: Column) -> Column:
    return F.greatest(h, w) / F.least(h, w) <= MAX_RATIO


def smart_resize(h: Column, w: Column, factor: int = 32, low: int | None = None, high: int | None = None) -> Column:
    """M-02: multiples of the factor, at least one each, with an area in the band; struct<height, width>."""
    low, high = 4 * factor**2 if low is None else low, 16384 * factor**2 if high is None else high
    one = F.lit(factor).cast("long")
    h_bar, w_bar = F.greatest(one, round_by_factor(h, factor)), F.greatest(one, round_by_factor(w, factor))
    return F.when((F.least(h, w) > 0) & _ratio_ok(h, w), _into_band(h, w, h_bar, w_bar, factor, low, high))


def smart_resize_detection(h: Column, w: Column, factor: int = 28, low: int = 56 * 56, high: int = 14 * 14 * 4 * 1280, long_side: int = 8192) -> Column:
    """M-03: the long side is cut first, and no side is kept from becoming 0."""
    beta = F.greatest(h, w) / long_side
    over = F.greatest(h, w) > long_side
    ch, cw = F.when(over, _int(h / beta)).otherwise(_int(h)), F.when(over, _int(w / beta)).otherwise(_int(w))
    return F.when((F.least(h, w) >= 2) & _ratio_ok(h, w), _into_band(ch, cw, round_by_factor(ch, factor), round_by_factor(cw, factor), factor, low, high))


def smart_resize_training(h: Column, w: Column, factor: int = 28, low: int = 56 * 56, high: int = 14 * 14 * 4 * 1280) -> Column:
    """M-04: refuses sides under the factor."""
    return F.when((F.least(h, w) >= factor) & _ratio_ok(h, w), _into_band(h, w, round_by_factor(h, factor), round_by_factor(w, factor), factor, low, high))


def box_to_thousandths(box: Column, h: Column, w: Column) -> Column:
    """M-05: array of 4 pixels to 0 ... 1000."""
    return F.transform(box, lambda v, i: _int(_clamp(F.rint(v / F.when(i % 2 == 0, w).otherwise(h) * 1000), 0.0, 1000.0)))


def box_to_resized(box: Column, h: Column, w: Column, factor: int = 28, low: int = 56 * 56, high: int = 14 * 14 * 4 * 1280) -> Column:
    """M-06: pixels of the image as M-04 resizes it."""
    new = smart_resize_training(h, w, factor, low, high)

    def scaled(v, i):
        old, size = F.when(i % 2 == 0, w).otherwise(h), F.when(i % 2 == 0, new["width"]).otherwise(new["height"])
        return _int(_clamp(F.rint(v * (size / old)), F.lit(0.0), (size - 1).cast("double")))

    return F.when(new.isNotNull(), F.transform(box, scaled))


def frame_count(total: Column, video_fps: Column, fps: float = 2.0, low: int = 4, high: int = 768) -> Column:
    """M-07 by rate: even, within the bounds and the video; null where fewer than 2 are left."""
    least = F.lit(-(-low // 2) * 2).cast("double")
    most = F.floor(F.least(F.lit(high), total) / 2) * 2
    n = F.least(F.least(F.greatest(total / video_fps * fps, least), most.cast("double")), total.cast("double"))
    n = floor_by_factor(n, 2)
    return F.when((n >= 2) & (n <= total), n)


def frame_count_fixed(total: Column, wanted: Column) -> Column:
    """M-07 by number."""
    n = round_by_factor(wanted, 2)
    return F.when((n >= 2) & (n <= total), n)


def frame_range(total: Column, fps: Column, start: Column, end: Column) -> Column:
    """M-08: struct<start, end, count> of the frames between two times in seconds; null times are open ends."""
    length = total / fps
    first = F.when(start.isNull(), F.lit(0).cast("long")).otherwise(_int(F.ceil(_clamp(start, F.lit(0.0), length) * fps)))
    last = F.when(end.isNull(), _int(total - 1)).otherwise(F.least(_int(F.floor(_clamp(end, F.lit(0.0), length) * fps)), _int(total - 1)))
    ok = (total > 0) & (fps > 0) & ((first < last) | (start.isNull() & end.isNull()))
    return F.when(ok, F.struct(first.alias("start"), last.alias("end"), (last - first + 1).alias("count")))


def spaced_indices(a: Column, b: Column, n: Column) -> Column:
    """M-09: n evenly spaced indices from a to b, rounded half to even (in doubles)."""
    one = F.array(_int(a))
    many = F.transform(F.sequence(F.lit(0), F.greatest(n, F.lit(2)).cast("int") - 1), lambda i: _int(F.rint(a + i * ((b - a) / (n - 1)))))
    return F.when(n == 1, one).when(n > 1, many).otherwise(F.array().cast("array<long>"))


def subtitle_frame_count(frames: Column, fps: Column, rate: int = 2, low: int = 4, high: int = 512) -> Column:
    """M-10."""
    return F.least(F.greatest(_int(F.rint(frames / fps)) * rate, F.lit(low)), F.lit(high), _int(F.floor(frames / 2)) * 2)


def packing_indices(total: Column, fps: Column, interval: float, low: int, high: int) -> Column:
    """M-11: truncated evenly spaced indices without repeats."""
    n = F.least(F.greatest(_int(F.rint(total / fps / interval)), F.lit(low)), F.lit(high))
    step = (total - 1) / F.greatest(n - 1, F.lit(1))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), (n - 1).cast("int")), lambda i: _int(F.when(i == n - 1, (total - 1).cast("double")).otherwise(i * step))))


def visual_tokens(t: Column, h: Column, w: Column) -> Column:
    """M-12."""
    return _int(F.floor(t * h * w / 4))


def video_pixel_budget(frames: Column, low: int, high: int, total: float) -> Column:
    """M-13: the most pixels a frame may have."""
    return F.greatest(F.least(F.lit(float(high)), F.lit(float(total)) / frames * 2), F.lit(float(int(low * 1.05))))


def iou(a: list[Column], b: list[Column]) -> Column:
    """M-14 of two boxes (x1, y1, x2, y2); 0 where they don't overlap."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0))
    both = (w * h).cast("double")
    area = lambda x: F.greatest(x[2] - x[0], F.lit(0)) * F.greatest(x[3] - x[1], F.lit(0))
    return F.coalesce(F.try_divide(both, area(a) + area(b) - both), F.lit(0.0))


def xywh(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """M-15."""
    return F.array(x1, y1, x2 - x1, y2 - y1)


def centre(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """M-16: struct<x, y>."""
    return F.struct(((x1 + x2) / 2).alias("x"), ((y1 + y2) / 2).alias("y"))


def bounding_box(points: Column) -> Column:
    """A-10: array of [x, y] to [x1, y1, x2, y2]."""
    xs, ys = F.transform(points, lambda p: p[0]), F.transform(points, lambda p: p[1])
    return F.when(F.size(points) > 0, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def polygon_area(flat: Column) -> Column:
    """M-17: of x, y, x, y ...; 0 for fewer than three points."""

    def area(points):
        whole = 2 * F.floor(F.size(points) / 2).cast("int")
        closed = F.concat(F.slice(points, F.lit(1), whole), F.slice(points, 1, 2))
        cross = lambda p: F.aggregate(F.sequence(F.lit(0), F.size(p) - 4, F.lit(2)), F.lit(0.0), lambda acc, i: acc + F.get(p, i) * F.get(p, i + 3) - F.get(p, i + 2) * F.get(p, i + 1))
        return F.when(F.coalesce(F.size(points), F.lit(0)) < 6, F.lit(0.0)).otherwise(F.abs(once(closed, cross)) / 2)

    return once(flat, area)


def annotation_area(polygon: Column, w: Column, h: Column) -> Column:
    """M-18."""
    return F.when(F.coalesce(F.size(polygon), F.lit(0)) > 0, polygon_area(polygon)).otherwise((w * h).cast("double"))


def crop_box(x1: Column, y1: Column, x2: Column, y2: Column, width: Column, height: Column, ratio: float = 1.5) -> Column:
    """M-19: the box enlarged about its centre, truncated and clamped; null where nothing is left."""
    cx, cy = (x1 + x2) / 2, (y1 + y2) / 2
    ew, eh = F.greatest(F.lit(1.0), (x2 - x1) * F.lit(ratio)), F.greatest(F.lit(1.0), (y2 - y1) * F.lit(ratio))
    zero = F.lit(0).cast("long")
    out = F.array(F.greatest(zero, _int(cx - ew / 2)), F.greatest(zero, _int(cy - eh / 2)), F.least(_int(width), _int(cx + ew / 2)), F.least(_int(height), _int(cy + eh / 2)))
    return F.when((out[2] > out[0]) & (out[3] > out[1]), out)


def grid_cell(cx: Column, cy: Column, width: Column, height: Column, grid: int = 3) -> Column:
    """M-20."""
    at = lambda v, n: _clamp(_int(v / F.greatest(n, F.lit(1)) * grid), 0, grid - 1)
    return at(cy, height) * grid + at(cx, width)


def distance(x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """M-21."""
    return F.hypot(x2 - x1, y2 - y1)


def rescale_box(box: Column, h: Column, w: Column, resized_h: Column, resized_w: Column, relative: bool = False) -> Column:
    """M-22: from the resized image (or thousandths) back to the original's pixels."""
    of = lambda i: (F.lit(1000), F.when(i % 2 == 0, w).otherwise(h)) if relative else (F.when(i % 2 == 0, resized_w).otherwise(resized_h), F.when(i % 2 == 0, w).otherwise(h))
    return F.transform(box, lambda v, i: v / of(i)[0] * of(i)[1])


def grid_to_pixels(box: Column, width: Column, height: Column) -> Column:
    """M-23: 0 ... 999 to 0 ... side - 1, rounded."""
    return F.transform(box, lambda v, i: _int(F.rint(v / 999 * (F.when(i % 2 == 0, width).otherwise(height) - 1))))


def grid_point(point: Column, width: Column, height: Column) -> Column:
    """M-24: 0 ... 999 to 0 ... side, rounded."""
    return F.transform(point, lambda v, i: _int(F.rint(v / 999 * F.when(i % 2 == 0, width).otherwise(height))))


def thousandths_to_pixels(values: Column, width: Column, height: Column) -> Column:
    """M-25."""
    return F.transform(values, lambda v, i: v / 1000 * F.when(i % 2 == 0, width).otherwise(height))


_CORNERS = [(x, y, z) for x in (1, -1) for y in (1, -1) for z in (1, -1)]


def project_box(box: Column, fx: Column, fy: Column, cx: Column, cy: Column, angle_scale: float = 180.0) -> Column:
    """M-26 and M-33: image points of the corners before the camera of (x, y, z, sizes, pitch, yaw, roll).

    The angles times ``angle_scale`` are degrees. Corners run over x, then y, then z, the positive side first.
    """
    side = lambda b, i: F.get(b, F.lit(i))

    def angles(b):
        each = zip("pyr", (F.radians(side(b, i) * angle_scale) for i in (6, 7, 8)), strict=True)
        return F.struct(*[f(a).alias(f"{kind}{name}") for name, a in each for kind, f in (("c", F.cos), ("s", F.sin))])

    def corners(b, t):
        """A corner is turned in three steps, each of which reads what the one before it gave."""

        def corner(sign):
            start = F.struct(*[(side(b, 3 + i) * sign[i] / 2).alias(c) for i, c in enumerate("xyz")])
            pitched = once(start, lambda p: F.struct(p.x.alias("x"), (p.y * t.cp - p.z * t.sp).alias("y"), (p.y * t.sp + p.z * t.cp).alias("z")))
            seen = once(pitched, lambda p: F.struct((p.x * t.cy + p.z * t.sy).alias("x"), p.y.alias("y"), (p.z * t.cy - p.x * t.sy + side(b, 2)).alias("deep")))
            return once(seen, lambda p: F.when(p.deep > 0, F.array(fx * ((p.x * t.cr - p.y * t.sr + side(b, 0)) / p.deep) + cx, fy * ((p.x * t.sr + p.y * t.cr + side(b, 1)) / p.deep) + cy)))

        signs = F.array(*[F.array(*[F.lit(k) for k in s]) for s in _CORNERS])
        return F.filter(F.transform(signs, corner), lambda p: p.isNotNull())

    return once(box, lambda b: once(angles(b), lambda t: corners(b, t)))


def box_edges(corners: Column) -> Column:
    """M-33: the 12 edges as pairs of truncated points, where all 8 corners are in view."""
    pairs = [(a, b) for bit in (1, 2, 4) for a in range(8) for b in [a | bit] if not a & bit]
    point = lambda i: F.transform(corners[i], lambda v: v.cast("int"))
    return F.when(F.size(corners) >= 8, F.array(*[F.struct(point(a).alias("from"), point(b).alias("to")) for a, b in pairs]))


def pseudo_camera(width: Column, height: Column, fov: float = 60.0) -> Column:
    """M-27: struct<fx, fy, cx, cy> to two decimals."""
    scale = 2 * math.tan(math.radians(fov) / 2)
    two = lambda c: F.bround(c.cast("double"), 2)
    return F.struct(two(width / F.lit(scale)).alias("fx"), two(height / F.lit(scale)).alias("fy"), two(width / 2).alias("cx"), two(height / 2).alias("cy"))


def thumbnail_size(width: Column, height: Column, target: int) -> Column:
    """M-28."""
    wide = width > height
    return F.struct(F.when(wide, F.lit(target).cast("long")).otherwise(_int(width * target / height)).alias("width"), F.when(wide, _int(height * target / width)).otherwise(F.lit(target).cast("long")).alias("height"))


def sheet_place(index: Column, n: Column, columns: int) -> Column:
    """M-29: struct<rows, row, column> of a picture on a contact sheet."""
    return F.struct(_int(F.ceil(n / columns)).alias("rows"), _int(F.floor(index / columns)).alias("row"), _int(F.pmod(index, F.lit(columns))).alias("column"))


def frame_names(n: Column, fps: float, pattern: str) -> Column:
    """M-32: every int(1 / fps)-th frame's name."""
    return F.transform(F.sequence(F.lit(0), n.cast("int") - 1, F.lit(int(1 / fps))), lambda i: F.format_string(pattern, i))


def box_area(box: list[Column]) -> Column:
    return reduce(lambda a, b: a * b, (F.greatest(box[i + 2] - box[i], F.lit(0)) for i in (0, 1)))

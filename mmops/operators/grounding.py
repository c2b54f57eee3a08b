"""Grounding data: objects, descriptions, captions, exports.

Relational steps are joins, windows and aggregates. Steps that decide one thing after another within an
image (matching, span assignment, group sampling, coverage) run in Arrow batches of images; an image's objects are few.
Every random draw is a hash of keys and a seed.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import math
import string

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructType

from ..functions import geometry, text
from ..scratch import Scratch
from .spatial import iou_pairs, nearest

__all__ = ["iou_pairs", "nearest"]

COVER_CHUNK = 10


# ------------------------------------------------------------------ shapes and objects


def select_shapes(shapes: Column, prefer: str = "rectangle") -> Column:
    """P-08: shapes with points: those of the preferred kind, else of the other kind, else all the rest."""
    shapes = F.filter(shapes, lambda s: F.size(s.points) > 0)
    kind = lambda s: F.lower(F.trim(s.shape_type))
    other = "rectangle" if prefer == "polygon" else "polygon"
    first, second = F.filter(shapes, lambda s: kind(s) == prefer), F.filter(shapes, lambda s: kind(s) == other)
    rest = F.filter(shapes, lambda s: ~F.coalesce(kind(s).isin(prefer, other), F.lit(False)))
    return F.when(F.size(first) > 0, first).when(F.size(second) > 0, second).otherwise(rest)


def crop_metadata(objects: DataFrame, ratio: float = 1.5) -> DataFrame:
    """G-27: stem, obj_id, label, x1 ... y2, width, height to bbox_xywh, crop_box and crop_name; objects with an empty crop go."""
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    out = objects.withColumn("bbox_xywh", geometry.xywh(*box)).withColumn("crop_box", geometry.crop_box(*box, F.col("width"), F.col("height"), ratio))
    return out.withColumn("crop_name", text.crop_name(F.col("stem"), F.col("obj_id"), F.col("label"))).where("crop_box is not null")


def match_greedy(pairs: DataFrame, stem: str = "stem") -> DataFrame:
    """Q-02: objects in order take the free partner of the highest IoU, the first of equal ones. ``pairs`` come from :func:`iou_pairs`.

    An image's pairs are few; they are collected by image, and many images are matched in each Arrow batch.
    """
    grouped = pairs.groupBy(stem).agg(F.array_sort(F.collect_list(F.struct("obj_id", (-F.col("iou")).alias("o"), "other_id"))).alias("p"))

    @F.pandas_udf("array<struct<obj_id:long,other_id:long,iou:double>>")
    def match(own: pd.Series) -> pd.Series:
        out = []
        for rows in own:
            taken, done, found = set(), set(), []
            for r in rows:  # by object, best partner first
                if r["obj_id"] not in done and r["other_id"] not in taken:
                    done.add(r["obj_id"])
                    taken.add(r["other_id"])
                    found.append({"obj_id": r["obj_id"], "other_id": r["other_id"], "iou": -r["o"]})
            out.append(found)
        return pd.Series(out)

    return grouped.select(stem, F.inline(match("p")))


# ------------------------------------------------------------------ descriptions


def with_descriptions(objects: DataFrame, descriptions: DataFrame, keys: tuple[str, ...] = ("stem", "obj_id")) -> DataFrame:
    """J-02 and J-03: every object with its phrases, or the fallback ones, and where they come from."""
    d = descriptions.select(*keys, "phrases", F.col("source").alias("__source"))
    joined = objects.join(d, list(keys), "left")
    none = F.coalesce(F.size("phrases"), F.lit(0)) <= 0
    return joined.withColumn("source", F.when(none, "fallback").otherwise(F.coalesce("__source", F.lit("model")))).withColumn("phrases", F.when(none, text.fallback_phrases(F.col("label"))).otherwise(F.col("phrases"))).drop("__source")


def is_placeholder(phrases: Column, label: Column, source: Column) -> Column:
    """P-10: no phrases, a fallback, or nothing beyond the fallback phrases."""
    return (F.coalesce(F.size(phrases), F.lit(0)) <= 0) | (F.coalesce(source, F.lit("")) == "fallback") | (F.size(F.array_except(phrases, text.fallback_phrases(label))) == 0)


def work_list(objects: DataFrame, descriptions: DataFrame, keys: tuple[str, ...] = ("stem", "obj_id")) -> DataFrame:
    """J-08: objects without a usable description."""
    joined = descriptions.join(objects.select(*keys, "label"), list(keys))
    usable = joined.where(~is_placeholder(F.col("phrases"), F.col("label"), F.col("source"))).select(*keys)
    return objects.join(usable, list(keys), "left_anti")


def _keyed(phrases: DataFrame, key: Column, columns: list[str]) -> DataFrame:
    """The rows whose key isn't empty. A generator makes the key once; a filter on a column makes it a second time."""
    return phrases.select(*dict.fromkeys(columns), F.explode(F.filter(F.array(key), lambda k: k != "")).alias("phrase_key"))


def dedup_phrases(phrases: DataFrame, by: list[str], order: str, phrase: str = "phrase", synonyms: bool = False) -> DataFrame:
    """W-07: the first phrase of each content key within a group; empty keys go."""
    key = (text.synonym_key if synonyms else text.content_key)(F.col(phrase))
    keyed = _keyed(phrases, key, [*by, order, phrase])
    first = keyed.groupBy(*by, "phrase_key").agg(F.min_by(F.struct(order, phrase), order).alias("first"))
    return first.select(*by, "phrase_key", F.col("first")[order].alias(order), F.col("first")[phrase].alias(phrase))


def class_pool(phrases: DataFrame, by: list[str], order: str, phrase: str = "phrase") -> DataFrame:
    """A-11: a class's distinct phrases in the order they were first seen."""
    first = dedup_phrases(phrases, by, order, phrase)
    return first.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(order, phrase))), lambda x: x[phrase]).alias("pool"))


def remaining_pool(phrases: DataFrame, own: str, cls: list[str], order: str, phrase: str = "phrase") -> DataFrame:
    """J-13, S-06 and Q-09: how many phrases of its class an object doesn't have yet, by content.

    The difference of counts, not a join of every object with its class's pool: an own key is always in the pool.
    """
    keyed = _keyed(phrases, text.content_key(F.col(phrase)), [*cls, own])
    pool = keyed.select(*cls, "phrase_key").distinct().groupBy(*cls).agg(F.count("*").alias("pool"))
    has = keyed.select(*cls, own, "phrase_key").distinct().groupBy(*cls, own).agg(F.count("*").alias("own"))
    return has.join(pool, cls).select(*cls, own, "pool", "own", (F.col("pool") - F.col("own")).alias("remaining"))


# ------------------------------------------------------------------ captions


def covered(captions: DataFrame, stem: str = "stem", ids: str = "obj_ids") -> DataFrame:
    """A-13 and A-14: in how many captions each object is."""
    return captions.select(stem, F.explode(ids).alias("obj_id")).groupBy(stem, "obj_id").agg(F.count("*").alias("n_captions"))


def uncovered(objects: DataFrame, captions: DataFrame, stem: str = "stem") -> DataFrame:
    return objects.join(covered(captions, stem), [stem, "obj_id"], "left_anti")


def low_frequency(objects: DataFrame, captions: DataFrame, seed: int = 0, stem: str = "stem") -> DataFrame:
    """L-06: objects by how rarely captions have them; ties by a hash."""
    n = objects.join(covered(captions, stem), [stem, "obj_id"], "left").withColumn("n_captions", F.coalesce("n_captions", F.lit(0).cast("long")))
    order = Window.partitionBy(stem).orderBy("n_captions", F.xxhash64(stem, "obj_id", F.lit(seed)))
    return n.withColumn("place", F.row_number().over(order))


def used_phrases(captions: DataFrame, stem: str = "stem", phrases: str = "phrases") -> DataFrame:
    """A-12: (obj_id, phrase) that captions have chosen; phrases array<struct<obj_id, phrase, ...>>."""
    return _chosen(captions, stem, phrases).distinct()


def _chosen(captions: DataFrame, stem: str, phrases: str) -> DataFrame:
    spread = captions.select(stem, F.explode(phrases).alias("p")).select(stem, F.col("p.obj_id").alias("obj_id"), text.strip(F.col("p.phrase")).alias("phrase"))
    return spread.where("obj_id is not null and phrase <> ''")


def unused_phrases(descriptions: DataFrame, captions: DataFrame, stem: str = "stem") -> DataFrame:
    """Q-07: (obj_id, phrase) that no caption has yet: the strong phrases, or all of an object that has no strong one."""
    spread = descriptions.select(stem, "obj_id", "label", F.explode("phrases").alias("phrase")).withColumn("phrase", text.strip(F.col("phrase"))).where("phrase <> ''")
    spread = spread.withColumn("weak", text.is_weak_phrase(F.col("phrase"), F.col("label")))
    spread = spread.where(F.col(stem).isNotNull() & F.col("obj_id").isNotNull())
    strong = F.bool_or(~F.col("weak")).over(Window.partitionBy(stem, "obj_id"))
    pool = spread.withColumn("has_strong", strong).where("not weak or not has_strong").withColumn("low", F.lower("phrase"))
    used = _chosen(captions, stem, "phrases").select(stem, "obj_id", F.lower("phrase").alias("low")).distinct()
    return pool.join(used, [stem, "obj_id", "low"], "left_anti").select(stem, "obj_id", "phrase").distinct()


def weak_share(phrases: DataFrame, by: list[str], limit: float = 0.4) -> DataFrame:
    """A-15: the share of weak phrases and whether it asks for a rebuild."""
    weak = F.count_if(text.is_weak_phrase(F.col("phrase"), F.col("label")))
    out = phrases.groupBy(*by).agg(weak.alias("n_weak"), F.count("*").alias("n"))
    share = F.try_divide("n_weak", "n")
    return out.withColumn("rebuild", F.coalesce(share >= limit, F.lit(False)))


def pick_phrases(descriptions: DataFrame, used: DataFrame | None = None, seed: int = 0, stem: str = "stem", shortlist: int = 3) -> DataFrame:
    """L-03 and Q-08: one phrase an object: of its strong ones, else all, else its label; not a used one, and of the longest
    by words, then characters, three by a hash. An object whose phrases are all used is left out. A row for each description; nothing is shuffled unless phrases are used."""
    options = F.filter(F.coalesce("phrases", F.array().cast("array<string>")), lambda p: text.strip(p) != "")
    strong = lambda o: F.filter(o, lambda p: ~text.is_weak_phrase(p, F.col("label")))
    base = text.once(options, lambda o: text.once(strong(o), lambda s: F.when(F.size(s) > 0, s).when(F.size(o) > 0, o).otherwise(F.array("label"))))
    rows = descriptions.select(stem, "obj_id", "label", base.alias("base"))
    if used is not None:  # few for each object, so they are brought to it as an array
        low = used.groupBy(F.col(stem).alias("__s"), F.col("obj_id").alias("__o")).agg(F.collect_set(F.lower("phrase")).alias("used"))
        rows = rows.join(low, (F.col(stem) == F.col("__s")) & (F.col("obj_id") == F.col("__o")), "left")
        free = F.filter("base", lambda p: ~F.coalesce(F.array_contains("used", F.lower(text.strip(p))), F.lit(False)))
        rows = rows.select(stem, "obj_id", "label", free.alias("base")).where(F.size("base") > 0)
    ranked = F.array_sort(F.transform("base", lambda p, i: F.struct((-F.size(text.words(p))).alias("w"), (-F.length(p)).alias("n"), i.alias("i"), p.alias("phrase"))))
    # Words are counted only where there are more than the shortlist takes.
    listed = F.when(F.size("base") > shortlist, F.transform(F.slice(ranked, 1, shortlist), lambda r: r.phrase)).otherwise(F.col("base"))
    drawn = F.transform(listed, lambda p, i: F.struct(F.xxhash64(F.col(stem), F.col("obj_id"), p, F.lit(seed)).alias("h"), i.alias("i"), p.alias("phrase")))
    picked = rows.select(stem, "obj_id", "label", F.array_min(drawn)["phrase"].alias("phrase"))
    keep = F.lower(text.strip(F.col("phrase"))) == F.lower(text.strip(F.col("label")))
    return picked.withColumn("keep_source_label", keep).withColumn("features", F.when(~keep, F.array("phrase")))


_ALNUM = frozenset(string.ascii_letters + string.digits)


def assign_spans(caption: str | None, phrases: list) -> list:
    """G-11: spans [start, end) for phrases, none overlapping, None where there is no place. Longer phrases choose first; a
    span's neighbours aren't ASCII letters or digits."""
    caption = caption or ""
    found: list = [None] * len(phrases)
    free = bytearray(b"\x01" * len(caption))
    for i in sorted(range(len(phrases)), key=list(map(len, phrases)).__getitem__, reverse=True):  # equal ones stay in order
        p = phrases[i]
        at = caption.find(p) if p else -1
        while at >= 0:
            end = at + len(p)
            edges = (at == 0 or caption[at - 1] not in _ALNUM) and (end == len(caption) or caption[end] not in _ALNUM)
            if edges and free.find(0, at, end) < 0:
                found[i] = [at, end]
                free[at:end] = bytes(len(p))
                break
            at = caption.find(p, at + 1)
    return found


def complete_caption(caption: str | None, phrases: list) -> tuple[str, list]:
    """G-12: the caption with its unplaced phrases put at its end, and the spans."""
    caption = caption or ""
    for _ in range(len(phrases) + 2):
        spans = assign_spans(caption, phrases)
        missing = [p for p, s in zip(phrases, spans, strict=True) if p and s is None]
        if not missing:
            return caption, spans
        caption = f"{caption.rstrip('. ')}, with {', '.join(missing)}."
    return caption, assign_spans(caption, phrases)


def with_spans(rows: DataFrame, caption: str = "caption", phrases: str = "phrases", complete: bool = False) -> DataFrame:
    """G-11 or G-12 for a table: ``spans`` array<array<int>>, and the caption completed if asked. Arrow batches, whose phrases and spans are flat columns."""

    @F.arrow_udf("caption string, spans array<array<int>>")
    def spans(captions: pa.Array, texts: pa.Array) -> pa.Array:
        said = ["" if x is None else x.strip() for x in texts.flatten().to_pylist()]
        ends = [0, *itertools.accumulate(pc.list_value_length(texts).fill_null(0).to_pylist())]
        done, found = [], []
        for c, (i, j) in zip(captions.to_pylist(), itertools.pairwise(ends), strict=True):
            c, own = complete_caption(c, said[i:j]) if complete else (c, assign_spans(c, said[i:j]))
            done.append(c)
            found += own
        starts = [0, *itertools.accumulate(2 if s else 0 for s in found)]
        # A list whose start is null is null.
        each = pa.array([a if s else None for a, s in zip(starts, found)] + starts[-1:], pa.int32())  # noqa: B905  starts has one more
        each = pa.ListArray.from_arrays(each, pa.array([x for s in found if s for x in s], pa.int32()))
        return pa.StructArray.from_arrays([pa.array(done, pa.string()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each)], ["caption", "spans"])

    done = rows.withColumn("__s", spans(F.col(caption), F.col(phrases)))
    return done.withColumn(caption, F.col("__s.caption")).withColumn("spans", F.col("__s.spans")).drop("__s")


@functools.lru_cache(1 << 14)
def _said(keys: tuple) -> bytes:
    """What follows the seed in the text that is hashed. Images draw by the same few keys; only plain numbers and strings, as equal keys must read alike."""
    return repr(keys)[1:].encode() if len(keys) > 1 else f"{keys[0]!r})".encode()


def drawer(seed):
    """A function of keys to a number in [0, 1): the hash of ``repr((seed, *keys))``, whose common start is hashed once."""
    start = hashlib.blake2b(f"({seed!r}, ".encode(), digest_size=7)

    def draw(*keys) -> float:
        full = start.copy()
        full.update(_said(keys))
        return int.from_bytes(full.digest(), "big") / (1 << 56)

    return draw


def draw(seed, *keys) -> float:
    """A number in [0, 1) from a hash of the keys."""
    return int.from_bytes(hashlib.blake2b(repr((seed, *keys)).encode(), digest_size=7).digest(), "big") / (1 << 56)


def _near(objects: list, anchor: int, k: int, known: dict | None = None) -> list:
    """The object at ``anchor`` and its k - 1 nearest ones; ``known`` keeps the orders of an image's anchors."""
    known = {} if known is None else known
    if anchor not in known:
        at = objects[anchor]
        x, y = at["cx"], at["cy"]
        order = sorted((math.hypot(o["cx"] - x, o["cy"] - y), i) for i, o in enumerate(objects) if i != anchor)
        known[anchor] = [at["obj_id"], *[objects[i]["obj_id"] for _, i in order]]
    return known[anchor][: max(1, k)]


def _overlap(a: set, b: set) -> float:
    both = len(a & b)
    return both / (len(a) + len(b) - both) if both else 0.0


def plan_groups(objects: list, n: int, seed, grid: int = 3, known: dict | None = None) -> list:
    """Q-03: up to n groups of an image's objects [{obj_id, cx, cy, cell}]: neighbours of an object of a fresh grid cell each, and
    one drawn from all. A group that repeats another by over 0.7 is drawn anew; then more are added up to n."""
    if not objects:
        return []
    known = {} if known is None else known
    total, out, sets, seen_cells = len(objects), [], [], set()
    draw = drawer(seed)
    size = lambda *k: total if total < 3 else 3 + int(draw("size", *k) * (min(COVER_CHUNK, total) - 2))
    spread = n >= 2 and total >= 3
    all_cells = sorted({o["cell"] for o in objects})

    def sample(count, *k):
        return [o["obj_id"] for _, o in sorted(((draw("all", *k, o["obj_id"]), o) for o in objects), key=lambda p: (p[0], p[1]["obj_id"]))[:count]]

    def fresh(ids, limit):
        ids = set(ids)
        for other in sets:
            if _overlap(ids, other) > limit:
                return False
        return True

    def add(ids, strategy, cell):
        out.append({"obj_ids": ids, "strategy": strategy, "grid_cell": cell})
        sets.append(set(ids))

    for turn in range(n):
        k = size(turn)
        # The second try is made only if the first one isn't fresh.
        if spread and turn == n - 1:
            cell, strategy = -1, "global_random"
            tries = (sample(k, turn, *again) for again in ((), ("again",)))
        else:
            cells = [c for c in all_cells if c not in seen_cells] or all_cells
            cell, strategy = cells[int(draw("cell", turn) * len(cells))], "anchor_neighbor"
            seen_cells.add(cell)
            inside = [i for i, o in enumerate(objects) if o["cell"] == cell]
            anchors = (lambda: inside[int(draw("anchor", turn) * len(inside))], lambda: int(draw("anchor", turn, "again") * total))  # noqa: B023  used within its turn
            tries = (_near(objects, anchor(), k, known) for anchor in anchors)
        ids = next((t for t in tries if fresh(t, 0.7)), None)
        if ids:
            add(ids, strategy, cell)
    stale = set()  # what repeats a group repeats it when there are more, too
    for turn in range(40):
        if len(out) >= n:
            break
        tried = int(draw("more", turn) * total), 1 + int(draw("k", turn) * min(COVER_CHUNK, total))
        anyway = turn >= 20 or total <= 3
        if not anyway and tried in stale:
            continue
        ids = _near(objects, *tried, known)
        if anyway or fresh(ids, 0.85):
            add(ids, "anchor_neighbor", -1)
        else:
            stale.add(tried)
    return out[:n]


def image_groups(own: list, n: int, seed, cover: bool = True) -> list:
    """The groups of :func:`plan_groups` and, with ``cover``, more until every object is in one."""
    known: dict[int, list] = {}
    groups = plan_groups(own, n, seed, known=known)
    have = {x for g in groups for x in g["obj_ids"]}
    left = [o["obj_id"] for o in own if cover and o["obj_id"] not in have]
    while left:
        anchor, open_ids = next(i for i, o in enumerate(own) if o["obj_id"] == left[0]), set(left)
        near = [x for x in _near(own, anchor, min(COVER_CHUNK, len(own)), known) if x in open_ids]
        ids = [*near, *[x for x in left if x not in near]][:COVER_CHUNK]
        groups.append({"obj_ids": ids, "strategy": "cover_objects", "grid_cell": -1})
        left = [x for x in left if x not in ids]
    return groups


def caption_groups(objects: DataFrame, n: int = 5, seed: int = 0, cover: bool = True, stem: str = "stem") -> DataFrame:
    """Q-03 to Q-06: groups of objects to be captioned in each image: stem, sentence_id, obj_ids, strategy, grid_cell.

    With ``cover``, groups are added until every object is in one: the first uncovered object's neighbours that are
    uncovered, then other uncovered ones, ten at most. An image's objects are few: they are collected, and many images are
    planned in each Arrow batch, whose columns are read and written as flat arrays.
    """
    c = geometry.centre(*[F.col(x) for x in ("x1", "y1", "x2", "y2")])
    cell = geometry.grid_cell(c["x"], c["y"], F.col("width"), F.col("height"))
    member = F.struct(F.col("obj_id").cast("long").alias("obj_id"), c["x"].alias("cx"), c["y"].alias("cy"), cell.alias("cell"))
    points = objects.groupBy(stem).agg(F.array_sort(F.collect_list(member)).alias("o")).select(stem, F.col(stem).cast("string").alias("key"), "o")

    def plan(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            images = batch.column(2)
            sizes, flat = images.value_lengths().to_pylist(), images.flatten()
            ids, xs, ys, cells = (flat.field(name).to_pylist() for name in ("obj_id", "cx", "cy", "cell"))
            rows, sentence, members, counts, strategy, grid_cell, start = [], [], [], [], [], [], 0
            for k, (key, size) in enumerate(zip(batch.column(1).to_pylist(), sizes, strict=True)):
                own = [{"obj_id": ids[i], "cx": xs[i], "cy": ys[i], "cell": cells[i]} for i in range(start, start + size)]
                start += size
                for i, g in enumerate(image_groups(own, n, (seed, key), cover)):
                    rows.append(k)
                    sentence.append(i)
                    members += g["obj_ids"]
                    counts.append(len(g["obj_ids"]))
                    strategy.append(g["strategy"])
                    grid_cell.append(g["grid_cell"])
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(members, pa.int64()))
            columns = [batch.column(0).take(pa.array(rows, pa.int64())), pa.array(sentence, pa.int32()), lists, pa.array(strategy, pa.string()), pa.array(grid_cell, pa.int32())]
            yield pa.RecordBatch.from_arrays(columns, names=[stem, "sentence_id", "obj_ids", "strategy", "grid_cell"])

    kind = StructType([objects.schema[stem]]).add("sentence_id", IntegerType()).add("obj_ids", ArrayType(LongType())).add("strategy", StringType()).add("grid_cell", IntegerType())
    return points.mapInArrow(plan, kind)


def write_captions(groups: DataFrame, picked: DataFrame, stem: str = "stem") -> DataFrame:
    """Q-10 and G-25: groups and the picked phrase of each object to captions: a template sentence, its phrases and spans."""
    members = groups.select(stem, "sentence_id", "strategy", "grid_cell", F.posexplode("obj_ids").alias("pos", "obj_id"))
    joined = members.join(picked.select(stem, "obj_id", "phrase"), [stem, "obj_id"])
    rows = joined.groupBy(stem, "sentence_id", "strategy", "grid_cell").agg(F.array_sort(F.collect_list(F.struct("pos", "obj_id", "phrase"))).alias("m"))
    rows = rows.withColumn("obj_ids", F.transform("m", lambda x: x.obj_id)).withColumn("phrases", F.transform("m", lambda x: x.phrase)).drop("m")
    return with_spans(rows.withColumn("caption", text.template_caption(F.col("phrases"))), complete=True)


def cover_phrases(captions: DataFrame, descriptions: DataFrame, stem: str = "stem") -> DataFrame:
    """Q-06 for phrases: more captions of an image until each phrase of its objects is chosen, strong ones only where an object has any.

    The k-th unused phrases of an image's objects, ten objects at most, make a caption, so an object is in each once. They are numbered behind the others.
    """
    return captions.unionByName(_more_captions(captions, descriptions, stem))


def _more_captions(captions: DataFrame, descriptions: DataFrame, stem: str) -> DataFrame:
    """What :func:`cover_phrases` adds."""
    pairs = F.transform(F.arrays_zip("obj_ids", "phrases"), lambda p: F.struct(p.obj_ids.alias("obj_id"), p.phrases.alias("phrase")))
    unused = unused_phrases(descriptions, captions.select(stem, pairs.alias("phrases")), stem)
    turn = F.row_number().over(Window.partitionBy(stem, "obj_id").orderBy("phrase"))
    rows = unused.withColumn("turn", turn)
    chunk = F.floor((F.row_number().over(Window.partitionBy(stem, "turn").orderBy("obj_id")) - 1) / COVER_CHUNK)
    added = rows.withColumn("chunk", chunk).groupBy(stem, "turn", "chunk").agg(F.array_sort(F.collect_list(F.struct("obj_id", "phrase"))).alias("m"))
    number = F.row_number().over(Window.partitionBy(stem).orderBy("turn", "chunk")) - 1
    before = captions.groupBy(stem).agg((F.max("sentence_id") + 1).alias("__n"))
    added = added.withColumn("k", number).join(before, stem, "left").withColumn("sentence_id", (F.coalesce("__n", F.lit(0)) + F.col("k")).cast("int"))
    added = added.select(stem, "sentence_id", F.lit("cover_phrases").alias("strategy"), F.lit(-1).alias("grid_cell"), F.transform("m", lambda x: x.obj_id).alias("obj_ids"), F.transform("m", lambda x: x.phrase).alias("phrases"))
    return with_spans(added.withColumn("caption", text.template_caption(F.col("phrases"))), complete=True)


def generate_captions(objects: DataFrame, descriptions: DataFrame, n: int = 5, seed: int = 0, stem: str = "stem") -> tuple[DataFrame, DataFrame]:
    """Q-10: (captions, descriptions) of whole images: groups of objects, a phrase for each, captions with spans, more of them until all objects and phrases
    are chosen, and the chosen phrases back in the descriptions.

    Descriptions and both kinds of captions are written tables, since each is read more than once: no step runs again when the result is read."""
    scratch = Scratch(objects.sparkSession, "captions")
    descriptions = scratch.table(descriptions, "descriptions", keep=True)
    # Merged, as a written table is far larger in memory than its files, by which Spark would broadcast it.
    picked = pick_phrases(descriptions, seed=seed, stem=stem).hint("merge")
    captions = write_captions(caption_groups(objects, n, seed, stem=stem), picked, stem)
    captions = scratch.table(captions, "first", keep=True)
    captions = captions.unionByName(scratch.table(_more_captions(captions, descriptions, stem), "more", keep=True))
    return captions, sync_descriptions(descriptions, captions, stem)


def export_annotations(captions: DataFrame, objects: DataFrame, stem: str = "stem") -> DataFrame:
    """J-01, W-04, M-18 and G-26: a row per placed phrase of an existing object: annotation_id in image, sentence and phrase
    order, image_id (the sentence), bbox, area and tokens_positive."""
    spread = captions.select(stem, "sentence_id", F.posexplode(F.arrays_zip("obj_ids", "phrases", "spans")).alias("pos", "p"))
    rows = spread.where("p.spans is not null").select(stem, "sentence_id", "pos", F.col("p.obj_ids").alias("obj_id"), F.col("p.phrases").alias("phrase"), F.col("p.spans").alias("tokens_positive"))
    box = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    polygon = F.col("segmentation") if "segmentation" in objects.columns else F.lit(None).cast("array<double>")
    area = geometry.annotation_area(polygon, F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    joined = rows.join(objects.select(stem, "obj_id", geometry.xywh(*box).alias("bbox"), area.alias("area")), [stem, "obj_id"])
    number = F.row_number().over(Window.partitionBy(stem).orderBy("sentence_id", "pos")) - 1
    return joined.select(stem, number.alias("annotation_id"), F.col("sentence_id").alias("image_id"), "obj_id", "phrase", "bbox", "area", "tokens_positive", F.lit(1).alias("category_id"))


def delete_object(objects: DataFrame, descriptions: DataFrame, captions: DataFrame, stem_value, obj_id: int, stem: str = "stem") -> tuple[DataFrame, DataFrame, DataFrame]:
    """P-31: an object taken out of all three tables; captions keep their other phrases, and their spans are assigned anew."""
    gone = (F.col(stem) == stem_value) & (F.col("obj_id") == obj_id)
    here = F.col(stem) == stem_value
    members = F.filter(F.arrays_zip("obj_ids", "phrases"), lambda m: m.obj_ids != obj_id)
    kept = captions.withColumn("__m", F.when(here, members).otherwise(F.arrays_zip("obj_ids", "phrases")))
    kept = kept.withColumn("obj_ids", F.transform("__m", lambda m: m.obj_ids)).withColumn("phrases", F.transform("__m", lambda m: m.phrases)).drop("__m", "spans")
    return objects.where(~gone), descriptions.where(~gone), with_spans(kept)


def delete_caption(captions: DataFrame, stem_value, sentence_id: int, stem: str = "stem") -> DataFrame:
    """P-33 and W-03: a caption goes and the later ones of its image move up."""
    kept = captions.where(~((F.col(stem) == stem_value) & (F.col("sentence_id") == sentence_id)))
    return kept.withColumn("sentence_id", F.row_number().over(Window.partitionBy(stem).orderBy("sentence_id")) - 1)


def sync_descriptions(descriptions: DataFrame, captions: DataFrame, stem: str = "stem") -> DataFrame:
    """G-14: phrases that captions chose are added to their object's phrases; translations are filled up."""
    used = _chosen(captions.withColumn("__p", F.arrays_zip(F.col("obj_ids").alias("obj_id"), F.col("phrases").alias("phrase"))), stem, "__p")
    chosen = used.groupBy(stem, "obj_id").agg(F.array_sort(F.collect_set("phrase")).alias("chosen"))
    joined = descriptions.drop("chosen").join(chosen, [stem, "obj_id"], "left")
    phrases = F.array_distinct(F.concat("phrases", F.coalesce("chosen", F.array().cast("array<string>"))))
    zh = F.coalesce("zh", F.array().cast("array<string>")) if "zh" in descriptions.columns else F.array().cast("array<string>")
    filled = F.slice(F.concat(zh, F.array_repeat(F.lit(""), F.greatest(F.size(phrases) - F.size(zh), F.lit(0)))), F.lit(1), F.size(phrases))
    return joined.select(*[c for c in descriptions.columns if c not in ("phrases", "zh", "chosen")], filled.alias("zh"), phrases.alias("phrases"), "chosen")


def locked_phrases(captions: DataFrame, descriptions: DataFrame, stem: str = "stem") -> DataFrame:
    """G-13: the phrases of each caption that a refresh keeps: of existing objects and, unless they have features or keep the label, still among the
    object's phrases; once each. ``phrases`` is array<struct<obj_id, phrase, keep_source_label, features>>."""
    spread = captions.select(stem, "sentence_id", F.posexplode("phrases").alias("pos", "p"))
    rows = spread.select(stem, "sentence_id", "pos", F.col("p.obj_id").alias("obj_id"), text.strip(F.col("p.phrase")).alias("phrase"), F.coalesce("p.keep_source_label", F.lit(False)).alias("keep"), F.slice(F.coalesce("p.features", F.array().cast("array<string>")), 1, 2).alias("features"))
    known = descriptions.select(stem, "obj_id", "label", F.transform("phrases", lambda x: F.lower(text.strip(x))).alias("known"))
    joined = rows.join(known, [stem, "obj_id"]).where("phrase <> ''")
    free = F.col("keep") | (F.size("features") > 0) | (F.size("known") == 0) | F.array_contains("known", F.lower("phrase"))
    kept = joined.where(F.coalesce(free, F.lit(True)))
    # One sort of plain columns, without those that the caller leaves out; an aggregate of structs would sort twice.
    once = Window.partitionBy(stem, "sentence_id", "obj_id", "low", "keep").orderBy("pos")
    first = kept.withColumn("low", F.lower("phrase")).withColumn("__n", F.row_number().over(once)).where("__n = 1")
    return first.select(stem, "sentence_id", "obj_id", "keep", "pos", "phrase", "label", "features")


def refresh_merge(old: list, chosen: set, fresh: list, most: int) -> list:
    """Q-15: chosen phrases keep their places, the others are replaced by fresh ones in order, and the rest is added up to ``most``."""
    new = iter([p for p in fresh if p not in chosen])
    out = [p if p in chosen else next(new, None) for p in old]
    return [*[p for p in out if p is not None], *new][:most]

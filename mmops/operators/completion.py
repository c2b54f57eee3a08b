"""Completion of phrases within a class: what objects of one class are said to be, each other object of it may be, too."""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterable

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text

#: Takes [(label, phrases it has, candidates)] and gives for each the candidates that hold.
Matcher = Callable[[list[tuple[str, list[str], list[str]]]], list[list[str]]]


def class_pools(own: list[list[tuple[str, str]]]) -> tuple[list[str], list[int]]:
    """A-11: of the (phrase, key) lists of a class's objects the phrases of distinct keys, as first seen, and each object's as a bitmap."""
    pool, place, masks = [], {}, []
    for pairs in own:
        mask = 0
        for phrase, key in pairs:
            if key:
                if key not in place:
                    place[key] = len(pool)
                    pool.append(phrase)
                mask |= 1 << place[key]
        masks.append(mask)
    return pool, masks


def remaining(pool: list[str], mask: int) -> list[str]:
    """S-06: the pool without the bits of ``mask``."""
    left, out = ((1 << len(pool)) - 1) & ~mask, []
    while left:
        low = left & -left
        out.append(pool[low.bit_length() - 1])
        left ^= low
    return out


def _ends(counts: Iterable[int]) -> pa.Array:
    return pa.array(itertools.accumulate(counts, initial=0), pa.int32())


def complete_phrases(descriptions: DataFrame, match: Matcher | None, stem: str = "stem") -> DataFrame:
    """Q-09, J-13, S-06: stem, obj_id, label, phrases to phrases, exhaustive, exhaustive_added.

    Objects of an image whose labels read alike are a class, taken in the order of obj_id. Its pool is numbered, an object's phrases are
    a bitmap over it, and what the object lacks is one AND NOT; ``match`` says which of these hold, and they are appended. Without a matcher none is.
    An added phrase must have a content key that the object hasn't yet. Phrases that are null or white space go. A class is a row of its image, so objects
    are joined with no pool, and the matcher gets all classes of an Arrow batch at once. Null phrases are none; repeated ids are objects each.
    """
    clean = F.filter(F.coalesce("phrases", F.array().cast("array<string>")), text.has_text)
    item = F.struct("obj_id", "label", F.transform(clean, lambda p: F.struct(p.alias("phrase"), text.content_key(p).alias("key"))).alias("own"))
    classes = descriptions.groupBy(stem, text.label_reading(F.col("label")).alias("__class")).agg(F.sort_array(F.collect_list(item)).alias("objects"))
    kind = descriptions.schema["obj_id"].dataType.simpleString()

    @F.arrow_udf("array<struct<added:array<string>>>")
    def added(batch: pa.Array) -> pa.Array:
        # Flat columns and counts, since a Python object for each nested value costs more than the work itself.
        objects, shape = batch.flatten(), pc.list_value_length(batch).to_pylist()
        own = pc.struct_field(objects, "own")
        pairs, counts, labels = own.flatten(), pc.list_value_length(own).to_pylist(), pc.struct_field(objects, "label").to_pylist()
        phrases, keys = pc.struct_field(pairs, "phrase").to_pylist(), pc.struct_field(pairs, "key").to_pylist()
        asked, at, first = [], 0, 0
        for n in shape:
            ends = list(itertools.accumulate(counts[first : first + n], initial=at))
            has = list(itertools.pairwise(ends))
            pool, masks = class_pools([list(zip(phrases[i:j], keys[i:j], strict=True)) for i, j in has])
            asked += [(label, phrases[i:j], remaining(pool, mask)) for label, (i, j), mask in zip(labels[first : first + n], has, masks, strict=True)]
            at, first = ends[-1], first + n
        said = iter(match([a for a in asked if a[2]]) if match is not None else [])
        found = []
        for _, _, candidates in asked:
            held = set(next(said, [])) if candidates else ()
            found.append([p for p in candidates if p in held])
        lists = pa.ListArray.from_arrays(_ends(map(len, found)), pa.array([p for f in found for p in f], pa.string()))
        return pa.ListArray.from_arrays(_ends(shape), pa.StructArray.from_arrays([lists], ["added"]))

    done = classes.select(stem, "objects", added("objects").alias("more"))
    rows = done.select(stem, F.inline(F.arrays_zip("objects", "more")))
    own = F.transform("objects.own", lambda p: p.phrase)
    return rows.select(stem, F.col("objects.obj_id").cast(kind).alias("obj_id"), F.col("objects.label").alias("label"), F.concat(own, "more.added").alias("phrases"), F.lit(True).alias("exhaustive"), F.col("more.added").alias("exhaustive_added"))

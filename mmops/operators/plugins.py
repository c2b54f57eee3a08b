"""Plug-ins by scene: a registry, and their dispatch over batches of rows."""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Takes rows as a pandas table and gives a list of phrases for each.
Plugin = Callable[[pd.DataFrame], list[list[str]]]
DEFAULT = "default"


def plugin_name(scene: str | None) -> str:
    """The name that a scene's plug-in is registered by: its slug, or the default's."""
    return re.sub(r"[^a-z0-9_]+", "_", (scene or "").strip().lower()).strip("_") or DEFAULT


class Registry:
    """Plug-ins by scene; one is the default, which serves the scenes that have none."""

    def __init__(self, default: Plugin):
        self._known = {DEFAULT: default}

    def register(self, scene: str, plugin: Plugin) -> Registry:
        self._known[plugin_name(scene)] = plugin
        return self

    def resolve(self, scene: str | None) -> tuple[str, Plugin]:
        """The name of the plug-in that serves a scene, and it."""
        name = plugin_name(scene)
        return (name, self._known[name]) if name in self._known else (DEFAULT, self._known[DEFAULT])

    def known(self, scene: Column) -> Column:
        """The name that :meth:`resolve` gives."""
        slug = F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(scene, F.lit("")))), "[^a-z0-9_]+", "_"), F.lit("_"))
        return F.when(slug.isin(*self._known), slug).otherwise(F.lit(DEFAULT))


def describe(rows: DataFrame, registry: Registry, scene: str = "scene") -> DataFrame:
    """The rows with ``engine`` (the plug-in's name), ``phrases`` and ``error``; columns of these names are replaced.

    Each Arrow batch's rows are dealt to their scenes' plug-ins, which get a scene's rows at once and must give a list for each. A call that raises, or gives
    another number of lists, is made again row by row, so that an error stays with the rows that cause it: they have no phrases and its text. A null
    or unknown scene is the default's. No row is shuffled, and no plug-in sees more than a batch.
    """
    given = rows.drop("engine", "phrases", "error")
    given = given.withColumn("engine", registry.known(F.col(scene)))
    names = [c for c in given.columns if c != "engine"]

    def tried(plugin: Plugin, part: pd.DataFrame) -> list[tuple[list[str] | None, str | None]]:
        try:
            found = plugin(part)
            if len(found) != len(part):
                raise ValueError(f"{len(found)} results for {len(part)} rows")
            return [(list(p), None) for p in found]
        except Exception as e:  # a plug-in is foreign code: what it raises is the row's result
            if len(part) == 1:
                return [(None, f"{type(e).__name__}: {e}")]
            return [x for k in range(len(part)) for x in tried(plugin, part.iloc[k : k + 1])]

    @F.pandas_udf("struct<phrases:array<string>,error:string>")
    def run(engines: pd.Series, table: pd.DataFrame) -> pd.DataFrame:
        out: list = [None] * len(engines)
        for name, at in engines.reset_index(drop=True).groupby(engines.reset_index(drop=True)).groups.items():
            for k, found in zip(at, tried(registry.resolve(name)[1], table.iloc[list(at)]), strict=True):
                out[k] = found
        return pd.DataFrame(out, columns=["phrases", "error"])

    own = F.struct(*[F.col(f"`{c}`") for c in names])
    return given.withColumn("__said", run(F.col("engine"), own)).select(*[f"`{c}`" for c in names], "engine", "__said.phrases", "__said.error")

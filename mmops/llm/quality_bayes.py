"""Quality classifier by hierarchical empirical Bayes (operator 1).

Document evidence: two logistic classifiers, of quality and of toxicity, over hashed features of the whole text (words, beginnings
of words, and its form). They are trained in numpy on a bounded sample of labelled documents
(about ``TRAIN_ROWS`` ids, ``TRAIN_BYTES`` of text at most): features are chosen by the significance of their log odds, and weights are fitted by Newton steps.

Site evidence: each document belongs to a host, and to a path within it. Grouped aggregates give
the mean probability of each; a host's mean is shrunk toward the global one and a path's toward its
host's, ``(sum + kappa * prior) / (n + kappa)``, with kappa estimated from the spread between the
groups (method of moments). A document's own probability is left out of its groups' sums. Its posterior adds the log odds of its
path's posterior over the global ones to its own, with weight ``SITE_WEIGHT``; the weight of a site
never overturns a document whose own evidence is strong (``SITE_LIMIT`` in log odds).

Sums are aggregated before they are shuffled, so a host with a third of all rows is one row each task.

A null or empty text has the form features only. A null host or path is a group of its own. Repeated
rows count as often as they occur, and are one row in training. Of several labels of one id the least (quality, then toxic) holds;
texts are read whole, however long, but one that exceeds ``TRAIN_BYTES`` isn't learned from. Without labels of both kinds for a question, the evidence is the
labels' share, or else good and not toxic.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, bounded_broadcast, bounded_sample

TRAIN_ROWS = 4000
TRAIN_BYTES = 48 << 20
FEATURES = 600
LEAST_Z = 4.0
L2 = 0.05
SITE_WEIGHT, SITE_LIMIT = 0.5, 1.0
QUALITY_THRESHOLD, TOXIC_THRESHOLD = 0.5, 0.5
FORM = ("symbols", "upper", "repeat", "pipes", "lines", "short")
_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str) -> set[str]:
    """Distinct words and their beginnings of three to five letters."""
    found = set(_WORD.findall(text.lower()))
    return found.union(*[{w[:n] + "~" for w in found if len(w) > n} for n in (3, 4, 5)])


def form_of(text: str) -> list[float]:
    """Shares, between 0 and 1, that tell prose from other text."""
    words = text.split()
    n, chars = max(1, len(words)), max(1, len(text))
    lines = [x for x in text.split("\n") if x.strip()]
    return [
        min(1.0, 10 * sum(text.count(c) for c in "#*$%&|<>!") / chars), sum(map(str.isupper, words)) / n, 1 - len(set(words)) / n,
        min(1.0, 10 * text.count("|") / n), 1 - len(set(lines)) / max(1, len(lines)), float(len(words) < 20),
    ]


class Classifier:
    """p = logistic(weights of the chosen words present + weights of the form + bias)."""

    def __init__(self, weights: dict[str, float], form: list[float], bias: float):
        self.weights, self.form, self.bias = weights, form, bias

    def logit(self, words: set[str], form: list[float]) -> float:
        w = self.weights
        return self.bias + sum(w[x] for x in words & w.keys()) + sum(a * b for a, b in zip(self.form, form, strict=True))


def train_one(words: list[set[str]], forms: list[list[float]], labels: list[int]) -> Classifier:
    import numpy as np

    n1 = sum(labels)
    n0 = len(labels) - n1
    if not n1 or not n0:
        share = min(0.99, max(0.01, n1 / len(labels))) if labels else 0.5
        return Classifier({}, [0.0] * len(FORM), math.log(share / (1 - share)))
    count: tuple[Counter, Counter] = (Counter(), Counter())
    for w, y in zip(words, labels, strict=True):
        count[y].update(w)

    def z(x):
        a, b = count[1][x], count[0][x]
        odds = math.log((a + 0.5) / (n1 - a + 0.5)) - math.log((b + 0.5) / (n0 - b + 0.5))
        return odds / math.sqrt(1 / (a + 0.5) + 1 / (n1 - a + 0.5) + 1 / (b + 0.5) + 1 / (n0 - b + 0.5))

    strong = [(abs(z(x)), x) for x in count[0].keys() | count[1].keys() if count[0][x] + count[1][x] >= 5]
    chosen = [x for s, x in sorted(strong, key=lambda p: (-p[0], p[1]))[:FEATURES] if s >= LEAST_Z]
    place = {x: i for i, x in enumerate(chosen)}
    m = len(chosen)
    data = np.zeros((len(labels), m + len(FORM) + 1))
    for row, w, form in zip(data, words, forms, strict=True):
        row[[place[x] for x in w if x in place]] = 1
        row[m:-1] = form
        row[-1] = 1
    y, beta = np.array(labels, float), np.zeros(data.shape[1])
    ridge = np.full(len(beta), L2)
    ridge[-1] = 1e-6
    for _ in range(12):
        p = 1 / (1 + np.exp(-np.clip(data @ beta, -30, 30)))
        grad = data.T @ (y - p) - ridge * beta
        hess = (data * (p * (1 - p))[:, None]).T @ data + np.diag(ridge)
        step = np.linalg.solve(hess, grad)
        beta += step
        if np.abs(step).max() < 1e-6:
            break
    return Classifier(dict(zip(chosen, beta[:m].tolist(), strict=True)), beta[m:-1].tolist(), float(beta[-1]))


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> tuple[Classifier, Classifier]:
    """(quality, toxic) from about ``train_rows`` labelled documents, drawn by a hash of the id."""
    known = labels.select(F.col(id_col).alias("k"), F.col("quality").alias("q"), F.col("toxic").alias("x")).where(F.col("k").isNotNull())
    n = known.count()
    share = min(1.0, train_rows / max(1, n))
    drawn = known.where(F.pmod(F.xxhash64("k", F.lit(23)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))).groupBy("k").agg(F.min(F.struct("q", "x")).alias("l"))
    drawn = bounded_broadcast(drawn.select("k", "l.q", "l.x"), min(n, 2 * train_rows), 32)
    rows = bounded_sample(docs.select(F.col(id_col).alias("k"), F.col(text_col).alias("t")).join(drawn, "k"), 2 * train_rows, train_bytes)
    pool: dict[str, str] = {}  # one string for each word, however many documents have it
    words = [{pool.setdefault(w, w) for w in words_of(r.t or "")} for r in rows]
    forms = [form_of(r.t or "") for r in rows]
    del pool
    models = []
    for at, default in (("q", 1), ("x", 0)):
        use = [i for i, r in enumerate(rows) if r[at] is not None]
        if not use:
            models.append(Classifier({}, [0.0] * len(FORM), 4.0 if default else -4.0))
            continue
        models.append(train_one([words[i] for i in use], [forms[i] for i in use], [int(rows[i][at] > 0) for i in use]))
    return models[0], models[1]


def evidence(docs: DataFrame, models: tuple[Classifier, Classifier], id_col: str, text_col: str, host: Column, path: Column) -> DataFrame:
    """id, host, path, logit_quality, logit_toxic; log odds are kept within 12."""
    quality, toxic = models

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            q, x = [], []
            for text in batch.column(3).to_pylist():
                words, form = words_of(text or ""), form_of(text or "")
                q.append(max(-12.0, min(12.0, quality.logit(words, form))))
                x.append(max(-12.0, min(12.0, toxic.logit(words, form))))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(q, pa.float64()), pa.array(x, pa.float64())], names=["id", "host", "path", "quality", "toxic"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), host.cast("string").alias("host"), path.cast("string").alias("path"), F.col(text_col))
    return rows.mapInArrow(run, f"id {kind}, host string, path string, quality double, toxic double")


def _p(logit: Column) -> Column:
    return 1 / (1 + F.exp(-logit))


def _logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return F.log(q / (1 - q))


def _kappa(groups: DataFrame, prior: Column) -> Column:
    """One row's aggregate: the prior's weight, by the method of moments: large where groups differ no more than chance lets them."""
    mean = F.col("s") / F.col("n")
    within = F.sum(F.col("n") * mean * (1 - mean)) / F.greatest(F.sum("n"), F.lit(1))
    between = F.sum(F.col("n") * (mean - prior) * (mean - prior)) / F.greatest(F.sum("n"), F.lit(1))
    chance = within * F.count("*") / F.greatest(F.sum("n"), F.lit(1))
    return F.least(F.greatest(within / F.greatest(between - chance, F.lit(1e-9)), F.lit(1.0)), F.lit(1e6))


def classify(docs: DataFrame, models: tuple[Classifier, Classifier], id_col: str = "doc_id", text_col: str = "text", host: Column | None = None, path: Column | None = None) -> DataFrame:
    """A row per document: the id, quality_score, toxic_score (posteriors), kept. ``host`` and ``path`` default to
    source and language; for a table with a url give ``url_host`` and ``url_path``."""
    host = F.col("source") if host is None else host
    path = F.col("lang") if path is None else path
    scratch = Scratch(docs.sparkSession, "quality")
    rows = scratch.table(evidence(docs, models, id_col, text_col, host, path), "evidence", keep=True)
    out = rows
    for kind in ("quality", "toxic"):
        paths = rows.groupBy("host", "path").agg(F.sum(_p(F.col(kind))).alias("s"), F.count("*").alias("n"))
        paths = scratch.table(paths, f"{kind}-paths")
        hosts = paths.groupBy("host").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
        hosts = scratch.table(hosts, f"{kind}-hosts")
        total = hosts.agg(F.sum("s"), F.sum("n"), F.count("*")).first()
        prior = total[0] / total[1] if total[1] else 0.5
        kappa_host = hosts.agg(_kappa(hosts, F.lit(prior))).first()[0] or 1e6
        of_host = hosts.select(F.col("host").alias("h"), F.col("s").alias("hs"), F.col("n").alias("hn"))
        both = paths.join(of_host, F.col("host").eqNullSafe(F.col("h"))).withColumn("of_host", (F.col("hs") + kappa_host * prior) / (F.col("hn") + kappa_host))
        kappa_path = both.agg(_kappa(both, F.col("of_host"))).first()[0] or 1e6
        both = scratch.table(both.select(F.col("host").alias("h"), F.col("path").alias("p"), *[F.col(c).alias(f"{kind}_{c}") for c in ("s", "n", "hs", "hn")]), f"{kind}-sites", keep=True)
        same = F.col("host").eqNullSafe(F.col("h")) & F.col("path").eqNullSafe(F.col("p"))
        out = out.join(bounded_broadcast(both, paths.count(), 200), same).drop("h", "p")
        own = _p(F.col(kind))
        s, n, hs, hn = (F.col(f"{kind}_{c}") for c in ("s", "n", "hs", "hn"))
        host_mean = (F.greatest(hs - own, F.lit(0.0)) + kappa_host * prior) / (hn - 1 + kappa_host)
        path_mean = (F.greatest(s - own, F.lit(0.0)) + kappa_path * host_mean) / (n - 1 + kappa_path)
        shift = SITE_WEIGHT * (_logit(path_mean) - _logit(F.lit(prior)))
        shift = F.least(F.greatest(shift, F.lit(-SITE_LIMIT)), F.lit(SITE_LIMIT))
        out = out.withColumn(f"{kind}_score", _p(F.col(kind) + shift))
    scratch.close()
    kept = (F.col("quality_score") >= QUALITY_THRESHOLD) & (F.col("toxic_score") < TOXIC_THRESHOLD)
    return out.select(F.col("id").alias(id_col), "host", "path", "quality_score", "toxic_score", kept.alias("kept"))


def url_host(url: Column) -> Column:
    """The lower-case host without port, and without www; null if the text is no URL."""
    host = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    return F.when(host != "", F.regexp_replace(host, r"^www\.", ""))


def url_path(url: Column) -> Column:
    """The first directory of the path, or / if there is none."""
    return F.concat(F.lit("/"), F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+/([^/?#]+)/", 1))

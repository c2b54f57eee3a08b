"""Language identification (operator 4): averaged hashed subword embeddings and a linear softmax.

A word is a run of letters, lower-cased; its subwords are the n-grams of 2 to 4 characters of the word
with a space before and after it, and the whole, each hashed into ``BUCKETS`` rows of an embedding. A text is the
mean of the embeddings of all subwords of all its words, and a linear softmax over that gives its language.
Embeddings and weights are trained together by stochastic gradient descent in numpy, on a bounded sample
of labelled rows (``TRAIN_ROWS``, ``TRAIN_BYTES``; whole texts). A text's step on its embeddings is scaled by the root of the number of its
subwords: the plain gradient, a share of one over that number for each, hardly moves the embeddings of long texts. Prediction uses embedding times weights, a score a
subword and language. Subwords are hashed by numpy for a whole text at once, a long one by parts of ``PART`` characters.

Calibrated rejection: a part of the sample is held back from the training; a temperature is fitted to it, and
the threshold is the score under which ``REJECT_SHARE`` of its rightly predicted texts fall, and not above ``MAX_THRESHOLD``.
Texts under it, and those without any letter, are rejected.

A null text, an empty one and one without letters get ``und``, score 0, and are rejected. Rows are judged
one by one, so repeated rows get equal results. Without any labelled row everything is ``und``.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bounded_sample

BUCKETS, DIM = 1 << 17, 16
TRAIN_ROWS = 3000
TRAIN_BYTES = 48 << 20
STEPS, RATE = 9000, 0.5
REJECT_SHARE = 0.002
MAX_THRESHOLD = 0.5
#: Characters hashed at once; parts end between words.
PART = 100_000
_GAP = re.compile(r"[\W\d_]+")


def _hash(part):
    """Buckets of the subwords of a part: code points of words, with one space before, between and after them."""
    import numpy as np

    step, letter = np.uint64(0x9E3779B97F4A7C15), part != 32
    h, whole, found = part, np.ones(len(part), bool), []
    for n in (2, 3, 4):
        h = h[:-1] * step + part[n - 1 :]
        if n > 2:  # a space is only the first or the last character
            whole = whole[: len(h)] & letter[n - 2 : n - 2 + len(h)]
        found.append(h[whole[: len(h)]])
    ends = np.flatnonzero(~letter)
    place = np.arange(len(part)) - np.repeat(ends, np.diff(ends, append=len(part)))
    each = (part + place.astype(np.uint64) * step) * np.uint64(0xBF58476D1CE4E5B9)
    each = (each ^ (each >> np.uint64(31))) * step * letter
    found.append(np.add.reduceat(each, ends[:-1]))
    h = np.concatenate(found)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
    return (h >> np.uint64(33)).astype(np.int64) % BUCKETS


def subwords(text: str):
    """Arrays of the buckets of all subwords of a text, part by part; none if it has no letter."""
    import numpy as np

    if not any(map(str.isalpha, text)):
        return
    codes = np.frombuffer(f" {_GAP.sub(' ', text.lower()).strip()} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    ends = np.flatnonzero(codes == 32)
    first = 0
    while first < len(ends) - 1:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + PART, "right")) - 1)
        yield _hash(codes[ends[first] : ends[last] + 1])
        first = last


def _features(text: str):
    """Bucket indices and their weights, which add up to 1."""
    import numpy as np

    at, n = np.unique(np.concatenate([np.empty(0, np.int64), *subwords(text)]), return_counts=True)
    return at, n / max(1, n.sum())


class Model:
    """Languages, a score a bucket and language, the bias, the temperature and the rejection threshold."""

    def __init__(self, langs, table, bias, temperature=1.0, threshold=0.0):
        self.langs, self.table, self.bias, self.temperature, self.threshold = langs, table, bias, temperature, threshold

    def logits(self, text: str):
        """None if the text has no letter."""
        import numpy as np

        total, n = np.zeros(len(self.langs)), 0
        for at in subwords(text):
            total += self.table.take(at, axis=0).sum(axis=0, dtype=np.float64)
            n += len(at)
        return total / n + self.bias if n else None

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, rejected)."""
        import numpy as np

        z = self.logits(text) if text and self.langs else None
        if z is None:
            return "und", 0.0, True
        p = np.exp((z - z.max()) / self.temperature)
        p /= p.sum()
        best = int(p.argmax())
        return self.langs[best], float(p[best]), bool(p[best] < self.threshold)


def train(rows: list[tuple[str, str]], seed: int = 5) -> Model:
    """Rows are (text, language). Every fifth row calibrates."""
    import numpy as np

    rows = [r for r in rows if r[0] and r[1] is not None and any(map(str.isalpha, r[0]))]
    langs = sorted({r[1] for r in rows})
    if not langs:
        return Model([], np.zeros((1, 0)), np.zeros(0))
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM))
    w, bias = np.zeros((DIM, len(langs))), np.zeros(len(langs))
    data = [(*_features(t), langs.index(lang)) for t, lang in rows]
    held = data[::5] if len(data) >= 25 else []
    fit = [d for i, d in enumerate(data) if i % 5] if held else data
    epochs = -(-STEPS // len(fit))
    steps, done = epochs * len(fit), 0
    for _ in range(epochs):
        for i in rng.permutation(len(fit)):
            at, weight, label = fit[i]
            rate = RATE * (1 - done / steps)
            done += 1
            hidden = weight @ emb[at]
            z = hidden @ w + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = w @ p
            w -= rate * np.outer(hidden, p)
            bias -= rate * 0.1 * p
            emb[at] -= rate * len(at) ** 0.5 * np.outer(weight, back)
    model = Model(langs, (emb @ w).astype(np.float32), bias)
    if held:
        z = np.array([weight @ model.table[at] + bias for at, weight, _ in held])
        y = np.array([d[2] for d in held])

        def scores(t):
            e = np.exp((z - z.max(axis=1, keepdims=True)) / t)
            return e / e.sum(axis=1, keepdims=True)

        grid = [0.25 * 1.15**k for k in range(24)]
        model.temperature = min(grid, key=lambda t: -np.log(scores(t)[np.arange(len(y)), y] + 1e-12).sum())
        s = scores(model.temperature)
        right = s.max(axis=1)[s.argmax(axis=1) == y]
        model.threshold = float(min(np.quantile(right, REJECT_SHARE), MAX_THRESHOLD)) if len(right) else 0.0
    return model


def fit(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_rows: int = TRAIN_ROWS, train_bytes: int = TRAIN_BYTES) -> Model:
    """Trains on about ``train_rows`` labelled rows where ``may_learn`` holds, chosen by a hash of the id, and ``train_bytes`` of text at most.
    Of several languages of one id and text the first in the alphabet holds."""
    labelled = docs.where(may_learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = docs.select(id_col, lang_col).where(may_learn & F.col(lang_col).isNotNull()).count()
    share = min(1.0, train_rows / max(1, n))
    draw = F.pmod(F.xxhash64(F.col(id_col), F.lit(17)), F.lit(1 << 20)) < F.lit(int(share * (1 << 20)))
    drawn = labelled.where(draw).select(F.col(id_col).alias("k"), F.col(text_col).alias("t"), F.col(lang_col).alias("l"))
    rows = bounded_sample(drawn, 2 * train_rows, train_bytes)
    return train([(r.t, r.l) for r in rows])


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, score and rejected; columns of these names are replaced. The model goes along with the tasks: 2 MB for four languages."""
    names = docs.columns
    at = names.index(text_col)
    rest = [i for i, c in enumerate(names) if c not in ("lang_pred", "score", "rejected")]

    def judge(batches):
        import pyarrow as pa

        for batch in batches:
            rows = [model.predict(t) for t in batch.column(at).to_pylist()]
            lang, score, rejected = zip(*rows, strict=True) if rows else ((), (), ())
            own = [batch.column(i) for i in rest]
            yield pa.RecordBatch.from_arrays([*own, pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(rejected, pa.bool_())], names=[*[names[i] for i in rest], "lang_pred", "score", "rejected"])

    kinds = StructType([docs.schema.fields[i] for i in rest])
    return docs.mapInArrow(judge, kinds.add("lang_pred", "string").add("score", "double").add("rejected", "boolean"))


def is_held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.pmod(F.crc32(F.col(id_col).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))

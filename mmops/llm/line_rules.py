"""Quality rules by line sequence labelling (operator 10).

Base rules count words, word characters, symbols, repeated lines and words in repeated three-word windows of
the whole text. The method: the lines of a text are a sequence; a linear-chain CRF with features of
each line's form, counted over the whole line, labels them content or boilerplate, and Viterbi finds the likeliest labels. A text
is kept if it passes the base rules and its content lines hold at least ``CONTENT_SHARE`` of its word characters.

The CRF is trained on labelled texts, which ``labelled_texts`` writes from invented words: paragraphs,
short paragraphs and headings as content; licence lines, menus, tables of words, shouting, runs of symbols, lines that
repeat a word, and repeated lines as boilerplate. Nothing of it depends on the texts judged.

Null and empty texts have no words, fail the base rules and are not kept. Rows are judged one by one;
nothing is grouped. Long texts are read whole, each in one task, in memory of a few times their size.
"""

from __future__ import annotations

import math
import random
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crf import ChainCRF, slot

SYMBOLS = "#*$%&|<>"
CONTENT_SHARE = 0.3
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

# Words of notices and licences.
NOTICE_WORDS = frozenset("copyright licensed license licence rights reserved cookie cookies terms privacy policy subscribe login share click menu home contact".split())
_SPACE = " \t\n\x0b\x0c\r"
_WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeated_words(words: list) -> int:
    """Words in three-word windows that occur twice or more."""
    import numpy as np

    n = len(words)
    if n < 4:
        return 0
    ids: dict = {}
    a = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    v = len(ids)
    _, pair = np.unique(a[:-1] * v + a[1:], return_inverse=True)
    _, window, times = np.unique(pair[:-1] * v + a[2:], return_inverse=True, return_counts=True)
    starts = times[window] > 1
    hit = np.zeros(n, bool)
    for k in range(3):
        hit[k : n - 2 + k] |= starts
    return int(hit.sum())


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    chars = len(text) - sum(text.count(c) for c in _SPACE)
    symbols = sum(text.count(c) for c in SYMBOLS)
    seen, dup = set(), 0
    for line in text.split("\n"):
        if line in seen:
            dup += 1
        elif line.strip(_SPACE):
            seen.add(line)
    return len(words), chars, symbols, dup, repeated_words(words)


def line_features(lines: list[str]) -> list[list[int]]:
    """Feature slots of each line; lines are those with a word."""
    seen, out, n = set(), [], len(lines)
    for i, line in enumerate(lines):
        words = line.split()
        chars = max(1, len(line))
        upper = sum(map(str.isupper, words)) / max(1, len(words))
        marks = sum(line.count(c) for c in SYMBOLS) / chars
        distinct = len(set(words)) / max(1, len(words))
        last = line.rstrip()[-1:]
        notice = sum(w.strip(".,:") in NOTICE_WORDS for w in line.lower().split()) / max(1, len(words))
        names = (
            "bias", f"n:{min(len(words), 300).bit_length()}", f"m:{min(4, int(marks * 40))}", f"u:{int(upper * 4)}:{len(words) > 3}",
            f"r:{int(distinct * 5)}:{len(words) > 8}", f"e:{'stop' if last in '.!?' else 'other'}", f"d:{line in seen}",
            f"b:{line.count('!') * 12 > chars}", f"k:{min(3, math.ceil(notice * 10))}",
            f"g:{sum(map(str.isdigit, line)) * 5 > chars}", f"p:{'first' if i == 0 else 'last' if i == n - 1 else 'mid'}",
        )
        seen.add(line)
        out.append([slot("line/" + f) for f in names])
    return out


def labelled_texts(count: int = 400, seed: int = 41) -> list[tuple[list[str], list[int]]]:
    """[(lines, labels)], 1 for content."""
    rng = random.Random(seed)
    pick, chance = rng.choice, lambda p: rng.random() < p
    syllables = "an ber chi do er fa gu hil io ka lo men nu or pa que ri sta tion ul ver wen xi yo zu é ñ ü".split()

    def word():
        return "".join(pick(syllables) for _ in range(rng.randint(1, 4)))

    def words(lo, hi):
        return " ".join(word() for _ in range(rng.randint(lo, hi)))

    def prose(lo, hi):
        return " ".join(words(1, 22).capitalize() + pick((".", ".", ".", ",", "?")) for _ in range(rng.randint(lo, hi)))

    def boilerplate():
        kind = rng.randrange(7)
        if kind == 0:
            return pick(("Licensed under {}.", "Copyright {} all rights reserved", "© 2020 {}. Terms and privacy policy.", "This site uses cookies {}.", "Share | Subscribe | Login | {}")).format(words(1, 5))
        if kind == 1:
            return " | ".join(words(1, 1) for _ in range(rng.randint(4, 30)))
        if kind == 2:
            return words(4, 40).upper().replace(" ", pick(("!! ", "! ", " "))) + "!!"
        if kind == 3:
            mark = pick(("###", "***", "$$$", "%%%", "&&&"))
            return " ".join(w + pick((mark, "***", "&&&")) for w in words(3, 60).split())
        if kind == 4:
            return " ".join([word()] * rng.randint(6, 90))
        if kind == 5:
            return " ".join([words(2, 3)] * rng.randint(5, 40))
        return pick("#*|<>$") * rng.randint(3, 60) + " " + words(0, 2)

    out = []
    for _ in range(count):
        lines, labels = [], []
        for _ in range(rng.randint(1, 14)):
            if chance(0.7):
                line, y = pick((prose(1, 8), prose(1, 3), prose(1, 1), words(1, 6).capitalize() + pick(("", "."))), ), 1
                lines.append(line)
                labels.append(y)
            else:
                for _ in range(rng.choice((1, 1, 2, 4))):
                    lines.append(boilerplate())
                    labels.append(0)
            if lines and chance(0.08):
                lines.append(pick(lines))
                labels.append(0)
        out.append((lines, labels))
    return out


def train(texts: list[tuple[list[str], list[int]]] | None = None) -> ChainCRF:
    return ChainCRF(2).train([(line_features(lines), labels) for lines, labels in (texts if texts is not None else labelled_texts())])


def label_lines(model: ChainCRF, text: str) -> list[tuple[str, int]]:
    """The lines with a word and their labels."""
    lines = [x for x in text.split("\n") if x.strip(_SPACE)]
    return list(zip(lines, model.decode(line_features(lines)), strict=True))


def content_share(model: ChainCRF, text: str) -> float:
    """The share of the characters beside white space that content lines have; 0 of none."""
    sized = [(len(line) - sum(line.count(c) for c in _SPACE), y) for line, y in label_lines(model, text)]
    return sum(n for n, y in sized if y) / max(1, sum(n for n, _ in sized))


def judge(docs: DataFrame, model: ChainCRF, id_col: str = "doc_id", text_col: str = "text", share: float = CONTENT_SHARE) -> DataFrame:
    """A row per document: the id, the base counts, base_failed, content_share and kept."""

    def run(batches):
        import pyarrow as pa

        names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "content_share", "kept"]
        types = [pa.int64()] * 5 + [pa.bool_(), pa.float64(), pa.bool_()]
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                counts = base_counts(text or "")
                failed = counts[0] < MIN_WORDS or 100 * counts[4] > MAX_REPEAT_PERCENT * counts[0]
                content = content_share(model, text or "")
                rows.append((*counts, failed, content, not failed and content >= share))
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, t) for c, t in zip(zip(*rows, strict=True) if rows else [[]] * len(types), types, strict=True)]], names=["id", *names])

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, content_share double, kept boolean"
    return docs.select(F.col(id_col).alias("id"), F.col(text_col)).mapInArrow(run, schema).withColumnRenamed("id", id_col)

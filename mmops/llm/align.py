"""Alignment of two tokenizers' tokens over one text (operator 13).

A text with a space before it is cut into tokens by a byte-level BPE (A) and a sentencepiece model (B). Byte offsets where tokens of both end
cut the tokens into groups; each A and B token whose bytes overlap are a link.

Method: divide and conquer at shared cuts. Of an interval the A end in the middle, or else the nearest to it, that bisection finds among the B
ends is a shared cut, and both halves go on; an interval without one is a leaf: a group. All intervals of a depth, of all texts of a batch, are
searched together; an end that was found not to be shared is not asked again, so each A end is bisected once.

Counts are over documents: a row's distinct linked id pairs are written once, counted with partial sums before the shuffle, and come back by
a join, broadcast up to a checked size, whose sums are taken in each task before they are shuffled by row.

Null and empty texts, and those that a tokenizer does not give back byte for byte, have no tokens: zeros and an empty groups string. Special
tokens' strings are plain text. Repeated rows and rows of null ids are documents like others; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import re
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .byte_bpe import CACHE_LIMIT, CACHED_CHARS, _each_bytes, default_tokenizer_path, encoder_for, token_bytes
from .common import Scratch, bounded_broadcast

GROUP_CHARS = 2_000_000
PAIR_BYTES = 48
#: Words, each with the spaces before it; the last also with those behind it.
_WORDS = re.compile(r" +[^ ]+(?: +\Z)?| +\Z")


def default_model_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class PieceModel:
    """A sentencepiece model, and each id's bytes.

    If no piece of it has a space mark behind another character, no token crosses from a character to a space after it. A
    text's ids are then those of its words, each with the spaces before it, and words that were seen before need no second encoding.
    """

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        sp, ids = self.model, range(self.model.vocab_size())
        self.token_bytes = [bytes([int(sp.id_to_piece(i)[3:5], 16)]) if sp.is_byte(i) else sp.id_to_piece(i).replace("▁", " ").encode() for i in ids]

        self._by_words = all("▁" not in sp.id_to_piece(i).lstrip("▁") for i in ids)
        self._cache: dict[str, bytes] = {}
        self._lost: set[str] = set()  # words that are not given back byte for byte

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        ids = self.model.encode([w[1:] for w in new], num_threads=1) if new else []
        get, want = self.token_bytes.__getitem__, [w.encode() for w in new]
        # All at once, as words are nearly always given back: if not, one by one.
        if b"".join(map(get, chain.from_iterable(ids))) != b"".join(want) or [sum(map(len, map(get, own))) for own in ids] != list(map(len, want)):
            self._lost.update(w for w, own, x in zip(new, ids, want, strict=True) if b"".join(map(get, own)) != x)
        return dict(zip(new, _each_bytes(ids), strict=True))

    def encode_all(self, texts: list[str]) -> list[tuple[bytes, bool]]:
        """(ids, whether their bytes are a space and the text) of each text."""
        held = [_WORDS.findall(" " + t) if self._by_words else [" " + t] for t in texts]
        if len(self._cache) + len(self._lost) > CACHE_LIMIT:
            self._cache.clear()
            self._lost.clear()
        found = self._learn(list(set().union(*held).difference(self._cache)))
        self._cache.update((w, x) for w, x in found.items() if len(w) <= CACHED_CHARS)
        known, out = self._cache, []
        long = any(len(w) > CACHED_CHARS for w in found)
        for words in held:
            ids = [known[w] if w in known else found[w] for w in words] if long else map(known.__getitem__, words)
            out.append((b"".join(ids), self._lost.isdisjoint(words)))
        return out


@lru_cache(maxsize=2)
def model_for(path: str) -> PieceModel:
    return PieceModel(path)


@lru_cache(maxsize=2)
def _tables(path_a: str, path_b: str):
    """The bytes in each id, and each id's decimal with the mark after it, of both tokenizers."""
    import numpy as np

    a, b = token_bytes(path_a), model_for(path_b).token_bytes
    sizes = [np.array([len(x) for x in t], dtype=np.int64) for t in (a, b)]
    # Marks: , between a group's ids, | after its A ids, ; after its B ids.
    written = [[f"{i}{mark}" for mark in marks for i in range(len(t))] for t, marks in ((a, ",|"), (b, ",;"))]
    return *sizes, written[0] + written[1], len(written[0])


def shared_cuts(a_ends, b_ends):
    """Indices into ``a_ends`` and ``b_ends`` (both rising) of the values that they share, in order.

    Divide and conquer: of each open interval of A ends, the nearest to the middle that bisection finds in B splits it. The A ends
    passed over on the way are shared by none, so neither half asks them again.
    """
    import numpy as np

    cuts = []
    low, high = np.array([0], dtype=np.int64), np.array([len(a_ends)], dtype=np.int64)
    while True:
        keep = low < high
        low, high = low[keep], high[keep]
        if not low.size:
            break
        left = (low + high) // 2  # ends of [left, right) have been asked
        right = left.copy()
        open_, next_low, next_high = np.arange(low.size), [], []
        forward = True
        while open_.size:
            # The middle and those after it, in turn with those before it; where one side is used up, the other goes on.
            at_right = right[open_] < high[open_]
            at_left = left[open_] > low[open_]
            going = at_right | at_left
            open_, at_right, at_left = open_[going], at_right[going], at_left[going]
            use_right = at_right & (forward | ~at_left)
            forward = not forward
            ask = np.where(use_right, right[open_], left[open_] - 1)
            right[open_[use_right]] += 1
            left[open_[~use_right]] -= 1
            value = a_ends[ask]
            where = np.searchsorted(b_ends, value)
            hit = (where < len(b_ends)) & (b_ends[np.minimum(where, len(b_ends) - 1)] == value)
            found = open_[hit]
            cuts.append(ask[hit])
            # What is left of the interval on both sides of all that was asked.
            next_low += [low[found], right[found]]
            next_high += [left[found], high[found]]
            open_ = open_[~hit]
        if not next_low:
            break
        low, high = np.concatenate(next_low), np.concatenate(next_high)
        order = np.argsort(low)  # neighbours are looked up together
        low, high = low[order], high[order]
    a = np.sort(np.concatenate(cuts)) if cuts else np.zeros(0, dtype=np.int64)
    return a, np.searchsorted(b_ends, a_ends[a])


def align(texts: list[str | None], path_a: str, path_b: str) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, groups_sha256, a ids, b ids and numbers of its distinct links as arrays) of each text."""
    import numpy as np

    sizes_a, sizes_b, written, base_b = _tables(path_a, path_b)
    texts = [t or "" for t in texts]
    raw_a = [np.frombuffer(ids, dtype="<u4").astype(np.int64) for ids in encoder_for(path_a, False).encode_all(" " + t if t else "" for t in texts)]
    coded_b = model_for(path_b).encode_all(texts)
    raw_b = [np.frombuffer(ids, dtype="<u4").astype(np.int64) for ids, _ in coded_b]
    none = np.zeros(0, dtype=np.int64)
    result: list[tuple] = [(0, 0, 0, 0, "", none, none, none)] * len(texts)
    # A byte-level BPE keeps each byte or drops one that it lacks, so sizes tell.
    whole = [k for k, text in enumerate(texts) if text and coded_b[k][1] and sizes_a[raw_a[k]].sum() == len(text.encode()) + 1]
    if not whole:
        return result
    # All texts one after another: their own ends are shared cuts.
    a, b = np.concatenate([raw_a[k] for k in whole]), np.concatenate([raw_b[k] for k in whole])
    first_a, first_b = (np.cumsum([0, *[len(raw[k]) for k in whole]]) for raw in (raw_a, raw_b))
    a_ends, b_ends = np.cumsum(sizes_a[a]), np.cumsum(sizes_b[b])
    cut_a, cut_b = shared_cuts(a_ends, b_ends)
    # Each stretch between neighbouring ends, of whichever side, is what one A and one B token share: a link.
    both_a, both_b = np.zeros(len(a), dtype=bool), np.zeros(len(b), dtype=bool)
    both_a[cut_a], both_b[cut_b] = True, True
    ends = np.sort(np.concatenate([a_ends * 2, b_ends[~both_b] * 2 + 1]), kind="stable")  # B's own are odd
    of_a = ends & 1 == 0
    of_b = ~of_a
    of_b[of_a] = both_a
    link_a, link_b = np.cumsum(of_a) - of_a, np.cumsum(of_b) - of_b
    # Marks after each id: the last of a group's ids has another. A and B ids in the order of groups.
    mark_a, mark_b = a.copy(), b + base_b
    mark_a[cut_a] += len(sizes_a)
    mark_b[cut_b] += len(sizes_b)
    group_a, group_b = np.cumsum(both_a) - both_a, np.cumsum(both_b) - both_b
    line = np.empty(len(a) + len(b), dtype=np.int64)
    before_b = np.concatenate([[0], cut_b + 1])  # B tokens of the groups before
    line[np.arange(len(a)) + before_b[group_a]] = mark_a
    line[np.arange(len(b)) + (cut_a + 1)[group_b]] = mark_b
    links_of = np.searchsorted(link_a, first_a)  # links are in the order of A tokens, and none crosses texts
    groups_of = np.searchsorted(cut_a, first_a)
    for n, k in enumerate(whole):
        a0, a1, b0, b1 = first_a[n], first_a[n + 1], first_b[n], first_b[n + 1]
        said = "".join(map(written.__getitem__, line[a0 + b0 : a1 + b1].tolist()))[:-1]
        i, j = links_of[n], links_of[n + 1]
        pairs, times = np.unique(a[link_a[i:j]] << 32 | b[link_b[i:j]], return_counts=True)
        result[k] = (int(a1 - a0), int(b1 - b0), int(groups_of[n + 1] - groups_of[n]), int(j - i), hashlib.sha256(said.encode()).hexdigest(), pairs >> 32, pairs & 0xFFFFFFFF, times)
    return result


def _grouped(texts):
    """A few texts at a time."""
    held, size = [], 0
    for t in texts:
        held.append(t)
        size += len(t or "")
        if size >= GROUP_CHARS:
            yield held
            held, size = [], 0
    if held:
        yield held


def token_links(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None) -> DataFrame:
    """A row per document: row (an id of its own), the id column, n_a, n_b, n_groups, n_links, groups_sha256, and links, its distinct (a, b, n)."""
    path_a, path_b = path_a or default_tokenizer_path(), path_b or default_model_path()
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            at = 0
            for texts in _grouped(t.as_py() for t in batch.column(2)):
                found = align(texts, path_a, path_b)
                counts = [pa.array(c, pa.int64()) for c in list(zip(*found, strict=True))[:4]]
                offsets = pa.array(np.cumsum([0, *[len(f[5]) for f in found]]), pa.int32())
                parts = [pa.array(np.concatenate([f[c] for f in found]), pa.int32()) for c in (5, 6, 7)]
                links = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(parts, names=["a", "b", "n"]))
                own = [batch.column(c).slice(at, len(texts)) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*own, *counts, pa.array([f[4] for f in found], pa.string()), links], names=["row", "id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "links"])
                at += len(texts)

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    found = rows.mapInArrow(run, f"row long, id {kind}, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, links array<struct<a:int,b:int,n:int>>")
    return found.withColumnRenamed("id", id_col)


def pair_counts(links: DataFrame) -> DataFrame:
    """a, b, count (documents that hold the pair linked), best (count is the highest of its a)."""
    counts = links.select(F.explode("links").alias("l")).groupBy("l.a", "l.b").agg(F.count("*").alias("count"))
    most = counts.groupBy(F.col("a").alias("m")).agg(F.max("count").alias("most"))
    return counts.join(most, F.col("a") == F.col("m")).select("a", "b", "count", (F.col("count") == F.col("most")).alias("best"))


def alignment(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_a: str | None = None, path_b: str | None = None, broadcast_bytes: int = 64 << 20) -> DataFrame:
    """The id column, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256."""
    scratch = Scratch(docs.sparkSession, "align")
    links = scratch.table(token_links(docs, id_col, text_col, path_a, path_b), "links", keep=True)
    counts = scratch.table(pair_counts(links), "counts", keep=True)
    n = counts.count()
    known = bounded_broadcast(counts.select(F.col("a").alias("ka"), F.col("b").alias("kb"), "count", "best"), n, PAIR_BYTES, broadcast_bytes)
    each = links.select("row", F.explode("links").alias("l")).select("row", "l.*")
    found = each.join(known, (F.col("a") == F.col("ka")) & (F.col("b") == F.col("kb")))
    sums = found.groupBy(F.col("row").alias("r")).agg(F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("count")).alias("count_sum"))
    facts = links.select("row", F.col(id_col).alias("id"), "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
    joined = facts.join(sums, F.col("row") == F.col("r"), "left")
    return joined.select(F.col("id").alias(id_col), "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", F.lit(0)).alias("n_best"), F.coalesce("count_sum", F.lit(0)).alias("count_sum"), "groups_sha256")

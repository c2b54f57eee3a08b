r"""Byte-level BPE of whole texts by tree concatenation, and back (operator 11).

A long text is cut into halves, and those again, wherever the middle falls. Leaves are encoded apart; two neighbours are joined by
encoding anew only what the cut can have changed:

* Pieces, which the tokenizer's pattern splits a text into and no token crosses: from the last piece of the left side that looked at the
  cut, a window grows to the right until one of its borders is one of the right side's own. Matches look at most ``LOOK``
  characters ahead of their start beyond their own end and the character after it, and never back, so both sides agree from there on.
* Tokens of a piece that the cut split: a window of the k last and k first tokens, k = 1, 2, 4, ..., is encoded anew until its ends agree
  with the tokens beside it. A row of tokens is BPE's own answer if each two neighbours are that of their two strings.

Texts over ``part_chars`` are dealt out to tasks by parts, whose results meet in the same tree; shorter ones never leave their task. So only
long texts are shuffled, and one text's tokens are the most that a group holds.

Null texts are empty and have no ids; the special tokens' strings become their ids, as in the library. Repeated rows and null ids are rows
like others, and other columns are not looked at. Unknown ids have no text. Ids are little-endian unsigned 32-bit numbers in one binary.
"""

from __future__ import annotations

import array
import json
import os
import re
import sys
from bisect import bisect_left, bisect_right
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import _LETTERS, _NUMBERS, _PLAIN

LEAF_CHARS = 4096
PART_CHARS = 65_536
CACHE_LIMIT = 250_000
CACHED_CHARS = 48
GROUP_PIECES = 100_000
BATCH_BYTES = 4 << 20
LOOK = 3  # of a contraction such as 'll

# The pattern of byte-level tokenizers of this kind, for texts of the characters in _PLAIN.
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[{_NUMBERS}]+| ?[^\s{_LETTERS}{_NUMBERS}]+|\s+(?!\S)|\s+")


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes(ids) -> bytes:
    found = array.array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tobytes()


def _each_bytes(lists) -> list[bytes]:
    """:func:`_bytes` of many lists at once."""
    sizes = list(map(len, lists))
    flat, out, at = _bytes(chain.from_iterable(lists)), [], 0
    for size in sizes:
        out.append(flat[at : at + 4 * size])
        at += 4 * size
    return out


def _numbers(ids: bytes) -> list[int]:
    found = array.array("I", ids)
    if sys.byteorder == "big":
        found.byteswap()
    return found.tolist()


def byte_alphabet() -> dict[str, int]:
    """The character that stands for each byte: itself if it can be seen, else the next free one from 256 on."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(rest)}


class ByteBPE:
    """Encodes and decodes with a byte-level BPE tokenizer. ``specials=False`` takes the special tokens' strings as plain text."""

    def __init__(self, path: str, specials: bool = True, leaf_chars: int = LEAF_CHARS):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        added = spec.get("added_tokens") or []
        if spec.get("normalizer") or split.get("type") != "ByteLevel" or split.get("add_prefix_space") or not split.get("use_regex") or any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in added):
            raise ValueError("not a plain byte-level tokenizer")
        self._tok = Tokenizer.from_file(path)
        self._tok.no_truncation()
        self._tok.no_padding()
        self._tok.encode_special_tokens = not specials
        self._special = {t["content"]: _bytes([t["id"]]) for t in added} if specials else {}
        names = sorted(self._special, key=len, reverse=True)
        self._marks = re.compile("|".join(map(re.escape, names))) if names else None
        self.leaf_chars = leaf_chars
        self._cache: dict[str, bytes] = {}
        vocab = self._tok.get_vocab(with_added_tokens=False)
        self._names = {i: t for t, i in vocab.items()}
        self._one_piece = self._by_ranks(vocab, spec["model"]["merges"])
        self._agree = lru_cache(maxsize=100_000)(lambda a, b: self._bpe(self._names[a] + self._names[b]) == [a, b])

    @staticmethod
    def _by_ranks(vocab: dict[str, int], merges: list):
        """The ids of one piece's bytes by a library that merges by rank, which is the same where ids rise with the order of merges; else None."""
        import tiktoken

        ranks = [vocab["".join(m) if not isinstance(m, str) else m.replace(" ", "")] for m in merges]
        alphabet = byte_alphabet()
        if any(a >= b for a, b in zip(ranks, ranks[1:], strict=False)) or not all(c in vocab and vocab[c] < ranks[0] for c in alphabet):
            return None
        known = {bytes(map(alphabet.__getitem__, t)): i for t, i in vocab.items()}
        return tiktoken.Encoding("pieces", pat_str=r"(?s).+", mergeable_ranks=known, special_tokens={})._core_bpe.encode_single_piece

    def _bpe(self, letters: str) -> list[int]:
        return [t.id for t in self._tok.model.tokenize(letters)]

    def _split(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text):
            return _PIECES.findall(text)
        return [text[a:b] for _, (a, b) in self._tok.pre_tokenizer.pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[str]:
        """Pieces of a text; each special token is one."""
        if self._marks is None or not self._marks.search(text):
            return self._split(text)
        found, at = [], 0
        for m in self._marks.finditer(text):
            found += [*self._split(text[at : m.start()]), m[0]]
            at = m.end()
        return found + self._split(text[at:])

    def halves(self, text: str, most: int) -> list[str]:
        """A power of two of parts of at most about ``most`` characters; cuts inside a special token go before it."""
        if len(text) <= most:
            return [text]
        depth = (-(-len(text) // most) - 1).bit_length()
        cuts = [len(text) * k >> depth for k in range((1 << depth) + 1)]
        for a, b in (m.span() for m in self._marks.finditer(text)) if self._marks is not None else ():
            for j in range(bisect_right(cuts, a), bisect_left(cuts, b)):
                cuts[j] = a
        return [text[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]

    def _learn(self, pieces: Iterable[str]) -> dict[str, bytes]:
        """Ids of the pieces that the cache lacks; short ones are kept."""
        if len(self._cache) > CACHE_LIMIT:
            self._cache.clear()
            self._cache.update(self._special)
        new = [p for p in pieces if p not in self._cache and p not in self._special]
        one = self._one_piece
        ids = [one(p.encode()) for p in new] if one else [e.ids for e in self._tok.encode_batch_fast(new, add_special_tokens=False)]
        found = dict(zip(new, _each_bytes(ids), strict=True))
        self._cache.update((p, ids) for p, ids in found.items() if len(p) <= CACHED_CHARS)
        self._cache.update(self._special)
        return {p: ids for p, ids in found.items() if len(p) > CACHED_CHARS}

    def leaves(self, texts: Iterable[str]) -> Iterator[tuple[list[str], list[bytes]]]:
        """(pieces, their ids) of each text, a few texts at a time; texts are not halved here."""
        held, size = [], 0

        def known():
            long = self._learn(set().union(*held))
            cache = self._cache
            for pieces in held:
                yield pieces, [long[p] if p in long else cache[p] for p in pieces] if long else list(map(cache.__getitem__, pieces))

        for text in texts:
            held.append(self.pieces(text))
            size += len(held[-1])
            if size >= GROUP_PIECES:
                yield from known()
                held, size = [], 0
        yield from known()

    def _joined_tokens(self, left: bytes, right: bytes) -> bytes:
        a, b, k = _numbers(left), _numbers(right), 1
        while True:
            at, to = max(0, len(a) - k), min(k, len(b))
            window = self._bpe("".join(map(self._names.__getitem__, a[at:] + b[:to])))
            if (not at or self._agree(a[at - 1], window[0])) and (to == len(b) or self._agree(window[-1], b[to])):
                return _bytes(a[:at] + window + b[to:])
            k *= 2

    def join(self, left: tuple[list[str], list[bytes]], right: tuple[list[str], list[bytes]]) -> tuple[list[str], list[bytes]]:
        """Pieces and ids of two neighbouring stretches as one text's."""
        (lp, li), (rp, ri) = left, right
        if not lp or not rp or lp[-1] in self._special or rp[0] in self._special:
            return lp + rp, li + ri
        u, before = len(lp) - 1, len(lp[-1])
        while u and lp[u - 1] not in self._special and before + len(lp[u - 1]) < LOOK:
            u -= 1
            before += len(lp[u])
        tail, k = "".join(lp[u:]), 4
        while True:
            head = rp[:k]
            mark = next((j for j, p in enumerate(head) if p in self._special), None)
            ended = mark is not None or k >= len(rp)
            head = head[:mark]
            window = tail + "".join(head)
            borders, at = {before: 0}, before
            for j, p in enumerate(head):
                at += len(p)
                borders[at] = j + 1
            new, at, own = self._split(window), 0, None
            for n, p in enumerate(new):
                start, at = at, at + len(p)
                if not ended and (at == len(window) or start + LOOK > len(window)):
                    break
                if at in borders:
                    own = borders[at]
                    break
            if own is not None:
                break
            k *= 2
        new, ids, at = new[: n + 1], [], 0
        for p in new:
            end = at + len(p)
            if at < before < end and at == before - len(lp[-1]) and end == before + len(rp[0]):
                ids.append(self._joined_tokens(li[-1], ri[0]))
            elif p in self._cache:
                ids.append(self._cache[p])
            else:
                ids.append(self._learn([p]).get(p) or self._cache[p])
            at = end
        return lp[:u] + new + rp[own:], li[:u] + ids + ri[own:]

    def tree(self, parts: list[tuple[list[str], list[bytes]]]) -> tuple[list[str], list[bytes]]:
        while len(parts) > 1:
            parts = [self.join(parts[k], parts[k + 1]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0]

    def stretches(self, texts: Iterable[str | None]) -> Iterator[tuple[list[str], list[bytes]]]:
        """(pieces, their ids) of each whole text: halves, encoded apart, and joined."""
        counts: list[int] = []

        def cut():
            for text in texts:
                found = self.halves(text or "", self.leaf_chars)
                counts.append(len(found))
                yield from found

        held, done = [], 0
        for leaf in self.leaves(cut()):
            held.append(leaf)
            if len(held) == counts[done]:
                yield self.tree(held)
                held, done = [], done + 1

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        for _, ids in self.stretches(texts):
            yield b"".join(ids)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """Each id's bytes; of ids that are not there none. From the file alone, as decoding needs no tokenizer."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    alphabet, vocab = byte_alphabet(), spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
    found = [b""] * (max(vocab.values()) + 1)
    for token, i in vocab.items():
        found[i] = bytes(map(alphabet.__getitem__, token)) if all(c in alphabet for c in token) else token.encode()
    return found


def _sliced(rows, names: list[str], types: list):
    """Record batches of about BATCH_BYTES of rows; the last column counts."""
    import pyarrow as pa

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[-1])
        if size >= BATCH_BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


@lru_cache(maxsize=2)
def encoder_for(path: str, specials: bool = True, leaf_chars: int = LEAF_CHARS) -> ByteBPE:
    """One encoder a Python worker, so its cache serves all the tasks that the worker runs."""
    return ByteBPE(path, specials, leaf_chars)


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer_path: str | None = None, leaf_chars: int = LEAF_CHARS, part_chars: int = PART_CHARS) -> DataFrame:
    """The id column and ``ids`` (binary) of each text."""
    path = tokenizer_path or default_tokenizer_path()
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))

    def whole(batches):
        import pyarrow as pa

        encoder = encoder_for(path, True, leaf_chars)
        for batch in batches:
            ids = encoder.encode_all(t.as_py() for t in batch.column(1))
            yield from _sliced(zip(batch.column(0).to_pylist(), ids, strict=True), ["id", "ids"], [batch.column(0).type, pa.binary()])

    def parts(batches):
        import pyarrow as pa

        encoder = encoder_for(path, True, leaf_chars)
        for batch in batches:
            for k in range(batch.num_rows):
                found = encoder.halves(batch.column(2)[k].as_py(), part_chars)
                same = [batch.column(c).slice(k, 1).take(pa.array([0] * len(found))) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*same, pa.array(range(len(found)), pa.int32()), pa.array(found, pa.string())], names=["row", "id", "part", "text"])

    def encoded(batches):
        import pyarrow as pa

        encoder, names = encoder_for(path, True, leaf_chars), ["row", "id", "part", "text", "sizes", "counts", "ids"]
        for batch in batches:
            found = encoder.stretches(t.as_py() for t in batch.column(3))
            own = zip(*[c.to_pylist() for c in batch.columns], strict=True)
            out = ((*o, _bytes(map(len, p)), _bytes(len(i) // 4 for i in ids), b"".join(ids)) for o, (p, ids) in zip(own, found, strict=True))
            yield from _sliced(out, names, [*[c.type for c in batch.columns], *[pa.binary()] * 3])

    def joined(batches):
        """Parts of a text come one after another; equal depths are joined as soon as both are there."""
        import pyarrow as pa

        encoder, key, stack = encoder_for(path, True, leaf_chars), None, []

        def close():
            while len(stack) > 1:
                (d, right), (_, left) = stack.pop(), stack.pop()
                stack.append((d, encoder.join(left, right)))
            return pa.RecordBatch.from_arrays([key[1], pa.array([b"".join(stack[0][1][1])], pa.binary())], names=["id", "ids"])

        for batch in batches:
            for k in range(batch.num_rows):
                row, _, _, text, sizes, counts, ids = (c[k].as_py() if n != 1 else None for n, c in enumerate(batch.columns))
                if key is None or key[0] != row:
                    if key is not None:
                        yield close()
                    key, stack = (row, batch.column(1).slice(k, 1)), []
                pieces, own, at, to = [], [], 0, 0
                for size, count in zip(_numbers(sizes), _numbers(counts), strict=True):
                    pieces.append(text[at : at + size])
                    own.append(ids[to : to + 4 * count])
                    at, to = at + size, to + 4 * count
                stack.append((0, (pieces, own)))
                while len(stack) > 1 and stack[-1][0] == stack[-2][0]:
                    (d, right), (_, left) = stack.pop(), stack.pop()
                    stack.append((d + 1, encoder.join(left, right)))
        if key is not None:
            yield close()

    short = rows.where(F.length("text") <= part_chars).mapInArrow(whole, f"id {kind}, ids binary")
    long = rows.where(F.length("text") > part_chars).select(F.monotonically_increasing_id().alias("row"), "id", "text")
    dealt = long.mapInArrow(parts, f"row long, id {kind}, part int, text string").repartition("row", "part")
    found = dealt.mapInArrow(encoded, f"row long, id {kind}, part int, text string, sizes binary, counts binary, ids binary")
    found = found.repartition("row").sortWithinPartitions("row", "part").mapInArrow(joined, f"id {kind}, ids binary")
    return short.unionByName(found).withColumnRenamed("id", id_col)


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", tokenizer_path: str | None = None, text_col: str = "text") -> DataFrame:
    """The id column, the ids and their text; bytes that are no UTF-8 become U+FFFD, special tokens their strings."""
    path = tokenizer_path or default_tokenizer_path()
    kind = encoded.schema[id_col].dataType.simpleString()

    def run(batches):
        import pyarrow as pa

        table = token_bytes(path)

        def text_of(ids: list[int]) -> str:
            known = ids if not ids or max(ids) < len(table) else [i for i in ids if i < len(table)]
            return b"".join(map(table.__getitem__, known)).decode("utf-8", "replace")

        for batch in batches:
            rows = ((i.as_py(), ids.as_py(), text_of(_numbers(ids.as_py() or b""))) for i, ids in zip(batch.column(0), batch.column(1), strict=True))
            yield from _sliced(rows, ["id", "ids", "text"], [batch.column(0).type, pa.binary(), pa.string()])

    found = encoded.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, ids binary, text string")
    return found.select(F.col("id").alias(id_col), F.col("ids").alias(ids_col), F.col("text").alias(text_col))

"""Token ids of whole texts by the ``tokenizers`` library, piece by piece with a bounded cache."""

from __future__ import annotations

import array
import json
import os
import re
import sys
from collections.abc import Iterable, Iterator
from functools import lru_cache

CACHE_LIMIT = 600_000
CACHED_CHARS = 48
GROUP_PIECES = 50_000
_CHUNKS = re.compile(r"[^ \t\n\r]+")

# A tokenizer's pattern of pieces, and the same for texts of the characters in _PLAIN, where there is no
# doubt about letters, numbers, spaces and lower case.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_LETTERS, _NUMBERS = "a-zA-ZªµºÀ-ÖØ-öø-ʯ", "0-9²³¹¼-¾"
_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTERS}]+|[{_NUMBERS}]|[^\s{_LETTERS}{_NUMBERS}]+")
_PLAIN = re.compile("[\t\n\r\x20-\x7e¡-įı-ʯ]*")


def default_tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkEncoder:
    """Encodes texts with a tokenizer that drops white space and splits by a pattern before it merges.

    No token spans two pieces of that pattern, so a text's ids are the ids of its pieces one after another, and a
    piece that was seen before needs no second encoding. Texts with other characters than the plain ones, or with
    marks of special tokens, and texts for tokenizers of another pattern are cut at plain white space only, which no token
    spans either.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            steps = (json.load(f).get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        self._known = steps[0].get("pattern", {}).get("Regex") == _PATTERN and steps[0].get("behavior") == "Removed" and bool(steps[0].get("invert"))
        self._tok = Tokenizer.from_file(path)
        self._cache: dict[str, bytes] = {}

    def _cut(self, text: str) -> list[str]:
        if self._known and "<|" not in text and _PLAIN.fullmatch(text):
            return _PIECES.findall(text.lower())
        return _CHUNKS.findall(text)

    def _learn(self, new: list[str]) -> dict[str, bytes]:
        found = {}
        for piece, e in zip(new, self._tok.encode_batch_fast(new, add_special_tokens=False), strict=True):
            ids = array.array("I", e.ids)
            if sys.byteorder == "big":
                ids.byteswap()
            found[piece] = ids.tobytes()
        return found

    def encode_all(self, texts: Iterable[str | None]) -> Iterator[bytes]:
        """The little-endian unsigned 32-bit ids of each text; of a null text none. Texts are taken a few at a time."""
        held: list[list[str]] = []
        size = 0
        for text in texts:
            held.append(self._cut(text or ""))
            size += len(held[-1])
            if size >= GROUP_PIECES:
                yield from self._joined(held)
                held, size = [], 0
        yield from self._joined(held)

    def _joined(self, held: list[list[str]]) -> Iterator[bytes]:
        if len(self._cache) > CACHE_LIMIT:
            self._cache.clear()
        cache = self._cache
        new = list(set().union(*held).difference(cache))
        found = self._learn(new) if new else {}
        if all(len(p) <= CACHED_CHARS for p in found):
            cache.update(found)
            for pieces in held:
                yield b"".join(map(cache.__getitem__, pieces))
            return
        cache.update((p, ids) for p, ids in found.items() if len(p) <= CACHED_CHARS)
        for pieces in held:
            yield b"".join([cache[p] if p in cache else found[p] for p in pieces])

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))


@lru_cache(maxsize=2)
def encoder_for(path: str) -> ChunkEncoder:
    """One encoder a Python worker, so its cache serves all the tasks that the worker runs."""
    return ChunkEncoder(path)

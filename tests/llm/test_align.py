"""Alignment against a plain version over whole texts."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest

from mmops.llm import align, queries

SF = "/root/testdata/sf0.001"


def plain(docs):
    """[(id, text)] -> sorted rows of the query."""
    import sentencepiece
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tok.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte_of = {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in seen)}
    names = {i: t for t, i in tok.get_vocab().items()}
    found, docs_of = [], Counter()
    for doc, text in docs:
        if not text:
            found.append((doc, None))
            continue
        a, b = tok.encode(" " + text, add_special_tokens=False).ids, sp.encode(text)
        parts_a = [bytes(byte_of[c] for c in names[i]) for i in a]
        parts_b = [bytes([int(p[3:5], 16)]) if p[:3] == "<0x" and p[5:] == ">" and len(p) == 6 else p.replace("▁", " ").encode() for p in map(sp.id_to_piece, b)]
        if b"".join(parts_a) != (" " + text).encode() or b"".join(parts_b) != (" " + text).encode():
            found.append((doc, None))
            continue
        i = j = at_a = at_b = 0
        groups, links = [([], [])], []
        while i < len(a):
            links.append((a[i], b[j]))
            end_a, end_b = at_a + len(parts_a[i]), at_b + len(parts_b[j])
            if end_a <= end_b:
                groups[-1][0].append(a[i])
                i, at_a = i + 1, end_a
            if end_b <= end_a:
                groups[-1][1].append(b[j])
                j, at_b = j + 1, end_b
            if end_a == end_b:
                groups.append(([], []))
        said = ";".join(f"{','.join(map(str, x))}|{','.join(map(str, y))}" for x, y in groups[:-1])
        docs_of.update(set(links))
        found.append((doc, (len(a), len(b), len(groups) - 1, links, hashlib.sha256(said.encode()).hexdigest())))
    best = defaultdict(int)
    for (x, _), n in docs_of.items():
        best[x] = max(best[x], n)
    rows = [(doc, *((0,) * 6), "") if f is None else (doc, f[0], f[1], f[2], len(f[3]), sum(docs_of[p] == best[p[0]] for p in f[3]), sum(docs_of[p] for p in f[3]), f[4]) for doc, f in found]
    return sorted(rows, key=str)


COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
ODD = [(1, None), (2, ""), (3, " "), (4, "one two"), (4, "one two"), (5, "The quick brown fox. " * 3000), (6, "x" * 5000 + "=" * 333), (7, "中文字 日本語 😀👍"), (None, "<|endoftext|> <s> </s> <0x41>"), (None, "a ▁ b"), (-8, "é́ﬁ\r\n\t\x00\x7f"), (9, "  \n\n  unhappily  anti-establishment 1234567890"), (10, "​﻿ x")]


def rows(df):
    return sorted((tuple(r) for r in df.select(*COLUMNS).collect()), key=str)


def test_odd_rows(spark):
    df = spark.createDataFrame([(*r, "links", 1, 2) for r in ODD], "doc_id long, text string, links string, row int, id int")
    want = plain(ODD)
    assert rows(align.alignment(df)) == want
    assert rows(align.alignment(df, broadcast_bytes=0)) == want
    assert sum(r[1] > 0 for r in want) >= 8
    assert align.alignment(df.limit(0)).collect() == []


def test_given_documents(spark):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert rows(queries.op13_align(spark, SF)) == plain(docs)


@pytest.mark.parametrize("density", [0.01, 0.3, 0.9])
def test_shared_cuts(density):
    rng = random.Random(density)
    for _ in range(200):
        n = rng.randrange(1, 300)
        a, b = (np.array(sorted({*(x for x in range(n) if rng.random() < density), n})) for _ in range(2))
        i, j = align.shared_cuts(a, b)
        assert a[i].tolist() == b[j].tolist() == sorted({*a.tolist()} & {*b.tolist()})
    assert [x.size for x in align.shared_cuts(np.arange(1, 9, 2), np.arange(2, 9, 2))] == [0, 0]

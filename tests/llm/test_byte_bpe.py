"""Tree concatenation against the tokenizers library on whole texts."""

import hashlib
import random
import struct

import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from mmops.llm import byte_bpe, queries

PATH = public_tokenizers.path("byte_bpe_50k.json")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    return lambda texts: [e.ids for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)], tok.decode


def numbers(blobs):
    return [list(struct.unpack(f"<{len(b) // 4}I", b)) for b in blobs]


ALPHABETS = ["ab", "a ", "x", "=-", " \n", "'s ltre", "日本語中文", "é ïß", "0123456789", "the cat's we'll ", "😀👍 a", "ab  c ", "aA1!? \n\t", "ﬁ́a'"]


@pytest.mark.parametrize("alphabet", ALPHABETS)
@pytest.mark.parametrize("leaf", [3, 8, 64])
def test_random_texts(alphabet, leaf, library):
    rng, bpe = random.Random(f"{alphabet}{leaf}"), byte_bpe.ByteBPE(PATH, leaf_chars=leaf)
    texts = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(60)]
    texts += [c * n for c in alphabet[:2] for n in (leaf + 1, 333, 1500)]
    assert numbers(bpe.encode_all(texts)) == library[0](texts)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["<|endoftext|>", "<|endof", "text|>", "'", "ll", " ", "  ", "\n", "word", "xxxxxx", "7", "!!", "é", "中", "　", "\u0085", "\x1c"]), max_size=40))
def test_marks_and_spaces(parts):
    bpe, text = byte_bpe.encoder_for(PATH, True, 5), "".join(parts)
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(PATH)
    assert numbers(bpe.encode_all([text])) == [tok.encode(text, add_special_tokens=False).ids]
    tok.encode_special_tokens = True
    assert numbers(byte_bpe.encoder_for(PATH, False, 5).encode_all([text])) == [tok.encode(text, add_special_tokens=False).ids]


ODD = [(1, None), (2, ""), (3, " \n\t "), (4, "one two"), (4, "one two"), (5, "the long text " * 9000), (6, "x" * 20_000), (7, "中文字" * 5000), (None, "<|endoftext|>a" * 3000), (None, " " * 9000 + "x"), (-8, "é́" * 300), (9, "\U0001f600" * 3000)]


def test_odd_rows_and_parts(spark, library):
    df = spark.createDataFrame([(*r, "ids", 1) for r in ODD], "doc_id long, text string, ids string, id int")
    want = sorted(((d, ids, t or "") for (d, t), ids in zip(ODD, library[0]([t for _, t in ODD]), strict=True)), key=str)
    for part, leaf in ((byte_bpe.PART_CHARS, byte_bpe.LEAF_CHARS), (700, 60)):
        found = byte_bpe.decode(byte_bpe.encode(df, part_chars=part, leaf_chars=leaf)).collect()
        assert sorted(((r.doc_id, numbers([r.ids])[0], r.text) for r in found), key=str) == want
    assert byte_bpe.encode(df.limit(0)).collect() == []


def test_string_ids(spark, library):
    df = spark.createDataFrame([("a", "one"), (None, "two")], "name string, body string")
    found = byte_bpe.decode(byte_bpe.encode(df, "name", "body"), "name", text_col="body").collect()
    assert sorted((str(r.name), numbers([r.ids])[0], r.body) for r in found) == [("None", library[0](["two"])[0], "two"), ("a", library[0](["one"])[0], "one")]


def test_decode_of_any_ids(spark, library):
    rng = random.Random(2)
    ids = [[rng.randrange(50_257) for _ in range(50)] for _ in range(40)] + [[99_999], []]
    df = spark.createDataFrame([(k, bytearray(struct.pack(f"<{len(i)}I", *i))) for k, i in enumerate(ids)] + [(99, None)], "doc_id long, ids binary")
    found = {r.doc_id: r.text for r in byte_bpe.decode(df).collect()}
    assert found == {99: ""} | {k: library[1](i, skip_special_tokens=False) for k, i in enumerate(ids)}


def test_given_documents(spark, library):
    docs = [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = sorted((d, len(i), sha(struct.pack(f"<{len(i)}I", *i)), sha((t or "").encode())) for (d, t), i in zip(docs, library[0]([t for _, t in docs]), strict=True))
    assert sorted(tuple(r) for r in queries.op11_bpe(spark, SF).collect()) == want

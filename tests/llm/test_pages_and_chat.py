"""Chat formatting, HTML extraction, line rules and the quality classifier."""

import hashlib
import html
import re

import pytest
from pyspark.sql import functions as F

from mmops.llm import chat, html_extract, line_rules, quality_bayes

from .layouts import PAGES

SF = "/root/testdata/sf0.001"
TURNS = [
    (1, 0, "user", "hi \\ \\\\ ### x </turn> \\"), (1, 1, "assistant", "a\\"), (1, 2, "user", ""), (1, 3, "assistant", None), (1, 4, "user", "bye"),
    (2, 0, "a:b\n### c", "role with marks"), (3, 5, "assistant", "</turn>\n### user: fake </turn>\n"), (3, 5, "assistant", "</turn>\n### user: fake </turn>\n"),
    (4, None, None, "x"), (None, 1, "user", "no id"), (5, 0, "user", "long " * 20000), (5, 1, "assistant", "é\U0001f600" * 20000),
]


def test_chat(spark):
    df = spark.createDataFrame([(*t, "clash") for t in TURNS], "conv_id long, turn long, role string, text string, example string")
    examples = chat.expand(df)
    got = {r.conv_id: r for r in chat.read_back(examples).collect()}
    by_conv: dict = {}
    for c, t, role, text in sorted(TURNS, key=lambda r: (str(r[0]), r[1] or 0)):
        by_conv.setdefault(c, []).append((role or "", text or ""))
    assert set(got) == set(by_conv)
    for c, turns in by_conv.items():
        loss = "".join(x for r, x in turns if r == "assistant")
        assert (got[c].n_turns, got[c].loss_chars) == (len(turns), len(loss))
        assert got[c].turns_sha256 == hashlib.sha256("".join(f"{r}\n{x}\n" for r, x in turns).encode()).hexdigest()
        assert got[c].loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    rows = examples.where("conv_id = 1").orderBy("example").collect()
    assert [r.n_turns for r in rows] == [2, 4, 5] and rows[2].loss_start == rows[2].loss_end == len(rows[2].text)
    assert rows[1].text.startswith(rows[0].text) and sum(len(r.text) for r in rows) == got[1].formatted_chars
    assert chat.expand(df.limit(0)).count() == 0 and chat.read_back(chat.expand(df.limit(0))).count() == 0


@pytest.fixture(scope="module")
def model():
    return html_extract.train()


def test_pages(spark, model):
    pages = spark.read.parquet(f"{SF}/pages.parquet")
    got = {r.page_id: r for r in html_extract.extract(pages, model).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*)</article>", r.html, re.S)
        parts = re.split(r"</?(?:p|h1|h2|h3|div|ul|li)[^>]*>", inside[1]) if inside else []
        want = "\n\n".join(x for x in (" ".join(html.unescape(re.sub(r"<[^>]+>", " ", b)).split()) for b in parts) if x)
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def test_other_layouts(model):
    found = html_extract.labelled_pages(150, seed=501)
    right = sum(html_extract.main_text(model, p) == "\n\n".join(" ".join(t.split()) for t in main) for p, main in found)
    assert right >= 0.85 * len(found)


def test_html_oddities(spark, model):
    rows = [(1, None), (2, ""), (3, "plain"), (4, "<article><p>" + "A long text here. " * 5000), (5, "<script>var x='</p>'"), (6, "<<<>>&&&lt;"), (6, "<<<>>&&&lt;"), (7, "<article><h1>T &amp; U</h1><p>a\n b<br>c&nbsp;d</p></article>")]
    df = spark.createDataFrame([(a, b, 1, "clash") for a, b in rows], "page_id long, html string, n_chars int, text string")
    got = {r.page_id: r.text for r in html_extract.extract(df, model).collect()}
    assert got[1] == got[2] == got[5] == "" and got[7] == "T & U\n\na b c d" and len(got[4]) == 18 * 5000 - 1
    assert html_extract.extract(df.limit(0), model).count() == 0
    assert [b[0] for b in html_extract.blocks("<div>a<p>b<p>c<script>no</script><!-- no --></div>d<li>e<li>f")] == ["a", "b", "c", "d", "e", "f"]


def test_layouts_by_hand(model):
    """Of all blocks of pages that another hand laid out, nearly all are judged rightly."""
    right = total = 0
    for page, main in PAGES:
        found = [b[0] for b in html_extract.blocks(page)]
        assert all(m in found for m in main)
        got = html_extract.main_text(model, page).split("\n\n")
        right += sum((b in main) == (b in got) for b in found)
        total += len(found)
    assert right / total >= 0.9, (right, total)


@pytest.mark.parametrize(("page", "want"), [
    ("<p>one</p><script src=http://x/>var leak=1;</script><p title=don't>two</p><p>it's three</p>", ["one", "two", "it's three"]),
    ("a < b<p>c <b title='>'>d</b></p><svg/>e<style/>f{}</style>", ["a < b", "c d", "e"]), ("<div a=\"x>y</div><p>z</p>", ["y", "z"]), ("<p>x<br>y</p a='>'><p", ["x y", "'><p"]),
])
def test_broken_markup(page, want):
    assert [b[0] for b in html_extract.blocks(page)] == want


@pytest.mark.parametrize("page", ["<div>x" * 100_000, '<b "' * 100_000, '<b x="' * 100_000, "<p title=don't>t</p>" * 50_000, "<" * 200_000, "<p><button>" + "<div>x" * 100_000, "<!" * 100_000, "<div>" * 50_000 + "</span>x" * 100_000])
def test_long_pages_in_linear_time(page):
    import time

    began = time.process_time()
    html_extract.features(html_extract.blocks(page))
    assert time.process_time() - began < 10


def naive_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines, seen, dup = text.split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dup, len(hit)


def test_line_rules(spark):
    crf = line_rules.train()
    odd = ["", " \n\n ", "a a a a", "a b a b a b c", "x\nx\nx \n\nx", "é\x0bü\x1cz\u2003w #|", "one two three " * 60, "word " * 5000]
    rows = [(i, t) for i, t in enumerate([None, *odd])]
    df = spark.createDataFrame([(*r, 3) for r in rows], "doc_id long, text string, n_words int")
    docs = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) < 6000").select("doc_id", "text")
    for table in (df, docs):
        got = {r.doc_id: r for r in line_rules.judge(table, crf).collect()}
        for d, text in table.select("doc_id", "text").collect():
            want = naive_counts(text or "") if len(text or "") < 20000 else (5000, 20000, 0, 0, 5000)
            assert (got[d].n_words, got[d].word_chars, got[d].n_symbols, got[d].n_dup_lines, got[d].n_repeat_words) == want, text
            assert got[d].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0])
            assert not (got[d].kept and got[d].base_failed)
    assert line_rules.judge(df.limit(0), crf).count() == 0
    labelled = spark.read.parquet(f"{SF}/labels.parquet").join(spark.read.parquet(f"{SF}/documents.parquet"), "doc_id")
    judged = line_rules.judge(labelled, crf).join(labelled.select("doc_id", "quality"), "doc_id").where("not base_failed")
    assert judged.where("quality = 1 and not kept").count() == 0


def test_line_labels():
    crf = line_rules.train()
    pairs = [(a, b) for lines, y in line_rules.labelled_texts(60, seed=8) for a, b in zip(crf.decode(line_rules.line_features(lines)), y, strict=True)]
    assert sum(a == b for a, b in pairs) >= 0.97 * len(pairs)


def test_viterbi_and_marginals():
    """Against all label sequences."""
    import itertools

    import numpy as np

    from mmops.llm.crf import ChainCRF

    rng = np.random.default_rng(0)
    crf = ChainCRF(3)
    crf.w, crf.step, crf.start = rng.normal(size=crf.w.shape), rng.normal(size=(3, 3)), rng.normal(size=3)
    seq = [[1, 5], [2], [7, 8, 9], [4]]
    e = crf.scores(seq)
    score = {y: crf.start[y[0]] + sum(e[i, a] for i, a in enumerate(y)) + sum(crf.step[a, b] for a, b in zip(y, y[1:], strict=False)) for y in itertools.product(range(3), repeat=4)}
    assert tuple(crf.decode(seq)) == max(score, key=score.get)
    total = sum(np.exp(v) for v in score.values())
    single, pair = crf.marginals(e)
    assert np.isclose(single[2, 1], sum(np.exp(v) for y, v in score.items() if y[2] == 1) / total)
    assert np.isclose(pair[1, 0, 2], sum(np.exp(v) for y, v in score.items() if y[1:3] == (0, 2)) / total)


def test_quality(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    models = quality_bayes.fit(docs, labels)
    got = quality_bayes.classify(docs, models).join(labels, "doc_id")
    n, right = got.select(F.count("*"), F.count_if(F.col("kept") == ((F.col("quality") == 1) & (F.col("toxic") == 0)))).first()
    assert right >= 0.95 * n
    odd = spark.createDataFrame([(1, None, None, None), (2, "", "s", "x"), (2, "", "s", "x"), (3, "word " * 30000, "s", None), (None, "some text", "t", "en")], "doc_id long, text string, source string, host string").withColumn("lang", F.lit("en"))
    rows = quality_bayes.classify(odd, models).collect()
    assert len(rows) == 5 and all(0 <= r.quality_score <= 1 and r.kept is not None for r in rows)
    assert quality_bayes.classify(odd.limit(0), models).count() == 0
    assert quality_bayes.fit(docs, labels.limit(0))[1].logit(set(), [0.0] * 6) < 0


def plain_posteriors(rows, kind):
    """The site model on lists: rows (host, path, log odds of the evidence) to posteriors."""
    import math

    p_of = lambda z: 1 / (1 + math.exp(-z))
    logit = lambda p: math.log(min(max(p, 1e-6), 1 - 1e-6) / (1 - min(max(p, 1e-6), 1 - 1e-6)))
    hosts, paths = {}, {}
    for host, path, z in rows:
        for sums, key in ((hosts, host), (paths, (host, path))):
            s, n = sums.get(key, (0.0, 0))
            sums[key] = (s + p_of(z), n + 1)

    def kappa(groups, prior_of):
        total = sum(n for _, n in groups.values())
        within = sum(s * (1 - s / n) for s, n in groups.values()) / total
        between = sum(n * (s / n - prior_of(k)) ** 2 for k, (s, n) in groups.items()) / total
        return min(max(within / max(between - within * len(groups) / total, 1e-9), 1.0), 1e6)

    prior = sum(s for s, _ in hosts.values()) / len(rows)
    k_host = kappa(hosts, lambda _: prior)
    k_path = kappa(paths, lambda key: (hosts[key[0]][0] + k_host * prior) / (hosts[key[0]][1] + k_host))
    out = []
    for host, path, z in rows:
        own, (hs, hn), (s, n) = p_of(z), hosts[host], paths[host, path]
        of_host = (max(hs - own, 0) + k_host * prior) / (hn - 1 + k_host)
        of_path = (max(s - own, 0) + k_path * of_host) / (n - 1 + k_path)
        shift = quality_bayes.SITE_WEIGHT * (logit(of_path) - logit(prior))
        out.append(p_of(z + min(max(shift, -quality_bayes.SITE_LIMIT), quality_bayes.SITE_LIMIT)))
    return out


def test_posteriors_equal_plain_version_and_hold_on_unseen_documents(spark):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "labels"))
    held = F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(5)) == 0
    models = quality_bayes.fit(docs, labels.where(~held))
    rows = quality_bayes.evidence(docs, models, "doc_id", "text", F.col("source"), F.col("lang")).orderBy("id").collect()
    got = {r.doc_id: r for r in quality_bayes.classify(docs, models).collect()}
    for kind in ("quality", "toxic"):
        want = plain_posteriors([(r.host, r.path, r[kind]) for r in rows], kind)
        assert [got[r.id][f"{kind}_score"] for r in rows] == pytest.approx(want, rel=1e-6, abs=1e-9)
    judged = [(got[d].kept, q == 1 and x == 0) for d, q, x in labels.where(held).collect()]
    assert len(judged) > 50 and sum(a == b for a, b in judged) / len(judged) >= 0.93


def test_training_rows_are_defined(spark):
    """Of several labels of one id the least holds, and two runs give one model, whatever the order of rows; long texts are passed over by bytes."""
    docs = spark.createDataFrame([(i % 40, f"{'good' if i % 2 else 'bad'} word{i} " * 9) for i in range(200)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(i, 1, 1) for i in range(40)], "doc_id long, quality int, toxic int")
    a, b = (quality_bayes.fit(d, x) for d, x in ((docs, labels), (docs.repartition(7, "text"), labels.orderBy(F.desc("quality"), F.desc("doc_id")))))
    assert a[0].weights == b[0].weights and a[0].bias == b[0].bias and a[0].weights["good"] > 0 > a[0].weights["bad"] and not a[1].weights
    long = docs.unionByName(spark.createDataFrame([(1, "x " * 100_000)], "doc_id long, text string"))
    assert quality_bayes.fit(long, labels, train_bytes=100_000)[0].weights == a[0].weights


def test_shrinkage(spark):
    """A host of many poor documents lowers an unclear one more than a host of one does."""
    models = (quality_bayes.Classifier({"bad": -6.0, "good": 6.0}, [0.0] * 6, 0.0), quality_bayes.Classifier({}, [0.0] * 6, -6.0))
    rows = [(i, "bad", "poor", "p") for i in range(200)] + [(1000 + i, "good", "fine", "p") for i in range(200)] + [(1, "bad", "small", "p"), (5000, "unclear", "poor", "p"), (5001, "unclear", "fine", "p"), (5002, "unclear", "small", "p")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string")
    score = {r.doc_id: r.quality_score for r in quality_bayes.classify(df, models).where("doc_id >= 5000").collect()}
    assert score[5000] < score[5002] < score[5001]


def test_urls(spark):
    df = spark.createDataFrame([("http://www.A.example.com:80/fr/825?x=1",), ("https://m.b.org/top",), ("nothing",), (None,)], "url string")
    got = [tuple(r) for r in df.select(quality_bayes.url_host(F.col("url")), quality_bayes.url_path(F.col("url"))).collect()]
    assert got == [("a.example.com", "/fr"), ("m.b.org", "/"), (None, "/"), (None, None)]


def test_line_features_read_whole_lines():
    opening = "wenlo karimen stado berchi quenu fator lisal " * 10  # 70 words, over 300 characters
    plain, noticed, numbered = (line_rules.line_features([opening + rest])[0] for rest in ("wenlo " * 300, "Licensed under terms. " * 100, "12345 67890 " * 100))
    at = lambda f: line_rules.slot("line/" + f)
    assert at("k:0") in plain and at("k:3") in noticed
    assert at("g:False") in plain and at("g:True") in numbered
    few = line_rules.line_features([opening * 10 + "Licensed under terms."])[0]
    assert at("k:1") in few


def test_late_notices_change_the_verdict():
    crf = line_rules.train()
    prose = lambda lo, hi: " ".join(f"Tio{i}na verpar{i} gil{i}ka menzu{i}, orsta{i} hilo{i}." for i in range(lo, hi))
    notices = " ".join(f"Copyright menzu{i}, all rights reserved, licensed under terms of orsta{i}." for i in range(90))
    assert line_rules.content_share(crf, prose(0, 100)) == 1
    assert line_rules.content_share(crf, prose(0, 10) + " " + notices) == 0


def test_block_features_read_whole_blocks():
    opening = "wenlo karimen stado berchi " * 20
    late, none = html_extract.features([(opening + "12345 67890 " * 200, ("p",), (), 0), (opening, ("p",), (), 0)])
    assert html_extract.slot("d:True") in late and html_extract.slot("d:False") in none


FRAMES = {
    "body": "{}", "div": "<div>{}</div>", "container": '<div class="container">{}</div>', "output": '<div id="mw-parser-output">{}</div>', "cell": "<table><tr><td>{}</td></tr></table>", "section": "<section>{}</section>",
    "content": '<div class="content">{}</div>', "grid": '<div class="wrapper"><div class="row"><div class="col-md-8">{}</div></div></div>', "center": "<center>{}</center>", "unknown": '<div class="blogpost-xyz">{}</div>', "font": "<font size=2>{}</font>",
    "app": '<div id="root"><div id="app"><div class="css-1x2y">{}</div></div></div>', "second cell": '<table width="100%"><tr><td><ul><li><a href="x">Old</a></ul></td><td>{}</td></tr></table>', "deep": "<div><div><div><div><div>{}</div></div></div></div></div>",
    "layout": '<div id="page-1234"><div id="c2">{}</div></div>', "main": "<main>{}</main>", "named": '<section id="s-7">{}</section>', "article": "<article>{}</article>",
}
FRAMED = (
    "The mill on the coast stores the flood behind a gate of elm, and lets it out again when the sea has gone far enough back to leave a fall.",
    "Its miller worked by the moon and not by the clock, twice a day and an hour later on each day, in the dark as often as not.",
    "Few of them are left. The one at the mouth of the river was mended some years ago, and it still grinds a little on open days.",
)


@pytest.mark.parametrize("frame", FRAMES)
def test_articles_in_any_frame(frame, model):
    """Whole pages: the article and nothing else, with or without a heading, menu and footer."""
    menu = '<ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li><li><a href="/c">Contact</a></li></ul>'
    nav, foot = f"<nav>{menu}</nav>", "<footer><p>&copy; 2020 Mill Notes. All rights reserved.</p></footer>"
    for before, after in (("", ""), (nav, foot), (menu, foot), (nav, ""), ("", "<p>&copy; 2020 Mill Notes</p>")):
        for heading in ("", "How the mill kept its hours"):
            inside = (f"<h1>{heading}</h1>" if heading else "") + "".join(f"<p>{p}</p>" for p in FRAMED)
            page = f"<html><head><title>Mill</title></head><body>{before}{FRAMES[frame].format(inside)}{after}</body></html>"
            assert html_extract.main_text(model, page) == "\n\n".join([heading, *FRAMED] if heading else FRAMED)

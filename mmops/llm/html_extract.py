"""Main text of web pages by a conditional random field over DOM leaf blocks (operator 7).

A page is cut into leaf blocks: the text between two block-level tags, with character references
decoded and white space made one space. Scripts, styles, comments, templates and the like have
no text. A block's features are its ancestors' tags, key words of their class, id and role
attributes, and its text (length, link share, end, digits, place on the page). A linear-chain CRF labels the
blocks of a page; Viterbi gives the likeliest labels, and the blocks of the main text are joined by two \\n.

It is trained on labelled pages, which ``labelled_pages`` writes from a grammar of layouts: articles in article, main
or div elements, and in nearly half of the pages in a frame that tells nothing (the body itself, a plain div, a table cell, a class of no meaning),
with menus, headers, footers, sidebars, notices, adverts, forms, share lists and
reader comments before, inside and after them, some of them unframed too, and with unclosed paragraphs. Nothing of it depends on the pages judged.

A null or empty page, and one without main text, gives the empty text. Pages are judged one by
one: nothing is grouped, and repeated rows give equal results. Whole pages are read, whatever their length, in time that
is linear in it: an open element's place is looked up, not searched for, and every character is passed once. Broken markup is
read as the HTML standard has it: quotes open only after an equals sign, only void and foreign elements close themselves, and a
tag that the page's end cuts off is dropped; a "<" without any ">" after it is text, and so is a quote that nothing closes.
"""

from __future__ import annotations

import html as html_lib
import random
import re
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .crf import ChainCRF, slot

# The element kinds of HTML.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
SILENT = frozenset("script style noscript template svg math iframe object canvas audio video textarea select datalist title".split())
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
CLOSES_P = frozenset("address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split())
OWN_KIND = frozenset("li dt dd tr td th option".split())

# Words in class, id and role attributes.
KEYWORDS = frozenset(
    "ad ads advert advertisement adsense sponsor sponsored promo promotion banner nav navigation navbar menu breadcrumb breadcrumbs header masthead footer foot sidebar side aside widget related recommended more "
    "popular trending comment comments reply replies discussion disqus cookie cookies consent notice alert gdpr privacy popup modal overlay form login signup subscribe newsletter search share social sharing "
    "tags tag meta author byline pagination pager copyright legal skip toolbar toc "
    "article content post entry main story body text page prose".split()
)

FOREIGN = frozenset(("svg", "math"))
#: Other names count as one kind, so that a block's features are bounded.
KNOWN = VOID | SILENT | INLINE | CLOSES_P | OWN_KIND | frozenset("html head body button caption colgroup tbody tfoot thead legend label summary figcaption hgroup search".split())

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTR = re.compile(r"""[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:(["'])|([^\s>"'][^\s>]*)|(?=>)))?)""")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPLIT = re.compile(r"[^a-zA-Z]+|(?<=[a-z])(?=[A-Z])")
_ENDS = {tag: re.compile(rf"</{tag}(?![a-zA-Z])[^>]*>", re.I) for tag in SILENT}
_TELLING = frozenset(("class", "id", "role", "style", "aria-hidden", "hidden"))


@lru_cache(maxsize=4096)
def _words_of(attrs: tuple) -> tuple[str, ...]:
    found = set()
    for name, value in attrs:
        if name in ("class", "id", "role"):
            found.update(w for w in (x.lower() for x in _SPLIT.split(value)) if w in KEYWORDS)
        elif name == "hidden" or name == "style" and _HIDDEN.search(value) or name == "aria-hidden" and value == "true":
            found.add("hidden")
    return tuple(sorted(found))


def _attributes(page: str, at: int, last: dict[str, int]) -> tuple[list, bool, int]:
    """The telling attributes of a tag from behind its name, whether it ends in a slash, and the place behind it (-1: the page ends in it)."""
    found = []
    while m := _ATTR.match(page, at):
        at = m.end()
        if m.group(1):
            return found, page[at - 2] == "/" and m.start() < at - 1, at
        value = m.group(4) or ""
        if quote := m.group(3):
            end = page.find(quote, at) if at <= last[quote] else -1
            if end < 0:
                end = page.find(">", at) if at <= last[">"] else len(page)
                value, at = page[at:end], end
            else:
                value, at = page[at:end], end + 1
        if (name := m.group(2).lower()) in _TELLING:
            found.append((name, value))
    return found, False, -1


class _Open:
    """The open elements: each tag's places, how many are links, and the counts of tags and key words."""

    def __init__(self):
        self.stack: list[tuple[str, tuple[str, ...]]] = []
        self.places: dict[str, list[int]] = {}
        self.words: dict[str, int] = {}
        self.tags: dict[str, int] = {}
        self.blocks: list[str] = []

    @property
    def links(self) -> int:
        return len(self.places.get("a", ()))

    def push(self, tag: str, words: tuple[str, ...]) -> None:
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append((tag, words))
        for w in words:
            self.words[w] = self.words.get(w, 0) + 1
        if tag not in INLINE:
            kind = tag if tag in KNOWN else "other"
            self.blocks.append(kind)
            self.tags[kind] = self.tags.get(kind, 0) + 1

    def place(self, tag: str, stop: tuple[str, ...] = ()) -> int:
        """Where the innermost ``tag`` is, if none of ``stop`` is further in; -1 if nowhere."""
        at = (self.places.get(tag) or (-1,))[-1]
        return at if all((self.places.get(s) or (-1,))[-1] < at for s in stop) else -1

    def cut(self, at: int) -> None:
        while len(self.stack) > at:
            tag, words = self.stack.pop()
            self.places[tag].pop()
            for w in words:
                self.words[w] -= 1
                if not self.words[w]:
                    del self.words[w]
            if tag not in INLINE:
                kind = self.blocks.pop()
                self.tags[kind] -= 1
                if not self.tags[kind]:
                    del self.tags[kind]


def blocks(page: str | None) -> list[tuple[str, tuple[str, ...], tuple[str, ...], int]]:
    """[(text, ancestor tags, their key words, characters in links)] of the non-empty leaf blocks, in page order; each tag once, the parent's last."""
    page, out = page or "", []
    opened, parts = _Open(), []
    linked, at, n = 0, 0, len(page)
    last = {c: page.rfind(c) for c in "\"'>"}

    def flush():
        nonlocal linked
        if parts:
            text = " ".join(html_lib.unescape("".join(parts)).split())
            if text:
                parent = opened.blocks[-1:]
                out.append((text, (*[t for t in opened.tags if t not in parent], *parent), tuple(opened.words), linked))
            parts.clear()
        linked = 0

    def say(text):
        nonlocal linked
        parts.append(text)
        if opened.links:
            linked += len(text)

    def pop(tag: str, stop: tuple[str, ...] = ()) -> None:
        if (place := opened.place(tag, stop)) >= 0:
            if tag not in INLINE:
                flush()
            opened.cut(place)

    while at < n:
        start = page.find("<", at)
        if start != at:
            say(page[at : start if start >= 0 else n])
            if start < 0:
                break
        mark = page[start + 1 : start + 2]
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else n
        elif start > last[">"] or not (mark in ("!", "?", "/") or mark.isascii() and mark.isalpha()):
            say("<")
            at = start + 1
        elif mark in ("!", "?"):
            at = page.find(">", start) + 1
        elif mark == "/":
            if m := _NAME.match(page, start + 2):
                pop(m.group().lower())
            at = page.find(">", start) + 1
        else:
            m = _NAME.match(page, start + 1)
            tag = m.group().lower()
            attrs, slash, at = _attributes(page, m.end(), last)
            if at < 0:
                break
            if tag not in INLINE:
                flush()
            if tag in SILENT:
                if not (slash and tag in FOREIGN):
                    end = _ENDS[tag].search(page, at)
                    at = end.end() if end else n
                continue
            if tag == "br":
                parts.append(" ")
            if tag in VOID:
                continue
            if tag in CLOSES_P:
                pop("p", ("button", "td", "th", "table"))
            elif tag in OWN_KIND:
                for other in (("dt", "dd") if tag in ("dt", "dd") else ("td", "th") if tag in ("td", "th") else (tag,)):
                    pop(other, ("ul", "ol", "dl", "table", "select"))
            opened.push(tag, _words_of(tuple(attrs)) if attrs else ())
    flush()
    return out


def features(found) -> list[list[int]]:
    """Feature slots of each block of a page."""
    n, out = len(found), []
    for i, (text, tags, words, linked) in enumerate(found):
        size, last = len(text), text[-1]
        share = linked / (size + 1)
        names = {f"t:{t}" for t in tags}
        names.update(f"w:{w}" for w in words)
        names.update((
            "bias", f"p:{tags[-1] if tags else '-'}", f"n:{min(size, 2000).bit_length()}", f"l:{0 if share < 0.1 else 1 if share < 0.6 else 2}",
            f"e:{'stop' if last in '.!?…。' else 'colon' if last == ':' else 'other'}", f"d:{sum(map(str.isdigit, text)) * 4 > size}", f"c:{'©' in text}",
            f"a:{4 * i // n}", f"article:{'article' in tags or 'main' in tags}",
        ))
        out.append([slot(f) for f in sorted(names)])
    return out


# ---------------------------------------------------------------- labelled pages


def labelled_pages(count: int = 800, seed: int = 29) -> list[tuple[str, list[str]]]:
    """[(html, texts of its main blocks)] from a grammar of layouts and invented words."""
    rng = random.Random(seed)
    pick, chance = rng.choice, lambda p: rng.random() < p
    syllables = "an ber chi do er fa gu hil io ka lo men nu or pa que ri sta tion ul ver wen xi yo zu é ñ ü".split()

    def word():
        return "".join(pick(syllables) for _ in range(rng.randint(1, 4)))

    def words(lo, hi):
        return " ".join(word() for _ in range(rng.randint(lo, hi)))

    def sentence(lo=3, hi=24):
        return words(lo, hi).capitalize() + (pick(".!?") if chance(0.95) else "")

    def link(lo=1, hi=3):
        return f'<a href="/{word()}">{words(lo, hi)}</a>'

    def tagged(tag, kind, inside):
        attr = "" if not kind else f' {pick(("class", "id"))}="{kind}"'
        return f"<{tag}{attr}>{inside}</{tag}>"

    def items(n, f):
        return "<ul>" + "".join(f"<li>{f()}</li>" for _ in range(n)) + "</ul>"

    def menu():
        return tagged(*pick((("nav", ""), ("div", "nav"), ("div", "menu main-menu"), ("ul", "breadcrumbs"))), items(rng.randint(3, 9), link))

    def advert():
        return tagged(*pick((("div", "ad"), ("aside", "sponsored"), ("div", "advert banner"), ("section", "promo"), ("div", "adsense"))), pick((sentence(), f"<p>{sentence()}</p>", link(2, 6))))

    def notice():
        return tagged(*pick((("div", "cookie-notice"), ("div", "gdpr consent"), ("section", "alert notice"), ("div", "popup modal"))), f"<p>{sentence(6, 30)}</p><button>{words(1, 2)}</button>")

    def form():
        return f'<form action="/x">{pick((f"<label>{words(1, 3)}</label>", f"<p>{sentence()}</p>", words(2, 5)))}<input name="q"><button>{words(1, 2)}</button></form>'

    def side():
        return tagged(*pick((("aside", ""), ("div", "sidebar"), ("div", "widget related"), ("section", "popular"))), f"<h3>{words(1, 4)}</h3>" + pick((items(rng.randint(2, 6), link), f"<p>{sentence(6, 30)}</p>", items(3, sentence))))

    def comments():
        one = lambda: tagged(*pick((("div", "comment"), ("li", "comment reply"))), f"<b>{word()}</b>" + "".join(f"<p>{sentence(4, 30)}</p>" for _ in range(rng.randint(1, 3))))
        return tagged(*pick((("section", "comments"), ("div", "comments discussion"), ("div", "replies"))), pick((f"<h2>{words(1, 3)}</h2>", f"<h3>{rng.randint(1, 90)} {words(1, 2)}</h3>", "")) + "".join(one() for _ in range(rng.randint(1, 6))))

    def share():
        return tagged("div", pick(("share social", "sharing", "tags", "social")), pick((items(3, link), " ".join(link(1, 1) for _ in range(4)))))

    def head():
        return tagged(*pick((("header", ""), ("div", "header masthead"))), pick((f"<h1>{words(1, 3)}</h1>", f"<p>{sentence(2, 8)}</p>", link())) + pick((menu(), form(), "")))

    def foot():
        return tagged(*pick((("footer", ""), ("div", "footer"), ("div", "copyright legal"), ("p", "footer"))), pick((f"&copy; {word()} &middot; {sentence()}", f"{sentence(2, 6)} {sentence(2, 4)}", f"<p>{sentence()}</p>", items(4, link) + sentence(), f"<p>&copy; 2021 {words(1, 3)}</p>{link()}")))

    def bare_links():
        return pick((lambda: items(rng.randint(3, 8), link), lambda: f"<p>{' | '.join(link(1, 2) for _ in range(rng.randint(2, 6)))}</p>", lambda: f"<div>{' '.join(link(1, 2) for _ in range(rng.randint(2, 7)))}</div>"))()

    def bare_foot():
        return pick((lambda: f"<hr><p>&copy; {rng.randint(1990, 2024)} {words(1, 4)}</p>", lambda: f"<p>&copy; {words(1, 3)}. {sentence(2, 6)}</p>", lambda: f"<div>{link()} {link()} &copy; {word()}</div>", bare_links))()

    def plainly(inside):
        """The article in a frame that tells nothing."""
        r = rng.random()
        if r < 0.3:
            return inside
        if r < 0.5:
            cells = f"<td>{pick((menu, side, bare_links))()}</td>" if chance(0.5) else ""
            return f"<table><tr>{cells}<td>{inside}</td></tr></table>"
        core = tagged(pick(("div", "div", "div", "section", "center")), pick(("", "", "container", "wrapper", word(), f"{word()}-output")), inside)
        return tagged("div", pick(("", "container", word())), core) if chance(0.4) else core

    junk_before, junk_inside, junk_after = (menu, advert, notice, head, form, side), (advert, share, side, form), (advert, comments, side, foot, share, form, notice, menu)

    def body():
        main, out = [], []

        def block(tag, text, shown=None):
            main.append(text)
            out.append(f"<{tag}>{shown or text}</{tag}>" if chance(0.8) or tag != "p" else f"<p>{shown or text}")

        if chance(0.85):
            block("h1", words(1, 12).capitalize())
        for _ in range(rng.choice((1, 1, 2, 3, 5, 8, 14, 30))):
            r = rng.random()
            if r < 0.62:
                block("p", " ".join(sentence() for _ in range(rng.randint(1, 8))))
            elif r < 0.72:
                block("p", words(1, 4).capitalize() + pick(".!?:;,"))
            elif r < 0.80:
                a, b, c = sentence(), words(1, 3), sentence()
                block("p", f"{a} {b} {c}", f"{a} <a href='/{word()}'>{b}</a> <b>{c}</b>")
            elif r < 0.87:
                block(pick(("h2", "h3")), words(1, 7).capitalize())
            elif r < 0.93:
                texts = [pick((sentence(), words(1, 5))) for _ in range(rng.randint(2, 5))]
                main.extend(texts)
                out.append("<ul>" + "".join(f"<li>{t}</li>" for t in texts) + "</ul>")
            elif r < 0.96:
                block("blockquote", sentence())
            else:
                mark = pick(("***", "%%%", "###", "$$$", " |", "!!"))
                text = " ".join(w + mark for w in words(3, 30).split())
                block("p", text)
            if chance(0.05):
                out.append(pick(junk_inside)())
        return main, "".join(out)

    pages = []
    for _ in range(count):
        main, inside = body()
        frame = pick((("article", ""), ("article", ""), ("article", "post"), ("main", ""), ("div", "content"), ("div", "article-body"), ("div", "post entry"), ("div", "main-content"), ("div", "entry-content"), ("section", "story")))
        if chance(0.15):
            inside += comments()
        telling = chance(0.55)
        core = tagged(*frame, inside) if telling else plainly(inside)
        if telling and chance(0.2):
            core = tagged(*pick((("main", ""), ("div", "page"), ("div", "container"))), core + (side() if chance(0.4) else ""))
        bare = 0.0 if telling else 0.4
        before = "".join(bare_links() if chance(bare) else pick(junk_before)() for _ in range(rng.randint(0, 4)))
        after = "".join(bare_foot() if chance(bare) else pick(junk_after)() for _ in range(rng.randint(0, 4)))
        if chance(0.05):
            main, core = [], ""
        pages.append((f"<!DOCTYPE html><html><head><title>{words(2, 6)}</title></head><body>{before}{core}{after}</body></html>", main))
    return pages


def label(page: str, main: list[str]):
    """(feature slots, labels) of a labelled page: a block is main text if it is the next of the main texts."""
    found, at, labels = blocks(page), 0, []
    for text, *_ in found:
        hit = at < len(main) and text == " ".join(main[at].split())
        labels.append(int(hit))
        at += hit
    if at < len(main):
        raise ValueError("a main text isn't a block of its page")
    return features(found), labels


def train(pages: list[tuple[str, list[str]]] | None = None) -> ChainCRF:
    return ChainCRF(2).train([label(*p) for p in (pages if pages is not None else labelled_pages())])


def main_text(model: ChainCRF, page: str | None) -> str:
    found = blocks(page)
    return "\n\n".join(b[0] for b, y in zip(found, model.decode(features(found)), strict=True) if y)


def extract(pages: DataFrame, model: ChainCRF, html_col: str = "html") -> DataFrame:
    """The columns of ``pages`` but the html, and text and n_chars."""
    names = pages.columns
    at = names.index(html_col)
    rest = [c for c in names if c not in (html_col, "text", "n_chars")]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            texts = [main_text(model, p) for p in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*[batch.column(names.index(c)) for c in rest], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=[*rest, "text", "n_chars"])

    kinds = ", ".join(f"`{c}` {pages.schema[c].dataType.simpleString()}" for c in rest)
    return pages.select(*[F.col(c) for c in names]).mapInArrow(run, f"{kinds}, text string, n_chars long")

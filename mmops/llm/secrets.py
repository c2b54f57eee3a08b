r"""Secret scans: fixed patterns, and sliding-window entropy of candidate strings (operator 5). DataFrame functions only.

Patterns, leftmost and non-overlapping for each kind, over the whole text: ``assign`` (a name such as password,
an equals sign or colon, and a value of 6 characters or more), ``access`` (AKIA and more, 20 or more) and ``hex``
(24 or more). A text's pieces between the matches and the matches themselves give the places,
in code points, without positions from the regex engine.

Entropy: candidates are runs of 20 or more of ``[A-Za-z0-9+/_=-]``. Each has the narrowest character
class that holds it: lower-case hex, upper-case hex, upper-case letters and digits, lower-case letters and digits, or base 64. A window of ``WIDTH``
slides over it; counts are kept by character and change by one entering and one leaving
character, and with them ``sum(c * log2 c)``, from which the window's entropy in bits follows. The
windows at or above the class's threshold give one span from the first's start to the last's end, of kind ``entropy``: the first is looked for
from the front, the last from the back. Runs
without a digit or without a letter, and those that an allow-list pattern matches or that hold an
allow-listed text, are suppressed. So are spans inside a base span. Base spans always stay.

A null text is empty: counts 0 and no spans. Equal rows give equal results; nothing is grouped. Very long texts, candidates
and lists of matches are whole: places are prefix sums in blocks of ``BLOCK`` matches, a candidate's characters are an array, and no
pattern repeats a group that the regex engine would match by recursion.
"""

from __future__ import annotations

import math
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import as_one, field

ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+"""
ASSIGN_VALUE = r"""^(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)$"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{20,}"
KINDS = ("assign", "access", "hex", "entropy")

# Fixed values: (class, pattern, least bits of a window).
CLASSES = (
    ("hex", r"^[0-9a-f]+$", 3.2),
    ("upper_hex", r"^[0-9A-F]+$", 3.2),
    ("upper", r"^[A-Z0-9]+$", 3.6),
    ("lower", r"^[a-z0-9]+$", 3.6),
    ("base64", r"^[A-Za-z0-9+/_=-]+$", 3.9),
)
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_=-"
WIDTH = 20
# What is well known not to be a secret.
ALLOW_PATTERNS = (
    r"^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$",
    r"^(.)\1*$",
    r"^[A-Za-z]++(?:[/_=-][A-Za-z]++)*+[0-9]{0,4}$",
)
ALLOW_TEXTS = ("EXAMPLE", "0123456789", "abcdefghijklm", "ABCDEFGHIJKLM")
#: Elements of an array that are folded one after another; see ``_with_before``.
BLOCK = 256
SPANS = "array<struct<start:int,kind:int,end:int,value:string>>"


def _span(start: Column, kind: Column, end: Column, value: Column) -> Column:
    return F.struct(start.alias("start"), kind.alias("kind"), end.alias("end"), value.alias("value"))


def in_blocks(items: str, more: int = 0) -> Column:
    """The elements of the array column in arrays of ``BLOCK``, each with the ``more`` elements that follow it."""
    starts = F.when(F.size(items) > 0, F.sequence(F.lit(0), F.floor((F.size(items) - 1) / BLOCK).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda k: F.slice(items, k * BLOCK + 1, F.lit(BLOCK + more)))


def _with_before(df: DataFrame, name: str, values: Column, join) -> DataFrame:
    """``df`` and, for each of the integers, all earlier ones joined (0 for none): prefix sums or maxima.

    A fold that appends copies what it has, so it runs over blocks and inside each block, not over the whole. In steps of
    a column each, since an expression may not nest lambda functions too deeply.
    """

    def fold(items, at):
        zero = F.struct(at.cast("int").alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, x: F.struct(join(acc.at, x).cast("int").alias("at"), F.concat(acc.out, F.array(acc.at)).alias("out"))
        return F.aggregate(items, zero, step, lambda acc: acc.out)

    df = df.withColumn("__v", values).withColumn("__b", in_blocks("__v"))
    df = df.withColumn("__s", F.transform("__b", lambda b: F.aggregate(b, F.lit(0), lambda acc, x: join(acc, x).cast("int"))))
    df = df.withColumn("__o", fold(F.col("__s"), F.lit(0)))
    return df.withColumn(name, F.flatten(F.transform(F.arrays_zip("__b", "__o"), lambda x: fold(x["__b"], x["__o"])))).drop("__v", "__b", "__s", "__o")


def _with_spans(df: DataFrame, name: str, text: str, pattern: str, kind: int) -> DataFrame:
    """``df`` and the leftmost non-overlapping matches as array<struct<start, kind, end, value>>, in code points."""
    df = df.withColumn("__f", F.regexp_extract_all(text, F.lit(pattern), F.lit(0)))
    gaps = F.when(F.size("__f") > 0, F.slice(F.split(text, pattern, -1), F.lit(1), F.size("__f"))).otherwise(F.array().cast("array<string>"))
    df = df.withColumn("__g", gaps)
    df = _with_before(df, "__at", F.zip_with("__g", "__f", lambda g, f: F.length(g) + F.length(f)), lambda x, y: x + y)

    def span(x):
        start = x["__at"] + F.length(x["__g"])
        return _span(start, F.lit(kind), start + F.length(x["__f"]), x["__f"])

    return df.withColumn(name, F.transform(F.arrays_zip("__at", "__g", "__f"), span)).drop("__f", "__g", "__at")


def _with_outside(df: DataFrame, name: str, spans: Column, base: str) -> DataFrame:
    """``df`` and those of the spans that lie in no base span: in order of starts, the furthest end of a base span so far tells."""
    mark = lambda spans, mine: F.transform(spans, lambda s: F.struct(s.start.alias("start"), F.lit(mine).alias("mine"), s.kind.alias("kind"), s.end.alias("end"), s.value.alias("value")))
    df = df.withColumn("__both", F.array_sort(F.concat(mark(base, False), mark(spans, True))))  # base spans before others of the same start
    df = _with_before(df, "__reach", F.transform("__both", lambda s: F.when(s.mine, 0).otherwise(s.end)), F.greatest)
    kept = F.filter(F.arrays_zip("__both", "__reach"), lambda x: x["__both"]["mine"] & (x["__reach"] < x["__both"]["end"]))
    return df.withColumn(name, F.transform(kept, lambda x: _span(*[x["__both"][c] for c in ("start", "kind", "end", "value")]))).drop("__both", "__reach")


def _first_window(blocks: Column, least: Column) -> Column:
    """The first start (from 0) of a window with at least so many bits; null if none.

    ``blocks``: the characters' places in ``ALPHABET``, in blocks of starts; none is read after the first that is found.
    """
    x_log_x = F.array(*[F.lit(c * math.log2(c) if c else 0.0) for c in range(WIDTH + 2)])
    f = lambda c: F.element_at(x_log_x, c + 1)
    # The counts of the window's characters, sum(c * log2 c), and the start found.
    state = F.struct(F.array_repeat(F.lit(0), len(ALPHABET)).alias("counts"), F.lit(0.0).cast("double").alias("total"), F.lit(None).cast("int").alias("first"))
    high = lambda acc, n: (n >= WIDTH) & (F.lit(math.log2(WIDTH)) - acc.total / WIDTH >= least - 1e-9)

    def scan(block):
        def step(acc, i):
            counts, came, left = acc.counts, F.element_at(block, i), F.element_at(block, i - WIDTH)
            c, d = F.element_at(counts, came), F.element_at(counts, left)
            low, top, by = F.least(came, left), F.greatest(came, left), F.when(came < left, 1).otherwise(-1)
            grown = F.concat(F.slice(counts, F.lit(1), came - 1), F.array(c + 1), F.slice(counts, came + 1, F.lit(len(ALPHABET))))
            both = F.concat(F.slice(counts, F.lit(1), low - 1), F.array(F.element_at(counts, low) + by), F.slice(counts, low + 1, top - low - 1), F.array(F.element_at(counts, top) - by), F.slice(counts, top + 1, F.lit(len(ALPHABET))))
            to = lambda counts, total: F.struct(counts.alias("counts"), total.alias("total"), acc.first.alias("first"))
            found = F.struct(acc.counts.alias("counts"), acc.total.alias("total"), (i - 1 - WIDTH).alias("first"))
            # One character comes, and the one that many places before it leaves.
            return (
                F.when(acc.first.isNotNull(), acc).when(high(acc, i - 1), found).when(i <= WIDTH, to(grown, acc.total + f(c + 1) - f(c)))
                .when(came == left, acc).otherwise(to(both, acc.total + f(c + 1) - f(c) + f(d - 1) - f(d)))
            )

        n = F.size(block)
        return F.aggregate(F.sequence(F.lit(1), n), state, step, lambda acc: F.coalesce(acc.first, F.when(high(acc, n), n - WIDTH)))

    one = lambda acc, block: F.struct((acc.at + BLOCK).alias("at"), F.when(acc.first.isNotNull(), acc.first).otherwise(acc.at + scan(block)).alias("first"))
    return F.aggregate(blocks, F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("first")), one, lambda acc: acc.first)


def _with_entropy(df: DataFrame, name: str, text: str, base: str) -> DataFrame:
    """``df`` and the spans of kind 3 over the candidates that no allow-list suppresses and that lie in no base span."""
    df = _with_spans(df, "__runs", text, CANDIDATE, 3)
    allowed = [lambda v, p=p: v.rlike(p) for p in ALLOW_PATTERNS] + [lambda v, k=k: v.contains(k) for k in ALLOW_TEXTS]
    mixed = F.filter("__runs", lambda s: s.value.rlike("[0-9]") & s.value.rlike("[A-Za-z]"))
    df = _with_outside(df, "__runs", F.filter(mixed, lambda s: ~reduce(or_, [test(s.value) for test in allowed])), base)

    def least(value):
        bits = F.lit(None).cast("double")
        for _, pattern, bound in reversed(CLASSES):
            bits = F.when(value.rlike(pattern), F.lit(bound)).otherwise(bits)
        return bits

    # The characters' places in the alphabet: an element is found at once, a character of a string only by counting.
    slots = lambda value: F.transform(F.split(value, ""), lambda c: F.call_function("instr", F.lit(ALPHABET), c))
    cut = lambda x: F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / BLOCK).cast("int")), lambda k: F.slice(x, k * BLOCK + 1, F.lit(BLOCK + WIDTH - 1)))
    df = df.withColumn("__runs", F.transform("__runs", lambda s: F.struct(s.start.alias("start"), least(s.value).alias("least"), slots(s.value).alias("slots"))))
    df = df.withColumn("__runs", F.transform("__runs", lambda x: F.struct(x.start.alias("start"), x.least.alias("least"), x.slots.alias("slots"), cut(x.slots).alias("blocks"))))
    df = df.withColumn("__runs", F.transform("__runs", lambda x: F.struct(x.start.alias("start"), x.least.alias("least"), x.slots.alias("slots"), _first_window(x.blocks, x.least).alias("first"))))
    df = df.withColumn("__runs", F.filter("__runs", lambda x: x.first.isNotNull()))
    df = df.withColumn("__runs", F.transform("__runs", lambda x: F.struct(x.start.alias("start"), x.least.alias("least"), F.reverse(x.slots).alias("slots"), x.first.alias("first"))))
    df = df.withColumn("__runs", F.transform("__runs", lambda x: F.struct(x.start.alias("start"), x.first.alias("first"), (F.size(x.slots) - _first_window(cut(x.slots), x.least)).alias("end"))))
    found = F.transform("__runs", lambda x: _span(x.start + x.first, F.lit(3), x.start + x.end, F.lit("")))
    return _with_outside(df, name, found, base).drop("__runs")


def find_secrets(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """All columns of ``docs`` and ``secret_spans``: array<struct<start, kind, end, value>>, sorted by start, then kind.

    kind is a place in ``KINDS``; start and end are code points, end exclusive; value is the matched
    text of a base span and empty for an entropy span. A column ``secret_spans`` of ``docs`` is replaced.
    """
    kept = [c for c in docs.columns if c != "secret_spans"]
    df = docs.select(as_one(docs), F.coalesce(field(text_col), F.lit("")).alias("__text"))
    for kind, pattern in enumerate((ASSIGN, ACCESS, HEX)):
        df = _with_spans(df, f"__k{kind}", "__text", pattern, kind)
    assign = F.filter("__k0", lambda s: F.length(F.regexp_extract(s.value, ASSIGN_VALUE, 1)) >= 6)
    access = F.filter("__k1", lambda s: F.length(s.value) >= 20)
    df = df.withColumn("__base", F.array_sort(F.concat(assign, access, "__k2"))).drop("__k0", "__k1", "__k2")
    df = _with_entropy(df, "__high", "__text", "__base")
    return df.select(*[F.col("doc").getField(c).alias(c) for c in kept], F.array_sort(F.concat("__base", "__high")).alias("secret_spans"))


def _named(spans: Column) -> Column:
    kinds = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", kinds[s.kind], s.start.cast("string"), s.end.cast("string"))), ",")


def digest(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """A row per document: the id, counts by kind, the base spans' SHA-256 and all spans as text."""
    base = F.filter("secret_spans", lambda s: s.kind < 3)
    count = lambda k: F.size(F.filter("secret_spans", lambda s: s.kind == k)).cast("long")
    return found.select(id_col, count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_named(base), 256).alias("base_sha256"), _named(F.col("secret_spans")).alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span of its text replaced by ``mark``; overlapping and touching spans become one. All other columns stay, whatever their names."""
    df = find_secrets(docs.select(as_one(docs, "own"), field(text_col).alias("text")))
    df = _with_before(df, "__reach", F.transform("secret_spans", lambda s: s.end), F.greatest)
    # What stays before each run of overlapping or touching spans.
    fresh = F.filter(F.arrays_zip("secret_spans", "__reach"), lambda x: (x["secret_spans"]["start"] > x["__reach"]) | (x["secret_spans"]["start"] == 0) & (x["__reach"] == 0))
    df = df.withColumn("__gaps", F.transform(fresh, lambda x: F.struct(x["__reach"].alias("from"), x["secret_spans"]["start"].alias("to"))))
    df = df.withColumn("__blocks", in_blocks("__gaps"))
    # A block's stretch of the text is cut out first, as finding a place in a string takes as long as the place is far.
    stretch = lambda b: F.substring(F.col("text"), b[0]["from"] + 1, F.element_at(b, -1)["to"] - b[0]["from"])
    df = df.withColumn("__blocks", F.transform("__blocks", lambda b: F.struct(b.alias("gaps"), stretch(b).alias("stretch"))))
    piece = lambda b, g: F.concat(F.substring(b["stretch"], g["from"] - b["gaps"][0]["from"] + 1, g["to"] - g["from"]), F.lit(mark))
    pieces = F.flatten(F.transform("__blocks", lambda b: F.transform(b["gaps"], lambda g: piece(b, g))))
    tail = F.substring(F.col("text"), F.array_max(F.transform("secret_spans", lambda s: s.end)) + 1, F.length("text"))
    done = F.concat(F.array_join(pieces, ""), tail)
    done = F.when(F.size("secret_spans") > 0, done).otherwise(F.col("text"))
    return df.select(*[(done if c == text_col else F.col("own").getField(c)).alias(c) for c in docs.columns])

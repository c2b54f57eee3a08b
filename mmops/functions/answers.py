"""Reading an option letter or a value out of an answer in prose."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import strip, words

LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
# Refusals, which count as the answer Z; and the text of a failed call, which is no answer.
REFUSALS = ("Sorry, I can't help with images of people yet.", "I can't process this file.", "I'm sorry, but without the image provided", "Cannot determine the answer")
FAILED = "Failed to obtain answer via API"
PUNCTUATION = ".()[],:;!*#{}"


def options_map(**columns: Column) -> Column:
    """P-13: letter -> text of the options that aren't null."""
    entries = F.array(*[F.struct(F.lit(k).alias("key"), c.cast("string").alias("value")) for k, c in columns.items()])
    return F.map_from_entries(F.filter(entries, lambda e: e.value.isNotNull()))


def infer_option(answer: Column, options: Column) -> Column:
    """T-15: the one option letter that stands alone in the answer; Z for a refusal; else null.

    A lone A among more than three words is taken for an article.
    """
    answer = F.coalesce(answer, F.lit(""))
    tokens = words(F.translate(answer, PUNCTUATION, " " * len(PUNCTUATION)))
    present = F.array_intersect(F.map_keys(options), tokens)
    refused = F.lit(False)
    for text in REFUSALS:
        refused = refused | F.contains(answer, F.lit(text))
    article = F.array_contains(tokens, F.lit("A")) & (F.size(tokens) > 3)
    letter = F.when(F.size(present) == 1, F.when(~article, present[0])).when((F.size(present) == 0) & F.array_contains(tokens, F.lit("Z")), "Z")
    return F.when(F.contains(answer, F.lit(FAILED)), F.lit(None).cast("string")).when(refused, "Z").otherwise(letter)


def infer_text(answer: Column, options: Column) -> Column:
    """T-16: the letter of the one option whose text occurs in the answer, without regard to case; else null."""
    low = F.lower(F.coalesce(answer, F.lit("")))
    found = F.filter(F.map_entries(options), lambda e: F.contains(low, F.lower(e.value)))
    return F.when(F.size(found) == 1, found[0]["key"])


def infer(answer: Column, options: Column) -> Column:
    """T-17."""
    return F.coalesce(infer_option(answer, options), infer_text(answer, options))


def _number(text: Column) -> Column:
    """A number or a plain fraction; nothing is ever evaluated."""
    top, bottom = (F.regexp_extract(text, r"^\\?(?:d?frac)?\{?(-?[0-9.]+)\}?(?:/|\{)(-?[0-9.]+)\}?$", i).try_cast("double") for i in (1, 2))
    return F.coalesce(text.try_cast("double"), F.try_divide(top, bottom))


def answers_equal(answer: Column, truth: Column) -> Column:
    """T-18: equal without case and outer space, or numbers (also fractions) that differ by less than a millionth."""
    a, b = F.lower(strip(F.coalesce(answer, F.lit("")))), F.lower(strip(F.coalesce(truth, F.lit(""))))
    return (a == b) | F.coalesce(F.abs(_number(a) - _number(b)) < 1e-6, F.lit(False))


def truth_letter(answer: Column) -> Column:
    """P-15: the letter itself, or A for an answer that isn't one."""
    return F.when(answer.rlike("^[A-Z]$"), answer).otherwise("A")


def open_option_a(a: Column, answer: Column) -> Column:
    """P-14: an open question's first option is its answer."""
    return F.when(a.isNull(), answer.cast("string")).otherwise(a)


def open_option_b(a: Column, b: Column) -> Column:
    """P-14: and its second option stands for all others."""
    return F.when(a.isNull(), F.lit("Other Answers")).otherwise(b)


def letter_of(index: Column) -> Column:
    """M-30."""
    return F.char(index + 65)


def index_of(letter: Column) -> Column:
    """M-30."""
    return F.ascii(letter) - 65


def fallback_option(index: Column, options: Column) -> Column:
    """L-10: one of the options, by a hash of the row's index instead of a random draw."""
    keys = F.map_keys(options)
    return F.try_element_at(keys, (F.pmod(F.xxhash64(index), F.greatest(F.size(keys), F.lit(1))) + 1).cast("int"))


def post_check(prediction: Column, truth: Column, options: Column, prefetch: bool) -> Column:
    """Q-13: with options, the inferred letter in a first look and its equality in the last; without, the equality to the truth."""
    has = F.size(options) > 0
    letter = infer(prediction, options)
    if prefetch:
        return F.when(has, letter).when(answers_equal(prediction, truth), prediction)
    return F.when(has, F.coalesce(letter == truth, F.lit(False))).otherwise(answers_equal(prediction, truth))

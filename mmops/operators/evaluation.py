"""Scoring of answers: joins with the truth, extraction, grouped accuracy, prompts."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import answers
from ..functions.text import strip
from . import substrings
from .records import last_of_duplicates

OPTION_NAMES = tuple(answers.LETTERS)
#: Parts of a substring join are held by the tasks up to so many bytes.
PART_BYTES = substrings.PART_BYTES


def options_of(df: DataFrame) -> Column:
    """P-13 over the option columns that a table has."""
    return answers.options_map(**{c: F.col(c) for c in df.columns if c in OPTION_NAMES})


def open_to_choice(items: DataFrame) -> DataFrame:
    """P-14 and P-15: open questions as a choice of two; the truth as a letter in ``gt``."""
    a, b = F.col("A"), F.col("B") if "B" in items.columns else F.lit(None).cast("string")
    return items.withColumns({"A": answers.open_option_a(a, F.col("answer")), "B": answers.open_option_b(a, b), "gt": answers.truth_letter(F.col("answer"))})


def with_truth(predictions: DataFrame, truth: DataFrame, key: str = "index") -> DataFrame:
    """J-04 and J-05: predictions of known items with their truth; the last of repeated truths wins."""
    order = F.monotonically_increasing_id()
    last = last_of_duplicates(truth.select(key, "gt").withColumn("__n", order), key, "__n").drop("__n") if "__n" not in truth.columns else truth
    return predictions.join(last, key)


def unknown_predictions(predictions: DataFrame, truth: DataFrame, key: str = "index") -> DataFrame:
    """J-04: predictions of no known item."""
    return predictions.join(truth.select(key), key, "left_anti")


def extract(items: DataFrame, judge: Callable | None = None, prediction: str = "prediction", tries: int = 25) -> DataFrame:
    """T-17, Q-12 and Q-14: extracted_answer, extraction_method (rule, judge, random), extraction_success, hit against ``gt``.

    ``judge`` is a function of a pandas Series of prompts, or of that and the number of the try, to one of letters. It is asked for what the rules
    leave, and again, ``tries`` times at most, for what it left open or answered with no option. What is left then is given one
    of the options by a hash of the row's index.
    """
    options = options_of(items)
    out = items.withColumn("__options", options).withColumn("__rule", answers.infer(F.col(prediction), F.col("__options")))
    if judge is not None:
        ask = F.pandas_udf(_asked(judge, tries), "string")
        prompt = F.when(F.col("__rule").isNull(), judge_prompt(F.col("question"), F.col("__options"), F.col(prediction)))
        out = out.withColumn("__judge", F.when(F.col("__rule").isNull(), ask(prompt, F.array_join(F.map_keys("__options"), ""))))
    else:
        out = out.withColumn("__judge", F.lit(None).cast("string"))
    chosen = F.coalesce("__rule", "__judge", answers.fallback_option(F.col("index"), F.col("__options")))
    method = F.when(F.col("__rule").isNotNull(), "rule").when(F.col("__judge").isNotNull(), "judge").otherwise("random")
    success = F.coalesce((F.coalesce("__rule", "__judge") != "Z"), F.lit(False))
    out = out.withColumns({"extracted_answer": chosen, "extraction_method": method, "extraction_success": success})
    return out.withColumn("hit", F.coalesce(F.col("extracted_answer") == F.col("gt"), F.lit(False)).cast("int")).drop("__options", "__rule", "__judge")


def _asked(judge: Callable, tries: int) -> Callable:
    """The judge's letters, asked again for those that are none of the row's options."""
    from inspect import signature

    counted = len(signature(judge).parameters) > 1

    def run(prompts: pd.Series, letters: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(prompts), index=prompts.index, dtype=object)
        for turn in range(tries):
            left = prompts[prompts.notna() & out.isna()]
            if left.empty:
                break
            said = judge(left, turn) if counted else judge(left)
            for i, answer in zip(left.index, said, strict=True):
                if answer and (answer == "Z" or answer in letters[i]):
                    out[i] = answer
        return out

    return run


def accuracy(results: DataFrame, by: list[str] | None = None, hit: str = "hit") -> DataFrame:
    """A-01, A-02 and A-05: n, correct, accuracy (null for no rows); missing groups are unknown."""
    keys = [F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias(c) for c in by or []]
    return results.groupBy(*keys).agg(F.count("*").alias("n"), F.coalesce(F.sum(hit), F.lit(0)).cast("long").alias("correct"), F.try_divide(F.sum(hit), F.count(hit)).alias("accuracy"))


def accuracy_grouping_sets(results: DataFrame, sets: list[str], hit: str = "hit") -> DataFrame:
    """A-03: overall and by each of the columns alone, in one pass: grouping, value, n, correct, accuracy."""
    spread = F.array(F.struct(F.lit("overall").alias("g"), F.lit("").alias("v")), *[F.struct(F.lit(c).alias("g"), F.coalesce(F.col(c).cast("string"), F.lit("unknown")).alias("v")) for c in sets])
    rows = results.select(F.col(hit).alias("hit"), F.explode(spread).alias("s"))
    return rows.groupBy(F.col("s.g").alias("grouping"), F.col("s.v").alias("value")).agg(F.count("*").alias("n"), F.sum("hit").cast("long").alias("correct"), F.try_divide(F.sum("hit"), F.count("hit")).alias("accuracy"))


def subject_table(results: DataFrame, extractors: list[str], category: str = "category", log: str = "log", hit: str = "hit", model: str = "extract_model", flag: str = "extract_flag") -> DataFrame:
    """A-04: Subject, tot, prefetch, hit, rates in percent, and for each extractor its successes and uses, on the Overall row only."""
    prefetch = F.contains(F.coalesce(F.col(log), F.lit("")), F.lit("Prefetch succeed")).cast("int")
    base = results.select(F.coalesce(F.col(category).cast("string"), F.lit("unknown")).alias("c"), prefetch.alias("p"), F.col(hit).cast("int").alias("h"), F.col(model).alias("m"), F.col(flag).alias("f"))
    uses = []
    for name in extractors:
        uses += [
            F.when(F.grouping("c") == 1, F.count_if((F.col("m") == name) & F.col("f"))).otherwise(0).alias(f"{name}_success"),
            F.when(F.grouping("c") == 1, F.count_if(F.col("m") == name)).otherwise(0).alias(f"{name}_all"),
        ]
    out = base.rollup("c").agg(
        F.when(F.grouping("c") == 1, "Overall").otherwise(F.col("c")).alias("Subject"), F.count("*").alias("tot"), F.sum("p").alias("prefetch"), F.sum("h").alias("hit"),
        (F.sum("p") / F.count("*") * 100).alias("prefetch_rate"), (F.sum("h") / F.count("*") * 100).alias("acc"), *uses,
    )
    return out.drop("c").orderBy("Subject")


def macro_average(datasets: DataFrame, name: str, metrics: list[str]) -> DataFrame:
    """A-20: the rows by name, and an Average row of unweighted means."""
    mean = datasets.agg(F.lit("Average").alias(name), *[F.avg(m).alias(m) for m in metrics])
    return datasets.select(name, *metrics).unionByName(mean)


def test_tally(results: DataFrame, problem: str = "problem", code: str = "code") -> DataFrame:
    """A-22: results of single tests (1 passed, 0 failed, -1 timeout, -2 error) by problem."""
    c = F.col(code)
    return results.groupBy(problem).agg(F.count_if(c == 1).alias("passed"), F.count_if(c == 0).alias("failed"), F.count_if(c == -1).alias("timeout"), F.count_if(c == -2).alias("error"), F.try_divide(F.count_if(c == 1), F.count("*")).alias("accuracy"), F.bool_and(c == 1).alias("all_passed"))


def substring_pairs(texts: DataFrame, parts: DataFrame, text: str = "text", part: str = "part", keep: list[str] | None = None) -> DataFrame:
    """J-14 and J-18: rows of ``texts`` (of them the columns ``keep``) with the rows of ``parts`` that their text holds."""
    return substrings.substring_pairs(texts, parts, text, part, PART_BYTES, keep)


# ------------------------------------------------------------------ prompts (own wording)


def option_lines(options: Column) -> Column:
    """P-23: a line an option, by letter."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(options)), lambda e: F.concat(e.key, F.lit(". "), e.value)), "\n")


def choice_prompt(question: Column, options: Column, hint: Column | None = None) -> Column:
    """P-21: hint, question and options, and what to answer with."""
    hint = F.lit(None).cast("string") if hint is None else hint
    lines = F.when(F.size(options) > 0, option_lines(options))
    ask = F.when(F.size(options) > 0, "Choose one option and answer with its letter.").otherwise("Answer briefly.")
    return F.concat_ws("\n", F.concat(F.lit("Hint: "), hint), F.concat(F.lit("Question: "), question), lines, ask)


def judge_prompt(question: Column, options: Column, answer: Column) -> Column:
    """P-23: asks which option an answer means."""
    return F.concat_ws("\n", F.lit("Which option does the answer mean? Reply with one letter, or Z for none."), F.concat(F.lit("Question: "), question), option_lines(options), F.concat(F.lit("Answer: "), answer))


def video_options(options: Column) -> Column:
    """P-22: letter -> option text after its first dot."""
    return F.map_from_entries(F.transform(options, lambda o, i: F.struct(F.char(i + 65).alias("key"), strip(F.when(F.contains(o, F.lit(".")), F.regexp_replace(o, r"^[^.]*\.", "")).otherwise(o)).alias("value"))))

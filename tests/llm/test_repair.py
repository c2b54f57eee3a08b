"""Conversation repair against a plain search over all edits, and blocks against whole conversations."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from mmops.llm import queries, repair

SF = "/root/testdata/sf0.001"
SPACE = "\x20\x09\x0a\x0b\x0c\x0d"


def plain(rows):
    """[(conv, turn, role, text)] -> {conv: the columns of the query}; the edits by a search from the end over whole strings of letters."""
    convs = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        fault = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        own = convs[conv]
        if fault:
            row = (turn, "user" if fault == 4 else role, "" if fault == 1 else re.sub("[.!?]", "", text) if fault == 2 else text)
            own += [row] * (2 if fault == 3 else 1)
    out = {}
    for conv, own in convs.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
        turns = [r[0] for r in own if r[0] is not None]
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        seen, kinds = set(), []
        for _, role, text in own:
            bare = text.strip(SPACE)
            kinds.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
            seen.add((role, text))
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") or not a[1] or not b[1] for a, b in zip(own, own[1:], strict=False))
        step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("a", "u"): "u", ("u", "a"): "a"}
        # best[state] = (cost, letters, repaired) of what is left, from the end.
        best = {s: (0, "", ()) for s in ("", "a")}

        def with_inserts(best, step=step):
            best = dict(best)
            for _ in range(3):
                for (s, r), after in step.items():
                    if r != "s" and after in best:
                        c, letters, rest = best[after]
                        best[s] = min(best.get(s, (10**9,)), (c + 2, "I" + letters, ({"u": "user:", "a": "assistant:"}[r], *rest)))
            return best

        best = with_inserts(best)
        for (_, role, text), kind in zip(reversed(own), reversed(kinds), strict=True):
            now = {}
            for s in ("", "s", "u", "a"):
                options = []
                if s in best:
                    c, letters, rest = best[s]
                    options.append((c + 3, "D" + letters, rest))
                for r in "sua":
                    after = step.get((s, r))
                    if kind in ("blank", "duplicate") or after not in best:
                        continue
                    c, letters, rest = best[after]
                    if role[:1] == r:
                        options.append((c + (kind == "truncated"), "K" + letters, (f"{role}:{text}", *rest)))
                    if r != "s":
                        options.append((c + 2 + (kind == "truncated"), "R" + letters, ({"u": "user", "a": "assistant"}[r] + ":" + text, *rest)))
                if options:
                    now[s] = min(options)
            best = with_inserts(now)
        cost, audit, repaired = best[""]
        out[conv] = (gaps, kinds.count("blank"), kinds.count("duplicate"), kinds.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(repaired).encode()).hexdigest())
    return out


COLUMNS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def got(df):
    rows = df.collect()
    found = {r.conv_id: tuple(r[c] for c in COLUMNS) for r in rows}
    assert len(found) == len(rows)
    return found


def odd_rows():
    rng, rows = random.Random(5), []
    texts = [None, "", " \n", "Yes.", "no", "What? ", "Long text " * 3000 + "!", "…", "ends ", "a\x1f"]
    roles = ["user", "assistant", "system", "u", None, "", "tool", "User"]
    for conv in [*range(120), None]:
        for turn in range(rng.randrange(9)):
            rows.append((conv, rng.choice([turn, turn, turn, turn * 3, None]), rng.choice(roles[: rng.choice([2, 3, 8])]), rng.choice(texts)))
    return rows + rows[:40]


def test_given_conversations(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert got(queries.op12_repair(spark, SF)) == plain(rows)


def as_table(spark, tmp_path, rows):
    # An extra column, and clashing names of it.
    spark.createDataFrame([(*r, 1, "x") for r in rows], "conv_id long, turn long, role string, text string, i int, p string").write.parquet(f"{tmp_path}/conversations.parquet")
    return queries.op12_repair(spark, str(tmp_path))


def test_odd_rows(spark, tmp_path):
    rows = odd_rows()
    assert got(as_table(spark, tmp_path, rows)) == plain(rows)


def test_empty_table(spark, tmp_path):
    df = as_table(spark, tmp_path, [])
    assert df.collect() == [] and df.columns == ["conv_id", *COLUMNS]


def test_one_conversation_over_many_ranges(spark, tmp_path):
    """Most rows are of one conversation, which crosses ranges, and long runs of one symbol."""
    rng, rows = random.Random(9), [(c, t, "user", "Hi.") for c in (1, 9) for t in range(3)]
    role = "user"
    for turn in range(1500):
        role = rng.choice([role, role, role, "user", "assistant", "system"])
        rows.append((5, turn if turn % 50 else None, role, rng.choice(["Yes %d." % turn, "no %d" % turn, "Same.", " "])))
    kept = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else small ranges are merged
    try:
        assert got(as_table(spark, tmp_path, rows)) == plain(rows)
        fixed = repair.Repair(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
        assert fixed.blocks.where("crosses").count() >= 3
        initials = "".join(r.role[0] for r in fixed.rows().where("conv_id = 5").orderBy("p", "place").collect())
        assert re.fullmatch("(s?(ua)+)?", initials)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", kept)


@pytest.mark.parametrize("seed", range(3))
def test_runs_equal_single_steps(seed):
    """Long runs, which binary powers carry over, against the same rows one by one."""
    rng = random.Random(seed)
    for _ in range(60):
        runs = [(rng.choice("sua.") + rng.choice("xkt"), rng.choice([1, 2, 3, 7, 64, 1500])) for _ in range(rng.randrange(1, 5))]
        single = [(s, 1) for s, n in runs for _ in range(n)]
        assert repair.block_letters(runs, 0, repair.AT_END, True) == repair.block_letters(single, 0, repair.AT_END, True)
        v = repair.AT_END
        for s, n in reversed(runs):
            v = repair.back(s, n, v)
        assert v == repair.apply(repair.block_matrix(runs), repair.AT_END)


def test_damage(spark):
    rows = spark.range(2000).select((F.col("id") % 10).alias("conv_id"), F.col("id").alias("turn"), F.lit("system").alias("role"), F.lit("One. Two!").alias("text"))
    kinds = {i: zlib.crc32(f"{i % 10}:{i}".encode()) % 20 for i in range(2000)}
    found = defaultdict(list)
    for r in repair.damaged(rows).collect():
        found[r.turn].append((r.role, r.text))
    for i, k in kinds.items():
        assert found[i] == {0: [], 1: [("system", "")], 2: [("system", "One Two")], 3: [("system", "One. Two!")] * 2, 4: [("user", "One. Two!")]}.get(k, [("system", "One. Two!")])

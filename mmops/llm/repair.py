r"""Conversation structure repair by a run-length DP (operator 12).

A conversation's rows, in the order of turn (nulls first; ties: role, then text), are edited so that the role initials are
``(s?(ua)+)?``. Edits: D deletes a row (3), I inserts an empty user or assistant turn anywhere (2), K keeps a row, R gives it the
role user or assistant (2). A row's first fault counts: blank (nothing but white space) and duplicate (role and text seen earlier in
the conversation) rows must be deleted, a truncated one (last character other than white space not of ``.!?``) costs 1 unless it is
deleted. The audit is the cheapest edits' letters in order; of equal costs the ASCII-least.

Method: a row is a symbol (role initial, fault). Equal symbols in a row are a run; what a run does to the costs-to-go of the four
states is its symbol's min-plus matrix to the power of its length, applied through cached binary powers. Runs are taken from the end
to the start; then the choices are unrolled from the start, a run in two by the same powers, so memory is a run's logarithm.

Rows are sorted by range and written once; a block is a conversation's part in one range, so a conversation of any size
is dealt out. Those that cross ranges (one for each border at most) have their blocks' matrices chained, get the costs-to-go at each
block's end, are unrolled from each state, and the blocks' start states are chained forwards.

Null role and text are one space. Rows without conv_id are one conversation, and null turns come first. Empty texts are blank;
texts are whole. Repeated rows are duplicates. Empty tables give no rows. An empty role has no initial and no legal neighbour.
Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from functools import lru_cache
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch

SPACE = " \t\n\x0b\x0c\r"
DELETE, INSERT, REROLE, CUT = 3, 2, 2, 1
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 60
#: Costs-to-go when no row is left: an open pair is closed by inserts.
AT_END = (0, 2 * INSERT, INSERT, 0)
#: State after the next turn that is no system turn.
_NEXT = (USER, USER, ASSISTANT, USER)
_NAMES = {USER: "user", ASSISTANT: "assistant"}
GONE, FULL, TRUNCATED = "x", "k", "t"
LEGAL = ("su", "ua", "au")
CACHED_ROWS = 1024


def emitted(state: int, initial: str) -> int | None:
    """The state after a turn of this initial, or None."""
    if initial == "s":
        return SYSTEM if state == START else None
    after = _NEXT[state]
    return after if initial == ("a" if after == ASSISTANT else "u") else None


def edits(state: int, symbol: str) -> list[tuple[str, int, int]]:
    """(letter, cost, state after) of what may be done with a row, letters in ASCII order."""
    found = [("D", DELETE, state)]
    if symbol[1] != GONE:
        more = CUT if symbol[1] == TRUNCATED else 0
        if (after := emitted(state, symbol[0])) is not None:
            found.append(("K", more, after))
        found.append(("R", REROLE + more, _NEXT[state]))
    return found


def times(m: tuple, n: tuple) -> tuple:
    return tuple(tuple(min(NEVER, *map(add, row, col)) for col in zip(*n, strict=True)) for row in m)


def apply(m: tuple, v: tuple) -> tuple:
    return tuple(min(map(add, row, v)) for row in m)


@lru_cache(maxsize=None)  # symbols and bits of lengths are few
def power(symbol: str, bit: int) -> tuple:
    """The symbol's matrix to the power 2**bit: inserts before a row, then its edit."""
    if bit:
        half = power(symbol, bit - 1)
        return times(half, half)
    rows = []
    for state in range(4):
        row = [NEVER] * 4
        at, cost = state, 0
        for _ in range(3):
            for _, c, after in edits(at, symbol):
                row[after] = min(row[after], cost + c)
            at, cost = _NEXT[at], cost + INSERT
        rows.append(tuple(row))
    return tuple(rows)


def back(symbol: str, length: int, v: tuple) -> tuple:
    """Costs-to-go before a run from those after it."""
    for bit in range(length.bit_length()):
        if length >> bit & 1:
            v = apply(power(symbol, bit), v)
    return v


@lru_cache(maxsize=200_000)
def _short(symbol: str, length: int, state: int, v: tuple) -> tuple[str, int]:
    return _unroll(symbol, length, state, v)


def _unroll(symbol: str, length: int, state: int, v: tuple) -> tuple[str, int]:
    if length > 1:
        first = 1 << (length - 1).bit_length() - 1
        a, state = unroll(symbol, first, state, back(symbol, length - first, v))
        b, state = unroll(symbol, length - first, state, v)
        return a + b, state
    letters, before = "", apply(power(symbol, 0), v)
    while True:
        left = before[state]
        best = [(letter, after) for letter, cost, after in edits(state, symbol) if cost + v[after] == left]
        if INSERT + before[_NEXT[state]] == left and (not best or best[0][0] > "I"):
            letters, state = letters + "I", _NEXT[state]
            continue
        return letters + best[0][0], best[0][1]


def unroll(symbol: str, length: int, state: int, v: tuple) -> tuple[str, int]:
    """The ASCII-least cheapest letters of a run from ``state``, and the state after it; ``v`` are the costs-to-go after it."""
    least = min(v)
    v = tuple(x - least for x in v)
    return (_short if length <= CACHED_ROWS else _unroll)(symbol, length, state, v)


def block_matrix(runs: list[tuple[str, int]]) -> tuple:
    found = None
    for symbol, length in runs:
        for bit in range(length.bit_length()):
            if length >> bit & 1:
                found = power(symbol, bit) if found is None else times(found, power(symbol, bit))
    return found


def block_letters(runs: list[tuple[str, int]], state: int, v: tuple, last: bool) -> tuple[str, int, int]:
    """(letters, state after, cost) of a block from ``state``; ``v`` are the costs-to-go after it."""
    ends = [v]
    for symbol, length in reversed(runs):
        ends.append(back(symbol, length, ends[-1]))
    cost, letters = ends[-1][state], []
    for (symbol, length), after in zip(runs, reversed(ends[:-1]), strict=True):
        more, state = unroll(symbol, length, state, after)
        letters.append(more)
    while last and AT_END[state]:
        letters.append("I")
        state = _NEXT[state]
    return "".join(letters), state, cost


@lru_cache(maxsize=100_000)
def _whole(runs: tuple) -> tuple[str, int]:
    letters, _, cost = block_letters(list(runs), START, AT_END, True)
    return letters, cost


def damaged(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) damaged by crc32(``conv_id:turn``) % 20: 0 drops a row, 1 empties its text, 2 takes out its
    ``.!?``, 3 repeats it, 4 makes its role user. Nulls are one space in the sum too."""
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit(" ")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit(" ")).alias("text"))
    fault = F.crc32(F.concat_ws(":", *[F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]).cast("binary")) % 20
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    kept = rows.select("conv_id", "turn", F.when(fault == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), fault.alias("fault"), copies.alias("copies")).where("fault <> 0")
    return kept.select("conv_id", "turn", "role", "text", F.explode("copies").alias("copy")).drop("copy")


def _arrow(rows, schema, limit: int = 20_000):
    import pyarrow as pa

    held = []
    for row in rows:
        held.append(row)
        if len(held) >= limit:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _stream(batches):
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


class Repair:
    """The repair of (conv_id, turn, role, text) rows: :attr:`audits`, a row per block, :meth:`conversations` and :meth:`rows`."""

    def __init__(self, turns: DataFrame):
        self.scratch = Scratch(turns.sparkSession, "repair")
        head = F.substring("text", 1, 64)
        rows = turns.select("conv_id", "turn", "role", "text", head.alias("head"))
        parts = rows.repartitionByRange("conv_id", "turn", "role", "head").sortWithinPartitions("conv_id", "turn", "role", "head", "text")
        #: Range p; place i rises over all ranges.
        self.sorted = self.scratch.table(parts.select("conv_id", "turn", "role", "text", F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i")), "sorted", keep=True)
        self.blocks = self.scratch.table(self._blocks(), "blocks", keep=True)
        self.audits = self.scratch.table(self._audits(), "audits", keep=True)

    def _symbols(self) -> DataFrame:
        """conv_id, p, i, turn, initial, kind of each row, and whether its conversation crosses ranges."""
        bare = F.rtrim(F.col("text"), F.lit(SPACE))
        kind = F.when(bare == "", "b").when(F.right(bare, F.lit(1)).isin(".", "!", "?"), FULL).otherwise(TRUNCATED)
        slim = self.sorted.select("conv_id", "p", "i", "turn", F.substring("role", 1, 1).alias("initial"), kind.alias("kind"), F.sha2(F.concat_ws("\n", F.length("role").cast("string"), "role", "text"), 256).alias("said"))
        # Only what is said twice or more in a conversation is joined; equal rows count before they are shuffled.
        again = slim.where("kind <> 'b'").groupBy("conv_id", "said").agg(F.min("i").alias("first"), F.count("*").alias("n")).where("n > 1").select(F.col("conv_id").alias("c"), F.col("said").alias("s"), "first")
        crossing = self.sorted.groupBy("conv_id").agg(F.min("p").alias("a"), F.max("p").alias("b")).where("a < b").select(F.col("conv_id").alias("x"), F.lit(True).alias("crosses"))
        found = slim.join(again, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
        kind = F.when(F.col("kind") == "b", "b").when(F.col("i") > F.col("first"), "d").otherwise(F.col("kind"))
        # Ranges are neighbours: a conversation for each border at most.
        found = found.join(F.broadcast(crossing), F.col("conv_id").eqNullSafe(F.col("x")), "left")
        return found.select("conv_id", "p", "i", "turn", "initial", kind.alias("kind"), F.coalesce("crosses", F.lit(False)).alias("crosses"))

    def _blocks(self) -> DataFrame:
        def run(batches):
            import pyarrow as pa

            def blocks():
                key, state = None, None
                for conv, p, _, turn, initial, kind, crosses in _stream(batches):
                    if state is None or (conv, p) != key:
                        if state is not None:
                            yield close(key, state)
                        key, state = (conv, p), {"runs": [], "n": dict.fromkeys("bdtk", 0), "first": initial, "last": None, "illegal": 0, "turns": 0, "low": None, "high": None, "crosses": crosses}
                    state["n"][kind] += 1
                    if state["last"] is not None and state["last"] + initial not in LEGAL:
                        state["illegal"] += 1
                    state["last"] = initial
                    if turn is not None and turn != state["high"]:
                        state["turns"] += 1
                        state["low"] = turn if state["low"] is None else state["low"]
                        state["high"] = turn
                    # What must go goes whatever its role is, and only s, u and a can be kept.
                    symbol = "." + GONE if kind in "bd" else (initial if initial in ("s", "u", "a") else ".") + kind
                    runs = state["runs"]
                    if runs and runs[-1][0] == symbol:
                        runs[-1][1] += 1
                    else:
                        runs.append([symbol, 1])
                if state is not None:
                    yield close(key, state)

            def close(key, s):
                n, runs = s["n"], [tuple(r) for r in s["runs"]]
                letters, cost = (None, None) if s["crosses"] else _whole(tuple(runs))
                matrix = [x for row in block_matrix(runs) for x in row] if s["crosses"] else None
                kept = ([a for a, _ in runs], [b for _, b in runs]) if s["crosses"] else (None, None)
                return *key, s["crosses"], n["b"], n["d"], n["t"], s["illegal"], s["turns"], s["low"], s["high"], s["first"], s["last"], *kept, matrix, letters, cost

            long, text = pa.int64(), pa.string()
            schema = pa.schema([("conv_id", long), ("p", pa.int32()), ("crosses", pa.bool_()), *[(c, long) for c in ("blank", "duplicate", "truncated", "illegal", "turns", "low", "high")], ("first", text), ("last", text), ("symbols", pa.list_(text)), ("lengths", pa.list_(long)), ("matrix", pa.list_(long)), ("letters", text), ("cost", long)])
            yield from _arrow(blocks(), schema)

        ordered = self._symbols().repartition("conv_id", "p").sortWithinPartitions("conv_id", "p", "i")
        return ordered.mapInArrow(run, "conv_id long, p int, crosses boolean, blank long, duplicate long, truncated long, illegal long, turns long, low long, high long, first string, last string, symbols array<string>, lengths array<long>, matrix array<long>, letters string, cost long")

    def _audits(self) -> DataFrame:
        """conv_id, p, start (state), letters, cost (of the whole conversation, with its first block)."""
        single = self.blocks.where("not crosses").select("conv_id", "p", F.lit(START).alias("start"), "letters", "cost")
        crossing = self.blocks.where("crosses")

        def ends(batches):
            """The costs-to-go at each block's end."""
            import pyarrow as pa

            def rows():
                for conv, found in _stream(batches):
                    v = AT_END
                    for k, b in enumerate(reversed(found)):
                        yield conv, b["p"], list(v), not k
                        m = b["matrix"]
                        v = apply(tuple(tuple(m[r * 4 : r * 4 + 4]) for r in range(4)), v)

            yield from _arrow(rows(), pa.schema([("c", pa.int64()), ("q", pa.int32()), ("v", pa.list_(pa.int64())), ("final", pa.bool_())]))

        def letters(batches):
            import pyarrow as pa

            def rows():
                for conv, p, symbols, lengths, v, final in _stream(batches):
                    runs = list(zip(symbols, lengths, strict=True))
                    for state in range(4):
                        said, after, cost = block_letters(runs, state, tuple(v), final)
                        yield conv, p, state, after, said, cost

            yield from _arrow(rows(), pa.schema([("conv_id", pa.int64()), ("p", pa.int32()), ("start", pa.int32()), ("after", pa.int32()), ("letters", pa.string()), ("cost", pa.int64())]), 4)

        def starts(batches):
            import pyarrow as pa

            def rows():
                for conv, found in _stream(batches):
                    after, state = {(x["p"], x["start"]): x["after"] for x in found}, START
                    for p in sorted({x["p"] for x in found}):
                        yield conv, p, state
                        state = after[p, state]

            yield from _arrow(rows(), pa.schema([("c", pa.int64()), ("q", pa.int32()), ("s", pa.int32())]))

        def same(*pairs: tuple[str, str]) -> Column:
            return [F.col(a).eqNullSafe(F.col(b)) for a, b in pairs]

        # Matrices and states only, of as many blocks as there are ranges.
        matrices = crossing.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("p", "matrix"))))
        after = F.broadcast(matrices.mapInArrow(ends, "c long, q int, v array<long>, final boolean"))
        asked = crossing.join(after, same(("conv_id", "c"), ("p", "q"))).select("conv_id", "p", "symbols", "lengths", "v", "final")
        each = self.scratch.table(asked.mapInArrow(letters, "conv_id long, p int, start int, after int, letters string, cost long"), "letters", keep=True)
        chained = each.groupBy("conv_id").agg(F.collect_list(F.struct("p", "start", "after"))).mapInArrow(starts, "c long, q int, s int")
        chosen = each.join(F.broadcast(chained), same(("conv_id", "c"), ("p", "q"), ("start", "s"))).select("conv_id", "p", "start", "letters", "cost")
        return single.unionByName(chosen)

    def conversations(self) -> DataFrame:
        """A row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit."""
        facts = self.blocks.select("conv_id", "p", "blank", "duplicate", "truncated", "illegal", "turns", "low", "high", "first", "last")
        found = facts.join(self.audits.select(F.col("conv_id").alias("c"), F.col("p").alias("q"), "letters", "cost"), F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("p") == F.col("q")))
        before = Window.partitionBy("conv_id").orderBy("p")
        joint = (~F.concat(F.lag("last").over(before), F.col("first")).isin(*LEGAL)).cast("long")
        same_turn = (F.lag("high").over(before) == F.col("low")).cast("long")
        found = found.withColumns({"joint": F.coalesce(joint, F.lit(0)), "same": F.coalesce(same_turn, F.lit(0))})
        gaps = F.coalesce(F.max("high") - F.min("low") + 1 - F.sum(F.col("turns") - F.col("same")), F.lit(0))
        letters = F.array_sort(F.collect_list(F.struct("p", "letters")))
        return found.groupBy("conv_id").agg(
            gaps.alias("gaps"), F.sum("blank").alias("blank"), F.sum("duplicate").alias("duplicate"), F.sum("truncated").alias("truncated"),
            F.sum(F.col("illegal") + F.col("joint")).alias("illegal"), F.min_by("cost", "p").alias("cost"), F.array_join(F.transform(letters, lambda x: x["letters"]), "").alias("audit"),
        )

    def _edited(self) -> DataFrame:
        """Rows, and before those of a block a row of its edits (i = -1)."""
        edit = self.audits.select("conv_id", "p", F.lit(-1).cast("long").alias("i"), F.lit("").alias("role"), F.col("letters").alias("text"), "start")
        return self.sorted.select("conv_id", "p", "i", "role", "text", F.lit(None).cast("int").alias("start")).unionByName(edit)

    def rows(self) -> DataFrame:
        """The repaired turns: conv_id, p, place, role, text; a conversation's are ordered by (p, place)."""

        def run(batches):
            import pyarrow as pa

            long, text = pa.int64(), pa.string()
            yield from _arrow(((c, p, k, r, t) for c, p, k, r, t in _repaired(_stream(batches)) if r is not None), pa.schema([("conv_id", long), ("p", pa.int32()), ("place", long), ("role", text), ("text", text)]), 1000)

        dealt = self._edited().repartition("conv_id", "p").sortWithinPartitions("conv_id", "p", "i")
        return dealt.mapInArrow(run, "conv_id long, p int, place long, role string, text string")

    def digests(self) -> DataFrame:
        """conv_id, repaired_sha256 of its repaired ``role:text`` joined by line ends. A conversation is one running sum, as the digest
        is of all of it in order; turns pass through and none are held."""

        def run(batches):
            import pyarrow as pa

            def rows():
                key, running, started = None, None, False
                for conv, _, _, role, text in _repaired(_stream(batches)):
                    if running is None or conv != key:
                        if running is not None:
                            yield key, running.hexdigest()
                        key, running, started = conv, hashlib.sha256(), False
                    if role is not None:
                        running.update(f"{chr(10) if started else ''}{role}:{text}".encode())
                        started = True
                if running is not None:
                    yield key, running.hexdigest()

            yield from _arrow(rows(), pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))

        return self._edited().repartition("conv_id").sortWithinPartitions("conv_id", "p", "i").mapInArrow(run, "conv_id long, repaired_sha256 string")


def _repaired(rows):
    """(conv_id, p, place, role, text) of what the edits leave; a block begins with a row without a role."""
    letters = state = at = place = closing = conv = p = None

    def inserts():
        nonlocal at, state, place
        while at < len(letters) and letters[at] == "I":
            state, at, place = _NEXT[state], at + 1, place + 1
            yield conv, p, place, _NAMES[state], ""

    for conv_id, part, i, role, text, start in rows:
        if i < 0:
            letters, state, at, place, closing, conv, p = text, start, 0, 0, len(text.rstrip("I")), conv_id, part
            yield conv, p, 0, None, None
            continue
        if letters[at] == "I":
            yield from inserts()
        letter, at = letters[at], at + 1
        if letter != "D":
            state = emitted(state, role[:1]) if letter == "K" else _NEXT[state]
            place += 1
            yield conv, p, place, role if letter == "K" else _NAMES[state], text
        # Inserts after a block's last row close the conversation; those before a row are taken there.
        if at >= closing:
            yield from inserts()

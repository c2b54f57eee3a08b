r"""Chat formatting by prefix-target expansion (operator 6).

Every assistant turn becomes an example of its own: all turns before it as context, and its reply,
the only part under the loss mask. A conversation that doesn't end with the assistant has one example more,
of all its turns and an empty mask, so that no turn is lost.

Template: a turn is ``### role: text </turn>`` and a line end. In texts and roles, ``\``, ``###`` and ``</turn>`` (and in
roles ``:``) get a ``\`` before them; a ``\`` keeps the next character as it is, so unescaping is exact.

Rows are dealt out by conversation and sorted by turn (ties: role, then text), and each task runs
through its rows with the text so far; the memory is one conversation's. The examples together are the square of
a conversation's length, as the method has it.

Null texts and roles are empty. Rows without a conv_id are one conversation of that id. Repeated rows are turns like others.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, COLON, CLOSE = "### ", ": ", " </turn>\n"
TRAINED_ROLE = "assistant"
BATCH_CHARS = 4 << 20
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(r"### ((?:[^\\:]|\\.)*+): ((?:[^\\<]|\\.|<(?!/turn>))*+)</turn>\n", re.S)


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("###", "\\###").replace("</turn>", "\\</turn>")


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1", text)


def render(role: str, text: str) -> tuple[str, int]:
    """The turn, and where its escaped text begins."""
    head = OPEN + escape(role).replace(":", "\\:") + COLON
    return head + escape(text) + CLOSE, len(head)


def parse(formatted: str) -> Iterator[tuple[str, str]]:
    """(role, text) of each turn; raises if anything else is there."""
    at = 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        yield unescape(m.group(1)), unescape(m.group(2)[:-1])
        at = m.end()


def _groups(batches) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*[c.to_pylist() for c in batch.columns], strict=True)


def _batched(rows, schema, chars):
    """Record batches of about BATCH_CHARS; chars gives the size of a row."""
    import pyarrow as pa

    held, size = [], 0
    for row in rows:
        held.append(row)
        size += chars(row)
        if size >= BATCH_CHARS:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def expand(turns: DataFrame) -> DataFrame:
    """Examples of (conv_id, turn, role, text) rows: conv_id, example (from 0), n_turns, text, loss_start, loss_end (code points)."""

    def run(batches):
        import pyarrow as pa

        def examples():
            conv, started, prefix, n, example, closed = None, False, [], 0, 0, True
            for conv_id, _, role, text in _groups(batches):
                if not started or conv_id != conv:
                    if not closed:
                        whole = "".join(prefix)
                        yield conv, example, n, whole, len(whole), len(whole)
                    conv, started, prefix, n, example = conv_id, True, [], 0, 0
                turn, begins = render(role or "", text or "")
                prefix.append(turn)
                n += 1
                closed = role == TRAINED_ROLE
                if closed:
                    whole = "".join(prefix)
                    prefix = [whole]
                    yield conv, example, n, whole, len(whole) - len(turn) + begins, len(whole) - len(CLOSE)
                    example += 1
            if not closed:
                whole = "".join(prefix)
                yield conv, example, n, whole, len(whole), len(whole)

        schema = pa.schema([("conv_id", pa.int64()), ("example", pa.int64()), ("n_turns", pa.int64()), ("text", pa.string()), ("loss_start", pa.int64()), ("loss_end", pa.int64())])
        yield from _batched(examples(), schema, lambda r: len(r[3]))

    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, example long, n_turns long, text string, loss_start long, loss_end long")


def read_back(examples: DataFrame) -> DataFrame:
    """Digests of each conversation from its examples alone: what the template and the mask hold.

    conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, n_examples. The last example has every turn.
    """

    def run(batches):
        import pyarrow as pa

        def close(conv, state):
            loss, loss_chars, formatted, n, last = state
            turns, count = hashlib.sha256(), 0
            for role, text in parse(last):
                turns.update(f"{role}\n{text}\n".encode())
                count += 1
            return conv, count, turns.hexdigest(), loss_chars, loss.hexdigest(), formatted, n

        def digests():
            conv, state = None, None
            for conv_id, _, text, start, end in _groups(batches):
                if state is None or conv_id != conv:
                    if state is not None:
                        yield close(conv, state)
                    conv, state = conv_id, [hashlib.sha256(), 0, 0, 0, ""]
                target = unescape(text[start:end])
                state[0].update(target.encode())
                state[1] += len(target)
                state[2] += len(text)
                state[3] += 1
                state[4] = text
            if state is not None:
                yield close(conv, state)

        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_examples", pa.int64())])
        yield from _batched(digests(), schema, lambda r: 200)

    rows = examples.select("conv_id", "example", "text", "loss_start", "loss_end").repartition("conv_id").sortWithinPartitions("conv_id", "example")
    return rows.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long")

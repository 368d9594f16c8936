"""Chat formatting by prefix-target expansion.

A template marks each turn by its role. Every assistant turn becomes one
example: all preceding turns as context and only that reply trainable. Turns
after the last assistant turn form a last example without a target, so the
examples together hold the whole conversation.

Control strings inside texts are escaped by a backslash after their first
character (one more where backslashes stand there already), which
:func:`unescape` undoes exactly.

Plan: rows are shuffled by conversation and sorted by turn inside each
partition; a mapInArrow pass streams over them. State is the running text of
the current conversation, so memory follows the longest conversation, and no
conversation is gathered into a list. Examples come out in batches bounded by
bytes. Reading back streams over the examples in the same way.

Defined results for odd input: null text is empty; a null role is the role '';
other roles keep their name; rows with equal turn are ordered by role, then
text; null turns come first; rows with a null ``conv_id`` are one
conversation; repeated rows are repeated turns; an empty table gives no rows;
extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.session import ship_package

#: Role marks of the template; other roles use the last line's marks.
MARKS = {
    "user": ("[INST]", "[/INST]"),
    "assistant": ("<s>", "</s>"),
    "system": ("<<SYS>>", "<</SYS>>"),
}
ROLE, TURN = ("[ROLE]", "[/ROLE]"), ("[TURN]", "[/TURN]")
_ALL = sorted({m for pair in [*MARKS.values(), ROLE, TURN] for m in pair})
_ESCAPE = re.compile("|".join(f"{re.escape(m[0])}(?=\\\\*{re.escape(m[1:])})" for m in _ALL))
_UNESCAPE = re.compile("|".join(f"{re.escape(m[0])}\\\\(?=\\\\*{re.escape(m[1:])})" for m in _ALL))
_PARSE = re.compile(
    r"\[INST\](?P<user>.*?)\[/INST\]|<s>(?P<assistant>.*?)</s>|<<SYS>>(?P<system>.*?)<</SYS>>"
    r"|\[ROLE\](?P<role>.*?)\[/ROLE\]\[TURN\](?P<turn>.*?)\[/TURN\]",
    re.S,
)
_BATCH = 4 << 20


def escape(text: str) -> str:
    return _ESCAPE.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][0], text)


def format_turn(role: str, text: str) -> tuple[str, int, int]:
    """The formatted turn and where its text starts and ends in it."""
    body = escape(text)
    if role in MARKS:
        head, tail = MARKS[role]
    else:
        head, tail = ROLE[0] + escape(role) + ROLE[1] + TURN[0], TURN[1]
    return head + body + tail, len(head), len(head) + len(body)


def parse(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    at = 0
    while at < len(text):
        m = _PARSE.match(text, at)
        if m is None:
            raise ValueError(f"no turn at {at}")
        kind = m.lastgroup
        if kind == "turn":
            yield unescape(m["role"]), unescape(m["turn"])
        else:
            yield kind, unescape(m[kind])
        at = m.end()


_EXAMPLE = "conv_id long, example int, n_turns int, text string, loss_start long, loss_end long"
_EXAMPLE_KINDS = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
_NAMES = ["conv_id", "example", "n_turns", "text", "loss_start", "loss_end"]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for b in batches:
        for lo in range(0, b.num_rows, 512):
            yield from b.slice(lo, 512).to_pylist()


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), _EXAMPLE_KINDS)], _NAMES)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, text, turns, number, open_, out, size = object(), "", 0, 0, False, [], 0
    for r in _rows(batches):
        if r["conv_id"] != conv:
            if open_:  # turns after the last reply
                out.append((conv, number, turns, text, None, None))
                size += len(text)
            conv, text, turns, number, open_ = r["conv_id"], "", 0, 0, False
        role = r["role"] or ""
        piece, lo, hi = format_turn(role, r["text"] or "")
        at, text, turns, open_ = len(text), text + piece, turns + 1, role != "assistant"
        if not open_:
            out.append((conv, number, turns, text, at + lo, at + hi))
            size, number = size + len(text), number + 1
        if size > _BATCH:
            yield _batch(out)
            out, size = [], 0
    if open_:
        out.append((conv, number, turns, text, None, None))
    if out:
        yield _batch(out)


def expand_examples(turns: DataFrame) -> DataFrame:
    """One row per example: conv_id, its number, its turns, the formatted
    text, and the trainable span of code points (null: nothing)."""
    ship_package(turns.sparkSession)
    t = turns.select(F.col("conv_id").cast("long"), "turn", "role", "text")
    t = t.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text")
    return t.mapInArrow(_expand, _EXAMPLE)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples"]
    conv, last, loss, chars, n, out = object(), None, hashlib.sha256(), 0, 0, []

    def done() -> None:
        whole, count = hashlib.sha256(), 0
        for role, text in parse(last):
            whole.update(f"{role}\n{text}\n".encode())
            count += 1
        out.append((conv, count, whole.hexdigest(), chars, loss.hexdigest(), len(last), n))

    for b in batches:
        for i in range(b.num_rows):
            r = b.slice(i, 1).to_pylist()[0]
            if r["conv_id"] != conv:
                if last is not None:
                    done()
                conv, loss, chars, n = r["conv_id"], hashlib.sha256(), 0, 0
            last, n = r["text"], n + 1
            if r["loss_start"] is not None:
                reply = unescape(last[r["loss_start"] : r["loss_end"]])
                loss.update(reply.encode())
                chars += len(reply)
        if len(out) > 1000:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
            out.clear()
    if last is not None:
        done()
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)


def read_back(examples: DataFrame) -> DataFrame:
    """Per conversation, from its examples as they come out of
    :func:`expand_examples`: turns parsed from the longest example, the text
    under the loss mask of all of them, and the length of the whole formatted
    conversation."""
    return examples.mapInArrow(
        _digests,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_examples long",
    )


#: The two turns that the contract adds as conversation -1.
PROBE = [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]


def with_probe(turns: DataFrame) -> DataFrame:
    t = turns.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return t.unionByName(turns.sparkSession.createDataFrame(PROBE, "conv_id long, turn long, role string, text string"))

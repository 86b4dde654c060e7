"""Conversations as training text with marked turns, and the way back."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import arrow_schema, batches, fields

# Fixed values of the template: what opens and closes the text of a role.
ROLES = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>")}
# Any other role is spelt out: [ROLE]name[TEXT]text[/ROLE].
OTHER_OPEN, OTHER_TEXT, OTHER_CLOSE = "[ROLE]", "[TEXT]", "[/ROLE]"
CONTROLS = [m for pair in ROLES.values() for m in pair] + [OTHER_OPEN, OTHER_TEXT, OTHER_CLOSE]

_RESTS = "|".join(sorted(re.escape(c[1:]) for c in CONTROLS))
_CONFLICT = re.compile(rf"([<\[])(\\*)({_RESTS})")
_ESCAPED = re.compile(rf"([<\[])\\(\\*)({_RESTS})")
_CONTROL = re.compile("|".join(sorted(map(re.escape, CONTROLS), key=len, reverse=True)))
_ROLE_OF = {opening: role for role, (opening, _) in ROLES.items()}


class Turn(NamedTuple):
    """A turn that was read, with the place of its text (still escaped) in what was read."""

    role: str
    text: str
    start: int
    end: int


def escape(text: str) -> str:
    """A backslash more after the first sign of every control string, also of those that have backslashes there."""
    return _CONFLICT.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def parse(formatted: str) -> list[Turn]:
    """Turns of formatted text. Control strings are looked for from left to right; each must be the one that the grammar expects."""
    turns, at = [], 0
    while at < len(formatted):
        opening = _CONTROL.match(formatted, at)
        if not opening or opening[0] not in {*_ROLE_OF, OTHER_OPEN}:
            raise ValueError(f"no turn starts at {at}")
        start = opening.end()
        if opening[0] == OTHER_OPEN:
            middle = _CONTROL.search(formatted, start)
            if not middle or middle[0] != OTHER_TEXT:
                raise ValueError(f"the role at {start} has no end")
            role, close, start = unescape(formatted[start:middle.start()]), OTHER_CLOSE, middle.end()
        else:
            role = _ROLE_OF[opening[0]]
            close = ROLES[role][1]
        closing = _CONTROL.search(formatted, start)
        if not closing or closing[0] != close:
            raise ValueError(f"the turn at {at} has no end")
        turns.append(Turn(role, unescape(formatted[start:closing.start()]), start, closing.start()))
        at = closing.end()
    return turns


def render(role: str, text: str) -> str:
    if role in ROLES:
        opening, closing = ROLES[role]
        return opening + text + closing
    return OTHER_OPEN + role + OTHER_TEXT + text + OTHER_CLOSE


def format_turn(role: str, text: str) -> tuple[str, Turn]:
    """Formatted turn that reads back as the given one. Content is put down as it is, and escaped if it reads back otherwise."""
    for content in ((role, text), (escape(role), escape(text))):
        formatted = render(*content)
        try:
            turns = parse(formatted)
        except ValueError:
            continue
        if [t[:2] for t in turns] == [(role, text)]:
            return formatted, turns[0]
    raise ValueError("a turn does not read back as it was")


def format_turns(df: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text", learn: str = "assistant") -> DataFrame:
    """`(id, turn, formatted, loss_start, loss_chars)`: each turn as text, with the span under the loss mask.

    The formatted conversation is its turns one after the other in the order of
    `turn` (then of the text): a turn ends with a control string that its
    content cannot hold, so reading needs no separators. Every turn is read
    back and compared before it is given out. Spans count code points and are
    null for roles other than `learn`. Rows are formatted one by one, whatever
    the length of their conversation. Null role or text counts as empty; rows
    with a null id or turn, repeated rows and empty tables are formatted like
    any other; other columns are not read.
    """
    schema = StructType([*fields(df, id_col, turn_col), StructField("formatted", StringType()),
                         StructField("loss_start", LongType()), StructField("loss_chars", LongType())])
    out = arrow_schema(schema)

    def rows(source) -> Iterator[tuple]:
        for batch in source:
            for key, turn, role, text in zip(*[c.to_pylist() for c in batch.columns]):
                formatted, read = format_turn(role or "", text or "")
                span = (read.start, read.end - read.start) if role == learn else (None, None)
                yield key, turn, formatted, *span

    return df.select(id_col, turn_col, role_col, text_col).mapInArrow(
        lambda s: batches(out, rows(s), lambda r: 60 + 4 * len(r[2])), schema)


def digests(formatted: DataFrame, id_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """Per conversation what reads back: number of turns, SHA-256 of all turns and of all text under the loss mask.

    Rows are dealt by conversation, sorted on disk where needed, and read as a
    stream; a task holds one turn and two running digests, so a conversation of
    any length fits. A digest runs over its turns in order, which is the one
    thing here that a single task must do per conversation. Rows with a null id
    are one conversation; turns with a null number come first.
    """
    schema = StructType([
        *fields(formatted, id_col), StructField("n_turns", LongType()), StructField("turns_sha256", StringType()),
        StructField("loss_chars", LongType()), StructField("loss_sha256", StringType()), StructField("formatted_chars", LongType())])
    out = arrow_schema(schema)

    def rows(source) -> Iterator[tuple]:
        now = None
        for batch in source:
            for key, text, start, chars in zip(*[c.to_pylist() for c in batch.columns]):
                if now is None or now[0] != key:
                    if now:
                        yield _summary(now)
                    now = [key, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for turn in parse(text):
                    now[1] += 1
                    now[2].update(f"{turn.role}\n{turn.text}\n".encode("utf-8", "surrogatepass"))
                if start is not None:
                    learnt = unescape(text[start:start + chars])
                    now[3] += len(learnt)
                    now[4].update(learnt.encode("utf-8", "surrogatepass"))
                now[5] += len(text)
        if now:
            yield _summary(now)

    streamed = formatted.repartition(F.col(id_col)).sortWithinPartitions(id_col, turn_col, "formatted")
    return streamed.select(id_col, "formatted", "loss_start", "loss_chars").mapInArrow(lambda s: batches(out, rows(s), lambda r: 250), schema)


def _summary(now: list) -> tuple:
    key, turns, all_turns, chars, learnt, size = now
    return key, turns, all_turns.hexdigest(), chars, learnt.hexdigest(), size

"""Chat formatting with a grammar round trip.

A conversation is the concatenation of its turns, and a turn reads

    <s>[INST]role[/INST]text</s>

The grammar is deterministic: a role ends at the first closing mark, a text at the first
end mark. A role or text that holds a control string, or an escaped one, gets a backslash
after the string's first character, one more than it already has there; the parser takes
one away. Rendering starts from the plain text and reparses what it made: only if the
recovered turn differs is the conflicting content escaped, until both are identical.

The loss mask covers the texts of assistant turns, each once and in order.

Rows of a conversation are ordered by turn, then role and text; null roles and texts count
as empty. Rows without conv_id form one conversation of that id. Repeated rows are turns
of their own, an empty table gives no rows, and further columns are ignored.
"""

from __future__ import annotations

import hashlib
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.session import bounded_batches

# Fixed values of the template.
BEGIN, ROLE_END, END = "<s>[INST]", "[/INST]", "</s>"
CONTROL = ("<s>", "</s>", "[INST]", "[/INST]")
TRAINED = "assistant"

_PLAIN = re.compile("|".join(f"{re.escape(c[0])}(?=\\\\*{re.escape(c[1:])})" for c in CONTROL))
_ESCAPED = re.compile("|".join(f"{re.escape(c[0])}\\\\(?=\\\\*{re.escape(c[1:])})" for c in CONTROL))
_MAX_ROUNDS = 3


def escape(text: str) -> str:
    return _PLAIN.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[0][:-1], text)


class FormatError(ValueError):
    """The text doesn't follow the grammar."""


def parse(text: str) -> list[tuple[str, str, int, int]]:
    """(role, text, start and end of the raw text) of each turn; fails on anything else."""
    at, turns = 0, []
    while at < len(text):
        if not text.startswith(BEGIN, at):
            raise FormatError(f"no turn begins at {at}")
        role = at + len(BEGIN)
        body = text.find(ROLE_END, role)
        if body < 0:
            raise FormatError(f"the role at {role} has no end")
        start = body + len(ROLE_END)
        end = text.find(END, start)
        if end < 0:
            raise FormatError(f"the text at {start} has no end")
        raw = text[role:body], text[start:end]
        if any(c in part for part in raw for c in CONTROL):
            raise FormatError(f"a control string inside the turn at {at}")
        turns.append((unescape(raw[0]), unescape(raw[1]), start, end))
        at = end + len(END)
    return turns


def render_turn(role: str, text: str) -> str:
    """One turn that parses back to exactly this role and text."""
    a, b = role, text
    for _ in range(_MAX_ROUNDS):
        out = f"{BEGIN}{a}{ROLE_END}{b}{END}"
        try:
            got = parse(out)
        except FormatError:
            got = []
        if len(got) == 1 and got[0][:2] == (role, text):
            return out
        if not got or got[0][0] != role or len(got) > 1:
            a = escape(role)
        b = escape(text)
    raise FormatError("a turn can't be made to parse back")


def render(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and formatted: each row's piece of its conversation, made in parallel."""
    bounded_batches(conversations.sparkSession)

    def pieces(batches):
        for batch in batches:
            role, text = batch.column(2).fill_null(""), batch.column(3).fill_null("")
            out = [render_turn(r, t) for r, t in zip(role.to_pylist(), text.to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), role, text, pa.array(out, pa.string())], names=["conv_id", "turn", "role", "text", "formatted"])

    return conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text").mapInArrow(
        pieces, "conv_id long, turn long, role string, text string, formatted string"
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """Digests of each conversation, from its formatted pieces alone.

    A partition streams through its conversations in order of turns, so a conversation of
    any length needs the memory of one batch.
    """
    bounded_batches(rendered.sparkSession)
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def digest(batches):
        at, open_ = None, None
        for batch in batches:
            done = []
            for conv_id, piece in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if open_ is None or conv_id != at:
                    if open_ is not None:
                        done.append(open_.row(at))
                    at, open_ = conv_id, _Digest()
                open_.add(piece)
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*done, strict=True), kinds, strict=True)], names=names)
        if open_ is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(open_.row(at), kinds, strict=True)], names=names)

    return (
        rendered.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
        .select("conv_id", "formatted")
        .mapInArrow(digest, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    )


class _Digest:
    def __init__(self):
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()
        self.n = self.loss_chars = self.chars = 0

    def add(self, piece: str) -> None:
        self.chars += len(piece)
        for role, text, _, _ in parse(piece):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode())
            if role == TRAINED:
                self.loss_chars += len(text)
                self.loss.update(text.encode())

    def row(self, conv_id):
        return conv_id, self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def formatted(conversations: DataFrame) -> DataFrame:
    """conv_id and the whole formatted text with its loss spans [start, end), one row a conversation.

    For conversations that fit a row; read_back() streams those of any length.
    """
    at = F.struct("turn", "role", "text", "formatted")
    pieces = render(conversations).groupBy("conv_id").agg(F.sort_array(F.collect_list(at)).alias("p"))

    def spans(batches):
        for batch in batches:
            out = [[[a, b] for r, _, a, b in parse(x) if r == TRAINED] for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, pa.list_(pa.list_(pa.int64())))], names=["conv_id", "formatted", "loss_spans"])

    return pieces.select("conv_id", F.array_join("p.formatted", "").alias("formatted")).mapInArrow(
        spans, "conv_id long, formatted string, loss_spans array<array<bigint>>"
    )

"""Chat formatting by a finite-state machine over roles, with a loss flag for each text segment.

A template is declared, not coded: which role may follow which, the text before and after a turn, and
the roles whose text is under the loss mask. Conversations are dealt by id and sorted by turn; a task
streams over them, so a conversation of any length is formatted turn by turn. Each turn gives segments
(text, loss): the template's marks without loss, the turn's text with or without.

Control strings inside texts are escaped reversibly: in "<", backslashes, "|" one backslash is added.
So a formatted text holds "<|" only where the template wrote it. Line ends in roles are escaped, too.

Defined results: null texts and roles count as empty; rows with a null conv_id are one conversation;
a null turn comes first, equal turns are ordered by role and text, and equal rows are turns each;
a conversation whose roles the machine doesn't allow is formatted too, with valid = false; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm import words as W

START = "start"


@dataclass(frozen=True)
class Template:
    before: str = "<|im_start|>{role}\n"
    after: str = "<|im_end|>\n"
    loss: frozenset = frozenset({"assistant"})
    #: The machine: a role that may follow a state, which is the role before, or START.
    follows: dict = field(default_factory=lambda: {START: {"system", "user"}, "system": {"user"}, "user": {"assistant"}, "assistant": {"user"}})
    #: Roles after which a conversation may end.
    ends: frozenset = frozenset({"assistant"})

    def step(self, state: str | None, role: str) -> str | None:
        """The next state, None if the machine has refused."""
        return role if state is not None and role in self.follows.get(state, ()) else None

    def segments(self, role: str, text: str) -> list[tuple[str, bool]]:
        return [(self.before.format(role=escape_role(role)), False), (escape(text), role in self.loss), (self.after, False)]


CHATML = Template()


def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\1\\|", text)


def unescape(text: str) -> str:
    return re.sub(r"<(\\*)\\\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """As escape; a line end, which would end the role, and backslashes are written as in a string literal."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def formatted(turns: DataFrame, template: Template = CHATML) -> DataFrame:
    """(conv_id, seq, segments, valid) for each turn, in order within partitions, conversations whole in one.

    seq counts from 0; valid: whether the machine has accepted all turns so far, and, with the last one
    (last = true), whether the conversation may end there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fields = pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))
        conv, seq, state, waits = None, -1, START, None
        began = False

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            cols = list(zip(*rows, strict=True))
            kinds = [pa.int64(), pa.int64(), fields, pa.bool_(), pa.bool_()]
            return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], ["conv_id", "seq", "segments", "valid", "last"])

        for batch in W.slices(batches):
            out = []
            for c, role, text in zip(*(W.column(batch, k).to_pylist() for k in ("conv_id", "role", "text")), strict=True):
                if waits is not None:
                    same = began and c == conv
                    out.append((*waits, state is not None and (same or state in template.ends), not same))
                if not began or c != conv:
                    conv, seq, state, began = c, -1, START, True
                seq, state = seq + 1, template.step(state, role)
                waits = (c, seq, [{"text": t, "loss": x} for t, x in template.segments(role, text)])
            if out:
                yield batch_of(out)
        if waits is not None:
            yield batch_of([(*waits, state is not None and state in template.ends, True)])

    blank = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), blank("role"), blank("text"))
    parts = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ordered = rows.repartition(parts, "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return ordered.mapInArrow(run, "conv_id long, seq long, segments array<struct<text:string,loss:boolean>>, valid boolean, last boolean")


def digest(formatted_: DataFrame, template: Template = CHATML) -> DataFrame:
    """Read formatted turns back: per conversation n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, valid. Streams, with running digests."""
    head = re.compile(re.escape(template.before).replace(re.escape("{role}"), r"(?P<role>.*?)"), re.S)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"]
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
        n, loss, chars, turns, masked = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
        for batch in batches:
            out = []
            for conv, segments, valid, last in zip(*(W.column(batch, k).to_pylist() for k in ("conv_id", "segments", "valid", "last")), strict=True):
                whole = "".join(s["text"] for s in segments)
                begin = head.match(whole)
                if not begin or not whole.endswith(template.after):
                    raise ValueError("not a turn of this template")
                text = unescape(whole[begin.end() : len(whole) - len(template.after)])
                turns.update(f"{unescape_role(begin['role'])}\n{text}\n".encode())
                for s in segments:
                    if s["loss"]:
                        plain = unescape(s["text"])
                        masked.update(plain.encode())
                        loss += len(plain)
                n, chars = n + 1, chars + len(whole)
                if last:
                    out.append((conv, n, turns.hexdigest(), loss, masked.hexdigest(), chars, valid))
                    n, loss, chars, turns, masked = 0, 0, 0, hashlib.sha256(), hashlib.sha256()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)], names)

    return formatted_.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")

"""Conversations to training text with a loss mask, under a declarative template.

A finite-state machine over roles walks each conversation in turn order: a state is the
last role, an edge says which may follow.  Turns out of order are formatted like others
and marked.  Control strings inside a text are escaped, so that the formatted text can be
read back.  Conversations are streamed turn by turn: a task never holds one whole.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.common import map_batches

START = ""


@dataclass(frozen=True)
class Template:
    """How turns are marked, which texts bear loss, and which role may follow which."""

    prefix: dict[str, str] = field(default_factory=lambda: {
        "system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "})
    #: Marks a turn of a role the template does not know; the escaped role and a line end follow.
    other: str = "### Role: "
    suffix: str = " </turn>\n"
    loss: frozenset[str] = frozenset({"assistant"})
    follows: dict[str, frozenset[str]] = field(default_factory=lambda: {
        START: frozenset({"system", "user"}), "system": frozenset({"user"}),
        "user": frozenset({"assistant"}), "assistant": frozenset({"user"})})

    def control(self) -> list[str]:
        """Strings that a text must not hold unescaped."""
        return sorted({m.strip() for m in [*self.prefix.values(), self.other, self.suffix]})

    def escaper(self) -> re.Pattern:
        return re.compile("|".join(map(re.escape, ["\\", *self.control()])))


def escape(template_pattern: re.Pattern, text: str) -> str:
    """A backslash before every backslash and control string."""
    return template_pattern.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.DOTALL)


SEGMENT_SCHEMA = "conv_id long, turn_no long, segment int, role string, valid boolean, loss boolean, text string"
SUMMARY_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean"
)


def format_segments(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Segments of every turn of ``turns`` (conv_id, turn, role, text), in order within a task.

    Three segments a turn: the mark before, the escaped text, the mark after; ``loss`` is
    true for the text of a role that bears loss.  ``valid`` is false from the first turn
    that the machine does not allow.  A null text or role is empty; turns of one number go
    by role and text; a null turn comes first; turns without a conv_id are one conversation.
    """

    def work(batches):
        pattern = template.escaper()
        current, state, n, valid = object(), START, 0, True
        for batch in batches:
            out = []
            for conv, role, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if conv != current:
                    current, state, n, valid = conv, START, 0, True
                valid = valid and role in template.follows.get(state, ())
                state = role
                mark = template.prefix.get(role)
                if mark is None:
                    mark = f"{template.other}{escape(pattern, role)}\n"
                head = (conv, n)
                out.append((*head, 0, role, valid, False, mark))
                out.append((*head, 1, role, valid, role in template.loss, escape(pattern, text)))
                out.append((*head, 2, role, valid, False, template.suffix))
                n += 1
            if out:
                types = [pa.int64(), pa.int64(), pa.int32(), pa.string(), pa.bool_(), pa.bool_(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["conv_id", "turn_no", "segment", "role", "valid", "loss", "text"])

    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.coalesce("role", F.lit("")).alias("role"),
        F.coalesce("text", F.lit("")).alias("text"), F.col("turn").cast("long").alias("turn"),
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return map_batches(rows.select("conv_id", "role", "text"), work, SEGMENT_SCHEMA)


def read_back(segments: DataFrame, template: Template = Template()) -> DataFrame:
    """A digest of every conversation, from its formatted text alone.

    Reads the segments in the order in which they were written: roles and texts are found
    by their marks and unescaped, the masked text by the loss flags.
    """

    def work(batches):
        roles = {mark: role for role, mark in template.prefix.items()}
        current, sums, out = None, None, []

        def done():
            conv, n, turns, loss, loss_chars, chars, valid = sums
            out.append((conv, n, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, valid))

        def flushed():
            types = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_()]
            batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "valid"])
            out.clear()
            return batch

        for batch in batches:
            get = {name: batch.column(name).to_pylist() for name in ("conv_id", "valid", "loss", "text")}
            for conv, valid, loss, text in zip(*get.values()):
                if sums is None or conv != current:
                    if sums is not None:
                        done()
                    current, sums = conv, [conv, 0, hashlib.sha256(), hashlib.sha256(), 0, 0, True]
                sums[5] += len(text)
                sums[6] = sums[6] and valid
                if text in roles or text.startswith(template.other):
                    role = roles.get(text)
                    role = unescape(text[len(template.other) : -1]) if role is None else role
                    sums[1] += 1
                    sums[2].update(f"{role}\n".encode())
                elif text != template.suffix:
                    plain = unescape(text).encode()
                    sums[2].update(plain + b"\n")
                    if loss:
                        sums[3].update(plain)
                        sums[4] += len(plain.decode())
            if len(out) >= 1000:
                yield flushed()
        if sums is not None:
            done()
        if out:
            yield flushed()

    return map_batches(segments, work, SUMMARY_SCHEMA)

"""Chat formatting: a finite-state machine over roles and a declarative template with loss flags.

Rows of a conversation come in order of turn; each becomes text segments, and each segment says whether loss is taken
on it. The machine checks the order of roles; a conversation that breaks it is still formatted and marked as broken.
Control strings and backslashes inside a text get a backslash, which reading back removes.

Defined cases: a null text or role is empty; a null conversation is one conversation, and null turns come first. Turns
with the same number come in order of role, then text. Roles that the template doesn't name keep their name in a turn
of the general form. A text of any length is one segment. One conversation is read by one task, since its digest runs from
turn to turn, but only the turn at hand is in memory, however long the conversation. An empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from evalloom.llm.shared import small_batches

Segment = tuple[str, bool]


@dataclass(frozen=True)
class Template:
    """marks: role -> (open, close, loss on the text). general: (open, between role and text, close) for other roles."""

    marks: dict = field(default_factory=lambda: {"system": ("<<SYS>>", "<</SYS>>", False), "user": ("[INST]", "[/INST]", False), "assistant": ("<s>", "</s>", True)})
    general: tuple = ("<<TURN>>", "<<TEXT>>", "<</TURN>>")
    moves: dict = field(default_factory=lambda: {("start", "system"): "system", ("start", "user"): "user", ("system", "user"): "user", ("user", "assistant"): "assistant", ("assistant", "user"): "user"})
    ends: tuple = ("user", "assistant")

    def controls(self) -> str:
        marks = [m for o, c, _ in self.marks.values() for m in (o, c)] + [*self.general]
        return "|".join(map(re.escape, sorted(marks, key=len, reverse=True)))


def step(template: Template, state: str, role: str) -> str:
    """The next state; "broken" is for good."""
    return template.moves.get((state, role), "broken")


class Formatter:
    def __init__(self, template: Template):
        self.template = template
        self.guard = re.compile(rf"\\|{template.controls()}")
        self.unguard = re.compile(rf"\\(\\|{template.controls()})")
        self.token = re.compile(rf"\\(?:\\|{template.controls()})|({template.controls()})")

    def escape(self, text: str) -> str:
        return self.guard.sub(lambda m: "\\" + m[0], text)

    def unescape(self, text: str) -> str:
        return self.unguard.sub(lambda m: m[1], text)

    def segments(self, role: str, text: str) -> list[Segment]:
        """One turn's segments (text, loss)."""
        if role in self.template.marks:
            before, after, loss = self.template.marks[role]
            return [(before, False), (self.escape(text), loss), (after, False)]
        before, between, after = self.template.general
        return [(before, False), (self.escape(role), False), (between, False), (self.escape(text), False), (after, False)]

    def read(self, formatted: str) -> Iterator[tuple[str, str]]:
        """(role, text) of each turn in a formatted string."""
        opens = {o: r for r, (o, _, _) in self.template.marks.items()}
        role, start = None, 0
        for m in self.token.finditer(formatted):
            if not m[1]:
                continue
            if m[1] in opens:
                role, start = opens[m[1]], m.end()
            elif m[1] == self.template.general[0]:
                start = m.end()
            elif m[1] == self.template.general[1]:
                role, start = self.unescape(formatted[start : m.start()]), m.end()
            else:
                yield role, self.unescape(formatted[start : m.start()])


def turns_in_order(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) with a conversation in one partition and its turns in order."""
    plain = rows.selectExpr("conv_id", "turn", "coalesce(role, '') as role", "coalesce(text, '') as text")
    return plain.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


def format_turns(rows: DataFrame, template: Template | None = None) -> DataFrame:
    """One row per turn: conv_id, place (0, 1, ...), segments array<struct<text, loss>>, state after it."""
    template = template or Template()
    small_batches(rows.sparkSession)
    kind = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("segments", pa.list_(pa.struct([("text", pa.string()), ("loss", pa.bool_())]))), ("state", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, last, place, state = Formatter(template), object(), 0, "start"
        for batch in batches:
            out = []
            for conv, _, role, text in rows_of([batch]):
                if conv != last:
                    last, place, state = conv, 0, "start"
                state = step(template, state, role)
                out.append({"conv_id": conv, "place": place, "segments": [{"text": t, "loss": f} for t, f in form.segments(role, text)], "state": state})
                place += 1
            yield pa.RecordBatch.from_pylist(out, schema=kind)

    return turns_in_order(rows).mapInArrow(run, "conv_id long, place long, segments array<struct<text:string,loss:boolean>>, state string")


def read_back(formatted: DataFrame, template: Template | None = None, in_order: bool = False) -> DataFrame:
    """What the formatted turns say, one row per conversation; digests are updated turn by turn.

    Turns are brought together and in order first. in_order says that they are already, straight from `format_turns`.

    conv_id, n_turns, turns_sha256 (role, newline, text, newline of each turn), loss_chars and loss_sha256 (the unescaped
    text under the loss flags), formatted_chars, valid (the machine ended in an end state).
    """
    template = template or Template()
    kind = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("valid", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        form, now = Formatter(template), None

        def closed(c: dict) -> pa.RecordBatch:
            return pa.RecordBatch.from_pylist([c | {"turns_sha256": c["turns_sha256"].hexdigest(), "loss_sha256": c["loss_sha256"].hexdigest(), "valid": c["valid"] in template.ends}], schema=kind)

        done: list[pa.RecordBatch] = []
        for conv, _, segments, state in rows_of(batches):
            if now is None or conv != now["conv_id"]:
                if now is not None:
                    done.append(closed(now))
                if len(done) >= 1000:
                    yield from pa.Table.from_batches(done).combine_chunks().to_batches()
                    done = []
                now = {"conv_id": conv, "n_turns": 0, "turns_sha256": hashlib.sha256(), "loss_chars": 0, "loss_sha256": hashlib.sha256(), "formatted_chars": 0}
            whole = "".join(s["text"] for s in segments)
            for role, text in form.read(whole):
                now["n_turns"] += 1
                now["turns_sha256"].update(f"{role}\n{text}\n".encode())
            loss = form.unescape("".join(s["text"] for s in segments if s["loss"]))
            now["loss_chars"] += len(loss)
            now["loss_sha256"].update(loss.encode())
            now["formatted_chars"] += len(whole)
            now["valid"] = state
        if now is not None:
            done.append(closed(now))
        yield from pa.Table.from_batches(done, kind).combine_chunks().to_batches()

    turns = formatted.select("conv_id", "place", "segments", "state")
    if not in_order:
        small_batches(formatted.sparkSession)
        turns = turns.repartition("conv_id").sortWithinPartitions("conv_id", "place")
    return turns.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, valid boolean")

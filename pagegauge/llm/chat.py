"""Chat formatting: a finite-state machine over roles and a declarative template, as segments with loss flags.

Turns are dealt by conversation and sorted; both the formatter and the reader
stream over them and hold one turn at a time, so a conversation of any length
needs the memory of its longest turn.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Template:
    """What stands around each role's text, what order roles may have, and whose text is learned from.

    Opening strings must tell roles apart at the place where a turn begins, and
    a closing string ends with a control string that no escaped text holds.
    """

    begin: str = "<s>"
    roles: dict[str, tuple[str, str]] = field(default_factory=lambda: {"system": ("<<SYS>>\n", "\n<</SYS>>\n\n"), "user": ("[INST] ", " [/INST]"), "assistant": (" ", " </s>")})
    other: tuple[str, str, str] = ("<<ROLE:", ">>\n", "\n<</ROLE>>\n")
    control: tuple[str, ...] = ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "<<ROLE:", "<</ROLE>>")
    escape: str = "\\"
    learned: tuple[str, ...] = ("assistant",)
    #: state -> role -> next state; a turn without one is out of order, and the machine goes on from where that role leads.
    moves: dict[str, dict[str, str]] = field(default_factory=lambda: {"start": {"system": "told", "user": "asked"}, "told": {"user": "asked"}, "asked": {"assistant": "answered"}, "answered": {"user": "asked"}})
    final: tuple[str, ...] = ("answered",)

    def escaped(self, text: str) -> str:
        """text with an escape mark inside each control string and escape marks doubled."""
        return _escapes(self).sub(lambda m: self.escape * 2 if m[0] == self.escape else m[0][0] + self.escape + m[0][1:], text)

    def unescaped(self, text: str) -> str:
        e = re.escape(self.escape)
        return re.sub(f"{e}({e}?)", r"\1", text) if self.escape in text else text

    def landing(self, role: str) -> str:
        return next((to for state in self.moves.values() for r, to in state.items() if r == role), "answered")


def _escapes(template: Template) -> re.Pattern:
    return re.compile("|".join(map(re.escape, sorted((template.escape, *template.control), key=len, reverse=True))))


SEGMENTS = "conv_id long, turn_no long, role string, piece int, text string, loss boolean, in_order boolean"


def _format(template: Template):
    """Per turn: its opening, text and closing segments; the first opening also begins the conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, number, fresh = None, "start", 0, True
        for batch in batches:
            out = {name: [] for name in ("conv_id", "turn_no", "role", "piece", "text", "loss", "in_order")}
            for conv, role, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                if fresh or conv != now:
                    now, state, number, fresh = conv, "start", 0, False
                role, begin = role or "", "" if number else template.begin
                step = template.moves[state].get(role)
                state = step or template.landing(role)
                if role in template.roles:
                    head, tail = template.roles[role]
                else:
                    head, tail = template.other[0] + quote(role, safe="") + template.other[1], template.other[2]
                for k, (piece, loss) in enumerate(((begin + head, False), (template.escaped(text or ""), role in template.learned), (tail, False))):
                    for name, v in zip(out, (conv, number, role, k, piece, loss, step is not None), strict=True):
                        out[name].append(v)
                number += 1
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), (pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()), strict=True)], names=list(out))

    return run


def segments(turns: DataFrame, template: Template = Template()) -> DataFrame:
    """Rows of SEGMENTS, three a turn, dealt by conversation and in order within partitions.

    Turns come by conv_id, turn, then role and text for ties; repeated rows are
    turns of their own. Null texts and roles count as empty, null conv_ids are
    one conversation, a role that the template does not name gets a marked turn
    of its own. in_order: the machine allowed the role there.
    """
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(_format(template), SEGMENTS)


class Reader:
    """Turns of formatted text that comes in pieces: feed() gives the (role, text) that a piece completes."""

    def __init__(self, template: Template) -> None:
        self.template, self.held, self.begun = template, "", False
        t = template
        self.heads = sorted(((head, role, tail) for role, (head, tail) in t.roles.items()), key=lambda x: -len(x[0]))

    def feed(self, piece: str) -> list[tuple[str, str]]:
        self.held += piece
        out = []
        while (turn := self._turn()) is not None:
            out.append(turn)
        return out

    def _turn(self) -> tuple[str, str] | None:
        t = self.template
        if not self.begun:
            if not self.held.startswith(t.begin):
                return None
            self.held, self.begun = self.held[len(t.begin) :], True
        role, tail, at = None, "", 0
        if self.held.startswith(t.other[0]):
            close = self.held.find(t.other[1])
            if close < 0:
                return None
            role, tail, at = unquote(self.held[len(t.other[0]) : close]), t.other[2], close + len(t.other[1])
        else:
            for head, name, end in self.heads:
                if self.held.startswith(head):
                    role, tail, at = name, end, len(head)
                    break
        if role is None:
            return None
        end = self.held.find(tail, at)
        if end < 0:
            return None
        text, self.held = self.held[at:end], self.held[end + len(tail) :]
        return role, t.unescaped(text)


REPORT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, in_order boolean"


def _report(template: Template):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, open_ = None, False
        names = [x.split()[0] for x in REPORT.split(", ")]
        done: list[tuple] = []

        def begin(conv):
            nonlocal now, open_, reader, turns, loss, n_turns, loss_chars, chars, fine, state
            now, open_, reader = conv, True, Reader(template)
            turns, loss, n_turns, loss_chars, chars, fine, state = hashlib.sha256(), hashlib.sha256(), 0, 0, 0, True, "start"

        def close():
            if reader.held:
                raise ValueError(f"conversation {now}: formatted text does not read back")
            done.append((now, n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars, fine and state in template.final))

        def taken():
            rows, done[:] = list(done), []
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.bool_())
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

        reader = turns = loss = None
        n_turns = loss_chars = chars = 0
        fine, state = True, "start"
        for batch in batches:
            for conv, text, learned in zip(*[batch.column(k).to_pylist() for k in range(3)], strict=True):
                if not open_ or conv != now:
                    if open_:
                        close()
                    begin(conv)
                chars += len(text)
                if learned:
                    plain = template.unescaped(text)
                    loss_chars += len(plain)
                    loss.update(plain.encode())
                for role, said in reader.feed(text):
                    n_turns += 1
                    turns.update(f"{role}\n{said}\n".encode())
                    step = template.moves[state].get(role)
                    fine, state = fine and step is not None, step or template.landing(role)
            if done:
                yield taken()
        if open_:
            close()
        if done:
            yield taken()

    return run


def read_back(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """REPORT of each conversation, from the segments that segments() made and in their order: turns are parsed out of the text alone."""
    return formatted.select("conv_id", "text", "loss").mapInArrow(_report(template), REPORT)

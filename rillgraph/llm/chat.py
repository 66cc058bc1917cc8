"""Chat formatting in budgeted windows.

A conversation's turns are laid end to end; the prefix sum of tokens before a turn, divided by what a window has room for,
names the window that trains on it. So windows end at turns. Each window opens with the system turn and repeats a limited
history, both outside the loss mask; each assistant text lies under the mask of one window.

Conversations are dealt by id and sorted by turn; the formatter and the reader go through them as streams and hold one
window's history, not a conversation. A very long conversation costs one task's time, as its digest must be one stream.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rillgraph.llm.packing import tokenizer

# The marks of the template, and the control strings of common templates that texts may not show.
START, MIDDLE, END = "<|turn|>", "\n", "<|end|>\n"
CONTROLS = ("<|", "<s>", "</s>", "<<SYS>>", "<</SYS>>", "[INST]", "[/INST]")

_CONTROL = re.compile("|".join(f"{re.escape(c[0])}(?={re.escape(c[1:])})" for c in CONTROLS))
_ESCAPED = re.compile(r"\\([\\!n])")
_TURN = re.compile(f"{re.escape(START)}(.*?){MIDDLE}(.*?){re.escape(END)}", re.S)
#: Tokens of a turn's marks, roughly.
MARKS = 8

WINDOW = "conv_id {kind}, window long, text string, n_repeated int, n_tokens long, over boolean, loss array<struct<start:int,end:int>>"


def escape(text: str) -> str:
    """The text with backslashes doubled and every control string broken by ``\\!`` after its first character."""
    return _CONTROL.sub(lambda m: m[0] + "\\!", text.replace("\\", "\\\\"))


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: {"\\": "\\", "!": "", "n": "\n"}[m[1]], text)


def _header(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def parse(text: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a formatted window."""
    return [(unescape(a), unescape(b)) for a, b in _TURN.findall(text)]


class _Formatter:
    """Turns of one conversation in, windows out."""

    def __init__(self, conv, budget: int, history: int) -> None:
        self.conv, self.budget, self.history = conv, budget, history
        self.system: tuple[str, str, int] | None = None
        self.past: list[tuple[str, str, int]] = []
        self.turns: list[tuple[str, str, int]] = []
        self.before = self.number = self.seen = 0
        self.room = budget

    def _close(self) -> tuple | None:
        if not self.turns:
            return None
        again = ([self.system] if self.system and self.number else []) + self.past
        text, loss = [], []
        at = 0
        for i, (role, body, _) in enumerate(again + self.turns):
            head, body = START + _header(role) + MIDDLE, escape(body)
            if i >= len(again) and role == "assistant":
                loss.append({"start": at + len(head), "end": at + len(head) + len(body)})
            text += [head, body, END]
            at += len(head) + len(body) + len(END)
        tokens = sum(t[2] for t in again + self.turns)
        row = (self.conv, self.number, "".join(text), len(again), tokens, tokens > self.budget, loss)
        kept, size = [], 0
        for t in reversed(self.past + self.turns):
            if size + t[2] > self.history or t is self.system:
                break
            kept, size = [t, *kept], size + t[2]
        self.past, self.turns, self.number = kept, [], self.number + 1
        return row

    def add(self, role: str, body: str, tokens: int) -> tuple | None:
        turn, row = (role, body, tokens), None
        if not self.seen:
            if role == "system" and tokens <= self.budget // 2:
                self.system = turn
            self.room = self.budget - self.history - (tokens if self.system else 0)
        span = self.before // max(1, self.room)
        if self.turns and (span != (self.before - self.turns[-1][2]) // max(1, self.room) or self.size() + tokens > self.budget):
            row = self._close()
        self.turns.append(turn)
        self.before += tokens
        self.seen += 1
        return row

    def size(self) -> int:
        again = (self.system[2] if self.system and self.number else 0) + sum(t[2] for t in self.past)
        return again + sum(t[2] for t in self.turns)

    def end(self) -> tuple | None:
        return self._close()


def _format(path: str | None, budget: int, history: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, now = tokenizer(path), None
        kinds, out, held = None, [], 0
        names = ["conv_id", "window", "text", "n_repeated", "n_tokens", "over", "loss"]

        def put(row: tuple | None) -> None:
            nonlocal held
            if row:
                out.append(row)
                held += len(row[2])

        def flush() -> pa.RecordBatch:
            nonlocal held
            made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
            out.clear()
            held = 0
            return made

        for whole in batches:
            kinds = [whole.column(0).type, pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
            for lo in range(0, len(whole), 512):
                conv, role, text = (c.to_pylist() for c in whole.slice(lo, 512).columns)
                for c, r, t, ids in zip(conv, role, text, encode(text)):
                    if now is None or now.conv != c:
                        put(now.end() if now else None)
                        now = _Formatter(c, budget, history)
                    put(now.add(r, t, len(ids) + MARKS))
                    if held > 1 << 22:
                        yield flush()
        put(now.end() if now else None)
        if out:
            yield flush()

    return run


def format_windows(df: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", path: str | None = None, budget: int = 2048, history: int = 512) -> DataFrame:
    """One row per window: conv_id, window, text, n_repeated, n_tokens, over, loss.

    ``text`` is the formatted window, whose first ``n_repeated`` turns are the system turn and history; ``loss`` has
    the code-point spans of the assistant texts to train on. A window has ``budget`` tokens at most, of which history takes
    ``history`` at most; ``over`` marks a window whose single new turn is longer than what is left.

    The system turn is the conversation's first turn if its role is ``system``; one of over half the budget is not
    repeated. Null role and null text count as empty. Rows of a null conv_id form one conversation. Turns that tie are ordered
    by role and text, null turns come first, and repeated rows are turns each. An empty table gives an empty result. Other
    columns are not read. Rows of a conversation come in one partition, in order.
    """
    kind = df.schema[conv_col].dataType.simpleString()
    blank = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    rows = df.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), blank(role_col).alias("role"), blank(text_col).alias("text"))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    return rows.mapInArrow(_format(path, budget, history), WINDOW.format(kind=kind))


class _Read:
    def __init__(self, conv) -> None:
        self.conv, self.turns, self.loss_chars, self.chars = conv, 0, 0, 0
        self.all, self.loss = hashlib.sha256(), hashlib.sha256()

    def row(self) -> tuple:
        return self.conv, self.turns, self.all.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    now, out, kinds = None, [], None

    def flush() -> pa.RecordBatch:
        made = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        out.clear()
        return made

    for batch in batches:
        kinds = [batch.column(0).type, pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
        for conv, text, repeated, loss in zip(*(batch.column(i).to_pylist() for i in range(4))):
            if now is None or now.conv != conv:
                out += [now.row()] if now else []
                now = _Read(conv)
            for role, body in parse(text)[repeated:]:
                now.all.update(f"{role}\n{body}\n".encode("utf-8", "surrogatepass"))
                now.turns += 1
            for span in loss:
                body = unescape(text[span["start"] : span["end"]])
                now.loss.update(body.encode("utf-8", "surrogatepass"))
                now.loss_chars += len(body)
            now.chars += len(text)
        if out:
            yield flush()
    if now:
        out.append(now.row())
        yield flush()


def read_back(windows: DataFrame) -> DataFrame:
    """What windows say about their conversations: turns and texts under the loss mask, as counts and digests.

    ``windows`` is the result of ``format_windows``, whose partitions hold each conversation's windows in order; those of any
    other source are first dealt and sorted by the caller.
    """
    kind = windows.schema["conv_id"].dataType.simpleString()
    return windows.select("conv_id", "text", "n_repeated", "loss").mapInArrow(
        _read, f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


def masked(text: Column, loss: Column) -> Column:
    """The texts under a window's loss mask, still escaped."""
    return F.transform(loss, lambda x: F.substring(text, x["start"] + 1, x["end"] - x["start"]))

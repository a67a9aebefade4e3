"""Chat formatting in budgeted windows.

A conversation becomes windows of whole turns. Prefix sums of the turns' tokens choose the spans: a window holds the system
turn, as many earlier turns as fit in `history` tokens, and new turns up to `budget` tokens in all. The repeated turns are
context only: the loss mask covers the text of each assistant turn in the one window where it is new.

A turn is `<|im_start|>role newline text<|im_end|>newline`. In roles and texts a backslash is doubled and `<|` becomes `<\\|`, so a
control string can't come from a text; read_back() undoes it.

Defined results: null roles and texts count as empty; rows of a null conversation are one conversation, and ids of 64 bits
stay exact beside it; rows of a conversation are ordered by turn (null last), then role and
text, so repeated rows stay; a turn larger than the budget is a window of its own, beside the system turn; a conversation
of a system turn alone is one window; an empty table gives an empty one. A conversation is streamed turn by turn from a
sorted partition, never gathered.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ship, slices
from .packing import encoder

START, END = "<|im_start|>", "<|im_end|>"
_ESCAPED = re.compile(r"\\(.)", re.S)
_TURN = re.compile(re.escape(START) + r"(.*?)\n(.*?)" + re.escape(END) + "\n", re.S)
_TOKEN = re.compile(r"\w{1,4}|[^\w\s]")


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text) if "\\" in text else text


def escape_role(role: str) -> str:
    return escape(role).replace("\n", "\\n")


def count_tokens(text: str) -> int:
    """A tokenizer's count, roughly: pieces of words of four letters at most, and marks."""
    return len(_TOKEN.findall(text))


class Windows:
    """Takes the turns of one conversation in order and gives its windows."""

    def __init__(self, budget: int, history: int, count=count_tokens):
        self.budget, self.history, self.count = budget, history, count
        self.system: tuple | None = None
        self.past: list[tuple] = []  # turns that may be repeated, of `history` tokens at most
        self.new: list[tuple] = []
        self.sum, self.n, self.turns = 0, 0, 0

    def add(self, role: str, text: str) -> Iterator[tuple]:
        turn = (role, text, self.count(text) + 4)
        if self.new and self.sum + turn[2] > self.budget:
            yield self.close()
        if self.turns == 0 and role == "system":
            self.system = turn
        if not self.new:
            self.sum = sum(t[2] for t in self._context())
            while self.past and self.sum + turn[2] > self.budget:  # rather less history than a window too large
                self.sum -= self.past.pop(0)[2]
        self.new.append(turn)
        self.sum += turn[2]
        self.turns += 1

    def _context(self) -> list[tuple]:
        return ([self.system] if self.system and self.n else []) + self.past

    def close(self) -> tuple:
        context, out, spans, at = self._context(), [], [], 0
        for i, (role, text, _) in enumerate(context + self.new):
            head, body = f"{START}{escape_role(role)}\n", escape(text)
            if i >= len(context) and role == "assistant":
                spans.append((at + len(head), at + len(head) + len(body)))
            out.append(head + body + END + "\n")
            at += len(out[-1])
        row = (self.n, "".join(out), len(context), len(self.new), self.sum, spans)
        left, keep = self.history, []
        for t in reversed(self.past + self.new):
            if t is self.system or t[2] > left:
                break
            left -= t[2]
            keep.insert(0, t)
        self.past, self.new, self.sum, self.n = keep, [], 0, self.n + 1
        return row


FORMATTED = "window int, text string, repeated_turns int, new_turns int, tokens int, mask array<struct<start:int,end:int>>"
_WINDOW = [pa.int32(), pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))]
#: Characters of windows in a batch that a task gives.
_HELD = 4 << 20


def format_chats(turns: DataFrame, budget: int = 2048, history: int = 512, tokenizer: str | None = None) -> DataFrame:
    """conv_id, turn, role, text to windows: conv_id, window, text, repeated_turns, new_turns, tokens, mask (spans of code points).

    tokenizer: JSON file by which turns are counted; without it, count_tokens() does. A partition's windows come in order, each
    conversation's together. Identifiers stay in Arrow, exact beside nulls.
    """
    ship(turns.sparkSession)
    rows = turns.select("conv_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce("role", F.lit("")).alias("role"), "turn")
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text").drop("turn")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = (lambda text: len(encoder(tokenizer)(text))) if tokenizer else count_tokens
        at, state, out, held, kind = object(), None, [], 0, None
        for b in batches:
            kind = b.schema.field(0).type
            for part in slices(b, 1):
                for conv, text, role in zip(*(c.to_pylist() for c in part.columns)):
                    new = []
                    if conv != at or state is None:
                        if state is not None:
                            new.append((at, *state.close()))
                        at, state = conv, Windows(budget, history, count)
                    new += [(conv, *w) for w in state.add(role, text)]
                    out += new
                    held += sum(len(w[2]) for w in new)
                    if held > _HELD:
                        yield _batch(out, kind)
                        out, held = [], 0
        if state is not None:
            yield _batch([*out, (at, *state.close())], kind)

    return rows.mapInArrow(f, f"conv_id {turns.schema['conv_id'].dataType.simpleString()}, {FORMATTED}")


def _batch(rows: list[tuple], kind: pa.DataType) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [()] * 7
    columns[6] = [[{"start": a, "end": b} for a, b in spans] for spans in columns[6]]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [kind, *_WINDOW])], ["conv_id", "window", "text", "repeated_turns", "new_turns", "tokens", "mask"])


READ = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
_READ = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]


def read_back(formatted: DataFrame, in_order: bool = False) -> DataFrame:
    """Digests of each conversation, from its windows alone. in_order: they come straight from format_chats()."""
    if not in_order:
        formatted = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "window")
    rows = formatted.select("conv_id", "text", "window", "repeated_turns", "mask")

    def f(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, state, kind = None, None, None
        done = lambda: (at, state[0], state[1].hexdigest(), state[2], state[3].hexdigest(), state[4])
        names = ["conv_id", *(c.split()[0] for c in READ.split(", "))]
        batch = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [()] * 6, [kind, *_READ])], names)
        for b in batches:
            kind, out = b.schema.field(0).type, []
            for part in slices(b, 1):
                for conv, text, window, repeated, mask in zip(*(c.to_pylist() for c in part.columns)):
                    if window == 0:
                        if state is not None:
                            out.append(done())
                        at, state = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    for role, body in _TURN.findall(text)[repeated:]:
                        state[0] += 1
                        state[1].update(f"{unescape(role)}\n{unescape(body)}\n".encode())
                    for s in mask:
                        loss = unescape(text[s["start"] : s["end"]])
                        state[2] += len(loss)
                        state[3].update(loss.encode())
                    state[4] += len(text)
            yield batch(out)
        if state is not None:
            yield batch([done()])

    return rows.mapInArrow(f, f"conv_id {formatted.schema['conv_id'].dataType.simpleString()}, {READ}")

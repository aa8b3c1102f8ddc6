"""Chat transcripts as training windows of bounded length.

The running sum of turn tokens says how far a window reaches: windows end between turns, repeat the system turn and as much of
the latest history as its own budget allows, and train on each assistant text once, in the window where it is new.  A
conversation streams through one task turn by turn, so its length does not count for memory.
"""

from __future__ import annotations

import hashlib
import re
from collections import deque
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from jobweave.llm.common import SPACES, shipped, stored, table

BUDGET = 512
HISTORY_BUDGET = 128
#: Tokens that the marks of a turn count for.
MARK_TOKENS = 4
START, END = "<|im_start|>", "<|im_end|>"
TURN = re.compile(r"<\|im_start\|>([^\n]*)\n((?:(?!<\|).)*)<\|im_end\|>\n", re.DOTALL)
WORDS = re.compile(f"[^{SPACES}]+")


def escape(text: str) -> str:
    """A text without `<|`: a backslash goes between the two signs; where backslashes stand there, one more."""
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_role(role: str) -> str:
    """A role on one line; null roles count as empty."""
    return escape(role.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_role(role: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(role))


def turn_tokens(role: str, text: str) -> int:
    return MARK_TOKENS + len(WORDS.findall(text))


@dataclass
class Turn:
    role: str
    text: str
    tokens: int

    def shown(self) -> str:
        return f"{START}{escape_role(self.role)}\n{escape(self.text)}{END}\n"


@dataclass
class Window:
    """A window that is being filled: `context` is repeated, `fresh` is new."""

    context: list[Turn] = field(default_factory=list)
    fresh: list[Turn] = field(default_factory=list)
    total: int = 0

    def formatted(self) -> tuple[str, list[dict]]:
        parts, spans, at = [], [], 0
        for i, turn in enumerate([*self.context, *self.fresh]):
            shown = turn.shown()
            if turn.role == "assistant" and i >= len(self.context):
                head = len(START) + len(escape_role(turn.role)) + 1
                spans.append({"start": at + head, "length": len(escape(turn.text))})
            parts.append(shown)
            at += len(shown)
        return "".join(parts), spans


def cut(turns: Iterable[tuple[str, str]], budget: int = BUDGET, history_budget: int = HISTORY_BUDGET) -> Iterator[Window]:
    """Windows of one conversation.

    The first turn is kept as system turn if its role is `system`.  A window takes turns while the running sum of their
    tokens stays within `budget`, at least one; a longer turn stands whole in a window of its own.  The next window begins with
    the system turn and the longest run of last turns that fits into `history_budget` and leaves room for the next turn.
    """
    system, window, recent, held = None, None, deque(), 0
    for role, text in turns:
        turn = Turn(role, text, turn_tokens(role, text))
        if window is None:
            window = Window()
            system = turn if role == "system" else None
        elif window.total + turn.tokens > budget and window.fresh:
            yield window
            base = system.tokens if system else 0
            room = min(history_budget, budget - base - turn.tokens)
            while recent and held > room:
                held -= recent.popleft().tokens
            window = Window([*([system] if system else []), *recent], [], base + held)
        window.fresh.append(turn)
        window.total += turn.tokens
        if turn is not system:
            recent.append(turn)
            held += turn.tokens
            while recent and held > history_budget:
                held -= recent.popleft().tokens
    if window:
        yield window


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Role and text of every turn of a formatted window."""
    found, at = [], 0
    for match in TURN.finditer(formatted):
        if match.start() != at:
            break
        found.append((unescape_role(match[1]), unescape(match[2])))
        at = match.end()
    if at != len(formatted):
        raise ValueError("not a formatted window")
    return found


def by_conversation(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[tuple]]]:
    """Rows of one conversation after another, the first column being its id; never more than a batch is held."""
    rows = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns)))
    return groupby(rows, key=lambda row: row[0])


def windows(conversations: DataFrame, budget: int = BUDGET, history_budget: int = HISTORY_BUDGET) -> DataFrame:
    """Training windows: conv_id, window, n_context, n_new, formatted, loss (spans of code points, in order).

    Turns come in order of (turn, role, text); repeated rows are turns of their own, null texts and roles are empty, a null
    conv_id is a conversation like others.  An empty table gives no windows.
    """
    shipped(conversations.sparkSession)
    empty = F.lit("")
    rows = conversations.select("conv_id", "turn", F.coalesce("role", empty).alias("role"), F.coalesce("text", empty).alias("text"))
    rows = rows.repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "turn", "role", "text").drop("turn")
    names = ["conv_id", "window", "n_context", "n_new", "formatted", "loss"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, size = [], 0
        for conv, turns in by_conversation(batches):
            for i, window in enumerate(cut((t[1:] for t in turns), budget, history_budget)):
                formatted, loss = window.formatted()
                out.append((conv, i, len(window.context), len(window.fresh), formatted, loss))
                size += len(formatted)
                if size > 4_000_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    schema = "conv_id bigint, window bigint, n_context bigint, n_new bigint, formatted string, loss array<struct<start:bigint,length:bigint>>"
    return rows.mapInArrow(build, schema)


def read_back(made: DataFrame) -> DataFrame:
    """What windows say about each conversation: its turns and the text under the loss mask, as digests.

    Windows of a conversation are read in order; context turns were read before.  The digests are chains, so that a
    conversation is one sequence for one task, of which one window is held at a time.
    """
    shipped(made.sparkSession)
    rows = made.select("conv_id", "window", "n_context", "formatted", "loss").repartition(F.col("conv_id")).sortWithinPartitions("conv_id", "window")
    names = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = []
        for conv, own in by_conversation(batches):
            all_turns, all_loss, n, loss_chars, chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
            for _, _, n_context, formatted, loss in own:
                for role, text in read_turns(formatted)[n_context:]:
                    all_turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
                    n += 1
                for span in loss:
                    text = unescape(formatted[span["start"] : span["start"] + span["length"]])
                    all_loss.update(text.encode("utf-8", "surrogatepass"))
                    loss_chars += len(text)
                chars += len(formatted)
            out.append((conv, n, all_turns.hexdigest(), loss_chars, all_loss.hexdigest(), chars))
            if len(out) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    schema = "conv_id bigint, n_turns bigint, turns_sha256 string, loss_chars bigint, loss_sha256 string, formatted_chars bigint"
    return rows.mapInArrow(read, schema)


def query(spark: SparkSession, folder: str) -> DataFrame:
    """Digests of all conversations, and of one whose texts are control strings, read back from their windows."""
    tricky = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", tricky), (-1, 1, "assistant", tricky)], "conv_id bigint, turn bigint, role string, text string")
    all_rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionAll(extra)
    return read_back(stored(windows(all_rows), "windows"))

"""Conversations as training windows under a token budget.

Prefix sums of turn tokens decide which turns a window adds; a window repeats the system turn
and a limited stretch of history before them. A turn is added by one window only, repeated
turns are outside the loss mask, so each assistant text is learnt once.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stratalens.llm.common import rows_of

OPEN, ROLE_END, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
_CONTROL = re.compile(r"([<\[])(\\*)(/?s>|/?INST\])")
_ESCAPED = re.compile(r"([<\[])\\(\\*)(/?s>|/?INST\])")
_TURN = re.compile(r"<s>\[INST\] (.*?) \[/INST\](.*?)</s>", re.S)
#: Turn numbers that share a partial sum.
STRETCH = 256

WINDOW_SCHEMA = (
    "conv_id long, window long, formatted string, n_turns int, n_repeated int, "
    "loss array<struct<start:int,length:int>>, n_tokens long, over_budget boolean"
)
_WINDOWS = pa.schema([
    ("conv_id", pa.int64()), ("window", pa.int64()), ("formatted", pa.string()), ("n_turns", pa.int32()),
    ("n_repeated", pa.int32()), ("loss", pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))),
    ("n_tokens", pa.int64()), ("over_budget", pa.bool_()),
])


def escape(text: str) -> str:
    """Control strings get one backslash after their first character, those with backslashes there one more."""
    return _CONTROL.sub(r"\1\\\2\3", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"\1\2\3", text)


def parse(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted window."""
    return [(unescape(r), unescape(t)) for r, t in _TURN.findall(formatted)]


def about_tokens(text: Column) -> Column:
    """Four characters a token and five tokens for the marks of a turn."""
    return F.ceil(F.length(text) / 4) + 5


def chat_windows(
    turns: DataFrame, budget: int = 2048, history: int = 256, loss_role: str = "assistant",
    tokens: Callable[[Column], Column] = about_tokens,
) -> DataFrame:
    """One row per window: the formatted text, its repeated turns, the loss mask in code points.

    Turns are ordered by ``turn``, equal ones by role and text; nulls come first, a null
    role or text counts as empty, rows without ``conv_id`` are one conversation. Repeated rows
    are turns of their own. A window takes the turns whose tokens begin inside one step of
    half the free budget, so it keeps the budget unless a turn or the system turn is longer
    than that; such windows are whole and marked ``over_budget``. Texts are never cut. Before its first new turn a window repeats the
    turns that directly precede it, as many as have ``history`` tokens together; a turn that is longer ends the history. Where the system turn
    leaves little of the budget, steps have at least a quarter of its tokens, so the output stays within a multiple of the input.
    An empty table gives no windows; further columns are ignored.

    A long conversation is split: sums run over stretches of turns first, then inside
    each stretch, and its windows are rendered in different tasks.
    """
    rows = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    ).withColumns({"cost": tokens(F.col("text")).cast("long"), "stretch": F.floor(F.col("turn") / STRETCH)})

    sums = rows.groupBy("conv_id", "stretch").agg(F.sum("cost").alias("cost"), F.min(F.struct("turn", "role", "text")).alias("first"))
    along = Window.partitionBy("conv_id").orderBy(F.col("stretch").asc_nulls_first())
    sums = sums.select(
        "conv_id", "stretch", (F.sum("cost").over(along) - F.col("cost")).alias("before"),
        F.first("first").over(along).alias("first"),
    )
    system = F.when(F.col("first.role") == "system", F.col("first.text"))
    sums = sums.select("conv_id", "stretch", "before", system.alias("system_text"))

    inside = Window.partitionBy("conv_id", "stretch").orderBy(
        F.col("turn").asc_nulls_first(), "role", "text"
    ).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = rows.withColumn("up_to", F.sum("cost").over(inside)).alias("r").join(
        sums.alias("s"),
        F.col("r.conv_id").eqNullSafe(F.col("s.conv_id")) & F.col("r.stretch").eqNullSafe(F.col("s.stretch")),
    ).select(
        "r.conv_id", "role", "text", "cost", (F.col("before") + F.col("up_to") - F.col("cost")).alias("at"), "system_text"
    )
    reserved = F.when(F.col("system_text").isNotNull(), tokens(F.col("system_text"))).otherwise(0)
    # A system turn over the budget is repeated so rarely that all its copies cost no more than four times the turns.
    placed = placed.withColumn("step", F.greatest(F.floor((budget - history - reserved) / 2), F.floor(reserved / 4), F.lit(16)))
    placed = placed.withColumn("span", F.floor(F.col("at") / F.col("step")))
    # Turns that begin in the last tokens before the next step may be history there; which of them fit is known
    # where its first new turn is.
    reach = F.least(F.lit(history), F.col("step"))
    repeats = F.col("at") >= (F.col("span") + 1) * F.col("step") - reach
    repeats &= ~((F.col("at") == 0) & F.col("system_text").isNotNull())
    uses = F.when(repeats, F.array(F.struct(F.col("span").alias("window"), F.lit(True).alias("new")),
                                   F.struct((F.col("span") + 1).alias("window"), F.lit(False).alias("new"))))
    uses = uses.otherwise(F.array(F.struct(F.col("span").alias("window"), F.lit(True).alias("new"))))
    used = placed.withColumn("use", F.explode(uses)).select(
        "conv_id", F.col("use.window").alias("window"), F.col("use.new").alias("new"), "at", "role", "text", "cost",
        F.when(F.col("use.window") > 0, F.col("system_text")).alias("system_text"), reserved.cast("long").alias("system_cost"), reach.cast("long").alias("reach"),
    )
    dealt = used.repartition("conv_id", "window").sortWithinPartitions("conv_id", "window", "at")
    return dealt.mapInArrow(_rendered(budget, loss_role), WINDOW_SCHEMA)


def _rendered(budget: int, loss_role: str) -> Callable:
    def window(rows: list[tuple]) -> tuple | None:
        first = min((row[5] for row in rows if row[4]), default=None)
        if first is None:
            return None
        conv, number, system, system_cost = rows[0][:4]
        # The latest whole turns before the first new one whose tokens together keep the reach: all that begin within it.
        rows = [(row[4], *row[7:]) for row in rows if row[4] or row[5] >= first - row[6]]
        turns = [("system", system, False, system_cost)] if system is not None else []
        turns += [(role, text, new, cost) for new, role, text, cost in rows]
        out, loss, at = [], [], 0
        for role, text, new, _ in turns:
            head, body = OPEN + escape(role) + ROLE_END, escape(text)
            if new and role == loss_role:
                loss.append({"start": at + len(head), "length": len(body)})
            out.append(head + body + CLOSE)
            at += len(out[-1])
        total = sum(t[3] for t in turns)
        repeated = sum(not t[2] for t in turns)
        return conv, number, "".join(out), len(turns), repeated, loss, total, total > budget

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, done, size = [], [], 0
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "window", "system_text", "system_cost", "new", "at", "reach", "role", "text", "cost")]
            for row in zip(*columns):
                if held and held[0][:2] != row[:2]:
                    if made := window(held):
                        done.append(made)
                        size += len(made[2])
                    held = []
                    if size > 4_000_000:
                        yield from rows_of(_WINDOWS, list(zip(*done)))
                        done, size = [], 0
                held.append(row)
        if held and (made := window(held)):
            done.append(made)
        if done:
            yield from rows_of(_WINDOWS, list(zip(*done)))

    return run


DIGEST_SCHEMA = (
    "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_windows long"
)
_DIGESTS = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("n_windows", pa.int64()),
])


def conversation_digests(windows: DataFrame) -> DataFrame:
    """Per conversation, what its windows say once read back: turns, loss texts and their digests.

    A digest of a whole conversation is one running sum, so its windows pass through one task
    in order; the task holds one batch of windows and two hash states.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, key, state = [], None, None

        def close() -> None:
            turns, all_turns, chars, loss, formatted, count = state
            done.append((key[0], turns, all_turns.hexdigest(), chars, loss.hexdigest(), formatted, count))

        for batch in batches:
            names = ("conv_id", "formatted", "n_repeated", "loss")
            for conv, formatted, repeated, spans in zip(*(batch.column(c).to_pylist() for c in names)):
                if key is None or key[0] != conv:
                    if key is not None:
                        close()
                    key, state = (conv,), [0, hashlib.sha256(), 0, hashlib.sha256(), 0, 0]
                for role, text in parse(formatted)[repeated:]:
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for s in spans:
                    text = unescape(formatted[s["start"]:s["start"] + s["length"]])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(formatted)
                state[5] += 1
            if len(done) > 10_000:
                yield from rows_of(_DIGESTS, list(zip(*done)))
                done.clear()
        if key is not None:
            close()
        if done:
            yield from rows_of(_DIGESTS, list(zip(*done)))

    dealt = windows.select("conv_id", "window", "formatted", "n_repeated", "loss").repartition("conv_id")
    return dealt.sortWithinPartitions("conv_id", "window").mapInArrow(run, DIGEST_SCHEMA)

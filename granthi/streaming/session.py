"""Which case a conversation is about: a fold over its turns, in batch and as a stream.

State: the current case and the case last named in an answer. A user's turn may name a decision, point
back to one by a pronoun, or compare several; the answer that follows sets the case last named.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions import constants as K
from ..functions import query as Q
from ..functions.text import clean_text

OUT = "conv_id long, turn long, search_case string, current_case string, resolved_query string, comparison boolean"
STATE = "current string, last string"


def prepared(turns: DataFrame) -> DataFrame:
    """Turns with what the fold needs, by built-in functions: the cleaned text, numbers, the number named, the last one quoted."""
    text = clean_text(F.col("text"))
    return turns.select("conv_id", "turn", "role", text.alias("query"), Q.numbers(text).alias("numbers"), Q.decision_number(text).alias("named"), Q.last_decision(F.col("text")).alias("quoted"))


def step(current: str | None, last: str | None, row: dict) -> tuple[str | None, str | None, dict | None]:
    """The state after a turn, and what a user's turn resolves to; cases are decision numbers."""
    if row["role"] == "assistant":
        return current, row["quoted"], None
    if row["role"] != "user":
        return current, last, None
    query, low = row["query"], row["query"].lower()
    comparison = len(row["numbers"]) >= 2
    pointed = lambda case: row["named"] or (case if case and any(p in low for p in K.RELATIVE_PRONOUNS) else None)
    search = None if comparison else current
    if not comparison and pointed(current):
        current = search = pointed(current)
    resolved, new = query, current
    if query:
        if pointed(current):
            new = pointed(current)
        elif {*low.split()} & {*K.FOLLOWUP_PRONOUNS, *K.CASE_REFERENCES} and (current or last):
            new = current or last
            resolved = f"मुद्दा decision_{new} (निर्णय नं. {new}) को बारेमा: {query}"
    if new != current and not comparison:
        current = search = new
    if not current and last and not comparison:
        current = search = last
    as_id = lambda n: f"decision_{n}" if n else None
    return current, last, {"search_case": as_id(search), "current_case": as_id(current), "resolved_query": resolved, "comparison": comparison}


def _fold(key: int, rows: pd.DataFrame, current: str | None, last: str | None) -> tuple[pd.DataFrame, str | None, str | None]:
    out = []
    for row in rows.sort_values("turn", kind="stable").to_dict("records"):
        row["numbers"] = [] if row["numbers"] is None else list(row["numbers"])
        row = {k: None if isinstance(v, float) and v != v else v for k, v in row.items()}
        current, last, made = step(current, last, row)
        if made:
            out.append({"conv_id": key, "turn": row["turn"], **made})
    return pd.DataFrame(out, columns=[x.split()[0] for x in OUT.split(", ")]), current, last


def session_fold(turns: DataFrame) -> DataFrame:
    """One row for each user's turn: the case searched in, the current case, the query as resolved, whether it compares."""
    return prepared(turns).groupBy("conv_id").applyInPandas(lambda key, rows: _fold(key[0], rows, None, None)[0], OUT)


def session_stream(turns: DataFrame) -> DataFrame:
    """The same over a stream whose turns of a conversation arrive in order; the state stays between micro-batches."""

    def update(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        current, last = state.get if state.exists else (None, None)
        rows = pd.concat([*batches])
        out, current, last = _fold(key[0], rows, current, last)
        state.update((current, last))
        yield out

    return prepared(turns).groupBy("conv_id").applyInPandasWithState(update, OUT, STATE, "append", GroupStateTimeout.NoTimeout)


ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FIELDS = ("turn", "role", "query", "numbers", "named", "quoted")


class InOrder(StatefulProcessor):
    """Folds a conversation's turns by their numbers, in whatever order they come.

    A turn whose number is not the next one waits in a list. It goes on once the turns before it have come, or, so that a turn
    that never comes stops nothing, ``wait`` milliseconds after the first one began to wait: then all that wait go on in
    their order. A turn that comes after later ones have gone on is folded when it comes.
    """

    def __init__(self, wait: int, first: int):
        self.wait, self.first = wait, first

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("fold", "current string, last string, next long")
        self.early = handle.getListState("early", "row string")

    def _go(self, key: tuple, due: list[dict], early: list[dict], was: tuple) -> Iterator[pd.DataFrame]:
        current, last, upto = was
        if due:
            out, current, last = _fold(key[0], pd.DataFrame(due, columns=FIELDS), current, last)
            upto = max(upto, due[-1]["turn"] + 1)
        self.state.update((current, last, upto))
        if early:
            self.early.put([(json.dumps(r),) for r in early])
        elif self.early.exists():
            self.early.clear()
        if due and len(out):
            yield out

    def _was(self) -> tuple:
        return tuple(self.state.get()) if self.state.exists() else (None, None, self.first)

    def _waiting(self) -> list[dict]:
        return [json.loads(r[0]) for r in self.early.get()] if self.early.exists() else []

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        was, held = self._was(), self._waiting()
        for batch in rows:
            for r in batch[[*FIELDS]].to_dict("records"):
                r["numbers"] = [] if r["numbers"] is None else [*r["numbers"]]
                held.append({k: None if isinstance(v, float) and v != v else v for k, v in r.items()} | {"turn": int(r["turn"])})
        held.sort(key=lambda r: r["turn"])
        n, upto = 0, was[2]
        while n < len(held) and held[n]["turn"] <= upto:
            upto = max(upto, held[n]["turn"] + 1)
            n += 1
        timers = [*self.handle.listTimers()]
        if n < len(held) and not timers:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.wait)
        elif n == len(held):
            for t in timers:
                self.handle.deleteTimer(t)
        yield from self._go(key, held[:n], held[n:], was)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield from self._go(key, self._waiting(), [], self._was())

    def close(self) -> None:
        pass


def session_stream_any_order(turns: DataFrame, wait: int = 60_000, first: int = 0) -> DataFrame:
    """``session_stream`` over turns that may come in any order; conversations are numbered from ``first``.

    Once every turn has come the rows are those of ``session_fold``, as long as none came later than ``wait`` milliseconds after one
    that follows it. Rows without a turn are left out. The session's state store must be RocksDB's.
    """
    spark = turns.sparkSession
    if spark.conf.get("spark.sql.streaming.stateStore.providerClass") != ROCKSDB:
        raise ValueError(f"set spark.sql.streaming.stateStore.providerClass to {ROCKSDB}")
    rows = prepared(turns).where("turn is not null").groupBy("conv_id")
    return rows.transformWithStateInPandas(InOrder(wait, first), OUT, "append", "ProcessingTime")

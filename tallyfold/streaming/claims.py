"""The stage queue as streaming state: who may work on which meeting, at most one at a time.

Events (meeting_id, at, seq, kind, worker) ask for something; every event gets one answer. State is
kept by meeting: its status, the holder of its claim and when that runs out, attempts, and the last
event handled. A claim that isn't ended in time is released: by a timer once the watermark has
passed, or by the next event, whichever comes first. The batch form folds the same steps.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tallyfold.operators.ingest import FAILED, LADDER

#: How long a claim holds, in seconds.
LEASE = 3600
STATE = "status string, worker string, until long, attempts int, at long, seq long"
ANSWERS = "meeting_id {kind}, micros long, seq long, kind string, worker string, outcome string, status string, attempts int"


class State(NamedTuple):
    """A meeting's state; times in microseconds."""

    status: str | None = None
    worker: str | None = None
    until: int | None = None
    attempts: int = 0
    at: int | None = None
    seq: int | None = None


class Event(NamedTuple):
    at: int
    seq: int
    kind: str
    worker: str | None


class Answer(NamedTuple):
    at: int
    seq: int | None
    kind: str
    worker: str | None
    outcome: str
    status: str | None
    attempts: int


def released(state: State) -> tuple[State, Answer]:
    """The state without its claim, which ran out."""
    return state._replace(worker=None, until=None), Answer(state.until, None, "lease", state.worker, "expired", state.status, state.attempts)


def step(state: State, event: Event, lease: int) -> tuple[State, list[Answer]]:
    """The next state and the answers: one to the event, and one before it if a claim ran out meanwhile."""
    at, seq, kind, worker = event
    out: list[Answer] = []
    say = lambda s, outcome: (s, [*out, Answer(at, seq, kind, worker, outcome, s.status, s.attempts)])
    if state.at is not None and (at, seq) <= (state.at, state.seq):
        return say(state, "late")  # handled before, or overtaken
    if state.worker is not None and at >= state.until:
        state, gone = released(state)
        out.append(gone)
    state = state._replace(at=at, seq=seq)
    mine = worker is not None and state.worker == worker
    if kind == "discovered":
        return say(state, "known") if state.status else say(state._replace(status=LADDER[0]), "discovered")
    if kind == "claim":
        if worker is None or state.worker is not None or state.status not in LADDER[:-1]:
            return say(state, "refused")
        return say(state._replace(worker=worker, until=at + lease * 1_000_000, attempts=state.attempts + 1), "granted")
    if kind == "done" and mine:
        return say(state._replace(status=LADDER[LADDER.index(state.status) + 1], worker=None, until=None, attempts=0), "advanced")
    if kind == "failed" and mine:
        return say(state._replace(status=FAILED, worker=None, until=None), "failed")
    if kind == "retry" and state.status == FAILED:
        return say(state._replace(status=LADDER[0]), "requeued")
    return say(state, "ignored")


class Claims(StatefulProcessor):
    """step() over ValueState, with one event-time timer for a meeting's claim."""

    def __init__(self, lease: int):
        self.lease = lease

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("claim", STATE)

    def _read(self) -> State:
        return State(*self.state.get()) if self.state.exists() else State()

    def _write(self, before: State, after: State) -> None:
        self.state.update(tuple(after))
        if before.until != after.until:
            if before.until is not None:
                self.handle.deleteTimer(before.until // 1000)
            if after.until is not None:
                self.handle.registerTimer(after.until // 1000)

    @staticmethod
    def _frame(key: tuple, answers: list[Answer]) -> pd.DataFrame:
        df = pd.DataFrame([(key[0], *a) for a in answers], columns=["meeting_id", "micros", "seq", "kind", "worker", "outcome", "status", "attempts"])
        return df.astype({"seq": "Int64"})

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        before = state = self._read()
        answers: list[Answer] = []
        events = [Event(int(a), int(s), k, w if isinstance(w, str) else None) for df in rows for a, s, k, w in zip(df.micros, df.seq, df.kind, df.worker, strict=True)]
        for event in sorted(events, key=lambda e: e[:2]):
            state, said = step(state, event, self.lease)
            answers += said
        self._write(before, state)
        yield self._frame(key, answers)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        before = self._read()
        if before.until is None or before.until // 1000 != expiredTimerInfo.getExpiryTimeInMs():
            return  # an older claim's
        after, answer = released(before)
        self.state.update(tuple(after))
        yield self._frame(key, [answer])

    def close(self) -> None:
        pass


def _events(events: DataFrame) -> DataFrame:
    return events.select("meeting_id", "at", F.unix_micros("at").alias("micros"), F.col("seq").cast("long").alias("seq"), "kind", "worker")


def _timed(answers: DataFrame) -> DataFrame:
    return answers.select("meeting_id", F.timestamp_micros("micros").alias("at"), *answers.columns[2:])


def claims(events: DataFrame, lease: int = LEASE, late: str = "1 hour") -> DataFrame:
    """The answers to a stream of events. The query needs the RocksDB state store, see ROCKS."""
    kind = dict(events.dtypes)["meeting_id"]
    keyed = _events(events.withWatermark("at", late)).groupBy("meeting_id")
    return _timed(keyed.transformWithStateInPandas(Claims(lease), ANSWERS.format(kind=kind), "append", "eventtime"))


#: What the session must be set to for claims().
ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def claims_batch(events: DataFrame, lease: int = LEASE, upto: int | None = None) -> DataFrame:
    """The answers to a table of events; claims that run out before `upto` (microseconds) are released at the end.

    Events of one meeting are one sequence, so they meet in one task, sorted by Spark before it.
    """
    kind = dict(events.dtypes)["meeting_id"]

    def fold(key: tuple, frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        state = State()
        for df in frames:
            answers = []
            for a, s, k, w in zip(df.micros, df.seq, df.kind, df.worker, strict=True):
                state, said = step(state, Event(int(a), int(s), k, w if isinstance(w, str) else None), lease)
                answers += said
            yield Claims._frame(key, answers)
        if upto is not None and state.until is not None and state.until < upto:
            yield Claims._frame(key, [released(state)[1]])

    return _timed(_sorted_groups(_events(events), lambda key, frames: fold(key, frames), ANSWERS.format(kind=kind)))


def _sorted_groups(rows: DataFrame, work, schema: str) -> DataFrame:
    """work over each meeting's rows in order, in batches: a long sequence isn't held as a whole."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def pieces() -> Iterator[pd.DataFrame]:
            for df in frames:
                cuts = (df.meeting_id != df.meeting_id.shift()).cumsum()
                yield from (part for _, part in df.groupby(cuts, sort=False))

        held: list[pd.DataFrame] = []
        source = pieces()

        def of(first: pd.DataFrame) -> Iterator[pd.DataFrame]:
            yield first
            for part in source:
                if part.meeting_id.iloc[0] != first.meeting_id.iloc[0]:
                    held.append(part)
                    return
                yield part

        while True:
            first = held.pop() if held else next(source, None)
            if first is None:
                return
            yield from work((first.meeting_id.iloc[0],), of(first))

    placed = rows.where("meeting_id IS NOT NULL").repartition("meeting_id").sortWithinPartitions("meeting_id", "micros", "seq")
    return placed.mapInPandas(run, schema)

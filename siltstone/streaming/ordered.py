"""Replies and samplers on streams whose parts come out of order, with keyed state and timers.

A request's parts wait in its state, by their ordinal, until all before them are there, over any number of micro-batches; so any
order and any cutting of the stream into batches gives the same rows.  State ends by a timer some time after the last part came.
Needs the RocksDB state store: ``use_rocksdb(spark)``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from siltstone.streaming.replies import cut


def use_rocksdb(spark: SparkSession) -> None:
    """State by key needs this store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class InOrder(StatefulProcessor):
    """Hands the parts of a key to ``step`` one after the other by ordinal from 0; later ones wait.

    ``step(key, kept, part, last)`` takes what is kept of a key, None at first, and gives the rows for a part and what to keep.  Behind a
    part that it calls the end, or that is the last, nothing is handed on and nothing waits.  A part that comes twice counts once.
    """

    def __init__(self, kept: str, step: Callable[[str, tuple | None, tuple, bool], tuple[list[tuple], tuple, bool]], part: str, columns: list[str], forget_ms: int | None) -> None:
        self.kept, self.step, self.part, self.columns, self.forget_ms = kept, step, part, columns, forget_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, ended boolean")
        self.state = handle.getValueState("kept", self.kept)
        self.waiting = handle.getMapState("waiting", "ordinal long", f"{self.part}, last boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802
        at, ended = self.place.get() if self.place.exists() else (0, False)
        kept = tuple(self.state.get()) if self.state.exists() else None
        names = [c.split()[0] for c in self.part.split(", ")]
        if not ended:
            came = {}
            for frame in rows:
                for ordinal, last, *part in frame[["ordinal", "last", *names]].itertuples(index=False):
                    if ordinal >= at:
                        came.setdefault(int(ordinal), (*(None if pd.isna(x) else x for x in part), bool(last)))
            out: list[tuple] = []
            before = at
            while not ended:
                found = came.pop(at, None)
                if found is None and self.waiting.containsKey((at,)):
                    found = tuple(self.waiting.getValue((at,)))
                if found is None:
                    break
                if self.waiting.containsKey((at,)):
                    self.waiting.removeKey((at,))
                made, kept, done = self.step(key[0], kept, found[:-1], bool(found[-1]))
                out += made
                at, ended = at + 1, done or bool(found[-1])
            if ended:
                self.waiting.clear()
            else:
                for ordinal, part in came.items():
                    if not self.waiting.containsKey((ordinal,)):
                        self.waiting.updateValue((ordinal,), part)
            if at != before:
                self.state.update(kept)
            self.place.update((at, ended))
            if out:
                yield pd.DataFrame([(key[0], *r) for r in out], columns=["request", *self.columns])
        if self.forget_ms is not None:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.forget_ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802
        self.place.clear()
        self.state.clear()
        self.waiting.clear()
        yield from ()

    def close(self) -> None:
        pass


def _in_order(stream: DataFrame, kept: str, step, part: str, out: str, forget_ms: int | None) -> DataFrame:
    columns = [c.split()[0] for c in out.split(", ")]
    return stream.groupBy("request").transformWithStateInPandas(
        statefulProcessor=InOrder(kept, step, part, columns, forget_ms), outputStructType=f"request string, {out}", outputMode="Append", timeMode="None" if forget_ms is None else "ProcessingTime"
    )


def ordered_replies(parts: DataFrame, stops: tuple[str, ...], forget_ms: int | None = None) -> DataFrame:
    """(request, ordinal, text, done) from (request string, ordinal long, part string, last boolean): the text so far behind each part that makes it grow, up to a stop string."""

    def step(key: str, kept: tuple | None, part: tuple, last: bool) -> tuple[list[tuple], tuple, bool]:
        text, shown, n = kept or ("", "", 0)
        text += part[0] or ""
        now, stopped = cut(text, stops, last)
        done = last or stopped
        rows = [(n, now, done)] if now != shown or done else []
        return rows, ("" if done else text, "" if done else now, n + 1), done

    return _in_order(parts, "text string, shown string, n long", step, "part string", "ordinal long, text string, done boolean", forget_ms)


def smoothed_probabilities(draws: DataFrame, target: float, decay: float, forget_ms: int | None = None) -> DataFrame:
    """(request, ordinal, target) from (request string, ordinal long, probability double, last boolean): the target that the next token should be drawn
    near to, when a request's drawn probabilities are to have the mean ``target`` under weights that fall by ``decay``; within 0 and 1."""

    def step(key: str, kept: tuple | None, part: tuple, last: bool) -> tuple[list[tuple], tuple, bool]:
        total, weight, n = kept or (target / (1 - decay), 1 / (1 - decay), 0)
        total, weight = total * decay + (target if part[0] is None else part[0]), weight * decay + 1
        wanted = min(max(target * (weight * decay + 1) - total * decay, 0.0), 1.0)
        return [(n, wanted)], (total, weight, n + 1), last

    return _in_order(draws, "total double, weight double, n long", step, "probability double", "ordinal long, target double", forget_ms)

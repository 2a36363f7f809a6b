"""Replies while they're being written: text so far up to a stop string, and the speed since the last start."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame


def forgetting(forget_ms: int | None) -> str:
    """The timeout of state: none where nothing is forgotten, as in runs over what is there, which would wait for the time to pass."""
    return "NoTimeout" if forget_ms is None else "ProcessingTimeTimeout"


def cut(text: str, stops: tuple[str, ...], final: bool) -> tuple[str, bool]:
    """(text, whether a stop string ended it): up to the first stop string in the order given; unless ``final``, what may become one is held back."""
    for stop in stops:
        if stop in text:
            return text.partition(stop)[0], True
    held = max((k for s in stops for k in range(1, len(s)) if text.endswith(s[:k])), default=0)
    return (text if final or not held else text[: len(text) - held]), False


def reply_snapshots(parts: DataFrame, stops: tuple[str, ...], forget_ms: int | None = None) -> DataFrame:
    """(request, text, done) from a stream of (request string, ordinal long, part string, last boolean): the text so far whenever it has grown.

    A stop string, or the last part, ends a request.  Its state is its text, then a mark that it's done.  A stream that runs on
    should forget a request ``forget_ms`` after its last part.
    """

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        text, shown, done = state.get if state.exists else ("", "", False)
        new = pd.concat(list(frames)).sort_values("ordinal")
        if not done:
            text += "".join(new["part"].fillna(""))
            last = bool(new["last"].any())
            now, stopped = cut(text, stops, last)
            done = last or stopped
            if now != shown or done:
                shown = now
                yield pd.DataFrame({"request": [key[0]], "text": [now], "done": [done]})
        state.update(("" if done else text, "" if done else shown, done))
        if forget_ms:
            state.setTimeoutDuration(forget_ms)

    return parts.groupBy("request").applyInPandasWithState(step, "request string, text string, done boolean", "text string, shown string, done boolean", "append", forgetting(forget_ms))


def token_speed(counts: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """(request, seconds, tokens, speed) from a stream of (request string, at double, tokens long): tokens a second since the count last fell."""

    def step(key: tuple, frames: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        began, first, before = state.get if state.exists else (None, 0, -1)
        out: list[tuple] = []
        for at, tokens in pd.concat(list(frames)).sort_values("at")[["at", "tokens"]].itertuples(index=False):
            if began is None or tokens < before:
                began, first = float(at), int(tokens)
            seconds, made = float(at) - began, int(tokens) - first
            out.append((key[0], seconds, made, made / seconds if seconds > 0 else 0.0))
            before = int(tokens)
        state.update((began, first, before))
        if forget_ms:
            state.setTimeoutDuration(forget_ms)
        yield pd.DataFrame(out, columns=["request", "seconds", "tokens", "speed"])

    return counts.groupBy("request").applyInPandasWithState(step, "request string, seconds double, tokens long, speed double", "began double, first long, before long", "append", forgetting(forget_ms))

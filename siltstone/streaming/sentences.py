"""The first complete sentence of each reply while its parts arrive."""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import pandas as pd
from pyspark.sql import DataFrame

from siltstone.functions.sentences import spans
from siltstone.streaming.replies import forgetting


def _step(key: tuple, parts: Iterator[pd.DataFrame], state, forget_ms: int | None = None) -> Iterator[pd.DataFrame]:
    if state.hasTimedOut:
        state.remove()
        return
    if forget_ms:
        state.setTimeoutDuration(forget_ms)
    text, done = state.get if state.exists else ("", False)
    if done:
        return
    new = pd.concat(list(parts)).sort_values("ordinal")
    text, last = text + "".join(new["part"].fillna("")), bool(new["last"].any())
    found = next(spans(text, final=last), None)
    state.update(("" if found or last else text, bool(found or last)))
    if found:
        yield pd.DataFrame({"request": [key[0]], "sentence": [text[found[0] : found[1]]]})


def first_sentences(parts: DataFrame, forget_ms: int | None = None) -> DataFrame:
    """(request, sentence) from a stream of (request string, ordinal long, part string, last boolean).

    A full stop at the end of what has come may still go on, so a sentence comes out once white space or the last part
    has come.  The state of a request is its text so far, afterwards only a mark that it is done.  A stream that runs on should
    forget a request ``forget_ms`` after its last part.
    """
    step = partial(_step, forget_ms=forget_ms)
    return parts.groupBy("request").applyInPandasWithState(step, "request string, sentence string", "text string, done boolean", "append", forgetting(forget_ms))

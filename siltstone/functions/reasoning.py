"""Reasoning blocks at the head of replies, and channel tokens."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_type

from siltstone.functions.text import strip

#: Start, end and content marks of reasoning, in order; without a start mark it starts with the text.
FORMATS = (
    ("<think>", "</think>", ""), ("<|channel|>analysis<|message|>", "<|end|>", "<|channel|>final<|message|>"), ("<|channel|>commentary<|message|>", "<|end|>", "<|channel|>final<|message|>"),
    ("<seed:think>", "</seed:think>", ""), ("<|channel>thought", "<channel|>", ""), ("thought\n", "<channel|>", ""), ("<|think|>", "<|end|>", "<|content|>"), ("", "</think>", ""),
)
_FRAME = "<|start|>"
_FINAL = ("<|start|>assistant<|channel|>final<|message|>", "<|channel|>final<|message|>")
_CHANNELS = ("<|channel|>final<|message|>", "<|channel|>commentary<|message|>")


def _content(after: str, mark: str) -> str:
    """What follows the end of a block: behind the content mark, or all, unless only framing has come so far."""
    if not mark:
        return after
    _, marked, behind = after.partition(mark)
    if marked:
        return behind
    rest = after.lstrip()
    return "" if rest.startswith(_FRAME) or _FRAME.startswith(rest) else after


def split_block(text: str) -> tuple[str | None, str]:
    """(reasoning, content); no reasoning is None.  A text that may become a start mark has two empty parts."""
    bare = text.strip()
    for start, end, mark in FORMATS:
        if start and start not in text:
            if bare and start.startswith(bare):
                return "", ""
            continue
        rest = text.partition(start)[2] if start else text
        thought, closed, after = rest.partition(end)
        if closed:
            return thought, _content(after, mark).lstrip()
        if start:
            thought, _, after = rest.partition(mark) if mark else (rest, "", "")
            return thought, after.lstrip()
    for mark in _FINAL:
        before, found, after = text.partition(mark)
        if found:
            return before.strip() or None, after
    return None, text


_KIND = pa.struct([("reasoning", pa.string()), ("content", pa.string())])


@F.arrow_udf(from_arrow_type(_KIND))
def _split(column: pa.Array) -> pa.Array:
    return pa.array([None if t is None else dict(zip(("reasoning", "content"), split_block(t), strict=True)) for t in column.to_pylist()], _KIND)


def split_reasoning(text: Column) -> Column:
    """Struct of reasoning and content, by the first of FORMATS that fits; null stays null."""
    return _split(text)


def without_channels(text: Column) -> Column:
    """What a reply says in its final or commentary channel; without one, the text without white space at its ends."""
    out = strip(text)
    for mark in reversed(_CHANNELS):
        inner = F.substring_index(F.substring(text, F.instr(text, mark) + len(mark), F.length(text)), "<|end|>", 1)
        out = F.when(F.contains(text, F.lit(mark)), strip(inner)).otherwise(out)
    return out

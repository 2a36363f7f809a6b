"""Token counts and texts cut to a number of tokens, by any tokenizer that the caller gives."""

from __future__ import annotations

import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType

Count = Callable[[str], int]
_PIECE = re.compile(r"\w+|[^\w\s]")


def count_pieces(text: str) -> int:
    """Words and single other marks: the tokenizer where none is given."""
    return len(_PIECE.findall(text))


def file_tokenizer(path: str) -> Callable[[], object]:
    """Loads a tokenizer file once in each worker."""
    loaded: list = []

    def get():
        if not loaded:
            from tokenizers import Tokenizer

            loaded.append(Tokenizer.from_file(path))
        return loaded[0]

    return get


def encoded(text: Column, path: str) -> Column:
    """The ids of a text by a tokenizer file, without special tokens; null is empty."""
    model = file_tokenizer(path)

    @F.arrow_udf(ArrayType(LongType()))
    def run(column: pa.Array) -> pa.Array:
        return pa.array([model().encode(t or "", add_special_tokens=False).ids for t in column.to_pylist()], pa.list_(pa.int64()))

    return run(text)


def decoded(ids: Column, path: str) -> Column:
    model = file_tokenizer(path)

    @F.arrow_udf(StringType())
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if i is None else model().decode(i) for i in column.to_pylist()], pa.string())

    return run(ids)


def cut_to(text: str, budget: int, count: Count = count_pieces) -> str:
    """The longest beginning of a text with at most ``budget`` tokens, found by halving its length."""
    if count(text) <= budget:
        return text
    low, high = 0, len(text)
    while low + 1 < high:
        middle = (low + high) // 2
        low, high = (middle, high) if count(text[:middle]) <= budget else (low, middle)
    return text[:low]


def within_tokens(text: Column, budget: int, count: Count = count_pieces) -> Column:
    @F.arrow_udf(StringType())
    def run(column: pa.Array) -> pa.Array:
        return pa.array([None if t is None else cut_to(t, budget, count) for t in column.to_pylist()], pa.string())

    return run(text)


def within_words(text: Column, budget: int) -> Column:
    """The first ``budget`` runs between white space with what stands between them: without Python."""
    return F.regexp_extract(text, rf"^(?:\s*\S+){{0,{budget}}}", 0)

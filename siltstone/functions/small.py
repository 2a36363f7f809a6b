"""Small tools of a conversation: dates, dice, and hooks that change texts in turn."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def message_time(at: Column) -> Column:
    """As messages show it: Mar 05, 2024 07:09."""
    return F.date_format(at, "MMM dd, yyyy HH:mm")


def chat_id(at: Column) -> Column:
    return F.date_format(at, "yyyyMMdd-HH-mm-ss")


def time_sentence(at: Column) -> Column:
    """The sentences on time, weekday and date that go along with a context."""
    part = lambda pattern: F.date_format(at, pattern)
    return F.concat(F.lit("Current time is "), part("HH:mm:ss"), F.lit(". Today is "), part("EEEE"), F.lit(". The current date is "), part("yyyy-MM-dd"), F.lit("."))


def dice_total(rolls: Column, sides: int, most: int = 100) -> Column:
    """The sum of an array of numbers in [0, 1) as rolls of a die, ``most`` of them."""
    return F.aggregate(F.slice(rolls, 1, most), F.lit(0).cast("long"), lambda s, x: s + F.floor(x * max(sides, 1)).cast("long") + 1)


class Hooks:
    """Changes of texts by name, in the order they were added: chains, and overrides of which the first that gives anything wins."""

    def __init__(self) -> None:
        self.chains: dict[str, list[Callable[[Column], Column]]] = {}
        self.overrides: dict[str, list[Callable[..., Column]]] = {}

    def add(self, name: str, change: Callable[[Column], Column]) -> None:
        self.chains.setdefault(name, []).append(change)

    def override(self, name: str, make: Callable[..., Column]) -> None:
        self.overrides.setdefault(name, []).append(make)

    def apply(self, name: str, text: Column) -> Column:
        return reduce(lambda t, change: change(t), self.chains.get(name, []), text)

    def first(self, name: str, default: Column, *given: Column) -> Column:
        return F.coalesce(*(make(*given) for make in self.overrides.get(name, [])), default)

"""Grammar constraint: which tokens of a vocabulary may come next, as tables.

A grammar is compiled once, on the driver, to moves of a pushdown automaton over classes of characters; its size is that of the grammar.  A state
is a set of stacks of positions in rules.  Texts are read within the row by native expressions: by a table of numbered states where the grammar has few
(none of its rules nests in itself but at the end), else by stacks.  Tokens become words of character classes, so that a
large vocabulary leaves few different ones; the trie of these is walked level by level, states and trie nodes meeting by joins.

Alternatives that begin alike are followed side by side: where a rule nests in itself, let its alternatives differ in what they begin with (``items = item more``
instead of ``item`` or ``item, items``), as the stacks of a state double with each level otherwise.

Rules that start with themselves are an error.  A null text or token is in no state and in no mask.  An empty token is in the mask of every state that
has stacks.  Repeated tokens count as often as they are given.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property
from itertools import islice

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siltstone.sources.shared import Workspace

_STACKS = "array<array<int>>"
#: Numbered states fit into a long beside the number of the present one, for which the last number stands where there is none.
_MOST_STATES, _MOST_STACKS, _NONE = 57, 64, 63
#: Ranges of more code points are first replaced by one of their own.
_NARROW = 128


def _characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


@dataclass(frozen=True)
class Rule:
    """A reference to a rule."""

    name: str


@dataclass(frozen=True)
class Chars:
    """One character of any of the ranges, given as pairs: ``Chars("az", "09")``; with ``other``, any character outside of them."""

    ranges: tuple[str, ...]
    other: bool = False

    def spans(self) -> list[tuple[int, int]]:
        """Ranges of code points, ends exclusive."""
        own = sorted((min(map(ord, r)), max(map(ord, r)) + 1) for r in self.ranges)
        if not self.other:
            return own
        out, at = [], 0
        for lo, hi in own:
            if lo > at:
                out.append((at, lo))
            at = max(at, hi)
        return [*out, (at, 0x110000)] if at < 0x110000 else out


def chars(*ranges: str, other: bool = False) -> Chars:
    return Chars(ranges, other)


Symbol = str | Rule | Chars


@dataclass(frozen=True)
class Grammar:
    """``rules`` maps names to alternatives; an alternative is a sequence of literals, characters and references."""

    rules: dict[str, tuple[tuple[Symbol, ...], ...]]
    start: str = "root"

    @cached_property
    def _nodes(self) -> tuple[list[tuple[Chars | Rule, int]], dict[str, list[int]]]:
        """Positions as (symbol, next position or -1 at the end), and the first positions of each rule's alternatives (-1: an empty one)."""
        nodes: list[tuple[Chars | Rule, int]] = []
        firsts: dict[str, list[int]] = {}
        for name, alternatives in [("", ((Rule(self.start),),)), *self.rules.items()]:
            for sequence in alternatives:
                flat = [x for s in sequence for x in ([Chars((c,)) for c in s] if isinstance(s, str) else [s])]
                firsts.setdefault(name, []).append(len(nodes) if flat else -1)
                for i, symbol in enumerate(flat):
                    if isinstance(symbol, Rule) and symbol.name not in self.rules:
                        raise ValueError(f"no rule is named {symbol.name}")
                    nodes.append((symbol, len(nodes) + 1 if i + 1 < len(flat) else -1))
        return nodes, firsts

    @cached_property
    def _closures(self) -> tuple[list[set[tuple[Chars, tuple[int, ...]]]], list[bool]]:
        """For each position the (characters, stack put in its place) that may come next, and whether its rule may end without any."""
        nodes, firsts = self._nodes
        done: dict[int, tuple[set, bool]] = {-1: (set(), True)}
        going: set[int] = set()

        def close(at: int) -> tuple[set, bool]:
            if at in done:
                return done[at]
            if at in going:
                raise ValueError(f"the rule {nodes[at][0].name} starts with itself")
            going.add(at)
            symbol, after = nodes[at]
            rest = () if after < 0 else (after,)
            if isinstance(symbol, Chars):
                out = {(symbol, rest)}, False
            else:
                inner = [close(i) for i in firsts[symbol.name]]
                moves, empty = {(c, stack + rest) for m, _ in inner for c, stack in m}, any(e for _, e in inner)
                if empty:
                    later, empty = close(after)
                    moves |= later
                out = moves, empty
            going.discard(at)
            done[at] = out
            return out

        closed = [close(i) for i in range(len(nodes))]
        return [m for m, _ in closed], [e for _, e in closed]

    @cached_property
    def nullable(self) -> list[bool]:
        return self._closures[1]

    @cached_property
    def classes(self) -> tuple[list[int], list[int]]:
        """Borders between ranges of code points, and the class of each range: characters of a class are alike to all rules."""
        spans = [(i, j, lo, hi) for i, moves in enumerate(self._closures[0]) for j, (c, _) in enumerate(sorted(moves, key=repr)) for lo, hi in c.spans()]
        borders = sorted({0, *(x for *_, lo, hi in spans for x in (lo, hi))})
        numbers: dict[tuple, int] = {}
        kinds = [tuple(sorted({(i, j) for i, j, lo, hi in spans if lo <= b < hi})) for b in borders]
        return borders, [numbers.setdefault(k, len(numbers)) for k in kinds]

    @cached_property
    def moves(self) -> list[list[list[tuple[int, ...]]]]:
        """By position and class: the stacks that take the position's place."""
        borders, kinds = self.classes
        first = {k: borders[i] for i, k in reversed(list(enumerate(kinds)))}
        fits = lambda c, at: any(lo <= at < hi for lo, hi in c.spans())
        return [[sorted({stack for c, stack in m if fits(c, first[k])}) for k in range(len(first))] for m in self._closures[0]]

    @cached_property
    def automaton(self) -> tuple[list[tuple[tuple[int, ...], ...]], list[int]] | None:
        """All states that any text comes to, the beginning first, and the number of the next one by state and class, -1 where there is none; none if they are many."""
        moves, nullable = self.moves, self.nullable
        numbers: dict[tuple, int] = {((0,),): 0}
        states, table = list(numbers), []
        for stacks in states:  # grows on the way
            for kind in range(len(moves[0])):
                found = set()
                for s in stacks:
                    for i, node in enumerate(s):
                        found.update(new + s[i + 1 :] for new in moves[node][kind])
                        if not nullable[node]:
                            break
                after = tuple(sorted(found))
                if after and after not in numbers:
                    if len(states) == _MOST_STATES or len(after) > _MOST_STACKS:
                        return None
                    numbers[after] = len(states)
                    states.append(after)
                table.append(numbers.get(after, -1))
        return states, table

    def begin(self) -> Column:
        """The state before any text."""
        return F.array(F.array(F.lit(0))).cast(_STACKS)

    def code(self, text: Column) -> Column:
        """The text with each character replaced by that of its class, from ``!`` on."""
        borders, kinds = self.classes
        marks: dict[str, str] = {}
        for lo, hi, k in zip(borders, [*borders[1:], 0x110000], kinds):
            own = (chr(c) for c in range(lo, hi) if not 0xD800 <= c < 0xE000)
            if hi - lo > _NARROW:
                own = [c for c in islice(own, 3) if c not in "$\\"][:1]
                for c in own:
                    text = F.regexp_replace(text, rf"[\x{{{lo:x}}}-\x{{{hi - 1:x}}}]", c)
            marks |= dict.fromkeys(own, chr(33 + k))
        return F.translate(text, "".join(marks), "".join(marks.values()))

    def stepped(self, stacks: Column, mark: Column) -> Column:
        """The state after a character of the class ``mark`` stands for."""
        width = len(self.moves[0])
        table = F.array(*(F.array(*(F.array(*map(F.lit, s)) if s else F.array().cast("array<int>") for s in cell)).cast(_STACKS) for row in self.moves for cell in row))
        kind = F.ascii(mark) - 33
        none = F.array().cast(_STACKS)

        def of_place(stack: Column, node: Column, i: Column) -> Column:
            above = F.slice(stack, F.lit(1), i)
            below = F.slice(stack, i + 2, F.size(stack))
            return F.when(F.forall(above, self._may_end), F.transform(F.get(table, node * width + kind), lambda new: F.concat(new, below))).otherwise(none)

        return F.array_sort(F.array_distinct(F.flatten(F.transform(stacks, lambda s: F.flatten(F.transform(s, lambda n, i: of_place(s, n, i)))))))

    def _may_end(self, node: Column) -> Column:
        return F.get(F.array(*map(F.lit, self.nullable)), node)

    def may_end(self, stacks: Column) -> Column:
        """Whether the text may end in a state."""
        return F.exists(stacks, lambda s: F.forall(s, self._may_end))

    def read(self, code: Column, stacks: Column) -> Column:
        """The state after a code in a state."""
        return F.aggregate(_characters(code), stacks, lambda s, c: self.stepped(s, c))

    def after(self, text: Column) -> Column:
        """The state after a whole text; an empty array where the grammar doesn't allow it."""
        return self.read(self.code(text), self.begin())

    def met(self, text: Column) -> Column:
        """All states before, within and after a text, up to the character that the grammar doesn't allow."""
        return self._met_by_stacks(text) if self.automaton is None else self._met_by_number(text)

    def _met_by_number(self, text: Column) -> Column:
        """The fold's value has the present state in its lowest six bits and a bit for each state met above them."""
        states, table = self.automaton
        known = F.array(*(F.array(*(F.array(*map(F.lit, s)).cast("array<int>") for s in stacks)).cast(_STACKS) for stacks in states))
        width, bits = len(self.moves[0]), [1 << 6 + i for i in range(len(states))]
        longs = lambda values: F.array(*map(F.lit, values)).cast("array<bigint>")
        after = longs([i | bits[i] if i >= 0 else _NONE for i in table] + [_NONE] * (width * (_NONE + 1) - len(table)))

        def step(acc: Column, c: Column) -> Column:
            now = acc.bitwiseAND(F.lit(_NONE).cast("long")).cast("int")
            return acc.bitwiseAND(F.lit(~_NONE).cast("long")).bitwiseOR(F.get(after, now * width + F.ascii(c) - 33))

        one = F.array(F.aggregate(_characters(self.code(text)), F.lit(bits[0]).cast("long"), step))
        met = F.transform(one, lambda acc: F.filter(F.sequence(F.lit(0), F.lit(len(states) - 1)), lambda i: acc.bitwiseAND(F.get(longs(bits), i)) != 0))
        return F.when(text.isNotNull(), F.transform(F.get(met, F.lit(0)), lambda i: F.get(known, i)))

    def _met_by_stacks(self, text: Column) -> Column:
        start = F.struct(self.begin().alias("now"), F.array(self.begin()).alias("all"))

        def step(acc: Column, c: Column) -> Column:
            one = F.transform(F.array(self.stepped(acc["now"], c)), lambda now: F.struct(now.alias("now"), F.array_union(acc["all"], F.filter(F.array(now), lambda s: F.size(s) > 0)).alias("all")))
            return F.get(one, F.lit(0))

        return F.aggregate(_characters(self.code(text)), start, step, lambda acc: acc["all"])


def allowed_codes(ws: Workspace, grammar: Grammar, states: DataFrame, codes: DataFrame, stride: int = 8) -> DataFrame:
    """(state_id, code): which of ``codes(code)`` may follow each of ``states(state_id, stacks)``.

    A level of the trie is the distinct beginnings of a multiple of ``stride`` classes, its edges are the next ``stride`` classes; only beginnings that some
    state has come to are asked for their edges.
    """
    codes = ws.save(codes.where("code is not null").distinct(), "codes")
    front = ws.save(states.where(F.size("stacks") > 0).select("state_id", F.lit("").alias("node"), "stacks"), "front")
    longest = codes.agg(F.max(F.length("code"))).first()[0] or 0
    reached = front.select("state_id", "node")
    for depth in range(0, longest, stride):
        edges = codes.where(F.length("code") > depth).select(F.substring("code", 1, depth).alias("node"), F.substring("code", depth + 1, stride).alias("label")).distinct()
        grown = front.join(edges, "node").select("state_id", F.concat("node", "label").alias("node"), grammar.read(F.col("label"), F.col("stacks")).alias("stacks"))
        level = ws.save(grown.where(F.size("stacks") > 0), "front")
        if level.isEmpty():
            break
        reached = reached.unionByName(level.select("state_id", "node"))
        front = level.where(F.length("node") == depth + stride)
    return codes.join(reached, codes.code == reached.node).select("state_id", "code")


def mask(ws: Workspace, grammar: Grammar, states: DataFrame, tokens: DataFrame) -> DataFrame:
    """(state_id, token_id): the tokens of ``tokens(token_id, token)`` that may follow each of ``states(state_id, stacks)``."""
    coded = ws.save(tokens.where("token is not null").select("token_id", grammar.code(F.col("token")).alias("code")), "tokens")
    return coded.join(allowed_codes(ws, grammar, states, coded.select("code")), "code").select("state_id", "token_id")

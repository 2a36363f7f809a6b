"""Grammar masks against enumerated languages and against partial matches of a regular expression."""

import zlib
from collections import Counter
from pathlib import Path

import pyarrow.parquet as pq
import pytest
import regex
from pyspark.sql import functions as F

from siltstone.catalog import QUERIES
from siltstone.operators.grammar import Grammar, Rule, allowed_codes, chars, mask
from siltstone.sources.shared import Workspace

DATA = Path("/root/testdata/sf0.001")
NESTED = Grammar({"root": ((Rule("list"),),), "list": (("[", Rule("items"), "]"),), "items": ((), (Rule("item"), Rule("more"))), "more": ((), (",", Rule("item"), Rule("more"))), "item": ((Rule("list"),), (chars("09"),), ("é😀",))})
EMPTIES = Grammar({"root": ((Rule("a"), Rule("b"), Rule("c")),), "a": ((), ("x",)), "b": ((), ("y", Rule("b"), "z")), "c": ((Rule("a"), Rule("b")), ("w", chars("xz", other=True)))})


def language(grammar, longest, letters):
    """All beginnings, and all whole texts, of up to ``longest`` characters, by writing out sentential forms."""
    whole, begun, seen = set(), set(), set()
    todo = [("", (Rule(grammar.start),))]
    while todo:
        text, rest = todo.pop()
        if (text, rest) in seen:
            continue
        seen.add((text, rest))
        begun.add(text) if not rest or not isinstance(rest[0], Rule) else None
        if not rest:
            whole.add(text)
            continue
        head, tail = rest[0], rest[1:]
        if isinstance(head, Rule):
            # what must still be written bounds how far rules are replaced
            forms = [(*a, *tail) for a in grammar.rules[head.name]]
            todo += [(text, form) for form in forms if sum(len(s) if isinstance(s, str) else 1 for s in form) <= longest + 6]
        elif len(text) < longest:
            if isinstance(head, str):
                todo.append((text + head[0], (head[1:], *tail) if head[1:] else tail))
            else:
                todo += [(text + c, tail) for c in letters if any(lo <= ord(c) < hi for lo, hi in head.spans())]
    return begun | {t[:i] for t in begun for i in range(len(t))}, whole


@pytest.mark.parametrize(("grammar", "letters", "size"), [(NESTED, "[],5é😀", 5), (EMPTIES, "xyzwé", 5)])
def test_against_the_written_out_language(spark, grammar, letters, size):
    begun, whole = language(grammar, size, letters + "q")
    texts = {""}
    for _ in range(3):
        texts |= {t + c for t in texts for c in letters if len(t) < 3}
    texts = sorted(t for t in texts if len(t) <= 3)
    tokens = ["", *letters, *(a + b for a in letters for b in letters), "[[", "]]]", "q"]
    given = spark.createDataFrame([(t,) for t in texts], "text string")
    read = given.select("text", grammar.after(F.col("text")).alias("stacks"))
    read = read.select("text", "stacks", grammar.may_end(F.col("stacks")).alias("ends")).collect()
    for r in read:
        assert bool(r.stacks) == (r.text in begun or r.text in whole), r.text
        assert r.ends == (r.text in whole), r.text
    states = spark.createDataFrame([(r.text, r.stacks) for r in read], "state_id string, stacks array<array<int>>")
    words = spark.createDataFrame([(i, t) for i, t in enumerate(tokens) if len(t) <= 2] + [(90, None), (91, "q")], "token_id int, token string")
    got = {(r.state_id, tokens[r.token_id] if r.token_id < 90 else "q") for r in mask(Workspace(spark, "mask"), grammar, states, words).collect()}
    by_one = allowed_codes(Workspace(spark, "mask"), grammar, states, words.select(grammar.code(F.col("token")).alias("code")), stride=1)
    assert by_one.count() == allowed_codes(Workspace(spark, "mask"), grammar, states, words.select(grammar.code(F.col("token")).alias("code"))).count()
    assert got == {(t, w) for t in texts for w in tokens if len(w) <= 2 and (t + w in begun or t + w in whole) and (t in begun or t in whole)}


def test_odd_input(spark):
    loop = Grammar({"root": ((Rule("root"), "a"), ("b",))})
    with pytest.raises(ValueError, match="starts with itself"):
        loop.moves
    with pytest.raises(ValueError, match="no rule"):
        Grammar({"root": ((Rule("nothing"),),)}).moves
    none = spark.createDataFrame([], "state_id string, stacks array<array<int>>")
    words = spark.createDataFrame([(1, "["), (1, "["), (2, None)], "token_id int, token string")
    assert mask(Workspace(spark, "mask"), NESTED, none, words).count() == 0
    begin = spark.range(1).select(F.lit("s").alias("state_id"), NESTED.begin().alias("stacks"))
    assert [r.token_id for r in mask(Workspace(spark, "mask"), NESTED, begin, words).collect()] == [1, 1]
    assert mask(Workspace(spark, "mask"), NESTED, begin, words.where("token_id > 5")).count() == 0
    deep = spark.createDataFrame([("[" * 60 + "]" * 60,), ("[" * 60 + "]" * 61,), (None,)], "text string")
    ends = deep.select(NESTED.after(F.col("text")).alias("s")).select(F.size("s").alias("n"), NESTED.may_end(F.col("s")).alias("ends")).collect()
    assert [(r.n > 0, r.ends) for r in ends[:2]] == [(True, True), (False, False)] and ends[2].ends is None


def test_tokens_of_one_class_share_a_code(spark):
    words = spark.createDataFrame([(str(i),) for i in range(10)], "token string")
    assert words.select(NESTED.code(F.col("token")).alias("code")).distinct().count() == 1
    plan = allowed_codes(Workspace(spark, "codes"), NESTED, spark.range(1).select(F.lit("s").alias("state_id"), NESTED.begin().alias("stacks")), words.select(NESTED.code(F.col("token")).alias("code")))
    assert "Python" not in plan._jdf.queryExecution().executedPlan().toString()


def test_query_against_partial_matches(spark):
    got = QUERIES["grammar_masks"](spark, str(DATA)).collect()
    texts = [t for t in pq.read_table(DATA / "conversations.parquet")["text"].to_pylist() if t is not None]
    tokens = sorted({w for t in texts for w in regex.findall(r"[ \t\n\x0B\f\r]?[^ \t\n\x0B\f\r]+", t)})
    sentence = r"[A-ZÀ-Þ][A-Za-zÀ-ÿ]*(?:,? [A-Za-zÀ-ÿ]+)*[.!?]"
    shape = regex.compile(rf"{sentence}(?:[ \n]{sentence})*")
    fits = lambda t: shape.fullmatch(t, partial=True) is not None
    # what may follow depends on the end of a text alone: where the sentence, word or gap stands
    kinds = [("", ""), ("capital", "A"), ("letter", "Aa"), ("comma", "A,"), ("space", "A "), ("spaced", "A, "), ("end", "A."), ("gap", "A. ")]
    follow = {k: tuple(w for w in tokens if fits(t + w)) for k, t in kinds}
    counted = Counter()
    for text in texts:
        seen = {follow[""]}
        for i in range(1, len(text) + 1):
            if not fits(text[:i]):
                break
            a, b = text[i - 1], text[i - 2] if i > 1 else ""
            seen.add(follow["end" if a in ".!?" else "comma" if a == "," else "letter" if a not in " \n" else "gap" if b in ".!?" else "space"])
        counted.update(seen)
    want = {}
    for kept, n in counted.items():
        want[len(kept), sum(zlib.crc32(w.encode()) for w in kept)] = n
    ours = {}
    for r in got:
        ours.setdefault((r.tokens, r.sums), []).append(r.messages)
    assert set(ours) == set(want)
    assert all(max(n) <= want[k] <= sum(n) for k, n in ours.items())
    assert {r.ends for r in got} == {True, False}


def test_states_by_number(spark):
    plain = Grammar({"root": ((Rule("word"), Rule("more")),), "more": ((), (chars("!!", "é😀"), Rule("word"), Rule("more"))), "word": ((chars("az"), Rule("tail")), ("\0$",)), "tail": ((), (chars("az", "09"), Rule("tail")))})
    assert NESTED.automaton is None and 1 < len(plain.automaton[0]) <= 57
    texts = [a + b + c for a in ["", "a", "\0", "é", "😀", "$", "\0$", "!"] for b in ["", "b9", "9", "!\0$", "é\\", "\n"] for c in ["", "z", "😀a", "\U0010ffff"]]
    df = spark.createDataFrame([(t,) for t in [*texts, None]], "text string")
    text = F.col("text")
    assert df.where(~F.array_sort(plain.met(text)).eqNullSafe(F.array_sort(plain._met_by_stacks(text)))).count() == 0
    assert df.where(F.array_contains(plain.met(text), plain.after(text)) != (F.size(plain.after(text)) > 0)).count() == 0
    assert df.where("text is null").select(plain.met(text)).first()[0] is None
    # a text costs neither a walk over stacks nor a search of borders by character
    shown = df.select(plain.met(text))._jdf.queryExecution().analyzed().toString()
    assert "forall" not in shown and "translate" in shown
    # each range has the class of its borders
    borders, kinds = plain.classes
    odd = [b + d for b in borders for d in (-1, 0, 1) if 0 <= b + d]
    marks = spark.createDataFrame([(i, chr(i)) for i in odd], "i int, c string").select("i", plain.code(F.col("c"))).collect()
    assert all(m == chr(33 + kinds[sum(b <= i for b in borders) - 1]) for i, m in marks)


def test_rule_nested_deeply_goes_by_stacks(spark):
    df = spark.createDataFrame([("[[5],5]",), ("[" * 9,), ("]",), (None,)], "text string")
    got = [r[0] for r in df.select(F.size(NESTED.met(F.col("text")))).collect()]
    assert got[1] == 10 and got[2] == 1

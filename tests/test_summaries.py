"""Sentence ranks against a dense power iteration; summaries of odd texts."""

import math
import random
import re

import numpy as np

from siltstone.functions import sentences as S
from siltstone.operators import summaries as M
from siltstone.sources.shared import Workspace


def dense(sets, damping=0.85):
    n = len(sets)
    w = np.array([[len(a & b) / math.sqrt(len(a) * len(b)) if i != j and a and b else 0.0 for j, b in enumerate(sets)] for i, a in enumerate(sets)]).reshape(n, n)
    degree = w.sum(1)
    r = np.ones(n)
    for _ in range(400):
        r = 1 - damping + damping * w @ np.where(degree > 0, r / np.where(degree > 0, degree, 1), 0)
    return r


def texts():
    rng = random.Random(17)
    words = ["lake", "stone", "Wind", "boat", "reed", "heron", "mist", "oar", "pier", "dawn", "slow", "grey"]
    out = []
    for i in range(25):
        out.append((i, " ".join(" ".join(rng.choice(words[: rng.randint(3, 12)]) for _ in range(rng.randint(1, 9))) + "." for _ in range(rng.randint(0, 18)))))
    return [*out, (90, None), (91, ""), (92, "!. ?. " * 6), (93, "one. two. three. four. five. six."), (94, "same words. " * 9)]


def sets_of(text):
    return [set(re.findall(r"\w+", text[a:b].lower())) for a, b in S.spans(text or "")]


def test_ranks(spark):
    rows = [(i, s, w) for i, t in texts() for s, words in enumerate(sets_of(t)) for w in (words or [None])]
    got = {(r.doc, r.s): r.rank for r in M.sentence_ranks(Workspace(spark, "ranks"), spark.createDataFrame(rows, "doc long, s int, word string")).collect()}
    want = {(i, s): r for i, t in texts() for s, r in enumerate(dense(sets_of(t)))}
    assert got.keys() == want.keys() and max(abs(got[k] - want[k]) for k in want) < 1e-5


def test_summaries(spark):
    got = {r.doc: (r.n, r.sentences) for r in M.summaries(spark.createDataFrame(texts(), "doc long, text string")).collect()}
    for i, t in texts():
        spans = list(S.spans(t or ""))
        if t is None:
            assert i not in got
        elif len(spans) < 5:
            assert got[i] == (len(spans), [t])
        else:
            r = np.round(dense(sets_of(t)), 5)
            best = sorted(sorted(range(len(spans)), key=lambda s: (-r[s], s))[: math.ceil(0.2 * len(spans))])
            assert got[i] == (len(spans), [t[spans[s][0] : spans[s][1]] for s in best]), i
    assert M.summaries(spark.createDataFrame([], "doc long, text string")).count() == 0


def test_ranks_within_a_row(spark):
    plan = M.summaries(spark.createDataFrame(texts(), "doc long, text string"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan
    for _, t in texts():
        sets = sets_of(t)
        names = sorted(set().union(*sets))
        pairs = [(s, names.index(w)) for s, words in enumerate(sets) for w in sorted(words)]
        got = M.ranks_within(*(np.array([p[k] for p in pairs], int) for k in (0, 1)), len(sets))
        assert len(got) == len(sets) and np.abs(got - dense(sets)).max(initial=0) < 1e-5

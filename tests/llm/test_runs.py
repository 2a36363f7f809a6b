"""Operator 13 against a scan of every period, on small alphabets, odd texts and the given table through its query."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from siltstone.llm import runs

DATA = "/root/testdata/sf0.001"


def every_period(words, least=12):
    """(start, length, period) of all runs: stretches where words ``q`` apart are equal, without those of a smaller period."""
    n = len(words)
    ids = np.unique(np.array(words, dtype=object), return_inverse=True)[1] if n else np.zeros(0, int)
    found = []
    for q in range(1, n // 2 + 1):
        equal = np.r_[False, ids[:-q] == ids[q:], False].astype(int)
        for a, b in np.flatnonzero(np.diff(equal)).reshape(-1, 2):
            if b - a + q >= max(least, 2 * q):
                found.append((int(a), int(b - a + q), q))
    covered = lambda x, y: y[2] < x[2] and x[2] % y[2] == 0 and y[0] <= x[0] and x[0] + x[1] <= y[0] + y[1]
    return sorted(x for x in found if not any(covered(x, y) for y in found))


def expected(doc_id, text):
    w = (text or "").encode().split()
    n, h = len(w), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = every_period(w)
    gone = {i for s, length, q in found for i in range(s + q, s + length)}
    best = max(found, key=lambda r: (r[1], -r[0], -r[2])) if found else (None,) * 3
    lines = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(found), *best, 1000 * best[1] // best[2] if found else None, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("least", [2, 12])
def test_runs_of_small_alphabets(least):
    rng = random.Random(least)
    for _ in range(1500):
        w = [rng.choice("abcde"[: rng.choice([1, 2, 3, 5])]) for _ in range(rng.randint(0, 60))]
        if rng.random() < 0.5 and len(w) > 8:
            a, p = rng.randrange(len(w)), rng.randint(1, len(w) // 3)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        assert runs.runs_of(w, least) == every_period(w, least), w


def test_long_words_of_runs():
    """Words whose comparisons go far beyond the first few: powers, a Fibonacci word, Thue and Morse, equal halves that differ at the end."""
    fibonacci = ["a", "ab"]
    while len(fibonacci[-1]) < 1500:
        fibonacci.append(fibonacci[-1] + fibonacci[-2])
    thue = [bin(i).count("1") % 2 for i in range(1024)]
    base = [random.Random(1).randrange(50) for _ in range(400)]
    for w in (["x"] * 1000, ["x", "y"] * 500, list(fibonacci[-1]), thue, [*base, *base, 99], [99, *base, *base], [*base, 98, *base, 99]):
        assert runs.runs_of(w) == every_period(w)


def test_a_hash_that_lies_is_found_out(monkeypatch):
    """Where a run doesn't hold against the words, all are thrown away and the stretch is done again with another base."""
    monkeypatch.setattr(runs, "_holds", lambda ids, *run, real=runs._holds, seen=[]: (seen.append(run), len(seen) > 1 and real(ids, *run))[1])
    w = ["a", "b"] * 10
    assert runs.runs_of(w) == [(0, 20, 2)]


@pytest.mark.parametrize("bad", [{"min_length": 11}, {"window": 0}, {"window": 7}])
def test_windows_that_could_miss_runs(bad):
    with pytest.raises(ValueError, match="window"):
        runs.RunConfig(**bad)


def test_odd_tables(spark):
    rng = random.Random(5)
    line = " ".join(rng.choice(["sea", "Sea", "wind", "é", " x", "sky"]) for _ in range(7))
    texts = [None, "", " \t\n\r\x0b\x0c ", "one", "a " * 11, "a " * 12, "A a " * 8, "a b c d e f " * 2, "a b c d e f g a b c d e f", line + "\n" + line, f"{line} {line} {line} end", "x " * 5000 + "y " * 5000, " ".join(["p", "q"] * 9), "p q " * 9]
    rows = [(i, t, "n", 3) for i, t in enumerate(texts * 7)] + [(3, "again again " * 9, "n", 1), (3, "again again " * 9, "n", 1), (None, "b a " * 9, "n", 2), (None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, n int").repartition(3)
    made = runs.word_runs(runs.with_planted_runs(df))
    got = sorted(((r.doc_id, [tuple(x) for x in r.runs], r.collapsed) for r in made.collect()), key=str)
    want = []
    for doc_id, t, *_ in rows:
        w = (t or "").encode().split()
        if doc_id is not None and w and zlib.crc32(str(doc_id).encode()) % 10 == 0:
            g = zlib.crc32(str(doc_id).encode()) // 10
            a = g % len(w)
            p = 1 + (len(w) - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(len(w))]
        found = every_period(w)
        gone = {i for s, length, q in found for i in range(s + q, s + length)}
        want.append((doc_id, found, b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    assert got == sorted(want, key=str)
    assert runs.word_runs(df.where("false")).count() == 0


def test_query_on_the_given_table(spark):
    from siltstone.llm import entry

    docs = spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()
    got = sorted(tuple(r) for r in entry.QUERIES["op13_lyndon_runs"](spark, DATA).collect())
    assert got == sorted(expected(r.doc_id, r.text) for r in docs) and sum(r[1] > 0 for r in got) > 10


def test_one_very_long_text(spark):
    text = "tick tock " * 150_000 + "end"
    r = runs.word_runs(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()
    assert [tuple(x) for x in r.runs] == [(0, 300_000, 2)] and r.collapsed == "tick tock end"

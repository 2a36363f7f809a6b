"""Steps on logits against plain Python over the same rules."""

import math
import random

import pytest
from pyspark.sql import functions as F

from siltstone.functions import distributions as D


def softmax(x):
    top = max(v for v in x if v is not None)
    e = [0.0 if v is None else math.exp(v - top) for v in x]
    return [v / sum(e) for v in e]


def cases(seed, n=25, size=12):
    rng = random.Random(seed)
    return [[round(rng.gauss(0, 2), 3) if rng.random() < 0.9 or i == 0 else None for i in range(size)] for _ in range(n)]


def run(spark, rows, schema, column):
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r.y for r in sorted(df.select("i", column.alias("y")).collect())]


def close(a, b):
    return len(a) == len(b) and all((x is None) == (y is None) and (x is None or math.isclose(x, y, rel_tol=1e-9, abs_tol=1e-9)) for x, y in zip(a, b, strict=True))


def repeats_penalty(x, seq, m, base, allowed, breakers, longest=50):
    out, best = list(x), {}
    if seq and seq[-1] not in breakers:
        for i in range(len(seq) - 1):
            if seq[i] == seq[-1] and seq[i + 1] not in breakers:
                n = 1
                while n < longest and i - n >= 0 and seq[i - n] == seq[-1 - n] and seq[-1 - n] not in breakers:
                    n += 1
                best[seq[i + 1]] = max(n, best.get(seq[i + 1], 0))
    for t, n in best.items():
        if n >= allowed and out[t] is not None:
            out[t] -= m * base ** (n - allowed)
    return out


def test_repeats(spark):
    rng = random.Random(1)
    rows = [(x, [rng.randrange(4) for _ in range(rng.randint(0, 30))]) for x in cases(2, 60, 4)]
    for allowed, breakers, range_, longest in ((1, (), 0, 50), (2, (0,), 0, 50), (3, (3,), 12, 50), (1, (), 0, 3)):
        got = run(spark, rows, "x array<double>, t array<int>", D.dry_penalty(F.col("x"), F.col("t"), 0.7, 1.75, allowed, breakers, range_, longest))
        for (x, t), y in zip(rows, got, strict=True):
            assert close(y, repeats_penalty(x, t[-range_:] if range_ else t, 0.7, 1.75, allowed, breakers, longest))


def test_mirostat(spark):
    rng = random.Random(3)
    rows = [(cases(i, 8), [rng.random() for _ in range(8)]) for i in range(15)]
    got = run(spark, rows, "x array<array<double>>, u array<double>", D.mirostat(F.col("x"), F.col("u"), 1.2, 0.3))
    for (steps, draws), y in zip(rows, got, strict=True):
        mu, tokens = 2.4, []
        for x, u in zip(steps, draws, strict=True):
            p = softmax(x)
            order = sorted((i for i, v in enumerate(x) if v is not None), key=lambda i: (-x[i], i))
            head = [i for i in order if -math.log2(p[i]) <= mu] or order[:1]
            mass, s = sum(p[i] for i in head), 0.0
            for i in head:
                s += p[i]
                if s > u * mass:
                    break
            tokens.append(i)
            mu -= 0.3 * (-math.log2(p[i] / mass) - 1.2)
        assert y.tokens == tokens and math.isclose(y.mu, mu, rel_tol=1e-9)


def test_adaptive(spark):
    rng = random.Random(5)
    rows = [(cases(40 + i, 8), [rng.random() for _ in range(8)]) for i in range(15)]
    got = run(spark, rows, "x array<array<double>>, u array<double>", D.adaptive(F.col("x"), F.col("u"), 0.4, 0.9))
    for (steps, draws), y in zip(rows, got, strict=True):
        weighted, weight, tokens = 0.4 / (1 - 0.9), 1 / (1 - 0.9), []
        for x, u in zip(steps, draws, strict=True):
            p = softmax(x)
            aim = min(1.0, max(0.0, 0.8 - weighted / weight))
            bent = [None if v is None else abs(q - aim) / 0.3 for v, q in zip(x, p, strict=True)]
            new = softmax([None if d is None else 5 - 10 * d * d / (1 + d) for d in bent])
            s = 0.0
            for i, q in enumerate(new):  # noqa: B007
                s += q
                if s > u * sum(new):
                    break
            tokens.append(i)
            weighted, weight = p[i] + 0.9 * weighted, 1 + 0.9 * weight
        assert y.tokens == tokens and math.isclose(y.weighted, weighted, rel_tol=1e-9)


def test_masked_tokens_stay_masked(spark):
    rows = [(x,) for x in cases(9)]
    col = F.col("x")
    for step in (
        D.top_k(col, 3), D.top_p(col, 0.7), D.min_p(col, 0.2), D.top_a(col, 0.3), D.top_n_sigma(col, 1.0), D.tail_free(col, 0.8), D.typical(col, 0.5), D.epsilon_cutoff(col, 0.05), D.eta_cutoff(col, 0.1),
        D.exclude_top(col, 0.1), D.temperature(col, 0.5), D.quadratic_smoothing(col, 0.2, 1.5),
    ):
        for (x,), y in zip(rows, run(spark, rows, "x array<double>", step), strict=True):
            assert len(y) == len(x) and all(b is None for a, b in zip(x, y, strict=True) if a is None) and any(b is not None for b in y)


def test_order_and_errors(spark):
    steps = dict.fromkeys(("min_p", "top_k", "temperature", "unknown", "repetition_penalty"), lambda x: x)
    assert D.in_order(steps) == ["unknown", "repetition_penalty", "temperature", "top_k", "min_p"]
    assert D.in_order(steps, temperature_last=True)[-1] == "temperature"
    with pytest.raises(ValueError, match="above 0"):
        D.temperature(F.col("x"), 0)
    got = run(spark, [([0.5, 0.2],)], "x array<double>", D.exclude_top(F.col("x"), 0.1, draw=F.lit(0.9), probability=0.5))
    assert got == [[0.5, 0.2]]
    assert run(spark, [("a\tb\n",)], "x string", D.escaped(F.col("x"))) == ["a\\tb\\n"]
    assert run(spark, [(["ab", "c", "def"],)], "x array<string>", D.text_offsets(F.col("x"))) == [[0, 2, 3]]

"""Operator 4: document quality by a sparse rule ensemble.

Statistics of whole texts come from one vectorised pass.  On a bounded sample of labelled rows, small decision trees are grown;
every path from a root is a rule, a conjunction of comparisons of statistics.  Logistic regression under an L1 penalty
weighs the rules and drops most.  What is left is compiled into one Spark column expression over the statistics, so that
scoring stays in the engine's generated code.

Null and empty texts have all statistics 0 and get the score of those.  Without labels of both kinds the score is the
smoothed share of label 1.  Repeated rows get equal scores.  Rows with a null doc_id are scored as held out.  An empty table gives an
empty result.  A column to keep that is named like a statistic is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.labelled import fold, labelled_sample
from siltstone.llm.words import hash_words, text_blocks

STATISTICS = (
    "bytes", "words", "word_length", "letters", "capitals", "digits", "stops", "symbols", "bars", "exclaims", "lines", "high_bytes", "distinct_words", "repeats", "capital_words", "odd_words",
)


@dataclass(frozen=True)
class QualityConfig:
    """``sample`` bounds the labelled rows that are learned from, ``bag`` those that one tree is grown on."""

    sample: int = 20_000
    bag: int = 4_000
    trees: int = 24
    depth: int = 3
    cuts: int = 24
    least: int = 5
    penalty: float = 2e-3
    seed: int = 7


_CLASS = np.zeros(256, np.int64)
_CLASS[[*range(97, 123)]] = 1
_CLASS[[*range(65, 91)]] = 2
_CLASS[[*range(48, 58)]] = 3
_CLASS[[ord(c) for c in ".,;:?'\"()-"]] = 4
_CLASS[[ord(c) for c in "#*%$&@^~<>{}[]\\/=+_`"]] = 5
_CLASS[ord("|")] = 6
_CLASS[ord("!")] = 7
_CLASS[10] = 8
_CLASS[128:] = 9
_KINDS = 10


def statistics(column: pa.Array) -> Iterator[np.ndarray]:
    """One matrix of STATISTICS for each block of rows."""
    for at, end, data, bounds in text_blocks(column):
        n = end - at
        size = np.diff(bounds)
        owner = np.repeat(np.arange(n), size)
        kinds = np.bincount(owner * _KINDS + _CLASS[data], minlength=n * _KINDS).reshape(n, _KINDS).astype(float)
        words, starts, ends, first = hash_words(data, bounds)
        count = np.diff(first)
        word_owner = np.repeat(np.arange(n), count)
        again = np.zeros(len(words), bool)
        again[1:] = (words[1:] == words[:-1]) & (word_owner[1:] == word_owner[:-1])
        upper = np.concatenate([[0], np.cumsum(_CLASS[data] == 2)])
        odd = np.concatenate([[0], np.cumsum((_CLASS[data] >= 5) & (_CLASS[data] <= 7))])
        shout = (ends - starts >= 2) & (2 * (upper[ends] - upper[starts]) > ends - starts)
        noisy = odd[ends] - odd[starts] > 0
        distinct = np.zeros(n)
        for i in range(n):
            part = np.sort(words[first[i] : first[i + 1]])
            distinct[i] = 1 + np.count_nonzero(part[1:] != part[:-1]) if len(part) else 0
        b, w = np.maximum(size, 1), np.maximum(count, 1)
        per_word = lambda mask: np.bincount(word_owner[mask], minlength=n) / w  # noqa: E731, B023
        yield np.stack(
            [
                size, count, np.bincount(word_owner, ends - starts, minlength=n) / w, (kinds[:, 1] + kinds[:, 2] + kinds[:, 9]) / b, kinds[:, 2] / b, kinds[:, 3] / b, kinds[:, 4] / b,
                kinds[:, 5] / b, kinds[:, 6] / b, kinds[:, 7] / b, kinds[:, 8] / b, kinds[:, 9] / b, distinct / w, per_word(again), per_word(shout), per_word(noisy),
            ], 1,
        )


def statistics_batches(text_at: int):
    """A mapInArrow function that puts the statistics in place of the text column, which is last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.zeros((0, len(STATISTICS))), *statistics(batch.column(text_at))]
            values = np.concatenate(found)
            yield pa.RecordBatch.from_arrays([*batch.columns[:text_at], *(pa.array(np.ascontiguousarray(values[:, k])) for k in range(len(STATISTICS)))], names=[*batch.schema.names[:text_at], *STATISTICS])

    return run


def with_statistics(docs: DataFrame, keep: tuple[str, ...], text_col: str = "text") -> DataFrame:
    if {*STATISTICS, "_text"} & set(keep):
        raise ValueError("the columns to keep may not be named like a statistic")
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    kept = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in rows.schema.fields[:-1])
    return rows.mapInArrow(statistics_batches(len(keep)), kept + ", ".join(f"{s} double" for s in STATISTICS))


#: A condition is (statistic, greater, cut); a rule is a tuple of them.
Rule = tuple[tuple[int, bool, float], ...]


def grow_rules(x: np.ndarray, y: np.ndarray, cfg: QualityConfig) -> list[Rule]:
    """The distinct paths of bagged trees by Gini gain."""
    rng = np.random.default_rng(cfg.seed)
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, cfg.cuts + 2)[1:-1])) for k in range(x.shape[1])]
    rules: dict[Rule, None] = {}

    def split(rows: np.ndarray, path: Rule, features: np.ndarray) -> None:
        if path:
            rules[tuple(sorted(path))] = None
        n, ones = len(rows), y[rows].sum()
        if len(path) >= cfg.depth or n < 2 * cfg.least or ones in (0, n):
            return
        best, best_gain = None, 1e-9
        for k in features:
            values = x[rows, k]
            for cut in cuts[k]:
                right = values > cut
                m = int(right.sum())
                if m < cfg.least or n - m < cfg.least:
                    continue
                r = y[rows[right]].sum()
                gain = r * r / m + (m - r) ** 2 / m + (ones - r) ** 2 / (n - m) + (n - m - ones + r) ** 2 / (n - m) - ones * ones / n - (n - ones) ** 2 / n
                if gain > best_gain:
                    best, best_gain = (int(k), float(cut), right), gain
        if best:
            k, cut, right = best
            split(rows[right], (*path, (k, True, cut)), features)
            split(rows[~right], (*path, (k, False, cut)), features)

    for _ in range(cfg.trees):
        features = rng.choice(x.shape[1], max(2, x.shape[1] // 2), replace=False)
        split(rng.integers(0, len(y), min(len(y), cfg.bag)), (), features)
    return list(rules)


def apply_rules(x: np.ndarray, rules: list[Rule]) -> np.ndarray:
    out = np.ones((len(x), len(rules)))
    for j, rule in enumerate(rules):
        for k, greater, cut in rule:
            out[:, j] *= x[:, k] > cut if greater else x[:, k] <= cut
    return out


def lasso_logistic(r: np.ndarray, y: np.ndarray, penalty: float, steps: int = 400) -> tuple[np.ndarray, float]:
    """Proximal gradient with momentum; the intercept isn't penalised."""
    n = len(y)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    w, b, z, c, t = np.zeros(r.shape[1]), float(np.log(share / (1 - share))), np.zeros(r.shape[1]), 0.0, 1.0
    c = b
    rate = 1 / (0.25 * (np.linalg.norm(r, 2) ** 2 / n + 1))
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(r @ z + c, -30, 30))) - y
        step = z - rate * (r.T @ error / n)
        nw, nb = np.sign(step) * np.maximum(np.abs(step) - rate * penalty, 0), c - rate * error.mean()
        nt = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z, c = nw + (t - 1) / nt * (nw - w), nb + (t - 1) / nt * (nb - b)
        w, b, t = nw, nb, nt
    return w, b


@dataclass(frozen=True)
class RuleEnsemble:
    bias: float
    rules: tuple[Rule, ...] = ()
    weights: tuple[float, ...] = ()

    def score(self) -> Column:
        """The score as an expression over the columns STATISTICS."""
        total = F.lit(self.bias)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            holds = F.lit(True)
            for k, greater, cut in rule:
                holds = holds & (F.col(STATISTICS[k]) > cut if greater else F.col(STATISTICS[k]) <= cut)
            total = total + F.when(holds, F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def fit_quality(docs: DataFrame, labels: DataFrame, learn: Column, cfg: QualityConfig = QualityConfig()) -> RuleEnsemble:
    """Fits on at most ``cfg.sample`` labelled rows for which the column ``learn`` over ``labels`` holds."""
    rows = labelled_sample(docs, labels, "quality", learn, cfg.sample)
    table = with_statistics(rows, ("doc_id", "label")).toArrow().sort_by("doc_id")
    y = table["label"].to_numpy().astype(float)
    ones = y.sum() if len(y) else 0
    if not 0 < ones < len(y):
        share = (ones + 0.5) / (len(y) + 1)
        return RuleEnsemble(float(np.log(share / (1 - share))))
    x = np.stack([table[s].to_numpy() for s in STATISTICS], 1)
    rules = grow_rules(x, y, cfg)
    if not rules:
        return RuleEnsemble(float(np.log((ones + 0.5) / (len(y) - ones + 0.5))))
    w, b = lasso_logistic(apply_rules(x, rules), y, cfg.penalty)
    kept = np.flatnonzero(np.abs(w) > 1e-6)
    return RuleEnsemble(float(b), tuple(rules[i] for i in kept), tuple(float(w[i]) for i in kept))


def op4_rule_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: learns from labels whose fold isn't 1 of 3, scores all documents."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_quality(docs, labels, fold("doc_id", 3) != 1)
    scored = with_statistics(docs, ("doc_id",)).select("doc_id", F.coalesce(fold("doc_id", 3) == 1, F.lit(True)).alias("held_out"), model.score().alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.5, 1).otherwise(0))

"""Operator 9: toxicity by weak supervision.

Voters are lexicon words and word beginnings (patterns of 4, 5 and 6 bytes, which catch inflected and compound forms),
found in a bounded sample of labelled rows.  Together with voters on how many of them agree they fill a vote matrix with
for, against and abstained.  A generative label model estimates by expectation maximisation how accurate each voter is,
and from the residuals how voters correlate, so that voters that say the same count once.  Its posteriors, not the
labels, train a linear classifier over the voters, which scores whole texts in one pass without a shuffle.

Without labelled toxic rows, or without clean ones, there are no voters and every score is the (smoothed) share of toxic labels.
Null and empty texts are scored like texts without any voter's words.  Repeated rows get equal scores.  Rows with a null doc_id are
scored as held out.  An empty table gives an empty result.  A column ``score`` among those to keep is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm.labelled import fold, labelled_sample
from siltstone.llm.storage import Workspace
from siltstone.llm.streams import trimmed
from siltstone.llm.words import hash_ranges, lower_hash_table, mix64, text_blocks


@dataclass(frozen=True)
class ToxicityConfig:
    """``sample`` bounds the labelled rows that are learned from, and by that what the driver holds of them.

    A voter needs ``min_documents`` toxic documents (fewer if there are very few) and that share of toxic ones.  A voter is chosen for as many
    documents that count still, and a document counts ``cover`` times, so there are at most ``cover * sample / min_documents`` voters: 26,666
    (72 voters of 788 candidates on 20,000 rows of generated documents).  Votes are kept as pairs, correlations are summed in blocks of 256 columns
    and 1024 rows: about 10 KB for each voter and 16 bytes for each pair (44 MB for 6,000 voters; at 26,000, 268 MB and some 3 minutes).
    """

    sample: int = 20_000
    prefixes: tuple[int, ...] = (4, 5, 6)
    min_documents: int = 3
    precision: float = 0.95
    cover: int = 4
    rounds: int = 30
    agree: tuple[int, ...] = (1, 2, 3)

    def least(self, toxic: int) -> int:
        return min(self.min_documents, max(1, toxic // 4))


_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), 39, *range(128, 256)]] = True


def word_features(data: np.ndarray, bounds: np.ndarray, prefixes: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of lower-cased letter runs and of their beginnings, with the row of each.  One array after the other."""
    inside = np.zeros(len(data) + 1, bool)
    inside[:-1] = _LETTER[data]
    first = inside[:-1].copy()
    first[1:] &= ~inside[:-2]
    edges = bounds[:-1][bounds[:-1] < len(data)]
    first[edges] = inside[edges]
    last = inside[:-1].copy()
    last[:-1] &= ~inside[1:-1] | first[1:]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    owner = np.searchsorted(bounds, starts, "right") - 1
    hashes, owners = [], []
    table = lower_hash_table()
    for n in (0, *prefixes):
        long = ends - starts > n if n else np.ones(len(starts), bool)
        hashes.append(mix64(hash_ranges(data, starts[long], starts[long] + n if n else ends, table) + np.uint64(n)))
        owners.append(owner[long])
    return np.concatenate(hashes), np.concatenate(owners)


def _distinct_features(column: pa.Array, prefixes: tuple[int, ...]) -> Iterator[np.ndarray]:
    for at, end, data, bounds in text_blocks(column):
        h, owner = word_features(data, bounds, prefixes)
        order = np.argsort(owner, kind="stable")
        cut = np.searchsorted(owner[order], np.arange(end - at + 1))
        for i, j in zip(cut[:-1], cut[1:], strict=True):
            yield np.unique(h[order[i:j]])


def sample_batches(cfg: ToxicityConfig):
    """A mapInArrow function: (label, text) to (label, features)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [x.tobytes() for x in _distinct_features(batch.column(1), cfg.prefixes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["label", "features"])

    return run


def count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A mapInArrow function: (label, features) to (h, t, c), documents with a feature by label, summed over a batch."""
    for batch in batches:
        label = batch.column(0).to_numpy()
        for at in range(0, batch.num_rows, 512):
            sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in batch.column(1)[at : at + 512]]
            h, number = np.unique(np.concatenate(sets), return_inverse=True)
            toxic = np.bincount(number, np.repeat(label[at : at + 512], [len(x) for x in sets]), minlength=len(h)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(toxic), pa.array(np.bincount(number, minlength=len(h)) - toxic)], names=["h", "t", "c"])


def keep_batches(keys: np.ndarray):
    """A mapInArrow function over (label, features) that leaves the features among the sorted ``keys``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.intersect1d(np.frombuffer(x.as_buffer(), np.uint64), keys, assume_unique=True).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sets, pa.binary())], names=["label", "features"])

    return run


@dataclass(frozen=True)
class ToxicityModel:
    prior: float
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    agree_weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0


def choose_voters(sets: list[np.ndarray], labels: np.ndarray, cfg: ToxicityConfig) -> np.ndarray:
    """Features that nearly only toxic documents have, as sorted hashes.

    Greedy cover: the feature that the most toxic documents have comes next, and a document counts no more once ``cover``
    voters speak for it, so that the rare words of a much-copied document stay out.
    """
    toxic, clean = int(labels.sum()), int(len(labels) - labels.sum())
    if not toxic or not clean:
        return np.zeros(0, np.uint64)
    keys, number = np.unique(np.concatenate(sets), return_inverse=True)
    row = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    of_toxic = labels[row] == 1
    t, c = np.bincount(number[of_toxic], minlength=len(keys)), np.bincount(number[~of_toxic], minlength=len(keys))
    least = cfg.least(toxic)
    good = (t >= least) & (t >= cfg.precision * (t + c))
    known = of_toxic & good[number]
    number, row = number[known], row[known]
    order = np.argsort(number, kind="stable")
    number, row = number[order], row[order]
    left, open_, chosen = t * good, np.full(len(sets), cfg.cover), []
    by_row = np.argsort(row, kind="stable")
    row_at = np.searchsorted(row[by_row], np.arange(len(sets) + 1))
    while len(left):
        best = int(np.argmax(left))
        if left[best] < least:
            break
        chosen.append(best)
        left[best] = 0
        i, j = np.searchsorted(number, [best, best + 1])
        hit = row[i:j]
        open_[hit] -= 1
        for r in hit[open_[hit] == 0]:
            left[number[by_row[row_at[r] : row_at[r + 1]]]] -= 1
    return np.sort(keys[chosen])


@dataclass(frozen=True)
class Present:
    """Which lexicon voters stand in which rows, as pairs in order of row, and how many in each row."""

    row: np.ndarray
    voter: np.ndarray
    rows: int
    voters: int

    @classmethod
    def of(cls, sets: list[np.ndarray], keys: np.ndarray) -> Present:
        """``sets`` are sorted distinct features; those that aren't among the sorted ``keys`` are passed over."""
        found = [np.flatnonzero(np.isin(keys, s, assume_unique=True)) for s in sets]
        row = np.repeat(np.arange(len(sets)), [len(f) for f in found])
        return cls(row, np.concatenate([np.zeros(0, np.int64), *found]), len(sets), len(keys))

    @property
    def count(self) -> np.ndarray:
        return np.bincount(self.row, minlength=self.rows)

    def by_row(self, weights: np.ndarray) -> np.ndarray:
        """For each row the sum of its voters' weights."""
        return np.bincount(self.row, weights[self.voter], self.rows)

    def by_voter(self, values: np.ndarray) -> np.ndarray:
        """For each voter the sum of its rows' values."""
        return np.bincount(self.voter, values[self.row], self.voters)

    def dense(self, extra: np.ndarray, first: int, last: int) -> np.ndarray:
        """Rows ``first`` to ``last`` as a matrix, with the columns of ``extra`` behind the voters."""
        out = np.zeros((last - first, self.voters + extra.shape[1]), np.float32)
        i, j = np.searchsorted(self.row, [first, last])
        out[self.row[i:j] - first, self.voter[i:j]] = 1
        out[:, self.voters :] = extra[first:last]
        return out


def agreement_votes(count: np.ndarray, agree: tuple[int, ...]) -> np.ndarray:
    """A voter on agreement says 1 from ``agree`` lexicon voters on, -1 if there is none at all, else it abstains."""
    return np.stack([np.where(count >= n, 1, np.where(count == 0, -1, 0)) for n in agree], 1).astype(np.int8)


def evidence_shares(x: Present, extra: np.ndarray, posterior: np.ndarray, mean: np.ndarray, columns: int = 256, rows: int = 1024) -> np.ndarray:
    """1 / (1 + the sum of a voter's absolute residual correlations with the others), where those of 0.1 and more count.

    The residual of a vote is what its expectation given the class leaves.  Products of residuals follow from products of votes, which are summed
    over blocks of rows for a block of columns at a time.
    """
    share = np.stack([1 - posterior, posterior], 1)
    d = x.voters + extra.shape[1]
    with_class = np.concatenate([np.stack([x.by_voter(share[:, k]) for k in (0, 1)], 1), extra.T.astype(float) @ share])
    class_class = share.T @ share
    own = np.concatenate([np.bincount(x.voter, minlength=x.voters), (extra.astype(float) ** 2).sum(0)])
    variance = own - 2 * (with_class * mean.T).sum(1) + ((class_class @ mean) * mean).sum(0)
    scale = np.sqrt(np.maximum(variance, 0) / x.rows) + 1e-9
    out = np.zeros(d)
    for at in range(0, d, columns):
        block = slice(at, min(at + columns, d))
        both = np.zeros((d, block.stop - at))
        for first in range(0, x.rows, rows):
            part = x.dense(extra, first, min(first + rows, x.rows))
            both += part.T @ part[:, block]
            del part
        both -= with_class @ mean[:, block]
        both += mean.T @ (class_class @ mean[:, block] - with_class[block].T)
        both /= x.rows * scale[:, None] * scale[None, block]
        np.abs(both, out=both)
        both[both < 0.1] = 0
        out[block] = 1 / np.maximum(both.sum(0), 1)
    return out


def label_model(x: Present, extra: np.ndarray, start: np.ndarray, rounds: int) -> np.ndarray:
    """Posterior of toxicity for each row from votes alone; ``start`` gives first posteriors.

    Expectation maximisation of class-conditional vote frequencies.  A lexicon voter says 1 or abstains, so that its evidence is that of absence
    for all rows and a difference for the rows it stands in; ``extra`` are columns of -1, 0 and 1.  After the first rounds each voter's evidence is
    divided by 1 + the sum of its absolute residual correlations with the others, given the class.
    """
    posterior, share = start.astype(float), np.ones(x.voters + extra.shape[1])
    stands = np.bincount(x.voter, minlength=x.voters)
    for step in range(rounds):
        total = np.array([(1 - posterior).sum(), posterior.sum()])
        prior = np.clip((total[1] + 1) / (total.sum() + 2), 1e-3, 1 - 1e-3)
        rate = lambda seen, k: (seen + 0.5) / (total[k] + 1.5)
        in_toxic = x.by_voter(posterior)
        in_clean = stands - in_toxic
        lexicon = share[: x.voters]
        absent = lexicon * np.log(rate(total[1] - in_toxic, 1) / rate(total[0] - in_clean, 0))
        evidence = absent.sum() + x.by_row(lexicon * np.log(rate(in_toxic, 1) / rate(in_clean, 0)) - absent)
        of_extra = np.zeros((2, extra.shape[1]))
        for v in (-1, 0, 1):
            is_v = (extra == v).astype(float)
            p1, p0 = rate(posterior @ is_v, 1), rate((1 - posterior) @ is_v, 0)
            evidence += is_v @ (share[x.voters :] * np.log(p1 / p0))
            of_extra += v * np.stack([p0, p1])
        if step == min(3, rounds - 1):
            # no row has the vote -1 of a lexicon voter, whose smoothed frequency counts in the mean all the same
            of_lexicon = np.stack([rate(in_clean, 0) - rate(0, 0), rate(in_toxic, 1) - rate(0, 1)])
            share = evidence_shares(x, extra, posterior, np.concatenate([of_lexicon, of_extra], 1))
        new = 1 / (1 + np.exp(-np.clip(np.log(prior / (1 - prior)) + evidence, -30, 30)))
        if np.abs(new - posterior).max() < 1e-6 and step > 4:
            return new
        posterior = new
    return posterior


def fit_linear(x: Present, extra: np.ndarray, target: np.ndarray, penalty: float = 1e-5, steps: int = 500) -> tuple[np.ndarray, float]:
    """Logistic regression on soft targets by accelerated gradient steps; ``extra`` are columns of 0 and 1 behind those of the voters."""
    n, d = x.rows, x.voters + extra.shape[1]
    extra = extra.astype(float)
    times = lambda z: x.by_row(z[: x.voters]) + extra @ z[x.voters :]
    back = lambda e: np.concatenate([x.by_voter(e), extra.T @ e])
    v, norm = np.ones(d), 0.0
    for _ in range(100):
        v = back(times(v))
        norm = float(np.linalg.norm(v))
        if not norm:
            break
        v /= norm
    w, b = np.zeros(d), float(np.log((target.mean() + 1e-3) / (1 - target.mean() + 1e-3)))
    z, c, momentum = w.copy(), b, 1.0
    rate = 1 / (0.25 * (1.02 * norm / n + 1) + penalty)
    for _ in range(steps):
        error = 1 / (1 + np.exp(-np.clip(times(z) + c, -30, 30))) - target
        nw, nb = z - rate * (back(error) / n + penalty * z), c - rate * error.mean()
        nm = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        z, c = nw + (momentum - 1) / nm * (nw - w), nb + (momentum - 1) / nm * (nb - b)
        w, b, momentum = nw, nb, nm
    return w, b


def fit_toxicity(docs: DataFrame, labels: DataFrame, learn, cfg: ToxicityConfig = ToxicityConfig()) -> ToxicityModel:
    """Fits on at most ``cfg.sample`` labelled rows for which the column ``learn`` over ``labels`` holds."""
    ws = Workspace(docs.sparkSession, "toxicity")
    rows = labelled_sample(docs, labels, "toxic", learn, cfg.sample).select("label", "text")
    features = ws.save(rows.mapInArrow(trimmed(sample_batches(cfg)), "label int, features binary"), "features")
    sizes = {r.label: r["count"] for r in features.groupBy("label").count().collect()}
    toxic, clean = sizes.get(1, 0), sizes.get(0, 0)
    prior = (toxic + 0.5) / (toxic + clean + 1)
    keys = np.zeros(0, np.uint64)
    if toxic and clean:
        counts = features.mapInArrow(trimmed(count_batches), "h long, t long, c long").groupBy("h").agg(F.sum("t").alias("t"), F.sum("c").alias("c"))
        counts = counts.where((F.col("t") >= cfg.least(toxic)) & (F.col("t") >= cfg.precision * (F.col("t") + F.col("c"))))
        known = counts.select("h").toArrow()["h"].to_numpy().view(np.uint64)
        found = features.mapInArrow(keep_batches(np.sort(known)), "label int, features binary").toArrow().to_pylist()
        found.sort(key=lambda r: (r["label"], r["features"]))
        y = np.array([r["label"] for r in found], np.int64)
        sets = [np.frombuffer(r["features"], np.uint64) for r in found]
        keys = choose_voters(sets, y, cfg)
    ws.drop(features)
    if not len(keys):
        return ToxicityModel(float(min(prior, 0.49)))
    present = Present.of(sets, keys)
    count = present.count
    posterior = label_model(present, agreement_votes(count, cfg.agree), np.where(count > 0, 0.9, 0.05), cfg.rounds)
    w, b = fit_linear(present, np.stack([count >= n for n in cfg.agree], 1), posterior)
    return ToxicityModel(float(prior), keys, w[: len(keys)], w[len(keys) :], b)


def score_batches(model: ToxicityModel, cfg: ToxicityConfig, text_at: int):
    """A mapInArrow function that adds the score to all columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low = np.zeros(1 << 16, bool)
        low[(model.keys >> np.uint64(48)).astype(np.int64)] = True
        agree = np.array(cfg.agree)
        for batch in batches:
            score = np.full(batch.num_rows, model.prior)
            if len(model.keys):
                for at, end, data, bounds in text_blocks(batch.column(text_at)):
                    h, owner = word_features(data, bounds, cfg.prefixes)
                    maybe = low[(h >> np.uint64(48)).astype(np.int64)]
                    h, owner = h[maybe], owner[maybe]
                    place = np.searchsorted(model.keys, h)
                    place[place == len(model.keys)] = 0
                    hit = model.keys[place] == h
                    pair = np.unique(owner[hit] * len(model.keys) + place[hit])
                    row, voter = pair // len(model.keys), pair % len(model.keys)
                    count = np.bincount(row, minlength=end - at)
                    raw = model.bias + np.bincount(row, model.weights[voter], minlength=end - at) + (count[:, None] >= agree) @ model.agree_weights
                    score[at:end] = 1 / (1 + np.exp(-np.clip(raw, -30, 30)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(score)], names=[*batch.schema.names, "score"])

    return run


def score_toxicity(docs: DataFrame, model: ToxicityModel, cfg: ToxicityConfig = ToxicityConfig(), keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` and score for every row."""
    if {"score", "_text"} & set(keep):
        raise ValueError("the columns to keep may not be named score or _text")
    rows = docs.select(*keep, F.col(text_col).alias("_text"))
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(trimmed(score_batches(model, cfg, len(keep))), f"{kept}, score double").drop("_text")


def op9_weak_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Query: learns from labels whose fold isn't 0 of 5, scores all documents."""
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit_toxicity(docs, labels, fold("doc_id", 5) != 0)
    return score_toxicity(docs, model).select("doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(True)).alias("held_out"), "score", F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))

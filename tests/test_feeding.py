"""Chunk streams, training windows and the race of settings against loops."""

import random
import re

import pytest
from pyspark.sql import functions as F

from siltstone.operators import feeding, tuning
from siltstone.operators.windows import training_windows
from siltstone.sources.shared import Workspace


def pieces(text, size, left, right):
    """Chunks of whole words and the start and stop of their context."""
    edges = [0, *(m.end() for m in re.finditer(r"\s+|\S+", text))]
    at = 0
    while at < len(edges) - 1:
        end = at + 1
        while end + 1 < len(edges) and edges[end + 1] - edges[at] <= size:
            end += 1
        before = min(e for e in edges if e >= edges[at] - left)
        after = max(e for e in edges if e <= edges[end] + right)
        yield text[edges[at] : edges[end]], before, after
        at = end


def expected(docs, lengths, left, right, separator, pattern, apart, date=None):
    out = []
    for source, text in docs:
        text = text or ""
        cut, offset = [], 0
        for part in text.split(separator) if separator else [text]:
            cut.append((part, offset))
            offset += len(part) + len(separator)
        rows = [(date, date, 0)] if date else []
        for part, at in cut if pattern else []:
            for m in re.finditer(pattern, part):
                a = max(0, m.start() - left)
                rows.append((m[0], part[a : min(len(part), m.end() + right)], at + a))
        for size in lengths:
            for part, at in cut:
                rows += [(chunk, part[a:b], at + a) for chunk, a, b in pieces(part, size, left, right)]
        seen = {}
        for chunk, context, start in rows:
            if not any(c.isalnum() for c in chunk) or (seen.get(chunk) and abs(seen[chunk] - start) < apart):
                continue
            seen[chunk] = start
            out.append((source, chunk, context, start))
    return sorted(out)


@pytest.mark.parametrize(("lengths", "left", "right", "separator", "pattern"), [([12, 30], 5, 5, "", ""), ([9], 4, 8, "##", "[0-9]+"), ([7, 8], 0, 0, ".", "")])
def test_chunk_streams(spark, lengths, left, right, separator, pattern):
    rng = random.Random(len(lengths))
    word = lambda: rng.choice(["dusk", "a", "rain", "12", "é", ".", "##", "longerword"])
    docs = [(i, rng.choice(["", " "]).join("".join([word(), rng.choice([" ", "", "  "])]) for _ in range(rng.randint(0, 60)))) for i in range(12)] + [(90, None), (91, "")]
    made = feeding.chunk_stream(spark.createDataFrame(docs, "source long, text string"), lengths, left, right, separator, pattern)
    got = feeding.distinct_chunks(made, 25).collect()
    assert sorted((r.source, r.chunk, r.context, r.start) for r in got) == expected(docs, lengths, left, right, separator, pattern, 25)


def test_date_row_comes_first(spark):
    docs = spark.createDataFrame([(1, "one two")], "source long, text string")
    rows = feeding.chunk_stream(docs, [50], now=F.lit("2024-03-05 07:09:11").cast("timestamp"), clean=F.upper).orderBy("place").collect()
    assert [r.chunk for r in rows] == ["CURRENT TIME IS 07:09:11. TODAY IS TUESDAY. THE CURRENT DATE IS 2024-03-05.", "ONE TWO"] and rows[1].context == "one two"


@pytest.mark.parametrize(("cutoff", "stride", "end"), [(7, 0, None), (7, 3, 99), (5, 4, 99)])
def test_training_windows(spark, cutoff, stride, end):
    rng = random.Random(cutoff)
    docs = [(i, [rng.randint(1, 9) for _ in range(rng.randint(0, 12))]) for i in range(9)] + [(50, None)]
    row = [x for _, ids in docs for x in [*(ids or []), *([end] if end else [])]]
    got = training_windows(spark.createDataFrame(docs, "doc_id long, ids array<int>"), cutoff, stride, 0, end).orderBy("start").collect()
    want = []
    for start in range(0, len(row), cutoff - stride):
        part = row[start : start + cutoff]
        more = cutoff - len(part)
        want.append((start, part + [0] * more, part + [-100] * more, [1] * len(part) + [0] * more))
    assert [tuple(r) for r in got] == want
    with pytest.raises(ValueError, match="one window"):
        training_windows(spark.createDataFrame([(1, [1, 2])], "doc_id long, ids array<int>"), 7, 0, 0)


@pytest.mark.parametrize("known", [False, True])
def test_race_against_the_full_grid(spark, known):
    rng = random.Random(4)
    grid = {(s, q): min(4, int(rng.random() * 3 + s % 5 * 0.6)) for s in range(15) for q in range(40)}
    table = spark.createDataFrame([(s, q, h) for (s, q), h in grid.items()], "setting_id long, question long, hits long")
    asked = []

    def score(settings, questions):
        found = table.join(settings.select("setting_id"), "setting_id", "left_semi").join(questions.select("question"), "question", "left_semi")
        asked.append(found.count())
        return found

    settings, questions = spark.range(15).withColumnRenamed("id", "setting_id"), spark.range(40).select(F.col("id").alias("question"), F.lit(4).cast("long").alias("most"))
    before = table.where("question % 3 = 0 and setting_id < 9") if known else None
    log, scores = tuning.race(Workspace(spark, "race"), settings, questions, score, before, rounds=8)
    rows = log.orderBy("setting_id").collect()
    total = {s: sum(grid[s, q] for q in range(40)) for s in range(15)}
    best = min(total, key=lambda s: (-total[s], s))
    assert [r.setting_id for r in rows if r.best] == [best] and rows[best].hits == total[best] and rows[best].asked == rows[best].most == 160
    assert all(r.hits == total[r.setting_id] for r in rows if r.left_in is None) and all(total[r.setting_id] < total[best] for r in rows if r.left_in is not None)
    assert sum(asked) < 15 * 40 * 0.9 and scores.groupBy("setting_id", "question").count().where("count > 1").count() == 0

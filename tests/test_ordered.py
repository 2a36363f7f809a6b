"""Streams that come shuffled over micro-batches give the rows of ordered ones; state ends by its timer."""

import random

import pytest

from siltstone.streaming import ordered as O
from siltstone.streaming.replies import cut

SCHEMA = "request string, ordinal long, part string, last boolean"
STOPS = ("END", "\n\n")


def requests():
    rng = random.Random(8)
    out = []
    for k in range(6):
        n = rng.randint(1, 9)
        out += [(f"r{k}", i, "".join(rng.choice(["a", "b ", "E", "EN", "END", "\n"]) for _ in range(rng.randint(0, 3))), i == n - 1) for i in range(n)]
    return [*out, ("open", 0, "no end", False), ("open", 2, "never shown", False), ("null", 0, None, False), ("null", 1, "x", True)]


def expected(rows):
    out = []
    for key in {r[0] for r in rows}:
        text = shown = ""
        for n, (_, ordinal, part, last) in enumerate(sorted(r for r in rows if r[0] == key)):
            if ordinal != n:
                break
            text += part or ""
            now, stopped = cut(text, STOPS, last)
            if now != shown or last or stopped:
                out.append((key, n, now, last or stopped))
                shown = now
            if last or stopped:
                break
    return sorted(out)


def batches(spark, path, rows, schema, at_once):
    for i in range(0, len(rows), at_once):
        spark.createDataFrame(rows[i : i + at_once], schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def run(out, tmp_path, name):
    q = out.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / f"ck-{name}")).outputMode("append").trigger(availableNow=True).start()
    assert q.awaitTermination(240)
    return sorted(map(tuple, out.sparkSession.table(name).collect()))


@pytest.fixture
def rocksdb(spark):
    O.use_rocksdb(spark)
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield
    spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.shuffle.partitions", "4")


@pytest.mark.parametrize(("seed", "at_once"), [(None, 40), (1, 7), (2, 60)])
def test_any_order_gives_the_same(spark, tmp_path, rocksdb, seed, at_once):
    rows = requests()
    if seed is not None:
        random.Random(seed).shuffle(rows)
        rows += rows[:5]  # parts that come twice
    stream = batches(spark, str(tmp_path / "in"), rows, SCHEMA, at_once)
    assert run(O.ordered_replies(stream, STOPS), tmp_path, f"replies{seed}") == expected(requests())


def test_targets(spark, tmp_path, rocksdb):
    rng = random.Random(3)
    rows = [(k, i, rng.random() if i % 4 else None, i == 11) for k in "ab" for i in range(12)]
    want = []
    for k in "ab":
        total, weight = 0.3 / (1 - 0.9), 1 / (1 - 0.9)
        for _, i, p, _ in (r for r in rows if r[0] == k):
            total, weight = total * 0.9 + (0.3 if p is None else p), weight * 0.9 + 1
            want.append((k, i, round(min(max(0.3 * (weight * 0.9 + 1) - total * 0.9, 0), 1), 9)))
    rng.shuffle(rows)
    stream = batches(spark, str(tmp_path / "in"), rows, "request string, ordinal long, probability double, last boolean", 13)
    assert [(k, i, round(t, 9)) for k, i, t in run(O.smoothed_probabilities(stream, 0.3, 0.9), tmp_path, "targets")] == want


def test_state_ends_by_timer(spark, tmp_path, rocksdb):
    """What waited is gone after the time, so that its first part starts the request anew."""
    import time

    path, began = str(tmp_path / "in"), time.time()
    stream = batches(spark, path, [("a", 1, "late", True)], SCHEMA, 1)
    q = O.ordered_replies(stream, STOPS, forget_ms=1500).writeStream.format("memory").queryName("timed").option("checkpointLocation", str(tmp_path / "ck")).outputMode("append").start()
    # with timers a query has batches for ever: what is there is asked for, not waited for
    count = lambda: sum(p["stateOperators"][0]["numRowsTotal"] for p in q.recentProgress[-1:] if p["stateOperators"])
    while not count() and time.time() - began < 60:
        time.sleep(0.2)
    held = count()
    while count() and time.time() - began < 60:
        time.sleep(0.2)
    assert held and not count()
    spark.createDataFrame([("a", 0, "first ", False)], SCHEMA).coalesce(1).write.mode("append").parquet(path)
    while not spark.table("timed").count() and time.time() - began < 60:
        time.sleep(0.2)
    q.stop()
    assert [(r.request, r.text, r.done) for r in spark.table("timed").collect()] == [("a", "first ", False)]

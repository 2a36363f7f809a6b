"""Queries on logs and runs."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions.text import natural_key
from siltstone.plans import query


@query("orders", sql="SELECT o_orderkey, (row_number() OVER (PARTITION BY o_custkey ORDER BY array_to_string(list_transform(regexp_extract_all(lower(o_orderstatus || o_orderkey), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(x, 20, '0') ELSE x END), '')))::INT AS place FROM orders")
def natural_sort(orders):
    """Places of a customer's orders by natural order of status and number."""
    return orders.select("o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(natural_key(F.concat("o_orderstatus", F.col("o_orderkey").cast("string"))))).alias("place"))


_RUN = "o_custkey % 10 AS a, o_orderstatus AS b, o_orderpriority AS c, floor(o_totalprice / 50000)::INT AS d"


@query("orders", sql=f"WITH r AS (SELECT o_orderkey, {_RUN} FROM orders) SELECT o_orderkey, EXISTS (SELECT 1 FROM r l WHERE l.o_orderkey % 4 = 0 AND (l.a, l.b, l.c, l.d) = (r.a, r.b, r.c, r.d)) AS done FROM r WHERE o_orderkey % 4 = 1")
def eval_already_done(orders):
    """Which runs a log covers, by four columns."""
    r = orders.select("o_orderkey", (F.col("o_custkey") % 10).alias("a"), F.col("o_orderstatus").alias("b"), F.col("o_orderpriority").alias("c"), F.floor(F.col("o_totalprice") / 50000).cast("int").alias("d"))
    log = r.where("o_orderkey % 4 = 0").select("a", "b", "c", "d").distinct().withColumn("_done", F.lit(True))
    return r.where("o_orderkey % 4 = 1").join(log, ["a", "b", "c", "d"], "left").select("o_orderkey", F.coalesce("_done", F.lit(False)).alias("done"))


@query("orders", sql="SELECT a.o_orderkey AS before, b.o_orderkey AS after, a.o_orderstatus IS NOT DISTINCT FROM b.o_orderstatus AS same FROM orders a JOIN orders b ON b.o_orderkey = a.o_orderkey + 1")
def run_comparison(orders):
    """One run beside the next, compared null-safely."""
    a = orders.select(F.col("o_orderkey").alias("before"), F.col("o_orderstatus").alias("x"))
    b = orders.select(F.col("o_orderkey").alias("after"), F.col("o_orderstatus").alias("y"))
    return a.join(b, F.col("after") == F.col("before") + 1).select("before", "after", F.col("x").eqNullSafe(F.col("y")).alias("same"))


@query(
    "events",
    sql="""WITH d AS (SELECT *, coalesce(value < lag(value) OVER w, true)::INT AS reset FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(reset) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM d)
SELECT user_id, island::BIGINT AS island, count(*) AS events, round(max(value) - min(value), 6) AS gain FROM i GROUP BY user_id, island""",
)
def throughput_resets(events):
    """A counter that falls begins anew: gains between resets."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    d = events.withColumn("reset", F.coalesce(F.col("value") < F.lag("value").over(w), F.lit(True)).cast("int"))
    i = d.withColumn("island", F.sum("reset").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return i.groupBy("user_id", "island").agg(F.count("*").alias("events"), F.round(F.max("value") - F.min("value"), 6).alias("gain"))


@query("conversations", sql="SELECT role, count(*) AS turns, median(length(text))::DOUBLE AS median_length, max(turn) AS last_turn FROM conversations GROUP BY role")
def role_statistics(c):
    return c.groupBy("role").agg(F.count("*").alias("turns"), F.median(F.length("text")).alias("median_length"), F.max("turn").alias("last_turn"))

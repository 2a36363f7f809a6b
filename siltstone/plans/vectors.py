"""Queries on embeddings: every row whose id is divisible by 50 asks, all rows answer."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.operators.retrieval import recency_weight
from siltstone.operators.vectors import dot, top_k
from siltstone.plans import query

_SCORED = """WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS query_id, r.vec_id AS id, round(list_dot_product(q.v, r.v), 9) AS score FROM e q, e r WHERE q.vec_id % 50 = 0),
k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rank FROM s QUALIFY rank <= 20)
"""


def _nearest(e: DataFrame, k: int = 20) -> DataFrame:
    rows = e.select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))
    return top_k(rows.where("id % 50 = 0"), rows, k)


@query("embeddings", sql=_SCORED + "SELECT query_id, id, round(score, 6) AS score, rank::INT AS rank FROM k")
def knn_topk(e):
    """The 20 nearest rows by dot product, ties by id."""
    return _nearest(e).select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("embeddings", sql=_SCORED + "SELECT query_id, id, (row_number() OVER (PARTITION BY query_id ORDER BY id))::INT AS position FROM k WHERE rank <= 10")
def knn_sorted_by_id(e):
    """The 10 nearest rows in order of id."""
    return _nearest(e, 10).select("query_id", "id", F.row_number().over(Window.partitionBy("query_id").orderBy("id")).alias("position"))


@query("embeddings", sql=_SCORED + "SELECT query_id, id, round(score, 6) AS score FROM k WHERE score >= 0.3")
def knn_threshold_no_backfill(e):
    """A threshold after top-k: rows that fall away aren't replaced."""
    return _nearest(e).where("score >= 0.3").select("query_id", "id", F.round("score", 6).alias("score"))


@query(
    "embeddings",
    sql=_SCORED
    + """, n AS (SELECT max(vec_id) AS top FROM embeddings),
w AS (SELECT query_id, id, (2 - 2 * score) * (1 - id / top::DOUBLE * 0.5) AS d FROM k, n),
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(d, 9), id) AS place FROM w QUALIFY place <= 5)
SELECT query_id, id, abs(round(d, 6)) AS distance FROM b""",
)
def knn_two_stage_time_weight(e):
    """20 nearest, distances weighted by linear recency, then the 5 nearest."""
    top = e.agg(F.max("vec_id").alias("top"))
    near = _nearest(e).crossJoin(F.broadcast(top)).withColumn("d", (2 - 2 * F.col("score")) * (1 - F.col("id") / F.col("top").cast("double") * 0.5))
    order = Window.partitionBy("query_id").orderBy(F.round("d", 9), "id")
    return near.withColumn("place", F.row_number().over(order)).where("place <= 5").select("query_id", "id", F.abs(F.round("d", 6)).alias("distance"))


@query(
    "embeddings",
    sql=_SCORED
    + """, d AS (SELECT query_id, id, 2 - 2 * score AS d, median(2 - 2 * score) OVER (PARTITION BY query_id) AS m, min(2 - 2 * score) OVER (PARTITION BY query_id) AS least FROM k)
SELECT query_id, id, abs(round(d, 6)) AS distance FROM d WHERE round(d, 9) <= round(0.95 * m, 9) OR d = least""",
)
def median_outlier_filter(e):
    """Keeps distances up to 0.95 times the median of a query, and the least one always."""
    near = _nearest(e).withColumn("d", 2 - 2 * F.col("score"))
    stats = near.groupBy("query_id").agg(F.median("d").alias("m"), F.min("d").alias("least"))
    return near.join(stats, "query_id").where((F.round("d", 9) <= F.round(0.95 * F.col("m"), 9)) | (F.col("d") == F.col("least"))).select("query_id", "id", F.abs(F.round("d", 6)).alias("distance"))


@query("embeddings", sql="""WITH p AS (SELECT vec_id, 20.0 * (vec_id - (SELECT min(vec_id) FROM embeddings)) / (SELECT max(vec_id) - min(vec_id) FROM embeddings) - 10 AS x FROM embeddings)
SELECT vec_id, round(1 - 0.3 + 0.3 * (1 / (1 + exp(x)) - 1 / (1 + exp(10))) / (1 / (1 + exp(-10)) - 1 / (1 + exp(10))), 6) AS weight FROM p""")
def recency_sigmoid(e):
    """The factor of a distance by a sigmoid over the position: 1 for the first, 0.7 for the last."""
    ends = e.agg(F.min("vec_id").alias("least"), F.max("vec_id").alias("most"))
    return e.crossJoin(F.broadcast(ends)).select("vec_id", F.round(recency_weight(F.col("vec_id"), F.col("least"), F.col("most"), 0.3), 6).alias("weight"))


@query(
    "embeddings",
    sql="""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
p AS (SELECT label AS category, i, avg(v) AS m FROM x GROUP BY ALL),
s AS (SELECT x.vec_id, p.category, 2 * sum(x.v * p.m) AS score FROM x JOIN p USING (i) GROUP BY ALL)
SELECT vec_id, category, round(score, 6) AS score, score > 0.5 AS flagged FROM s""",
)
def moderation_scores(e):
    """Twice the dot product with each category's mean vector, flagged above 0.5.  There is one prototype a label."""
    every = F.explode(category_scores(F.col("embedding"), _prototypes(e))).alias("c")
    return e.select("vec_id", every).select("vec_id", "c.category", F.round("c.score", 6).alias("score"), (F.col("c.score") > 0.5).alias("flagged"))


@query(
    "embeddings",
    sql="""WITH x AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings),
p AS (SELECT label AS category, i, avg(v) AS m FROM x GROUP BY ALL),
s AS (SELECT x.vec_id, p.category, 2 * sum(x.v * p.m) AS score FROM x JOIN p USING (i) GROUP BY ALL)
SELECT vec_id, bool_or(round(score, 6) > 0.5) AS flagged, count_if(round(score, 6) > 0.5)::INT AS categories, round(max(score), 6) AS most FROM s GROUP BY vec_id""",
)
def moderation_any(e):
    """Whether any category flags a vector, how many do, and the highest score."""
    scored = e.select("vec_id", F.transform(category_scores(F.col("embedding"), _prototypes(e)), lambda c: F.round(c.score, 6)).alias("s"))
    over = F.size(F.filter("s", lambda x: x > 0.5))
    return scored.select("vec_id", (over > 0).alias("flagged"), over.alias("categories"), F.array_max("s").alias("most"))


def category_scores(vector, prototypes):
    """Array of (category, score): twice the product with each of ``prototypes``, rows of (category, mean), of which there are a bounded number."""
    return F.array(*(F.struct(F.lit(c).alias("category"), (2 * dot(vector, F.array(*map(F.lit, mean)))).alias("score")) for c, mean in prototypes))


def _prototypes(e: DataFrame, most: int = 1000) -> list[tuple]:
    """(category, mean) by label; more than ``most`` categories are an error, as each is a part of the plan."""
    parts = e.select("label", F.posexplode("embedding").alias("i", "v")).groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    found = parts.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda x: x.m).alias("mean")).orderBy("label").limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"there are more than {most} categories")
    return [(r.label, [float(v) for v in r.mean]) for r in found]

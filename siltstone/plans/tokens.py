"""Queries on token distributions: an embedding's 64 values serve as logits of a vocabulary of 64.

Every row is worked on by itself: no query of a distribution shuffles.
"""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import distributions as D
from siltstone.plans import query

_P = """WITH x AS (SELECT vec_id, unnest(embedding)::DOUBLE * 10 AS logit, generate_subscripts(embedding, 1) - 1 AS token FROM embeddings),
m AS (SELECT *, max(logit) OVER w AS top FROM x WINDOW w AS (PARTITION BY vec_id)),
p AS (SELECT vec_id, token, logit, top, exp(logit - top) / sum(exp(logit - top)) OVER (PARTITION BY vec_id) AS p FROM m),
r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token) AS rank, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY logit DESC, token ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM p)
"""
_KEPT = "SELECT vec_id, count(*) AS kept, min(token)::INT AS least FROM r WHERE {} GROUP BY vec_id"
#: A text's tokens: the embedding's values as numbers from 0 to 5, for penalties and repeats.
_SEEN = "SELECT vec_id, list_transform(embedding, lambda x: (floor(abs(x) * 100)::INT % 6)) AS seen FROM embeddings"


def _x(e):
    return e.select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 10).alias("x"))


def _seen():
    # the product is one of 32 bits, as in the SQL: 0.29 is token 29 % 6, not 28 % 6
    return F.transform("embedding", lambda v: (F.floor(F.abs(v) * F.lit(100).cast("float")).cast("int") % 6))


def _kept(e, step):
    """How many tokens a filter keeps, and the smallest of them."""
    t = _x(e).select("vec_id", step(F.col("x")).alias("y"))
    tokens = F.filter(F.transform("y", lambda y, i: F.when(y.isNotNull(), i)), lambda i: i.isNotNull())
    return t.select("vec_id", tokens.alias("t")).select("vec_id", F.size("t").cast("long").alias("kept"), F.array_min("t").alias("least"))


def _sums(e, step):
    """The sum of all logits and of each times its place, of what a step makes of them."""
    t = _x(e).select("vec_id", step(F.col("x")).alias("y"))
    return t.select("vec_id", F.round(D.total(F.col("y")), 6).alias("total"), F.round(D.total(F.transform("y", lambda y, i: y * (i + 1))), 6).alias("weighted"))


_SUMS = "SELECT vec_id, round(sum(y), 6) AS total, round(sum(y * (token + 1)), 6) AS weighted FROM ({}) GROUP BY vec_id"


@query("embeddings", sql=_P + "SELECT vec_id, token::INT AS token, round(ln(p), 6) AS logprob, rank::INT AS rank FROM r WHERE rank <= 5")
def softmax_logprobs(e):
    """The five likeliest tokens with log probabilities."""
    t = _x(e).select("vec_id", F.inline(D.top_tokens(F.col("x"), 5)))
    return t.select("vec_id", "token", F.round("logprob", 6).alias("logprob"), "rank")


@query("embeddings", sql=_P + ", o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY token <> vec_id % 64, rank) AS place FROM r) SELECT vec_id, token::INT AS token, round(ln(p), 6) AS logprob, rank::INT AS rank FROM o WHERE place <= 3")
def logprobs_of_actual(e):
    """The token that was drawn, whatever its rank, and the two likeliest others."""
    t = _x(e).select("vec_id", F.inline(D.top_tokens(F.col("x"), 3, (F.col("vec_id") % 64).cast("int"))))
    return t.select("vec_id", "token", F.round("logprob", 6).alias("logprob"), "rank")


@query("embeddings", sql=_P + _SUMS.format("SELECT vec_id, token, logit / 0.7 AS y FROM r"))
def sampler_temperature(e):
    return _sums(e, lambda x: D.temperature(x, 0.7))


@query("embeddings", sql=_P + _SUMS.format("SELECT vec_id, token, -(0.9 * 0.3 * (logit - top) ** 2) + 0.1 * 0.3 * (logit - top) ** 3 + top AS y FROM r"))
def sampler_quadratic(e):
    return _sums(e, lambda x: D.quadratic_smoothing(x, 0.3, 1.2))


@query("embeddings", sql=_P + _KEPT.format("rank <= 10"))
def sampler_top_k(e):
    return _kept(e, lambda x: D.top_k(x, 10))


@query("embeddings", sql=_P + _KEPT.format("round(before, 9) < 0.9"))
def sampler_top_p(e):
    """The smallest head with a mass of 0.9."""
    return _kept(e, lambda x: D.top_p(x, 0.9))


@query("embeddings", sql=_P + _KEPT.format("exp(logit - top) >= 0.1"))
def sampler_min_p(e):
    return _kept(e, lambda x: D.min_p(x, 0.1))


@query("embeddings", sql=_P + ", t AS (SELECT *, max(p) OVER (PARTITION BY vec_id) AS pm FROM r) SELECT vec_id, count(*) AS kept, min(token)::INT AS least FROM t WHERE p >= 0.2 * pm * pm GROUP BY vec_id")
def sampler_top_a(e):
    """Keeps p of at least a times the square of the greatest."""
    return _kept(e, lambda x: D.top_a(x, 0.2))


@query("embeddings", sql=_P + ", t AS (SELECT *, stddev_samp(logit) OVER (PARTITION BY vec_id) AS sd FROM r) SELECT vec_id, count(*) AS kept, min(token)::INT AS least FROM t WHERE logit >= top - 1.0 * sd GROUP BY vec_id")
def sampler_top_n_sigma(e):
    """Keeps logits within one standard deviation of the greatest."""
    return _kept(e, lambda x: D.top_n_sigma(x, 1.0))


@query(
    "embeddings",
    sql=_P
    + """, h AS (SELECT *, -sum(p * ln(p)) OVER (PARTITION BY vec_id) AS h FROM p), o AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY round(abs(-ln(p) - h), 12), token) AS place FROM h),
b AS (SELECT *, coalesce(sum(p) OVER (PARTITION BY vec_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS mass FROM o)
SELECT vec_id, count(*) AS kept, min(token)::INT AS least FROM b WHERE round(mass, 9) < 0.6 GROUP BY vec_id""",
)
def sampler_typical(e):
    """The tokens whose surprise is nearest to the entropy, up to a mass of 0.6."""
    return _kept(e, lambda x: D.typical(x, 0.6))


@query("embeddings", sql=_P + _KEPT.format("p >= 0.02 OR logit = top"))
def sampler_epsilon(e):
    return _kept(e, lambda x: D.epsilon_cutoff(x, 0.02))


@query("embeddings", sql=_P + ", h AS (SELECT *, -sum(p * ln(p)) OVER (PARTITION BY vec_id) AS h FROM p) SELECT vec_id, count(*) AS kept, min(token)::INT AS least FROM h WHERE p >= least(0.05, sqrt(0.05) * exp(-h)) OR logit = top GROUP BY vec_id")
def sampler_eta(e):
    return _kept(e, lambda x: D.eta_cutoff(x, 0.05))


@query("embeddings", sql=_P + ", n AS (SELECT *, coalesce(lead(p) OVER (PARTITION BY vec_id ORDER BY rank) >= 0.08, false) AS gone FROM r), g AS (SELECT *, bool_or(gone AND token IN (3, 7)) OVER (PARTITION BY vec_id) AS guarded FROM n) SELECT vec_id, count(*) AS kept, min(token)::INT AS least FROM g WHERE guarded OR NOT gone GROUP BY vec_id")
def sampler_exclude_top(e):
    """Drops the likeliest tokens but the last above 0.08, not where token 3 or 7 would go."""
    return _kept(e, lambda x: D.exclude_top(x, 0.08, (3, 7)))


@query("embeddings", sql=_P + "SELECT vec_id, round(-sum(p * ln(p)), 6) AS entropy, round(exp(-sum(p * ln(p))), 6) AS perplexity FROM p GROUP BY vec_id")
def entropy_perplexity(e):
    t = _x(e).select("vec_id", D.entropy(D.softmax(F.col("x"))).alias("h"))
    return t.select("vec_id", F.round("h", 6).alias("entropy"), F.round(F.exp("h"), 6).alias("perplexity"))


@query(
    "embeddings",
    sql=_P
    + """, h AS (SELECT vec_id, 0.5 + 1.5 * pow(-sum(p * ln(p)) / ln(64), 1.0) AS t FROM p GROUP BY vec_id)
SELECT vec_id, round(t, 6) AS temperature FROM h""",
)
def dynamic_temperature(e):
    """A temperature between 0.5 and 2 by the entropy's share of its maximum."""
    return _x(e).select("vec_id", F.round(D.dynamic_temperature(F.col("x"), 0.5, 2.0), 6).alias("temperature"))


@query(
    "embeddings",
    sql=_P
    + """, d AS (SELECT *, abs(p - 2 * lead(p, 1) OVER w + lead(p, 2) OVER w) AS d2 FROM r WINDOW w AS (PARTITION BY vec_id ORDER BY rank)),
c AS (SELECT *, sum(d2) OVER (PARTITION BY vec_id ORDER BY rank ROWS UNBOUNDED PRECEDING) / sum(d2) OVER (PARTITION BY vec_id) AS cdf FROM d),
k AS (SELECT *, lag(cdf) OVER (PARTITION BY vec_id ORDER BY rank) AS before_cdf FROM c)
SELECT vec_id, count(*) AS kept, min(token)::INT AS least FROM k WHERE rank = 1 OR (rank < 64 AND round(before_cdf, 9) <= 0.9) GROUP BY vec_id""",
)
def sampler_tail_free(e):
    """Cuts where the running share of absolute second differences passes 0.9; the first stays, the last always goes."""
    return _kept(e, lambda x: D.tail_free(x, 0.9))


def _with_seen(e, step):
    t = e.select("vec_id", F.transform("embedding", lambda v: v.cast("double") * 10).alias("x"), _seen().alias("seen"))
    t = t.select("vec_id", step(F.col("x"), F.col("seen")).alias("y"))
    return t.select("vec_id", F.round(D.total(F.col("y")), 6).alias("total"), F.round(D.total(F.transform("y", lambda y, i: y * (i + 1))), 6).alias("weighted"))


@query("embeddings", sql=_P + f", s AS ({_SEEN}) " + _SUMS.format("SELECT vec_id, token, CASE WHEN NOT list_contains(seen[-20:], token::INT) THEN logit WHEN logit < 0 THEN logit * 1.3 ELSE logit / 1.3 END AS y FROM r JOIN s USING (vec_id)"))
def penalty_repetition(e):
    """The last 20 tokens weigh against their logits, by sign."""
    return _with_seen(e, lambda x, seen: D.repetition_penalty(x, seen, 1.3, 20))


@query("embeddings", sql=_P + f", s AS ({_SEEN}) " + _SUMS.format("SELECT vec_id, token, logit - CASE WHEN list_contains(seen, token::INT) THEN 0.5 ELSE 0 END - 0.25 * len(list_filter(seen[-8:], lambda z: z = token)) AS y FROM r JOIN s USING (vec_id)"))
def penalty_presence_frequency(e):
    return _with_seen(e, lambda x, seen: D.frequency_penalty(D.presence_penalty(x, seen, 0.5), seen, 0.25, 8))


@query("embeddings", sql=_P + _SUMS.format("SELECT vec_id, token, logit + CASE token WHEN 2 THEN 1.5 WHEN 5 THEN -100 ELSE 0 END AS y FROM r"))
def logit_bias(e):
    return _sums(e, lambda x: D.logit_bias(x, F.create_map(F.lit(2), F.lit(1.5), F.lit(5), F.lit(-100.0))))


@query("embeddings")
def penalty_repeats(e):
    """Lowers tokens that would go on a repeat; token 0 breaks runs."""
    return _with_seen(e, lambda x, seen: D.dry_penalty(x, seen, 0.8, 1.75, 1, (0,)))


@query("embeddings", sql=_P + ", t AS (SELECT vec_id, token, logit, row_number() OVER (PARTITION BY vec_id ORDER BY logit DESC, token) AS k FROM r), q AS (SELECT vec_id, token, logit / 0.5 AS z FROM t WHERE k <= 12), g AS (SELECT *, max(z) OVER (PARTITION BY vec_id) AS zt FROM q) SELECT vec_id, count(*) AS kept, min(token)::INT AS least FROM g WHERE exp(z - zt) >= 0.05 GROUP BY vec_id")
def sampler_chain(e):
    """Temperature, top-k and min-p, given in another order than the one they are applied in."""
    return _kept(e, lambda x: D.apply_steps(x, {"min_p": lambda y: D.min_p(y, 0.05), "top_k": lambda y: D.top_k(y, 12), "temperature": lambda y: D.temperature(y, 0.5)}))


@query("embeddings", sql=_P + "SELECT vec_id, round(exp(avg(w)), 6) AS perplexity, round(exp(sum(n * w) / sum(n)), 6) AS by_token FROM (SELECT vec_id, token // 24 AS part, count(*) AS n, avg(-ln(p)) AS w FROM p GROUP BY ALL) GROUP BY vec_id")
def perplexity_of_windows(e):
    """The exponential of the plain mean of window means, beside the one by token, over windows of 24 tokens."""
    nll = F.transform(D.softmax(F.col("x")), lambda p: -F.ln(p))
    t = _x(e).select("vec_id", nll.alias("nll")).select("vec_id", "nll", F.transform(F.sequence(F.lit(1), F.lit(64), F.lit(24)), lambda i: F.slice("nll", i, 24)).alias("w"))
    means = F.transform("w", lambda w: D.total(w) / F.size(w))
    return t.select("vec_id", F.round(D.perplexity(means), 6).alias("perplexity"), F.round(F.exp(D.total(F.col("nll")) / 64), 6).alias("by_token"))


@query("conversations", sql="SELECT conv_id, turn, md5(array_to_string(list_transform(t, lambda x, i: (coalesce(list_sum(list_transform(t[1 : i - 1], lambda y: length(y))), 0)::INT)::VARCHAR), ',')) AS digest FROM (SELECT conv_id, turn, regexp_extract_all(text, '[^ ]+ *| +') AS t FROM conversations)")
def token_text_offsets(c):
    """Where each token (a word and the spaces behind it) starts in its message."""
    t = c.select("conv_id", "turn", F.regexp_extract_all("text", F.lit("[^ ]+ *| +"), F.lit(0)).alias("t"))
    return t.select("conv_id", "turn", F.md5(F.array_join(D.text_offsets(F.col("t")).cast("array<string>"), ",")).alias("digest"))


@query(
    "documents",
    sql="""WITH w AS (SELECT doc_id, unnest(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda x: x <> '')) AS token FROM documents)
SELECT doc_id, count(DISTINCT token) AS presence, count(*) - count(DISTINCT token) AS repeats FROM w GROUP BY doc_id""",
)
def penalty_counts(docs):
    """Distinct and repeated tokens, as presence and frequency penalties count them."""
    from siltstone.functions.text import word_tokens

    t = docs.select("doc_id", word_tokens(F.col("text")).alias("w")).where("size(w) > 0").select("doc_id", F.size("w").alias("n"), F.size(F.array_distinct("w")).alias("d"))
    return t.select("doc_id", F.col("d").cast("long").alias("presence"), (F.col("n") - F.col("d")).cast("long").alias("repeats"))


@query(
    "documents",
    sql="""WITH s AS (SELECT doc_id, n_chars AS n, unnest(range(0, n_chars, 512)) AS a FROM documents), e AS (SELECT doc_id, n, a, least(a + 1024, n) AS b FROM s),
p AS (SELECT *, coalesce(lag(b) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM e)
SELECT doc_id, a AS start, b AS stop, b - prev AS targets FROM p WHERE prev < n""",
)
def perplexity_windows(docs):
    """Sliding windows of 1024 with a stride of 512; targets leave out what the window before covered."""
    s = docs.where("n_chars > 0").select("doc_id", F.col("n_chars").alias("n"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chars") - 1, F.lit(512).cast("long"))).alias("a"))
    p = s.withColumn("b", F.least(F.col("a") + 1024, F.col("n"))).withColumn("prev", F.coalesce(F.lag("b").over(Window.partitionBy("doc_id").orderBy("a")), F.lit(0)))
    return p.where("prev < n").select("doc_id", F.col("a").alias("start"), F.col("b").alias("stop"), (F.col("b") - F.col("prev")).alias("targets"))

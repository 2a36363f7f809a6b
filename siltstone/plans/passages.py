"""Queries on sentences, passages and tool calls."""

from __future__ import annotations

from pyspark.sql import functions as F

from siltstone.functions import sentences as S
from siltstone.functions.tools import MARKERS, held_back, tool_calls
from siltstone.operators import passages as P
from siltstone.plans import query


@query("documents")
def sentence_spans(docs):
    """Every sentence with its place and size."""
    return docs.select("doc_id", F.posexplode(S.assessed(F.col("text"))).alias("ordinal", "s")).select("doc_id", "ordinal", "s.start", "s.stop", "s.words", "s.letters", F.md5("s.text").alias("digest"))


@query("documents")
def sentence_windows(docs):
    """Windows of one to three sentences without damaged ones."""
    w = P.sentence_windows(docs.select("doc_id", "text"), 3)
    return w.select("doc_id", "start", "stop", "sentences", "words", "letters", "short", F.md5("window_text").alias("digest"))


@query("documents")
def window_dedup_provenance(docs):
    """Each distinct window text with its occurrences and its first place."""
    w = P.sentence_windows(docs.select("doc_id", "text"), 3).withColumn("digest", F.md5("window_text"))
    return w.groupBy("digest").agg(F.count("*").alias("occurrences"), F.countDistinct("doc_id").alias("documents"), F.min(F.struct("doc_id", "start")).alias("f")).select("digest", "occurrences", "documents", F.col("f.doc_id").alias("first_doc"), F.col("f.start").alias("first_start"))


@query("documents")
def flag_counts(docs):
    """How many sentences carry each quality flag."""
    s = docs.select(F.explode(S.assessed(F.col("text"))).alias("s"))
    return s.select(F.explode("s.flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("sentences"))


@query("documents")
def chunk_words_context(docs):
    """Chunks of whole words with 50 characters of context on both sides."""
    return docs.select("doc_id", F.posexplode(P.word_chunks(F.col("text"), 700, 50, 50)).alias("chunk", "c")).select("doc_id", "chunk", "c.*")


@query("documents")
def near_dup_suppress(docs):
    """Sentences of a document but for repeats within 500 characters of the last kept one."""
    s = docs.select("doc_id", F.explode(S.sentences(F.col("text"))).alias("s")).select("doc_id", "s.start", F.md5("s.text").alias("digest"))
    g = s.groupBy("doc_id", "digest").agg(F.array_sort(F.collect_list("start")).alias("starts"))
    return g.select("doc_id", "digest", F.explode(P.keep_apart(F.col("starts"), 500)).alias("start"))


#: One call of a tool with one argument, in each format; % is the argument.
_WRITTEN = (
    '<tool_call>{"name": "lookup", "parameters": {"turn": %}}</tool_call>', "<｜tool▁calls▁begin｜><｜tool▁call▁begin｜>lookup<｜tool▁sep｜>{\"turn\": %}<｜tool▁call▁end｜>", "<|tool_call_begin|>functions.lookup:0<|tool_call_argument_begin|>{\"turn\": %}<|tool_call_end|>",
    '<|start|>assistant to=functions.lookup<|channel|>commentary json<|message|>{"turn": %}', "<|tool_call>call:lookup{turn:%}<tool_call|>", '<minimax:tool_call><invoke name="lookup"><parameter name="turn">%</parameter></invoke></minimax:tool_call>',
    "<tool_call>lookup\n<arg_key>turn</arg_key>\n<arg_value>%</arg_value>\n</tool_call>", "<tool_call><function=lookup><parameter=turn>%</parameter></function></tool_call>", '[TOOL_CALLS]lookup[ARGS]{"turn": %}', 'lookup {"turn": %}',
    "[lookup(turn=%)]", '```json\n{"function": {"name": "lookup", "arguments": {"turn": %}}}\n```',
)


@query("conversations", sql="""SELECT conv_id, turn, 0 AS call, 'lookup' AS name, '{"turn": ' || turn || '}' AS arguments FROM conversations WHERE (conv_id + turn) % 12 <> 10 OR text IS NULL OR NOT regexp_matches(text, '\\[[^\\[\\]]+\\]')""")
def tool_calls_parse(c):
    """Calls in messages that carry one behind them, each in one of twelve ways of writing it; a bracketed list counts only as the first bracket."""
    ways = F.array(*map(F.lit, _WRITTEN))
    call = F.replace(F.get(ways, ((F.col("conv_id") + F.col("turn")) % len(_WRITTEN)).cast("int")), F.lit("%"), F.col("turn").cast("string"))
    reply = F.concat(F.coalesce("text", F.lit("")), F.lit("\n"), call)
    return c.select("conv_id", "turn", F.posexplode(tool_calls(reply, ("lookup",))).alias("call", "c")).select("conv_id", "turn", "call", "c.name", "c.arguments")


_BEGUN = sorted({m[:k] for m in MARKERS for k in range(1, len(m))})
_BROKEN = "text || CASE turn % 3 WHEN 0 THEN ' <tool_call>{' WHEN 1 THEN CASE conv_id % 2 WHEN 0 THEN ' <tool_ca' ELSE ' <tool_ca.' END ELSE ' x' END"
_HELD = " OR ".join([f"contains(r, '{m}')" for m in MARKERS] + [f"suffix(r, '{b}')" for b in _BEGUN])


@query("conversations", sql=f"SELECT conv_id, turn, {_HELD} AS held FROM (SELECT *, {_BROKEN} AS r FROM conversations)")
def tool_stream_held(c):
    """Whether a reply that breaks off may be a call: a whole mark, the start of one, or neither."""
    end = F.when(F.col("turn") % 3 == 0, " <tool_call>{").when(F.col("turn") % 3 == 1, F.when(F.col("conv_id") % 2 == 0, " <tool_ca").otherwise(" <tool_ca.")).otherwise(" x")
    return c.select("conv_id", "turn", held_back(F.concat("text", end)).alias("held"))


def _rows(column: str):
    return F.transform(F.sequence(F.lit(0), F.lit(7)), lambda i: F.transform(F.slice(F.col(column), i * 8 + 1, F.lit(8)), lambda x: x.cast("double")))


def _cosine(a, b):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def _maxsim(a, b):
    return F.aggregate(F.transform(a, lambda x: F.array_max(F.transform(b, lambda y: _cosine(x, y)))), F.lit(0.0), lambda s, v: s + v) / F.size(a)


@query(
    "embeddings",
    sql="""WITH m AS (SELECT vec_id, list_transform(range(0, 8), lambda i: CAST(embedding[i * 8 + 1 : i * 8 + 8] AS DOUBLE[])) AS r FROM embeddings),
p AS (SELECT a.vec_id, a.r AS x, b.r AS y FROM m a JOIN m b ON b.vec_id = a.vec_id + 1),
s AS (SELECT vec_id, list_avg(list_transform(x, lambda u: list_max(list_transform(y, lambda v: list_cosine_similarity(u, v))))) AS forward,
list_avg(list_transform(y, lambda u: list_max(list_transform(x, lambda v: list_cosine_similarity(u, v))))) AS backward FROM p)
SELECT vec_id, round(forward, 6) AS forward, round((forward + backward) / 2, 6) AS symmetric FROM s""",
)
def maxsim(e):
    """Late interaction of each vector, as eight rows of eight, with the next one: one way and symmetric."""
    m = e.select("vec_id", _rows("embedding").alias("x"))
    p = m.join(e.select((F.col("vec_id") - 1).alias("vec_id"), _rows("embedding").alias("y")), "vec_id")
    s = p.select("vec_id", _maxsim(F.col("x"), F.col("y")).alias("f"), _maxsim(F.col("y"), F.col("x")).alias("b"))
    return s.select("vec_id", F.round("f", 6).alias("forward"), F.round((F.col("f") + F.col("b")) / 2, 6).alias("symmetric"))

"""Queries on conversations and training rows."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import messages as M
from siltstone.functions import reasoning as R
from siltstone.functions import text as T
from siltstone.operators.windows import token_windows, training_windows
from siltstone.plans import query

_W = "[ \\t\\n\\x0B\\f\\r]+"
_TOKENS = f"len(list_filter(regexp_split_to_array(text, '{_W}'), lambda w: w <> ''))"


def _by():
    return Window.partitionBy("conv_id").orderBy("turn")


@query("conversations", sql="SELECT conv_id, turn, text AS user, reply FROM (SELECT *, lead(role) OVER w AS next, CASE WHEN lead(role) OVER w = 'assistant' THEN lead(text) OVER w ELSE '' END AS reply FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)) WHERE role = 'user'")
def chat_pairs(c):
    """Each user message with the assistant's message that follows, or ''."""
    next_role, next_text = F.lead("role").over(_by()), F.lead("text").over(_by())
    return c.withColumn("reply", F.when(next_role == "assistant", next_text).otherwise("")).where("role = 'user'").select("conv_id", "turn", F.col("text").alias("user"), "reply")


@query(
    "conversations",
    sql=f"""WITH t AS (SELECT conv_id, turn, CASE WHEN role = 'assistant' AND turn % 4 = 2 THEN 'tool' ELSE role END AS role, {_TOKENS} AS tokens FROM conversations),
s AS (SELECT *, coalesce(sum(CASE WHEN role = 'system' THEN tokens END) OVER (PARTITION BY conv_id), 0) AS sys, sum(CASE WHEN role = 'system' THEN 0 ELSE tokens END) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used,
max(CASE WHEN role <> 'system' THEN turn END) OVER (PARTITION BY conv_id) AS last FROM t),
k AS (SELECT * FROM s WHERE role = 'system' OR used + sys <= 300 OR turn = last),
f AS (SELECT *, min(CASE WHEN role NOT IN ('system', 'tool') THEN turn END) OVER (PARTITION BY conv_id) AS first FROM k)
SELECT conv_id, turn, CASE WHEN role <> 'system' AND turn = last THEN least(tokens, greatest(300 - sys, 0)) ELSE tokens END::BIGINT AS taken FROM f WHERE role <> 'tool' OR turn > first""",
)
def chat_truncate_budget(c):
    """The latest messages within 300 tokens; system messages stay, tool results go with their calls, the last one is cut."""
    role = F.when((F.col("role") == "assistant") & (F.col("turn") % 4 == 2), "tool").otherwise(F.col("role"))
    t = c.select("conv_id", "turn", role.alias("role"), F.size(T.word_tokens(F.col("text"))).cast("long").alias("tokens"))
    return M.within_budget(t, ["conv_id"], 300).select("conv_id", "turn", F.col("taken").cast("long").alias("taken"))


@query(
    "conversations",
    sql=f"""SELECT conv_id, min(turn) AS turn FROM (SELECT conv_id, turn, sum({_TOKENS}) OVER (PARTITION BY conv_id ORDER BY turn DESC ROWS UNBOUNDED PRECEDING) AS used FROM conversations) WHERE used <= 200 GROUP BY conv_id""",
)
def chat_hijack_pos(c):
    """The earliest turn from which the rest takes at most 200 tokens."""
    late = Window.partitionBy("conv_id").orderBy(F.desc("turn")).rowsBetween(Window.unboundedPreceding, 0)
    t = c.withColumn("used", F.sum(F.size(T.word_tokens(F.col("text"))).cast("long")).over(late))
    return t.where("used <= 200").groupBy("conv_id").agg(F.min("turn").alias("turn"))


@query("conversations", sql="SELECT conv_id, turn, array_to_string(list_sort(list_filter([role || '_' || turn, role || '_' || (turn + 2)], lambda k: split_part(k, '_', 2)::INT <= conv_id % 4 + 1)), ',') AS keys FROM conversations WHERE turn <= conv_id % 4 + 1")
def chat_branch(c):
    """A branch at a turn of its own for each conversation, with the metadata of later turns gone."""
    key = lambda n: F.concat("role", F.lit("_"), (F.col("turn") + n).cast("string"))
    b = M.branch(c.withColumn("meta", F.create_map(key(0), F.lit(1), key(2), F.lit(2))), F.col("conv_id") % 4 + 1, "meta")
    return b.select("conv_id", "turn", F.array_join(F.array_sort(F.map_keys("meta")), ",").alias("keys"))


@query("conversations", sql="SELECT conv_id, CASE WHEN length(t) > 28 THEN substr(t, 1, 25) || '...' ELSE t END AS title FROM (SELECT conv_id, CASE WHEN conv_id % 5 = 0 THEN 'notes ' || conv_id ELSE trim(arg_min(text, turn)) END AS t FROM conversations WHERE role = 'user' GROUP BY conv_id)")
def chat_titles(c):
    """The file's name, or of files named by time the first prompt, of 28 characters at most."""
    t = c.where("role = 'user'").groupBy("conv_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.text).alias("prompts"))
    name = F.when(F.col("conv_id") % 5 == 0, F.concat(F.lit("notes "), F.col("conv_id").cast("string"))).otherwise("20250102-03-04-05")
    return t.select("conv_id", M.title(name, F.col("prompts")).alias("title"))


@query("conversations", sql="SELECT DISTINCT conv_id FROM conversations WHERE contains(text, 'the ')")
def chat_search(c):
    """Conversations that hold a string, case counts."""
    return c.where(F.col("text").contains("the ")).select("conv_id").distinct()


@query("conversations", sql="SELECT conv_id, md5(string_agg(upper(role[1]) || role[2:] || ': ' || text, chr(10) ORDER BY turn)) AS digest, count(*) AS turns FROM conversations GROUP BY conv_id")
def chat_transcript(c):
    """Name and text of all turns on lines."""
    line = F.concat(F.initcap("role"), F.lit(": "), "text")
    turns = F.array_sort(F.collect_list(F.struct("turn", line.alias("line"))))
    return c.groupBy("conv_id").agg(F.md5(F.array_join(F.transform(turns, lambda x: x.line), "\n")).alias("digest"), F.count("*").alias("turns"))


@query("conversations", sql="SELECT conv_id, string_agg(role || ':' || length(text), ',' ORDER BY turn) AS speakers FROM conversations GROUP BY conv_id")
def train_normalize(c):
    """Conversations of two public formats, every other one with other names, under one set of roles."""
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: x)
    g = c.groupBy("conv_id").agg(turns.alias("t"))
    theirs = F.transform("t", lambda x: F.struct(F.when(x.role == "user", "human").when(x.role == "assistant", "gpt").otherwise(x.role).alias("from"), x.text.alias("value")))
    ours = F.transform("t", lambda x: F.struct(x.role.alias("role"), x.text.alias("content")))
    rows = g.select("conv_id", F.when(F.col("conv_id") % 2 == 0, ours).alias("messages"), F.when(F.col("conv_id") % 2 == 1, theirs).alias("conversations"))
    m = rows.select("conv_id", M.normal_messages(F.col("messages"), F.col("conversations")).alias("m"))
    return m.select("conv_id", F.array_join(F.transform("m", lambda x: F.concat(x.role, F.lit(":"), F.length(x.content).cast("string"))), ",").alias("speakers"))


@query("conversations", sql=f"SELECT conv_id, sum(n)::BIGINT AS tokens, coalesce(sum(n) FILTER (role = 'assistant'), 0)::BIGINT AS learned FROM (SELECT conv_id, role, {_TOKENS} AS n FROM conversations) GROUP BY conv_id")
def train_label_mask(c):
    """How many tokens a conversation has, and how many of them are learned: the assistant's."""
    t = c.select("conv_id", "role", F.size(T.word_tokens(F.col("text"))).cast("long").alias("n"))
    return t.groupBy("conv_id").agg(F.sum("n").alias("tokens"), F.sum(F.when(F.col("role") == "assistant", F.col("n")).otherwise(0)).alias("learned"))


@query("conversations", sql=f"SELECT conv_id, sum({_TOKENS})::BIGINT AS tokens FROM conversations GROUP BY conv_id HAVING sum({_TOKENS}) BETWEEN 1 AND 512")
def train_length_filter(c):
    """Conversations of at most 512 tokens."""
    t = c.groupBy("conv_id").agg(F.sum(F.size(T.word_tokens(F.col("text"))).cast("long")).alias("tokens"))
    return t.where("tokens between 1 and 512")


_WORDS = f"list_filter(regexp_split_to_array(text, '{_W}'), lambda w: w <> '')"


@query(
    "documents",
    sql=f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), o AS (SELECT *, coalesce(sum(len(w)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM d),
t AS (SELECT off + unnest(range(0, len(w))) AS i, unnest(w) AS word FROM o), p AS (SELECT i, word, unnest(range(greatest((i - 255 + 191) // 192, 0), i // 192 + 1)) AS k FROM t WHERE true)
SELECT k * 192 AS start, count(*) AS length, 256 - count(*) AS padding, md5(string_agg(word, ' ' ORDER BY i)) AS digest FROM p WHERE i >= k * 192 AND i < k * 192 + 256 GROUP BY k""",
)
def train_chunk_stride(docs):
    """Windows of 256 tokens with a step of 192 over all documents in a row, the tail padded."""
    return token_windows(docs.select("doc_id", T.word_tokens(F.col("text")).alias("tokens")), 256, 64).select("start", "length", (256 - F.col("length")).alias("padding"), F.md5(F.array_join("tokens", " ")).alias("digest"))


@query(
    "documents",
    sql=f"""WITH d AS (SELECT doc_id, list_append(list_transform({_WORDS}, lambda x: length(x)), 0) AS w FROM documents), o AS (SELECT *, coalesce(sum(len(w)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS off FROM d),
t AS (SELECT off + unnest(range(0, len(w))) AS i, unnest(w) AS id FROM o), p AS (SELECT i, id, unnest(range(greatest((i - 255 + 191) // 192, 0), i // 192 + 1)) AS k FROM t WHERE true),
g AS (SELECT k * 192 AS start, count(*) AS n, string_agg(id, ',' ORDER BY i) AS ids FROM p WHERE i >= k * 192 AND i < k * 192 + 256 GROUP BY k)
SELECT start, md5(ids || repeat(',-1', (256 - n)::INT)) AS input_ids, md5(ids || repeat(',-100', (256 - n)::INT)) AS labels, n AS attended FROM g""",
)
def train_windows(docs):
    """Windows of 256 ids with a step of 192, an end behind each document, with labels and attention; ids are lengths of words here."""
    ids = F.transform(T.word_tokens(F.col("text")), F.length)
    joined = lambda c: F.md5(F.array_join(F.col(c).cast("array<string>"), ","))
    made = training_windows(docs.select("doc_id", ids.alias("ids")), 256, 64, -1, end=0)
    return made.select("start", joined("input_ids").alias("input_ids"), joined("labels").alias("labels"), F.aggregate("attention_mask", F.lit(0).cast("long"), lambda s, x: s + x).alias("attended"))


@query("conversations", sql=f"SELECT conv_id, turn, sum(CASE WHEN role = 'assistant' THEN n ELSE -100 * n END)::BIGINT - 200 AS checksum FROM (SELECT conv_id, turn, role, len({_WORDS}) AS n FROM conversations) GROUP BY conv_id, turn, role")
def train_labels(c):
    """Labels of each message behind a header of two tokens: its tokens if it's the assistant's, else masked; ids are all 1 here."""
    ids = F.transform(T.word_tokens(F.col("text")), lambda _: F.lit(1))
    turn = F.struct(F.col("role").alias("role"), F.array(F.lit(1), F.lit(1)).alias("header"), ids.alias("ids"))
    labels = M.labels_of(F.array(turn))
    return c.select("conv_id", "turn", F.aggregate(labels, F.lit(0).cast("long"), lambda s, x: s + x).alias("checksum"))


@query("conversations", sql=f"SELECT conv_id, turn, CASE WHEN n <= 40 THEN n WHEN conv_id % 2 = 0 THEN 40 ELSE 0 END::INT AS kept FROM (SELECT conv_id, turn, len({_WORDS}) AS n FROM conversations)")
def train_cutoff(c):
    """Messages over 40 tokens are cut in every other conversation and dropped in the rest."""
    ids = T.word_tokens(F.col("text"))
    return c.select("conv_id", "turn", F.size(F.when(F.col("conv_id") % 2 == 0, M.fitted(ids, 40, True)).otherwise(M.fitted(ids, 40, False))).alias("kept"))


@query("conversations", sql=f"SELECT conv_id, turn, max(n) OVER (PARTITION BY conv_id) - n AS padding FROM (SELECT conv_id, turn, {_TOKENS} AS n FROM conversations)")
def train_collate_pad(c):
    """Padding of each message up to the longest of its batch."""
    t = c.select("conv_id", "turn", F.size(T.word_tokens(F.col("text"))).cast("long").alias("n"))
    return t.select("conv_id", "turn", (F.max("n").over(Window.partitionBy("conv_id")) - F.col("n")).alias("padding"))


@query("conversations", sql="SELECT conv_id, turn, split_part(text, '.', 1) AS reasoning, ltrim(text, ' ' || chr(9) || chr(10) || chr(13)) AS content FROM conversations")
def think_split(c):
    """Reasoning and answer of messages that carry their first sentence in tags, in three of the formats."""
    first = F.substring_index("text", ".", 1)
    wrapped = F.when(F.col("turn") % 3 == 0, F.concat(F.lit("<think>"), first, F.lit("</think>"), "text")).when(F.col("turn") % 3 == 1, F.concat(F.lit("<seed:think>"), first, F.lit("</seed:think>"), "text"))
    wrapped = wrapped.otherwise(F.concat(F.lit("<|channel|>analysis<|message|>"), first, F.lit("<|end|><|start|>assistant<|channel|>final<|message|>"), "text"))
    return c.select("conv_id", "turn", R.split_reasoning(wrapped).alias("s")).select("conv_id", "turn", "s.reasoning", "s.content")


@query("conversations", sql="SELECT conv_id, turn, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS content FROM conversations")
def channel_text(c):
    """What replies say in a channel, or all of it."""
    return c.select("conv_id", "turn", R.without_channels(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("x<|channel|>final<|message|>"), "text", F.lit("<|end|>y"))).otherwise(F.col("text"))).alias("content"))


@query(
    "conversations",
    sql="""WITH n AS (SELECT *, lead(role) OVER w AS nr, lead(text) OVER w AS nt, lag(role) OVER w AS pr, min(CASE WHEN role <> 'system' THEN turn END) OVER (PARTITION BY conv_id) AS first FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
r AS (SELECT conv_id, turn, CASE WHEN role = 'user' THEN text WHEN role = 'system' THEN text ELSE '' END AS u, CASE WHEN role = 'user' AND nr = 'assistant' THEN nt WHEN role = 'assistant' THEN text ELSE '' END AS a FROM n
WHERE (role = 'user' AND nr IS NOT NULL) OR (role = 'assistant' AND pr IS DISTINCT FROM 'user') OR (role = 'system' AND turn > first))
SELECT c.conv_id, count(r.turn) AS pairs, coalesce(sum(length(r.u) + 1000 * length(r.a)), 0)::BIGINT AS checksum FROM (SELECT DISTINCT conv_id FROM conversations) c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id""",
)
def chat_rows(c):
    """Messages as rows of user and assistant, the waiting last message left out."""
    m = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x.role.alias("role"), x.text.alias("content"), F.lit(None).cast("string").alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id")))
    p = c.groupBy("conv_id").agg(m.alias("m")).select("conv_id", M.paired(F.col("m")).alias("p"))
    size = F.aggregate("p.rows", F.lit(0).cast("long"), lambda s, r: s + F.length(r.user) + 1000 * F.length(r.assistant))
    return p.select("conv_id", F.size("p.rows").cast("long").alias("pairs"), size.alias("checksum"))


@query("conversations", sql="SELECT conv_id, turn, role, text FROM conversations WHERE role IN ('user', 'assistant') AND text <> ''")
def chat_messages_again(c):
    """Pairs taken apart again give the messages they were made of."""
    m = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x.role.alias("role"), x.text.alias("content"), F.lit(None).cast("string").alias("tool_calls"), F.lit(None).cast("string").alias("tool_call_id")))
    turns = F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda x: x.turn)
    p = c.where("role in ('user', 'assistant') and text <> ''").groupBy("conv_id").agg(m.alias("m"), turns.alias("turns")).select("conv_id", "turns", M.paired(F.col("m")).alias("p"))
    waiting = F.when(F.col("p.pending") != "", F.array(F.struct(F.lit("user").alias("role"), F.col("p.pending").alias("content")))).otherwise(F.array().cast("array<struct<role:string,content:string>>"))
    again = F.concat(M.unpaired(F.col("p.rows"), F.col("p.system")), waiting)
    rows = p.select("conv_id", F.explode(F.arrays_zip(F.col("turns").alias("turn"), again.alias("m"))).alias("x"))
    return rows.select("conv_id", "x.turn", "x.m.role", F.col("x.m.content").alias("text"))


@query("conversations", sql="SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN repeat('<__media__>', 2) || chr(10) || chr(10) ELSE '' END || split_part(text, '.', 1) || chr(10) || text AS content FROM conversations")
def flat_contents(c):
    """Parts of texts and images as one text."""
    part = lambda kind, text: F.struct(F.lit(kind).alias("type"), text.alias("text"))
    texts = F.array(part("text", F.substring_index("text", ".", 1)), part("text", F.col("text")))
    image = part("image_url", F.lit(None).cast("string"))
    return c.select("conv_id", "turn", M.flat_content(F.when(F.col("turn") % 3 == 0, F.concat(F.array(image), texts, F.array(image))).otherwise(texts)).alias("content"))


@query("conversations", sql="SELECT c.conv_id, c.turn AS call_id, coalesce(r.text, '') AS content FROM conversations c LEFT JOIN conversations r ON r.conv_id = c.conv_id AND r.turn = c.turn + 1 AND r.role = 'assistant' WHERE c.role = 'user'")
def tool_results(c):
    """Each user message as a call, with the reply behind it as its result or an empty one."""
    calls = c.where("role = 'user'").select("conv_id", F.col("turn").alias("call_id"))
    results = c.where("role = 'assistant'").select("conv_id", (F.col("turn") - 1).alias("call_id"), F.col("text").alias("content"))
    return M.answered_calls(calls, results, ["conv_id"])


@query("conversations", sql="SELECT conv_id, array_to_string(list_sort(list_filter(s, lambda x: NOT list_bool_or(list_transform(s, lambda y: x <> y AND starts_with(x, y))))), '|') AS stops FROM (SELECT conv_id, list_distinct(list_transform(list(text), lambda t: substr(t, 1, 1 + length(t) % 3))) AS s FROM conversations GROUP BY conv_id)")
def needed_stops(c):
    """Of the first letters of messages as stop strings, those that don't start with another."""
    s = c.groupBy("conv_id").agg(F.collect_list(F.expr("substring(text, 1, 1 + length(text) % 3)")).alias("s"))
    return s.select("conv_id", F.array_join(F.array_sort(M.needed_stops(F.col("s"))), "|").alias("stops"))


@query("conversations", sql="SELECT conv_id, least(greatest(max(turn) + conv_id % 5 - 2, 0), count(*) - 1)::BIGINT AS version FROM conversations GROUP BY conv_id")
def version_steps(c):
    """A step through versions, within the first and the last."""
    g = c.groupBy("conv_id").agg(F.collect_list("text").alias("v"), F.max("turn").alias("now"))
    return g.select("conv_id", M.version_at(F.col("v"), F.col("now"), F.col("conv_id") % 5 - 2).cast("long").alias("version"))


@query("conversations", sql="SELECT conv_id, md5(string_agg('<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10), '' ORDER BY turn) || '<|im_start|>assistant' || chr(10)) AS digest FROM conversations GROUP BY conv_id")
def chat_render(c):
    """Conversations in a template, with the start of a reply."""
    m = F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))), lambda x: F.struct(x.role.alias("role"), x.text.alias("content")))
    return c.groupBy("conv_id").agg(F.md5(M.rendered(m, prompt=True)).alias("digest"))


@query("conversations", sql="SELECT conv_id, turn, md5(CASE WHEN contains(text, chr(10)) THEN split_part(text, chr(10), 1) WHEN contains(text, '. ') THEN split_part(text, '. ', 1) WHEN suffix(text, '.') THEN substr(text, 1, length(text) - 1) ELSE text END) AS digest FROM conversations")
def stop_cut(c):
    """Texts cut at stop strings, first a line end, then a full stop and a space."""
    return c.select("conv_id", "turn", F.md5(T.cut_at_stop(F.col("text"), ("\n", ". "))).alias("digest"))

"""Queries on texts."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import sentences as S
from siltstone.functions import text as T
from siltstone.operators.ranks import sorted_table
from siltstone.operators.retrieval import merge_passages, page_of
from siltstone.plans import query
from siltstone.sources.shared import Workspace

_CHUNKS = "WITH c AS (SELECT doc_id, (n.i)::INT AS chunk, substr(text, n.i * 700 + 1, 700) AS chunk_text FROM documents, LATERAL (SELECT unnest(range(0, (length(text) + 699) // 700)) AS i) n) "


def chunks(docs, size: int = 700):
    """Fixed-size chunks of code points."""
    starts = F.sequence(F.lit(0), F.floor((F.length("text") - 1) / size).cast("int"))
    return docs.where(F.length("text") > 0).select("doc_id", F.posexplode(F.transform(starts, lambda i: F.substring(F.col("text"), i * size + 1, F.lit(size)))).alias("chunk", "chunk_text"))


@query("documents", sql=_CHUNKS + "SELECT doc_id, chunk, length(chunk_text) AS length, md5(chunk_text) AS digest FROM c")
def chunk_fixed(docs):
    """Chunks of 700 code points without overlap."""
    return chunks(docs).select("doc_id", "chunk", F.length("chunk_text").cast("long").alias("length"), F.md5("chunk_text").alias("digest"))


@query(
    "documents",
    sql="SELECT doc_id, (unnest(range(0, len(string_split(text, chr(10))))))::INT AS part, length(unnest(string_split(text, chr(10)))) AS length FROM documents",
)
def chunk_separator(docs):
    """Parts between line ends."""
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("part", "t")).select("doc_id", "part", F.length("t").cast("long").alias("length"))


@query("documents", sql=_CHUNKS + "SELECT doc_id, count(*) AS chunks FROM c WHERE regexp_matches(chunk_text, '[\\p{L}\\p{N}]') GROUP BY doc_id")
def chunk_nonblank(docs):
    """How many chunks hold a letter or a number."""
    return chunks(docs).where(F.col("chunk_text").rlike(r"[\p{L}\p{N}]")).groupBy("doc_id").agg(F.count("*").alias("chunks"))


@query("documents", sql=_CHUNKS + "SELECT md5(chunk_text) AS digest, count(*) AS occurrences, min(doc_id) AS first_doc FROM c GROUP BY chunk_text")
def chunk_dedup_provenance(docs):
    """Each distinct chunk with its number of occurrences and its first document."""
    return chunks(docs).groupBy(F.md5("chunk_text").alias("digest")).agg(F.count("*").alias("occurrences"), F.min("doc_id").alias("first_doc"))


_HITS = "SELECT doc_id, n.i * 200 AS start, least(n.i * 200 + 260, length(text)) AS stop, ((doc_id * 31 + n.i * 17) % 100) / 100.0 AS distance, text FROM documents, LATERAL (SELECT unnest(range(0, (length(text) + 199) // 200)) AS i) n WHERE (doc_id + n.i * n.i) % 3 < 2"


def _hits(docs):
    """Passages of 260 characters as a search might return them, with distances."""
    i = F.explode(F.sequence(F.lit(0), F.floor((F.length("text") - 1) / 200).cast("int"))).alias("i")
    rows = docs.where(F.length("text") > 0).select("doc_id", "text", i).where((F.col("doc_id") + F.col("i") * F.col("i")) % 3 < 2)
    start, stop = F.col("i") * 200, F.least(F.col("i") * 200 + 260, F.length("text"))
    return rows.select("doc_id", start.alias("start"), stop.alias("stop"), F.expr("substring(text, i * 200 + 1, 260)").alias("text"), (((F.col("doc_id") * 31 + F.col("i") * 17) % 100) / 100.0).alias("distance"))


@query(
    "documents",
    sql=f"""WITH s AS ({_HITS}), o AS (SELECT *, coalesce(start > max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS fresh FROM s),
i AS (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING) AS island FROM o)
SELECT doc_id, min(start)::INT AS start, max(stop)::INT AS stop, count(*)::INT AS members, round(min(distance), 6) AS distance, md5(substr(any_value(text), min(start) + 1, max(stop) - min(start))) AS digest FROM i GROUP BY doc_id, island""",
)
def interval_merge(docs):
    """Overlapping or touching passages of a document become one: stitched text and the least distance."""
    return merge_passages(_hits(docs), ["doc_id"], "min").select("doc_id", "start", "stop", "members", F.round("distance", 6).alias("distance"), F.md5("text").alias("digest"))


@query(
    "documents",
    sql="""WITH t AS (SELECT doc_id, doc_id // 100 AS context, len(list_filter(regexp_split_to_array(text, '[ \\t\\n\\x0B\\f\\r]+'), lambda w: w <> '')) AS tokens FROM documents),
r AS (SELECT *, coalesce(sum(tokens) OVER (PARTITION BY context ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used FROM t)
SELECT context, doc_id, least(tokens, 4000 - used)::BIGINT AS taken FROM r WHERE used < 4000""",
)
def token_budget(docs):
    """Documents of a context in order up to 4000 tokens; the one that crosses is cut."""
    t = docs.select("doc_id", F.floor(F.col("doc_id") / 100).alias("context"), F.size(T.word_tokens(F.col("text"))).cast("long").alias("tokens"))
    w = Window.partitionBy("context").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1)
    r = t.withColumn("used", F.coalesce(F.sum("tokens").over(w), F.lit(0)))
    return r.where("used < 4000").select("context", "doc_id", F.least("tokens", 4000 - F.col("used")).alias("taken"))


_PARTS = "regexp_extract_all(text, '[\\p{L}\\p{N}_]+|[^\\p{L}\\p{N}_]+')"


@query("documents", sql=f"SELECT doc_id, md5(array_to_string(list_transform({_PARTS}, lambda p: CASE WHEN regexp_full_match(p, '[A-Z_]+') THEN p ELSE lower(p) END), '')) AS digest FROM documents")
def smart_lower(docs):
    """Lower case but for words of capitals and underscores."""
    return docs.select("doc_id", F.md5(T.smart_lower(F.col("text"))).alias("digest"))


@query("documents", sql=f"SELECT doc_id, md5(array_to_string(list_transform({_PARTS}, lambda p: CASE WHEN regexp_full_match(p, '[0-9]+') THEN translate(p, '0123456789', 'ABCDEFGHIJ') ELSE p END), '')) AS digest FROM documents")
def num_to_char(docs):
    """Words of digits as letters."""
    return docs.select("doc_id", F.md5(T.digits_to_letters(F.col("text"))).alias("digest"))


@query(
    "documents",
    sql=f"""SELECT doc_id, md5(array_to_string(list_transform({_PARTS}, lambda p: CASE WHEN regexp_full_match(p, '[0-9]{{2,}}')
THEN array_to_string(list_transform(string_split(translate(p, '0123456789', 'ABCDEFGHIJ'), ''), lambda c, i: repeat(c, (length(p) - i + 1)::BIGINT)), '') ELSE p END), '')) AS digest FROM documents""",
)
def num_to_runs(docs):
    """Words of two digits or more as letters repeated by place."""
    return docs.select("doc_id", F.md5(T.digits_to_runs(F.col("text"), 2)).alias("digest"))


@query(
    "documents",
    sql="SELECT doc_id, md5(regexp_replace(translate(text, '!\"#$%&''()*+,-./:;<=>?@[\\]^_`{|}~', ''), ' +', ' ', 'g')) AS digest FROM documents",
)
def strip_punct(docs):
    """Without ASCII punctuation, runs of spaces merged."""
    return docs.select("doc_id", F.md5(T.merge_spaces(T.strip_punctuation(F.col("text")))).alias("digest"))


_STOPS = ", ".join("'" + w.replace("'", "''") + "'" for w in T.STOP_WORDS)


@query("documents", sql=f"SELECT doc_id, md5(array_to_string(list_filter({_PARTS}, lambda x: x NOT IN ({_STOPS})), '')) AS digest FROM documents")
def stopwords(docs):
    """Without function words; what stands between words stays."""
    return docs.select("doc_id", F.md5(T.remove_stop_words(F.col("text"))).alias("digest"))


_BLANK = "[ \\t\\x0B\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{202F}\\x{205F}\\x{3000}]"
_JOIN = "[\\p{L}\\p{Nl}\\p{No}]"


def _unwrapped_sql(scanned: bool) -> str:
    """All passes but the last, paragraph ends as chr(8233); the passes without look-around: wraps are replaced twice, as a letter may stand between two of them."""
    x = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(text, '^\\x{FEFF}', ''), '\\r\\n?', chr(10), 'g'), '[\\x{2029}\\f]', chr(10) || chr(10), 'g'), '\\x{2028}', chr(10), 'g')"
    wrap = lambda x, mark: f"regexp_replace(regexp_replace({x}, '({_JOIN}){mark}{_BLANK}*\\n{_BLANK}*({_JOIN})', '\\1\\2', 'g'), '({_JOIN}){mark}{_BLANK}*\\n{_BLANK}*({_JOIN})', '\\1\\2', 'g')"
    if scanned:
        x = f"regexp_replace({x}, '(?im)^{_BLANK}*(?:[0-9]+|(?:page|chapter){_BLANK}+(?:[0-9]+|[ivxlcdm]+)){_BLANK}*(?:\\n|\\z)', '', 'g')"
    x = f"replace({wrap(x, '\\x{AD}')}, chr(173), '')"
    x = wrap(wrap(x, "\\x{AC}"), "-") if scanned else x
    return f"regexp_replace(regexp_replace({x}, '{_BLANK}+', ' ', 'g'), ' *\\n(?: *\\n)+ *', chr(8233), 'g')"


def _clean_sql(scanned: bool) -> str:
    x = _unwrapped_sql(scanned)
    return f"SELECT doc_id, md5(replace(regexp_replace({x}, ' *\\n *', ' ', 'g'), chr(8233), chr(10) || chr(10))) AS digest FROM documents"


@query("documents", sql=_clean_sql(False))
def clean_conservative(docs):
    """The conservative clean-up."""
    return docs.select("doc_id", F.md5(T.clean(F.col("text"))).alias("digest"))


@query("documents", sql=_clean_sql(True))
def clean_scanned(docs):
    """The clean-up of scanned books, hyphens at line ends joined."""
    return docs.select("doc_id", F.md5(T.clean(F.col("text"), True, "scanned_book")).alias("digest"))


@query("documents", sql=_clean_sql(False))
def clean_with_offsets(docs):
    """The text of the clean-up that also keeps offsets and counts."""
    return docs.select("doc_id", F.md5(T.clean_report(F.col("text")).text).alias("digest"))


_WRAP = f"'({_JOIN})\\x{{AD}}{_BLANK}*\\n{_BLANK}*({_JOIN})'"
_SOFT = "len(regexp_extract_all({}, '\\x{{AD}}'))"
#: How often each pass of the conservative clean-up changes something, each on the text that the passes before it left.
_PASS_COUNTS = f"""WITH x AS (SELECT regexp_replace(text, '^\\x{{FEFF}}', '') AS a, regexp_replace(a, '\\r\\n?', chr(10), 'g') AS b, regexp_replace(b, '[\\x{{2029}}\\f]', chr(10) || chr(10), 'g') AS c, regexp_replace(c, '\\x{{2028}}', chr(10), 'g') AS d,
regexp_replace(regexp_replace(d, {_WRAP}, '\\1\\2', 'g'), {_WRAP}, '\\1\\2', 'g') AS e, replace(e, chr(173), '') AS f, regexp_replace(f, '{_BLANK}+', ' ', 'g') AS g, regexp_replace(g, ' *\\n(?: *\\n)+ *', chr(8233), 'g') AS h, text FROM documents),
n AS (SELECT MAP {{'byte_order_mark': length(text) - length(a), 'line_endings': len(list_filter(regexp_extract_all(a, '\\r\\n?|\\n'), lambda m: m <> chr(10))), 'paragraph_separators': len(regexp_extract_all(b, '[\\x{{2029}}\\f]')),
'line_separators': len(regexp_extract_all(c, '\\x{{2028}}')), 'soft_hyphen_wraps': {_SOFT.format("d")} - {_SOFT.format("e")}, 'soft_hyphens': {_SOFT.format("e")}, 'horizontal_whitespace': len(list_filter(regexp_extract_all(f, '{_BLANK}+'), lambda m: m <> ' ')),
'paragraph_whitespace': len(list_filter(regexp_extract_all(g, ' *\\n(?: *\\n)+ *'), lambda m: m <> chr(10) || chr(10))), 'line_wraps': len(regexp_extract_all(h, ' *\\n *'))}} AS m FROM x)
SELECT key AS kind, sum(value)::BIGINT AS changes, count_if(value > 0)::BIGINT AS files FROM (SELECT unnest(map_entries(m), recursive := true) FROM n) GROUP BY key HAVING sum(value) > 0"""


@query("documents", sql=_PASS_COUNTS)
def cleanup_totals(docs):
    """How often each pass of the clean-up changed something, and in how many texts."""
    kinds = docs.select(F.explode(T.clean_counts(F.col("text")).counts).alias("kind", "n"))
    return kinds.groupBy("kind").agg(F.sum("n").alias("changes"), F.count("*").alias("files"))


@query("documents")
def cleanup_samples(docs):
    """All kinds of clean-up of scanned texts: changes, texts, and the sample of the smallest doc_id."""
    r = Workspace(docs.sparkSession, "cleanup").save(docs.select("doc_id", T.clean_counts(F.col("text"), "scanned_book").alias("r")), "changed")  # texts are cleaned once
    totals = r.select(F.explode("r.counts").alias("kind", "n")).groupBy("kind").agg(F.sum("n").alias("changes"), F.count("*").alias("files"))
    first = r.select("doc_id", F.inline("r.snippets")).groupBy("kind").agg(F.min(F.struct("doc_id", "before", "after")).alias("f"))
    return totals.join(first, "kind").select("kind", "changes", "files", F.col("f.doc_id").alias("first_doc"), "f.before", "f.after")


_PIECE = r"[\p{L}\p{M}\p{N}]+|[^\p{L}\p{M}\p{N} \t\n\x0B\f\r]+"
_PIECES = f"SELECT unnest(regexp_extract_all(text, '{_PIECE}')) AS t FROM documents"


@query(
    "documents",
    sql=f"""WITH l AS ({_PIECES}), f AS (SELECT [CASE WHEN contains(t, chr(65533)) THEN 'replacement_character' END, CASE WHEN regexp_matches(t, '[\\x00-\\x08\\x0E-\\x1B\\x7F-\\x{{84}}\\x{{86}}-\\x{{9F}}]') THEN 'control_character' END,
CASE WHEN regexp_matches(t, '\\pP') AND NOT regexp_matches(t, '[^\\pP \\t\\n\\x0B\\f\\r\\x{{85}}\\p{{Z}}]') THEN 'punctuation_fragment' END] AS flags FROM l)
SELECT flag, count(*) AS words FROM (SELECT unnest(list_filter(flags, lambda x: x IS NOT NULL)) AS flag FROM f) GROUP BY flag""",
)
def word_flags(docs):
    """How many words, and runs of other characters between them, carry each flag of damage."""
    words = docs.select(F.explode(F.regexp_extract_all("text", F.lit(f"({_PIECE})"))).alias("t"))
    return words.select(F.explode(S.damage_flags(F.col("t"))).alias("flag")).groupBy("flag").agg(F.count("*").alias("words"))


@query(
    "documents",
    sql="SELECT doc_id, length(regexp_replace(text, '[^\\p{L}]', '', 'g')) AS letters, len(regexp_extract_all(text, '[\\p{L}\\p{M}\\p{N}]+')) AS words FROM documents",
)
def word_letter_counts(docs):
    """Letters and runs of letters, marks and numbers."""
    return docs.select("doc_id", F.length(F.regexp_replace("text", r"[^\p{L}]", "")).cast("long").alias("letters"), F.regexp_count("text", F.lit(r"[\p{L}\p{M}\p{N}]+")).cast("long").alias("words"))


@query(
    "documents",
    "labels",
    sql="""SELECT quality, count(*) AS documents, count_if(noisy)::BIGINT AS flagged FROM (SELECT l.quality, regexp_matches(d.text, '[#*%$&|!]{2,}| \\| ') AS noisy FROM documents d JOIN labels l USING (doc_id)) GROUP BY quality""",
)
def labels_quality_eval(docs, labels):
    """How a noise flag meets the quality labels."""
    j = docs.select("doc_id", F.col("text").rlike(r"[#*%$&|!]{2,}| \| ").alias("noisy")).join(labels, "doc_id")
    return j.groupBy("quality").agg(F.count("*").alias("documents"), F.count_if("noisy").alias("flagged"))


@query("pages", sql="SELECT page_id, regexp_matches(url, '^https?://[^/\\\\@]+(/|$)') AS allowed FROM pages")
def url_safe_predicate(pages):
    """Scheme allow-list, no backslash and no user info in the authority."""
    return pages.select("page_id", F.col("url").rlike(r"^https?://[^/\\@]+(/|$)").alias("allowed"))


_NATURAL = "array_to_string(list_transform(regexp_extract_all(lower({}), '[0-9]+|[^0-9]+'), lambda x: CASE WHEN regexp_matches(x, '^[0-9]') THEN chr(1) || lpad(length(regexp_replace(x, '^0+([0-9])', '\\1'))::VARCHAR, 10, '0') || regexp_replace(x, '^0+([0-9])', '\\1') ELSE x END), '')"


def _by_address(pages):
    return sorted_table(Workspace(pages.sparkSession, "pages"), pages.select("page_id", "url"), [T.natural_key(F.col("url")), F.col("page_id")])


@query("pages", sql=f"SELECT page_id FROM pages ORDER BY {_NATURAL.format('url')}, page_id LIMIT 10 OFFSET ((least(3, (SELECT (count(*) + 9) // 10 FROM pages)) - 1) * 10)")
def paginate(pages):
    """The third page of ten by natural order of the address."""
    return page_of(_by_address(pages), 3, 10).select("page_id")


@query("pages", sql=f"SELECT page_id FROM pages ORDER BY {_NATURAL.format('url')}, page_id LIMIT 7 OFFSET (((SELECT (count(*) + 6) // 7 FROM pages) - 1) * 7)")
def paginate_clamped(pages):
    """A page beyond the end is the last one."""
    return page_of(_by_address(pages), 1_000_000, 7).select("page_id")


@query("documents", sql="SELECT doc_id, row_number() OVER (ORDER BY source, n_chars DESC, doc_id) - 1 AS place FROM documents")
def ranks_of_all(docs):
    """The number of every document in order of source, length and id, by ranges and running offsets."""
    order = [F.col("source"), F.col("n_chars").desc(), F.col("doc_id")]
    return sorted_table(Workspace(docs.sparkSession, "ranks"), docs.select("doc_id", "source", "n_chars"), order).numbered("place").select("doc_id", "place")

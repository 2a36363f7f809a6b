"""Summaries: the sentences of a text that its other sentences lean on, by weighted PageRank over all texts at once.

Two sentences of a text are linked by the cosine of their sets of words.  That weight is a sum over the words they share,
so a round needs no links: what the sentences of a word send is added up for each word, and what a sentence gets is added up
over its words, less what it sent itself.  A round is two joins with the index of words and costs in proportion to it, however
many sentences share a word.  Texts whose ranks stand still leave the rounds.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from siltstone.functions import sentences as S
from siltstone.functions.text import word_set
from siltstone.sources.shared import Workspace


def sentence_ranks(ws: Workspace, words: DataFrame, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 100, at_once: int = 5) -> DataFrame:
    """(doc, s, rank) of the sentences of ``words(doc, s, word)``, in which a null word stands for a sentence without words.

    A sentence that shares no word has 1 - ``damping``.  A text takes part until ``at_once`` rounds, which make one job, move
    no rank of its own by more than ``tolerance``, and for about ``rounds`` rounds at most.
    """
    one = ["doc", "s"]
    every = ws.save(words.select(*one).distinct(), "sentences")
    pairs = words.where("word is not null").select("doc", "s", "word").distinct()
    sizes = pairs.groupBy(*one).agg(F.count("*").alias("n"))
    # a word of one sentence links nothing
    shared = pairs.groupBy("doc", "word").agg(F.count("*").alias("held")).where("held > 1")
    held = ws.save(pairs.join(shared, ["doc", "word"]).join(sizes, one).select("doc", "s", "word", F.sqrt("n").alias("size"), "n"), "held")
    by_word = held.groupBy("doc", "word").agg(F.sum(1 / F.col("size")).alias("u"))
    degrees = held.join(by_word, ["doc", "word"]).groupBy(*one).agg((F.sum("u") / F.first("size")).alias("all"), (F.count("*") / F.first("n")).alias("own"))
    degrees = ws.save(degrees.select(*one, (F.col("all") - F.col("own")).alias("degree"), "own").where("degree > 1e-12"), "degrees")
    # what a sentence sends of its rank to a word and takes from it; a word of its own takes back what it would send itself
    linked = held.join(degrees, one)
    links = linked.select("doc", "s", "word", (1 / (F.col("size") * F.col("degree"))).alias("send"), (1 / F.col("size")).alias("take"))
    back = degrees.select("doc", "s", F.concat(F.lit("\x00"), F.col("s").cast("string")).alias("word"), (1 / F.col("degree")).alias("send"), (-F.col("own")).alias("take"))
    index = ws.save(links.unionByName(back), "index")
    live = ws.save(degrees.select(*one, F.lit(1.0).alias("rank")), "ranks")
    ended = []
    for _ in range(-(-rounds // at_once)):
        lines, next_ = index.join(live.select("doc").distinct(), "doc", "left_semi"), live
        for _ in range(at_once):
            sent = lines.join(next_, one).groupBy("doc", "word").agg(F.sum(F.col("rank") * F.col("send")).alias("u"))
            next_ = lines.join(sent, ["doc", "word"]).groupBy(*one).agg((1 - damping + damping * F.sum(F.col("u") * F.col("take"))).alias("rank"))
        moved = F.max(F.abs(F.col("rank") - F.col("before"))).over(Window.partitionBy("doc"))
        new = next_.join(live.select(*one, F.col("rank").alias("before")), one).select(*one, "rank", (moved <= tolerance).alias("still"))
        new = ws.save(new, "ranks")
        ended.append(new.where("still").select(*one, "rank"))
        live = new.where("not still").select(*one, "rank")
        if live.isEmpty():
            break
    else:
        ended.append(live)
    ranks = ended[0]
    for more in ended[1:]:
        ranks = ranks.unionByName(more)
    return every.join(ranks, one, "left").select(*one, F.coalesce("rank", F.lit(1 - damping)).alias("rank"))


def ranks_within(sentence: np.ndarray, word: np.ndarray, count: int, damping: float = 0.85, tolerance: float = 1e-6, rounds: int = 100, at_once: int = 5) -> np.ndarray:
    """The ranks of ``count`` sentences of one text by the rule of ``sentence_ranks``; ``sentence`` and ``word`` are the distinct pairs of them, as numbers."""
    out = np.full(count, 1 - damping)
    n = np.bincount(sentence, minlength=count)
    _, word, held = np.unique(word, return_inverse=True, return_counts=True)
    sentence, word = sentence[held[word] > 1], word[held[word] > 1]
    if not len(word):
        return out
    over = 1 / np.sqrt(np.maximum(n, 1))
    of_words = lambda by: np.bincount(word, by[sentence])
    of_sentences = lambda by: np.bincount(sentence, by[word], minlength=count)
    own = np.bincount(sentence, minlength=count) / np.maximum(n, 1)
    degree = of_sentences(of_words(over)) * over - own
    linked = degree > 1e-12
    send = np.where(linked, 1 / np.where(linked, degree, 1), 0.0)
    rank, moved = np.where(linked, 1.0, 0.0), np.inf
    for _ in range(-(-rounds // at_once)):
        before = rank
        for _ in range(at_once):
            sent = rank * send
            rank = np.where(linked, 1 - damping + damping * (of_sentences(of_words(sent * over)) * over - own * sent), 0.0)
        moved = np.abs(rank - before).max()
        if moved <= tolerance:
            break
    out[linked] = rank[linked]
    return out


def ranks_of(words: Column) -> Column:
    """The ranks of a text's sentences, given as an array of their arrays of distinct words."""

    @F.arrow_udf("array<double>")
    def ranked(column: pa.Array) -> pa.Array:
        out = []
        for at in range(len(column)):  # a text at a time
            sets = column[at].values
            flat = sets.flatten().dictionary_encode().indices.to_numpy() if sets is not None else None
            out.append(None if sets is None else ranks_within(np.repeat(np.arange(len(sets)), sets.value_lengths().to_numpy()), flat, len(sets)))
        return pa.array(out, pa.list_(pa.float64()))

    return ranked(words)


def summaries(docs: DataFrame, least: int = 5, share: float = 0.2, ws: Workspace | None = None) -> DataFrame:
    """(doc, n, sentences) for ``docs(doc, text)``: the best ``share`` of a text's sentences, in order of standing; ties go to the earlier one.

    A text of fewer than ``least`` sentences is its own summary; a null text has none.  ``doc`` tells rows apart.
    """
    ws = ws or Workspace(docs.sparkSession, "summaries")
    cut = ws.save(docs.select("doc", "text", S.sentences(F.col("text")).alias("all")), "cut")
    ranks = cut.where(F.size("all") >= least).select("doc", "all", ranks_of(F.transform("all", lambda a: word_set(a.text))).alias("ranks"))
    # greater ranks first, then earlier sentences
    order = F.array_sort(F.transform("ranks", lambda r, s: F.struct((-F.round(r, 5)).alias("rank"), s.alias("s"))))
    kept = F.array_sort(F.transform(F.slice(order, F.lit(1), F.ceil(F.size("all") * share).cast("int")), lambda x: x.s))
    best = ranks.select("doc", "all", kept.alias("kept")).select("doc", F.size("all").alias("n"), F.transform("kept", lambda s: F.get("all", s).text).alias("sentences"))
    short = cut.where((F.size("all") < least) & F.col("text").isNotNull()).select("doc", F.size("all").alias("n"), F.array("text").alias("sentences"))
    return best.unionByName(short)

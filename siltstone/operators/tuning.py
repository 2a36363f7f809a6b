"""The best of many settings by scores on questions: settings as rows, asked in rounds, out as soon as they can't win.

Every round asks a block of the questions to the settings that are left.  A setting leaves when even full marks on all questions to come
would leave it behind one that is sure of more, so the winner is that of the full grid, for fewer scores.  Scores that are known already aren't asked
for again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siltstone.sources.shared import Workspace


def race(ws: Workspace, settings: DataFrame, questions: DataFrame, score: Callable[[DataFrame, DataFrame], DataFrame], known: DataFrame | None = None, rounds: int = 4) -> tuple[DataFrame, DataFrame]:
    """(log, scores): log has (setting_id, hits, asked, most, left_in, best), and scores all (setting_id, question, hits) there are now.

    ``settings`` has setting_id and whatever ``score`` needs, ``questions`` has (question, most) and more; ``score`` gives (setting_id, question, hits) for all
    pairs of what it is given, with hits from 0 to most.  ``left_in`` is the round a setting left in, null for those that stayed; of equal
    scores the smallest setting_id is best.
    """
    dealt = ws.save(questions.withColumn("block", F.pmod(F.xxhash64("question"), F.lit(rounds))), "questions")
    total = dealt.agg(F.coalesce(F.sum("most"), F.lit(0))).first()[0]
    scores = ws.save(known.select("setting_id", "question", F.col("hits").cast("long").alias("hits")) if known is not None else settings.select("setting_id", F.lit(None).cast(dealt.schema["question"].dataType).alias("question"), F.lit(0).cast("long").alias("hits")).limit(0), "scores")
    live, out = ws.save(settings.select("setting_id").withColumn("left_in", F.lit(None).cast("int")), "live"), None
    for i in range(rounds):
        going = settings.join(live.where("left_in is null").select("setting_id"), "setting_id", "left_semi")
        block = dealt.where(F.col("block") == i)
        old = scores.join(block.select("question"), "question", "left_semi").join(going.select("setting_id"), "setting_id", "left_semi")
        # a question that any setting left hasn't been asked is asked to those that haven't
        asked = block.join(old.groupBy("question").agg(F.count("*").alias("n")), "question", "left")
        fresh = asked.where(F.coalesce("n", F.lit(0)) < going.count()).drop("n", "block")
        new = score(going, fresh).select("setting_id", "question", F.col("hits").cast("long").alias("hits")).join(old.select("setting_id", "question"), ["setting_id", "question"], "left_anti")
        scores = ws.save(scores.unionByName(new), "scores")
        sure = scores.join(dealt.where(F.col("block") <= i).select("question", "most"), "question").groupBy("setting_id").agg(F.sum("hits").alias("hits"), F.sum("most").alias("asked"))
        state = live.join(sure, "setting_id", "left").na.fill(0, ["hits", "asked"])
        top = state.where("left_in is null").agg(F.max("hits")).first()[0] or 0
        lost = F.col("left_in").isNull() & (F.col("hits") + total - F.col("asked") < top)
        out = ws.save(state.withColumn("left_in", F.when(lost, F.lit(i)).otherwise(F.col("left_in"))), "state")
        live = out.select("setting_id", "left_in")
    winner = out.where("left_in is null").orderBy(F.desc("hits"), "setting_id").select("setting_id").limit(1).withColumn("best", F.lit(True))
    log = out.join(winner, "setting_id", "left").select("setting_id", "hits", "asked", F.lit(total).alias("most"), "left_in", F.coalesce("best", F.lit(False)).alias("best"))
    return log, scores


def write_best(settings: DataFrame, log: DataFrame, path: str) -> None:
    """The best setting with its score as JSON."""
    settings.join(log.where("best").select("setting_id", "hits", "most"), "setting_id").coalesce(1).write.mode("overwrite").json(path)

"""A running publish is cancelled by its tag: it raises, its staging goes, the old index stays; other work isn't touched."""

import time

import pytest
from pyspark import InheritableThread
from pyspark.sql import functions as F

from siltstone.sources.cancel import Cancelled, cancel, cancellable
from siltstone.sources.index import Index


def test_a_running_publish(spark, tmp_path):
    index = Index(spark, str(tmp_path))
    first = index.publish({"rows": spark.range(3)}, "one")
    sleep = F.udf(lambda x: time.sleep(6) or x, "long")
    slow = spark.range(0, 8, 1, 8).select(sleep("id").alias("id"))
    raised = []

    def work():
        try:
            with cancellable(spark, "build-7"):
                index.publish({"quick": spark.range(5), "slow": slow}, "two")
        except Exception as error:
            raised.append(error)

    thread = InheritableThread(target=work)
    thread.start()
    deadline = time.time() + 60
    while time.time() < deadline and not any("slow" in str(p) for p in tmp_path.glob("generation-*/*")):
        time.sleep(0.1)
    assert not cancel(spark, "another")
    begun = time.time()
    while thread.is_alive() and time.time() < deadline:
        cancel(spark, "build-7")
        thread.join(0.2)
    assert not thread.is_alive() and time.time() - begun < 20 and isinstance(raised[0], Cancelled), raised
    assert [p.name for p in tmp_path.glob("generation-*")] == [f"generation-{first['generation']}"]
    assert index.manifest() == first and index.table("rows", "one").count() == 3
    assert spark.range(2).count() == 2


def test_other_errors_stay(spark):
    with pytest.raises(ValueError, match="own"), cancellable(spark, "t"):
        raise ValueError("own")
    assert "t" not in spark.sparkContext.getJobTags()

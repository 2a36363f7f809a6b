"""Cancelling: jobs of a piece of work carry its tag, and are interrupted by it from any other thread.

An interrupted ``Index.publish`` or ``CorpusIndex.build`` raises, removes what it wrote and leaves the published index as it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession


class Cancelled(RuntimeError):
    """The work was cancelled by its tag."""


@contextmanager
def cancellable(spark: SparkSession, tag: str) -> Iterator[None]:
    """Jobs started inside carry ``tag``; if they're interrupted by it, the error is ``Cancelled``."""
    spark.sparkContext.addJobTag(tag)
    try:
        yield
    except Exception as error:
        if "cancelled" in str(error).lower():
            raise Cancelled(tag) from error
        raise
    finally:
        spark.sparkContext.removeJobTag(tag)


def cancel(spark: SparkSession, tag: str) -> bool:
    """Interrupts the running jobs of ``tag``; whether any were seen.  Work is between two jobs now and then: ask again until it has ended."""
    context = spark.sparkContext
    running = list(context._jsc.sc().statusTracker().getJobIdsForTag(tag))
    active = set(context.statusTracker().getActiveJobsIds())
    context.cancelJobsWithTag(tag)
    return any(job in active for job in running)

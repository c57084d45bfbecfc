"""Matrix entries and log events as unbounded tables.

The batch operators that are plain aggregations run on streams as they are; what a stream
needs besides is a bound on state, which event time and a watermark give.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def running_totals(entries: DataFrame, axis: str = "i") -> DataFrame:
    """(axis, nnz, total, squares) kept up to date over a stream of V(i, j, x); complete or update mode."""
    return entries.groupBy(axis).agg(F.count("*").alias("nnz"), F.sum("x").alias("total"), F.sum(F.col("x") * F.col("x")).alias("squares"))


def windowed_counts(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Count and mean of a value by key and time window; rows more than ``late`` behind the newest are dropped, and windows close after that."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    win = F.window(time, width)
    return marked.groupBy(win.alias("win"), key).agg(F.count("*").alias("n"), F.avg(value).alias("mean")).select(F.col("win.start").alias("start"), key, "n", "mean")


def predicted(entries: DataFrame, w: DataFrame, h: DataFrame, rank: int) -> DataFrame:
    """Entries of a stream with their prediction and error under fixed factors: stream-static joins without state."""
    from ..functions.vectors import dot

    both = entries.join(w, "i").join(h, "j")
    return both.select("i", "j", "x", dot("w", "h", rank).alias("prediction")).withColumn("error", F.col("x") - F.col("prediction"))

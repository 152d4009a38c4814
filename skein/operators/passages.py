"""Passages: contiguous assistant segments merge, every other segment stands alone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(segments: DataFrame, session: str, order: list[str], kind: Column, text: str = "text") -> DataFrame:
    """``segments`` with ``kind`` and ``passage``, the number of the segment's passage in its session, from 1.

    Empty segments are dropped before runs are formed, so they do not close a run.
    """
    own = Window.partitionBy(session).orderBy(*order)
    rows = segments.withColumn("kind", kind).where(F.col(text) != "")
    starts = (F.col("kind") != "assistant") | F.coalesce(F.lag("kind").over(own) != "assistant", F.lit(True))
    return rows.withColumn("starts", starts.cast("long")).withColumn("passage", F.sum("starts").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("starts")


def bodies(rows: DataFrame, session: str, order: str, text: str = "text") -> DataFrame:
    """(session, passage, kind, events, body): the segments of each passage in order, joined by a line feed."""
    parts = F.array_sort(F.collect_list(F.struct(F.col(order).alias("at"), F.col(text).alias("text"))))
    return (
        rows.groupBy(session, "passage")
        .agg(F.min("kind").alias("kind"), F.count("*").alias("events"), parts.alias("parts"))
        .select(session, "passage", "kind", "events", F.array_join(F.transform("parts", lambda p: p["text"]), "\n").alias("body"))
    )

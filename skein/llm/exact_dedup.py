"""Exact deduplication against a persistent digest index (DataFrame operations only).

The index is a table bucketed and sorted by digest, one row for each distinct normalised text ever
accepted. A batch is aggregated to one row a digest before anything is shuffled by digest, the new
digests are found by a sort-merge anti-join that does not move the index, and they are appended to
the same buckets. ``dedup`` reads the texts once and never shuffles them; ``keep_first``, which returns
whole rows, moves each once.

Defined results
    null text          counts as empty; empty texts form one group
    null doc_id        sorts after every other id
    repeated rows      exactly one of the identical rows stays
    ties               most code points in the original text, then smallest doc_id
    very long texts    digested whole
    empty batch        empty result, index unchanged
    extra columns      ignored
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.llm.storage import Workspace

#: Deleted before texts are compared. The space and U+0009 to U+000D.
BLANKS = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    """``text`` without any blank; null counts as empty."""
    out = F.coalesce(text, F.lit(""))
    for blank in BLANKS:
        out = F.replace(out, F.lit(blank), F.lit(""))
    return out


class DigestIndex:
    """Digests of all accepted texts, in ``buckets`` files sorted by digest below ``path``.

    A later session opens the same ``path`` with the same ``buckets`` and goes on appending.
    ``buckets`` should give files of some hundred MB: 48 bytes a digest.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = 64) -> None:
        self.spark, self.path, self.buckets = spark, path, buckets
        self.table = "skein_digests_" + "".join(c if c.isalnum() else "_" for c in path)[-100:]
        spark.sql(
            f"CREATE TABLE IF NOT EXISTS {self.table} (digest BINARY, keep_id BIGINT, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
        )

    def rows(self) -> DataFrame:
        self.spark.catalog.refreshTable(self.table)
        return self.spark.table(self.table)

    def append(self, fresh: DataFrame) -> None:
        """Add rows of digests that the index does not hold. One task writes a bucket, so a bucket gains one file."""
        fresh.select("digest", "keep_id", "batch").repartition(self.buckets, "digest").write.insertInto(self.table)


def dedup(docs: DataFrame, index: DigestIndex, batch: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deduplicate ``docs`` within itself and against ``index``; append what is new.

    Returns one row per input row: doc_id, keep_id, group_size (rows of this batch with the same
    normalised text), kept, text_sha256, known (the index held the text before this batch).

    ``batch`` names the batch in the index; each call is a batch of its own. Only a caller that repeats
    a call that failed half-way gives the name of the first attempt, whose rows then count as new.
    """
    batch = batch or uuid.uuid4().hex
    work = Workspace(index.spark, "exact")
    text = F.col(text_col)
    keys = work.put(
        docs.select(
            F.col(id_col).cast("long").alias("doc_id"),
            F.unhex(F.sha2(normalised(text), 256)).alias("digest"),
            F.length(F.coalesce(text, F.lit(""))).alias("points"),
        ).withColumn("row", F.monotonically_increasing_id()),
        "keys",
    )
    rank = F.struct((-F.col("points")).alias("a"), F.col("doc_id").isNull().alias("b"), "doc_id", "row")
    groups = work.put(
        keys.groupBy("digest")
        .agg(F.count("*").alias("group_size"), F.min(rank).alias("best"))
        .select("digest", "group_size", F.col("best.doc_id").alias("keep_id"), F.col("best.row").alias("keep_row")),
        "groups",
    )
    known = index.rows().hint("merge")
    fresh = work.put(groups.join(known, "digest", "left_anti").withColumn("batch", F.lit(batch)), "fresh")
    index.append(fresh)
    accepted = index.rows().hint("merge").select("digest", F.col("keep_id").alias("index_id"), F.col("batch").alias("since"))
    decided = work.put(
        groups.join(accepted, "digest").select(
            "digest",
            "group_size",
            F.col("index_id").alias("keep_id"),
            F.when(F.col("since") == batch, F.col("keep_row")).alias("keep_row"),
        ),
        "decided",
    )
    # The few rows of `decided` meet the rows of a hot digest here; both sides are plain exchanges,
    # so that adaptive execution can split the hot one.
    return keys.join(decided.hint("merge"), "digest").select(
        "doc_id",
        "keep_id",
        "group_size",
        F.coalesce(F.col("row") == F.col("keep_row"), F.lit(False)).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
        F.col("keep_row").isNull().alias("known"),
    )


def keep_first(docs: DataFrame, index: DigestIndex, batch: str | None = None) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns.

    Each whole text moves once, to meet the (id, digest) pairs of the rows to drop. Only where rows share
    both are they told apart by their texts: the longest stays, of equal lengths the first in order.
    """
    work = Workspace(index.spark, "first")
    pairs = dedup(docs, index, batch).groupBy("doc_id", "text_sha256").agg(F.bool_or("kept").alias("stays"), F.count("*").alias("rows"))
    pairs = work.put(pairs.where("not stays or rows > 1").select(F.col("doc_id").alias("_skein_id"), F.col("text_sha256").alias("_skein_sum"), "stays"), "pairs")
    rows = docs.withColumn("_skein_digest", F.sha2(normalised(F.col("text")), 256))
    same = F.col("doc_id").cast("long").eqNullSafe(F.col("_skein_id")) & (F.col("_skein_digest") == F.col("_skein_sum"))
    if pairs.where("stays").isEmpty():
        return rows.join(pairs.hint("shuffle_hash"), same, "left_anti").select(*docs.columns)
    near = Window.partitionBy("doc_id", "_skein_digest").orderBy(F.length("text").desc(), "text")
    left = rows.join(pairs.hint("merge"), same, "left").where("coalesce(stays, true)")
    return left.withColumn("_skein_rank", F.row_number().over(near)).where("_skein_rank = 1").select(*docs.columns)

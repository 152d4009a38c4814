"""Operators of the incremental catalog, over any tables with the named columns."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def counts(member: DataFrame, tables: dict[str, DataFrame], key: str) -> DataFrame:
    """(name, n): for each table, its rows of members."""
    parts = [t.select(key).join(member.select(key), key, "left_semi").agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def delta(before: DataFrame, after: DataFrame) -> DataFrame:
    """Rows that came (sign 1) and went (sign -1)."""
    return after.subtract(before).withColumn("sign", F.lit(1)).unionByName(before.subtract(after).withColumn("sign", F.lit(-1)))


def delta_counts(change: DataFrame, tables: dict[str, DataFrame], key: str) -> DataFrame:
    """(name, n): by how much the counts of each table change; the cost follows the change, not the corpus."""
    total = F.coalesce(F.sum("sign"), F.lit(0)).cast("long").alias("n")
    parts = [t.select(key).join(change, key).agg(total).select(F.lit(name).alias("name"), "n") for name, t in tables.items()]
    return reduce(DataFrame.unionByName, parts)


def unique_targets(nodes: DataFrame, keys: list[str], identity: str) -> DataFrame:
    """The keys that name exactly one identity."""
    return nodes.groupBy(*keys).agg(F.min(identity).alias("low"), F.max(identity).alias("high")).where("low = high").select(*keys)


def resolution(relations: DataFrame, nodes: DataFrame, keys: list[str], identity: str) -> DataFrame:
    """(relations, resolved, unresolved): a relation resolves if its target names exactly one node."""
    marked = relations.join(unique_targets(nodes, keys, identity).withColumn("found", F.lit(True)), keys, "left")
    return marked.agg(
        F.count("*").alias("relations"), F.count_if(F.col("found").isNotNull()).alias("resolved"), F.count_if(F.col("found").isNull()).alias("unresolved")
    )


def tool_pairs(events: DataFrame, keys: list[str], is_call: Column, is_result: Column, at: str) -> DataFrame:
    """(keys, call, result): the keys with exactly one call and one result, in whichever order."""
    return (
        events.groupBy(*keys)
        .agg(
            F.count_if(is_call).alias("calls"),
            F.count_if(is_result).alias("results"),
            F.min(F.when(is_call, F.col(at))).alias("call"),
            F.min(F.when(is_result, F.col(at))).alias("result"),
        )
        .where("calls = 1 and results = 1")
        .drop("calls", "results")
    )


def unique_parents(records: DataFrame, identity: str, parent: Column, scope: str) -> DataFrame:
    """``records`` with ``parent_found``: the parent's identity if one record of the scope, not the record itself, bears it."""
    known = records.groupBy(scope, F.col(identity).alias("_parent")).agg(F.count("*").alias("_n")).where("_n = 1").drop("_n")
    asked = records.withColumn("_parent", parent).where(F.col("_parent").isNull() | (F.col("_parent") != F.col(identity)))
    own = records.withColumn("_parent", parent).where(F.col("_parent") == F.col(identity)).withColumn("_hit", F.lit(None).cast("boolean"))
    found = asked.join(known.withColumn("_hit", F.lit(True)), [scope, "_parent"], "left").unionByName(own)
    return found.withColumn("parent_found", F.when(F.col("_hit"), F.col("_parent"))).drop("_hit", "_parent")


def missing(rows: DataFrame, known: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose keys ``known`` does not have: orphans, dangling references, what is to be retained."""
    return rows.join(known.select(*keys), keys, "left_anti")


def unreclaimed(generations: DataFrame, rows: DataFrame, active: int) -> DataFrame:
    """(generation, state, rows): failed and superseded ``generations`` that still hold ``rows``; never the active one."""
    held = rows.groupBy("generation").agg(F.count("*").alias("rows"))
    return generations.where(F.col("state").isin("failed", "superseded") & (F.col("generation") != active)).join(held, "generation")


def tombstoned(rows: DataFrame, seen: DataFrame, key: str, when: Column, failed: bool = False) -> DataFrame:
    """``rows`` with ``disappeared_at`` set where it is null and the key was not seen; unchanged if any source failed."""
    if failed:
        return rows
    marked = rows.join(seen.select(key).distinct().withColumn("_seen", F.lit(True)), key, "left")
    gone = F.col("_seen").isNull() & F.col("disappeared_at").isNull()
    return marked.withColumn("disappeared_at", F.when(gone, when).otherwise(F.col("disappeared_at"))).drop("_seen")


def behind(listed: DataFrame, presented: DataFrame, key: str, revision: str) -> DataFrame:
    """(added, removed, changed) between what is listed now and what the catalog presents."""
    a, b = listed.select(key, F.col(revision).alias("_a"), F.lit(1).alias("_l")), presented.select(key, F.col(revision).alias("_b"), F.lit(1).alias("_p"))
    both = a.join(b, key, "full_outer")
    return both.agg(
        F.count_if(F.col("_p").isNull()).alias("added"),
        F.count_if(F.col("_l").isNull()).alias("removed"),
        F.count_if(F.col("_l").isNotNull() & F.col("_p").isNotNull() & ~F.col("_a").eqNullSafe(F.col("_b"))).alias("changed"),
    )


def change_kind(old: Column, new: Column, old_identity: Column | None = None, new_identity: Column | None = None) -> Column:
    """How the bytes of a container changed: the first that holds of initial, unchanged, replaced, grown, truncated, rewritten."""
    size_old, size_new = F.octet_length(old), F.octet_length(new)
    replaced = F.lit(False)
    if old_identity is not None:
        replaced = F.coalesce((old_identity != "") & (new_identity != "") & (old_identity != new_identity), F.lit(False))
    return (
        F.when(old.isNull(), "initial")
        .when(F.sha2(old, 256) == F.sha2(new, 256), "unchanged")
        .when(replaced, "replaced")
        .when((size_new > size_old) & (F.sha2(F.substring(new, F.lit(1), size_old), 256) == F.sha2(old, 256)), "grown")
        .when((size_new < size_old) & (F.sha2(F.substring(old, F.lit(1), size_new), 256) == F.sha2(new, 256)), "truncated")
        .otherwise("rewritten")
    )


def reuse(listed: DataFrame, checkpoints: DataFrame, derived: DataFrame) -> DataFrame:
    """(occurrence, action): ``reuse`` if the discovery revision is as before and derived rows exist, ``rebuild`` if only the former, else ``read``."""
    found = listed.join(checkpoints.select("occurrence", F.col("discovery").alias("_before"), "revision"), "occurrence", "left")
    found = found.join(derived.select("revision").distinct().withColumn("_built", F.lit(True)), "revision", "left")
    same = F.col("discovery") == F.col("_before")
    return found.select("occurrence", F.when(same & F.col("_built"), "reuse").when(same, "rebuild").otherwise("read").alias("action"))


def observed(known: DataFrame, seen: DataFrame, key: str, columns: list[str], now: Column) -> DataFrame:
    """Merge: new identities are inserted, seen ones get the new ``columns``, last_seen and no tombstone; first_seen stays."""
    b = seen.select(key, *[F.col(c).alias(f"_{c}") for c in columns], F.lit(True).alias("_seen"))
    both = known.join(b, key, "full_outer")
    return both.select(
        key,
        *[F.when(F.col("_seen"), F.col(f"_{c}")).otherwise(F.col(c)).alias(c) for c in columns],
        F.coalesce("first_seen", now).alias("first_seen"),
        F.when(F.col("_seen"), now).otherwise(F.col("last_seen")).alias("last_seen"),
        F.when(F.col("_seen"), F.lit(None)).otherwise(F.col("disappeared_at")).alias("disappeared_at"),
    )


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key, by ``order``; map-side combined, so a hot key costs one row a task."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")).select(key, "_last.*")


def facet_counts(docs: DataFrame, facets: list[tuple[str, str]]) -> DataFrame:
    """(namespace, key, value, n) for the given (namespace, column) pairs, in one pass over ``docs``."""
    pairs = F.array(*[F.struct(F.lit(n).alias("namespace"), F.lit(c).alias("key"), F.col(c).cast("string").alias("value")) for n, c in facets])
    return docs.select(F.explode(pairs).alias("f")).groupBy("f.namespace", "f.key", "f.value").agg(F.count("*").alias("n"))


def with_cached_embeddings(docs: DataFrame, cache: DataFrame) -> DataFrame:
    """``docs`` (space, content_hash) with the cached embedding and ``cached``; the rest is to be computed and appended."""
    held = cache.select("space", "content_hash", F.col("embedding").alias("_held"))
    return docs.join(held, ["space", "content_hash"], "left").withColumn("cached", F.col("_held").isNotNull()).withColumnRenamed("_held", "embedding")

"""Operators on single records and small listings: formats, identities, sources, validation, envelopes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skein.functions import identity

#: How long an observation of processes holds.
PRESENCE_TTL = "INTERVAL 1 MINUTE"
# The stores of a transcript directory that are never imported.
AUXILIARY = ("history.jsonl", "file-history", "sessions", "shell-snapshots", "session-env", "tasks")
#: Top-level directories that hold a harness's containers.
ROOTS = {"codex": ("sessions", "archived_sessions"), "claude": ("projects",)}


def format_time(at: Column) -> Column:
    """A timestamp in UTC by RFC 3339 with as many digits of a second as it needs; ``-`` for none."""
    digits = F.rtrim(F.lpad(F.pmod(F.unix_micros(at), F.lit(1_000_000)).cast("string"), 6, "0"), F.lit("0"))
    whole = F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss")
    return F.when(at.isNull(), "-").otherwise(F.concat(whole, F.when(digits == "", "").otherwise(F.concat(F.lit("."), digits)), F.lit("Z")))


def _quoted(value: Column) -> Column:
    escaped = F.replace(F.replace(value, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))
    return F.concat(F.lit('"'), escaped, F.lit('"'))


def format_locator(locator: Column) -> Column:
    """One line for a locator (kind, root, path, record, line, byte_start, byte_end, keys); a bare kind if it has no place."""
    at = lambda name: locator[name]
    number = lambda label, name: F.coalesce(F.concat(F.lit(f" {label}="), at(name).cast("string")), F.lit(""))
    span = F.coalesce(F.concat(F.lit(" bytes="), at("byte_start").cast("string"), F.lit("-"), at("byte_end").cast("string")), F.lit(""))
    keys = F.array_join(F.transform(F.coalesce(at("keys"), F.array().cast("array<struct<name:string,value:string>>")), lambda k: F.concat(F.lit(" "), k["name"], F.lit("="), _quoted(k["value"]))), "")
    file = F.concat(F.lit("file:root="), _quoted(at("root")), F.lit(" path="), _quoted(at("path")), number("record", "record"), number("line", "line"), span)
    database = F.concat(F.lit("database:path="), _quoted(at("path")), F.lit(" table="), _quoted(at("root")), keys)
    opaque = F.concat(F.lit("opaque:scheme="), _quoted(at("root")), F.lit(" value="), _quoted(at("path")))
    return F.coalesce(F.when(at("kind") == "file", file).when(at("kind") == "database", database).when(at("kind") == "opaque", opaque), at("kind"))


def flat_locator(kind: Column, file: Column, database: Column, opaque: Column) -> Column:
    """(kind, root, path): a table or a scheme stands where a file has its root."""
    root = F.coalesce(file["root"], database["table"], opaque["scheme"])
    path = F.coalesce(file["path"], database["path"], opaque["value"])
    return F.struct(kind.alias("kind"), root.alias("root"), path.alias("path"))


def relation_kind(native: Column) -> Column:
    """The relation that a native hint becomes; only a fork has another name here."""
    return F.when(native == "fork_parent", "branch_parent").otherwise(native)


def cache_name(source: Column) -> Column:
    """A file name that every platform takes."""
    return F.concat(F.regexp_replace(source, "[^A-Za-z0-9_-]", "-"), F.lit(".ndjson"))


def of_sources(rows: DataFrame, wanted: list[str], column: str = "source") -> DataFrame:
    """The rows of the ``wanted`` sources; all if none is given."""
    return rows.where(F.col(column).isin(wanted)) if wanted else rows


def matches_identity(primary: Column, agent: Column, header_session: Column, header_agent: Column) -> Column:
    """Whether a record's header names its container: the agent of an agent's transcript, else the session; an empty name fits all."""
    fits = lambda named, own: (F.coalesce(named, F.lit("")) == "") | (named == own)
    return F.when(F.coalesce(agent, F.lit("")) == "", fits(header_session, primary)).otherwise(fits(header_agent, agent))


def fork_parents(sessions: DataFrame) -> DataFrame:
    """``sessions`` (source, session, native_id, fork_of) with ``parent``: the one session of the source with that native id."""
    known = sessions.groupBy("source", F.col("native_id").alias("fork_of")).agg(F.min("session").alias("parent"), F.count("*").alias("n")).where("n = 1").drop("n")
    return sessions.join(known, ["source", "fork_of"], "left")


def first_seen(rows: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """(key, value, order): the distinct values of each key, with the place at which each came first."""
    return rows.where(F.col(value) != "").groupBy(key, value).agg(F.min(order).alias(order))


def registered(processes: DataFrame, registry: DataFrame) -> DataFrame:
    """``processes`` (pid, started_at) with ``native_id`` and ``reason``, by a registry of (pid, started_at, native_id).

    An entry counts if it is of the same second; one of another time is stale.
    """
    second = lambda c: F.date_trunc("SECOND", c)
    known = registry.select("pid", second(F.col("started_at")).alias("_since"), F.col("native_id").alias("_native"))
    both = processes.join(known, "pid", "left")
    fits = second(F.col("started_at")) == F.col("_since")
    reason = F.when(F.col("_since").isNull(), "no_session_identity").when(~fits, "stale_process_identity")
    return both.select("pid", "started_at", F.when(fits, F.col("_native")).alias("native_id"), reason.alias("reason"))


def expires(observed: Column) -> Column:
    return observed + F.expr(PRESENCE_TTL)


def first_failures(failures: DataFrame, order: str) -> DataFrame:
    """The first failure of each source: source, harness, reason."""
    return failures.groupBy("source").agg(F.min_by(F.struct("harness", "reason"), order).alias("_f")).select("source", "_f.harness", "_f.reason")


def unindexed(vectors: DataFrame, indexes: DataFrame, space: str = "space") -> DataFrame:
    """(space, dimensions) of the spaces in use that have no index."""
    used = vectors.select(space, F.size("embedding").alias("dimensions")).distinct()
    return used.join(indexes.select(space), space, "left_anti")


def sources(present: DataFrame, harness: str, home: str) -> DataFrame:
    """The sources of a home: (harness, kind, status, relative, source, diagnostics, rank), rank in listing order.

    ``present`` has the relative names of what the home holds. The canonical source is missing if it
    has none of its roots; auxiliary stores and journals are listed, and never read.
    """
    spark, roots = present.sparkSession, ROOTS[harness]
    names = present.select(F.split("relative", "/")[0].alias("top")).distinct()
    tops = names.where(F.col("top").isin(*roots)).agg(F.collect_set("top").alias("tops"))
    lost = F.filter(F.array(*[F.lit(r) for r in roots]), lambda r: ~F.array_contains("tops", r))
    note = F.transform(lost, lambda r: F.concat(F.lit(f"{harness}_{'projects' if harness == 'claude' else 'root'}_missing: "), r))
    status = F.when(F.size(lost) == len(roots), "missing").otherwise("available")
    id_ = identity.derived_id("source", harness, F.lit(home))
    rows = tops.select(F.lit("canonical").alias("kind"), status.alias("status"), F.lit(".").alias("relative"), id_.alias("source"), note.alias("diagnostics"))
    if harness == "claude":
        fixed = spark.createDataFrame([(x,) for x in AUXILIARY], "relative string")
        held = names.select(F.col("top").alias("relative"), F.lit(True).alias("_held"))
        stores = fixed.join(held, "relative", "left").select("relative", F.when(F.col("_held"), "disabled").otherwise("missing").alias("status"))
        journals = present.where(F.col("relative").rlike("^projects/[^/]+/[^/]+/subagents/workflows/[^/]+/journal\\.jsonl$")).select("relative", F.lit("disabled").alias("status"))
        own = identity.derived_id("source", harness, F.lit(home), F.col("relative"))
        others = stores.union(journals).select(F.lit("auxiliary").alias("kind"), "status", "relative", own.alias("source"), F.array(F.lit("claude_auxiliary_excluded")).alias("diagnostics"))
        rows = rows.unionByName(others)
    order = Window.partitionBy("harness").orderBy(F.when(F.col("kind") == "canonical", 0).otherwise(1), "source")
    return rows.withColumn("harness", F.lit(harness)).withColumn("rank", F.row_number().over(order))


def violations(rows: DataFrame, rules: dict[str, str], strict: bool = False) -> DataFrame:
    """``rows`` with ``violations``: the names of the rules (SQL conditions that must hold; null counts as broken) they break.

    In strict mode a broken rule is an error.
    """
    broken = F.array_compact(F.array(*[F.when(~F.coalesce(F.expr(sql), F.lit(False)), F.lit(name)) for name, sql in rules.items()]))
    if strict:
        broken = F.when(F.size(broken) > 0, F.raise_error(F.concat(F.lit("invalid record: "), F.array_join(broken, ", ")))).otherwise(broken)
    return rows.withColumn("violations", broken)


#: What must hold of an event: one kind and only what belongs to it.
EVENT_RULES = {
    "identity": "event <> '' AND observation <> '' AND session <> ''",
    "index": "event_index >= 0 AND record > 0",
    "kind": "kind IN ('message', 'reasoning', 'tool_call', 'tool_result', 'usage', 'facts', 'marker', 'unknown')",
    "role": "(kind = 'message') = (role IS NOT NULL)",
    "call": "kind NOT IN ('tool_call', 'tool_result') OR call_id <> ''",
    "name": "kind <> 'tool_call' OR name <> ''",
    "status": "kind <> 'tool_result' OR status IN ('success', 'error', 'running', 'pending', 'unknown')",
    "usage": "usage IS NULL OR (kind = 'usage' AND least(usage.input_tokens, usage.output_tokens, usage.total_tokens, 0) >= 0)",
    "facts": "(kind = 'facts') = (coalesce(size(facts), 0) > 0)",
    "blocks": "size(array_distinct(transform(coalesce(content, array()), b -> b.id))) = size(coalesce(content, array()))",
}


def envelope(rows: DataFrame, schema: str, producer: str, order: list[str]) -> DataFrame:
    """(document): one JSON document of all ``rows`` in order. It is one value: for results that fit a terminal or a file, not a corpus."""
    record = F.struct(*rows.columns)
    held = F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("at"), record.alias("record"))))
    body = F.struct(F.lit(schema).alias("schema"), F.lit(producer).alias("producer"), F.transform(held, lambda x: x["record"]).alias("records"))
    return rows.agg(F.to_json(body).alias("document"))

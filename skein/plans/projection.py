"""From normalised events to relations and searchable passages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import identity, text
from skein.operators import catalog, passages, records

PROJECTION_VERSION = "v1"
_RELATION = ["session", "relation", "kind", "origin", "from_kind", "from_ref", "to_kind", "to_ref", "observation"]


def _relation(rows: DataFrame, kind: str, origin: str, source: tuple[str, Column], target: tuple[str, Column], *evidence: Column) -> DataFrame:
    named = identity.derived_id("relation", F.col("occurrence"), kind, source[0], source[1], target[0], target[1], *evidence)
    return rows.select(
        "session", named.alias("relation"), F.lit(kind).alias("kind"), F.lit(origin).alias("origin"), F.lit(source[0]).alias("from_kind"),
        source[1].alias("from_ref"), F.lit(target[0]).alias("to_kind"), target[1].alias("to_ref"), evidence[0].alias("observation"),
    )


def tool_relations(events: DataFrame) -> DataFrame:
    """A relation for each call id with one call and one result in its session; the order does not matter."""
    calls, results = F.col("kind") == "tool_call", F.col("kind") == "tool_result"
    rows = events.where(calls | results).withColumn("node", F.struct("event", "observation"))
    pairs = catalog.tool_pairs(rows, ["session", "occurrence", "call_id"], calls, results, "node")
    return _relation(
        pairs, "tool_pair", "deterministic", ("event", F.col("call.event")), ("event", F.col("result.event")), F.col("call.observation"), F.col("result.observation")
    )


def reply_relations(events: DataFrame) -> DataFrame:
    """A relation to the record that ``parent_key`` names, if it names one of the session, and not the record itself."""
    rows = events.where("event_index = 0").select("session", "occurrence", "observation", "native_key", "parent_key")
    known = rows.where("native_key <> ''").groupBy("session", "native_key").agg(F.min("observation").alias("target"), F.count("*").alias("n")).where("n = 1")
    asked = rows.where("parent_key <> ''").drop("native_key").withColumnRenamed("parent_key", "native_key")
    found = asked.join(known.drop("n"), ["session", "native_key"]).where("target <> observation")
    return _relation(found, "reply_to", "native", ("observation", F.col("observation")), ("observation", F.col("target")), F.col("observation"))


def fork_relations(events: DataFrame) -> DataFrame:
    """A relation to the record of another transcript that a session was forked from."""
    rows = events.where("event_index = 0 and fork_key <> ''")
    return _relation(rows, "branch_parent", "native", ("session", F.col("session")), ("native_record", F.col("fork_key")), F.col("observation"))


def session_forks(sessions: DataFrame, events: DataFrame) -> DataFrame:
    """A relation to the session that a session's header says it was forked from, if its source has one session of that name.

    ``sessions`` has source, session, occurrence, native_id and fork_of; the header is the evidence.
    """
    parents = records.fork_parents(sessions.select("source", "session", "occurrence", "native_id", "fork_of")).where("parent is not null")
    heads = events.where("record = 1 and event_index = 0").select("session", "observation")
    return _relation(parents.join(heads, "session"), "branch_parent", "native", ("session", F.col("session")), ("session", F.col("parent")), F.col("observation"))


def relations(events: DataFrame) -> DataFrame:
    """All relations of ``events``, which also have their session's occurrence."""
    return tool_relations(events).unionByName(reply_relations(events)).unionByName(fork_relations(events)).select(*_RELATION)


def segments(events: DataFrame) -> DataFrame:
    """(session, order, event, kind, text, removed): the searchable texts in order, without U+0000, and the bytes lost."""
    rows = events.select("session", "record", "event_index", "event", F.posexplode("segments").alias("part", "s"))
    return rows.select(
        "session", F.struct("record", "event_index", "part").alias("order"), "event", F.col("s.kind").alias("kind"),
        text.without_nul(F.col("s.text")).alias("text"), text.removed_nul(F.col("s.text")).alias("removed"),
    )


def project(events: DataFrame, most: int = text.MAX_BODY_BYTES) -> DataFrame:
    """(session, passage, kind, events, part, parts, body, content_hash, removed): bodies of at most ``most`` bytes.

    ``removed`` counts the U+0000 of the whole passage.
    """
    rows = passages.islands(segments(events), "session", ["order"], F.col("kind"))
    made = passages.bodies(rows, "session", "order")
    lost = rows.groupBy("session", "passage").agg(F.sum("removed").alias("removed"), F.array_sort(F.collect_list(F.struct("order", "event"))).alias("at"))
    made = made.drop("events").join(lost, ["session", "passage"]).withColumn("events", F.transform("at", lambda x: x["event"])).drop("at")
    parts = text.split_bodies(made, most)
    return parts.withColumn("content_hash", identity.content_hash(PROJECTION_VERSION, F.col("kind"), F.col("part"), F.col("body")))

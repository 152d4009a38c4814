"""Sessions as the readers list them, and the records of one session, without a catalog."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.operators import presence, records
from skein.operators import sessions as listing
from skein.plans.store import READERS
from skein.sources import framing

COLUMNS = ["harness", "session", "native_id", "title", "started_at", "updated_at", "path", "relative"]
_RFC3339 = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d+)?(Z|[+-]\d{2}:\d{2})$"


def timestamp(raw: Column) -> Column:
    """An RFC 3339 time in microseconds; null if ``raw`` is not one."""
    return F.when(raw.rlike(_RFC3339), F.try_to_timestamp(raw))


def _records(spark: SparkSession, harness: str, home: str, path: str | None = None) -> DataFrame:
    """Records of a home, or of one container below it, with their session."""
    reader, files = READERS[harness], framing.containers(spark, path or home)
    found, framed = reader.discover(files, home), framing.records(files)
    named = reader.sessions(framed, found) if harness == "codex" else found.where("session is not null")
    return framed.where("record is not null").join(named.select("path", "relative", "native_id", "occurrence", "session"), "path").withColumn("harness", F.lit(harness))


def sessions(spark: SparkSession, homes: dict[str, str]) -> DataFrame:
    """All sessions, by ``COLUMNS``.

    started_at is the time of the first record; updated_at the last one in record order that can be
    parsed (a rollout log has none); the title is the last custom one, else the last automatic one.
    """
    parts = None
    for harness, home in sorted(homes.items()):
        field = lambda name: F.get_json_object(F.col("data").cast("string"), f"$.{name}")
        rows = _records(spark, harness, home).select("harness", "session", "native_id", "path", "relative", "record", timestamp(field("timestamp")).alias("at"),
                                                     field("type").alias("kind"), F.coalesce(field("customTitle"), field("aiTitle")).alias("name"))
        last = F.max_by("at", F.when(F.col("at").isNotNull(), F.col("record"))) if harness == "claude" else F.lit(None).cast("timestamp")
        heads = rows.groupBy("harness", "session", "native_id", "path", "relative").agg(
            F.min_by("at", F.when(F.col("record") == 1, F.col("record"))).alias("started_at"), last.alias("updated_at")
        )
        made = heads.join(listing.titles(rows, "session", "record", "kind", "name"), "session").select(*COLUMNS)
        parts = made if parts is None else parts.unionByName(made)
    return parts


def listed(spark: SparkSession, homes: dict[str, str], since: Column | None = None, until: Column | None = None) -> DataFrame:
    """``sessions`` with activity in the window, most recent first."""
    active = F.coalesce("updated_at", "started_at")
    rows = listing.activity_between(sessions(spark, homes), since, until, active).withColumn("activity", active)
    return listing.listed(rows, "activity", "harness", "session")


def read(spark: SparkSession, homes: dict[str, str], selector: str) -> DataFrame:
    """The events of the one session that ``selector`` names, in order."""
    found = listing.selected(sessions(spark, homes), selector, "session").limit(9).collect()
    if len(found) != 1:
        names = ", ".join(r.session for r in found[:8])
        raise LookupError(f"{selector} is ambiguous: {names}" if found else f"no session {selector}")
    harness = found[0].harness
    records = _records(spark, harness, homes[harness], found[0].path)
    return READERS[harness].events(records).orderBy("record", "event_index")


def sources(spark: SparkSession, homes: dict[str, str]) -> DataFrame:
    """The sources of all homes in listing order: by harness, canonical before auxiliary, by id."""
    parts = None
    for harness, home in sorted(homes.items()):
        relative = F.regexp_replace("path", "^.*?" + home.rstrip("/").replace(".", r"\.") + "/", "")
        rows = records.sources(framing.containers(spark, home).select(relative.alias("relative")), harness, home)
        parts = rows if parts is None else parts.unionByName(rows)
    return parts.orderBy("harness", "rank")


def current(spark: SparkSession, homes: dict[str, str], claims: DataFrame, exact_only: bool = False) -> DataFrame:
    """The listed sessions that a running process works on, by injected ``claims`` (see ``presence``), with its certainty."""
    known = sessions(spark, homes)
    found = presence.matches(claims, known.select("harness", "native_id", "session"), exact_only)
    chosen = found.select(F.explode(F.when(F.col("selected").isNotNull(), F.array("selected")).otherwise(F.col("candidates"))).alias("session"), "certainty", "processes")
    return known.join(chosen, "session")

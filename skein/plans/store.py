"""The incremental catalog: immutable Parquet batches, generations, and a pointer to the published one.

Layout below the root::

    tables/<name>/batch=<b>/   what one scan derived; never rewritten
    generation/<b>/member/     the session revisions that the generation of that scan presents
    generation/<b>/checkpoint/ what is known of each container as of then, broken ones included
    generation/<b>/identity/   every container ever seen: since when, until when, and whether it is gone
    pointer/<n>                names the batch of generation n; the greatest n counts
    lease                      the token of the one writer

A scan reads only containers whose discovery revision changed, appends what they derive as one
batch under a name of its own, writes the membership of the new generation, and publishes it by
creating its pointer file, which fails if there is one. A search pins the generation once; as files
never change, that is its snapshot. A scan that dies leaves a batch that no pointer names.

One writer at a time holds the lease and renews it at each step. A lease that was not renewed for
``LEASE`` seconds may be taken over; its former holder finds that out before it publishes, and as
batches have names of their own it can't have touched another writer's files.
"""

from __future__ import annotations

import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from types import ModuleType

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skein.functions import identity, stem
from skein.operators import catalog, search
from skein.plans import projection, state
from skein.sources import claude, codex, framing

READERS: dict[str, ModuleType] = {"codex": codex, "claude": claude}
BUILDERS = {"passage": "v1", "reader": "v1", "projection": projection.PROJECTION_VERSION}
#: Seconds after which a lease that was not renewed may be taken over.
LEASE = 3600
#: Tables that a scan derives, and what is known of a container after it.
DERIVED = ("event", "relation", "document", "trigram", "posting", "change")
CHECKPOINT = state.TABLES["checkpoint"][1] + ", batch long, error string"
IDENTITY = "occurrence string, harness string, path string, first_seen long, last_seen long, disappeared_at long"


class LeaseLost(RuntimeError):
    """Another writer holds the catalog."""


def numbered(rows: DataFrame, name: str, order: list[str], first: int, path: str) -> DataFrame:
    """``rows`` with dense numbers from ``first``, in the order of ``order``, as the long column ``name``.

    The rows are sorted in ranges and written to ``path``; only a count per range reaches the driver.
    """
    spark = rows.sparkSession
    low = (1 << 33) - 1
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = placed.withColumns({"_range": F.spark_partition_id(), "_at": F.monotonically_increasing_id().bitwiseAND(low)})
    placed.write.mode("overwrite").parquet(path)
    placed = spark.read.parquet(path)
    starts, at = [], first
    for r in placed.groupBy("_range").count().orderBy("_range").collect():
        starts.append((r["_range"], at))
        at += r["count"]
    if not starts:
        return placed.drop("_range", "_at").withColumn(name, F.lit(None).cast("long"))
    table = F.create_map(*[F.lit(x) for pair in starts for x in pair])
    return placed.withColumn(name, F.element_at(table, F.col("_range")) + F.col("_at")).drop("_range", "_at")


class Catalog:
    """A catalog below ``root``; a fresh one is created by the first scan."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    # --- files ------------------------------------------------------------------------------------

    def _fs(self, path: str):
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(f"{self.root}/{path}")
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()), where

    def _exists(self, path: str) -> bool:
        fs, where = self._fs(path)
        return fs.exists(where)

    def _text(self, path: str) -> str:
        """The content of a small file; empty if there is none."""
        fs, where = self._fs(path)
        if not fs.exists(where):
            return ""
        stream = fs.open(where)
        try:
            return bytes(stream.readNBytes(4096)).decode()
        finally:
            stream.close()

    def _create(self, path: str, text: str) -> bool:
        """Write a small file that must not exist yet; whether it did not."""
        fs, where = self._fs(path)
        try:
            stream = fs.create(where, False)
        except Exception as error:
            if fs.exists(where):
                return False
            raise error
        stream.write(bytearray(text.encode()))
        stream.close()
        return True

    def _names(self, path: str) -> list[str]:
        fs, where = self._fs(path)
        return sorted(x.getPath().getName() for x in fs.listStatus(where)) if fs.exists(where) else []

    def _delete(self, path: str) -> None:
        fs, where = self._fs(path)
        fs.delete(where, True)

    def _pointers(self) -> dict[int, int]:
        """Generation to batch, of what was published; a pointer that is still being written does not count."""
        found = {int(n): self._text(f"pointer/{n}") for n in self._names("pointer") if n.isdigit()}
        return {n: int(text) for n, text in found.items() if text}

    def generation(self) -> int:
        """The published generation; 0 before the first."""
        return max(self._pointers(), default=0)

    def generations(self) -> list[dict]:
        """number, batch and state of every generation: active, superseded, reclaimed, or failed (never published; no number)."""
        pointers, held = self._pointers(), {int(x) for x in self._names("generation")}
        last = max(pointers, default=0)
        out = [{"number": n, "batch": b, "state": "active" if n == last else "superseded" if b in held else "reclaimed"} for n, b in sorted(pointers.items())]
        return out + [{"number": None, "batch": b, "state": "failed"} for b in sorted(held - set(pointers.values()))]

    # --- the writer -------------------------------------------------------------------------------

    @contextmanager
    def writer(self) -> Iterator[str]:
        """Hold the lease; its token. An error if another writer has it and is alive."""
        token = uuid.uuid4().hex
        if not self._create("lease", token):
            fs, where = self._fs("lease")
            held = self._text("lease")
            if fs.exists(where) and time.time() - fs.getFileStatus(where).getModificationTime() / 1000 < LEASE:
                raise LeaseLost(f"another writer holds the catalog: {held}")
            self._delete("lease")
            if not self._create("lease", token):
                raise LeaseLost("another writer took the lease over")
        try:
            yield token
        finally:
            if self._text("lease") == token:
                self._delete("lease")

    def _renew(self, token: str) -> None:
        if self._text("lease") != token:
            raise LeaseLost("the lease was taken over")
        fs, where = self._fs("lease")
        fs.setTimes(where, int(time.time() * 1000), -1)

    def _publish(self, generation: int, batch: int, token: str) -> None:
        self._renew(token)
        if not self._create(f"pointer/{generation}", str(batch)):
            raise LeaseLost(f"generation {generation} was published by another writer")

    def table(self, name: str) -> DataFrame:
        """All batches of a table, with the column ``batch``."""
        return self.spark.read.parquet(f"{self.root}/tables/{name}")

    def members(self, generation: int) -> DataFrame:
        """(session, revision, batch) of a generation."""
        return self.spark.read.parquet(f"{self.root}/generation/{self._pointers()[generation]}/member")

    def identities(self, generation: int | None = None) -> DataFrame:
        """Every container ever seen, by ``IDENTITY``; times are in microseconds."""
        number = self.generation() if generation is None else generation
        if not number:
            return self.spark.createDataFrame([], IDENTITY)
        return self.spark.read.parquet(f"{self.root}/generation/{self._pointers()[number]}/identity")

    # --- scan -------------------------------------------------------------------------------------

    def _listed(self, homes: dict[str, str]) -> DataFrame:
        """(harness, path, occurrence, discovery) of all containers; no content is read."""
        parts = None
        for harness, home in sorted(homes.items()):
            found = READERS[harness].discover(framing.containers(self.spark, home), home)
            if harness == "claude":
                found = found.where("session is not null")
            stamp = [F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string")]
            rows = found.select(F.lit(harness).alias("harness"), "path", "occurrence", identity.derived_id("discovery", F.col("occurrence"), *stamp).alias("discovery"))
            parts = rows if parts is None else parts.unionByName(rows)
        return parts

    def _checkpoints(self, generation: int) -> DataFrame:
        if not generation:
            return self.spark.createDataFrame([], CHECKPOINT)
        return self.spark.read.parquet(f"{self.root}/generation/{self._pointers()[generation]}/checkpoint")

    def _retain(self, homes: dict[str, str], changed: DataFrame, before: int, batch: int) -> DataFrame:
        """Store the bytes of the changed containers once each; (occurrence, snapshot_hash, change_kind)."""
        now = None
        for harness, home in sorted(homes.items()):
            paths = [r.path for r in changed.where(F.col("harness") == harness).select("path").collect()]
            if paths:
                files = framing.containers(self.spark, *paths)
                rows = READERS[harness].discover(files, home).select("path", "occurrence").join(files.select("path", "content"), "path")
                now = rows if now is None else now.unionByName(rows)
        known = self.table("snapshot").drop("batch") if self._exists("tables/snapshot") else self.spark.createDataFrame([], state.TABLES["snapshot"][1])
        kinds = state.changes(self._checkpoints(before), known, now)
        self._derive("snapshot", batch, state.snapshots(now, known))
        return self._derive("change", batch, kinds)

    def _read(self, homes: dict[str, str], changed: DataFrame) -> DataFrame | None:
        """Normalised events of the changed containers, with occurrence, harness and revision.

        A container that cannot be framed has one row with its error.
        """
        out = None
        for harness, home in sorted(homes.items()):
            reader = READERS[harness]
            paths = [r.path for r in changed.where(F.col("harness") == harness).select("path").collect()]
            if not paths:
                continue
            found = reader.discover(framing.containers(self.spark, *paths), home)
            records = framing.records(framing.containers(self.spark, *paths))
            sessions = reader.sessions(records, found) if harness == "codex" else found
            named = records.where("record is not null").join(sessions.select("path", "session", "occurrence"), "path")
            events = reader.events(named).join(named.select("session", "occurrence", "revision").distinct(), "session")
            broken = records.where("error is not null").select("path", "error").join(found.select("path", "occurrence"), "path")
            events = events.unionByName(broken.select("occurrence", F.col("occurrence").alias("session"), "error"), allowMissingColumns=True)
            events = events.withColumn("harness", F.lit(harness))
            out = events if out is None else out.unionByName(events)
        return out

    def scan(self, homes: dict[str, str]) -> dict[str, int]:
        """Bring the catalog up to date with ``homes`` (harness to directory) and publish; returns counters.

        An unchanged container costs its membership row and its checkpoint, nothing else. One that cannot be
        framed or normalised is not presented, and not read again before it changes.
        """
        with self.writer() as token:
            return self._scan(homes, token)

    def _scan(self, homes: dict[str, str], token: str) -> dict[str, int]:
        before, batch = self.generation(), uuid.uuid4().int >> 65
        builder = ";".join(f"{k}={v}" for k, v in sorted(BUILDERS.items()))
        listed = self._listed(homes)
        known = self._checkpoints(before)
        same = known.where(F.col("builder") == builder).select("occurrence", "discovery", "session", "revision", "snapshot_hash", "batch", "error")
        reused = listed.join(same, ["occurrence", "discovery"])
        changed = catalog.missing(listed, same, ["occurrence", "discovery"])
        events = self._read(homes, changed)
        counters = {"reused": reused.where("error is null").count(), "read": 0, "rows": 0, "failed": 0}
        columns = ["occurrence", "discovery", "session", "revision", "snapshot_hash", "change_kind", "batch", "error"]
        members = reused.withColumn("change_kind", F.lit("unchanged")).select(*columns)
        if events is not None:
            events = self._derive("event", batch, events)
            self._renew(token)
            errors = events.where("error is not null").groupBy("occurrence").agg(F.min("error").alias("error"))
            broken = listed.join(errors, "occurrence").select("occurrence", "discovery", *[F.lit(None).cast(t).alias(c) for c, t in (("session", "string"), ("revision", "string"))],
                                                              F.lit(None).cast("string").alias("snapshot_hash"), F.lit("failed").alias("change_kind"), F.lit(None).cast("long").alias("batch"), "error")
            counters["failed"] = broken.count()
            events = catalog.missing(events, errors, ["occurrence"])
            fresh = events.groupBy("session").agg(F.first("occurrence").alias("occurrence"), F.first("revision").alias("revision"))
            fresh = fresh.join(listed.select("occurrence", "discovery"), "occurrence").withColumns({"batch": F.lit(batch).cast("long"), "error": F.lit(None).cast("string")})
            fresh = fresh.join(self._retain(homes, changed, before, batch), "occurrence")
            counters["rows"] = events.count() + self._derive("relation", batch, projection.relations(events)).count()
            bodies = projection.project(events).join(events.groupBy("session").agg(F.first("harness").alias("harness")), "session")
            bodies = bodies.withColumn("dl", F.size(stem.stems(F.col("body"))))
            last = self.table("document").agg(F.max("doc_id")).first()[0] if self._exists("tables/document") else 0
            documents = self._derive("document", batch, numbered(bodies, "doc_id", ["session", "passage", "part"], (last or 0) + 1, f"{self.root}/work/{uuid.uuid4().hex}"))
            counters["rows"] += documents.count()
            self._renew(token)
            # Sorted by what a search asks for, so that it reads few row groups.
            for name, index, key in (("trigram", search.trigram_index(documents), "trigram"), ("posting", search.postings(documents, terms=stem.stems).drop("dl"), "term")):
                self._derive(name, batch, index.repartitionByRange(key, "doc_id").sortWithinPartitions(key, "doc_id"))
            counters["read"] = fresh.count()
            members = members.unionByName(fresh.select(*columns)).unionByName(broken.select(*columns))
        self._renew(token)
        own = f"{self.root}/generation/{batch}"
        members.withColumn("builder", F.lit(builder)).write.parquet(f"{own}/checkpoint")
        members = self.spark.read.parquet(f"{own}/checkpoint").where("error is null")
        members.select("session", "revision", "batch").write.parquet(f"{own}/member")
        now = F.lit(int(time.time() * 1e6))
        seen = catalog.observed(self.identities(before), listed.select("occurrence", "harness", "path"), "occurrence", ["harness", "path"], now)
        catalog.tombstoned(seen, listed, "occurrence", now).select(*[x.split()[0] for x in IDENTITY.split(", ")]).write.parquet(f"{own}/identity")
        self._publish(before + 1, batch, token)
        self._delete("work")
        return counters

    def _derive(self, name: str, batch: int, rows: DataFrame) -> DataFrame:
        """Write the rows of a table for this batch; they as read back."""
        path = f"{self.root}/tables/{name}/batch={batch}"
        rows.write.parquet(path)
        return self.spark.read.schema(rows.schema).parquet(path)

    def reclaim(self) -> list[int]:
        """Remove superseded and failed generations and the batches and snapshots that the active one does not name; numbers of the former.

        The published generation is never touched, so no search that starts later can miss a row. It
        holds the lease, so it never runs beside a scan, whose batch is not named yet.
        """
        with self.writer():
            rows = self.generations()
            active = next((r for r in rows if r["state"] == "active"), None)
            if active is None:
                return []
            named = {r.batch for r in self.members(active["number"]).select("batch").distinct().collect()}
            for r in rows:
                if r["state"] in ("superseded", "failed"):
                    self._delete(f"generation/{r['batch']}")
            for table in DERIVED:
                for name in self._names(f"tables/{table}"):
                    if name.startswith("batch=") and int(name.partition("=")[2]) not in named:
                        self._delete(f"tables/{table}/{name}")
            self._sweep_snapshots()
            return [r["number"] for r in rows if r["state"] == "superseded"]

    def _sweep_snapshots(self) -> None:
        """Drop the batches of retained bytes none of which the active generation needs."""
        if not self._exists("tables/snapshot"):
            return
        needed = self._checkpoints(self.generation()).select(F.col("snapshot_hash").alias("content_hash")).where("content_hash is not null")
        held = self.table("snapshot").select("content_hash", "batch")
        live = {r.batch for r in held.join(needed, "content_hash", "left_semi").select("batch").distinct().collect()}
        for name in self._names("tables/snapshot"):
            if name.startswith("batch=") and int(name.partition("=")[2]) not in live:
                self._delete(f"tables/snapshot/{name}")

    # --- queries ----------------------------------------------------------------------------------

    def eligible(self, table: str, generation: int | None = None) -> DataFrame:
        """The rows of a table that the generation (the published one) presents."""
        members = self.members(self.generation() if generation is None else generation)
        return self.table(table).join(members.select("session", "batch"), ["session", "batch"], "left_semi")

    def search(self, query: str, mode: str = "literal", k: int = search.DEFAULT_LIMIT, harness: str | None = None) -> DataFrame:
        """The k best passages: doc_id, score, rank, session, kind, body and the events behind it, by rank."""
        if mode not in ("literal", "lexical"):
            raise ValueError(f"unknown mode {mode}")
        number = self.generation()
        docs = self.eligible("document", number)
        if harness is not None:
            docs = docs.where(F.col("harness") == harness)
        if mode == "literal":
            rows = docs.select("doc_id", "body")
            found, _ = search.literal_by_trigrams(rows, self.table("trigram") if search.query_trigrams(query) else rows, query)
            hits = found.select("doc_id", F.lit(None).cast("double").alias("score")).orderBy("doc_id").limit(search.limit_or_default(k))
        else:
            hits = search.bm25_of_postings(self.table("posting"), docs.select("doc_id", "dl"), stem.query_stems(query), k)
        found = search.hydrate(hits, docs.select("doc_id", "session", "harness", "kind", "part", "parts", "body", "events", "removed"))
        near = Window.orderBy(F.col("score").asc_nulls_last(), "doc_id")
        return found.withColumn("rank", F.row_number().over(near)).orderBy("rank")

    def counts(self) -> dict[str, int]:
        """Rows of the published generation, and how its relations resolve."""
        out = {name: self.eligible(name).count() for name in ("event", "relation", "document")}
        return {"session": self.members(self.generation()).count(), **out, **self.resolution()}

    def resolution(self) -> dict[str, int]:
        """Relations whose target names exactly one node of the published generation."""
        events = self.eligible("event")
        nodes = [("event", "event"), ("observation", "observation"), ("native_record", "native_key"), ("session", "session")]
        targets = None
        for kind, ref in nodes:
            unique = events.where(F.col(ref) != "").select(F.lit(kind).alias("to_kind"), F.col(ref).alias("to_ref"), F.col("session" if ref == "session" else "observation").alias("of"))
            targets = unique if targets is None else targets.unionByName(unique)
        row = catalog.resolution(self.eligible("relation"), targets, ["to_kind", "to_ref"], "of").first()
        return {"resolved": row.resolved, "unresolved": row.unresolved}

    def changes(self) -> dict[str, int]:
        """How many containers of the published generation changed in which way when it was made."""
        return {r.change_kind: r["count"] for r in self._checkpoints(self.generation()).groupBy("change_kind").count().collect()}

    def export(self, path: str) -> dict[str, int]:
        """Write the retained evidence of the published generation as a state stream to a new local file."""
        checkpoints = self._checkpoints(self.generation()).where("error is null").drop("batch", "error")
        held = self.table("snapshot").drop("batch").join(checkpoints.select(F.col("snapshot_hash").alias("content_hash")), "content_hash", "left_semi")
        return state.export({"snapshot": held, "checkpoint": checkpoints}, path)

    def import_state(self, path: str) -> None:
        """Take the snapshots of a state stream into an empty catalog; what they derive comes with the next scan."""
        if self.generation() or self._exists("tables/snapshot"):
            raise RuntimeError("the catalog is not empty")
        found = state.load(self.spark, path)
        found["checkpoint"].write.mode("overwrite").parquet(f"{self.root}/tables/imported/batch=0")
        found["snapshot"].write.mode("overwrite").parquet(f"{self.root}/tables/snapshot/batch=0")

    def doctor(self) -> list[dict[str, str]]:
        """Ordered checks of the catalog: name, status (ok, warning or error) and what was found."""
        out: list[dict[str, str]] = []

        def report(check: str, good: bool, detail: str, otherwise: str = "error") -> bool:
            out.append({"check": check, "status": "ok" if good else otherwise, "detail": detail})
            return good

        rows = self.generations()
        active = next((r for r in rows if r["state"] == "active"), None)
        if not report("published", active is not None, f"generation {active['number']}" if active else "no generation is published", "warning"):
            return out
        lease = self._text("lease")
        report("lease", not lease, f"held by {lease}" if lease else "free", "warning")
        waste = [r for r in rows if r["state"] in ("superseded", "failed")]
        report("reclaimed", not waste, f"{len(waste)} generations hold rows that nothing presents", "warning")
        members = self.members(active["number"])
        named = {r.batch for r in members.select("batch").distinct().collect()}
        for table in DERIVED:
            held = {int(x.partition("=")[2]) for x in self._names(f"tables/{table}") if x.startswith("batch=")}
            report(f"table {table}", named <= held, f"{len(named - held)} batches are missing")
        if named:
            events, documents = self.eligible("event"), self.eligible("document")
            lost = catalog.missing(members, events, ["session", "batch"]).count()
            report("sessions", not lost, f"{lost} sessions have no event")
            bare = catalog.missing(documents, members, ["session", "batch"]).count()
            report("documents", not bare, f"{bare} documents have no session")
            twice = documents.groupBy("doc_id").count().where("count > 1").count()
            report("document ids", not twice, f"{twice} ids occur twice")
            needed = self._checkpoints(active["number"]).select(F.col("snapshot_hash").alias("content_hash")).where("content_hash is not null")
            held = self.table("snapshot").select("content_hash", "checksum", (F.sha2("data", 256) == F.col("checksum")).alias("good"))
            gone, damaged = catalog.missing(needed, held, ["content_hash"]).count(), held.where("not good").count()
            report("snapshots", not gone and not damaged, f"{gone} are missing, {damaged} are damaged")
        return out

    def behind(self, homes: dict[str, str]) -> dict[str, int]:
        """How many containers came, went or changed since the published generation."""
        return catalog.behind(self._listed(homes), self._checkpoints(self.generation()), "occurrence", "discovery").first().asDict()

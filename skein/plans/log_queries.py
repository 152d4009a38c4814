"""Registered queries over session logs, which are made here of the conversations, and their SQL.

Each conversation becomes one container in either harness's format. Texts stand in it as hex digits, so
that Spark and the checking SQL write the same bytes; the expressions that write a line are shared.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.functions import identity
from skein.operators import catalog, presence, records
from skein.plans import projection, state
from skein.plans.registry import query, table
from skein.sources import claude, codex, framing, rawjson

HOME = "/logs"
_UUID = "'20000000-0000-4000-8000-' || lpad(cast(conv_id AS STRING), 12, '0')"
_CODEX_PATH = f"'sessions/2026/03/05/rollout-2026-03-05T10-11-12-' || {_UUID} || '.jsonl'"
_CLAUDE_PATH = f"'projects/-w/' || {_UUID} || '.jsonl'"
_END = "CASE WHEN conv_id % 2 = 1 THEN chr(13) || chr(10) ELSE chr(10) END"
#: An unterminated record at the end of some containers.
_TAIL = """CASE WHEN conv_id % 3 = 0 THEN '{"type":' ELSE '' END"""
_TURN = "cast(turn AS STRING)"
_CALLS = "role = 'assistant' AND turn % 4 < 2"
_RESULT = "role = 'user' AND turn % 4 >= 2"
_CODEX_HEAD = f"""'{{"type":"session_meta","timestamp":"2026-03-05T10:11:12Z","payload":{{"id":"' || {_UUID} || '","cwd":"/w"}}}}'"""
_CODEX_LINE = f"""CASE
    WHEN role = 'system' THEN '{{"type":"response_item","payload":{{"type":"message","role":"system","content":"' || hex(text) || '"}}}}'
    WHEN {_CALLS} THEN '{{"type":"response_item","payload":{{"type":"function_call","call_id":"c' || {_TURN} || '","name":"run","arguments":"' || {_TURN} || '"}}}}'
    WHEN {_RESULT} THEN '{{"type":"response_item","payload":{{"type":"function_call_output","call_id":"c' || cast(turn - 1 AS STRING) || '","output":"' || hex(text) || '"}}}}'
    WHEN role = 'user' THEN '{{"type":"response_item","payload":{{"type":"message","role":"user","content":[{{"type":"input_text","text":"' || hex(text) || '"}}]}}}}'
    ELSE '{{"type":"event_msg","payload":{{"type":"agent_message","message":"' || hex(text) || '"}}}}' END"""
_NAMES = f"""'"uuid":"u' || {_TURN} || '","parentUuid":"u' || cast(turn - 1 AS STRING) || '"'"""
_CLAUDE_LINE = f"""CASE
    WHEN role = 'system' THEN '{{"type":"system","subtype":"turn_duration",' || {_NAMES} || ',"content":"' || hex(text) || '"}}'
    WHEN role = 'user' THEN '{{"type":"user",' || {_NAMES} || ',"message":{{"role":"user","content":"' || hex(text) || '"}}}}'
    ELSE '{{"type":"assistant",' || {_NAMES} || ',"message":{{"role":"assistant","model":"m","usage":{{"input_tokens":' || cast(length(text) AS STRING)
        || ',"output_tokens":' || {_TURN} || '}},"content":[{{"type":"thinking","thinking":"t' || {_TURN} || '"}},{{"type":"text","text":"' || hex(text)
        || '"}},{{"type":"tool_use","id":"t' || {_TURN} || '","name":"ls","input":{{ "k" : 1.50 }}}}]}}}}' END"""


def _files(spark: SparkSession, sf_dir: str, path: str, line: str, head: str | None = None) -> DataFrame:
    """(path, length, modificationTime, content, conv_id): the containers."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", F.expr(f"{line} || {_END}").alias("line"))
    lines = F.array_sort(F.collect_list(F.struct("turn", "line")))
    rows = rows.groupBy("conv_id").agg(F.array_join(F.transform(lines, lambda x: x["line"]), "").alias("body"))
    content = F.concat(F.expr(f"{head} || {_END}") if head else F.lit(""), "body", F.expr(_TAIL)).cast("binary")
    rows = rows.select("conv_id", F.concat(F.lit(f"{HOME}/"), F.expr(path)).alias("path"), content.alias("content"))
    return rows.withColumns({"length": F.octet_length("content").cast("long"), "modificationTime": F.lit("2026-03-05").cast("timestamp")})


def _codex(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the rollout logs, with conv_id and occurrence."""
    files = _files(spark, sf_dir, _CODEX_PATH, _CODEX_LINE, _CODEX_HEAD)
    framed = framing.records(files)
    named = codex.sessions(framed, codex.discover(files, HOME)).select("path", "session", "occurrence")
    rows = framed.where("record is not null").join(named, "path")
    return codex.events(rows).join(named.join(files.select("path", "conv_id"), "path").drop("path"), "session")


def _claude(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of the transcripts, with conv_id and occurrence."""
    files = _files(spark, sf_dir, _CLAUDE_PATH, _CLAUDE_LINE)
    named = claude.discover(files, HOME).select("path", "session", "occurrence")
    rows = framing.records(files).where("record is not null").join(named, "path")
    return claude.events(rows).join(named.join(files.select("path", "conv_id"), "path").drop("path"), "session")


# --- the checking SQL -----------------------------------------------------------------------------


def _id(kind: str, *values: str) -> str:
    """SQL for a derived id."""
    framed = " || ".join(f"unhex(printf('%08x', octet_length(encode({v})))) || encode({v})" for v in (f"'{identity.ID_VERSION}'", f"'{kind}'", *values))
    return f"('{kind}:sha256:' || sha256({framed}))"


def _lines_sql(line: str, head: str | None) -> str:
    """CTE l: conv_id, record, data (without framing), line (with it), turn, role, text, of every complete record."""
    first = f"SELECT DISTINCT conv_id, CAST(NULL AS BIGINT) AS turn, NULL AS role, NULL AS text, {head} AS data FROM conversations UNION ALL " if head else ""
    return (
        f"r AS ({first}SELECT conv_id, turn, role, text, {line} AS data FROM conversations), "
        f"l AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) AS record, data || {_END} AS line FROM r)"
    )


def _named_sql(harness: str, path: str) -> str:
    """CTE n: conv_id, occurrence, session."""
    source = _id("source", f"'{harness}'", f"'{HOME}'")
    return (
        f"o AS (SELECT conv_id, {_UUID} AS native, {_id('occurrence', source, chr(39) + HOME + chr(39), path)} AS occurrence FROM (SELECT DISTINCT conv_id FROM conversations)), "
        f"n AS (SELECT conv_id, occurrence, {_id('session', 'occurrence', 'native')} AS session FROM o)"
    )


_CODEX_EVENTS = (
    f"WITH {_lines_sql(_CODEX_LINE, _CODEX_HEAD)}, {_named_sql('codex', _CODEX_PATH)}, "
    f"k AS (SELECT l.*, n.session, n.occurrence, {_id('observation', 'n.session', 'cast(l.record AS VARCHAR)', 'sha256(l.line)')} AS observation, "
    f"CASE WHEN turn IS NULL THEN 'facts' WHEN {_CALLS} THEN 'tool_call' WHEN {_RESULT} THEN 'tool_result' ELSE 'message' END AS kind FROM l JOIN n USING (conv_id)), "
    f"e AS (SELECT *, {_id('event', 'observation', chr(39) + '0' + chr(39), 'kind')} AS event, "
    "CASE kind WHEN 'tool_call' THEN 'c' || turn WHEN 'tool_result' THEN 'c' || (turn - 1) END AS call_id, "
    "CASE kind WHEN 'message' THEN role WHEN 'facts' THEN NULL ELSE kind END AS segment, "
    "CASE kind WHEN 'tool_call' THEN 'run' || chr(10) || turn WHEN 'facts' THEN NULL ELSE hex(text) END AS said FROM k) "
)


# --- framing and discovery ------------------------------------------------------------------------


@query(
    f"WITH {_lines_sql(_CODEX_LINE, _CODEX_HEAD)}, w AS (SELECT *, string_agg(line, '') OVER (PARTITION BY conv_id ORDER BY record) AS prefix, "
    f"string_agg(line, '') OVER (PARTITION BY conv_id) AS body FROM l) SELECT conv_id, record, sha256(line) AS sha256, sha256(prefix) AS prefix_sha256, "
    "strlen(prefix) - strlen(line) AS byte_start, strlen(prefix) - strlen(line) + strlen(data) AS byte_end, strlen(body) AS confirmed_end, "
    f"'sha256:' || sha256(body || {_TAIL}) AS revision, strlen(body || {_TAIL}) AS size, CASE WHEN {_TAIL} = '' THEN 'clean' ELSE 'pending' END AS tail, sha256(data) AS data_sha256 FROM w"
)
def framed_records(spark, sf_dir):
    files = _files(spark, sf_dir, _CODEX_PATH, _CODEX_LINE, _CODEX_HEAD)
    rows = framing.records(files).join(files.select("path", "conv_id"), "path").withColumn("data_sha256", F.sha2("data", 256))
    return rows.select("conv_id", "record", "sha256", "prefix_sha256", "byte_start", "byte_end", "confirmed_end", "revision", "size", "tail", "data_sha256")


@query(
    "SELECT doc_id, CASE WHEN end_ IS NULL THEN 'initial' WHEN octet_length(encode(text)) >= end_ AND known = sha256(array_slice(encode(text), 1, end_)) THEN 'continue' ELSE 'replay' END AS action "
    "FROM (SELECT doc_id, text, CASE doc_id % 4 WHEN 0 THEN NULL WHEN 3 THEN octet_length(encode(text)) + 1 ELSE octet_length(encode(text)) // 2 END AS end_, "
    "CASE WHEN doc_id % 4 = 2 THEN sha256('other') ELSE sha256(array_slice(encode(text), 1, octet_length(encode(text)) // 2)) END AS known FROM documents)"
)
def resume_actions(spark, sf_dir):
    now = table(spark, sf_dir, "documents").select("doc_id", F.col("doc_id").cast("string").alias("path"), F.col("text").cast("binary").alias("content"))
    size = F.octet_length("content")
    half = F.expr("octet_length(content) div 2").cast("int")
    end = F.when(F.expr("doc_id % 4 = 3"), size + 1).otherwise(half).cast("long")
    known = F.when(F.expr("doc_id % 4 = 2"), F.sha2(F.lit("other"), 256)).otherwise(F.sha2(F.substring("content", F.lit(1), half), 256))
    before = now.where("doc_id % 4 <> 0").select("path", end.alias("confirmed_end"), known.alias("prefix_sha256"))
    return framing.resume(before, now.select("path", "content")).select(F.col("path").cast("long").alias("doc_id"), "action")


_KINDS = f"""CASE conv_id % 6
    WHEN 0 THEN {_CODEX_PATH} WHEN 1 THEN {_CODEX_PATH} || '.zst'
    WHEN 2 THEN 'archived_sessions/rollout-2026-03-05T10-11-12-' || {_UUID} || '.jsonl'
    WHEN 3 THEN 'sessions/2026/02/30/rollout-2026-02-28T10-11-12-' || {_UUID} || '.jsonl'
    WHEN 4 THEN 'sessions/2026/03/05/rollout-2026-03-05T25-11-12-' || {_UUID} || '.jsonl'
    ELSE 'sessions/notes-' || {_UUID} || '.jsonl' END"""


@query(
    f"SELECT {_KINDS} AS relative, {_UUID} AS native_id, {_id('occurrence', _id('source', chr(39) + 'codex' + chr(39), chr(39) + HOME + chr(39)), chr(39) + HOME + chr(39), _KINDS)} AS occurrence "
    "FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 6 < 3"
)
def codex_discovery(spark, sf_dir):
    # Every container also has a compressed twin, which a plain one hides.
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    plain = ids.select(F.concat(F.lit(f"{HOME}/"), F.expr(_KINDS)).alias("path"))
    files = plain.union(plain.where("path not like '%.zst'").select(F.concat("path", F.lit(".zst")))).withColumns({"length": F.lit(1), "modificationTime": F.lit(None).cast("timestamp")})
    return codex.discover(files, HOME).select("relative", "native_id", "occurrence")


_AGENTS = f"""CASE conv_id % 5
    WHEN 0 THEN {_CLAUDE_PATH} WHEN 1 THEN 'projects/-w/' || {_UUID} || '/subagents/agent-a' || conv_id || '.jsonl'
    WHEN 2 THEN 'projects/-w/' || {_UUID} || '/subagents/workflows/f/journal.jsonl'
    WHEN 3 THEN 'projects/-w/' || {_UUID} || '/subagents/workflows/f/agent-b' || conv_id || '.jsonl' ELSE 'projects/-w/notes.jsonl' END"""


@query(
    f"SELECT relative, CASE conv_id % 5 WHEN 0 THEN 'primary' WHEN 2 THEN 'journal' ELSE 'agent' END AS kind, native_id, "
    f"CASE WHEN native_id IS NOT NULL THEN {_id('session', 'occurrence', 'native_id')} END AS session FROM (SELECT conv_id, {_AGENTS} AS relative, "
    f"CASE conv_id % 5 WHEN 0 THEN {_UUID} WHEN 1 THEN 'a' || conv_id WHEN 3 THEN 'b' || conv_id END AS native_id, "
    f"{_id('occurrence', _id('source', chr(39) + 'claude' + chr(39), chr(39) + HOME + chr(39)), chr(39) + HOME + chr(39), _AGENTS)} AS occurrence "
    "FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 5 < 4)"
)
def claude_discovery(spark, sf_dir):
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    files = ids.select(F.concat(F.lit(f"{HOME}/"), F.expr(_AGENTS)).alias("path"), F.lit(1).alias("length"), F.lit(None).cast("timestamp").alias("modificationTime"))
    return claude.discover(files, HOME).select("relative", "kind", "native_id", "session")


# --- normalisation --------------------------------------------------------------------------------


@query(
    _CODEX_EVENTS + "SELECT conv_id, record, observation, event, kind, CASE WHEN kind = 'message' THEN role END AS role, call_id, CASE WHEN kind = 'tool_call' THEN 'run' END AS name, "
    "CASE WHEN kind = 'tool_result' THEN 'success' END AS status, said, CASE kind WHEN 'tool_call' THEN cast(turn AS VARCHAR) WHEN 'tool_result' THEN hex(text) END AS payload, "
    "CASE WHEN kind = 'facts' THEN '/w' END AS directory FROM e"
)
def codex_events(spark, sf_dir):
    rows = _codex(spark, sf_dir).where("error is null")
    said, fact = F.get("segments", F.lit(0))["text"], F.get(F.filter("facts", lambda f: f["kind"] == "launch_directory"), F.lit(0))["value"]
    return rows.select(
        "conv_id", "record", "observation", "event", "kind", "role", "call_id", "name", "status", said.alias("said"), F.col("payload").cast("string").alias("payload"), fact.alias("directory")
    )


@query(
    f"WITH {_lines_sql(_CLAUDE_LINE, None)}, {_named_sql('claude', _CLAUDE_PATH)}, "
    f"k AS (SELECT l.*, {_id('observation', 'n.session', chr(39) + 'jsonl' + chr(39), 'cast(l.record AS VARCHAR)', 'sha256(l.line)')} AS observation FROM l JOIN n USING (conv_id)), "
    "e AS (SELECT *, unnest(CASE role WHEN 'system' THEN ['message', 'marker'] WHEN 'user' THEN ['message'] ELSE ['message', 'reasoning', 'tool_call', 'usage', 'facts'] END) AS kind, "
    "unnest(CASE role WHEN 'system' THEN [0, 1] WHEN 'user' THEN [0] ELSE [0, 1, 2, 3, 4] END) AS spot FROM k) "
    f"SELECT conv_id, record, spot AS event_index, kind, {_id('event', 'observation', 'cast(spot AS VARCHAR)', 'kind')} AS event, CASE WHEN kind = 'message' THEN role END AS role, "
    "'u' || turn AS native_key, 'u' || (turn - 1) AS parent_key, CASE kind WHEN 'message' THEN hex(text) WHEN 'reasoning' THEN 't' || turn WHEN 'tool_call' THEN 'ls' || chr(10) || '{ \"k\" : 1.50 }' END AS said, "
    "CASE WHEN kind = 'usage' THEN length(text) ELSE -1 END AS input_tokens, CASE WHEN kind = 'usage' THEN turn ELSE -1 END AS output_tokens, CASE WHEN kind = 'marker' THEN 'turn_duration' END AS marker FROM e"
)
def claude_events(spark, sf_dir):
    rows = _claude(spark, sf_dir).where("error is null")
    return rows.select(
        "conv_id", "record", "event_index", "kind", "event", "role", "native_key", "parent_key", F.get("segments", F.lit(0))["text"].alias("said"),
        F.coalesce("usage.input_tokens", F.lit(-1)).alias("input_tokens"), F.coalesce("usage.output_tokens", F.lit(-1)).alias("output_tokens"), "marker",
    )


@query("SELECT conv_id, sum(length(text))::BIGINT AS input_tokens, sum(turn)::BIGINT AS output_tokens, count(*) AS reports FROM conversations WHERE role = 'assistant' GROUP BY 1")
def log_usage(spark, sf_dir):
    rows = _claude(spark, sf_dir).where("kind = 'usage'").groupBy("conv_id")
    return rows.agg(F.sum("usage.input_tokens").alias("input_tokens"), F.sum("usage.output_tokens").alias("output_tokens"), F.count("*").alias("reports"))


@query("SELECT event_id, props AS raw, '[1.0,  2]' AS list FROM events")
def raw_members(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_id", F.concat(F.lit('{ "a" :'), "props", F.lit(' , "b":[1.0,  2], "a":'), "props", F.lit("}")).alias("text"))
    return rawjson.member_texts(rows, "text", ["a", "b"]).select("event_id", F.col("a").alias("raw"), F.col("b").alias("list"))


# --- projection -----------------------------------------------------------------------------------


@query(
    _CODEX_EVENTS + "SELECT c.conv_id, 'tool_pair' AS kind, 'deterministic' AS origin, c.event AS from_ref, r.event AS to_ref, "
    f"{_id('relation', 'c.occurrence', chr(39) + 'tool_pair' + chr(39), chr(39) + 'event' + chr(39), 'c.event', chr(39) + 'event' + chr(39), 'r.event', 'c.observation', 'r.observation')} AS relation "
    "FROM e c JOIN e r ON r.conv_id = c.conv_id AND r.call_id = c.call_id AND c.kind = 'tool_call' AND r.kind = 'tool_result'"
)
def log_tool_pairs(spark, sf_dir):
    events = _codex(spark, sf_dir)
    made = projection.relations(events).join(events.select("session", "conv_id").distinct(), "session")
    return made.select("conv_id", "kind", "origin", "from_ref", "to_ref", "relation")


@query("SELECT conv_id, 'reply_to' AS kind, turn + 1 AS record, turn AS parent FROM conversations WHERE turn > 0 AND (conv_id, turn - 1) IN (SELECT (conv_id, turn) FROM conversations)")
def log_replies(spark, sf_dir):
    events = _claude(spark, sf_dir)
    known = events.where("event_index = 0").select("observation", "conv_id", "record")
    made = projection.relations(events).where("kind = 'reply_to'").select("kind", "from_ref", "to_ref")
    made = made.join(known.withColumnRenamed("observation", "from_ref"), "from_ref")
    return made.join(known.select(F.col("observation").alias("to_ref"), F.col("record").alias("parent")), "to_ref").select("conv_id", "kind", "record", "parent")


@query(
    _CODEX_EVENTS + ", i AS (SELECT *, cast(segment <> 'assistant' OR coalesce(lag(segment) OVER w <> 'assistant', true) AS BIGINT) AS starts FROM e WHERE said <> '' WINDOW w AS (PARTITION BY conv_id ORDER BY record)), "
    "p AS (SELECT *, cast(sum(starts) OVER (PARTITION BY conv_id ORDER BY record) AS BIGINT) AS passage FROM i), "
    "b AS (SELECT conv_id, passage, min(segment) AS kind, string_agg(said, chr(10) ORDER BY record) AS body, count(*) AS events FROM p GROUP BY ALL) "
    "SELECT conv_id, passage, kind, events, body, 0 AS part, 1 AS parts, "
    "sha256(encode('v1') || unhex('00') || encode(kind) || unhex('00') || encode('0') || unhex('00') || encode(body)) AS content_hash, 0 AS removed FROM b"
)
def log_passages(spark, sf_dir):
    events = _codex(spark, sf_dir)
    made = projection.project(events).join(events.select("session", "conv_id").distinct(), "session")
    return made.select("conv_id", "passage", "kind", F.size("events").alias("events"), "body", "part", "parts", "content_hash", "removed")


# --- retained evidence ----------------------------------------------------------------------------


@query("SELECT sha256(text) AS content_hash, octet_length(encode(any_value(text))) AS size, sha256(any_value(text)) AS restored FROM documents GROUP BY 1")
def snapshot_round_trip(spark, sf_dir):
    held = state.snapshots(table(spark, sf_dir, "documents").select(F.col("text").cast("binary").alias("content")))
    back = state.contents(held).select("content_hash", F.sha2("content", 256).alias("restored"))
    return held.select("content_hash", "size").join(back, "content_hash")


@query(
    "SELECT row_number() OVER (ORDER BY number, key) AS position, name, key FROM (SELECT DISTINCT 0 AS number, 'snapshot' AS name, sha256(text) AS key FROM documents "
    "UNION ALL SELECT 1, 'checkpoint', 'o' || c_custkey FROM customer)"
)
def state_stream(spark, sf_dir):
    held = state.snapshots(table(spark, sf_dir, "documents").select(F.col("text").cast("binary").alias("content")))
    fields = [F.lit("x").alias(x) for x in ("discovery", "builder", "session", "revision", "snapshot_hash", "change_kind")]
    known = table(spark, sf_dir, "customer").select(F.concat(F.lit("o"), F.col("c_custkey").cast("string")).alias("occurrence"), *fields)
    return state.stream({"snapshot": held, "checkpoint": known}).select("position", "name", "key")


# --- presence -------------------------------------------------------------------------------------

_CLAIMS = """(SELECT event_id, 'codex' AS harness, event_id % 300 AS pid, event_type AS started_at, CASE WHEN event_id % 7 <> 0 THEN 'n' || cast(event_id % 150 AS STRING) END AS native_id,
    CASE WHEN value > 50 THEN 'exact' ELSE 'probable' END AS certainty, CASE WHEN value > 50 AND event_id % 3 = 0 THEN 's' || cast(event_id % 150 AS STRING) END AS exact_session FROM events)"""
_SESSIONS = """(SELECT 'codex' AS harness, 'n' || cast(conv_id AS STRING) AS native_id, 's' || cast(conv_id AS STRING) AS session FROM (SELECT DISTINCT conv_id FROM conversations)
    UNION ALL SELECT 'codex', 'n' || cast(conv_id AS STRING), 's' || cast(conv_id AS STRING) || 'b' FROM (SELECT DISTINCT conv_id FROM conversations) WHERE conv_id % 5 = 0)"""


def _claims(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    sources = {name: table(spark, sf_dir, name) for name in ("events", "conversations")}
    claims = spark.sql(f"SELECT * FROM {_CLAIMS.replace('FROM events', 'FROM {events}')}", events=sources["events"])
    sessions = spark.sql(f"SELECT * FROM {_SESSIONS.replace('FROM conversations', 'FROM {conversations}')}", conversations=sources["conversations"])
    return claims.withColumns({"evidence": F.array("started_at"), "reason": F.lit(None).cast("string")}), sessions


@query(
    f"WITH c AS {_CLAIMS}, s AS {_SESSIONS}, k AS (SELECT native_id, list(DISTINCT session ORDER BY session) AS candidates FROM s GROUP BY 1), "
    "g AS (SELECT native_id, CASE WHEN bool_or(certainty = 'exact') THEN 'exact' ELSE 'probable' END AS certainty, count(DISTINCT (pid, started_at)) AS processes, "
    "list(DISTINCT exact_session) FILTER (WHERE exact_session IS NOT NULL) AS named, array_to_string(list(DISTINCT started_at ORDER BY started_at), ',') AS evidence FROM c WHERE native_id IS NOT NULL GROUP BY 1) "
    "SELECT native_id, certainty, processes, array_to_string(candidates, ',') AS candidates, CASE WHEN len(named) = 1 THEN named[1] WHEN len(candidates) = 1 THEN candidates[1] END AS selected, evidence FROM g JOIN k USING (native_id)"
)
def presence_matches(spark, sf_dir):
    rows = presence.matches(*_claims(spark, sf_dir)).withColumns({"candidates": F.array_join("candidates", ","), "evidence": F.array_join("evidence", ",")})
    return rows.select("native_id", "certainty", "processes", "candidates", "selected", "evidence")


@query(
    f"WITH c AS {_CLAIMS}, s AS {_SESSIONS} SELECT pid, started_at, coalesce(array_to_string(list(DISTINCT native_id ORDER BY native_id) FILTER (WHERE native_id IS NOT NULL), ','), '') AS claimed, "
    "CASE WHEN count(native_id) > 0 THEN 'unmatched_native_identity' ELSE 'no_session_identity' END AS reason FROM c GROUP BY pid, started_at "
    "HAVING NOT bool_or(coalesce(native_id IN (SELECT native_id FROM s), false))"
)
def presence_unmatched(spark, sf_dir):
    rows = presence.unmatched(*_claims(spark, sf_dir))
    return rows.select("pid", "started_at", F.array_join("claimed", ",").alias("claimed"), "reason")


# --- records and listings -------------------------------------------------------------------------


@query(
    "SELECT event_id, CASE WHEN event_id % 10 = 0 THEN '-' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%S') || rtrim(rtrim(strftime(ts, '.%f'), '0'), '.') || 'Z' END AS at FROM events"
)
def time_format(spark, sf_dir):
    at = F.when(F.expr("event_id % 10 <> 0"), F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", records.format_time(at).alias("at"))


_LOCATED = "CASE page_id % 4 WHEN 0 THEN 'file' WHEN 1 THEN 'database' WHEN 2 THEN 'opaque' ELSE 'none' END"


@query(
    f"SELECT page_id, CASE {_LOCATED} WHEN 'file' THEN 'file:root=\"/r\" path=\"' || u || '\" record=' || page_id || CASE WHEN page_id % 8 = 0 THEN ' line=3 bytes=5-' || (page_id + 5) ELSE '' END "
    "WHEN 'database' THEN 'database:path=\"' || u || '\" table=\"/r\" k=\"' || page_id || '\"' WHEN 'opaque' THEN 'opaque:scheme=\"/r\" value=\"' || u || '\"' ELSE 'none' END AS locator "
    "FROM (SELECT page_id, replace(replace(url, '/', '\\\\'), '.', '\\\"') AS u FROM pages)"
)
def locator_format(spark, sf_dir):
    # Slashes and dots become characters that have to be escaped.
    path = F.replace(F.replace("url", F.lit("/"), F.lit("\\")), F.lit("."), F.lit('"'))
    eighth = F.expr("page_id % 8 = 0")
    keys = F.array(F.struct(F.lit("k").alias("name"), F.col("page_id").cast("string").alias("value")))
    fields = {
        "kind": F.expr(_LOCATED), "root": F.lit("/r"), "path": path, "record": F.col("page_id"), "line": F.when(eighth, 3), "byte_start": F.when(eighth, 5),
        "byte_end": F.when(eighth, F.col("page_id") + 5), "keys": keys,
    }
    located = F.struct(*[c.alias(n) for n, c in fields.items()])
    return table(spark, sf_dir, "pages").select("page_id", records.format_locator(located).alias("locator"))


@query(f"SELECT page_id, {_LOCATED} AS kind, CASE WHEN page_id % 4 < 3 THEN ['/r', 'table', 'scheme'][page_id % 4 + 1] ELSE '' END AS root, CASE WHEN page_id % 4 < 3 THEN url ELSE '' END AS path FROM pages")
def locator_flat(spark, sf_dir):
    variant = lambda k, root, path, name: F.when(F.expr(f"page_id % 4 = {k}"), F.struct(F.lit(name).alias(root), F.col("url").alias(path)))
    made = records.flat_locator(F.expr(_LOCATED), variant(0, "root", "path", "/r"), variant(1, "table", "path", "table"), variant(2, "scheme", "value", "scheme"))
    return table(spark, sf_dir, "pages").select("page_id", made.alias("l")).select("page_id", "l.kind", F.coalesce("l.root", F.lit("")).alias("root"), F.coalesce("l.path", F.lit("")).alias("path"))


@query("SELECT page_id, regexp_replace(url, '[^A-Za-z0-9_-]', '-', 'g') || '.ndjson' AS name FROM pages")
def cache_names(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", records.cache_name(F.col("url")).alias("name"))


@query("SELECT role, CASE role WHEN 'system' THEN 'branch_parent' ELSE role END AS kind, count(*) AS n FROM conversations GROUP BY ALL")
def relation_kinds(spark, sf_dir):
    native = F.when(F.col("role") == "system", "fork_parent").otherwise(F.col("role"))
    return table(spark, sf_dir, "conversations").groupBy("role", records.relation_kind(native).alias("kind")).agg(F.count("*").alias("n"))


@query(
    "WITH u AS (SELECT o_orderstatus AS s, o_custkey AS k, min(o_orderkey) AS parent FROM orders GROUP BY ALL HAVING count(*) = 1) "
    "SELECT o_orderkey AS session, coalesce(u.parent, -1) AS parent FROM orders LEFT JOIN u ON u.s = o_orderstatus AND u.k = o_custkey + 1"
)
def fork_parent_sessions(spark, sf_dir):
    rows = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("source"), F.col("o_orderkey").alias("session"), F.col("o_custkey").alias("native_id"), (F.col("o_custkey") + 1).alias("fork_of"))
    return records.fork_parents(rows).select("session", F.coalesce("parent", F.lit(-1)).alias("parent"))


@query("SELECT user_id, event_type AS parent, min(event_id) AS event_id FROM events WHERE event_type <> 'view' GROUP BY ALL")
def first_fork_parents(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("parent", F.when(F.col("event_type") == "view", "").otherwise(F.col("event_type")))
    return records.first_seen(rows, "user_id", "parent", "event_id")


@query("SELECT conv_id, arg_max(role, turn) AS role, max(turn) AS turn FROM conversations GROUP BY 1")
def active_leaf(spark, sf_dir):
    return catalog.latest(table(spark, sf_dir, "conversations").select("conv_id", "turn", "role"), "conv_id", ["turn"])


@query(
    "SELECT p.event_id AS pid, CASE WHEN r.pid IS NOT NULL AND r.since = date_trunc('second', p.ts) THEN r.native_id ELSE '' END AS native_id, "
    "CASE WHEN r.pid IS NULL THEN 'no_session_identity' WHEN r.since <> date_trunc('second', p.ts) THEN 'stale_process_identity' ELSE '' END AS reason FROM events p "
    "LEFT JOIN (SELECT event_id AS pid, 'n' || user_id AS native_id, date_trunc('second', CASE WHEN event_id % 3 = 1 THEN ts + INTERVAL 1 SECOND ELSE ts END) AS since FROM events WHERE event_type <> 'view') r ON r.pid = p.event_id"
)
def process_registry(spark, sf_dir):
    events = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    since = F.when(F.expr("event_id % 3 = 1"), F.col("ts") + F.expr("INTERVAL 1 SECOND")).otherwise(F.col("ts"))
    registry = events.where("event_type <> 'view'").select(F.col("event_id").alias("pid"), since.alias("started_at"), F.concat(F.lit("n"), F.col("user_id").cast("string")).alias("native_id"))
    found = records.registered(events.select(F.col("event_id").alias("pid"), F.col("ts").alias("started_at")), registry)
    return found.select("pid", F.coalesce("native_id", F.lit("")).alias("native_id"), F.coalesce("reason", F.lit("")).alias("reason"))


@query("SELECT event_id, epoch_us(ts + INTERVAL 1 MINUTE) AS until FROM events")
def presence_expiry(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", F.unix_micros(records.expires(F.col("ts").cast("timestamp"))).alias("until"))


@query("SELECT 'u' || user_id AS source, arg_min(event_type, event_id) AS harness, arg_min(props, event_id) AS reason FROM events WHERE event_type = 'error' GROUP BY user_id")
def source_failures(spark, sf_dir):
    rows = table(spark, sf_dir, "events").where("event_type = 'error'")
    rows = rows.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("source"), F.col("event_type").alias("harness"), F.col("props").alias("reason"), "event_id")
    return records.first_failures(rows, "event_id")


@query("SELECT DISTINCT label AS space, len(embedding) AS dimensions FROM embeddings WHERE label NOT IN (SELECT n_nationkey FROM nation WHERE n_nationkey % 2 = 0)")
def unindexed_spaces(spark, sf_dir):
    indexes = table(spark, sf_dir, "nation").where("n_nationkey % 2 = 0").select(F.col("n_nationkey").alias("space"))
    return records.unindexed(table(spark, sf_dir, "embeddings").withColumnRenamed("label", "space"), indexes)


_HELD = f"""CASE conv_id % 5 WHEN 0 THEN {_CLAUDE_PATH} WHEN 1 THEN 'history.jsonl' WHEN 2 THEN 'projects/-w/' || {_UUID} || '/subagents/workflows/f/journal.jsonl'
    WHEN 3 THEN 'tasks/' || conv_id ELSE 'sessions/' || conv_id END"""


@query(
    f"WITH p AS (SELECT DISTINCT {_HELD} AS relative FROM conversations), s AS (SELECT 'canonical' AS kind, 'available' AS status, '.' AS relative, "
    f"{_id('source', chr(39) + 'claude' + chr(39), chr(39) + HOME + chr(39))} AS source UNION ALL SELECT 'auxiliary', status, relative, "
    f"{_id('source', chr(39) + 'claude' + chr(39), chr(39) + HOME + chr(39), 'relative')} FROM (SELECT n AS relative, CASE WHEN EXISTS (SELECT 1 FROM p WHERE split_part(relative, '/', 1) = n) THEN 'disabled' ELSE 'missing' END AS status "
    f"FROM (SELECT unnest({list(records.AUXILIARY)!r}) AS n) UNION ALL SELECT relative, 'disabled' FROM p WHERE relative LIKE '%/journal.jsonl')) "
    "SELECT kind, status, relative, source, row_number() OVER (ORDER BY kind = 'auxiliary', source) AS rank FROM s"
)
def source_listing(spark, sf_dir):
    present = table(spark, sf_dir, "conversations").select(F.expr(_HELD).alias("relative")).distinct()
    return records.sources(present, "claude", HOME).select("kind", "status", "relative", "source", F.col("rank").cast("long").alias("rank"))


@query(
    _CODEX_EVENTS + "SELECT conv_id, record, CASE WHEN conv_id % 4 = 1 THEN 'kind,role' WHEN conv_id % 4 = 2 AND kind IN ('tool_call', 'tool_result') THEN 'call' ELSE '' END AS broken FROM e "
    "WHERE NOT (conv_id % 4 = 1 AND kind <> 'message') UNION ALL SELECT conv_id, record, CASE kind WHEN 'facts' THEN 'kind,facts' ELSE 'kind' END FROM e WHERE conv_id % 4 = 1 AND kind <> 'message'"
)
def event_violations(spark, sf_dir):
    # Some events are damaged on purpose.
    events = _codex(spark, sf_dir).withColumns({"kind": F.expr("CASE WHEN conv_id % 4 = 1 THEN 'novel' ELSE kind END"), "call_id": F.expr("CASE WHEN conv_id % 4 = 2 THEN '' ELSE call_id END")})
    return records.violations(events, records.EVENT_RULES).select("conv_id", "record", F.array_join("violations", ",").alias("broken"))


@query(
    "SELECT '{\"schema\":\"s/v1\",\"producer\":\"p\",\"records\":[' || string_agg('{\"name\":\"' || n_name || '\",\"key\":' || n_nationkey || '}', ',' ORDER BY n_nationkey) || ']}' AS document FROM nation"
)
def json_envelope(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").select(F.col("n_name").alias("name"), F.col("n_nationkey").alias("key"))
    return records.envelope(rows, "s/v1", "p", ["key"])


_FORK = f"""'{{"type":"session_meta","payload":{{"id":"' || {_UUID} || '","forked_from_id":"' || CASE WHEN conv_id % 3 = 1 THEN '20000000-0000-4000-8000-' || lpad(cast(conv_id - 1 AS STRING), 12, '0') ELSE 'gone' END || '"}}}}'"""


@query(
    f"WITH {_named_sql('codex', _CODEX_PATH)}, h AS (SELECT n.*, {_id('observation', 'session', chr(39) + '1' + chr(39), f'sha256({_FORK} || chr(10))')} AS observation FROM n) "
    f"SELECT c.session AS from_ref, p.session AS to_ref, {_id('relation', 'c.occurrence', chr(39) + 'branch_parent' + chr(39), chr(39) + 'session' + chr(39), 'c.session', chr(39) + 'session' + chr(39), 'p.session', 'c.observation')} AS relation "
    "FROM h c JOIN h p ON p.conv_id = c.conv_id - 1 WHERE c.conv_id % 3 = 1"
)
def session_forks(spark, sf_dir):
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    files = ids.select("conv_id", F.concat(F.lit(f"{HOME}/"), F.expr(_CODEX_PATH)).alias("path"), F.expr(f"{_FORK} || chr(10)").cast("binary").alias("content"))
    files = files.withColumns({"length": F.octet_length("content").cast("long"), "modificationTime": F.lit(None).cast("timestamp")})
    framed = framing.records(files)
    named = codex.sessions(framed, codex.discover(files, HOME))
    events = codex.events(framed.join(named.select("path", "session"), "path"))
    return projection.session_forks(named, events).select("from_ref", "to_ref", "relation")


_AGENT = f"'projects/-w/' || {_UUID} || '/subagents/agent-a' || cast(conv_id AS STRING) || '.jsonl'"
_SIDECAR = """CASE WHEN conv_id % 10 = 9 THEN '[1]' ELSE '{"agentType":"t","model":"m' || cast(conv_id AS STRING) || '","toolUseId":"","parentAgentId":"a' || cast(conv_id - 1 AS STRING) || '"}' END"""


@query(
    f"WITH o AS (SELECT conv_id, replace({_AGENT}, '.jsonl', '.meta.json') AS beside, {_SIDECAR} AS content, "
    f"{_id('occurrence', _id('source', chr(39) + 'claude' + chr(39), chr(39) + HOME + chr(39)), chr(39) + HOME + chr(39), _AGENT)} AS occurrence FROM (SELECT DISTINCT conv_id FROM conversations)), "
    f"s AS (SELECT *, {_id('session', 'occurrence', chr(39) + 'a' + chr(39) + ' || conv_id')} AS session FROM o WHERE conv_id % 4 <> 0) "
    f"SELECT session, beside AS relative, {_id('observation', 'session', chr(39) + 'meta' + chr(39), 'beside', 'sha256(content)')} AS observation, CASE WHEN conv_id % 10 = 9 THEN '' ELSE 'm' || conv_id END AS model, "
    "CASE WHEN conv_id % 10 = 9 THEN '' ELSE 'a' || (conv_id - 1) END AS parent_agent, CASE WHEN conv_id % 10 = 9 THEN 'not a JSON object' ELSE '' END AS error FROM s"
)
def sidecar_observations(spark, sf_dir):
    # A quarter of the agents has no metadata.
    ids = table(spark, sf_dir, "conversations").select("conv_id").distinct()
    blank = {"length": F.lit(1), "modificationTime": F.lit(None).cast("timestamp")}
    found = claude.discover(ids.select(F.concat(F.lit(f"{HOME}/"), F.expr(_AGENT)).alias("path")).withColumns(blank), HOME)
    beside = ids.where("conv_id % 4 <> 0").select(F.concat(F.lit(f"{HOME}/"), F.replace(F.expr(_AGENT), F.lit(".jsonl"), F.lit(".meta.json"))).alias("path"), F.expr(_SIDECAR).cast("binary").alias("content"))
    return claude.sidecars(beside, found, HOME).select("session", "relative", "observation", *[F.coalesce(c, F.lit("")).alias(c) for c in ("model", "parent_agent", "error")])


@query(
    "SELECT conv_id, turn, ref AS reference, CASE WHEN conv_id % 2 = 0 THEN 'external_payload' ELSE 'missing_external_payload' END AS limitation FROM "
    "(SELECT conv_id, turn, unnest(['out/' || conv_id || '.txt', '/abs/' || conv_id || '.txt']) AS ref FROM conversations WHERE role = 'user')"
)
def external_payloads(spark, sf_dir):
    turns = table(spark, sf_dir, "conversations").where("role = 'user'")
    line = """'{"type":"user","message":{"role":"user","content":[{"type":"tool_result","tool_use_id":"t","content":"x","persistedOutputPath":"out/' || cast(conv_id AS STRING)
        || '.txt"}]},"toolUseResult":{"persistedOutputPath":"/abs/' || cast(conv_id AS STRING) || '.txt"}}'"""
    named = F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    rows = turns.select(named.alias("session"), F.lit(1).cast("long").alias("record"), F.expr(line).cast("binary").alias("data"), F.lit("d").alias("sha256"))
    paths = F.array(F.concat(F.lit(f"{HOME}/out/"), F.col("conv_id").cast("string"), F.lit(".txt")), F.concat(F.lit("/abs/"), F.col("conv_id").cast("string"), F.lit(".txt")))
    present = turns.where("conv_id % 2 = 0").select(F.explode(paths).alias("path"))
    found = claude.payloads(claude.events(rows), present, HOME)
    of = F.split("session", "/")
    return found.select(of[0].cast("long").alias("conv_id"), of[1].cast("long").alias("turn"), "reference", "limitation")

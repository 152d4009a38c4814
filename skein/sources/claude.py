"""Project transcripts: several events per record, in a fixed order."""

from __future__ import annotations

import base64

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skein.functions import identity
from skein.sources import rawjson
from skein.sources.events import JSON, TEXT, USAGE, Event, derived_id, normalised
from skein.sources.rawjson import Member, boolean, integer, object_, string

# Record types and system subtypes that become a marker of that name.
OPERATIONAL = ("attachment", "queue-operation", "file-history-delta", "file-history-snapshot", "ai-title", "custom-title", "last-prompt", "mode")
SUBTYPES = ("local_command", "stop_hook_summary", "turn_duration", "hook_summary", "away_summary")
# Usage counters and their native names.
COUNTERS = {
    "input_tokens": "input_tokens", "output_tokens": "output_tokens", "cache_read_tokens": "cache_read_input_tokens",
    "cache_write_tokens": "cache_creation_input_tokens", "total_tokens": "total_tokens",
}

_UUID = r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
_PRIMARY = rf"^projects/[^/]+/({_UUID})\.jsonl$"
_AGENT = rf"^projects/[^/]+/({_UUID})/subagents/(?:workflows/[^/]+/)?agent-([^/]+)\.jsonl$"
_JOURNAL = rf"^projects/[^/]+/{_UUID}/subagents/workflows/[^/]+/journal\.jsonl$"


def discover(files: DataFrame, config: str) -> DataFrame:
    """(path, relative, kind, native_id, agent, source, occurrence, session, length, modificationTime) below ``config``.

    kind is primary, agent or journal; journals are auxiliary and have no session.
    """
    relative = F.regexp_replace(F.col("path"), "^.*?" + config.rstrip("/").replace(".", r"\.") + "/", "")
    rows = files.select("path", "length", "modificationTime", relative.alias("relative"))
    name = F.col("relative")
    kind = F.when(name.rlike(_PRIMARY), "primary").when(name.rlike(_AGENT), "agent").when(name.rlike(_JOURNAL), "journal")
    agent = F.when(kind == "agent", F.regexp_extract("relative", _AGENT, 2))
    rows = rows.withColumns({"kind": kind, "agent": agent}).where("kind is not null")
    rows = rows.withColumn("native_id", F.coalesce("agent", F.when(F.col("kind") == "primary", F.regexp_extract("relative", _PRIMARY, 1))))
    source = identity.derived_id("source", "claude", F.lit(config))
    rows = rows.withColumns({"source": source, "occurrence": identity.derived_id("occurrence", source, F.lit(config), F.col("relative"))})
    return rows.withColumn("session", F.when(F.col("native_id").isNotNull(), identity.derived_id("session", F.col("occurrence"), F.col("native_id"))))


def sidecars(files: DataFrame, found: DataFrame, config: str) -> DataFrame:
    """(session, observation, relative, agent_type, model, parent_agent, call_id, sha256): the metadata beside an agent's transcript.

    ``files`` has path and content. Such an observation comes before the records of its transcript; a
    sidecar that is not an object is an error of its row.
    """
    relative = F.regexp_replace("path", "^.*?" + config.rstrip("/").replace(".", r"\.") + "/", "")
    beside = files.select(relative.alias("beside"), "content").where(F.col("beside").endswith(".meta.json"))
    agents = found.where("kind = 'agent'").select("session", F.regexp_replace("relative", r"\.jsonl$", ".meta.json").alias("beside"))
    text, digest = F.col("content").cast("string"), F.sha2("content", 256)
    field = lambda name: F.nullif(F.get_json_object(text, f"$.{name}"), F.lit(""))
    whole = F.try_parse_json(text).isNotNull() & text.rlike(r"^\s*\{")
    return agents.join(beside, "beside").select(
        "session", identity.derived_id("observation", F.col("session"), "meta", F.col("beside"), digest).alias("observation"), F.col("beside").alias("relative"),
        field("agentType").alias("agent_type"), field("model").alias("model"), field("parentAgentId").alias("parent_agent"), field("toolUseId").alias("call_id"),
        digest.alias("sha256"), F.when(~F.coalesce(whole, F.lit(False)), "not a JSON object").alias("error"),
    )


def payloads(events: DataFrame, present: DataFrame, config: str) -> DataFrame:
    """(session, observation, reference, limitation): the payloads outside the transcripts, present or missing.

    ``present`` has the paths of the files that are there. A relative reference is one below ``config``.
    """
    rows = events.where(F.size("external") > 0).select("session", "observation", F.explode("external").alias("reference"))
    place = F.when(F.col("reference").startswith("/"), F.col("reference")).otherwise(F.concat(F.lit(config.rstrip("/") + "/"), "reference"))
    held = present.select(F.col("path").alias("place")).distinct().withColumn("held", F.lit(True))
    both = rows.withColumn("place", place).join(held, "place", "left")
    return both.select("session", "observation", "reference", F.when(F.col("held"), "external_payload").otherwise("missing_external_payload").alias("limitation"))


class _Record:
    """Builds the events of one record in order."""

    def __init__(self, session: str, record: int, digest: str, found: dict[str, Member]) -> None:
        self.observation = derived_id("observation", session, "jsonl", str(record), digest)
        self.found, self.events, self.diagnostics, self.external = found, [], [], []

    def add(self, kind: str, **fields) -> Event:
        event = Event(self.observation, len(self.events), kind)
        event.update(fields)
        self.events.append(event)
        return event

    def refer(self, member: Member | None) -> None:
        """Note the external payloads that an object or the elements of an array name."""
        if member is None or not isinstance(member.value, (dict, list)):
            return
        for value in [member.value] if isinstance(member.value, dict) else member.value:
            path = value.get("persistedOutputPath") if isinstance(value, dict) else None
            if path is not None and not isinstance(path, str):
                raise ValueError("persistedOutputPath must be a string")
            self.external += [path] if path else []

    def operational(self) -> None:
        """A system message for each thing that the record carries."""
        for name in ("content", "attachment", "hookAdditionalContext"):
            if name in self.found:
                member, event = self.found[name], self.add("message", role="system")
                if isinstance(member.value, str):
                    event.text(member.value)
                else:
                    event.opaque("system_content", member.raw.encode())

    def message(self, kind: str, compact: bool) -> None:
        message = object_(self.found, "message")
        if string(message, "role") != kind or "content" not in message or compact and kind != "user":
            raise ValueError("message role or content is invalid")
        event = self.add("message", role="system" if compact else kind)
        thoughts, calls, results = [], [], []
        content = message["content"]
        if isinstance(content.value, str):
            event.text(content.value)
        else:
            for number, member in enumerate(rawjson.elements(content.raw)):
                self.block(event, number, member, thoughts, calls, results)
        for text in thoughts:
            self.add("reasoning").text(text)
        for fields in calls:
            self.add("tool_call", **fields)
        for fields in results:
            self.add("tool_result", **fields)
        if kind == "assistant":
            self.usage(object_(message, "usage") if "usage" in message else object_(self.found, "usage"))
        if compact:
            self.add("marker", marker="compaction")
        self.refer(content)
        self.refer(self.found.get("toolUseResult"))

    def block(self, event: Event, number: int, member: Member, thoughts: list, calls: list, results: list) -> None:
        found = rawjson.members(member.raw)
        kind = string(found, "type")
        if not kind:
            raise ValueError("a content block requires type")
        if kind in ("text", "thinking"):
            text = string(found, kind)
            if text is None:
                raise ValueError(f"a {kind} block requires {kind}")
            thoughts.append(text) if kind == "thinking" else event.text(text, at=number)
        elif kind == "image":
            source = object_(found, "source")
            media_type, url = string(source, "media_type"), string(source, "url")
            how = string(source, "type")
            if not media_type or how not in ("base64", "url") or how == "url" and not url:
                raise ValueError("an image requires media_type and a base64 or url source")
            event.media(media_type, url, base64.b64decode(string(source, "data") or "", validate=True) if how == "base64" else None, at=number)
        else:
            event.opaque(kind, member.raw.encode(), at=number)
            if kind == "tool_use":
                if not string(found, "id") or not string(found, "name") or not isinstance(member.value, dict) or "input" not in member.value:
                    raise ValueError("tool_use requires id, name and input")
                given = found["input"].raw if "input" in found else "null"
                calls.append({"call_id": string(found, "id"), "name": string(found, "name"), "payload": given.encode(), "payload_type": JSON})
            elif kind == "tool_result":
                output = found.get("content")
                if not string(found, "tool_use_id") or output is None:
                    raise ValueError("tool_result requires tool_use_id and content")
                plain = isinstance(output.value, str)
                results.append(
                    {
                        "call_id": string(found, "tool_use_id"),
                        "status": "error" if boolean(found, "is_error") else "success",
                        "payload": (output.value if plain else output.raw).encode(),
                        "payload_type": TEXT if plain else JSON,
                    }
                )

    def usage(self, found: dict[str, Member]) -> None:
        usage = {name: integer(found, native) for name, native in COUNTERS.items()}
        if any(v is not None and v < 0 for v in usage.values()):
            raise ValueError("a usage counter is negative")
        if any(v is not None for v in usage.values()):
            self.add("usage", usage={u: usage.get(u) for u in USAGE})


def normalise(session: str, record: int, data: bytes, digest: str) -> tuple[dict, list[Event]]:
    """The events of one record."""
    found = rawjson.members(data.decode("utf-8", "replace"))
    kind = string(found, "type")
    if not kind:
        raise ValueError("record type is required")
    out = _Record(session, record, digest, found)
    if kind in ("user", "assistant"):
        out.message(kind, bool(boolean(found, "isCompactSummary")))
    elif kind == "system":
        subtype = string(found, "subtype")
        if not subtype:
            raise ValueError("system subtype is required")
        out.operational()
        if subtype == "compact_boundary" or subtype in SUBTYPES:
            out.add("marker", marker="compaction" if subtype == "compact_boundary" else subtype)
        else:
            out.add("unknown", native_type=f"system:{subtype}")
            out.diagnostics.append("claude_unknown_system_subtype")
    elif kind in OPERATIONAL:
        out.operational()
        out.add("marker", marker=kind)
    else:
        out.add("unknown", native_type=kind)
        out.diagnostics.append("claude_unknown_record_type")
    side = boolean(found, "isSidechain")
    if side is not None:
        out.add("marker", marker="sidechain", state=str(side).lower())
    model = string(found, "model") or (string(object_(found, "message"), "model") if kind in ("user", "assistant") else None)
    facts = [("working_directory", string(found, "cwd")), ("git_branch", string(found, "gitBranch")), ("model", model)]
    kept = [{"kind": k, "value": v} for k, v in facts if v]
    if kept:
        out.add("facts", facts=kept)
    if path := string(found, "persistedOutputPath"):
        out.external.append(path)
    shared = {
        "observation": out.observation,
        "native_kind": kind,
        "native_key": string(found, "uuid") or "",
        "parent_key": string(found, "parentUuid"),
        "fork_key": string(object_(found, "forkedFrom"), "messageUuid"),
        "timestamp_raw": string(found, "timestamp"),
        "diagnostics": out.diagnostics,
        "external": out.external,
    }
    return shared, out.events


def events(records: DataFrame) -> DataFrame:
    """Events of ``records`` (session, record, data, sha256)."""
    return normalised(records, normalise)

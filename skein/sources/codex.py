"""Rollout logs: one session per container, one event per record."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skein.functions import identity
from skein.sources import rawjson
from skein.sources.events import JSON, TEXT, Event, data_uri, derived_id, normalised
from skein.sources.rawjson import Member, integer, object_, string

Found = dict[str, Member]

# The native record kinds, by what they become.
CALLS = ("function_call", "custom_tool_call", "local_shell_call")
RESULTS = tuple(f"{c}_output" for c in CALLS)
OPERATIONS = ("exec_command", "patch_apply", "mcp_tool_call")
MARKERS = (
    "state", "compacted", "compaction", "context_compacted", "task_started", "task_complete",
    "turn_started", "turn_complete", "turn_aborted", "entered_review_mode", "exited_review_mode",
)
ROLES = {"user": "user", "assistant": "assistant", "agent": "assistant", "developer": "developer", "system": "system", "tool": "tool"}
STATUS = {
    "completed": "success", "success": "success", "failed": "error", "error": "error",
    "in_progress": "running", "running": "running", "pending": "pending", "incomplete": "pending",
}
# Text block types and the contexts in which they may stand.
TEXT_BLOCKS = {
    "input_text": ("message", "agent_message"), "output_text": ("message", "agent_message"),
    "reasoning_text": ("reasoning",), "text": ("reasoning",), "summary_text": ("reasoning_summary",),
}
MEDIA_BLOCKS = {"input_image": ("image_url", "image/*"), "input_audio": ("audio_url", "audio/*")}
# Facts of a metadata record after its directory, in order.
FACTS = [("model", "model"), ("provider", "model_provider"), ("effort", "effort"), ("approval_policy", "approval_policy")]
GIT_FACTS = [("git_root", "root"), ("git_remote", "repository_url"), ("git_branch", "branch"), ("git_commit", "commit_hash")]

_STAMP = r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])T(?:[01]\d|2[0-3])-[0-5]\d-[0-5]\d"
_UUID = r"[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}"
_PATH = rf"^(?:sessions/(\d{{4}}/\d{{2}}/\d{{2}})/|archived_sessions/)rollout-({_STAMP})-({_UUID})\.jsonl(\.zst)?$"


def discover(files: DataFrame, home: str) -> DataFrame:
    """(path, relative, native_id, source, occurrence, length, modificationTime) of the containers below ``home``.

    Directories must be calendar dates. A plain container hides its compressed twin.
    """
    relative = F.regexp_replace(F.col("path"), "^.*?" + home.rstrip("/").replace(".", r"\.") + "/", "")
    rows = files.select("path", "length", "modificationTime", relative.alias("relative"))
    part = lambda k: F.regexp_extract("relative", _PATH, k)
    dated = (part(1) == "") | F.try_to_timestamp(part(1), F.lit("yyyy/MM/dd")).isNotNull()
    clock = F.try_to_timestamp(part(2), F.lit("yyyy-MM-dd'T'HH-mm-ss")).isNotNull()
    rows = rows.where(F.col("relative").rlike(_PATH)).where(dated & clock).withColumn("native_id", F.lower(part(3)))
    plain = rows.where(~F.col("relative").endswith(".zst")).select(F.concat("relative", F.lit(".zst")).alias("relative"))
    source = identity.derived_id("source", "codex", F.lit(home))
    return rows.join(plain, "relative", "left_anti").withColumns({"source": source, "occurrence": identity.derived_id("occurrence", source, F.lit(home), F.col("relative"))})


def sessions(records: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with session, native_id of the header, started_at_raw and fork_of (the native id it was forked from, or null).

    Only containers whose first record names a session.
    """
    head = records.where("record = 1").select("path", F.col("data").cast("string").alias("head"))
    kind = F.coalesce(F.nullif(_text("$.type"), F.lit("")), F.nullif(_text("$.record_type"), F.lit("")), F.when(_text("$.id") != "", "session_meta"))
    native = F.coalesce(_text("$.payload.id"), _text("$.id"))
    fork = F.nullif(F.coalesce(_text("$.payload.forked_from_id"), _text("$.forked_from_id")), F.lit(""))
    rows = head.where((kind == "session_meta") & (native != "")).select("path", native.alias("id"), _text("$.timestamp").alias("started_at_raw"), fork.alias("fork_of"))
    joined = found.drop("native_id").join(rows, "path").withColumnRenamed("id", "native_id")
    return joined.withColumn("session", identity.derived_id("session", F.col("occurrence"), F.col("native_id")))


def _text(path: str) -> Column:
    return F.get_json_object("head", path)


def _required(found: Found, name: str, where: str) -> str:
    out = string(found, name)
    if not out:
        raise ValueError(f"{where} requires {name}")
    return out


def _kind(found: Found) -> str:
    return string(found, "type") or string(found, "record_type") or ("session_meta" if string(found, "id") else "")


def _blocks(event: Event, found: Found, name: str, context: str, plain: bool = False, optional: bool = False, summary: bool = False) -> None:
    """Add the content blocks of a member: an array of typed blocks, or a string where ``plain``."""
    if name not in found:
        if not optional:
            raise ValueError(f"{context}: {name} is required")
        return
    if plain and isinstance(found[name].value, str):
        event.text(found[name].value, summary=summary)
        return
    for member in rawjson.elements(found[name].raw):
        block = rawjson.members(member.raw)
        kind = _required(block, "type", "a content block")
        contexts = TEXT_BLOCKS.get(kind) or (("message",) if kind in MEDIA_BLOCKS else ("agent_message",) if kind == "encrypted_content" else None)
        if contexts is None:
            event.opaque(kind, member.raw.encode(), summary=summary)
            continue
        if context not in contexts:
            raise ValueError(f"content type {kind} is invalid in {context}")
        field = MEDIA_BLOCKS[kind][0] if kind in MEDIA_BLOCKS else "encrypted_content" if kind == "encrypted_content" else "text"
        value = string(block, field)
        if value is None:
            raise ValueError(f"{kind} requires {field}")
        if kind in MEDIA_BLOCKS:
            media_type, data = data_uri(value, MEDIA_BLOCKS[kind][1])
            event.media(media_type, value, data, summary=summary)
        elif kind == "encrypted_content":
            event.opaque(kind, value.encode(), TEXT, availability="encrypted", summary=summary)
        else:
            event.text(value, summary=summary)


def _metadata(new, outer: Found, inner: Found, kind: str, raw: str) -> Event:
    meta = object_(outer, "payload") if "payload" in outer else outer
    facts = [("launch_directory" if kind == "session_meta" else "working_directory", string(meta, "cwd"))]
    facts += [(fact, string(meta, name)) for fact, name in FACTS]
    policy = meta.get("sandbox_policy")
    facts.append(("sandbox_policy", policy and (policy.value if isinstance(policy.value, str) else policy.raw.strip())))
    facts += [("timezone", string(meta, "timezone")), ("current_date", string(meta, "current_date"))]
    git = object_(meta, "git")
    facts += [(fact, string(git, name)) for fact, name in GIT_FACTS]
    kept = [{"kind": k, "value": v} for k, v in facts if v]
    event = new("facts" if kept else "unknown")
    event.update({"facts": kept} if kept else {"native_type": kind})
    return event


def _message(new, outer: Found, inner: Found, kind: str, raw: str) -> Event:
    event = new("message")
    event["role"] = ROLES.get(_required(inner, "role", "message"), "unknown")
    _blocks(event, inner, "content", "message", plain=True)
    return event


def _spoken(new, outer: Found, inner: Found, kind: str, raw: str) -> Event:
    event = new("message")
    event["role"] = "user" if kind == "user_message" else "assistant"
    if outer is inner and "message" not in inner:
        _blocks(event, inner, "content", "agent_message")
        return event
    text = string(inner, "message")
    if text is None:
        raise ValueError("message is required")
    event.text(text)
    for name in ("images", "local_images"):
        for member in rawjson.elements(inner[name].raw) if name in inner else []:
            media_type, data = data_uri(member.value, "image/*")
            event.media(media_type, member.value, data)
    return event


def _reasoning(new, outer: Found, inner: Found, kind: str, raw: str) -> Event:
    event = new("reasoning")
    enclosed = outer is not inner and _kind(outer) == "response_item"
    _blocks(event, inner, "content", "reasoning", plain=True, optional="encrypted_content" in inner or "summary" in inner)
    hidden = string(inner, "encrypted_content")
    if hidden is not None:
        event.opaque("encrypted_reasoning", hidden.encode(), TEXT, availability="encrypted")
    _blocks(event, inner, "summary", "reasoning_summary", optional=not enclosed, summary=True)
    return event


def _thought(new, outer: Found, inner: Found, kind: str, raw: str) -> Event:
    event, text = new("reasoning"), string(inner, "text")
    if text is None:
        raise ValueError("agent_reasoning requires text")
    event.text(text)
    return event


def _call(new, outer: Found, inner: Found, kind: str, raw: str) -> Event:
    event = new("tool_call")
    if kind == "local_shell_call":
        event.update(call_id=string(inner, "call_id") or _required(inner, "id", kind), name="local_shell")
        action = inner.get("action")
        if action is None or not isinstance(action.value, dict):
            raise ValueError("local_shell_call action must be an object")
        event.put_payload(action.raw.encode(), JSON)
        return event
    event.update(call_id=_required(inner, "call_id", kind), name=_required(inner, "name", kind))
    field = "arguments" if kind == "function_call" else "input"
    given = string(inner, field)
    if given is None:
        raise ValueError(f"{kind} requires {field}")
    if kind == "function_call":
        rawjson.value(given)
    event.put_payload(given.encode(), JSON if kind == "function_call" else TEXT)
    return event


def _result(new, outer: Found, inner: Found, kind: str, raw: str) -> Event:
    event, output = new("tool_result"), inner.get("output")
    event.update(call_id=_required(inner, "call_id", kind), status="success")
    if output is None or not isinstance(output.value, (str, list)):
        raise ValueError(f"{kind} output must be a string or an array")
    event.put_payload(*((output.value.encode(), TEXT) if isinstance(output.value, str) else (output.raw.encode(), JSON)))
    return event


def _operation(new, outer: Found, inner: Found, kind: str, raw: str) -> Event:
    begins = kind.endswith("_begin")
    event = new("tool_call" if begins else "tool_result")
    event["call_id"] = _required(inner, "call_id", kind)
    event.put_payload(raw.encode(), JSON)
    code = integer(inner, "exit_code")
    if begins:
        event["name"] = kind.removesuffix("_begin")
    elif code is not None:
        event["status"] = "error" if code else "success"
    else:
        event["status"] = STATUS.get(string(inner, "status") or "", "unknown")
    return event


def _usage(new, outer: Found, inner: Found, kind: str, raw: str) -> Event:
    total = object_(object_(inner, "info"), "total_token_usage")
    reasoning = integer(total, "reasoning_output_tokens")
    usage = {
        "input_tokens": integer(total, "input_tokens"),
        "output_tokens": integer(total, "output_tokens"),
        "reasoning_tokens": reasoning if reasoning is not None else integer(total, "reasoning_tokens"),
        "cache_read_tokens": integer(total, "cached_input_tokens"),
        "total_tokens": integer(total, "total_tokens"),
    }
    if any(v is not None for v in usage.values()):
        event = new("usage")
        event["usage"] = usage
        return event
    if "rate_limits" not in inner:
        raise ValueError("token_count has no supported counters")
    event = new("unknown")
    event.update(native_type=kind, diagnostics=["codex_token_count_without_usage"])
    return event


def _marker(new, outer: Found, inner: Found, kind: str, raw: str) -> Event:
    event = new("marker")
    event["marker"] = kind
    return event


def _unknown(new, outer: Found, inner: Found, kind: str, raw: str) -> Event:
    event = new("unknown")
    event.update(native_type=kind, diagnostics=["codex_unknown_record_kind"])
    return event


HANDLERS = {
    "session_meta": _metadata, "turn_context": _metadata, "message": _message, "user_message": _spoken, "agent_message": _spoken,
    "reasoning": _reasoning, "agent_reasoning": _thought, "token_count": _usage,
    **dict.fromkeys(CALLS, _call), **dict.fromkeys(RESULTS, _result), **dict.fromkeys(MARKERS, _marker),
    **dict.fromkeys([f"{o}_{e}" for o in OPERATIONS for e in ("begin", "end")], _operation),
}


def normalise(session: str, record: int, data: bytes, digest: str) -> tuple[dict, list[Event]]:
    """The event of one record."""
    raw = data.decode("utf-8", "replace")
    outer = inner = rawjson.members(raw)
    native_kind = kind = _kind(outer)
    observation = derived_id("observation", session, str(record), digest)
    if kind in ("response_item", "event_msg"):
        if "payload" not in outer:
            raise ValueError(f"{kind} requires payload")
        raw = outer["payload"].raw
        inner = rawjson.members(raw)
        kind = _required(inner, "type", f"{kind} payload")
    if not kind:
        raise ValueError("record type is required")
    event = HANDLERS.get(kind, _unknown)(lambda k: Event(observation, 0, k), outer, inner, kind, raw)
    shared = {"observation": observation, "native_kind": native_kind, "timestamp_raw": string(outer, "timestamp"), "diagnostics": event.pop("diagnostics", [])}
    return shared, [event]


def events(records: DataFrame) -> DataFrame:
    """Events of ``records`` (session, record, data, sha256)."""
    return normalised(records, normalise)

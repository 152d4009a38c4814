"""Synthetic logs of either harness, from bytes to passages and relations."""

import hashlib
import json

import pytest

from skein.plans import projection
from skein.sources import claude, codex, framing
from skein.sources.events import derived_id

UUID = "20000000-0000-4000-8000-000000000001"
ROLLOUT = f"sessions/2026/03/05/rollout-2026-03-05T10-11-12-{UUID}.jsonl"


def wrap(kind, **payload):
    return {"type": kind, "timestamp": "2026-03-05T10:11:12.5Z", "payload": payload}


CODEX = [
    wrap("session_meta", id=UUID, cwd="/w", model_provider="p", git={"branch": "main"}),
    wrap("response_item", type="message", role="user", content=[{"type": "input_text", "text": "find\0 it"}, {"type": "input_image", "image_url": "data:image/png;base64,AAEC"}]),
    wrap("response_item", type="reasoning", content=None, encrypted_content="zz", summary=[{"type": "summary_text", "text": "think"}]),
    wrap("response_item", type="message", role="assistant", content=[{"type": "output_text", "text": "one"}]),
    wrap("event_msg", type="agent_message", message="two"),
    wrap("response_item", type="function_call_output", call_id="c1", output="done"),
    wrap("response_item", type="function_call", call_id="c1", name="run", arguments='{"a": 1}'),
    wrap("event_msg", type="exec_command_end", call_id="c2", exit_code=3),
    wrap("event_msg", type="token_count", info={"total_token_usage": {"input_tokens": 5, "reasoning_tokens": 2}}),
    wrap("event_msg", type="token_count", rate_limits={"x": 1}),
    wrap("event_msg", type="turn_complete"),
    {"type": "novel"},
]
BAD = [
    {"type": "response_item"}, wrap("response_item", type="message", content=[]), wrap("response_item", type="function_call", call_id="c", name="n", arguments="{"),
    wrap("response_item", type="message", role="user", content=[{"type": "summary_text", "text": "x"}]), wrap("event_msg", type="token_count"), {"type": 5}, {}, [1],
]


def lines(rows):
    return "".join(json.dumps(r) + "\n" for r in rows).encode()


def one(module, row):
    data = row if isinstance(row, bytes) else json.dumps(row).encode()
    return module.normalise("s", 1, data, "d")


def test_codex_records():
    kinds = [one(codex, r)[1][0] for r in CODEX]
    assert [e["kind"] for e in kinds] == ["facts", "message", "reasoning", "message", "message", "tool_result", "tool_call", "tool_result", "usage", "unknown", "marker", "unknown"]
    assert [(f["kind"], f["value"]) for f in kinds[0]["facts"]] == [("launch_directory", "/w"), ("provider", "p"), ("git_branch", "main")]
    assert [(b["kind"], b["availability"]) for b in kinds[1]["content"]] == [("text", "available"), ("media", "available")]
    assert kinds[1]["content"][1]["data"] == b"\0\1\2"
    assert [(b["kind"], b["availability"], b["summary"]) for b in kinds[2]["content"]] == [("opaque", "encrypted", False), ("text", "available", True)]
    assert kinds[6].segments() == [{"kind": "tool_call", "text": 'run\n{"a": 1}'}]
    assert kinds[7]["status"] == "error" and kinds[8]["usage"]["reasoning_tokens"] == 2
    assert one(codex, CODEX[9])[0]["diagnostics"] == ["codex_token_count_without_usage"]
    assert one(codex, CODEX[11])[0]["diagnostics"] == ["codex_unknown_record_kind"]
    observation = derived_id("observation", "s", "1", "d")
    assert kinds[10]["event"] == derived_id("event", observation, "0", "marker")


@pytest.mark.parametrize("row", BAD)
def test_codex_rejects(row):
    with pytest.raises(ValueError):
        one(codex, row)


def test_raw_payloads_are_kept():
    raw = b'{"type":"event_msg","payload":{ "type":"exec_command_begin" ,"call_id":"c","x":1.50}}'
    assert one(codex, raw)[1][0]["payload"] == b'{ "type":"exec_command_begin" ,"call_id":"c","x":1.50}'
    raw = b'{"type":"assistant","message":{"role":"assistant","content":[{"type":"tool_use","id":"a","name":"n","input":{ "k" : 1.0 }}]}}'
    assert one(claude, raw)[1][1]["payload"] == b'{ "k" : 1.0 }'


CLAUDE = [
    {"type": "user", "uuid": "u1", "sessionId": UUID, "cwd": "/w", "message": {"role": "user", "content": "hello"}},
    {"type": "assistant", "uuid": "u2", "parentUuid": "u1", "message": {"role": "assistant", "model": "m", "usage": {"input_tokens": 3}, "content": [
        {"type": "thinking", "thinking": "hm"}, {"type": "text", "text": "first"}, {"type": "tool_use", "id": "t1", "name": "ls", "input": {"p": 1}}]}},
    {"type": "user", "uuid": "u3", "parentUuid": "u2", "isSidechain": False, "message": {"role": "user", "content": [
        {"type": "tool_result", "tool_use_id": "t1", "is_error": True, "content": "failed", "persistedOutputPath": "out.txt"}]}},
    {"type": "user", "uuid": "u4", "parentUuid": "gone", "isCompactSummary": True, "message": {"role": "user", "content": "summary"}},
    {"type": "system", "subtype": "novel", "content": "note"},
    {"type": "custom-title", "customTitle": "T"},
    {"type": "strange", "forkedFrom": {"sessionId": "x", "messageUuid": "u9"}},
]


def test_claude_records():
    made = [one(claude, r) for r in CLAUDE]
    assert [[e["kind"] for e in events] for _, events in made] == [
        ["message", "facts"], ["message", "reasoning", "tool_call", "usage", "facts"], ["message", "tool_result", "marker"],
        ["message", "marker"], ["message", "unknown"], ["marker"], ["unknown"],
    ]
    assert made[2][1][1]["status"] == "error" and made[2][0]["external"] == ["out.txt"] and made[2][1][2]["state"] == "false"
    assert made[3][1][0]["role"] == "system" and made[3][1][1]["marker"] == "compaction"
    assert made[4][0]["diagnostics"] == ["claude_unknown_system_subtype"]
    for bad in ({"type": "user"}, {"type": "user", "message": {"role": "assistant", "content": ""}}, {"type": "system"}, {"type": "assistant", "message": {"role": "assistant", "content": [], "usage": {"input_tokens": -1}}}):
        with pytest.raises(ValueError):
            one(claude, bad)


def test_codex_end_to_end(spark, tmp_path):
    home = tmp_path / "codex"
    for name, content in {
        ROLLOUT: lines(CODEX),
        ROLLOUT + ".zst": b"hidden by the plain one",
        f"sessions/2026/02/30/rollout-2026-02-28T10-11-12-{UUID}.jsonl": lines(CODEX),
        f"sessions/2026/03/05/rollout-2026-03-05T25-11-12-{UUID}.jsonl": lines(CODEX),
        "sessions/2026/03/05/notes.jsonl": b"{}\n",
        f"archived_sessions/rollout-2026-03-04T00-00-00-{UUID[:-1]}2.jsonl": lines([{"id": "legacy"}, {"type": "message", "role": "user", "content": "old"}]),
    }.items():
        (home / name).parent.mkdir(parents=True, exist_ok=True)
        (home / name).write_bytes(content)
    files = framing.containers(spark, str(home))
    found = codex.discover(files, str(home))
    assert sorted(r.relative for r in found.collect()) == sorted([ROLLOUT, f"archived_sessions/rollout-2026-03-04T00-00-00-{UUID[:-1]}2.jsonl"])
    records = framing.records(files.join(found.select("path"), "path"))
    sessions = codex.sessions(records, found)
    first = next(r for r in sessions.collect() if r.relative == ROLLOUT)
    source = derived_id("source", "codex", str(home))
    occurrence = derived_id("occurrence", source, str(home), ROLLOUT)
    assert (first.native_id, first.session) == (UUID, derived_id("session", occurrence, UUID))
    events = codex.events(records.join(sessions.select("path", "session"), "path").where("record is not null")).join(sessions.select("session", "occurrence"), "session").cache()
    assert events.where("error is not null").count() == 0 and events.count() == len(CODEX) + 2
    row = events.where(f"session = '{first.session}' and record = 2").first()
    data = json.dumps(CODEX[1]).encode() + b"\n"
    assert row.observation == derived_id("observation", first.session, "2", hashlib.sha256(data).hexdigest())
    pairs = projection.relations(events).collect()
    assert [(r.kind, r.origin) for r in pairs] == [("tool_pair", "deterministic")]
    passages = [(r.kind, r.body, r.removed, len(r.events)) for r in projection.project(events).where(f"session = '{first.session}'").orderBy("passage").collect()]
    assert passages[:4] == [("user", "find it", 1, 1), ("reasoning_summary", "think", 0, 1), ("assistant", "one\ntwo", 0, 2), ("tool_result", "done", 0, 1)]


def test_claude_end_to_end(spark, tmp_path):
    config = tmp_path / "claude"
    name = f"projects/-w/{UUID}.jsonl"
    for path, content in {
        name: lines(CLAUDE),
        f"projects/-w/{UUID}/subagents/agent-7.jsonl": lines(CLAUDE[:1]),
        f"projects/-w/{UUID}/subagents/workflows/f/journal.jsonl": b"{}\n",
        "projects/-w/other.jsonl": b"{}\n",
    }.items():
        (config / path).parent.mkdir(parents=True, exist_ok=True)
        (config / path).write_bytes(content)
    files = framing.containers(spark, str(config))
    found = claude.discover(files, str(config)).cache()
    assert sorted((r.kind, r.native_id or "") for r in found.collect()) == [("agent", "7"), ("journal", ""), ("primary", UUID)]
    sessions = found.where("session is not null")
    records = framing.records(files).join(sessions.select("path", "session"), "path").where("record is not null")
    events = claude.events(records).join(sessions.select("session", "occurrence"), "session").cache()
    assert events.where("error is not null").count() == 0
    kinds = sorted(r.kind for r in projection.relations(events).collect())
    assert kinds == ["branch_parent", "reply_to", "reply_to", "tool_pair"]
    session = found.where("kind = 'primary'").first().session
    made = projection.project(events).where(f"session = '{session}'").orderBy("passage").collect()
    assert [(r.kind, r.body) for r in made] == [
        ("user", "hello"), ("assistant", "first"), ("reasoning", "hm"), ("tool_call", 'ls\n{"p": 1}'), ("tool_result", "failed"), ("system", "summary"), ("system", "note"),
    ]

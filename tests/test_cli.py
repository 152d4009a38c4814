import json

import pytest

from skein.__main__ import main

UUID = "20000000-0000-4000-8000-00000000000"


@pytest.fixture
def homes(tmp_path):
    path = tmp_path / f"codex/sessions/2026/03/05/rollout-2026-03-05T10-11-12-{UUID}1.jsonl"
    path.parent.mkdir(parents=True)
    rows = [{"type": "session_meta", "timestamp": "2026-03-05T10:11:12.123456789Z", "payload": {"id": UUID + "1"}},
            {"type": "message", "role": "user", "content": "where is it"}]
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    path = tmp_path / f"claude/projects/p/{UUID}2.jsonl"
    path.parent.mkdir(parents=True)
    rows = [{"type": "user", "timestamp": "2026-03-06T00:00:00Z", "message": {"role": "user", "content": "it was there"}},
            {"type": "custom-title", "customTitle": "mine", "timestamp": "2026-03-04T00:00:00Z"}, {"type": "ai-title", "aiTitle": "its", "timestamp": "soon"}]
    path.write_text("".join(json.dumps(r) + "\n" for r in rows))
    return ["--codex", str(tmp_path / "codex"), "--claude", str(tmp_path / "claude"), "--catalog", f"file://{tmp_path}/catalog"]


def test_commands(spark, homes, capsys, tmp_path):
    def run(*args):
        code = main([*homes, *args], spark)
        return code, [json.loads(x)["record"] for x in capsys.readouterr().out.splitlines()]

    rows = run("list")[1]
    assert [(r["harness"], r.get("title"), r["started_at"][:19], r.get("updated_at", "-")[:10]) for r in rows] == [
        ("codex", None, "2026-03-05T10:11:12", "-"), ("claude", "mine", "2026-03-06T00:00:00", "2026-03-04")]
    assert [r["harness"] for r in run("list", "--since", "2026-03-05T00:00:00Z")[1]] == ["codex"]
    shown = run("show", rows[0]["session"].rsplit(":")[-1][:20])[1]
    assert [r["kind"] for r in shown] == ["unknown", "message"]
    with pytest.raises(LookupError):
        run("show", "session:")
    with pytest.raises(LookupError):
        run("show", "nothing")
    assert run("search", "places there") == (1, [])
    assert run("search", "it", "--mode", "literal")[0] == 0
    assert run("search", "absent", "--mode", "literal") == (1, [])
    status = run("status")[1][0]
    assert (status["session"], status["document"], status["behind"]["added"]) == (2, 2, 0)
    assert run("export", str(tmp_path / "state"))[1] == [{"snapshot": 2, "checkpoint": 2}]
    assert run("reclaim")[1] == [{"generations": []}]
    assert run("doctor") == (0, run("doctor")[1]) and {r["status"] for r in run("doctor")[1]} == {"ok"}
    found = run("sources")[1]
    assert [(r["harness"], r["kind"], r["status"]) for r in found[:2]] == [("claude", "canonical", "available"), ("claude", "auxiliary", "missing")]
    assert [(r["status"], r["diagnostics"]) for r in found if r["harness"] == "codex"] == [("available", ["codex_root_missing: archived_sessions"])]
    assert main([*homes, "dump", rows[0]["session"]], spark) == 0
    dumped = json.loads(capsys.readouterr().out)
    assert dumped["schema"] == "skein.session/v1" and [r["kind"] for r in dumped["records"]] == ["unknown", "message"]
    claim = {"harness": "codex", "pid": 1, "started_at": "x", "native_id": UUID + "1", "certainty": "probable", "evidence": ["open file"]}
    (tmp_path / "claims").write_text(json.dumps(claim) + "\n")
    assert [(r["harness"], r["certainty"]) for r in run("current", str(tmp_path / "claims"))[1]] == [("codex", "probable")]
    assert run("current", str(tmp_path / "claims"), "--exact")[1] == []
    with pytest.raises(SystemExit):
        main(["search", "x"], spark)

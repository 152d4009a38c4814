import json

import pytest

from skein.plans.store import Catalog, numbered

UUID = "20000000-0000-4000-8000-00000000000"


def turn(role, text):
    return {"type": "response_item", "payload": {"type": "message", "role": role, "content": text}}


def write(home, number, rows):
    path = home / f"sessions/2026/03/0{number}/rollout-2026-03-0{number}T10-11-12-{UUID}{number}.jsonl"
    path.parent.mkdir(parents=True, exist_ok=True)
    head = {"type": "session_meta", "payload": {"id": f"{UUID}{number}"}}
    path.write_text("".join(json.dumps(r) + "\n" for r in [head, *rows]))
    return path


def test_numbers_are_dense_and_ordered(spark, tmp_path):
    rows = spark.createDataFrame([(f"k{x:03}", x) for x in range(100)], "k string, v long").repartition(7)
    found = numbered(rows, "n", ["k"], 5, f"file://{tmp_path}/w").collect()
    assert {r.v: r.n for r in found} == {x: x + 5 for x in range(100)}
    assert numbered(rows.limit(0), "n", ["k"], 1, f"file://{tmp_path}/e").count() == 0


def test_catalog(spark, tmp_path):
    codex, claude = tmp_path / "codex", tmp_path / "claude"
    write(codex, 1, [turn("user", "find 100% of it"), turn("assistant", "alpha beta"), turn("assistant", "gamma")])
    write(codex, 2, [turn("user", "alpha alpha alpha"), {"type": "response_item", "payload": {"type": "function_call", "call_id": "c", "name": "run", "arguments": "{}"}},
                     {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "c", "output": "ok"}}])
    path = claude / f"projects/p/{UUID}9.jsonl"
    path.parent.mkdir(parents=True)
    path.write_text("".join(json.dumps(r) + "\n" for r in [
        {"type": "user", "uuid": "a", "message": {"role": "user", "content": "delta alpha"}},
        {"type": "user", "uuid": "b", "parentUuid": "a", "forkedFrom": {"messageUuid": "nowhere"}, "message": {"role": "user", "content": "more"}},
    ]))
    homes = {"codex": str(codex), "claude": str(claude)}
    store = Catalog(spark, f"file://{tmp_path}/catalog")
    assert store.generation() == 0
    assert store.scan(homes) == {"reused": 0, "read": 3, "rows": 10 + 3 + 7, "failed": 0}
    assert store.counts() == {"session": 3, "event": 10, "relation": 3, "document": 7, "resolved": 2, "unresolved": 1}
    assert [r.body for r in store.search("100%").collect()] == ["find 100% of it"]
    assert store.search("100_").count() == 0 and store.search("ALPHA").count() == 0
    hits = store.search("alpha", "lexical").collect()
    assert hits[0].body == "alpha alpha alpha" and len(hits) == 3 and hits[0].score < hits[1].score < 0
    assert [r.body for r in store.search("alpha", "lexical", harness="claude").collect()] == ["delta alpha"]
    assert [len(r.events) for r in store.search("beta\ngamma").collect()] == [2]
    assert [r.body for r in store.search("deltas", "lexical").collect()] == ["delta alpha"]
    with pytest.raises(ValueError):
        store.search("x", "vector")

    assert store.scan(homes) == {"reused": 3, "read": 0, "rows": 0, "failed": 0}
    assert store.behind(homes) == {"added": 0, "removed": 0, "changed": 0}
    write(codex, 2, [turn("user", "omega"), turn("user", "\0nul")])
    write(codex, 3, [turn("user", "new"), {"type": "response_item"}])
    write(codex, 4, []).write_text('{"type": "session_meta", "payload": {"id": "x"}}\n{broken\n')
    assert store.behind(homes) == {"added": 2, "removed": 0, "changed": 1}
    assert store.scan(homes)["failed"] == 2
    assert store.changes() == {"rewritten": 1, "unchanged": 2, "failed": 2}
    # A broken container is not read again before it changes.
    batches = len(store._names("tables/event"))
    assert store.scan(homes) == {"reused": 3, "read": 0, "rows": 0, "failed": 0} and len(store._names("tables/event")) == batches
    assert store.changes() == {"unchanged": 5}
    assert store.export(str(tmp_path / "state")) == {"snapshot": 3, "checkpoint": 3}
    other = Catalog(spark, f"file://{tmp_path}/other")
    other.import_state(str(tmp_path / "state"))
    assert other.table("snapshot").count() == 3
    with pytest.raises(RuntimeError):
        store.import_state(str(tmp_path / "state"))
    assert store.search("alpha alpha").count() == 0 and store.search("omega").count() == 1
    assert [r.removed for r in store.search("nul").collect()] == [1]
    assert store.eligible("document", 1).count() == 7
    ids = [r.doc_id for r in store.table("document").collect()]
    assert sorted(ids) == list(range(1, len(ids) + 1))
    before = sorted(r.body for r in store.eligible("document").collect())
    assert [(g["number"], g["state"]) for g in store.generations()] == [(1, "superseded"), (2, "superseded"), (3, "superseded"), (4, "active")]
    assert {r["status"] for r in store.doctor()} == {"ok", "warning"}
    assert store.reclaim() == [1, 2, 3] and store.reclaim() == []
    assert {r["status"] for r in store.doctor()} == {"ok"}
    assert sorted(r.body for r in store.eligible("document").collect()) == before
    assert store.scan(homes)["reused"] == 3
    (codex / f"sessions/2026/03/01/rollout-2026-03-01T10-11-12-{UUID}1.jsonl").unlink()
    store.scan(homes)
    gone = {r.path.rsplit("-", 1)[-1]: r for r in store.identities().collect()}
    assert [n for n, r in gone.items() if r.disappeared_at] == ["000000000001.jsonl"] and all(r.first_seen <= r.last_seen for r in gone.values())


def test_one_writer_at_a_time(spark, tmp_path, monkeypatch):
    from skein.plans import store as module

    write(tmp_path / "codex", 1, [turn("user", "one")])
    homes = {"codex": str(tmp_path / "codex")}
    first, second = (Catalog(spark, f"file://{tmp_path}/catalog") for _ in range(2))
    first.scan(homes)
    with first.writer() as token:
        with pytest.raises(module.LeaseLost):
            second.scan(homes)
        with pytest.raises(module.LeaseLost):
            second.reclaim()
        # A lease that its holder lets expire is taken over; the holder can't publish any more, and nothing is harmed.
        monkeypatch.setattr(module, "LEASE", -1)
        write(tmp_path / "codex", 2, [turn("user", "two")])
        assert second.scan(homes)["read"] == 1
        with pytest.raises(module.LeaseLost):
            first._publish(second.generation() + 1, 1, token)
    assert first.generation() == 2 and first.counts()["document"] == 2
    # What a writer that died has left counts as failed, and goes with the next sweep.
    first._derive("event", 77, first.table("event").drop("batch"))
    first.spark.range(1).write.parquet(f"file://{tmp_path}/catalog/generation/77/member")
    assert [g["state"] for g in first.generations()] == ["superseded", "active", "failed"]
    assert first.reclaim() == [1] and first.counts()["document"] == 2
    assert not first._exists("tables/event/batch=77") and not first._exists("generation/77")


def test_stored_indexes_narrow_a_search(spark, tmp_path):
    write(tmp_path / "codex", 1, [turn("user", f"text {k} of many") for k in range(40)])
    store = Catalog(spark, f"file://{tmp_path}/catalog")
    store.scan({"codex": str(tmp_path / "codex")})
    assert [r.body for r in store.search("t 17 o").collect()] == ["text 17 of many"]
    assert [r.rank for r in store.search("text", "lexical", 5).collect()] == [1, 2, 3, 4, 5]
    assert store.search("no such thing", "lexical").count() == 0
    rows = store.table("trigram").where("trigram = ' 17'").collect()
    assert len(rows) == 1

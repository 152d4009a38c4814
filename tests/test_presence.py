from datetime import datetime

import pytest
from pyspark.sql import functions as F

from skein.operators import presence, vectors

NOW, LATER = datetime(2026, 3, 5, 1), datetime(2026, 3, 5, 2)
CLAIMS = "harness string, pid long, started_at timestamp, native_id string, certainty string, exact_session string, evidence array<string>, reason string"


def test_presence(spark):
    sessions = spark.createDataFrame([("codex", "n1", "s1"), ("codex", "n2", "s2"), ("codex", "n2", "s3"), ("codex", "n3", "s4"), ("codex", "n3", "s5")], "harness string, native_id string, session string")
    claims = spark.createDataFrame(
        [
            ("codex", 1, NOW, "n1", "probable", None, ["argv"], None), ("codex", 1, NOW, "n2", "probable", None, ["cwd"], None),
            ("codex", 2, NOW, "n3", "exact", "s5", ["file"], None), ("codex", 2, LATER, "n3", "probable", None, ["argv", "file"], None),
            ("codex", 3, NOW, "gone", "exact", None, ["file"], None), ("codex", 4, NOW, None, None, None, ["argv"], None),
        ],
        CLAIMS,
    )
    found = {r.native_id: r for r in presence.matches(claims, sessions).collect()}
    assert {k: (r.certainty, r.processes, r.selected) for k, r in found.items()} == {"n1": ("probable", 1, "s1"), "n2": ("probable", 1, None), "n3": ("exact", 2, "s5")}
    assert found["n3"].evidence == ["argv", "file"] and found["n2"].candidates == ["s2", "s3"]
    assert [r.native_id for r in presence.matches(claims, sessions, exact_only=True).collect()] == ["n3"]
    lost = {r.pid: (r.claimed, r.reason) for r in presence.unmatched(claims, sessions).collect()}
    assert lost == {3: (["gone"], "unmatched_native_identity"), 4: ([], "no_session_identity")}
    assert sorted(r.pid for r in presence.unmatched(claims, sessions, exact_only=True).collect()) == [3, 4]


def test_spaces_and_cache(spark):
    spaces, one = vectors.ensure_space(spark.createDataFrame([], vectors.SPACES), "a", "p", "m", 2)
    assert vectors.ensure_space(spaces, "a", "p", "m", 2)[1] == one == 1
    with pytest.raises(ValueError):
        vectors.ensure_space(spaces, "a", "p", "m", 3)
    docs = spark.createDataFrame([(1, "h1", "x"), (2, "h2", "yy"), (3, "h2", "yy")], "doc_id long, content_hash string, body string")
    cache = spark.createDataFrame([(1, "h1", [9.0, 9.0]), (2, "h2", [7.0, 7.0])], "space long, content_hash string, embedding array<float>")
    embed = lambda rows: rows.select("content_hash", F.array(F.length("body").cast("float"), F.lit(0.0).cast("float")).alias("embedding"))
    done, fresh = vectors.attach(docs, cache, 1, 2, embed)
    assert {r.doc_id: r.embedding for r in done.collect()} == {1: [9.0, 9.0], 2: [2.0, 0.0], 3: [2.0, 0.0]}
    assert [(r.space, r.content_hash) for r in fresh.collect()] == [(1, "h2")]
    with pytest.raises(Exception, match="3 numbers"):
        vectors.attach(docs, cache, 1, 3, embed)[1].collect()

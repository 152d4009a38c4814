"""Every registered query against its SQL, and the operators' edge cases."""

import os
from datetime import UTC, datetime, timedelta

import duckdb
import pytest
from pyspark.sql import functions as F

from skein.functions import identity, text
from skein.operators import catalog, passages, search, sessions
from skein.plans import log_queries, registry

assert log_queries.query is registry.query  # its queries are registered with the others
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sql():
    db = duckdb.connect()
    for name in os.listdir(SF):
        db.execute(f"CREATE VIEW {name.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{name}'")
    return db


@pytest.mark.parametrize("name", registry.QUERIES)
def test_query(spark, sql, name):
    frame = registry.QUERIES[name](spark, SF)
    columns = sorted(frame.columns)
    got = sorted((tuple(r) for r in frame.select(*columns).collect()), key=repr)
    if name in registry.ORACLES:
        made = sql.execute(registry.ORACLES[name])
        names = [d[0] for d in made.description]
        assert sorted(names) == columns
        assert got == sorted((tuple(r[names.index(c)] for c in columns) for r in made.fetchall()), key=repr)


def test_parts_lose_no_byte():
    for body in ("", "a" * 10, "é" * 10, "ab\ncd\n\nefghijkl\nx", "日本語テキスト\n" * 3, "a\r\nb" * 5):
        for most in (4, 5, 7, 100):
            parts = text.parts_of(body, most)
            assert "".join(parts) == body and all(len(p.encode()) <= most for p in parts)
    assert text.parts_of("ab\ncd\nef", 6) == ["ab\ncd\n", "ef"]
    assert text.parts_of("ab\n" + "c" * 9, 4) == ["ab\n", "cccc", "cccc", "c"]


def test_split_keeps_other_columns(spark):
    rows = spark.createDataFrame([(1, "x" * 9, [1]), (2, "short", None), (3, None, [])], "id long, body string, other array<int>")
    found = sorted(tuple(r) for r in text.split_bodies(rows, 5).select("id", "part", "parts").collect())
    assert found == [(1, 0, 2), (1, 1, 2), (2, 0, 1), (3, 0, 1)]


def test_display_and_nul(spark):
    rows = spark.createDataFrame([("  a\n\tb  ",), ("x" * 9,), ("a\0\0b\0",)], "t string")
    assert [r[0] for r in rows.select(text.display(F.col("t"), 5)).collect()][:2] == ["a b", "xxxxx..."]
    last = rows.select(text.without_nul(F.col("t")), text.removed_nul(F.col("t"))).collect()[2]
    assert tuple(last) == ("ab", 3)


def test_builder_key(spark):
    made = spark.range(1).select(identity.builder_key(F.create_map(F.lit("b"), F.lit("2"), F.lit("a"), F.lit("1")))).first()[0]
    assert made == "a=1;b=2"


def test_excluded_documents_take_no_place(spark):
    docs = spark.createDataFrame([(k, "wanted " * (3 if k < 600 else 1)) for k in range(601)], "doc_id long, body string")
    member = docs.where("doc_id >= 600").select("doc_id")
    assert [r.doc_id for r in search.bm25(search.eligible(docs, member), "wanted", 3).collect()] == [600]
    assert [r.doc_id for r in search.literal(search.eligible(docs, member), "wanted", 3).collect()] == [600]
    assert search.bm25(docs, "wanted", 0).count() == search.DEFAULT_LIMIT
    assert search.bm25(docs.limit(0), "wanted").count() == 0
    with pytest.raises(ValueError):
        search.bm25_all(docs, "wanted", 0)


def test_literal_takes_wildcards_as_they_are(spark):
    docs = spark.createDataFrame([(1, "50% off"), (2, "50 off"), (3, "a_b"), (4, "axb"), (5, "back\\slash")], "doc_id long, body string")
    for query, want in (("50%", [1]), ("a_b", [3]), ("\\", [5]), ("up", []), ("OFF", [])):
        assert [r.doc_id for r in search.literal(docs, query).collect()] == want
        found, how = search.literal_by_trigrams(docs, search.trigram_index(docs), query)
        assert sorted(r.doc_id for r in found.collect()) == want
        assert how == ("trigram" if len(query) > 2 else "scan")


def test_empty_segments_do_not_close_a_run(spark):
    rows = [("s", 1, "assistant", "a"), ("s", 2, "user", ""), ("s", 3, "assistant", "b"), ("s", 4, "user", "c"), ("s", 5, "user", "d"), ("s", 6, "assistant", "e"), ("t", 1, "assistant", "f")]
    frame = spark.createDataFrame(rows, "session string, at int, role string, text string")
    made = passages.bodies(passages.islands(frame, "session", ["at"], F.col("role")), "session", "at").orderBy("session", "passage")
    assert [(r.kind, r.body) for r in made.collect()] == [("assistant", "a\nb"), ("user", "c"), ("user", "d"), ("assistant", "e"), ("assistant", "f")]


def test_change_kinds(spark):
    rows = [(None, "a", "", "", "initial"), ("a", "a", "x", "y", "unchanged"), ("a", "ab", "x", "y", "replaced"), ("a", "ab", "", "y", "grown"), ("ab", "a", "x", "x", "truncated"), ("ab", "b", "", "", "rewritten"), ("ab", "ba", "", "", "rewritten")]
    frame = spark.createDataFrame(rows, "a string, b string, i string, j string, want string")
    kind = catalog.change_kind(F.col("a").cast("binary"), F.col("b").cast("binary"), F.col("i"), F.col("j"))
    assert all(r.want == r.got for r in frame.select("want", kind.alias("got")).collect())


def test_failed_sources_leave_no_tombstones(spark):
    known = spark.createDataFrame([(1, None), (2, None), (3, 7)], "k int, disappeared_at int")
    seen = spark.createDataFrame([(1,)], "k int")
    assert sorted(map(tuple, catalog.tombstoned(known, seen, "k", F.lit(9)).collect())) == [(1, None), (2, 9), (3, 7)]
    assert catalog.tombstoned(known, seen, "k", F.lit(9), failed=True) is known


def test_parents_are_unique_and_not_the_record_itself(spark):
    rows = [("s", "a", None), ("s", "b", "a"), ("s", "c", "c"), ("s", "d", "x"), ("s", "e", "f"), ("s", "f", None), ("s", "f", "a"), ("t", "g", "a")]
    frame = spark.createDataFrame(rows, "s string, id string, up string")
    found = {(r.s, r.id, r.up): r.parent_found for r in catalog.unique_parents(frame, "id", F.col("up"), "s").collect()}
    assert len(found) == len(rows) and {k[1] for k, v in found.items() if v} == {"b", "f"} and found["s", "f", "a"] == "a"


def test_selectors(spark):
    ids = spark.createDataFrame([("session:ab1",), ("session:ab2",), ("ab",)], "id string")
    for selector, n in (("ab", 1), ("ab1", 1), ("session:ab", 2), ("AB", 0)):
        assert sessions.selected(ids, selector, "id").count() == n


def test_relative_times():
    now = datetime(2026, 3, 5, tzinfo=UTC)
    assert sessions.relative_time("90m", now) == now - timedelta(minutes=90)
    assert sessions.relative_time("2w", now) == now - timedelta(days=14)
    assert sessions.relative_time("2026-03-01T00:00:00Z", now).day == 1
    for wrong in ("0d", "5", "99999999999w", "2026-03-01T00:00:00", "x"):
        with pytest.raises(ValueError):
            sessions.relative_time(wrong, now)


def test_activity_needs_a_time_only_if_bounded(spark):
    rows = spark.createDataFrame([(1, 5), (2, None), (3, 9)], "k int, t int")
    assert sessions.activity_between(rows, None, None, F.col("t")).count() == 3
    assert [r.k for r in sessions.activity_between(rows, F.lit(5), F.lit(8), F.col("t")).collect()] == [1]


@pytest.mark.parametrize("name", ["passages_skip_empty", "passage_body"])
def test_empty_segments_are_skipped_by_the_operator(spark, monkeypatch, name):
    seen, islands = [], passages.islands
    monkeypatch.setattr(passages, "islands", lambda segments, *rest: seen.append(segments) or islands(segments, *rest))
    registry.QUERIES[name](spark, SF)
    turns = spark.read.parquet(f"{SF}/conversations.parquet")
    assert seen[0].count() == turns.count()
    assert seen[0].where("text = ''").count() >= turns.where("turn % 3 = 1").count() > 0


def test_event_rules(spark):
    from skein.operators import records

    schema = (
        "session string, record long, observation string, event string, event_index int, kind string, role string, call_id string, name string, status string, "
        "usage struct<input_tokens:long,output_tokens:long,total_tokens:long>, facts array<struct<kind:string,value:string>>, content array<struct<id:string>>"
    )
    good = ("s", 1, "o", "e", 0, "message", "user", None, None, None, None, None, [("a",), ("b",)])
    rows = [good, (*good[:5], "usage", None, None, None, None, (1, -2, 3), None, None), (*good[:12], [("a",), ("a",)]), (*good[:5], "tool_call", None, "c", "", None, None, None, None)]
    frame = spark.createDataFrame(rows, schema)
    assert [r.violations for r in records.violations(frame, records.EVENT_RULES).collect()] == [[], ["usage"], ["blocks"], ["name"]]
    assert records.violations(frame.limit(1), records.EVENT_RULES, strict=True).count() == 1
    with pytest.raises(Exception, match="invalid record: "):
        records.violations(frame, records.EVENT_RULES, strict=True).collect()


def test_sources_of_a_home(spark):
    from skein.operators import records

    names = spark.createDataFrame([("tasks/1",), ("other",)], "relative string")
    rows = records.sources(names, "claude", "/h").orderBy("rank").collect()
    assert [(r.kind, r.status) for r in rows[:1]] == [("canonical", "missing")] and rows[0].diagnostics == ["claude_projects_missing: projects"]
    assert {r.relative: r.status for r in rows[1:]} == {n: "disabled" if n == "tasks" else "missing" for n in records.AUXILIARY}
    assert [r.status for r in records.sources(names, "codex", "/h").collect()] == ["missing"]
    assert records.of_sources(names, [], "relative").count() == 2 and records.of_sources(names, ["other"], "relative").count() == 1


def test_identity_of_a_record(spark):
    from skein.operators import records

    rows = spark.createDataFrame([("p", "", "p", "x"), ("p", "", "", ""), ("p", "", "q", ""), ("p", "a", "q", "a"), ("p", "a", "p", None), ("p", "a", "p", "b")], "p string, a string, s string, g string")
    fits = records.matches_identity(*[F.col(c) for c in "pasg"])
    assert [r[0] for r in rows.select(fits).collect()] == [True, True, False, True, True, False]

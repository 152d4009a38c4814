import pytest

from skein.plans import state


@pytest.fixture
def tables(spark):
    contents = spark.createDataFrame([(b"one",), (b"two",), (b"one",), (b"",)], "content binary")
    snapshot = state.snapshots(contents)
    digests = [r.content_hash for r in snapshot.orderBy("size", "content_hash").collect()]
    rows = [(f"o{k}", "d", "b", "s", "r", h, "initial") for k, h in enumerate(digests)]
    return {"snapshot": snapshot, "checkpoint": spark.createDataFrame(rows, state.TABLES["checkpoint"][1])}


def test_snapshots_are_stored_once_and_verified(spark, tables):
    assert tables["snapshot"].count() == 3
    assert sorted(bytes(r.content) for r in state.contents(tables["snapshot"]).collect()) == [b"", b"one", b"two"]
    more = spark.createDataFrame([(b"two",), (b"three",)], "content binary")
    assert [r.size for r in state.snapshots(more, tables["snapshot"]).collect()] == [5]
    from pyspark.sql import functions as F

    with pytest.raises(Exception, match="damaged"):
        state.contents(tables["snapshot"].withColumn("checksum", F.lit("x"))).collect()


def test_changes(spark, tables):
    order = [bytes(r.content) for r in tables["checkpoint"].join(state.contents(tables["snapshot"]).withColumnRenamed("content_hash", "snapshot_hash"), "snapshot_hash").orderBy("occurrence").collect()]
    now = spark.createDataFrame([("o0", order[0]), ("o1", order[1] + b"more"), ("o2", order[2][:1]), ("o9", b"new")], "occurrence string, content binary")
    found = {r.occurrence: r.change_kind for r in state.changes(tables["checkpoint"], tables["snapshot"], now).collect()}
    assert found == {"o0": "unchanged", "o1": "grown", "o2": "truncated", "o9": "initial"}


def test_round_trip_and_tampering(spark, tables, tmp_path):
    path = tmp_path / "state.ndjson"
    assert state.export(tables, str(path)) == {"snapshot": 3, "checkpoint": 3}
    with pytest.raises(FileExistsError):
        state.export(tables, str(path))
    back = state.load(spark, str(path))
    for name in tables:
        columns = sorted(tables[name].columns)
        assert sorted(map(str, back[name].select(*columns).collect())) == sorted(map(str, tables[name].select(*columns).collect()))
    content = path.read_bytes()
    for at in (len(content) - 3, 700):
        (tmp_path / "bad").write_bytes(content[:at] + bytes([content[at] ^ 1]) + content[at + 1 :])
        with pytest.raises(ValueError):
            state.load(spark, str(tmp_path / "bad"))
    (tmp_path / "cut").write_bytes(content[: content.rindex(b"\n", 0, -1) + 1])
    with pytest.raises(ValueError):
        state.load(spark, str(tmp_path / "cut"))

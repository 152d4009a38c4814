from skein.streaming.pairs import tool_pairs
from skein.streaming.tail import TailSource


def test_tail_continues_waits_and_replays(spark, tmp_path):
    spark.dataSource.register(TailSource)
    logs = tmp_path / "logs"
    logs.mkdir()
    a, b = logs / "a.jsonl", logs / "b.jsonl"
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")

    def drain():
        stream = spark.readStream.format("skein_tail").option("pattern", f"{logs}/*.jsonl").load()
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
        assert query.awaitTermination(60)
        rows = spark.read.parquet(out).collect()
        return sorted((r.path.rsplit("/", 1)[1], r.replay, r.record, r.byte_start, bytes(r.data)) for r in rows)

    a.write_bytes(b'{"n":1}\n{"n":2')
    first = [("a.jsonl", 0, 1, 0, b'{"n":1}')]
    assert drain() == first
    a.write_bytes(b'{"n":1}\n{"n":22}\r\n3\n')
    b.write_bytes(b"[]\n")
    second = first + [("a.jsonl", 0, 2, 8, b'{"n":22}'), ("a.jsonl", 0, 3, 18, b"3"), ("b.jsonl", 0, 1, 0, b"[]")]
    assert drain() == second
    a.write_bytes(b'{"n":9}\n')
    assert drain() == sorted([*second, ("a.jsonl", 1, 1, 0, b'{"n":9}')])


def test_pairs_in_either_order_and_withdrawn(spark, tmp_path):
    schema, source = "session string, call_id string, kind string, event string", tmp_path / "in"
    out, marks = str(tmp_path / "out"), str(tmp_path / "marks")

    def drain(rows):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(source))
        stream = tool_pairs(spark.readStream.schema(schema).parquet(str(source)))
        query = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", marks).trigger(availableNow=True).start()
        assert query.awaitTermination(60)
        return sorted(tuple(r) for r in spark.read.parquet(out).collect())

    assert drain([("s", "c", "tool_result", "r1"), ("s", "d", "tool_call", "k2"), ("s", "d", "tool_result", "r2"), ("t", "c", "message", "m")]) == [("s", "d", "k2", "r2", True)]
    assert drain([("s", "c", "tool_call", "k1"), ("t", "c", "tool_call", "k9")]) == [("s", "c", "k1", "r1", True), ("s", "d", "k2", "r2", True)]
    assert ("s", "d", "k2", "r2", False) in drain([("s", "d", "tool_call", "k3")])


def test_idle_pairs_are_forgotten(spark, tmp_path):
    import time

    schema, source = "session string, call_id string, kind string, event string", str(tmp_path / "in")
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(source)
    put(("s", "c", "tool_call", "k1"))
    stream = tool_pairs(spark.readStream.schema(schema).parquet(source), idle=500)
    query = stream.writeStream.format("memory").queryName("idle_pairs").option("checkpointLocation", str(tmp_path / "marks")).start()

    def rows(wanted):
        end = time.time() + 60
        while time.time() < end and query.isActive:
            if wanted(query.lastProgress):
                return True
            time.sleep(0.2)

    try:
        assert rows(lambda p: p and p["stateOperators"][0]["numRowsTotal"] == 0 and p["batchId"] > 0)
    finally:
        query.stop()

import hashlib

import pyarrow as pa
import pytest

from skein.sources import framing, rawjson

EDGES = [b'{"a":1}\n', b'{"a":1}\r\n{"b":2}\n', b'{"a":1}', b" [1, 2] \n\t3\t\n", b"true\r", b""]


@pytest.mark.parametrize("content", EDGES)
@pytest.mark.parametrize("tail", [framing.GROWING, framing.FINAL])
def test_frames_reconstruct_the_container(content, tail):
    found = list(framing.frames(content, tail))
    whole = b"".join(f.data + f.framing for f in found)
    assert content.startswith(whole)
    assert tail == framing.GROWING or whole == content
    assert [f.record for f in found] == list(range(1, len(found) + 1))
    assert all(content[f.start : f.end] == f.data for f in found)
    if found:
        assert found[-1].prefix_sha256 == hashlib.sha256(whole).hexdigest()


@pytest.mark.parametrize("content", [b"\n", b"{}\n{\n", b"{} {}\n", b"NaN\n", b'"\x01"\n'])
def test_frames_reject_what_is_not_one_value(content):
    with pytest.raises(framing.FramingError):
        list(framing.frames(content))


def test_limit_excludes_the_framing():
    assert len(list(framing.frames(b"1234\r\n", limit=4))) == 1
    with pytest.raises(framing.FramingError):
        list(framing.frames(b"12345\n", limit=4))
    with pytest.raises(framing.FramingError):
        list(framing.frames(b"12345", limit=4))


def test_raw_members():
    found = rawjson.members(' { "b" : { "x" :  1.50 , "a":[ ] } , "a":null, "c":"t\\u00e9" , "b2":[1 , 2]}')
    assert found["b"].raw == '{ "x" :  1.50 , "a":[ ] }' and "a" not in found and found["c"].value == "té"
    assert [m.raw for m in rawjson.elements('[ {"k" : 1}, "x" ,3 ]')] == ['{"k" : 1}', '"x"', "3"]
    assert rawjson.members("{}") == {} and rawjson.elements("[]") == []
    for wrong in ("[]", "{", '{"a":1} x'):
        with pytest.raises(ValueError):
            rawjson.members(wrong)


def test_records(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "a/x.jsonl").write_bytes(b'{"a":1}\n{"b":2}\r\n{"tail"')
    (tmp_path / "a/empty.jsonl").write_bytes(b"")
    (tmp_path / "a/pending.jsonl").write_bytes(b"{")
    (tmp_path / "a/bad.jsonl").write_bytes(b"{}\n{\n")
    packed = pa.BufferOutputStream()
    with pa.CompressedOutputStream(packed, "zstd") as out:
        out.write(b'{"z":1}\n')
    (tmp_path / "a/y.jsonl.zst").write_bytes(packed.getvalue().to_pybytes())
    rows = {}
    for r in framing.records(framing.containers(spark, str(tmp_path))).collect():
        rows.setdefault(r.path.rsplit("/", 1)[1], []).append(r)
    assert [(r.record, r.byte_start, r.byte_end, bytes(r.framing)) for r in rows["x.jsonl"]] == [(1, 0, 7, b"\n"), (2, 8, 15, b"\r\n")]
    assert {(r.tail, r.confirmed_end, r.size) for r in rows["x.jsonl"]} == {("pending", 17, 24)}
    assert "empty.jsonl" not in rows
    assert (rows["pending.jsonl"][0].record, rows["pending.jsonl"][0].tail, rows["pending.jsonl"][0].confirmed_end) == (None, "pending", 0)
    assert rows["bad.jsonl"][0].record is None and "record 2 at byte 3" in rows["bad.jsonl"][0].error
    assert (rows["y.jsonl.zst"][0].byte_start, bytes(rows["y.jsonl.zst"][0].data)) == (None, b'{"z":1}')


def test_resume(spark):
    digest = hashlib.sha256(b"abc").hexdigest()
    before = spark.createDataFrame([("p", 3, digest), ("q", 3, digest), ("s", 3, digest)], "path string, confirmed_end long, prefix_sha256 string")
    now = spark.createDataFrame([("p", b"abcdef"), ("q", b"xbcdef"), ("r", b"new"), ("s", b"ab")], "path string, content binary")
    assert dict(framing.resume(before, now).collect()) == {"p": "continue", "q": "replay", "r": "initial", "s": "replay"}

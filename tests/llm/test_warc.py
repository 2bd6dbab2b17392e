import io
import os
import random

from plumbline.llm import warc
from plumbline.plans.check import differs

SF = "/root/testdata/sf0.001"


def test_oracle(spark):
    assert not differs(warc.op4_warc(spark, SF), warc.OP4_SQL, SF)


def test_frames():
    records = [warc.record_bytes(i, f"http://x/{i}", f"<p>{'word ' * 40}{i}</p>".encode() * 3, "D", None, False) for i in range(300)]
    data = b"".join(warc.archive_frames(records))
    assert data[:4] == b"\x5d\x2a\x4d\x18"
    assert list(warc.read_archive(io.BytesIO(data), 7)) == records
    alone = b"".join(warc.archive_frames(records[:2]))
    assert list(warc.read_archive(io.BytesIO(alone))) == records[:2] and list(warc.read_archive(io.BytesIO(b""))) == []


def test_few_large_records_get_a_dictionary():
    rng = random.Random(1)
    words = ["".join(rng.choice("abcdefgh") for _ in range(7)) for _ in range(300)]
    big = [("<p>" + " ".join(rng.choice(words) for _ in range(700_000))).encode() for _ in range(3)]
    for records in (big, [x[:9_000] for x in big]):
        frames = list(warc.archive_frames(records))
        assert len(frames) == 4 and frames[0][:4] == b"\x5d\x2a\x4d\x18"
        assert list(warc.read_archive(io.BytesIO(b"".join(frames)))) == records
    assert warc.train([]) is None and warc.train([b"short"]) is None


def test_attempts_leave_each_other_alone(spark, tmp_path):
    """Files that a lost attempt has written are in no list."""
    pages = spark.createDataFrame([(i, "u", f"page {i}") for i in range(40)], "page_id long, url string, html string").repartition(3)
    warc.write_archives(pages, f"file://{tmp_path}/w").collect()
    first = set(os.listdir(f"{tmp_path}/w"))
    archives = warc.archive(pages, f"file://{tmp_path}/w")
    assert len(first) == 3 and len(os.listdir(f"{tmp_path}/w")) == 6 and archives.count() == 3
    assert sorted(r["page_id"] for r in warc.read_records(archives).collect()) == list(range(40))


def test_edges(spark, tmp_path):
    long = "<p>" + "é" * 2_000_000
    rows = [(3, "http://a/", "same", 1), (1, "http://b/", "same", 1), (2, None, None, 1), (4, "bad url\r\nX: y", "", 1), (None, "u", "same", 1), (5, "u", long, 1), (5, "u", long, 1), (6, "u", "one", 1)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, digest int")
    archives = warc.archive(pages, f"file://{tmp_path}/w")
    got = sorted(((r["page_id"] or 0), r["record_type"], r["refers_to"], r["payload_bytes"], r["html"]) for r in warc.read_records(archives).collect())
    assert [x[:4] for x in got] == [(0, "revisit", 1, 4), (1, "response", None, 4), (2, "response", None, 0), (3, "revisit", 1, 4), (4, "revisit", 2, 0), (5, "response", None, 4_000_003), (5, "response", None, 4_000_003), (6, "response", None, 3)]
    assert got[5][4] == long
    assert warc.read_records(warc.archive(pages.limit(0), f"file://{tmp_path}/none")).count() == 0


def test_minimum(spark, tmp_path):
    pages = spark.createDataFrame([(1, "u", "ab"), (2, "u", "ab"), (3, "u", "abcd"), (4, "u", "abcd")], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["record_type"]) for r in warc.read_records(warc.archive(pages, f"file://{tmp_path}/m", 3)).collect())
    assert got == [(1, "response"), (2, "response"), (3, "response"), (4, "revisit")]


def test_large_groups_are_looked_up(spark):
    pages = spark.createDataFrame([(i, "u", "copy" if i % 3 else f"own {i // 6}") for i in range(900)], "page_id long, url string, html string")
    got = {r["page_id"]: (r["origin"], r["shared"]) for r in warc.with_origin(pages).collect()}
    first = {}
    for i in range(900):
        first.setdefault("copy" if i % 3 else f"own {i // 6}", i)
    assert all(got[i] == (first["copy"], True) for i in range(900) if i % 3)
    assert len(got) == 900

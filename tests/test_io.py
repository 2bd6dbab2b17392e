import json

import numpy as np
import pytest
import yaml
from pyspark.sql import functions as F

from plumbline.sources import readers, writers
from plumbline.streaming.incremental import read_version, stream_upserts


def test_html_and_json(spark, tmp_path):
    (tmp_path / "NKE-10-K-2026.html").write_bytes("<p>é".encode() + b"\xff</p>")
    r = readers.html_files(spark, f"{tmp_path}/*.html").first()
    assert r["doc_id"] == "NKE-10-K-2026" and r["html"].startswith("<p>é") and r["html"].endswith("</p>")
    (tmp_path / "m.json").write_text(json.dumps([{"cik": 1, "ticker": "A", "local_path": "data\\raw\\A-10-K-2025.html"}, {"cik": 2, "ticker": "B", "doc_id": "own"}]))
    assert {r["doc_id"] for r in readers.manifest(spark, f"{tmp_path}/m.json").collect()} == {"A-10-K-2025", "own"}
    (tmp_path / "p-x.json").write_text(json.dumps({"source_file": "a.html", "total_chars": 9, "sections": [{"item_section": "Item 1", "content": "x", "char_count": 1, "start": 0}]}))
    r = readers.parsed_filings(spark, f"{tmp_path}/p-x.json").first()
    assert r["doc_id"] == "p-x" and r["sections"][0]["item_section"] == "Item 1"


def test_tickers(spark, tmp_path):
    (tmp_path / "t.json").write_text(json.dumps({"0": {"cik_str": 7, "ticker": "nke", "title": "NIKE, Inc."}, "1": {"cik_str": 8, "ticker": "A", "title": "a"}}))
    index = readers.ticker_index(spark, f"{tmp_path}/t.json")
    assert [r["ticker"] for r in index.collect()] == ["A", "NKE"]
    readers.write_ticker_cache(index, f"{tmp_path}/cache")
    assert sorted(map(tuple, readers.read_ticker_cache(spark, f"{tmp_path}/cache").collect())) == [("A", 8, "a"), ("NKE", 7, "NIKE, Inc.")]


def test_latest_filing(spark):
    rows = [(1, ["8-K", "10-K", "10-K"], ["0-0", "1-23-4", "2"], ["a", "b", "c"], ["2026-01-01"] * 3, ["2025-12-31"] * 3), (2, ["8-K"], ["x"], ["d"], ["2026-01-01"], ["2025-12-31"])]
    df = spark.createDataFrame(rows, "cik long, form array<string>, accession array<string>, document array<string>, filed array<string>, reported array<string>")
    got = readers.latest_filing(df).collect()
    assert [(r["cik"], r["accession"], r["accession_dashed"], r["document"], r["fiscal_year"]) for r in got] == [(1, "1234", "1-23-4", "b", 2025)]


def test_yaml(spark, tmp_path):
    pin = {"ticker": "A", "cik": 1, "accession": "1", "document": "d", "filed_date": "2026-01-01", "report_date": "2025-12-31", "fiscal_year": 2025, "company": "a"}
    (tmp_path / "pin.yaml").write_text(yaml.safe_dump({"filings": [pin]}))
    assert readers.pinned_filings(spark, f"{tmp_path}/pin.yaml").first()["cik"] == 1
    (tmp_path / "bad.yaml").write_text(yaml.safe_dump({"filings": [{**pin, "document": ""}]}))
    with pytest.raises(ValueError, match="document"):
        readers.pinned_filings(spark, f"{tmp_path}/bad.yaml")
    (tmp_path / "q.yaml").write_text(yaml.safe_dump([{"id": "q1", "question": "?", "type": "extractive", "answerable": True, "gold_chunks": [{"doc_id": "d", "chunk_index": 3, "contains": "x"}, {"doc_id": "d", "chunk_index": 4, "unlocalisable": {"anchor": "a", "reason": "r"}}]}]))
    r = readers.benchmark(spark, f"{tmp_path}/q.yaml").first()
    assert r["gold_chunks"][0]["contains"] == "x" and r["gold_chunks"][1]["unlocalisable"]["reason"] == "r"


def test_vectors(spark, tmp_path):
    m = np.arange(12, dtype=np.float32).reshape(4, 3)
    np.save(tmp_path / "v.npy", m)
    got = sorted(map(tuple, readers.npy_vectors(spark, f"{tmp_path}/v.npy").collect()))
    assert [x[1] for x in got] == m.tolist()
    assert readers.vectors_of_text(spark.createDataFrame([("[0.5,1]",)], "embedding string")).first()["embedding"] == [0.5, 1.0]
    assert readers.tables_and_settings(spark).filter("kind = 'setting'").count() == 2


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a", "x"), (2, "b", "y"), (3, None, None)], "k int, v string, w string")
    new = spark.createDataFrame([(2, "B", "Y"), (3, "C", "Z"), (4, "D", None)], "k int, v string, w string")
    assert sorted(map(tuple, writers.upsert(old, new, ["k"], ["v"]).collect())) == [(1, "a", "x"), (2, "B", "y"), (3, "C", None), (4, "D", None)]
    assert sorted(map(tuple, writers.insert_ignore(old, new, ["k"]).collect())) == [(1, "a", "x"), (2, "b", "y"), (3, None, None), (4, "D", None)]
    assert sorted(map(tuple, writers.upsert(old, new.limit(0), ["k"], ["v"]).collect())) == sorted(map(tuple, old.collect()))


def test_serial_and_dump(spark, tmp_path):
    rows = spark.createDataFrame([(f"d{i % 7}", i, f"t{i}") for i in range(200)], "doc_key string, chunk_index int, content string").repartition(5)
    got = writers.with_serial(rows, ["doc_key", "chunk_index"]).orderBy("chunk_id").collect()
    assert [r["chunk_id"] for r in got] == list(range(1, 201)) and [(r["doc_key"], r["chunk_index"]) for r in got] == sorted((r["doc_key"], r["chunk_index"]) for r in got)
    digest = writers.dump(rows, f"{tmp_path}/dump")
    assert digest == writers.table_digest(rows.orderBy(F.rand())) != writers.table_digest(rows.limit(199))
    with pytest.raises(ValueError):
        writers.load_into_empty(rows, f"{tmp_path}/dump")
    writers.load_into_empty(rows, f"{tmp_path}/fresh")
    writers.write_result(rows, f"{tmp_path}/result", {"n": 200})
    with pytest.raises(Exception, match="exist"):
        writers.write_result(rows, f"{tmp_path}/result", {"n": 200})


def test_tables(spark):
    writers.drop_tables(spark)
    writers.create_tables(spark)
    writers.create_tables(spark)
    assert spark.table("chunks").columns[:2] == ["chunk_id", "doc_id"] and spark.table("documents").count() == 0
    writers.drop_tables(spark)


def test_stream(spark, tmp_path):
    schema = "k int, v string, w string"
    spark.createDataFrame([(1, "a", "x"), (2, "b", "y")], schema).coalesce(1).write.json(f"{tmp_path}/in/1")
    source = lambda: spark.readStream.schema(schema).json(f"{tmp_path}/in/*")
    stream_upserts(source(), f"{tmp_path}/out", f"{tmp_path}/ck", ["k"], ["v"]).awaitTermination()
    spark.createDataFrame([(2, "B", "Y"), (3, "c", "z")], schema).coalesce(1).write.json(f"{tmp_path}/in/2")
    stream_upserts(source(), f"{tmp_path}/out", f"{tmp_path}/ck", ["k"], ["v"]).awaitTermination()
    assert sorted(map(tuple, read_version(spark, f"{tmp_path}/out", 1).collect())) == [(1, "a", "x"), (2, "B", "y"), (3, "c", "z")]
    assert read_version(spark, f"{tmp_path}/out", 9) is None

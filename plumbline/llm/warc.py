"""WARC archives compressed by Zstandard with a dictionary of their own.

An archive is one leading skippable frame that holds a dictionary built from
the archive's own records, then one frame a record. Equal payloads are stored
once: the record of the smallest id is a response, the others revisit it.
Archives roll at a size, so writers and readers hold a bounded part of one.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from typing import IO
from urllib.parse import unquote, urlsplit

import pandas as pd
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import shared_dir, small_batches, table

SKIPPABLE = 0x184D2A5D
DICTIONARY_BYTES = 64 << 10
#: Uncompressed bytes of records after which an archive ends.
ARCHIVE_BYTES = 24 << 20
#: Bytes of one archive's records, evenly spaced, from which its dictionary is built, and of a piece of them.
TRAINING_BYTES, SAMPLE_BYTES = 4 << 20, 16 << 10
DATE = "2024-01-01T00:00:00Z"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass(frozen=True)
class Record:
    headers: dict[str, str]
    http: dict[str, str]
    payload: bytes


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}>"


def page_of(urn: str) -> int | None:
    found = urn.strip("<>").rpartition(":")[2]
    return None if found == "null" else int(found)


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One uncompressed record; a revisit keeps the HTTP headers and no payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    target = "".join((url or "urn:x-none").split()) or "urn:x-none"
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {target}"]
    lines += ["Content-Type: application/http; msgtype=response", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"WARC-Refers-To: {record_id(refers_to)}"]
    return "\r\n".join([*lines, f"Content-Length: {len(block)}", "", ""]).encode() + block + b"\r\n\r\n"


def parse_record(data: bytes) -> Record:
    head, _, rest = data.partition(b"\r\n\r\n")
    first, *lines = head.decode("utf-8", "replace").split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(headers["Content-Length"])]
    if len(rest) != len(block) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("the record's length is wrong")
    http, _, payload = block.partition(b"\r\n\r\n")
    return Record(headers, dict(x.split(": ", 1) for x in http.decode("utf-8", "replace").split("\r\n")[1:]), payload)


def train(records: list[bytes]) -> zstandard.ZstdCompressionDict | None:
    """A dictionary from pieces that are spread evenly over all records of one
    archive; None if all of them together are under 8 KB, or the trainer finds
    nothing that repeats."""
    pieces = [(i, at) for i, x in enumerate(records) for at in range(0, len(x), SAMPLE_BYTES)]
    step = max(1, -(-sum(map(len, records)) // TRAINING_BYTES))
    samples = [records[i][at : at + SAMPLE_BYTES] for i, at in pieces[::step]]
    # The trainer wants several samples: few are cut finer.
    if len(samples) < 16:
        samples = [x[at : at + 512] for x in samples for at in range(0, len(x), 512)]
    size = min(DICTIONARY_BYTES, sum(map(len, samples)) // 8)
    try:
        return zstandard.train_dictionary(size, samples, k=256, d=8, steps=1, threads=0) if size >= 1024 else None
    except zstandard.ZstdError:
        return None


def archive_frames(records: list[bytes], level: int = 3) -> Iterator[bytes]:
    """The bytes of one archive: dictionary frame, then a frame a record."""
    found = train(records)
    if found is not None:
        raw = found.as_bytes()
        yield struct.pack("<II", SKIPPABLE, len(raw)) + raw
    press = zstandard.ZstdCompressor(level=level, dict_data=found, write_content_size=True, write_checksum=True)
    for record in records:
        yield press.compress(record)


def read_archive(file: IO[bytes], chunk: int = 1 << 20) -> Iterator[bytes]:
    """The records of an archive, one at a time."""
    head, found = file.read(8), None
    if len(head) == 8 and struct.unpack("<I", head[:4])[0] == SKIPPABLE:
        raw = file.read(struct.unpack("<I", head[4:])[0])
        if raw[:4] == b"\x28\xb5\x2f\xfd":
            raw = zstandard.ZstdDecompressor().decompress(raw)
        found, head = zstandard.ZstdCompressionDict(raw), b""
    press, rest = zstandard.ZstdDecompressor(dict_data=found), head
    while rest or (rest := file.read(chunk)):
        frame, parts = press.decompressobj(), []
        while True:
            parts.append(frame.decompress(rest))
            if frame.eof:
                rest = frame.unused_data
                break
            if not (rest := file.read(chunk)):
                raise ValueError("the archive ends inside a frame")
        yield b"".join(parts)


def _opened(uri: str, mode: str) -> IO[bytes]:
    """A file of the shared folder; other schemes than file go through Arrow's file systems."""
    from pyarrow import fs

    if uri.startswith("file:") or "://" not in uri:
        system, path = fs.LocalFileSystem(), unquote(urlsplit(uri).path) if uri.startswith("file:") else uri
    else:
        system, path = fs.FileSystem.from_uri(uri)
    if mode == "r":
        return system.open_input_stream(path, compression=None)
    system.create_dir(path.rpartition("/")[0], recursive=True)
    return system.open_output_stream(path, compression=None)


def with_origin(pages: DataFrame, minimum: int = 0) -> DataFrame:
    """pages(page_id, url, html) with digest and origin: the smallest page_id
    among equal payloads of at least minimum bytes, null where there is only
    one such row or the payload is smaller.

    Only digests and ids are grouped. Digests of over a thousandth of all rows
    are fewer than a thousand and are broadcast; the others are joined by
    shuffle, so that no task gets a large group of copies."""
    digest = F.sha1(F.coalesce(F.col("html"), F.lit("")).cast("binary"))
    keyed = pages.withColumn("digest", digest).withColumn("size", F.octet_length(F.coalesce("html", F.lit(""))))
    groups = keyed.filter(F.col("size") >= minimum).groupBy("digest").agg(F.count("*").alias("n"), F.min("page_id").alias("origin")).filter("n > 1")
    share = max(100, pages.count() // 1000)
    hot = F.broadcast(groups.filter(F.col("n") > share).select(F.col("digest").alias("hot"), F.col("origin").alias("hot_origin")))
    cold = groups.filter(F.col("n") <= share).select(F.col("digest").alias("cold"), "origin")
    out = keyed.join(hot, F.col("digest") == F.col("hot"), "left")
    # A digest is 40 hex digits; a row that has its origin already gets a key of its own that meets none.
    key = F.when(F.col("hot").isNull(), F.col("digest")).otherwise(F.concat(F.lit("-"), F.coalesce(F.col("page_id").cast("string"), F.lit(""))))
    out = out.withColumn("key", key).join(cold, F.col("key") == F.col("cold"), "left")
    return out.select("page_id", "url", "html", F.coalesce("hot_origin", "origin").alias("origin"), F.coalesce(F.col("hot").isNotNull() | F.col("cold").isNotNull(), F.lit(False)).alias("shared"))


def write_archives(pages: DataFrame, folder: str, minimum: int = 0) -> DataFrame:
    """Write a record for every row of pages(page_id, url, html); a DataFrame
    (path, records, bytes) of the archives in folder, which all executors share.

    Every attempt of a task writes files of names of its own, and only those
    that its result names count: what a lost or repeated attempt has written,
    in whatever order it got its rows, is in no list. A null html is an empty payload. Of equal payloads, rows with the smallest
    page_id are responses; null ids count as the largest."""

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        part, held, size, at = TaskContext.get().partitionId(), [], 0, 0

        def roll() -> pd.DataFrame:
            nonlocal held, size, at
            path, stored = f"{folder}/part-{part:06d}-{at:04d}-{uuid.uuid4().hex}.warc.zst", 0
            with _opened(path, "w") as file:
                for frame in archive_frames(held):
                    file.write(frame)
                    stored += len(frame)
            out = pd.DataFrame({"path": [path], "records": [len(held)], "bytes": [stored]})
            held, size, at = [], 0, at + 1
            return out

        for pdf in batches:
            for page_id, url, html, origin, shared in zip(pdf["page_id"], pdf["url"], pdf["html"], pdf["origin"], pdf["shared"], strict=True):
                page_id, origin = (None if pd.isna(x) else int(x) for x in (page_id, origin))
                payload = (html or "").encode("utf-8", "surrogatepass")
                revisit = bool(shared) and page_id != origin
                held.append(record_bytes(page_id, url, payload, payload_digest(payload), origin, revisit))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES:
                    yield roll()
        if held:
            yield roll()

    rows = with_origin(pages, minimum)
    # Ids as text: a column of longs with nulls would reach pandas as doubles.
    rows = rows.withColumns({c: F.col(c).cast("string") for c in ("page_id", "origin")})
    return rows.mapInPandas(write, "path string, records long, bytes long")


def read_records(archives: DataFrame) -> DataFrame:
    """(page_id, url, record_type, payload_bytes, payload_digest, refers_to,
    html) of every record of archives(path); html is null for revisits. A
    response whose payload doesn't have the digest of its header raises."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "html"]
        for pdf in batches:
            for path in pdf["path"]:
                rows, size = [], 0
                with _opened(path, "r") as file:
                    for data in read_archive(file):
                        x = parse_record(data)
                        kind, digest = x.headers["WARC-Type"], x.headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        if kind == "response" and (payload_digest(x.payload) != digest or len(x.payload) != int(x.http["Content-Length"])):
                            raise ValueError(f"a payload of {path} isn't what its headers say")
                        refers = page_of(x.headers["WARC-Refers-To"]) if kind == "revisit" else None
                        rows.append((page_of(x.headers["WARC-Record-ID"]), x.headers["WARC-Target-URI"], kind, int(x.http["Content-Length"]), digest, refers, x.payload.decode("utf-8", "surrogatepass") if kind == "response" else None))
                        size += len(data)
                        if size > 4 << 20:
                            yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})
                            rows, size = [], 0
                if rows:
                    yield pd.DataFrame(rows, columns=names).astype({"page_id": "Int64", "refers_to": "Int64"})

    return archives.select("path").mapInPandas(read, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, html string")


def archive(pages: DataFrame, folder: str | None = None, minimum: int = 0) -> DataFrame:
    """Write pages(page_id, url, html), whose other columns aren't used, and list
    the archives. The list, which Spark commits as a whole, says which files of
    the folder are the archives."""
    spark = pages.sparkSession
    small_batches(spark)
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    listing = f"{folder}-list"
    write_archives(pages, folder, minimum).write.parquet(listing)
    return spark.read.schema("path string, records long, bytes long").parquet(listing)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    paths = archive(pages).select("path")
    back = read_records(paths.repartition(max(spark.sparkContext.defaultParallelism, paths.count())))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


_B32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
OP4_SQL = f"""
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS x FROM pages),
o AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS origin, count(*) OVER (PARTITION BY x) AS n FROM p),
g AS (SELECT *, [('0x' || substr(x, 1 + 5 * i, 5))::BIGINT for i in range(8)] AS b FROM o)
SELECT page_id, payload_bytes,
       array_to_string([substr('{_B32}', 1 + ((b[1 + i // 4] >> (15 - 5 * (i % 4))) & 31)::BIGINT, 1) for i in range(32)], '') AS payload_digest,
       CASE WHEN n > 1 AND page_id IS DISTINCT FROM origin THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN n > 1 AND page_id IS DISTINCT FROM origin THEN origin END AS refers_to
FROM g
"""

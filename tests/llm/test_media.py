import hashlib
import io
import struct
import zlib

import numpy as np
import pytest

from plumbline.llm import media

RNG = np.random.default_rng(1)


@pytest.mark.parametrize("shape", [(1, 1), (5, 7), (3, 4, 3), (8, 9, 3), (2, 5)])
def test_round_trips(shape):
    x = RNG.integers(0, 256, shape, dtype=np.uint8)
    assert (media.decode(media.encode_netpbm(x)) == x).all()
    assert (media.decode(media.encode_bmp(x)) == x).all()
    assert (media.from_npy(media.to_npy(x)) == x).all()


def test_text_formats():
    assert media.decode(b"P1\n# c\n3 2\n1 0 1\n0 1 0\n").tolist() == [[0, 255, 0], [255, 0, 255]]
    assert media.decode(b"P2 2 1 9 3 9").tolist() == [[85, 255]]
    assert media.decode(b"P2 3 1 1000 0 500 1000").tolist() == [[0, 32768, 65535]]
    assert media.decode(b"P5 2 1 15 \x05\x0f").tolist() == media.decode(b"P2 2 1 3 1 3").tolist() == [[85, 255]]
    assert media.decode(b"P3\n1 1\n255\n1 2 3").tolist() == [[[1, 2, 3]]]
    assert media.decode(b"P4\n3 1\n\xa0").tolist() == [[0, 255, 0]]
    assert media.decode(b"P5 1 1 65535 \x01\x02").tolist() == [[258]]
    with pytest.raises(ValueError):
        media.decode(b"P9")
    with pytest.raises(ValueError):
        media.decode(b"P5 9 9 255 x")


def test_area_resize():
    x = RNG.random((7, 11))
    wide = np.repeat(np.repeat(x, 6, axis=0), 5, axis=1)  # 42 x 55: cells of 6 x 5 cut evenly by 3 x 11
    want = wide.reshape(3, 14, 11, 5).mean(axis=(1, 3))
    assert np.allclose(media.resize_area(x, 3, 11), want)
    assert np.allclose(media.resize_area(x, 7, 11), x)
    assert np.isclose(media.resize_area(x, 1, 1)[0, 0], x.mean())
    assert media.resize_area(x, 20, 30).shape == (20, 30)


def test_hash_follows_shade():
    ramp = np.tile(np.arange(90, dtype=np.uint8), (64, 1))
    assert media.difference_hash(ramp) == "f" * 16
    assert media.difference_hash(ramp[:, ::-1]) == "0" * 16


def test_resize_is_the_mean_of_areas():
    """Against sums over pixels, each by the share of it that a cell covers."""
    for h, w, hh, ww in ((7, 5, 3, 4), (3, 24, 16, 16), (10, 9, 8, 9), (1, 1, 2, 3)):
        x = RNG.integers(0, 256, (h, w, 3)).astype(float)
        cover = lambda n, m: np.array([[max(0.0, min((i + 1) * n / m, j + 1) - max(i * n / m, j)) for j in range(n)] for i in range(m)]) * m / n
        want = np.einsum("ij,jkc,lk->ilc", cover(h, hh), x, cover(w, ww))
        assert np.allclose(media.resize_area(x, hh, ww), want)


def test_bmp_with_the_short_header():
    rows = bytes([1, 2, 3, 4, 5, 6, 0, 0, 7, 8, 9, 10, 11, 12, 0, 0])
    short = struct.pack("<2sIHHIIHHHH", b"BM", 26 + len(rows), 0, 0, 26, 12, 2, 2, 1, 24) + rows
    assert media.decode(short).tolist() == [[[9, 8, 7], [12, 11, 10]], [[3, 2, 1], [6, 5, 4]]]
    palette = bytes([0, 0, 0, 9, 9, 9])
    short = struct.pack("<2sIHHIIHHHH", b"BM", 36, 0, 0, 32, 12, 2, 1, 1, 1) + palette + b"\x40\0\0\0"
    assert media.decode(short).tolist() == [[0, 9]]


def test_payloads():
    kinds = set()
    for n in (0, 1, 575, 576, 577, 100_000, 576 * 4):
        data = bytes(RNG.integers(0, 256, n, dtype=np.uint8))
        stored = media.store_payload(data)
        back = np.ascontiguousarray(media.decode(stored)).tobytes()
        kinds.add(stored[:2])
        assert len(back) == max(1, -(-n // 576)) * 576
        assert back[:n] == data and set(back[n:]) <= {255}
    assert kinds == {b"P6", b"BM"}


def test_query_by_hand(spark):
    """Digests of all texts and media recomputed from the texts alone, features by sums over pixels."""
    rows = {r["doc_id"]: r for r in media.op2_media_columns(spark, "/root/testdata/sf0.001").collect()}
    texts = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    assert len(rows) == len(texts) == 200
    for t in texts:
        r, raw = rows[t["doc_id"]], (t["text"] or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 if raw else 576)
        samples = [payload[i : i + 72] for i in range(0, len(payload), 72)]
        if len(payload) // 576 % 2:
            file = b"P6\n24 %d\n255\n" % len(samples) + payload
        else:
            swapped = b"".join(row[i + 2 : i - 1 if i else None : -1] if i else row[2::-1] for row in reversed(samples) for i in range(0, 72, 3))
            file = struct.pack("<2sIHHIIiiHHIIiiII", b"BM", 54 + len(payload), 0, 0, 54, 40, 24, len(samples), 1, 24, 0, len(payload), 2835, 2835, 0, 0) + swapped
        assert (r["n_bytes"], r["payload_bytes"], r["media_bytes"]) == (len(raw), len(payload), len(file))
        assert r["payload_sha256"] == hashlib.sha256(payload).hexdigest() and r["tail_crc32"] == zlib.crc32(payload[-32:])
        assert r["media_sha256"] == hashlib.sha256(file).hexdigest()
        pixels = np.frombuffer(payload, np.uint8).reshape(-1, 24, 3).astype(float)
        # Shares of pixels in cells as whole numbers, so that nothing rounds before the division.
        cover = lambda n, m: np.array([[max(0, min((i + 1) * n, (j + 1) * m) - max(i * n, j * m)) for j in range(n)] for i in range(m)])
        area = lambda x, h, w: np.einsum("ij,jkc,lk->ilc", cover(x.shape[0], h), x, cover(x.shape[1], w)) / (x.shape[0] * x.shape[1])
        cells = np.rint(area((pixels @ np.array([299.0, 587.0, 114.0]))[:, :, None], 8, 9)[:, :, 0] / 62.5)
        assert r["feature"].split(":")[0] == np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()
        tile = np.rint(area(pixels, 16, 16)).astype(np.uint8)
        np.save(out := io.BytesIO(), tile)
        assert r["feature"].split(":")[1] == f"{zlib.crc32(out.getvalue()):08x}"


def test_edges(spark, tmp_path):
    rows = [(None, None), (1, ""), (2, None), (3, "é" * 300_000), (1, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = media.op2_media_columns(spark, str(tmp_path)).collect()
    assert sorted((r["doc_id"] or 0, r["n_bytes"]) for r in got) == [(0, 0), (1, 0), (1, 0), (2, 0), (3, 600_000)]
    spark.createDataFrame([], "doc_id long, text string, media string, tile int").write.parquet(f"{tmp_path}/none/documents.parquet")
    assert media.op2_media_columns(spark, f"{tmp_path}/none").count() == 0


def test_tiles(spark):
    x = RNG.integers(0, 256, (30, 40, 3), dtype=np.uint8)
    rows = [(1, bytearray(media.encode_bmp(x)), "a"), (2, bytearray(media.encode_netpbm(x)), "b"), (3, None, "c"), (4, bytearray(b"P6 x"), "d")]
    df = spark.createDataFrame(rows, "id long, media binary, dhash string")
    got = {r["id"]: r for r in media.media_tiles(df).collect()}
    assert got[1]["tile"] == got[2]["tile"] and got[1]["dhash"] == got[2]["dhash"]
    assert media.from_npy(bytes(got[1]["tile"])).shape == (16, 16, 3)
    assert (got[1]["media_height"], got[1]["media_width"], got[1]["media_channels"]) == (30, 40, 3)
    assert got[3]["media_error"] == "null" and got[4]["media_error"] and got[4]["tile"] is None
    assert media.media_tiles(df.limit(0)).count() == 0

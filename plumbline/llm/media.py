"""Media columns: Netpbm and BMP files as binary columns, decoded to numpy
arrays, resized by area with integral images, and written as NPY tiles with
difference hashes."""

from __future__ import annotations

import hashlib
import io
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import materialize, small_batches, table

#: Bytes of one block of the lossless store: 8 rows of 24 pixels of 3 samples.
BLOCK = 576
WIDTH = 24


def encode_netpbm(pixels: np.ndarray) -> bytes:
    """uint8 (h, w) as P5, (h, w, 3) as P6."""
    h, w = pixels.shape[:2]
    return b"%s\n%d %d\n255\n" % (b"P5" if pixels.ndim == 2 else b"P6", w, h) + np.ascontiguousarray(pixels, np.uint8).tobytes()


_FIELD = re.compile(rb"(?:\s+|#[^\n]*\n)*(\d+)")


def decode_netpbm(data: bytes) -> np.ndarray:
    """P1 to P6 as uint8 or uint16 (h, w) or (h, w, 3), by the file's own maximum
    scaled to the type's; bitmaps give 0 for black, 255 for white."""
    kind, at, head = data[:2], 2, []
    if not re.fullmatch(rb"P[1-6]", kind):
        raise ValueError("not a Netpbm file")
    for _ in range(2 if kind in (b"P1", b"P4") else 3):
        if not (m := _FIELD.match(data, at)):
            raise ValueError("Netpbm header ends early")
        head.append(int(m[1]))
        at = m.end()
    w, h, top = (*head, 1)[:3] if len(head) == 2 else head
    shape = (h, w, 3) if kind in (b"P3", b"P6") else (h, w)
    if not 0 < top < 65536:
        raise ValueError("Netpbm maximum out of range")
    if kind == b"P1":
        bits = np.frombuffer(re.sub(rb"#[^\n]*|[^01]", b"", data[at:]), np.uint8)[: h * w] - 48
        out = (1 - bits) * 255
    elif kind in (b"P2", b"P3"):
        out = np.array(re.sub(rb"#[^\n]*", b"", data[at:]).split()[: int(np.prod(shape))], dtype=np.int64)
    elif kind == b"P4":
        row = (w + 7) // 8
        bits = np.unpackbits(np.frombuffer(data, np.uint8, row * h, at + 1).reshape(h, row), axis=1)[:, :w]
        out = (1 - bits) * 255
    else:
        out = np.frombuffer(data, np.uint8 if top < 256 else ">u2", int(np.prod(shape)), at + 1)
    if out.size != int(np.prod(shape)):
        raise ValueError("Netpbm samples end early")
    full = 255 if top < 256 or kind in (b"P1", b"P4") else 65535
    if kind in (b"P1", b"P4") or top == full:
        return out.reshape(shape).astype(np.uint8 if full == 255 else np.uint16, copy=False)
    scaled = (np.minimum(out, top).astype(np.int64) * (2 * full) + top) // (2 * top)
    return scaled.reshape(shape).astype(np.uint8 if full == 255 else np.uint16)


def encode_bmp(pixels: np.ndarray) -> bytes:
    """uint8 (h, w) as 8 bits with a grey palette, (h, w, 3) as 24 bits; rows bottom up, padded to 4 bytes."""
    h, w = pixels.shape[:2]
    grey = pixels.ndim == 2
    rows = pixels[::-1].reshape(h, -1) if grey else pixels[::-1, :, ::-1].reshape(h, -1)
    rows = np.pad(rows, ((0, 0), (0, -rows.shape[1] % 4)))
    palette = np.repeat(np.arange(256, dtype=np.uint8), 4).reshape(256, 4) * np.array([1, 1, 1, 0], np.uint8) if grey else np.zeros(0, np.uint8)
    at, body = 54 + palette.size, rows.astype(np.uint8).tobytes()
    head = struct.pack("<2sIHHI", b"BM", at + len(body), 0, 0, at)
    info = struct.pack("<IiiHHIIiiII", 40, w, h, 1, 8 if grey else 24, 0, len(body), 2835, 2835, 256 if grey else 0, 0)
    return head + info + palette.tobytes() + body


def decode_bmp(data: bytes) -> np.ndarray:
    """1, 4, 8, 24 and 32 bits without compression as uint8 (h, w) if the palette
    is grey, else (h, w, 3); the header of 12 bytes is read as well."""
    if data[:2] != b"BM":
        raise ValueError("not a BMP file")
    at, size = struct.unpack_from("<II", data, 10)
    if size == 12:
        w, h, _, bits, packed, entry, used = *struct.unpack_from("<HHHH", data, 18), 0, 3, 0
    else:
        w, h, _, bits, packed = struct.unpack_from("<iiHHI", data, 18)
        entry, used = 4, struct.unpack_from("<I", data, 46)[0]
    if packed not in (0, 3) or bits not in (1, 4, 8, 24, 32) or (packed == 3 and bits != 32):
        raise ValueError(f"BMP of {bits} bits with compression {packed} isn't read")
    up, h = h > 0, abs(h)
    row = (w * bits + 31) // 32 * 4
    rows = np.frombuffer(data, np.uint8, row * h, at).reshape(h, row)
    rows = rows[::-1] if up else rows
    if bits >= 24:
        return rows[:, : w * bits // 8].reshape(h, w, bits // 8)[:, :, 2::-1]
    if bits < 8:
        parts = np.unpackbits(rows, axis=1).reshape(h, -1, bits)
        rows = parts @ (1 << np.arange(bits - 1, -1, -1)).astype(np.uint8)
    used = used or 1 << bits
    palette = np.frombuffer(data, np.uint8, entry * used, 14 + size).reshape(used, entry)[:, 2::-1]
    out = palette[rows[:, :w]]
    return out[:, :, 0] if (palette == palette[:, :1]).all() else out


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def integral_image(pixels: np.ndarray) -> np.ndarray:
    """Sums of all pixels above and to the left of each corner, one row and column more than pixels."""
    out = np.zeros((pixels.shape[0] + 1, pixels.shape[1] + 1, *pixels.shape[2:]))
    np.cumsum(np.cumsum(pixels, axis=0, dtype=np.float64), axis=1, out=out[1:, 1:])
    return out


def _corners(have: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of n + 1 evenly spaced edges over `have` pixels, the whole position before each and what is left, in n-ths."""
    edges = np.arange(n + 1) * have
    low = np.minimum(edges // n, have - 1)
    return low, edges - low * n


def resize_area(pixels: np.ndarray, height: int, width: int) -> np.ndarray:
    """Mean of each target cell's area, cells may cut pixels: differences of the
    integral image at the cells' corners, where it is bilinear between whole
    positions. For whole samples all sums are whole numbers, so that only the last division rounds."""
    total = integral_image(pixels)
    (y, dy), (x, dx) = _corners(pixels.shape[0], height), _corners(pixels.shape[1], width)
    dy, dx = dy.reshape(-1, 1, *[1] * (pixels.ndim - 2)), dx.reshape(1, -1, *[1] * (pixels.ndim - 2))
    upper = total[np.ix_(y, x)] * (width - dx) + total[np.ix_(y, x + 1)] * dx
    lower = total[np.ix_(y + 1, x)] * (width - dx) + total[np.ix_(y + 1, x + 1)] * dx
    at = upper * (height - dy) + lower * dy
    return (at[1:, 1:] - at[:-1, 1:] - at[1:, :-1] + at[:-1, :-1]) / (pixels.shape[0] * pixels.shape[1])


def grey(pixels: np.ndarray) -> np.ndarray:
    """Luma in thousandths of a sample, whole numbers for whole samples."""
    return pixels * 1000.0 if pixels.ndim == 2 else pixels @ np.array([299.0, 587.0, 114.0])


def difference_hash(pixels: np.ndarray) -> str:
    """64 bits as hex: is a cell of 8 rows of 9 darker, in sixteenths, than its right neighbour?"""
    cells = np.rint(resize_area(grey(pixels), 8, 9) / 62.5)
    return np.packbits(cells[:, :-1] < cells[:, 1:]).tobytes().hex()


def to_npy(pixels: np.ndarray) -> bytes:
    np.save(out := io.BytesIO(), pixels, allow_pickle=False)
    return out.getvalue()


def from_npy(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(data), allow_pickle=False)


def tile_of(pixels: np.ndarray, side: int) -> bytes:
    return to_npy(np.clip(np.rint(resize_area(pixels, side, side)), 0, 65535).astype(pixels.dtype.newbyteorder("=")))


def media_tiles(df: DataFrame, media: str = "media", side: int = 16) -> DataFrame:
    """df with media_height, media_width, media_channels, tile (NPY bytes of a
    side by side tile), dhash and media_error.

    A null, broken or empty image gives nulls and the reason in media_error.
    Repeated rows give repeated results; columns of df with the names of the
    new ones are replaced, others pass."""
    fields = "media_height int, media_width int, media_channels int, tile binary, dhash string, media_error string"
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name not in {x.split()[0] for x in fields.split(", ")}] + [fields])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def one(data: bytes | None) -> tuple:
            if data is None:
                return None, None, None, None, None, "null"
            try:
                pixels = decode(bytes(data))
                if not pixels.size:
                    raise ValueError("no pixels")
                return *pixels.shape[:2], 1 if pixels.ndim == 2 else 3, tile_of(pixels, side), difference_hash(pixels), None
            except (ValueError, struct.error, IndexError) as e:
                return None, None, None, None, None, str(e)

        for pdf in batches:
            found = pd.DataFrame([one(x) for x in pdf[media]], columns=[x.split()[0] for x in fields.split(", ")], index=pdf.index)
            yield pd.concat([pdf.drop(columns=[c for c in found if c in pdf]), found.astype({c: "Int32" for c in found.columns[:3]})], axis=1)

    return df.mapInPandas(run, schema)


def store_payload(data: bytes) -> bytes:
    """data, padded by bytes 255 to a positive multiple of BLOCK, as rows of WIDTH
    pixels: a P6 file for an odd number of blocks, a BMP file for an even one."""
    blocks = max(1, -(-len(data) // BLOCK))
    pixels = np.frombuffer(data.ljust(blocks * BLOCK, b"\xff"), np.uint8).reshape(-1, WIDTH, 3)
    return encode_netpbm(pixels) if blocks % 2 else encode_bmp(pixels)


def text_media(docs: DataFrame, folder: list[str] | None = None) -> DataFrame:
    """(doc_id, n_bytes, media): every text of docs(doc_id, text) stored as an
    image in the shared folder; a null text counts as empty."""
    small_batches(docs.sparkSession)

    @F.pandas_udf("binary")
    def stored(texts: pd.Series) -> pd.Series:
        return pd.Series([store_payload((x or "").encode("utf-8", "surrogatepass")) for x in texts], dtype="object")

    rows = docs.select(F.col("doc_id").cast("long"), F.octet_length(F.coalesce("text", F.lit(""))).cast("long").alias("n_bytes"), stored(F.col("text")).alias("media"))
    return materialize(rows, "media", folder)


def payload_digests(media: Column) -> Column:
    """struct(payload_bytes, payload_sha256, tail_crc32) of the samples of stored media."""

    @F.pandas_udf("payload_bytes long, payload_sha256 string, tail_crc32 long")
    def of(files: pd.Series) -> pd.DataFrame:
        rows = []
        for data in files:
            back = np.ascontiguousarray(decode(bytes(data))).tobytes()
            rows.append((len(back), hashlib.sha256(back).hexdigest(), zlib.crc32(back[-32:])))
        return pd.DataFrame(rows, columns=["payload_bytes", "payload_sha256", "tail_crc32"])

    return of(media)


def op2_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text stored as an image and read back; feature is the difference
    hash and the CRC-32 of the NPY tile of media_tiles(). A null text counts as
    empty; a null id stays null; repeated rows give repeated rows; an empty
    table none; other columns of the table aren't used."""
    tiles = media_tiles(text_media(table(spark, sf_dir, "documents").select("doc_id", "text")))
    feature = F.concat_ws(":", "dhash", F.lpad(F.lower(F.hex(F.crc32("tile"))), 8, "0"))
    return tiles.withColumn("p", payload_digests(F.col("media"))).select("doc_id", "n_bytes", "p.payload_bytes", "p.payload_sha256", "p.tail_crc32", F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), feature.alias("feature"))

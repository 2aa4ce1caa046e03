"""Images in columns: Netpbm and BMP decoded to numpy, area-resized by integral images, kept as NPY tiles with hashes."""

from __future__ import annotations

import hashlib
import io
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import raw_texts, text_column, text_groups

#: Side of the square tile that is kept of each image, and of the grid that the difference hash compares.
TILE, HASH_ROWS, HASH_COLS = 16, 8, 9
#: Bytes in a row of a payload that is stored as an image.
ROW_BYTES = 64


def _numbers(data: bytes, at: int, count: int) -> tuple[list[int], int]:
    """Header numbers of a Netpbm file; comments run from # to the line's end."""
    out: list[int] = []
    while len(out) < count:
        while data[at : at + 1].isspace():
            at += 1
        if data[at : at + 1] == b"#":
            at = data.index(b"\n", at) + 1
            continue
        end = at
        while data[end : end + 1].isdigit():
            end += 1
        if end == at:
            raise ValueError("no number where the header needs one")
        out.append(int(data[at:end]))
        at = end
    return out, at


def decode_netpbm(data: bytes) -> np.ndarray:
    """Samples (rows, columns, channels) of a P1 to P6 file; bitmaps give 0 for black and 1 for white."""
    kind = data[:2]
    if kind not in (b"P1", b"P2", b"P3", b"P4", b"P5", b"P6"):
        raise ValueError("no Netpbm file")
    bitmap, channels = kind in (b"P1", b"P4"), 3 if kind in (b"P3", b"P6") else 1
    head, at = _numbers(data, 2, 2 if bitmap else 3)
    width, height, top = head[0], head[1], 1 if bitmap else head[2]
    if not 0 < top < 65536:
        raise ValueError("the largest sample must lie between 1 and 65535")
    if not (width and height):
        raise ValueError("an image has at least one sample")
    n = width * height * channels
    if kind == b"P1":
        bits = bytes(c for c in data[at:] if c in b"01")[:n]
        flat = 1 - (np.frombuffer(bits, np.uint8) - 48)
    elif kind in (b"P2", b"P3"):
        flat = np.array(data[at:].split()[:n], np.int64)
        if len(flat) and not 0 <= flat.min() <= flat.max() <= top:
            raise ValueError("a sample lies outside 0 to the largest")
        flat = flat.astype(np.uint8 if top < 256 else np.uint16)
    elif kind == b"P4":
        row = (width + 7) // 8
        packed = np.frombuffer(data, np.uint8, row * height, at + 1).reshape(height, row)
        flat = 1 - np.unpackbits(packed, axis=1)[:, :width].reshape(-1)
    else:
        flat = np.frombuffer(data, np.uint8 if top < 256 else ">u2", n, at + 1)
        if top not in (255, 65535) and flat.max() > top:
            raise ValueError("a sample lies outside 0 to the largest")
    if len(flat) < n:
        raise ValueError("the file is shorter than its header says")
    return flat.reshape(height, width, channels)


def encode_netpbm(samples: np.ndarray) -> bytes:
    """P5 or P6, 8 bits a sample."""
    height, width, channels = samples.shape
    return b"P%d\n%d %d\n255\n" % (5 if channels == 1 else 6, width, height) + np.ascontiguousarray(samples, np.uint8).tobytes()


def decode_bmp(data: bytes) -> np.ndarray:
    """Samples (rows, columns, channels RGB or 1) of an uncompressed BMP of 8, 24 or 32 bits a pixel."""
    if data[:2] != b"BM":
        raise ValueError("no BMP file")
    le = lambda a, n=4, signed=False: int.from_bytes(data[a : a + n], "little", signed=signed)
    start, header, width, height, bits, packing = le(10), le(14), le(18, signed=True), le(22, signed=True), le(28, 2), le(30)
    if packing not in (0, 3) or bits not in (8, 24, 32) or width <= 0 or height == 0:
        raise ValueError("only plain BMP files of 8, 24 or 32 bits with at least one sample are read")
    row = (width * bits // 8 + 3) // 4 * 4
    grid = np.frombuffer(data, np.uint8, row * abs(height), start).reshape(abs(height), row)
    if height > 0:  # rows stand bottom up
        grid = grid[::-1]
    pixels = grid[:, : width * bits // 8].reshape(abs(height), width, bits // 8)
    if bits == 8:
        colours = (le(46) or 256) if header >= 40 else 256
        palette = np.frombuffer(data, np.uint8, colours * 4, 14 + header).reshape(colours, 4)
        pixels = palette[pixels[:, :, 0]]
    out = pixels[:, :, 2::-1]
    return out[:, :, :1] if (out == out[:, :, :1]).all() else out


def encode_bmp(samples: np.ndarray) -> bytes:
    """8-bit grey with a palette, or 24-bit colour."""
    height, width, channels = samples.shape
    bits = 8 if channels == 1 else 24
    row = (width * bits // 8 + 3) // 4 * 4
    palette = b"".join(bytes((i, i, i, 0)) for i in range(256)) if bits == 8 else b""
    grid = np.zeros((height, row), np.uint8)
    grid[:, : width * bits // 8] = samples[::-1, :, ::-1].reshape(height, -1)
    start = 54 + len(palette)
    pack = lambda n, size=4: int(n).to_bytes(size, "little")
    head = b"BM" + pack(start + grid.size) + pack(0) + pack(start) + pack(40) + pack(width) + pack(height) + pack(1, 2) + pack(bits, 2)
    return head + pack(0) + pack(grid.size) + pack(2835) * 2 + pack(256 if palette else 0) + pack(0) + palette + grid.tobytes()


def decode(data: bytes) -> np.ndarray:
    return decode_bmp(data) if data[:2] == b"BM" else decode_netpbm(data)


def integral(samples: np.ndarray) -> np.ndarray:
    """The sums of all samples above and left of each corner."""
    height, width = samples.shape[:2]
    sums = np.zeros((height + 1, width + 1, samples.shape[2]))
    np.cumsum(samples, axis=0, dtype=np.float64, out=sums[1:, 1:])
    return np.cumsum(sums, axis=1, out=sums)


def area_resized(samples: np.ndarray, rows: int, cols: int, sums: np.ndarray | None = None) -> np.ndarray:
    """Means over the rows x cols equal rectangles of an image, parts of samples by their area (by its integral image)."""
    height, width = samples.shape[:2]
    sums = integral(samples) if sums is None else sums

    def at_edges(values: np.ndarray, n: int, parts: int) -> np.ndarray:
        edge = np.arange(parts + 1) * n / parts
        low = np.minimum(edge.astype(np.int64), n - 1)
        share = (edge - low).reshape(-1, *[1] * (values.ndim - 1))
        return values[low] + share * (values[low + 1] - values[low])

    sums = at_edges(sums, height, rows)
    sums = at_edges(sums.swapaxes(0, 1), width, cols).swapaxes(0, 1)
    boxes = sums[1:, 1:] - sums[:-1, 1:] - sums[1:, :-1] + sums[:-1, :-1]
    return boxes * (rows * cols / (height * width))


def npy(array: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, array)
    return out.getvalue()


def features(samples: np.ndarray) -> tuple[bytes, str]:
    """The NPY file of an image's tile (uint8) and its difference hash (16 hex digits)."""
    sums = integral(samples)
    tile = np.clip(np.rint(area_resized(samples, TILE, TILE, sums)), 0, 255).astype(np.uint8)
    grey = area_resized(samples, HASH_ROWS, HASH_COLS, sums).mean(axis=2)
    bits = np.packbits(np.round(grey[:, 1:], 6) > np.round(grey[:, :-1], 6))
    return npy(tile), bits.tobytes().hex()


def payload_of(raw: bytes) -> bytes:
    """The bytes and zeros behind them, up to a positive multiple of the row length."""
    return raw + bytes(-len(raw) % ROW_BYTES) if raw else bytes(ROW_BYTES)


MEDIA = "doc_id long, n_bytes long, media binary, tile binary, dhash string"


def stored_media(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text's bytes as a grey Netpbm image of 64 columns, with the tile and hash of what is read back.

    Rows (doc_id, n_bytes, media, tile, dhash). A null text counts as empty (one row of zeros). Equal texts give equal
    values; null and repeated ids are kept; extra columns are ignored; an empty table gives no rows. No shuffle, memory
    bounded by the longest text.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in text_groups(batch):
                data, offsets = raw_texts(part.column(1))
                flat, media, tiles, hashes = data.tobytes(), [], [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    payload = payload_of(flat[a:b])
                    stored = encode_netpbm(np.frombuffer(payload, np.uint8).reshape(-1, ROW_BYTES, 1))
                    tile, dhash = features(decode(stored))
                    media.append(stored)
                    tiles.append(tile)
                    hashes.append(dhash)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(np.diff(offsets)), pa.array(media, pa.binary()), pa.array(tiles, pa.binary()), pa.array(hashes, pa.string())], names=["doc_id", "n_bytes", "media", "tile", "dhash"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_column(text_col).alias("text"))
    return picked.mapInArrow(run, MEDIA)


DECODED = "rows int, cols int, channels int, tile binary, dhash string, error string"


def with_decoded(media: DataFrame, media_col: str = "media") -> DataFrame:
    """media with what its images hold: the columns rows, cols, channels, tile (NPY), dhash and error.

    Images may be Netpbm (P1 to P6) or BMP files. A null gives nulls; bytes that are no such image give an error text and
    nulls, and fail no task. The other columns stay as they are, in Python as in the plan; a table that has columns of the
    new names is refused. An empty table gives no rows. No shuffle.
    """
    if clash := {x.split()[0] for x in DECODED.split(", ")} & {c.lower() for c in media.columns}:
        raise ValueError(f"the table has columns of the names {sorted(clash)} already")
    schema = T.StructType(media.schema.fields + T._parse_datatype_string(DECODED).fields)
    at = media.columns.index(media_col)
    names = [x.split()[0] for x in DECODED.split(", ")]
    kinds = [pa.int32()] * 3 + [pa.binary(), pa.string(), pa.string()]

    def decoded(data: bytes | None) -> tuple:
        if data is None:
            return (None,) * 6
        try:
            image = decode(data)
            return (*image.shape, *features(image), None)
        except (ValueError, IndexError, ArithmeticError, MemoryError) as error:
            return (None, None, None, None, None, str(error) or type(error).__name__)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):  # one image at a time, as each may be large
                found = decoded(batch.column(at)[i].as_py())
                yield pa.RecordBatch.from_arrays([*batch.slice(i, 1).columns, *(pa.array([x], k) for x, k in zip(found, kinds))], names=[*batch.schema.names, *names])

    return media.mapInArrow(run, schema)


DIGEST = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"


def media_digests(media: DataFrame) -> DataFrame:
    """What stored media hold, read back from their bytes: payload digests, and the feature (dhash and tile checksum).

    media: the rows of stored_media(); null or broken bytes give null digests. Repeated rows and null ids stay; extra
    columns are ignored; an empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc, n, stored, tile, dhash in zip(*(c.to_pylist() for c in batch.columns)):
                try:
                    payload = decode(stored or b"").tobytes()
                except (ValueError, IndexError, ArithmeticError):
                    rows.append((doc, n, *[None] * 6))
                    continue
                rows.append((doc, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-ROW_BYTES:]), len(stored), hashlib.sha256(stored).hexdigest(), f"{dhash}-{zlib.crc32(tile):08x}"))
            kinds = [pa.int64()] * 3 + [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            cols = list(zip(*rows)) or [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], names=[x.split()[0] for x in DIGEST.split(", ")])

    return media.select("doc_id", "n_bytes", "media", "tile", "dhash").mapInArrow(run, DIGEST)

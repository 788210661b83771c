"""Image files as relations, without an imaging library: PNG and BMP codecs, and the packed tree format."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators.topology import nodes
from tessera.session import ship

PNG_MAGIC = b"\x89PNG\r\n\x1a\n"
TREE_MAGIC, MIXED = 0x51494D47, 0xFFFF


class BadImage(ValueError):
    """A file that isn't an image of the wanted form."""


#: First column and row, and steps between columns and rows, of the passes of an interlaced picture.
PASSES = ((0, 0, 8, 8), (4, 0, 8, 8), (0, 4, 4, 8), (2, 0, 4, 4), (0, 2, 2, 4), (1, 0, 2, 2), (0, 1, 1, 2))
#: The depths that each kind of picture may have, and its channels.
DEPTHS = {0: (1, 2, 4, 8, 16), 2: (8, 16), 3: (1, 2, 4, 8), 4: (8, 16), 6: (8, 16)}
CHANNELS = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}


def _chunks(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(name, body) up to the end chunk; a chunk that must be understood has to have its right sum."""
    at = 8
    while True:
        size, name = struct.unpack(">I4s", data[at : at + 8])
        body, crc = data[at + 8 : at + 8 + size], data[at + 8 + size : at + 12 + size]
        if len(crc) < 4:
            raise BadImage("a PNG that ends too early")
        if name[0] & 32 == 0 and struct.unpack(">I", crc)[0] != zlib.crc32(name + body):
            raise BadImage(f"a wrong sum in a chunk {name!r}")
        if name == b"IEND":
            return
        yield name, body
        at += 12 + size


def decode_png(data: bytes, strict: bool = False) -> np.ndarray:
    """Rows of RGBA bytes, of plain and interlaced files. strict: only 8-bit RGB or RGBA; else 16 bits lose their low byte, palettes and greys become RGB."""
    if data[:8] != PNG_MAGIC:
        raise BadImage("no PNG")
    raw, palette, clear, head = [], None, None, None
    for name, body in _chunks(data):
        if name == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif name == b"PLTE":
            palette = np.frombuffer(body, np.uint8).reshape(-1, 3)
        elif name == b"tRNS":
            clear = np.frombuffer(body, np.uint8)
        elif name == b"IDAT":
            raw.append(body)
    if head is None:
        raise BadImage("a PNG without a header")
    w, h, depth, kind, packing, filters, lace = head
    if not w or not h or packing or filters or lace > 1 or depth not in DEPTHS.get(kind, ()) or strict and (depth != 8 or kind not in (2, 6)):
        raise BadImage("a form of PNG that isn't read")
    if kind == 3 and palette is None:
        raise BadImage("a PNG without its palette")
    channels = CHANNELS[kind]
    parts = [(x, y, dx, dy, -(-(w - x) // dx), -(-(h - y) // dy)) for x, y, dx, dy in (PASSES if lace else ((0, 0, 1, 1),)) if x < w and y < h]
    lines = [1 + -(-pw * channels * depth // 8) for *_, pw, _ in parts]
    whole = sum(n * part[5] for n, part in zip(lines, parts, strict=True))
    # no more is unpacked than the picture needs, whatever the file holds
    body = zlib.decompressobj().decompress(b"".join(raw), whole)
    if len(body) < whole:
        raise BadImage("a PNG with too few pixels")
    px, at = np.zeros((h, w, channels), np.uint8), 0
    for (x, y, dx, dy, pw, ph), line in zip(parts, lines, strict=True):
        rows = np.frombuffer(body, np.uint8, line * ph, at).reshape(ph, line)
        at += line * ph
        px[y::dy, x::dx] = _samples(unfilter(rows[:, 0], rows[:, 1:], max(1, channels * depth // 8)), pw, channels, depth, kind)
    full = np.full((h, w, 1), 255, np.uint8)
    if kind == 3:
        if int(px.max()) >= len(palette):
            raise BadImage("a colour beyond the palette")
        alpha = np.full(256, 255, np.uint8)
        if clear is not None:
            alpha[: len(clear)] = clear[:256]
        return np.concatenate([palette[px[:, :, 0]], alpha[px]], axis=2)
    if kind in (0, 4):
        return np.concatenate([px[:, :, :1].repeat(3, 2), px[:, :, 1:] if kind == 4 else full], axis=2)
    return px if kind == 6 else np.concatenate([px, full], axis=2)


def _samples(lines: np.ndarray, w: int, channels: int, depth: int, kind: int) -> np.ndarray:
    """Lines of bytes as (rows, w, channels) of one byte each; greys of few bits take the whole range."""
    if depth < 8:
        px = np.unpackbits(lines, axis=1).reshape(len(lines), -1, depth)[:, : w * channels]
        px = (px * (1 << np.arange(depth - 1, -1, -1))).sum(2).astype(np.uint8)
        px = px if kind == 3 else px * (255 // ((1 << depth) - 1))
    else:
        px = lines if depth == 8 else lines[:, ::2]
    return px.reshape(len(lines), w, channels)


def unfilter(kinds: np.ndarray, lines: np.ndarray, step: int) -> np.ndarray:
    """Lines without their filters: by whole lines where none hangs on both neighbours, else by the diagonals of the picture.

    A pixel hangs on its left, upper and upper left neighbours, so those of a diagonal don't hang on each other.
    """
    if kinds.max(initial=0) > 4:
        raise BadImage("an unknown filter")
    h, n = lines.shape
    w = -(-n // step)
    if (kinds <= 2).all():
        out, above = np.zeros((h, w * step), np.uint8), np.zeros(w * step, np.uint8)
        out[:, :n] = lines
        for y in range(h):
            if kinds[y] == 1:
                out[y] = np.cumsum(out[y].reshape(w, step), axis=0, dtype=np.uint8).reshape(-1)
            elif kinds[y] == 2:
                out[y] += above
            above = out[y]
        return out[:, :n]
    slanted = np.zeros((w + h, h, step), np.int16)
    padded = np.zeros((h, w * step), np.uint8)
    padded[:, :n] = lines
    padded = padded.reshape(h, w, step)
    for y in range(h):
        slanted[y : y + w, y] = padded[y]
    have = [(kinds == k)[:, None] for k in range(5)]
    some = [bool(x.any()) for x in have]
    before, left = np.zeros((h + 1, step), np.int16), np.zeros((h + 1, step), np.int16)
    for d in range(w + h - 1):
        a, b, c = left[1:], left[:-1], before[:-1]
        guess = np.where(have[1], a, 0) if some[1] else 0
        if some[2]:
            guess = np.where(have[2], b, guess)
        if some[3]:
            guess = np.where(have[3], (a + b) >> 1, guess)
        if some[4]:
            pa, pb = b - c, a - c
            pc = np.abs(pa + pb)
            pa, pb = np.abs(pa), np.abs(pb)
            guess = np.where(have[4], np.where((pa <= pb) & (pa <= pc), a, np.where(pb <= pc, b, c)), guess)
        slanted[d] = (slanted[d] + guess) & 255
        # what lies left of the picture stays 0
        before, left = left, np.concatenate([np.zeros((1, step), np.int16), slanted[d]])
    out = np.stack([slanted[y : y + w, y] for y in range(h)]).astype(np.uint8)
    return out.reshape(h, w * step)[:, :n]


def encode_png(pixels: np.ndarray) -> bytes:
    """PNG of rows of RGB or RGBA bytes."""
    h, w, c = pixels.shape
    raw = np.concatenate([np.zeros((h, 1), np.uint8), pixels.reshape(h, w * c)], axis=1).tobytes()

    def chunk(name: bytes, body: bytes) -> bytes:
        return struct.pack(">I", len(body)) + name + body + struct.pack(">I", zlib.crc32(name + body))

    return PNG_MAGIC + chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, 8, 2 if c == 3 else 6, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def encode_bmp(pixels: np.ndarray) -> bytes:
    """24-bit BMP of rows of RGB or RGBA bytes: bottom row first, rows padded to four bytes."""
    h, w, _ = pixels.shape
    rows = np.zeros((h, (3 * w + 3) & ~3), np.uint8)
    rows[:, : 3 * w] = pixels[::-1, :, 2::-1].reshape(h, 3 * w)
    body = rows.tobytes()
    return struct.pack("<2sIHHI", b"BM", 54 + len(body), 0, 0, 54) + struct.pack("<IiiHHIIiiII", 40, w, h, 1, 24, 0, len(body), 2835, 2835, 0, 0) + body


def decode_bmp(data: bytes) -> np.ndarray:
    """RGB rows of a 24-bit BMP, bottom row first or, where its height is negative, top row first."""
    if data[:2] != b"BM":
        raise BadImage("no BMP")
    start, w, h, depth, packed = struct.unpack("<I", data[10:14])[0], *struct.unpack("<ii", data[18:26]), *struct.unpack("<HI", data[28:34])
    if depth != 24 or packed or w <= 0 or not h:
        raise BadImage("a form of BMP that isn't read")
    rows = np.frombuffer(data, np.uint8, (3 * w + 3 & ~3) * abs(h), start).reshape(abs(h), -1)[:, : 3 * w]
    return rows.reshape(abs(h), w, 3)[:: -1 if h > 0 else 1, :, ::-1]


def glyph_bmp(bits: str, w: int, h: int) -> bytes:
    """Black ink on white from a string of 0 and 1."""
    ink = np.frombuffer(bits.encode(), np.uint8).reshape(h, w) == 49
    return encode_bmp(np.where(ink, 0, 255).astype(np.uint8)[:, :, None].repeat(3, 2))


def encode_tree(w: int, h: int, colours: list[int], payload: list[np.ndarray]) -> bytes:
    """A packed tree: header, a colour for each node, pixels of mixed leaves in node order."""
    return struct.pack("<III", TREE_MAGIC, h << 16 | w, len(colours)) + np.array(colours, "<u2").tobytes() + b"".join(p.astype("<u2").tobytes() for p in payload)


def decode_tree(data: bytes, overlay: bool = True) -> np.ndarray:
    """RGB rows of a packed tree; with the overlay, leaves of one colour get a white falling and a black rising diagonal."""
    magic, size, count = struct.unpack("<III", data[:12])
    w, h = size & 0xFFFF, size >> 16
    # the least number of nodes is known before any is made
    if magic != TREE_MAGIC or not w or not h or 12 + 2 * count > len(data) or 2 * -(-w // 16) * -(-h // 16) - 1 > count:
        raise BadImage("no packed tree")
    tree = nodes(w, h)
    if count != len(tree):
        raise BadImage("no packed tree")
    colours = np.frombuffer(data, "<u2", count, 12)
    at, q = 12 + 2 * count, np.zeros((h, w), np.uint16)
    for i, x0, y0, x1, y1, left, _ in tree:
        if left is not None:
            continue
        if colours[i] == MIXED:
            n = (x1 - x0) * (y1 - y0)
            q[y0:y1, x0:x1] = np.frombuffer(data, "<u2", n, at).reshape(y1 - y0, x1 - x0)
            at += 2 * n
            continue
        q[y0:y1, x0:x1] = colours[i]
        if overlay:
            for k in range(min(x1 - x0, y1 - y0)):
                q[y0 + k, x0 + k] = 0x7FFF
                q[y0 + k, x1 - 1 - k] = 0
    five = np.stack([q >> 10 & 31, q >> 5 & 31, q & 31], axis=2)
    return (five << 3 | five >> 2).astype(np.uint8)


DECODERS = {"png": decode_png, "bmp": decode_bmp, "qimg": decode_tree}


def decode(name: str, data: bytes, strict: bool = False) -> np.ndarray:
    """The picture of a file, by its name's ending; whatever is wrong with it is a BadImage. strict: see decode_png."""
    kind = name.rsplit(".", 1)[-1].lower()
    if kind not in DECODERS:
        raise BadImage("an unknown kind of file")
    try:
        return decode_png(data, strict) if kind == "png" else DECODERS[kind](data)
    except (ValueError, TypeError, LookupError, ArithmeticError, MemoryError, struct.error, zlib.error) as e:
        raise e if isinstance(e, BadImage) else BadImage(f"a damaged {kind}: {e}") from e


def read_images(spark: SparkSession, path: str, strict: bool = False) -> DataFrame:
    """(path, w, h, raw RGB bytes, error) of the image files under a path; files that can't be read keep their row with an error.

    Files without a byte have no row, as Spark's reader leaves them out.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out = []
            for name, data in zip(f["path"], f["content"], strict=True):
                try:
                    px = decode(name, data, strict)
                    out.append((name, px.shape[1], px.shape[0], np.ascontiguousarray(px[:, :, :3]).tobytes(), None))
                except BadImage as e:
                    out.append((name, None, None, None, str(e)))
            yield pd.DataFrame(out, columns=["path", "w", "h", "raw", "error"]).astype({"w": "Int32", "h": "Int32"})

    return ship(spark).read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "path string, w int, h int, raw binary, error string")


def image_pixels(images: DataFrame, rows: int = 1 << 16) -> DataFrame:
    """(path, y, x, r, g, b): a picture's bytes become Arrow columns, about `rows` pixels at a time, so no pixel carries the picture."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, w, h, raw in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                px = np.frombuffer(raw, np.uint8).reshape(h, w, 3)
                step = max(1, rows // max(1, w))
                for y in range(0, h, step):
                    part = px[y : y + step].reshape(-1, 3).astype(np.int32)
                    at = np.arange(len(part), dtype=np.int32)
                    name = pa.array([path], pa.string()).take(pa.array(np.zeros(len(part), np.int64)))
                    yield pa.RecordBatch.from_arrays([name, pa.array(y + at // w), pa.array(at % w), *(pa.array(part[:, k].copy()) for k in range(3))], names=["path", "y", "x", "r", "g", "b"])

    found = images.where("raw is not null and w > 0 and h > 0").select("path", "w", "h", "raw")
    ship(images.sparkSession)
    return found.mapInArrow(run, "path string, y int, x int, r int, g int, b int")


def invert_png(data: bytes) -> bytes:
    """The PNG with inverted colours in the form it came in: 8-bit RGB stays RGB, RGBA stays RGBA with its alpha as it was.

    Other forms are an error.
    """
    px = decode_png(data, strict=True).copy()
    px[:, :, :3] = 255 - px[:, :, :3]
    return encode_png(px if data[25] == 6 else px[:, :, :3])


def class_files(spark: SparkSession, root: str, suffix: str = ".bmp") -> DataFrame:
    """(split, class, file) of files under root/split/class; a missing split has no rows."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root).select("path")
    parts = F.split("path", "/")
    return files.where(F.lower("path").endswith(suffix)).select(F.element_at(parts, -3).alias("split"), F.element_at(parts, -2).alias("class"), F.element_at(parts, -1).alias("file"))


def write_samples(samples: DataFrame, path: str) -> None:
    """Samples in folders by split and class."""
    samples.write.partitionBy("split", "class").mode("append").parquet(path)

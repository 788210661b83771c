"""Damaged and interlaced images; frames as a stream, with a sink that commits batches."""

import os
import struct
import time
import zlib

import numpy as np
import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tessera.operators.topology import nodes
from tessera.sources import datasource, images

RNG = np.random.default_rng(8)


def png(px, kind, depth=8, lace=0, filters=None, palette=None):
    """A PNG of (h, w, channels) samples, each line filtered by the given kinds in turn, byte by byte."""
    h, w, c = px.shape
    step = max(1, c * depth // 8)
    filters = filters or [0]

    def lines(part):
        out, above = b"", None
        for y, row in enumerate(part):
            if depth == 16:
                own = b"".join(bytes([int(v), 7]) for v in row.reshape(-1))
            elif depth == 8:
                own = bytes(row.reshape(-1).tolist())
            else:
                bits = "".join(f"{int(v):0{depth}b}" for v in row.reshape(-1))
                own = bytes(int(bits[k : k + 8].ljust(8, "0"), 2) for k in range(0, len(bits), 8))
            above = above or bytes(len(own))
            f, made = filters[y % len(filters)], []
            for k, v in enumerate(own):
                a, b, d = own[k - step] if k >= step else 0, above[k], above[k - step] if k >= step else 0
                p = a + b - d
                nearest = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
                made.append((v - (0, a, b, (a + b) // 2, nearest)[f]) & 255)
            out += bytes([f, *made])
            above = own
        return out

    passes = images.PASSES if lace else ((0, 0, 1, 1),)
    body = b"".join(lines(px[y::dy, x::dx]) for x, y, dx, dy in passes if x < w and y < h)
    chunk = lambda n, d: struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d))
    head = chunk(b"IHDR", struct.pack(">IIBBBBB", w, h, depth, kind, 0, 0, lace)) + (chunk(b"PLTE", palette.tobytes()) if palette is not None else b"")
    packed = zlib.compress(body)
    return images.PNG_MAGIC + head + chunk(b"IDAT", packed[:5]) + chunk(b"tEXt", b"a\x00b") + chunk(b"IDAT", packed[5:]) + chunk(b"IEND", b"")


@pytest.mark.parametrize("lace", [0, 1])
@pytest.mark.parametrize("filters", [[0], [1, 2], [3], [4], [4, 0, 3, 1, 2]])
def test_png_forms(lace, filters):
    for w, h in ((1, 1), (3, 2), (9, 17), (33, 8)):
        for kind, depth in ((2, 8), (6, 8), (0, 8), (4, 8), (2, 16), (6, 16), (0, 1), (0, 2), (0, 4)):
            px = RNG.integers(0, min(256, 1 << depth), (h, w, images.CHANNELS[kind]), dtype=np.uint8)
            got = images.decode_png(png(px, kind, depth, lace, filters))
            scaled = px * (255 // ((1 << depth) - 1)) if depth < 8 else px
            rgb = scaled[:, :, :1].repeat(3, 2) if kind in (0, 4) else scaled[:, :, :3]
            assert (got[:, :, :3] == rgb).all()
            assert (got[:, :, 3] == (scaled[:, :, -1] if kind in (4, 6) else 255)).all()
        palette = RNG.integers(0, 256, (11, 3), dtype=np.uint8)
        px = RNG.integers(0, 11, (h, w, 1), dtype=np.uint8)
        assert (images.decode_png(png(px, 3, 4, lace, filters, palette))[:, :, :3] == palette[px[:, :, 0]]).all()
    with pytest.raises(images.BadImage, match="palette"):
        images.decode_png(png(px, 3, 8, lace, filters))
    with pytest.raises(images.BadImage, match="beyond"):
        images.decode_png(png(px + 3, 3, 8, lace, filters, palette[:4]))


def test_a_large_frame_is_quick():
    lines = RNG.integers(0, 256, (1080, 1920 * 3), dtype=np.uint8)
    began = time.process_time()
    images.unfilter(np.full(1080, 4, np.uint8), lines, 3)
    assert time.process_time() - began < 3  # some 0.3 s; a loop over bytes takes 19


def files():
    px = RNG.integers(0, 256, (5, 6, 3), dtype=np.uint8)
    tree = nodes(20, 18)
    colours = [images.MIXED if k == len(tree) - 1 else k for k in range(len(tree))]
    _, x0, y0, x1, y1, *_ = tree[-1]
    packed = images.encode_tree(20, 18, colours, [np.arange((x1 - x0) * (y1 - y0))])
    top = bytearray(images.encode_bmp(px[::-1]))
    top[22:26] = struct.pack("<i", -5)
    return {"a.png": png(px, 2, filters=[4, 1]), "laced.png": png(px, 2, lace=1), "b.bmp": images.encode_bmp(px), "top.bmp": bytes(top), "c.qimg": packed}, px


def test_damaged_files_are_bad_images():
    whole, px = files()
    assert (images.decode("b.bmp", whole["b.bmp"]) == px).all() and (images.decode("top.bmp", whole["top.bmp"]) == px).all()
    for name, data in whole.items():
        images.decode(name, data)
        for cut in range(len(data)):
            with pytest.raises(images.BadImage):
                images.decode(name, data[:cut])
        for _ in range(300):
            broken = bytearray(data)
            for at in RNG.integers(0, len(data), 3):
                broken[at] = RNG.integers(0, 256)
            try:
                images.decode(name, bytes(broken))
            except images.BadImage:
                pass
    wrong = bytearray(whole["a.png"])
    wrong[20] ^= 1
    with pytest.raises(images.BadImage, match="sum"):
        images.decode("a.png", bytes(wrong))


def test_no_damaged_file_ends_a_job(spark, tmp_path):
    whole, _ = files()
    for name, data in whole.items():
        (tmp_path / name).write_bytes(data)
        (tmp_path / f"cut-{name}").write_bytes(data[: len(data) // 2])
    (tmp_path / "empty.png").write_bytes(b"")
    (tmp_path / "note.txt").write_text("no image")
    rows = images.read_images(spark, str(tmp_path)).collect()
    # Spark's reader leaves out files without a byte
    assert len(rows) == 11 and sum(r.error is None for r in rows) == 5
    datasource.register(spark)
    assert spark.read.format("raster").load(str(tmp_path)).count() == 5
    kept = spark.read.format("raster").option("errors", "keep").load(str(tmp_path))
    assert kept.count() == 11 and kept.where("error IS NOT NULL").count() == 6


def put(folder, k):
    px = np.full((2, 3, 3), k, np.uint8)
    os.makedirs(folder, exist_ok=True)
    with open(folder / f"frame_{k:04d}.png", "wb") as f:
        f.write(images.encode_png(px))


def run(frames, path, checkpoint):
    query = frames.writeStream.format("parquet").option("path", str(path)).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
    query.awaitTermination()


def test_frames_are_read_once_and_resumed(spark, tmp_path):
    datasource.register(spark)
    root = tmp_path / "frames"

    def frames(**options):
        return spark.readStream.format("raster").options(frames="true", **options).load(str(root)).select("frame", F.element_at(F.split("path", "/"), -1).alias("name"), F.length("raw").alias("n"))

    for k in (5, 6):
        put(root, k)
    run(frames(), tmp_path / "out", tmp_path / "c1")
    for k in (1, 7):  # a name before the others, with an older time, is still a later frame
        put(root, k)
        os.utime(root / f"frame_{k:04d}.png", (1, 1))
    (root / "frame_0009.png").write_bytes(b"no image")
    run(frames(filesPerPartition="1"), tmp_path / "out", tmp_path / "c1")
    run(frames(), tmp_path / "out", tmp_path / "c1")
    got = [tuple(r) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("frame").collect()]
    assert got == [(0, "frame_0005.png", 18), (1, "frame_0006.png", 18), (2, "frame_0001.png", 18), (3, "frame_0007.png", 18)]
    # subscribers of their own: one from a frame on, one that comes late
    run(frames(startingFrame="2"), tmp_path / "late", tmp_path / "c2")
    assert [r.frame for r in spark.read.parquet(str(tmp_path / "late")).orderBy("frame").collect()] == [2, 3]
    run(frames(startingFrame="latest"), tmp_path / "last", tmp_path / "c3")
    put(root, 11)
    run(frames(startingFrame="latest"), tmp_path / "last", tmp_path / "c3")
    assert [r.name for r in spark.read.parquet(str(tmp_path / "last")).collect()] == ["frame_0011.png"]


def test_batches_are_bounded(tmp_path):
    for k in range(7):
        put(tmp_path / "f", k)
    reader = datasource.StreamReader(str(tmp_path / "f"), str(tmp_path / "l"), "0", 2, 3, False, True)
    assert reader.initialOffset() == {"frame": 0} and reader.latestOffset() == {"frame": 7}
    put(tmp_path / "f", 20), put(tmp_path / "f", 21), put(tmp_path / "f", 22)
    assert [reader.latestOffset()["frame"] for _ in range(3)] == [9, 10, 10]
    assert [(p.first, len(p.paths)) for p in reader.partitions({"frame": 2}, {"frame": 9})] == [(2, 3), (5, 3), (8, 1)]
    # two ledgers of one folder agree, whoever writes
    a, b = datasource.Ledger(str(tmp_path / "m")), datasource.Ledger(str(tmp_path / "m"))
    a.enter(iter(["x", "y"])), b.enter(iter(["y", "z"])), a.enter(iter(["w", "z"]))
    b.refresh()
    assert a.paths == b.paths == ["x", "y", "z", "w"]


def test_a_failed_batch_leaves_no_picture(spark, tmp_path):
    datasource.register(spark)
    source, out, flag = tmp_path / "in", tmp_path / "out", str(tmp_path / "flag")
    for k in range(6):
        put(source, k)

    def start():
        frames = spark.readStream.format("raster").option("filesPerPartition", "1").load(str(source))
        broken = F.when(F.col("path").endswith("3.png") & F.lit(not os.path.exists(flag)), F.raise_error(F.lit("lost"))).otherwise(F.col("raw"))
        frames = frames.withColumn("raw", broken.cast("binary"))
        return frames.writeStream.format("raster").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(out))

    with pytest.raises(Exception, match="lost"):
        start().awaitTermination()
    seen = lambda: sorted(f for f in os.listdir(out) if not f.startswith("_")) if out.exists() else []
    staged = lambda: [f for _, _, names in os.walk(out / "_staging") for f in names]
    assert seen() == [] and staged() == []
    open(flag, "w").close()
    start().awaitTermination()
    assert seen() == [f"frame_{k:04d}.png" for k in range(6)] and staged() == [] and len(os.listdir(out / "_log")) == 1
    # a batch that is in the log is not done again
    writer = datasource.StreamWriter(str(out))
    message = datasource.Staging(str(out)).write(iter([spark.createDataFrame([("new.png", 1, 1, bytearray(3))], "path string, w int, h int, raw binary").first()]))
    writer.commit([message], 0)
    assert "new.png" not in seen() and staged() == []
    assert spark.read.format("raster").load(str(out)).count() == 6


def test_a_task_later_than_its_job_leaves_no_picture(tmp_path):
    row = Row(path="late.png", w=1, h=1, raw=bytearray(3))
    staging = datasource.Staging(str(tmp_path))
    staging.end()
    with pytest.raises(FileNotFoundError):
        staging.write(iter([row]))
    staging = datasource.Staging(str(tmp_path))

    def ends_meanwhile():
        yield row
        staging.end()
        yield row

    with pytest.raises(FileNotFoundError):
        staging.write(ends_meanwhile())
    assert not [f for _, _, names in os.walk(tmp_path) for f in names]

"""Packed trees by joins against the decoder of single files."""

import struct

import numpy as np

from tessera.operators import topology, trees
from tessera.sources import images


def a_tree(rng, w, h, share):
    colours, payload = [], []
    for _, x0, y0, x1, y1, left, _ in topology.nodes(w, h):
        mixed = left is None and rng.random() < share
        colours.append(images.MIXED if mixed else int(rng.integers(0, 1 << 15)))
        if mixed:
            payload.append(rng.integers(0, 1 << 15, (x1 - x0) * (y1 - y0)))
    return images.encode_tree(w, h, colours, payload)


def rgb(rows, w, h):
    q = np.full((h, w), -1)
    for r in rows:
        assert q[r.y, r.x] == -1
        q[r.y, r.x] = r.q
    five = np.stack([q >> 10 & 31, q >> 5 & 31, q & 31], axis=2)
    return (five << 3 | five >> 2).astype(np.uint8)


def test_tree_pixels(spark):
    """Trees of many sizes, with and without mixed leaves, payloads over block borders, and damaged files, which have no rows."""
    rng = np.random.default_rng(8)
    sizes = [(1, 1), (16, 16), (17, 3), (64, 100), (130, 70), (64, 100)]
    files = {f"i{k}": a_tree(rng, w, h, (0, 1, 0.5, 0.9, 0.4, 0)[k]) for k, (w, h) in enumerate(sizes)}
    good = files["i3"]
    bad = {"cut": good[:-1], "long": good + b"x", "short": good[:9], "head": good[:12], "magic": b"x" + good[1:], "count": good[:8] + struct.pack("<I", 7) + good[12:], "huge": good[:4] + b"\xff" * 8 + good[12:], "none": None, "empty": b""}
    table = spark.createDataFrame([(k, v) for k, v in (files | bad).items()], "image string, data binary").repartition(3)
    for overlay in (True, False):
        got = {}
        for r in trees.tree_pixels(table, overlay).collect():
            got.setdefault(r.image, []).append(r)
        assert set(got) == set(files)
        for k, (w, h) in enumerate(sizes):
            assert (rgb(got[f"i{k}"], w, h) == images.decode_tree(files[f"i{k}"], overlay)).all()
    assert trees.tree_pixels(table.limit(0)).count() == 0


def test_packed_trees_come_back(spark):
    """Packed and decoded without the overlay, every pixel is what it was; the decoder of single files agrees."""
    rng = np.random.default_rng(9)
    rows = [(k, w, h, x, y, int(7 if x < 20 else rng.integers(0, 1 << 15))) for k, (w, h) in enumerate([(40, 33), (5, 2)]) for y in range(h) for x in range(w)]
    pixels = spark.createDataFrame(rows, "image int, w int, h int, x int, y int, q int")
    files = trees.pack_trees(pixels)
    back = sorted((r.image, r.y, r.x, r.q) for r in trees.tree_pixels(files, overlay=False).collect())
    assert back == sorted((k, y, x, q) for k, _, _, x, y, q in rows)
    for r in files.collect():
        w, h = next((w, h) for k, w, h, *_ in rows if k == r.image)
        assert images.decode_tree(bytes(r["data"])).shape == (h, w, 3)


def test_long_glyphs(spark):
    """A region of many pixels: its bitmap costs what its pixels cost, not their square."""
    from tessera.operators import glyphs

    ink = spark.range(60_000).selectExpr("0 as frame_id", "0 as region_id", "cast(id * 2 % 400 as int) + 3 as x", "cast(id * 2 div 400 as int) + 5 as y", "3 as minx", "5 as miny", "402 as maxx", "304 as maxy")
    assert glyphs.glyph_bits(ink).first()["bits"] == "10" * 60_000

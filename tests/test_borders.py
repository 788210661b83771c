"""Borders of boxes in tiles against single pixels."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import render


def ring(x0, y0, x1, y1, w, h):
    edge = {(x, y) for x in range(x0, x1 + 1) for y in (y0, y1)} | {(x, y) for y in range(y0, y1 + 1) for x in (x0, x1)}
    return {(x, y) for x, y in edge if 0 <= x < w and 0 <= y < h}


@pytest.mark.parametrize("w,h", [(40, 30), (16, 8), (1, 1)])
def test_borders_in_tiles(spark, w, h):
    rng, rows = random.Random(w), [(3, 5, 5, 5, 5), (3, 4, 9, 2, 9), (4, -9, -9, 60, 60), (4, -3, 2, 7, 9)]
    for k in range(30):
        x, y = rng.randrange(-12, w + 4), rng.randrange(-12, h + 4)
        rows.append((k % 3, x, y, x + rng.randrange(30), y + rng.randrange(30)))
    boxes = spark.createDataFrame(rows, "frame_id long, minx int, miny int, maxx int, maxy int")

    def pixels(grow):
        return {(f, *p) for f, a, b, c, d in rows if a - grow <= c + grow and b - grow <= d + grow for p in ring(a - grow, b - grow, c + grow, d + grow, w, h)}

    one = render.border(boxes, F.lit(w), F.lit(h))
    assert sorted(map(tuple, one.collect())) == sorted(pixels(0))
    two = render.double_border(boxes, F.lit(w), F.lit(h))
    # (4, 9, 2, 9) is no box until it is grown
    assert sorted((r.frame_id, r.x, r.y, r.g) for r in two.collect()) == sorted((*p, 0 if p in pixels(0) else 255) for p in pixels(0) | pixels(1))
    chains = boxes.where("frame_id = 1")
    drawn = {(r.frame_id, r.x, r.y): r.r for r in render.chain_picture(boxes, chains, F.lit(w), F.lit(h)).collect()}
    small = {(f, *p) for f, a, b, c, d in rows if c - a < 31 and d - b < 31 and a <= c and b <= d for p in ring(a, b, c, d, w, h)}
    red = {p for p in pixels(0) if p[0] == 1}
    assert drawn == {p: 255 if p in red else 0 for p in small | red}
    # no hash table has a row for each pixel
    assert all("bit_or" in str(d._jdf.queryExecution().optimizedPlan().toString()) for d in (one, two))


def test_chain_borders_shuffle_tiles(spark):
    boxes = spark.createDataFrame([(1, 0, 0, 9, 9)], "frame_id long, minx int, miny int, maxx int, maxy int")
    drawn = render.chain_picture(boxes, boxes, F.lit(400), F.lit(300))
    assert drawn._jdf.queryExecution().optimizedPlan().toString().count("Aggregate [frame_id") == 1
    assert "bit_or" in drawn._jdf.queryExecution().optimizedPlan().toString()

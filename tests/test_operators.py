"""Hand-worked cases and models in plain Python."""

import random

import pytest
from pyspark.sql import functions as F

from tessera.functions import colour, naming
from tessera.operators import blocks, components, evaluate, generate, glyphs, regions, render, runs, shapes, topology


def one(spark, **columns):
    return spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()


def test_colours(spark):
    r, g, b = F.lit(255), F.lit(128), F.lit(64)
    got = one(spark, q=colour.rgb332(r, g, b), q6=colour.quant6(r, g, b), g4=colour.gray4(r, g, b), i=colour.invert(g), p=colour.pack(r, g, b))
    assert tuple(got) == (241, 57, 9, 127, 0xFF8040)
    assert tuple(one(spark, **dict(zip("rgb", colour.expand_rgb332(F.lit(241)), strict=True)))) == (255, 146, 85)
    assert tuple(one(spark, **dict(zip("rgb", colour.unpack(F.lit(0xFF8040)), strict=True)))) == (255, 128, 64)
    assert tuple(one(spark, **dict(zip("rgb", colour.expand_rgb555(F.lit(0x7FFF)), strict=True)))) == (255, 255, 255)


def test_names(spark):
    got = one(spark, a=naming.marked_name(F.lit("frame_0001.png")), b=naming.marked_name(F.lit("noext")), c=naming.glyph_name(F.lit("101010")), d=naming.dump_name(F.lit("a.png.b")), e=naming.base_name(F.lit("/x/y.z.ttf")), f=naming.look_alike(F.lit("АВС")), g=naming.glyph_name(F.lit("")))
    assert tuple(got) == ("frame_0001_.png", "noext_", "g", "a.bmp", "y.z", "ABC", "")


def frame(spark, text, name="q"):
    rows = [(0, y, x, int(c)) for y, line in enumerate(text.split()) for x, c in enumerate(line)]
    return spark.createDataFrame(rows, f"frame_id long, y int, x int, {name} int")


def test_block_ties(spark):
    px = spark.createDataFrame([(0, i // 32, i % 32, 9 if i < 512 else 5) for i in range(1024)] + [(0, y, 32 + x, 7) for y in range(32) for x in range(32)], "frame_id long, y int, x int, q int")
    got = {r.bcol: (r.bg, r.fg, r.uniform) for r in blocks.block_colours(blocks.histogram(px, "q")).collect()}
    assert got == {0: (5, 9, False), 1: (7, 7, True)}
    assert {r.bcol for r in blocks.mask_rows(px, "q").collect()} == {0}
    assert blocks.wildcard_uniform(px, "q").where("uniform").count() == 1


def flood(grid, eight):
    h, w = len(grid), len(grid[0])
    seen, out = {}, []
    near = [(0, 1), (1, 0), (0, -1), (-1, 0)] + ([(1, 1), (1, -1), (-1, 1), (-1, -1)] if eight else [])
    for y in range(h):
        for x in range(w):
            if (y, x) in seen:
                continue
            todo, cells = [(y, x)], []
            seen[y, x] = 1
            while todo:
                a, b = todo.pop()
                cells.append((a, b))
                for dy, dx in near:
                    c = (a + dy, b + dx)
                    if 0 <= c[0] < h and 0 <= c[1] < w and c not in seen and grid[c[0]][c[1]] == grid[a][b]:
                        seen[c] = 1
                        todo.append(c)
            ys, xs = [c[0] for c in cells], [c[1] for c in cells]
            out.append((min(xs), min(ys), max(xs), max(ys), len(cells), int(grid[y][x])))
    return sorted(out)


@pytest.mark.parametrize("eight", [False, True])
def test_components(spark, eight):
    rng = random.Random(1)
    grid = ["".join(rng.choice("0012") for _ in range(90)) for _ in range(12)]
    numbered = components.numbered(runs.row_runs(frame(spark, "\n".join(grid)), "q"))
    for find in (components.components, components.relational_components):
        got = sorted((r.minx, r.miny, r.maxx, r.maxy, r.cnt, r.value) for r in components.boxes(find(numbered, eight)).collect())
        assert got == flood(grid, eight)


def test_regions_are_numbered_by_block(spark):
    """Blocks of 2: raster order meets the right block's first row before the left block's second; block order doesn't."""
    r = components.numbered(runs.row_runs(frame(spark, "0010\n1000\n0000\n0101").where("q = 1"), "q"))
    got = {(i.minx, i.miny): i.region_id for i in regions.number_regions(components.components(r), 2).collect()}
    assert got == {(0, 1): 1, (2, 0): 2, (1, 3): 3, (3, 3): 4}
    whole = components.numbered(runs.row_runs(frame(spark, "0011\n1110\n0000\n0100").where("q = 1"), "q"))
    got = {i.cnt: i.region_id for i in regions.number_regions(components.components(whole), 2).collect()}
    assert got == {5: 1, 1: 2}


@pytest.mark.parametrize("eight", [False, True])
def test_components_of_strips(spark, eight):
    rng = random.Random(8)
    grid = ["".join(rng.choice("001") for _ in range(40)) for _ in range(23)]
    numbered = components.numbered(runs.row_runs(frame(spark, "\n".join(grid)), "q"))
    whole = sorted(map(tuple, components.components(numbered, eight).select("run_id", "component").collect()))
    for strip in (1, 4, 23):
        assert sorted(map(tuple, components.components(numbered, eight, strip).select("run_id", "component").collect())) == whole


def test_diagonal(spark):
    r = components.numbered(runs.row_runs(frame(spark, "10\n01").where("q = 1"), "q"))
    assert components.components(r).select("component").distinct().count() == 2
    assert components.components(r, eight=True).select("component").distinct().count() == 1


def test_rectangles(spark):
    solid = shapes.solid_rectangles(runs.row_runs(frame(spark, "110\n100\n222"), "q"), 1, 1)
    assert [(r.x, r.y, r.w, r.h) for r in solid.collect()] == [(0, 2, 3, 1)]
    rects = spark.createDataFrame([(0, 0, 0, 1000, 40, 1), (0, 0, 50, 60, 60, 1)], "frame_id long, x int, y int, w int, h int, value int")
    assert shapes.take_while(rects).count() == 0
    assert rects.where("w >= 50 and h >= 50").count() == 1
    greedy = shapes.greedy_rectangles(runs.row_runs(frame(spark, "11211\n11111"), "q"), 2, 2)
    assert [(r.x, r.y, r.w, r.h) for r in greedy.collect()] == [(0, 0, 2, 2)]


def greedy_model(grid, least_run, least_h):
    """Each run in raster order, unless taken, grows downwards while a run of its colour covers it; those runs are taken."""
    lines = []
    for y, line in enumerate(grid):
        x = 0
        while x < len(line):
            e = x
            while e + 1 < len(line) and line[e + 1] == line[x]:
                e += 1
            if e - x + 1 >= least_run:
                lines.append((y, x, e, line[x]))
            x = e + 1
    taken, out = set(), []
    for y, x1, x2, c in lines:
        if (y, x1) in taken:
            continue
        h = 1
        while True:
            nxt = next((r for r in lines if r[0] == y + h and r[3] == c and r[1] <= x1 and r[2] >= x2 and (r[0], r[1]) not in taken), None)
            if nxt is None:
                break
            taken.add((nxt[0], nxt[1]))
            h += 1
        if h >= least_h:
            out.append((x1, y, x2 - x1 + 1, h, int(c)))
    return sorted(out)


def test_greedy_model(spark):
    rng = random.Random(9)
    for k in range(6):
        grid = ["".join(rng.choice("0001") for _ in range(40)) for _ in range(14)]
        got = shapes.greedy_rectangles(runs.row_runs(frame(spark, "\n".join(grid)), "q"), 2, 1 + k % 3)
        assert sorted((r.x, r.y, r.w, r.h, r.value) for r in got.collect()) == greedy_model(grid, 2, 1 + k % 3)


def boxes(spark, rows):
    return spark.createDataFrame([(0, i, *b, 1) for i, b in enumerate(rows)], "frame_id long, region_id long, minx int, miny int, maxx int, maxy int, cnt long")


def test_neighbours_and_chains(spark):
    b = boxes(spark, [(0, 0, 9, 9), (15, 0, 24, 9), (60, 0, 69, 9)])
    links = regions.right_neighbours(b)
    assert sorted((r.region_id, r.neighbor_id, r.dx) for r in links.collect()) == [(0, 1, 6), (1, None, None), (2, None, None)]
    got = regions.chains(b, links).collect()
    assert [(r.region_id, r.minx, r.miny, r.maxx, r.maxy, r.n) for r in got] == [(0, 0, 0, 24, 9, 2)]


def test_neighbours_model(spark):
    rng = random.Random(4)
    rows = [(x, y, x + rng.randint(1, 40), y + rng.randint(1, 40)) for x, y in ((rng.randint(0, 300), rng.randint(0, 60)) for _ in range(120))]

    def near(i):
        a = rows[i]
        best = None
        for j, b in enumerate(rows):
            small = all(r[2] - r[0] + 1 < 32 and r[3] - r[1] + 1 < 32 for r in (a, b))
            if i != j and small and 0 < b[0] - a[2] <= 32 and abs((b[3] - b[1]) - (a[3] - a[1])) <= 6 and abs((b[1] + b[3]) // 2 - (a[1] + a[3]) // 2) <= 16 and (best is None or b[0] - a[2] < best[0]):
                best = (b[0] - a[2], j)
        return best[1] if best else None

    got = {r.region_id: r.neighbor_id for r in regions.right_neighbours(boxes(spark, rows)).collect()}
    assert got == {i: near(i) for i in range(len(rows))}


def test_lines(spark):
    got = {r.region_id: r.line_no for r in regions.text_lines(boxes(spark, [(0, 0, 9, 9), (15, 12, 24, 21), (0, 40, 9, 49)])).collect()}
    assert got == {0: 1, 1: 1, 2: 2}


def test_recognition(spark):
    px = spark.createDataFrame([(0, r, i % 16, i // 16, 0, 0) for r, n in ((1, 64), (2, 65)) for i in range(n)], "frame_id long, region_id long, x int, y int, minx int, miny int")
    got = {r.region_id: r.ch for r in glyphs.recognise(glyphs.samples(px), glyphs.zero_templates(spark)).collect()}
    assert got == {1: "A", 2: "?"}


def test_glyph_names(spark):
    px = spark.createDataFrame([(0, 0, x, y, 0, 0, 2, 1) for y, row in enumerate(("101", "010")) for x, c in enumerate(row) if c == "1"], "frame_id long, region_id long, x int, y int, minx int, miny int, maxx int, maxy int")
    store = glyphs.glyph_store(glyphs.glyph_bits(px))
    assert [tuple(r) for r in store.collect()] == [(3, 2, "g", 1)]
    assert glyphs.glyph_store(glyphs.glyph_bits(px), store).count() == 0


def test_balance(spark):
    counts = spark.createDataFrame([("a", 3), ("b", 1), ("c", 0)], "class string, n long")
    assert {r["class"]: r.deviation for r in evaluate.class_balance(counts).collect()} == {"a": 125.0, "b": -25.0, "c": -100.0}
    assert evaluate.class_balance(counts.where("n > 9")).count() == 0


def test_confusion(spark):
    pairs = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (1, 1)], "true_label int, pred_label int")
    m = evaluate.confusion(pairs, spark.range(3).select(F.col("id").cast("int").alias("label")))
    assert sorted((r.true_label, r.pred_label, r.share) for r in evaluate.normalised(m).collect() if r.share) == [(0, 0, 0.5), (0, 1, 0.5), (1, 1, 1.0)]
    assert {r.true_label: r.error for r in evaluate.class_errors(m).collect()} == {0: 0.5, 1: 0.0, 2: 1.0}
    e = spark.createDataFrame([(1, 1.0, 1.0), (2, 0.8, 1.2), (3, 0.7, 1.1)], "epoch int, train double, val double")
    assert [r.overfit for r in evaluate.overfit(e).orderBy("epoch").collect()] == [False, True, False]


def test_topology(spark):
    t = topology.nodes(40, 20)
    assert len(t) == 15 and sum(n[5] is None for n in t) == 8
    by = {n[0]: n[1:5] for n in t}
    assert (by[1], by[2], by[3], by[4], by[9]) == ((0, 0, 20, 20), (20, 0, 40, 20), (0, 0, 10, 20), (10, 0, 20, 20), (20, 0, 30, 20))


def test_chain_picture(spark):
    small = boxes(spark, [(0, 0, 2, 2), (0, 0, 40, 2)])
    chain = small.where("region_id = 0").select("frame_id", F.lit(1).alias("minx"), F.lit(0).alias("miny"), F.lit(9).alias("maxx"), F.lit(1).alias("maxy"))
    got = {(r.x, r.y): r.r for r in render.chain_picture(small, chain, F.lit(9), F.lit(9)).collect()}
    assert got[0, 0] == 0 and got[1, 0] == 255 and (9, 0) not in got and got[0, 2] == 0 and (1, 1) in got and len(got) == 18 + 3


def test_region_picture(spark):
    b = boxes(spark, [(0, 0, 2, 2), (2, 2, 3, 3)])
    ink = spark.createDataFrame([(0, 1, 1), (0, 2, 2), (0, 9, 9)], "frame_id long, x int, y int")
    got = {(r.x, r.y): r.region_id for r in render.region_picture(ink, b, F.lit(4), F.lit(4)).collect()}
    assert got[1, 1] is None and got[2, 2] == 1 and got[0, 0] == 0 and (9, 9) not in got


def test_grey_slots_and_names(spark):
    from tessera.functions import bits

    got = one(spark, a=colour.luma(F.lit(255), F.lit(128), F.lit(0)), b=bits.slot_count(F.lit(50), F.lit(10)), c=bits.slot_count(F.lit(400), F.lit(20)), d=bits.slot_count(F.lit(99_999), F.lit(1)), e=naming.stamped_name("regions", F.lit(3), F.lit(17)), f=naming.stamped_name("dbg_quant", F.lit(3), F.lit(17), F.lit(5)))
    assert tuple(got) == (151, 1, 5, 8, "regions_3_17.png", "dbg_quant_3_17_000000005.png")


def test_arguments():
    from tessera.params import Params, arguments

    assert arguments(["--slots=3"]) == (3, None) and arguments(["--workers=32", "--slots=8"]) == (8, 32) and arguments([]) == (None, None)
    for bad in (["--slots=9"], ["--workers=0"], ["--workers=x"], ["--other"], ["stray"]):
        with pytest.raises(SystemExit):
            arguments(bad)
    with pytest.raises(ValueError):
        Params(slots=0)


def test_fonts(spark):
    fonts = spark.createDataFrame([("a", True), ("a", True), ("b", False), ("c", True)], "font string, loads boolean")
    assert sorted(r.font for r in generate.usable_fonts(fonts).collect()) == ["a", "c"]
    with pytest.raises(ValueError):
        generate.usable_fonts(fonts.where("not loads"))


def test_balance_of_splits(spark):
    one_, two = (spark.createDataFrame([(c,) for c in s], "class string") for s in ("aab", "cab"))
    assert [(r["class"], r.n, r.deviation) for r in evaluate.balance_report(one_, two).collect()] == [("a", 3, 50.0), ("b", 2, 0.0), ("c", 1, -50.0)]
    assert evaluate.balance_report(one_.limit(0), two.limit(0)).count() == 0


def test_characters(spark):
    c = generate.characters(spark)
    assert c.select("class").distinct().count() == 127
    assert {r["class"] for r in c.where("ch = '3'").collect()} == {"3", "З"}


def test_invert_twice(spark):
    px = spark.createDataFrame([(0, 0, 0, 1, 2, 3), (0, 1, 0, 250, 251, 252)], "frame_id long, x int, y int, r int, g int, b int")
    assert sorted(map(tuple, render.inverted(render.inverted(px)).collect())) == sorted(map(tuple, px.collect()))
    rects = spark.createDataFrame([(0, 0, 0, 1, 1), (0, 0, 0, 1, 1)], "frame_id long, x int, y int, w int, h int")
    assert {r.x: r.r for r in render.inverted_under(px, rects).collect()} == {0: 254, 1: 250}


def test_many_frames_are_labelled_at_once():
    """Runs of several frames and strips in batches of any size give whole parts, each in one table."""
    import pyarrow as pa

    rows = sorted((f, y) for f in range(40) for y in range(0, 9, 1 + f % 3))
    whole = pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows]) for k in (0, 1)], names=["frame_id", "y"])
    for strip in (None, 4):
        key = [(f, y // strip if strip else 0) for f, y in rows]
        for size in (1, 3, 50, 1000):
            got = list(components._whole_parts((whole.slice(k, size) for k in range(0, len(rows), size)), 0, 1, strip))
            assert [tuple(r.values()) for t in got for r in t.to_pylist()] == rows
            parts = [set((f, y // strip if strip else 0) for f, y in zip(t["frame_id"].to_pylist(), t["y"].to_pylist())) for t in got]  # noqa: B905
            assert sum(map(len, parts)) == len(set(key)) and (size < 1000 or len(got) <= 2)

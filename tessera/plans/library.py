"""The queries over the given tables, with their DuckDB forms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import bits, colour, naming
from tessera.operators import blocks, components, drawing, evaluate, generate, glyphs, regions, render, runs, shapes, topology, training, trees
from tessera.plans.catalog import query
from tessera.session import written
from tessera.sources.rasters import document_runs, embedding_pixels, event_boxes, read
from tessera.streaming import slots

# --- parts of the DuckDB forms -------------------------------------------------------------------------------------

PX = """px AS (SELECT frame_id, y, x, v, CASE WHEN v < -0.08 THEN 0 WHEN v < 0 THEN 1 WHEN v < 0.08 THEN 2 ELSE 3 END AS level,
  CAST(least(greatest(floor((v + 1.0) * 127.5), 0), 255) AS INT) AS r, x * 4 AS g, y * 5 % 256 AS b
  FROM (SELECT vec_id // 100 AS frame_id, CAST(vec_id % 100 AS INT) AS y, CAST(generate_subscripts(embedding, 1) - 1 AS INT) AS x, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings))"""
Q332 = "((r & 224) | ((g & 224) >> 3) | (b >> 6))"
Q6 = "(((r >> 6) << 4) | ((g >> 6) << 2) | (b >> 6))"
G4 = "((r * 77 + g * 150 + b * 29) >> 12)"
BL = f"bl AS (SELECT *, {Q332} AS q, y // 32 AS brow, x // 32 AS bcol, y % 32 AS dy, x % 32 AS dx FROM px)"
HI = "hi AS (SELECT frame_id, brow, bcol, q AS colour, count(*) AS n FROM bl GROUP BY ALL)"
BC = """rk AS (SELECT *, row_number() OVER (PARTITION BY frame_id, brow, bcol ORDER BY n DESC, colour) AS rn FROM hi),
bc AS (SELECT frame_id, brow, bcol, max(colour) FILTER (rn = 1) AS bg, coalesce(max(colour) FILTER (rn = 2), max(colour) FILTER (rn = 1)) AS fg, count(*) = 1 AS uniform, CAST(sum(n) AS BIGINT) AS pixels FROM rk GROUP BY ALL)"""


def run_sql(source: str, value: str, along: str, least: int = 1) -> str:
    across = "y" if along == "x" else "x"
    return f"""SELECT frame_id, {across} AS across, min({along}) AS first, max({along}) AS last, {value} AS value, max({along}) - min({along}) + 1 AS len
    FROM (SELECT *, {along} - row_number() OVER (PARTITION BY frame_id, {across}, {value} ORDER BY {along}) AS island FROM {source}) GROUP BY frame_id, {across}, {value}, island HAVING max({along}) - min({along}) + 1 >= {least}"""


def component_sql(source: str, eight: bool) -> str:
    """rn: numbered runs (frame_id, y, x1, x2, value) of `source`; cc: their components."""
    d = 1 if eight else 0
    return f"""rn AS MATERIALIZED (SELECT *, CAST(y AS BIGINT) * 1048576 + x1 AS run_id FROM {source}),
    ed AS MATERIALIZED (SELECT a.frame_id, a.run_id AS i, b.run_id AS j FROM rn a JOIN rn b ON a.frame_id = b.frame_id AND a.value = b.value AND b.y = a.y + 1 AND a.x1 <= b.x2 + {d} AND a.x2 + {d} >= b.x1),
    bo AS MATERIALIZED (SELECT * FROM ed UNION ALL SELECT frame_id, j, i FROM ed),
    rr(frame_id, id, root) AS (SELECT frame_id, run_id, run_id FROM rn UNION SELECT rr.frame_id, bo.j, rr.root FROM rr JOIN bo ON bo.frame_id = rr.frame_id AND bo.i = rr.id WHERE bo.j > rr.root),
    cc AS (SELECT frame_id, id AS run_id, min(root) AS component FROM rr GROUP BY ALL),
    bxs AS (SELECT frame_id, component, value, min(x1) AS minx, min(y) AS miny, max(x2) AS maxx, max(y) AS maxy, CAST(sum(x2 - x1 + 1) AS BIGINT) AS cnt, count(*) AS runs FROM rn JOIN cc USING (frame_id, run_id) GROUP BY ALL)"""


ROWS = "ro AS (SELECT frame_id, across AS y, first AS x1, last AS x2, value FROM ({}))"
DOC_RUNS = r"""dl AS (SELECT doc_id AS frame_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS y FROM documents),
dw AS (SELECT frame_id, y, unnest(string_split(line, ' ')) AS word, generate_subscripts(string_split(line, ' '), 1) AS k FROM dl),
dp AS (SELECT *, CAST(coalesce(sum(length(word) + 1) OVER (PARTITION BY frame_id, y ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS INT) AS x1, length(word) AS n FROM dw),
dr AS (SELECT frame_id, CAST(y AS INT) AS y, x1, x1 + n - 1 AS x2, 1 AS value FROM dp WHERE n > 0)"""
BOX = """eb AS (SELECT event_id // 50 AS frame_id, event_id AS region_id, CAST(event_id * 37 % 400 AS INT) AS minx, CAST(event_id * 91 % 300 AS INT) AS miny, CAST(event_id * 7 % 30 + 3 AS INT) AS w, CAST(event_id * 13 % 29 + 4 AS INT) AS h FROM events),
rg AS (SELECT frame_id, region_id, minx, miny, minx + w - 1 AS maxx, miny + h - 1 AS maxy, CAST(w * h AS BIGINT) AS cnt FROM eb)"""
NB = """sm AS (SELECT *, maxx - minx + 1 AS w, maxy - miny + 1 AS h, (miny + maxy) // 2 AS cy FROM rg WHERE maxx - minx + 1 < 32 AND maxy - miny + 1 < 32),
nr AS (SELECT a.frame_id, a.region_id, b.region_id AS j, b.minx - a.maxx AS dx, row_number() OVER (PARTITION BY a.frame_id, a.region_id ORDER BY b.minx - a.maxx, b.region_id) AS rn
  FROM sm a JOIN sm b ON a.frame_id = b.frame_id AND a.region_id <> b.region_id AND b.minx - a.maxx BETWEEN 1 AND 32 AND abs(b.h - a.h) <= 6 AND abs(b.cy - a.cy) <= 16),
nb AS (SELECT rg.frame_id, rg.region_id, nr.j AS neighbor_id, nr.dx FROM rg LEFT JOIN nr ON nr.frame_id = rg.frame_id AND nr.region_id = rg.region_id AND nr.rn = 1)"""
LN = """l1 AS (SELECT *, count(*) OVER f AS n, sum(maxy - miny + 1) OVER f AS sum_h, max(maxy) OVER (PARTITION BY frame_id ORDER BY miny, region_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen FROM rg WINDOW f AS (PARTITION BY frame_id)),
l2 AS (SELECT * EXCLUDE (n, sum_h, seen), CAST(sum(CASE WHEN seen IS NULL OR (miny - seen) * 5 * n > sum_h * 3 THEN 1 ELSE 0 END) OVER (PARTITION BY frame_id ORDER BY miny, region_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS line_no FROM l1)"""
PRED = """pr AS (SELECT vec_id, label AS true_label, CAST(vec_id % 7 + CASE WHEN embedding[1] > 0 THEN 0 ELSE 3 END AS INT) AS pred_label FROM embeddings WHERE label IS NOT NULL),
cl AS (SELECT range AS label FROM range(0, 11)),
mx AS (SELECT CAST(a.label AS INT) AS true_label, CAST(b.label AS INT) AS pred_label, coalesce(c.n, 0) AS n FROM cl a CROSS JOIN cl b LEFT JOIN (SELECT true_label, pred_label, count(*) AS n FROM pr GROUP BY ALL) c ON c.true_label = a.label AND c.pred_label = b.label)"""
ERR = "er AS (SELECT true_label, round(1 - CASE WHEN sum(n) > 0 THEN sum(CASE WHEN true_label = pred_label THEN n ELSE 0 END) / sum(n) ELSE 0 END, 6) AS error FROM mx GROUP BY ALL)"
WORST = "wo AS (SELECT * FROM er ORDER BY error DESC, true_label LIMIT 5)"
NM = "nm AS (SELECT true_label, pred_label, round(CASE WHEN sum(n) OVER (PARTITION BY true_label) > 0 THEN n / sum(n) OVER (PARTITION BY true_label) ELSE 0 END, 6) AS share FROM mx)"

# --- colour --------------------------------------------------------------------------------------------------------

C = F.col


def _rgb():
    return C("r"), C("g"), C("b")


def _px(spark: SparkSession, sf: str) -> DataFrame:
    return embedding_pixels(spark, sf)


def _q(spark: SparkSession, sf: str) -> DataFrame:
    return _px(spark, sf).withColumn("q", colour.rgb332(*_rgb()))


@query("q_rgb332", f"WITH {PX} SELECT frame_id, {Q332} AS q, count(*) AS n FROM px GROUP BY ALL")
def q_rgb332(spark, sf):
    return _q(spark, sf).groupBy("frame_id", "q").agg(F.count("*").alias("n"))


@query("q_quant6", f"WITH {PX}, t AS (SELECT frame_id, {Q6} AS q, count(*) AS n FROM px GROUP BY ALL) SELECT *, (q >> 4) * 85 AS pr, ((q >> 2) & 3) * 85 AS pg, (q & 3) * 85 AS pb FROM t")
def q_quant6(spark, sf):
    r, g, b = colour.quant6_rgb(C("q"))
    return _px(spark, sf).groupBy("frame_id", colour.quant6(*_rgb()).alias("q")).agg(F.count("*").alias("n")).withColumns({"pr": r, "pg": g, "pb": b})


@query("q_gray4", f"WITH {PX}, t AS (SELECT frame_id, {G4} AS q, count(*) AS n FROM px GROUP BY ALL) SELECT *, q * 17 AS grey, 15 - q AS inverse FROM t")
def q_gray4(spark, sf):
    return _px(spark, sf).groupBy("frame_id", colour.gray4(*_rgb()).alias("q")).agg(F.count("*").alias("n")).withColumns({"grey": colour.gray4_level(C("q")), "inverse": colour.gray4_inverse(C("q"))})


@query("q_expand", f"WITH {PX}, t AS (SELECT DISTINCT {Q332} AS q FROM px) SELECT q, (((q >> 5) << 5) | ((q >> 5) << 2) | ((q >> 5) >> 1)) AS r, ((((q >> 2) & 7) << 5) | (((q >> 2) & 7) << 2) | (((q >> 2) & 7) >> 1)) AS g, (q & 3) * 85 AS b, (((q & 31) << 3) | ((q & 31) >> 2)) AS e5 FROM t")
def q_expand(spark, sf):
    r, g, b = colour.expand_rgb332(C("q"))
    return _q(spark, sf).select("q").distinct().select("q", r.alias("r"), g.alias("g"), b.alias("b"), colour.expand5(C("q").bitwiseAND(31)).alias("e5"))


@query("q_invert", f"WITH {PX} SELECT frame_id, CAST(sum(255 - r) AS BIGINT) AS r, CAST(sum(255 - g) AS BIGINT) AS g, CAST(sum(255 - b) AS BIGINT) AS b, CAST(sum((r << 16) | (g << 8) | b) AS BIGINT) AS packed FROM px GROUP BY ALL")
def q_invert(spark, sf):
    return _px(spark, sf).groupBy("frame_id").agg(*[F.sum(colour.invert(C(c))).alias(c) for c in "rgb"], F.sum(colour.pack(*_rgb())).alias("packed"))


@query("q_scalar_bits", "SELECT p_partkey, CAST(ceil((p_size) / 32.0) AS INT) AS blocks, (p_size + 127) & ~127 AS aligned, CAST(bit_count(~xor(p_size, 21) & 255) AS INT) AS equal_bits, least(greatest(p_size - 3, 1), 32) AS workers, CASE WHEN p_size > 25 THEN 255 ELSE 0 END AS binary, round((p_size / 255.0 - 0.5) / 0.5, 9) AS normal FROM part")
def q_scalar_bits(spark, sf):
    s = C("p_size")
    return read(spark, sf, "part").select("p_partkey", bits.blocks_across(s).alias("blocks"), bits.align_up(s, 128).alias("aligned"), bits.xnor_matches(s, F.lit(21)).alias("equal_bits"), bits.worker_count(s).alias("workers"), colour.binarise(s, 25).alias("binary"), F.round(colour.normalise(s), 9).alias("normal"))


# --- blocks --------------------------------------------------------------------------------------------------------


@query("q_block_hist", f"WITH {PX}, {BL}, {HI} SELECT * FROM hi")
def q_block_hist(spark, sf):
    return blocks.histogram(_q(spark, sf), "q")


@query("q_block_bgfg", f"WITH {PX}, {BL}, {HI}, {BC} SELECT * FROM bc")
def q_block_bgfg(spark, sf):
    return blocks.block_colours(blocks.histogram(_q(spark, sf), "q"))


@query("q_block_uniform", f"WITH {PX}, t AS (SELECT *, y // 4 AS brow, x // 4 AS bcol FROM px) SELECT frame_id, brow, bcol, count(DISTINCT level) = 1 AS uniform FROM t GROUP BY ALL")
def q_block_uniform(spark, sf):
    return blocks.block_colours(blocks.histogram(_px(spark, sf), "level", 4)).select(*blocks.KEYS, "uniform")


@query("q_block_wildcard", f"WITH {PX}, t AS (SELECT *, y // 4 AS brow, x // 4 AS bcol FROM px), f AS (SELECT frame_id, brow, bcol, arg_min(level, y * 64 + x) AS first FROM t GROUP BY ALL) SELECT t.frame_id, t.brow, t.bcol, bool_and(first = 0 OR level = 0 OR level = first) AS uniform FROM t JOIN f USING (frame_id, brow, bcol) GROUP BY ALL")
def q_block_wildcard(spark, sf):
    return blocks.wildcard_uniform(_px(spark, sf), "level", 4)


@query("q_block_mask", f"WITH {PX}, {BL}, {HI}, {BC} SELECT bl.frame_id, bl.brow, bl.bcol, dy, bit_or(CAST(1 AS BIGINT) << dx) AS bits FROM bl JOIN bc USING (frame_id, brow, bcol) WHERE NOT uniform AND q <> bg GROUP BY ALL")
def q_block_mask(spark, sf):
    return blocks.mask_rows(_q(spark, sf), "q")


@query("q_foreground_count", f"WITH {PX}, {BL}, {HI}, {BC} SELECT bl.frame_id, bl.brow, bl.bcol, count(*) AS n FROM bl JOIN bc USING (frame_id, brow, bcol) WHERE NOT uniform AND q <> bg GROUP BY ALL")
def q_foreground_count(spark, sf):
    return blocks.foreground(_q(spark, sf), "q").groupBy(*blocks.KEYS).agg(F.count("*").alias("n"))


# --- runs ----------------------------------------------------------------------------------------------------------


@query("q_hruns", f"WITH {PX} " + run_sql("px", "level", "x"))
def q_hruns(spark, sf):
    return runs.runs(_px(spark, sf), "level", "x")


@query("q_vruns", f"WITH {PX} " + run_sql("px", "level", "y"))
def q_vruns(spark, sf):
    return runs.runs(_px(spark, sf), "level", "y")


MONO = f"h AS ({run_sql('px', 'level', 'x', 3)}), w AS ({run_sql('px', 'level', 'y', 3)}), ml AS (SELECT frame_id, first AS x, across AS y, value, len, 1 AS horizontal FROM h UNION ALL SELECT frame_id, across, first, value, len, 0 FROM w)"


@query("q_mono_lines", f"WITH {PX}, {MONO} SELECT * FROM ml")
def q_mono_lines(spark, sf):
    return runs.mono_lines(_px(spark, sf), "level", 3)


@query("q_lines_topk", f"WITH {PX}, {MONO} SELECT * FROM ml ORDER BY len DESC, frame_id, y, x, horizontal DESC LIMIT 100")
def q_lines_topk(spark, sf):
    return runs.longest(runs.mono_lines(_px(spark, sf), "level", 3), 100)


@query("q_lines_drawn", f"WITH {PX}, {MONO} SELECT frame_id, horizontal, count(*) AS n, CAST(sum(len) AS BIGINT) AS total FROM ml WHERE len >= 5 GROUP BY ALL")
def q_lines_drawn(spark, sf):
    return runs.mono_lines(_px(spark, sf), "level", 3).where("len >= 5").groupBy("frame_id", "horizontal").agg(F.count("*").alias("n"), F.sum("len").alias("total"))


# --- components, rectangles, regions -------------------------------------------------------------------------------

SIGN = "sg AS (SELECT *, CASE WHEN v < 0 THEN 0 ELSE 1 END AS sign FROM px)"


def _sign(spark, sf):
    return _px(spark, sf).withColumn("sign", F.when(C("v") < 0, 0).otherwise(1))


def _level_runs(spark, sf, value="level"):
    return components.numbered(runs.row_runs(_sign(spark, sf), value))


LEVEL8 = f"WITH RECURSIVE {PX}, {ROWS.format(run_sql('px', 'level', 'x'))}, {component_sql('ro', True)}"
SIGN4 = f"WITH RECURSIVE {PX}, {SIGN}, {ROWS.format(run_sql('sg', 'sign', 'x'))}, {component_sql('ro', False)}"


@query("q_components4", f"{SIGN4} SELECT frame_id, run_id, component FROM cc")
def q_components4(spark, sf):
    return components.components(_level_runs(spark, sf, "sign")).select("frame_id", "run_id", "component")


@query("q_ccl8_buckets", f"{LEVEL8} SELECT * FROM bxs")
def q_ccl8_buckets(spark, sf):
    return components.boxes(components.components(_level_runs(spark, sf), eight=True))


@query("q_ccl_gray16", f"WITH RECURSIVE {PX}, gy AS (SELECT *, {G4} AS grey FROM px), {ROWS.format(run_sql('gy', 'grey', 'x'))}, {component_sql('ro', True)} SELECT * FROM bxs WHERE maxx - minx + 1 >= 3 AND maxy - miny + 1 >= 2")
def q_ccl_gray16(spark, sf):
    grey = _px(spark, sf).withColumn("grey", colour.gray4(*_rgb()))
    return components.boxes(components.components(components.numbered(runs.row_runs(grey, "grey")), eight=True)).where("maxx - minx + 1 >= 3 and maxy - miny + 1 >= 2")


SOLID = f"{SIGN4}, so AS (SELECT frame_id, minx AS x, miny AS y, maxx - minx + 1 AS w, maxy - miny + 1 AS h, value FROM bxs WHERE cnt = (maxx - minx + 1) * (maxy - miny + 1) AND maxx - minx + 1 >= 2 AND maxy - miny + 1 >= 1)"


@query("q_rect_solid", f"{SOLID} SELECT * FROM so")
def q_rect_solid(spark, sf):
    return shapes.solid_rectangles(_level_runs(spark, sf, "sign").drop("run_id"), 2, 1)


@query("q_rect_takewhile", f"{SOLID}, tw AS (SELECT *, max(CASE WHEN w < 3 OR h < 1 THEN 1 ELSE 0 END) OVER (PARTITION BY frame_id ORDER BY w * h DESC, y, x, value ROWS UNBOUNDED PRECEDING) AS failed FROM so) SELECT * EXCLUDE failed FROM tw WHERE failed = 0")
def q_rect_takewhile(spark, sf):
    return shapes.take_while(q_rect_solid(spark, sf), 3, 1)


# rows from the top: each run goes on with the earliest base that it contains, or is a base; a run of no frame keeps rows going
GREEDY = f"""WITH RECURSIVE {PX}, {SIGN}, {ROWS.format(run_sql('sg', 'sign', 'x', 2))}, gr AS MATERIALIZED (SELECT frame_id, y, x1, x2, value FROM ro UNION ALL SELECT -1, CAST(range AS INT), 0, 0, -1 FROM range(0, 100)),
gb(y, frame_id, x1, x2, value, top, bx1, bx2) AS (SELECT y, frame_id, x1, x2, value, y, x1, x2 FROM gr WHERE y = 0
  UNION ALL SELECT y, frame_id, x1, x2, value, b.t, b.p, b.q FROM (SELECT r.y, r.frame_id, r.x1, r.x2, r.value, min(CASE WHEN g.top IS NULL THEN {{'t': r.y, 'p': r.x1, 'q': r.x2}} ELSE {{'t': g.top, 'p': g.bx1, 'q': g.bx2}} END) AS b
    FROM gr r JOIN (SELECT max(y) + 1 AS k FROM gb) z ON r.y = z.k LEFT JOIN gb g ON g.frame_id = r.frame_id AND g.value = r.value AND r.x1 <= g.bx1 AND r.x2 >= g.bx2 GROUP BY ALL))"""


@query("q_rect_greedy", f"{GREEDY} SELECT frame_id, bx1 AS x, top AS y, bx2 - bx1 + 1 AS w, count(*) AS h, value FROM gb WHERE frame_id >= 0 GROUP BY frame_id, value, top, bx1, bx2 HAVING count(*) >= 2")
def q_rect_greedy(spark, sf):
    return shapes.greedy_rectangles(_level_runs(spark, sf, "sign").drop("run_id"), 2, 2)


@query("q_rect_drawn", f"{SOLID}, co AS (SELECT DISTINCT px.frame_id, px.x, px.y FROM px JOIN so ON px.frame_id = so.frame_id AND px.x BETWEEN so.x AND so.x + so.w - 1 AND px.y BETWEEN so.y AND so.y + so.h - 1 WHERE so.w >= 3) SELECT px.frame_id, CAST(sum(CASE WHEN co.x IS NULL THEN px.r ELSE 255 - px.r END) AS BIGINT) AS r, CAST(sum(CASE WHEN co.x IS NULL THEN px.g ELSE 255 - px.g END) AS BIGINT) AS g FROM px LEFT JOIN co USING (frame_id, x, y) GROUP BY ALL")
def q_rect_drawn(spark, sf):
    drawn = render.inverted_under(_px(spark, sf), q_rect_solid(spark, sf).where("w >= 3"))
    return drawn.groupBy("frame_id").agg(F.sum("r").alias("r"), F.sum("g").alias("g"))


MASKED = f"{PX}, {BL}, {HI}, {BC}, fg AS (SELECT bl.frame_id, y, x, 1 AS ink FROM bl JOIN bc USING (frame_id, brow, bcol) WHERE NOT uniform AND q <> bg)"
# the first pixel of a region in the order of blocks, of which a frame has two columns
FIRST_PIXEL = "fp AS (SELECT fg.frame_id, component, min(((y // 32 * 2 + x // 32) * 32 + y % 32) * 32 + x % 32) AS local FROM (SELECT DISTINCT frame_id, y, x FROM fg) fg JOIN (SELECT frame_id, y AS ry, x1, x2, component FROM rn JOIN cc USING (frame_id, run_id)) r ON r.frame_id = fg.frame_id AND r.ry = fg.y AND fg.x BETWEEN r.x1 AND r.x2 GROUP BY ALL)"
REG4 = f"WITH RECURSIVE {MASKED}, {ROWS.format(run_sql('fg', 'ink', 'x'))}, {component_sql('ro', False)}, {FIRST_PIXEL}, rs AS (SELECT bxs.*, row_number() OVER (PARTITION BY frame_id ORDER BY local) AS region_id FROM bxs JOIN fp USING (frame_id, component))"


def _regions(spark, sf):
    ink = blocks.foreground(_q(spark, sf), "q").withColumn("ink", F.lit(1))
    return regions.number_regions(components.components(components.numbered(runs.row_runs(ink, "ink"))))


@query("q_regions4", f"{REG4} SELECT frame_id, region_id, minx, miny, maxx, maxy, cnt, runs FROM rs")
def q_regions4(spark, sf):
    return _regions(spark, sf).select("frame_id", "region_id", "minx", "miny", "maxx", "maxy", "cnt", "runs")


@query("q_regions_small", f"{REG4} SELECT frame_id, region_id, minx, miny, maxx, maxy, cnt FROM rs WHERE maxx - minx + 1 <= 32 AND maxy - miny + 1 <= 32")
def q_regions_small(spark, sf):
    return regions.small_regions(_regions(spark, sf)).select("frame_id", "region_id", "minx", "miny", "maxx", "maxy", "cnt")


@query("q_word_runs", f"WITH {DOC_RUNS} SELECT frame_id, count(*) AS runs, CAST(sum(x2 - x1 + 1) AS BIGINT) AS ink, max(y) AS last_line, max(x2) AS widest FROM dr GROUP BY ALL")
def q_word_runs(spark, sf):
    return document_runs(spark, sf).groupBy("frame_id").agg(F.count("*").alias("runs"), F.sum(C("x2") - C("x1") + 1).alias("ink"), F.max("y").alias("last_line"), F.max("x2").alias("widest"))


@query("q_text_blocks", f"WITH RECURSIVE {DOC_RUNS}, {component_sql('dr', False)} SELECT frame_id, count(*) AS blocks, max(cnt) AS largest, max(runs) AS most_runs FROM bxs GROUP BY ALL")
def q_text_blocks(spark, sf):
    found = components.boxes(components.components(components.numbered(document_runs(spark, sf)), strip=components.STRIP))
    return found.groupBy("frame_id").agg(F.count("*").alias("blocks"), F.max("cnt").alias("largest"), F.max("runs").alias("most_runs"))


H64 = f"h6 AS (SELECT frame_id, {Q6} AS colour, count(*) AS n FROM px GROUP BY ALL), tk AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY n DESC, colour) AS rank FROM h6 QUALIFY rank <= 15)"


def _top15(spark, sf):
    return blocks.rank_colours(_px(spark, sf).groupBy("frame_id", colour.quant6(*_rgb()).alias("colour")).agg(F.count("*").alias("n")), 15)


@query("q_top15_colors", f"WITH {PX}, {H64} SELECT * FROM tk")
def q_top15_colors(spark, sf):
    return _top15(spark, sf)


@query("q_top15_ccl", f"WITH RECURSIVE {PX}, {H64}, t6 AS (SELECT px.*, {Q6} AS colour FROM px SEMI JOIN tk ON tk.frame_id = px.frame_id AND tk.colour = {Q6}), {ROWS.format(run_sql('t6', 'colour', 'x'))}, {component_sql('ro', True)} SELECT * FROM bxs")
def q_top15_ccl(spark, sf):
    own = _px(spark, sf).withColumn("colour", colour.quant6(*_rgb())).join(_top15(spark, sf), ["frame_id", "colour"], "left_semi")
    return components.boxes(components.components(components.numbered(runs.row_runs(own, "colour")), eight=True))


# --- text ----------------------------------------------------------------------------------------------------------


@query("q_region_picture", f"{REG4}, bx AS (SELECT frame_id, unnest(range(minx, maxx + 1)) AS x, miny AS y, region_id FROM rs UNION ALL SELECT frame_id, unnest(range(minx, maxx + 1)), maxy, region_id FROM rs UNION ALL SELECT frame_id, minx, unnest(range(miny, maxy + 1)), region_id FROM rs UNION ALL SELECT frame_id, maxx, unnest(range(miny, maxy + 1)), region_id FROM rs), al AS (SELECT frame_id, x, y, max(region_id) AS region_id FROM (SELECT * FROM bx UNION ALL SELECT frame_id, x, y, NULL FROM fg) GROUP BY ALL) SELECT frame_id, region_id, count(*) AS n, CAST(sum(x * 100 + y) AS BIGINT) AS places FROM al GROUP BY ALL")
def q_region_picture(spark, sf):
    ink = blocks.foreground(_q(spark, sf), "q").withColumn("ink", F.lit(1))
    drawn = render.region_picture(ink, _regions(spark, sf), F.lit(64), F.lit(100))
    return drawn.groupBy("frame_id", "region_id").agg(F.count("*").alias("n"), F.sum(C("x") * 100 + C("y")).cast("long").alias("places"))


@query("q_drawn_lines", f"WITH {PX}, {MONO}, co AS (SELECT DISTINCT px.frame_id, px.x, px.y FROM px JOIN ml ON px.frame_id = ml.frame_id AND ml.len >= 5 AND CASE WHEN horizontal = 1 THEN px.y = ml.y AND px.x BETWEEN ml.x AND ml.x + len - 1 ELSE px.x = ml.x AND px.y BETWEEN ml.y AND ml.y + len - 1 END) SELECT px.frame_id, count(co.x) AS drawn, CAST(sum(CASE WHEN co.x IS NULL THEN px.r ELSE 255 - px.r END) AS BIGINT) AS r FROM px LEFT JOIN co USING (frame_id, x, y) GROUP BY ALL")
def q_drawn_lines(spark, sf):
    px, lines = _px(spark, sf), render.lines_as_boxes(runs.mono_lines(_px(spark, sf), "level", 3), 5)
    drawn = render.inverted_under(px, lines, keep_hit=True)
    return drawn.groupBy("frame_id").agg(F.count("hit").alias("drawn"), F.sum("r").alias("r"))


@query("q_neighbors", f"WITH {BOX}, {NB} SELECT * FROM nb")
def q_neighbors(spark, sf):
    return regions.right_neighbours(event_boxes(spark, sf))


@query("q_text_lines", f"WITH {BOX}, {LN} SELECT frame_id, line_no, count(*) AS n, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy, string_agg(CAST(region_id AS VARCHAR), ',' ORDER BY minx, region_id) AS members FROM l2 GROUP BY ALL")
def q_text_lines(spark, sf):
    return regions.line_boxes(regions.text_lines(event_boxes(spark, sf)))


@query("q_line_order", f"WITH {BOX}, {LN} SELECT frame_id, region_id, line_no, row_number() OVER (PARTITION BY frame_id, line_no ORDER BY minx, region_id) AS pos FROM l2")
def q_line_order(spark, sf):
    return regions.text_lines(event_boxes(spark, sf)).select("frame_id", "region_id", "line_no", "pos")


HEADS = "hd AS (SELECT frame_id, region_id FROM nb WHERE neighbor_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nb o WHERE o.frame_id = nb.frame_id AND o.neighbor_id = nb.region_id))"


@query("q_chain_heads", f"WITH {BOX}, {NB}, {HEADS} SELECT * FROM hd")
def q_chain_heads(spark, sf):
    return regions.chain_heads(regions.right_neighbours(event_boxes(spark, sf)))


CHAIN = "ch(frame_id, region_id, cur) AS (SELECT frame_id, region_id, region_id FROM hd UNION ALL SELECT ch.frame_id, ch.region_id, nb.neighbor_id FROM ch JOIN nb ON nb.frame_id = ch.frame_id AND nb.region_id = ch.cur WHERE nb.neighbor_id IS NOT NULL)"


@query("q_chains", f"WITH RECURSIVE {BOX}, {NB}, {HEADS}, {CHAIN} SELECT ch.frame_id, ch.region_id, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy, count(*) AS n FROM ch JOIN rg ON rg.frame_id = ch.frame_id AND rg.region_id = ch.cur GROUP BY ALL")
def q_chains(spark, sf):
    boxes = event_boxes(spark, sf)
    return regions.chains(boxes, regions.right_neighbours(boxes))


def _frame_sql(boxes: str, layer: int) -> str:
    parts = [f"SELECT frame_id, unnest(range(minx, maxx + 1)) AS x, {y} AS y, {layer} AS layer FROM {boxes}" for y in ("miny", "maxy")]
    parts += [f"SELECT frame_id, {x} AS x, unnest(range(miny, maxy + 1)) AS y, {layer} AS layer FROM {boxes}" for x in ("minx", "maxx")]
    return " UNION ALL ".join(parts)


LINED = "lb AS (SELECT frame_id, line_no, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM l2 GROUP BY ALL)"


@query("q_line_borders", f"WITH {BOX}, {LN}, {LINED}, e AS ({_frame_sql('lb', 0)}) SELECT frame_id, count(DISTINCT x * 1000 + y) AS pixels FROM e WHERE x < 400 AND y < 300 GROUP BY ALL")
def q_line_borders(spark, sf):
    lines = regions.line_boxes(regions.text_lines(event_boxes(spark, sf)))
    return render.border(lines, F.lit(400), F.lit(300)).groupBy("frame_id").agg(F.count("*").alias("pixels"))


@query("q_chain_borders", f"WITH RECURSIVE {BOX}, {NB}, {HEADS}, {CHAIN}, cb AS (SELECT ch.frame_id, min(minx) AS minx, min(miny) AS miny, max(maxx) AS maxx, max(maxy) AS maxy FROM ch JOIN rg ON rg.frame_id = ch.frame_id AND rg.region_id = ch.cur GROUP BY ch.frame_id, ch.region_id), e AS ({_frame_sql('sm', 0)} UNION ALL {_frame_sql('cb', 1)}), t AS (SELECT frame_id, x, y, max(layer) AS layer FROM e WHERE x < 400 AND y < 300 GROUP BY ALL) SELECT frame_id, count(*) AS pixels, count(*) FILTER (layer = 1) AS red FROM t GROUP BY ALL")
def q_chain_borders(spark, sf):
    drawn = render.chain_picture(event_boxes(spark, sf), q_chains(spark, sf), F.lit(400), F.lit(300))
    return drawn.groupBy("frame_id").agg(F.count("*").alias("pixels"), F.count_if(C("r") == 255).alias("red"))


# --- glyphs --------------------------------------------------------------------------------------------------------

INK = f"{SIGN4}, gp AS (SELECT rn.frame_id, cc.component AS region_id, unnest(range(x1, x2 + 1)) AS x, y FROM rn JOIN cc USING (frame_id, run_id) WHERE value = 1), gb AS (SELECT gp.frame_id, gp.region_id, gp.x, gp.y, minx, miny, maxx, maxy FROM gp JOIN bxs ON bxs.frame_id = gp.frame_id AND bxs.component = gp.region_id)"
SAMPLE = "sa AS (SELECT frame_id, region_id, CAST(y - miny AS INT) AS row, CAST(bit_or(CAST(1 AS INT) << CAST(x - minx AS INT)) AS INT) AS bits FROM gb WHERE x - minx < 16 AND y - miny < 16 GROUP BY ALL)"


def _ink(spark, sf):
    labelled = components.components(_level_runs(spark, sf, "sign").where("value = 1"))
    box = components.boxes(labelled).select("frame_id", "component", "minx", "miny", "maxx", "maxy")
    px = labelled.select("frame_id", "component", "y", F.explode(F.sequence("x1", "x2")).alias("x"))
    return px.join(box, ["frame_id", "component"]).withColumnRenamed("component", "region_id")


@query("q_glyph_sample", f"{INK}, {SAMPLE} SELECT * FROM sa")
def q_glyph_sample(spark, sf):
    return glyphs.samples(_ink(spark, sf))


@query("q_recognize", f"{INK}, {SAMPLE} SELECT frame_id, region_id, CASE WHEN 256 - sum(bit_count(bits)) >= 192 THEN 'A' ELSE '?' END AS ch, CAST(256 - sum(bit_count(bits)) AS BIGINT) AS score FROM sa GROUP BY ALL")
def q_recognize(spark, sf):
    return glyphs.recognise(glyphs.samples(_ink(spark, sf)), glyphs.zero_templates(spark))


BITMAP = "bm AS (SELECT frame_id, region_id, maxx - minx + 1 AS w, maxy - miny + 1 AS h, list((y - miny) * (maxx - minx + 1) + x - minx) AS on_ FROM gb GROUP BY ALL), bt AS (SELECT frame_id, region_id, w, h, array_to_string(list_transform(range(0, CAST(w * h AS BIGINT)), lambda i: CASE WHEN list_contains(on_, i) THEN '1' ELSE '0' END), '') AS bits FROM bm)"
NAMED = f"nd AS (SELECT w, h, bits, count(*) AS seen, array_to_string(list_transform(range(0, least(250, CAST(ceil(length(bits) / 6.0) AS BIGINT))), lambda i: substr('{naming.ALPHABET}', CAST(list_sum(list_transform(range(0, 6), lambda k: CASE WHEN substr(rpad(bits, 1500, '0'), i * 6 + k + 1, 1) = '1' THEN 1 << CAST(5 - k AS INT) ELSE 0 END)) AS BIGINT) + 1, 1)), '') AS name FROM bt GROUP BY w, h, bits)"


# three templates of 16 rows: the fourth row and below set, odd columns set, nothing set; the first of equal scores wins
TEMPLATES = "tp(k, ch) AS (VALUES (0, 'H'), (1, 'V'), (2, 'O')), tr AS (SELECT k, ch, CAST(range AS INT) AS row, CASE k WHEN 0 THEN CASE WHEN range >= 3 THEN 65535 ELSE 0 END WHEN 1 THEN 43690 ELSE 0 END AS want FROM tp CROSS JOIN range(0, 16))"


@query("q_recognize_best", f"{INK}, {SAMPLE}, {TEMPLATES}, ms AS (SELECT r.frame_id, r.region_id, k, ch, 256 - CAST(sum(bit_count(xor(want, coalesce(bits, 0)))) AS BIGINT) AS score FROM (SELECT DISTINCT frame_id, region_id FROM sa) r CROSS JOIN tr LEFT JOIN sa ON sa.frame_id = r.frame_id AND sa.region_id = r.region_id AND sa.row = tr.row GROUP BY ALL), bs AS (SELECT *, row_number() OVER (PARTITION BY frame_id, region_id ORDER BY score DESC, k) AS rn FROM ms) SELECT frame_id, region_id, CASE WHEN score >= 128 THEN ch ELSE '?' END AS ch, score FROM bs WHERE rn = 1")
def q_recognize_best(spark, sf):
    rows = [(0, "H", [65535 if r >= 3 else 0 for r in range(16)]), (1, "V", [43690] * 16), (2, "O", [0] * 16)]
    return glyphs.recognise(glyphs.samples(_ink(spark, sf)), spark.createDataFrame(rows, "template_no int, ch string, bits array<int>"), 0.5)


@query("q_glyph_dedupe", f"{INK}, {BITMAP}, {NAMED} SELECT w, h, name, seen FROM nd")
def q_glyph_dedupe(spark, sf):
    return glyphs.glyph_store(glyphs.glyph_bits(_ink(spark, sf)))


@query("q_glyph_new", f"{INK}, {BITMAP}, {NAMED} SELECT w, h, name, seen FROM nd WHERE NOT EXISTS (SELECT 1 FROM bt o WHERE o.frame_id = 0 AND o.w = nd.w AND o.h = nd.h AND o.bits = nd.bits)")
def q_glyph_new(spark, sf):
    bitmaps = glyphs.glyph_bits(_ink(spark, sf))
    return glyphs.glyph_store(bitmaps, glyphs.glyph_store(bitmaps.where("frame_id = 0")))


# samples drawn from stored glyphs: their character comes from their size
DRAWN = f"""{INK}, {BITMAP}, gl AS (SELECT DISTINCT CAST(w AS INT) AS w, CAST(h AS INT) AS h, bits, substr('A0.,:', CAST((w + h) % 5 + 1 AS BIGINT), 1) AS ch FROM bt),
ta AS (SELECT *, CAST('0x' || left(md5(w || '|' || h || '|' || bits || '|' || attempt), 8) AS BIGINT) AS seed FROM (SELECT *, CAST(unnest(range(0, 3)) AS INT) AS attempt FROM gl)),
tb AS (SELECT *, 300 + {{1}} AS scale, CAST({{2}} - 5 AS INT) AS jx, CAST({{3}} - 5 AS INT) AS jy, CASE WHEN {{4}} < 100 THEN 'val' ELSE 'train' END AS split FROM ta),
tc AS (SELECT *, greatest(1, w * scale // 1000) AS sw, greatest(1, h * scale // 1000) AS sh FROM tb),
td AS (SELECT row_number() OVER () AS id, *, CAST(floor((48 - sw) / 2) AS INT) + jx - 8 AS ax, CAST(floor((48 - sh) / 2) AS INT) + jy - 8 AS ay FROM tc WHERE sw <= 32 AND sh <= 32),
te AS (SELECT * FROM td WHERE ax >= 0 AND ay >= 0 AND ax + sw <= 32 AND ay + sh <= 32),
tp AS (SELECT *, k % w AS i, k // w AS j FROM (SELECT *, unnest(range(0, CAST(w AS BIGINT) * h)) AS k FROM te) WHERE substr(bits, CAST(k + 1 AS INT), 1) = '1'),
tx AS (SELECT *, unnest(range(i * sw // w, CAST(ceil((i + 1) * sw / w) AS BIGINT))) AS x FROM tp),
ty AS (SELECT *, unnest(range(j * sh // h, CAST(ceil((j + 1) * sh / h) AS BIGINT))) AS y FROM tx),
tz AS (SELECT id, x, y, sum((least((x + 1) * w, (i + 1) * sw) - greatest(x * w, i * sw)) * (least((y + 1) * h, (j + 1) * sh) - greatest(y * h, j * sh))) AS area FROM ty GROUP BY ALL),
tk AS (SELECT id, ay + y AS y, sum(CAST(1 AS BIGINT) << CAST(31 - ax - x AS INT)) AS line, count(*) AS black FROM tz JOIN te USING (id) WHERE 255 * (w * h - area) <= 128 * w * h GROUP BY ALL),
tl AS (SELECT te.id, r.r, coalesce(tk.line, 0) AS line, coalesce(tk.black, 0) AS black FROM te CROSS JOIN range(0, 32) r(r) LEFT JOIN tk ON tk.id = te.id AND tk.y = r.r),
tm AS (SELECT id, CAST(sum(black) AS INT) AS black, string_agg(printf('%08X', CAST(line AS BIGINT)), '' ORDER BY r) AS image FROM tl GROUP BY ALL)"""


def _seeded(k: int, n: int) -> str:
    return f"((seed * {7919 + 104729 * k} + {611953 * k}) % 1000003 % {n})"


def _drawn_sql() -> str:
    out = DRAWN
    for k, n in ((1, 1601), (2, 11), (3, 11), (4, 1000)):
        out = out.replace(f"{{{k}}}", _seeded(k, n))
    return out + " SELECT w, h, bits, ch, attempt, split, black, image FROM te JOIN tm USING (id) WHERE black >= CASE ch WHEN 'A' THEN 10 WHEN '0' THEN 9 WHEN '.' THEN 1 WHEN ',' THEN 2 WHEN ':' THEN 2 ELSE 1 END"


def _least_black(spark):
    return spark.createDataFrame(list(generate.LEAST_BLACK.items()), "ch string, least int")


@query("q_gen_images", _drawn_sql())
def q_gen_images(spark, sf):
    stored = glyphs.glyph_bits(_ink(spark, sf)).select("w", "h", "bits").distinct()
    made = stored.withColumn("ch", F.substring(F.lit("A0.,:"), ((C("w") + C("h")) % 5 + 1).cast("int"), F.lit(1)))
    return drawing.generate_samples(made, _least_black(spark), 3).select("w", "h", "bits", "ch", "attempt", "split", "black", F.hex("image").alias("image"))


@query("q_train_glyphs")
def q_train_glyphs(spark, sf):
    """Epochs of the network on samples of the ten commonest glyphs of four cells or more: four attempts for each place where one is seen."""
    found = glyphs.glyph_bits(_ink(spark, sf)).where("w * h >= 4")
    seen = written(found.groupBy("w", "h", "bits").agg(F.count("*").alias("seen")), "seen-glyphs")
    classes = seen.orderBy(F.desc("seen"), "w", "h", "bits").limit(10).withColumn("ch", F.lit("."))
    tries = drawing.attempts(classes, 4 * C("seen"), 0.2, cell=6)
    made = drawing.draw(tries).select(F.concat_ws("x", "w", "h", "bits").alias("label"), "image", "split", F.concat_ws("|", "w", "h", "bits", "attempt").alias("key"))
    return training.train(made, epochs=2, steps=3, rate=3e-3)[1]


# --- evaluation ----------------------------------------------------------------------------------------------------


@query("q_class_balance", "WITH c AS (SELECT source AS class, count(*) AS n FROM documents GROUP BY ALL) SELECT class, n, round((n - avg(n) OVER ()) / avg(n) OVER () * 100, 6) AS deviation FROM c")
def q_class_balance(spark, sf):
    return evaluate.class_balance(read(spark, sf, "documents").groupBy(C("source").alias("class")).agg(F.count("*").alias("n")))


@query("q_split_balance", "WITH c AS (SELECT lang AS class, count(*) AS n FROM documents WHERE lang IS NOT NULL GROUP BY ALL) SELECT class, n, round((n - avg(n) OVER ()) / avg(n) OVER () * 100, 6) AS deviation FROM c ORDER BY class")
def q_split_balance(spark, sf):
    rows = evaluate.split(read(spark, sf, "documents").where("lang is not null").select(C("lang").alias("class"), "doc_id"), "doc_id")
    return evaluate.balance_report(rows.where("split = 'train'"), rows.where("split = 'val'"))


@query("q_class_balance_zero", "WITH k AS (SELECT DISTINCT o_orderpriority || '/' || o_orderstatus AS class FROM orders UNION SELECT 'none/none'), c AS (SELECT o_orderpriority || '/' || o_orderstatus AS class, count(*) AS n FROM orders WHERE o_totalprice > 50000 GROUP BY ALL), f AS (SELECT k.class, coalesce(c.n, 0) AS n FROM k LEFT JOIN c USING (class)) SELECT class, n, round((n - avg(n) OVER ()) / avg(n) OVER () * 100, 6) AS deviation FROM f")
def q_class_balance_zero(spark, sf):
    orders = read(spark, sf, "orders").withColumn("class", F.concat_ws("/", "o_orderpriority", "o_orderstatus"))
    classes = orders.select("class").distinct().unionByName(spark.createDataFrame([("none/none",)], "class string"))
    return evaluate.class_balance(evaluate.with_all_classes(orders.where("o_totalprice > 50000").groupBy("class").agg(F.count("*").alias("n")), classes))


def _predictions(spark, sf):
    e = read(spark, sf, "embeddings").where("label is not null")
    return e.select("vec_id", C("label").alias("true_label"), (C("vec_id") % 7 + F.when(C("embedding")[0] > 0, 0).otherwise(3)).cast("int").alias("pred_label"))


def _matrix(spark, sf):
    return evaluate.confusion(_predictions(spark, sf), spark.range(11).select(C("id").cast("int").alias("label")))


@query("q_confusion", f"WITH {PRED} SELECT * FROM mx")
def q_confusion(spark, sf):
    return _matrix(spark, sf)


@query("q_confusion_norm", f"WITH {PRED}, {NM} SELECT * FROM nm")
def q_confusion_norm(spark, sf):
    return evaluate.normalised(_matrix(spark, sf))


@query("q_class_errors", f"WITH {PRED}, {ERR} SELECT * FROM er")
def q_class_errors(spark, sf):
    return evaluate.class_errors(_matrix(spark, sf))


@query("q_error_topk", f"WITH {PRED}, {ERR}, {WORST} SELECT * FROM wo")
def q_error_topk(spark, sf):
    return evaluate.worst_classes(_matrix(spark, sf), 5)


@query("q_confused_submatrix", f"WITH {PRED}, {ERR}, {WORST}, {NM} SELECT * FROM nm WHERE true_label IN (SELECT true_label FROM wo) AND pred_label IN (SELECT true_label FROM wo)")
def q_confused_submatrix(spark, sf):
    return evaluate.worst_submatrix(_matrix(spark, sf), 5)


@query("q_accuracy", f"WITH {PRED} SELECT count(*) AS n, round(avg(CASE WHEN true_label = pred_label THEN 1.0 ELSE 0.0 END) * 100, 6) AS accuracy FROM pr")
def q_accuracy(spark, sf):
    return evaluate.accuracy(_predictions(spark, sf))


@query("q_weighted_loss", "SELECT round(sum(l_discount * l_quantity) / sum(l_quantity), 6) AS mean FROM lineitem")
def q_weighted_loss(spark, sf):
    return evaluate.weighted_mean(read(spark, sf, "lineitem"), "l_discount", "l_quantity")


@query("q_overfit_flag", "WITH e AS (SELECT day(ts) AS epoch, round(avg(value) FILTER (event_id % 10 <> 0), 6) AS train, round(avg(value) FILTER (event_id % 10 = 0), 6) AS val FROM events GROUP BY ALL) SELECT CAST(epoch AS INT) AS epoch, coalesce(val - lag(val) OVER (ORDER BY epoch) > 1e-3 AND lag(train) OVER (ORDER BY epoch) - train > 1e-3, false) AS overfit FROM e")
def q_overfit_flag(spark, sf):
    held = C("event_id") % 10 == 0
    e = read(spark, sf, "events").groupBy(F.dayofmonth("ts").alias("epoch")).agg(F.round(F.avg(F.when(~held, C("value"))), 6).alias("train"), F.round(F.avg(F.when(held, C("value"))), 6).alias("val"))
    return evaluate.overfit(e)


HASH = "({} % 1000003) * 7919 % 1000003"


@query("q_split", f"SELECT vec_id, CASE WHEN {HASH.format('vec_id')} < 100000 THEN 'val' ELSE 'train' END AS split FROM embeddings")
def q_split(spark, sf):
    return evaluate.split(read(spark, sf, "embeddings"), "vec_id").select("vec_id", "split")


@query("q_sample_n", f"SELECT doc_id, source FROM documents ORDER BY {HASH.format('doc_id')}, doc_id LIMIT 64")
def q_sample_n(spark, sf):
    return evaluate.sample(read(spark, sf, "documents"), "doc_id", 64).select("doc_id", "source")


# --- sample grids and names ----------------------------------------------------------------------------------------


def _groups_sql() -> str:
    def values(pairs):
        return ", ".join("('" + c.replace("'", "''") + "', '" + k + "')" for c, k in pairs)

    alike = [(c, to) for c, to in zip(*naming.HOMOGLYPHS, strict=True)] + [(to, to) for to in naming.HOMOGLYPHS[1]] + [(c, k) for k, many in generate.ALSO.items() for c in many]
    fixed = [(c, k) for k, c in generate.MARKS.items()] + [(d, d) for d in "0123456789"]
    return f"""WITH g(ch, class) AS (VALUES {values(alike)}), f(ch, class) AS (VALUES {values(fixed)}),
    l AS (SELECT chr(CAST(i AS INT)) AS ch FROM (SELECT unnest(range(65, 91)) AS i UNION ALL SELECT unnest(range(97, 123)) UNION ALL SELECT unnest(range(1040, 1104)))),
    a AS (SELECT * FROM g UNION ALL SELECT * FROM f UNION ALL SELECT ch, ch FROM l WHERE ch NOT IN (SELECT ch FROM g))
    , d AS (SELECT ch, count(*) AS n FROM (SELECT unnest(string_split(text, '')) AS ch FROM documents) GROUP BY ALL)
    SELECT class, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n, string_agg(a.ch, '' ORDER BY a.ch) AS members FROM a LEFT JOIN d USING (ch) GROUP BY ALL"""


@query("q_class_groups", _groups_sql())
def q_class_groups(spark, sf):
    """How often the documents have each class's characters, and which these are."""
    used = read(spark, sf, "documents").select(F.explode(F.split("text", "")).alias("ch")).groupBy("ch").agg(F.count("*").alias("n"))
    counted = generate.characters(spark).join(used, "ch", "left")
    return counted.groupBy("class").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"), F.array_join(F.array_sort(F.collect_list("ch")), "").alias("members"))


@query("q_homoglyph", f"SELECT doc_id, md5(translate(text, '{naming.HOMOGLYPHS[0]}', '{naming.HOMOGLYPHS[1]}')) AS digest, CASE WHEN length(text) = 0 THEN 0 ELSE unicode(text) END AS first FROM documents")
def q_homoglyph(spark, sf):
    return read(spark, sf, "documents").select("doc_id", F.md5(naming.look_alike(C("text")).cast("binary")).alias("digest"), F.ascii("text").alias("first"))


@query("q_gen_grid", "SELECT n_name AS class, r_name AS font, CAST(unnest(range(0, greatest(30, CAST(ceil(200.0 / (SELECT count(*) FROM region)) AS BIGINT)))) AS INT) AS attempt FROM nation CROSS JOIN region")
def q_gen_grid(spark, sf):
    fonts = read(spark, sf, "region").select(C("r_name").alias("font"))
    return generate.grid(read(spark, sf, "nation").select(C("n_name").alias("class")), fonts, 200)


GRID = "gr AS (SELECT n_name AS class, r_name AS font, CAST(unnest(range(0, 40)) AS INT) AS attempt, n_nationkey, r_regionkey, substr(n_name, 1, 1) AS ch FROM nation CROSS JOIN region), gk AS (SELECT *, (n_nationkey * 7 + r_regionkey * 11 + attempt * 13) % 41 AS black FROM gr)"
LEAST = "CASE ch WHEN 'A' THEN 10 WHEN '0' THEN 9 WHEN '.' THEN 1 WHEN ',' THEN 2 WHEN ':' THEN 2 ELSE 1 END"


@query("q_gen_yield", f"WITH {GRID} SELECT class, font, count(*) AS n, count(*) < 35 AS short FROM gk WHERE black >= {LEAST} GROUP BY ALL")
def q_gen_yield(spark, sf):
    nation = read(spark, sf, "nation").select(C("n_name").alias("class"), "n_nationkey", F.substring("n_name", 1, 1).alias("ch"))
    fonts = read(spark, sf, "region").select(C("r_name").alias("font"), "r_regionkey")
    made = generate.grid(nation, fonts, 200).withColumn("black", (C("n_nationkey") * 7 + C("r_regionkey") * 11 + C("attempt") * 13) % 41)
    least = spark.createDataFrame(list(generate.LEAST_BLACK.items()), "ch string, least int")
    return generate.yields(generate.enough_ink(made, least), 35)


@query("q_ink_yield", f"WITH {PX}, bk AS (SELECT frame_id, y // 20 AS row, x // 8 AS col, count(*) FILTER (level = 0) AS black, substr('A0.,:', CAST((y // 20 + x // 8) % 5 + 1 AS BIGINT), 1) AS ch FROM px GROUP BY ALL) SELECT frame_id, ch, count(*) AS n, CAST(sum(black) AS BIGINT) AS black FROM bk WHERE black >= {LEAST} GROUP BY ALL")
def q_ink_yield(spark, sf):
    places = _px(spark, sf).withColumns({"row": F.expr("y div 20"), "col": F.expr("x div 8")})
    made = generate.ink_counts(places, ["frame_id", "row", "col"], "level").withColumn("ch", F.substring(F.lit("A0.,:"), (C("row") + C("col")).cast("int") % 5 + 1, F.lit(1)))
    least = spark.createDataFrame(list(generate.LEAST_BLACK.items()), "ch string, least int")
    return generate.enough_ink(made, least).groupBy("frame_id", "ch").agg(F.count("*").alias("n"), F.sum("black").alias("black"))


@query("q_gen_fits", f"WITH {BOX} SELECT region_id, minx % 30 AS minx, miny % 30 AS miny, minx % 30 + maxx - minx AS maxx, miny % 30 + maxy - miny AS maxy FROM rg WHERE minx % 30 >= 8 AND miny % 30 >= 8 AND minx % 30 + maxx - minx < 40 AND miny % 30 + maxy - miny < 40")
def q_gen_fits(spark, sf):
    b = event_boxes(spark, sf)
    return generate.fits_canvas(b.select("region_id", (C("minx") % 30).alias("minx"), (C("miny") % 30).alias("miny"), (C("minx") % 30 + C("maxx") - C("minx")).alias("maxx"), (C("miny") % 30 + C("maxy") - C("miny")).alias("maxy")))


def _draw(k: int, n: int) -> str:
    return f"((p_partkey * {7919 + 104729 * k} + {611953 * k}) % 1000003 % {n})"


@query("q_gen_draws", f"SELECT p_partkey, round(0.3 + {_draw(1, 1601)} / 1000.0, 3) AS scale, CAST({_draw(2, 11)} - 5 AS INT) AS jitter_x, CAST({_draw(3, 11)} - 5 AS INT) AS jitter_y, CASE WHEN {_draw(4, 1000)} < 100 THEN 'val' ELSE 'train' END AS split FROM part")
def q_gen_draws(spark, sf):
    return generate.draws(read(spark, sf, "part").select("p_partkey"), "p_partkey")


@query("q_folded_classes", "WITH d AS (SELECT doc_id, substr(text, 1, 1) AS ch FROM documents WHERE length(text) > 0), c(ch, class) AS (SELECT chr(CAST(i AS INT)), chr(CAST(i AS INT)) FROM (SELECT unnest(range(65, 91)) AS i UNION ALL SELECT unnest(range(97, 123)) UNION ALL SELECT unnest(range(48, 58)))) SELECT class, count(*) AS n FROM d JOIN c USING (ch) GROUP BY ALL")
def q_folded_classes(spark, sf):
    firsts = read(spark, sf, "documents").where("length(text) > 0").select("doc_id", F.substring("text", 1, 1).alias("ch"))
    plain = generate.characters(spark).where(C("class").rlike("^[A-Za-z0-9]$"))
    return generate.fold_groups(firsts, plain).groupBy("class").agg(F.count("*").alias("n"))


@query("q_out_name", r"SELECT page_id, CASE WHEN contains(url, '.') THEN regexp_replace(url, '^(.*)[.]([^.]*)$', '\1_.\2') ELSE url || '_' END AS marked, regexp_replace(url || '.png', '(?s)\.png.*$', '.bmp') AS dumped, regexp_replace(split_part(url, '/', -1), '\.[^.]*$', '') AS base FROM pages")
def q_out_name(spark, sf):
    u = C("url")
    return read(spark, sf, "pages").select("page_id", naming.marked_name(u).alias("marked"), naming.dump_name(F.concat(u, F.lit(".png"))).alias("dumped"), naming.base_name(u).alias("base"))


@query("q_sample_names", "SELECT p_partkey, printf('frame_%04d.png', p_partkey) AS frame, printf('%dx%d', p_size, p_size + 1) AS folder, printf('%d_%03d_%s_%04d.bmp', unicode(p_name), p_size, p_brand, p_partkey) AS sample FROM part")
def q_sample_names(spark, sf):
    return read(spark, sf, "part").select("p_partkey", naming.frame_name(C("p_partkey")).alias("frame"), naming.glyph_folder(C("p_size"), C("p_size") + 1).alias("folder"), naming.sample_name(F.ascii("p_name"), C("p_size"), C("p_brand"), C("p_partkey")).alias("sample"))


@query("q_sample_numbers", "SELECT p_partkey, p_brand, CAST(row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) - 1 AS INT) AS n FROM part")
def q_sample_numbers(spark, sf):
    return glyphs.numbered_samples(read(spark, sf, "part"), "p_brand", "p_partkey").select("p_partkey", "p_brand", "n")


# --- streams, trees, pictures --------------------------------------------------------------------------------------

SHED = """tk AS (SELECT user_id AS run, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS tick, CAST(abs(value) * 40 AS DOUBLE) AS ms FROM events),
sl AS (SELECT *, CAST(tick % 3 AS INT) AS slot, CAST(tick * 250 AS DOUBLE) AS t0, row_number() OVER (PARTITION BY run, tick % 3 ORDER BY tick) AS k FROM tk),
st(run, slot, k, tick, ms, kept, busy) AS (SELECT run, slot, k, tick, ms, true, t0 + ms FROM sl WHERE k = 1 UNION ALL SELECT sl.run, sl.slot, sl.k, sl.tick, sl.ms, sl.t0 >= st.busy, CASE WHEN sl.t0 >= st.busy THEN sl.t0 + sl.ms ELSE st.busy END FROM st JOIN sl ON sl.run = st.run AND sl.slot = st.slot AND sl.k = st.k + 1)"""


def _ticks(spark, sf):
    events = slots.numbered(read(spark, sf, "events").select("user_id", "event_id", "value"), ["user_id"], ["event_id"], "tick")
    return events.select(C("user_id").alias("run"), C("tick").cast("long"), (F.abs("value") * 40).cast("double").alias("service_ms"))


@query("q_load_shed", f"WITH RECURSIVE {SHED} SELECT run, slot, tick, kept FROM st")
def q_load_shed(spark, sf):
    return slots.shed(_ticks(spark, sf), 3, 250, "run").select("run", "slot", "tick", "kept")


@query("q_slot_yield", f"WITH RECURSIVE {SHED} SELECT run, slot, count(*) AS ticks, count(*) FILTER (kept) AS kept FROM st GROUP BY ALL")
def q_slot_yield(spark, sf):
    return slots.shed(_ticks(spark, sf), 3, 250, "run").groupBy("run", "slot").agg(F.count("*").alias("ticks"), F.count_if("kept").alias("kept"))


@query("q_slot_states", f"WITH RECURSIVE {SHED}, z(step, from_state, to_state) AS (VALUES (0, 'FREE', 'RAW_READY'), (1, 'RAW_READY', 'IN_PROGRESS'), (2, 'IN_PROGRESS', 'QUANT_DONE'), (3, 'QUANT_DONE', 'SERIALIZING'), (4, 'SERIALIZING', 'FREE')) SELECT run, slot, tick, step, from_state, to_state FROM st CROSS JOIN z WHERE kept")
def q_slot_states(spark, sf):
    return slots.transitions(slots.shed(_ticks(spark, sf), 3, 250, "run")).select("run", "slot", "tick", "step", "from_state", "to_state")


@query("q_latency", "SELECT l_orderkey, l_linenumber, CAST(l_quantity * 1000000 AS BIGINT) AS elapsed_ns FROM lineitem")
def q_latency(spark, sf):
    f = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.lit(5).cast("long").alias("start_ns"), (C("l_quantity") * 1000000 + 5).cast("long").alias("end_ns"))
    return slots.latency(f).select("l_orderkey", "l_linenumber", "elapsed_ns")


TREE = "WITH RECURSIVE sz AS (SELECT DISTINCT p_size * 4 + 40 AS w, p_size * 2 + 20 AS h FROM part), t(w, h, x0, y0, x1, y1) AS (SELECT w, h, 0, 0, w, h FROM sz UNION ALL SELECT w, h, CASE WHEN x1 - x0 >= y1 - y0 AND s = 1 THEN x0 + (x1 - x0) // 2 ELSE x0 END, CASE WHEN x1 - x0 < y1 - y0 AND s = 1 THEN y0 + (y1 - y0) // 2 ELSE y0 END, CASE WHEN x1 - x0 >= y1 - y0 AND s = 0 THEN x0 + (x1 - x0) // 2 ELSE x1 END, CASE WHEN x1 - x0 < y1 - y0 AND s = 0 THEN y0 + (y1 - y0) // 2 ELSE y1 END FROM t CROSS JOIN (VALUES (0), (1)) v(s) WHERE x1 - x0 > 16 OR y1 - y0 > 16)"


@query("q_bsp_leaves", f"{TREE} SELECT w, h, x0, y0, x1, y1 FROM t WHERE x1 - x0 <= 16 AND y1 - y0 <= 16")
def q_bsp_leaves(spark, sf):
    sizes = read(spark, sf, "part").select((C("p_size") * 4 + 40).alias("w"), (C("p_size") * 2 + 20).alias("h")).distinct()
    return topology.topology(sizes).where("left is null").select("w", "h", "x0", "y0", "x1", "y1")


@query("q_leaf_offsets", "SELECT p_brand AS image, p_partkey AS idx, p_size % 2 = 0 AS mixed, p_size AS pixels, CAST(coalesce(sum(CASE WHEN p_size % 2 = 0 THEN p_size * 2 ELSE 0 END) OVER (PARTITION BY p_brand ORDER BY p_partkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS \"offset\" FROM part")
def q_leaf_offsets(spark, sf):
    leaves = read(spark, sf, "part").select(C("p_brand").alias("image"), C("p_partkey").alias("idx"), (C("p_size") % 2 == 0).alias("mixed"), C("p_size").alias("pixels"))
    return topology.payload_offsets(leaves)


SPOTS = "CASE WHEN v > 0.3 THEN ((r >> 3) << 10) | (b >> 3) ELSE 4660 END"
FIVE = "CAST(sum((({0} & 31) << 3) | (({0} & 31) >> 2)) AS BIGINT)"
TREE_PX = f"""WITH RECURSIVE {PX}, pq AS (SELECT frame_id AS image, x, y, {SPOTS} AS q, max(x) OVER (PARTITION BY frame_id) + 1 AS w, max(y) OVER (PARTITION BY frame_id) + 1 AS h FROM px),
sz AS (SELECT DISTINCT w, h FROM pq), {TREE[TREE.index("t(w, h"):]},
lf AS (SELECT pq.image, pq.x, pq.y, pq.q, x0, y0, x1, min(pq.q) OVER k = max(pq.q) OVER k AS one FROM pq JOIN t ON pq.w = t.w AND pq.h = t.h AND x >= x0 AND x < x1 AND y >= y0 AND y < y1 WHERE x1 - x0 <= 16 AND y1 - y0 <= 16 WINDOW k AS (PARTITION BY pq.image, x0, y0)),
dr AS (SELECT image, one, CASE WHEN one AND x - x0 = x1 - x0 - 1 - (y - y0) THEN 0 WHEN one AND x - x0 = y - y0 THEN 32767 ELSE q END AS q FROM lf)"""


def _spots(spark, sf):
    """Frames of one colour but for strong values, as the pixels of trees."""
    v, frame = C("v"), Window.partitionBy("frame_id")
    q = F.when(v > 0.3, F.shiftleft(F.shiftright("r", 3), 10).bitwiseOR(F.shiftright("b", 3))).otherwise(4660)
    px = _px(spark, sf).select("frame_id", "x", "y", q.cast("int").alias("q"))
    sizes = px.groupBy("frame_id").agg((F.max("x") + 1).alias("w"), (F.max("y") + 1).alias("h"))
    return px.join(sizes, "frame_id").withColumnRenamed("frame_id", "image")


@query("q_tree_pixels", f"{TREE_PX} SELECT image, count(*) AS n, count(*) FILTER (one) AS plain, {FIVE.format('(q >> 10)')} AS r, {FIVE.format('(q >> 5)')} AS g, {FIVE.format('q')} AS b FROM dr GROUP BY ALL")
def q_tree_pixels(spark, sf):
    """Packed trees of all frames, written and read again, then decoded by joins."""
    files = written(trees.pack_trees(_spots(spark, sf)), "trees")
    leaves = trees.tree_leaves(files).groupBy("image").agg(F.sum(F.when(C("mixed"), 0).otherwise(C("pixels"))).cast("long").alias("plain"))
    part = {c: F.shiftright("q", k).bitwiseAND(F.lit(31)) for c, k in (("r", 10), ("g", 5), ("b", 0))}
    sums = [F.sum(F.shiftleft(p, 3).bitwiseOR(F.shiftright(p, 2))).alias(c) for c, p in part.items()]
    return trees.tree_pixels(files).groupBy("image").agg(F.count("*").alias("n"), *sums).join(leaves, "image")


@query("q_reconstruct", f"WITH {PX}, {BL}, t AS (SELECT frame_id, x, y, q FROM bl) SELECT frame_id, CAST(sum(((q >> 5) << 5) | ((q >> 5) << 2) | ((q >> 5) >> 1)) AS BIGINT) AS r, CAST(sum((q & 3) * 85) AS BIGINT) AS b FROM t GROUP BY ALL")
def q_reconstruct(spark, sf):
    return render.from_rgb332(_q(spark, sf)).groupBy("frame_id").agg(F.sum("r").alias("r"), F.sum("b").alias("b"))


FILL = "CASE WHEN one AND dy = least(bw - 1 - dx, (bw - 1 - dx) * bh // bw) THEN 255 WHEN one AND (dy = least(dx, dx * bh // bw) OR dx = bw - 1 OR dy = bh - 1) THEN 0 WHEN one AND (dx = 0 OR dy = 0) THEN 255 ELSE c END"


@query("q_filled_blocks", f"WITH {PX}, pq AS (SELECT frame_id, y, x, level AS q FROM px), bl AS (SELECT *, y // 4 AS brow, x // 4 AS bcol, y % 4 AS dy, x % 4 AS dx FROM pq), {HI}, {BC}, t AS (SELECT bl.frame_id, bl.x, bl.y, bl.dx, bl.dy, least(4, 64 - bl.bcol * 4) AS bw, least(4, 100 - bl.brow * 4) AS bh, bg = fg AS one, (CASE WHEN q <> bg THEN fg ELSE bg END & 3) * 85 AS c FROM bl JOIN bc USING (frame_id, brow, bcol)) SELECT frame_id, x, y, CAST({FILL} AS INT) AS b FROM t")
def q_filled_blocks(spark, sf):
    px = _px(spark, sf)
    colours = blocks.block_colours(blocks.histogram(px, "level", 4))
    return render.from_blocks(px.select("frame_id", "x", "y"), colours, blocks.mask_rows(px, "level", 4), 64, 100, 4).select("frame_id", "x", "y", "b")


@query("q_borders", f"WITH {BOX}, e AS (SELECT frame_id, unnest(range(minx, maxx + 1)) AS x, miny AS y FROM rg UNION SELECT frame_id, unnest(range(minx, maxx + 1)), maxy FROM rg UNION SELECT frame_id, minx, unnest(range(miny, maxy + 1)) FROM rg UNION SELECT frame_id, maxx, unnest(range(miny, maxy + 1)) FROM rg) SELECT frame_id, count(*) AS pixels, CAST(sum(x) AS BIGINT) AS sx, CAST(sum(y) AS BIGINT) AS sy FROM e WHERE x < 400 AND y < 300 GROUP BY ALL")
def q_borders(spark, sf):
    return render.border(event_boxes(spark, sf), F.lit(400), F.lit(300)).groupBy("frame_id").agg(F.count("*").alias("pixels"), F.sum("x").alias("sx"), F.sum("y").alias("sy"))


def _edge_sql(d: int, layer: int) -> str:
    a, b, c, e = f"minx - {d}", f"miny - {d}", f"maxx + {d}", f"maxy + {d}"
    parts = [f"SELECT frame_id, unnest(range({a}, {c} + 1)) AS x, {y} AS y, {layer} AS layer FROM rg" for y in (b, e)]
    parts += [f"SELECT frame_id, {x} AS x, unnest(range({b}, {e} + 1)) AS y, {layer} AS layer FROM rg" for x in (a, c)]
    return " UNION ALL ".join(parts)


@query("q_double_borders", f"WITH {BOX}, e AS ({_edge_sql(0, 1)} UNION ALL {_edge_sql(1, 0)}), t AS (SELECT frame_id, x, y, max(layer) AS layer FROM e WHERE x >= 0 AND y >= 0 AND x < 400 AND y < 300 GROUP BY ALL) SELECT frame_id, count(*) AS n, count(*) FILTER (layer = 0) AS yellow FROM t GROUP BY ALL")
def q_double_borders(spark, sf):
    drawn = render.double_border(event_boxes(spark, sf), F.lit(400), F.lit(300))
    return drawn.groupBy("frame_id").agg(F.count("*").alias("n"), F.count_if(C("g") == 255).alias("yellow"))


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Frames to blocks to mask to runs to regions."""
    return q_regions4(spark, sf_dir)

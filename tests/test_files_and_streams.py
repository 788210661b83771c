import os
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators.topology import nodes
from tessera.sources import glyph_store, images
from tessera.streaming import slots


def test_png_round_trip():
    px = np.random.default_rng(0).integers(0, 256, (7, 5, 4), dtype=np.uint8)
    assert (images.decode_png(images.encode_png(px)) == px).all()
    assert (images.decode_png(images.encode_png(px[:, :, :3]))[:, :, :3] == px[:, :, :3]).all()
    with pytest.raises(images.BadImage):
        images.decode_png(b"nothing")


@pytest.mark.parametrize("kind", range(5))
def test_png_filters(kind):
    rng = np.random.default_rng(kind)
    row, above = rng.integers(0, 256, 12, dtype=np.uint8), rng.integers(0, 256, 12, dtype=np.uint8)
    want = images.unfilter(np.array([0, kind], np.uint8), np.stack([above, row]), 3)[1].astype(int)
    back = []
    for i, v in enumerate(want):
        left, up, corner = (want[i - 3] if i >= 3 else 0), int(above[i]), (int(above[i - 3]) if i >= 3 else 0)
        p = left + up - corner
        paeth = left if abs(p - left) <= abs(p - up) and abs(p - left) <= abs(p - corner) else up if abs(p - up) <= abs(p - corner) else corner
        back.append((v - (0, left, up, (left + up) // 2, paeth)[kind]) % 256)
    assert back == row.tolist()


def test_bmp_round_trip():
    px = np.random.default_rng(1).integers(0, 256, (3, 5, 3), dtype=np.uint8)
    data = images.encode_bmp(px)
    assert len(data) == 54 + 3 * 16 and (images.decode_bmp(data) == px).all()
    assert (images.decode_bmp(images.glyph_bmp("101010", 3, 2))[:, :, 0] == [[0, 255, 0], [255, 0, 255]]).all()


def test_tree():
    t = nodes(40, 20)
    leaves = [n for n in t if n[5] is None]
    colours = [images.MIXED if n is leaves[0] else 0x1F for n in t]
    x0, y0, x1, y1 = leaves[0][1:5]
    data = images.encode_tree(40, 20, colours, [np.full((y1 - y0, x1 - x0), 0x7C00)])
    px = images.decode_tree(data, overlay=False)
    assert px[y0, x0].tolist() == [255, 0, 0] and px[-1, -1].tolist() == [0, 0, 255]
    assert images.decode_tree(data)[leaves[1][2], leaves[1][1]].tolist() == [255, 255, 255]
    with pytest.raises(images.BadImage):
        images.decode_tree(b"\0" * 12)


def test_read_images(spark, tmp_path):
    px = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    (tmp_path / "a.png").write_bytes(images.encode_png(px))
    (tmp_path / "b.bmp").write_bytes(images.encode_bmp(px))
    (tmp_path / "c.png").write_bytes(b"broken")
    found = images.read_images(spark, str(tmp_path))
    assert found.where("error is not null").count() == 1
    got = images.image_pixels(found)
    assert got.count() == 16
    assert sorted(map(tuple, got.where("path like '%a.png'").select("y", "x", "r").collect())) == [(y, x, int(px[y, x, 0])) for y in range(2) for x in range(4)]


def test_inverted_png():
    px = np.random.default_rng(4).integers(0, 256, (3, 5, 4), dtype=np.uint8)
    for own, kind in ((px, 6), (px[:, :, :3], 2)):
        data = images.invert_png(images.encode_png(own))
        back = images.decode_png(data, strict=True)
        assert data[25] == kind and (back[:, :, :3] == 255 - px[:, :, :3]).all() and (kind == 2 or (back[:, :, 3] == px[:, :, 3]).all())
    with pytest.raises(images.BadImage):
        images.invert_png(b"nothing")


def test_write_samples(spark, tmp_path):
    rows = spark.createDataFrame([("train", "a", 1), ("val", "a", 2), ("train", "b", 3)], "split string, class string, n int")
    images.write_samples(rows, str(tmp_path / "s"))
    assert sorted(os.listdir(tmp_path / "s" / "split=train")) == ["class=a", "class=b"]
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "s")).select("split", "class", "n").collect())) == sorted(map(tuple, rows.collect()))


def test_report_of_class_files(spark, tmp_path):
    from tessera.operators import evaluate

    for name in ("train/a/1.bmp", "train/b/1.bmp", "val/a/1.bmp", "val/a/2.bmp"):
        f = tmp_path / name
        os.makedirs(f.parent, exist_ok=True)
        f.write_bytes(b"x")
    files = images.class_files(spark, str(tmp_path))
    report = evaluate.balance_report(files.where("split = 'train'"), files.where("split = 'val'"))
    assert [(r["class"], r.n, r.deviation) for r in report.collect()] == [("a", 3, 50.0), ("b", 1, -50.0)]


def test_class_files(spark, tmp_path):
    for split, name in (("train", "a/1.bmp"), ("train", "a/2.BMP"), ("val", "b/1.bmp"), ("val", "b/x.txt")):
        f = tmp_path / split / name
        os.makedirs(f.parent, exist_ok=True)
        f.write_bytes(b"x")
    assert sorted((r["split"], r["class"], r["count"]) for r in images.class_files(spark, str(tmp_path)).groupBy("split", "class").count().collect()) == [("train", "a", 2), ("val", "b", 1)]


def test_glyph_store(spark, tmp_path):
    rows = spark.createDataFrame([(3, 2, "g", "101010"), (3, 2, "g", "101010"), (1, 1, "W", "1"), (None, 1, None, "0")], "w int, h int, name string, bits string")
    path = str(tmp_path / "a store")
    assert glyph_store.read_glyphs(spark, path).count() == 0
    assert glyph_store.store_glyphs(rows.limit(0), path) == 0
    assert glyph_store.store_glyphs(rows.withColumn("more", F.lit(1)), path) == 3
    assert glyph_store.store_glyphs(rows, path) == 0
    assert glyph_store.store_glyphs(spark.createDataFrame([(1, 1, "W", "1"), (1, 2, "W", "11")], rows.schema), path) == 1
    assert sorted(map(str, glyph_store.read_glyphs(spark, path).collect())) == sorted(map(str, [*rows.distinct().collect(), type(rows.first())(w=1, h=2, name="W", bits="11")]))


def test_writers_at_once(spark, tmp_path):
    """Six writers with overlapping glyphs at the same time: each glyph once, the counts of all calls add up, no part is left."""
    from concurrent.futures import ThreadPoolExecutor

    path = str(tmp_path / "store")
    own = [spark.range(10 * k, 10 * k + 30).selectExpr("cast(id as int) as w", "1 as h", "cast(id as string) as name", "'1' as bits") for k in range(6)]
    with ThreadPoolExecutor(6) as pool:
        added = list(pool.map(lambda df: glyph_store.store_glyphs(df, path), own))
    got = sorted(r.w for r in glyph_store.read_glyphs(spark, path).collect())
    assert got == list(range(80)) and sum(added) == 80
    versions = [x for x in os.listdir(tmp_path / "store" / "versions") if x.isdigit()]
    assert len(os.listdir(tmp_path / "store" / "parts")) == len(versions)


def test_a_failed_writer_leaves_nothing(spark, tmp_path):
    """A part without a version isn't read, and a store with a version missing is an error, not an empty store."""
    rows = spark.createDataFrame([(1, 1, "a", "1")], "w int, h int, name string, bits string")
    path = tmp_path / "store"
    rows.write.parquet(str(path / "parts" / "dead"))
    assert glyph_store.read_glyphs(spark, str(path)).count() == 0
    assert glyph_store.store_glyphs(rows, str(path)) == 1
    (path / "versions" / "0000000000").rename(path / "versions" / "0000000001")
    with pytest.raises(ValueError):
        glyph_store.store_glyphs(rows, str(path))


TICKS = [(0, 600.0), (1, 100.0), (2, 100.0), (3, 100.0), (4, 100.0)]


def test_shed(spark):
    got = {r.tick: r.kept for r in slots.shed(spark.createDataFrame(TICKS, slots.TICKS), 2).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: True}


def test_shed_needs_no_whole_slot(spark):
    """A hot run, ranges that cut its slots, nulls, ties and services of no time against a fold; no group is collected."""
    rng = np.random.default_rng(3)
    rows = [(None if k % 7 == 0 else "hot", int(t), float(s)) for k, (t, s) in enumerate(zip(np.sort(rng.integers(0, 2500, 3000)), rng.choice([0.0, 250.0, 600.5, 1500.0], 3000), strict=True))]
    df = spark.createDataFrame(rows, "run string, tick long, service_ms double").repartition(5)
    coalesce = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(coalesce, "false")
    try:
        out = slots.shed(df, 3, 250, "run")
        got = sorted(str((r.run, r.slot, r.tick, r.service_ms, r.kept)) for r in out.collect())
        ranges = slots.spread(df, ["run"], ["tick"]).where("run = 'hot'").select("__p").distinct().count()
        places = sorted((r.run or "", r.tick, r.n) for r in slots.numbered(df.select("run", "tick").distinct(), ["run"], ["tick"], "n").collect())
    finally:
        spark.conf.unset(coalesce)
    assert ranges > 1
    assert "collect_list" not in out._jdf.queryExecution().toString()
    want, busy = [], {}
    for run, tick, ms in sorted(rows, key=lambda r: (str(r[0]), r[1], r[2])):
        kept = tick * 250.0 >= busy.get((run, tick % 3), -1.0)
        if kept:
            busy[run, tick % 3] = tick * 250.0 + ms
        want.append((run, tick % 3, tick, ms, kept))
    assert got == sorted(map(str, want))
    for run in ("", "hot"):
        assert [n for r, _, n in places if r == run] == list(range(sum(r == run for r, _, _ in places)))


def test_shed_stream(spark, tmp_path):
    src = str(tmp_path / "in")
    spark.createDataFrame(TICKS, slots.TICKS).coalesce(1).write.parquet(src)
    stream = slots.shed_stream(spark.readStream.schema(slots.TICKS).parquet(src), 2)
    slots.run_available(stream, "shed_out", str(tmp_path / "ck"))
    assert {r.tick: r.kept for r in spark.table("shed_out").collect()} == {0: True, 1: True, 2: False, 3: True, 4: True}


def test_shed_keyed(spark, tmp_path):
    """Several micro-batches, the first ticks seeded by a batch's state, against shed over all of them; and state that goes."""
    rng = np.random.default_rng(2)
    rows = [("ab"[k % 2], k // 2, float(ms)) for k, ms in enumerate(rng.choice([0.0, 100.0, 900.0, 2600.0], 120))]
    schema = "run string, tick long, service_ms double"
    whole = {(r.run, r.tick): r.kept for r in slots.shed(spark.createDataFrame(rows, schema), 3, 250, "run").collect()}
    before = slots.shed(spark.createDataFrame(rows[:40], schema), 3, 250, "run")
    provider = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        src = str(tmp_path / "in")
        for n, (s, e) in enumerate(((40, 60), (60, 61), (61, 120))):
            spark.createDataFrame(rows[s:e], schema).coalesce(1).write.mode("append").parquet(src)
            stream = spark.readStream.schema(schema).parquet(src)
            kept = slots.shed_keyed(stream, 3, 250, "run", slots.free_again(before, 250, "run"), idle_ms=3_600_000)
            kept.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "ck")).trigger(once=True).start().awaitTermination()
        got = spark.read.parquet(str(tmp_path / "out"))
        assert {(r.run, r.tick): r.kept for r in got.collect()} == {k: v for k, v in whole.items() if k[1] >= 20}
        # a slot that was seeded as busy for ever is free after a millisecond without ticks
        src, seed = str(tmp_path / "idle"), spark.createDataFrame([(0, float("inf"))], "slot int, free double")
        for tick in (0, None, 1):  # a batch without ticks lets the timer expire
            if tick is not None:
                spark.createDataFrame([(tick, 1.0)], slots.TICKS).write.mode("append").parquet(src)
            kept = slots.shed_keyed(spark.readStream.schema(slots.TICKS).parquet(src), 1, initial=seed, idle_ms=1)
            kept.writeStream.format("parquet").option("path", str(tmp_path / "out2")).option("checkpointLocation", str(tmp_path / "ck2")).trigger(once=True).start().awaitTermination()
            time.sleep(0.1)
        assert {r.tick: r.kept for r in spark.read.parquet(str(tmp_path / "out2")).collect()} == {0: False, 1: True}
    finally:
        spark.conf.unset(provider)


def test_name_stream(spark, tmp_path):
    folder = str(tmp_path / "names")
    slots.announce(spark.createDataFrame([("a.png",), ("",), (" b.png ",)], "name string"), folder)
    slots.run_available(slots.name_stream(spark, folder), "names_out", str(tmp_path / "ck"))
    assert sorted(r.name for r in spark.table("names_out").collect()) == ["a.png", "b.png"]


def test_late_subscriber(spark, tmp_path):
    import datetime
    import time

    folder = str(tmp_path / "names")
    slots.announce(spark.createDataFrame([("early.png",)], "name string"), folder)
    time.sleep(1.5)
    since = datetime.datetime.now(datetime.timezone.utc)
    time.sleep(0.2)
    slots.announce(spark.createDataFrame([("late.png",)], "name string"), folder)
    slots.run_available(slots.name_stream(spark, folder, since), "late_out", str(tmp_path / "ck"))
    assert [r.name for r in spark.table("late_out").collect()] == ["late.png"]


def test_cadence(spark, tmp_path):
    import datetime
    import time

    seen, said = [], []
    start = datetime.datetime.now(datetime.timezone.utc)
    listener = slots.Progress(lambda *a: said.append(a))
    spark.streams.addListener(listener)
    query = slots.run_cadence(slots.tick_stream(spark, start), lambda df, _: seen.extend(r.tick for r in df.collect()), str(tmp_path / "ck"))
    try:
        end = time.time() + 60
        while len(seen) < 12 and time.time() < end:
            time.sleep(0.2)
    finally:
        query.stop()
        spark.streams.removeListener(listener)
    assert len(seen) >= 12 and sorted(seen) == list(range(min(seen), min(seen) + len(seen))) and said


def test_bounded_ticks(spark):
    assert slots.ticks_until(spark).count() == 41


def test_data_source(spark, tmp_path):
    from tessera.sources import datasource

    datasource.register(spark)
    px = np.arange(24, dtype=np.uint8).reshape(2, 4, 3)
    rows = spark.createDataFrame([("a.png", 4, 2, bytearray(px.tobytes())), ("b.bmp", 4, 2, bytearray(px.tobytes()))], "path string, w int, h int, raw binary")
    out = str(tmp_path / "out")
    rows.write.format("raster").option("path", out).mode("append").save()
    got = spark.read.format("raster").option("path", out).load()
    assert sorted((os.path.basename(r.path), r.w, r.h, bytes(r.raw)) for r in got.collect()) == [("a.png", 4, 2, px.tobytes()), ("b.bmp", 4, 2, px.tobytes())]


def test_serve_lowest(spark):
    ready = spark.createDataFrame([(3, "RAW_READY"), (1, "RAW_READY"), (0, "FREE")], "slot int, state string")
    assert slots.serve_next(ready, "RAW_READY").first()[0] == 1


def test_resume(spark, tmp_path):
    from tessera.operators import evaluate

    path = str(tmp_path / "epochs")
    for e in (1, 2):
        evaluate.save_epoch(spark.createDataFrame([(e, 0.5)], "epoch int, loss double"), path)
    assert evaluate.next_epoch(spark.read.parquet(path)) == 3
    assert evaluate.next_epoch(spark.read.parquet(path).limit(0)) == 1
    evaluate.save_matrix(spark.createDataFrame([(0, 0, 3), (0, 1, 0)], "true_label int, pred_label int, n long"), str(tmp_path / "m"))
    assert spark.read.parquet(str(tmp_path / "m")).count() == 1

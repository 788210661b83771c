"""Generated samples and the classifier's training."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.operators import drawing, evaluate, training
from tessera.session import written

GLYPHS = [("ring", 4, 4, "1111100110011111"), ("cross", 3, 3, "010111010"), ("bar", 1, 4, "1111")]


@pytest.fixture(scope="module")
def samples(spark):
    rows = spark.createDataFrame(GLYPHS, "label string, w int, h int, bits string")
    made = drawing.draw(drawing.attempts(rows, 120, 0.25, cell=5))
    return made.withColumn("key", F.concat_ws("/", "label", "attempt")).select("label", "image", "split", "key", "black", "sw", "sh").persist()


def test_resampled_share_of_ink():
    ink = np.array([[1, 0], [0, 1]], bool)
    for w, h in ((1, 1), (2, 2), (3, 5), (7, 4), (32, 1)):
        got = drawing.resample(ink, w, h)
        fine = np.kron(ink, np.ones((h * w, h * w)))  # every target cell is a whole number of these
        share = fine.reshape(h, 2 * w, w, 2 * h).mean(axis=(1, 3))
        assert (got == (255 * (1 - share) <= 128 + 1e-9)).all()


def test_samples_fit_and_hold_ink(spark, samples):
    rows = samples.collect()
    assert {r.split for r in rows} == {"train", "val"} and len(rows) > 100
    for r in rows:
        px = np.unpackbits(np.frombuffer(r.image, np.uint8)).reshape(32, 32)
        assert px.sum() == r.black > 0
        ys, xs = np.nonzero(px)
        assert np.ptp(xs) < r.sw and np.ptp(ys) < r.sh
    odd = spark.createDataFrame([(None, 2, "11", "a"), (2, 1, None, "a"), (2, 2, "11", "a"), (0, 0, "", "a"), (100, 100, "1" * 10_000, "a"), (1, 1, "0", "a")], "w int, h int, bits string, ch string")
    least = spark.createDataFrame([("b", 3)], "ch string, least int")
    # none is drawn: sizes are missing or wrong, too large even at the least scale, or without ink
    assert drawing.generate_samples(odd.where("w is null or h <> 100"), least, 5).count() == 0
    assert drawing.attempts(odd.where("w = 100"), 400).where("sw > 32").count() == 0
    assert drawing.generate_samples(odd.where("w < 0"), least, 5).count() == 0


def test_gradients_are_finite_differences():
    net = training.new_network(["a", "b", "c"], kind=np.float64, side=8, kernels=((3, 5), (4, 3)), hidden=7)
    rng = np.random.default_rng(3)
    x, y = rng.standard_normal((4, 1, 8, 8)), np.array([0, 2, 1, 1])
    _, _, grads = training.gradients(net.weights, x, y)
    for name, w in net.weights.items():
        for at in map(tuple, rng.integers(0, w.shape, (25, w.ndim))):
            old, step, ends = w[at], 1e-6, []
            for move in (step, -step):
                w[at] = old + move
                ends.append(training.losses(training.forward(net.weights, x)[0], y)[0].sum())
            w[at] = old
            assert abs((ends[0] - ends[1]) / (2 * step) - grads[name][at]) < 1e-5


def test_sums_of_tasks_are_the_whole_sum(spark, samples):
    net = training.new_network(["bar", "cross", "ring"])
    rows = samples.select("label", "image").unionByName(spark.createDataFrame([("ring", b"x"), (None, None), ("unknown", bytes(128))], "label string, image binary"))
    one = training.gradient_sum(rows.coalesce(1), net)
    many = training.gradient_sum(rows.repartition(20), net)
    assert one[1:3] == many[1:3] and one[2] == samples.count() and abs(one[0] - many[0]) < 1e-3 * one[0]
    for k in net.weights:
        assert np.allclose(one[3][k], many[3][k], atol=1e-3)
    assert training.gradient_sum(rows.where("label = 'none'"), net)[2] == 0


def test_equal_pictures_go_through_the_network_once(spark, samples, monkeypatch):
    """A row of n equal samples counts as n rows; training writes and computes each different picture of a step once."""
    net = training.new_network(["bar", "cross", "ring"])
    rows = samples.select("label", "image")
    each = training.gradient_sum(rows.unionByName(rows).unionByName(rows), net)
    some = training.gradient_sum(rows.groupBy("label", "image").agg((3 * F.count("*")).alias("n")), net)
    assert each[1:3] == some[1:3] and each[2] == 3 * samples.count() and abs(each[0] - some[0]) < 1e-3 * each[0]
    assert all(np.allclose(each[3][k], some[3][k], atol=5e-3) for k in net.weights)
    tables = {}
    monkeypatch.setattr(training, "written", lambda df, name: tables.setdefault(name, written(df, name)))
    many = samples.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(40)))).withColumn("key", F.concat_ws("/", "key", "copy"))
    _, told = training.train(many, epochs=1, steps=1)
    assert tables["samples"].count() == samples.select("label", "image", "split").distinct().count()
    scored = training.predictions(samples.where("split = 'val'"), training.train(many, epochs=1, steps=1)[0])
    assert told.first().val_loss == pytest.approx(scored.agg(F.avg("loss")).first()[0], rel=1e-3)


def test_gradients_of_few_partitions_are_spread(spark, samples):
    """However few partitions there are, each has a task for its gradients, beside the one that adds them up."""
    net = training.new_network(["bar", "cross", "ring"])
    rows, tracker = written(samples.select("label", "image").repartition(4), "few"), spark.sparkContext.statusTracker()
    parts = rows.rdd.getNumPartitions()
    assert 1 < parts <= training.FAN
    spark.sparkContext.setJobGroup("gradients", "one sum")
    try:
        training.gradient_sum(rows, net)
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("gradients") for s in tracker.getJobInfo(j).stageIds]
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(s.numTasks for s in stages if s) >= parts


def test_attempts_of_one_place_are_drawn_once(spark, samples, monkeypatch):
    first = drawing.draw(drawing.attempts(spark.createDataFrame(GLYPHS, "label string, w int, h int, bits string"), 120, 0.25, cell=5))
    monkeypatch.setattr(drawing, "DRAWN", 3)
    again = drawing.draw(drawing.attempts(spark.createDataFrame(GLYPHS, "label string, w int, h int, bits string"), 120, 0.25, cell=5))
    assert sorted(map(tuple, first.select("label", "attempt", "image").collect())) == sorted(map(tuple, again.select("label", "attempt", "image").collect()))


def test_training_learns_and_goes_on(spark, samples, tmp_path):
    path = str(tmp_path / "run")
    net, told = training.train(samples, epochs=3, steps=4, rate=3e-3, path=path)
    first = told.collect()
    again, rest = training.train(samples, epochs=6, steps=4, rate=3e-3, path=path)
    rows = first + rest.collect()
    assert [r.epoch for r in rows] == [1, 2, 3, 4, 5, 6] and again.steps == 24
    assert rows[-1].train_loss < 0.6 * rows[0].train_loss
    # the metrics of a run come from its own predictions
    scored = training.predictions(samples.where("split = 'val'"), again).select(F.col("label").alias("true_label"), "pred_label", "loss")
    accuracy = evaluate.accuracy(scored).first()
    assert accuracy.accuracy > 60 and abs(accuracy.accuracy - rows[-1].val_acc) < 1e-6
    matrix = evaluate.confusion(scored, spark.createDataFrame([(g[0],) for g in GLYPHS], "label string"))
    assert matrix.agg(F.sum("n")).first()[0] == accuracy.n
    assert evaluate.class_errors(matrix).count() == 3
    assert evaluate.weighted_mean(scored.withColumn("n", F.lit(1)), "loss", "n").first()["mean"] == pytest.approx(rows[-1].val_loss, abs=1e-5)
    with pytest.raises(ValueError, match="no samples"):
        training.train(samples.where("false"))

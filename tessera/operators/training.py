"""Training of the glyph classifier: a small convolutional network, its gradients summed on executors.

A step is a Spark job over its part of the samples: tasks run the network forwards and backwards over Arrow batches and give
one sum of gradients each, sums are added up in a tree, and the driver, which only ever sees one sum, makes Adam's step and
sends the new weights. So what travels is bounded by the network, never by the samples; a lost executor costs its tasks, and
a stopped run goes on after its last saved epoch. Equal pictures of a label in a step are counted once and go through the
network once, with their count as weight: the sums are the same, and the work is that of the different pictures.
"""

from __future__ import annotations

import io
import math
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.operators import evaluate
from tessera.session import ship, written

#: The network's layers (kernels, their size), its hidden units, and the step length of Adam.
KERNELS, HIDDEN, RATE = ((16, 5), (32, 3), (64, 3)), 128, 1e-3
SIDE = 32
#: Sums that one task of the tree adds up.
FAN = 8


@dataclass
class Network:
    """Weights by layer, Adam's two averages and its step count, the classes in order, and the epoch after which this is."""

    classes: list[str]
    weights: dict[str, np.ndarray]
    first: dict[str, np.ndarray] = field(default_factory=dict)
    second: dict[str, np.ndarray] = field(default_factory=dict)
    steps: int = 0
    epoch: int = 0

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        arrays = {f"{k}/{n}": a for k, d in (("w", self.weights), ("m", self.first), ("v", self.second)) for n, a in d.items()}
        np.savez(out, classes=np.array(self.classes), counts=np.array([self.steps, self.epoch]), **arrays)
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> Network:
        z = np.load(io.BytesIO(data))
        part = {k: {n[2:]: z[n] for n in z.files if n.startswith(f"{k}/")} for k in "wmv"}
        return cls(z["classes"].tolist(), part["w"], part["m"], part["v"], *z["counts"].tolist())


def new_network(classes: list[str], seed: int = 42, kind: type = np.float32, side: int = SIDE, kernels=KERNELS, hidden: int = HIDDEN) -> Network:
    """Weights drawn evenly within one over the root of a unit's inputs; no biases."""
    if len(classes) > evaluate.MOST_CLASSES:
        raise ValueError(f"more than {evaluate.MOST_CLASSES} classes")
    rng = np.random.default_rng(seed)
    shapes, before = {}, 1
    for k, (n, size) in enumerate(kernels):
        shapes[f"c{k}"] = (n, before, size, size)
        before, side = n, side // 2
    shapes |= {"hidden": (hidden, before * side * side), "out": (len(classes), hidden)}
    return Network(list(classes), {n: (rng.uniform(-1, 1, s) / math.sqrt(np.prod(s[1:]))).astype(kind) for n, s in shapes.items()})


def _columns(x: np.ndarray, size: int) -> np.ndarray:
    """(images, rows, columns, channels * size * size): what lies under the kernel at each place, zeros beyond the border."""
    pad = size // 2
    at = np.lib.stride_tricks.sliding_window_view(np.pad(x, ((0, 0), (0, 0), (pad, pad), (pad, pad))), (size, size), axis=(2, 3))
    n, c, h, w = x.shape
    return at.transpose(0, 2, 3, 1, 4, 5).reshape(n, h, w, c * size * size)


def _layers(weights: dict[str, np.ndarray]) -> list[str]:
    return sorted(n for n in weights if n.startswith("c"))


def forward(weights: dict[str, np.ndarray], x: np.ndarray) -> tuple[np.ndarray, list]:
    """Scores of each class, and what the way back needs. x: (images, 1, side, side)."""
    kept = []
    for name in _layers(weights):
        kernel = weights[name]
        under = _columns(x, kernel.shape[2])
        y = np.maximum(under @ kernel.reshape(len(kernel), -1).T, 0).transpose(0, 3, 1, 2)
        n, c, h, w = y.shape
        four = y.reshape(n, c, h // 2, 2, w // 2, 2).transpose(0, 1, 2, 4, 3, 5).reshape(n, c, h // 2, w // 2, 4)
        best = four.argmax(4)
        x = np.take_along_axis(four, best[..., None], 4)[..., 0]
        kept.append((under, best, x.shape, x > 0))
    flat = x.reshape(len(x), -1)
    inner = np.maximum(flat @ weights["hidden"].T, 0)
    return inner @ weights["out"].T, [*kept, flat, inner]


def losses(scores: np.ndarray, targets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cross-entropy of each image, and the shares that the scores give to the classes."""
    e = scores - scores.max(1, keepdims=True)
    log = e - np.log(np.exp(e).sum(1, keepdims=True))
    return -log[np.arange(len(targets)), targets], np.exp(log)


def gradients(weights: dict[str, np.ndarray], x: np.ndarray, targets: np.ndarray, times: np.ndarray | None = None) -> tuple[float, int, dict[str, np.ndarray]]:
    """(sum of losses, right ones, sums of gradients by layer) of some images, each as many `times` as it says (once)."""
    times = np.ones(len(targets), np.int64) if times is None else times
    scores, kept = forward(weights, x)
    loss, share = losses(scores, targets)
    flat, inner = kept[-2:]
    d = share
    d[np.arange(len(targets)), targets] -= 1
    d *= times.astype(d.dtype)[:, None]
    out = {"out": d.T @ inner}
    d = d @ weights["out"] * (inner > 0)
    out["hidden"] = d.T @ flat
    d = d @ weights["hidden"]
    names = _layers(weights)
    for k in range(len(names) - 1, -1, -1):
        kernel = weights[names[k]]
        under, best, shape, alive = kept[k]
        n, c, h, w = shape
        d = d.reshape(shape) * alive
        four = np.zeros((n, c, h, w, 4), d.dtype)
        np.put_along_axis(four, best[..., None], d[..., None], 4)
        d = four.reshape(n, c, h, w, 2, 2).transpose(0, 2, 4, 3, 5, 1).reshape(n * 4 * h * w, c)
        out[names[k]] = (d.T @ under.reshape(len(d), -1)).reshape(kernel.shape)
        if k:
            # back through the kernel: its places, turned over, on the gradient of its output
            back = kernel[:, :, ::-1, ::-1].transpose(1, 0, 2, 3).reshape(kernel.shape[1], -1)
            d = (_columns(d.reshape(n, 2 * h, 2 * w, c).transpose(0, 3, 1, 2), kernel.shape[2]) @ back.T).transpose(0, 3, 1, 2)
    return float((loss * times).sum()), int(((scores.argmax(1) == targets) * times).sum()), out


def pictures(images: list[bytes], kind: type = np.float32) -> np.ndarray:
    """Packed bits, 1 is black, as numbers from -1 (black) to 1."""
    bits = np.unpackbits(np.frombuffer(b"".join(images), np.uint8)).reshape(len(images), 1, SIDE, SIDE)
    return (1 - 2 * bits.astype(np.int8)).astype(kind)


def _batches(batches: Iterator[pa.RecordBatch], most: int = 64) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, most):
            yield batch.slice(at, most)


def gradient_sum(samples: DataFrame, network: Network) -> tuple[float, int, int, dict[str, np.ndarray]]:
    """(losses, right ones, images, gradients) summed over samples (label, image), in a tree of tasks.

    samples may have n, the number of equal ones that a row stands for. Samples of unknown classes, or without an image of the right size, don't count.
    """
    spark = ship(samples.sparkSession)
    sent = spark.sparkContext.broadcast((network.weights, {c: k for k, c in enumerate(network.classes)}))
    names = list(network.weights)

    def pack(loss, right, n, total):
        return pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([right], pa.int64()), pa.array([n], pa.int64()), pa.array([b"".join(total[k].astype(np.float64).tobytes() for k in names)], pa.binary())], names=["loss", "hits", "n", "total"])

    def run(batches):
        weights, place = sent.value
        loss, right, n = 0.0, 0, 0
        total = {k: np.zeros(w.shape) for k, w in weights.items()}
        for batch in _batches(batches):
            rows = [(place[a], b, m) for a, b, m in zip(*(c.to_pylist() for c in batch.columns), strict=True) if a in place and b is not None and len(b) == SIDE * SIDE // 8]
            if not rows:
                continue
            times = np.array([m for _, _, m in rows], np.int64)
            one, hits, grads = gradients(weights, pictures([b for _, b, _ in rows], weights["out"].dtype.type), np.array([a for a, _, _ in rows]), times)
            loss, right, n = loss + one, right + hits, n + int(times.sum())
            for k in names:
                total[k] += grads[k]
        if n:
            yield pack(loss, right, n, total)

    def add(batches):
        loss, right, n, total = 0.0, 0, 0, None
        for batch in batches:
            for one, hits, m, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                loss, right, n = loss + one, right + hits, n + m
                values = np.frombuffer(data, np.float64)
                total = values if total is None else total + values
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([loss]), pa.array([right], pa.int64()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["loss", "hits", "n", "total"])

    schema = "loss double, hits long, n long, total binary"
    rows = samples.select("label", "image", (F.col("n") if "n" in samples.columns else F.lit(1)).cast("long").alias("n"))
    parts = rows.rdd.getNumPartitions()
    sums = rows.mapInArrow(run, schema)
    while parts > FAN:
        parts = -(-parts // FAN)
        sums = sums.repartition(parts).mapInArrow(add, schema)
    # by a shuffle: without one the gradients too would be worked out in this one task
    found = sums.repartition(1).mapInArrow(add, schema).first()
    sent.destroy()
    if found is None:
        return 0.0, 0, 0, {k: np.zeros(w.shape) for k, w in network.weights.items()}
    flat, at, out = np.frombuffer(bytes(found.total), np.float64), 0, {}
    for k, w in network.weights.items():
        out[k], at = flat[at : at + w.size].reshape(w.shape), at + w.size
    return found.loss, found.hits, found.n, out


def adam_step(network: Network, total: dict[str, np.ndarray], n: int, rate: float = RATE) -> None:
    """One step of Adam with the mean gradient, in place; its decays are 0.9 and 0.999."""
    network.steps += 1
    for k, w in network.weights.items():
        g = total[k] / n
        m = network.first[k] = 0.9 * network.first.get(k, 0) + 0.1 * g
        v = network.second[k] = 0.999 * network.second.get(k, 0) + 0.001 * g * g
        move = rate * (m / (1 - 0.9**network.steps)) / (np.sqrt(v / (1 - 0.999**network.steps)) + 1e-8)
        network.weights[k] = (w - move).astype(w.dtype)


def predictions(samples: DataFrame, network: Network) -> DataFrame:
    """samples with pred_label, the class of the highest score, and loss; null where there is no image, or no loss as the label is unknown."""
    spark = ship(samples.sparkSession)
    sent = spark.sparkContext.broadcast((network.weights, network.classes))
    at = [samples.columns.index(c) for c in ("label", "image")]

    def run(batches):
        weights, classes = sent.value
        place = {c: k for k, c in enumerate(classes)}
        for batch in _batches(batches):
            labels, images = (batch.column(i).to_pylist() for i in at)
            usable = [i for i, b in enumerate(images) if b is not None and len(b) == SIDE * SIDE // 8]
            label, loss = [None] * batch.num_rows, [None] * batch.num_rows
            if usable:
                scores, _ = forward(weights, pictures([images[i] for i in usable], weights["out"].dtype.type))
                each, _ = losses(scores, np.array([place.get(labels[i], 0) for i in usable]))
                for i, best, x in zip(usable, scores.argmax(1).tolist(), each.tolist(), strict=True):
                    label[i] = classes[best]
                    loss[i] = x if labels[i] in place else None
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(label, pa.string()), pa.array(loss, pa.float64())], names=[*batch.schema.names, "pred_label", "loss"])

    return samples.mapInArrow(run, T.StructType([*samples.schema.fields, T.StructField("pred_label", T.StringType()), T.StructField("loss", T.DoubleType())]))


def save_network(spark: SparkSession, network: Network, path: str) -> None:
    """Add the network to the run's table, as its epoch."""
    spark.createDataFrame([(network.epoch, bytearray(network.to_bytes()))], "epoch int, state binary").write.mode("append").parquet(path)


def load_network(spark: SparkSession, path: str) -> Network | None:
    """The network of the last saved epoch; None where nothing was saved."""
    try:
        found = spark.read.parquet(path).orderBy(F.desc("epoch")).first()
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None
    return Network.from_bytes(bytes(found.state)) if found else None


def train(samples: DataFrame, epochs: int = 20, steps: int = 8, rate: float = RATE, seed: int = 42, path: str | None = None) -> tuple[Network, DataFrame]:
    """The network after `epochs`, and a row for each epoch of this run: epoch, train_loss, train_acc, val_loss, val_acc.

    samples: (label, image, split, key); rows of split 'train' teach in `steps` steps an epoch, dealt by a hash of the key, and
    those of 'val' are only scored; an empty split has nulls. Null labels are left out. path: a table of saved epochs, from whose
    last one the run goes on; its classes stay. No training rows are an error.
    """
    spark = samples.sparkSession
    dealt = samples.where("label IS NOT NULL AND image IS NOT NULL").select(F.col("label").cast("string").alias("label"), "image", "split", "key", F.pmod(F.xxhash64("key", F.lit(seed)), F.lit(steps)).cast("int").alias("step"))
    dealt = written(dealt.where("split IN ('train', 'val')").groupBy("label", "image", "split", "step").agg(F.count("*").alias("n")), "samples")
    network = load_network(spark, path) if path else None
    if network is None:
        classes = [r.label for r in dealt.where("split = 'train'").select("label").distinct().orderBy("label").limit(evaluate.MOST_CLASSES + 1).collect()]
        if not classes:
            raise ValueError("no samples to train on")
        network = new_network(classes, seed)
    taught = [written(dealt.where((F.col("split") == "train") & (F.col("step") == s)).repartition(max(1, spark.sparkContext.defaultParallelism), F.xxhash64("label", "image")), "step") for s in range(steps)]
    # a step's number tells nothing here
    valued = written(dealt.where("split = 'val'").groupBy("label", "image").agg(F.sum("n").alias("n")).repartition(max(1, spark.sparkContext.defaultParallelism), F.xxhash64("label", "image")), "val")
    told = []
    while network.epoch < epochs:
        loss = right = count = 0
        for part in taught:
            one, hits, n, total = gradient_sum(part, network)
            if n:
                adam_step(network, total, n, rate)
                loss, right, count = loss + one, right + hits, count + n
        right_one = (F.col("label") == F.col("pred_label")).cast("double")
        mean = lambda c: F.sum(c * F.col("n")) / F.sum(F.when(c.isNotNull(), F.col("n")))
        val = predictions(valued, network).agg(mean(F.col("loss")).alias("loss"), mean(right_one).alias("acc")).first()
        network.epoch += 1
        told.append((network.epoch, loss / count if count else None, 100.0 * right / count if count else None, val["loss"], 100.0 * val["acc"] if val["acc"] is not None else None))
        if path:
            save_network(spark, network, path)
    return network, spark.createDataFrame(told, "epoch int, train_loss double, train_acc double, val_loss double, val_acc double")

"""Quality by a factorisation machine over hashed words, structure statistics and metadata (Rendle, 2010).

score = sigmoid(w0 + sum w_i x_i + 1/2 sum_f ((sum v_if x_i)^2 - sum v_if^2 x_i^2)): pairwise interactions of low rank in
time linear in the features. Words of a text are hashed from its bytes by one prefix polynomial, so a batch needs no
loop over words. The model is fitted on the driver from at most TRAIN_ROWS labelled rows (a documented bound); scoring
is one pass over all texts without a shuffle.

Null and empty texts have only structure features. A null n_chars is the text's own length. Repeated rows score alike.
If a class has no training rows every score is the smoothed share. An id that several rows have is trained on once.
Columns beside doc_id, text and n_chars are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import flat, labelled_sample, prepare, slices, tidy

#: Settings, chosen by folds of training rows alone (choose_settings.py).
PENALTY, ROUNDS = 1e-4, 150
BITS, RANK, TRAIN_ROWS, SEGMENT = 15, 8, 6000, 1 << 16
_PRIME = np.uint64(0x100000001B3)
_INVERSE = np.uint64(pow(0x100000001B3, -1, 1 << 64))
_MIX = np.uint64(0x9E3779B97F4A7C15)
_KIND = np.zeros(256, np.uint8)  # 0 letter or part of one, 1 blank, 2 line end, 3 capital, 4 digit, 5 sentence mark, 6 other mark
_KIND[[32, 9, 11, 12, 13]] = 1
_KIND[10] = 2
_KIND[65:91] = 3
_KIND[48:58] = 4
_KIND[33:48] = _KIND[58:65] = _KIND[91:97] = _KIND[123:127] = 6
_KIND[[ord(c) for c in ".,;:?"]] = 5
STATISTICS = 16
#: Words in fewer training rows tell nothing.
LEAST_ROWS = 5
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def _spans(out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last-plus-one places of the runs where `out` is false."""
    edge = np.diff(np.concatenate([[True], out, [True]]).astype(np.int8))
    return np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)


class Features:
    """Feature ids and values of texts. Texts are gone through SEGMENT bytes at a time, so very long ones take little memory."""

    def __init__(self):
        self.powers, self.inverses = (np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(SEGMENT, base, np.uint64))]) for base in (_PRIME, _INVERSE))

    def _hashes(self, low: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """A hash of each run low[s:e]: a polynomial in its bytes, by prefix sums, brought to the power of its first byte."""
        first, last, shift = np.zeros(len(s), np.uint64), np.zeros(len(s), np.uint64), np.zeros(len(s), np.uint64)
        carry, power, inverse = np.uint64(0), np.uint64(1), np.uint64(1)
        with np.errstate(over="ignore"):
            for at in range(0, len(low), SEGMENT):
                part = low[at : at + SEGMENT]
                n = len(part)
                prefix = np.concatenate([[np.uint64(0)], np.cumsum((part.astype(np.uint64) + np.uint64(1)) * self.powers[:n])]) * power + carry
                for places, out in ((s, first), (e, last)):
                    k = slice(np.searchsorted(places, at), np.searchsorted(places, at + n, side="right"))
                    out[k] = prefix[places[k] - at]
                k = slice(np.searchsorted(s, at), np.searchsorted(s, at + n))
                shift[k] = self.inverses[s[k] - at] * inverse
                carry, power, inverse = prefix[-1], power * self.powers[n], inverse * self.inverses[n]
            return (last - first) * shift * _MIX

    def of(self, raw: np.ndarray, n_chars: int | None) -> tuple[np.ndarray, np.ndarray]:
        """raw: a text's bytes."""
        n = len(raw)
        low, kinds = _LOWER[raw], _KIND[raw]
        counts = sum((np.bincount(kinds[at : at + SEGMENT], minlength=7) for at in range(0, n, SEGMENT)), np.zeros(7, np.int64))
        s, e = _spans((kinds == 1) | (kinds == 2))
        words = self._hashes(low, s, e)
        ls, le = _spans(kinds == 2)
        lines = self._hashes(low, ls, le)
        _, often = np.unique(lines, return_counts=True)
        ids, tf = np.unique(words >> np.uint64(64 - BITS), return_counts=True)
        nw, solid = max(1, len(words)), max(1, n - counts[1] - counts[2])
        size = e - s
        length = n if n_chars is None else n_chars
        # marks that end words, as a share of words
        tail = np.bincount(kinds[e - 1], minlength=7) / nw if len(e) else np.zeros(7)
        alone = ((size == 1) & (kinds[s] >= 5)).sum() / nw if len(s) else 0.0
        stats = np.array(
            [
                1.0,
                np.log1p(n) / 12,
                np.log1p(max(0, length)) / 12,
                np.log1p(len(words)) / 10,
                min(1.0, size.mean() / 20) if len(size) else 0.0,
                np.log1p(size.max()) / 8 if len(size) else 0.0,
                counts[3] / solid,
                counts[4] / solid,
                5 * counts[5] / solid,
                5 * counts[6] / solid,
                tail[5],
                tail[6],
                alone,
                len(np.unique(words)) / nw,
                len(often) / max(1, len(lines)),
                often.max() / max(1, len(lines)) if len(often) else 0.0,
            ]
        )
        values = tf / max(1.0, np.sqrt((tf.astype(np.float64) ** 2).sum()))
        return np.concatenate([np.arange(STATISTICS), ids.astype(np.int64) + STATISTICS]).astype(np.int32), np.concatenate([stats, values]).astype(np.float32)


@dataclass
class Machine:
    bias: float
    w: np.ndarray
    v: np.ndarray

    def score(self, ids: np.ndarray, x: np.ndarray) -> float:
        v = self.v[ids] * x[:, None]
        s = v.sum(0)
        z = self.bias + float(self.w[ids] @ x) + 0.5 * float(s @ s - (v * v).sum())
        return float(1 / (1 + np.exp(-np.clip(z, -40, 40))))


def fit(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, rounds: int | None = None, penalty: float | None = None) -> Machine:
    """Full-batch steps with momentum per coordinate; classes weigh alike; the initial factors come from a fixed seed."""
    rounds, penalty = ROUNDS if rounds is None else rounds, PENALTY if penalty is None else penalty
    n = (1 << BITS) + STATISTICS
    share = (y.sum() + 1) / (len(y) + 2)
    prior = Machine(float(np.log(share / (1 - share))), np.zeros(n, np.float32), np.zeros((n, RANK), np.float32))
    if not len(y) or y.min() == y.max():
        return prior
    ids, x = np.concatenate([r[0] for r in rows]), np.concatenate([r[1] for r in rows])
    of = np.repeat(np.arange(len(y)), [len(r[0]) for r in rows])
    df = np.bincount(ids, minlength=n)
    use = df[ids] >= LEAST_ROWS
    ids, x, of = ids[use], x[use], of[use].astype(np.int32)
    own, ids = np.unique(ids, return_inverse=True)
    by = np.argsort(ids, kind="stable").astype(np.int32)
    ids = ids.astype(np.int32)
    starts = np.searchsorted(ids[by], np.arange(len(own)))
    at = np.searchsorted(of, np.arange(len(y)))  # every row has its statistics
    of_by, x_by = of[by], x[by]
    rng = np.random.default_rng(5)
    p = [np.zeros(len(own), np.float32), rng.normal(0, 0.05, (len(own), RANK)).astype(np.float32), np.zeros(1, np.float32)]
    m, q = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    each = np.where(y == 1, 0.5 / y.sum(), 0.5 / (1 - y).sum()).astype(np.float32)
    x2_by = (x_by * x_by).astype(np.float32)
    for t in range(1, rounds + 1):
        w, v, b = p
        # a factor at a time, so that memory stays near that of the features
        z, s = b[0] + np.add.reduceat(w[ids] * x, at), np.zeros((len(y), RANK), np.float32)
        for f in range(RANK):
            vx = v[ids, f] * x
            s[:, f] = np.add.reduceat(vx, at)
            z += 0.5 * (s[:, f] * s[:, f] - np.add.reduceat(vx * vx, at))
        g = ((1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * each).astype(np.float32)
        g_by = g[of_by]
        gx, gxx = g_by * x_by, np.add.reduceat(g_by * x2_by, starts)
        gv = np.stack([np.add.reduceat(gx * s[of_by, f], starts) - v[:, f] * gxx for f in range(RANK)], axis=1)
        grad = [np.add.reduceat(gx, starts) + penalty * w, gv + penalty * v, np.array([g.sum()], np.float32)]
        for a, ga, ma, qa in zip(p, grad, m, q, strict=True):
            ma += 0.1 * (ga - ma)
            qa += 0.01 * (ga * ga - qa)
            a -= 0.05 * (ma / (1 - 0.9**t)) / (np.sqrt(qa / (1 - 0.99**t)) + 1e-5)
    out = Machine(float(p[2][0]), np.zeros(n, np.float32), np.zeros((n, RANK), np.float32))
    out.w[own], out.v[own] = p[0], p[1]
    return out


def train(docs: DataFrame, labels: DataFrame, keep: Column, most: int = TRAIN_ROWS) -> Machine:
    """A model of `labels.quality`, from at most `most` labelled rows for which `keep` holds; features come from executors."""
    prepare(docs.sparkSession)
    chosen = labelled_sample(docs, labels, "quality", keep, most).select("doc_id", F.encode("text", "UTF-8").alias("raw"), "n_chars", F.col("__y").alias("y"))

    def run(batches):
        with tidy():
            f = Features()
            for batch in slices(batches):
                got = [f.of(np.frombuffer(raw, np.uint8), c) for raw, c in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
                cols = [batch.column(0), batch.column(3), pa.array([g[0].tobytes() for g in got], pa.binary()), pa.array([g[1].tobytes() for g in got], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "y", "ids", "x"])

    kind = chosen.schema["doc_id"].dataType.simpleString()
    # the driver gives the sample's memory back
    with tidy():
        rows = sorted(map(tuple, chosen.mapInArrow(run, f"doc_id {kind}, y int, ids binary, x binary").collect()), key=lambda r: r[:2])
        model = fit([(np.frombuffer(r[2], np.int32), np.frombuffer(r[3], np.float32)) for r in rows], np.array([r[1] for r in rows], np.int64))
        del rows
    return model


def score_documents(docs: DataFrame, model: Machine) -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)  # 2^BITS x (RANK + 1) weights

    def run(batches):
        with tidy():
            f = Features()
            for batch in slices(batches, 1024, 8 << 20):
                data, at = flat(batch.column(1))
                at = at.tolist()
                scores = [shared.value.score(*f.of(data[s:e], c)) for s, e, c in zip(at, at[1:], batch.column(2).to_pylist())]  # noqa: B905
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    n_chars = F.col("n_chars") if "n_chars" in docs.columns else F.char_length("text")
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), n_chars.cast("long").alias("n_chars")).mapInArrow(run, f"doc_id {kind}, score double")


def filter_documents(docs: DataFrame, model: Machine, threshold: float = 0.3) -> DataFrame:
    """The rows of docs, all columns, whose score reaches the threshold."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)
    at = docs.columns.index("text")
    by = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches):
        with tidy():
            f = Features()
            for batch in slices(batches, 1024, 8 << 20):
                data, to = flat(batch.column(at))
                to = to.tolist()
                chars = batch.column(by).to_pylist() if by is not None else [len(t or "") for t in batch.column(at).to_pylist()]
                scores = [shared.value.score(*f.of(data[s:e], c)) for s, e, c in zip(to, to[1:], chars)]  # noqa: B905
                yield batch.filter(pa.array(np.array(scores) >= threshold))

    return docs.mapInArrow(run, docs.schema)

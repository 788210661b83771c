"""Toxicity by a linear classifier over character n-grams, scaled by naive Bayes log-count ratios (Wang and Manning, 2012).

Features are the distinct hashed n-grams of a text's characters (code points) in lower case, white space as one blank. For
each, the log-count ratio r of its smoothed shares among toxic and clean training rows scales the feature, and logistic
regression with an L2 penalty learns weights on the scaled features. The model is fitted on the driver from at most
TRAIN_ROWS labelled rows (a documented bound); scoring is one pass over all texts without a shuffle.

Null and empty texts have no features and get the score of the intercept. Repeated rows score alike. If a class has no
training rows every score is the smoothed share of the other. An id that several rows have is trained on once. Columns
beside doc_id and text are left alone.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import labelled_sample, prepare, slices, texts, tidy, written

#: Settings, chosen by folds of training rows alone (choose_settings.py): n-gram sizes, standard errors that a ratio must
#: be away from none, penalty, rounds.
SIZES, SURE, PENALTY, ROUNDS = (4, 6, 8), 3.5, 1e-3, 100
BITS = 20
TRAIN_ROWS = 6000
SEGMENT = 1 << 18
_STEP = np.uint64(0x100000001B3)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
#: The code points of white space.
_BLANKS = np.array([9, 10, 11, 12, 13, 28, 29, 30, 31, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000], np.uint32)


def ngram_ids(text: str, seen: np.ndarray, sizes: tuple[int, ...] | None = None) -> np.ndarray:
    """Distinct hashed n-grams of a text. seen: scratch of 2^BITS int32 numbers."""
    sizes = sizes or SIZES
    c = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
    blank = (c <= 32) | (c == 0x85) | (c >= 0xA0) & np.isin(c, _BLANKS)
    keep = ~(blank & np.concatenate([[False], blank[:-1]]))
    c = np.concatenate([[32], np.where(blank, 32, c)[keep], [32]]).astype(np.uint32)
    most, found = max(sizes), []
    for at in range(0, len(c), SEGMENT):  # so that a very long text takes little memory
        part = c[at : at + SEGMENT + most - 1].astype(np.uint64)
        ids, code = [np.zeros(0, np.int32)], part
        for n in range(2, most + 1):
            if len(part) < n:
                break
            code = code[: len(part) - n + 1] * _STEP + part[n - 1 :]
            if n in sizes:
                ids.append(((code + np.uint64(n)) * _MULTIPLIER >> np.uint64(64 - BITS)).astype(np.int32))
        found.append(_distinct(np.concatenate(ids), seen))
    return found[0] if len(found) == 1 else _distinct(np.concatenate(found), seen)


def _distinct(ids: np.ndarray, seen: np.ndarray) -> np.ndarray:
    order = np.arange(len(ids), dtype=np.int32)
    seen[ids] = order
    return ids[seen[ids] == order]


@dataclass
class Linear:
    weights: np.ndarray
    intercept: float

    def score(self, ids: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.weights[ids].sum(dtype=np.float64) + self.intercept, -40, 40))))


def log_ratios(hits: np.ndarray, toxic: int, clean: int, smooth: float = 1.0, sure: float | None = None) -> np.ndarray:
    """Log-count ratios from each class's rows with a feature; 0 where they are within a few standard errors of none."""
    h = hits + smooth
    ratio = np.log(h[1] / (toxic + 2 * smooth)) - np.log(h[0] / (clean + 2 * smooth))
    ratio[np.abs(ratio) < (SURE if sure is None else sure) * np.sqrt(1 / h[0] + 1 / h[1])] = 0
    return ratio


def fit(features: list[np.ndarray], y: np.ndarray, hits: np.ndarray | None = None, rounds: int | None = None, penalty: float | None = None, sure: float | None = None) -> Linear:
    """NB-scaled logistic regression by full-batch steps with momentum per coordinate; both classes weigh alike."""
    rounds, penalty = ROUNDS if rounds is None else rounds, PENALTY if penalty is None else penalty
    n = 1 << BITS
    share = (y.sum() + 1) / (len(y) + 2)
    prior = Linear(np.zeros(n, np.float32), float(np.log(share / (1 - share))))
    if not len(y) or y.min() == y.max():
        return prior
    rows = np.repeat(np.arange(len(y)), [len(f) for f in features])
    ids = np.concatenate(features)
    if hits is None:
        hits = np.stack([np.bincount(ids[y[rows] == v], minlength=n) for v in (0, 1)])
    ratio = log_ratios(hits, int(y.sum()), int((1 - y).sum()), sure=sure)
    use = ratio[ids] != 0
    rows, ids = rows[use], ids[use]
    if not len(ids):
        return prior
    # only the features seen
    own, ids = np.unique(ids, return_inverse=True)
    r = ratio[own]
    by = np.argsort(ids, kind="stable")
    rows_by, starts = rows[by], np.searchsorted(ids[by], np.arange(len(own)))
    row_starts = np.searchsorted(rows, np.arange(len(y)))
    has = np.bincount(rows, minlength=len(y)) > 0
    w, m, v = np.zeros(len(own)), np.zeros(len(own)), np.zeros(len(own))
    b, mb, vb = float(np.log(share / (1 - share))), 0.0, 0.0
    each = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    for t in range(1, rounds + 1):
        x = (w * r)[ids]
        z = np.where(has, np.add.reduceat(np.append(x, 0.0), np.minimum(row_starts, len(x))), 0.0) + b
        g = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * each
        gw = np.add.reduceat(g[rows_by], starts) * r + penalty * w
        gb = g.sum()
        m, v = 0.9 * m + 0.1 * gw, 0.99 * v + 0.01 * gw * gw
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        rate = 0.02
        w -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-4)
        b -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-4)
    weights = np.zeros(n, np.float32)
    weights[own] = w * r
    return Linear(weights, float(b))


def train(docs: DataFrame, labels: DataFrame, keep: Column, most: int = TRAIN_ROWS) -> Linear:
    """A model of `labels.toxic`, from at most `most` labelled rows for which `keep` holds.

    The sample is written once; executors turn it into n-grams, so the driver gets only hit counts and the n-grams
    that tell the classes apart.
    """
    spark = prepare(docs.sparkSession)
    chosen = labelled_sample(docs, labels, "toxic", keep, most).select("doc_id", "text", F.col("__y").alias("y"))
    chosen = written(chosen.repartition(8), "toxicity-sample")
    n = 1 << BITS

    def count(batches):
        with tidy():
            seen, hits = np.zeros(n, np.int32), np.zeros((2, n), np.int32)
            for batch in slices(batches):
                for text, y in zip(texts(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                    hits[y][ngram_ids(text, seen)] += 1
            yield pa.RecordBatch.from_arrays([pa.array([hits.tobytes()], pa.binary())], names=["hits"])

    hits = np.zeros((2, n))
    for r in chosen.mapInArrow(count, "hits binary").toLocalIterator():
        hits += np.frombuffer(r[0], np.int32).reshape(2, n)
    told = spark.sparkContext.broadcast(log_ratios(hits, chosen.where("y = 1").count(), chosen.where("y = 0").count()) != 0)

    def pick(batches):
        with tidy():
            seen = np.zeros(n, np.int32)
            for batch in slices(batches):
                ids = [ngram_ids(text, seen) for text in texts(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array([np.sort(x[told.value[x]]).tobytes() for x in ids], pa.binary())], names=["doc_id", "y", "ids"])

    kind = chosen.schema["doc_id"].dataType.simpleString()
    # the driver gives the sample's memory back
    with tidy():
        rows = sorted(map(tuple, chosen.mapInArrow(pick, f"doc_id {kind}, y int, ids binary").collect()), key=lambda r: r[0])
        model = fit([np.frombuffer(r[2], np.int32) for r in rows], np.array([r[1] for r in rows], np.int64), hits)
        del rows
    return model


def score_documents(docs: DataFrame, model: Linear) -> DataFrame:
    """doc_id and score (0 to 1) of every row."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)  # 2^BITS weights

    def run(batches):
        with tidy():
            seen = np.zeros(1 << BITS, np.int32)
            for batch in slices(batches, 1024, 8 << 20):
                scores = [shared.value.score(ngram_ids(t, seen)) for t in texts(batch.column(1))]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], names=["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, score double")


def filter_documents(docs: DataFrame, model: Linear, threshold: float = 0.7) -> DataFrame:
    """The rows of docs, all columns, whose score is below the threshold."""
    shared = prepare(docs.sparkSession).sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def run(batches):
        with tidy():
            seen = np.zeros(1 << BITS, np.int32)
            for batch in slices(batches, 1024, 8 << 20):
                scores = [shared.value.score(ngram_ids(t, seen)) for t in texts(batch.column(at))]
                yield batch.filter(pa.array(np.array(scores) < threshold))

    return docs.mapInArrow(run, docs.schema)

"""Settings of the two classifiers, compared by folds of the training rows alone.

    python -m tessera.llm.choose_settings /root/testdata/sf0.1

Only rows that the queries may learn from are read: crc32(doc_id as text) mod 3 is not 1 for toxicity, mod 5 is not 0 for
quality. They are dealt into FOLDS by crc32 of the id followed by a dash, which has nothing to do with these remainders.
Each setting is fitted on all folds but one and scored on that one. The setting of fewest errors at the query's threshold
is the one to take, of equals that of the least logarithmic loss. Held-out rows play no part.
"""

from __future__ import annotations

import sys
import zlib
from collections.abc import Callable
from itertools import product
from multiprocessing import Pool

import numpy as np

from tessera.llm import quality_fm, toxicity

FOLDS = 5
Rows = list[tuple[int, str, int, int]]


def training_rows(folder: str, label: str, modulus: int, held: int) -> Rows:
    """(doc_id, text, n_chars, label) of the rows to learn from, a row for each id."""
    import pyarrow.parquet as pq

    docs = {d["doc_id"]: d for d in pq.read_table(f"{folder}/documents.parquet", columns=["doc_id", "text", "n_chars"]).to_pylist()}
    found = {r["doc_id"]: r[label] for r in pq.read_table(f"{folder}/labels.parquet").to_pylist()}
    own = [i for i, y in sorted(found.items()) if y is not None and i in docs and zlib.crc32(str(i).encode()) % modulus != held]
    return [(i, docs[i]["text"] or "", docs[i]["n_chars"], int(found[i])) for i in own]


def compared(rows: Rows, features: Callable, fit: Callable, threshold: float) -> tuple[int, float]:
    """Errors at the threshold and mean logarithmic loss over all folds."""
    y = np.array([r[3] for r in rows])
    fold = np.array([zlib.crc32(f"{r[0]}-".encode()) % FOLDS for r in rows])
    x = [features(r) for r in rows]
    errors, loss = 0, 0.0
    for k in range(FOLDS):
        at, out = np.flatnonzero(fold != k), np.flatnonzero(fold == k)
        model = fit([x[i] for i in at], y[at])
        p = np.array([model.score(*x[i]) if isinstance(x[i], tuple) else model.score(x[i]) for i in out])
        errors += int(((p >= threshold) != y[out]).sum())
        loss -= float(np.log(np.clip(np.where(y[out] == 1, p, 1 - p), 1e-6, 1)).sum())
    return errors, loss / max(1, len(rows))


def toxic(job: tuple) -> tuple:
    rows, sizes, sure, penalty, rounds = job
    seen = np.zeros(1 << toxicity.BITS, np.int32)
    return (sizes, sure, penalty, rounds), compared(rows, lambda r: toxicity.ngram_ids(r[1], seen, sizes), lambda x, y: toxicity.fit(x, y, None, rounds, penalty, sure), 0.7)


def quality(job: tuple) -> tuple:
    rows, penalty, rounds = job
    f = quality_fm.Features()
    return (penalty, rounds), compared(rows, lambda r: f.of(np.frombuffer(r[1].encode(), np.uint8), r[2]), lambda x, y: quality_fm.fit(x, y, rounds, penalty), 0.3)


def main(folder: str) -> None:
    with Pool() as pool:
        rows = training_rows(folder, "toxic", 3, 1)
        jobs = [(rows, *s) for s in product(((2, 3, 4), (3, 4, 5), (3, 5, 7), (4, 6, 8), (5, 7, 9)), (2.5, 3.5, 4.5), (1e-3,), (100,))]
        show("toxicity: sizes, sure, penalty, rounds", rows, pool.map(toxic, jobs, 1))
        rows = training_rows(folder, "quality", 5, 0)
        jobs = [(rows, *s) for s in product((1e-3, 1e-4), (40, 90, 150))]
        show("quality: penalty, rounds", rows, pool.map(quality, jobs, 1))


def show(title: str, rows: Rows, results: list[tuple]) -> None:
    print(f"{title}; errors of {len(rows)} training rows, loss")
    for setting, (errors, loss) in sorted(results, key=lambda r: r[1]):
        print(f"  {setting}: {errors}, {loss:.4f}")


if __name__ == "__main__":
    main(sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1")

"""How the sources of a language differ in their words, by a sort-based stream of term runs.

Tasks count the terms of their documents, combine those of about 16 MB of text by language, term and source, and label each
such sum with the first of its documents. These partial rows are dealt by (lang, term) and sorted by lang, term,
source and document; a scan over the runs of equal keys adds up document frequency and counts, and a term whose run reaches
the least frequency is kept, as one row with its counts by source.

Shares need the totals of every group first: they are summed from the kept terms, and come to each bucket of terms as header
rows in the sort, before its terms. A second scan reads a bucket's header and then its runs, and emits partial sums for pairs
of sources and the partial highest terms of each source; sums and ranks of these finish the result. The library broadcasts nothing,
and no task holds more than a run of terms, the groups of one language, and its pair sums where they fit.

All numbers are exact whole numbers. Null text, lang and source count as ''. Repeated rows and ids count as documents each.
A very long text is counted whole, as arrays of bytes. Ties in value are ordered by item, as bytes. An empty table gives an empty result; other
columns are ignored, whatever their names. A group without terms still has its pairs; a language without kept terms has
pairs of value 0 and no terms.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import flat, prepare, slices, texts, tidy, written

#: Bytes of text that are counted together; cells of a chunk of terms by sources; cells of pair sums at once.
TOGETHER, CHUNK, PAIRS = 16 << 20, 1 << 20, 1 << 22
SCALE, PRIOR = 1_000_000_000, 5
#: Bytes of terms as they count, and 0 for bytes between terms: letters, with A-Z lower-cased, and all of other scripts.
LETTER = np.array([c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 128 else 0 for c in range(256)], np.uint8)


def terms_of(column: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The terms of all texts of a column, in their order, and the row of each."""
    raw, offsets = flat(column)
    data = LETTER[raw]
    letter = data != 0
    new = letter.copy()
    new[1:] &= ~letter[:-1]
    inner = offsets[:-1][offsets[:-1] < offsets[1:]]
    new[inner] = letter[inner]  # a term ends with its text
    starts = np.flatnonzero(new)
    data = data[letter]
    sizes = np.bincount(np.cumsum(new)[letter] - 1, minlength=len(starts)) if len(starts) else np.zeros(0, np.int64)
    ends = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data)])
    return found.dictionary_encode(), np.searchsorted(offsets, starts, "right") - 1


def _sums(key: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """Distinct keys, ascending, and for each the sums of the values."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    at = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return [key[at], *(np.add.reduceat(v[order], at) if len(key) else v for v in values)]


def partial_terms(docs: DataFrame) -> DataFrame:
    """(lang, source, term, document, df, n): sums over some documents of one task; document tells which, by the first one's number."""
    prepare(docs.sparkSession)

    def count(batch: pa.RecordBatch, at: int) -> pa.RecordBatch:
        terms, row = terms_of(batch.column(0))
        names = pa.array([f"{a}\0{b}" for a, b in zip(*(texts(batch.column(i)) for i in (1, 2)), strict=True)], pa.string()).dictionary_encode()
        wide = len(terms.dictionary) + 1
        # first within each document, so that a term has one vote there, then over the documents of a group
        own, n = _sums(row * wide + terms.indices.to_numpy(), np.ones(len(terms), np.int64))
        group = names.indices.to_numpy()[own // wide].astype(np.int64)
        key, df, n = _sums(group * wide + own % wide, np.ones(len(own), np.int64), n)
        first = np.full(len(names.dictionary) + 1, at, np.int64)
        np.minimum.at(first, names.indices.to_numpy(), at)
        pairs = [x.rsplit("\0", 1) for x in names.dictionary.to_pylist()]
        lang, source = (pa.array([p[k] for p in pairs], pa.string()).take(pa.array(key // wide)) for k in (0, 1))
        term = terms.dictionary.cast(pa.large_string()).cast(pa.string()).take(pa.array(key % wide))
        return pa.RecordBatch.from_arrays([lang, source, term, pa.array(first[key // wide]), pa.array(df), pa.array(n)], names=["lang", "source", "term", "document", "df", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tidy():
            at = 0
            for batch in slices(batches, 1 << 20, TOGETHER):
                yield count(batch, at)
                at += batch.num_rows

    return docs.select(F.col("text").cast("string"), F.col("lang").cast("string"), F.col("source").cast("string")).mapInArrow(run, "lang string, source string, term string, document long, df long, n long")


def kept_terms(partial: DataFrame, least: int) -> DataFrame:
    """(lang, term, sources, counts) of terms in at least `least` documents of the language, by a scan of sorted runs.

    Lang and term are one string in the sort, with a zero between, which no term has: so its first bytes tell most rows apart.
    """

    def changes(column: pa.Array) -> np.ndarray:
        n = len(column)
        return np.concatenate([[True], pc.not_equal(column.slice(1), column.slice(0, n - 1)).to_numpy(zero_copy_only=False)])

    def runs(table: pa.Table) -> list[tuple]:
        key, source = (table.column(i).combine_chunks() for i in (0, 1))
        df, n = (table.column(i).to_numpy() for i in (2, 3))
        new = changes(key)
        at = np.flatnonzero(new)
        enough = np.add.reduceat(df, at) >= least
        ends = np.append(at[1:], len(new))
        each = np.flatnonzero(new | changes(source))
        count = np.add.reduceat(n, each)
        out = []
        for s, e in zip(at[enough].tolist(), ends[enough].tolist(), strict=True):
            i, j = np.searchsorted(each, (s, e))
            out.append((*key[s].as_py().rsplit("\0", 1), source.take(pa.array(each[i:j])).to_pylist(), count[i:j].tolist()))
        return out

    def scan(batches):
        with tidy():
            rest: list[pa.RecordBatch] = []
            for batch in batches:
                if not batch.num_rows:
                    continue
                # the last run may go on in the next batch
                key = batch.column(0)
                cut = int(np.flatnonzero(changes(key))[-1])
                if cut == 0 and rest and rest[-1].column(0)[-1] == key[0]:
                    rest.append(batch)
                    continue
                if out := runs(pa.Table.from_batches([*rest, batch.slice(0, cut)])) if rest or cut else []:
                    yield rows(out)
                rest = [batch.slice(cut)]
            if rest:
                yield rows(runs(pa.Table.from_batches(rest)))

    def rows(out):
        kinds = (pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int64()))
        return pa.RecordBatch.from_arrays([pa.array([o[k] for o in out], t) for k, t in enumerate(kinds)], names=["lang", "term", "sources", "counts"])

    keyed = partial.select(F.concat("lang", F.lit("\0"), "term").alias("key"), "source", "document", "df", "n")
    dealt = keyed.repartition("key").sortWithinPartitions("key", "source", "document")
    return dealt.select("key", "source", "df", "n").mapInArrow(scan, "lang string, term string, sources array<string>, counts array<long>")


def shares(counts: np.ndarray, totals: np.ndarray) -> np.ndarray:
    """1 + floor(SCALE * (counts + PRIOR) / totals), in whole numbers, by long division of three digits of a thousand."""
    rest, out = counts + PRIOR, 0
    out, rest = rest // totals, rest % totals
    for _ in range(3):
        rest = rest * 1000
        out, rest = out * 1000 + rest // totals, rest % totals
    return out + 1


def partial_results(bucketed: DataFrame, ranks: int) -> DataFrame:
    """(lang, source, part, item, value): partial pair sums and highest terms of each bucket; headers have no term."""

    def run(batches):
        with tidy(False):
            for rows in _buckets(batches):
                yield from _bucket(rows)

    def _buckets(batches):
        """For each bucket: lang, header rows, and an iterator over chunks of its terms; here as lists of bounded size."""
        state = None
        for batch in slices(batches, 4096):
            for lang, bucket, term, sources, counts, kept in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if state is None or state.key != (lang, bucket):
                    if state is not None:
                        yield state.finish()
                    state = Bucket(lang, bucket, ranks)
                if term is None:
                    state.group(sources[0], counts[0], kept)
                else:
                    state.add(term, sources, counts)
            if state is not None and state.full():
                yield state.flush()
        if state is not None:
            yield state.finish()

    def _bucket(out):
        for at in range(0, len(out[0]), 1 << 16):
            cols = [c[at : at + (1 << 16)] for c in out]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(),) * 4 + (pa.int64(),), strict=True)], names=["lang", "source", "part", "item", "value"])

    return bucketed.mapInArrow(run, "lang string, source string, part string, item string, value long")


class Bucket:
    """The terms of one bucket of a language: sums over pairs of its sources and each source's highest terms so far."""

    def __init__(self, lang: str, bucket: int, ranks: int):
        self.key, self.lang, self.ranks = (lang, bucket), lang, ranks
        self.sources: list[str] = []
        self.totals: list[int] = []
        self.kept = 0
        self.terms: list[str] = []
        self.rows: list[tuple[list[int], list[int]]] = []
        self.place: dict[str, int] = {}
        self.pairs: np.ndarray | None = None
        self.best: list[list[tuple[int, str]]] = []
        self.out: list[tuple] = []

    def group(self, source: str, total: int, kept: int) -> None:
        self.place[source] = len(self.sources)
        self.sources.append(source)
        self.totals.append(total)
        self.best.append([])
        self.kept = kept

    def add(self, term: str, sources: list[str], counts: list[int]) -> None:
        self.terms.append(term)
        self.rows.append(([self.place[s] for s in sources], counts))
        if len(self.terms) * len(self.sources) >= CHUNK:
            self._chunk()

    def _chunk(self) -> None:
        if not self.terms:
            return
        n = len(self.sources)
        counts = np.zeros((len(self.terms), n), np.int64)
        for i, (at, c) in enumerate(self.rows):
            counts[i, at] = c
        p = shares(counts, np.array(self.totals, np.int64) + PRIOR * self.kept)
        q = shares(counts.sum(1), np.int64(sum(self.totals) + PRIOR * self.kept))
        over = np.where((counts > 0) & (p > q[:, None]), p - q[:, None], 0)
        for s in range(n):
            at = np.flatnonzero(over[:, s])
            self.best[s] += zip((-over[at, s]).tolist(), [self.terms[i] for i in at], strict=True)
            if len(self.best[s]) > 4 * self.ranks:
                self.best[s] = sorted(self.best[s])[: self.ranks]
        if self.pairs is None and n * n <= PAIRS:
            self.pairs = np.zeros((n, n), np.int64)
        for s in range(n):
            sums = np.abs(p - p[:, s : s + 1]).sum(0)
            if self.pairs is not None:
                self.pairs[s] += sums
            else:  # too many sources to hold all pairs: each chunk's own sums are emitted
                self._emit_pairs(s, sums)
        self.terms, self.rows = [], []

    def _emit_pairs(self, s: int, sums: np.ndarray) -> None:
        self.out += [(self.lang, self.sources[s], "pair", self.sources[k], int(v)) for k, v in enumerate(sums.tolist()) if k != s and v]

    def full(self) -> bool:
        return len(self.out) > PAIRS // 8

    def flush(self) -> list[list]:
        out, self.out = self.out, []
        return [list(c) for c in zip(*out, strict=True)] or [[]] * 5

    def finish(self) -> list[list]:
        self._chunk()
        for s in range(len(self.sources)):
            if self.pairs is not None:
                self._emit_pairs(s, self.pairs[s])
            self.out += [(self.lang, self.sources[s], "term", t, -v) for v, t in sorted(self.best[s])[: self.ranks]]
        return self.flush()


def audit_sources(docs: DataFrame, least: int = 30, ranks: int = 50) -> DataFrame:
    """lang, source, part (pair or term), item, value and rank, for every language and source of docs."""
    spark = docs.sparkSession
    groups = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]).distinct()
    kept = written(kept_terms(partial_terms(docs), least), "kept-terms")
    each = kept.select("lang", F.explode(F.arrays_zip("sources", "counts")).alias("x")).groupBy("lang", F.col("x.sources").alias("source")).agg(F.sum("x.counts").alias("total"))
    sizes = kept.groupBy("lang").agg(F.count("*").alias("kept"))
    header = written(groups.join(each, ["lang", "source"], "left").join(sizes, "lang", "left").select("lang", "source", F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("kept", F.lit(0)).alias("kept")), "groups")
    buckets = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))  # of each language; results don't hang on it
    heads = header.where("kept > 0").select("lang", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("bucket"), F.lit(None).cast("string").alias("term"), F.array("source").alias("sources"), F.array("total").alias("counts"), "kept")
    terms = kept.select("lang", F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"), "term", "sources", "counts", F.lit(0).cast("long").alias("kept"))
    dealt = heads.unionByName(terms).repartition("lang", "bucket").sortWithinPartitions("lang", "bucket", F.col("term").asc_nulls_first(), F.col("sources")[0])
    found = written(partial_results(dealt, ranks), "partial-results")
    # every pair has a row, also where all terms are alike or none is kept
    none = header.select("lang", "source").join(header.select("lang", F.col("source").alias("item")), "lang").where("source <> item").select("lang", "source", F.lit("pair").alias("part"), "item", F.lit(0).cast("long").alias("value"))
    pairs = found.where("part = 'pair'").unionByName(none).groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    order = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    top = found.where("part = 'term'").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= ranks)
    return pairs.withColumn("rank", F.row_number().over(order)).unionByName(top)

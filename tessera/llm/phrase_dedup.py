"""Removal of repeated passages by phrase automata.

A window is a number of consecutive words. It has an anchor, the phrase of GRAM words in it whose hash is lowest, which any
other place with the same words has too. So only windows whose anchor occurs twice can recur; these are hashed, counted, and
the recurring ones, each in the first text that has it, join to passages: recurring passages, every window of which is in one.

Passages are dealt to shards of about a bounded number of words, those of near copies to one shard. A shard compiles its
passages' probes into an Aho-Corasick automaton over code points that stand for words. A probe is what half a window's number
of consecutive windows have in common, so that any window holds a whole one. A near copy's passage is the windows around a
word that differs; its probes hold that word, so texts without it, which share all but one word of a window with the passage
on either side, don't meet them. The regions of all texts around anchors that a shard's passages have are streamed through
the automaton; a probe found is extended both ways as far as text and passage agree, and what agrees over a window's length
or more is an occurrence. The place a passage was taken from counts where another occurrence covers it, so a false match of
hashes removes nothing.

Texts are told by digest and distinct texts are searched once. A text with copies recurs as a whole, and needs no search for
itself. Regions of a shard are dealt over as many tasks as their size asks for, each with the shard's passages. Texts are
written once, compressed, so that rows have fixed numbers; no list of windows, passages or fingerprints comes to the driver.

Null and empty texts have no words and lose nothing. A null id is kept as it is, repeated rows are copies of each other and
keep a row each. Very long texts are searched whole; their passages are cut into pieces that overlap by a window. An empty
table gives an empty one. Other columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import prepare, slices, tidy, written

#: Words of a window; of an anchor.
WINDOW, GRAM = 35, 12
#: Words of a passage's piece, of a shard's passages, and of the regions that a task streams through a shard, about.
PIECE, SHARD, STREAM = 4096, 200_000, 1_000_000
#: Words of passages are code points from FIRST on, beyond those of surrogates; a word of no passage is OTHER.
FIRST, OTHER = 0xE000, "\x01"
_STEP = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xBF58476D1CE4E5B9)


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def phrase_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """A hash for each run of `size` words, by doubling."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out, done, power, cur, width = np.zeros(n, np.uint64), 0, _STEP, h, 1
    rest = size
    while rest:
        if rest & 1:
            out = out * power + cur[done : done + n]
            done += width
        rest >>= 1
        if rest:
            cur = cur[: len(cur) - width] * power + cur[width:]
            power, width = np.uint64(int(power) ** 2 & (1 << 64) - 1), 2 * width
    out = (out ^ (out >> np.uint64(29))) * _MIX
    return out ^ (out >> np.uint64(32))


def window_anchors(grams: np.ndarray, window: int = WINDOW, gram: int = GRAM) -> np.ndarray:
    """For each window, the place of its anchor: of the lowest hash among its grams, the first of equal ones."""
    span = window - gram + 1
    n = len(grams) - span + 1
    value, at = grams, np.arange(len(grams), dtype=np.int32)
    width = 1
    while width < span:
        step = min(width, span - width)
        left, right = value[: len(value) - step], value[step:]
        at = np.where(left <= right, at[: len(at) - step], at[step:])
        value = np.minimum(left, right)
        width += step
    return at[:n]


def text_rows(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """uid, doc_id, digest, n_words, kept (sha256 of all words), packed text, and the distinct anchors with their places; written."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        with tidy(False):
            for batch in slices(batches, 512, 8 << 20):
                out: list[list] = [[] for _ in range(6)]
                for raw in batch.column(1).to_pylist():
                    words = (raw or b"").split()
                    joined = b" ".join(words)
                    at = np.zeros(0, np.int64)
                    grams = np.zeros(0, np.uint64)
                    if len(words) >= window:
                        grams = phrase_hashes(word_hashes(words), GRAM)
                        at = np.unique(window_anchors(grams, window))
                    digest = hashlib.sha256(joined).digest()
                    for col, x in zip(out, (digest, len(words), digest.hex(), press.compress(joined), grams[at].view(np.int64), at.astype(np.int32)), strict=True):
                        col.append(x)
                kinds = (pa.binary(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds, strict=True))], names=["doc_id", "digest", "n_words", "kept", "packed", "anchors", "places"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    made = docs.select("doc_id", F.encode(F.col("text").cast("string"), "UTF-8").alias("raw")).mapInArrow(run, f"doc_id {kind}, digest binary, n_words long, kept string, packed binary, anchors array<long>, places array<int>")
    return written(made.withColumn("uid", F.monotonically_increasing_id()), "texts")


#: One for each worker process: making one costs more than a short text's unpacking.
_UNPRESS = zstandard.ZstdDecompressor()


def unpack_text(packed: bytes) -> bytes:
    return _UNPRESS.decompress(packed)


def unpack(packed: bytes) -> list[bytes]:
    return unpack_text(packed).split(b" ")


@F.pandas_udf(T.StringType())
def unpacked(packed: pd.Series) -> pd.Series:
    return packed.map(lambda x: unpack_text(x).decode())


def recurring_windows(found: DataFrame, window: int = WINDOW) -> DataFrame:
    """(uid, starts): of each recurring window, a place in the first text that has it. found: (uid, packed, places of recurring anchors)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tidy(False):
            for batch in slices(batches, 256, 4 << 20):
                cols = [[np.zeros(0, np.int64)] for _ in range(3)]
                for uid, packed, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    h = word_hashes(unpack(packed))
                    recurs = np.zeros(len(h), bool)
                    recurs[places] = True
                    at = np.flatnonzero(recurs[window_anchors(phrase_hashes(h, GRAM), window)])
                    for col, x in zip(cols, (phrase_hashes(h, window)[at].view(np.int64), np.full(len(at), uid, np.int64), at), strict=True):
                        col.append(x)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in cols], names=["w", "uid", "start"])

    windows = found.select("uid", "packed", "places").mapInArrow(run, "w long, uid long, start long")
    twice = windows.groupBy("w").agg(F.count("*").alias("n"), F.min("uid").alias("uid"), F.min_by("start", "uid").alias("start")).where("n > 1")
    return twice.groupBy("uid").agg(F.collect_list("start").alias("starts"))


def passages(first: DataFrame, window: int = WINDOW) -> DataFrame:
    """(uid, kin, start, words, text, anchors): maximal runs of the given windows of each text, in pieces. first: (uid, kin, packed, starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tidy(False):
            for batch in slices(batches, 256, 4 << 20):
                out: list[list] = [[] for _ in range(6)]
                for uid, kin, packed, starts in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    words = unpack(packed)
                    own = np.sort(np.array(starts, np.int64))
                    cuts = np.flatnonzero(np.diff(own) > 1) + 1
                    for run_ in np.split(own, cuts):
                        # only the run's words are hashed: a window's anchor hangs on the window alone
                        first_ = int(run_[0])
                        grams = phrase_hashes(word_hashes(words[first_ : int(run_[-1]) + window]), GRAM)
                        at = window_anchors(grams, window)
                        for s in range(first_, int(run_[-1]) + 1, PIECE - window + 1):
                            e = min(s + PIECE - window, int(run_[-1]))
                            row = (uid, kin, s, e - s + window, b" ".join(words[s : e + window]), np.unique(grams[at[s - first_ : e + 1 - first_]]).view(np.int64))
                            for col, x in zip(out, row, strict=True):
                                col.append(x)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["uid", "kin", "start", "words", "text", "anchors"])

    return first.select("uid", "kin", "packed", "starts").mapInArrow(run, "uid long, kin long, start long, words long, text binary, anchors array<long>")


def sharded(pieces: DataFrame, shards: int) -> DataFrame:
    """Passages with a shard each, those of kin texts in one. pieces: (uid, kin, start, words), written.

    Near copies have their lowest recurring anchor alike; were their passages apart, each copy would go to all their shards.
    Kin texts that have more than half a shard are split by text, a text by tracts of a quarter of a shard.
    """
    tract = F.expr(f"start div {SHARD // 4}")
    sizes = pieces.groupBy("kin", tract.alias("tract")).agg(F.ceil(F.sum("words") / (SHARD // 2)).alias("split"))
    large = written(sizes.where("split > 1"), "large-kin")  # at most two rows for each shard
    rows = pieces.withColumn("tract", tract).join(large, ["kin", "tract"], "left")
    within = F.pmod(F.xxhash64("uid"), F.coalesce("split", F.lit(1)))
    return rows.withColumn("shard", F.pmod(F.xxhash64("kin", "tract", within), F.lit(shards)).cast("int")).drop("tract", "split")


def regions(routed: DataFrame, window: int = WINDOW) -> DataFrame:
    """(shard, uid, start, words, text): what lies within a window of the anchors that a shard has. routed: (shard, uid, packed, places)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tidy(False):
            for batch in slices(batches, 256, 4 << 20):
                out: list[list] = [[] for _ in range(5)]
                for shard, uid, packed, places in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    words = unpack(packed)
                    at = np.unique(np.array(places, np.int64))
                    low, high = np.maximum(at - (window - GRAM), 0), np.minimum(at + window, len(words))
                    new = np.concatenate([[True], low[1:] > high[:-1]])
                    for s, e in zip(low[new].tolist(), high[np.append(np.flatnonzero(new)[1:] - 1, len(at) - 1)].tolist(), strict=True):
                        for col, x in zip(out, (shard, uid, s, e - s, b" ".join(words[s:e])), strict=True):
                            col.append(x)
                kinds = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["shard", "uid", "start", "words", "text"])

    return routed.select("shard", "uid", "packed", "places").mapInArrow(run, "shard int, uid long, start long, words long, text binary")


def _agree(a: str, i: int, b: str, j: int, most: int) -> int:
    """How many characters a from i and b from j on have alike, of the next `most`; where none is negative, they are there."""
    if a[i : i + most] == b[j : j + most]:
        return most
    low, high = 0, most  # the first `low` agree, the first `high` don't
    while high - low > 1:
        mid = (low + high) // 2
        if a[i + low : i + mid] == b[j + low : j + mid]:
            low = mid
        else:
            high = mid
    return low


def _agree_back(a: str, i: int, b: str, j: int, most: int) -> int:
    """The same for the characters before i and j."""
    if a[i - most : i] == b[j - most : j]:
        return most
    low, high = 0, most
    while high - low > 1:
        mid = (low + high) // 2
        if a[i - mid : i - low] == b[j - mid : j - low]:
            low = mid
        else:
            high = mid
    return low


class _Letters(dict):
    """A code point for each word that is asked for."""

    def __missing__(self, word: bytes) -> str:
        out = self[word] = chr(len(self) + FIRST)
        return out


def probes(words: int, window: int = WINDOW) -> Iterator[tuple[int, int]]:
    """Where a passage's probes lie: its windows fall into even groups, of half a window's number at most; each has its common words."""
    windows = words - window + 1
    groups = -(-windows // (window - (window + 1) // 2 + 1))
    for g in range(groups):
        yield windows * (g + 1) // groups - 1, windows * g // groups + window


class Shard:
    """The automaton of a shard's passages, and the occurrences of them that it has seen."""

    def __init__(self, window: int = WINDOW):
        self.window = window
        self.letters = _Letters()
        self.origins: list[tuple[int, int]] = []
        self.held: list[np.ndarray] = []
        self.automaton = None

    def add(self, uid: int, start: int, text: bytes) -> None:
        self.origins.append((uid, start))
        self.held.append("".join(map(self.letters.__getitem__, text.split(b" "))))

    def compile(self) -> None:
        import ahocorasick

        places: dict[str, list[tuple[int, int]]] = {}
        for k, phrase in enumerate(self.held):
            for at, end in probes(len(phrase), self.window):
                places.setdefault(phrase[at:end], []).append((k, at))
        self.automaton = ahocorasick.Automaton()
        for phrase, found in places.items():
            self.automaton.add_word(phrase, (len(phrase), found))
        self.automaton.make_automaton()
        # differences of the number of occurrences that cover a passage's word
        self.seen = [np.zeros(len(phrase) + 1, np.int64) for phrase in self.held]
        # passages that one occurrence covers whole: their own places have nothing more to learn
        self.done = [False] * len(self.held)

    def occurrences(self, uid: int, start: int, text: bytes) -> list[tuple[int, int]]:
        """Intervals of words of a region that agree with a passage over a window or more, elsewhere than where it was taken.

        Of a done passage, those that lie within the others may be left out.
        """
        held, done = self.held, self.done
        ids = "".join(map(self.letters.get, text.split(b" "), repeat(OTHER)))
        n = len(ids)
        reached: dict[tuple[int, int], int] = {}
        low = high = -1  # a run of the region's words that intervals cover
        out = []
        for last, (probe, found) in self.automaton.iter(ids):
            at, end = last - probe + 1, last + 1
            for k, off in found:
                phrase = held[k]
                if done[k] and low <= max(at - off, 0) and min(at - off + len(phrase), n) <= high or reached.get((k, at - off), -1) > last:
                    continue
                back = _agree_back(ids, at, phrase, off, min(at, off))
                on = probe + _agree(ids, end, phrase, off + probe, min(n - end, len(phrase) - off - probe))
                reached[k, at - off] = at + on
                own, begin = self.origins[k]
                if back + on >= self.window and (uid != own or start + at != begin + off):
                    out.append((start + at - back, start + at + on))
                    self.seen[k][off - back] += 1
                    self.seen[k][off + on] -= 1
                    if back == off and off + on == len(phrase):
                        done[k] = True
                    if at - back > high:
                        low, high = at - back, at + on
                    elif at + on >= low:
                        low, high = min(low, at - back), max(high, at + on)
        return out

    def origin_covers(self) -> Iterator[tuple[int, int, int]]:
        """(uid, start, end): what of the passages' own places other occurrences cover."""
        for (uid, start), diff in zip(self.origins, self.seen, strict=True):
            covered = np.concatenate([[0], (np.cumsum(diff[:-1]) > 0).astype(np.int8), [0]])
            edge = np.flatnonzero(np.diff(covered))
            for s, e in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                yield uid, start + s, start + e


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def located(streams: DataFrame, window: int = WINDOW) -> DataFrame:
    """(uid, s, e): covered words. streams: (shard, part, passage, uid, start, text), sorted, a shard's passages before its regions."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tidy(False):
            key, shard = None, Shard(window)
            out: list[tuple[int, int, int]] = []
            for batch in slices(batches, 2048, 4 << 20):
                for k, part, passage, uid, start, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if key != (k, part):
                        if shard.automaton is not None:
                            out += shard.origin_covers()
                        key, shard = (k, part), Shard(window)
                    if passage:
                        shard.add(uid, start, text)
                        continue
                    if shard.automaton is None:
                        shard.compile()
                    out += [(uid, s, e) for s, e in merged(shard.occurrences(uid, start, text))]
                yield rows(out)
                out = []
            if shard.automaton is not None:
                out += shard.origin_covers()
            yield rows(out)

    def rows(out):
        cols = np.array(out, np.int64).reshape(-1, 3)
        return pa.RecordBatch.from_arrays([pa.array(cols[:, k].copy()) for k in range(3)], names=["uid", "s", "e"])

    return streams.select("shard", "part", "passage", "uid", "start", "text").mapInArrow(run, "uid long, s long, e long")


def kept_words(covered: DataFrame) -> DataFrame:
    """(uid, n_removed, left, kept_text): each text without its covered words. covered: (uid, packed, spans)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        with tidy(False):
            for batch in slices(batches, 256, 4 << 20):
                out: list[list] = [[] for _ in range(4)]
                for uid, packed, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    words, keep, at, gone = unpack(packed), [], 0, 0
                    for s, e in merged([(x["s"], x["e"]) for x in spans]):
                        keep += words[at:s]
                        at, gone = e, gone + e - s
                    text = b" ".join(keep + words[at:])
                    for col, x in zip(out, (uid, gone, hashlib.sha256(text).hexdigest(), text.decode()), strict=True):
                        col.append(x)
                kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], names=["uid", "n_removed", "left", "kept_text"])

    return covered.select("uid", "packed", "spans").mapInArrow(run, "uid long, n_removed long, left string, kept_text string")


def remove_passages(docs: DataFrame, window: int = WINDOW, with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 of every document, and kept_text if asked for: words apart by one space.

    window: at least 2 * GRAM words.
    """
    if window < 2 * GRAM:
        raise ValueError(f"a window has {2 * GRAM} words at least")
    rows = text_rows(docs, window)
    classes = written(rows.groupBy("digest").agg(F.count("*").alias("copies"), F.min("uid").alias("uid")), "text-classes")
    # each distinct text once
    anchors = rows.where(F.col("n_words") >= window).select("uid", "anchors", "places").join(classes.select("uid").hint("shuffle_hash"), "uid", "left_semi")
    anchors = written(anchors.select("uid", F.explode(F.arrays_zip("anchors", "places")).alias("x")).select("uid", F.col("x.anchors").alias("anchor"), F.col("x.places").alias("place")), "anchors")
    # written, so that the join with it can split an anchor of very many texts
    twice = written(anchors.groupBy("anchor").agg(F.count("*").alias("n")).where("n > 1").select("anchor"), "anchors-twice")
    hits = written(anchors.join(twice, "anchor"), "recurring-anchors")
    packed = rows.select("uid", "packed")
    found = written(packed.join(hits.groupBy("uid").agg(F.collect_list("place").alias("places"), F.min("anchor").alias("kin")), "uid"), "candidates")
    taken = passages(found.select("uid", "kin", "packed").join(recurring_windows(found, window), "uid"), window)
    sized = written(taken, "passages")
    shards = max(1, -(-(sized.agg(F.sum("words")).first()[0] or 0) // SHARD))
    sized = sharded(sized, shards)
    where = sized.select("shard", F.explode("anchors").alias("anchor")).distinct()
    routes = hits.join(where, "anchor").groupBy("shard", "uid").agg(F.collect_list("place").alias("places"))
    streamed = written(regions(routes.join(found.select("uid", "packed"), "uid"), window), "regions")
    parts = written(streamed.groupBy("shard").agg(F.ceil(F.sum("words") / STREAM).cast("int").alias("parts")), "parts")
    texts = sized.join(parts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(True).alias("passage"), "uid", "start", "text")
    dealt = streamed.join(parts, "shard").select("shard", F.pmod(F.xxhash64("uid", "start"), F.col("parts")).cast("int").alias("part"), F.lit(False).alias("passage"), "uid", "start", "text")
    dealt = texts.unionByName(dealt).repartition("shard", "part").sortWithinPartitions("shard", "part", F.desc("passage"), "uid", "start")
    spans = located(dealt, window).distinct().groupBy("uid").agg(F.collect_list(F.struct("s", "e")).alias("spans"))
    names = ["n_removed", "left"] + ["kept_text"] * with_text
    less = written(kept_words(found.select("uid", "packed").join(spans, "uid")).select("uid", *names), "kept")
    out = rows.join(classes.select("digest", "copies"), "digest").join(less, "uid", "left")
    whole = (F.col("copies") > 1) & (F.col("n_words") >= window)
    nothing = F.lit(hashlib.sha256(b"").hexdigest())
    columns = [F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"), F.when(whole, nothing).otherwise(F.coalesce("left", "kept")).alias("kept_sha256")]
    if with_text:
        columns.append(F.when(whole, F.lit("")).otherwise(F.coalesce("kept_text", unpacked("packed"))).alias("kept_text"))
    return out.select("doc_id", "n_words", *columns)

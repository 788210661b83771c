"""SimHash near-duplicates through covering locality-sensitive hashing.

Fingerprints of 64 bits come from word shingles. For radius r every bit gets a non-zero vector of r + 1 bits; a table for
each non-zero v keeps the bits whose vector has an odd product with v. For any r bits some v is orthogonal to all their
vectors and so keeps none of them: every pair within the radius agrees in at least one of the 2^(r + 1) - 1 tables
(Pagh, 2016). Candidates are distinct fingerprints, so copies never multiply. A bucket's fingerprints are linked by a
search that expands each member once and emits a spanning star, never its pairs; a large bucket is first split by
covering masks over its free bits, which is exact again. Components follow from the edges by distributed steps.

near_duplicates links fingerprints of `words`-word shingles as they are. deduplicate looks for similar texts: candidates
come from four fingerprints of the distinct words, which differ in few bits where texts differ in few words, each within its
radius. Sketches, fingerprints of 256 bits of the distinct `words`-word shingles, tell apart what chance alone brings
together at this radius; they only rule out, with a margin of five standard deviations. What is left is compared by the
shingles themselves: two texts are linked where the Jaccard similarity of these sets is no less than the wanted one.

Null and empty texts have fingerprint zero and are linked like any other. Null ids are kept, but never name a component
unless it has no other. Repeated rows keep a row each. An empty table gives an empty one. Columns may have any name.
"""

from __future__ import annotations

import math
import random

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.llm.common import prepare, shared_name, slices, texts, tidy, written
from tessera.llm.components import connected_components

SEED = 42
SMALL, LARGE, SHINGLES = 8, 2048, 1 << 16
#: Fingerprints of distinct words by which deduplicate looks for candidates.
TRIES = 4
#: Shingles of a component that one search may hold; what has more is searched by the buckets that brought it together.
MOST_SHINGLES = 4 << 20
#: Classes of a component of near fingerprints that one search may hold.
MOST_MEMBERS = 1 << 16
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def fingerprint(raw: bytes, words: int = 3) -> int:
    """The SimHash of a UTF-8 text, as an unsigned number."""
    parts = raw.lower().split()
    if not parts:
        return 0
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) <= words:
        begins, ends = [0], [len(joined)]
    else:
        ends = (np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)) + 1) - 1).tolist()
        begins, ends = [0, *(e + 1 for e in ends[:-words])], ends[words - 1 :]
    ones = np.zeros(64, np.int64)
    for at in range(0, len(begins), SHINGLES):
        hashes = [digest(joined[s:e], SEED) for s, e in zip(begins[at : at + SHINGLES], ends[at : at + SHINGLES], strict=True)]
        h = np.array(hashes, np.uint64).view(np.uint8).reshape(-1, 8)
        ones += np.concatenate([np.bincount(h[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(begins), bitorder="little").view("<u8")[0])


def _majority(h: np.ndarray) -> int:
    """The bits that more than half of the numbers have."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), SHINGLES):
        v = h[at : at + SHINGLES].view(np.uint8).reshape(-1, 8)
        ones += np.concatenate([np.bincount(v[:, k], minlength=256) @ _BITS for k in range(8)])
    return int(np.packbits(2 * ones > len(h), bitorder="little").view("<u8")[0])


def _mix(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers whose bits all depend on all (splitmix64's last steps)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _shingles(h: np.ndarray, words: int) -> np.ndarray:
    """A number for each run of `words` words, or for all words where there are fewer; h: the words' numbers."""
    words = min(words, len(h))
    n = len(h) - words + 1
    out = np.zeros(n, np.uint64)
    for k in range(words):
        out = out * np.uint64(0x100000001B3) + h[k : k + n]
    return _mix(out)


def _prints(numbers: np.ndarray, count: int) -> list[int]:
    """Fingerprints of a set of numbers, each under another permutation of them."""
    return [_majority(_mix(numbers + np.uint64(k * 0x9E3779B97F4A7C15 & (1 << 64) - 1))) for k in range(count)]


def _words(raw: bytes) -> np.ndarray:
    """A number for each word."""
    parts = raw.lower().split()
    return np.fromiter((xxhash.xxh64_intdigest(w, SEED) for w in parts), np.uint64, len(parts))


def shingle_set(raw: bytes, words: int = 5) -> np.ndarray:
    """The distinct `words`-word shingles as sorted signed numbers; none for a text without words."""
    h = _words(raw)
    return np.unique(_shingles(h, words).view(np.int64)) if len(h) else h.view(np.int64)


def sketch(raw: bytes, words: int = 5) -> tuple[int, ...]:
    """Numbers of 64 bits: TRIES fingerprints of the distinct words, and four of the distinct `words`-word shingles."""
    h = _words(raw)
    if not len(h):
        return (0,) * (TRIES + 4)
    return *_prints(np.unique(h), TRIES), *_prints(np.unique(_shingles(h, words)), 4)


def sketch_bits(similarity: float) -> int:
    """How many of a sketch's 256 bits differ on average where two sets of shingles have this Jaccard similarity (and are of one size)."""
    return math.floor(256 * math.acos(2 * similarity / (1 + similarity)) / math.pi)


def loose_bits(similarity: float) -> int:
    """A bound on differing bits that sets of this similarity pass by chance once in millions: the mean and five standard deviations."""
    share = math.acos(2 * similarity / (1 + similarity)) / math.pi
    return math.ceil(256 * share + 5 * math.sqrt(256 * share * (1 - share)))


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """doc_id and fp, the fingerprint as a signed long."""
    prepare(docs.sparkSession)

    def run(batches):
        with tidy():
            for batch in slices(batches, 1024, 8 << 20):
                fps = np.array([fingerprint(x or b"", words) for x in batch.column(1).to_pylist()], np.uint64)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], names=["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.encode(F.col("text").cast("string"), "UTF-8").alias("raw")).mapInArrow(run, f"doc_id {kind}, fp long")


def sketched(docs: DataFrame, words: int = 5) -> tuple[DataFrame, str, str]:
    """docs, all columns, with the sketch as an array of signed longs and a number for the row; written, so both stay; and these columns' names."""
    name, uid = shared_name(docs, "sketch"), shared_name(docs, "uid")
    prepare(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        with tidy():
            for batch in slices(batches, 1024, 8 << 20):
                found = np.array([sketch(x.encode(), words) for x in texts(batch.column(at))], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(list(found), pa.list_(pa.int64()))], names=[*batch.schema.names, name])

    schema = T.StructType([*docs.schema.fields, T.StructField(name, T.ArrayType(T.LongType()))])
    return written(docs.mapInArrow(run, schema).withColumn(uid, F.monotonically_increasing_id()), "sketched"), name, uid


def deduplicate(docs: DataFrame, words: int = 5, similarity: float = 0.8, radius: int = 4) -> DataFrame:
    """One row of docs, all columns, from each component of similar texts: that of the smallest id, null ids last, one of repeated rows.

    Texts of one sketch, all 512 bits, are one class, whose first text stands for it; links join classes. Winners are joined by
    row number, a unique key, so large groups of copies don't gather in one task; they are as many as the groups, so they are
    never broadcast.
    """
    rows, name, uid = sketched(docs, words)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col(uid).alias("uid"))).alias("first")
    classes = rows.groupBy(F.col(name).alias("sketch")).agg(first)
    classes = written(classes.withColumn("node", F.monotonically_increasing_id()), "sketches")
    one_each = rows.select(F.col(uid).alias("uid"), "text")
    labels = connected_components(similar_links(classes, one_each, words, similarity, radius))
    roots = classes.select("node", "first").join(labels, "node", "left").groupBy(F.coalesce("root", "node").alias("root")).agg(F.min("first").alias("first"))
    winners = written(roots.select(F.col("first.uid").alias(uid)), "winners")
    return rows.join(winners.hint("shuffle_hash"), uid, "left_semi").select(*[F.col(f"`{c}`") for c in docs.columns])


def _tried(classes: DataFrame) -> DataFrame:
    """(node, k, fp, sketch): each class of (node, sketch) under each of its fingerprints of words, fp, with those of its shingles.

    All tries go through the tables as one plan: a plan for each would take four times the driver's memory.
    """
    each = classes.select("node", F.posexplode(F.slice("sketch", 1, TRIES)).alias("k", "fp"), F.slice("sketch", TRIES + 1, 4).alias("rest"))
    return each.select("node", "k", "fp", F.concat(F.array("fp"), F.col("rest")).alias("sketch"))


def similar_links(classes: DataFrame, one_each: DataFrame, words: int, similarity: float, radius: int) -> DataFrame:
    """(a, b): links that connect all candidate classes whose texts have the similarity. classes: (node, sketch, first.uid); one_each: (uid, text).

    Candidates are first united by their sketches alone, at the loose bound, so that a text's shingles travel once, to the
    component that it is in. A link is a matter of its two texts alone: some fingerprint of words within the radius, sketches
    within the bound, shingles of the similarity. So every link lies within a component and in a bucket of the covering tables,
    and where components of more than MOST_SHINGLES are searched by these buckets, to each of which the shingles travel, the
    links and what they connect are the same.
    """
    most = loose_bits(similarity)
    prepare(classes.sparkSession)
    loose = connected_components(similar_classes(_tried(classes), radius, most))
    members = loose.join(classes, "node").select(F.col("first.uid").alias("uid"), F.col("root").alias("group"), "node", *[F.col("sketch")[i].alias(f"s{i}") for i in range(TRIES + 4)])
    numbers = [f"s{i}" for i in range(TRIES + 4)]
    texts_of = one_each.join(members.hint("shuffle_hash"), "uid").select("group", "node", *numbers, F.encode("text", "UTF-8").alias("raw"))

    def shingled(batches):
        with tidy():
            for batch in slices(batches, 1024, 8 << 20):
                sets = [shingle_set(x or b"", words) for x in batch.column(batch.num_columns - 1).to_pylist()]
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sets, pa.list_(pa.int64()))], names=[*batch.schema.names[:-1], "own"])

    fields = f"`group` long, node long, {', '.join(f'{n} long' for n in numbers)}, own array<long>"
    sets = written(texts_of.mapInArrow(shingled, fields), "shingles")
    large = sets.groupBy("group").agg(F.sum(F.size("own")).alias("n")).where(F.col("n") > MOST_SHINGLES).select("group")
    large = written(large, "large")
    if large.isEmpty():
        return _verified(sets, radius, most, similarity)
    wide = sets.join(large, "group", "left_semi")
    near = near_classes(_tried(classes.join(wide.select("node"), "node", "left_semi")), radius).select("group", "node").distinct()
    wide = near.join(wide.drop("group"), "node").select(*sets.columns)
    return _verified(sets.join(large, "group", "left_anti"), radius, most, similarity).unionByName(_verified(wide, radius, most, similarity))


def _verified(rows: DataFrame, radius: int, most: int, similarity: float) -> DataFrame:
    """(a, b): links that connect all rows (group, node, the sketch's numbers, own) of a group whose sketches and shingles are near enough."""

    def run(batches):
        with tidy():
            for group, node, *parts, own in _whole_runs(batches):
                sketches = np.stack(parts, axis=1).view(np.uint64)
                cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]]))
                found = [np.zeros((0, 2), np.int64)]
                for s, e in zip(cuts, cuts[1:]):  # noqa: B905
                    found += _spanning(np.arange(s, e), own, sketches, radius, most, similarity)
                e = node[np.concatenate(found)]
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], names=["a", "b"])

    return rows.repartition(F.col("group")).sortWithinPartitions("group", "node").mapInArrow(run, "a long, b long")


def similar_sets(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sorted sets have the Jaccard similarity, in millionths; sets without members are alike."""
    if len(a) > len(b):
        a, b = b, a
    least = round(similarity * 1_000_000)
    if 1_000_000 * len(a) < least * len(b):
        return False
    shared = int((b[np.minimum(np.searchsorted(b, a), len(b) - 1)] == a).sum()) if len(a) else 0
    return 1_000_000 * shared >= least * (len(a) + len(b) - shared)


def _spanning(at: np.ndarray, own: np.ndarray, sketches: np.ndarray, radius: int, most: int, similarity: float) -> list[np.ndarray]:
    """Edges, as places, that span each component of similar sets at some places; a link hangs on its own two sets alone."""
    out, left = [], at
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            i = front.pop()
            differ = np.bitwise_count(sketches[left] ^ sketches[i])
            near = (differ[:, :TRIES] <= radius).any(axis=1) & (differ[:, TRIES:].sum(axis=1) <= most)
            near[near] = [similar_sets(own[j], own[i], similarity) for j in left[near]]
            if near.any():
                front += list(left[near])
                out.append(np.stack([left[near], np.full(int(near.sum()), i)], axis=1))
                left = left[~near]
    return out


def near_classes(classes: DataFrame, radius: int) -> DataFrame:
    """(group, fp, node, s1 to s4): every two classes (node, fp, sketch) whose fingerprints are within the radius are in some group together.

    classes may have k, the number of a try: only fingerprints of one try are compared.
    """
    classes = classes if "k" in classes.columns else classes.withColumn("k", F.lit(0))
    several = classes.groupBy("k", "fp").agg(F.count("*").alias("n")).where("n > 1").select(F.xxhash64("k", "fp").alias("group"), "k", "fp")
    groups = near_groups(classes.select("k", "fp").distinct(), radius).unionByName(several)
    return groups.join(classes, ["k", "fp"]).select("group", "fp", "node", *[F.col("sketch")[k].alias(f"s{k}") for k in range(1, 5)])


def whole_classes(classes: DataFrame, radius: int) -> DataFrame:
    """The same as near_classes, in groups that are components of near fingerprints: a class is in one at most, not in one a table.

    classes has k. A component of more than MOST_MEMBERS classes isn't for one task: near_classes' buckets take its place.
    """
    prints = written(classes.groupBy("k", "fp").agg(F.count("*").alias("n")).withColumn("number", F.xxhash64("k", "fp")), "prints")
    labels = connected_components(near_prints(prints.select("k", "fp"), radius))
    placed = prints.join(labels, prints["number"] == labels["node"], "left").select("k", "fp", F.coalesce("root", "number").alias("group"), "n")
    sizes = placed.groupBy("group").agg(F.sum("n").alias("members")).where("members > 1")
    placed = written(placed.join(sizes, "group"), "print-groups")
    groups = placed.where(F.col("members") <= MOST_MEMBERS).select("group", "k", "fp")
    wide = placed.where(F.col("members") > MOST_MEMBERS)
    copies = wide.where("n > 1").select(F.xxhash64("k", "fp").alias("group"), "k", "fp")
    groups = groups.unionByName(near_groups(wide.select("k", "fp"), radius)).unionByName(copies)
    return groups.join(classes, ["k", "fp"]).select("group", "fp", "node", *[F.col("sketch")[k].alias(f"s{k}") for k in range(1, 5)])


def similar_classes(classes: DataFrame, radius: int, most: int) -> DataFrame:
    """(a, b): links that connect all classes (node, fp, sketch) whose fingerprints are within the radius and sketches within `most` bits.

    Both conditions hold for each step of the search in a bucket, so no link hangs on which others were found. Sketches travel
    only to groups where fingerprints are near, each to one unless that is too large for a task.
    """
    rows = whole_classes(classes if "k" in classes.columns else classes.withColumn("k", F.lit(0)), radius)

    def run(batches):
        with tidy():
            for group, fp, node, *parts in _whole_runs(batches):
                e = node[run_edges(group, fp.view(np.uint64), radius, np.stack(parts, axis=1).view(np.uint64), most)]
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], names=["a", "b"])

    return rows.repartition(F.col("group")).sortWithinPartitions("group", "fp", "node").mapInArrow(run, "a long, b long")


def covering_masks(bits: list[int], radius: int) -> list[int]:
    """Masks over the given bit numbers; any two values that differ in at most `radius` of them agree under some mask."""
    n = (1 << (radius + 1)) - 1
    # where there are more vectors than bits, an even choice of them: so each mask keeps about half of the bits
    order = random.Random(radius).sample(range(n), n) if n > len(bits) else range(n)
    vector = {b: order[i % n] + 1 for i, b in enumerate(bits)}
    return [sum(1 << b for b in bits if (vector[b] & v).bit_count() % 2) for v in range(1, n + 1)]


def _star(at: np.ndarray, fps: np.ndarray, radius: int, sketches: np.ndarray | None, most: int) -> list[np.ndarray]:
    """Edges, as places, that span each component of the values at some places: each value with the one that reached it."""
    out, left = [], at
    while len(left) > 1:
        front, left = [left[0]], left[1:]
        while front and len(left):
            i = front.pop()
            near = np.bitwise_count(fps[left] ^ fps[i]) <= radius
            if sketches is not None:
                near[near] = np.bitwise_count(sketches[left[near]] ^ sketches[i]).sum(axis=1) <= most
            if near.any():
                front += list(left[near])
                out.append(np.stack([left[near], np.full(int(near.sum()), i)], axis=1))
                left = left[~near]
    return out


def bucket_edges(at: np.ndarray, fps: np.ndarray, radius: int, sketches: np.ndarray | None = None, most: int = 0) -> list[np.ndarray]:
    """Edges, as places, among the values of one bucket. Where a mask leaves over half of them together, they are dense, and one search is cheaper."""
    differ = int(np.bitwise_or.reduce(fps[at] ^ fps[at[0]]))
    if len(at) <= LARGE or not differ:
        return _star(at, fps, radius, sketches, most)
    out = []
    for mask in covering_masks([b for b in range(64) if differ >> b & 1], radius):
        key = fps[at] & np.uint64(mask)
        order = np.argsort(key, kind="stable")
        cuts = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1], [True]]))
        if 2 * int(np.diff(cuts).max()) > len(at):
            return _star(at, fps, radius, sketches, most)
        for s, e in zip(cuts, cuts[1:]):  # noqa: B905
            if e - s > 1:
                out += bucket_edges(at[order[s:e]], fps, radius, sketches, most)
    return out


def run_edges(key: np.ndarray, fp: np.ndarray, radius: int, sketches: np.ndarray | None = None, most: int = 0) -> np.ndarray:
    """Edges within runs of equal keys, as pairs of places."""
    new = np.concatenate([[True], key[1:] != key[:-1]])
    start = np.flatnonzero(new)
    size = np.diff(np.append(start, len(key)))
    of = np.repeat(size, size)
    found = [np.zeros((0, 2), np.int64)]
    small = np.flatnonzero((of > 1) & (of <= SMALL))
    for d in range(1, SMALL):
        i, j = small[d:], small[:-d]
        hit = (key[i] == key[j]) & (np.bitwise_count(fp[i] ^ fp[j]) <= radius)
        i, j = i[hit], j[hit]
        if sketches is not None:
            hit = np.bitwise_count(sketches[i] ^ sketches[j]).sum(axis=1) <= most
            i, j = i[hit], j[hit]
        found.append(np.stack([i, j], axis=1))
    for i in np.flatnonzero(size > SMALL):
        found += bucket_edges(np.arange(start[i], start[i] + size[i]), fp, radius, sketches, most)
    return np.concatenate(found)


def _whole_runs(batches):
    """The columns of sorted batches as arrays, cut only between values of the first column."""
    rest = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if rest:
            columns = [np.concatenate(both) for both in zip(rest, columns, strict=True)]
        k = columns[0]
        # the last run may go on in the next batch
        cut = int(np.searchsorted(k, k[-1]))
        if cut:
            yield [c[:cut] for c in columns]
        rest = [c[cut:] for c in columns]
    if rest:
        yield rest


def _tables(distinct: DataFrame, radius: int) -> DataFrame:
    """(key, fp) and k, if there is such a column, sorted by key and fp: each fingerprint under its key in each covering table, whole keys in one partition."""
    prepare(distinct.sparkSession)
    masks = [m - (1 << 64) if m >> 63 else m for m in covering_masks(list(range(64)), radius)]
    of = [c for c in distinct.columns if c == "k"]
    keys = F.array(*[F.xxhash64(*of, F.lit(t), F.col("fp").bitwiseAND(F.lit(m).cast("long"))) for t, m in enumerate(masks)])
    keyed = distinct.select(F.explode(keys).alias("key"), "fp", *of)
    return keyed.repartition(F.col("key")).sortWithinPartitions("key", "fp")


def near_edges(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """(a, b): edges between distinct fingerprints (column fp) that connect all pairs within the radius."""

    def run(batches):
        with tidy():
            for key, fp in _whole_runs(batches):
                e = np.unique(fp[run_edges(key, fp.view(np.uint64), radius)], axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0].copy()), pa.array(e[:, 1].copy())], names=["a", "b"])

    return _tables(distinct, radius).mapInArrow(run, "a long, b long")


def near_prints(distinct: DataFrame, radius: int) -> DataFrame:
    """(a, b): edges between distinct fingerprints (k, fp), by their hashes, that connect all pairs of one k within the radius."""

    def run(batches):
        with tidy():
            for key, fp, k in _whole_runs(batches):
                at = run_edges(key, fp.view(np.uint64), radius)
                e = np.unique(np.stack([k[at[:, 0]].astype(np.int64), fp[at[:, 0]], fp[at[:, 1]]], axis=1), axis=0)
                yield pa.RecordBatch.from_arrays([pa.array(e[:, 0].astype(np.int32)), pa.array(e[:, 1].copy()), pa.array(e[:, 2].copy())], names=["k", "a", "b"])

    found = _tables(distinct, radius).mapInArrow(run, "k int, a long, b long")
    return found.select(F.xxhash64("k", "a").alias("a"), F.xxhash64("k", "b").alias("b"))


def near_groups(distinct: DataFrame, radius: int) -> DataFrame:
    """(group, k, fp): every two distinct fingerprints (k, fp) of one k that are within the radius are in some group together.

    A group is what a bucket has of fingerprints with another near it; its number comes from its members, so that tables which
    bring the same ones together give one group.
    """

    def run(batches):
        with tidy():
            for key, fp, k in _whole_runs(batches):
                at = np.unique(run_edges(key, fp.view(np.uint64), radius))
                _, of = np.unique(key[at], return_inverse=True)
                total = np.zeros(len(at), np.uint64)
                np.add.at(total, of, _mix(fp[at].view(np.uint64) ^ _mix(k[at].astype(np.uint64) + np.uint64(1))))
                yield pa.RecordBatch.from_arrays([pa.array(total[of].view(np.int64)), pa.array(k[at]), pa.array(fp[at])], names=["group", "k", "fp"])

    return _tables(distinct, radius).mapInArrow(run, "group long, k int, fp long").distinct()


def near_duplicates(docs: DataFrame, words: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits) and component_id, the smallest document id reachable by links."""
    prints = written(fingerprints(docs, words), "fingerprints")
    classes = prints.groupBy("fp").agg(F.min("doc_id").alias("least"))
    labels = connected_components(near_edges(classes.select("fp"), radius))
    joined = classes.join(labels.select(F.col("node").alias("fp"), "root"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    roots = joined.where("root <> fp OR least IS NOT NULL").groupBy("root").agg(F.min("least").alias("component_id"))
    named = written(joined.join(roots, "root").select("fp", "component_id"), "classes")
    hexed = F.lpad(F.lower(F.hex("fp")), 16, "0")
    return prints.join(named, "fp", "left").select("doc_id", hexed.alias("fingerprint"), "component_id")

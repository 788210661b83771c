import random
import re
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessera.llm import components, embed_dedup, queries, simhash
from tessera.llm.common import written
from tessera.llm.components import connected_components


def brute_print(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(s.encode(), 42) for s in ([" ".join(w[i : i + 3]) for i in range(len(w) - 2)] or [" ".join(w)])]
    return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in h) > len(h))


def classes(n, linked):
    root = list(range(n))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, j in linked:
        root[max(find(i), find(j))] = min(find(i), find(j))
    return [find(i) for i in range(n)]


def brute_components(ids, prints):
    n = len(ids)
    roots = classes(n, [(i, j) for i, j in combinations(range(n), 2) if (prints[i] ^ prints[j]).bit_count() <= 3])
    least = {}
    for i, r in enumerate(roots):
        if ids[i] is not None:
            least[r] = min(least.get(r, ids[i]), ids[i])
    return [least.get(r) for r in roots]


def brute_sketch(text, words=5):
    """The candidate fingerprints and the sketch with Python's own numbers, bit by bit."""
    full = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & full
        x = (x ^ x >> 27) * 0x94D049BB133111EB & full
        return x ^ x >> 31

    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not w:
        return [0] * 4, 0
    h = [xxhash.xxh64_intdigest(x.encode(), 42) for x in w]

    def shingles(n):
        n = min(n, len(h))
        out = []
        for i in range(len(h) - n + 1):
            v = 0
            for x in h[i : i + n]:
                v = (v * 0x100000001B3 + x) & full
            out.append(mix(v))
        return out

    def majority(v):
        return sum(1 << k for k in range(64) if 2 * sum(x >> k & 1 for x in v) > len(v))

    def prints(numbers):
        return [majority([mix((x + k * 0x9E3779B97F4A7C15) & full) for x in numbers]) for k in range(4)]

    return prints(set(h)), sum(v << 64 * k for k, v in enumerate(prints(set(shingles(words)))))


def exact_shingles(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + words]) for i in range(max(1, len(w) - words + 1))}


def brute_similar(ids, texts):
    """The smallest id of each component, by the shingles of all pairs as words."""
    s = [exact_shingles(t) for t in texts]
    near = [(i, j) for i, j in combinations(range(len(s)), 2) if 5 * len(s[i] & s[j]) >= 4 * len(s[i] | s[j])]
    roots, least = classes(len(s), near), {}
    for i, r in enumerate(roots):
        least[r] = min((v for v in (least.get(r), ids[i]) if v is not None), default=None)
    return list(least.values())


def test_sketches_and_similarity():
    rng = random.Random(2)
    word = [f"w{i}" for i in range(5000)]
    close = far = 0
    for _ in range(60):
        a = [rng.choice(word) for _ in range(300)]
        b = list(a)
        for _ in range(4):
            b[rng.randrange(300)] = rng.choice(word)
        c = [rng.choice(word) for _ in range(300)]
        x, y, z = (simhash.sketch(" ".join(t).encode()) for t in (a, b, c))
        assert (list(x[:4]), sum(v << 64 * k for k, v in enumerate(x[4:]))) == brute_sketch(" ".join(a))
        bits = [sum((p ^ q).bit_count() for p, q in zip(x[4:], o[4:], strict=True)) for o in (y, z)]
        close, far = close + (bits[0] <= simhash.sketch_bits(0.8)), far + (bits[1] <= simhash.sketch_bits(0.8))
    assert close >= 57 and far == 0 and simhash.sketch_bits(1.0) == 0


def test_wide_masks_lose_no_pair():
    masks, rng = simhash.covering_masks(list(range(64)), 6), random.Random(1)
    assert len(masks) == 127 and min(m.bit_count() for m in masks) >= 16
    for _ in range(3000):
        d = sum(1 << b for b in rng.sample(range(64), 6))
        assert any(not d & m for m in masks)


def test_near_copies_go(spark, no_docs):
    """Copies with a few other words go, unlike texts stay; of each group the smallest id."""
    rng, rows = random.Random(5), []
    word = [f"w{i}" for i in range(3000)]
    for g in range(12):
        text = [rng.choice(word) for _ in range(200)]
        for k in range(6):
            own = list(text)
            for _ in range(k % 3):
                own[rng.randrange(200)] = rng.choice(word)
            rows.append((g * 10 + k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    kept = sorted(r.doc_id for r in simhash.deduplicate(docs).collect())
    assert kept == sorted(brute_similar([r[0] for r in rows], [r[1] for r in rows]))
    # of the 60 copies, of similarity 0.9 or more, at least 0.85 go
    assert len(kept) <= 12 + 9 and {g * 10 for g in range(12)} <= set(kept)


def test_similar_texts_by_all_pairs(spark, monkeypatch):
    """Texts around the similarity of 0.8: only exact links, nearly all of them, and the same by buckets as by whole components."""
    rng, rows = random.Random(9), []
    word = [f"w{i}" for i in range(4000)]
    for g in range(40):
        text = [rng.choice(word) for _ in range(rng.choice((60, 150, 400)))]
        for k in range(5):
            own = list(text)
            for _ in range(rng.randrange(1 + len(text) // 35)):
                own[rng.randrange(len(own))] = rng.choice(word)
            rows.append((g * 10 + k, " ".join(own)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets, of = [exact_shingles(t) for _, t in rows], {i: n for n, (i, _) in enumerate(rows)}
    pairs = [(i, j) for i, j in combinations(range(len(rows)), 2) if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])]
    with_partner = len(rows) - len(set(classes(len(rows), pairs)))
    seen = []
    for most in (simhash.MOST_SHINGLES, 100):
        monkeypatch.setattr(simhash, "MOST_SHINGLES", most)
        seen.append({r.doc_id for r in simhash.deduplicate(docs).collect()})
    assert seen[0] == seen[1]
    gone = [of[i] for i, _ in rows if i not in seen[0]]
    assert all(any(n in p for p in pairs) for n in gone)
    assert 40 < with_partner and 0.95 * with_partner <= len(gone) <= with_partner


def test_a_link_hangs_on_its_two_texts_alone(spark, monkeypatch):
    """Alike texts whose fingerprints are far apart aren't linked by a third text that is near both, in components of any size."""
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(0, text, 0), (1, text + " end", 0xFF), (2, "other words", 0x0F), (3, text, 0x1FF << 40), (4, text + " end", 0x1FE << 40)]
    one_each = spark.createDataFrame([r[:2] for r in rows], "uid long, text string")
    classes_of = spark.createDataFrame([(n, [fp] * 4 + [0] * 4, (n,)) for n, _, fp in rows], "node long, sketch array<long>, first struct<uid: long>")
    for most in (simhash.MOST_SHINGLES, 10, 0):
        monkeypatch.setattr(simhash, "MOST_SHINGLES", most)
        links = simhash.similar_links(classes_of, one_each, 5, 0.8, 4).collect()
        assert {tuple(sorted(e)) for e in links} == {(3, 4)}


def test_similar_sets_are_exact():
    a = np.arange(10)
    assert simhash.similar_sets(a[:8], a, 0.8) and not simhash.similar_sets(a[:7], a, 0.8)
    assert simhash.similar_sets(a[:9], a[1:], 0.8) and not simhash.similar_sets(a[:9], a[2:], 0.8)
    assert simhash.similar_sets(a[:0], a[:0], 0.8) and not simhash.similar_sets(a[:0], a, 0.8)


def test_covering_masks_lose_no_pair():
    masks = simhash.covering_masks(list(range(64)), 3)
    for n in (1, 2, 3):
        for bits in combinations(range(64), n):
            d = sum(1 << b for b in bits)
            assert any(not d & m for m in masks)


def test_fingerprint_in_parts(monkeypatch):
    monkeypatch.setattr(simhash, "SHINGLES", 5)
    for t in ("", "a", "a b", "a b c", "A b c d", "x y " * 40, "é É ß word " * 9):
        assert simhash.fingerprint(t.encode()) == brute_print(t)


def test_buckets_split_exactly(monkeypatch):
    rng = random.Random(3)
    pool = [rng.getrandbits(64)]
    for _ in range(3000):
        x = rng.choice(pool[-60:])
        for _ in range(rng.randint(1, 5)):
            x ^= 1 << rng.randrange(40)
        pool.append(x)
    fps = np.array(sorted(set(pool)), np.uint64)
    at = np.arange(len(fps))

    def found(edges):
        return classes(len(fps), [pair for e in edges for pair in e.tolist()])

    whole = found(simhash._star(at, fps, 3, None, 0))
    monkeypatch.setattr(simhash, "LARGE", 64)
    assert found(simhash.bucket_edges(at, fps, 3)) == whole


def near_classes(n, seed=5):
    """Fingerprints and sketches that drift from one another; many near in one are far in the other, many fingerprints are equal."""
    rng = random.Random(seed)
    made = [(rng.getrandbits(64), [rng.getrandbits(64) for _ in range(4)])]
    while len(made) < n:
        fp, sketch = rng.choice(made[-40:])
        for _ in range(rng.choice((0, 0, 1, 3, 5))):
            fp ^= 1 << rng.randrange(64)
        sketch = list(sketch)
        for _ in range(rng.randint(10, 50)):
            sketch[rng.randrange(4)] ^= 1 << rng.randrange(64)
        made.append((fp, sketch))
    return made


def similar_links(made, radius, most):
    def far(a, b):
        return (a[0] ^ b[0]).bit_count() > radius or sum((x ^ y).bit_count() for x, y in zip(a[1], b[1], strict=True)) > most

    return [(i, j) for i, j in combinations(range(len(made)), 2) if not far(made[i], made[j])]


def test_search_by_two_conditions(monkeypatch):
    made = near_classes(700)
    links = similar_links(made, 6, 38)
    near = similar_links(made, 6, 256)
    assert len(links) < len(near) / 2 and classes(len(made), links) != classes(len(made), near)
    fps, sketches, key = np.array([m[0] for m in made], np.uint64), np.array([m[1] for m in made], np.uint64), np.zeros(len(made), np.int64)
    for large in (2048, 400, 32):
        monkeypatch.setattr(simhash, "LARGE", large)
        edges = simhash.run_edges(key, fps, 6, sketches, 38)
        assert set(map(tuple, np.sort(edges, axis=1).tolist())) <= set(links)
        assert classes(len(made), edges.tolist()) == classes(len(made), links)
    few = simhash.run_edges(np.arange(len(made)) // 5, fps, 6, sketches, 38)
    assert sorted(map(tuple, np.sort(few, axis=1).tolist())) == [(i, j) for i, j in links if i // 5 == j // 5]


def test_similar_classes_lose_no_link(spark):
    made = near_classes(400, 6)
    whole = classes(len(made), similar_links(made, 6, 38))
    signed = [(i, *np.array([fp, *sketch], np.uint64).view(np.int64).tolist()) for i, (fp, sketch) in enumerate(made)]
    held = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        for partitions in ("1", "32"):
            spark.conf.set("spark.sql.shuffle.partitions", partitions)
            rows = spark.createDataFrame([(i, fp, [fp, *s]) for i, fp, *s in signed], "node long, fp long, sketch array<long>")
            found = simhash.similar_classes(rows, 6, 38).collect()
            assert classes(len(made), [(r.a, r.b) for r in found]) == whole
        assert not simhash.similar_classes(rows.limit(0), 6, 38).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", held)


def test_a_class_travels_to_one_group(spark, monkeypatch):
    """A large group of near classes doesn't send each of them to every table; where it is too large for a task, no link is lost."""
    made = near_classes(300, 8)
    whole = classes(len(made), similar_links(made, 6, 38))
    signed = [np.array([fp, *sketch], np.uint64).view(np.int64).tolist() for fp, sketch in made]
    rows = spark.createDataFrame([(i, 0, s[0], s) for i, s in enumerate(signed)], "node long, k int, fp long, sketch array<long>")
    placed = simhash.whole_classes(rows, 6).select("node").collect()
    assert len(placed) == len({r.node for r in placed}) > 200
    for most in (1 << 16, 50, 1):
        monkeypatch.setattr(simhash, "MOST_MEMBERS", most)
        found = simhash.similar_classes(rows, 6, 38).collect()
        assert classes(len(made), [(r.a, r.b) for r in found]) == whole


def test_all_tries_in_one_plan(spark):
    """The fingerprints of a text go through one set of tables: the plan doesn't grow with their number."""
    classes_of = spark.createDataFrame([(n, [n, 1 << 20, 7 * n, 1 << 40 + n] + [0] * 4) for n in range(9)], "node long, sketch array<long>")
    found = simhash.similar_classes(simhash._tried(classes_of), 4, 38)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 2
    # the second fingerprint is one for all, and only fingerprints of one try are compared
    assert classes(9, [(r.a, r.b) for r in found.collect()]) == [0] * 9
    apart = classes_of.where("node in (3, 5)").select("node", F.expr("transform(sketch, (x, i) -> if(i < 4, shiftleft(1023L, cast(10 * ((node + i) % 4) as int)), 0L))").alias("sketch"))
    assert not simhash.similar_classes(simhash._tried(apart), 4, 38).collect()


def test_simhash_query(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    ids, prints = [d.doc_id for d in docs], [brute_print(d.text) for d in docs]
    want = {i: (f"{p:016x}", c) for i, p, c in zip(ids, prints, brute_components(ids, prints), strict=True)}
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in queries.op4_simhash_dedup(spark, sf).collect()} == want


def test_simhash_odd_rows(spark, odd_docs, no_docs):
    rows = odd_docs.collect()
    ids, prints = [r.doc_id for r in rows], [brute_print(r.text) for r in rows]
    comps = brute_components(ids, prints)
    want = sorted(map(str, zip(ids, (f"{p:016x}" for p in prints), comps, strict=True)))
    assert sorted(map(str, ((r.doc_id, r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd_docs).collect()))) == want
    kept = simhash.deduplicate(odd_docs)
    assert kept.dtypes == odd_docs.dtypes
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, brute_similar(ids, [r.text for r in rows])))
    assert simhash.near_duplicates(no_docs).count() == 0 and simhash.deduplicate(no_docs).count() == 0


def test_components_take_few_tables(spark, monkeypatch):
    """Contracted edges give the same components, whatever a task holds; where a task holds all, two tables are enough."""
    rng, tables = random.Random(4), []
    pairs = [(rng.randrange(3000), rng.randrange(3000)) for _ in range(2200)] + [(i, i + 1) for i in range(4000, 4900)] + [(7, 7), (None, 3), (8, None)]
    real = [p for p in pairs if None not in p]
    nodes = {n for a, b in real if a != b for n in (a, b)}
    want = {n: r for n, r in enumerate(classes(5000, real)) if n in nodes}
    edges = spark.createDataFrame(pairs, "a long, b long").repartition(6)
    monkeypatch.setattr(components, "written", lambda df, name: tables.append(name) or written(df, name))
    for most, least, bound in ((1 << 18, 1, 2), (100, 3, 60)):
        monkeypatch.setattr(components, "EDGES", most)
        tables.clear()
        got = connected_components(edges).collect()
        assert len(got) == len(want) and {r.node: r.root for r in got} == want
        assert least <= len(tables) <= bound


def test_components_of_a_path(spark):
    n = 60
    edges = spark.range(n - 1).select(((F.col("id") * 37) % n).alias("a"), (((F.col("id") + 1) * 37) % n).alias("b"))
    assert {r.root for r in connected_components(edges).collect()} == {0}
    assert connected_components(edges.limit(0)).count() == 0


def brute_links(vectors):
    x = [None if v is None or not len(v) or any(c is None or not np.isfinite(c) for c in v) or not np.any(v) else np.array(v, np.float64) for _, v in vectors]
    n = len(x)
    linked = [(i, j) for i, j in combinations(range(n), 2) if x[i] is not None and x[j] is not None and len(x[i]) == len(x[j]) and vectors[i][0] is not None and vectors[j][0] is not None and x[i] @ x[j] / np.sqrt((x[i] @ x[i]) * (x[j] @ x[j])) >= 0.9]
    roots = classes(n, linked)
    links = np.zeros(n, int)
    for i, j in linked:
        links[i] += 1
        links[j] += 1
    least = {}
    for i, r in enumerate(roots):
        least[r] = min((v for v in (least.get(r), vectors[i][0]) if v is not None), default=None)
    return sorted(map(str, ((vectors[i][0], int(links[i]), least[roots[i]], None if vectors[i][0] is None else vectors[i][0] == least[roots[i]]) for i in range(n))))


def own_links(df):
    return sorted(map(str, ((r.vec_id, r.n_links, r.component_id, r.kept) for r in df.collect())))


def test_embedding_query(spark, sf):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert own_links(queries.op5_embedding_dedup(spark, sf)) == brute_links(rows)


def test_embedding_clusters(spark, monkeypatch):
    monkeypatch.setattr(embed_dedup, "BLOCK", 8)
    rng = np.random.default_rng(7)
    rows = []
    for _ in range(6):
        centre = rng.normal(size=16)
        rows += [(centre + rng.normal(size=16) * 0.25).tolist() for _ in range(40)]
    rows += rows[:5] * 3
    vectors = list(enumerate(rows))
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert own_links(embed_dedup.near_duplicates(df)) == brute_links(vectors)


def test_embedding_odd_rows(spark):
    vectors = [(1, None), (2, []), (3, [0.0, 0.0]), (4, [1.0, None]), (5, [1.0, float("nan")]), (6, [1.0, 2.0]), (7, [2.0, 4.0]), (8, [1.0, 2.0, 3.0]), (9, [1.0, 2.0]), (None, [1.0, 2.0]), (10, [-1.0, 2.0]), (9, [1.0, 2.0])]
    df = spark.createDataFrame([(*v, "a", 1) for v in vectors], "vec_id long, embedding array<double>, `key` string, n int")
    assert own_links(embed_dedup.near_duplicates(df)) == brute_links(vectors)
    assert embed_dedup.near_duplicates(df.limit(0)).count() == 0


def test_embedding_repeated_ids(spark):
    """One id may stand for two vectors, in one component or in two."""
    vectors = [(5, [1.0, 0.0, 0.0]), (5, [0.0, 1.0, 0.0]), (7, [1.0, 0.01, 0.0]), (9, [0.0, 1.0, 0.01]), (5, [1.0, 0.0, 0.0]), (4, [0.0, 0.0, 1.0])]
    df = spark.createDataFrame(vectors, "vec_id long, embedding array<double>")
    assert own_links(embed_dedup.near_duplicates(df)) == brute_links(vectors)


def test_embedding_planted_pairs(spark):
    """Lone pairs just above the threshold among random vectors, whatever the number of partitions."""
    rng = np.random.default_rng(12)
    n, pairs, dim = 6000, 500, 64
    x = rng.standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    y = rng.standard_normal((pairs, dim))
    y -= (y * x[:pairs]).sum(1)[:, None] * x[:pairs]
    cosine = rng.uniform(0.9005, 0.92, pairs)[:, None]
    x = np.concatenate([x, cosine * x[:pairs] + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1)[:, None]])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    old, seen = spark.conf.get("spark.sql.shuffle.partitions"), []
    try:
        for parts in (8, 200):
            spark.conf.set("spark.sql.shuffle.partitions", parts)
            got = {r.vec_id: r for r in embed_dedup.near_duplicates(df).collect()}
            seen.append(sum(got[n + i].component_id == i for i in range(pairs)))
            assert all(r.n_links == (1 if i < pairs or i >= n else 0) or r.n_links == 0 for i, r in got.items())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    assert seen[0] == seen[1] >= 0.99 * pairs


def test_embedding_tables_follow_the_size():
    agree = 1 - np.arccos(0.9) / np.pi
    for n in (1, 512, 513, 50_000, 500_000, 5_000_000, 50_000_000, 10**9):
        bits, tables = embed_dedup.tables_for(n)
        assert n / 2**bits <= embed_dedup.BUCKET and (1 - agree**bits) ** tables <= embed_dedup.MISS


def test_embedding_dense_below_threshold(spark):
    """Pairs at 0.9 in a crowd whose members are at 0.8 to each other, which nothing links."""
    rng = np.random.default_rng(5)
    n, pairs, dim = 8000, 400, 64
    centre = np.eye(dim)[0]

    def off(x, cosine):
        y = rng.standard_normal(x.shape)
        y[:, 0] = 0
        y -= (y * x).sum(1)[:, None] * x / (x * x).sum(1)[:, None]
        return cosine * x + (1 - cosine**2) ** 0.5 * y / np.linalg.norm(y, axis=1)[:, None]

    x = off(np.tile(centre, (n, 1)), 0.8**0.5)
    x = np.concatenate([x, off(x[:pairs], 0.905)])
    x /= np.linalg.norm(x, axis=1)[:, None]
    want = (x @ x.T >= 0.9).sum(1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = np.array([r.n_links for r in embed_dedup.near_duplicates(df).orderBy("vec_id").collect()])
    print(want.sum(), got.sum())
    assert (got <= want).all() and got.sum() >= 0.99 * want.sum() > 0


def test_embedding_passes_on_a_small_table(spark, sf, monkeypatch):
    """With runs of 16 vectors wanted, a small table takes several passes too, and loses no link of the given vectors."""
    monkeypatch.setattr(embed_dedup, "BUCKET", 16)
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf}/embeddings.parquet").collect()]
    assert embed_dedup.tables_for(len(rows))[1] > 5
    assert own_links(queries.op5_embedding_dedup(spark, sf)) == brute_links(rows)

"""Repeated phrases against all pairs of windows; the audits of sources and of filters against plain loops."""

import hashlib
import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessera.llm import filter_audit, phrase_dedup, queries, source_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute_passages(docs, window=35):
    """docs: (doc_id, text). Every window is held against all others."""
    words = [WORD.findall(t or "") for _, t in docs]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, _), w in zip(docs, words, strict=True):
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((doc_id, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest(), kept))
    return Counter(out)


def planted(seed=5):
    rng = random.Random(seed)
    vocabulary = [f"w{k}é"[: rng.randint(2, 6)] for k in range(60)] + ["naïve", "漢字", "😀", "\x00", "…"]
    say = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passages = [say(n) for n in (34, 35, 36, 52, 53, 70, 200, 4200)]
    docs = []
    for k in range(120):
        own = say(rng.choice([0, 3, 34, 35, 60, 300]))
        for p in rng.sample(passages, rng.choice([0, 0, 1, 2])):
            s = rng.randrange(0, max(1, len(p) - 34))
            e = rng.randrange(s, len(p)) + 1
            at = rng.randrange(0, len(own) + 1)
            own[at:at] = p[s:e]
        docs.append((k, rng.choice([" ", "\n", "\t "]).join(own)))
    docs += [(200 + k, docs[7][1]) for k in range(5)] + [(300, " ".join(["same"] * 400)), (301, " ".join(["ab", "cd"] * 40)), (302, "x " * 34), (7, docs[7][1])]
    return docs + [(400, None), (401, ""), (None, docs[9][1]), (402, " \t ")]


@pytest.mark.parametrize("size", [64, 200_000])
def test_passages(spark, monkeypatch, size):
    monkeypatch.setattr(phrase_dedup, "SHARD", size)  # many shards, or one
    docs = planted()
    rows = spark.createDataFrame(docs, "doc_id long, text string").repartition(5)
    got = phrase_dedup.remove_passages(rows, 35, with_text=True).collect()
    assert Counter(map(tuple, (r[:3] + (r.kept_sha256, r.kept_text) for r in got))) == brute_passages(docs)


def test_passages_of_odd_documents(spark, odd_docs, no_docs):
    got = phrase_dedup.remove_passages(odd_docs).collect()
    want = brute_passages([(r.doc_id, r.text) for r in odd_docs.select("doc_id", "text").collect()])
    assert Counter(map(tuple, got)) == Counter({k[:4]: n for k, n in want.items()})
    assert phrase_dedup.remove_passages(no_docs).count() == 0


def test_passage_query(spark, sf):
    docs = [(r.doc_id, r.text) for r in queries.table(spark, sf, "documents").select("doc_id", "text").collect()]
    got = Counter(map(tuple, queries.op11_repeated_phrases(spark, sf).collect()))
    assert got == Counter({k[:4]: n for k, n in brute_passages(docs).items()})
    assert sum(r[2] for r in got) > 0


def test_anchors_and_hashes():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 5, 300).astype(np.uint64)
    for size in (1, 12, 35):
        got = phrase_dedup.phrase_hashes(h, size)
        runs = [tuple(h[i : i + size]) for i in range(len(h) - size + 1)]
        assert len(got) == len(runs) and len(set(got.tolist())) == len(set(runs))
    grams = phrase_dedup.phrase_hashes(h, 12)
    assert phrase_dedup.window_anchors(grams).tolist() == [i + int(np.argmin(grams[i : i + 24])) for i in range(len(grams) - 23)]


def test_a_passage_alone_removes_nothing():
    shard = phrase_dedup.Shard(35)
    shard.add(1, 0, b" ".join(b"%d" % k for k in range(80)))
    shard.compile()
    assert shard.occurrences(1, 0, b" ".join(b"%d" % k for k in range(80))) == []
    assert shard.occurrences(2, 4, b"x " + b" ".join(b"%d" % k for k in range(10, 50))) == [(5, 45)]
    assert list(shard.origin_covers()) == [(1, 10, 50)]


# --- sources ---------------------------------------------------------------------------------------------------------


def brute_sources(docs, least, ranks):
    """docs: (text, lang, source)."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    counts, df = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        found = term.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        counts[lang or "", source or ""].update(found)
        df[lang or ""].update(set(found))
    out = set()
    for lang in df:
        kept = [t for t, n in df[lang].items() if n >= least]
        groups = {s: c for (x, s), c in counts.items() if x == lang}
        whole = sum(groups.values(), Counter())

        def share(c):
            total = sum(c[t] for t in kept) + 5 * len(kept)
            return {t: 1 + 1_000_000_000 * (c[t] + 5) // total for t in kept}  # noqa: B023

        p, q = {s: share(c) for s, c in groups.items()}, share(whole)
        for s in groups:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in groups if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if groups[s][t] and p[s][t] > q[t]]
            for part, items, most in (("pair", pairs, None), ("term", terms, ranks)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out |= {(lang, s, part, i, v, k + 1) for k, (i, v) in enumerate(items)}
    return out


def test_sources(spark, odd_docs, no_docs, monkeypatch):
    rng = random.Random(3)
    terms = [f"t{k}".replace("1", "A").replace("2", "é").translate(str.maketrans("03456789", "bcdfghij")) for k in range(90)] + ["ßÜ", "漢"]
    rows = [(" 9-".join(rng.choices(terms, k=rng.randrange(0, 40))), rng.choice(["en", "de", None, ""]), rng.choice(["a", "b", "c", None, "é"])) for _ in range(300)]
    rows += [("", "xx", "a"), (None, "xx", "b"), ("One Two", "yy", "a")]
    frame = spark.createDataFrame(rows, "text string, lang string, source string").repartition(4)
    want = brute_sources(rows, 12, 7)
    assert {tuple(r) for r in source_audit.audit_sources(frame, 12, 7).collect()} == want and any(r[2] == "term" for r in want)
    monkeypatch.setattr(source_audit, "PAIRS", 3)
    monkeypatch.setattr(source_audit, "CHUNK", 20)
    assert {tuple(r) for r in source_audit.audit_sources(frame, 12, 7).collect()} == want
    odd = [tuple(r) for r in odd_docs.select("text", "lang", "source").collect()]
    assert {tuple(r) for r in source_audit.audit_sources(odd_docs, 2, 50).collect()} == brute_sources(odd, 2, 50)
    assert source_audit.audit_sources(no_docs).count() == 0


def test_shares_are_exact():
    counts, totals = [0, 1, 10**15 - 9, 7 * 10**14], [6, 10**9 + 7, 10**15 + 3, 9 * 10**14 + 1]
    got = source_audit.shares(np.array(counts, np.int64), np.array(totals, np.int64))
    assert got.tolist() == [1 + 10**9 * (c + 5) // t for c, t in zip(counts, totals, strict=True)]


# --- filters ---------------------------------------------------------------------------------------------------------


def brute_filters(docs, labels):
    """docs: (doc_id, text, source); labels: (doc_id, quality, toxic). Every order is applied document by document."""
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, _ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    parts = defaultdict(list)
    for i, t, s in docs:
        t = t or ""
        w = WORD.findall(t)
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": i is not None and least[t] < i}
        parts[s or ""].append(({f for f in fails if fails[f]}, i in good, i in toxic))
    out = {}
    for part, rows in parts.items():
        removed_by = Counter()
        for order in permutations("ABCDE"):
            for k, f in enumerate(order):
                gone = set(order[:k])
                here = [r for r in rows if f in r[0] and not r[0] & gone]
                removed_by[f] += len(here)
                out[part, "".join(order), k + 1] = [sum(not r[0] & {*gone, f} for r in rows), len(here), sum(f in r[0] and bool(r[0] & gone) for r in rows), sum(r[0] == {f} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here)]
        for (p, order, step), row in out.items():
            if p == part:
                row.append(removed_by[order[step - 1]])
    return out


def test_filters(spark, odd_docs, no_docs):
    rng = random.Random(11)
    words = [f"word{k}" for k in range(70)]
    pool = [" ".join(rng.choices(words[: rng.choice([30, 70])], k=rng.choice([3, 49, 50, 60, 90]))) for _ in range(25)]
    pool = [rng.choice([t, t.upper(), t + "#", "A" + t, ""]) for t in pool] + [" ".join(words[:50]), None, "\t", "ÀÉ" * 30]
    docs = [(rng.choice([*range(150), None]), rng.choice(pool), rng.choice(["a", "b", None, ""])) for _ in range(220)]
    docs += docs[:5]
    labels = [(k, rng.choice([0, 1, None]), rng.choice([0, 1])) for k in range(0, 160, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(4)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = {tuple(r)[:3]: list(r)[3:] for r in filter_audit.audit_filters(frame, marks).collect()}
    assert got == brute_filters(docs, labels)
    odd = [tuple(r) for r in odd_docs.select("doc_id", "text", "source").collect()]
    got = {tuple(r)[:3]: list(r)[3:] for r in filter_audit.audit_filters(odd_docs, marks).collect()}
    assert got == brute_filters(odd, labels)
    assert filter_audit.audit_filters(no_docs, marks).count() == 0
    assert filter_audit.audit_filters(frame, marks.where(F.lit(False))).agg(F.sum("good_lost")).first()[0] == 0


@pytest.mark.parametrize("name", ["op12_source_divergence", "op13_filter_interactions"])
def test_query(spark, sf, duck, name):
    from tests.conftest import rows_of

    got, want = queries.QUERIES[name](spark, sf).toPandas(), duck.execute(queries.ORACLE[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def test_native_plan(spark, sf):
    plan = queries.op13_filter_interactions(spark, sf)._jdf.queryExecution().toString()
    assert "Arrow" not in plan and "Python" not in plan and "Cartesian" not in plan


def test_occurrences_within_others_are_not_extended(monkeypatch):
    """Short passages within a long one, once seen whole, cost nothing where the long one is; what is covered stays the same."""
    words = [f"w{i}".encode() for i in range(200)]
    shard = phrase_dedup.Shard()
    shard.add(1, 0, b" ".join(words))
    for k in range(40):
        shard.add(2 + k, 0, b" ".join(words[k : k + 60]))
    shard.compile()
    calls, real = [0], phrase_dedup._agree

    def counted(*args):
        calls[0] += 1
        return real(*args)

    monkeypatch.setattr(phrase_dedup, "_agree", counted)
    for uid in range(100, 104):
        assert phrase_dedup.merged(shard.occurrences(uid, 0, b" ".join([b"x", *words, b"y"]))) == [(1, 201)]
    assert calls[0] < 2 * 41
    assert sorted(shard.origin_covers()) == [(1, 0, 200)] + [(2 + k, 0, 60) for k in range(40)]
    # a passage's own place doesn't cover itself
    alone = phrase_dedup.Shard()
    alone.add(1, 0, b" ".join(words))
    alone.compile()
    assert not alone.occurrences(1, 0, b" ".join(words)) and not list(alone.origin_covers())


def test_near_copies_without_the_word_of_a_passage_do_not_meet_it(monkeypatch):
    """The passages of near copies, all but one word of a window on either side alike, cost nothing in texts that lack that word."""
    words = [f"w{i}".encode() for i in range(300)]
    shard = phrase_dedup.Shard()
    shard.add(0, 0, b" ".join(words))
    for k in range(40):
        at = 100 + k
        shard.add(1 + k, at - 34, b" ".join([*words[at - 34 : at], b"new%d" % k, *words[at + 1 : at + 35]]))
    shard.compile()
    calls, real = [0], phrase_dedup._agree

    def counted(*args):
        calls[0] += 1
        return real(*args)

    monkeypatch.setattr(phrase_dedup, "_agree", counted)
    assert phrase_dedup.merged(shard.occurrences(100, 0, b" ".join(words))) == [(0, 300)]
    assert calls[0] == 1
    changed = [*words[:120], b"new20", *words[121:]]
    assert phrase_dedup.merged(shard.occurrences(101, 0, b" ".join(changed))) == [(0, 300)]
    assert sorted(shard.origin_covers()) == [(0, 0, 300), (21, 86, 155)]


@pytest.mark.parametrize("window", [24, 35, 36])
def test_any_window_holds_a_probe(window):
    for words in range(window, 6 * window):
        probes = list(phrase_dedup.probes(words, window))
        assert all(end - at >= (window + 1) // 2 and 0 <= at and end <= words for at, end in probes)
        assert all(any(s <= at and end <= s + window for at, end in probes) for s in range(words - window + 1))


def test_kin_passages_have_one_shard(spark):
    """Unless they are more than half a shard: then they are dealt over some, and a text's tract stays together."""
    rows = [(100 * kin + uid, kin, start, 50) for kin in range(40) for uid in range(5) for start in (0, 60)]
    rows += [(10_000 + uid, 99, 0, phrase_dedup.SHARD // 20) for uid in range(100) for _ in range(2)]
    got = phrase_dedup.sharded(spark.createDataFrame(rows, "uid long, kin long, start long, words long"), 16).collect()
    assert Counter((r.uid, r.kin, r.start, r.words) for r in got) == Counter(rows)
    shards = {}
    for r in got:
        shards.setdefault(r.kin, {}).setdefault(r.uid, set()).add(r.shard)
    assert all(len(set.union(*shards[kin].values())) == 1 for kin in range(40))
    assert len(set.union(*shards[99].values())) > 4 and all(len(s) == 1 for s in shards[99].values())

import hashlib
import random
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import bpe, media_ts, packing, queries
from tests.llm.conftest import LONG, byte_path, word_path

TEXTS = ["", " ", "a<|endoftext|>b  \n\n  c", "aaaaaaaaaaa aaaa", "it's 12 o'clock, isn't it?..", "x" * 5000, "ab" * 2500, "ünïcødé 漢字 😀", "İstanbul ſ ǅ", "a.b, c.. d!? 'S <|startoftext|>", "\x85\x1c weird", LONG[:3000], "Hi,hi.hi, hi."]


def test_codec_matches_library():
    lib, own = Tokenizer.from_file(byte_path()), bpe.ByteBPE(byte_path())
    for t, (raw, decimal) in zip(TEXTS, own.encode(TEXTS), strict=True):
        ids = lib.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(raw, "<u4").tolist() == ids
        assert decimal == ",".join(map(str, ids))
        assert own.decode(ids) == lib.decode(ids, skip_special_tokens=False)


def test_codec_full_cache(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED", 3)
    lib, own = Tokenizer.from_file(byte_path()), bpe.ByteBPE(byte_path())
    for _ in range(2):
        assert [np.frombuffer(r, "<u4").tolist() for r, _ in own.encode(TEXTS)] == [lib.encode(t, add_special_tokens=False).ids for t in TEXTS]


def test_codec_query(spark, odd_docs, no_docs):
    lib = Tokenizer.from_file(byte_path())
    got = bpe.encode_documents(odd_docs, byte_path()).collect()
    want = Counter()
    for r in odd_docs.collect():
        ids = lib.encode(r.text or "", add_special_tokens=False).ids
        back = lib.decode(ids, skip_special_tokens=False)
        want[r.doc_id, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(back.encode()).hexdigest()] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in got) == want
    back = bpe.decode_documents(bpe.encode_documents(odd_docs, byte_path()), byte_path())
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text or "") for r in odd_docs.collect())
    assert bpe.encode_documents(no_docs, byte_path()).count() == 0


def test_word_ids_match_library():
    own = packing.Tokens(word_path())
    rng = random.Random(5)
    many = TEXTS + [" ".join("".join(rng.choice("abcdeéßñ'.,!Z9") for _ in range(rng.randint(1, 9))) for _ in range(60)) for _ in range(80)]
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode(many)] == [x.ids for x in own.tokenizer.encode_batch(many, add_special_tokens=False)]


def optimum(items, capacity):
    """Fewest bins, by trying all subsets that hold the largest item."""
    if not items:
        return 0
    first, rest = items[0], items[1:]
    best = len(items)
    for n in range(len(rest), -1, -1):
        for pick in combinations(range(len(rest)), n):
            if first + sum(rest[i] for i in pick) <= capacity:
                best = min(best, 1 + optimum([x for i, x in enumerate(rest) if i not in pick], capacity))
    return best


def test_bins_are_fewest():
    rng = random.Random(1)
    for _ in range(40):
        items = sorted((rng.randint(2, 19) for _ in range(9)), reverse=True)
        bins = packing.plan_bins(dict(Counter(items)), 20)
        assert Counter(x for lengths, n in bins for x in lengths * n) == Counter(items)
        assert all(sum(lengths) <= 20 for lengths, _ in bins)
        assert sum(n for _, n in bins) == optimum(items, 20)


def test_bins_meet_bound():
    rng = random.Random(2)
    counts = Counter(min(4096, int(rng.lognormvariate(6.5, 1)) + 1) for _ in range(30_000))
    bins = packing.plan_bins(dict(counts))
    assert Counter({x: 0 for x in counts}) + sum((Counter({x: k * n for x, k in Counter(b).items()}) for b, n in bins), Counter()) == counts
    assert sum(n for _, n in bins) == packing.lower_bound(counts, 4096)


def single_best_fit(counts, capacity):
    """Best-fit decreasing, an item at a time."""
    free = []
    for x in sorted(Counter(counts).elements(), reverse=True):
        fit = [r for r in free if r >= x]
        free.append(min(fit) - x if fit else capacity - x)
        if fit:
            free.remove(min(fit))
    return len(free)


def test_best_fit_by_multiplicities():
    rng = random.Random(3)
    for k in range(40):
        counts = {rng.randint(1, 60): rng.randint(1, 9) for _ in range(rng.randint(1, 12))}
        bins = packing.best_fit(counts, 60)
        assert sum((Counter({x: c * n for x, c in Counter(b).items()}) for b, n in bins), Counter()) == Counter(counts)
        assert sum(n for _, n in bins) == single_best_fit(counts, 60) and all(sum(b) <= 60 for b, _ in bins)
    assert packing.best_fit({}, 60) == [] and packing.plan_bins({}) == []


@pytest.mark.parametrize("low, high", [(1030, 2040), (1000, 1400), (1, 4096)])
def test_plans_are_never_worse_than_best_fit(low, high):
    counts = Counter(random.Random(low).choices(range(low, high + 1), k=260_000))
    bins = packing.plan_bins(dict(counts), nodes=2_000)
    assert sum((Counter({x: c * n for x, c in Counter(b).items()}) for b, n in bins), Counter()) == counts
    assert packing.lower_bound(counts, 4096) <= sum(n for _, n in bins) <= sum(n for _, n in packing.best_fit(counts, 4096))


def test_lower_bound_is_one():
    rng = random.Random(6)
    for _ in range(40):
        items = sorted((rng.randint(2, 19) for _ in range(8)), reverse=True)
        assert packing.lower_bound(dict(Counter(items)), 20) <= optimum(items, 20)


def check_packing(rows, docs, capacity):
    lib = Tokenizer.from_file(word_path())
    want = Counter()
    for r in docs.collect():
        ids = np.array([*lib.encode(r.text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            want[r.doc_id, k, at, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    places = {}
    for r in rows:
        places.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for p in places.values():
        end = 0
        for offset, length in sorted(p):
            assert offset == end
            end += length
        assert end <= capacity
    return len(places)


def test_packing(spark, odd_docs, no_docs, sf):
    check_packing(packing.pack_documents(odd_docs, word_path(), 64).collect(), odd_docs, 64)
    assert packing.pack_documents(no_docs, word_path()).count() == 0
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = queries.op1_best_fit_packing(spark, sf).collect()
    assert check_packing(rows, docs, 4096) == packing.lower_bound(Counter(r.length for r in rows), 4096)


@pytest.mark.parametrize("n", [0, 1, 64, 161, 162, 163, 346, 32768, 32769, 200_001])
def test_stream_round_trip(n):
    payload = media_ts.pad(random.Random(n).randbytes(n))
    stream = media_ts.mux(payload)
    back, units, packets = media_ts.demux(stream)
    assert back == payload and packets * 188 == len(stream)
    assert units[0][2] and [u[1] for u in units] == list(range(0, len(payload), media_ts.UNIT))


def test_broken_streams():
    stream = bytearray(media_ts.mux(media_ts.pad(b"x" * 1000)))
    for at, what in ((0, 0), (188 * 4 + 3, 0x1F), (10, 9)):
        bad = bytearray(stream)
        bad[at] = what
        with pytest.raises(ValueError):
            media_ts.demux(bytes(bad))


def plain_feature(payload):
    """What the stream of a payload is like, from its length and bytes alone."""
    size, units = len(payload), -(-len(payload) // media_ts.UNIT)
    packets = 2
    for at in range(0, size, media_ts.UNIT):
        packets += 1 + max(0, -(-(min(media_ts.UNIT, size - at) + 14 - 176) // 184))
    stamps = [k * media_ts.UNIT * 90_000 // 8_000 for k in range(units)]
    shares = [n / size for n in Counter(payload).values()]
    entropy = -sum(p * np.log2(p) for p in shares)
    steps = [b - a for a, b in zip(stamps, stamps[1:])]
    return packets, f"packets={packets};units={units};access={-(-units // 4)};last_pts={stamps[-1]};largest_step={max(steps, default=0)};entropy={entropy + 0.0:.6f}"


def test_media_by_plain_loops(spark):
    rng = random.Random(2)
    docs = spark.createDataFrame([(n, "".join(rng.choice("abc é漢") for _ in range(n))) for n in (0, 1, 63, 64, 161, 170, 5000, 20_000, 90_000)], "doc_id long, text string")
    stored = media_ts.write_media(docs)
    media = {r.doc_id: bytes(r.media) for r in stored.collect()}
    got = {r.doc_id: r for r in media_ts.read_media(stored).collect()}
    for r in docs.collect():
        packets, feature = plain_feature(media_ts.pad(r.text.encode()))
        own = got[r.doc_id]
        assert (own.media_bytes, own.media_sha256, own.feature, own.error) == (188 * packets, hashlib.sha256(media[r.doc_id]).hexdigest(), feature, None)
        assert own.access_offsets == [t for k, t in enumerate(range(0, own.payload_bytes, media_ts.UNIT)) if k % 4 == 0]


def test_broken_streams_keep_their_rows(spark):
    good = media_ts.mux(media_ts.pad(b"x" * 1000))
    bad = bytearray(good)
    bad[188 * 4 + 3] = 0x1F
    rows = [(1, 1000, good), (2, 5, bytes(bad)), (3, 5, None), (4, 5, b"no stream"), (5, 5, b"G" * 188), (6, 5, good[:376])]
    got = {r.doc_id: r for r in media_ts.read_media(spark.createDataFrame(rows, "doc_id long, n_bytes long, media binary")).collect()}
    assert got[1].error is None and got[1].payload_bytes == 1024
    assert all(got[k].error and got[k].payload_sha256 is None and got[k].timestamps is None for k in (2, 3, 4, 5, 6))


def test_damage_is_an_error_or_none():
    """Whatever bytes change, demux returns or raises ValueError."""
    rng, good = random.Random(4), media_ts.mux(media_ts.pad(b"ab" * 3000))
    for _ in range(400):
        bad = bytearray(good)
        for _ in range(rng.randint(1, 4)):
            bad[rng.randrange(len(bad))] = rng.randrange(256)
        try:
            media_ts.demux(bytes(bad))
        except ValueError:
            pass


def test_legal_repeats_and_jumps():
    payload = media_ts.pad(random.Random(7).randbytes(90_000))
    stream = media_ts.mux(payload)
    p = [bytearray(stream[i : i + 188]) for i in range(0, len(stream), 188)]
    twice = b"".join(p[:5] + p[4:5] + p[5:])
    assert media_ts.demux(twice)[0] == payload
    with pytest.raises(ValueError):
        media_ts.demux(b"".join(p[:5] + p[4:5] * 2 + p[5:]))
    first = [i for i, x in enumerate(p) if x[1] & 0x40 and x[1] & 31 == 1][1]
    for x in p[first:]:
        x[3] = x[3] & 0xF0 | (x[3] + 5) & 15
    with pytest.raises(ValueError):
        media_ts.demux(b"".join(p))
    p[first][5] |= 0x80
    assert media_ts.demux(b"".join(p))[0] == payload


def test_media(spark, odd_docs, no_docs):
    rows = media_ts.read_media(media_ts.write_media(odd_docs)).collect()
    want = Counter((r.doc_id, (r.text or "").encode()) for r in odd_docs.collect())
    assert Counter((r.doc_id, r.n_bytes, r.payload_sha256, r.tail_crc32) for r in rows) == Counter({(i, len(t), hashlib.sha256(media_ts.pad(t)).hexdigest(), zlib.crc32(media_ts.pad(t)[-64:])): n for (i, t), n in want.items()})
    assert len({(r.payload_sha256, r.media_sha256, r.feature) for r in rows}) == len({r.payload_sha256 for r in rows})
    assert media_ts.read_media(media_ts.write_media(no_docs)).count() == 0


def test_very_long_texts(monkeypatch):
    monkeypatch.setattr(bpe, "LONG_TEXT", 50)
    monkeypatch.setattr(packing, "SEGMENT", 64)
    real = packing.long_parts
    monkeypatch.setattr(packing, "long_parts", lambda t, safe: real(t, safe, 40))
    rng = random.Random(8)
    many = ["".join(rng.choice("ab cd  é,'s \n1") for _ in range(400)) for _ in range(30)] + ["x" * 300, " " * 200]
    lib, own = Tokenizer.from_file(byte_path()), bpe.ByteBPE(byte_path())
    assert [np.frombuffer(r, "<u4").tolist() for r, _ in own.encode(many)] == [lib.encode(t, add_special_tokens=False).ids for t in many]
    assert [d for _, d in own.encode(many)] == [",".join(map(str, lib.encode(t, add_special_tokens=False).ids)) for t in many]
    words = packing.Tokens(word_path())
    assert [np.frombuffer(x, "<u4").tolist() for x in words.encode(many)] == [x.ids for x in words.tokenizer.encode_batch(many, add_special_tokens=False)]


def test_sequences(spark, odd_docs):
    pieces = packing.token_pieces(odd_docs, word_path(), 64, with_ids=True)
    packed = packing.pack(packing.written(pieces, "pieces"), 64)
    whole = packing.sequences(packed).collect()
    assert all(len(r.ids) <= 64 for r in whole)
    assert sum(len(r.ids) for r in whole) == sum(r.length for r in packed.collect())
    lib = Tokenizer.from_file(word_path())
    want = Counter(i for r in odd_docs.collect() for i in [*lib.encode(r.text or "", add_special_tokens=False).ids, 1])
    assert Counter(i for r in whole for i in r.ids) == want

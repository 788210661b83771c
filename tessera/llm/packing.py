"""Best-fit packing of token sequences by bin completion.

Only a histogram of piece lengths (at most `capacity` rows, whatever the corpus) comes to the driver. There bin
completion by branch and bound works on lengths with multiplicities: around the longest length left it enumerates
undominated fillings, least waste first, and prunes by waste and by the bins that the rest needs. Best-fit decreasing, also
over multiplicities, is the first incumbent, so a plan is never worse. The search is the same for every size: it ends at
the lower bound or after NODES steps. The plan (patterns with counts, bounded by the number of lengths) is then mapped
back to the pieces by their rank within a length, by joins over narrow rows; texts and ids never move.

Null and empty texts are one piece, of the end token alone. Repeated rows are packed each on its own; null document ids
are kept. Other columns of the input are ignored.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.bpe import ByteBPE
from tessera.llm.common import long_parts, prepare, slices, texts, tidy, written

#: Texts of these characters only are split at white space before the tokenizer sees them: it drops white space, and its
#: normaliser works on each character alone there.
PLAIN = re.compile("[\t\n\r\x20-\x7e\xa1-įı-ɏ]*")
#: Chunks that a worker remembers; later ones are encoded where they stand, so memory is bounded.
REMEMBERED = 400_000
#: Characters that are worked on at a time; longer texts are cut at white space.
SEGMENT = 2 << 20
BLANK = re.compile(r"\s")
PRIME = np.uint64(0x100000001B3)
MARKS = np.frombuffer(b".,;:!?", np.uint8)
LETTER = np.zeros(256, bool)
LETTER[65:91] = LETTER[97:123] = True
SUBRANKS = 1024
#: Steps of the search for a plan, of branches and of fillings looked at.
NODES = 40_000


class Tokens:
    """Ids of texts as little-endian unsigned 32-bit numbers.

    Plain texts are cut at white space into chunks; a batch's chunks are told apart by a hash of their bytes, so each
    distinct one is looked up or encoded once, and its ids are laid out by index arithmetic.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.bpe = ByteBPE(path)
        self.known: dict[bytes, bytes] = {}
        self.marks = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.powers = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(1 << 16, PRIME))])

    def _raw(self, many: list[str]) -> list[bytes]:
        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(many, add_special_tokens=False)]

    def _words(self, words: list[bytes]) -> dict[bytes, bytes]:
        """Ids of single words, by the merge rounds of op2's codec (much faster on many short words; the same ids)."""
        out = {}
        for k in range(0, len(words), 16_384):
            part = words[k : k + 16_384]
            ids, at = self.bpe.encode_words(part)
            raw, at = ids.astype("<u4").tobytes(), (4 * at).tolist()
            out.update((w, raw[s:e]) for w, s, e in zip(part, at, at[1:]))  # noqa: B905
        return out

    def _hashes(self, raw: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
        """A hash of each chunk raw[s:e]: a polynomial in its bytes, by prefix sums."""
        n = len(raw) + 1
        if len(self.powers) < n:
            self.powers = np.concatenate([[np.uint64(1)], np.multiply.accumulate(np.full(2 * n, PRIME))])
        prefix = np.zeros(n, np.uint64)
        np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * self.powers[n - 2 :: -1][: n - 1], out=prefix[1:])
        # the same chunk further on has a smaller power; bring all to that of the first byte
        return (prefix[e] - prefix[s]) * self.powers[s]

    def _ids(self, chunks: list[bytes]) -> list[bytes]:
        known = self.known
        got = list(map(known.get, chunks))
        parts = [c for c, v in zip(chunks, got, strict=True) if v is None]
        # letters alone are one word to the tokenizer
        words = [x for x in parts if x.decode().isalpha()]
        found = self._words(words)
        others = [x for x in parts if x not in found]
        found.update(zip(others, self._raw([x.decode() for x in others]), strict=True))
        if len(known) + len(parts) <= REMEMBERED:
            known.update(found)
        return [found[c] if v is None else v for c, v in zip(chunks, got, strict=True)]

    def encode(self, many: list[str]) -> list[bytes]:
        plain = [bool(PLAIN.fullmatch(t)) and not any(m in t for m in self.marks) for t in many]
        out: list[bytes] = [b""] * len(many)
        rest = [i for i, p in enumerate(plain) if not p]
        for i, ids in zip(rest, self._raw([many[i] for i in rest]), strict=True):
            out[i] = ids
        held, size = [], 0
        for i, p in enumerate(plain):
            for part in long_parts(many[i], BLANK) if p else ():
                if held and size + len(part) > SEGMENT:
                    self._encode_plain(held, out)
                    held, size = [], 0
                held.append((i, part))
                size += len(part)
        self._encode_plain(held, out)
        return out

    def _encode_plain(self, held: list[tuple[int, str]], out: list[bytes]) -> None:
        """Add the ids of the parts to those of their texts."""
        # lower case as the normaliser does it, one character at a time
        texts = [part.lower().encode() for _, part in held]
        joined = b"\n".join(texts)
        raw = np.frombuffer(joined, np.uint8)
        if not len(raw):
            return
        edge = np.diff(np.concatenate([[True], raw <= 32, [True]]).astype(np.int8))
        s, e = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        # a letter and a last mark are never one word
        cut = (e - s > 1) & np.isin(raw[e - 1], MARKS) & LETTER[raw[e - 2]]
        s, e = np.sort(np.concatenate([s, e[cut] - 1])), np.sort(np.concatenate([e, e[cut] - 1]))
        _, first, of = np.unique(self._hashes(raw, s, e), return_index=True, return_inverse=True)
        ids = self._ids([joined[a:b] for a, b in zip(s[first].tolist(), e[first].tolist(), strict=True)])
        sizes = np.array([len(x) // 4 for x in ids], np.int64)
        begins = np.cumsum(sizes) - sizes
        size = sizes[of]
        ends = np.cumsum(size)
        flat = np.frombuffer(b"".join(ids), "<u4")[np.repeat(begins[of] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0)]
        starts = np.cumsum([0, *(len(t) + 1 for t in texts)])
        cut = np.concatenate([[0], ends])[np.searchsorted(s, starts)].tolist()
        for k, (i, _) in enumerate(held):
            out[i] += flat[cut[k] : cut[k + 1]].tobytes()


@lru_cache(maxsize=2)
def tokens(path: str) -> Tokens:
    return Tokens(path)


def token_pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids): every document's ids and the end id, cut only where longer than capacity."""
    prepare(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def run(batches):
        with tidy(collect=False):
            tok = tokens(path)
            for batch in slices(batches, 1024, 2 << 20):
                who, piece, start, length, crc, ids = [], [], [], [], [], []
                for i, raw in enumerate(tok.encode(texts(batch.column(1)))):
                    raw += end
                    for k, at in enumerate(range(0, len(raw), 4 * capacity)):
                        part = raw[at : at + 4 * capacity]
                        who.append(i)
                        piece.append(k)
                        start.append(at // 4)
                        length.append(len(part) // 4)
                        crc.append(zlib.crc32(part))
                        if with_ids:
                            ids.append(np.frombuffer(part, "<i4"))
                cols = [batch.column(0).take(pa.array(who, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())]
                yield pa.RecordBatch.from_arrays(cols + ([pa.array(ids, pa.list_(pa.int32()))] if with_ids else []), names=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long{', ids array<int>' * with_ids}")


def lower_bound(counts: dict[int, int], capacity: int) -> int:
    """Bins needed at least: the best of the total's bound, for each cut that of the items too large to share (L2), and
    those of rounded weights (dual feasible functions u^(k) of Fekete and Schepers)."""
    total = sum(x * n for x, n in counts.items())
    best = -(-total // capacity)
    lengths = sorted(counts)
    size = np.array(lengths)
    num = np.array([counts[x] for x in lengths])
    for k in [0, *(x for x in lengths if 2 * x <= capacity)]:
        big, mid, low = size > capacity - k, (size <= capacity - k) & (2 * size > capacity), (2 * size <= capacity) & (size >= k)
        n, free = int(num[mid].sum()), int((num[mid] * (capacity - size[mid])).sum())
        best = max(best, int(num[big].sum()) + n + max(0, -(-(int((num[low] * size[low]).sum()) - free) // capacity)))
    for k in range(1, 21):
        parts, over = np.divmod((k + 1) * size, capacity)
        weight = np.where(over == 0, k * size, parts * capacity)
        best = max(best, -(-int((num * weight).sum()) // (k * capacity)))
    return best


Plan = list[tuple[tuple[int, ...], int]]


def best_fit(counts: dict[int, int], capacity: int) -> Plan:
    """Best-fit decreasing over lengths with multiplicities: (lengths of a bin, falling, how many such bins).

    An item goes where it leaves least room, so equal items fill a bin as far as they fit before they turn to the next:
    whole groups of equal bins are filled at a time, and each length splits one group at most.
    """
    rooms: list[int] = []
    groups: dict[int, list[tuple[tuple[int, ...], int]]] = {}

    def put(room: int, have: tuple[int, ...], n: int) -> None:
        if room not in groups:
            insort(rooms, room)
            groups[room] = []
        groups[room].append((have, n))

    for x in sorted((x for x, n in counts.items() if n), reverse=True):
        left, made, at = counts[x], [], bisect_left(rooms, x)
        while left and at < len(rooms):
            room = rooms[at]
            each = room // x
            while left and groups[room]:
                have, n = groups[room].pop()
                full = min(n, left // each)
                if full:
                    made.append((room - each * x, have + (x,) * each, full))
                    left -= full * each
                if full < n and left:  # fewer than a bin takes are left
                    made.append((room - left * x, have + (x,) * left, 1))
                    left, full = 0, full + 1
                if full < n:
                    groups[room].append((have, n - full))
            if groups[room]:
                at += 1
            else:
                del groups[room], rooms[at]
        each = capacity // x
        if left >= each:
            made.append((capacity - each * x, (x,) * each, left // each))
        if left % each:
            made.append((capacity - left % each * x, (x,) * (left % each), 1))
        for m in made:
            put(*m)
    return [g for room in rooms for g in groups[room]]


class Budget:
    """Steps that a search may still take."""

    def __init__(self, steps: int):
        self.left = steps

    def spend(self) -> bool:
        self.left -= 1
        return self.left >= 0


def _steps(num: np.ndarray, room: int, exact: bool) -> tuple[list[tuple[int, int, int]], int]:
    """Subset sums of the available lengths, larger first, as the bits of a number: (length, copies, sums before), and the sums.

    Copies are taken in powers of two, so none is left out. exact: end as soon as the room itself is a sum.
    """
    reach, full, steps = 1, (1 << (room + 1)) - 1, []
    for x in np.flatnonzero(num[: room + 1])[::-1].tolist():
        copies, k = min(int(num[x]), room // x), 1
        while copies:
            k = min(k, copies)
            steps.append((x, k, reach))
            reach |= reach << k * x & full
            copies -= k
            k *= 2
        if exact and reach >> room & 1:
            break
    return steps, reach


def _subsets(steps: list[tuple[int, int, int]], total: int, budget: Budget) -> Iterator[tuple[int, ...]]:
    """The ways to make a sum that is among the steps', larger lengths first as far as they can be left out late."""
    todo = [(len(steps), total, ())]
    while todo and budget.spend():
        i, left, have = todo.pop()
        if not left:
            yield tuple(sorted(have, reverse=True))
            continue
        # down to the step without which the sum can't be made; where it can, both ways are open
        while i and left:
            x, k, before = steps[i - 1]
            i -= 1
            if k * x <= left and before >> (left - k * x) & 1:
                if not before >> left & 1:
                    have, left = have + (x,) * k, left - k * x
                    continue
                todo.append((i, left - k * x, have + (x,) * k))
        if not left:
            yield tuple(sorted(have, reverse=True))


def _dominated(num: np.ndarray, filling: tuple[int, ...], waste: int) -> bool:
    """Whether a left-out item fits beside the filling, or a longer one instead of one of its items."""
    used = Counter(filling)
    spare = [x for x in np.flatnonzero(num[: waste + max(used, default=0) + 1]).tolist() if num[x] > used[x]]
    return any(x <= waste for x in spare) or any(y < x <= y + waste for y in used for x in spare)


def fillings(num: np.ndarray, room: int, budget: Budget, waste: int) -> Iterator[tuple[int, ...]]:
    """Undominated fillings of `room` from the counts `num`, of at most `waste`, least waste first; first of all those without waste
    from the longest lengths that allow one."""
    seen = set()
    for exact in (True, False):
        steps, reach = _steps(num, room, exact)
        for lost in range(0, min(waste, room) + 1 if not exact else 1):
            if reach >> (room - lost) & 1:
                for f in _subsets(steps, room - lost, budget):
                    if f not in seen:
                        seen.add(f)
                        if not _dominated(num, f, lost):
                            yield f


def complete(counts: dict[int, int], capacity: int, best: Plan, nodes: int = NODES) -> Plan:
    """Bin completion by branch and bound over lengths with multiplicities; `best` is the incumbent.

    Around the longest length left, every undominated filling is tried, least waste first, as often as its lengths allow,
    then half as often, down to once. A branch ends where its waste is more than a better plan can have, or where the rest
    needs too many bins. The search ends at the lower bound or after `nodes` steps, of branches and of fillings looked at.
    """
    bound, total, fewest = lower_bound(counts, capacity), sum(x * n for x, n in counts.items()), sum(n for _, n in best)
    num = np.zeros(capacity + 1, np.int64)
    for x, n in counts.items():
        num[x] = n
    budget, rest, lost, bins = Budget(nodes), total, 0, 0
    top = capacity
    done: Plan = []
    #: for each bin kind of the branch: the choices tried before it, the longest length then
    path: list[tuple[int, int]] = []

    def choices(x: int) -> Iterator[tuple[tuple[int, ...], int]]:
        num[x] -= 1
        spare = (fewest - 1) * capacity - total - lost
        for f in fillings(num, capacity - x, budget, spare):
            num[x] += 1
            need = Counter((x, *f))
            times = min(int(num[y]) // n for y, n in need.items())
            while times:
                yield (x, *f), times
                times //= 2
            num[x] -= 1
        num[x] += 1

    def take(have: tuple[int, ...], times: int) -> None:
        nonlocal rest, lost, bins
        for y in have:
            num[y] -= times
        rest -= times * sum(have)
        lost += times * (capacity - sum(have))
        bins += times

    skip = 0
    while fewest > bound and budget.spend():
        if not rest:
            if bins < fewest:
                best, fewest = list(done), bins
            found = None
        elif bins - (-rest // capacity) >= fewest or lost > (fewest - 1) * capacity - total:
            found = None
        else:
            while not num[top]:
                top -= 1
            here = choices(top)
            found = next(islice(here, skip, None), None)
            here.close()
        if found is None:
            if not path:
                break
            skip, top = path.pop()
            have, times = done.pop()
            take(have, -times)
            skip += 1
        else:
            path.append((skip, top))
            done.append(found)
            take(*found)
            skip = 0
    return best


def plan_bins(counts: dict[int, int], capacity: int = 4096, nodes: int = NODES) -> Plan:
    """(lengths of a bin, how many such bins), for all pieces. Lengths must be within 1 and capacity."""
    counts = {x: n for x, n in counts.items() if n > 0}
    return complete(counts, capacity, best_fit(counts, capacity), nodes)


def pack(pieces: DataFrame, capacity: int = 4096) -> DataFrame:
    """The pieces (doc_id, piece, length, ...) with sequence_id and offset. An empty table gives an empty one."""
    prepare(pieces.sparkSession)
    # rows of one id, or copies of a row, differ in their place
    sub = F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id()), F.lit(SUBRANKS)).cast("int")
    keyed = written(pieces.withColumn("__sub", sub), "pieces")
    counted = written(keyed.groupBy("length", "__sub").agg(F.count("*").alias("__n")), "lengths")  # at most capacity x SUBRANKS rows
    counts = {int(r[0]): int(r[1]) for r in counted.groupBy("length").agg(F.sum("__n")).collect()}
    bins = plan_bins(counts, capacity)
    # for each length, which ranks go to which pattern: entries sorted by (length, first rank)
    entries, first = [], 0
    taken: dict[int, int] = {}
    for lengths, times in bins:
        at = 0
        for x, n in Counter(lengths).items():
            entries.append((x, taken.get(x, 0), first, n, at))
            taken[x] = taken.get(x, 0) + n * times
            at += x * n
        first += times
    entries.sort()
    table = np.array(entries, np.int64).reshape(-1, 5)
    plan = pieces.sparkSession.sparkContext.broadcast(table)  # a few rows for each length at most
    order = Window.partitionBy("length").orderBy("__sub").rowsBetween(Window.unboundedPreceding, -1)
    base = counted.select("length", "__sub", F.coalesce(F.sum("__n").over(order), F.lit(0)).alias("__base"))
    within = Window.partitionBy("length", "__sub").orderBy("doc_id", "piece")
    ranked = keyed.join(base, ["length", "__sub"]).withColumn("__rank", F.col("__base") + F.row_number().over(within) - 1)
    names = pieces.columns

    def place(batches):
        t = plan.value
        key = t[:, 0] << 44 | t[:, 1]
        for batch in batches:
            length, rank = (batch.column(c).to_numpy() for c in ("length", "__rank"))
            e = t[np.searchsorted(key, length << 44 | rank, side="right") - 1] if len(t) else t
            local = rank - e[:, 1]
            seq, off = e[:, 2] + local // e[:, 3], e[:, 4] + local % e[:, 3] * length
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(seq), pa.array(off)], names=[*names, "sequence_id", "offset"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.select(*names, "__rank").mapInArrow(place, f"{schema}, sequence_id long, offset long")


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id and offset of every piece of every document."""
    return pack(token_pieces(docs, path, capacity), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, doc_ids): the packed sequences, from packed pieces with their ids; each is bounded by the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "doc_id", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.doc_id").alias("doc_ids"))

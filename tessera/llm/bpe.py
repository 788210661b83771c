"""Byte-level BPE encoding and decoding by batched numpy merge rounds.

The symbols of many words lie in one flat array. A round looks every adjacent pair up by binary search over the sorted
pair keys, takes each word's lowest-rank pair and merges all its occurrences from the left; finished words leave the
array. Words of over LONG symbols take a heap instead, as their rounds would be many. Vocabulary files are read from a
path that is a parameter.

Nulls are empty texts; an empty text has no tokens; special tokens in a text become their own id, as the tokenizers
library does by default. Repeated rows are encoded alike, and other columns are left alone.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import long_parts, prepare, slices, texts, tidy

#: Fixed value: the word pattern of the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LONG = 2048
LONG_TEXT = 1 << 20
#: Words that a worker remembers; later ones are encoded for their batch only, so memory is bounded.
REMEMBERED = 250_000


def byte_characters() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [], 0
    for b in range(256):
        if b in plain:
            out.append(chr(b))
        else:
            out.append(chr(256 + extra))
            extra += 1
    return out


class ByteBPE:
    """A vocabulary with its merges as sorted arrays, and the words encoded so far."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        merges = [m.split(" ") if isinstance(m, str) else m for m in merges]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*vocab.values(), *self.special.values()]) + 1
        chars = byte_characters()
        of_char = {c: b for b, c in enumerate(chars)}
        # a vocabulary with word ends has a symbol of its own for a word's last byte
        suffix = spec["model"].get("end_of_word_suffix") or ""
        self.first = np.array([vocab[c] for c in chars], np.int64)
        self.last = np.array([vocab[c + suffix] for c in chars], np.int64)
        left, right = (np.array([vocab[m[i]] for m in merges], np.int64) for i in (0, 1))
        made = np.array([vocab[m[0] + m[1]] for m in merges], np.int64)
        key = left << 32 | right
        order = np.argsort(key, kind="stable")
        self.key, self.rank, self.made = key[order], order.astype(np.int64), made[order]
        raw = [b""] * size
        for token, i in vocab.items():
            raw[i] = bytes(of_char[c] for c in token)
        for token, i in self.special.items():
            raw[i] = token.encode()
        self.text = [str(i) for i in range(size)]
        self.sizes = np.array([len(x) for x in raw], np.int64)
        self.begins = np.concatenate([[0], np.cumsum(self.sizes)])[:-1]
        self.bytes = np.frombuffer(b"".join(raw), np.uint8)
        self.pattern = regex.compile(PATTERN)
        self.safe = regex.compile(r"(?<=\p{L}) (?=\p{L})")
        self.splitter = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.known: dict[str, tuple[bytes, str, int]] = {}

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each pair: its rank (or a large number) and what it makes."""
        none = np.iinfo(np.int64).max
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.rank[at], none), self.made[at]

    def encode_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and n + 1 offsets."""
        sizes = np.array([len(w) for w in words], np.int64)
        long = sizes > LONG
        small = [w for w, x in zip(words, long, strict=True) if not x]
        joined = np.frombuffer(b"".join(small), np.uint8)
        sym = self.first[joined]
        tail = np.cumsum(sizes[~long])[sizes[~long] > 0] - 1
        sym[tail] = self.last[joined[tail]]
        word = np.repeat(np.flatnonzero(~long), sizes[~long])
        none = np.iinfo(np.int64).max
        done_word, done_sym = [], []
        for i in np.flatnonzero(long):
            ids = self._one(words[i])
            done_word.append(np.full(len(ids), i, np.int64))
            done_sym.append(ids)
        rank, made = np.full(len(sym), none), np.zeros(len(sym), np.int64)
        if len(sym) > 1:
            rank[:-1], made[:-1] = self._ranks(sym[:-1], sym[1:])
            rank[:-1][word[1:] != word[:-1]] = none
        while len(sym):
            new = np.concatenate([[True], word[1:] != word[:-1]])
            least = np.minimum.reduceat(rank, np.flatnonzero(new))[np.cumsum(new) - 1]
            over = least == none
            if over.any():
                done_word.append(word[over])
                done_sym.append(sym[over])
            at = np.flatnonzero((rank == least) & ~over)
            if not len(at):
                break
            # of a run of overlapping occurrences, every second one from the left
            head = np.concatenate([[True], at[1:] != at[:-1] + 1])
            at = at[(np.arange(len(at)) - np.flatnonzero(head)[np.cumsum(head) - 1]) % 2 == 0]
            sym[at] = made[at]
            keep = ~over
            keep[at + 1] = False
            at = (np.cumsum(keep) - 1)[at]
            sym, word, rank, made = sym[keep], word[keep], rank[keep], made[keep]
            # only pairs beside a merge are new
            near = np.zeros(len(sym), bool)
            near[at] = near[at[at > 0] - 1] = True
            at = np.flatnonzero(near)
            last = (at == len(sym) - 1) | (word[np.minimum(at + 1, len(sym) - 1)] != word[at])
            rank[at[last]] = none
            at = at[~last]
            rank[at], made[at] = self._ranks(sym[at], sym[at + 1])
        words_of = np.concatenate(done_word) if done_word else np.zeros(0, np.int64)
        syms = np.concatenate(done_sym) if done_sym else np.zeros(0, np.int64)
        order = np.argsort(words_of, kind="stable")
        return syms[order], np.concatenate([[0], np.cumsum(np.bincount(words_of, minlength=len(words)))])

    def _one(self, word: bytes) -> np.ndarray:
        """A single long word, by a heap of (rank, place)."""
        sym = self.first[np.frombuffer(word, np.uint8)]
        sym[-1] = self.last[word[-1]]
        n = len(sym)
        after, before, alive = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, bool)
        rank, made = self._ranks(sym[:-1], sym[1:])
        none = np.iinfo(np.int64).max
        heap = [(int(r), i, int(sym[i]), int(sym[i + 1]), int(m)) for i, (r, m) in enumerate(zip(rank, made, strict=True)) if r != none]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, m = heapq.heappop(heap)
            j = after[i] if alive[i] else n
            if j >= n or sym[i] != a or sym[j] != b:
                continue
            sym[i], alive[j] = m, False
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for x in (before[i], i):
                if x >= 0 and after[x] < n:
                    r, w = self._ranks(sym[x : x + 1], sym[after[x] : after[x] + 1])
                    if r[0] != none:
                        heapq.heappush(heap, (int(r[0]), int(x), int(sym[x]), int(sym[after[x]]), int(w[0])))
        return sym[alive]

    def _learn(self, words: list[str]) -> dict[str, tuple[bytes, str, int]]:
        out = {}
        for k in range(0, len(words), 16_384):
            part = words[k : k + 16_384]
            ids, at = self.encode_words([w.encode() for w in part])
            raw, at, ids = ids.astype("<u4").tobytes(), at.tolist(), ids.tolist()
            for w, s, e in zip(part, at, at[1:]):  # noqa: B905
                out[w] = (raw[4 * s : 4 * e], ",".join([self.text[i] for i in ids[s:e]]), e - s)
        return out

    def _special(self, token: str) -> tuple[bytes, str, int]:
        i = self.special[token]
        return np.array([i], "<u4").tobytes(), str(i), 1

    def encode(self, many: list[str]) -> list[tuple[bytes, str]]:
        """Of each text: its ids as little-endian unsigned 32-bit numbers, and in decimal joined by commas.

        Very long texts are cut between a letter and a blank before a letter, where words end whatever stands around.
        """
        out = []
        for t in many:
            if len(t) > LONG_TEXT and not any(x in t for x in self.special):
                parts = [self._encode([x])[0] for x in long_parts(t, self.safe, LONG_TEXT)]
                out.append((b"".join(p[0] for p in parts), ",".join(p[1] for p in parts)))
            else:
                out.append(None)
        rest = iter(self._encode([t for t, o in zip(many, out, strict=True) if o is None]))
        return [next(rest) if o is None else o for o in out]

    def _encode(self, many: list[str]) -> list[tuple[bytes, str]]:
        split = []
        for t in many:
            parts = []
            if self.splitter is not None and "<|" in t:
                for k, x in enumerate(self.splitter.split(t)):
                    parts += [(True, x)] if k % 2 else [(False, w) for w in self.pattern.findall(x)]
                split.append((True, parts))
            else:
                split.append((False, self.pattern.findall(t)))
        known = self.known
        new = self._learn(list({w for mixed, ws in split for w in ([x for s, x in ws if not s] if mixed else ws) if w not in known}))
        if len(known) + len(new) <= REMEMBERED:
            known.update(new)
            new = {}
        out = []
        for mixed, ws in split:
            if mixed:
                got = [self._special(x) if s else known.get(x) or new[x] for s, x in ws]
            elif new:
                got = [known[w] if w in known else new[w] for w in ws]
            else:
                got = [known[w] for w in ws]
            out.append((b"".join([x[0] for x in got]), ",".join([x[1] for x in got])))
        return out

    def decode_bytes(self, ids: np.ndarray) -> bytes:
        """The bytes that the ids stand for, end to end."""
        sizes = self.sizes[ids]
        ends = np.cumsum(sizes)
        if not len(ends):
            return b""
        return self.bytes[np.repeat(self.begins[ids] - (ends - sizes), sizes) + np.arange(ends[-1])].tobytes()

    def decode(self, ids) -> str:
        return self.decode_bytes(np.asarray(ids, np.int64)).decode("utf-8", "replace")


@lru_cache(maxsize=2)
def vocabulary(path: str) -> ByteBPE:
    return ByteBPE(path)


def encode_documents(docs: DataFrame, path: str, with_ids: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids (array<int>, unless with_ids is false), ids_sha256 and decoded_sha256 of every row."""
    prepare(docs.sparkSession)

    def run(batches):
        with tidy(collect=False):
            bpe = vocabulary(path)
            for batch in slices(batches, 512, 4 << 20):
                rows = {"doc_id": batch.column(0), "n_tokens": [], "ids": [], "ids_sha256": [], "decoded_sha256": []}
                for raw, decimal in bpe.encode(texts(batch.column(1))):
                    ids = np.frombuffer(raw, "<u4")
                    back = bpe.decode_bytes(ids).decode("utf-8", "replace").encode()
                    rows["n_tokens"].append(len(ids))
                    if with_ids:
                        rows["ids"].append(ids.astype(np.int32))
                    rows["ids_sha256"].append(hashlib.sha256(decimal.encode()).hexdigest())
                    rows["decoded_sha256"].append(hashlib.sha256(back).hexdigest())
                cols = [rows["doc_id"], pa.array(rows["n_tokens"], pa.int64())]
                cols += [pa.array(rows["ids"], pa.list_(pa.int32()))] if with_ids else []
                cols += [pa.array(rows[c], pa.string()) for c in ("ids_sha256", "decoded_sha256")]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "n_tokens", *["ids"] * with_ids, "ids_sha256", "decoded_sha256"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind}, n_tokens long, {'ids array<int>, ' * with_ids}ids_sha256 string, decoded_sha256 string")


def decode_documents(encoded: DataFrame, path: str) -> DataFrame:
    """doc_id and text of rows with ids; null ids give an empty text."""
    prepare(encoded.sparkSession)

    def run(batches):
        bpe = vocabulary(path)
        for batch in slices(batches, 512, 4 << 20):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([bpe.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])

    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {kind}, text string")

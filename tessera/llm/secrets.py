"""Secret scans through a trigram inverted index, by DataFrame functions alone.

From each rule's regex a Boolean trigram query is derived: strings that any match must contain, as AND and OR over
trigrams. The index has postings for the trigrams that queries name; intersecting them gives the candidates of each rule,
and only those are verified with the regex. A rule without mandatory trigrams (a run of hex digits) scans every text.

span_report and redact store the index as a table and scan by it. It has postings (trigram, text digest), keyed by a 96-bit
digest, so equal texts share them, and null or repeated ids do no harm; candidates come back to the rows by a join on digest
and a salt, so a text with very many copies is spread over tasks. scan_secrets without an index makes the row's own postings,
as bits, and intersects them in the same pass.

Null texts count as empty and have no span; repeated rows keep a row each, and an empty table gives an empty one. Matches
are leftmost and non-overlapping for each kind; places are code points. Places come from running totals by doubling and
texts are blanked from pieces, so a text's cost is near linear in its length and spans. Other columns are kept, whatever
their names.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce
from re import _constants as C
from re import _parser

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import shared_name, written

SALTS = 16
#: Code points of the pieces that a text is cut into where spans of it are replaced.
PIECE = 256


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its regex, the group whose length counts and its least length, and whether letters fold."""

    kind: str
    regex: str
    group: int = 0
    least: int = 1
    fold: bool = False
    base: bool = True


#: The kinds asked for, in order, then those that this scan adds.
RULES = (
    Rule("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12, fold=True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 18),
    Rule("hex", r"[0-9a-f]+", 0, 16),
    Rule("private_key", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", base=False),
    Rule("github", r"ghp_[A-Za-z0-9]{36,}", base=False),
    Rule("slack", r"xox[bp]-[A-Za-z0-9-]{10,}", base=False),
)

#: A query is None (every text) or a set of alternatives, each a set of trigrams that must all occur.
Query = frozenset[frozenset[str]] | None
MOST_STRINGS = 64


def _trigrams(text: str) -> frozenset[str]:
    return frozenset(text[i : i + 3] for i in range(len(text) - 2))


def _any(strings: set[str]) -> Query:
    """One of the strings occurs."""
    if any(len(s) < 3 for s in strings):
        return None
    sets = {_trigrams(s) for s in strings}
    return frozenset(s for s in sets if not any(t < s for t in sets))


def _both(a: Query, b: Query) -> Query:
    if a is None or b is None:
        return b if a is None else a
    sets = {x | y for x in a for y in b}
    return frozenset(s for s in sets if not any(t < s for t in sets))


def _strings(node) -> set[str] | None:
    """All strings that a parsed piece can match, if they are few."""
    op, arg = node
    if op is C.LITERAL:
        return {chr(arg).lower()}
    if op is C.IN:
        if any(k not in (C.LITERAL, C.RANGE) for k, _ in arg):
            return None
        out = {chr(c).lower() for k, v in arg for c in ([v] if k is C.LITERAL else range(v[0], v[1] + 1))}
        return out if len(out) <= 4 else None
    if op is C.SUBPATTERN:
        return _sequence(arg[-1])
    if op is C.BRANCH:
        parts = [_sequence(x) for x in arg[1]]
        return None if any(p is None for p in parts) else set().union(*parts)
    if op is C.MAX_REPEAT and arg[1] <= 8:
        one, out = _sequence(arg[2]), set()
        if one is None:
            return None
        for n in range(arg[0], arg[1] + 1):
            part = {""}
            for _ in range(n):
                part = {a + b for a in part for b in one}
                if len(part) > MOST_STRINGS:
                    return None
            out |= part
        return out
    return None


def _sequence(items) -> set[str] | None:
    out = {""}
    for x in items:
        more = _strings(x)
        if more is None or len(out) * len(more) > MOST_STRINGS:
            return None
        out = {a + b for a in out for b in more}
    return out


def trigram_query(regex: str) -> Query:
    """The trigrams, of the lower-cased text, without which the regex can't match; None if it has no mandatory ones."""

    def walk(items) -> Query:
        found: Query = None
        run = {""}
        for x in items:
            more = _strings(x)
            if more is not None and len(run) * len(more) <= MOST_STRINGS:
                run = {a + b for a in run for b in more}
                continue
            found, run = _both(found, _any(run)), {""}
            if more is not None:
                run = more
                continue
            op, arg = x
            if op is C.SUBPATTERN:
                found = _both(found, walk(arg[-1]))
            elif op is C.MAX_REPEAT and arg[0] >= 1:
                found = _both(found, walk(arg[2]))
            elif op is C.BRANCH:
                parts = [walk(p) for p in arg[1]]
                if all(p is not None for p in parts):
                    found = _both(found, frozenset().union(*parts))
        return _both(found, _any(run))

    return walk(_parser.parse(regex))


def query_terms(rules: tuple[Rule, ...] = RULES) -> list[str]:
    return sorted({t for r in rules for alt in trigram_query(r.regex) or () for t in alt})


def _digest() -> list[Column]:
    return [F.xxhash64("__text").alias("__d1"), F.crc32(F.encode("__text", "UTF-8")).alias("__d2")]


def trigram_postings(docs: DataFrame, terms: list[str]) -> DataFrame:
    """The index: (term, __d1, __d2), for each distinct text and each of the terms in its lower-cased form."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select(text.alias("__text")).select(F.lower("__text").alias("__low"), *_digest())
    return rows.select("__d1", "__d2", F.explode(F.filter(F.array(*[F.lit(t) for t in terms]), lambda t: F.contains("__low", t))).alias("term"))


def stored_index(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The postings of the rules' trigrams, as a table in the shared folder."""
    return written(trigram_postings(docs, query_terms(rules)), "postings")


def candidates(postings: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(__d1, __d2, __rules): texts that some rule's query accepts; bit k stands for rule k. Postings meet by digest."""
    terms = query_terms(rules)
    places = F.create_map(*[F.lit(x) for i, t in enumerate(terms) for x in (t, i)])
    words = -(-len(terms) // 60)
    place = places[F.col("term")]
    bits = [F.bit_or(F.when(F.expr("p div 60") == w, F.expr("shiftleft(1L, p % 60)")).otherwise(F.lit(0).cast("long"))).alias(f"__m{w}") for w in range(words)]
    met = postings.withColumn("p", place).groupBy("__d1", "__d2").agg(*bits)
    return met.select("__d1", "__d2", accepted(terms, rules).alias("__rules")).where("__rules <> 0")


def accepted(terms: list[str], rules: tuple[Rule, ...]) -> Column:
    """From postings as bits (__m0, __m1, …): bit k is set where rule k's query holds."""

    def holds(alt: frozenset[str]) -> Column:
        out = F.lit(True)
        for w in range(-(-len(terms) // 60)):
            mask = sum(1 << (i % 60) for i, t in enumerate(terms) if t in alt and i // 60 == w)
            if mask:
                out = out & (F.col(f"__m{w}").bitwiseAND(F.lit(mask).cast("long")) == mask)
        return out

    found = F.lit(0)
    for k, r in enumerate(rules):
        q = trigram_query(r.regex)
        if q is not None:
            hit = F.lit(False)
            for alt in sorted(q, key=sorted):
                hit = hit | holds(alt)
            found = found + F.when(hit, 1 << k).otherwise(0)
    return found


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of the value, which is worked out once, however often body names it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def running(values: Column, join: Callable[[Column, Column], Column]) -> Column:
    """Running totals of an array under an associative join, by doubling: n log n steps, and no array grows by one."""

    def step(a: Column, k: Column) -> Column:
        back = F.call_function("shiftleft", F.lit(1), k)
        return F.transform(a, lambda x, i: F.when(i >= back, join(x, F.get(a, i - back))).otherwise(x))

    rounds = F.ceil(F.log2(F.greatest(F.size(values), F.lit(1)).cast("double"))).cast("int")
    return F.aggregate(F.sequence(F.lit(0), rounds), values, step)


def match_spans(text: Column, rule: Rule, order: int) -> Column:
    """Spans (s, o, e) of the rule's matches, from the pieces between them; they hold only matches of enough length."""
    java = ("(?i)" if rule.fold else "") + rule.regex
    hits = F.regexp_extract_all(text, F.lit(java), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(java), F.lit(rule.group))
    # the last piece, behind all matches, meets none
    pieces = F.zip_with(F.split(text, java, -1), hits, lambda g, h: F.struct(F.char_length(g).alias("g"), F.char_length(h).alias("h")))
    rows = F.filter(F.zip_with(pieces, value, lambda x, v: F.struct(x["g"].alias("g"), x["h"].alias("h"), F.char_length(v).alias("v"))), lambda x: x["h"].isNotNull())

    def spans(row: Column) -> Column:
        ends = running(F.transform(row, lambda x: x["g"] + x["h"]), lambda a, b: a + b)
        placed = F.zip_with(row, ends, lambda x, e: F.struct((e - x["h"]).alias("s"), F.lit(order).alias("o"), e.alias("e"), x["v"].alias("v")))
        return F.transform(F.filter(placed, lambda x: x["v"] >= rule.least), lambda x: F.struct(x["s"].alias("s"), x["o"].alias("o"), x["e"].alias("e")))

    return bound(rows, spans)


def row_postings(low: Column, terms: list[str]) -> list[Column]:
    """The row's own entries of the index, as bits of long numbers: bit i % 60 of number i // 60 for the i-th term."""
    words = []
    for w in range(0, len(terms), 60):
        bits = [F.when(F.contains(low, F.lit(t)), F.lit(1 << i).cast("long")).otherwise(F.lit(0).cast("long")) for i, t in enumerate(terms[w : w + 60])]
        words.append(reduce(lambda a, b: a.bitwiseOR(b), bits))
    return words


def scan_secrets(docs: DataFrame, rules: tuple[Rule, ...] = RULES, name: str = "secret_spans", index: DataFrame | None = None) -> DataFrame:
    """docs with the column `name` (in place of one of that name): an array of (s, o, e), start, number of the rule and end, in that order.

    index: stored postings of these texts (trigram_postings); they are intersected by digest, and candidates come back to
    the rows by a join. Without one, each row's postings are made and intersected in the pass that verifies it, and no text
    is shuffled.
    """
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(whole, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("__text"))
    if index is None:
        terms = query_terms(rules)
        posted = rows.select("row", "__text", F.lower("__text").alias("__low"))
        posted = posted.select("row", "__text", *[c.alias(f"__m{w}") for w, c in enumerate(row_postings(F.col("__low"), terms))])
        keyed = posted.select("row", "__text", accepted(terms, rules).alias("__rules"))
    else:
        found = candidates(index, rules).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int").alias("__salt")
        keyed = rows.select("row", "__text", *_digest(), salt).join(found.hint("shuffle_hash"), ["__d1", "__d2", "__salt"], "left")
    none = F.array().cast("array<struct<s:int,o:int,e:int>>")
    parts = []
    for k, r in enumerate(rules):
        if trigram_query(r.regex) is None:
            # a run of the class in its least length is looked for first
            worth = F.col("__text").rlike(re.sub(r"\+$", "{%d}" % r.least, r.regex)) if r.group == 0 and r.regex.endswith("]+") else F.lit(True)
        else:
            worth = F.coalesce(F.col("__rules").bitwiseAND(F.lit(1 << k)) != 0, F.lit(False))
        parts.append(F.when(worth, match_spans(F.col("__text"), r, k)).otherwise(none))
    own = [F.col(f"row.`{c}`") for c in docs.columns if c.lower() != name.lower()]
    return keyed.select(*own, F.array_sort(F.concat(*parts)).alias(name))


def span_report(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans of every row, by the stored index."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    base = sum(r.base for r in rules)

    def text(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(kinds, x["o"] + 1), x["s"], x["e"])), ",")

    spans = F.col("secret_spans")

    def count(k: int) -> Column:
        return F.size(F.filter(spans, lambda x: x["o"] == k)).cast("long")

    counts = [count(k).alias(f"n_{r.kind}") for k, r in enumerate(rules[:base])]
    return scan_secrets(docs.select("doc_id", "text"), rules, index=stored_index(docs, rules)).select("doc_id", *counts, F.sha2(text(F.filter(spans, lambda x: x["o"] < base)).cast("binary"), 256).alias("base_sha256"), text(spans).alias("spans"))


def text_between(pieces: Column, a: Column, b: Column) -> Column:
    """Code points a to b of a text that is cut into pieces of PIECE: only the pieces between them are looked at."""
    first, last = F.floor(a / PIECE).cast("int"), F.floor(b / PIECE).cast("int")
    head = F.substring(F.get(pieces, first), a % PIECE + 1, F.least(b - a, F.lit(PIECE)))
    rest = F.concat(F.array_join(F.slice(pieces, first + 2, F.greatest(last - first - 1, F.lit(0))), ""), F.coalesce(F.substring(F.get(pieces, last), F.lit(1), b % PIECE), F.lit("")))
    return F.concat(F.coalesce(head, F.lit("")), F.when(last > first, rest).otherwise(F.lit("")))


def redact(docs: DataFrame, mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span of its text replaced by the mark; overlapping spans become one. Null texts stay null."""
    spans = shared_name(docs, "spans")
    pieces = F.regexp_extract_all(F.col("text"), F.lit("(?s).{1,%d}" % PIECE), F.lit(0))

    def blanked(cut: Column, found: Column, ends: Column) -> Column:
        before = F.transform(found, lambda x, i: F.struct(F.coalesce(F.get(ends, i - 1), F.lit(0)).alias("p"), x["s"].alias("s")))
        kept = F.transform(F.filter(before, lambda x: x["s"] >= x["p"]), lambda x: F.concat(text_between(cut, x["p"], x["s"]), F.lit(mark)))
        done = F.element_at(ends, -1)
        return F.concat(F.array_join(kept, ""), text_between(cut, done, F.greatest(done, F.char_length("text"))))

    def furthest(found: Column) -> Column:
        return running(F.transform(found, lambda x: x["e"]), lambda a, b: F.greatest(a, b))

    rest = bound(pieces, lambda cut: bound(F.col(spans), lambda found: bound(furthest(found), lambda ends: blanked(cut, found, ends))))
    new = F.when(F.size(spans) > 0, rest).otherwise(F.col("text"))
    return scan_secrets(docs, rules, spans, stored_index(docs, rules)).withColumn("text", new).select(*[F.col(f"`{c}`") for c in docs.columns])

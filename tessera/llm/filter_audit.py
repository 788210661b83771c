"""Audit of how document filters interact, from histograms of failure masks.

Native expressions give each text four bits, one for each filter that looks at the text alone; grouping by a digest of the
text supplies the smallest document id with that text, and with it the fifth bit, for rows that repeat a smaller id's text.
Each part is then 32 cells, counts by mask, and every order of the filters is worked out from the cells: what a step keeps
or removes hangs only on which filters came before it, so no order passes over the documents again.

The rows travel as digest, id, part and mask, never as texts; groups of copies and parts are combined map-side, and the join
that finds the smallest id of a text is on text and id together, so a large group of copies is spread. No Python is involved.

Null texts count as empty, null sources as the part ''. A null id is smaller than none and nothing is smaller than it, so
such a row never counts as a repeat; nor do rows that repeat both id and text. An id with several labels has those that any
of them gives. Very long texts are cut into words one text at a time. Ties don't occur: results are counts. An empty table
gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce
from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import written

#: The filters in order; filter k has bit 2^k of the mask.
FILTERS = "ABCDE"
CELLS = 1 << len(FILTERS)
SPACE = r"[\x20\x09-\x0D]+"


def text_mask(text: Column) -> Column:
    """Bits of the filters that fail on the text alone: few words, repeated words, capitals, marks."""
    words = F.filter(F.split(text, SPACE, -1), lambda w: w != "")
    fails = [
        F.size(words) < 50,
        100 * F.size(F.array_distinct(words)) < 65 * F.size(words),
        # a text without its capitals
        100 * (F.octet_length(text) - F.octet_length(F.regexp_replace(text, "[A-Z]+", ""))).cast("long") > 5 * F.char_length(text).cast("long"),
        text.rlike("[#$%&*|]"),
    ]
    return reduce(lambda a, b: a + b, [F.when(f, 1 << k).otherwise(0) for k, f in enumerate(fails)])


def failure_masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) of every document: its five failure bits, and whether its labels say quality 1 or toxic 1."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    facts = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    facts = written(facts.select("doc_id", "part", F.unhex(F.sha2(F.encode("text", "UTF-8"), 256)).alias("digest"), text_mask(F.col("text")).alias("mask")), "masks")
    first = facts.where("doc_id IS NOT NULL").groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    marks = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max((F.col("quality") == 1).cast("int")).alias("good"), F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
    known = facts.where("doc_id IS NOT NULL").join(marks, "doc_id", "left").join(first, ["digest", "doc_id"], "left")
    repeats = F.when(F.col("first").isNull(), 1 << 4).otherwise(0)
    known = known.select("part", (F.col("mask") + repeats).alias("mask"), F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    return known.unionByName(facts.where("doc_id IS NULL").select("part", "mask", F.lit(0).alias("good"), F.lit(0).alias("toxic")))


def mask_cells(masks: DataFrame) -> DataFrame:
    """(part, n, good, toxic): a row for each part, with arrays of counts by mask."""
    counts = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    arrays = [F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == m, F.col(c))), F.lit(0)).cast("long") for m in range(CELLS)]).alias(c) for c in ("n", "good", "toxic")]
    return counts.groupBy("part").agg(*arrays)


def _total(cells: str, wanted) -> Column:
    """The sum of the cells whose mask is wanted."""
    return F.aggregate(F.transform(F.col(cells), lambda x, m: F.when(wanted(m), x).otherwise(F.lit(0).cast("long"))), F.lit(0).cast("long"), lambda a, x: a + x)


def audit_orders(cells: DataFrame) -> DataFrame:
    """For each part, order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost and shapley."""
    orders = ["".join(p) for p in permutations(FILTERS)]
    steps = F.explode(F.array(*[F.lit(o) for o in orders])).alias("filter_order")
    rows = cells.select("part", "n", "good", "toxic", steps)
    # masks of the filters that come before each step, and the step's own
    bit = F.expr(f"transform(sequence(1, {len(FILTERS)}), i -> shiftleft(1, ascii(substring(filter_order, i, 1)) - {ord(FILTERS[0])}))")
    rows = rows.select("*", bit.alias("bits"), F.posexplode(bit).alias("at", "own"))
    rows = rows.withColumn("before", F.expr("aggregate(slice(bits, 1, at), 0, (a, b) -> a | b)"))
    own, before = F.col("own"), F.col("before")

    def clear(m: Column, mask: Column) -> Column:
        return m.bitwiseAND(mask) == 0

    first = lambda m: clear(m, before) & ~clear(m, own)
    # a document that fails several filters goes by each of them in an equal share of the orders; the count of orders is a multiple of 1 to 5
    share = F.expr(f"aggregate(transform(n, (x, m) -> if(m & own = 0, 0L, x * ({len(orders)}L div greatest(bit_count(m), 1)))), 0L, (a, x) -> a + x)")
    return rows.select(
        "part", "filter_order", (F.col("at") + 1).alias("step"),
        _total("n", lambda m: clear(m, before.bitwiseOR(own))).alias("kept"),
        _total("n", first).alias("removed"),
        _total("n", lambda m: ~clear(m, before) & ~clear(m, own)).alias("redundant"),
        F.get("n", own).alias("unique_fails"),
        _total("good", first).alias("good_lost"),
        _total("toxic", first).alias("toxic_lost"),
        share.alias("shapley"),
    )


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The audit of docs (doc_id, text, source) with labels (doc_id, quality, toxic), a row for each part, order and step."""
    return audit_orders(mask_cells(failure_masks(docs, labels)))

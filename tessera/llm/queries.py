"""One query for each operator, over its whole table, and its DuckDB form where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from tessera.llm import bpe, embed_dedup, filter_audit, html_text, media_ts, packing, phrase_dedup, quality_fm, secrets, sharding, simhash, source_audit, toxicity
from tessera.llm.common import crc_part, prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return prepare(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), vocabulary_path("word_bpe_49k.json"), 4096)


def op2_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(table(spark, sf_dir, "documents"), vocabulary_path("byte_bpe_50k.json"), with_ids=False)


def _scored(scores: DataFrame, modulus: int, held: int, threshold: float) -> DataFrame:
    # a null id is never held out
    return scores.select("doc_id", F.coalesce(crc_part(modulus) == held, F.lit(False)).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = toxicity.train(docs, table(spark, sf_dir, "labels"), crc_part(3) != 1)
    return _scored(toxicity.score_documents(docs, model), 3, 1, 0.7)


def op4_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op5_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), 0.9)


def op6_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract_pages(table(spark, sf_dir, "pages"))


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_rows(table(spark, sf_dir, "documents"), 8)


def op8_transport_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_ts.read_media(media_ts.write_media(table(spark, sf_dir, "documents")))


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.span_report(table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = quality_fm.train(docs, table(spark, sf_dir, "labels"), crc_part(5) != 0)
    return _scored(quality_fm.score_documents(docs, model), 5, 0, 0.3)


def op11_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_dedup.remove_passages(table(spark, sf_dir, "documents"), 35)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_audit.audit_sources(table(spark, sf_dir, "documents"), 30, 50)


def op13_filter_interactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES |= {f.__name__: f for f in (op1_best_fit_packing, op2_bpe_codec, op3_toxicity, op4_simhash_dedup, op5_embedding_dedup, op6_html_main_text, op7_hilbert_shards, op8_transport_streams, op9_secret_scan, op10_quality, op11_repeated_phrases, op12_source_divergence, op13_filter_interactions)}


def _secret_sql() -> str:
    """The same scan with DuckDB's list functions."""
    parts = []
    for k, r in enumerate(secrets.RULES):
        regex = (("(?i)" if r.fold else "") + r.regex).replace("'", "''")
        if r.group == 0 and r.regex == "[0-9a-f]+":
            regex = f"[0-9a-f]{{{r.least},}}"  # the same matches after the length filter, and far fewer
        parts.append(
            f"list_filter(list_transform(range(1, len(h{k}) + 1), lambda i: {{'s': list_sum(list_transform(g{k}[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h{k}[1:i - 1], lambda x: length(x))), 0), "
            f"'o': {k}, 'e': list_sum(list_transform(g{k}[1:i], lambda x: length(x))) + list_sum(list_transform(h{k}[1:i], lambda x: length(x))), 'n': length(v{k}[i])}}), lambda x: x.n >= {r.least})"
        )
    lists = ", ".join(
        f"regexp_split_to_array(t, '{rx}') AS g{k}, regexp_extract_all(t, '{rx}', 0) AS h{k}, regexp_extract_all(t, '{rx}', {r.group}) AS v{k}"
        for k, r in enumerate(secrets.RULES)
        for rx in [(f"[0-9a-f]{{{r.least},}}" if r.regex == "[0-9a-f]+" else ("(?i)" if r.fold else "") + r.regex).replace("'", "''")]
    )
    kinds = "[" + ", ".join(f"'{r.kind}'" for r in secrets.RULES) + "]"
    base = sum(r.base for r in secrets.RULES)
    text = "array_to_string(list_transform({}, lambda x: " + kinds + "[x.o + 1] || ':' || CAST(x.s AS BIGINT) || ':' || CAST(x.e AS BIGINT)), ',')"
    return f"""
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), l AS (SELECT doc_id, {lists} FROM d),
    s AS (SELECT doc_id, list_sort(flatten([{", ".join(parts)}])) AS a FROM l)
    SELECT doc_id, {", ".join(f"CAST(len(list_filter(a, lambda x: x.o = {k})) AS BIGINT) AS n_{r.kind}" for k, r in enumerate(secrets.RULES[:base]))},
    sha256({text.format(f"list_filter(a, lambda x: x.o < {base})")}) AS base_sha256, {text.format("a")} AS spans FROM s"""


ORACLE["op9_secret_scan"] = _secret_sql()


#: The words, shares and ranks of each source of a language, with whole numbers of 128 bits.
ORACLE["op12_source_divergence"] = r"""
    WITH d AS (SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
      translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
    w AS (SELECT doc, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
    k AS (SELECT lang, term FROM w GROUP BY ALL HAVING count(DISTINCT doc) >= 30),
    v AS (SELECT lang, count(*) AS v FROM k GROUP BY ALL),
    c AS (SELECT lang, source, term, count(*) AS c FROM w SEMI JOIN k USING (lang, term) GROUP BY ALL),
    g AS (SELECT DISTINCT lang, source FROM d),
    n AS (SELECT g.lang, g.source, coalesce(sum(c), 0) AS n FROM g LEFT JOIN c USING (lang, source) GROUP BY ALL),
    p AS (SELECT n.lang, n.source, k.term, coalesce(c.c, 0) AS c, CAST(1 + CAST(1000000000 AS HUGEINT) * (coalesce(c.c, 0) + 5) // (CAST(n.n AS HUGEINT) + 5 * v.v) AS BIGINT) AS p
      FROM n JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = n.lang AND c.source = n.source AND c.term = k.term),
    l AS (SELECT lang, term, sum(c) AS c FROM c GROUP BY ALL), ln AS (SELECT lang, sum(n) AS n FROM n GROUP BY ALL),
    q AS (SELECT l.lang, l.term, CAST(1 + CAST(1000000000 AS HUGEINT) * (l.c + 5) // (CAST(ln.n AS HUGEINT) + 5 * v.v) AS BIGINT) AS q FROM l JOIN ln USING (lang) JOIN v USING (lang)),
    a AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
    pairs AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, coalesce(a.value, 0) AS value FROM g x JOIN g y ON x.lang = y.lang AND x.source <> y.source LEFT JOIN a ON a.lang = x.lang AND a.source = x.source AND a.item = y.source),
    terms AS (SELECT p.lang, p.source, 'term' AS part, p.term AS item, p.p - q.q AS value FROM p JOIN q USING (lang, term) WHERE p.c > 0 AND p.p > q.q),
    r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
    SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50"""

#: Each document's five failures, then every order of the filters over the counts by failures.
ORACLE["op13_filter_interactions"] = r"""
    WITH RECURSIVE d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
    w AS (SELECT doc_id, part, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, min(doc_id) OVER (PARTITION BY t) AS least FROM d),
    l AS (SELECT doc_id, max(CAST(quality = 1 AS INT)) AS good, max(CAST(toxic = 1 AS INT)) AS toxic FROM labels GROUP BY ALL),
    m AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
      CASE WHEN len(w) < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 2 ELSE 0 END
      + CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * length(t) THEN 4 ELSE 0 END
      + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN coalesce(doc_id > least, false) THEN 16 ELSE 0 END AS mask
      FROM w LEFT JOIN l USING (doc_id)),
    c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY ALL),
    f(letter, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
    o(filter_order, step, before, bit) AS (SELECT '', 0, 0, 0 UNION ALL SELECT filter_order || letter, step + 1, before | o.bit, f.bit FROM o JOIN f ON NOT contains(filter_order, letter) WHERE step < 5),
    s AS (SELECT x.filter_order, y.step, y.before, y.bit FROM o x JOIN o y ON starts_with(x.filter_order, y.filter_order) WHERE x.step = 5 AND y.step > 0),
    r AS (SELECT part, filter_order, step, bit,
      CAST(sum(n) FILTER (mask & (before | bit) = 0) AS BIGINT) AS kept, CAST(sum(n) FILTER (mask & before = 0 AND mask & bit <> 0) AS BIGINT) AS removed,
      CAST(sum(n) FILTER (mask & before <> 0 AND mask & bit <> 0) AS BIGINT) AS redundant, CAST(sum(n) FILTER (mask = bit) AS BIGINT) AS unique_fails,
      CAST(sum(good) FILTER (mask & before = 0 AND mask & bit <> 0) AS BIGINT) AS good_lost, CAST(sum(toxic) FILTER (mask & before = 0 AND mask & bit <> 0) AS BIGINT) AS toxic_lost
      FROM c CROSS JOIN s GROUP BY part, filter_order, step, bit)
    SELECT part, filter_order, CAST(step AS INT) AS step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
      coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, bit) AS BIGINT) AS shapley FROM r"""

import corpus_pipeline
from tessera.llm import secrets, simhash
from tests.llm.test_near_duplicates import brute_similar


def test_run(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    cur, kept = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        cur = stage(spark, cur, sf)
        kept[name] = cur.collect()
        if name != "packing":
            assert cur.columns == docs.columns and cur.dtypes == docs.dtypes
            cur = spark.createDataFrame(kept[name], docs.schema)
    labels = {r.doc_id: r for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    one, two, three, four = ({r.doc_id for r in kept[n]} for n in ("quality", "toxicity", "near_duplicates", "secrets"))
    assert three == four and three <= two <= one
    assert sum(i in one for i, r in labels.items() if r.quality) >= 0.95 * sum(bool(r.quality) for r in labels.values())
    ids, texts = zip(*((r.doc_id, r.text) for r in kept["toxicity"]), strict=True)
    assert three == set(brute_similar(ids, texts))
    assert all(not r.secret_spans for r in secrets.scan_secrets(spark.createDataFrame(kept["secrets"], docs.schema)).collect())
    assert {r.doc_id for r in kept["packing"]} == four
    assert len(corpus_pipeline.run(spark, sf).collect()) == len(kept["packing"])


def test_odd_rows(spark, odd_docs, no_docs, sf):
    for docs in (odd_docs, no_docs):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, sf)
            assert out.columns == docs.columns or name == "packing"
            assert out.count() <= docs.count() or name == "packing"
    assert simhash.deduplicate(odd_docs).count() < odd_docs.count()

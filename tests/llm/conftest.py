from __future__ import annotations

import pytest

CLASHING = ("__fp", "__uid", "uid", "__salt", "__text", "__low", "__m0", "__d1", "__rules", "__spans", "spans", "secret_spans", "slot", "place", "shard", "_shard", "cell", "sub", "row", "crc", "error", "held_out", "__y")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, length string, fp int, `key` string, score double, root string, y int, offset int, " + ", ".join(f"{c} int" for c in CLASHING)
LONG = "Zażółć gęślą jaźń " * 20_000


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and very long texts, repeated rows, tied ids, and names that operators might use."""
    rest = ("en", "src0", 10, "x", 1, "k", 0.5, "r", 1, 2, *range(len(CLASHING)))
    rows = [(None,) * (12 + len(CLASHING)), (1, "", *rest), (2, None, *rest), (3, LONG, *rest), (3, LONG, *rest), (4, "Alpha beta gamma delta.", *(None,) * (10 + len(CLASHING))), (4, "Other words with tied id", *rest)]
    rows += [(5, " \t\n ", *rest), (6, "naïve 漢字 😀 <|endoftext|> 'tis", *rest), (7, "Alpha beta gamma delta.", *rest), (None, "Alpha beta gamma delta.", *rest)]
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


def byte_path():
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def word_path():
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")

"""Tables with blank texts alone."""

import pytest

from codestrata.llm import bpe, media, near_dup, packing, quality, rules, secrets, token_counts

DOCUMENTS = "doc_id long, text string"
NO_LABELS = "doc_id long, quality int"


@pytest.mark.parametrize("texts", [["", None], [" ", "\n"], ["\x00"]])
def test_blank_texts(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), DOCUMENTS)
    labels = spark.createDataFrame([(0, 1), (1, 0)], NO_LABELS)
    contracts = [bpe.digests, secrets.scan, media.stored_features, near_dup.contract, lambda d: quality.contract(d, labels), token_counts.over_limit, packing.pieces, rules.contract]
    for contract in contracts:
        assert {r.doc_id for r in contract(rows).collect()} == set(range(len(texts)))

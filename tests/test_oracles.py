"""A part of the catalogue against its SQL on the smallest tables; tests/oracle.py runs all of it."""

import os

import pytest

from docfathom.plans import ORACLES, QUERIES
from docfathom.plans.registry import WRITERS
from tests.oracle import compare, duck

SF = "/root/testdata/sf0.001"
SOME = ["bm25_topk", "corpus_stats", "knn_cosine_topk", "rrf_fusion", "events_rollup", "access_ema_prefetch", "merge_small_chunks", "readability", "graph_components", "terminology_scores", "code_parse", "provider_pick"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", SOME)
def test_oracle(spark, name):
    assert compare(spark, SF, QUERIES[name], ORACLES[name], duck(SF)) == ""


@pytest.mark.skipif(not os.path.isdir(SF), reason="no tables here")
@pytest.mark.parametrize("name", sorted(WRITERS))
def test_queries_that_write(spark, name):
    assert compare(spark, SF, QUERIES[name], WRITERS[name], duck(SF)) == ""

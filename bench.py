"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from docfathom.plans import QUERIES
from docfathom.session import session

SF = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
HEADLINE = ["bm25_topk", "bm25_benchmark_batch", "term_stats", "word_frequency_top", "counts_by_source", "tf_fallback_topk", "knn_cosine_topk", "rrf_fusion", "linear_fusion", "rerank_light", "persona_supervisor",
            "events_rollup", "events_time_bucket", "window_metrics_p99", "chunk_quality", "merge_small_chunks", "redact", "readability", "terminology_scores", "keyword_topk_per_doc", "html_text", "recursive_chunks",
            "shared_value_edges", "graph_components", "clustering_coeff", "code_parse"]


def main() -> None:
    spark = session("bench", cores=CPUS)
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in HEADLINE:
        at = time.time()
        QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
        took[name] = round(time.time() - at, 3)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()

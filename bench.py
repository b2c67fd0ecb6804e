"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from litspark.queries import QUERIES
from litspark.session import build_session

HEADLINE = [
    "sliding_chunks", "keyword_index_df", "keyword_topk", "keyword_topk_filtered", "dense_topk", "rrf_fusion",
    "hybrid_retrieve", "answer_confidence_scores", "paper_quality", "corpus_grade", "length_stats", "corpus_stats",
    "jats_sections", "html_text", "regulatory_join", "post_process", "card_finish", "judge_all", "eval_grouped",
    "context_budget", "merge_protected", "upsert_latest", "eav_pivot", "latency_percentiles", "rate_limit_exact",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("litspark-bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus if cpus.isdigit() else "8", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    # Starts the JVM's code paths and the Python workers; not a measured query.
    spark.range(1000).selectExpr("sum(id)").collect()
    took: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - start, 3)
    chunks = QUERIES["sliding_chunks"](spark, sf_dir).count()
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus, "chunks": chunks,
        "index_chunks_per_sec": round(chunks / took["keyword_index_df"], 1)}))
    spark.stop()


if __name__ == "__main__":
    main()

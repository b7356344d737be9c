"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local threads.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from phrasebench.queries import QUERIES  # noqa: E402
from phrasebench.session import build_session  # noqa: E402

HEADLINE = [
    "type_token_ratio", "profile_overview", "kde_len", "group_split", "entity_split", "within_entity_split",
    "entity_bank", "phrase_match", "dense_top5", "dense_metrics", "lexical_stats", "bm25_top10",
    "bm25_recall_curve", "hybrid_bank", "hybrid_pool", "hybrid_vectors", "phrase_boost_search", "hybrid_rerank",
    "hard_negatives", "positive_pairs", "tfidf_top_terms", "roc_points", "a26_roc_orders", "calibration",
    "threshold_coverage", "model_gains",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": str(2 * int(cpus)), "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in names:
        start = time.time()
        QUERIES[name](spark, root).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": Path(root).name.removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Prepared data and fitted models are written once per session and shared, so the first query of a
view pays for them ("prepare_*" and "fit_*" entries time those parts on their own).
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from catalog import views
from catalog.queries import QUERIES
from kindred.session import local_session

HEADLINE = [
    "normalize_purchases", "violation_counts", "split_seeded", "transition_pairs",
    "prefix_examples", "itemknn_topn", "cooccurrence_min2", "tfidf_similarity", "semantic_topn",
    "embedding_topn", "score_popularity", "score_itemknn", "score_tfidf_factored",
    "rrf_purchases", "weighted_purchases", "hybrid_top10", "recommend_sessions",
    "metrics_popularity", "normalized_edges", "propagate_2_layers", "bpr_top10",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}

    def timed(name: str, work) -> None:
        start = time.perf_counter()
        work()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)

    def ready(prepared) -> None:
        prepared.ratings("train")
        prepared.ratings("test")
        prepared.indexed_items.count()

    timed("prepare_purchases", lambda: ready(views.prepared_purchases(spark, sf)))
    timed("prepare_clicks", lambda: ready(views.prepared_clicks(spark, sf)))
    timed("fit_popularity", lambda: views.model(spark, sf, "purchases", "popularity"))
    timed("fit_itemknn", lambda: views.model(spark, sf, "purchases", "itemknn", neighbours=20))
    names = sys.argv[1:] or HEADLINE
    for name in names:
        timed(name, lambda: QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save())
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf.rstrip("/").rsplit("/sf", 1)[-1],
    }))


if __name__ == "__main__":
    main()

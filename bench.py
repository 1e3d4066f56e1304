"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
os.environ["PYTHONPATH"] = os.pathsep.join([sys.path[0], os.environ.get("PYTHONPATH", "")])

QUERIES = [
    "rank_callers", "rank_dependents", "coupling_namespace", "file_graph_edges", "impact_depth3", "cochange_pairs",
    "structural_diff_counts", "entity_observations", "lexical_bm25_or", "idf_table", "hashed_embedding", "knn_l2", "hybrid_rrf",
    "fuzzy_query", "incremental_merge", "rename_overlap_running",
]


def main() -> None:
    from quarrymap.plans.catalog import QUERIES as known
    from quarrymap.session import local_session

    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", cores=os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in QUERIES:
        for again in (False, True):  # the second run counts: code is compiled then
            start = time.time()
            known[name](spark, sf).write.format("noop").mode("overwrite").save()
            took[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf}))


if __name__ == "__main__":
    main()

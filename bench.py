"""Headline queries on one machine; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores. The five stages of the
published baseline come first, then the heavy joins, windows and iterations.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from contrasieve import plans  # noqa: E402
from contrasieve.session import build_session  # noqa: E402

HEADLINE = [
    # text features and triage
    "x2_tfidf", "t11_markers", "r1_triage", "x6_log_odds", "x7_domain_terms",
    # classification
    "m6_out_of_fold", "m16_pu_centroid", "m9_curve_areas", "m10_threshold_sweep",
    # topics and clusters
    "x12_lda_topics", "k4_kmeans_sweep", "k6_gaussian_mixture",
    # outliers
    "k10_isolation_forest", "k11_local_outlier_factor", "k12_novelty", "k13_detector_ensemble",
    # joins, profiles, graph, series
    "a3_value_profile", "a14_pair_aggregate", "j11_co_occurrence", "k1_knn_graph", "w4_percentile_rank",
    "g3_page_rank", "g9_connected_components", "r5_signal_count", "ts2_decompose",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = plans.load()
    spark.read.parquet(f"{folder}/lineitem.parquet").count()  # start the engine outside the clock
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": Path(folder).name}))
    spark.stop()


if __name__ == "__main__":
    main()

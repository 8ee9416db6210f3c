"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: the median of three warm runs each, as one line of JSON."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from pyspark.sql import SparkSession

from vexel.plans import catalog

HEADLINE = ["knn_exact_l2", "knn_hamming", "rerank_hamming_l2", "cluster_probe_exact", "knn_triangle_inequality", "pq_encode", "adc_search_heap", "adc_search_ea", "adc_search_fast2",
            "adc_search_ti", "adc_search_visit", "adc_refine", "gram_matrix", "kmeans_lloyd_3iter", "vaq_search_end_to_end", "metrics_recall"]
RUNS = 3


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
             .config("spark.driver.memory", "8g").config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        times = []
        for _ in range(RUNS + 1):
            began = time.perf_counter()
            catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(median(times[1:]), 3)
    recall = {n: catalog.QUERIES[n](spark, sf).first().value for n in ("metrics_recall", "metrics_recall_at_r", "metrics_map")}
    spark.stop()
    print(json.dumps({"metric": "total of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "recall": recall, "sf": sf}))


if __name__ == "__main__":
    main()

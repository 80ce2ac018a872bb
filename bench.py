"""Time the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import time

from pyspark.sql import SparkSession

from quillon.plans import applied, queries

QUERIES = queries.QUERIES | applied.QUERIES

HEADLINE = ["scan_filter_project", "group_all_aggregates", "join_three_pushdown", "order_nulls_desc", "topk", "radius_haversine", "knn", "polygon_concave_border", "join_radius_group", "text_lexicon", "bm25", "tfidf", "bm25_indexed", "tfidf_indexed", "knn_cosine", "knn_euclidean", "chunk_words", "rrf_fusion"]


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        for last in (False, True):
            began = time.perf_counter()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            if last:
                times[name] = round(time.perf_counter() - began, 4)
    print(json.dumps({"metric": "headline queries, total", "value": round(sum(times.values()), 4), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()

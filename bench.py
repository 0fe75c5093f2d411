"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import functions as F

from taskatlas.operators import similarity
from taskatlas.operators.embedding import encode_text
from taskatlas.plans.catalog import QUERIES
from taskatlas.plans.runs import ensemble_run
from taskatlas.session import local_session
from taskatlas.sources.storage import clear_scratch

HEADLINE = (
    "p1_clean_text", "d1_drop_identical", "d2_keep_first", "v1_encode_text", "c1_zero_shot_text", "c1_zero_shot", "c2_models",
    "c3_vote", "c3_vote_long", "a21_pair_agreement", "f8_similar_pairs", "v12_top_k", "v12_top_k_blocked", "v12_top_k_by_year_blocked", "v13_approximate_top_k",
    "a5_similarity_distribution", "a7_match_counts", "a10_exposure", "a11_exposure_wide", "a13_top_occupations", "a14_growth",
    "w1_contributions", "w4_flow_links", "q5_quadrants", "q6_outliers", "q11_top_priority", "r1_wide_to_long",
    "s4_category_results", "i1_label_stream", "i3_running_totals", "run_neighbours_by_year", "run_exposure",
)


# Larger inputs than the given vectors: votes on one row per order, matches of all parts with all documents.
MODELS = 5


def votes(spark, sf_dir):
    ids = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey")
    models = [
        ids.select(
            F.col("o_orderkey").alias("application_id"),
            F.concat(F.lit("c"), F.pmod(F.xxhash64("o_orderkey", F.lit(i)), F.lit(4))).alias("category"),
            (F.pmod(F.xxhash64(F.lit(i), "o_orderkey"), F.lit(1000)) / 1000).alias("confidence"),
        )
        for i in range(MODELS)
    ]
    return ensemble_run(models), ids.count()


def counts(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").alias("id"), "text", F.col("lang").alias("category"), F.lit(2021).alias("year"))
    parts = spark.read.parquet(f"{sf_dir}/part.parquet").select(F.col("p_partkey").alias("qid"), F.concat_ws(" ", "p_name", "p_type").alias("task"))
    side = encode_text(docs, "text").select("id", "vec", "category", "year")
    return similarity.match_counts(encode_text(parts, "task").select("qid", "vec"), side, threshold=0.3, k=500), docs.count()


RATES = {"vote_ids": votes, "match_documents": counts}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "taskatlas-bench")
    spark.range(1000).selectExpr("sum(id)").collect()  # start-up is not part of a query
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        # The noop sink runs every row and column without a driver collect.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    rates = {}
    for name, case in RATES.items():
        start = time.perf_counter()
        df, rows = case(spark, sf_dir)
        df.write.format("noop").mode("overwrite").save()
        seconds[f"rate_{name}"] = round(time.perf_counter() - start, 3)
        rates[name] = {"rows": rows, "rows_per_sec": round(rows / seconds[f"rate_{name}"], 1)}
    clear_scratch(spark)
    spark.stop()
    total = round(sum(seconds.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": seconds, "rates": rates, "sf": sf_dir.rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()

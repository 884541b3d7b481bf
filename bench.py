"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query's result goes to Spark's noop sink, so every row and column is computed and nothing is collected.
"""
import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from evisets.queries import queries

HEADLINE = (
    "scan_set_lists", "combine_evidence", "near_join", "nearest_entity", "set_moments", "assoc_marginal_linear", "assoc_enrichment_q",
    "assoc_marginal_logistic", "list_enrichment", "correlated_pairs", "prune_correlated", "shrink_independent", "prior_from_effects", "loco_priors",
    "cross_validation_best", "shrink_joint_one_round", "trait_compare_diagnostic", "score_variants", "clump", "entity_log_bf", "locus_evidence",
    "factor_metrics", "factor_trait_adjusted", "ard_nmf", "capture", "support_run",
)


def main():
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    shuffle = str(max(8, int(cpus) if cpus.isdigit() else 8))
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.sql.shuffle.partitions", shuffle)
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "16g").config("spark.sql.adaptive.enabled", "true").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf}/part.parquet").groupBy("p_brand").count().write.format("noop").mode("overwrite").save()  # start the JVM's pools
    known, times = queries(), {}
    only = sys.argv[1:]
    for name in HEADLINE:
        if only and name not in only:
            continue
        start = time.perf_counter()
        known[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()

"""Bench: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

The given tables are single row groups, which Parquet cannot split; the bench
first copies them to a scratch folder in as many files as there are cores, as a
large table would lie. Every query is timed from a cold scan of that copy; the
library itself keeps nothing between queries.

Each query is forced with the ``noop`` sink (full computation, nothing
collected to the driver). A warm-up pass on the smallest scale runs first so
JVM start-up and code generation are not timed.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidecorpus.plans.registry import load_all  # noqa: E402
from tidecorpus.session import local_session  # noqa: E402

# main input table of each headline query (for input rows per second)
INPUT = {
    "p10_min_length_filter": "documents", "t1_social_normalise": "documents", "e2_word_vocabulary": "documents",
    "e9_e12_padded_masks": "documents", "e13_dynamic_padding": "documents", "e18_mlm_masking": "documents",
    "d1_stratified_split": "labels", "a7_category_report": "embeddings", "a9_single_label_report": "embeddings",
    "a16_kruskal_wallis": "events", "a15_bootstrap_ci": "events",
}

HEADLINE = [
    "p10_min_length_filter",      # corpus filter slice
    "t1_social_normalise",        # full tweet normaliser over whole texts
    "e2_word_vocabulary",         # vocabulary aggregates
    "e9_e12_padded_masks",        # encode + assemble + pad + masks
    "e13_dynamic_padding",        # batch + dynamic padding
    "e18_mlm_masking",            # masking
    "d1_stratified_split",        # exact stratified split
    "a7_category_report",         # multi-label report
    "a9_single_label_report",     # single-label report
    "a16_kruskal_wallis",         # rank test
    "a15_bootstrap_ci",           # bootstrap intervals
]


def run(spark, reg, name, sf_dir):
    t0 = time.perf_counter()
    reg[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def spread_copy(spark, sf_dir, parts):
    """The bench's tables in ``parts`` files each, in a new scratch folder."""
    out = tempfile.mkdtemp(prefix="tidecorpus-bench-")
    for t in sorted(set(INPUT.values()) | {"documents", "labels"}):
        spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")).repartition(parts).write.parquet(os.path.join(out, f"{t}.parquet"))
    return out


def main():
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, shuffle_partitions=int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", "16")), app="tidecorpus-bench")
    reg = load_all()
    warm = "/root/testdata/sf0.001"
    if os.path.isdir(warm):
        for name in HEADLINE:
            run(spark, reg, name, warm)
    given, sf_dir = sf_dir, spread_copy(spark, sf_dir, max(1, spark.sparkContext.defaultParallelism))
    times = {name: round(run(spark, reg, name, sf_dir), 3) for name in HEADLINE}
    rows = {t: spark.read.parquet(os.path.join(sf_dir, f"{t}.parquet")).count() for t in set(INPUT.values())}
    docs = rows["documents"]
    sf = os.path.basename(given.rstrip("/")).replace("sf", "")
    total = round(sum(times.values()), 3)
    print(json.dumps({
        "metric": "headline_total",
        "value": total,
        "unit": "sec",
        "queries": times,
        "sf": float(sf) if sf.replace(".", "").isdigit() else sf,
        "cores": int(cpus) if str(cpus).isdigit() else cpus,
        "filter_rows_per_sec": round(docs / times["p10_min_length_filter"], 1),
        "input_rows_per_sec": {q: round(rows[INPUT[q]] / s, 1) for q, s in times.items()},
    }))
    spark.stop()


if __name__ == "__main__":
    main()

"""Command line for the jobs: ``python -m tidecorpus <job> …`` or, on a cluster,
``spark-submit tidecorpus/__main__.py <job> …``. The session comes from the
environment (cluster settings, ``spark.checkpoint.dir``); ``--master`` is only
for local runs."""

from __future__ import annotations

import argparse
import os
import sys

if __package__ in (None, ""):  # run as a file by spark-submit
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    __package__ = "tidecorpus"

from pyspark.sql import SparkSession  # noqa: E402

from tidecorpus import jobs  # noqa: E402
from tidecorpus.operators.vocab import load_model  # noqa: E402
from tidecorpus.session import ensure_checkpoint_dir  # noqa: E402


def _session(master: str | None) -> SparkSession:
    b = SparkSession.builder.appName("tidecorpus")
    if master:
        b = b.master(master).config("spark.ui.enabled", "false")
    spark = b.getOrCreate()
    ensure_checkpoint_dir(spark)
    return spark


def main(argv=None) -> int:
    p = argparse.ArgumentParser(prog="tidecorpus")
    p.add_argument("--master", default=None, help="only for local runs, e.g. local[8]")
    sub = p.add_subparsers(dest="job", required=True)

    f = sub.add_parser("filter-tweets")
    f.add_argument("in_dir"), f.add_argument("out_dir"), f.add_argument("num_workers", type=int, nargs="?", default=None)

    g = sub.add_parser("generate-dataset")
    g.add_argument("input_path"), g.add_argument("output_path")
    g.add_argument("--num-files", type=int, default=6), g.add_argument("--limit", type=int, default=None)

    t = sub.add_parser("train-tokenizer")
    t.add_argument("train_path"), t.add_argument("output_path")
    t.add_argument("--lowercase", action="store_true"), t.add_argument("--strip-accents", action="store_true")
    t.add_argument("--vocab-size", type=int, default=30_000), t.add_argument("--min-frequency", type=int, default=10)
    t.add_argument("--limit-alphabet", type=int, default=400), t.add_argument("--num-files", type=int, default=40)
    t.add_argument("--merges-per-round", type=int, default=32)

    m = sub.add_parser("prepare-mlm")
    m.add_argument("files"), m.add_argument("tokenizer_dir"), m.add_argument("output_path")
    m.add_argument("--max-length", type=int, default=128), m.add_argument("--batch-size", type=int, default=1024)
    m.add_argument("--mlm-probability", type=float, default=0.15), m.add_argument("--seed", type=int, default=2021)

    s = sub.add_parser("summarise")
    s.add_argument("ledger_glob")

    a = p.parse_args(argv)
    spark = _session(a.master)
    if a.job == "filter-tweets":
        n = jobs.filter_tweets(spark, a.in_dir, a.out_dir, a.num_workers).count()
        print(f"kept {n} lines in {a.out_dir}")
    elif a.job == "generate-dataset":
        ds = jobs.generate_dataset(spark, a.input_path, a.output_path, a.num_files, a.limit)
        ds.groupBy("split").count().show()
    elif a.job == "train-tokenizer":
        model = jobs.train_tokenizer(
            spark, a.train_path, a.output_path, a.strip_accents, a.lowercase, a.vocab_size, a.min_frequency,
            a.limit_alphabet, a.num_files, a.merges_per_round,
        )
        print(f"vocabulary of {model.vocab.count()} saved to {a.output_path}")
    elif a.job == "prepare-mlm":
        model = load_model(spark, a.tokenizer_dir)
        out = jobs.prepare_mlm(spark, a.files, model, a.output_path, a.max_length, a.batch_size, a.mlm_probability, a.seed)
        print(f"{out.count()} encoded rows in {a.output_path}")
    elif a.job == "summarise":
        jobs.summarise_benchmarks(spark, a.ledger_glob).show(truncate=False)
    return 0


if __name__ == "__main__":
    sys.exit(main())

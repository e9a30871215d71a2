"""End-to-end jobs: the reference's entry points as Spark pipelines.

* ``filter_tweets``      – line files → keep texts with ≥ 6 tokens → sharded text files (§3.1)
* ``generate_dataset``   – sample k files, the last is test → optional per-split limit → parquet (D3, L4, S8)
* ``train_tokenizer``    – first k sorted files → tokenizer normaliser → BPE → saved vocabulary (L5, T15, E1, S13)
* ``prepare_mlm``        – lines → encode → truncate / assemble / pad → batches → masking → parquet (§3.2)
* ``summarise_benchmarks`` – ledgers → headline metrics → mean ± std table and scores (§3.3)
* ``evaluate_run`` / ``class_weights`` – one run's metric set from a predictions table, appended
  to the ledger store; the per-task class weighting rule (§3.3 stages 5, 7, 8)

Task sets themselves come from ``operators.task_loaders`` (D6).

Each job is a composition of the library's DataFrame operators; none collects
rows to the driver (only bounded tables: vocabulary, merge list, one best pair
per merge round).
"""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import constants as K
from .functions import text as tx
from .operators import encode as en
from .operators import results as rs
from .operators import vocab as vb
from .operators import wordpiece
from .operators.scan_order import number_lines, with_batches
from .operators.splits import file_holdout, text_hash
from .plans.corpus import filter_corpus
from .sources import sinks
from .sources.text import list_files, non_blank, read_ledgers, read_lines


def filter_tweets(
    spark: SparkSession, in_dir: str, out_dir: str, num_workers: int | None = None, min_tokens: int = K.MIN_TOKENS, vocab_file: str | None = None
) -> DataFrame:
    """§3.1: one pass without a shuffle (``num_workers`` files only if asked for); the original text is kept.
    With ``vocab_file`` (a published WordPiece vocabulary) lengths count its pieces, the four added tokens
    being one each; without, words."""
    lines = read_lines(spark, in_dir, "*.txt")
    if vocab_file:
        kept = wordpiece.filter_corpus(lines, wordpiece.read_vocabulary(spark, vocab_file), "value", min_tokens)
    else:
        kept = filter_corpus(lines, "value", min_tokens)
    sinks.write_shards(kept, out_dir, num_workers)
    return spark.read.text(out_dir)


def generate_dataset(
    spark: SparkSession, input_path: str, output_path: str, num_files: int = 6, limit: int | None = None, seed: int = 2021
) -> DataFrame:
    """D3: ``num_files`` files sampled by a seeded hash (repeatable), the last one
    is test; with ``limit`` each split keeps its first ``limit`` lines and fewer
    lines is an error (L4); saved with ``split`` as partition column (S8)."""
    files = list_files(spark, input_path, "*.txt")
    chosen = [r["file_path"] for r in files.orderBy(text_hash("file_path", seed), "file_path").limit(num_files).collect()]  # num_files names
    lines = read_lines(spark, chosen, "*.txt")  # only the chosen files are read
    held = file_holdout(lines, "file_path", num_files, seed)
    if limit:
        held = number_lines(held, ["split"], "_pos")
        short = held.groupBy("split").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") < limit).count()
        if short:
            raise ValueError(f"a split has fewer than {limit} lines")
        held = held.filter(F.col("_pos") < limit)
    out = held.select(F.col("value").alias("text"), "split")
    sinks.save_dataset(out, output_path)
    return sinks.load_dataset(spark, output_path)


def train_tokenizer(
    spark: SparkSession,
    train_path: str,
    output_path: str,
    strip_accents: bool = False,
    lowercase: bool = False,
    vocab_size: int = K.VOCAB_SIZE,
    min_frequency: int = K.MIN_FREQUENCY,
    limit_alphabet: int = K.LIMIT_ALPHABET,
    num_files: int = K.NUM_FILES,
    merges_per_round: int = 32,
    prefix: str | None = None,
) -> vb.BpeModel:
    """L5 + T15 + E1 + S13: the first ``num_files`` files in sorted order,
    normalised like the tokenizer does, trained, and saved."""
    first = [r["file_path"] for r in list_files(spark, train_path, "*.txt").orderBy("file_path").limit(num_files).collect()]  # num_files names
    lines = read_lines(spark, first, "*.txt")  # only these files are read
    text = tx.tokenizer_normalise("value", lowercase=lowercase, strip_accents=strip_accents)
    model = vb.train_bpe(
        lines.select(text.alias("text")), "text", vocab_size, min_frequency, limit_alphabet, merges_per_round=merges_per_round
    )
    if "://" not in output_path:
        os.makedirs(output_path, exist_ok=True)  # the job creates its folder; save_vocabulary (S13) requires one
    vb.save_vocabulary(model, output_path, prefix)
    vb.save_vocabulary_files(model, output_path, prefix)
    return model


def prepare_mlm(
    spark: SparkSession,
    files: str | Sequence[str],
    model: vb.BpeModel,
    output_path: str,
    max_length: int = K.MAX_LENGTH,
    batch_size: int = K.ENCODE_BATCH,
    mlm_probability: float = K.MLM_PROBABILITY,
    seed: int = 2021,
    lowercase: bool = True,
    strip_accents: bool = False,
) -> DataFrame:
    """§3.2: S1 → S3 → T15 → E4 → E5 → E10 → E7/E8/E12/E9 → E15 → E18 → parquet.

    Batches run across files in (file, offset, position) order; masks are keyed by
    a line's index in that order, so a rerun gives the same masks however the
    files are split over tasks.
    """
    lines = non_blank(read_lines(spark, files, "*"))
    text = tx.tokenizer_normalise("value", lowercase=lowercase, strip_accents=strip_accents)
    enc = vb.bpe_id_encoder(spark, model)  # pieces → ids inside the task: no shuffle before batching
    # numbers in scan order: only line counts by block are shuffled, no line and no array
    seq = with_batches(number_lines(lines), batch_size)
    seq = seq.select("row_index", "batch_id", "pos_in_batch", en.truncate(enc(text), max_length).alias("body"))
    seq = seq.select(
        "row_index", "batch_id", "pos_in_batch",
        en.pad(en.build_inputs("body"), max_length).alias("input_ids"),
        en.pad(en.special_tokens_mask("body"), max_length, 1).alias("special_tokens_mask"),
    )
    seq = seq.withColumn("attention_mask", en.attention_mask("input_ids")).withColumn("token_type_ids", en.token_type_ids("input_ids"))
    vocab_n = model.vocab.count()
    masked, labels = en.mlm_mask("input_ids", "special_tokens_mask", "row_index", seed, vocab_n, mlm_probability)
    out = seq.select(
        "batch_id", "pos_in_batch", masked.alias("input_ids"), "attention_mask", "token_type_ids", labels.alias("labels")
    )
    return sinks.encode_once(out, output_path)


def summarise_benchmarks(spark: SparkSession, ledger_glob: str, task_metric: dict | None = None, order: Sequence[str] | None = None) -> DataFrame:
    """§3.3: ledgers → headline metric per task → ``mean +- std`` per task (×100,
    population std) in one row per model, with the four-task and five-task scores."""
    long = read_ledgers(spark, ledger_glob)
    head = rs.headline(long, rs.headline_dim(spark, task_metric or K.TASK_METRIC))
    ms = rs.mean_std(head, ("model", "task"))
    wide = rs.wide_by(ms, "model", "task", K.SCORE_TASKS_FIVE, "text")
    scores = rs.composite_score(ms, K.SCORE_TASKS_FOUR).join(rs.composite_score(ms, K.SCORE_TASKS_FIVE, name="score5"), "model")
    out = wide.join(scores, "model")
    return rs.order_by_list(out, "model", order) if order else out.orderBy(F.desc("score"))


TASK_LABELS = {
    "sentiment": K.SENTIMENT_LABELS,
    "emotion": K.EMOTION_LABELS,
    "hate": K.HATE_LABELS,
    "irony": K.IRONY_LABELS,
}


def evaluate_run(
    spark: SparkSession, task: str, predictions: DataFrame, model: str, run: int, ledger_path: str | None = None
) -> DataFrame:
    """§3.3 stages 7–8: the metric set of one run from a predictions table,
    named like the ledger (``eval_<metric>``), optionally put into the ledger
    store (S10, by model, task and run).

    ``predictions``: single-label tasks ``label, logits``; context hate
    ``HATEFUL, labels, logits`` (9 wide, CALLS first).
    """
    from .operators import evaluate as ev

    if task == "context_hate":
        rep = ev.category_report(predictions)
        per_cat = rep.select(F.concat(F.col("category"), F.lit("_f1")).alias("metric"), F.col("f1").alias("value"))
        summary = ev.category_summary(rep).unpivot([], ["mean_f1", "mean_precision", "mean_recall"], "metric", "value")
        ext = ev.extended_report(predictions).unpivot([], ["hate_precision", "hate_recall", "hate_f1"], "metric", "value")
        metrics = per_cat.unionByName(summary).unionByName(ext)
    else:
        metrics = ev.single_label_report(predictions, TASK_LABELS[task])
    out = metrics.select(
        F.lit(model).alias("model"), F.lit(task).alias("task"), F.lit(run).cast("int").alias("run"),
        F.concat(F.lit("eval_"), F.col("metric")).alias("metric"), F.col("value").cast("double").alias("value"),
    )
    if ledger_path:
        rs.upsert_ledger(out, ledger_path)  # a run written twice stands once
    return out


def class_weights(spark: SparkSession, task: str, train: DataFrame, limited: bool = False) -> DataFrame | None:
    """§3.3 stage 5: ``balanced`` for emotion (A4), ``1/(2·mean)`` per category
    for context hate (A5), none for sentiment, hate and irony."""
    from .operators.tasks import balanced_weights, label_dim, positive_weights

    if task == "emotion":
        return balanced_weights(train, "label", label_dim(spark, K.EMOTION_LABELS))
    if task == "context_hate":
        return positive_weights(train, K.EXTENDED_HATE_CATEGORIES, limited)
    return None

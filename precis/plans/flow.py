"""Composed jobs: P1 train_and_evaluate (tokenizer -> scorer -> evaluation)
and P2 evaluate_model.  Each stage is a DataFrame plan; P1 writes every
stage to Parquet under one output folder (the hand-over between steps) and
commits it with a manifest, so a run that broke off goes on behind the last
committed stage (``stages``)."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.arrays import shift_input, shift_output
from ..operators import pairs as pr
from ..operators import rouge, runlog
from ..operators.bpe import BpeModel, read_tokenizer, require_specials, train_bpe, write_tokenizer
from ..operators.corpus import unpivot_corpus
from ..functions.numeric import cosine_lr
from ..operators.encode import bpe_encode, decode_ids, encode_pairs, padded_batches
from ..operators.generate import batch_generate
from ..operators.nexttoken import epoch_losses, next_token_table, table_after
from ..operators.ordering import first_n
from ..session import materialize, shuffle_partitions
from ..sources import scan
from ..sources.saved import scan_saved_split
from .stages import Stages, fingerprint_of_files


@dataclass
class Summarizer:
    """A trained tokenizer plus the next-token table it scores with."""
    model: BpeModel
    table: DataFrame

    @property
    def vocab_size(self) -> int:
        return len(self.model.tokens)


def encoded_pairs(pairs: DataFrame, model: BpeModel, max_len: int = 128) -> DataFrame:
    """X4 on both sides (only the pre-tokens that can survive truncation are
    encoded), then X5 + X6."""
    enc = bpe_encode(pairs, model, "text", "src_ids", max_pretokens=max_len)
    enc = bpe_encode(enc, model, "summary", "tgt_ids", max_pretokens=max(max_len - 2, 0))
    return encode_pairs(enc, "src_ids", "tgt_ids", max_len)


def fit_scorer(pairs: DataFrame, model: BpeModel, max_len: int = 128) -> DataFrame:
    """G8 from the training pairs: teacher-forced (input, target) ids of each
    framed target.  No padding is needed for counting."""
    e = encoded_pairs(pairs, model, max_len)
    rows = e.select(F.lit(0).alias("batch_id"), shift_input("tgt").alias("tgt_in"),
                    shift_output("tgt").alias("tgt_out"))
    return next_token_table(rows, len(model.tokens))


def generated_pairs(test_pairs: DataFrame, summarizer: Summarizer, max_length: int = 150,
                    rules: bool = True) -> DataFrame:
    """G7 / G6 for the pairs: ``pair_id, prediction, reference``, in as many
    tasks as the session shuffles into."""
    spread = test_pairs.select("pair_id", "text", F.col("summary").alias("reference")).repartition(
        shuffle_partitions(test_pairs.sparkSession), "pair_id")
    gen = batch_generate(spread, summarizer.model, summarizer.table, summarizer.vocab_size,
                         max_length=max_length, rules=rules)
    return gen.select("pair_id", F.col("summary").alias("prediction"), "reference")


def evaluate_pairs(spark: SparkSession, test_pairs: DataFrame, summarizer: Summarizer,
                   max_length: int = 150) -> tuple[DataFrame, DataFrame]:
    """G7 -> A8-A11.  Returns (per-pair scores, corpus scores); take the
    second from the written first if both are needed."""
    pr.require_nonempty(test_pairs)
    per_pair = rouge.rouge_all(generated_pairs(test_pairs, summarizer, max_length))
    return per_pair, rouge.rouge_corpus(per_pair, rouge.ALL_METRICS)


def evaluate_model(spark: SparkSession, sf_dir: str, summarizer: Summarizer, num_samples: int | None = 20,
                   source: str = "conv", saved_path: str | None = None) -> DataFrame | None:
    """The test rows (S2 + F1-F3 + L1, or the saved ``test`` split taken
    as is, T16), F8, generation and ROUGE; None if nothing is saved at
    ``saved_path``."""
    if saved_path:
        test = scan_saved_split(spark, saved_path, "test")
        if test is None:
            return None
        test = pr.null_to_empty(first_n(test, num_samples))
    else:
        test = scan.load_source(spark, source, "test", num_samples, sf_dir)
    return evaluate_pairs(spark, test, summarizer)[1]


def spot_check(pairs: DataFrame, summarizer: Summarizer, max_len: int = 128, limit: int = 20,
               batch_size: int = 32) -> DataFrame:
    """The check after an epoch: the first rows of the first validation batch,
    plain greedy decoding, references decoded from the truncated ids (T9),
    blank pairs left out (F7), mean ROUGE."""
    first = pr.spot_check_rows(pairs, limit, batch_size)
    model = summarizer.model
    told = encoded_pairs(first, model, max_len).select("pair_id", "text", decode_ids("tgt", model).alias("summary"))
    scored = pr.drop_blank_scored(generated_pairs(told, summarizer, max_len, rules=False))
    return rouge.rouge_corpus(rouge.rouge_scores(scored, ("rouge1", "rouge2", "rougeL")),
                              ("rouge1", "rouge2", "rougeL"))


def padded_of(pairs: DataFrame, model: BpeModel, max_len: int, batch_size: int) -> DataFrame:
    """Padded batches of the pairs in order of source and key."""
    encoded = materialize(encoded_pairs(pairs, model, max_len).select("source_rank", "pair_id", "src", "tgt"), "encoded")
    return padded_batches(encoded, batch_size, order_cols=("source_rank", "pair_id"))


def run_log(train_losses: DataFrame, val_losses: DataFrame, epochs: int, lr: float = 1e-4) -> DataFrame:
    """``epoch, train_loss, val_loss, lr, improved, patience_counter`` up to the
    epoch at which training stops (W2, W3, X15); a loss without a batch is 0.0."""
    every = val_losses.sparkSession.range(1, epochs + 1).select(F.col("id").cast("int").alias("epoch"))
    both = (every.join(train_losses.select("epoch", F.col("loss").alias("train_loss")), "epoch", "left")
            .join(val_losses.select("epoch", F.col("loss").alias("val_loss")), "epoch", "left")
            .fillna(0.0, ["train_loss", "val_loss"]).withColumn("run_id", F.lit(1)))
    stop = runlog.run_summary(both).select("run_id", "stop_epoch")
    return (runlog.early_stop(both).join(stop, "run_id").where(F.col("epoch") <= F.col("stop_epoch"))
            .withColumn("lr", cosine_lr(F.col("epoch"), F.lit(epochs), lr))
            .select("epoch", "train_loss", "val_loss", "lr", "improved", "patience_counter"))


def train_and_evaluate(spark: SparkSession, sf_dir: str, out_dir: str, vocab_size: int = 32_000,
                       max_samples: int | None = None, max_len: int = 128, batch_size: int = 32,
                       eval_samples: int = 200, seed: int = 13, lr: float = 1e-4, epochs: int = 1) -> dict[str, str]:
    """Tokenizer on the training corpus of every source (A4, S7), scorer
    counts on the encoded training pairs (G8), losses of every epoch (A6, A7),
    the epoch at which training stops and the one that is kept (W2-W4), spot
    check and learning rate in the run log (X15), and ROUGE of the kept epoch on
    the test split (P2).  Every stage lands in ``out_dir`` and is committed
    behind its data; a run with the same parameters and input files takes
    committed stages as they are and makes the others.  A failing step raises
    and stops the job."""
    run = Stages(spark, out_dir, fingerprint_of_files(spark, sf_dir))

    def pairs_of(split: str, n: int | None) -> DataFrame:
        return scan.load_pairs(spark, "all", split, n, sf_dir)

    def tokenizer(path: str) -> None:
        model = train_bpe(unpivot_corpus(pairs_of("train", max_samples)), vocab_size=vocab_size)
        require_specials(model)
        write_tokenizer(model, spark, path)

    run.folder("tokenizer", tokenizer, {"vocab_size": vocab_size, "max_samples": max_samples})
    model = read_tokenizer(spark, run.path("tokenizer"))
    size = {"max_len": max_len, "batch_size": batch_size}
    counts = run.table("scorer", lambda: fit_scorer(pairs_of("train", max_samples), model, max_len), size, ["tokenizer"])

    def losses(split: str, n: int | None):
        batches = padded_of(pairs_of(split, n), model, max_len, batch_size)
        return epoch_losses(batches, counts, len(model.tokens), epochs)

    some = pr.validation_cap(max_samples)
    trained = run.table("train_loss", lambda: losses("train", max_samples), size | {"epochs": epochs}, ["scorer"])
    checked = run.table("validation_loss", lambda: losses("validation", some).withColumnRenamed("loss", "val_loss"),
                        size | {"epochs": epochs}, ["scorer"])
    log = run.table("epochs", lambda: run_log(trained, checked.withColumnRenamed("val_loss", "loss"), epochs, lr),
                    {"lr": lr}, ["train_loss", "validation_loss"])
    kept_epoch = log.where("improved").agg(F.coalesce(F.max("epoch"), F.lit(1))).first()[0]  # a row per epoch
    kept = run.table("kept_scorer", lambda: table_after(counts, kept_epoch, len(model.tokens)), {"epoch": kept_epoch}, ["epochs"])
    summarizer = Summarizer(model, kept)

    def shown() -> DataFrame:
        val = pairs_of("validation", some)
        return spot_check(val.where(F.col("source_rank") == val.agg(F.min("source_rank")).scalar()), summarizer, max_len,
                          batch_size=batch_size)

    spot = run.table("spot_check", shown, size, ["kept_scorer"])
    names = ("rouge1", "rouge2", "rougeL")
    rouge_of = {r["metric"]: r["score"] for r in spot.collect()}  # three rows; every epoch decodes alike, since passes keep the order of the counts
    run.table("run_log", lambda: log.select("*", *[F.lit(float(rouge_of[m])).alias(m) for m in names]), {}, ["epochs", "spot_check"])
    per_pair = run.table("rouge_pairs", lambda: evaluate_pairs(
        spark, scan.load_source(spark, "conv", "test", eval_samples, sf_dir), summarizer)[0],
        {"eval_samples": eval_samples}, ["kept_scorer"])
    run.table("rouge", lambda: rouge.rouge_corpus(per_pair, rouge.ALL_METRICS), {}, ["rouge_pairs"])
    return {name: run.path(name) for name in run.names}

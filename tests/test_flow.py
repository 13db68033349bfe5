"""P1 end to end on the smallest tables; T9 (spot-check references are
decoded from truncated ids)."""

import tempfile

from pyspark.sql import functions as F

from precis.operators.encode import decode_ids
from precis.plans.flow import encoded_pairs, train_and_evaluate
from tests.conftest import SF_SMALL


def test_train_and_evaluate_writes_every_stage(spark):
    out = tempfile.mkdtemp(prefix="precis-flow-", dir="/tmp")
    paths = train_and_evaluate(spark, SF_SMALL, out, vocab_size=275, eval_samples=5)
    scores = {r["metric"]: r["score"] for r in spark.read.parquet(paths["rouge"]).collect()}
    assert set(scores) == {"rouge1", "rouge2", "rougeL", "rougeLsum"}
    assert all(0.0 <= v <= 1.0 for v in scores.values())
    loss = spark.read.parquet(paths["validation_loss"]).first()
    assert loss["val_loss"] > 0 and loss["n_batches"] >= 1
    assert spark.read.parquet(f"{paths['tokenizer']}/vocab").count() == 275
    log = spark.read.parquet(paths["run_log"]).collect()
    assert len(log) == 1 and log[0]["epoch"] == 1 and log[0]["val_loss"] == loss["val_loss"]
    assert set(paths) == {"tokenizer", "scorer", "train_loss", "validation_loss", "epochs", "kept_scorer", "spot_check", "run_log",
                          "rouge_pairs", "rouge"}
    assert log[0]["train_loss"] > 0 and 0 <= log[0]["rougeL"] <= 1 and 0 < log[0]["lr"] <= 1e-4

    from precis.operators.bpe import read_tokenizer
    model = read_tokenizer(spark, paths["tokenizer"])
    pairs = spark.createDataFrame([(1, "un texte", "le résumé de référence " * 20)],
                                  "pair_id long, text string, summary string")
    enc = encoded_pairs(pairs, model, max_len=8).select(
        decode_ids(F.col("tgt"), model).alias("ref_from_ids"), "summary").first()
    # The spot check scores against the truncated reference, not the raw one
    assert enc["ref_from_ids"] != enc["summary"]
    assert enc["summary"].startswith(enc["ref_from_ids"])


def test_a_run_goes_on_behind_its_last_committed_stage(spark, monkeypatch):
    from precis.plans import flow
    out = tempfile.mkdtemp(prefix="precis-flow-", dir="/tmp")
    how = {"vocab_size": 270, "eval_samples": 3, "epochs": 5, "max_samples": 60}
    plain = {name: getattr(flow, name) for name in ("train_bpe", "fit_scorer", "epoch_losses")}
    calls, killed = [], []

    def counted(name):
        def call(*args, **kwargs):
            calls.append(name)
            if name == "epoch_losses" and not killed:
                killed.append(name)
                raise RuntimeError("killed")
            return plain[name](*args, **kwargs)
        return call
    for name in plain:
        monkeypatch.setattr(flow, name, counted(name))
    try:
        flow.train_and_evaluate(spark, SF_SMALL, out, **how)
        raise AssertionError("not killed")
    except RuntimeError:
        pass
    assert calls == ["train_bpe", "fit_scorer", "epoch_losses"]
    paths = flow.train_and_evaluate(spark, SF_SMALL, out, **how)
    assert calls[3:] == ["epoch_losses", "epoch_losses"]  # tokenizer and scorer are taken as they are
    log = sorted(spark.read.parquet(paths["run_log"]).collect(), key=lambda r: r["epoch"])
    assert 1 < len(log) <= 5 and [r["epoch"] for r in log] == list(range(1, len(log) + 1))
    assert [r["train_loss"] for r in log] == sorted((r["train_loss"] for r in log), reverse=True)
    best = max(r["epoch"] for r in log if r["improved"])
    n = spark.read.parquet(paths["scorer"]).agg(F.sum("n")).first()[0]
    assert spark.read.parquet(paths["kept_scorer"]).agg(F.sum("n")).first()[0] == best * n
    del calls[:]
    flow.train_and_evaluate(spark, SF_SMALL, out, **how)
    assert calls == []
    flow.train_and_evaluate(spark, SF_SMALL, out, **(how | {"epochs": 3}))  # other parameters: the stages they touch
    assert calls == ["epoch_losses", "epoch_losses"]


def test_an_uncommitted_or_changed_stage_is_made_again(spark, tmp_path):
    from precis.plans.stages import Stages, fingerprint_of_files
    data = tmp_path / "in"
    spark.range(3).write.parquet(str(data))

    def go(n):
        run = Stages(spark, str(tmp_path / "out"), fingerprint_of_files(spark, str(data)))
        a = run.table("a", lambda: spark.read.parquet(str(data)), {})
        run.table("b", lambda: a.where(F.col("id") < n), {"n": n}, ["a"])
        return run.made
    assert go(2) == ["a", "b"] and go(2) == []
    assert go(1) == ["b"] and spark.read.parquet(str(tmp_path / "out" / "b")).count() == 1
    (tmp_path / "out" / "_done" / "a.json").unlink()
    assert go(1) == ["a"]
    spark.range(5).write.mode("append").parquet(str(data))
    assert go(1) == ["a", "b"]

"""The semantic traps of the survey (T1-T16) on hand-made frames."""

import math

import pytest
from pyspark.sql import functions as F

from precis.functions import text as tx
from precis.functions.arrays import EOS, SOS
from precis.operators import decoding as dc
from precis.operators import pairs as pr
from precis.operators.encode import encode_pairs
from precis.operators.generate import Scorer, Seen, choose, decode
from precis.operators.nexttoken import token_cross_entropy
from precis.operators.ordering import first_n
from precis.operators.runlog import early_stop, epoch_loss, run_summary
from precis.sources import scan
from precis.plans.fixtures import fixture_registry
from precis.sources.registry import Registry, SourceSpec
from tests.conftest import SF_SMALL


def _pairs(spark, rows):
    return spark.createDataFrame(rows, "pair_id long, text string, summary string")


def test_t1_blank_text_passes_filter_but_not_guard(spark):
    df = _pairs(spark, [(1, "   ", "s"), (2, "", "s"), (3, None, "s"), (4, "a", "s"), (5, "　\x1c", "s")])
    kept = pr.drop_empty_pairs(df).select("pair_id").collect()
    assert sorted(r[0] for r in kept) == [1, 4, 5]
    guard = {r["pair_id"]: r["needs_generation"] for r in pr.blank_guard(df).collect()}
    assert guard == {1: False, 2: False, 3: False, 4: True, 5: False}


def test_t2_limit_counts_rows_after_filter(spark):
    df = _pairs(spark, [(1, "", "x"), (2, "a", "x"), (3, "b", "x"), (4, "c", "x")])
    out = first_n(pr.drop_empty_pairs(df), 2).collect()
    assert [r["pair_id"] for r in sorted(out)] == [2, 3]


def test_first_n_large_uses_positions(spark):
    df = spark.range(0, 30000).withColumnRenamed("id", "pair_id")
    out = first_n(df, 12345)
    assert out.count() == 12345
    assert out.agg(F.max("pair_id")).first()[0] == 12344


def test_t3_zero_samples(spark):
    single = scan.load_pairs(spark, "conv", "train", 0, SF_SMALL)
    assert single.count() == 0
    unlimited = scan.load_pairs(spark, "all", "train", None, SF_SMALL).count()
    assert scan.load_pairs(spark, "all", "train", 0, SF_SMALL).count() == unlimited > 0


def test_t4_quota_zero_gives_empty_union(spark):
    for n in (1, 2):
        assert scan.load_pairs(spark, "all", "train", n, SF_SMALL).count() == 0


def test_t5_validation_cap():
    assert pr.validation_cap(0) == 2000
    assert pr.validation_cap(None) == 2000
    assert pr.validation_cap(10) == 10
    assert pr.validation_cap(5000) == 2000
    assert pr.validation_cap(0) // 3 == 666


def test_t6_bad_split_swallowed_in_all_mode(spark):
    reg = fixture_registry()
    with pytest.raises(ValueError, match="No split"):
        scan.load_pairs(spark, "conv", "dev", None, SF_SMALL, reg)
    report = []
    with pytest.raises(ValueError, match="every source failed"):
        scan.load_pairs(spark, "all", "dev", None, SF_SMALL, reg, report)
    assert [r.status for r in report] == ["failed"] * 3


def test_s3_unknown_source_lists_names(spark):
    with pytest.raises(ValueError, match="conv, docs, pages, all"):
        scan.load_pairs(spark, "nope", "train", None, SF_SMALL)


def test_u2_failing_source_left_out(spark):
    bad = SourceSpec("broken", parquet_files={"train": ("missing/0000.parquet",)})
    reg = Registry(fixture_registry().sources + (bad,))
    report = []
    df = scan.load_pairs(spark, "all", "train", None, SF_SMALL, reg, report)
    assert {r.source: r.status for r in report}["broken"] == "failed"
    assert df.select("source").distinct().count() == 3


def test_t7_epoch_loss_not_token_weighted(spark):
    b = spark.createDataFrame([(1, 0, 1.0), (1, 1, 3.0)], "run_id long, batch_id long, batch_loss double")
    assert epoch_loss(b).first()["epoch_loss"] == 2.0


def test_t8_equal_or_nan_is_not_improvement(spark):
    log = spark.createDataFrame([(1, 1, 2.0), (1, 2, 2.0), (1, 3, float("nan")), (1, 4, 1.0),
                                 (1, 5, 1.5), (1, 6, 1.5), (1, 7, 1.2), (1, 8, 0.5)],
                                "run_id long, epoch int, val_loss double")
    per = {r["epoch"]: (r["improved"], r["patience_counter"]) for r in early_stop(log).collect()}
    assert per[1] == (True, 0) and per[2] == (False, 1) and per[3] == (False, 2)
    assert per[4] == (True, 0) and per[7] == (False, 3)
    s = run_summary(log).first()
    assert (s["stop_epoch"], s["best_epoch"], s["stopped_early"]) == (7, 4, True)


def _loop_reference(losses, patience=3):
    best, counter, best_epoch = math.inf, 0, None
    for e, v in enumerate(losses, start=1):
        if v < best:
            best, counter, best_epoch = v, 0, e
        else:
            counter += 1
        if counter >= patience:
            return e, best_epoch
    return len(losses), best_epoch


def test_early_stop_equals_loop(spark):
    import random
    rng = random.Random(7)
    runs = [[round(rng.uniform(0, 3), 1) for _ in range(rng.randint(1, 15))] for _ in range(60)]
    rows = [(i, e, v) for i, r in enumerate(runs) for e, v in enumerate(r, start=1)]
    log = spark.createDataFrame(rows, "run_id long, epoch int, val_loss double")
    got = {r["run_id"]: (r["stop_epoch"], r["best_epoch"]) for r in run_summary(log).collect()}
    for i, r in enumerate(runs):
        assert got[i] == _loop_reference(r), (i, r)


def test_t10_plain_greedy_drops_eos_constrained_keeps_it():
    import numpy as np

    class Fixed(Scorer):
        """Offers eos once the fourth call comes."""
        def __init__(self):
            self.size, self.bonus, self.calls = 8, 1.0, 0

        def logits(self, last, bonus):
            self.calls += 1
            out = np.full((len(last), 8), -5.0)
            out[:, EOS] = 10.0 if self.calls >= 5 else -1.0
            out[:, 5 + self.calls % 3] = 1.0
            return out
    plain = decode([[5]], Fixed(), 20, rules=False)[0]
    assert plain[0] == SOS and EOS not in plain
    ruled = decode([[5]], Fixed(), 20, rules=True)[0]
    assert ruled[0] == SOS and ruled[-1] == EOS and len(ruled) >= 6


def test_t11_penalised_sos_stays_minus_inf(spark):
    c = spark.createDataFrame([(1, t, 2.0) for t in range(8)], "seq_id long, token_id long, logit double")
    p = spark.createDataFrame([(1, [0, 5, 6])], "seq_id long, prefix array<int>")
    out = {r["token_id"]: r["logit"] for r in dc.repetition_penalty(dc.block_specials(c), p).collect()}
    assert out[0] == float("-inf") and out[5] == pytest.approx(2.0 / 1.5) and out[7] == 2.0


def test_t12_all_minus_inf_picks_lowest_id(spark):
    import numpy as np
    c = spark.createDataFrame([(1, t, float("-inf")) for t in range(6)],
                              "seq_id long, token_id long, logit double")
    p = spark.createDataFrame([(1, [0, 5])], "seq_id long, prefix array<int>")
    assert dc.decode_step(c, p).first()["next_token"] == 0
    assert choose(np.full((1, 6), -np.inf), np.array([[0, 5]]), [Seen([0, 5])])[0] == 0


def test_g5_repeat_takes_second_best(spark):
    import numpy as np
    logits = [0.0, 0.0, 0.0, 0.0, 0.0, 9.0, 8.0, 1.0]
    c = spark.createDataFrame([(1, t, v) for t, v in enumerate(logits)], "seq_id long, token_id long, logit double")
    p = spark.createDataFrame([(1, [0, 7, 5, 5])], "seq_id long, prefix array<int>")
    got = dc.decode_step(c, p).first()["next_token"]
    arr = np.array(logits)
    assert got == choose(arr[None, :], np.array([[0, 7, 5, 5]]), [Seen([0, 7, 5, 5])])[0]
    # 5 is penalised to 6.0 (< 8.0), so 6 is best already
    assert got == 6


def test_t13_max_len_below_two_rejected(spark):
    df = spark.createDataFrame([(1, [5, 6], [7])], "pair_id long, src_ids array<int>, tgt_ids array<int>")
    with pytest.raises(ValueError):
        encode_pairs(df, max_len=1)
    out = encode_pairs(df, max_len=2).first()
    assert out["src"] == [5, 6] and out["tgt"] == [SOS, EOS]


def test_t15_compression_negative(spark):
    df = spark.createDataFrame([("abcd", "abcdefgh"), ("", "x"), ("a b  c", "a")], "text string, summary string")
    rows = df.select(tx.compression_pct("summary", "text").alias("c"),
                     tx.word_delta("summary", "text").alias("d")).collect()
    assert rows[0]["c"] == -100.0 and rows[1]["c"] == 0.0 and rows[2]["d"] == -2


def test_word_count_matches_python(spark):
    texts = ["a  b\tc\n", " x y\x1cz", "", None, "é l'été 12"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = [r[0] for r in df.select(tx.word_count("t")).collect()]
    assert got == [len(t.split()) if t else 0 for t in texts]


def test_preview_forms(spark):
    df = spark.createDataFrame([("x" * 1200,), ("short",)], "t string")
    rows = df.select(tx.preview_always("t", 500).alias("a"), tx.preview_if_longer("t", 1000).alias("b")).collect()
    assert rows[0]["a"] == "x" * 500 + "..." and rows[0]["b"] == "x" * 1000 + "..."
    assert rows[1]["a"] == "short..." and rows[1]["b"] == "short"


def test_rouge_tokens_split_accents(spark):
    df = spark.createDataFrame([("L'Été à Paris-12",)], "t string")
    assert df.select(tx.rouge_tokens("t")).first()[0] == ["l", "t", "paris", "12"]


def test_cross_entropy_unseen_pair_smoothed(spark):
    b = spark.createDataFrame([(0, [0, 5], [5, 2])], "batch_id long, tgt_in array<int>, tgt_out array<int>")
    table = spark.createDataFrame([(0, 5, 3, 3)], "prev int, next int, n long, total long")
    out = token_cross_entropy(b, table, 10, alpha=0.5).first()
    p1 = (3 + 0.5) / (3 + 5.0)
    p2 = 0.5 / (0 + 5.0)
    assert out["batch_loss"] == pytest.approx((-math.log(p1) - math.log(p2)) / 2)

"""Plan shape: pushdown, pruning, single exchange for ROUGE-N, no
single-task window over the corpus, no cartesian product."""

import re
import uuid

from pyspark.sql import functions as F

from precis.operators import ordering, rouge
from precis.sources import scan
from tests.conftest import SF_SMALL


def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def _docs(spark):
    return scan.load_source(spark, "docs", "train", None, SF_SMALL)


def test_filter_pushed_and_columns_pruned(spark):
    plan = _plan(_docs(spark))
    pushed = plan.split("PushedFilters: [", 1)[1].split("]", 1)[0]
    for f in ("IsNotNull(lang)", "EqualTo(lang,fr)", "IsNotNull(text)", "Not(EqualTo(text,))"):
        assert f in pushed, pushed
    assert "ReadSchema: struct<doc_id:bigint,text:string,lang:string>" in plan


def test_rouge_scores_in_one_scan_without_exchange(spark):
    pairs = _docs(spark).select("pair_id", F.col("text").alias("prediction"),
                                F.col("summary").alias("reference"))
    for scored in (rouge.rouge_n(pairs), rouge.rouge_all(pairs), rouge.ngram_overlap(rouge.tokenized(pairs))):
        plan = _plan(scored)
        assert "Exchange" not in plan and plan.count("FileScan") == 1


def test_positions_number_rows_by_range_and_write_nothing(spark, monkeypatch):
    """Rows are numbered in range windows; only the table of one row per range
    goes through a window without partitions, and no row is written."""
    monkeypatch.setattr(ordering, "materialize", None)
    df = ordering.batch_rows(_docs(spark), 32)
    plan = df._jdf.queryExecution().optimizedPlan().toString().splitlines()
    windows = [k for k, line in enumerate(plan) if "Window [" in line]
    assert len(windows) == 2
    alone = [k for k in windows if re.search(r"windowspecdefinition\(_range#\d+L? ASC", plan[k])]  # ordered, not partitioned
    assert len(alone) == 1 and "Aggregate [_range" in plan[alone[0] + 1]


def test_range_of_any_key(spark):
    import datetime
    import decimal
    rows = [(None, None, None, None), ("a", 1, decimal.Decimal("1.5"), datetime.date(2020, 1, 1)), ("a", None, None, None),
            ("b", 2, decimal.Decimal("-2.25"), datetime.date(2021, 1, 1)), ("b", -2, None, None), (None, 3, None, None)] * 7
    df = spark.createDataFrame([(*r, k) for k, r in enumerate(rows)], "s string, i int, d decimal(9,2), t date, k long")
    for cols in (["s", "i", "d", "t", "k"], ["t", "s", "k"], ["d", "k"], ["k"]):
        ordered = [r["k"] for r in df.orderBy(*cols).collect()]
        got = {r["k"]: r["pos"] for r in ordering.with_positions(df, cols).collect()}
        assert [k for k, _ in sorted(got.items(), key=lambda x: x[1])] == ordered


def _jobs(spark, build):
    tracker, group = spark.sparkContext.statusTracker(), f"jobs-{uuid.uuid4().hex}"
    spark.sparkContext.setJobGroup(group, "count")
    try:
        out = build()
        return out, len(tracker.getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_few_jobs_before_the_action(spark):
    from precis.plans import catalog
    for name, most in (("token_cross_entropy_conv", 5), ("token_ids_conv", 3), ("padded_batches_conv", 5)):
        _, jobs = _jobs(spark, lambda: catalog.QUERIES[name](spark, SF_SMALL))
        assert jobs <= most, (name, jobs)


def test_selection_of_the_nth_key(spark):
    """Ties, nulls, hot keys and many ranges; no step sorts more rows than a range."""
    import random
    rng = random.Random(2)
    keys = [rng.choice([None, 0, 1, 1, 1, 1, rng.randrange(2000)]) for _ in range(4000)]
    df = spark.createDataFrame([(k, f"r{j}") for j, k in enumerate(keys)], "pair_id int, text string").repartition(6)
    order = sorted(keys, key=lambda k: (k is not None, k or 0))
    for n in (1, 5, 571, 572, 2000, 3999, 4000, 4001):
        got = [r["pair_id"] for r in ordering.first_n(df, n).collect()]
        assert sorted(got, key=lambda k: (k is not None, k or 0)) == order[:n], n
        assert len({r["text"] for r in ordering.first_n(df, n).collect()}) == min(n, 4000)
    keys_only = df.select("pair_id")
    for n in (1, 700, 3500):
        row, less, equal = ordering.nth_key(keys_only, n, range_rows=50, splits=8)
        assert row["pair_id"] == order[n - 1]
        assert less == sum((k is not None, k or 0) < (row["pair_id"] is not None, row["pair_id"] or 0) for k in keys)
        assert equal == keys.count(row["pair_id"])


def test_first_of_a_repeated_key(spark):
    df = spark.createDataFrame([(7, "a"), (7, "b"), (7, "c"), (8, "d")], "pair_id long, text string")
    assert ordering.first_n(df, 1).count() == 1 and ordering.first_n(df, 2).count() == 2
    assert ordering.first_n(df.limit(0), 3).count() == 0 and ordering.first_n(df, 0).count() == 0


def test_positions_equal_row_number(spark):
    df = spark.range(0, 5000).withColumnRenamed("id", "pair_id").withColumn("pair_id", F.col("pair_id") * 7 % 5003)
    got = ordering.with_positions(df, ["pair_id"], "pos").collect()
    order = sorted(r["pair_id"] for r in got)
    assert {r["pair_id"]: r["pos"] for r in got} == {k: i for i, k in enumerate(order)}


def test_grouped_positions(spark):
    rows = [(s, i) for s in ("a", "b", "c") for i in range(0, 300, 1 + len(s))]
    df = spark.createDataFrame(rows, "source string, pair_id long")
    got = ordering.with_positions(df, ["pair_id"], "pos", group_cols=["source"]).collect()
    for s in ("a", "b", "c"):
        mine = sorted((r["pair_id"], r["pos"]) for r in got if r["source"] == s)
        assert [p for _, p in mine] == list(range(len(mine)))


def test_positions_with_a_hot_group(spark):
    """One group holding 90% of the rows: positions stay exact, and the hot
    group is spread over the same range partitions as everything else."""
    hot = spark.range(0, 9000).select(F.lit("hot").alias("source"), F.col("id").alias("pair_id"))
    cold = spark.range(0, 1000).select(F.lit("cold").alias("source"), (F.col("id") * 9).alias("pair_id"))
    df = hot.unionByName(cold)
    out = ordering.with_positions(df, ["pair_id"], "pos", group_cols=["source"])
    got = out.groupBy("source").agg(F.min("pos").alias("lo"), F.max("pos").alias("hi"),
                                    F.count(F.lit(1)).alias("n"), F.countDistinct("pos").alias("d")).collect()
    stats = {r["source"]: (r["lo"], r["hi"], r["n"], r["d"]) for r in got}
    assert stats == {"hot": (0, 8999, 9000, 9000), "cold": (0, 999, 1000, 1000)}
    assert out.where((F.col("source") == "hot") & (F.col("pair_id") == 4321)).first()["pos"] == 4321


def test_positions_of_text_keys_that_share_a_prefix(spark):
    names = [f"https://{(k * 7919) % 10_000}" for k in range(10_000)]
    df = spark.createDataFrame([(n,) for n in names], "pair_id string").repartition(7)
    got = {r["pair_id"]: r["pos"] for r in ordering.with_positions(df, ["pair_id"]).collect()}
    assert [got[n] for n in sorted(names)] == list(range(10_000))


def test_first_n_has_one_way_for_every_n_and_key(spark):
    names = [f"k{k:05d}" for k in range(12_000)]
    df = spark.createDataFrame([(n, k % 3) for k, n in enumerate(names)], "pair_id string, part int").repartition(5)
    for n in (1, 9_999, 10_000, 10_001, 50_000):
        got = sorted(r["pair_id"] for r in ordering.first_n(df, n).collect())
        assert got == names[:n]
    two = ordering.first_n(df, 4_500, ("part", "pair_id"))
    want = sorted(((k % 3, n) for k, n in enumerate(names)))[:4_500]
    assert sorted((r["part"], r["pair_id"]) for r in two.collect()) == want
    assert two.rdd.getNumPartitions() > 1


def test_batches_of_two_order_columns(spark):
    df = spark.createDataFrame([(s, p) for s in (1, 0) for p in range(200)], "source_rank int, pair_id long").repartition(6)
    rows = ordering.batch_rows(df, 32, ("source_rank", "pair_id")).collect()
    order = [(r["source_rank"], r["pair_id"]) for r in sorted(rows, key=lambda r: r["pos"])]
    assert order == [(s, p) for s in (0, 1) for p in range(200)]
    assert all(r["batch_id"] == r["pos"] // 32 and r["pos_in_batch"] == r["pos"] % 32 for r in rows)


def test_a_range_is_never_null(spark):
    """Else a join by it tests that on every row below the aggregation that the key comes from."""
    df = spark.createDataFrame([("a",), (None,), ("b",)], "k string")
    cuts = ordering.cut_keys(df, 2)
    assert cuts and not df.select(ordering.range_of(df, ["k"], cuts).alias("r")).schema["r"].nullable

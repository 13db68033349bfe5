import hashlib
from collections import defaultdict

from pyspark.sql import functions as F

from precis.llm import line_dedup as ld

SCHEMA = "doc_id long, text string, dropped int, keep_runs string"


def brute(rows):
    blank = " \t\n\x0b\x0c\r"
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    key = lambda x: x.strip(blank).translate(low)
    held = defaultdict(list)
    for r, (i, t) in enumerate(rows):
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= 20:
                held[k].append((r, i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        keep = []
        for x in lines:
            who = held.get(key(x), [])
            tops = [j for _, j in who if j is not None]
            keep.append(len(who) < 3 or i == (max(tops) if tops else None))
        kept = "\n".join(x for x, k in zip(lines, keep) if k)
        out.append((i, len(lines), keep.count(False), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=repr)


def digest(spark, rows):
    df = spark.createDataFrame([(i, t, 7, "x") for i, t in rows], SCHEMA)
    return sorted([tuple(r) for r in ld.line_dedup_digest(df).collect()], key=repr)


def test_brute_force(spark):
    a, b, c = "The same long line, again", "ÀÉ another long line of text", "0123456789012345678"
    rows = [(1, f"{a}\nx\n{b}"), (2, f"  {a.upper()}\t\ny"), (3, f"{a}\n{a}\n{b}\n\n"), (4, f"{b}\r\n{c}"), (5, c), (6, c),
            (7, None), (8, ""), (None, f"{a}\nz"), (None, b), (9, "\n".join([a] * 300 + ["end"])), (9, a), (9, a)]
    assert digest(spark, rows) == brute(rows)


def test_null_ids_only(spark):
    rows = [(None, "a line of twenty characters")] * 3
    assert digest(spark, rows) == brute(rows)


def test_empty_table(spark):
    assert digest(spark, []) == []


def test_keep_runs_rebuild_the_flags(spark):
    line = "a line that three documents hold"
    rows = [(i, f"{line}\nown {i}\n{line}\n{line}") for i in range(3)]
    df = spark.createDataFrame([(i, t, 0, "") for i, t in rows], SCHEMA)
    got = {r._id: (r.dropped, r.keep_runs) for r in ld.keep_bitmaps(df).collect()}
    assert got == {0: ([0, 2, 3], [0, 1, 1, 2]), 1: ([0, 2, 3], [0, 1, 1, 2])}
    kept = {r.doc_id: r._kept for r in ld.line_dedup(df).collect()}
    assert kept[0] == "own 0" and kept[2] == rows[2][1]


def test_plan_is_native_and_streams_by_hash_range(spark):
    df = spark.createDataFrame([(1, "x", 0, "")], SCHEMA)
    plan = ld.line_dedup_digest(df)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert "rangepartitioning(h1" in plan


def test_other_columns_survive(spark):
    df = spark.createDataFrame([(1, "x", 5, "y")], SCHEMA)
    row = ld.line_dedup(df).select("dropped", "keep_runs", F.col("_kept")).first()
    assert tuple(row) == (5, "y", "x")


def test_columns_that_have_the_names_of_added_ones(spark):
    line = "a line that three documents hold"
    schema = ("doc_id long, text string, _kept string, _n_lines int, _KEEP_RUNS string, __ld_text_hash int, __ld_id int, __ld_dropped int, "
              "_n_dropped int, _id int, _t int, dropped int, k int")
    df = spark.createDataFrame([(i, f"{line}\nown", "mine", 70 + i, "r", 1, 2, 3, 4, 5, 6, 7, 8) for i in range(3)], schema)
    out = ld.line_dedup(df)
    assert out.columns == [*df.columns, "__n_lines", "__n_dropped", "__kept", "__keep_runs"]
    rows = sorted(tuple(r) for r in out.collect())
    assert [r[2:13] for r in rows] == [("mine", 70 + i, "r", 1, 2, 3, 4, 5, 6, 7, 8) for i in range(3)]
    assert [r[13:16] for r in rows] == [(2, 1, "own"), (2, 1, "own"), (2, 0, f"{line}\nown")]

"""Generation: the decoder's rules equal the table operators on the
logits / prefixes fixture; blank, empty and failing rows."""

import numpy as np
from pyspark.sql import functions as F

from precis.operators import decoding as dc
from precis.operators.generate import Scorer, Seen, choose, decode
from precis.plans import fixtures as fx
from tests.conftest import SF_SMALL


def test_worker_rules_equal_table_rules(spark):
    logits = fx.logits(spark, SF_SMALL)
    prefixes = fx.prefixes(spark, SF_SMALL)
    table = {r["seq_id"]: r["next_token"] for r in dc.decode_step(logits, prefixes).collect()}
    vecs = {}
    for r in logits.collect():
        vecs.setdefault(r["seq_id"], {})[r["token_id"]] = r["logit"]
    pref = {r["seq_id"]: list(r["prefix"]) for r in prefixes.collect()}
    for seq, d in vecs.items():
        arr = np.array([d[i] for i in range(len(d))], dtype=float)
        p = np.array([pref[seq]])
        assert choose(arr[None, :], p, [Seen(pref[seq])])[0] == table[seq], seq


def test_batch_generate_blank_and_errors(spark):
    from precis.operators.bpe import train_bpe
    from precis.operators.generate import batch_generate
    from precis.plans.flow import fit_scorer
    corpus = spark.createDataFrame([("le chat noir est ici",), ("le chien noir",)], "value string")
    model = train_bpe(corpus, vocab_size=270)
    train = spark.createDataFrame([(1, "le chat", "le chat noir"), (2, "le chien", "le chien noir")],
                                  "pair_id long, text string, summary string")
    table = fit_scorer(train, model)
    df = spark.createDataFrame([(1, "le chat"), (2, "   "), (3, None), (4, "<s>")], "pair_id long, text string")
    out = {r["pair_id"]: r for r in batch_generate(df, model, table, len(model.tokens), max_length=12).collect()}
    assert out[2]["summary"] == "" and out[3]["summary"] == ""
    assert out[1]["gen_ids"][0] == 0 and out[1]["error"] is None
    assert len(out[1]["gen_ids"]) <= 13
    assert out[4]["error"] is None


def test_x19_failing_rows_report_error_and_job_goes_on(spark):
    """A scorer row pointing outside the vocabulary makes generation fail for
    the rows that reach it; they get the fallback text, the others do not."""
    from precis.operators.bpe import train_bpe
    from precis.operators.generate import ERROR_TEXT, batch_generate
    corpus = spark.createDataFrame([("le chat noir",)], "value string")
    model = train_bpe(corpus, vocab_size=265)
    v = len(model.tokens)
    table = spark.createDataFrame([(0, v + 7, 3, 3)], "prev int, next int, n long, total long")
    df = spark.createDataFrame([(1, "le chat"), (2, "  ")], "pair_id long, text string")
    out = {r["pair_id"]: r for r in batch_generate(df, model, table, v, max_length=5).collect()}
    assert out[1]["summary"] == ERROR_TEXT and out[1]["error"]
    assert out[2]["summary"] == "" and out[2]["error"] is None


def test_t14_default_lengths():
    import inspect
    from precis.operators.encode import encode_pairs
    from precis.operators.generate import batch_generate
    assert inspect.signature(batch_generate).parameters["max_length"].default == 150
    assert inspect.signature(encode_pairs).parameters["max_len"].default == 128


def _plain_decode(src, counts, v, max_len, rules):
    """One row, one token at a time, rules as loops."""
    prefix = [0]
    for _ in range(max_len):
        total = sum(n for (a, _), n in counts.items() if a == prefix[-1])
        x = [np.log((counts.get((prefix[-1], t), 0) + 0.1) / (total + 0.1 * v)) + (t in src) for t in range(v)]
        if rules:
            x = [-np.inf if t in (0, 1, 3, 4) else y for t, y in enumerate(x)]
            x = [(y / 1.5 if y > 0 else y * 1.5) if t in prefix[-8:] else y for t, y in enumerate(x)]
            if len(prefix) < 5:
                x[2] = -np.inf
            if len(prefix) >= 4:
                for a, b, c in zip(prefix, prefix[1:], prefix[2:]):
                    if [a, b] == prefix[-2:]:
                        x[c] = -np.inf
        order = sorted(range(v), key=lambda t: (-x[t], t))
        best = order[0]
        if rules and len(prefix) > 2 and best == prefix[-1] == prefix[-2]:
            best = order[1]
        if rules or best != 2:
            prefix.append(best)
        if best == 2:
            break
    return prefix


def test_batch_decoding_equals_one_row_at_a_time():
    rng = np.random.default_rng(6)
    v = 14
    counts = {(int(a), int(b)): int(n) for a, b, n in zip(rng.integers(0, v, 60), rng.integers(2, v, 60), rng.integers(1, 40, 60))}
    prev, nxt, n = (np.array(x) for x in zip(*((a, b, c) for (a, b), c in counts.items())))
    scorer = Scorer(prev, nxt, n, v)
    sources = [sorted(set(rng.integers(5, v, rng.integers(1, 6)).tolist())) for _ in range(40)]
    for rules in (True, False):
        got = decode(sources, scorer, 25, rules)
        assert got == [_plain_decode(s, counts, v, 25, rules) for s in sources]


def test_generation_runs_in_many_tasks_after_a_limit(spark):
    from precis.operators.bpe import train_bpe
    from precis.operators.ordering import first_n
    from precis.plans.flow import Summarizer, fit_scorer, generated_pairs
    pairs = spark.range(400).selectExpr("id AS pair_id", "concat('le chat ', id) AS text", "'le chat' AS summary")
    model = train_bpe(pairs.select(F.col("text").alias("value")), vocab_size=265)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        out = generated_pairs(first_n(pairs, 300), Summarizer(model, fit_scorer(pairs, model)), 4)
        tasks = out.select(F.spark_partition_id().alias("p"), F.length("prediction")).groupBy("p").count().collect()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert len(tasks) > 1 and sum(r["count"] for r in tasks) == 300


def test_a_batch_is_decoded_in_slices_of_bounded_matrices(spark, monkeypatch):
    from precis.operators import generate as g
    from precis.operators.bpe import BpeModel, base_tokens
    model = BpeModel(base_tokens())
    table = spark.createDataFrame([(a, b, 1 + (a * b) % 7) for a in range(261) for b in range(5, 261, 41)], "prev int, next int, n long")
    texts = spark.createDataFrame([(k, None if k % 9 == 8 else "mot " * (k % 5)) for k in range(40)], "pair_id long, text string").coalesce(1)
    got, default = [], g.CELLS
    for cells in (g.CELLS, 261 * 3):
        monkeypatch.setattr(g, "CELLS", cells)
        got.append(sorted(map(tuple, g.batch_generate(texts, model, table, 261, max_length=12).select("pair_id", "gen_ids", "error").collect())))
    assert got[0] == got[1] and len(got[0]) == 40 and any(ids for _, ids, _ in got[0])
    assert 8 * default <= 1 << 22  # bytes of a score matrix

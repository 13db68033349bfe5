import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from precis.llm import order_minhash as om
from precis.llm import words as wd
from precis.llm.graph import components

SCHEMA = "doc_id long, text string, class_id int, node string"


def plain(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def classes(spark, rows, **more):
    df = spark.createDataFrame([(i, t, 0, "") for i, t in rows], SCHEMA).repartition(3)
    return sorted([tuple(r) for r in om.near_duplicates(df, **more).collect()], key=repr)


def test_distance_against_the_full_table():
    rng = random.Random(1)
    for _ in range(1500):
        a = [rng.randint(0, rng.choice([2, 5, 30])) for _ in range(rng.randint(0, 40))]
        b = list(a)
        for _ in range(rng.randint(0, 12)):
            kind = rng.random()
            if kind < 0.33 and b:
                b[rng.randrange(len(b))] = rng.randint(0, 9)
            elif kind < 0.66 and b:
                del b[rng.randrange(len(b))]
            else:
                b.insert(rng.randint(0, len(b)), rng.randint(0, 9))
        most, real = rng.randint(0, 25), plain(a, b)
        assert om.distance(np.array(a, np.uint64), np.array(b, np.uint64), most) == (real if real <= most else None)


def test_sketches_keep_text_order_and_do_not_depend_on_the_batch():
    texts = ["one two three four five six seven eight nine ten", "six seven eight nine ten one two three four five", "", None,
             "a b", "x " * 50]
    n, keys = om.sketches(pa.array(texts))
    assert n.tolist() == [10, 10, 0, 0, 2, 50]
    assert not (keys[0] == keys[1]).any()
    for k, t in enumerate(texts):
        if n[k]:
            assert (om.sketches(pa.array([t]))[1][0] == keys[k]).all()


def test_links_of_near_copies(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(3000)]
    rows, want = [], {}
    for group in range(12):
        words = [rng.choice(vocabulary) for _ in range(rng.randint(60, 300))]
        for copy in range(rng.choice([1, 2, 6])):
            own = list(words)
            for _ in range(len(words) // 50 if copy else 0):
                own[rng.randrange(len(own))] = rng.choice(vocabulary)
            rows.append((len(rows), " ".join(own)))
            want[len(rows) - 1] = group
    got = dict(classes(spark, rows))
    for i in want:
        assert got[i] == min(j for j in want if want[j] == want[i])


def test_classes_of_documents_against_all_pairs(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    words = [wd.lower_words(pa.array([r.text])).hashes for r in docs]
    bags = [set(om.labelled(wd.Words(w, np.array([0, len(w)]), w, w), om.WORDS)[0].tolist()) for w in words]
    got = dict(classes(spark, [(r.doc_id, r.text) for r in docs]))
    links = {}
    for i in range(len(docs)):
        for j in range(i):
            common = len(bags[i] & bags[j])
            most = int(0.2 * max(len(words[i]), len(words[j])) + 1e-9)
            if common and om.distance(words[i], words[j], most) is not None:
                links[i, j] = common / len(bags[i] | bags[j])
    assert any(x < 1 for x in links.values())
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, j in links:
        parent[root(i)] = root(j)
    for (i, j), likeness in links.items():
        if likeness >= 0.8:
            assert got[docs[i].doc_id] == got[docs[j].doc_id]
    for i in range(len(docs)):  # nothing is joined that no chain of links joins
        for j in range(i):
            if got[docs[i].doc_id] == got[docs[j].doc_id]:
                assert root(i) == root(j) or docs[i].text == docs[j].text


def test_defined_cases(spark):
    text = " ".join(f"w{k}" for k in range(80))
    near = text.replace("w40", "zz")
    rows = [(5, text), (3, near), (9, text), (9, text), (None, text), (None, "only null"), (1, None), (2, ""), (4, " - "),
            (6, "two words"), (7, "Two, words!"), (8, "v " * 60_000), (10, "v " * 60_001)]
    assert classes(spark, rows) == sorted([(5, 3), (3, 3), (9, 3), (9, 3), (None, 3), (None, None), (1, 1), (2, 1), (4, 4),
                                           (6, 6), (7, 6), (8, 8), (10, 8)], key=repr)
    assert classes(spark, []) == []


def test_repeated_and_null_ids_link_by_their_texts(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(80)) for x in "abc")
    near = c.replace("c40", "zz")
    rows = [(1, a), (1, b), (2, a), (3, b), (None, c), (None, near), (4, c), (None, "of its own kind entirely")]
    got = classes(spark, rows)
    # a and b are told apart, although both are text of id 1
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 1), (None, 4), (None, 4), (4, 4), (None, None)], key=repr)
    df = spark.createDataFrame(rows, "doc_id long, text string")
    roots = [(r.i, r.root) for r in om.classified(df).collect()]
    assert len({r for _, r in roots}) == 4 and len({r for i, r in roots if i == 1}) == 2
    kept = sorted(((r.doc_id, r.text) for r in om.one_of_each_class(df).collect()), key=repr)
    assert kept == sorted([(1, a), (1, b), (4, c), (None, "of its own kind entirely")], key=repr)


def test_one_of_rows_equal_in_id_and_text_stays(spark):
    rows = [(1, "x y"), (1, "x y"), (2, "x y"), (None, "p q"), (None, "p q"), (None, None), (5, ""), (6, None), (6, "")]
    df = spark.createDataFrame([(i, t, 7) for i, t in rows], "doc_id long, text string, h1 int")
    got = om.one_of_each_class(df)
    assert got.columns == df.columns
    assert sorted([(r.doc_id, r.text or "") for r in got.collect()], key=repr) == sorted([(1, "x y"), (None, "p q"), (5, "")], key=repr)


def passage_texts(share, n=2000, planted=150, size=100, seed=4, vocabulary=4000):
    """Texts of ``size`` words, ``share`` of them one common passage, the others
    their own; behind them near copies of the first ones at an edit similarity
    of 0.82, the edits outside the passage."""
    rng = random.Random(seed)
    words = [f"w{k}" for k in range(vocabulary)]
    passage = [f"p{k}" for k in range(int(share * size))]
    out = []
    for _ in range(n):
        own = [rng.choice(words) for _ in range(size - len(passage))]
        at = rng.randrange(len(own) + 1)
        out.append((own[:at], own[at:]))
    for k in range(planted):
        own = list(out[k][0] + out[k][1])
        for e in rng.sample(range(len(own)), min(18, len(own))):
            own[e] = rng.choice(words)
        out.append((own[:len(out[k][0])], own[len(out[k][0]):]))
    return [" ".join(a + passage + b) for a, b in out]


@pytest.mark.parametrize("share,recall", [(0.3, 1.0), (0.5, 0.99), (0.65, 0.95), (0.72, 0.9)])
def test_near_copies_among_texts_that_share_a_passage(spark, share, recall, monkeypatch):
    texts = passage_texts(share)
    asked = []
    plain = om.links

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return plain(pairs, *rest)
    monkeypatch.setattr(om, "links", counted)
    got = dict(classes(spark, list(enumerate(texts))))
    caught = sum(got[2000 + k] == k for k in range(150)) / 150
    assert caught >= recall
    # nothing else is joined, and pairs stay below a constant a text
    assert len(set(got.values())) >= 2000
    per_text = 2 * om.NEAR * (om.TREES + om.ORDERED_BUCKETS) / 2
    assert sum(asked) <= (2 * (om.TABLES + om.SHORT_TABLES) + per_text) * len(texts)
    print(share, caught, [x / len(texts) for x in asked])


def test_texts_that_share_a_passage_alone_are_joined_by_length(spark):
    """100 common words, then words of their own, 20 to 60: those of up to 25
    are alike; the ends of a bucket may be among the others."""
    rng = random.Random(5)
    passage = [f"p{k}" for k in range(100)]
    sizes = [rng.choice([20, 22, 24, 50, 55, 60]) for _ in range(300)]
    texts = [" ".join(passage + [f"o{i}x{k}" for k in range(n)]) for i, n in enumerate(sizes)]
    got = dict(classes(spark, list(enumerate(texts))))
    short = {got[i] for i, n in enumerate(sizes) if n < 25}
    assert len(short) == 1 and all(got[i] == i for i, n in enumerate(sizes) if n > 25)


@pytest.mark.parametrize("partitions", [1, 3, 40])
def test_neighbours_across_partition_borders(spark, partitions):
    rows = [(t, bytes([0, k // 7, k]), k, k, 10, bytes([k % 3 and 1] * 8)) for t in range(2) for k in range(30)]
    df = spark.createDataFrame(rows, om.PATH)
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = {tuple(r) for r in om.neighbours(df, near=2).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 4)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    alike = [bool(k % 3) for k in range(30)]
    assert got == {(k, j) for k in range(30) for j in range(max(k - 2, 0), k) if alike[k] == alike[j]}


def test_a_hot_group_makes_linear_pairs(spark):
    rows = spark.range(400).select(F.col("id").alias("node"), F.lit(50).alias("n"), F.array(F.lit(1), F.lit(2)).cast("array<long>").alias("keys"))
    assert om.candidates(rows).count() <= 2 * 400


@pytest.mark.parametrize("edges", [[], [(1, 2)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 50)],
                                   [(2 * k, 2 * k + 2) for k in range(20)] + [(2 * k + 1, 2 * k + 3) for k in range(20)]])
def test_components(spark, edges):
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = {}
    for a, b in edges:
        own = {x for x in (a, b)} | {x for x in want if want[x] in (want.get(a, a), want.get(b, b))}
        low = min(min(want.get(x, x) for x in own), *own)
        want |= {x: low for x in own}
    assert got == {x: r for x, r in want.items() if x != r}


def scattered(rng, words, edits, vocabulary):
    words = list(words)
    for at in rng.sample(range(len(words)), edits):
        words[at] = rng.choice(vocabulary)
    return words


@pytest.mark.parametrize("sizes", [(5, 12), (12, 40), (41, 80), (80, 400)])
@pytest.mark.parametrize("similarity", [0.8, 0.85])
def test_recall_by_edit_similarity_is_at_least_99_percent(sizes, similarity):
    rng = random.Random(sizes[0])
    vocabulary = [f"w{k}" for k in range(20_000)]
    met = 0
    for _ in range(400):
        own = [rng.choice(vocabulary) for _ in range(rng.randint(*sizes))]
        pair = pa.array([" ".join(own), " ".join(scattered(rng, own, int((1 - similarity) * len(own) + 1e-9), vocabulary))])
        keys = om.sketches(pair)[1]
        short = om.sketches(pair, om.WORDS, om.SHORT_PICKS, om.SHORT_TABLES)[1]
        met += (keys[0] == keys[1]).any() or len(own) <= om.SHORT_WORDS and (short[0] == short[1]).any()
    assert met >= 0.99 * 400


def test_copies_edited_all_over_are_joined(spark):
    rng = random.Random(2)
    vocabulary, rows = [f"w{k}" for k in range(5000)], []
    for size in [6, 10, 30, *[rng.randint(41, 300) for _ in range(37)]]:
        own = [rng.choice(vocabulary) for _ in range(size)]
        rows += [" ".join(own), " ".join(scattered(rng, own, size // 5, vocabulary))]
    got = dict(classes(spark, list(enumerate(rows))))
    assert sum(got[k + 1] != k for k in range(0, len(rows), 2)) <= 1


def test_classes_join_every_true_link(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()
    words = [wd.lower_words(pa.array([r.text])).hashes for r in docs]
    got = dict(classes(spark, [(r.doc_id, r.text) for r in docs]))
    for i in range(len(docs)):
        for j in range(i):
            most = int(0.2 * max(len(words[i]), len(words[j])) + 1e-9)
            if len(words[i]) and len(words[j]) and om.distance(words[i], words[j], most) is not None:
                assert got[docs[i].doc_id] == got[docs[j].doc_id]


def test_a_link_inside_a_bucket_that_misses_both_ends(spark):
    for seed in range(200):  # a template of 78 of 100 words; the texts 1 and 2 share four more
        template, common = ([f"{x}{seed}x{k}" for k in range(n)] for x, n in (("t", 78), ("c", 4)))
        texts = []
        for d in range(5):
            own = [f"o{seed}x{d}x{k}" for k in range(22)]
            texts.append(" ".join(template + (common + own[4:] if d in (1, 2) else own)))
        keys = om.sketches(pa.array(texts), om.WORDS, 1, 1)[1]
        if (keys == keys[0]).all():
            break
    assert (keys == keys[0]).all()
    assert classes(spark, list(enumerate(texts)), picks=1, tables=1) == [(0, 0), (1, 1), (2, 1), (3, 3), (4, 4)]


@pytest.mark.parametrize("block", [4, 2048])
def test_pairs_of_a_large_bucket_that_no_neighbourhood_meets(spark, block, monkeypatch):
    texts = passage_texts(0.72, 300, 40)
    monkeypatch.setattr(om, "neighbours", lambda rows, *rest: spark.createDataFrame([], "a long, b long"))
    plain = om.compared
    monkeypatch.setattr(om, "compared", lambda nodes, roots, similarity: plain(nodes, roots, similarity, block))
    got = dict(classes(spark, list(enumerate(texts))))
    assert all(got[300 + k] == k for k in range(40)) and len(set(got.values())) == 300


def test_the_bound_of_shared_words_loses_no_link():
    rng = random.Random(9)
    for _ in range(30):
        vocabulary = np.array([rng.randrange(2**63) for _ in range(rng.choice([3, 40, 500]))], np.uint64)
        texts = [np.array([rng.choice(vocabulary) for _ in range(rng.randint(1, 60))], np.uint64) for _ in range(12)]
        for t in texts[:6]:
            own = t.copy()
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
            texts.append(own)
        may = set(zip(*(x.tolist() for x in om.may_link(texts, texts, 0.8, 16))))
        for i, a in enumerate(texts):
            for j, b in enumerate(texts):
                if om.distance(a, b, int(0.2 * max(len(a), len(b)) + 1e-9)) is not None:
                    assert (i, j) in may

import numpy as np
import pyarrow as pa
import pytest

from precis.llm import decontaminate as dc
from precis.llm import words as wd

DOCS = "doc_id long, text string, item_id string, distance int"
ITEMS = "item_id long, text string, doc_id long"


def tokens(text):
    return wd.lower_words(pa.array([text], pa.string())).hashes


def least(item, doc):
    row = np.zeros(len(doc) + 1, int)
    for i, x in enumerate(item, 1):
        new = np.empty_like(row)
        new[0] = i
        for j, y in enumerate(doc, 1):
            new[j] = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
        row = new
    return int(row.min())


def sentence(rng, n, size=400):
    return [f"w{x}" for x in rng.zipf(1.4, n) % size]


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        at, kind = int(rng.integers(len(words))), int(rng.integers(3))
        if kind == 0:
            words[at] = f"e{rng.integers(1000)}"
        elif kind == 1:
            del words[at]
        else:
            words.insert(at, f"e{rng.integers(1000)}")
    return words


def test_recall_over_random_edits_is_at_least_99_percent():
    rng = np.random.default_rng(4)
    items = [sentence(rng, int(n)) for n in rng.integers(10, 120, 150)]
    hashes = [tokens(" ".join(x)) for x in items]
    index = dc.build_index(hashes)
    found = wanted = 0
    for _ in range(500):
        k = int(rng.integers(len(items)))
        most = int(0.2 * len(items[k]) + 1e-9)
        passage = edited(rng, items[k], int(rng.integers(0, most + 1)))
        doc = " ".join(sentence(rng, 60) + passage + sentence(rng, 60))
        if least(hashes[k], tokens(doc)) <= most:
            wanted += 1
            got = dc.find(index, wd.lower_words(pa.array([doc])))
            found += any(i == k for _, i, _ in got)
    assert wanted > 400 and found >= 0.99 * wanted


def test_hits_are_exact(spark):
    rng = np.random.default_rng(8)
    items = [(k, " ".join(sentence(rng, int(n)))) for k, n in enumerate(rng.integers(5, 50, 20))]
    docs = []
    for d in range(60):
        words = sentence(rng, 80)
        if d % 2:
            own = items[d % 20][1].split()
            words[40:40] = edited(rng, own, int(rng.integers(0, 1 + len(own) // 3)))
        docs.append((d, " ".join(words), "x", 0))
    got = {(r.doc_id, r.item_id): (r.item_words, r.distance) for r in dc.contained(
        spark.createDataFrame(docs, DOCS), spark.createDataFrame([(*i, 0) for i in items], ITEMS)).collect()}
    want = {}
    for d, text, _, _ in docs:
        for k, item in items:
            a = tokens(item)
            e = least(a, tokens(text))
            if e <= int(0.2 * len(a) + 1e-9):
                want[d, k] = (len(a), e)
    assert got.keys() <= want.keys() and len(got) >= 0.99 * len(want)
    assert all(got[x][1] >= want[x][1] and got[x][1] <= 0.2 * got[x][0] for x in got)


def test_nulls_empty_short_repeated_and_blocks(spark):
    long = " ".join(f"t{k}" for k in range(30))
    items = [(1, long, 0), (2, long.upper() + "!", 0), (3, None, 0), (4, "", 0), (5, "a b", 0), (None, long, 0)]
    docs = [(1, None, "x", 0), (2, "", "x", 0), (None, f"so {long}", "x", 0), (3, "a b c d " * 50_000 + long, "x", 0), (4, long, "x", 0),
            (4, long, "x", 0), (5, long[:-40], "x", 0)]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    for block in (100, 2):
        got = sorted([(r.doc_id, r.item_id, r.distance) for r in dc.contained(d, i, block=block).collect()], key=repr)
        # "a b" has fewer than five words: found as it stands, and rare here
        assert got == sorted([(x, y, 0) for x in (None, 3, 4, 4) for y in (1, 2, None)] + [(3, 5, 0)], key=repr)
        left = dc.decontaminate(d, i, block=block)
        assert left.columns == d.columns and sorted(r.doc_id for r in left.collect()) == [1, 2, 5]
    assert dc.contained(d.limit(0), i).collect() == [] and dc.contained(d, i.limit(0)).collect() == []
    assert dc.decontaminate(d, i.limit(0)).count() == 7


@pytest.mark.parametrize("n", [5, 6, 9, 17, 80])
def test_every_item_finds_its_own_copy(n):
    rng = np.random.default_rng(n)
    items = [tokens(" ".join(sentence(rng, n))) for _ in range(30)]
    index = dc.build_index(items)
    for k, x in enumerate(items):
        w = wd.Words(x, np.array([0, len(x)]), x, x)
        assert (0, k, 0) in dc.find(index, w)


def test_best_match_against_the_full_table():
    rng = np.random.default_rng(2)
    for _ in range(200):
        a, b = (rng.integers(0, 6, rng.integers(1, 30)).astype(np.uint64) for _ in "ab")
        assert dc.best_match(a, b, len(a)) == least(a, b)


def test_an_item_of_more_words_than_a_block_of_steps():
    rng = np.random.default_rng(6)
    words = [f"w{x}" for x in rng.integers(5000, size=6000)]
    item = tokens(" ".join(words))
    index = dc.build_index([item])
    doc = " ".join(sentence(rng, 50) + edited(rng, words, 300) + sentence(rng, 50))
    got = dc.find(index, wd.lower_words(pa.array(["no such text", doc])))
    assert [(d, k) for d, k, _ in got] == [(1, 0)] and got[0][2] <= 300


def test_short_items_are_found_unless_they_are_common(spark):
    docs = [(k, f"the cat number {k} sat on the mat", "", 0) for k in range(300)]
    docs += [(500, "they say the answer is forty two indeed", "", 0), (501, "Answer is; forty-two!", "", 0), (502, "answer is forty", "", 0)]
    items = [(1, "answer is forty two", 0), (2, "on the mat", 0), (3, "number 7", 0), (4, "two indeed", 0), (5, "mat the", 0)]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame(items, ITEMS)
    for block in (100, 1):
        got = sorted((r.doc_id, r.item_id, r.item_words, r.distance) for r in dc.contained(d, i, block=block).collect())
        assert got == [(7, 3, 2, 0), (500, 1, 4, 0), (500, 4, 2, 0), (501, 1, 4, 0)]
        gone = {r.doc_id for r in d.collect()} - {r.doc_id for r in dc.decontaminate(d, i, block=block).collect()}
        assert gone == {7, 500, 501}


@pytest.mark.parametrize("item", [
    "\u6700\u5927\u7684\u884c\u661f\u662f\u6728\u661f\uff0c\u5b83\u7684\u8d28\u91cf\u662f\u5176\u4ed6\u884c\u661f\u603b\u548c\u7684\u4e24\u500d\u591a\u3002",
    "\u65e5\u672c\u3067\u4e00\u756a\u9ad8\u3044\u5c71\u306f\u5bcc\u58eb\u5c71\u3067\u3001\u9ad8\u3055\u306f\u4e09\u5343\u4e03\u767e\u4e03\u5341\u516d\u30e1\u30fc\u30c8\u30eb\u3067\u3059\u3002",
    "\u0e40\u0e21\u0e37\u0e2d\u0e07\u0e2b\u0e25\u0e27\u0e07\u0e02\u0e2d\u0e07\u0e1b\u0e23\u0e30\u0e40\u0e17\u0e28\u0e44\u0e17\u0e22\u0e04\u0e37\u0e2d\u0e01\u0e23\u0e38\u0e07\u0e40\u0e17\u0e1e",
])
def test_items_in_scripts_without_spaces(spark, item):
    around = "\u7532\u4e59\u4e19\u4e01\u620a\u5df1" * 5
    changed = item[:8] + "\u9f98" + item[9:]
    docs = [(1, around + item + around, "", 0), (2, around, "", 0), (3, "so " + changed + ".", "", 0), (4, item[:10], "", 0)]
    d, i = spark.createDataFrame(docs, DOCS), spark.createDataFrame([(1, item, 0)], ITEMS)
    assert sorted((r.doc_id, r.distance) for r in dc.contained(d, i).collect()) == [(1, 0), (3, 1)]


def test_blocks_are_bounded_by_words(spark):
    items = spark.createDataFrame([(k, " ".join(f"w{k}x{j}" for j in range(100)), 0) for k in range(10)], ITEMS)
    blocks = list(dc.item_blocks(items, "item_id", "text", 100, words=250))
    assert [len(b) for b in blocks] == [2] * 5
    assert [len(b) for b in dc.item_blocks(items, "item_id", "text", 100, words=50)] == [1] * 10

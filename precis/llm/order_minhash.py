"""Near-duplicate documents by Order MinHash and banded alignment.

Sketch: a document's words are labelled by occurrence (the second ``a`` of a
text is another element than the first).  Each of ``tables`` seeded orders
picks the ``picks`` smallest labelled words and hashes them in the order in
which they stand in the text.  Two texts share a table's key with the
probability that both pick the same words in the same order, about J ** picks
at a labelled Jaccard similarity J; s of the words unchanged and the others
replaced give J = s / (2 - s).  Unrelated texts that share common words rarely
have six of them in one order.  The defaults are set for a recall of 0.99 of
pairs at an edit similarity of 0.8 (measured in the tests).  A text of at most
``SHORT_WORDS`` words has too few words for that: it has ``SHORT_TABLES``
further keys of ``SHORT_PICKS`` words.

Candidates: texts that are equal become one node first (hash of the text,
partial minimum).  A first round pairs every node with the smallest node of each
of its buckets, a partial aggregate and an equi-join, so a bucket of m texts
gives m - 1 pairs, and verified links join most buckets into one class.  What
is left are buckets of several classes, as a passage makes that many otherwise
different texts share.  In a second round the nodes of such a bucket of at most
``SMALL`` are all paired; those of larger ones go through a forest of prefix
trees: in each of ``TREES`` orders a node's ``DEPTH`` smallest
labelled words, smallest first, are its path.  Nodes that share a passage share
the beginning of a path and part at the first word outside the passage, so texts
that are also alike outside of it stay neighbours however many share the passage.
The paths are sorted (range partitions, neighbours across a border included) and
every node meets its ``NEAR`` neighbours on either side in each tree; in
one more order the nodes of a bucket stand by their number of words, for texts
that share the passage alone.  Met nodes of different classes are a pair if their
word counts and the share of equal first words of the paths allow a link.  So
pairs per node of this round are bounded by a constant, whatever the size of a
bucket.  A third round is exact for the buckets that still hold several classes:
all their pairs of nodes are compared (:func:`compared`), a cell of two blocks of
nodes at a time.  A bound of the words that two texts share, a matrix product of
hashed word counts, rules out most pairs; it rules out none that can link.  The
work of this round grows with the square of such a bucket, its memory does not.

Verification: a pair links if its word sequences have an edit similarity
``1 - distance / longer`` of at least ``similarity``; the distance is computed
inside a band of diagonals that grows only as needed.  Classes are the
connected components of the links, named by their smallest id.

Defined results: null text counts as empty; texts without a word link only to
equal texts; rows are told apart by their texts alone, so rows that repeat an id
or have none link like all others; a class whose rows all have a null id has
the class id null; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.llm import words as wd
from precis.llm.common import key128, stored, table
from precis.llm.graph import components

WORDS, PICKS, TABLES, SIMILARITY = 1, 6, 80, 0.8
SHORT_WORDS, SHORT_PICKS, SHORT_TABLES = 40, 3, 24
SKETCH = "i long, h1 long, h2 long, n int, keys array<long>"
TREES, DEPTH, NEAR, ORDERED_BUCKETS = 64, 12, 2, 16
SMALL = 8  # nodes of a bucket that are paired one by one
BLOCK, BLOCK_WORDS, TILE = 2048, 1 << 20, 256  # about so many nodes and words of a block; nodes that a matrix product compares at once
BINS = (256, 4096)  # least and most bins of hashed words
MARKS_ALIKE = 0.5  # of the first words of the paths; texts at a similarity of 0.8 share 0.667, give or take 0.06 at 64 trees
PATH = "tree int, path binary, node long, root long, n int, marks binary"
MET = "a long, b long, part int, place long, tree int, node long, root long, n int, marks binary"
_TOP = np.uint64(2**64 - 1)


def labelled(w: wd.Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(labelled shingle hash, text index) in text order; a text of 1 to k - 1
    words gives one shingle of them all."""
    h, owner = wd.shingles(w, k)
    size = np.diff(w.bounds)
    short = np.flatnonzero((size > 0) & (size < k))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for j in range(k - 1):
            at = w.bounds[short] + j
            more = j < size[short]
            whole[more] = wd.mix(whole[more] + w.hashes[at[more]])
        order = np.argsort(np.concatenate([owner, short]), kind="stable")
        h, owner = np.concatenate([h, whole])[order], np.concatenate([owner, short])[order]
    if not len(h):
        return h, owner
    same = wd.mix(h ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    order = np.argsort(same, kind="stable")
    first = np.concatenate([[True], same[order][1:] != same[order][:-1]])
    at = np.arange(len(order))
    times = np.empty(len(order), np.uint64)
    times[order] = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    return wd.mix(h + times * np.uint64(0xD6E8FEB86659FD93)), owner


def least(h: np.ndarray, owner: np.ndarray, n_texts: int, picks: int, tables: int, seed: int):
    """(texts with words, their places in ``h``): first the texts, then for
    each table the places of their ``picks`` smallest words, smallest first;
    the place ``len(h)`` where a text has fewer."""
    counts = np.bincount(owner, minlength=n_texts)
    have = np.flatnonzero(counts)
    yield have
    if not len(have):
        return
    size = counts[have]
    doc = np.repeat(np.arange(len(have)), size)
    some = 4 * picks + 2  # only words below a bar that so many are expected to pass are ranked
    bar = np.where(size <= some, _TOP, ((2.0**64 - 2048) * np.minimum(some / size, 1)).astype(np.uint64))[doc]
    need = np.minimum(size, picks)
    draw = np.random.default_rng(seed)
    for _ in range(tables):
        v = h * np.uint64(int(draw.integers(2**63)) * 2 + 1)
        v ^= v >> np.uint64(32)
        v *= np.uint64(int(draw.integers(2**63)) * 2 + 1)
        low = np.flatnonzero(v <= bar)
        lacking = np.bincount(doc[low], minlength=len(have)) < need
        if lacking.any():  # too few passed: rank all words of that text
            low = np.flatnonzero((v <= bar) | lacking[doc])
        low = low[np.lexsort((v[low], doc[low]))]
        whose = doc[low]
        rank = np.arange(len(low)) - np.searchsorted(whose, whose)
        where = np.full((picks, len(have)), len(h), np.int64)
        first = rank < picks
        where[rank[first], whose[first]] = low[first]
        yield where


def sketches(texts: pa.Array, words: int = WORDS, picks: int = PICKS, tables: int = TABLES
             ) -> tuple[np.ndarray, np.ndarray]:
    """(word counts, keys): one row of ``tables`` keys for each text; the row
    of a text without words means nothing."""
    w = wd.lower_words(texts)
    h, owner = labelled(w, words)
    keys = np.zeros((len(texts), tables), np.uint64)
    picked = least(h, owner, len(texts), picks, tables, 11)
    have = next(picked)
    padded = np.append(h, np.uint64(0))
    for t, where in enumerate(picked):
        where.sort(axis=0)
        key = np.full(len(have), (picks << 32) + t + 1, np.uint64)
        for p in range(picks):
            key = wd.mix(key + padded[where[p]])
        keys[have, t] = key
    return np.diff(w.bounds), keys


def paths(texts: pa.Array, words: int = WORDS, trees: int = TREES, depth: int = DEPTH) -> tuple[np.ndarray, np.ndarray]:
    """(paths, marks): for each tree and text the first ``depth`` words of the
    tree's order, two bytes each; one byte of the first word for each text and tree."""
    h, owner = labelled(wd.lower_words(texts), words)
    path = np.zeros((trees, len(texts), depth), ">u2")
    marks = np.zeros((len(texts), trees), np.uint8)
    picked = least(h, owner, len(texts), depth, trees, 12)
    have = next(picked)
    short = np.append(wd.mix(h), np.uint64(0))
    for t, where in enumerate(picked):
        path[t, have] = (short[where.T] & np.uint64(0xFFFF)).astype(">u2")
        marks[have, t] = (short[where[0]] >> np.uint64(16)).astype(np.uint8)
    return path, marks


def sketch_table(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                 picks: int = PICKS, tables: int = TABLES) -> DataFrame:
    """Rows as in ``SKETCH``; ``h1, h2`` hash the text, ``n`` counts words."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    h1, h2 = key128(text)
    rows = docs.select(F.col(id_col).cast("long").alias("i"), text.alias("t"), h1.alias("h1"), h2.alias("h2"))

    def run(batches):
        for batch in batches:
            for part in wd.pieces(batch, 1):
                n, keys = sketches(part.column(1), words, picks, tables)
                short = n <= SHORT_WORDS
                keys = np.concatenate([keys, np.zeros((len(n), SHORT_TABLES), np.uint64)], axis=1)
                keys[short, tables:] = sketches(part.column(1).filter(pa.array(short)), words, SHORT_PICKS, SHORT_TABLES)[1]
                own = np.where(short, tables + SHORT_TABLES, tables)
                off = np.concatenate([[0], np.cumsum(own)]).astype(np.int32)
                keys = keys[np.arange(tables + SHORT_TABLES) < own[:, None]]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(2), part.column(3), pa.array(n.astype(np.int32)),
                     pa.ListArray.from_arrays(pa.array(off), pa.array(keys.view(np.int64)))],
                    names=["i", "h1", "h2", "n", "keys"])

    return rows.mapInArrow(run, SKETCH)


def distance(a: np.ndarray, b: np.ndarray, most: int) -> int | None:
    """Edit distance of two sequences if it is at most ``most``, else None.

    What both share at their ends is cut off.  Then the table of distances is
    computed column by column inside a band, a column's vertical differences
    (plus and minus one) held as the bits of two integers that slide along the
    diagonal.  What lies outside counts as growing by one, so the result is
    exact once it does not exceed the band's half-width; until then the band
    doubles."""
    m = min(len(a), len(b))
    diff = np.flatnonzero(a[:m] != b[:m])
    cut = int(diff[0]) if len(diff) else m
    a, b = a[cut:], b[cut:]
    m = min(len(a), len(b))
    diff = np.flatnonzero(a[len(a) - m:][::-1] != b[len(b) - m:][::-1])
    cut = int(diff[0]) if len(diff) else m
    a, b = a[:len(a) - cut], b[:len(b) - cut]
    if abs(len(a) - len(b)) > most:
        return None
    if not len(a) or not len(b):
        return max(len(a), len(b))
    both, coded = np.unique(np.concatenate([a, b]), return_inverse=True)
    ca, cb = coded[:len(a)], coded[len(a):]
    shared = np.minimum(np.bincount(ca, minlength=len(both)), np.bincount(cb, minlength=len(both))).sum()
    if max(len(a), len(b)) - shared > most:
        return None
    ca, cb = ca.tolist(), cb.tolist()
    band = max(abs(len(a) - len(b)), 8)
    while True:
        band = min(band, most)
        got = _banded(ca, cb, band)
        if got is not None and got <= band:
            return got
        if band == most:
            return None
        band *= 2


def _banded(a: list, b: list, t: int) -> int | None:
    n, m = len(a), len(b)
    width = 2 * t + 1
    mask = (1 << width) - 1
    where: dict[int, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | (1 << (i + t))
    minus = (1 << (t + 1)) - 1        # rows up to 0: each is one less than the row above
    plus = mask ^ minus
    low, at_diagonal = 1 << (2 * t), 0
    give_up = t + abs(n - m)
    for j, c in enumerate(b):
        plus, minus = (plus >> 1) | low, minus >> 1   # the band moves down a row
        match = (where.get(c, 0) >> j) & mask
        same = ((((match & plus) + plus) ^ plus) | match | minus) & mask
        up = minus | (mask & ~(same | plus))
        down = same & plus
        up, down = ((up << 1) | 1) & mask, (down << 1) & mask
        plus = down | (mask & ~(same | up))
        minus = up & same
        at_diagonal += not (same >> t) & 1
        if at_diagonal > give_up:
            return None
    rows = ((1 << abs(n - m)) - 1) << (t + 1 if n > m else t + 1 - (m - n))
    step = (plus & rows).bit_count() - (minus & rows).bit_count()
    return at_diagonal + (step if n > m else -step)


def members(nodes: DataFrame) -> DataFrame:
    """``key, node, n`` for every node and bucket of several nodes, with the
    smallest node ``lo`` and its words ``nlo``; nodes: ``node, n, keys``."""
    keyed = nodes.where("n > 0 AND node IS NOT NULL").select("node", "n", F.explode("keys").alias("key"))
    # stored, so that the join is one of two plain shuffles, which AQE splits at a hot bucket
    ends = stored(keyed.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.min_by("n", "node").alias("nlo"))
                  .where("lo < hi").drop("hi"), "buckets")
    return keyed.join(ends, "key")


def _alike(n: str, m: str, similarity: float):
    """Whether the word counts allow a link."""
    return F.least(n, m) >= F.lit(similarity) * F.greatest(n, m)


def _ends(met: DataFrame, similarity: float) -> DataFrame:
    pair = met.where("node <> lo").where(_alike("n", "nlo", similarity))
    return pair.select(F.col("node").alias("a"), F.col("lo").alias("b")).distinct()


def candidates(nodes: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Distinct pairs ``a, b`` of each node with the smallest node of each of
    its buckets; nodes: ``node, n, keys``."""
    return _ends(members(nodes), similarity)


def unsettled(met: DataFrame, roots: DataFrame, similarity: float = SIMILARITY) -> tuple[DataFrame, DataFrame]:
    """What the first round leaves open in buckets of several classes, whose
    smallest node is known to all: ``a, b``, all pairs of the other nodes of a
    bucket that has at most ``SMALL`` of them, and ``node, n, root, buckets``,
    the nodes of larger ones; met: rows of :func:`members`, roots: ``node,
    root``."""
    rooted = (met.where("node <> lo").join(roots, "node", "left")
              .select("key", "node", "n", F.coalesce("root", "node").alias("root")))
    # stored, so that the joins are of plain shuffles, which AQE splits at a hot bucket
    rooted = stored(rooted, "rooted")
    several = stored(rooted.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.count(F.lit(1)).alias("m"))
                     .where("r < s").select("key", "m"), "unsettled")
    open_ = stored(rooted.join(several, "key"), "unsettled-rows")
    few = open_.where(F.col("m") <= SMALL).groupBy("key").agg(F.sort_array(F.collect_list(F.struct("node", "n", "root"))).alias("x"))
    pairs = few.select(F.posexplode("x").alias("at", "a"), "x").select("a", F.explode(F.slice("x", F.lit(1), F.col("at"))).alias("b"))
    pairs = (pairs.where("a.root <> b.root").where(_alike("a.n", "b.n", similarity))
             .select(F.col("a.node").alias("a"), F.col("b.node").alias("b")).distinct())
    nodes = open_.where(F.col("m") > SMALL).groupBy("node").agg(  # a node has as many buckets as tables
        F.first("n").alias("n"), F.first("root").alias("root"), F.sort_array(F.collect_set("key")).alias("buckets"))
    return pairs, stored(nodes, "unsettled-nodes")


def _binary(rows: np.ndarray) -> pa.Array:
    """A row of bytes each."""
    n, width = len(rows), rows.dtype.itemsize * rows.shape[1]
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(np.arange(0, (n + 1) * width, width, dtype=np.int32).tobytes()),
                                                  pa.py_buffer(np.ascontiguousarray(rows).tobytes())])


def forest(nodes: DataFrame, words: int = WORDS, trees: int = TREES, depth: int = DEPTH) -> DataFrame:
    """Rows as in ``PATH`` of the nodes ``node, n, root, buckets, t``: one per
    tree, and one per bucket (tree -1) that orders its nodes by words."""
    names = [x.split()[0] for x in PATH.split(", ")]

    def run(batches):
        for batch in batches:
            for part in wd.pieces(batch, 4):
                path, marks = paths(part.column(4), words, trees, depth)
                node, n, root = (part.column(k).to_numpy() for k in range(3))
                every = np.tile(np.arange(len(node)), trees)
                yield rows(np.repeat(np.arange(trees), len(node)), path.reshape(-1, depth), node, root, n, marks, every)
                keys = [b[:ORDERED_BUCKETS] for b in part.column(3).to_pylist()]
                who = np.repeat(np.arange(len(node)), [len(b) for b in keys])
                at = np.stack([np.array([k for b in keys for k in b], np.int64), n[who].astype(np.int64)], axis=1).astype(">i8")
                yield rows(np.full(len(who), -1), at, node, root, n, marks, who)

    def rows(tree, path, node, root, n, marks, who) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [pa.array(tree.astype(np.int32)), _binary(path), pa.array(node[who]), pa.array(root[who]), pa.array(n[who]),
             _binary(marks[who])], names=names)

    return nodes.select("node", "n", "root", "buckets", "t").mapInArrow(run, PATH)


def meet(rows: list[np.ndarray], similarity: float, near: int, same=None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (larger, smaller node) among rows at most ``near`` apart in a
    sorted run of ``tree, node, root, n, marks``; ``same`` leaves out pairs of
    rows of one part."""
    tree, node, root, n, marks = rows
    a, b = [], []
    for d in range(1, near + 1):
        x, y = slice(d, None), slice(None, -d)
        ok = (tree[x] == tree[y]) & (root[x] != root[y])
        ok &= np.minimum(n[x], n[y]) >= similarity * np.maximum(n[x], n[y])
        if same is not None:
            ok &= same[x] != same[y]
        at = np.flatnonzero(ok)
        at = at[(marks[at + d] == marks[at]).sum(axis=1) >= MARKS_ALIKE * marks.shape[1]]
        a.append(np.maximum(node[at + d], node[at]))
        b.append(np.minimum(node[at + d], node[at]))
    return np.concatenate(a), np.concatenate(b)


def neighbours(rows: DataFrame, similarity: float = SIMILARITY, near: int = NEAR) -> DataFrame:
    """Distinct pairs ``a, b`` of nodes of different classes that meet in the
    sorted rows (``PATH``).  The first and last rows of every range partition
    come to the driver (2 * ``near`` a partition), for the pairs across borders."""
    spark = rows.sparkSession
    ordered = rows.repartitionByRange("tree", "path", "node").sortWithinPartitions("tree", "path", "node")
    names = [x.split()[0] for x in MET.split(", ")]
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]

    def arrays(table: pa.Table) -> list[np.ndarray]:
        marks = np.frombuffer(b"".join(table.column(4).to_pylist()), np.uint8)
        return [table.column(k).to_numpy() for k in range(4)] + [marks.reshape(table.num_rows, -1)]

    def run(batches):
        from pyspark import TaskContext
        part, done, tail = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            own = pa.Table.from_batches([batch])
            if done < near:
                yield edge(own.slice(0, near - done), part, done)
            table = own if tail is None else pa.concat_tables([tail, own])
            a, b = meet(arrays(table), similarity, near)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), *[pa.nulls(len(a), k) for k in kinds[2:]]], names=names)
            done += batch.num_rows
            tail = table.slice(max(table.num_rows - near, 0))
        if tail is not None:
            yield edge(tail, part, done - tail.num_rows)

    def edge(table: pa.Table, part: int, place: int) -> pa.RecordBatch:
        m = table.num_rows
        return pa.RecordBatch.from_arrays(
            [pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.array(np.full(m, part, np.int32)), pa.array(np.arange(place, place + m)),
             *[table.column(k).combine_chunks() for k in range(5)]], names=names)

    met = stored(ordered.select("tree", "node", "root", "n", "marks").mapInArrow(run, MET), "met")
    found = met.where("part IS NULL").select("a", "b")
    edges = met.where("part IS NOT NULL").dropDuplicates(["part", "place"]).orderBy("part", "place").collect()
    if edges:
        rows = [np.array([r[k] for r in edges]) for k in ("tree", "node", "root", "n")]
        marks = np.frombuffer(b"".join(bytes(r.marks) for r in edges), np.uint8).reshape(len(edges), -1)
        a, b = meet([*rows, marks], similarity, near, np.array([r.part for r in edges]))
        found = found.unionByName(spark.createDataFrame(list(zip(a.tolist(), b.tolist())), "a long, b long"))
    return found.distinct()


def links(pairs: DataFrame, texts: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """The pairs ``a, b`` whose texts (``node, t``, one row a node) are similar
    enough.  Both joins read one shuffle of the texts, at every size."""
    left = texts.select(F.col("node").alias("a"), F.col("t").alias("ta"))
    right = texts.select(F.col("node").alias("b"), F.col("t").alias("tb"))
    joined = (pairs.hint("merge").join(left, "a").hint("merge").join(right, "b")
              .select("a", "b", "ta", "tb"))

    def run(batches):
        for batch in batches:
            for part in wd.pieces(batch, 2):
                x, y = wd.lower_words(part.column(2)), wd.lower_words(part.column(3))
                keep = []
                for k in range(part.num_rows):
                    p, q = x.hashes[x.bounds[k]:x.bounds[k + 1]], y.hashes[y.bounds[k]:y.bounds[k + 1]]
                    most = int((1 - similarity) * max(len(p), len(q)) + 1e-9)
                    keep.append(distance(p, q, most) is not None)
                yield part.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    return joined.mapInArrow(run, "a long, b long")


def worded(rows: DataFrame) -> DataFrame:
    """``node, n, buckets, words`` of rows ``node, n, buckets, t``; words: their
    hashes in text order, eight bytes each."""
    def run(batches):
        for batch in batches:
            for part in wd.pieces(batch, 3):
                w = wd.lower_words(part.column(3))
                held = [w.hashes[a:b].tobytes() for a, b in zip(w.bounds[:-1], w.bounds[1:])]
                yield pa.RecordBatch.from_arrays([*[part.column(k) for k in range(3)], pa.array(held, pa.binary())],
                                                 names=["node", "n", "buckets", "words"])

    return rows.select("node", "n", "buckets", "t").mapInArrow(run, "node long, n int, buckets array<long>, words binary")


def _bins(words: list[np.ndarray], bins: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text, whether a bin holds at least one and at least two of its
    words, and how many words are beyond two a bin."""
    owner = np.repeat(np.arange(len(words)), [len(w) for w in words])
    at = owner * bins + (wd.mix(np.concatenate(words)) % np.uint64(bins)).astype(np.int64)
    held = np.bincount(at, minlength=len(words) * bins).reshape(len(words), bins)
    return np.concatenate([held >= 1, held >= 2], axis=1).astype(np.float32), np.maximum(held - 2, 0).sum(axis=1)


def may_link(a: list[np.ndarray], b: list[np.ndarray], similarity: float, bins: int) -> tuple[np.ndarray, np.ndarray]:
    """Places in ``a`` and ``b`` (word hashes of texts) of all pairs that can be
    similar enough: bins shared by two texts count at least the words they
    share, and whatever the longer one does not share is an edit."""
    (x, x_more), (y, y_more) = _bins(a, bins), _bins(b, bins)
    shared = x @ y.T + np.minimum(x_more[:, None], y_more[None, :])
    n, m = np.array([len(w) for w in a])[:, None], np.array([len(w) for w in b])[None, :]
    longer = np.maximum(n, m)
    need = longer - ((1 - similarity) * longer + 1e-9).astype(np.int64)
    return np.nonzero((np.minimum(n, m) >= need) & (shared >= need))


def compared(nodes: DataFrame, roots: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """Links ``a, b`` between nodes ``node, n, buckets, words`` that share a
    bucket and are of different classes (``node, root``): enough of them to join
    the classes of all pairs that are similar enough.  A bucket's nodes are dealt
    into blocks, and every two blocks meet in a cell; a pair is looked at in the
    smallest bucket it shares."""
    rooted = nodes.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    spread = stored(rooted.select("node", "n", "root", F.explode("buckets").alias("key")), "spread")
    size = F.greatest(F.count(F.lit(1)) / block, F.sum("n") / BLOCK_WORDS)
    several = stored(spread.groupBy("key").agg(F.min("root").alias("r"), F.max("root").alias("s"), F.ceil(size).cast("int").alias("blocks"))
                     .where("r < s").select("key", "blocks"), "several")
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    cells = (spread.join(several, "key").select("key", "node", "root", own.alias("own"), "blocks")
             .select("key", "node", "root", "own", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
             .select("key", "node", "root", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j")))

    def run(cell: pa.Table) -> pa.Table:
        order = np.argsort(cell.column("n").to_numpy(), kind="stable")
        cell = cell.take(pa.array(order))
        node, own, key = cell.column("node").to_numpy(), cell.column("own").to_numpy(), cell.column("key")[0].as_py()
        words = [np.frombuffer(w, np.uint64) for w in cell.column("words").to_pylist()]
        size = np.array([len(w) for w in words])
        before = [{k for k in keys if k < key} for keys in cell.column("buckets").to_pylist()]
        above = {r: r for r in cell.column("root").to_pylist()}
        root, found = cell.column("root").to_pylist(), []
        bins = min(max(1 << int(2 * size.max() - 1).bit_length(), BINS[0]), BINS[1])

        def top(r: int) -> int:
            while above[r] != r:
                above[r] = r = above[above[r]]
            return r

        first, second = cell.column("i")[0].as_py(), cell.column("j")[0].as_py()
        left, right = np.flatnonzero(own == first), np.flatnonzero(own == second)
        for s in range(0, len(left), TILE):
            p = left[s:s + TILE]
            for t in range(s if first == second else 0, len(right), TILE):
                q = right[t:t + TILE]
                if max(size[p[0]], size[q[0]]) * similarity > min(size[p[-1]], size[q[-1]]) + 1:
                    continue  # all of one tile are too long for all of the other
                for x, y in zip(*(z.tolist() for z in may_link([words[k] for k in p], [words[k] for k in q], similarity, bins))):
                    x, y = p[x], q[y]
                    r, s_ = top(root[x]), top(root[y])
                    if r == s_ or not before[x].isdisjoint(before[y]) or first == second and x >= y:
                        continue
                    most = int((1 - similarity) * max(size[x], size[y]) + 1e-9)
                    if distance(words[x], words[y], most) is not None:
                        above[max(r, s_)] = min(r, s_)
                        found.append((int(max(node[x], node[y])), int(min(node[x], node[y]))))
        return pa.table({"a": pa.array([a for a, _ in found], pa.int64()), "b": pa.array([b for _, b in found], pa.int64())})

    return (cells.join(nodes, "node").select("key", "i", "j", "node", "root", "own", "n", "buckets", "words")
            .groupBy("key", "i", "j").applyInArrow(run, "a long, b long").distinct())


def joined_classes(roots: DataFrame, found: DataFrame) -> DataFrame:
    """``node, root`` after further links ``a, b``; only the classes that they
    join go through the graph once more."""
    roots = stored(roots, "roots")
    ends = found
    for c in ("a", "b"):
        own = roots.select(F.col("node").alias(c), F.col("root").alias("r"))
        ends = ends.join(own, c, "left").withColumn(c, F.coalesce("r", c)).drop("r")
    again = stored(components(ends.where("a <> b")), "joined")
    further = again.select(F.col("node").alias("root"), F.col("root").alias("r"))
    return roots.join(further, "root", "left").select("node", F.coalesce("r", "root").alias("root")).unionByName(again)


def _texts(docs: DataFrame, text_col: str, id_col: str, node, wanted: DataFrame) -> DataFrame:
    """``node, t``, one row for each of the nodes ``node, least`` (its smallest
    id): only rows of that id are kept before any shuffle of texts is sorted."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("i"), text.alias("t")).withColumn("node", node(F.col("t")))
    return (rows.join(wanted, "node").where(F.col("i").eqNullSafe(F.col("least")))
            .select("node", "t").dropDuplicates(["node"]))


def _node(clashes: list):
    """Text -> its node: 64 bits of hash, from the second 64 bits where two
    texts share the first."""
    def of(text):
        h1, h2 = key128(text)
        return F.when(h1.isin(clashes), h2).otherwise(h1) if clashes else h1
    return of


def classified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
               picks: int = PICKS, tables: int = TABLES, similarity: float = SIMILARITY) -> DataFrame:
    """``i, h1, h2, root`` of each row of ``docs``: its id, the hashes of its
    text, and a name of its class."""
    sketched = stored(sketch_table(docs, id_col, text_col, words, picks, tables), "sketches")
    clashes = [r.h1 for r in sketched.select("h1", "h2").distinct().groupBy("h1").count().where("count > 1").collect()]  # n^2 / 2^65 of n texts
    node = _node(clashes)
    own = F.when(F.col("h1").isin(clashes), F.col("h2")).otherwise(F.col("h1")) if clashes else F.col("h1")
    sketched = sketched.withColumn("node", own)
    nodes = sketched.groupBy("node").agg(F.first("n").alias("n"), F.first("keys").alias("keys"))
    least_id = sketched.groupBy("node").agg(F.min("i").alias("least"))
    met = stored(members(nodes), "members")
    pairs = stored(_ends(met, similarity), "pairs")

    def verified(pairs: DataFrame) -> DataFrame:
        paired = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct().join(least_id, "node")
        return links(pairs, _texts(docs, text_col, id_col, node, paired), similarity)

    roots = components(verified(pairs))
    more, left = unsettled(met, roots, similarity)
    if not left.isEmpty():
        texts = _texts(docs, text_col, id_col, node, left.select("node").join(least_id, "node"))
        # stored, since the range partitions are sampled before they are written
        rows = stored(left.join(texts, "node"), "unsettled-texts")
        more = more.unionByName(neighbours(forest(rows, words), similarity)).distinct()
    more = stored(more, "pairs")
    if not more.isEmpty():
        found = stored(verified(more), "links")
        if not found.isEmpty():
            roots = joined_classes(roots, found)
    if not left.isEmpty():
        roots = stored(roots, "roots")
        found = stored(compared(stored(worded(rows), "unsettled-words"), roots, similarity), "links")
        if not found.isEmpty():
            roots = joined_classes(roots, found)
    # stored, so that the join is one of two plain shuffles, which AQE splits
    # where one text has very many copies
    roots = stored(roots, "roots")
    return stored(sketched.select("i", "h1", "h2", "node").join(roots, "node", "left")
                  .select("i", "h1", "h2", F.coalesce("root", "node").alias("root")), "classified")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
                    picks: int = PICKS, tables: int = TABLES, similarity: float = SIMILARITY) -> DataFrame:
    """``doc_id, class_id``, a row for each row of ``docs``."""
    rows = classified(docs, id_col, text_col, words, picks, tables, similarity)
    names = stored(rows.groupBy("root").agg(F.min("i").alias("class_id")), "classes")
    return rows.join(names, "root").select(F.col("i").alias("doc_id"), "class_id")


def one_of_each_class(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The rows of ``docs``, one of each class: that with the smallest id
    (null last), among rows of one id that with the smallest hash of its text,
    and any one of rows equal in both."""
    rows = classified(docs, id_col, text_col, **how)
    order = F.struct(F.col("i").isNull().alias("z"), "i", "h1", "h2")
    first = stored(rows.groupBy("root").agg(F.min(order).alias("first")), "first")
    marked = rows.withColumn("own", order).join(first, "root").withColumn("is", F.col("own") == F.col("first"))
    gone = marked.where("NOT is").select("i", "h1", "h2").distinct()
    twins = stored(marked.where("is").groupBy("i", "h1", "h2").count().where("count > 1"), "twins")
    h1, h2 = key128(F.coalesce(F.col(text_col), F.lit("")))
    keyed = docs.withColumns({"__om_id": F.col(id_col).cast("long"), "__om_h1": h1, "__om_h2": h2})

    def same(other: DataFrame):
        return (keyed["__om_id"].eqNullSafe(other["i"]) & (keyed["__om_h1"] == other["h1"]) & (keyed["__om_h2"] == other["h2"]))

    kept = keyed.join(gone, same(gone), "left_anti")
    if not twins.isEmpty():
        keys = ["__om_id", "__om_h1", "__om_h2"]
        kept = kept.join(twins, same(twins), "left_anti").unionByName(
            keyed.join(twins, same(twins), "left_semi").dropDuplicates(keys))
    return kept.select(*docs.columns)


def near_duplicate_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))

"""Hard-negative mining with a vertical scan (BOND).

Vectors become integers, ``floor(scale * x)``; a row's score is its inner
product with the anchor, so all scores are exact.  Anchors are the rows whose id
is divisible by ``every``.  An anchor's positives are its first ``positives``
other rows of the same label; for each of them the first ``negatives`` rows of
another label with ``low * positive <= 100 * score <= 100 * positive`` are
returned.  Higher scores come first, ties by the smaller id.

Scan: a task holds its rows by column, one array per dimension, grouped by
label.  For an anchor it reads the columns in descending magnitude of the
anchor's components and adds them up.  From the least and greatest value of the
columns not yet read follow a lower and an upper bound of every score.  A row
leaves the candidates when its upper bound lies below the ``positives``-th
lower bound (positives), or when it can lie in no window or lies, in each
window that it can still reach, below ``negatives`` rows that surely lie in it
and score higher (negatives).  What is left after the last column has exact scores.

How it runs: the integer vectors are written once.  Anchors go to the tasks in
blocks of at most about ``block``; each block is two passes over all rows, one
for the positives, one, with the positives' scores, for the negatives.  Every
task returns its own first few rows per anchor or window, and a second step
takes the first of those.  Nothing is joined row by row and no row is shuffled;
a block, its positives and the few rows per task are all that moves.

Defined results: rows with a null label, a null vector or a null, NaN or
infinite component take no part.  Where an id is divisible by 7 the label is
``(label + 1) % 10``.  "Other" rows are those with another id; a null id is no
anchor, differs from every id and comes last in a tie.  Rows that repeat an id
count each; repeated anchors (id, label, vector) are mined once.  Vectors of
different lengths are compared over the components that both have.  Components
beyond +-2^24 after scaling count as that; vectors have at most 2^14
components.  A negative positive score has no window, so no row.  Other columns
are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from precis.llm.common import scratch, stored, table
from precis.llm.vectors import integer_vectors

SCALE, POSITIVES, NEGATIVES, LOW, EVERY = 256, 5, 5, 80, 100
MOST = 1 << 24
BLOCK = 4096     # anchors sent to the tasks at once
CHUNK = 1 << 22  # components a task holds at once
STEP = 8         # columns read between two looks at the bounds

POSITIVE = "a long, anchor_id long, positive_id long, score long"
NEGATIVE = "a long, anchor_id long, p int, positive_id long, positive_score long, negative_id long, score long"
RESULT = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


class Chunk:
    """Rows of a task by column, ordered by label, then id (null last)."""

    def __init__(self, ids: np.ndarray, known: np.ndarray, labels: np.ndarray, sizes: np.ndarray, values: np.ndarray):
        order = np.lexsort((ids, ~known, labels))
        self.ids, self.known, self.labels = ids[order], known[order], labels[order]
        rows = np.zeros((len(ids), max(int(sizes.max()), 1)), np.int32)
        rows[np.arange(rows.shape[1]) < sizes[:, None]] = values
        self.columns = np.ascontiguousarray(rows[order].T)
        self.least, self.most = self.columns.min(axis=1).astype(np.int64), self.columns.max(axis=1).astype(np.int64)

    def own(self, label: int) -> slice:
        return slice(*np.searchsorted(self.labels, [label, label + 1]))

    def others(self, rows: np.ndarray, anchor_id: int) -> np.ndarray:
        return rows[~self.known[rows] | (self.ids[rows] != anchor_id)]


def chunks(batches, most: int = CHUNK):
    """Batches ``i, label, v`` put together to at most about ``most`` components."""
    held, size = [], 0
    for batch in batches:
        if batch.num_rows:
            held.append(batch)
            size += len(batch.column(2).flatten())
        if size >= most:
            yield _chunk(held)
            held, size = [], 0
    if held:
        yield _chunk(held)


def _chunk(batches: list) -> Chunk:
    rows = pa.Table.from_batches(batches).combine_chunks()
    ids, v = rows.column(0).combine_chunks(), rows.column(2).combine_chunks()
    sizes = v.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return Chunk(ids.fill_null(0).to_numpy(), np.asarray(ids.is_valid()), rows.column(1).to_numpy().astype(np.int64), sizes,
                 v.flatten().to_numpy())


def _scan(chunk: Chunk, q: np.ndarray, rows: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
    """(rows left, exact scores): the vertical scan.  ``keep(low, high)`` says
    which rows stay, given bounds of their scores."""
    dims = min(len(q), len(chunk.columns))
    order = np.argsort(-np.abs(q[:dims]), kind="stable")
    q = q[order].astype(np.int64)
    a, b = q * chunk.least[order], q * chunk.most[order]
    rest = lambda x: np.append(np.cumsum(x[::-1])[::-1], 0)
    low, high = rest(np.minimum(a, b)), rest(np.maximum(a, b))
    whole = len(rows) and rows[-1] - rows[0] + 1 == len(rows)  # a run of rows is read without an index
    at = slice(int(rows[0]), int(rows[-1]) + 1) if whole else rows
    score = np.zeros(len(rows), np.int64)
    for j, d in enumerate(order):
        score += q[j] * chunk.columns[d, at]
        if (j + 1) % STEP == 0 or j + 1 == dims:
            stay = keep(score + low[j + 1], score + high[j + 1])
            if j + 1 == dims or stay.sum() < 0.8 * len(rows):
                rows, score = rows[stay], score[stay]
                at = rows
            if not len(rows):
                break
    return rows, score


def _first(chunk: Chunk, rows: np.ndarray, score: np.ndarray, k: int) -> np.ndarray:
    """Places of the first ``k`` by score, then id."""
    if len(score) > 4 * k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        at = np.arange(len(score))
    order = np.lexsort((chunk.ids[rows[at]], ~chunk.known[rows[at]], -score[at]))
    return at[order[:k]]


def _kth(x: np.ndarray, k: int) -> int:
    return int(np.partition(x, len(x) - k)[len(x) - k])


def top_same(chunk: Chunk, anchor_id: int, label: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, scores) of the first ``k`` other rows of the label."""
    own = chunk.own(label)
    rows = chunk.others(np.arange(own.start, own.stop), anchor_id)

    def keep(low, high):
        return high >= _kth(low, k) if len(low) > k else np.ones(len(low), bool)

    rows, score = _scan(chunk, q, rows, keep)
    at = _first(chunk, rows, score, k)
    return rows[at], score[at]


def in_windows(chunk: Chunk, anchor_id: int, label: int, q: np.ndarray, windows: list[tuple[int, int]], k: int) -> list:
    """For each window ``least, most`` the (rows, scores) of the first ``k``
    rows of another label in it."""
    own = chunk.own(label)
    rows = chunk.others(np.concatenate([np.arange(own.start), np.arange(own.stop, len(chunk.ids))]), anchor_id)

    def keep(low, high):
        stay = np.zeros(len(low), bool)
        for least, most in windows:
            surely = low[(low >= least) & (high <= most)]
            bar = max(least, _kth(surely, k)) if len(surely) >= k else least
            stay |= (high >= bar) & (low <= most)
        return stay

    rows, score = _scan(chunk, q, rows, keep)
    out = []
    for least, most in windows:
        inside = np.flatnonzero((score >= least) & (score <= most))
        at = inside[_first(chunk, rows[inside], score[inside], k)]
        out.append((rows[at], score[at]))
    return out


def window(score: int, low: int = LOW) -> tuple[int, int]:
    """The least and the greatest whole score ``s`` with ``low * score <= 100 * s <= 100 * score``."""
    return -(-low * score // 100), score


def _column(parts: list, kind) -> pa.Array:
    return pa.array(np.concatenate(parts) if parts else np.zeros(0, np.int64)).cast(kind)


def _ids(chunk: Chunk, rows: np.ndarray) -> pa.Array:
    return pa.array(chunk.ids[rows], mask=~chunk.known[rows])


def positives_of(vectors: DataFrame, anchors, k: int) -> DataFrame:
    """Rows as in ``POSITIVE``: each task's first ``k`` of each anchor of the
    broadcast block."""
    def run(batches):
        for chunk in chunks(batches):
            found = []
            for a, i, label, q in anchors.value:
                rows, score = top_same(chunk, i, label, np.array(q, np.int64), k)
                found.append((np.full(len(rows), a), np.full(len(rows), i), rows, score))
            yield _batch(chunk, found, 2, POSITIVE)

    return vectors.select("i", "label", "v").mapInArrow(run, POSITIVE)


def negatives_of(vectors: DataFrame, anchors, k: int, low: int) -> DataFrame:
    """Rows as in ``NEGATIVE``: each task's first ``k`` of each window; the
    block's anchors carry their positives ``(place, id, score)``."""
    def run(batches):
        for chunk in chunks(batches):
            found = []
            for a, i, label, q, positives in anchors.value:
                spans = [window(s, low) for _, _, s in positives]
                open_ = sorted({w for w in spans if w[0] <= w[1]})
                if not open_:
                    continue
                got = dict(zip(open_, in_windows(chunk, i, label, np.array(q, np.int64), open_, k)))
                for (place, j, s), span in zip(positives, spans):
                    if span in got:
                        rows, score = got[span]
                        n = len(rows)
                        found.append((np.full(n, a), np.full(n, i), np.full(n, place), [j] * n, np.full(n, s), rows, score))
            yield _batch(chunk, found, 5, NEGATIVE)

    return vectors.select("i", "label", "v").mapInArrow(run, NEGATIVE)


def _batch(chunk: Chunk, found: list, at: int, schema: str) -> pa.RecordBatch:
    """Columns put together; column ``at`` holds rows of the chunk, which become ids."""
    fields = [x.split() for x in schema.split(", ")]
    columns = list(zip(*found)) if found else [[] for _ in fields]
    arrays = []
    for k, ((_, kind), parts) in enumerate(zip(fields, columns)):
        kind = pa.int32() if kind == "int" else pa.int64()
        if k == at:
            arrays.append(_ids(chunk, np.concatenate(parts)) if parts else pa.array([], kind))
        elif parts and isinstance(parts[0], list):
            arrays.append(pa.array([x for part in parts for x in part], kind))
        else:
            arrays.append(_column(list(parts), kind))
    return pa.RecordBatch.from_arrays(arrays, names=[name for name, _ in fields])


def first_rows(rows: DataFrame, group: list[str], id_col: str, k: int, name: str) -> DataFrame:
    """The first ``k`` rows of each group, numbered from 1; Spark cuts each
    map task's rows to ``k`` a group before the shuffle."""
    order = W.partitionBy(*group).orderBy(F.col("score").desc(), F.col(id_col).asc_nulls_last())
    return rows.withColumn(name, F.row_number().over(order)).where(F.col(name) <= k)


def mine(df: DataFrame, id_col: str = "vec_id", label_col: str = "label", vec_col: str = "embedding", scale: int = SCALE,
         positives: int = POSITIVES, negatives: int = NEGATIVES, low: int = LOW, every: int = EVERY,
         block: int = BLOCK) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score``."""
    spark = df.sparkSession
    i, label = F.col(id_col).cast("long"), F.col(label_col).cast("long")
    rows = df.where(label.isNotNull()).select(
        i.alias("i"), F.when(i % 7 == 0, (label + 1) % 10).otherwise(label).alias("label"), F.col(vec_col).alias("x"))
    vectors = integer_vectors(rows, "i long, label long", "x", scale, MOST, name="mined-vectors")
    asked = stored(vectors.where(F.col("i") % every == 0).distinct()
                   .withColumn("a", F.monotonically_increasing_id()), "anchors")
    blocks = -(-asked.count() // block)
    out = scratch(spark, "negatives")
    spark.createDataFrame([], NEGATIVE + ", rank int").write.parquet(out)
    for b in range(blocks):
        part = asked.where(F.pmod(F.xxhash64("a"), F.lit(blocks)) == b).collect()  # about ``block`` rows
        sent = spark.sparkContext.broadcast([(r.a, r.i, r.label, r.v) for r in part])
        near = first_rows(positives_of(vectors, sent, positives), ["a"], "positive_id", positives, "p")
        per: dict = {}
        for r in near.collect():  # at most ``positives`` rows an anchor of the block
            per.setdefault(r.a, []).append((r.p, r.positive_id, r.score))
        sent.destroy()
        sent = spark.sparkContext.broadcast([(r.a, r.i, r.label, r.v, sorted(per[r.a])) for r in part if r.a in per])
        far = first_rows(negatives_of(vectors, sent, negatives, low), ["a", "p"], "negative_id", negatives, "rank")
        far.write.mode("append").parquet(out)
        sent.destroy()
    return (spark.read.schema(NEGATIVE + ", rank int").parquet(out)
            .withColumnRenamed("score", "negative_score").select(*RESULT))


def hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mine(table(spark, sf_dir, "embeddings"))


ORACLE = f"""
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         [CAST(floor({SCALE} * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS v
  FROM embeddings
  WHERE label IS NOT NULL AND len([x FOR x IN embedding IF x IS NOT NULL AND isfinite(x)]) = len(embedding)
), s AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id, a.label = b.label AS same,
         CAST(list_sum([a.v[i] * b.v[i] FOR i IN range(1, len(a.v) + 1)]) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % {EVERY} = 0
), p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= {POSITIVES}
)
SELECT anchor_id, positive_id,
       CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, s.vec_id) AS INTEGER) AS rank,
       s.vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND {LOW} * positive_score <= 100 * score AND score <= positive_score
QUALIFY rank <= {NEGATIVES}
"""

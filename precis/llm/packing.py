"""Packing into optimal length buckets.

Documents are cut into pieces of at most ``max_tokens``.  The global histogram
of piece lengths, in units of ``granule`` tokens (at most ``max_tokens /
granule`` cells, so its size is bounded whatever the corpus), goes to the
driver, where dynamic programming chooses the ``buckets`` upper bounds that
minimise the padding of the whole corpus.  Inside each bucket the pieces, in
order of id and piece, form batches of as many sequences as the token budget
holds at the bucket's length.  Positions come from quantile ranges and their
counts (see ``common.positions``), so a bucket that holds most of the corpus is
numbered by many tasks.

Tokens are runs of letters and digits and single other signs, counted by the
scan itself, unless ``tokens`` gives another expression.  Defined results: null
or empty text is one piece of 0 tokens, padded to one granule; a null id comes
first; repeated rows are pieces of their own; ties in padding go to the
smaller bounds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.llm.common import positions, stored, table

MAX_TOKENS, GRANULE, BUCKETS, BATCH_TOKENS = 8192, 8, 8, 65536
TOKEN = r"[\p{L}\p{N}]+|[^ \t\n\x0B\f\r\p{L}\p{N}]"


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(TOKEN))


def pieces(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None,
           max_tokens: int = MAX_TOKENS, granule: int = GRANULE) -> DataFrame:
    n = F.coalesce((token_count(F.col(text_col)) if tokens is None else tokens).cast("long"), F.lit(0))
    cut = docs.select(F.col(id_col).alias("doc_id"), n.alias("_all")).withColumn(
        "piece", F.explode(F.sequence(F.lit(0), F.greatest(F.ceil(F.col("_all") / max_tokens) - 1, F.lit(0)).cast("int"))))
    size = F.least(F.col("_all") - F.col("piece") * max_tokens, F.lit(max_tokens))
    return cut.select("doc_id", "piece", (F.col("piece").cast("long") * max_tokens).alias("first_token"),
                      size.alias("n_tokens"),
                      F.greatest(F.ceil(size / granule), F.lit(1)).cast("int").alias("cell"))


def best_bounds(cells: np.ndarray, counts: np.ndarray, tokens: np.ndarray, buckets: int, granule: int) -> list[int]:
    """Upper bounds, in cells, of ``min(buckets, used cells)`` buckets with the
    least padding; ``cells`` ascending."""
    m = len(cells)
    if not m:
        return []
    c = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
    s = np.concatenate([[0], np.cumsum(tokens)]).astype(np.int64)
    top = np.concatenate([[0], cells]).astype(np.int64) * granule
    pad = top[None, :] * (c[None, :] - c[:, None]) - (s[None, :] - s[:, None])  # bucket (i, j]
    far = np.iinfo(np.int64).max // 4
    pad[np.tril_indices(m + 1)] = far
    cost, back = pad[0].copy(), []
    for _ in range(1, min(buckets, m)):
        total = np.minimum(cost, far)[:, None] + pad
        back.append(total.argmin(axis=0))
        cost = np.minimum(total.min(axis=0), far)
    bounds, j = [], m
    for choice in reversed(back):
        bounds.append(int(cells[j - 1]))
        j = int(choice[j])
    return [*reversed([*bounds, int(cells[j - 1])])]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokens: Column | None = None,
         max_tokens: int = MAX_TOKENS, granule: int = GRANULE, buckets: int = BUCKETS,
         batch_tokens: int = BATCH_TOKENS) -> DataFrame:
    """One row per piece: ``doc_id, piece, first_token, n_tokens, bucket,
    bucket_tokens, batch, slot`` (batches count from 0 inside a bucket)."""
    cut = stored(pieces(docs, id_col, text_col, tokens, max_tokens, granule), "pieces")
    rows = cut.groupBy("cell").agg(F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).orderBy("cell").collect()
    bounds = best_bounds(*(np.array([r[k] for r in rows], np.int64) for k in range(3)), buckets, granule)
    known = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array(F.lit(1))
    placed = (cut.withColumn("bucket", F.size(F.filter(known, lambda b: b < F.col("cell"))))
              .withColumn("bucket_tokens", (F.get(known, F.col("bucket")) * granule).cast("long")))
    numbered = positions(placed, "bucket", "doc_id", ["piece", "n_tokens"])
    slots = F.greatest(F.floor(F.lit(batch_tokens) / F.col("bucket_tokens")), F.lit(1)).cast("long")
    return (numbered.withColumn("_slots", slots)
            .select("doc_id", "piece", "first_token", "n_tokens", "bucket", "bucket_tokens",
                    F.expr("_pos div _slots").alias("batch"), F.expr("_pos % _slots").cast("long").alias("slot")))


def pack_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def oracle(source: str = "documents") -> str:
    """DuckDB SQL of :func:`pack` with the default parameters over ``source``."""
    levels = [f"""d1 AS (SELECT 1 AS k, j, {GRANULE} * cell * c - s AS cost, CAST(0 AS BIGINT) AS i FROM ix)"""]
    for k in range(2, BUCKETS + 1):
        levels.append(f"""d{k} AS (SELECT {k} AS k, j, best[1] AS cost, best[2] AS i FROM (
  SELECT b.j, min([a.cost + {GRANULE} * b.cell * (b.c - x.c) - (b.s - x.s), a.j]) AS best
  FROM d{k - 1} a JOIN ix x ON x.j = a.j JOIN ix b ON b.j > a.j GROUP BY b.j))""")
    every = " UNION ALL ".join(f"SELECT * FROM d{k}" for k in range(1, BUCKETS + 1))
    return rf"""
WITH RECURSIVE n AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[\p{{L}}\p{{N}}]+|[^ \t\n\x0B\f\r\p{{L}}\p{{N}}]')) AS a
  FROM {source}
), p AS (
  SELECT doc_id, CAST(piece AS INT) AS piece, least(a - piece * {MAX_TOKENS}, {MAX_TOKENS}) AS n_tokens
  FROM n, LATERAL (SELECT unnest(range(0, greatest((a + {MAX_TOKENS - 1}) // {MAX_TOKENS}, 1))) AS piece) u
), q AS (
  SELECT *, greatest((n_tokens + {GRANULE - 1}) // {GRANULE}, 1) AS cell FROM p
), h AS (SELECT cell, count(*) AS n, CAST(sum(n_tokens) AS BIGINT) AS t FROM q GROUP BY cell),
ix AS (
  SELECT row_number() OVER (ORDER BY cell) AS j, cell, CAST(sum(n) OVER (ORDER BY cell) AS BIGINT) AS c,
         CAST(sum(t) OVER (ORDER BY cell) AS BIGINT) AS s FROM h
), {', '.join(levels)}, d AS ({every}),
path AS (
  SELECT k, j, i FROM d WHERE j = (SELECT max(j) FROM ix) AND k = (SELECT least({BUCKETS}, max(j)) FROM ix)
  UNION ALL
  SELECT d.k, d.j, d.i FROM d JOIN path ON d.k = path.k - 1 AND d.j = path.i
), bounds AS (SELECT path.k - 1 AS bucket, ix.cell AS bound, coalesce(lag(ix.cell) OVER (ORDER BY path.k), 0) AS low
              FROM path JOIN ix USING (j)),
r AS (
  SELECT q.*, CAST(bucket AS INT) AS bucket, bound * {GRANULE} AS bucket_tokens,
         row_number() OVER (PARTITION BY bucket ORDER BY doc_id NULLS FIRST, piece, n_tokens) - 1 AS pos
  FROM q JOIN bounds ON cell > low AND cell <= bound
)
SELECT doc_id, piece, CAST(piece AS BIGINT) * {MAX_TOKENS} AS first_token, n_tokens, bucket, bucket_tokens,
       pos // greatest({BATCH_TOKENS} // bucket_tokens, 1) AS batch,
       pos % greatest({BATCH_TOKENS} // bucket_tokens, 1) AS slot
FROM r
"""

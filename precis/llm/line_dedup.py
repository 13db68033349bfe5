"""Line dedup with keep bitmaps, DataFrame functions only.

A line's key is the line without white space (space, \\t..\\r) at its ends and
with A-Z lower-cased.  A key of at least ``min_chars`` code points that occurs
in at least ``min_docs`` documents loses all its lines, except those of the
document with the largest id that holds it.

How it runs: each document yields its distinct keys once, as 128 bits of hash;
the keys are summed by (hash, salt) with partial sums on the map side, so a
line that a third of the corpus holds becomes a few rows per salt; those sums
are range-partitioned by hash, sorted by (hash, document descending) and
streamed, which gives each key's first occurrence in that order (the keeper)
and its document count.  Only lines of keys that reach ``min_docs`` go back to
their documents, as positions; a document's positions become a run-length
coded keep bitmap.  The text itself is read again only by :func:`apply_keep`.

Defined results: null or empty text is one empty line; a null id is smaller
than every id; each row counts as one document (repeated rows of the largest
id all keep their lines); other columns are carried, whatever their names: the
added ones give way (see :func:`apply_keep`).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from precis.llm.common import free_name, key128

#: The white space that is stripped, and the letters lower-cased.
BLANKS = " \t\n\x0b\x0c\r"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SALTS = 32


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANKS)), UPPER, LOWER)


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


def keep_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                 min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """One row per (id, text) that loses lines: ``_id, _th`` (hash of the
    text), ``dropped`` (sorted positions from 0) and ``keep_runs`` (run lengths
    of the keep bitmap up to the last dropped line, first run kept)."""
    base = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_t"))
    keys = F.array_distinct(F.filter(F.transform(_lines(F.col("_t")), line_key),
                                     lambda k: F.length(k) >= min_chars))
    h1, h2 = key128(F.col("k"))
    seen = base.select("_id", F.explode(keys).alias("k")).select("_id", h1.alias("h1"), h2.alias("h2"))
    sums = (seen.groupBy("h1", "h2", F.pmod(F.xxhash64("_id"), F.lit(SALTS)).alias("salt"))
            .agg(F.count(F.lit(1)).alias("n"), F.max("_id").alias("top")))
    by_key = W.partitionBy("h1", "h2")
    streamed = (sums.repartitionByRange("h1", "h2")
                .withColumn("rank", F.row_number().over(by_key.orderBy(F.col("top").desc_nulls_last())))
                .withColumn("docs", F.sum("n").over(by_key)))
    repeated = (streamed.where((F.col("rank") == 1) & (F.col("docs") >= min_docs))
                .select("h1", "h2", "top"))
    placed = (base.select("_id", F.xxhash64("_t").alias("_th"), F.posexplode(_lines(F.col("_t"))).alias("pos", "line"))
              .withColumn("k", line_key(F.col("line")))
              .where(F.length("k") >= min_chars)
              .select("_id", "_th", "pos", h1.alias("h1"), h2.alias("h2")))
    lost = (placed.join(repeated, ["h1", "h2"])
            .where(~F.col("_id").eqNullSafe(F.col("top")))
            .groupBy("_id", "_th").agg(F.sort_array(F.collect_set("pos")).alias("dropped")))
    return lost.withColumn("keep_runs", _runs(F.col("dropped")))


def _runs(dropped: Column) -> Column:
    """Run lengths keep, drop, keep, drop, ... of the sorted positions."""
    starts, ends = _starts(dropped), _ends(dropped)
    before = F.concat(F.array(F.lit(-1)), F.slice(ends, F.lit(1), F.greatest(F.size(ends) - 1, F.lit(0))))
    return F.flatten(F.zip_with(F.zip_with(starts, before, lambda s, e: F.struct(s.alias("s"), (s - e - 1).alias("gap"))),
                                ends, lambda a, e: F.array(a["gap"], e - a["s"] + 1)))


def _starts(dropped: Column) -> Column:
    return F.filter(dropped, lambda p, i: (i == 0) | (F.get(dropped, i - 1) != p - 1))


def _ends(dropped: Column) -> Column:
    return F.filter(dropped, lambda p, i: (i == F.size(dropped) - 1) | (F.get(dropped, i + 1) != p + 1))


def kept_lines(lines: Column, dropped: Column) -> Column:
    """The lines between the dropped positions, in one linear pass."""
    n = F.size(dropped)
    lo = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(dropped, i - 1) + 1)
    hi = lambda i: F.when(i == n, F.size(lines)).otherwise(F.get(dropped, i))
    return F.flatten(F.transform(F.sequence(F.lit(0), n), lambda i: F.slice(lines, lo(i) + 1, hi(i) - lo(i))))


#: what :func:`apply_keep` adds
ADDED = ("_n_lines", "_n_dropped", "_kept", "_keep_runs")


def apply_keep(docs: DataFrame, bitmaps: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``_n_lines, _n_dropped, _kept`` (the text that stays) and
    ``_keep_runs``, by other names (``common.free_name``) where these are taken."""
    names = {c: free_name(c, docs.columns) for c in ADDED}
    th, rid, rth, rdropped, rruns = (free_name(f"__ld_{c}", docs.columns) for c in ("text_hash", "id", "hash", "dropped", "runs"))
    left = docs.withColumn(th, F.xxhash64(text_col))
    right = bitmaps.select(F.col("_id").alias(rid), F.col("_th").alias(rth),
                           F.col("dropped").alias(rdropped), F.col("keep_runs").alias(rruns))
    joined = left.join(right, left[id_col].eqNullSafe(right[rid]) & (left[th] == right[rth]), "left")
    lines, dropped = _lines(F.col(text_col)), F.col(rdropped)
    text = F.coalesce(F.col(text_col), F.lit(""))
    return joined.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        F.size(lines).cast("long").alias(names["_n_lines"]),
        F.when(dropped.isNull(), 0).otherwise(F.size(dropped)).cast("long").alias(names["_n_dropped"]),
        F.when(dropped.isNull(), text).otherwise(F.array_join(kept_lines(lines, dropped), "\n")).alias(names["_kept"]),
        F.col(rruns).alias(names["_keep_runs"]))


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               min_chars: int = 20, min_docs: int = 3) -> DataFrame:
    """``docs`` with the columns of :func:`apply_keep`."""
    return apply_keep(docs, keep_bitmaps(docs, id_col, text_col, min_chars, min_docs), id_col, text_col)


def line_dedup_digest(docs: DataFrame) -> DataFrame:
    out = line_dedup(docs.select("doc_id", "text"))
    return out.select("doc_id", F.col("_n_lines").alias("n_lines"), F.col("_n_dropped").alias("n_dropped"),
                      F.sha2("_kept", 256).alias("kept_sha256"))


ORACLE = r"""
WITH l AS (
  SELECT r, doc_id, u.pos, u.line,
         translate(trim(u.line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents) d,
       LATERAL (SELECT unnest(a) AS line, generate_subscripts(a, 1) AS pos) u
), bad AS (
  SELECT k, max(doc_id) AS top FROM l WHERE length(k) >= 20
  GROUP BY k HAVING count(DISTINCT r) >= 3
), m AS (
  SELECT l.*, bad.k IS NOT NULL AND l.doc_id IS DISTINCT FROM bad.top AS lost FROM l LEFT JOIN bad USING (k)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE lost) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '')) AS kept_sha256
FROM m GROUP BY r
"""

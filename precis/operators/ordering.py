"""Row order without a single-task window (L1, L4, L6 helpers).

The reference relies on table order (first N rows, batches of consecutive
rows).  ``row_number()`` without ``PARTITION BY`` would move every row to one
task, so positions are computed in a distributed way instead: a sample of the
keys gives cuts, the cuts divide the rows into ranges of about equal size, rows
are numbered inside their range, and a row's position is its number plus the
row counts of the ranges before its own, a table of one row per range.  Only the
sample is taken when the plan is built; the counts read the key columns alone,
and no row is written.

The key, of any type and any number of columns, must be unique; rows that
repeat a key get consecutive positions in no particular order.  Nulls come
first.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from ..session import materialize, shuffle_partitions

#: ``monotonically_increasing_id`` holds the partition above this many bits
_ROW_BITS = 33
#: ranges of a numbering per shuffle partition, at most so many, and sampled rows per range
RANGES, MOST_RANGES, SAMPLE = 4, 4096, 16
#: rows that the selection of L1 sorts at once, and ranges that it counts at once
RANGE_ROWS, SPLITS = 100_000, 64


def cut_keys(keys: DataFrame, n: int) -> list[Row]:
    """At most ``n`` distinct keys, in order, that cut the rows into ranges of
    about equal size: the quantiles of a random sample of ``SAMPLE * n`` rows."""
    sample = keys.orderBy(F.rand(7)).limit(SAMPLE * n).sortWithinPartitions(*keys.columns).collect()
    step = max(len(sample) // (n + 1), 1)
    picked = sample[step::step][:n]
    return [r for k, r in enumerate(picked) if k == 0 or r != picked[k - 1]]


def range_of(df: DataFrame, cols: Sequence[str], cuts: list[Row]) -> Column:
    """How many of the sorted ``cuts`` are at or before the key, by binary
    search in a constant array."""
    if not cuts:
        return F.lit(0)
    kinds = {f.name: f.dataType for f in df.select(*cols).schema.fields}
    key = F.struct(*[F.col(c).alias(f"k{j}") for j, c in enumerate(cols)])
    at = F.array(*[F.struct(*[F.lit(r[j]).cast(kinds[c]).alias(f"k{j}") for j, c in enumerate(cols)]) for r in cuts])

    def halve(span: Column, _) -> Column:
        low, high = span["low"], span["high"]
        middle = F.floor((low + high) / 2).cast("int")
        before = F.element_at(at, F.least(middle, F.lit(len(cuts) - 1)) + 1) <= key
        return F.struct(F.when((low < high) & before, middle + 1).otherwise(low).alias("low"),
                        F.when((low < high) & ~before, middle).otherwise(high).alias("high"))

    start = F.struct(F.lit(0).alias("low"), F.lit(len(cuts)).alias("high"))
    # never null, and said to be so: a join by it would else test that before any
    # aggregation the key comes from, which is once for each row of a group
    return F.coalesce(F.aggregate(F.sequence(F.lit(1), F.lit(len(cuts).bit_length() + 1)), start, halve, lambda s: s["low"]), F.lit(0))


def with_positions(df: DataFrame, order_cols: Sequence[str], pos_col: str = "pos",
                   group_cols: Sequence[str] = (), keys: DataFrame | None = None) -> DataFrame:
    """Add a 0-based ``pos_col``: the rank of each row by ``order_cols``
    inside ``group_cols``.  The positions of a group are the global ones,
    ordered by group first, less the group's smallest.  ``keys`` may name a
    table of the same keys that is cheaper to sample than ``df``."""
    cols = [*group_cols, *order_cols]
    n = min(RANGES * shuffle_partitions(df.sparkSession), MOST_RANGES)
    cuts = cut_keys((df if keys is None else keys).select(*cols), n)
    ranged = df.withColumn("_range", range_of(df, cols, cuts))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # a row per range
    offsets = ranged.groupBy("_range").agg(F.count(F.lit(1)).alias("_n")).select(
        "_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    inside = F.row_number().over(Window.partitionBy("_range").orderBy(*cols))
    out = (ranged.withColumn("_row", inside).join(F.broadcast(offsets), "_range")  # at most MOST_RANGES rows
           .withColumn(pos_col, (F.col("_off") + F.col("_row") - 1).cast("long")).drop("_range", "_row", "_off"))
    if not group_cols:
        return out
    first = out.groupBy(*[F.col(c).alias(f"_g_{c}") for c in group_cols]).agg(F.min(pos_col).alias("_first"))
    same = reduce(lambda a, b: a & b, [out[c].eqNullSafe(first[f"_g_{c}"]) for c in group_cols])
    return (out.join(first, same).withColumn(pos_col, F.col(pos_col) - F.col("_first"))
            .drop("_first", *[f"_g_{c}" for c in group_cols]))


def _after(cols: Sequence[str], row) -> Column:
    """The key is greater than that of ``row`` (null first, as in a sort)."""
    out, same = F.lit(False), F.lit(True)
    for c in cols:
        v = row[c]
        greater = F.col(c).isNotNull() if v is None else F.coalesce(F.col(c) > F.lit(v), F.lit(False))
        out, same = out | (same & greater), same & F.col(c).eqNullSafe(F.lit(v))
    return out


def _same(cols: Sequence[str], row) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.lit(row[c])) for c in cols])


def nth_key(keys: DataFrame, n: int, range_rows: int = RANGE_ROWS, splits: int = SPLITS):
    """``(row, less, equal)``: the ``n``-th row (from 1) of ``keys`` in the order
    of its columns, null first, and how many rows are less than and equal to
    it; None if there are not so many.

    Distributed selection: a sample gives ``splits`` keys that cut the rows into
    ranges, each key a range of its own; their rows are counted by one partial
    aggregate, and only the range that holds the ``n``-th row is looked at
    further, until at most ``range_rows`` rows are sorted.  So no task gets more
    than one such range, whatever ``n``, and a key that very many rows repeat
    ends the search at once."""
    cols = keys.columns
    left, before, size = keys, 0, keys.count()
    if size < n:
        return None
    while size > range_rows:
        picked = {tuple(r): r for r in left.sample(min(1.0, 32 * splits / size), 7).collect()}  # about 32 * splits rows
        if not picked:
            continue
        order = left.sparkSession.createDataFrame(list(picked.values()), left.schema).orderBy(*cols).collect()
        cuts = order[::max(len(order) // splits, 1)]
        behind = reduce(lambda a, b: a + b, [_after(cols, c).cast("int") for c in cuts])
        on = reduce(lambda a, b: a | b, [_same(cols, c) for c in cuts])
        counts = {(r["i"], r["on"]): r["count"] for r in
                  left.groupBy(behind.alias("i"), on.alias("on")).count().collect()}  # two rows a cut at most
        for i in range(len(cuts) + 1):
            inside = counts.get((i, False), 0)
            if before + inside >= n:
                if i > 0:
                    left = left.where(_after(cols, cuts[i - 1]))
                if i < len(cuts):
                    left = left.where(~_after(cols, cuts[i]) & ~_same(cols, cuts[i]))
                size = inside
                break
            before += inside
            equal = counts.get((i, True), 0)
            if before + equal >= n:
                return cuts[i], before, equal
            before += equal
    last = left.orderBy(*cols).limit(n - before).agg(F.max(F.struct(*cols)).alias("row")).first()["row"]
    less, equal = left.agg(F.sum((~_after(cols, last) & ~_same(cols, last)).cast("long")),
                           F.sum(_same(cols, last).cast("long"))).first()
    return last, before + less, equal


def first_n(df: DataFrame, n: int | None, order_cols: Sequence[str] = ("pair_id",)) -> DataFrame:
    """L1: exactly ``min(n, rows)`` rows, the first in key order (null first);
    ``None`` keeps all.  One way for every ``n``: the n-th key is found on the
    key columns alone and becomes a filter, so the rows stay in their
    partitions and the filter can reach the scan.  Where rows repeat that key
    and not all of them fit, they are written once, numbered in their
    partitions, and as many as fit are kept, in no particular order."""
    if n is None:
        return df
    if n <= 0:
        return df.limit(0)
    cols = list(order_cols)
    found = nth_key(df.select(*cols), n)
    if found is None:
        return df
    row, less, equal = found
    up_to = ~_after(cols, row)
    if less + equal == n:
        return df.where(up_to)
    ties = materialize(df.where(_same(cols, row)).withColumn("_mid", F.monotonically_increasing_id()), "ties")
    room, cut = n - less, 0
    for r in ties.groupBy(F.shiftright("_mid", _ROW_BITS).alias("part")).count().orderBy("part").collect():  # a row a partition
        cut = (r["part"] << _ROW_BITS) + min(room, r["count"])
        room -= r["count"]
        if room <= 0:
            break
    return df.where(up_to & ~_same(cols, row)).unionByName(ties.where(F.col("_mid") < cut).drop("_mid"))


def seeded_shuffle_key(seed: int, epoch: int, key: str = "pair_id") -> Column:
    """L4: a reproducible random order: digest of (seed, epoch, key)."""
    return F.md5(F.concat_ws(",", F.lit(str(seed)), F.lit(str(epoch)), F.col(key).cast("string")))


def batch_rows(df: DataFrame, batch_size: int, order_cols: Sequence[str] = ("pair_id",),
               keys: DataFrame | None = None) -> DataFrame:
    """Consecutive rows into batches of ``batch_size``; the last batch may
    be short, no row is dropped.  Adds ``pos``, ``batch_id``, ``pos_in_batch``.
    ``keys`` as in :func:`with_positions`."""
    if batch_size < 1:
        raise ValueError("batch_size must be >= 1")
    with_pos = with_positions(df, order_cols, "pos", keys=keys)
    return with_pos.withColumn("batch_id", F.floor(F.col("pos") / batch_size).cast("long")) \
                   .withColumn("pos_in_batch", (F.col("pos") % batch_size).cast("int"))


def shuffled_batches(df: DataFrame, batch_size: int, seed: int, epoch: int,
                     key: str = "pair_id") -> DataFrame:
    """L4 + L6: seeded random order, then batches (training side)."""
    keyed = df.withColumn("_shuffle", seeded_shuffle_key(seed, epoch, key))
    return batch_rows(keyed, batch_size, ("_shuffle", key)).drop("_shuffle")

"""Byte-level BPE: A3 pair_counts, A4 bpe_train, A5 build_vocab, S7 tables.

Training works on the table of *distinct* pre-tokens with their counts (A2
did the heavy reduction: a corpus of any size becomes one row per distinct
pre-token), held as blocks of words (``bpe_blocks``).

The driver knows the most frequent pairs, at most ``known_pairs`` of them, and
the bar below which it knows none.  That is enough: a merge only takes
occurrences from pairs that exist, and the pairs it creates are reported with
its pass.  When the best known pair falls below the bar, all pairs are counted
anew.  A merge onto a string that the vocabulary already has can raise a pair
below the bar, so it is followed by a count as well.

A round takes the best pairs, up to ``top_k``, and, for those, the counts of the triples
they take part in.  Going down the list it accepts every merge that the
one-by-one algorithm would provably pick next:

* merging (a, b) uses up only pairs (b, y) and (x, a); any other pair keeps its
  count, whatever symbols it shares;
* a pair that is used up is passed over, not a reason to stop: of its
  occurrences at least those in a triple with an accepted pair go, so the rest
  is a bound of its new count;
* a pair that a merge creates occurs at most as often as its triple;
* a merge is accepted while its count is strictly above all those bounds.

One pass over the blocks then merges the accepted pairs, touching only the words
that hold one, and returns the changes of the known pairs, the new pairs, and
the triples of the pairs that can be on the next list.  The blocks are written
to the shared folder every ``rewrite_every`` rounds (in between they are cached)
and the table they replace is deleted.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass, field

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SORTED_ALPHABET, SPECIAL_TOKENS, byte_symbol_array
from ..session import materialize, shared_path, shuffle_partitions
from .bpe_blocks import BLOCK, MAX_SYMBOLS, Step, all_pairs, blocks, pack, run_step, outcome
from .corpus import pretoken_counts

N_SPECIAL = len(SPECIAL_TOKENS)
FIRST_MERGE_ID = N_SPECIAL + len(SORTED_ALPHABET)  # 261


def symbol_ids(pretoken: Column) -> Column:
    """Base ids of a pre-token: 5 + rank of each byte symbol in the sorted
    alphabet."""
    return F.transform(byte_symbol_array(pretoken),
                       lambda c: (F.instr(F.lit(SORTED_ALPHABET), c) + F.lit(N_SPECIAL - 1)).cast("int"))


def word_table(counts: DataFrame, pretoken: str = "pretoken", n: str = "n") -> DataFrame:
    """Distinct pre-tokens as (pretoken, n, syms), ``syms`` being the symbol
    ids as text, each in brackets."""
    ids = F.transform(symbol_ids(F.col(pretoken)), lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(">")))
    return counts.select(pretoken, F.col(n).cast("long").alias("n"), F.array_join(ids, "").alias("syms"))


def has_pair(syms: Column) -> Column:
    """At least two symbols."""
    return syms.contains("><")


def _ids(syms: Column) -> Column:
    """The symbol ids as an array."""
    plain = F.btrim(F.replace(syms, F.lit("><"), F.lit(" ")), F.lit("<>"))
    return F.split(plain, " ").cast("array<int>")


def _runs(words: DataFrame, k: int) -> DataFrame:
    """``words`` (with ``n`` and ``syms``) as a row per run of ``k`` adjacent
    symbols, overlapping ones included: ``n, s1 .. sk``."""
    with_ids = words.select("n", _ids(F.col("syms")).alias("ids")).where(F.size("ids") >= k)
    shifted = [F.slice("ids", j, F.size("ids") - (k - 1)).alias(f"s{j}") for j in range(1, k + 1)]
    return with_ids.select("n", F.inline(F.arrays_zip(*shifted)))


def pair_rows(words: DataFrame) -> DataFrame:
    """A row ``l, r, c`` for each pair of adjacent symbols of each word, with
    the word's count; overlapping pairs all count (``aaa`` has two ``aa``)."""
    return _runs(words.where(has_pair(F.col("syms"))), 2).select(
        F.col("s1").alias("l"), F.col("s2").alias("r"), F.col("n").alias("c"))


def pair_counts(words: DataFrame) -> DataFrame:
    """A3: count of each adjacent symbol pair, weighted by the word count.  The
    words are written first: the symbols derive from the key that the words were
    grouped by, so the optimizer would push the test for a pair below that
    aggregation, to every occurrence of a word."""
    spark = words.sparkSession
    words = materialize(words.select("n", "syms").repartition(shuffle_partitions(spark)), "words")
    return pair_rows(words).groupBy("l", "r").agg(F.sum("c").alias("c"))


@dataclass
class BpeModel:
    """Vocabulary (id -> token, byte-level strings) and ranked merges."""
    tokens: list[str]
    merges: list[tuple[int, int, int]] = field(default_factory=list)  # (left, right, new_id)
    rounds: int = 0

    def vocab_frame(self, spark: SparkSession) -> DataFrame:
        """A5: ids 0..4 specials, 5..260 byte alphabet by code point, then
        merges in rank order."""
        return spark.createDataFrame(list(enumerate(self.tokens)), "id int, token string")

    def merges_frame(self, spark: SparkSession) -> DataFrame:
        rows = [(i, l, r, n, self.tokens[l], self.tokens[r]) for i, (l, r, n) in enumerate(self.merges)]
        return spark.createDataFrame(
            rows, "rank int, left_id int, right_id int, new_id int, left string, right string")


def base_tokens() -> list[str]:
    return list(SPECIAL_TOKENS) + list(SORTED_ALPHABET)


class _Written:
    """A table in the shared folder that takes the place of an earlier one."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.name, self.path = spark, name, None

    def put(self, df: DataFrame) -> DataFrame:
        path = shared_path(self.spark, self.name)
        df.write.parquet(path)
        if self.path:
            p = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.path)
            p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
        self.path = path
        return self.spark.read.schema(df.schema).parquet(path)


@dataclass
class _Known:
    """The most frequent pairs and their counts; a pair is known if it comes
    before the bar ``(count, pair)`` or at it, more frequent and smaller first."""
    counts: dict[int, int]
    bar: tuple[int, int]

    def above(self, pair: int, c: int) -> bool:
        return c > self.bar[0] or (c == self.bar[0] and pair <= self.bar[1])

    def top(self, k: int) -> list[tuple[int, int]]:
        """The ``k`` best as (count, pair)."""
        best = heapq.nsmallest(k, ((-c, p) for p, c in self.counts.items()))
        return [(-c, p) for c, p in best]

    def change(self, changes: dict[int, int], most: int) -> None:
        for pair, c in changes.items():
            c += self.counts.pop(pair, 0)
            if c > 0 and self.above(pair, c):
                self.counts[pair] = c
        if len(self.counts) > 2 * most:
            kept = self.top(most)
            self.counts, self.bar = {p: c for c, p in kept}, kept[-1]


def known_pairs_of(state: DataFrame, most: int) -> _Known:
    """At most about ``most`` of the best pairs: those above the smallest power
    of two that few enough reach."""
    all_ = all_pairs(state).persist(StorageLevel.MEMORY_AND_DISK)
    sizes = all_.groupBy(F.floor(F.log2("c")).cast("int").alias("e")).count().collect()  # a row per power of two
    bar, n = None, 0
    for r in sorted(sizes, key=lambda r: -r["e"]):
        n += r["count"]
        if n > most:
            break
        bar = (1 << r["e"], MAX_SYMBOLS * MAX_SYMBOLS)
    else:
        bar = (0, 0)
    if bar:
        rows = all_.where(F.col("c") >= bar[0]).collect()
    else:  # too many pairs in the highest power of two
        rows = all_.orderBy(F.col("c").desc(), "k").limit(most).collect()
        bar = (rows[-1]["c"], rows[-1]["k"])
    all_.unpersist()
    return _Known({r["k"]: r["c"] for r in rows}, bar)


def accept(top: list[tuple[int, int]], most: dict, both: dict, watched) -> list[int]:
    """The pairs of ``top`` that one-by-one training would merge next, in
    order (see the module's notes).  ``most`` and ``both`` hold the triples of
    the pairs that ``watched`` accepts; behind any other pair the list ends.
    ``both`` may hold the larger of two triples that join the same two pairs in
    either order, so it counts only where one order is possible."""
    taken: list[tuple[int, int]] = []
    ceiling = -1
    for c, pair in top:
        if c <= ceiling:
            break
        l, r = divmod(pair, MAX_SYMBOLS)
        uses = [(a, b) for a, b in taken if l == b or r == a]
        if uses:
            gone = max(_used_up((l, r), u, both) for u in uses)
            ceiling = max(ceiling, c - gone)
            continue
        taken.append((l, r))
        ceiling = max(ceiling, most.get(pair, 0) if watched(pair) else c)
    return [pack(l, r) for l, r in taken]


def _used_up(pair: tuple[int, int], merged: tuple[int, int], both: dict) -> int:
    """At least so many occurrences of ``pair`` go when ``merged`` merges."""
    (l, r), (a, b) = pair, merged
    if a == b or l == r or (l == b and r == a):
        return 0
    return both.get((pack(l, r), pack(a, b)), 0)


def train_bpe(corpus: DataFrame, vocab_size: int = 30000, value: str = "value", top_k: int = 1024,
              rewrite_every: int = 10, batched: bool = True, known_pairs: int = 50_000) -> BpeModel:
    """A4: learn merges until the vocabulary has ``vocab_size`` entries or
    no pair is left.  Ties go to the smallest (left id, right id).  A merge
    whose string already exists reuses that id.  ``batched=False`` accepts
    one merge per round (the plain loop, for tests).  The list of a round is
    four times as long as what the last one accepted, ``top_k`` at most."""
    spark = corpus.sparkSession
    if vocab_size > MAX_SYMBOLS:
        raise ValueError(f"vocab_size must be at most {MAX_SYMBOLS}")
    file = _Written(spark, "words")
    words = pretoken_counts(corpus, value).select(F.col("n").cast("long").alias("n"), "pretoken")
    # no filter before this table is written: one on the grouping key goes
    # below the aggregation
    state = file.put(blocks(words.repartition(shuffle_partitions(spark))))
    known = known_pairs_of(state, known_pairs)
    tokens = base_tokens()
    index = {t: i for i, t in enumerate(tokens)}
    merges: list[tuple[int, int, int]] = []
    held: DataFrame | None = None  # cached frame under ``state`` between rewrites
    most: dict = {}
    both: dict = {}
    listed: set[int] = set()
    fresh: set[int] = set()
    rounds, length = 0, 64
    while len(index) < vocab_size:
        top = known.top(length if batched else 1)
        if not top:
            if known.bar == (0, 0):
                break
            known = known_pairs_of(state, known_pairs)
            if not known.counts:
                break
            continue
        chosen = accept(top, most, both, lambda p: p in listed or not fresh.isdisjoint(divmod(p, MAX_SYMBOLS)))
        accepted: list[tuple[int, int, int]] = []
        reused = False
        for pair in chosen if batched else [top[0][1]]:
            l, r = divmod(pair, MAX_SYMBOLS)
            token = tokens[l] + tokens[r]
            if len(index) >= vocab_size or (token in index and accepted):
                break  # a merge onto an existing id goes alone in its round
            reused = token in index
            if not reused:
                index[token] = len(tokens)
                tokens.append(token)
            accepted.append((l, r, index[token]))
            if reused:
                break
        merges.extend(accepted)
        rounds += 1
        done = {pack(l, r) for l, r, _ in accepted}
        length = min(max(4 * len(accepted), 64), top_k)
        listed = {p for _, p in known.top(length + len(done)) if p not in done} if batched else set()
        fresh = {n for _, _, n in accepted}
        by_pair = sorted((pack(l, r), n) for l, r, n in accepted)
        step = Step(np.array([p for p, _ in by_pair], np.int64), np.array([n for _, n in by_pair], np.int32),
                    np.array(sorted(known.counts), np.int64), np.array(sorted(listed), np.int64), len(tokens))
        after = run_step(state, step).persist(StorageLevel.MEMORY_AND_DISK)
        changes, most, both = {}, {}, {}
        told = outcome(after, 1 if reused else max(known.bar[0], 1)).toArrow()  # known and new pairs, and the list's triples
        for pair, other, c in zip(*(told.column(k).to_pylist() for k in range(3))):
            if other == -1:
                changes[pair] = c
            else:
                most[pair] = max(most.get(pair, 0), c)
                if other >= 0:
                    both[pair, other] = c
        raised = reused and any(c > 0 and p not in known.counts for p, c in changes.items())
        known.change(changes, known_pairs)
        state = after.where(F.col("kind") == BLOCK)
        if held is not None:
            held.unpersist()
        held = after
        if rounds % rewrite_every == 0:
            state = file.put(state)  # cuts the lineage
            after.unpersist()
            held = None
        if raised:
            known = known_pairs_of(state, known_pairs)
    if held is not None:
        held.unpersist()
    return BpeModel(tokens, merges, rounds)


def write_tokenizer(model: BpeModel, spark: SparkSession, path: str) -> None:
    """Vocabulary and merges as two Parquet tables under ``path``."""
    model.vocab_frame(spark).write.mode("overwrite").parquet(f"{path}/vocab")
    model.merges_frame(spark).write.mode("overwrite").parquet(f"{path}/merges")


def read_tokenizer(spark: SparkSession, path: str) -> BpeModel:
    """Inverse of S7 (the tables are bounded by the vocabulary size)."""
    vocab = spark.read.parquet(f"{path}/vocab").orderBy("id").collect()
    merges = spark.read.parquet(f"{path}/merges").orderBy("rank").collect()
    return BpeModel([r["token"] for r in vocab],
                    [(r["left_id"], r["right_id"], r["new_id"]) for r in merges])


def require_specials(model: BpeModel, needed=SPECIAL_TOKENS) -> dict[str, int]:
    """Ids of the special tokens; a missing one -> ValueError naming it."""
    index = {t: i for i, t in enumerate(model.tokens)}
    missing = [t for t in needed if t not in index]
    if missing:
        raise ValueError(f"the vocabulary lacks special tokens: {', '.join(missing)}")
    return {t: index[t] for t in needed}

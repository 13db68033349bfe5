"""Batch generation: G6 greedy_plain, G7 batch_summarize, X19 error_fallback.

Generation is up to 150 dependent steps, so it is no DataFrame loop: an Arrow
UDF decodes the rows of a slice of a batch together.  Each step scores a matrix
(rows still open x vocabulary), applies the rules G1-G5 to all its rows as
masks, takes one token per row, and closes the rows that are done.  A row keeps
a hash of the bigrams it has seen, so the repeat rule costs one look-up.

The JVM splits special literals and pre-tokenizes (X1) before, and decodes the
ids (X10) after; the other columns of the table stay where they are.  The scorer
is a file in the shared folder that each worker opens once; the driver never
holds it.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.arrays import EOS, SOS
from ..functions.text import is_blank
from ..session import shared_path
from ..sources.shared import read_columns
from .bpe import BpeModel
from .decoding import BLOCKED, MIN_PREFIX, PENALTY, RECENT_WINDOW, TRIGRAM_MIN_PREFIX
from .encode import _Encoder, decode_ids, pretokens_with_specials

ERROR_TEXT = "Error during generation"  # fixed value: the text of a failed row
SOURCE_BONUS = 1.0
ALPHA = 0.1
#: cells of the score matrix of the rows that are decoded together (a few such matrices are held at a time)
CELLS = 1 << 19


class Scorer:
    """logit(t | prefix, src) = ln((n(prev, t) + a) / (total(prev) + a V))
    + bonus * [t in src], prev = last token of the prefix."""

    def __init__(self, prev: np.ndarray, nxt: np.ndarray, n: np.ndarray, vocab_size: int,
                 alpha: float = ALPHA, bonus: float = SOURCE_BONUS):
        self.size, self.alpha, self.bonus = vocab_size, alpha, bonus
        order = np.argsort(prev, kind="stable")
        self.next, self.n = nxt[order], n[order].astype(float)
        self.first = np.searchsorted(prev[order], np.arange(vocab_size + 1))
        self.total = np.bincount(prev, n, vocab_size)

    def source_bonus(self, sources: list[list[int]]) -> np.ndarray:
        out = np.zeros((len(sources), self.size))
        for row, ids in zip(out, sources):
            row[ids] = self.bonus
        return out

    def logits(self, last: np.ndarray, bonus: np.ndarray) -> np.ndarray:
        scale = self.total[last] + self.alpha * self.size
        many = self.first[last + 1] - self.first[last]
        row = np.repeat(np.arange(len(last)), many)
        known = np.repeat(self.first[last] - np.cumsum(many) + many, many) + np.arange(many.sum())
        out = np.repeat(np.log(self.alpha / scale)[:, None], self.size, axis=1)
        out[row, self.next[known]] = np.log((self.n[known] + self.alpha) / scale[row])
        out += bonus
        return out


class Seen:
    """What followed each bigram of a growing prefix."""

    def __init__(self, prefix=()):
        self.after = defaultdict(set)
        for a, b, c in zip(prefix, prefix[1:], prefix[2:]):
            self.after[int(a), int(b)].add(int(c))

    def add(self, a: int, b: int, c: int) -> None:
        self.after[a, b].add(c)

    def banned(self, a: int, b: int) -> list[int]:
        return list(self.after.get((a, b), ()))


def choose(logits: np.ndarray, prefix: np.ndarray, seen: list[Seen]) -> np.ndarray:
    """G1-G5 on a matrix of logits (changed in place), a row for each prefix;
    the prefixes are equally long.  Ties go to the lowest id."""
    rows, length = np.arange(len(prefix)), prefix.shape[1]
    logits[:, list(BLOCKED)] = -np.inf
    recent = np.zeros(logits.shape, bool)
    recent[rows[:, None], prefix[:, -RECENT_WINDOW:]] = True
    held = logits[recent]
    logits[recent] = np.where(held > 0, held / PENALTY, held * PENALTY)
    if length < MIN_PREFIX:
        logits[:, EOS] = -np.inf
    if length >= TRIGRAM_MIN_PREFIX:
        for k in rows:
            logits[k, seen[k].banned(int(prefix[k, -2]), int(prefix[k, -1]))] = -np.inf
    best = logits.argmax(axis=1)
    if length > 2:
        for k in np.flatnonzero((best == prefix[:, -1]) & (best == prefix[:, -2])):
            others = np.delete(logits[k], best[k])
            at = int(others.argmax())
            best[k] = at + (at >= best[k])
    return best


def decode(sources: list[list[int]], scorer: Scorer, max_len: int, rules: bool = True) -> list[list[int]]:
    """G7 (rules on: eos is kept) or G6 (rules off: eos is dropped) for all
    sources together; every result starts with sos."""
    done: list[list[int]] = [[] for _ in sources]
    live, bonus = np.arange(len(sources)), scorer.source_bonus(sources)
    prefix, seen = np.full((len(sources), 1), SOS), [Seen() for _ in sources]
    for _ in range(max_len):
        logits = scorer.logits(prefix[:, -1], bonus)
        token = choose(logits, prefix, seen) if rules else logits.argmax(axis=1)
        ends = token == EOS
        grown = np.concatenate([prefix, token[:, None]], axis=1)
        for k in np.flatnonzero(ends):
            done[live[k]] = (grown if rules else prefix)[k].tolist()
        stay = np.flatnonzero(~ends)
        live, bonus, prefix, seen = live[stay], bonus[stay], grown[stay], [seen[k] for k in stay]
        if not len(live):
            break
        if rules and prefix.shape[1] > 2:
            for s, (a, b, c) in zip(seen, prefix[:, -3:].tolist()):
                s.add(a, b, c)
    for k, ids in zip(live, prefix.tolist()):
        done[k] = ids
    return done


def decode_or_report(sources: list[list[int]], scorer: Scorer, max_len: int, rules: bool
                     ) -> tuple[list[list[int] | None], list[str | None]]:
    """A batch that fails is decoded row by row, and only the rows at
    fault report their error."""
    try:
        return decode(sources, scorer, max_len, rules), [None] * len(sources)
    except Exception as exc:  # noqa: BLE001 - reported per row
        if len(sources) == 1:
            return [None], [f"{type(exc).__name__}: {exc}"]
        one = [decode_or_report([s], scorer, max_len, rules) for s in sources]
        return [ids[0] for ids, _ in one], [err[0] for _, err in one]


#: The model this worker has opened last, by the path of its scorer.
_OPEN: dict[str, tuple[_Encoder, Scorer]] = {}


def _open(path: str, merges: list, vocab_size: int) -> tuple[_Encoder, Scorer]:
    if path not in _OPEN:
        _OPEN.clear()
        _OPEN[path] = _Encoder(merges), Scorer(*read_columns(path, ["prev", "next", "n"]), vocab_size)
    return _OPEN[path]


def batch_generate(df: DataFrame, model: BpeModel, table: DataFrame, vocab_size: int,
                   text: str = "text", max_length: int = 150, rules: bool = True,
                   min_length: int | None = None, num_beams: int | None = None) -> DataFrame:
    """G7 / G6 over a whole table.  Adds ``gen_ids``, ``summary`` and
    ``error``: blank text -> '' without generation (F6); a text with no
    ids -> ''; a failing row -> the fallback text (X19) while the job goes on.
    ``min_length`` and ``num_beams`` are accepted and ignored, as in the
    original ``summarize``."""
    del min_length, num_beams
    spark = df.sparkSession
    path = shared_path(spark, "scorer")
    table.select(F.col("prev").cast("long"), F.col("next").cast("long"), F.col("n").cast("long")).write.parquet(path)
    merges = spark.sparkContext.broadcast(list(model.merges))  # bounded by the vocabulary
    at_once = max(CELLS // max(vocab_size, 1), 1)

    def part(pieces: pa.Array, blank: pa.Array) -> pa.StructArray:
        encoder, scorer = _open(path, merges.value, vocab_size)
        sources = [[] if b else encoder.encode(p)[:max_length] for p, b in zip(pieces.to_pylist(), blank.to_pylist())]
        ids, errors = [[] for _ in sources], [None] * len(sources)
        work = [k for k, s in enumerate(sources) if s]
        got, failed = decode_or_report([sources[k] for k in work], scorer, max_length, rules) if work else ([], [])
        for k, i, e in zip(work, got, failed):
            ids[k], errors[k] = i, e
        return pa.StructArray.from_arrays([pa.array(ids, pa.list_(pa.int32())), pa.array(errors, pa.string())], ["gen_ids", "error"])

    @F.arrow_udf("gen_ids array<int>, error string")
    def generated(pieces: pa.Array, blank: pa.Array) -> pa.Array:
        # a batch stays in Arrow: only the rows that are decoded together are Python objects
        out = [part(pieces.slice(a, at_once), blank.slice(a, at_once)) for a in range(0, len(pieces), at_once)]
        return pa.concat_arrays(out) if out else part(pieces, blank)

    pieces = F.slice(pretokens_with_specials(text), 1, max_length)
    out = df.withColumn("_gen", generated(pieces, is_blank(F.col(text)))).withColumns(
        {"gen_ids": F.col("_gen.gen_ids"), "error": F.col("_gen.error")}).drop("_gen")
    decoded = decode_ids(F.coalesce(F.col("gen_ids"), F.array().cast("array<int>")), model, strip=rules)
    return out.withColumn("summary", F.when(F.col("error").isNotNull(), F.lit(ERROR_TEXT)).otherwise(decoded))

"""Benchmark decontamination by CGK embedding, bit-sampling LSH and exact edits.

Documents and benchmark items are sequences of lower-cased words.  An item
counts as contained in a document if some passage of it has an edit distance of
at most ``(1 - similarity) * words of the item``.

Embedding: a walk reads a sequence; at step j it writes the word it stands on
and moves on iff a random bit, drawn from (j, word), is 1.  Sequences at a small
edit distance take walks that fall into step again and agree in most places,
so edit distance becomes Hamming distance.

Search: items of one length class share a window length, the largest power of
two up to three quarters of their words.  Every window of that length starts a
walk, at each offset of an item and at each position of a document.  In each
of ``rounds`` repetitions a key samples ``COORDINATES`` places of the walk; the
first two are early and the same for all lengths, so that almost all windows of
a document drop out after a step or two, which is the same as comparing whole
keys.  ``ROUNDS`` and ``COORDINATES`` are set for a recall of 0.99 of passages
with edits of a fifth of their words (measured in the tests).

Verification: each collision fixes an alignment; the item's exact best match in
the passage around it is computed (semi-global edit distance).

Items of fewer than ``MIN_WORDS`` words have no room for an edit: their words
are searched for as they stand.  Many such items are common phrases, so they
count only if they are rare, that is found in at most ``RARE`` of the documents;
the documents that hold each are counted first, in a pass of its own that is
made only if there are such items.

Documents are read once, in Arrow batches, and nothing but those counts is
shuffled.  Items come to the driver and go to the tasks in blocks of at most
``block`` items and ``BLOCK_WORDS`` words (one pass over the documents per
block), so what is broadcast is bounded; an item longer than that is a block.

Defined results: null text is empty and contains nothing; items without a word
are in no document; items that repeat a text are searched once and all reported;
other columns of ``docs`` go through :func:`decontaminate` untouched.
"""

from __future__ import annotations

from collections import defaultdict
from functools import lru_cache
from itertools import islice
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.llm import words as wd
from precis.llm.common import table

SIMILARITY, MIN_WORDS, ROUNDS, COORDINATES, BLOCK = 0.8, 5, 10, 6, 20_000
BLOCK_WORDS, RARE = 400_000, 0.01
HITS = "doc_id long, item_id long, item_words int, distance int"
_FIRST_BITS, _THIRD_BITS = 20, 18


class Probe(NamedTuple):
    """One repetition for one window length."""
    places: tuple[int, ...]        # sampled places of the walk after the two early ones, ascending
    third: np.ndarray              # bitmap over the top bits of the keys up to the first of them
    prefixes: list[np.ndarray]     # sorted hashes of the sampled words of all item windows up to each place
    owners: tuple[np.ndarray, np.ndarray]  # item and offset, by whole key
    bounds: np.ndarray             # owners of key k are bounds[k]:bounds[k + 1]


class Round(NamedTuple):
    seed: int
    near: int                      # the second place; the first is 0
    early: np.ndarray              # bitmap over the top bits of the hash of the first two words
    probes: list[Probe]


class Index(NamedTuple):
    items: list[np.ndarray]        # word hashes
    first: np.ndarray              # bitmap over the top bits of the first words of item windows
    rounds: list[Round]
    short: list                    # by number of words: (sorted hashes, item) of the items too short for windows


def window_length(n: int) -> int:
    return 1 << max(int(0.75 * n), 1).bit_length() - 1


_STEPS = 4096


@lru_cache(maxsize=None)
def _odd(seed: int, block: int) -> np.ndarray:
    """A random odd multiplier for each of the ``_STEPS`` steps of a walk from
    ``block * _STEPS`` on."""
    draw = np.random.default_rng([seed, block] if block else seed)
    return draw.integers(2**64, size=_STEPS, dtype=np.uint64) | np.uint64(1)


def _bit(words: np.ndarray, seed: int, step: int) -> np.ndarray:
    """The walk's random bit for each word at this step."""
    return ((words * _odd(seed, step // _STEPS)[step % _STEPS]) >> np.uint64(63)).astype(np.int64)


def _walk(words: np.ndarray, at: np.ndarray, seed: int, done: int, upto: int) -> np.ndarray:
    """Positions after the steps ``done`` to ``upto - 1``; a text's end (word
    0) keeps the walk where it is."""
    for step in range(done, upto):
        here = words[at]
        at = at + (_bit(here, seed, step) & (here != 0))
    return at


def _padded(w: wd.Words) -> tuple[np.ndarray, np.ndarray]:
    """Words with a 0 behind each text, and where each text starts."""
    n = np.diff(w.bounds)
    out = np.zeros(len(w.hashes) + len(n), np.uint64)
    out[np.arange(len(w.hashes)) + w.owner] = w.hashes | np.uint64(1)
    return out, w.bounds[:-1] + np.arange(len(n))


def _grow(key: np.ndarray, word: np.ndarray) -> np.ndarray:
    return wd.mix(key * np.uint64(3) + word)


def places_of(seed: int, near: int, length: int, coordinates: int = COORDINATES) -> tuple[int, ...]:
    """Places of the walk over the window, drawn behind the near one."""
    behind = np.arange(near + 1, max(2 * length, near + coordinates))
    drawn = np.random.default_rng(seed).choice(behind, min(coordinates - 2, len(behind)), replace=False)
    return tuple(sorted(int(x) for x in drawn))


def build_index(items: list[np.ndarray], rounds: int = ROUNDS, coordinates: int = COORDINATES) -> Index:
    classes = defaultdict(list)
    for k, item in enumerate(items):
        if len(item) >= MIN_WORDS:
            classes[window_length(len(item))].append(k)
    windows = []
    first = np.zeros(1 << _FIRST_BITS, bool)
    for length, members in sorted(classes.items()):
        words = np.concatenate([np.append(items[k] | np.uint64(1), np.uint64(0)) for k in members])
        spans = [len(items[k]) - length + 1 for k in members]
        base = np.cumsum([0, *(len(items[k]) + 1 for k in members)])[:-1]
        start = np.concatenate([b + np.arange(s) for b, s in zip(base, spans)])
        windows.append((length, words, start, np.repeat(members, spans),
                        np.concatenate([np.arange(s) for s in spans])))
        first[words[start] >> np.uint64(64 - _FIRST_BITS)] = True
    built = []
    for r in range(1, rounds + 1):
        near, early, probes = 1 + r % 3, np.zeros(1 << _FIRST_BITS, bool), []
        for length, words, start, whose, offset in windows:
            at = _walk(words, start, r, 0, near)
            key, done = _grow(_grow(np.zeros(len(start), np.uint64), words[start]), words[at]), near
            early[key >> np.uint64(64 - _FIRST_BITS)] = True
            places, prefixes = places_of(r * 1009 + length, near, length, coordinates), []
            third = np.zeros(1 << _THIRD_BITS, bool)
            for p in places:
                at, done = _walk(words, at, r, done, p), p
                key = _grow(key, words[at])
                prefixes.append(np.unique(key))
            third[prefixes[0] >> np.uint64(64 - _THIRD_BITS)] = True
            order = np.argsort(key, kind="stable")
            bounds = np.append(np.searchsorted(key[order], prefixes[-1]), len(key))
            probes.append(Probe(places, third, prefixes, (whose[order], offset[order]), bounds))
        built.append(Round(r, near, early, probes))
    return Index(items, first, built, [_short_items(items, k) for k in range(1, MIN_WORDS)])


def _short_items(items: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    own = np.array([n for n, item in enumerate(items) if len(item) == k], np.int64)
    h = np.array([_sequence(items[n]) for n in own], np.uint64)
    order = np.argsort(h, kind="stable")
    return h[order], own[order]


def _sequence(item: np.ndarray) -> int:
    n = len(item)
    return int(wd.shingles(wd.Words(item, np.array([0, n]), item, item), n)[0][0])


def find_short(index: Index, w: wd.Words) -> list[tuple[int, int, int]]:
    """(text, item, 0) of each short item that stands in a text."""
    out = set()
    for k, (known, item) in enumerate(index.short, start=1):
        if len(known):
            h, text = wd.shingles(w, k)
            at = np.minimum(np.searchsorted(known, h), len(known) - 1)
            hit = known[at] == h
            out.update(zip(text[hit].tolist(), item[at[hit]].tolist()))
    return [(d, n, 0) for d, n in sorted(out)]


def _among(keys: np.ndarray, known: np.ndarray) -> np.ndarray:
    at = np.searchsorted(known, keys)
    at[at == len(known)] = 0
    return known[at] == keys


def collisions(index: Index, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(item, position where the item would start) of every key that agrees."""
    live = np.flatnonzero((words != 0) & index.first[words >> np.uint64(64 - _FIRST_BITS)])
    found = []
    head = _grow(np.zeros(len(live), np.uint64), words[live])
    for r in index.rounds:
        at = _walk(words, live, r.seed, 0, r.near)
        key = _grow(head, words[at])
        keep = r.early[key >> np.uint64(64 - _FIRST_BITS)]
        some = live[keep], at[keep], key[keep]
        for probe in r.probes:
            (start, at, key), done = some, r.near
            for p, known in zip(probe.places, probe.prefixes):
                at, done = _walk(words, at, r.seed, done, p), p
                key = _grow(key, words[at])
                keep = probe.third[key >> np.uint64(64 - _THIRD_BITS)]
                if known is not probe.prefixes[0]:
                    keep = _among(key, known)
                start, at, key = start[keep], at[keep], key[keep]
                if not len(start):
                    break
            if len(start):
                slot = np.searchsorted(probe.prefixes[-1], key)
                n = probe.bounds[slot + 1] - probe.bounds[slot]
                pick = np.repeat(probe.bounds[slot] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                found.append(np.stack([probe.owners[0][pick], np.repeat(start, n) - probe.owners[1][pick]]))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.concatenate(found, axis=1), axis=1)
    return both[0], both[1]


def best_match(item: np.ndarray, passage: np.ndarray, most: int) -> int:
    """Least edit distance of the item to any part of the passage, column by
    column with the vertical differences as bits of two integers; above
    ``most`` a lower bound of it."""
    where: dict[int, int] = defaultdict(int)
    for i, c in enumerate(item.tolist()):
        where[c] |= 1 << i
    n, passage = len(item), passage.tolist()
    there = set(passage)
    if (missing := sum(c not in there for c in item.tolist())) > most:
        return missing  # each costs an edit at least
    mask, top = (1 << n) - 1, 1 << (n - 1)
    plus, minus, now = mask, 0, n
    best = now
    for c in passage:
        match = where.get(c, 0)
        same = ((((match & plus) + plus) ^ plus) | match | minus) & mask
        up = minus | (mask & ~(same | plus))
        down = same & plus
        if up & top:
            now += 1
        elif down & top:
            now -= 1
            best = min(best, now)
        up, down = (up << 1) & mask, (down << 1) & mask
        plus = down | (mask & ~(same | up))
        minus = up & same
    return best


def find(index: Index, w: wd.Words, similarity: float = SIMILARITY) -> list[tuple[int, int, int]]:
    """(text, item, distance) of each item that a text contains."""
    return find_short(index, w) + find_long(index, w, similarity)


def find_long(index: Index, w: wd.Words, similarity: float = SIMILARITY) -> list[tuple[int, int, int]]:
    words, starts = _padded(w)
    items, at = collisions(index, words)
    if not len(items):
        return []
    sizes = np.array([len(x) for x in index.items])[items]
    slack = ((1 - similarity) * sizes + 1e-9).astype(np.int64)
    # the start may lie up to slack words before the text, never in another one
    text = np.searchsorted(starts, np.minimum(np.maximum(at + sizes // 2, 0), len(words) - 1), side="right") - 1
    out: dict[tuple[int, int], int] = {}
    seen: dict[tuple[int, int], int] = {}
    for k, a, n, s, d in zip(items.tolist(), at.tolist(), sizes.tolist(), slack.tolist(), text.tolist()):
        last = seen.get((d, k))
        if last is not None and a - last <= s // 2 or out.get((d, k)) == 0:
            continue  # that passage has been looked at with half the slack to spare
        seen[d, k] = a
        own = w.hashes[w.bounds[d]:w.bounds[d + 1]]
        lo = a - int(starts[d])
        passage = own[max(lo - 2 * s, 0):max(lo + n + 2 * s, 0)]
        distance = best_match(index.items[k], passage, s)
        if distance <= s and distance < out.get((d, k), s + 1):
            out[d, k] = distance
    return [(d, k, e) for (d, k), e in out.items()]


def item_blocks(items: DataFrame, id_col: str, text_col: str, block: int, words: int = BLOCK_WORDS):
    """Blocks of (ids of equal items, word hashes), by way of the driver."""
    rows = items.select(F.col(id_col).cast("long"), F.coalesce(text_col, F.lit(""))).toLocalIterator()
    same, size, n = defaultdict(list), 0, 0
    while some := list(islice(rows, 1000)):
        w = wd.lower_words(pa.array([r[1] for r in some], pa.string()))
        for k, r in enumerate(some):
            own = w.hashes[w.bounds[k]:w.bounds[k + 1]]
            if n and (n >= block or size + len(own) > words):
                yield [(ids, np.frombuffer(h, np.uint64)) for h, ids in same.items()]
                same, size, n = defaultdict(list), 0, 0
            key = own.tobytes()
            size += 0 if key in same else len(own)
            n += 1
            same[key].append(r[0])
    if same:
        yield [(ids, np.frombuffer(h, np.uint64)) for h, ids in same.items()]


def rare_items(docs: DataFrame, own: list, text_col: str, rare: float) -> list:
    """A block without the short items that more than ``rare`` of the
    documents hold (but one document may always hold an item)."""
    short = [k for k, (_, h) in enumerate(own) if 0 < len(h) < MIN_WORDS]
    if not short:
        return own
    spark = docs.sparkSession
    index = spark.sparkContext.broadcast(build_index([own[k][1] for k in short], 0))

    def run(batches):
        seen, n = np.zeros(len(short), np.int64), 0
        for batch in batches:
            for part in wd.pieces(batch, 0):
                n += part.num_rows
                hits = find_short(index.value, wd.lower_words(part.column(0)))
                seen += np.bincount([k for _, k, _ in hits], minlength=len(short)).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(np.arange(len(short)), -1)), pa.array(np.append(seen, n))], names=["k", "n"])

    counts = docs.select(F.coalesce(text_col, F.lit("")).alias("t")).mapInArrow(run, "k long, n long")
    total = {r["k"]: r["n"] for r in counts.groupBy("k").agg(F.sum("n").alias("n")).collect()}  # a row per short item of the block
    most = max(rare * total.get(-1, 0), 1)
    common = {short[k] for k, n in total.items() if k >= 0 and n > most}
    return [x for k, x in enumerate(own) if k not in common]


def contained(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text",
              item_id: str = "item_id", item_text: str = "text", similarity: float = SIMILARITY,
              rounds: int = ROUNDS, block: int = BLOCK, rare: float = RARE) -> DataFrame:
    """``doc_id, item_id, item_words, distance``, a row for each document row
    and item that it contains."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(text_col, F.lit("")).alias("t"))
    out = None
    for own in item_blocks(items, item_id, item_text, block):
        own = rare_items(docs, own, text_col, rare)
        index = spark.sparkContext.broadcast((build_index([h for _, h in own], rounds), [ids for ids, _ in own]))

        def run(batches, index=index):
            for batch in batches:
                for part in wd.pieces(batch, 1):
                    hits = find(index.value[0], wd.lower_words(part.column(1)), similarity)
                    rows = [(part.column(0)[d].as_py(), i, len(index.value[0].items[k]), e)
                            for d, k, e in hits for i in index.value[1][k]]
                    cols = list(zip(*rows)) if rows else [[]] * 4
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), pa.int32(), pa.int32()])],
                        names=["doc_id", "item_id", "item_words", "distance"])

        found = rows.mapInArrow(run, HITS)
        out = found if out is None else out.unionByName(found)
    return spark.createDataFrame([], HITS) if out is None else out


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", item_text: str = "text",
                  similarity: float = SIMILARITY, rounds: int = ROUNDS, block: int = BLOCK, rare: float = RARE) -> DataFrame:
    """The rows of ``docs`` that contain no item, columns as they are."""
    spark, names, whole = docs.sparkSession, docs.columns, docs
    numbered = items.select(F.lit(0).alias("k"), F.col(item_text).alias("t"))
    for own in item_blocks(numbered, "k", "t", block):
        own = rare_items(whole, own, text_col, rare)
        index = spark.sparkContext.broadcast(build_index([h for _, h in own], rounds))

        def run(batches, index=index):
            for batch in batches:
                for part in wd.pieces(batch, names.index(text_col)):
                    clean = np.ones(part.num_rows, bool)
                    for d, _, _ in find(index.value, wd.lower_words(part.column(names.index(text_col))), similarity):
                        clean[d] = False
                    yield part.filter(pa.array(clean))

        docs = docs.mapInArrow(run, docs.schema)
    return docs


def benchmark_hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))

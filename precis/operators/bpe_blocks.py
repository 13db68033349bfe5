"""The words of BPE training in blocks, and the passes over them.

A block is one row that holds the symbols of many words as one array of 32-bit
ids, a separator behind each word, and the words' counts.  A pass finds the
places of its pairs with two table lookups per symbol (may it start, may it end
a pair?) and a search among the few places left; only the words that hold such a
pair are looked at again, rewritten, and give the change of the pair counts.  A
word left with one symbol leaves its block.

Pairs and triples of symbols are packed into one long (21 bits a symbol).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import BYTE_ALPHABET, SORTED_ALPHABET, SPECIAL_TOKENS

#: byte -> id of its symbol: 5 + rank in the sorted alphabet
SYMBOL_IDS = np.array([len(SPECIAL_TOKENS) + SORTED_ALPHABET.index(c) for c in BYTE_ALPHABET], np.int32)
SHIFT = 21
MAX_SYMBOLS = 1 << SHIFT
WORDS_PER_BLOCK = 1 << 16
BLOCK, DELTA, TRIPLE = 0, 1, 2
#: kind, packed pair or triple, flags of a triple, count, symbols, counts of the words
ROW = "kind int, k long, f int, c long, ids binary, counts binary"
HEAD, TAIL, HEAD_LISTED, TAIL_LISTED = 1, 2, 4, 8
_END = -1


class Step(NamedTuple):
    """What one pass does: merges the pairs ``keys`` (sorted) into ``news``,
    reports the changes of the pairs ``known`` (sorted) and of all that hold a
    symbol of ``news``, and counts the triples around the pairs ``listed``
    (sorted) and, again, around those that hold a symbol of ``news``."""
    keys: np.ndarray
    news: np.ndarray
    known: np.ndarray
    listed: np.ndarray
    symbols: int


def pack(left, right):
    return (left << SHIFT) | right


def blocks(words: DataFrame, per_block: int = WORDS_PER_BLOCK) -> DataFrame:
    """Rows of kind ``BLOCK`` of the words ``n, pretoken``.  A word's symbols are
    those of its UTF-8 bytes, looked up for a whole block at once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                size += batch.num_rows
            if size >= per_block:
                yield _block(held)
                held, size = [], 0
        if held:
            yield _block(held)

    return words.select("n", "pretoken").mapInArrow(run, ROW)


def _block(batches: list) -> pa.RecordBatch:
    table = pa.Table.from_batches(batches).combine_chunks()
    texts = pa.concat_arrays([c.cast(pa.large_string()) for c in table.column(1).chunks])
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    sizes = np.diff(bounds)
    counts = table.column(0).to_numpy().astype(np.int64)
    flat = np.full(int(sizes.sum()) + len(sizes), _END, np.int32)
    inside = np.ones(len(flat), bool)
    inside[np.cumsum(sizes + 1) - 1] = False
    flat[inside] = SYMBOL_IDS[np.frombuffer(texts.buffers()[2], np.uint8)[bounds[0]:bounds[-1]]]
    return _rows(BLOCK, flat, counts)


def _rows(kind: int, a: np.ndarray, b: np.ndarray, flags: np.ndarray | None = None) -> pa.RecordBatch:
    """A block (symbols, counts) or counted keys (keys, counts)."""
    names = [x.split()[0] for x in ROW.split(", ")]
    if kind == BLOCK:
        columns = [pa.array([BLOCK], pa.int32()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.int64()),
                   pa.array([a.tobytes()], pa.binary()), pa.array([b.tobytes()], pa.binary())]
    else:
        n = len(a)
        columns = [pa.array(np.full(n, kind, np.int32)), pa.array(a), pa.array(np.zeros(n, np.int32) if flags is None else flags),
                   pa.array(b), pa.nulls(n, pa.binary()), pa.nulls(n, pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=names)


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(distinct keys in order, sums)."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(n[order], first)


def inside(keys: np.ndarray, listed: np.ndarray) -> np.ndarray:
    if not len(listed):
        return np.zeros(len(keys), bool)
    return listed[np.minimum(np.searchsorted(listed, keys), len(listed) - 1)] == keys


def pairs(ids: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed pair, weight) at each place where a word goes on."""
    at = np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))
    return pack(ids[at].astype(np.int64), ids[at + 1]), weight[at]


def _ends_of(ids: np.ndarray) -> np.ndarray:
    return np.flatnonzero(ids == _END)


def _tables(keys: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Which symbols start and which end one of the pairs; the separator, as
    the last entry, does neither."""
    starts, ends = np.zeros(symbols + 1, bool), np.zeros(symbols + 1, bool)
    starts[keys >> SHIFT] = True
    ends[keys & (MAX_SYMBOLS - 1)] = True
    return starts, ends


def places(ids: np.ndarray, keys: np.ndarray, tables) -> tuple[np.ndarray, np.ndarray]:
    """(places, which key) of the pairs ``keys``."""
    starts, ends = tables
    at = np.flatnonzero(starts[ids[:-1]] & ends[ids[1:]])
    packed = pack(ids[at].astype(np.int64), ids[at + 1])
    which = np.minimum(np.searchsorted(keys, packed), max(len(keys) - 1, 0))
    hit = keys[which] == packed if len(keys) else np.zeros(0, bool)
    return at[hit], which[hit]


def merge(ids: np.ndarray, counts: np.ndarray, step: Step, tables) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(symbols, counts, changed pairs, changes) after the step's merges.  Its
    pairs do not overlap each other; a pair of equal symbols overlaps itself
    and is merged from the left."""
    nothing = np.zeros(0, np.int64)
    at, which = places(ids, step.keys, tables)
    if not len(at):
        return ids, counts, nothing, nothing
    start = np.concatenate([[True], np.diff(at) != 1])
    number = np.arange(len(at))
    even = (number - np.maximum.accumulate(np.where(start, number, 0))) % 2 == 0
    at, which = at[even], which[even]
    ends = _ends_of(ids)
    sizes = np.diff(ends, prepend=-1)
    word = np.searchsorted(ends, at)
    touched = np.zeros(len(ends), bool)
    touched[word] = True
    old_keys, old_n = pairs(*_part(ids, counts, sizes, touched))
    out = ids.copy()
    out[at] = step.news[which]
    stay = np.ones(len(ids), bool)
    stay[at + 1] = False
    out = out[stay]
    sizes = sizes - np.bincount(word, minlength=len(ends))
    new_keys, new_n = pairs(*_part(out, counts, sizes, touched))
    keys, change = summed(np.concatenate([old_keys, new_keys]), np.concatenate([-old_n, new_n]))
    live = sizes > 2  # a word of one symbol and its separator has no pair
    if not live.all():
        out, counts = out[np.repeat(live, sizes)], counts[live]
    some = change != 0
    return out, counts, keys[some], change[some]


def _part(ids, counts, sizes, words) -> tuple[np.ndarray, np.ndarray]:
    """(symbols, the word's count at each) of some of the words."""
    return ids[np.repeat(words, sizes)], np.repeat(counts[words], sizes[words])


def triples(ids: np.ndarray, counts: np.ndarray, step: Step, listed_tables, fresh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(packed triple with its four flags in the low bits, count) around the
    listed pairs and those with a fresh symbol."""
    listed = np.zeros(max(len(ids) - 1, 0), bool)
    listed[places(ids, step.listed, listed_tables)[0]] = True
    new = fresh[ids[:-1]] | fresh[ids[1:]]
    watched = listed | new
    whole = (ids[:-2] >= 0) & (ids[1:-1] >= 0) & (ids[2:] >= 0)
    at = np.flatnonzero((watched[:-1] | watched[1:]) & whole)
    a, b, c = (ids[at + j].astype(np.int64) for j in range(3))
    sizes = np.diff(_ends_of(ids), prepend=-1)
    n = np.repeat(counts, sizes)[at]
    keys, sums = summed((a << 2 * SHIFT) | (b << SHIFT) | c, n)
    return keys, sums


def flags_of(keys: np.ndarray, step: Step, fresh: np.ndarray) -> np.ndarray:
    """Whether head and tail of each packed triple are watched and listed."""
    out = np.zeros(len(keys), np.int32)
    low = MAX_SYMBOLS - 1
    for pair, seen, is_listed in ((keys >> SHIFT, HEAD, HEAD_LISTED), (keys & (MAX_SYMBOLS * MAX_SYMBOLS - 1), TAIL, TAIL_LISTED)):
        listed = inside(pair, step.listed)
        new = fresh[pair >> SHIFT] | fresh[pair & low]
        out |= np.where(listed | new, seen, 0).astype(np.int32) | np.where(listed, is_listed, 0).astype(np.int32)
    return out


def run_step(state: DataFrame, step: Step) -> DataFrame:
    """One pass: the blocks after the merges, and per task the changes of the
    pairs and the counts of the triples that the step asks for."""
    def run(batches):
        tables, listed_tables = _tables(step.keys, step.symbols), _tables(step.listed, step.symbols)
        fresh = np.zeros(step.symbols + 1, bool)
        fresh[step.news] = True
        found: dict[int, list] = {DELTA: [], TRIPLE: []}
        for batch in batches:
            for ids, counts in zip(batch.column(4), batch.column(5)):
                ids, counts = np.frombuffer(ids.as_buffer(), np.int32), np.frombuffer(counts.as_buffer(), np.int64)
                ids, counts, keys, change = merge(ids, counts, step, tables)
                if len(counts):
                    yield _rows(BLOCK, ids, counts)
                asked = inside(keys, step.known) | fresh[keys >> SHIFT] | fresh[keys & (MAX_SYMBOLS - 1)]
                _gather(found[DELTA], keys[asked], change[asked])
                if len(step.listed) and len(ids) > 2:
                    _gather(found[TRIPLE], *triples(ids, counts, step, listed_tables, fresh))
        for kind, parts in found.items():
            if parts:
                keys, n = summed(*map(np.concatenate, zip(*parts)))
                yield _rows(kind, keys, n, flags_of(keys, step, fresh) if kind == TRIPLE else None)

    return state.select(*[x.split()[0] for x in ROW.split(", ")]).mapInArrow(run, ROW)


def _gather(parts: list, keys: np.ndarray, n: np.ndarray) -> None:
    """Keeps a task's sums small: what came together is summed up when it has doubled."""
    parts.append((keys, n))
    if len(parts) > 1 and sum(len(k) for k, _ in parts[1:]) > 2 * len(parts[0][0]) + 100_000:
        parts[:] = [summed(*map(np.concatenate, zip(*parts)))]


def all_pairs(state: DataFrame) -> DataFrame:
    """``k, c``: the count of every pair."""
    def run(batches):
        found: list = []
        for batch in batches:
            for ids, counts in zip(batch.column(0), batch.column(1)):
                ids, counts = np.frombuffer(ids.as_buffer(), np.int32), np.frombuffer(counts.as_buffer(), np.int64)
                _gather(found, *summed(*pairs(ids, np.repeat(counts, np.diff(_ends_of(ids), prepend=-1)))))
        if found:
            keys, n = summed(*map(np.concatenate, zip(*found)))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(n)], names=["k", "c"])

    return state.select("ids", "counts").mapInArrow(run, "k long, c long").groupBy("k").agg(F.sum("c").alias("c"))


def outcome(after: DataFrame, least: int) -> DataFrame:
    """``pair, other, c`` of a step's rows: for ``other = -1`` the change of a
    pair (of pairs with a fresh symbol only changes of at least ``least``, which
    no rewritten pair needs), for ``other = -2`` the highest count of a triple
    that starts or ends with the pair, and for two listed pairs the count of
    the triple that joins them.  ``least`` is a column of its own, so that the
    compiled code of a round serves the next."""
    low = MAX_SYMBOLS * MAX_SYMBOLS - 1
    summed_up = (after.where(f"kind <> {BLOCK}").groupBy("kind", "k", "f").agg(F.sum("c").alias("c")))
    side = "struct(cast(f & {seen} as boolean) AS seen, {pair} AS pair, if((f & {listed}) <> 0, {other}, -2L) AS other)"
    head, tail = f"shiftright(k, {SHIFT})", f"(k & {low}L)"
    rows = (summed_up.selectExpr("c", f"""inline(if(kind = {DELTA}, array(struct(true AS seen, k AS pair, -1L AS other)), array(
        {side.format(seen=HEAD, pair=head, listed=TAIL_LISTED, other=tail)},
        {side.format(seen=TAIL, pair=tail, listed=HEAD_LISTED, other=head)})))""").where("seen"))
    return (rows.groupBy("pair", "other").agg(F.max("c").alias("c"))
            .where((F.col("other") != -1) | (F.col("c") < 0) | (F.col("c") >= least)))

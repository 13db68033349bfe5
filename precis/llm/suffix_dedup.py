"""Removal of byte strings that a document with a smaller id holds too.

Each byte that is covered by a string of ``LENGTH`` bytes that also starts in a
document with a smaller id goes.  Strings are judged on the input; matches
never cross documents.

1. Blocks: the documents are written once to the shared folder with the number
   of their block and row, so that later passes name rows by number.
2. Anchors: of each window of ``LENGTH`` bytes the substring of ``GRAM`` bytes
   with the smallest hash is its anchor (the leftmost of equal ones); equal
   windows have equal anchors at equal places.  Anchors go, packed, to the task
   of their hash, which keeps those of more than one document and gives each a
   route: a stretch of the smallest document that holds it (shorter stretches
   for anchors of many documents, the anchor alone beyond that).
3. Segments: consecutive anchors of one route, with the bytes of all windows
   that they anchor, are sent to that route.  Equal windows meet, since they
   have equal anchors and so equal routes.
4. Suffix arrays: equal segments of a route become one; the different ones form
   one text whose suffix array is built by linear grouping (``suffix_groups``,
   many texts at a time).  Neighbours in it that share ``LENGTH`` bytes
   (compared byte for byte) are one string; every occurrence in a larger
   document than its smallest is covered.
5. The covered spans go back to their blocks, where the bytes are dropped.

Hot anchors: one that more than ``HOT`` documents hold would make too large a
route.  Its windows become rows (128-bit hash, document, place) that Spark sums
by partial minimum and joins back, which AQE splits.  A route whose different
segments exceed ``MOST`` bytes (an anchor with very many different
surroundings) is settled by the same 128-bit hashes inside its task.

Defined results: null or empty text has 0 bytes; a null id is larger than every
id; rows that repeat an id are no smaller documents to each other; texts
shorter than ``LENGTH`` lose nothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.llm import words as wd
from precis.llm.common import scratch, stored, table
from precis.llm.suffix_groups import suffix_arrays
from precis.llm.warc import open_folder
from precis.session import shuffle_partitions

LENGTH, GRAM = 50, 28
HOT = 50_000
#: Route stretches, in bytes of the smallest document, for anchors of at most so many documents.
STRETCH = ((8, 2048), (64, 512), (512, 128))
MOST, BATCH, FLUSH = 1 << 16, 1 << 21, 1 << 24
NOBODY = 2**63 - 1
BLOCKS = "block int, row int, i long, o long, t string"
PACKED = "q int, block int, data binary"
SEGMENT = "route long, block int, row int, o long, at int, data binary"
SPANS = "block int, data binary"
WINDOW = "w1 long, w2 long, o long, block int, row int, at int"
RESULT = "i long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans string"
_SIDE = np.uint64(24)


# --- anchors -----------------------------------------------------------------

def anchors(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position in the buffer, hash) of the anchors of all windows that lie
    within one text."""
    places, hashes = [], []
    step = 1 << 23
    for base in range(0, max(len(data) - LENGTH + 1, 0), step):
        part = data[base:base + step + LENGTH - 1]
        sums, inverse = wd.prefix_hash(part)
        h = (sums[GRAM:] - sums[:-GRAM]) * inverse[:len(part) - GRAM + 1]
        h ^= h >> np.uint64(29)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        low = (h >> _SIDE << _SIDE) | np.arange(len(h), dtype=np.uint64)
        width, span = LENGTH - GRAM + 1, 1
        while 2 * span <= width:
            low = np.minimum(low[:-span], low[span:])
            span *= 2
        if width > span:
            low = np.minimum(low[:span - width], low[width - span:])
        whole = np.ones(len(low), bool)
        first, last = np.searchsorted(off, [base, base + len(part)])
        for end in off[first:last + 1].tolist():
            whole[max(end - base - LENGTH + 1, 0):max(end - base, 0)] = False
        low = low[whole]
        at = (low[np.concatenate([[True], low[1:] != low[:-1]])[:len(low)]] & np.uint64((1 << 24) - 1)).astype(np.int64)
        places.append(at + base)
        hashes.append(h[at])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at, h = np.concatenate(places), np.concatenate(hashes)
    if len(places) > 1:
        at, keep = np.unique(at, return_index=True)
        h = h[keep]
    return at, h


def _by_block(batches, text: int):
    """Slices (block, rows) of batches whose columns are those of BLOCKS."""
    for batch in batches:
        block = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))[:len(block)].tolist()
        for a, b in zip(cuts, [*cuts[1:], len(block)]):
            for part in wd.pieces(batch.slice(a, b - a), text):
                yield int(block[a]), part


def write_blocks(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("i"), F.coalesce(text_col, F.lit("")).alias("t"))

    def number(batches):
        block, row = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            order = pa.array([NOBODY if x is None else x for x in batch.column(0).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(n, block, np.int32)), pa.array(np.arange(row, row + n, dtype=np.int32)),
                 batch.column(0), order, batch.column(1)], names=["block", "row", "i", "o", "t"])
            row += n

    return stored(rows.mapInArrow(number, BLOCKS), "blocks")


def _pack(*arrays: np.ndarray) -> bytes:
    head = np.array([len(arrays), *(x for a in arrays for x in (len(a), ord(a.dtype.char)))], np.int64)
    return head.tobytes() + b"".join(a.tobytes() for a in arrays)


def _unpack(data: bytes) -> list[np.ndarray]:
    n = int(np.frombuffer(data, np.int64, 1)[0])
    head = np.frombuffer(data, np.int64, 1 + 2 * n)[1:].tolist()
    at, out = 8 * (1 + 2 * n), []
    for size, kind in zip(head[::2], head[1::2]):
        out.append(np.frombuffer(data, np.dtype(chr(kind)), size, at))
        at += out[-1].nbytes
    return out


def spread_anchors(blocks: DataFrame, parts: int) -> DataFrame:
    """Packed anchors by the part of their hash: documents, then per anchor 40
    bits of hash, the document's number and the place in units of 128 bytes."""
    def run(batches):
        held, held_bytes, now = [], 0, None

        def flush():
            place, h, order = (np.concatenate(x) for x in zip(*held))
            q = ((h & np.uint64((1 << 24) - 1)) % np.uint64(parts)).astype(np.int64)
            by = np.argsort(q, kind="stable")
            cuts = np.searchsorted(q[by], np.arange(parts + 1))
            for k in range(parts):
                own = by[cuts[k]:cuts[k + 1]]
                if len(own):
                    docs, number = np.unique(order[own], return_inverse=True)
                    top = h[own] >> _SIDE
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k], pa.int32()), pa.array([now], pa.int32()),
                         pa.array([_pack(docs, (top >> np.uint64(8)).astype(np.uint32), top.astype(np.uint8),
                                         number.astype(np.uint32), np.minimum(place[own] >> 7, 65535).astype(np.uint16))],
                                  pa.binary())], names=["q", "block", "data"])

        for block, part in _by_block(batches, 4):
            if held and (block != now or held_bytes > FLUSH):
                yield from flush()
                held, held_bytes = [], 0
            now = block
            data, off = wd.buffer(part.column(4))
            at, h = anchors(data, off)
            owner = np.searchsorted(off, at, side="right") - 1
            held.append((at - off[owner], h, part.column(3).to_numpy()[owner]))
            held_bytes += len(data)
        if held:
            yield from flush()

    return blocks.select("block", "row", "i", "o", "t").mapInArrow(run, PACKED)


def route_anchors(packed: DataFrame, parts: int, hot: int) -> DataFrame:
    """Per block, the anchors that several documents hold: key and route,
    sorted by key; route 0 marks a hot anchor."""
    def run(batches):
        rows = [(q, b, d) for batch in batches
                for q, b, d in zip(*(batch.column(k).to_pylist() for k in range(3)))]
        for q in sorted({r[0] for r in rows}):
            own = [(b, _unpack(d)) for k, b, d in rows if k == q]
            h = np.concatenate([(x[1].astype(np.uint64) << np.uint64(8)) | x[2] for _, x in own])
            order = np.concatenate([x[0][x[3]] for _, x in own])
            place = np.concatenate([x[4] for _, x in own]).astype(np.int64)
            block = np.repeat([b for b, _ in own], [len(x[1]) for _, x in own])
            by = np.lexsort((place, order, h))
            h, order, place, block = h[by], order[by], place[by], block[by]
            new = np.concatenate([[True], h[1:] != h[:-1]])
            first = np.flatnonzero(new)
            other = np.concatenate([[True], (order[1:] != order[:-1]) | new[1:]])
            docs = np.add.reduceat(other.astype(np.int64), first)
            stretch = (h[first] << np.uint64(1)) | np.uint64(1)
            for most, size in reversed(STRETCH):
                stretch = np.where(docs <= most, (place[first] // (size >> 7)).astype(np.uint64) * np.uint64(8192)
                                   + np.uint64(size * 2), stretch)
            route = wd.mix(wd.mix(order[first].astype(np.uint64)) + stretch) | np.uint64(1)
            route = np.where(docs > hot, np.uint64(0), route)
            group = np.cumsum(new) - 1
            keep = docs[group] > 1
            h, block, route = h[keep], block[keep], route[group][keep]
            key = (h << _SIDE) | np.uint64(q)
            by = np.lexsort((key, block))
            key, block, route = key[by], block[by], route[by]
            one = np.concatenate([[True], (key[1:] != key[:-1]) | (block[1:] != block[:-1])])[:len(key)]
            key, block, route = key[one], block[one], route[one]
            cuts = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]])[:len(block)]).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(block)]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([q], pa.int32()), pa.array([int(block[a])], pa.int32()),
                     pa.array([_pack(key[a:b], route[a:b])], pa.binary()),
                     pa.array([int((route[a:b] == 0).sum())], pa.int64())], names=["q", "block", "data", "hot"])

    return packed.repartitionById(parts, "q").mapInArrow(run, PACKED + ", hot long")


def by_block(rows: DataFrame, name: str) -> str:
    """Writes rows (block, data) into a folder per block; tasks that read a
    block open its folder."""
    path = scratch(rows.sparkSession, name)
    rows.repartition("block").write.partitionBy("block").parquet(path)
    return path


def read_block(folder: str, block: int) -> list[list[np.ndarray]]:
    fs, path = open_folder(folder)
    found = fs.get_file_info(pafs.FileSelector(f"{path}/block={block}", allow_not_found=True))
    return [_unpack(x) for f in found if f.is_file and f.path.endswith(".parquet")
            for x in pq.read_table(f.path, filesystem=fs, columns=["data"], partitioning=None)["data"].to_pylist()]


# --- segments ----------------------------------------------------------------

class _Routes:
    """The routed anchors of one block at a time."""

    def __init__(self, folder: str, parts: int):
        self.folder, self.parts, self.block = folder, parts, None

    def of(self, block: int, h: np.ndarray) -> np.ndarray:
        """Route of each hash plus 1; 0: not shared (so 1 is a hot anchor)."""
        if block != self.block:
            got = read_block(self.folder, block)
            key = np.concatenate([x[0] for x in got]) if got else np.zeros(0, np.uint64)
            route = np.concatenate([x[1] for x in got]) if got else np.zeros(0, np.uint64)
            by = np.argsort(key)
            self.block, self.key, self.route = block, key[by], route[by]
        key = (h >> _SIDE << _SIDE) | ((h & np.uint64((1 << 24) - 1)) % np.uint64(self.parts))
        if not len(self.key):
            return np.zeros(len(h), np.uint64)
        at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
        return np.where(self.key[at] == key, self.route[at] + np.uint64(1), np.uint64(0))


def cut_segments(blocks: DataFrame, routes: str, parts: int) -> DataFrame:
    def run(batches):
        known = _Routes(routes, parts)
        for block, part in _by_block(batches, 4):
            data, off = wd.buffer(part.column(4))
            at, h = anchors(data, off)
            route, owner = known.of(block, h), np.searchsorted(off, at, side="right") - 1
            new = np.concatenate([[True], (route[1:] != route[:-1]) | (owner[1:] != owner[:-1])])[:len(at)]
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(at))[:len(first)] - 1
            use = route[first] > 1
            first, last = first[use], last[use]
            doc = owner[first]
            lo = np.maximum(at[first] - (LENGTH - GRAM), off[doc])
            hi = np.minimum(at[last] + LENGTH, off[doc + 1])
            yield pa.RecordBatch.from_arrays(
                [pa.array(route[first].view(np.int64)), pa.array(np.full(len(first), block, np.int32)),
                 part.column(1).take(pa.array(doc)), part.column(3).take(pa.array(doc)),
                 pa.array((lo - off[doc]).astype(np.int32)),
                 pa.array([data[a:b].tobytes() for a, b in zip(lo.tolist(), hi.tolist())], pa.binary())],
                names=["route", "block", "row", "o", "at", "data"])

    return blocks.select("block", "row", "i", "o", "t").mapInArrow(run, SEGMENT)


def hot_windows(blocks: DataFrame, routes: str, parts: int) -> DataFrame:
    """A row for each window that a hot anchor anchors (and a few beside)."""
    def run(batches):
        known = _Routes(routes, parts)
        for block, part in _by_block(batches, 4):
            data, off = wd.buffer(part.column(4))
            at, h = anchors(data, off)
            at = at[known.of(block, h) == 1]
            doc = np.searchsorted(off, at, side="right") - 1
            mark = np.zeros(len(data) + 1, np.int64)
            np.add.at(mark, np.maximum(at - (LENGTH - GRAM), off[doc]), 1)
            np.add.at(mark, np.maximum(np.minimum(at, off[doc + 1] - LENGTH) + 1, off[doc]), -1)
            start = np.flatnonzero(np.cumsum(mark[:-1]) > 0)
            doc = np.searchsorted(off, start, side="right") - 1
            w1, w2 = window_hashes(data, start)
            yield pa.RecordBatch.from_arrays(
                [pa.array(w1.view(np.int64)), pa.array(w2.view(np.int64)), part.column(3).take(pa.array(doc)),
                 pa.array(np.full(len(start), block, np.int32)), part.column(1).take(pa.array(doc)),
                 pa.array((start - off[doc]).astype(np.int32))], names=["w1", "w2", "o", "block", "row", "at"])

    return blocks.select("block", "row", "i", "o", "t").mapInArrow(run, WINDOW)


def window_hashes(data: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of hash of the window at each start: two polynomials, over the
    bytes and over scrambled pairs of neighbouring bytes."""
    out = []
    wide = data.astype(np.uint64)
    pair = wd.mix(wide[:-1] * np.uint64(257) + wide[1:] + np.uint64(1)) if len(data) > 1 else wide[:0]
    for values, n in ((wide, LENGTH), (pair, LENGTH - 1)):
        power, inverse = wd._powers(len(values))
        sums = np.concatenate([[np.uint64(0)], np.cumsum((values + np.uint64(1)) * power[:-1])])
        out.append(wd.mix((sums[start + n] - sums[start]) * inverse[start]))
    return out[0], out[1]


# --- suffix arrays of routes -------------------------------------------------

class _Route:
    """The different segments of a route with the smallest document of each."""

    def __init__(self):
        self.seen: dict[bytes, list] = {}   # bytes -> [smallest document, occurrences]

    def add(self, data: bytes, o: int, where: tuple) -> None:
        got = self.seen.setdefault(data, [o, []])
        got[0] = min(got[0], o)
        got[1].append((o, *where))

    @property
    def size(self) -> int:
        return sum(map(len, self.seen)) + len(self.seen)


def _equal(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the windows at ``a`` and ``b`` are equal, eight bytes at a time."""
    words = np.ndarray((len(data) - 7,), "<u8", data, 0, (1,))
    same = np.ones(len(a), bool)
    for k in [*range(0, LENGTH - 8, 8), LENGTH - 8]:
        same &= words[a + k] == words[b + k]
    return same


def covered(routes: list[_Route], direct: bool = False):
    """(segment number over all routes, from, to) of what the smallest document
    of each different segment loses; by suffix arrays, or by window hashes."""
    parts = [list(r.seen) for r in routes]
    pieces = [s for p in parts for s in p]
    size = np.array([len(s) + 1 for s in pieces])
    ends = np.cumsum(size)
    begin = ends - size
    data = np.frombuffer(b"\0".join(pieces) + b"\0" * 9, np.uint8)[:int(ends[-1]) + 8]
    n = int(ends[-1])
    segment = np.repeat(np.arange(len(pieces)), size)
    smallest = np.array([r.seen[s][0] for r, p in zip(routes, parts) for s in p], np.int64)
    whole = np.arange(n) + LENGTH < ends[segment]
    if direct:
        start = np.flatnonzero(whole)
        w1, w2 = window_hashes(data, start)
        order = np.lexsort((w2, w1))
        start, w1, w2 = start[order], w1[order], w2[order]
        same = (w1[1:] == w1[:-1]) & (w2[1:] == w2[:-1])
    else:
        symbols = data[:n].astype(np.int64) + 1
        symbols[ends - 1] = 0
        bounds = np.concatenate([[0], ends[np.cumsum([len(p) for p in parts]) - 1]])
        order = suffix_arrays(symbols, bounds)
        start = order[whole[order]]
        text = np.searchsorted(bounds, start, side="right")
        same = (text[1:] == text[:-1]) & _equal(data, start[1:], start[:-1])
    if not len(start):
        return np.zeros((3, 0), np.int64)
    first = np.flatnonzero(np.concatenate([[True], ~same]))
    own = smallest[segment[start]]
    least = np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(start))))
    hit = start[own > least]
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, hit, 1)
    np.add.at(mark, hit + LENGTH, -1)
    on = np.concatenate([[False], np.cumsum(mark[:-1]) > 0, [False]])
    a, b = np.flatnonzero(on[1:] & ~on[:-1]), np.flatnonzero(~on[1:] & on[:-1])
    return np.stack([segment[a], a - begin[segment[a]], b - begin[segment[a]]])


def route_spans(routes: list[_Route]):
    """(block, row, from, to) of the covered spans of all occurrences."""
    out = []
    by_size = sorted((r for r in routes if len(r.seen) > 1), key=lambda r: r.size)
    batches, held, size = [], [], 0
    for r in by_size:
        if held and (size + r.size > BATCH or r.size > MOST):
            batches.append(held)
            held, size = [], 0
        held.append(r)
        size += r.size
    for batch in [*batches, *([held] if held else [])]:
        firsts = [(s, o) for r in batch for s, o in r.seen.items()]
        for k, a, b in covered(batch, batch[0].size > MOST).T.tolist():
            least, found = firsts[k][1]
            out += [(block, row, at + a, at + b) for o, block, row, at in found if o == least]
    for r in routes:
        for data, (least, found) in r.seen.items():
            if len(data) >= LENGTH:
                out += [(block, row, at, at + len(data)) for o, block, row, at in found if o > least]
    return out


def match_segments(segments: DataFrame) -> DataFrame:
    def run(batches):
        routes, held, now = [], 0, None

        def flush():
            spans = np.array(route_spans(routes), np.int64).reshape(-1, 4)
            spans = spans[np.argsort(spans[:, 0], kind="stable")]
            cuts = np.flatnonzero(np.concatenate([[True], spans[1:, 0] != spans[:-1, 0]])[:len(spans)]).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(spans)]):
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(spans[a, 0])], pa.int32()),
                     pa.array([_pack(*(spans[a:b, k].astype(np.int32) for k in (1, 2, 3)))], pa.binary())],
                    names=["block", "data"])

        for batch in batches:
            for route, block, row, o, at, data in zip(*(batch.column(k).to_pylist() for k in range(6))):
                if route != now:
                    if held > 8 * BATCH:
                        yield from flush()
                        routes, held = [], 0
                    routes.append(_Route())
                    now = route
                routes[-1].add(data, o, (block, row, at))
                held += len(data)
        if routes:
            yield from flush()

    return (segments.repartition(shuffle_partitions(segments.sparkSession), "route")
            .sortWithinPartitions("route").mapInArrow(run, SPANS))


def match_hot(windows: DataFrame) -> DataFrame:
    # both stored: the windows are cut once, and the join is of two plain
    # shuffles, which AQE splits at a window that very many documents hold
    windows = stored(windows, "hot-windows")
    least = stored(windows.groupBy("w1", "w2").agg(F.min("o").alias("least")), "hot-least")
    lost = windows.join(least, ["w1", "w2"]).where("o > least").select("block", "row", "at")

    def run(batches):
        for batch in batches:
            block, row, at = (batch.column(k).to_numpy() for k in range(3))
            by = np.argsort(block, kind="stable")
            cuts = np.flatnonzero(np.concatenate([[True], block[by][1:] != block[by][:-1]])[:len(by)]).tolist()
            for a, b in zip(cuts, [*cuts[1:], len(by)]):
                own = by[a:b]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([int(block[own[0]])], pa.int32()),
                     pa.array([_pack(row[own], at[own], at[own] + np.int32(LENGTH))], pa.binary())],
                    names=["block", "data"])

    return lost.mapInArrow(run, SPANS)


# --- result ------------------------------------------------------------------

def merged(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The maximal runs that the spans cover."""
    by = np.argsort(lo, kind="stable")
    lo, hi = lo[by], np.maximum.accumulate(hi[by])
    new = np.concatenate([[True], lo[1:] > hi[:-1]])
    first = np.flatnonzero(new)
    return lo[first], hi[np.append(first[1:], len(lo)) - 1]


def drop_spans(blocks: DataFrame, spans: str) -> DataFrame:
    """Rows as in ``RESULT``."""
    def run(batches):
        now = None
        for block, part in _by_block(batches, 4):
            if block != now:
                got = read_block(spans, block)
                rows, lo, hi = (np.concatenate([x[k] for x in got]) if got else np.zeros(0, np.int32) for k in range(3))
                by = np.argsort(rows, kind="stable")
                rows, lo, hi, now = rows[by], lo[by].astype(np.int64), hi[by].astype(np.int64), block
            data, off = wd.buffer(part.column(4))
            row = part.column(1).to_numpy()
            first, last = np.searchsorted(rows, row), np.searchsorted(rows, row, side="right")
            out = []
            for k, (a, b) in enumerate(zip(first.tolist(), last.tolist())):
                text = data[off[k]:off[k + 1]]
                if a == b:
                    out.append((len(text), 0, 0, hashlib.sha256(text).hexdigest(), ""))
                    continue
                begin, end = merged(lo[a:b], hi[a:b])
                kept, at = hashlib.sha256(), 0
                for s, e in zip(begin.tolist(), end.tolist()):
                    kept.update(text[at:s])
                    at = e
                kept.update(text[at:])
                out.append((len(text), int((end - begin).sum()), len(begin), kept.hexdigest(),
                            ",".join(f"{s}:{e}" for s, e in zip(begin.tolist(), end.tolist()))))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [part.column(2), *(pa.array(c, t) for c, t in zip(cols, [pa.int64()] * 3 + [pa.string()] * 2))],
                names=[x.split()[0] for x in RESULT.split(", ")])

    return blocks.select("block", "row", "i", "o", "t").mapInArrow(run, RESULT)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", hot: int = HOT) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans`` (byte spans
    ``from:to``, comma-joined), a row for each row of ``docs``."""
    parts = shuffle_partitions(docs.sparkSession)
    blocks = write_blocks(docs, id_col, text_col)
    routed = stored(route_anchors(spread_anchors(blocks, parts), parts, hot), "anchors")
    routes = by_block(routed.select("block", "data"), "routes")
    spans = match_segments(cut_segments(blocks, routes, parts))
    if routed.agg(F.sum("hot")).first()[0]:
        spans = spans.unionByName(match_hot(hot_windows(blocks, routes, parts)))
    return drop_spans(blocks, by_block(spans, "spans")).withColumnRenamed("i", "doc_id")


def drop_repeats_digest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return drop_repeats(table(spark, sf_dir, "documents")).drop("spans")

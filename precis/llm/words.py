"""Word hashes of whole Arrow batches at a time.

A batch of texts is one byte buffer.  Words are the maximal runs of word bytes
(:func:`split`) or of letters, marks and digits of any script, where each
character of a script written without spaces is a word (:func:`lower_words`);
a word's hash is a polynomial over its bytes, taken as the difference of two
prefix sums, so that the cost is a few array passes per byte and no Python
object per word.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are handled at once; a longer text is handled alone.
SLICE_BYTES = 1 << 20

_BASE = 0x9E3779B97F4A7C15 | 1
_POW = {"p": np.ones(1, np.uint64), "i": np.ones(1, np.uint64)}

#: ASCII letters and digits and every byte of a non-ASCII character.
ALNUM = np.zeros(256, bool)
ALNUM[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Everything but ASCII white space.
SOLID = np.ones(256, bool)
SOLID[[9, 10, 11, 12, 13, 32]] = False


class Words(NamedTuple):
    hashes: np.ndarray   # uint64, one per word
    bounds: np.ndarray   # int64, words of text i are bounds[i]:bounds[i + 1]
    starts: np.ndarray   # byte positions in the buffer
    ends: np.ndarray

    @property
    def owner(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.bounds) - 1), np.diff(self.bounds))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POW["p"]) < n + 1:
        size = max(n + 1, SLICE_BYTES + 1)
        for k, b in (("p", _BASE), ("i", pow(_BASE, -1, 1 << 64))):
            x = np.full(size, b, np.uint64)
            x[0] = 1
            _POW[k] = np.cumprod(x)
    return _POW["p"][:n + 1], _POW["i"][:n + 1]


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser of a 64-bit hash (bijective)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x = x * np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets from 0) of a string array; null counts as empty."""
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    texts = texts.cast(pa.large_string())
    off = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset:texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, np.uint8)[off[0]:off[-1]] if data is not None and len(off) and off[-1] > off[0] \
        else np.zeros(0, np.uint8)
    return raw, off - off[0]


def prefix_hash(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(prefix sums, inverse powers): bytes s:e hash to
    ``(sums[e] - sums[s]) * inverse[s]``."""
    power, inverse = _powers(len(data))
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    return sums, inverse


#: Code points of scripts written without spaces between words.
UNSPACED = ((0x0E00, 0x0EFF), (0x0F00, 0x109F), (0x1780, 0x17FF), (0x19E0, 0x19FF), (0x1A20, 0x1AAF), (0x3005, 0x3007), (0x3021, 0x30FF),
            (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xA9E0, 0xA9FF), (0xAA60, 0xAA7F), (0xF900, 0xFAFF), (0xFF66, 0xFF9F),
            (0x1B000, 0x1B16F), (0x20000, 0x3FFFF))
_BREAK, _WORD, _SOLO = 0, 1, 2


@lru_cache(maxsize=1)
def _kinds() -> np.ndarray:
    """What each code point is: part of a word, a word of its own, or none."""
    kind = np.full(0x110000, _BREAK, np.uint8)
    for c in range(0x80, 0x110000):
        if unicodedata.category(chr(c))[0] in "LMN":
            kind[c] = _WORD
    for first, last in UNSPACED:
        own = kind[first:last + 1]
        own[own == _WORD] = _SOLO
    return kind


def _beyond_ascii(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of characters that break words, borders of one-character words)
    of valid UTF-8."""
    at = np.flatnonzero(data >= 0xC0)
    lead = data[at].astype(np.int64)
    size = 2 + (lead >= 0xE0) + (lead >= 0xF0)
    code = np.where(size == 2, lead & 0x1F, np.where(size == 3, lead & 0x0F, lead & 0x07))
    for k in range(1, 4):
        more = size > k
        code[more] = (code[more] << 6) | (data[at[more] + k] & 0x3F)
    kind = _kinds()[code]
    off = kind == _BREAK
    solo = kind == _SOLO
    return (np.concatenate([at[off & (size > k)] + k for k in range(4)]),
            np.concatenate([at[solo], at[solo] + size[solo]]))


def split(data: np.ndarray, off: np.ndarray, word_bytes: np.ndarray, scripts: bool = False) -> Words:
    """Words of the buffer; none crosses the border of two texts.  With
    ``scripts`` characters beyond ASCII count by what they are."""
    n = len(data)
    if not n:
        z = np.zeros(0, np.int64)
        return Words(np.zeros(0, np.uint64), np.zeros(len(off), np.int64), z, z)
    inside = word_bytes[data]
    first, last = inside.copy(), inside.copy()
    edge = np.zeros(n + 1, bool)
    edge[off] = True
    if scripts:
        breaks, borders = _beyond_ascii(data)
        inside[breaks] = False
        edge[borders] = True
        first, last = inside.copy(), inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:-1]
    last[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    sums, inverse = prefix_hash(data)
    h = mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))
    return Words(h, np.searchsorted(starts, off), starts, ends)


def lower_words(texts: pa.Array) -> Words:
    """Lower-cased words of letters, marks and digits."""
    return split(*buffer(pc.utf8_lower(texts)), ALNUM, True)


def shingles(words: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text index) of each run of ``k`` words within a text, in order."""
    h, n = words.hashes, len(words.hashes) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = h[:n].copy()
    for j in range(1, k):
        out = out * np.uint64(0x9DDFEA08EB382D69 | 1) + h[j:j + n]
    owner = words.owner
    whole = owner[:n] == owner[k - 1:]
    return mix(out[whole]), owner[:n][whole]


def pieces(batch: pa.RecordBatch, text: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in slices of at most ``most`` bytes of text, one row at least."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False))
    at = 0
    while at < batch.num_rows:
        done = size[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(size, done + most, side="right")))
        yield batch.slice(at, to - at)
        at = to

"""Licence scan: ordered signature rules behind a keyword prefilter.

Words are the runs of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`` of the text with A-Z
lower-cased.  Base labels are found where all words of a phrase stand
consecutively.  The method's rules (``license_rules``) are regular expressions
over the words joined by single spaces, in an order of priority.

Prefilter: every rule names gate words, one of which its matches need.  The
words of a whole batch are hashed at once and looked up among the gate words;
only texts that hold one are put together as words, and only rules of gate words
that are there run on them.  No other text reaches a regular expression.

Resolution: a detection is an interval of words.  It is dropped if it lies
inside one of a better kind, or of its own kind that is longer or, where both
are equal, of an earlier rule.  "GNU Lesser General Public License 2.1" so gives
``lgpl-2.1`` alone, although ``gpl`` matches inside it.  Intervals that overlap
without containing each other all stay.  Base labels are never dropped.

``score`` is ``1 - product of (1 - strength)`` over the distinct (label, kind)
that stay; a base label without a detection counts as an abbreviation.

Each whole text is scanned in one pass inside Arrow batches; nothing is
shuffled, and memory is bounded by a slice of texts or the longest text.

Defined results: null text counts as empty: no word, no place, empty labels, a
score of 0; repeated rows repeat; a null id stays null; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

from bisect import bisect_right
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from precis.llm import words as wd
from precis.llm.common import table
from precis.llm.license_rules import KINDS, Rule, rules

#: Base phrases and their labels (given).
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

RESULT = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, "
          "score double, detections string")
_KIND = {k: n for n, k in enumerate(KINDS)}
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class Scanner:
    """Rules with their gate words, ready for batches."""

    def __init__(self, ordered: list[Rule], phrases: dict[str, str]):
        self.rules = ordered
        by_gate: dict[str, list[int]] = {}
        for n, rule in enumerate(ordered):
            for gate in rule.gates:
                by_gate.setdefault(gate, []).append(n)
        gates = sorted(by_gate, key=lambda g: int(hashed(g)[0]))
        self.gate_hashes = np.array([int(hashed(g)[0]) for g in gates], np.uint64)
        self.gate_rules = [by_gate[g] for g in gates]
        self.some = np.zeros(1 << 16, bool)  # of the top bits of a hash
        self.some[self.gate_hashes >> np.uint64(48)] = True
        self.phrases = [(label, phrase.encode().split(b" "), hashed(phrase)) for phrase, label in phrases.items()]

    def gated(self, w: wd.Words) -> dict[int, set[int]]:
        """Text -> rules of whose gate words it holds one."""
        at = np.flatnonzero(self.some[(w.hashes >> np.uint64(48)).astype(np.int64)])
        gate = np.minimum(np.searchsorted(self.gate_hashes, w.hashes[at]), max(len(self.gate_hashes) - 1, 0))
        if not len(self.gate_hashes):
            return {}
        hit = self.gate_hashes[gate] == w.hashes[at]
        text = np.searchsorted(w.bounds, at[hit], side="right") - 1
        out: dict[int, set[int]] = {}
        for t, g in set(zip(text.tolist(), gate[hit].tolist())):
            out.setdefault(t, set()).update(self.gate_rules[g])
        return out

    def base(self, w: wd.Words, data: np.ndarray) -> dict[int, list[tuple[int, int, str]]]:
        """Text -> (first word, words, label) of each place of a phrase."""
        out: dict[int, list] = {}
        for label, parts, hashes in self.phrases:
            k = len(parts)
            at = np.flatnonzero(w.hashes[:max(len(w.hashes) - k + 1, 0)] == hashes[0])
            for j in range(1, k):
                at = at[w.hashes[at + j] == hashes[j]]
            text = np.searchsorted(w.bounds, at, side="right") - 1
            inside = at + k <= w.bounds[text + 1]
            for t, p in zip(text[inside].tolist(), at[inside].tolist()):
                if all(data[w.starts[p + j]:w.ends[p + j]].tobytes() == x for j, x in enumerate(parts)):
                    out.setdefault(t, []).append((p - int(w.bounds[t]), k, label))
        return out

    def detect(self, text: bytes, which) -> list[tuple[int, int, int]]:
        """(first word, end, rule) of each match of the rules ``which`` in a
        text of words joined by single spaces."""
        spaces = None
        out = []
        for n in sorted(which):
            for m in self.rules[n].pattern.finditer(text):
                if spaces is None:
                    spaces = np.flatnonzero(np.frombuffer(text, np.uint8) == 32)
                s, e = np.searchsorted(spaces, m.span())
                out.append((int(s), int(e) + 1, n))
        return out

    def resolve(self, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Detections that lie inside no better one, by place."""
        better = _Cover()
        left = []
        for kind in KINDS:
            own = sorted((f for f in found if self.rules[f[2]].kind == kind), key=lambda f: (f[0], -f[1], f[2]))
            reach = -1
            for f in own:  # an earlier one of its kind that ends no sooner contains it
                if f[1] > reach and not better.contains(f[0], f[1]):
                    left.append(f)
                reach = max(reach, f[1])
            better.add(own)
        return sorted(left)


class _Cover:
    """Intervals; whether one of them contains a given one."""

    def __init__(self):
        self.all: list[tuple[int, int]] = []
        self.starts: list[int] = []
        self.reach: list[int] = []

    def add(self, found: list) -> None:
        self.all = sorted(self.all + [f[:2] for f in found])
        self.starts = [s for s, _ in self.all]
        self.reach = np.maximum.accumulate([e for _, e in self.all]).tolist() if self.all else []

    def contains(self, start: int, end: int) -> bool:
        n = bisect_right(self.starts, start)
        return n > 0 and self.reach[n - 1] >= end


def hashed(phrase: str) -> np.ndarray:
    data = np.frombuffer(phrase.encode(), np.uint8)
    return wd.split(data, np.array([0, len(data)]), wd.ALNUM).hashes


def score_of(kinds: set[tuple[str, str]]) -> float:
    miss = 1.0
    for _, kind in sorted(kinds):
        miss *= 1 - KINDS[kind]
    return 1 - miss


@lru_cache(maxsize=1)
def scanner() -> Scanner:
    return Scanner(rules(), PHRASES)


def scan_texts(texts: pa.Array, scan: Scanner) -> list[tuple]:
    """The columns of ``RESULT`` after the id, one row per text."""
    data, off = wd.buffer(texts)
    data = _LOWER[data]
    w = wd.split(data, off, wd.ALNUM)
    n_words = np.diff(w.bounds).tolist()
    base, gated = scan.base(w, data), scan.gated(w)
    spaced = np.where(wd.ALNUM[data], data, np.uint8(32)) if gated else data
    rows = []
    for t in range(len(texts)):
        if t not in base and t not in gated:
            rows.append((n_words[t], 0, None, None, "", "", 0.0, ""))
            continue
        places = base.get(t, ())
        found = []
        if t in gated:
            text = b" ".join(spaced[off[t]:off[t + 1]].tobytes().split())
            found = scan.resolve(scan.detect(text, gated[t]))
        base_labels = {label for _, _, label in places}
        kinds = {(scan.rules[n].label, scan.rules[n].kind) for _, _, n in found}
        named = {label for label, _ in kinds}
        starts = [p for p, _, _ in places]
        rows.append((n_words[t], len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)),
                     ",".join(sorted(base_labels | named)), score_of(kinds | {(x, "short") for x in base_labels - named}),
                     ",".join(f"{scan.rules[n].label}:{scan.rules[n].kind}:{s}:{e}" for s, e, n in found)))
    return rows


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows as in ``RESULT``, one per row of ``docs``; ``detections`` lists
    ``label:kind:first word:end`` by place."""
    fields = [x.split() for x in RESULT.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}

    def run(batches):
        for batch in batches:
            for part in wd.pieces(batch, 1):
                columns = list(zip(*scan_texts(part.column(1), scanner())))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), *[pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields[1:])]],
                    names=[name for name, _ in fields])

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).alias("t")).mapInArrow(run, RESULT)


def license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))

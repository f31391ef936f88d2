"""Quality rules on a text's own repetition, from a suffix array of what repeats.

Only positions whose window of ``MIN_REPEAT`` code points occurs again can start a repeat that
matters, so the suffix array holds these suffixes alone. They are in lexicographic order: their first
windows are ranked by their code points, and the ranks are doubled from there. The longest common
prefix of two neighbours is read off the ranks from the longest power down to single code points.
Of the LCP intervals that hold a suffix the deepest one is that with its closer neighbour: its length
is the suffix's longest repeat, and the union of these spans is what maximal repeated substrings cover.
Everything is per text, in memory proportional to that text: some 20 arrays of 8 bytes a code point,
for one text at a time, however long it is.

Null and empty text: no words, nothing covered; it fails the base rule on length like any short text.
Rows are judged one by one: repeated rows and null ids get a row each, columns beside id and text are
neither read nor returned. Repeats of equal length: all of them count.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows

#: Code points from which on a repeat counts: a power of two.
MIN_REPEAT = 64
MAX_COVERED = 0.3
MAX_REPEAT = 2_000
MIN_WORDS = 50
SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\x0b\x0c\r"
MIX = np.uint64(0x9E3779B97F4A7C15)


def _joined(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    x = left * np.uint64(0xC2B2AE3D27D4EB4F) + right * MIX
    return x ^ (x >> np.uint64(29))


def _recurring(h: np.ndarray) -> np.ndarray:
    """Positions whose value occurs at least twice, ascending."""
    bits = max(10, int(len(h)).bit_length() + 2)
    cell = (h * MIX >> np.uint64(64 - bits)).astype(np.int64)
    some = np.flatnonzero(np.bincount(cell, minlength=1 << bits)[cell] > 1)
    if not some.size:
        return some
    _, at, n = np.unique(h[some], return_inverse=True, return_counts=True)
    return some[n[at] > 1]


@dataclass(frozen=True)
class Repeats:
    """Spans (starts, ends; disjoint, ascending) that repeated substrings cover, and the longest repeat."""

    starts: np.ndarray
    ends: np.ndarray
    longest: int

    @property
    def covered(self) -> int:
        return int((self.ends - self.starts).sum())


NOTHING = Repeats(np.zeros(0, np.int64), np.zeros(0, np.int64), 0)


def _ranks(*keys: np.ndarray) -> np.ndarray:
    """Dense ranks from 0 of rows of keys, the first key first; equal rows have one rank."""
    order = np.lexsort(keys[::-1])
    step = np.zeros(len(order), np.int64)
    for key in keys:
        held = key[order]
        step[1:] |= held[1:] != held[:-1]
    out = np.empty_like(step)
    out[order] = np.cumsum(step)
    return out


def _window_ranks(codes: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    """Lexicographic ranks of the windows of ``width`` code points at ``at``; a window that the text's end cuts comes before longer ones."""
    letters, dense = np.unique(codes, return_inverse=True)
    bits = int(len(letters)).bit_length()
    packed = np.r_[dense.astype(np.uint64) + np.uint64(1), np.zeros(width, np.uint64)]
    k = 1
    while 2 * k <= width and 2 * k * bits <= 63:
        packed = np.r_[packed[:-k] << np.uint64(k * bits) | packed[k:], np.zeros(k, np.uint64)]
        k *= 2
    return _ranks(*[packed[at + j] for j in range(0, width, k)])


def repeats(text: str, least: int = MIN_REPEAT) -> Repeats:
    """All substrings of ``least`` code points or more that occur twice in ``text``, overlapping or not."""
    n = len(text)
    if n <= least:
        return NOTHING
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    # Hashes of windows of 1, 2, 4, ... least code points; the last ones of a level are cut short.
    levels = [codes]
    while 1 << len(levels) <= least:
        k = 1 << (len(levels) - 1)
        last = levels[-1]
        levels.append(_joined(last[:-k], last[k:]))
    at = _recurring(levels[-1])
    if not at.size:
        return NOTHING
    # Ranks of the recurring positions and of those a window behind them. Where two suffixes still have equal
    # ranks, all windows so far recur, so the window behind is ranked, too.
    ranked = np.unique(np.r_[at, at[at + least < n] + least])
    recurs = np.isin(ranked, at, assume_unique=True)
    pad = n + least
    alone = -2 - np.arange(pad, dtype=np.int64)
    new, rank, k = _window_ranks(codes, ranked, least), [], least
    while True:
        # A window that isn't in the array occurs once: it equals no other.
        equal = alone.copy()
        equal[ranked[recurs]] = new[recurs]
        rank.append(equal)
        if np.bincount(new[recurs]).max() == 1 or k > n:
            break
        full = np.full(pad, -1, np.int64)
        full[ranked] = new
        new, k = _ranks(new, full[np.minimum(ranked + k, pad - 1)]), 2 * k
    suffixes = ranked[recurs][np.argsort(new[recurs], kind="stable")]
    p, q = suffixes[:-1], suffixes[1:]
    lcp = np.zeros(p.size, np.int64)
    for j in reversed(range(len(rank))):
        i, m = np.minimum(p + lcp, pad - 1), np.minimum(q + lcp, pad - 1)
        lcp += np.where(rank[j][i] == rank[j][m], least << j, 0)
    for j in reversed(range(len(levels) - 1)):
        h, i, m = levels[j], p + lcp, q + lcp
        inside = (i < h.size) & (m < h.size)
        lcp += np.where(inside & (h[np.where(inside, i, 0)] == h[np.where(inside, m, 0)]), 1 << j, 0)
    reach = np.maximum(np.r_[0, lcp], np.r_[lcp, 0])
    by_start = np.argsort(suffixes)
    starts, ends = suffixes[by_start], np.maximum.accumulate((suffixes + reach)[by_start])
    opens = np.r_[True, starts[1:] > ends[:-1]]
    return Repeats(starts[opens], ends[np.r_[opens[1:], True]], int(lcp.max(initial=0)))


def word_statistics(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.encode("utf-8", "surrogatepass").split()
    word_chars = len(text) - sum(map(text.count, SPACES))
    n_symbols = sum(map(text.count, SYMBOLS))
    lines = [line for line in text.split("\n") if line.strip(SPACES)]
    n = len(words)
    if n < 4:
        # Three words are one window; four make two.
        return n, word_chars, n_symbols, len(lines) - len(set(lines)), 0
    ids: dict[bytes, int] = {}
    w = np.fromiter((ids.setdefault(x, len(ids)) for x in words), np.uint64, n)
    m = np.uint64(len(ids))
    # Exact below two million distinct words; beyond, a hash of 64 bits.
    h = (w[:-2] * m + w[1:-1]) * m + w[2:] if len(ids) < 2_000_000 else _joined(_joined(w[:-2], w[1:-1]), w[2:])
    mark = np.zeros(n, bool)
    for k in range(3):
        mark[_recurring(h) + k] = True
    return n, word_chars, n_symbols, len(lines) - len(set(lines)), int(mark.sum())


SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, n_covered long, longest_repeat long, spans array<struct<start:long,end:long>>, kept boolean"


def judge(docs: DataFrame, max_covered: float = MAX_COVERED, max_repeat: int = MAX_REPEAT, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, word statistics, what repeats (spans in code points) and whether the row is kept.

    A row is kept if it passes the base rule, repeats cover at most ``max_covered`` of its code points
    and no repeat is longer than ``max_repeat``. No shuffle.
    """
    kind = dict(docs.dtypes)[id_col]

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            rows = []
            for text in batch.column(1).to_pylist():
                text = text or ""
                statistics, found = word_statistics(text), repeats(text)
                failed = statistics[0] < MIN_WORDS or 100 * statistics[4] > 50 * statistics[0]
                fine = found.covered <= max_covered * len(text) and found.longest <= max_repeat
                spans = [{"start": a, "end": b} for a, b in zip(found.starts.tolist(), found.ends.tolist())]
                rows.append((*statistics, failed, found.covered, found.longest, spans, fine and not failed))
            kinds = [pa.int64()] * 5 + [pa.bool_(), pa.int64(), pa.int64(), pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])), pa.bool_()]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            return pa.RecordBatch.from_arrays([batch.column(0), *columns], ["id", *[c.split(" ")[0] for c in SCHEMA.split(", ")]])

        return each

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return map_rows(rows, make, f"id {kind}, {SCHEMA}").withColumnRenamed("id", id_col)

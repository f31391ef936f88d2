"""Benchmark decontamination by templates.

Texts become templates: numbers, names (runs of title-case words inside a sentence) and units (after a number)
turn into typed placeholders, a title-case word that starts a sentence is read both as a word and as (part of) a
name, other words are lower-cased and lose punctuation at both ends. Windows of ``WINDOW`` template words are
hash-joined with those of the benchmark items; a window counts only if at least ``LITERALS`` of its words are
literal. Filters of bits, of bounded size whatever the benchmark's, tell the tasks which words and windows an
item may have; what they let through by chance joins nothing. A document holds an item if one occurrence has
``COVERAGE`` of the item's windows and fills the slots consistently: one name of the item always stands
for one and the same name, and one place of a number or unit for one and the same value (``AGREEMENT``
of the matched slots). So re-parameterised questions are caught, and chance matches of generic templates
aren't.

An occurrence is what matches around one alignment (place in the document less place in the item), give
or take ``shift()`` words put in or left out. Each alignment is tried and the best one counts, so further
copies and variants of an item, or of its template, in the same document don't blur each other.

An item, or a reading of it, that is shorter than a window is one window; an item with too few literal words has no window and is
never found. Null and empty texts have no windows. Repeated rows of an id count as one document, repeated
rows of an item as one item, but an occurrence lies in one text of each; rows with a null id are grouped
under null. Equally good occurrences and items: each item that is held is reported. Very long texts are
read whole, one at a time. Columns beside id and text aren't read. No cap on matches.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import bit_filter, holds, map_rows, may_hold, release, written
from .jaccard_join import mixed

WINDOW, LITERALS = 5, 3
COVERAGE, AGREEMENT = 0.5, 0.8
#: Bits at most of the filters of the items' windows (8 MB) and words (2 MB).
WINDOW_BITS, WORD_BITS = 1 << 26, 1 << 24
#: Stands for every word that no benchmark item has.
OTHER = 1
#: Ends a text where several are read in a row; no chunk between white space is like it.
BOUNDARY = " "
#: Chunks that are read in a row; a longer text is read alone.
CHUNKS = 1 << 17
REMEMBERED = 500_000
NUMBER = re.compile(r"[+-]?[$€£]?\d[\d.,:/]*(?:e[+-]?\d+)?(%|[a-zµ°]{1,4})?$")
UNITS = set(
    "mm cm m km in inch inches ft foot feet yd yard yards mile miles mg g kg t ton tons tonne tonnes oz lb lbs pound pounds ml l liter liters litre litres "
    "gallon gallons second seconds sec s minute minutes min hour hours hr h day days week weeks month months year years percent % dollar dollars usd euro euros "
    "eur cent cents degree degrees celsius fahrenheit kelvin k joule joules j kj watt watts w kw volt volts v ampere amperes amp a ohm ohms hz khz mhz ghz "
    "newton newtons n pascal pa kpa bar mole moles mol byte bytes kb mb gb tb mph kmh".split()
)
EDGES = ".,;:!?\"'()[]{}<>#*&|~_`“”«»…-–—/\\=+^@"
ENDS = ".!?:"
NUM, TITLE, UNIT, END = 1, 2, 4, 8
SLOTS = {NUM: np.uint64(3), TITLE: np.uint64(5), UNIT: np.uint64(7)}


class Words(dict):
    """A chunk between white space -> its hash (high 60 bits; 0: no word) and flags, of bounded size."""

    def __init__(self, vocabulary: np.ndarray | None = None):
        self.vocabulary = vocabulary.tobytes() if vocabulary is not None else None

    def __missing__(self, chunk: str) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        flags, core, plain = 0, chunk, chunk.isalpha()
        if chunk == BOUNDARY:
            value = self[chunk] = OTHER << 4 | END
            return value
        if not plain:
            bare = chunk.rstrip("#*&|~_`\"')]}>”»")
            flags = END if bare and bare[-1] in ENDS else 0
            core = chunk.strip(EDGES)
        value = 0
        if core:
            low = core.lower()
            if not plain and NUMBER.fullmatch(low):
                flags |= NUM
            elif low in UNITS:
                flags |= UNIT
            if low[0] != core[0] and len(core) > 1 and core[1:].islower():
                flags |= TITLE
            value = word_hash(low)
            if self.vocabulary is not None and not holds(self.vocabulary, value):
                value = OTHER
        value = self[chunk] = value << 4 | flags
        return value


def word_hash(low: str) -> int:
    return max(OTHER + 1, xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")) >> 4)


def text_hash(text: str) -> int:
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - 2**63


def chunks_of(text: str | None) -> list[str]:
    return (text or "").replace("\n", " . ").split()


def template(chunks: list[str], known: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Which of the chunks are words, and of these words the template hash, which are slots, which may be names
    or not (at the start of a sentence), and where the name that begins there ends (the next word for others)."""
    v = np.fromiter(map(known.__getitem__, chunks), np.uint64, len(chunks))
    flags = (v & np.uint64(15)).astype(np.int64)
    word = v >> np.uint64(4)
    starts = np.r_[True, flags[:-1] & END > 0][: len(v)]
    at = np.flatnonzero(word)
    word, flags, starts = word[at], flags[at], starts[at]
    num = flags & NUM > 0
    unit = (flags & UNIT > 0) & np.r_[False, num[:-1]][: len(at)]
    title = (flags & TITLE > 0) & ~num & ~unit
    name, either = title & ~starts, title & starts
    for kind, mark in ((NUM, num), (UNIT, unit), (TITLE, name)):
        word[mark] = SLOTS[kind]
    # A name goes on with the next title-case word, unless a comma or the like comes between.
    joined = np.zeros(len(at), bool)
    for i in np.flatnonzero(title[:-1] & name[1:] & (np.diff(at) == 1)).tolist():
        joined[i] = chunks[at[i]][-1].isalnum()
    stops = np.flatnonzero(~joined)
    end = stops[np.searchsorted(stops, np.arange(len(at)))] + 1
    return at, word, num | unit | name, either, end


def windows(word: np.ndarray, slot: np.ndarray, either: np.ndarray, end: np.ndarray, sizes: list[int] | None) -> tuple[np.ndarray, ...]:
    """Positions, hashes, sizes and readings of the windows with enough literal words; bit k of a reading: its k-th word is a name by choice.

    sizes: those to take, None: WINDOW, and readings of the whole text that are shorter.
    """
    n, least, most = len(word), LITERALS if sizes is None else min(sizes), WINDOW if sizes is None else max(sizes)
    out = [(np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    if n >= least:
        # A window with a word that no item has can't match, nor one that begins within a name.
        fit = np.r_[0, np.cumsum((word != np.uint64(OTHER)) | either)]
        inner = np.r_[False, (slot & (end > np.arange(n) + 1))[:-1]]
        first = np.flatnonzero((fit[least:] - fit[:-least] == least) & ~inner[: n - least + 1])
        at, h, slots, chosen = first, np.zeros(len(first), np.uint64), np.zeros(len(first), np.int64), np.zeros(len(first), np.int64)
        for k in range(most):
            plain, named = (at < n).nonzero()[0], (at < n).nonzero()[0]
            plain, named = plain[word[at[plain]] != np.uint64(OTHER)], named[either[at[named]]]
            p, q = at[plain], at[named]
            value = np.r_[word[p], np.full(len(q), SLOTS[TITLE], np.uint64)]
            rows = np.r_[plain, named]
            first, slots, chosen = first[rows], slots[rows] + np.r_[slot[p], np.ones(len(q), bool)], chosen[rows] | np.r_[np.zeros(len(p), np.int64), np.full(len(q), 1 << k)]
            h = mixed(h[rows] + value) + np.uint64(0x9E3779B97F4A7C15)
            at = np.r_[np.where(either[p], p + 1, end[p]), end[q]]
            some = slots <= most - LITERALS
            first, at, h, slots, chosen = first[some], at[some], h[some], slots[some], chosen[some]
            done = k + 1 - slots >= LITERALS
            if sizes is None and k + 1 < WINDOW:
                done &= (first == 0) & (at == n)
            elif sizes is not None and k + 1 not in sizes:
                continue
            out.append((first[done], h[done], np.full(done.sum(), k + 1), chosen[done]))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _runs(texts: list[str | None], together: bool) -> Iterator[tuple[list[int], list[int], list[str]]]:
    """Texts (their places, and where their chunks end) that are read in a row, with BOUNDARY behind each; one by one if not ``together``."""
    rows, ends, run = [], [], []
    for k, text in enumerate(texts):
        found = chunks_of(text)
        if rows and (not together or len(run) + len(found) > CHUNKS):
            yield rows, ends, run
            rows, ends, run = [], [], []
        run += found
        if together:
            run.append(BOUNDARY)
        rows.append(k)
        ends.append(len(run))
    if rows:
        yield rows, ends, run


def _window_rows(df: DataFrame, sizes: list[int] | None, filters: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[DataFrame, Broadcast | None]:
    """(id, copy, at, n, size, window, slots) of each window of ``df`` (id, text); copy: the text's hash, n: places of windows in an item's text.

    slots: what fills them; for items, what they are bound by: names by their value, the others by ``#`` and their place.
    sizes: those to take, None: items, WINDOW or all of a shorter reading. filters: of the windows and words to look at.
    """
    sent = df.sparkSession.sparkContext.broadcast(filters) if filters is not None else None

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        wanted, vocabulary = sent.value if sent else (None, None)
        known = Words(vocabulary)

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = batch.column(1).to_pylist()
            row, copy, position, count, length, hashes, slots = [], [], [], [], [], [], []
            for rows, ends, chunks in _runs(texts, sizes is not None):
                where, word, slot, either, end = template(chunks, known)
                at, h, size, chosen = windows(word, slot, either, end, sizes)
                n = len(np.unique(at)) if sizes is None else 0
                if wanted is not None:
                    some = np.flatnonzero(may_hold(wanted, h))
                    at, h, size, chosen = at[some], h[some], size[some], chosen[some]
                if not len(at):
                    continue
                firsts = np.searchsorted(where, [0, *ends])
                which = np.searchsorted(firsts, at, side="right") - 1
                row += [rows[k] for k in which.tolist()]
                codes = {k: text_hash(texts[rows[k]]) for k in set(which.tolist())}
                copy += [codes[k] for k in which.tolist()]
                position += (at - firsts[which]).tolist()
                count += [n] * len(at)
                length += size.tolist()
                hashes.append(h)
                for i, steps, names in zip(at.tolist(), size.tolist(), chosen.tolist(), strict=True):
                    filled = []
                    for step in range(steps):
                        to = i + 1 if either[i] and not names >> step & 1 else int(end[i])
                        if slot[i] or names >> step & 1:
                            placed = sizes is None and not either[i] and word[i] != SLOTS[TITLE]
                            filled.append(f"#{i}" if placed else " ".join(chunks[c].strip(EDGES).lower() for c in where[i:to]))
                        i = to
                    slots.append(filled)
            flat = np.concatenate(hashes).view(np.int64) if hashes else np.zeros(0, np.int64)
            ids = batch.column(0).take(pa.array(row, pa.int64()))
            return pa.RecordBatch.from_arrays([ids, pa.array(copy, pa.int64()), pa.array(position, pa.int32()), pa.array(count, pa.int64()), pa.array(length, pa.int32()), pa.array(flat), pa.array(slots, pa.list_(pa.string()))], ["id", "copy", "at", "n", "size", "window", "slots"])

        return each

    schema = StructType([df.schema["id"], *StructType.fromDDL("copy long, at int, n long, size int, window long, slots array<string>").fields])
    return map_rows(df.select("id", "text"), make, schema), sent


def _words(benchmark: DataFrame) -> DataFrame:
    """(word): the hashes of the items' words."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            words = {c.strip(EDGES).lower() for text in batch.column(0).to_pylist() for c in (text or "").split()}
            return pa.RecordBatch.from_arrays([pa.array(sorted(map(word_hash, words)), pa.int64())], ["word"])

        return each

    return map_rows(benchmark.select("text"), make, "word long").distinct()


def shift(n_windows: int) -> int:
    """Words that may be put in or left out between parts of an occurrence."""
    return max(WINDOW, n_windows // 2)


def best_occurrence(n_windows: int, hits: list[tuple[int, int, list[str], list[str]]], coverage: float, agreement: float) -> tuple[int, int, int]:
    """(n_matched, n_slots, n_agreeing) of the best occurrence of an item's text in a document's.

    hits: (place in the document, place in the item, what the item's slots are bound by, what fills them) of each
    matched window. Around each alignment, every window of the item counts at its nearest hit.
    """
    hits = sorted(hits, key=lambda x: (x[0] - x[1], x[1], len(x[2]), x[2], x[3]))
    aligned = np.array([x[0] - x[1] for x in hits])
    near, best, found = shift(n_windows), None, (0, 0, 0)
    for middle in np.unique(aligned).tolist():
        first, last = np.searchsorted(aligned, [middle - near, middle + near + 1]).tolist()
        if best is not None and best[0] and min(last - first, n_windows) < found[0]:
            continue
        nearest: dict[int, tuple[int, int]] = {}
        for k in range(first, last):
            far = abs(hits[k][0] - hits[k][1] - middle), k
            if far < nearest.get(hits[k][1], (near + 1, 0)):
                nearest[hits[k][1]] = far
        votes: dict[str, dict[str, int]] = {}
        for _, k in nearest.values():
            for key, value in zip(hits[k][2], hits[k][3], strict=True):
                some = votes.setdefault(key, {})
                some[value] = some.get(value, 0) + 1
        matched, slots, agreeing = len(nearest), sum(sum(v.values()) for v in votes.values()), sum(max(v.values()) for v in votes.values())
        held = matched >= coverage * n_windows and agreeing >= agreement * slots
        rank = held, matched, agreeing / slots if slots else 1.0
        if best is None or rank > best:
            best, found = rank, (matched, slots, agreeing)
        if held and matched == n_windows and agreeing == slots:
            break
    return found


def _occurrences(pairs: DataFrame, coverage: float, agreement: float) -> DataFrame:
    """pairs (doc, item, n_windows, hits) with the figures of their best occurrence instead of hits."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            figures = [
                best_occurrence(n, [(x["at"], x["item_at"], x["slots"], x["filled"]) for x in hits], coverage, agreement)
                for n, hits in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)
            ]
            columns = [pa.array([f[k] for f in figures], pa.int64()) for k in range(3)]
            return pa.RecordBatch.from_arrays([*batch.columns[:3], *columns], ["doc", "item", "n_windows", "n_matched", "n_slots", "n_agreeing"])

        return each

    pairs = pairs.select("doc", "item", "n_windows", "hits")
    schema = StructType([*pairs.schema.fields[:3], *StructType.fromDDL("n_matched long, n_slots long, n_agreeing long").fields])
    return map_rows(pairs, make, schema)


def matches(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text", coverage: float = COVERAGE, agreement: float = AGREEMENT) -> DataFrame:
    """(id, item, n_windows, n_matched, n_slots, n_agreeing) of each document and item that share a window, of their best occurrence."""
    return _matches(docs, benchmark, id_col, item_col, text_col, coverage, agreement, 0.0)


def _matches(docs: DataFrame, benchmark: DataFrame, id_col: str, item_col: str, text_col: str, coverage: float, agreement: float, least: float) -> DataFrame:
    """matches(), without texts of which not even all hits together cover ``least`` of the item."""
    asked = benchmark.select(F.col(item_col).alias("id"), F.col(text_col).alias("text"))
    items = written(_window_rows(asked, None)[0], "benchmark-windows")
    sizes = {WINDOW} | {r["size"] for r in items.select("size").distinct().collect()}
    words = written(_words(asked), "benchmark-words")
    hashes = items.select("window").distinct()
    filters = bit_filter(hashes, hashes.count(), WINDOW_BITS), bit_filter(words, words.count(), WORD_BITS)
    found, sent = _window_rows(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), sorted(sizes), filters)
    found = found.select(F.col("id").alias("doc"), "copy", "at", "window", F.col("slots").alias("filled"))
    keyed = items.select(F.col("id").alias("item"), F.col("copy").alias("item_copy"), F.col("at").alias("item_at"), F.col("n").alias("n_windows"), "window", "slots").distinct()
    joined = written(found.join(keyed, "window"), "benchmark-hits")
    sent.destroy()
    release(items, words)
    pairs = joined.groupBy("doc", "copy", "item", "item_copy").agg(
        F.max("n_windows").alias("n_windows"), F.count_distinct("item_at").alias("covered"), F.collect_set(F.struct("at", "item_at", "slots", "filled")).alias("hits")
    )
    judged = _occurrences(pairs.where(F.col("covered") >= least * F.col("n_windows")), coverage, agreement)
    part, same = F.col("n_matched") / F.col("n_windows"), F.when(F.col("n_slots") > 0, F.col("n_agreeing") / F.col("n_slots")).otherwise(1.0)
    figures = ["n_windows", "n_matched", "n_slots", "n_agreeing"]
    held = _held(coverage, agreement)
    best = judged.groupBy("doc", "item").agg(F.max_by(F.struct(*figures), F.struct(held, part, same, *figures)).alias("best"))
    return best.select(F.col("doc").alias(id_col), F.col("item").alias(item_col), *[F.col("best")[c].alias(c) for c in figures])


def _held(coverage: float, agreement: float) -> Column:
    return (F.col("n_matched") >= coverage * F.col("n_windows")) & (F.col("n_agreeing") >= agreement * F.col("n_slots"))


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, agreement: float = AGREEMENT, id_col: str = "doc_id", item_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """Those matches() that cover enough of the item with consistent slots."""
    return _matches(docs, benchmark, id_col, item_col, text_col, coverage, agreement, coverage).where(_held(coverage, agreement))


def clean(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", **columns: str) -> DataFrame:
    """``docs`` without contaminated documents. Rows without an id can't be named, and stay."""
    bad = contaminated(docs, benchmark, id_col=id_col, **columns).select(id_col).distinct()
    return docs.join(bad, id_col, "left_anti").select(*docs.columns)

"""Dedup of long byte substrings by a logarithmic family of sampled suffix arrays.

A byte goes if a ``LENGTH``-byte string over it also starts earlier: in a document with a smaller id, or
earlier in the same one. Strings are judged on the input and never cross documents.

Suffixes are sampled by content: of the ``GRAM``-byte grams inside a LENGTH-byte window the one with
the least hash (the leftmost of equals) is the window's anchor, so equal windows have equal anchors, and
about 1 of 19 positions is one. A suffix array's entry stands for all neighbouring windows of one
anchor: its first eight bytes, its gram's hash, the hash of all the windows' bytes, and its first owner.
Arrays are tables in buckets by these keys and sorted by them inside: by content for eight bytes and by
hash beyond, since only equality of prefixes of GRAM bytes and more counts.

Documents arrive in ``BATCHES`` batches by id. A batch's suffix array is merge-scanned (a sort-merge join
over the buckets, so that levels are neither shuffled nor sorted again) against the existing levels: what a
level owns already goes. What is left becomes a level of size one; two levels of equal size merge, bucket by
bucket, into one of twice the size, so there are never more than log2(batches) + 1. Each bucket is one file, written
in order, and is read as a sorted run. In the end a document's
entries that the levels don't own by it are those that start earlier elsewhere. Entries that share their
gram but not all bytes are told apart window by window at the end.

Grams that occur once can't match. They are left out by exact counts, through a bit filter of bounded
size, which at worst lets more of them through.

Null and empty text: zero bytes. Null ids come after all others. Rows with the same id and text are
one document; those with the same id and other text are ordered by 64 bits of hash of the text. Ids are whole
numbers. Very long texts are anchored SEGMENT bytes at a time. Columns beside id and text aren't read.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SLICE_ROWS, bit_filter, may_hold, release, written

LENGTH, GRAM = 100, 64
BATCHES = 8
LAST = 2**63 - 1
#: Bytes of a text that are anchored at a time; positions fit the low bits of the keys.
SEGMENT, POSITION_BITS = 1 << 22, 24
#: Bytes of short texts that are anchored together.
TOGETHER = 1 << 16
ENTRY = ["head", "gram", "context"]


def _hashes(data: np.ndarray) -> np.ndarray:
    """Hash of each GRAM-byte gram."""
    x = (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    k = 1
    while k < GRAM:
        x = x[:-k] * np.uint64(0xC2B2AE3D27D4EB4F) + x[k:]
        x ^= x >> np.uint64(31)
        k *= 2
    return x * np.uint64(0xD6E8FEB86659FD93)


def _nearest(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each window its anchor's position, and the hashes of all grams."""
    h = _hashes(data)
    low = np.uint64(POSITION_BITS)
    key = (h >> low << low) | np.arange(len(h), dtype=np.uint64)
    width, k, least = LENGTH - GRAM + 1, 1, key
    while 2 * k <= width:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    if k < width:
        least = np.minimum(least[: k - width], least[width - k :])
    return (least & np.uint64((1 << POSITION_BITS) - 1)).astype(np.int64), h


def anchors(texts: list[bytes]) -> tuple[np.ndarray, ...]:
    """text's place, gram hash, position, and first and last window start of each run of windows with one anchor; by text and position."""
    found: list[tuple[np.ndarray, ...]] = []

    def add(run: np.ndarray, places: np.ndarray, begins: np.ndarray, shift: int) -> None:
        """run: the bytes of some texts in a row, of places ``places``, that begin at ``begins``."""
        if len(run) < LENGTH:
            return
        at, h = _nearest(run)
        ends = np.r_[begins[1:], len(run)]
        text = np.searchsorted(begins, np.arange(len(at)), side="right") - 1
        inside = np.flatnonzero(np.arange(len(at)) + LENGTH <= ends[text])
        if not len(inside):
            return
        anchor = at[inside]
        turn = (anchor[1:] != anchor[:-1]) | (np.diff(inside) > 1)
        first, last = inside[np.r_[True, turn]], inside[np.r_[turn, True]]
        which, anchor = text[first], at[first]
        base = begins[which] - shift
        found.append((places[which], h[anchor], anchor - base, first - base, last - base))

    k = 0
    while k < len(texts):
        if len(texts[k]) > TOGETHER:
            data = np.frombuffer(texts[k], np.uint8)
            for start in range(0, max(1, len(data) - LENGTH + 1), SEGMENT):
                add(data[start : start + SEGMENT + LENGTH - 1], np.array([k]), np.array([0]), start)
            k += 1
            continue
        more, size = k, 0
        while more < len(texts) and size + len(texts[more]) <= TOGETHER:
            size += len(texts[more])
            more += 1
        sizes = np.fromiter(map(len, texts[k:more]), np.int64, more - k)
        some = np.flatnonzero(sizes)
        if len(some):
            add(np.frombuffer(b"".join(texts[k:more]), np.uint8), some + k, (np.cumsum(sizes) - sizes)[some], 0)
        k = more
    none = np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found)) if found else (none, none.astype(np.uint64), none, none, none)


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE_ROWS):
            yield batch.slice(at, SLICE_ROWS)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _grams(docs: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            gram = anchors([_bytes(t) for t in batch.column(0).to_pylist()])[1]
            yield pa.RecordBatch.from_arrays([pa.array(gram.view(np.int64))], ["gram"])

    return docs.select("text").mapInArrow(run, "gram long")


def candidates(texts: list[bytes], table: np.ndarray) -> tuple[np.ndarray, ...]:
    """Those anchors() whose gram is in the filter."""
    every = anchors(texts)
    some = np.flatnonzero(may_hold(table, every[1]))
    return tuple(x[some] for x in every)


def packed(at: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """An anchor's position, and how far before it the first and the last of its windows start: less than LENGTH - GRAM + 1, so 6 bits each. In the order of positions."""
    return at << 12 | at - lo << 6 | at - hi


def unpacked() -> tuple[Column, Column, Column]:
    """Position, first and last window start from the column place."""
    at = F.shiftright("place", 12)
    return tuple(c.cast("int") for c in (at, at - F.shiftright("place", 6).bitwiseAND(F.lit(63)), at - F.col("place").bitwiseAND(F.lit(63))))


def _entries(docs: DataFrame, sent: Broadcast) -> DataFrame:
    """(head, gram, context, doc, th, place): anchors whose gram may repeat; place: see packed()."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = sent.value
        for batch in _slices(batches):
            texts = [_bytes(t) for t in batch.column(2).to_pylist()]
            text, gram, at, lo, hi = candidates(texts, table)
            rows = list(zip(text.tolist(), lo.tolist(), hi.tolist(), at.tolist()))
            contexts = [xxhash.xxh3_64_intdigest(texts[k][a : b + LENGTH], c - a) for k, a, b, c in rows]
            # Big-endian with the first bit turned, so that numbers are in the order of bytes.
            heads = np.frombuffer(b"".join([texts[k][c : c + 8] for k, _, _, c in rows]), ">u8").astype(np.uint64) ^ np.uint64(1 << 63)
            doc, th = batch.column(0).to_numpy()[text], batch.column(1).to_numpy()[text]
            arrays = [heads.view(np.int64), gram.view(np.int64), np.array(contexts, np.uint64).view(np.int64), doc, th, packed(at, lo, hi)]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, arrays)), [*ENTRY, *OWNER])

    return docs.select("doc", "th", "text").mapInArrow(run, "head long, gram long, context long, doc long, th long, place long")


OWNER = ["doc", "th", "place"]
#: Whether bucketed tables are read in the order of their files.
RUNS = "spark.sql.legacy.bucketedTableScan.outputOrdering"


class SuffixIndex:
    """Levels of entries with their owners, each with its size in batches; no entry is in two. Documents have to come in order."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.buckets = int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.levels: list[tuple[int, str]] = []

    def level(self, rows: DataFrame) -> str:
        """Entries written as one sorted run a bucket."""
        name = f"suffix_level_{uuid.uuid4().hex}"
        rows.write.bucketBy(self.buckets, *ENTRY).sortBy(*ENTRY).saveAsTable(name)
        return name

    @contextmanager
    def sorted_runs(self) -> Iterator[None]:
        """While this holds, Spark relies on the order of a bucket's only file."""
        held = self.spark.conf.get(RUNS)
        self.spark.conf.set(RUNS, "true")
        try:
            yield
        finally:
            self.spark.conf.set(RUNS, held)

    def insert(self, batch: DataFrame) -> None:
        """Add the suffix array of a batch's entries, without what the levels own."""
        with self.sorted_runs():
            self._insert(batch)

    def _insert(self, batch: DataFrame) -> None:
        array = batch.groupBy(*ENTRY).agg(F.min(F.struct(*OWNER)).alias("owner"))
        for _, name in self.levels:
            array = array.join(self.spark.table(name).select(*ENTRY).hint("merge"), ENTRY, "left_anti")
        size, name = 1, self.level(array)
        while self.levels and self.levels[-1][0] == size:
            _, other = self.levels.pop()
            merged = self.level(self.merged(other, name))
            self.drop(other, name)
            size, name = 2 * size, merged
        self.levels.append((size, name))

    def merged(self, one: str, two: str) -> DataFrame:
        """Two levels as one, each entry with its owner; no entry is in both."""
        joined = self.spark.table(one).hint("merge").join(self.spark.table(two).withColumnRenamed("owner", "second"), ENTRY, "full")
        return joined.select(*ENTRY, F.coalesce("owner", "second").alias("owner"))

    def owners(self) -> DataFrame:
        """Each entry's first owner."""
        every = self.spark.table(self.levels[0][1])
        for _, name in self.levels[1:]:
            every = every.unionByName(self.spark.table(name))
        return every.select("gram", "owner.*")

    def drop(self, *names: str) -> None:
        for name in names:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")


def _windows(docs: DataFrame, index: SuffixIndex) -> DataFrame:
    """(doc, th, lo, hi): windows of first owners that another first owner with the same gram has earlier."""
    owners = index.owners()
    several = owners.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("gram")
    # Copies of a whole context are settled; only grams with several contexts are doubtful.
    doubtful = owners.join(several, "gram", "left_semi")
    _, lo, hi = unpacked()
    asked = written(doubtful.groupBy("doc", "th").agg(F.collect_list(F.struct(lo.alias("lo"), hi.alias("hi"))).alias("runs")), "suffix-asked")
    texts = docs.select("doc", "th", "text").join(asked, ["doc", "th"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            for doc, th, text, runs in zip(*(batch.column(k).to_pylist() for k in range(4))):
                data = _bytes(text)
                starts = np.concatenate([np.arange(r["lo"], r["hi"] + 1) for r in runs])
                both = np.frombuffer(b"".join([xxhash.xxh3_128_digest(data[s : s + LENGTH]) for s in starts.tolist()]), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1]), pa.array(np.full(len(starts), doc)), pa.array(np.full(len(starts), th)), pa.array(starts.astype(np.int32))], ["w1", "w2", "doc", "th", "at"])

    windows = texts.mapInArrow(run, "w1 long, w2 long, doc long, th long, at int")
    # What a window's first owner keeps; all other windows of these runs go.
    kept = windows.groupBy("w1", "w2").agg(F.min(F.struct("doc", "th", "at")).alias("first")).select("first.*")
    kept = kept.groupBy("doc", "th").agg(F.collect_list("at").alias("kept"))
    told = written(asked.join(kept, ["doc", "th"], "left"), "suffix-told")
    release(asked)
    return told


def dedup(docs: DataFrame, batches: int = BATCHES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, kept (the bytes that stay), n_bytes, removed (maximal removed runs: start, end)."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc"), F.col(text_col).alias("text"))
    # Rows of one id (or without any) are told apart by 64 bits of their texts.
    rows = rows.withColumn("th", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    repeated = written(_grams(rows).groupBy("gram").count().where("count > 1").select("gram"), "suffix-grams")
    sent = docs.sparkSession.sparkContext.broadcast(bit_filter(repeated, repeated.count()))
    release(repeated)
    cuts = rows.where(F.col("doc") < LAST).agg(*[F.percentile_approx("doc", k / batches, 1000).alias(f"c{k}") for k in range(1, batches)], F.count(F.lit(1))).first()
    batch = sum(((F.col("doc") > F.lit(cuts[k] if cuts[k] is not None else 0)).cast("int") for k in range(batches - 1)), F.lit(0))
    entries = written(_entries(rows, sent).withColumn("batch", batch), "suffix-entries", "batch")
    index = SuffixIndex(docs.sparkSession)
    for k in range(batches):
        index.insert(entries.where(F.col("batch") == k).drop("batch"))
    release(entries)
    told = _windows(rows, index)
    at, _, _ = unpacked()
    owned = index.owners().groupBy("doc", "th").agg(F.collect_list(at).alias("owned"))
    marks = written(owned.join(told, ["doc", "th"], "full"), "suffix-marks")
    release(told)
    index.drop(*(name for _, name in index.levels))
    joined = rows.join(marks, ["doc", "th"], "left").select("id", "text", "owned", "runs", "kept")
    kind = dict(rows.dtypes)["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _slices(batches):
            out = []
            texts = [_bytes(t) for t in batch.column(1).to_pylist()]
            text, _, *runs_of = candidates(texts, sent.value)
            cuts = np.searchsorted(text, np.arange(1, len(texts)))
            of_text = zip(*(np.split(x, cuts) for x in runs_of))
            for data, (at, lo, hi), owned, runs, kept in zip(texts, of_text, *(batch.column(k).to_pylist() for k in range(2, 5))):
                lost = ~np.isin(at, owned or [])
                if not lost.any() and not runs:
                    out.append((data, len(data), []))
                    continue
                gone = np.zeros(len(data) + 1, bool)
                for a, b in (*zip(lo[lost].tolist(), hi[lost].tolist()), *((r["lo"], r["hi"]) for r in runs or ())):
                    gone[a : b + 1] = True
                if kept:
                    gone[np.asarray(kept)] = False
                edge = np.zeros(len(data) + LENGTH + 1, np.int32)
                starts = np.flatnonzero(gone)
                edge[starts] += 1
                edge[starts + LENGTH] -= 1
                bare = np.cumsum(edge[: len(data)]) > 0
                turn = np.flatnonzero(np.diff(np.r_[False, bare, False].astype(np.int8)))
                spans = [{"start": a, "end": b} for a, b in turn.reshape(-1, 2).tolist()]
                out.append((np.frombuffer(data, np.uint8)[~bare].tobytes(), len(data), spans))
            span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([o[0] for o in out], pa.binary()), pa.array([o[1] for o in out], pa.int64()), pa.array([o[2] for o in out], span)], ["id", "kept", "n_bytes", "removed"])

    done = joined.mapInArrow(run, f"id {kind}, kept binary, n_bytes long, removed array<struct<start:long,end:long>>")
    return done.withColumnRenamed("id", id_col)

"""Reversible line dedup: sharded cuckoo filters backed by exact reference counts.

A line's key is the line without ASCII white space at both ends, A-Z lower-cased; keys of fewer than
``MIN_KEY`` code points are left alone. The index has, as shared tables,

* references: one row (h1, h2, doc_id) for each key and document that holds it (h1, h2: 128-bit hash);
* counts: per key the exact number of documents and the smallest doc_id;
* filters: per shard a cuckoo filter of the keys that have a count.

An inserted batch is first aggregated by key, so a line in every document is one row. Each shard's
new keys are tested against its filter: what the filter has never seen is new for certain and is
appended; only possible hits meet the exact counts. Deleting documents lowers the counts of their
keys; keys without references leave the counts and, as cuckoo filters can, the filters. The result
of any row of insertions and deletions is that of indexing the documents that are left.

A line is dropped if its key has references from two documents or more and its document isn't the
one with the smallest doc_id. Null doc_id: such rows count as one document after all others. Rows
with the same doc_id are one document. Null and empty text is one empty line. No cap anywhere.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_rows, written

MIN_KEY = 10
#: Keys that a shard is sized for, with the filter's slots; a shard is one task's work.
SHARD_KEYS = 200_000
SLOTS = 4
#: Stands for a null doc_id.
LAST = 2**63 - 1
KEY = ["h1", "h2"]


def keys_of(text: str | None) -> list[bytes | None]:
    """For each line the 16-byte hash of its key, None where the key is too short."""
    found: list[bytes | None] = []
    for line in (text or "").encode().split(b"\n"):
        key = line.strip().lower()
        long = len(key) >= 4 * MIN_KEY or len(key) >= MIN_KEY and len(key.decode()) >= MIN_KEY
        found.append(hashlib.blake2b(key, digest_size=16).digest() if long else None)
    return found


def references(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(h1, h2, doc_id): each key of each row once."""

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [{k for k in keys_of(text) if k} for text in batch.column(1).to_pylist()]
            halves = np.frombuffer(b"".join(k for s in sets for k in s), "<i8").reshape(-1, 2)
            ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), [len(s) for s in sets])
            return pa.RecordBatch.from_arrays([pa.array(halves[:, 0]), pa.array(halves[:, 1]), pa.array(ids)], ["h1", "h2", "doc_id"])

        return each

    rows = docs.select(F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_id"), F.col(text_col).alias("text"))
    return map_rows(rows, make, "h1 long, h2 long, doc_id long")


class Cuckoo:
    """A cuckoo filter with 16-bit fingerprints, four to a bucket; arrays in, arrays out."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.mask = np.uint64(len(table) - 1)

    @staticmethod
    def empty(keys: int) -> Cuckoo:
        buckets = 1 << max(4, int(np.ceil(np.log2(max(1, keys) / SLOTS / 0.85))))
        return Cuckoo(np.zeros((buckets, SLOTS), np.uint16))

    @staticmethod
    def load(data: bytes) -> Cuckoo:
        return Cuckoo(np.frombuffer(data, np.uint16).reshape(-1, SLOTS).copy())

    def dump(self) -> bytes:
        return self.table.tobytes()

    def places(self, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fingerprints and first buckets, from the second half of the keys' hashes."""
        bits = h2.view(np.uint64)
        return (bits >> np.uint64(48)).astype(np.uint16) | np.uint16(1), bits & self.mask

    def other(self, prints: np.ndarray, at: np.ndarray) -> np.ndarray:
        return at ^ ((prints.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(20)) & self.mask)

    def has(self, h2: np.ndarray) -> np.ndarray:
        prints, at = self.places(h2)
        one, two = (self.table[x.astype(np.int64)] == prints[:, None] for x in (at, self.other(prints, at)))
        return one.any(1) | two.any(1)

    def add(self, h2: np.ndarray) -> bool:
        """False if the table is too full: the caller builds a larger one."""
        prints, at = self.places(h2)
        table, turn = self.table, 0
        for _ in range(500):
            if not len(prints):
                return True
            at = at.astype(np.int64)
            order = np.argsort(at, kind="stable")
            prints, at = prints[order], at[order]
            first = np.r_[True, at[1:] != at[:-1]]
            rank = np.arange(len(at)) - np.maximum.accumulate(np.where(first, np.arange(len(at)), 0))
            free = np.argsort(table[at] != 0, axis=1, kind="stable")
            fits = rank < (table[at] == 0).sum(1)
            table[at[fits], free[fits, rank[fits]]] = prints[fits]
            prints, at, first = prints[~fits], at[~fits], first[~fits]
            # One key of each full bucket changes places with a resident; the others try their other bucket.
            kicks = np.r_[True, at[1:] != at[:-1]] if len(at) and turn % 2 else np.zeros(len(at), bool)
            slot = (turn // 2) % SLOTS
            out = table[at[kicks], slot].copy()
            table[at[kicks], slot] = prints[kicks]
            prints[kicks] = out
            at = self.other(prints, at.astype(np.uint64))
            turn += 1
        return not len(prints)

    def remove(self, h2: np.ndarray) -> None:
        prints, at = self.places(h2)
        for p, a, b in zip(prints.tolist(), at.tolist(), self.other(prints, at).tolist()):
            for x in (a, b):
                if (hit := np.flatnonzero(self.table[x] == p)).size:
                    self.table[x, hit[0]] = 0
                    break


def _remember(old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
    """A shard's filter with ``keys`` added; b"" if it is full."""
    if not len(keys) or not len(data := old["cuckoo"].iloc[0]):
        return old
    cuckoo = Cuckoo.load(data)
    fits = cuckoo.add(keys["h2"].to_numpy(np.int64))
    return old.assign(cuckoo=[cuckoo.dump() if fits else b""], n_keys=old["n_keys"] + len(keys))


@dataclass(frozen=True)
class LineIndex:
    """The tables of one state of the index; insert() and delete() return the next state."""

    references: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int

    @staticmethod
    def create(spark: SparkSession, expected_keys: int) -> LineIndex:
        """An empty index. ``expected_keys`` sizes the shards; more keys only make them larger."""
        return LineIndex(
            spark.createDataFrame([], "h1 long, h2 long, doc_id long"),
            spark.createDataFrame([], "h1 long, h2 long, n_docs long, first_doc long"),
            spark.createDataFrame([], "shard int, cuckoo binary, n_keys long"),
            max(12, -(-expected_keys // SHARD_KEYS)),
        )

    def shard(self):
        return F.pmod(F.col("h1"), F.lit(self.shards)).cast("int")

    def insert(self, refs: DataFrame) -> LineIndex:
        """Add references of documents that the index doesn't hold yet."""
        refs = refs.select(*KEY, "doc_id")
        batch = refs.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))

        def probe(old: pd.DataFrame, new: pd.DataFrame) -> pd.DataFrame:
            shard = int(old["shard"].iloc[0] if len(old) else new["shard"].iloc[0])
            h2 = new["h2"].to_numpy(np.int64)
            held = int(old["n_keys"].iloc[0]) if len(old) else 0
            cuckoo = Cuckoo.load(old["cuckoo"].iloc[0]) if len(old) else Cuckoo.empty(max(len(h2), 16))
            seen = cuckoo.has(h2)
            if len(old) == 0 or held + int((~seen).sum()) <= 0.85 * cuckoo.table.size:
                full = not cuckoo.add(h2[~seen])
            else:
                full = True
            rows = new[["shard", "h1", "h2", "n_docs", "first_doc"]].assign(seen=seen, cuckoo=None)
            # A filter that is full is left out, and built anew from the exact counts by the caller.
            last = pd.DataFrame({"shard": [shard], "h1": [0], "h2": [0], "n_docs": [held + int((~seen).sum())], "first_doc": [0], "seen": [False], "cuckoo": [b"" if full else cuckoo.dump()]})
            return pd.concat([rows, last]) if len(rows) else last

        schema = "shard int, h1 long, h2 long, n_docs long, first_doc long, seen boolean, cuckoo binary"
        probed = self.filters.groupBy("shard").cogroup(batch.withColumn("shard", self.shard()).groupBy("shard")).applyInPandas(probe, schema)
        probed = written(probed, "lines-probed")
        found = probed.where("cuckoo is null")
        fresh = found.where("not seen").select(*KEY, "n_docs", "first_doc")
        hits = found.where("seen").select(*KEY, "n_docs", "first_doc")
        old, missed = self.counts, None
        if old.isEmpty():
            counts = hits
        else:
            touched = hits.select(*KEY, F.col("n_docs").alias("more"), F.col("first_doc").alias("other"))
            both = old.join(touched, KEY, "full")
            counts = both.select(*KEY, (F.coalesce("n_docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n_docs"), F.least("first_doc", "other").alias("first_doc"))
            missed = hits.join(old, KEY, "left_anti").withColumn("shard", self.shard())
        counts = written(counts.unionByName(fresh), "lines-counts")
        built = probed.where("cuckoo is not null").select("shard", "cuckoo", F.col("n_docs").alias("n_keys"))
        if missed is not None:
            # Hits that the exact counts deny share a fingerprint with another key; they need their own, for deletions.
            built = written(built.groupBy("shard").cogroup(missed.groupBy("shard")).applyInPandas(_remember, "shard int, cuckoo binary, n_keys long"), "lines-filters")
        kept = replace(self, references=self.references.unionByName(refs), counts=counts, filters=built)
        full = built.where("length(cuckoo) = 0").select("shard")
        return kept.rebuilt(full) if full.head(1) else kept

    def rebuilt(self, shards: DataFrame) -> LineIndex:
        """Filters of ``shards`` built from the exact counts, with room for twice their keys."""

        def build(rows: pd.DataFrame) -> pd.DataFrame:
            h2, room = rows["h2"].to_numpy(np.int64), 2 * len(rows)
            while not (cuckoo := Cuckoo.empty(room)).add(h2):
                room *= 2
            return pd.DataFrame({"shard": [int(rows["shard"].iloc[0])], "cuckoo": [cuckoo.dump()], "n_keys": [len(h2)]})

        new = self.counts.withColumn("shard", self.shard()).join(shards, "shard", "left_semi").groupBy("shard").applyInPandas(build, "shard int, cuckoo binary, n_keys long")
        return replace(self, filters=written(self.filters.join(shards, "shard", "left_anti").unionByName(new), "lines-filters"))

    def delete(self, doc_ids: DataFrame) -> LineIndex:
        """Take the documents of the column doc_id out again."""
        gone = self.references.join(doc_ids.select(F.col("doc_id").cast("long")).distinct(), "doc_id", "left_semi")
        left = written(self.references.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti").select(*KEY, "doc_id"), "lines-references")
        changed = gone.select(*KEY).distinct()
        again = left.join(changed, KEY, "left_semi").groupBy(*KEY).agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))
        again = written(again, "lines-recounted")
        dead = changed.join(again, KEY, "left_anti").withColumn("shard", self.shard())
        counts = written(self.counts.join(changed, KEY, "left_anti").unionByName(again), "lines-counts")

        def forget(old: pd.DataFrame, keys: pd.DataFrame) -> pd.DataFrame:
            if not len(old) or not len(keys):
                return old
            cuckoo = Cuckoo.load(old["cuckoo"].iloc[0])
            cuckoo.remove(keys["h2"].to_numpy(np.int64))
            return old.assign(cuckoo=[cuckoo.dump()], n_keys=old["n_keys"] - len(keys))

        filters = self.filters.groupBy("shard").cogroup(dead.groupBy("shard")).applyInPandas(forget, "shard int, cuckoo binary, n_keys long")
        return replace(self, references=left, counts=counts, filters=written(filters, "lines-filters"))

    def drops(self) -> DataFrame:
        """(doc_id, drop): the keys that each document loses, as 16-byte hashes joined together."""
        repeated = self.counts.where("n_docs >= 2").select(*KEY, "first_doc")
        lost = self.references.join(repeated, KEY).where("doc_id <> first_doc")
        return lost.groupBy("doc_id").agg(F.collect_list(F.struct(*KEY)).alias("drop"))


def strip(docs: DataFrame, index: LineIndex, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with text as it is kept, n_lines (before) and n_dropped; columns of these names are replaced."""
    names = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    packed = F.struct(*[F.col(c) for c in names if c != text_col])
    held = docs.select(packed.alias("rest"), F.col(text_col).alias("text"), F.coalesce(F.col(id_col).cast("long"), F.lit(LAST)).alias("doc_id"))
    joined = held.join(index.drops(), "doc_id", "left").select("rest", "text", "drop")
    schema = joined.select("rest", "text").schema

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, n_lines, n_dropped = [], [], []
            for text, drop in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                lines = (text or "").split("\n")
                lost: set[bytes] = {np.array([k["h1"], k["h2"]], "<i8").tobytes() for k in drop or ()}
                kept = [line for line, key in zip(lines, keys_of(text)) if key not in lost] if lost else lines
                texts.append("\n".join(kept) if lost else text)
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(kept))
            columns = [batch.column(0), pa.array(texts, pa.string()), pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["rest", "text", "n_lines", "n_dropped"])

        return each

    schema = schema.add("n_lines", "long").add("n_dropped", "long")
    done = map_rows(joined, make, schema)
    return done.select(*[F.col("text").alias(c) if c == text_col else F.col(f"rest.`{c}`").alias(c) for c in names], "n_lines", "n_dropped")


def dedup(docs: DataFrame, batches: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Index ``docs`` in batches, then strip() them. The batches only bound what one insertion holds."""
    refs = references(docs, id_col, text_col).withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches)))
    refs = written(refs.dropDuplicates([*KEY, "doc_id"]), "lines-references")
    index = LineIndex.create(docs.sparkSession, refs.count())
    for k in range(batches):
        index = index.insert(refs.where(F.col("batch") == k))
    return strip(docs, replace(index, references=refs.select(*KEY, "doc_id")), id_col, text_col)

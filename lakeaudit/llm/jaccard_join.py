"""N-gram Jaccard self-join by vertical partitioning, down to components of linked documents.

Documents with the same set of n-grams are one class. All n-grams have one global order, rare ones
first: by how many documents hold an n-gram (from a counting sketch of fixed size over all
documents, on a logarithmic scale; clashes only change the order, never the result), then by hash. That
order is cut into fragments, vertically through every document.

Candidates: two linked classes share an n-gram among the rarest of both (their prefixes), no later than
their threshold allows, and pass the length and position bounds. Prefix n-grams that one class alone has
are found by an exact count, and left out of the postings through a bit filter of bounded size, which
at worst lets more of them through. For each n-gram that is left, first the class where it stands
earliest is paired with all others; classes that end up in different components are then paired
completely, a large n-gram's classes in parts. So a group of n linked near copies costs about n pairs,
and no link is lost.

Before any n-gram is fetched, the counts of both sets in BINS hash bins bound a pair's overlap: it can't
exceed the sum of the smaller counts.

Verification: for each pair and fragment the partial overlap is counted by itself, and the overlaps
are summed per pair.

Null, empty and blank texts have no n-grams and no links. A text with fewer words than n is one n-gram.
Null ids: such rows take part, but give no component its name. Ties and repeated rows share a class.
Very long texts are read whole, one slice of rows at a time. Columns beside id and text aren't read.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from .common import SLICE_ROWS, bit_filter, map_rows, may_hold, release, salted_join, written
from .graph import components

#: Bins by whose counts pairs are bounded before their n-grams are fetched.
BINS = 64
#: Cells of the sketch, and pieces in which it travels. A task counts to 255, so that its piece of a cell is a byte.
CELL_BITS, PIECES = 22, 64
CELLS = 1 << CELL_BITS
FRAGMENTS = 4
#: Levels of the logarithmic scale a doubling of the count.
STEPS = 256
#: Classes of one n-gram that are paired with all others of it in one part.
PART = 2_000
#: Words that a task remembers.
REMEMBERED = 500_000
CLS = StructType([StructField("h1", LongType()), StructField("h2", LongType())])


class WordIds(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingles(texts: Sequence[str | None], n: int, known: WordIds) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word n-grams; A-Z are lower-cased, words end at ASCII white space."""
    words = [(text or "").encode("utf-8", "surrogatepass").lower().split() for text in texts]
    sizes = list(map(len, words))
    ids = np.fromiter(map(known.__getitem__, chain.from_iterable(words)), np.uint64, sum(sizes))

    def hashed(run: np.ndarray, size: int) -> np.ndarray:
        h = np.full(max(0, len(run) - size + 1), size, np.uint64)
        for k in range(size):
            h = mixed(h + run[k : k + len(h)]) + np.uint64(0x9E3779B97F4A7C15)
        return h

    # Windows over two texts are hashed, too, but lie in none's slice.
    every, out, at = hashed(ids, n), [], 0
    for size in sizes:
        found = np.sort(every[at : at + size - n + 1]) if size >= n else hashed(ids[at : at + size], size) if size else ids[:0]
        out.append(found[np.r_[True, found[1:] != found[:-1]]] if len(found) else found)
        at += size
    return out


def classes_of(sets: Sequence[np.ndarray]) -> pa.Array:
    """128 bits of each set of n-grams."""
    flat = np.frombuffer(b"".join(xxhash.xxh3_128_digest(grams.tobytes()) for grams in sets), "<i8").reshape(-1, 2)
    return pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["h1", "h2"])


def lists_of(arrays: Sequence[np.ndarray]) -> pa.Array:
    """Arrays of n-grams as one list each."""
    flat = np.concatenate([*arrays, np.zeros(0, np.uint64)]).view(np.int64)
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, arrays)]), pa.int32()), pa.array(flat))


def cells(grams: np.ndarray) -> np.ndarray:
    return (grams >> np.uint64(64 - CELL_BITS)).astype(np.int64)


@dataclass(frozen=True)
class Order:
    """The global order of n-grams, by the level of their cell's count, and where it is cut."""

    levels: np.ndarray
    cuts: np.ndarray

    @staticmethod
    def of(levels: np.ndarray) -> Order:
        cells_at = np.bincount(levels, minlength=2**16)
        share = np.cumsum(cells_at * (2.0 ** (np.arange(2**16) / STEPS) - 1))
        return Order(levels, np.searchsorted(share, share[-1] * np.arange(1, FRAGMENTS) / FRAGMENTS))

    def sort(self, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The n-grams (ascending), rare ones first, and their levels."""
        level = self.levels[cells(grams)]
        order = np.argsort(level, kind="stable")
        return grams[order], level[order]


def members(docs: DataFrame, n: int) -> tuple[DataFrame, Order]:
    """(id, n_grams, cls, bins) of each row of ``docs`` (id, text), and the order of n-grams over all rows."""
    names = ["id", "n_grams", "cls", "piece", "counts", "bins"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sketch, id_type = WordIds(), np.zeros(CELLS, np.int32), None
        for batch in batches:
            id_type = batch.column(0).type
            for at in range(0, batch.num_rows, SLICE_ROWS):
                part = batch.slice(at, SLICE_ROWS)
                sets, rows = shingles(part.column(1).to_pylist(), n, known), part.num_rows
                sizes = np.fromiter(map(len, sets), np.int64, rows)
                flat = np.concatenate(sets)
                np.add.at(sketch, cells(flat), 1)
                bins = np.bincount(np.repeat(np.arange(rows), sizes) * BINS + (flat & np.uint64(BINS - 1)).astype(np.int64), minlength=rows * BINS)
                bins = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1) * BINS, pa.int32()), pa.array(bins.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), classes_of(sets), pa.nulls(rows, pa.int32()), pa.nulls(rows, pa.binary()), bins], names)
        if id_type is not None:
            parts = [p.tobytes() for p in np.split(np.minimum(sketch, 255).astype(np.uint8), PIECES)]
            none = pa.StructArray.from_arrays([pa.nulls(PIECES, pa.int64())] * 2, ["h1", "h2"])
            yield pa.RecordBatch.from_arrays([pa.nulls(PIECES, id_type), pa.nulls(PIECES, pa.int64()), none, pa.array(range(PIECES), pa.int32()), pa.array(parts, pa.binary()), pa.nulls(PIECES, pa.list_(pa.int32()))], names)

    schema = StructType([StructField("id", docs.schema["id"].dataType), *StructType.fromDDL("n_grams long").fields, StructField("cls", CLS), *StructType.fromDDL("piece int, counts binary, bins array<int>").fields])
    both = written(docs.select("id", "text").mapInArrow(run, schema), "jaccard-members")

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(CELLS // PIECES, np.int64)
        for batch in batches:
            for data in batch.column("counts"):
                total += np.frombuffer(data.as_py(), np.uint8)
        levels = np.minimum(np.log2(1 + total) * STEPS, 2**16 - 1).astype("<u2")
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([levels.tobytes()], pa.binary())], ["piece", "levels"])

    # PIECES rows of a fixed size come to the driver, whatever the data.
    pieces = both.where("piece is not null").select("piece", "counts").groupBy("piece").applyInArrow(add, "piece int, levels binary")
    levels = np.zeros((PIECES, CELLS // PIECES), np.uint16)
    for row in pieces.collect():
        levels[row["piece"]] = np.frombuffer(row["levels"], "<u2")
    return both.where("piece is null").select("id", "n_grams", "cls", "bins"), Order.of(levels.reshape(-1))


def prefixes(docs: DataFrame, n: int, sent: Broadcast, part: int, whole: int) -> DataFrame:
    """(cls, n_grams, grams): the rarest n-grams of each row's class, in order."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        known, order = WordIds(), sent.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            sets = [s for s in shingles(batch.column(0).to_pylist(), n, known) if len(s)]
            first = [order.sort(s)[0][: len(s) - -(-part * len(s) // whole) + 1] for s in sets]
            return pa.RecordBatch.from_arrays([classes_of(sets), pa.array(map(len, sets), pa.int64()), lists_of(first)], ["cls", "n_grams", "grams"])

        return each

    schema = StructType([StructField("cls", CLS), *StructType.fromDDL("n_grams long, grams array<long>").fields])
    return map_rows(docs.select("text"), make, schema)


def postings(prefix: DataFrame, shared: Broadcast) -> DataFrame:
    """(gram, cls, place) of the prefix n-grams that the filter ``shared`` may hold; place packs position (high) and set size (low)."""

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        table = shared.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            lists = batch.column(2)
            ends, flat = lists.offsets.to_numpy().astype(np.int64), lists.values.to_numpy()
            flat, ends = flat[ends[0] : ends[-1]], ends - ends[0]
            row = np.repeat(np.arange(len(lists)), np.diff(ends))
            some = np.flatnonzero(may_hold(table, flat.view(np.uint64)))
            row, position = row[some], some - ends[row[some]]
            places = position << 32 | batch.column(1).to_numpy()[row]
            return pa.RecordBatch.from_arrays([pa.array(flat[some]), batch.column(0).take(pa.array(row)), pa.array(places)], ["gram", "cls", "place"])

        return each

    schema = StructType([StructField("gram", LongType()), StructField("cls", CLS), StructField("place", LongType())])
    return map_rows(prefix.select("cls", "n_grams", "grams"), make, schema)


def position(place: str) -> Column:
    return F.shiftright(place, 32)


def size(place: str) -> Column:
    return F.col(place).bitwiseAND(F.lit(2**32 - 1))


def possible(a: str, b: str, part: int, whole: int) -> Column:
    """Length and position bounds of two classes' places at the first n-gram that they share."""
    shorter, longer = F.least(size(a), size(b)), F.greatest(size(a), size(b))
    most = F.least(size(a) - position(a), size(b) - position(b))
    return (shorter * whole >= longer * part) & (most * (whole + part) >= (size(a) + size(b)) * part)


def bounded(part: int, whole: int) -> Column:
    """Bound of the overlap of two classes by the counts x and y of their bins; n_a and n_b are their sizes."""
    most = F.aggregate(F.zip_with("x", "y", lambda p, q: F.least(p, q)), F.lit(0), lambda total, k: total + k)
    return most * (whole + part) >= (F.col("n_a") + F.col("n_b")) * part


def verified(pairs: DataFrame, docs: DataFrame, classes: DataFrame, n: int, sent: Broadcast, part: int, whole: int) -> DataFrame:
    """Those of ``pairs`` (a, b: classes, n_a, n_b; written) whose similarity reaches the threshold.

    The n-grams of the pairs' classes come from one row of each: its id is in a bit filter of bounded size.
    Texts that this lets through by chance are read, too, but join nothing.
    """
    needed = pairs.select(F.col("a").alias("cls")).unionByName(pairs.select(F.col("b").alias("cls"))).distinct()
    hashes = written(needed.join(classes, "cls").select(F.xxhash64("id").alias("h")), "jaccard-needed")
    wanted = docs.sparkSession.sparkContext.broadcast(bit_filter(hashes, hashes.count()))

    def make() -> Callable[[pa.RecordBatch], pa.RecordBatch]:
        known, order, table = WordIds(), sent.value, wanted.value

        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            some = np.flatnonzero(may_hold(table, batch.column(0).to_numpy().view(np.uint64)))
            sets = [s for s in shingles(batch.column(1).take(pa.array(some)).to_pylist(), n, known) if len(s)]
            row, fragments, grams = [], [], []
            for k, found in enumerate(sets):
                ordered, levels = order.sort(found)
                for j, piece in enumerate(np.split(ordered, np.searchsorted(levels, order.cuts, side="right"))):
                    if len(piece):
                        row.append(k)
                        fragments.append(j)
                        grams.append(piece)
            return pa.RecordBatch.from_arrays([classes_of(sets).take(pa.array(row, pa.int64())), pa.array(fragments, pa.int32()), lists_of(grams)], ["cls", "fragment", "grams"])

        return each

    schema = StructType([StructField("cls", CLS), *StructType.fromDDL("fragment int, grams array<long>").fields])
    pieces = map_rows(docs.select(F.xxhash64("id"), "text"), make, schema)
    pieces = written(pieces.join(needed, "cls", "left_semi").dropDuplicates(["cls", "fragment"]), "jaccard-fragments")
    wanted.destroy()
    left = pieces.select(F.col("cls").alias("a"), "fragment", F.col("grams").alias("left"))
    right = pieces.select(F.col("cls").alias("b"), "fragment", F.col("grams").alias("right"))
    cut = pairs.withColumn("fragment", F.explode(F.array(*map(F.lit, range(FRAGMENTS)))))
    with_left = salted_join(cut, left, "a", "fragment")
    partial = with_left.join(right, ["b", "fragment"]).select("a", "b", "n_a", "n_b", F.size(F.array_intersect("left", "right")).alias("overlap"))
    summed = partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("overlap").alias("overlap"))
    edges = written(summed.where(F.col("overlap") * (whole + part) >= (F.col("n_a") + F.col("n_b")) * part).select("a", "b"), "jaccard-edges")
    release(hashes, pieces)
    return edges


def link_components(docs: DataFrame, n: int = 5, part: int = 80, whole: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_shingles, component_id (smallest id that links reach; similarity part/whole or more)."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    context = docs.sparkSession.sparkContext
    member, order = members(rows, n)
    sent = context.broadcast(order)
    classes = member.where("n_grams > 0").groupBy("cls").agg(F.min("id").alias("id"), F.first("bins").alias("bins"))
    classes = written(classes, "jaccard-classes")
    prefix = written(prefixes(rows, n, sent, part, whole), "jaccard-prefixes")
    # An n-gram that only one class has pairs nothing.
    each = prefix.select(F.explode("grams").alias("gram"), F.col("cls.h1").alias("c"))
    several = written(each.groupBy("gram").agg(F.min("c").alias("y"), F.max("c").alias("z")).where("y <> z").select("gram"), "jaccard-several")
    filtered = context.broadcast(bit_filter(several, several.count()))
    shared = written(postings(prefix, filtered).distinct(), "jaccard-postings")
    filtered.destroy()
    release(prefix, several)
    first = shared.groupBy("gram").agg(F.min(F.struct("place", "cls")).alias("first"))

    def pairs(frame: DataFrame) -> DataFrame:
        """frame: cls, place, other, other_place -> distinct pairs that can be linked, from the places of what they share."""
        fit = frame.where((F.col("cls") != F.col("other")) & possible("place", "other_place", part, whole))
        swap = F.col("cls") > F.col("other")
        ordered = fit.select(
            F.when(swap, F.col("other")).otherwise(F.col("cls")).alias("a"),
            F.when(swap, F.col("cls")).otherwise(F.col("other")).alias("b"),
            F.when(swap, size("other_place")).otherwise(size("place")).alias("n_a"),
            F.when(swap, size("place")).otherwise(size("other_place")).alias("n_b"),
        )
        return written(ordered.distinct(), "jaccard-pairs")

    met = salted_join(shared, first, "gram").select("cls", "place", F.col("first.cls").alias("other"), F.col("first.place").alias("other_place"))
    stars = pairs(met)
    bins_of = classes.select("cls", "bins")
    binned = written(salted_join(stars, bins_of.select(F.col("cls").alias("a"), F.col("bins").alias("x")), "a"), "jaccard-binned")
    fit = salted_join(binned, bins_of.select(F.col("cls").alias("b"), F.col("bins").alias("y")), "b").where(bounded(part, whole))
    asked = written(fit.select("a", "b", "n_a", "n_b"), "jaccard-bounded")
    edges = verified(asked, rows, classes, n, sent, part, whole)
    found = written(components(edges), "jaccard-components")
    release(binned, asked)
    # What the stars left apart: classes of different components that share a rare n-gram. Of two, one is the star.
    labelled = shared.join(found.withColumnRenamed("node", "cls"), "cls", "left").select("gram", "cls", "place", F.coalesce("label", "cls").alias("label"))
    labelled = written(labelled, "jaccard-labelled")
    split = labelled.groupBy("gram").agg(F.min("label").alias("y"), F.max("label").alias("z"), F.count(F.lit(1)).alias("n")).where("y <> z and n > 2").select("gram", F.ceil(F.col("n") / PART).cast("int").alias("parts"))
    apart = written(salted_join(labelled, split, "gram"), "jaccard-apart")
    if not apart.isEmpty():
        apart_bins = written(apart.join(bins_of, "cls"), "jaccard-apart")
        one = apart_bins.select("gram", "cls", "place", "label", F.col("bins").alias("x"), F.pmod(F.xxhash64("cls"), F.col("parts")).cast("int").alias("dealt"))
        two = apart_bins.select("gram", F.col("cls").alias("other"), F.col("place").alias("other_place"), F.col("label").alias("other_label"), F.col("bins").alias("y"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("dealt"))
        fit = possible("place", "other_place", part, whole) & (F.col("label") < F.col("other_label"))
        both = one.join(two, ["gram", "dealt"]).where(fit).withColumns({"n_a": size("place"), "n_b": size("other_place")})
        rest = pairs(both.where(bounded(part, whole))).join(stars.select("a", "b"), ["a", "b"], "left_anti")
        rest = written(rest, "jaccard-rest")
        if not rest.isEmpty():
            edges = edges.unionByName(verified(rest, rows, classes, n, sent, part, whole))
            found = written(components(edges), "jaccard-components")
        release(apart_bins, rest)
    sent.destroy()
    release(shared, stars, labelled, apart)
    named = classes.select("cls", "id").join(found.withColumnRenamed("node", "cls"), "cls", "left").withColumn("label", F.coalesce("label", "cls"))
    named = written(named, "jaccard-named")
    least = named.groupBy("label").agg(F.min("id").alias("component_id"))
    by_class = salted_join(named.select("cls", "label"), least, "label").select("cls", "component_id")
    linked = salted_join(member.where("n_grams > 0").select("id", "n_grams", "cls"), written(by_class, "jaccard-named"), "cls").select("id", "n_grams", "component_id")
    out = linked.unionByName(member.where("n_grams = 0").select("id", "n_grams", F.col("id").alias("component_id")))
    return out.select(F.col("id").alias(id_col), F.col("n_grams").alias("n_shingles"), F.col("component_id"))

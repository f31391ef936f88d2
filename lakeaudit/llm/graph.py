"""Connected components of a graph of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, written


def components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the smallest node that links reach. ``edges`` has columns a and b.

    Alternates large and small stars until nothing changes: the rounds grow with the logarithm of
    the longest chain, and each is two joins on nodes, so no component is ever in one task. A round's links are
    held against the last ones by their number and two sums of hashes.
    """

    def star(links: DataFrame, large: bool) -> DataFrame:
        """links: (a, b) with a > b. Each node's neighbours are hung on the smallest of them."""
        both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        hung = both.join(least, "a")
        moved = hung.where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")) if large else hung.select(F.col("b").alias("a"), F.col("m").alias("b"))
        kept = links.select("a").distinct().join(least, "a").select("a", F.col("m").alias("b"))
        return moved.unionByName(kept).where("a > b").distinct()

    def state(links: DataFrame) -> tuple:
        return tuple(links.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.shiftright(F.xxhash64("b", "a"), 32))).first())

    links = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    links = written(links, "links")
    before = state(links)
    while True:
        large = written(star(links, True), "links")
        after = written(star(large, False), "links")
        release(links, large)
        links, last, before = after, before, state(after)
        if before == last:
            break
    roots = links.select(F.col("b").alias("node")).distinct().select("node", F.col("node").alias("label"))
    return links.select(F.col("a").alias("node"), F.col("b").alias("label")).unionByName(roots)

"""What the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows that a task holds as Python objects at a time.
SLICE_ROWS = 256
#: Bits of a filter of hashes at most, and the pieces in which it is built.
FILTER_BITS, PIECES = 1 << 28, 64
#: A key is hot if it holds more than one of HOT parts of the rows (and HOT_ROWS rows); there can't be HOT such keys.
HOT, HOT_ROWS = 1_000, 1_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The table ``name`` below ``sf_dir``; any file system that Spark can open."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def map_rows(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], pa.RecordBatch]], schema: str | StructType) -> DataFrame:
    """``mapInArrow`` by slices of SLICE_ROWS rows.

    ``make`` runs once a task, for what is costly to set up; what it returns maps each slice.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = make()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE_ROWS):
                yield each(batch.slice(at, SLICE_ROWS))

    return df.mapInArrow(run, schema)


def shared_path(spark: SparkSession, what: str) -> str:
    """A new path that driver and executors share: below ``spark.checkpoint.dir``, or, on one machine where that is unset, the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
    base = base or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str, *parts: str) -> DataFrame:
    """``df`` written to a shared table, in folders by the columns ``parts``, and read again: lineage ends here, and lost executors cost nothing.

    The shuffles behind the table aren't needed any more. Spark's cleaner drops them once the driver has
    collected its garbage, which a long job on a large heap may not do for hours, so it is asked to.
    """
    spark = df.sparkSession
    path = shared_path(spark, what)
    df.write.parquet(path, partitionBy=list(parts) or None)
    spark.sparkContext._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path)


def release(*tables: DataFrame) -> None:
    """Delete tables that written() made and that nothing reads any more."""
    for table in tables:
        spark = table.sparkSession
        for file in table.inputFiles()[:1]:
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(file).getParent()
            while "=" in path.getName():
                path = path.getParent()
            path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bit_filter(hashes: DataFrame, n_rows: int, most: int = FILTER_BITS) -> np.ndarray:
    """Packed bits of the values of the only column (long) of ``hashes``, to be asked by may_hold().

    Some 32 bits a row, ``most`` at most: with more rows the filter only lets more values through. It is
    made in PIECES pieces by the executors, whose size doesn't depend on the rows beyond that.
    """
    bits = 1 << min(most.bit_length() - 1, max(16, int(32 * n_rows).bit_length()))

    def build(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(bits // PIECES, bool)
        for batch in batches:
            cell = batch.column("h").to_numpy().view(np.uint64) % np.uint64(bits)
            mine[(cell // np.uint64(PIECES)).astype(np.int64)] = True
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), pa.array([np.packbits(mine).tobytes()], pa.binary())], ["piece", "bits"])

    # The last bits of a hash say its piece, so pieces are even however the hashes are spread.
    column = hashes.columns[0]
    keyed = hashes.select(F.col(column).alias("h"), F.col(column).bitwiseAND(F.lit(PIECES - 1)).cast("int").alias("piece"))
    out = np.zeros((PIECES, bits // PIECES // 8), np.uint8)
    for row in keyed.groupBy("piece").applyInArrow(build, "piece int, bits binary").collect():
        out[row["piece"]] = np.frombuffer(row["bits"], np.uint8)
    return out.reshape(-1)


def may_hold(table: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which of ``hashes`` (uint64) have their bit in a bit_filter()."""
    cell = hashes % np.uint64(8 * len(table))
    inner = cell // np.uint64(PIECES)
    at = (cell % np.uint64(PIECES)) * np.uint64(len(table) // PIECES) + (inner >> np.uint64(3))
    return (table[at.astype(np.int64)] >> (np.uint8(7) - (inner & np.uint64(7)).astype(np.uint8))) & 1 == 1


def holds(table: bytes, value: int) -> bool:
    """may_hold() of one value of a bit_filter()'s bytes."""
    inner, piece = divmod(value % (8 * len(table)), PIECES)
    return table[piece * (len(table) // PIECES) + (inner >> 3)] >> (7 - (inner & 7)) & 1 == 1


def salted_join(rows: DataFrame, table: DataFrame, *keys: str) -> DataFrame:
    """Inner join of ``rows`` (written, so that they may be read twice) with ``table`` in which a hot key's rows are split.

    Only the hot keys are broadcast, fewer than HOT whatever the data. Their rows are dealt to as many parts as
    they hold shares of the whole, and ``table``'s rows of such a key are repeated for each part.
    """
    share = max(HOT_ROWS, rows.count() // HOT)
    counts = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > share)
    hot = F.broadcast(counts.select(*keys, F.ceil(F.col("_n") / share).cast("int").alias("_parts")))
    parts = F.coalesce("_parts", F.lit(1))
    dealt = rows.join(hot, list(keys), "left").withColumn("_part", F.pmod(F.xxhash64(*rows.columns), parts).cast("int")).drop("_parts")
    each = table.join(hot, list(keys), "left").withColumn("_part", F.explode(F.sequence(F.lit(0), parts - 1))).drop("_parts")
    return dealt.join(each, [*keys, "_part"]).drop("_part")

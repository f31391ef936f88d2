"""Source files as a table: from a tree, or from any table that has paths and contents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import is_scannable, language, line_count

COLUMNS = ["project_id", "relative_path", "language", "content", "line_count", "byte_size"]


def files_from_table(df: DataFrame) -> DataFrame:
    """Scannable files of ``df`` (project_id, relative_path, content, byte_size), with language and line_count."""
    known = df.withColumn("language", language("relative_path")).where(F.col("language").isNotNull() & is_scannable("relative_path", "byte_size"))
    return known.withColumn("line_count", line_count("content")).select(*COLUMNS)


def read_source_files(spark: SparkSession, root: str, project_depth: int = 1) -> DataFrame:
    """Scan a tree of projects; the first ``project_depth`` folders below ``root`` name the project.

    Path and size are filtered before any content is decoded. Bytes that aren't UTF-8 are replaced and
    line ends become newlines. project_depth 0: the whole tree is one project, named "".
    """
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    parts = F.split(F.expr(f"substring(path, locate('{root.rstrip('/')}/', path) + {len(root.rstrip('/')) + 1})"), "/")
    named = found.withColumn("parts", parts).select(
        F.array_join(F.slice("parts", 1, project_depth), "/").alias("project_id") if project_depth else F.lit("").alias("project_id"),
        F.array_join(F.expr(f"slice(parts, {project_depth + 1}, size(parts))"), "/").alias("relative_path"),
        F.col("length").alias("byte_size"),
        "content",
    )
    kept = named.where(language("relative_path").isNotNull() & is_scannable("relative_path", "byte_size"))
    text = F.regexp_replace(F.make_valid_utf8(F.col("content").cast("string")), "\r\n?", "\n")
    return files_from_table(kept.withColumn("content", text))

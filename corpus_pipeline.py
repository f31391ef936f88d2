"""A corpus from raw documents, in stages: quality, lines, near copies, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept. Every stage works on
rows, not on ids: rows with one doc_id but other text, and rows without a doc_id, are judged and kept or
dropped by themselves. Columns beside COLUMNS are not carried on. An empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeaudit.llm import bpe, decontaminate, jaccard_join, line_index, quality
from lakeaudit.llm.common import table, written
from lakeaudit.llm.queries import tokenizer_file

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def with_key(docs: DataFrame) -> DataFrame:
    """``docs`` with key: (doc_id, hash of the row), never null; rows without an id come last. Only identical rows share one."""
    number = F.coalesce(F.col("doc_id").cast("long"), F.lit(2**63 - 1)).alias("doc_id")
    return docs.select(*COLUMNS).withColumn("key", F.struct(number, F.xxhash64("text", "lang", "source", "n_chars").alias("row")))


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly labelled classifier accepts. Null and empty texts go; identical rows share their fate."""
    return quality.judge(docs, table(spark, sf_dir, "labels")).where("kept").select(*COLUMNS)


def distinct_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier document holds; n_chars follows the text.

    Rows of one doc_id, and those without any, count as one document here: lines that they share stay in each.
    """
    kept = line_index.dedup(docs)
    chars = F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return kept.withColumn("n_chars", chars).select(*COLUMNS)


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of rows linked by 5-word shingles (similarity 0.8 or more) the one with the smallest doc_id, and of
    these the one with the smallest hash; of identical rows one. Texts without a word are linked with nothing, and stay.
    """
    keyed = with_key(docs)
    found = jaccard_join.link_components(keyed, id_col="key").where("n_shingles > 0")
    held = found.groupBy("key").agg(F.min("component_id").alias("first"), F.count(F.lit(1)).alias("n"))
    marks = written(held.where("first <> key or n > 1").select("key", (F.col("first") == F.col("key")).alias("stays")), "pipeline-marks")
    alone = keyed.join(marks.select("key"), "key", "left_anti")
    several = keyed.join(marks.where("stays").select("key"), "key", "left_semi").dropDuplicates(["key"])
    return alone.unionByName(several).select(*COLUMNS)


def without_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Null and empty texts hold none."""
    return decontaminate.clean(with_key(docs), table(spark, sf_dir, "benchmark"), id_col="key").select(*COLUMNS)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids (as in ids_sha256) and the decoded text's hash, of each row; a null text is an empty one."""
    coded = bpe.encode_and_decode(docs, tokenizer_file())
    return coded.select(
        "doc_id",
        (F.length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", distinct_lines),
    ("n-gram Jaccard join", one_of_each),
    ("benchmark decontamination", without_leaks),
    ("BPE encoding and decoding", tokens),
]

#: The classifier and the tokenizer are beyond SQL; a test holds run(), given the classifier's verdicts, against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, "pipeline")
    return docs

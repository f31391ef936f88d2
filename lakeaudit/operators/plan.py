"""Review tasks: batches of files, clipped sources and token budgets. Only lengths travel, not texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .facts import GENERIC_LANGUAGES, KEYS
from .ranges import number_rows

# Files a batch, lines of a target and of a related file, characters a file counts at most, tokens a reply and a verification cost.
BATCH, TARGET_LINES, RELATED_LINES, FILE_CHARS, REPLY, VERIFY = 6, 420, 140, 18_000, 1_600, 500


def first_n(df: DataFrame, n: int, keys: list[str], order: list[Column]) -> DataFrame:
    """The first ``n`` rows of each key; Spark keeps n a key before the shuffle."""
    return df.withColumn("_place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col("_place") <= n).drop("_place")


def batch_files(files: DataFrame, size: int = BATCH) -> DataFrame:
    """(project_id, task, priority, paths): generic files by path in groups of ``size``."""
    mine = files.where(F.col("language").isin(*GENERIC_LANGUAGES))
    placed = number_rows(mine.select("project_id", "relative_path"), ["project_id"], [F.col("relative_path")], "_place")
    numbered = placed.select("project_id", "relative_path", F.ceil(F.col("_place") / size).cast("int").alias("task"))
    paths = F.array_sort(F.collect_list("relative_path"))
    return numbered.groupBy("project_id", "task").agg(paths.alias("paths")).withColumn("priority", F.col("task") + 70)


# What ends a line, and what stands for lines that are left out.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
LEFT_OUT = "\n...（该文件其余内容未提供）"


def lines(content: Column | str) -> Column:
    """A text's lines; none after a final line end, and none of an empty text."""
    every = F.split(content, LINE_END)
    return F.when(F.element_at(every, -1) == "", F.slice(every, 1, F.size(every) - 1)).otherwise(every)


def number_lines(files: DataFrame) -> DataFrame:
    """(KEYS, line, text): each line with its number from 1 in four places."""
    each = files.select(*KEYS, F.posexplode(lines("content")).alias("pos", "text"))
    return each.select(*KEYS, (F.col("pos") + 1).alias("line"), F.format_string("%4d: %s", F.col("pos") + 1, F.col("text")).alias("text"))


def clip_source(content: Column | str, most: int) -> Column:
    """The first ``most`` lines of a text, and a mark if there are more."""
    every = lines(content)
    return F.concat(F.array_join(F.slice(every, 1, most), "\n"), F.when(F.size(every) > most, LEFT_OUT).otherwise(""))


def estimate_tokens(tasks: DataFrame, prompt_chars: int, verifier_chars: int) -> DataFrame:
    """Per project: tokens in, out, kept in reserve, and in all. tasks: project_id, task, relative_path, chars.

    A task counts each file once and FILE_CHARS of it at most. The reserve is what verifying the
    max(2, a quarter) largest tasks would take.
    """
    once = tasks.groupBy("project_id", "task", "relative_path").agg(F.least(F.max("chars"), F.lit(FILE_CHARS)).alias("chars"))
    sized = once.groupBy("project_id", "task").agg(F.sum("chars").alias("context"))
    counts = sized.groupBy("project_id").agg(F.count(F.lit(1)).alias("_n"))
    ranked = number_rows(sized, ["project_id"], [F.desc("context"), F.col("task")], "_place").join(counts, "project_id")
    k = F.least(F.col("_n"), F.greatest(F.lit(2), F.floor((F.col("_n") + 3) / 4)))
    out = ranked.withColumn("_kept", F.col("_place") <= k).groupBy("project_id").agg(
        F.greatest(F.lit(1), F.floor(F.sum(F.col("context") + prompt_chars) / 3)).cast("long").alias("input_tokens"),
        (F.count(F.lit(1)) * REPLY).alias("output_tokens"),
        (F.floor(F.sum(F.when(F.col("_kept"), F.col("context") + verifier_chars).otherwise(0)) / 3) + F.count_if("_kept") * VERIFY).cast("long").alias("reserve_tokens"),
    )
    return out.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens") + F.col("reserve_tokens"))


def plan_groups(chains: DataFrame) -> DataFrame:
    """(project_id, plan_group, n_chains): first group that fits. chains: project_id, risk_score, status, method."""
    group = F.when(F.col("risk_score") >= 50, "high_risk").when(F.col("status") != "complete", "unconfirmed").when(F.col("method").isin("POST", "PUT", "PATCH", "DELETE"), "write").otherwise("read")
    return chains.groupBy("project_id", group.alias("plan_group")).agg(F.count(F.lit(1)).alias("n_chains"))


def order_chain_tasks(chains: DataFrame) -> DataFrame:
    """chains with place (by risk, then id) and priority (max(1, 100 - risk))."""
    placed = number_rows(chains, ["project_id"], [F.desc("risk_score"), F.col("chain_id")], "place")
    return placed.withColumn("priority", F.greatest(F.lit(1), 100 - F.col("risk_score")))

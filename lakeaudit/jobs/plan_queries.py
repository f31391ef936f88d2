"""Queries of review planning."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import plan
from .bindings import bound, duck
from .fact_queries import KEYS, PROSE, prose, register

_GENERIC = "language IN ('c', 'cpp', 'go', 'python', 'rust', 'java', 'javascript', 'typescript', 'vue')"
_BATCHED = f"(SELECT project_id, relative_path, length(content) AS chars, ((row_number() OVER (PARTITION BY project_id ORDER BY relative_path) + 5) // 6)::INT AS task FROM {PROSE} AS f WHERE {_GENERIC})"


@register("w6_batch_files", f"SELECT project_id, task, task + 70 AS priority, string_agg(relative_path, '|' ORDER BY relative_path) AS paths FROM {_BATCHED} AS b GROUP BY project_id, task")
def w6(spark, sf_dir):
    return plan.batch_files(prose(spark, sf_dir)).select("project_id", "task", "priority", F.array_join("paths", "|").alias("paths"))


@register("w8_first_n_per_key", f"SELECT project_id, relative_path FROM (SELECT *, row_number() OVER (PARTITION BY project_id, language ORDER BY relative_path) AS k FROM {PROSE} AS f) AS x WHERE k <= 3")
def w8(spark, sf_dir):
    return plan.first_n(prose(spark, sf_dir), 3, ["project_id", "language"], [F.col("relative_path")]).select(*KEYS)


_ENDINGS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]"
_LINES = f"(SELECT project_id, relative_path, CASE WHEN every[-1] = '' THEN every[1:-2] ELSE every END AS lines FROM (SELECT project_id, relative_path, string_split_regex(content, '{_ENDINGS}') AS every FROM {PROSE} AS f) AS e)"


@register("x21_number_lines", f"SELECT project_id, relative_path, i::INT AS line, lpad(i::VARCHAR, greatest(4, length(i::VARCHAR))::INT, ' ') || ': ' || lines[i] AS text FROM (SELECT *, unnest(range(1, len(lines) + 1)) AS i FROM {_LINES} AS a) AS b")
def x21(spark, sf_dir):
    return plan.number_lines(prose(spark, sf_dir))


def _clipped(n: int) -> str:
    return f"array_to_string(lines[1:{n}], chr(10)) || CASE WHEN len(lines) > {n} THEN '{plan.LEFT_OUT}' ELSE '' END"


@register("t3_clip_source", f"SELECT project_id, relative_path, {_clipped(plan.TARGET_LINES)} AS target, {_clipped(plan.RELATED_LINES)} AS related FROM {_LINES} AS a")
def t3(spark, sf_dir):
    return prose(spark, sf_dir).select(*KEYS, plan.clip_source("content", plan.TARGET_LINES).alias("target"), plan.clip_source("content", plan.RELATED_LINES).alias("related"))


@register("a10_estimate_tokens", f"""
WITH s AS (SELECT project_id, task, sum(least(chars, 18000)) AS context FROM {_BATCHED} AS b GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY context DESC, task) AS place, count(*) OVER (PARTITION BY project_id) AS n FROM s),
k AS (SELECT *, place <= least(n, greatest(2, (n + 3) // 4)) AS kept FROM r),
t AS (SELECT project_id, greatest(1, sum(context + 900) // 3) AS input_tokens, count(*) * 1600 AS output_tokens, sum(CASE WHEN kept THEN context + 300 ELSE 0 END) // 3 + count(*) FILTER (kept) * 500 AS reserve_tokens FROM k GROUP BY project_id)
SELECT project_id, input_tokens::BIGINT AS input_tokens, output_tokens, reserve_tokens::BIGINT AS reserve_tokens, (input_tokens + output_tokens + reserve_tokens)::BIGINT AS total_tokens FROM t
""")
def a10(spark, sf_dir):
    files = prose(spark, sf_dir)
    sizes = files.select(*KEYS, F.length("content").cast("long").alias("chars"))
    tasks = plan.batch_files(files).select("project_id", "task", F.explode("paths").alias("relative_path")).join(sizes, KEYS)
    return plan.estimate_tokens(tasks, prompt_chars=900, verifier_chars=300)


_CHAINS = "SELECT 'c' || cast(o_custkey % 10 AS string) AS project_id, 'chain' || cast(o_orderkey AS string) AS chain_id, cast(o_orderkey % 101 AS int) AS risk_score, CASE o_orderkey % 3 WHEN 0 THEN 'complete' WHEN 1 THEN 'partial' ELSE 'complete' END AS status, CASE o_orderkey % 4 WHEN 0 THEN 'POST' ELSE 'GET' END AS method FROM orders"


@register("a12_plan_groups", f"SELECT project_id, CASE WHEN risk_score >= 50 THEN 'high_risk' WHEN status <> 'complete' THEN 'unconfirmed' WHEN method = 'POST' THEN 'write' ELSE 'read' END AS plan_group, count(*) AS n_chains FROM ({duck(_CHAINS)}) AS c GROUP BY ALL")
def a12(spark, sf_dir):
    return plan.plan_groups(bound(spark, sf_dir, _CHAINS))


@register("t1_order_chain_tasks", f"SELECT project_id, chain_id, row_number() OVER (PARTITION BY project_id ORDER BY risk_score DESC, chain_id) AS place, greatest(1, 100 - risk_score) AS priority FROM ({duck(_CHAINS)}) AS c")
def t1(spark, sf_dir):
    return plan.order_chain_tasks(bound(spark, sf_dir, _CHAINS)).select("project_id", "chain_id", F.col("place").cast("long").alias("place"), "priority")

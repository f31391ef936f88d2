"""Queries of registered capabilities: three rule sets and a fallback over templated code and prose."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import capabilities, facts, relate
from ..operators.capabilities import Capability, Registry
from ..sources.shared import written
from .fact_queries import _X1, _X3, code, prose, register
from .graph_queries import _A2, _BOTH, _MARKS

_SCORES = _A2.format(_MARKS.format(_BOTH))
# What each capability of the query claims; scripts and queries score alike.
_WEB, _SCRIPTS = ("java", "vue", "javascript", "typescript", "xml", "yaml"), ("python", "go", "typescript")


def _broken(rows):
    raise ValueError("no rules today")


def _registry() -> Registry:
    out = Registry()

    def of(*languages):
        return F.col("language").isin(*languages)

    def where(language, score, reason):
        return lambda files: files.where(F.col("language") == language).select("project_id", F.lit(score).alias("score"), F.lit(reason).alias("reason")).distinct()

    out.register(Capability("web", lambda files: relate.detect_capability(files).select("project_id", "score", F.col("reasons").alias("reason")), of(*_WEB), lambda files: {"routes": facts.extract_routes(files), "sql": facts.extract_sql_operations(files)}))
    out.register(Capability("scripts", where("python", 0.7, "python"), of(*_SCRIPTS), lambda files: {"signals": facts.extract_generic_signals(files)}))
    out.register(Capability("queries", where("sql", 0.7, "sql"), of("sql", "typescript"), lambda files: {"sql": facts.extract_sql_operations(files).withColumn("line", F.col("line").cast("string"))}))
    out.register(Capability("broken", where("rust", 0.9, "rust"), of("rust", "python", "sql"), lambda files: {"none": files.select("project_id").mapInArrow(_broken, "project_id string")}))
    out.register(Capability("generic", lambda files: files.select("project_id", F.lit(0.1).alias("score"), F.lit("rest").alias("reason")).distinct(), F.lit(True), lambda files: {"signals": facts.extract_generic_signals(files)}, specialized=False))
    return out


def _run(spark, sf_dir) -> capabilities.Run:
    return capabilities.run(written(code(spark, sf_dir).unionByName(prose(spark, sf_dir)), "files"), _registry())


_OWNERS = f"""(SELECT f.project_id, relative_path, language, score, broken,
  CASE WHEN scripts AND language IN {_SCRIPTS} AND NOT (web AND score >= 0.7 AND language IN {_WEB}) THEN 'scripts' WHEN queries AND language IN ('sql', 'typescript') AND NOT (web AND score >= 0.7 AND language IN {_WEB}) THEN 'queries'
       WHEN web AND language IN {_WEB} THEN 'web' WHEN language IN ('c', 'cpp', 'go', 'python', 'rust', 'java', 'javascript', 'typescript', 'vue') THEN 'generic' END AS owner
  FROM {_BOTH} AS f JOIN (SELECT *, score >= 0.5 AS web FROM ({_SCORES}) AS s) AS d ON d.project_id = f.project_id
    JOIN (SELECT project_id, bool_or(language = 'python') AS scripts, bool_or(language = 'sql') AS queries, bool_or(language = 'rust') AS broken FROM {_BOTH} AS b GROUP BY project_id) AS l ON l.project_id = f.project_id)"""


@register("u1_capability_owners", f"SELECT project_id, relative_path, owner FROM {_OWNERS} AS o")
def u1_owners(spark, sf_dir):
    return _run(spark, sf_dir).owners


_TRIED = f"SELECT DISTINCT project_id FROM {_OWNERS} AS o WHERE broken"


@register("u1_capability_failures", f"SELECT project_id, 'broken' AS capability FROM ({_TRIED}) AS t")
def u1_failures(spark, sf_dir):
    return _run(spark, sf_dir).failures.select("project_id", "capability")


@register("u1_capability_selections", f"""
SELECT project_id, capability, n_files, CASE WHEN capability = 'broken' THEN '{capabilities.DEGRADED}' WHEN n_files = 0 THEN '{capabilities.EMPTY}' ELSE '{capabilities.ENABLED}' END AS status
FROM (SELECT project_id, capability, count(*) FILTER (owner = capability) AS n_files,
        bool_or(CASE capability WHEN 'web' THEN score >= 0.5 WHEN 'scripts' THEN language = 'python' WHEN 'queries' THEN language = 'sql' WHEN 'broken' THEN language = 'rust' ELSE owner = 'generic' END) AS chosen
      FROM {_OWNERS} AS o, (SELECT unnest(['web', 'scripts', 'queries', 'broken', 'generic']) AS capability) AS c GROUP BY ALL) AS x WHERE chosen
""")
def u1_selections(spark, sf_dir):
    return _run(spark, sf_dir).selections.drop("score", "reason")


@register("o1_merge_facts", f"""
SELECT r.project_id, 'web' AS capability, 0 AS rank, 'routes' AS kind, r.relative_path, r.line::VARCHAR AS line, upper(g1) AS method, g2 AS path, NULL AS operation, NULL AS statement FROM {_X1} AS r JOIN {_OWNERS} AS o ON o.project_id = r.project_id AND o.relative_path = r.relative_path WHERE owner = 'web'
UNION ALL SELECT x.project_id, owner, CASE owner WHEN 'web' THEN 0 ELSE 2 END, 'sql', x.relative_path, x.line::VARCHAR, NULL, NULL, operation, statement FROM ({_X3}) AS x JOIN {_OWNERS} AS o ON o.project_id = x.project_id AND o.relative_path = x.relative_path WHERE owner IN ('web', 'queries')
""")
def o1(spark, sf_dir):
    found = _run(spark, sf_dir)
    merged = capabilities.merge_facts(found.facts).where("kind <> 'signals'")
    return merged.select("project_id", "capability", "rank", "kind", "relative_path", "line", "method", "path", "operation", "statement")

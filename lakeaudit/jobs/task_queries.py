"""Queries of chain tasks: plans, fragments and contexts, over chains that are projections of the given tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import plan, tasks
from ..sources.shared import written
from .bindings import FINDING_FILES, bound
from .fact_queries import register

# Chains of the events' projects, their nodes in the findings' files: spans that overlap, repeat, are one line, and end past the file.
_NODES = """
SELECT 'q' || cast(user_id % 4 AS string) AS project_id, 'c' || cast(event_id % 60 AS string) AS chain_id, event_id AS place,
       CASE event_type WHEN 'error' THEN 'java_method' WHEN 'purchase' THEN 'dto_type' WHEN 'click' THEN 'sql_statement' WHEN 'view' THEN 'controller_endpoint' ELSE 'api_call' END AS kind,
       CASE WHEN event_id % 37 = 0 THEN 'm9/src/Gone.java' ELSE 'm' || cast(user_id % 7 AS string) || '/src/F' || cast(user_id AS string) || '.java' END AS relative_path,
       cast(event_id % 8 AS int) AS line, cast(CASE event_id % 3 WHEN 0 THEN 0 WHEN 1 THEN event_id % 8 + event_id % 5 ELSE 90 END AS int) AS end_line
FROM events
"""
_CHAINS = """
SELECT 'q' || cast(user_id % 4 AS string) AS project_id, 'c' || cast(event_id % 60 AS string) AS chain_id, min('POST /c' || cast(event_id % 60 AS string)) AS name,
       CASE WHEN min(event_id % 60) % 3 = 0 THEN 'partial' ELSE 'complete' END AS status, CASE WHEN min(event_id % 60) % 3 = 0 THEN 'gap a|gap b' ELSE '' END AS gap,
       cast(min(event_id % 60) % 5 * 30 AS int) AS risk_score, CASE WHEN min(event_id % 60) % 5 > 0 THEN 'write' ELSE '' END AS reason
FROM events WHERE user_id % 4 <> 3 GROUP BY user_id % 4, event_id % 60
"""
_KEYS = """
SELECT DISTINCT 'q' || cast(user_id % 4 AS string) AS project_id, 'm' || cast(user_id % 3 AS string) || '/application.yml' AS relative_path, cast(user_id % 40 AS int) AS line,
       'spring.datasource.k' || cast(user_id % 120 AS string) AS key, CASE WHEN user_id % 5 = 0 THEN '[已脱敏]' ELSE 'v' || cast(user_id % 120 AS string) END AS value
FROM events WHERE user_id % 4 <> 1
"""
_STRATEGIES = "SELECT DISTINCT 'q' || cast(user_id % 4 AS string) AS project_id, CASE WHEN user_id % 4 = 2 THEN 'layered_fallback' ELSE 'endpoint_chain' END AS strategy FROM events"
_LAYERED = "SELECT DISTINCT 'q' || cast(user_id % 4 AS string) AS project_id, event_type AS task_id, 'domain of ' || event_type AS domain, cast(length(event_type) * 10 AS int) AS priority FROM events"


def _split(column: str):
    return F.when(F.col(column) == "", F.array().cast("array<string>")).otherwise(F.split(column, r"\|"))


def _files(spark, sf_dir):
    files = bound(spark, sf_dir, FINDING_FILES)
    return files.withColumn("line_count", F.length("content") - F.length(F.replace("content", F.lit("\n"), F.lit(""))) + 1)


def _chains(spark, sf_dir):
    return bound(spark, sf_dir, _CHAINS).withColumns({"gaps": _split("gap"), "risk_reasons": _split("reason")})


def _plan(spark, sf_dir):
    nodes = bound(spark, sf_dir, _NODES)
    paths = nodes.groupBy("project_id", "chain_id").agg(F.concat(F.lit("path of "), F.min("relative_path")).alias("chain_path"))
    return tasks.build_chain_plan(_chains(spark, sf_dir), paths, bound(spark, sf_dir, _KEYS), bound(spark, sf_dir, _STRATEGIES), bound(spark, sf_dir, _LAYERED))


_FILES_SQL = f"(SELECT *, length(content) - length(replace(content, chr(10), '')) + 1 AS line_count FROM ({FINDING_FILES}) AS f)"
_SPANS = f"""(SELECT project_id, chain_id, kind, relative_path, language, content, place,
  CASE WHEN kind = 'dto_type' THEN 1 WHEN one THEN greatest(1, a - 2) ELSE a END AS line, CASE WHEN kind = 'dto_type' THEN least(line_count, 160) WHEN one THEN least(line_count, b + 6) ELSE b END AS last
  FROM (SELECT *, greatest(1, line) AS a, CASE end_line WHEN 0 THEN greatest(1, line) ELSE end_line END AS b, (CASE end_line WHEN 0 THEN greatest(1, line) ELSE end_line END) = greatest(1, line) AS one
        FROM ({_NODES}) AS n JOIN {_FILES_SQL} AS f USING (project_id, relative_path) WHERE kind <> 'controller_endpoint') AS s)"""
_CUT = f"""
SELECT project_id, chain_id, number, CASE kind WHEN 'java_method' THEN 'Java 方法' WHEN 'dto_type' THEN 'DTO' WHEN 'sql_statement' THEN 'SQL' ELSE '前端 API' END AS label, relative_path, line, language,
  coalesce(array_to_string(list_transform(range(line, least(last, len(lines)) + 1), lambda k: printf('%4d: %s', k, lines[k])), chr(10)), '') AS content
FROM (SELECT *, row_number() OVER (PARTITION BY project_id, chain_id ORDER BY place)::INTEGER AS number, string_split(rtrim(content, chr(10)), chr(10)) AS lines
      FROM (SELECT project_id, chain_id, relative_path, language, line, last, any_value(content) AS content, min(place) AS place, arg_min(kind, place) AS kind FROM {_SPANS} AS s GROUP BY ALL) AS d) AS e
WHERE number <= 18
"""


@register("j19_cut_fragments", _CUT)
def j19(spark, sf_dir):
    return tasks.cut_fragments(bound(spark, sf_dir, _NODES), _files(spark, sf_dir))


_FACTS = f"(SELECT project_id, row_number() OVER (PARTITION BY project_id ORDER BY relative_path, line, key)::INTEGER AS number, key || '=' || value || '（' || relative_path || ':' || line || '）' AS fact FROM ({_KEYS}) AS k)"


@register("g4_attach_config", f"SELECT project_id, chain_id, number, fact FROM ({_CHAINS}) AS c JOIN {_FACTS} AS f USING (project_id) WHERE number <= 20")
def g4(spark, sf_dir):
    return tasks.attach_config(_chains(spark, sf_dir), bound(spark, sf_dir, _KEYS))


_BY_CHAIN = "project_id <> 'q2' AND project_id <> 'q3'"
_PLAN = f"""
SELECT project_id, chain_id AS task_id, 'endpoint_chain' AS kind, '全链路：' || name AS domain, greatest(1, 100 - risk_score) AS priority, chain_id, name AS endpoint, status AS chain_status,
  'path of ' || first_path AS chain_path, gap AS chain_gaps, risk_score, reason AS risk_reasons
FROM ({_CHAINS}) AS c JOIN (SELECT project_id, chain_id, min(relative_path) AS first_path FROM ({_NODES}) AS n GROUP BY ALL) AS p USING (project_id, chain_id) WHERE {_BY_CHAIN}
UNION ALL SELECT DISTINCT project_id, 'springvue.config-context', 'springvue_config', '项目运行配置上下文', 80, '', '', '', '', '', 0, '' FROM ({_KEYS}) AS k WHERE {_BY_CHAIN}
UNION ALL SELECT project_id, task_id, 'layered', domain, priority, '', '', '', '', '', 0, '' FROM ({_LAYERED}) AS l WHERE NOT ({_BY_CHAIN})
"""


@register("o5_build_chain_plan", _PLAN)
def o5(spark, sf_dir):
    return _plan(spark, sf_dir).withColumns({c: F.array_join(c, "|") for c in ("chain_gaps", "risk_reasons")})


# Relations of chains; a chain has at most as many as events.
_RELATIONS = f"SELECT project_id, chain_id, cast(place AS bigint) AS number, 'n' || cast(place % 9 AS string) AS source, kind, CASE WHEN place % 2 = 0 THEN 'high' ELSE 'medium' END AS confidence, 't' || cast(line AS string) AS target, 'seen' AS evidence FROM ({_NODES}) AS n"
_CHECKS = ("check the path", "check the data")


@register("u4_render_chain_context", f"""
SELECT project_id, task_id, concat_ws(chr(10) || chr(10), '链路：' || chain_id, '接口：' || endpoint, '状态：' || chain_status, '通路：' || chain_path,
  CASE WHEN chain_gaps <> '' THEN '断链：' || chr(10) || '- ' || replace(chain_gaps, '|', chr(10) || '- ') END, CASE WHEN risk_reasons <> '' THEN '风险依据：' || risk_reasons END,
  '清单：' || chr(10) || '- {_CHECKS[0]}' || chr(10) || '- {_CHECKS[1]}', relations, facts, fragments) AS context
FROM (SELECT * FROM ({_PLAN}) AS p WHERE kind = 'endpoint_chain') AS t
  LEFT JOIN (SELECT project_id, chain_id, '关系：' || chr(10) || string_agg(source || ' --' || kind || '/' || confidence || '--> ' || target || '：' || evidence, chr(10) ORDER BY number) AS relations FROM ({_RELATIONS}) AS r GROUP BY ALL) AS r USING (project_id, chain_id)
  LEFT JOIN (SELECT project_id, '配置（远程值未验证）：' || chr(10) || '- ' || string_agg(fact, chr(10) || '- ' ORDER BY number) AS facts FROM {_FACTS} AS f WHERE number <= 20 GROUP BY ALL) AS f USING (project_id)
  LEFT JOIN (SELECT project_id, chain_id, string_agg(label || ': ' || relative_path || ':' || line || chr(10) || '```' || language || chr(10) || content || chr(10) || '```', chr(10) || chr(10) ORDER BY number) AS fragments FROM ({_CUT}) AS c GROUP BY ALL) AS g USING (project_id, chain_id)
""")
def u4_chain(spark, sf_dir):
    planned = written(_plan(spark, sf_dir), "plan")
    fragments = tasks.cut_fragments(bound(spark, sf_dir, _NODES), _files(spark, sf_dir))
    return tasks.render_context(tasks.chain_pieces(planned, _CHECKS, bound(spark, sf_dir, _RELATIONS), bound(spark, sf_dir, _KEYS), fragments))


@register("u4_render_config_context", f"""
SELECT project_id, 'springvue.config-context' AS task_id, '清单：' || chr(10) || '- {_CHECKS[0]}' || chr(10) || '- {_CHECKS[1]}' || chr(10) || chr(10) || '脱敏配置：' || chr(10) || '- ' || string_agg(fact, chr(10) || '- ' ORDER BY number) AS context
FROM {_FACTS} AS f WHERE number <= 80 AND {_BY_CHAIN} GROUP BY project_id
""")
def u4_config(spark, sf_dir):
    return tasks.render_context(tasks.config_pieces(_plan(spark, sf_dir), _CHECKS, bound(spark, sf_dir, _KEYS)))


# Layered contexts over prose: long texts are cut, and each file is a target of some task and related to others.
_LONG = """
SELECT 's' || cast(doc_id % 10 AS string) AS project_id, 'd' || cast(doc_id AS string) || CASE WHEN doc_id % 6 = 0 THEN '.yml' ELSE '.py' END AS relative_path, CASE WHEN doc_id % 6 = 0 THEN 'yaml' ELSE 'python' END AS language,
       CASE WHEN doc_id % 6 = 0 THEN 'password: abcd' || cast(doc_id AS string) ELSE replace(coalesce(text, ''), ' ', chr(10)) || chr(10) END AS content, doc_id AS n
FROM documents
"""
_LAYER_TASKS = "SELECT DISTINCT 's' || cast(doc_id % 10 AS string) AS project_id, 't' || cast(doc_id % 3 AS string) AS task_id, 'domain' AS domain, 'why' AS rationale FROM documents"
_HELD = "SELECT 's' || cast(doc_id % 10 AS string) AS project_id, 't' || cast((doc_id + k) % 3 AS string) AS task_id, 'd' || cast(doc_id AS string) || CASE WHEN doc_id % 6 = 0 THEN '.yml' ELSE '.py' END AS relative_path, CASE k WHEN 0 THEN 'target' ELSE 'related' END AS kind, doc_id AS rank FROM documents CROSS JOIN (SELECT 0 AS k UNION ALL SELECT 1) AS ks"
_TIES = "SELECT 's' || cast(doc_id % 10 AS string) AS project_id, 'd' || cast(doc_id AS string) || CASE WHEN doc_id % 6 = 0 THEN '.yml' ELSE '.py' END AS source, 'd' || cast(doc_id + 10 AS string) || CASE WHEN (doc_id + 10) % 6 = 0 THEN '.yml' ELSE '.py' END AS target, 'calls' AS kind FROM documents"
_TECH = "SELECT DISTINCT 's' || cast(doc_id % 10 AS string) AS project_id, 'Vue|MySQL' AS technologies FROM documents"


@register("u4_render_layered_context", f"""
WITH files AS (SELECT *, string_split(CASE WHEN ends_with(content, chr(10)) THEN left(content, -1) ELSE content END, chr(10)) AS all_lines
  FROM (SELECT project_id, relative_path, language, CASE WHEN language = 'yaml' THEN 'password: [已脱敏]' ELSE content END AS content FROM ({_LONG}) AS l) AS l
), few AS (
  SELECT * FROM (SELECT project_id, task_id, relative_path, kind, row_number() OVER (PARTITION BY project_id, task_id ORDER BY kind DESC, rank) AS number FROM ({_HELD}) AS h) AS x WHERE number <= 14
), cut AS (
  SELECT project_id, task_id, string_agg(CASE kind WHEN 'target' THEN '目标文件' ELSE '关联文件' END || ': ' || relative_path || chr(10) || '```' || language || chr(10)
    || coalesce(array_to_string(list_transform(range(1, least(CASE kind WHEN 'target' THEN 420 ELSE 140 END, n_lines) + 1), lambda k: printf('%4d: %s', k, all_lines[k])), chr(10)), '')
    || CASE WHEN n_lines > CASE kind WHEN 'target' THEN 420 ELSE 140 END THEN '{plan.LEFT_OUT.replace(chr(10), "' || chr(10) || '")}' ELSE '' END || chr(10) || '```', chr(10) || chr(10) ORDER BY number) AS shown
  FROM (SELECT *, CASE WHEN content IN ('', chr(10)) THEN length(content) ELSE len(all_lines) END AS n_lines FROM few JOIN files USING (project_id, relative_path)) AS y GROUP BY ALL
), told AS (
  SELECT project_id, task_id, '关联：' || chr(10) || string_agg(source || ' --' || kind || '--> ' || target, chr(10) ORDER BY source, target) AS relations
  FROM (SELECT *, row_number() OVER (PARTITION BY project_id, task_id ORDER BY source, target) AS k
        FROM (SELECT DISTINCT t.project_id, h.task_id, source, t.kind, target FROM ({_TIES}) AS t JOIN ({_HELD}) AS h ON h.project_id = t.project_id AND h.relative_path IN (source, target)) AS d) AS e WHERE k <= 40 GROUP BY ALL
)
SELECT project_id, task_id, concat_ws(chr(10) || chr(10), '技术栈：Vue、MySQL', '范围：domain', '理由：why', '清单：' || chr(10) || '- {_CHECKS[0]}' || chr(10) || '- {_CHECKS[1]}', shown, relations) AS context
FROM ({_LAYER_TASKS}) AS t LEFT JOIN cut USING (project_id, task_id) LEFT JOIN told USING (project_id, task_id)
""")
def u4_layered(spark, sf_dir):
    asked = bound(spark, sf_dir, _LAYER_TASKS).withColumn("checklist", F.array(*map(F.lit, _CHECKS)))
    technologies = bound(spark, sf_dir, _TECH).withColumn("technologies", F.split("technologies", r"\|"))
    pieces = tasks.layered_pieces(asked, technologies, bound(spark, sf_dir, _HELD), bound(spark, sf_dir, _LONG), bound(spark, sf_dir, _TIES))
    return tasks.render_context(pieces)

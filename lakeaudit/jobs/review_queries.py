"""Queries of front-end code, configuration and review tasks. SQL over templated code says what each part's files must yield."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import config, facts, findings, front, relate, review
from ..sources.files import files_from_table
from .bindings import FINDING_FILES, FINDINGS, RAW_FRONT, TASKS, bound, duck
from .fact_queries import _ROLE, CODE, KEYS, code, register
from .finding_queries import _GOV_W7, _governed
from .graph_queries import _J1

_PART = "(SELECT 'p' || (p_partkey % 20) AS project_id, 'svc' || (p_partkey % 40) AS svc, p_partkey AS n, p_partkey::VARCHAR AS k FROM part) AS p"
_API, _VIEW = "svc || '/src/main/web/api/api' || k || '.ts'", "svc || '/src/main/web/views/View' || k || '.vue'"
# line, method, url, normalized_url, function, dynamic, confidence, when
_CALLS = [
    ("4", "'POST'", "'/api/item' || k || '/create'", "'/api/item' || k || '/create'", "'createItem' || k", "false", "'high'", "true"),
    ("6", "'GET'", "'/api/item' || k || '/{}/part?full=1'", "'/api/item' || k || '/{}/part'", "'one' || k", "true", "'high'", "true"),
    ("7", "'PUT'", "'/api/item' || k || '/{}'", "'/api/item' || k || '/{}'", "'sync' || k", "true", "'high'", "true"),
    ("CASE WHEN n % 3 = 0 THEN 9 ELSE 8 END", "'FETCH'", "'gone/item' || k", "'/gone/item' || k", "'sync' || k", "false", "'medium'", "n % 10 = 0"),
]
_X18 = " UNION ALL ".join(
    f"SELECT project_id, {_API} AS relative_path, ({line})::INT AS line, {method} AS method, {url} AS url, {norm} AS normalized_url, {function} AS function, {dynamic} AS dynamic, {sure} AS confidence FROM {_PART} WHERE {when}"
    for line, method, url, norm, function, dynamic, sure, when in _CALLS
)


def _front(spark, sf_dir):
    raw = bound(spark, sf_dir, RAW_FRONT)
    return front.front_facts(files_from_table(raw.withColumn("byte_size", F.octet_length("content").cast("long"))))


@register("x18_extract_http_calls", f"SELECT project_id, relative_path, line, method, url, normalized_url, dynamic, confidence FROM ({_X18}) AS c")
def x18(spark, sf_dir):
    return front.extract_http_calls(_front(spark, sf_dir)).select(*KEYS, "line", "method", "url", "normalized_url", "dynamic", "confidence")


@register("j22_nearest_function", f"SELECT project_id, relative_path, line, function FROM ({_X18}) AS c")
def j22(spark, sf_dir):
    return front.extract_http_calls(_front(spark, sf_dir)).select(*KEYS, "line", "function")


@register("x19_extract_frontend_functions", f"""
SELECT project_id, {_VIEW} AS relative_path, 'View' || k || '.save' AS name, 5 AS line, 8 AS end_line, 'createItem' || k || '|one' || k AS called FROM {_PART}
UNION ALL SELECT project_id, {_VIEW}, 'View' || k || '.idle', 9, 9, '' FROM {_PART}
""")
def x19(spark, sf_dir):
    return front.extract_frontend_functions(_front(spark, sf_dir)).select(*KEYS, "name", "line", "end_line", F.array_join("called", "|").alias("called"))


_J13 = " UNION ALL ".join(f"SELECT project_id, 'action:' || {_VIEW} || ':5:save' AS source, 'api:' || {_API} || ':{line}:' || {method} || {url} AS target, 'initiates' AS kind FROM {_PART}" for line, method, url, *_ in _CALLS[:2])


@register("j13_link_actions_to_calls", _J13)
def j13(spark, sf_dir):
    scanned = _front(spark, sf_dir)
    linked = front.link_actions_to_calls(front.extract_frontend_functions(scanned), front.extract_http_calls(scanned))
    return linked.select("project_id", "source", "target", "kind")


_YAML = "svc || '/src/main/resources/application-dev' || k || '.yml'"
_SECRET = "CASE WHEN n % 8 = 0 THEN 'pw' ELSE 'secret' || k END"
_KEYED = [("spring", "''", 1, "true"), ("spring.datasource", "''", 2, "true"), ("spring.datasource.url", "'jdbc:mysql://db/item' || k", 3, "true"), ("spring.datasource.password", _SECRET, 4, "true"),
          ("spring.config", "''", 5, "n % 2 = 0"), ("spring.config.import", "'nacos:item' || k || '.yaml'", 6, "n % 2 = 0")]
_X17 = " UNION ALL ".join(f"SELECT project_id, {_YAML} AS relative_path, '{key}' AS key, {value} AS value, {line} AS line, k FROM {_PART} WHERE {when}" for key, value, line, when in _KEYED)
_P7 = f"SELECT *, key LIKE '%password%' AS sensitive, key LIKE '%import' AS remote_reference, 'dev' || k AS profile FROM ({_X17}) AS x WHERE key NOT IN ('spring', 'spring.config')"


@register("x17_flatten_yaml", f"SELECT project_id, relative_path, key, value, line FROM ({_X17}) AS x")
def x17(spark, sf_dir):
    return config.flatten_yaml(code(spark, sf_dir))


@register("p7_relevant_config", f"SELECT project_id, relative_path, key, CASE WHEN sensitive THEN '{facts.REDACTED}' ELSE value END AS value, sensitive, remote_reference, profile FROM ({_P7}) AS y")
def p7(spark, sf_dir):
    return config.relevant_config(config.flatten_yaml(code(spark, sf_dir))).select(*KEYS, "key", "value", "sensitive", "remote_reference", "profile")


@register("j24_link_config_source", f"SELECT project_id, 'config:' || relative_path || ':' || line || ':' || key AS source, 'config_source:' || relative_path AS target, 'provided_by' AS kind FROM ({_P7}) AS y")
def j24(spark, sf_dir):
    return config.link_config_source(config.relevant_config(config.flatten_yaml(code(spark, sf_dir)))).select("project_id", "source", "target", "kind")


_LAYERED = "(VALUES " + ", ".join(f"('{t}', {p}, '{role}', {k})" for t, _, p, roles in review.LAYERS for k, role in enumerate(roles)) + ") AS l(task_id, priority, role, rank)"
_TARGETS = f"t AS (SELECT project_id, task_id, priority, relative_path, rank FROM (SELECT *, {_ROLE} AS role FROM {CODE} AS f) AS r JOIN {_LAYERED} ON l.role = r.role), rel AS ({_J1})"
_RELATED = """n AS (SELECT t.project_id, t.task_id, rel.target AS other, rel.source AS s, rel.target AS g FROM t JOIN rel ON rel.project_id = t.project_id AND rel.source = t.relative_path WHERE t.task_id NOT IN ('config', 'architecture')
  UNION ALL SELECT t.project_id, t.task_id, rel.source, rel.source, rel.target FROM t JOIN rel ON rel.project_id = t.project_id AND rel.target = t.relative_path WHERE t.task_id NOT IN ('config', 'architecture')),
m AS (SELECT project_id, task_id, other, min({'s': s, 'g': g}) AS first FROM n WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.project_id = n.project_id AND t.task_id = n.task_id AND t.relative_path = n.other) GROUP BY ALL),
near AS (SELECT project_id, task_id, other AS relative_path FROM (SELECT *, row_number() OVER (PARTITION BY project_id, task_id ORDER BY first, other) AS k FROM m) AS z WHERE k <= 12)"""


def _held(spark, sf_dir):
    files = code(spark, sf_dir)
    return review.task_files(facts.classify_role(files).select(*KEYS, "role"), relate.relate_injections(files))


@register("j20_related_files", f"WITH {_TARGETS}, {_RELATED} SELECT project_id, task_id, relative_path FROM near")
def j20(spark, sf_dir):
    return _held(spark, sf_dir).where("kind = 'related' AND task_id <> 'architecture'").select("project_id", "task_id", "relative_path")


@register("o4_build_review_plan", f"""
WITH {_TARGETS}, {_RELATED},
c AS (SELECT project_id, task_id, priority, count(*) AS n_targets FROM t GROUP BY ALL), r AS (SELECT project_id, task_id, count(*) AS k FROM near GROUP BY ALL), d AS (SELECT project_id, least(8, n_targets) AS k FROM c WHERE task_id = 'database')
SELECT c.project_id, c.task_id, priority, n_targets, coalesce(CASE WHEN c.task_id = 'architecture' THEN d.k ELSE r.k END, 0) AS n_related
FROM c LEFT JOIN r ON r.project_id = c.project_id AND r.task_id = c.task_id LEFT JOIN d ON d.project_id = c.project_id
""")
def o4(spark, sf_dir):
    return review.build_review_plan(_held(spark, sf_dir)).select("project_id", "task_id", "priority", "n_targets", "n_related")


@register("j15_bind_task_metadata", f"""
SELECT q.project_id, seq, coalesce(chain_id, '') AS chain_id, coalesce(t.endpoint, q.endpoint) AS endpoint, coalesce(proven_status, q.chain_status) AS chain_status, coalesce(t.chain_path, '') AS chain_path, coalesce(gap, '') AS gaps, coalesce(t.endpoint, '') AS affected
FROM ({duck(FINDINGS)}) AS q LEFT JOIN (SELECT * FROM ({TASKS}) AS x WHERE kind = 'endpoint_chain') AS t ON t.project_id = q.project_id AND t.task_id = q.task_id
""")
def j15(spark, sf_dir):
    gaps = F.when(F.col("gap") != "", F.array("gap"))
    tasks = bound(spark, sf_dir, TASKS).withColumnRenamed("proven_status", "chain_status").withColumn("chain_gaps", gaps)
    out = review.bind_task_metadata(bound(spark, sf_dir, FINDINGS), tasks)
    return out.select("project_id", "seq", "chain_id", "endpoint", "chain_status", "chain_path", F.array_join("chain_gaps", "|").alias("gaps"), F.array_join("affected_endpoints", "|").alias("affected"))


_LINES = f"(SELECT project_id, relative_path, string_split(content, chr(10))[1:-2] AS lines FROM ({FINDING_FILES}) AS c)"
_WINDOW = "range(greatest(0, greatest(0, coalesce(line, 1) - 1) - 50) + 1, least(len(lines), greatest(0, coalesce(line, 1) - 1) + 80) + 1)"


# Relations of the findings' files; some have more than a context shows.
_TIES = """SELECT DISTINCT 'q' || cast(user_id % 4 AS string) AS project_id, 'm' || cast(user_id % 7 AS string) || '/src/F' || cast(user_id AS string) || '.java' AS source, event_type AS kind,
  'm' || cast(event_id % 7 AS string) || '/src/F' || cast(event_id % 200 AS string) || '.java' AS target FROM events"""
_SAID = f"""(SELECT project_id, relative_path, string_agg(source || ' --' || kind || '--> ' || target, chr(10) ORDER BY source, target, kind) AS relations
  FROM (SELECT *, row_number() OVER (PARTITION BY project_id, relative_path ORDER BY source, target, kind) AS k
        FROM (SELECT DISTINCT project_id, unnest([source, target]) AS relative_path, source, kind, target FROM ({_TIES}) AS t) AS e) AS r WHERE k <= {review.RELATIONS} GROUP BY ALL)"""


@register("j21_finding_context", f"""
SELECT q.project_id, seq, array_to_string(list_transform({_WINDOW}, lambda i: lpad(i::VARCHAR, 4, ' ') || ': ' || lines[i]), chr(10)) AS source, coalesce(relations, '') AS relations
FROM ({duck(FINDINGS)}) AS q LEFT JOIN {_LINES} AS l ON l.project_id = q.project_id AND l.relative_path = q.relative_path LEFT JOIN {_SAID} AS s ON s.project_id = q.project_id AND s.relative_path = q.relative_path
""")
def j21(spark, sf_dir):
    return review.finding_context(bound(spark, sf_dir, FINDINGS), bound(spark, sf_dir, FINDING_FILES), bound(spark, sf_dir, _TIES)).select("project_id", "seq", "source", "relations")


_SECTION = "list_position([" + ", ".join(f"'{s}'" for s in review.ORDER) + "], severity)"
# What wasn't covered: a few lines a project, one of them twice.
_LIMITS = "SELECT 'q' || cast(user_id % 4 AS string) AS project_id, 'limit ' || cast(user_id % 6 AS string) AS limit FROM events WHERE user_id % 4 <> 2"


def _told(name: str, value: str) -> str:
    return f"chr(10) || '- {name}' || {value}"


@register("s4_report_lines", _GOV_W7 + f"""
SELECT project_id, {_SECTION}::INT AS section, number::INT AS number, CASE WHEN number = 1 THEN chr(10) || '## ' || severity || chr(10) ELSE '' END || chr(10) || '### ' || number || '. ' || title || chr(10)
  || {_told("类别：", "category")} || {_told("位置：`", "relative_path || CASE WHEN coalesce(line, 0) > 0 THEN ':' || line ELSE '' END || '`'")} || {_told("置信度：", "confidence")}
  || CASE WHEN len(affected_endpoints) > 0 THEN {_told("接口：`", "affected_endpoints[1] || '`'")} ELSE '' END || CASE WHEN len(affected_endpoints) > 1 THEN {_told("受影响接口：", "array_to_string(affected_endpoints, '、')")} ELSE '' END
  || {_told("证据：", "evidence")} || {_told("触发路径：", "trigger_path")} || {_told("影响：", "impact")} || {_told("修复建议：", "recommendation")} AS text
FROM (SELECT *, row_number() OVER (PARTITION BY project_id, severity ORDER BY relative_path, coalesce(line, 0), seq) AS number FROM (SELECT w7.*, q.category, q.confidence, q.evidence, q.trigger_path, q.impact, q.recommendation,
        CASE WHEN coalesce(endpoints, '') = '' THEN [] ELSE string_split(endpoints, '|') END AS affected_endpoints FROM w7 JOIN ({duck(FINDINGS)}) AS q USING (project_id, seq)) AS v) AS w
UNION ALL SELECT project_id, {len(review.ORDER) + 1}, number::INT, CASE WHEN number = 1 THEN chr(10) || '{review.LIMITS}' || chr(10) || chr(10) ELSE '' END || '- ' || "limit"
FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY "limit") AS number FROM (SELECT DISTINCT * FROM ({_LIMITS.replace("AS limit", 'AS "limit"')}) AS l) AS d) AS e
""")
def s4(spark, sf_dir):
    pieces = review.report_lines(findings.number_findings(_governed(spark, sf_dir)), bound(spark, sf_dir, _LIMITS))
    return pieces.select("project_id", "section", "number", "text")

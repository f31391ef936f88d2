"""Queries of findings and replies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import facts, findings
from .bindings import FINDING_FILES, FINDINGS, bound, duck
from .fact_queries import _SCOPE, _SINK, _X5, KEYS, code, register

_RANK = "CASE severity " + " ".join(f"WHEN '{s}' THEN {k}" for s, k in T.RANKS.items()) + " ELSE 0 END"


def _any(text: str, words) -> str:
    return "(" + " OR ".join("contains({0}, {1})".format(text, "'" + w.replace("'", "''") + "'") for w in words) + ")"


f = findings
_TEXT = "concat_ws(' ', category, title, evidence, trigger_path, impact, recommendation)"
_FLAGS = f"""(SELECT project_id, relative_path, length(content) - length(replace(content, chr(10), '')) + 1 AS n_lines, contains(content, '$' || '{{') OR regexp_matches(content, '{_SINK}') AS sink,
  contains(content, 'ConcurrentHashMap') AS concurrent, contains(lower(content), 'expire(') OR contains(lower(content), 'ttl') AS expiry, {_any('lower(content)', f.CREDENTIALS)} AS credentials FROM ({FINDING_FILES}) AS c)"""
_GATE = f"(SELECT project_id, bool_or(contains(content, 'GlobalFilter')) AND bool_or(contains(content, 'validate(')) AND bool_or(contains(content, 'X-User-Id')) AS gateway FROM ({FINDING_FILES}) AS c WHERE contains(content, 'GlobalFilter') GROUP BY project_id)"
_HANDLERS = f"(SELECT DISTINCT project_id, {_SCOPE} AS scope, true AS handler FROM ({FINDING_FILES}) AS c WHERE contains(content, '@RestControllerAdvice') AND contains(content, '@ExceptionHandler'))"
_RUNTIME = f"(contains(low, 'runtimeexception') AND {_any('text', f.RUNTIME)})"
_IDENTITY = f"((contains(low, 'x-user-role') OR contains(low, 'x-user-id') OR contains(text, '身份请求头')) AND {_any('text', f.HEADER_DOUBT)})"
# Each step sees the severity that the one before left.
_P9 = f"""
WITH j AS (SELECT q.*, {_TEXT} AS text, lower({_TEXT}) AS low, n_lines, sink, concurrent, expiry, credentials, coalesce(gateway, false) AS gateway, coalesce(handler, false) AS handler
  FROM (SELECT *, {_SCOPE} AS scope FROM ({duck(FINDINGS)}) AS q0) AS q LEFT JOIN {_FLAGS} AS fl ON fl.project_id = q.project_id AND fl.relative_path = q.relative_path
  LEFT JOIN {_GATE} AS ga ON ga.project_id = q.project_id LEFT JOIN {_HANDLERS} AS ha ON ha.project_id = q.project_id AND ha.scope = q.scope),
a AS (SELECT *, CASE WHEN n_lines IS NULL OR trim(evidence) = '' THEN 'manual' WHEN line < 1 OR line > n_lines THEN 'manual' WHEN {_any('text', f.CONTRADICTING)} THEN 'reject'
  WHEN {_any('low', f.INJECTION_CLAIM)} AND NOT sink THEN 'reject' WHEN (contains(low, 'hashmap') OR contains(text, '线程安全')) AND concurrent THEN 'reject' WHEN {_any('text', f.NO_EXPIRY)} AND expiry THEN 'reject'
  WHEN {_any('text', f.NO_TRANSACTION)} THEN 'reject' WHEN {_any('text', f.ENTITY_RETURNED)} AND NOT credentials THEN 'reject' END AS d1 FROM j),
b AS (SELECT * REPLACE (CASE WHEN d1 IS NOT NULL THEN severity WHEN {_any('text', f.SHARED_DATABASE + f.UNUSED_FIELDS)} THEN '{T.SUGGESTION}' ELSE severity END AS severity) FROM a),
c AS (SELECT * REPLACE (CASE WHEN d1 IS NULL AND severity IN ('{T.CRITICAL}', '{T.MEDIUM}') AND ({_any('text', f.PATH_PARAMETER)} OR ({_RUNTIME} AND NOT handler)) THEN '{T.MINOR}' ELSE severity END AS severity),
  coalesce(d1, CASE WHEN {_RUNTIME} AND handler THEN 'reject' END) AS d2 FROM b),
d AS (SELECT * REPLACE (CASE WHEN d2 IS NULL AND {_any('text', f.LOST_UPDATE)} THEN '{T.SUGGESTION}' ELSE severity END AS severity), d2 IS NULL AND {_IDENTITY} AND gateway AS renamed FROM c),
e AS (SELECT * REPLACE (CASE WHEN renamed THEN '{f.IDENTITY_TITLE}' ELSE title END AS title), coalesce(d2, CASE WHEN renamed THEN 'manual' WHEN {_any('text', f.USER_LOG)} THEN 'reject'
  WHEN severity = '{T.CRITICAL}' AND (confidence <> '高' OR chain_status IN ('partial', 'needs_confirmation') OR {_any('text', f.CONDITIONAL)}) THEN 'manual' WHEN {_any('evidence', f.UNVERIFIED)} THEN 'manual'
  WHEN needs_human_confirmation OR severity = '{T.MANUAL}' THEN 'manual' END, 'keep') AS decision FROM d),
gov AS (SELECT project_id, seq, task_id, category, CASE WHEN decision = 'manual' THEN '{T.MANUAL}' ELSE severity END AS severity, title, relative_path, line, evidence, endpoint, decision FROM e WHERE decision <> 'reject')
"""


def _findings(spark, sf_dir):
    return bound(spark, sf_dir, FINDINGS)


def _files(spark, sf_dir):
    return bound(spark, sf_dir, FINDING_FILES)


@register("p9_govern", _P9 + "SELECT project_id, seq, severity, title, decision FROM gov")
def p9(spark, sf_dir):
    return findings.validate_evidence(_findings(spark, sf_dir), _files(spark, sf_dir)).select("project_id", "seq", "severity", "title", "decision")


_P8 = f"SELECT q.project_id, seq, CASE WHEN fl.project_id IS NULL OR trim(evidence) = '' THEN 'evidence' WHEN line < 1 OR line > n_lines THEN 'line' ELSE '' END AS problem FROM ({duck(FINDINGS)}) AS q LEFT JOIN {_FLAGS} AS fl ON fl.project_id = q.project_id AND fl.relative_path = q.relative_path"


@register("p8_validate_evidence", f"SELECT project_id, problem, count(*) AS n FROM ({_P8}) AS x WHERE problem <> '' GROUP BY ALL")
def p8(spark, sf_dir):
    checked = findings.validate_evidence(_findings(spark, sf_dir), _files(spark, sf_dir))
    return checked.where(F.col("rule").isin("evidence", "line")).groupBy("project_id", F.col("rule").alias("problem")).agg(F.count(F.lit(1)).alias("n"))


_LOW3 = "lower(concat_ws(' ', category, title, evidence))"
_SEP = "chr(31)"


def _root(name: str, where: str) -> str:
    return f"'root' || {_SEP} || '{name}' || {_SEP} || {where} || {_SEP} || '0'"


_KEY = f"""CASE WHEN (contains(low3, 'x-user-role') OR contains(low3, 'x-user-id') OR contains(low3, '身份请求头')) AND {_any('low3', f.HEADER_DOUBT)} THEN {_root('trusted_identity_header', "''")}
  WHEN contains(low3, 'runtimeexception') AND {_any('low3', f.RUNTIME)} THEN {_root('unhandled_business_exception', 'scope')} WHEN {_any('low3', f.PAGE_SIZE)} THEN {_root('unbounded_page_size', 'scope')}
  WHEN {_any('low3', f.SILENT_ERROR)} THEN {_root('silent_frontend_error', 'scope')} WHEN {_any('low3', f.PATH_ROOT)} THEN {_root('path_parameter_validation', 'scope')}
  WHEN {_any('low3', f.LOST_UPDATE)} THEN {_root('state_update_concurrency', 'scope')} WHEN {_any('low3', f.TRANSACTION_ROOT)} THEN {_root('multi_write_transaction', 'relative_path')}
  ELSE lower(trim(category)) || {_SEP} || lower(trim(title)) || {_SEP} || relative_path || {_SEP} || coalesce(cast(line AS string), '0') END"""


def _keyed(source: str) -> str:
    return f"(SELECT *, {_KEY} AS key FROM (SELECT *, {_SCOPE} AS scope, {_LOW3} AS low3 FROM {source} AS k0) AS k1)"


@register("f11_root_cause_key", f"SELECT project_id, seq, key FROM {_keyed(f'({duck(FINDINGS)})')} AS k")
def f11(spark, sf_dir):
    return _findings(spark, sf_dir).select("project_id", "seq", findings.root_cause_key().alias("key"))


_W7 = f"""(SELECT b.project_id, b.seq, severity, relative_path, line, title, endpoints FROM (SELECT *, row_number() OVER (PARTITION BY project_id, key ORDER BY {_RANK} DESC, seq) AS k FROM {{0}} AS x) AS b
JOIN (SELECT project_id, key, string_agg(endpoint, '|' ORDER BY first) AS endpoints FROM (SELECT project_id, key, endpoint, min(seq) AS first FROM {{0}} AS y GROUP BY ALL) AS z GROUP BY ALL) AS e ON e.project_id = b.project_id AND e.key = b.key WHERE b.k = 1)"""
_W7_RAW = _W7.format(_keyed(f"({duck(FINDINGS)})"))


@register("w7_dedup_findings", f"SELECT project_id, seq, severity, endpoints FROM {_W7_RAW} AS w")
def w7(spark, sf_dir):
    return findings.dedup_findings(_findings(spark, sf_dir)).select("project_id", "seq", "severity", F.array_join("affected_endpoints", "|").alias("endpoints"))


@register("a14_merge_affected_endpoints", f"SELECT project_id, key, string_agg(endpoint, '|' ORDER BY first) AS endpoints FROM (SELECT project_id, key, endpoint, min(seq) AS first FROM {_keyed(f'({duck(FINDINGS)})')} AS y GROUP BY ALL) AS z GROUP BY ALL")
def a14(spark, sf_dir):
    merged = findings.dedup_findings(_findings(spark, sf_dir))
    return merged.select("project_id", findings.root_cause_key().alias("key"), F.array_join("affected_endpoints", "|").alias("endpoints"))


_GOV_W7 = _P9 + ", w7 AS (SELECT * FROM " + _W7.format(_keyed("gov")) + " AS w) "


def _governed(spark, sf_dir):
    return findings.dedup_findings(findings.validate_evidence(_findings(spark, sf_dir), _files(spark, sf_dir)))


@register("a11_severity_counts", _GOV_W7 + "SELECT project_id, severity, count(*) AS n_findings FROM w7 GROUP BY ALL")
def a11(spark, sf_dir):
    return findings.severity_counts(_governed(spark, sf_dir))


@register("w11_number_findings", _GOV_W7 + f"SELECT project_id, seq, severity, row_number() OVER (PARTITION BY project_id, severity ORDER BY relative_path, coalesce(line, 0), seq) AS number FROM w7")
def w11(spark, sf_dir):
    return findings.number_findings(_governed(spark, sf_dir)).select("project_id", "seq", "severity", F.col("number").cast("long").alias("number"))


@register("t2_order_findings", f"SELECT project_id, seq, row_number() OVER (PARTITION BY project_id ORDER BY {_RANK} DESC, relative_path, coalesce(line, 0), seq) AS place FROM ({duck(FINDINGS)}) AS q")
def t2(spark, sf_dir):
    from pyspark.sql import Window

    window = Window.partitionBy("project_id").orderBy(*findings.order_findings())
    return _findings(spark, sf_dir).select("project_id", "seq", F.row_number().over(window).cast("long").alias("place"))


_VERDICTS = "SELECT 'q' || cast(e.user_id % 4 AS string) AS project_id, e.event_id AS seq, CASE WHEN l.quality = 1 THEN '成立' WHEN l.toxic = 1 THEN '不成立' ELSE '证据不足' END AS verdict, CASE WHEN l.toxic = 1 THEN 'p2' WHEN l.doc_id % 5 = 0 THEN 'none' ELSE 'critical' END AS recommended_severity, l.doc_id % 9 <> 0 AS valid FROM labels l JOIN events e ON e.event_id = l.doc_id"
_J17 = f"""
SELECT project_id, seq, CASE WHEN severity <> '{T.CRITICAL}' THEN severity WHEN up THEN level ELSE '{T.MANUAL}' END AS severity,
  CASE WHEN severity <> '{T.CRITICAL}' THEN 'unverified' WHEN up AND level = '{T.CRITICAL}' THEN 'upheld' WHEN up THEN 'recalibrated' WHEN ok THEN 'insufficient' ELSE 'failed' END AS review_status
FROM (SELECT *, ok AND coalesce(verdict, '') = '成立' AND level <> '{T.MANUAL}' AS up FROM (SELECT q.project_id, q.seq, q.severity, verdict, coalesce(valid, false) AS ok, CASE recommended_severity WHEN 'p2' THEN '{T.MEDIUM}' WHEN 'critical' THEN '{T.CRITICAL}' ELSE '{T.MANUAL}' END AS level
  FROM ({duck(FINDINGS)}) AS q LEFT JOIN ({_VERDICTS}) AS v ON v.project_id = q.project_id AND v.seq = q.seq) AS a) AS b WHERE NOT (severity = '{T.CRITICAL}' AND ok AND coalesce(verdict, '') = '不成立')
"""


@register("j17_apply_verdicts", _J17)
def j17(spark, sf_dir):
    return findings.apply_verdicts(_findings(spark, sf_dir), bound(spark, sf_dir, _VERDICTS)).select("project_id", "seq", "severity", "review_status")


_LOCAL = "CASE kind " + " ".join(f"WHEN '{k}' THEN {{{n}}}" for n, k in enumerate(f.TEMPLATES)) + " END"


def _pick(column: int) -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN '{v[column]}'" for k, v in f.TEMPLATES.items()) + " END"


@register("p10_local_findings", f"SELECT DISTINCT project_id, {_pick(0)} AS category, {_pick(1)} AS severity, {_pick(2)} AS title, relative_path, line FROM ({_X5}) AS s")
def p10(spark, sf_dir):
    return findings.local_findings(facts.extract_signals(code(spark, sf_dir)))


@register("a13_gateway_boundary", f"SELECT * FROM {_GATE} AS g")
def a13(spark, sf_dir):
    return findings.gateway_boundary(_files(spark, sf_dir))


@register("j16_module_has_handler", f"SELECT project_id, scope, handler FROM {_HANDLERS} AS h")
def j16(spark, sf_dir):
    return findings.handler_scopes(_files(spark, sf_dir))


@register("j14_attach_source", f"SELECT q.project_id, q.seq, n_lines, coalesce(sink, false) AS sink FROM ({duck(FINDINGS)}) AS q LEFT JOIN {_FLAGS} AS fl ON fl.project_id = q.project_id AND fl.relative_path = q.relative_path")
def j14(spark, sf_dir):
    joined = _findings(spark, sf_dir).join(findings.file_flags(_files(spark, sf_dir)), KEYS, "left")
    return joined.select("project_id", "seq", "n_lines", F.coalesce("sink", F.lit(False)).alias("sink"))


# Replies of two attempts a task; some are cut short, some hold no array, some are wrapped in a fence.
_REPLIES = """
SELECT 'q' || cast(user_id % 4 AS string) AS project_id, 't' || cast(event_id % 997 AS string) AS task_id, event_id AS attempt, event_id % 211 = 0 AS provider_error,
  cast(floor(value * 10) AS bigint) AS prompt_tokens, cast(floor(value) AS bigint) AS completion_tokens, cast(floor(value * 10) + floor(value) AS bigint) AS total_tokens,
  CASE WHEN event_id % 10 = 0 THEN '{"issues": [{"severity": "hi' WHEN event_id % 7 = 0 THEN '{"issues": "none"}' WHEN event_id % 11 = 0 THEN '{}'
    ELSE CASE WHEN event_id % 3 = 0 THEN 'Sure: ' ELSE '' END || '{"issues": [{"severity": "' || event_type || '", "title": "T' || cast(event_id AS string) || '", "file": "F.java", "line": "' || cast(event_id % 90 AS string) || '", "needs_human_confirmation": "yes"}, {"severity": "p1", "line": "x"}]}' END AS content
FROM events
"""
_OK = "event_ok"
_REPLY_OK = f"(SELECT *, NOT (attempt % 10 = 0 OR attempt % 7 = 0) AS ok FROM ({_REPLIES}) AS r)"


def _replies(spark, sf_dir):
    return bound(spark, sf_dir, _REPLIES)


_F7 = f"""
SELECT project_id, task_id, attempt, 0 AS ord, CASE WHEN json_extract_string(body, '$.issues[0].severity') IN ('low', 'warning') THEN '{T.MINOR}' ELSE '{T.MANUAL}' END AS severity, json_extract_string(body, '$.issues[0].title') AS title, 'F.java' AS relative_path, (attempt % 90)::INT AS line, true AS flag
FROM (SELECT *, regexp_extract(content, '(?s)\\{{.*\\}}', 0) AS body FROM {_REPLY_OK} AS r WHERE ok AND attempt % 11 <> 0) AS b
UNION ALL SELECT project_id, task_id, attempt, 1, '{T.MEDIUM}', '未命名问题', '', NULL, false FROM {_REPLY_OK} AS r WHERE ok AND attempt % 11 <> 0
"""


@register("f7_parse_findings", _F7)
def f7(spark, sf_dir):
    numbered = _replies(spark, sf_dir).withColumn("task_id", F.concat_ws("#", "task_id", F.col("attempt").cast("string")))
    found = findings.explode_findings(findings.parse_findings(numbered))
    parts = F.split("task_id", "#")
    return found.select("project_id", parts[0].alias("task_id"), parts[1].cast("long").alias("attempt"), "ord", "severity", "title", "relative_path", "line", F.col("needs_human_confirmation").alias("flag"))


@register("f6_extract_json", f"SELECT project_id, attempt, CASE WHEN regexp_extract(content, '(?s)\\{{.*\\}}', 0) = '' THEN trim(content) ELSE regexp_extract(content, '(?s)\\{{.*\\}}', 0) END AS body FROM ({_REPLIES}) AS r")
def f6(spark, sf_dir):
    return _replies(spark, sf_dir).select("project_id", "attempt", findings.extract_json("content").alias("body"))


@register("a15_failed_tasks", f"SELECT project_id, task_id FROM {_REPLY_OK} AS r GROUP BY ALL HAVING bool_and(NOT ok) OR bool_or(provider_error)")
def a15(spark, sf_dir):
    return findings.failed_tasks(findings.parse_findings(_replies(spark, sf_dir)))


@register("a9_usage_totals", f"SELECT project_id, sum(prompt_tokens) AS prompt_tokens, sum(completion_tokens) AS completion_tokens, sum(total_tokens) AS total_tokens FROM ({_REPLIES}) AS r GROUP BY project_id")
def a9(spark, sf_dir):
    return findings.usage_totals(_replies(spark, sf_dir))


@register("w10_cumulative_tokens", f"SELECT project_id, task_id, task_tokens, sum(task_tokens) OVER (PARTITION BY project_id ORDER BY task_id ROWS UNBOUNDED PRECEDING) AS running_tokens FROM (SELECT project_id, task_id, sum(total_tokens) AS task_tokens FROM ({_REPLIES}) AS r GROUP BY ALL) AS t")
def w10(spark, sf_dir):
    return findings.cumulative_tokens(_replies(spark, sf_dir))

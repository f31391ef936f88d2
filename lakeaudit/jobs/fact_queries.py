"""Queries of scanning, scalar functions and per-file facts."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import facts
from ..sources.files import files_from_table
from ..sources.shared import written
from ..sources.tables import table
from .bindings import KINDS, RAW_CODE, RAW_PROSE, bound, duck
from .registry import ORACLES, QUERIES

KEYS = facts.KEYS


def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The templated code, written once: its readers scan it many times and would spell its texts out each time."""
    # One branch a kind of file, so that each compiles only its own text expression.
    kinds = [bound(spark, sf_dir, RAW_CODE.replace("{kinds}", f"SELECT {k} AS f")) for k in range(KINDS)]
    return written(files_from_table(reduce(DataFrame.unionAll, kinds)), "code")


def prose(spark: SparkSession, sf_dir: str) -> DataFrame:
    return files_from_table(bound(spark, sf_dir, RAW_PROSE))


def register(name: str, sql: str | None = None):
    def keep(f):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return keep


_LANG_CASE = "CASE lower(regexp_extract(relative_path, '[^/]\\.([^./]+)$', 1)) " + " ".join(f"WHEN '{s}' THEN '{lang}'" for s, lang in T.LANGUAGES.items()) + " END"
_NO_IGNORED = " AND ".join(f"NOT list_contains(string_split(relative_path, '/'), '{d}')" for d in T.IGNORED)


def _files(raw: str) -> str:
    return f"""(SELECT project_id, relative_path, {_LANG_CASE} AS language, content,
      CASE WHEN content = '' THEN 0 ELSE length(content) - length(replace(content, chr(10), '')) + 1 END AS line_count, byte_size
      FROM ({duck(raw)}) AS raw WHERE {_LANG_CASE} IS NOT NULL AND {_NO_IGNORED} AND byte_size <= {T.MAX_BYTES})"""


CODE, PROSE = _files(RAW_CODE), _files(RAW_PROSE)


def _find(files: str, where: str, pattern: str, groups: int = 0) -> str:
    """project_id, relative_path, language, line, m (match) and g1.. of each match, in DuckDB."""
    p = pattern.replace("'", "''")
    arrays = "".join(f", regexp_extract_all(content, '{p}', {k}) AS a{k}" for k in range(1, groups + 1))
    picked = "".join(f", a{k}[i] AS g{k}" for k in range(1, groups + 1))
    count = "length(x) - length(replace(x, chr(10), ''))"
    return f"""(SELECT project_id, relative_path, language, m[i] AS m,
        (1 + coalesce(list_sum(list_transform(gaps[1:i], lambda x: {count})), 0) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: {count})), 0))::INT AS line{picked}
      FROM (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM (SELECT *, regexp_extract_all(content, '{p}') AS m, string_split_regex(content, '{p}') AS gaps{arrays}
            FROM {files} AS f WHERE {where}) AS s) AS t)"""


_SCAN = "SELECT project_id, relative_path, language, line_count, byte_size FROM {0} AS f"


@register("s2_files_from_table", _SCAN.format(PROSE))
def s2(spark, sf_dir):
    return prose(spark, sf_dir).select(*KEYS, "language", "line_count", F.col("byte_size").cast("long").alias("byte_size"))


@register("p1_with_language", f"SELECT project_id, relative_path, {_LANG_CASE} AS language FROM ({duck(RAW_PROSE)}) AS r WHERE {_LANG_CASE} IS NOT NULL")
def p1(spark, sf_dir):
    raw = bound(spark, sf_dir, RAW_PROSE)
    return raw.select(*KEYS, T.language("relative_path").alias("language")).where("language is not null")


@register("p2_filter_scannable", f"SELECT project_id, relative_path FROM ({duck(RAW_PROSE)}) AS r WHERE {_NO_IGNORED} AND byte_size <= {T.MAX_BYTES}")
def p2(spark, sf_dir):
    return bound(spark, sf_dir, RAW_PROSE).where(T.is_scannable("relative_path", "byte_size")).select(*KEYS)


@register("p3_with_line_count", f"SELECT project_id, relative_path, line_count FROM {CODE} AS f")
def p3(spark, sf_dir):
    return bound(spark, sf_dir, RAW_CODE).select(*KEYS, T.line_count("content").alias("line_count"))


_ROLE = """CASE WHEN language = 'java' THEN CASE
    WHEN contains(content, '@RestController') OR contains(content, '@Controller') THEN 'controller' WHEN contains(content, '@Service') THEN 'service'
    WHEN contains(content, '@Mapper') OR relative_path LIKE '%Mapper.java' THEN 'mapper' WHEN contains(content, '@Entity') OR contains(content, '@TableName') THEN 'entity'
    WHEN relative_path LIKE '%DTO.java' OR relative_path LIKE '%VO.java' OR relative_path LIKE '%Request.java' OR relative_path LIKE '%Response.java' THEN 'dto' ELSE 'java_other' END
  WHEN language = 'vue' THEN 'vue_component' WHEN language IN ('javascript', 'typescript') THEN 'frontend_script' WHEN language = 'sql' THEN 'sql_file'
  WHEN language = 'xml' AND contains(content, '<mapper') THEN 'mapper_xml' WHEN language = 'yaml' THEN 'configuration' END"""


@register("p4_classify_role", f"SELECT project_id, relative_path, role FROM (SELECT *, {_ROLE} AS role FROM {CODE} AS f) AS r WHERE role IS NOT NULL")
def p4(spark, sf_dir):
    return facts.classify_role(code(spark, sf_dir)).select(*KEYS, "role")


_IS_TEST = "len(list_filter(string_split(lower(relative_path), '/'), lambda p: p IN ('test','tests','fixture','fixtures','example','examples','demo') OR p LIKE 'test\\_%' ESCAPE '\\' OR p LIKE '%\\_test' ESCAPE '\\')) > 0"


@register("p5_is_test_or_example", f"SELECT project_id, relative_path, {_IS_TEST} AS is_test FROM ({duck(RAW_PROSE)}) AS r")
def p5(spark, sf_dir):
    return bound(spark, sf_dir, RAW_PROSE).select(*KEYS, T.is_test_or_example("relative_path").alias("is_test"))


_SCOPE = "CASE WHEN contains(relative_path, '/src/') THEN string_split(relative_path, '/src/')[1] ELSE string_split(relative_path, '/')[1] END"


@register("p6_module_scope", f"SELECT project_id, {_SCOPE} AS scope, count(*) AS n_files FROM {CODE} AS f GROUP BY ALL")
def p6(spark, sf_dir):
    return code(spark, sf_dir).groupBy("project_id", T.module_scope("relative_path").alias("scope")).agg(F.count(F.lit(1)).alias("n_files"))


@register("a3_language_counts", f"SELECT project_id, language, count(*) AS n_files FROM {PROSE} AS f GROUP BY ALL")
def a3(spark, sf_dir):
    return prose(spark, sf_dir).groupBy("project_id", "language").agg(F.count(F.lit(1)).alias("n_files"))


_URL_STEPS = [(r"^https?://[^/]+", ""), (r"\$\{[^}]+\}", "{}"), (r"\{[^}]+\}", "{}"), (r"/:[^/]+", "/{}"), ("/+", "/")]


def _duck_url(url: str) -> str:
    out = f"string_split(trim({url}), '?')[1]"
    for a, b in _URL_STEPS:
        out = f"regexp_replace({out}, '{a}', '{b}', 'g')"
    out = f"(SELECT CASE WHEN y = '' THEN '/' ELSE y END FROM (SELECT regexp_replace(CASE WHEN x <> '' AND x NOT LIKE '/%' THEN '/' || x ELSE x END, '/+$', '') AS y FROM (SELECT {out} AS x) AS s1) AS s2)"
    return out


@register("f1_normalize_url", f"SELECT page_id, {_duck_url('url')} AS normalized_url FROM pages")
def f1(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", T.normalize_url("url").alias("normalized_url"))


_JOIN = "CASE WHEN page_id % 5 = 0 THEN '' ELSE '/api/v' || cast(page_id % 3 AS string) || '/' END"


@register("f2_join_url", f"SELECT page_id, {_duck_url('joined')} AS joined FROM (SELECT page_id, CASE WHEN pre = '' THEN suf WHEN suf = '' THEN pre ELSE regexp_replace(pre, '/+$', '') || '/' || regexp_replace(suf, '^/+', '') END AS joined FROM (SELECT page_id, {_JOIN} AS pre, regexp_extract(url, '://[^/]*(.*)', 1) AS suf FROM pages) AS a) AS b")
def f2(spark, sf_dir):
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", T.join_url(F.expr(_JOIN), F.regexp_extract("url", "://[^/]*(.*)", 1)).alias("joined"))


_TYPES = "'List<' || p_type || '>' || CASE p_partkey % 4 WHEN 0 THEN '[]' WHEN 1 THEN '?' ELSE '' END"
_TYPE_NAMES = f"SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN {_TYPES} ELSE 'com.demo.' || replace(p_brand, '#', '') || '<A, B<C>>' END AS t FROM part"


@register("f3_normalize_type", f"SELECT p_partkey, trim(list_last(string_split(replace(replace(regexp_replace(t, '<.*>', ''), '[]', ''), '?', ''), '.'))) AS type_name FROM ({_TYPE_NAMES}) AS x")
def f3(spark, sf_dir):
    return bound(spark, sf_dir, _TYPE_NAMES).select("p_partkey", T.normalize_type("t").alias("type_name"))


_CAMEL = "SELECT p_partkey, replace(upper(substr(p_name, 1, 1)) || substr(p_name, 2), ' ', 'X') || 'Id' AS t FROM part"


@register("f4_snake_case", f"SELECT p_partkey, lower(substr(t, 1, 1) || regexp_replace(substr(t, 2), '([A-Z])', '_\\1', 'g')) AS snake FROM ({_CAMEL}) AS x")
def f4(spark, sf_dir):
    return bound(spark, sf_dir, _CAMEL).select("p_partkey", T.snake_case("t").alias("snake"))


@register("f5_stable_id", "SELECT p_partkey, 'part:' || p_brand || ':' || cast(p_size AS string) || ':' || replace(p_name, ' ', '') AS node_id FROM part")
def f5(spark, sf_dir):
    return table(spark, sf_dir, "part").select("p_partkey", T.stable_id("part", "p_brand", "p_size", "p_name").alias("node_id"))


_RATIO = "SELECT user_id, count(*) AS n, count(CASE WHEN event_type = 'error' THEN 1 END) AS errors, count(CASE WHEN value > 1e9 THEN 1 END) AS none FROM events GROUP BY user_id"


@register("f9_ratio", f"SELECT user_id, round(errors / n, 4) AS error_rate, CASE WHEN none = 0 THEN 1.0 ELSE round(errors / none, 4) END AS empty_rate FROM ({_RATIO}) AS x")
def f9(spark, sf_dir):
    return bound(spark, sf_dir, _RATIO).select("user_id", T.ratio("errors", "n").alias("error_rate"), T.ratio("errors", "none").alias("empty_rate"))


_ALIASES = [name for names in T.SEVERITY_ALIASES.values() for name in names]
_SEV = "SELECT event_id, CASE event_id % " + str(len(_ALIASES) + 2) + " " + " ".join(f"WHEN {k} THEN ' {n.upper() if n.isascii() else n} '" for k, n in enumerate(_ALIASES)) + " ELSE 'else' END AS severity, CASE event_id % 6 WHEN 0 THEN ' True' WHEN 1 THEN '1' WHEN 2 THEN 'no' WHEN 3 THEN '是' WHEN 4 THEN 'YES' END AS flag FROM events"
_SEV_CASE = "CASE " + " ".join(f"WHEN lower(trim(severity)) IN ({', '.join(repr(n) for n in names)}) THEN '{level}'" for level, names in T.SEVERITY_ALIASES.items()) + f" ELSE '{T.MANUAL}' END"


@register("f8_normalize_severity", f"SELECT event_id, {_SEV_CASE} AS severity, coalesce(lower(trim(flag)) IN ('true', '1', 'yes', '是'), false) AS flag FROM ({_SEV}) AS x")
def f8(spark, sf_dir):
    return bound(spark, sf_dir, _SEV).select("event_id", T.normalize_severity("severity").alias("severity"), T.as_bool("flag").alias("flag"))


_SINK = r"""(?is)\b(select|update|delete|insert)\b.{0,240}?["'']\s*\+\s*[A-Za-z_(]"""


@register("f13_sql_injection_sink", f"SELECT project_id, relative_path, contains(content, '$' || '{{') OR regexp_matches(content, '{_SINK}') AS sink FROM {CODE} AS f")
def f13(spark, sf_dir):
    return code(spark, sf_dir).select(*KEYS, T.has_sql_injection_sink("content").alias("sink"))


_ROUTE = facts.ROUTE
_X1 = _find(CODE, "language = 'java'", _ROUTE, 2)


@register("x1_extract_routes", f"SELECT project_id, relative_path, line, upper(g1) AS method, g2 AS path FROM {_X1} AS t")
def x1(spark, sf_dir):
    return facts.extract_routes(code(spark, sf_dir)).drop("ord")


_FRONT = "language IN ('vue', 'javascript', 'typescript')"
_X2 = f"SELECT project_id, relative_path, line, upper(g1) AS method, g2 AS path FROM {_find(CODE, _FRONT, facts.VERB_CALL, 2)} AS t UNION ALL SELECT project_id, relative_path, line, 'FETCH' AS method, g1 AS path FROM {_find(CODE, _FRONT, facts.FETCH_CALL, 1)} AS u"


@register("x2_extract_api_calls", _X2)
def x2(spark, sf_dir):
    return facts.extract_api_calls(code(spark, sf_dir)).drop("pattern", "ord")


_SQL_FILES = "language IN ('xml', 'sql', 'java')"


def _tag(verb: str) -> str:
    return rf"""(?is)<{verb}\b[^>]*(?:id=["']([^"']+)["'])?[^>]*>(.*?)</{verb}>"""


_TAGS = " UNION ALL ".join(
    f"SELECT project_id, relative_path, line, '{v}' AS operation, g2 AS body FROM {_find(CODE, _SQL_FILES, _tag(v), 2)} AS t{v}" for v in ("select", "insert", "update", "delete")
)
_COMPACT = "substr(trim(regexp_replace({0}, '\\s+', ' ', 'g')), 1, 500)"
_X3 = f"""
SELECT project_id, relative_path, line, operation, {_COMPACT.format('body')} AS statement FROM ({_TAGS}) AS a
UNION ALL SELECT project_id, relative_path, line, lower(g1), {_COMPACT.format('g2')} FROM {_find(CODE, _SQL_FILES, facts.SQL_ANNOTATION, 2)} AS b
UNION ALL SELECT project_id, relative_path, line, lower(regexp_extract(m, '^\\S+', 0)), {_COMPACT.format('m')} FROM {_find(CODE, _SQL_FILES, facts.SQL_BARE)} AS c
  WHERE language = 'sql' OR contains(lower(m), 'select')
"""


@register("x3_extract_sql_operations", _X3)
def x3(spark, sf_dir):
    return facts.extract_sql_operations(code(spark, sf_dir))


@register("x4_extract_config_findings", f"SELECT project_id, relative_path, line, g1 AS key, '{facts.REDACTED}' AS value FROM {_find(CODE, "language = 'yaml'", facts.SECRET, 2)} AS t UNION ALL SELECT project_id, relative_path, line, g1, '{facts.REDACTED}' FROM {_find(PROSE, "language = 'yaml'", facts.SECRET, 2)} AS u")
def x4(spark, sf_dir):
    return facts.extract_config_findings(code(spark, sf_dir).unionByName(prose(spark, sf_dir)))


_OWNERS = f"(SELECT project_id, class, max(relative_path) AS relative_path FROM (SELECT project_id, relative_path, regexp_extract(content, '{facts.CLASS}', 1) AS class FROM {CODE} AS f WHERE language = 'java') AS c WHERE class <> '' GROUP BY ALL)"
_X5 = f"""
SELECT t.project_id, t.relative_path, t.line, 'controller_direct_mapper' AS kind FROM {_find(CODE, "language = 'java' AND contains(content, '@RestController')", facts.INJECTION, 2)} AS t SEMI JOIN {_OWNERS} AS o ON o.project_id = t.project_id AND o.relative_path = t.relative_path WHERE g1 LIKE '%Mapper'
UNION ALL SELECT project_id, relative_path, 1, 'write_without_transaction' FROM {CODE} AS f WHERE ({_ROLE}) = 'service' AND NOT contains(content, '@Transactional') AND regexp_matches(content, '{facts.WRITES}')
UNION ALL SELECT project_id, relative_path, len(string_split(string_split(content, '$' || '{{')[1], chr(10))), 'mybatis_dollar_placeholder' FROM {CODE} AS f WHERE {_SQL_FILES} AND contains(content, '$' || '{{')
UNION ALL SELECT project_id, relative_path, line, 'sql_string_concatenation' FROM {_find(CODE, _SQL_FILES, facts.CONCATENATION)} AS a
UNION ALL SELECT project_id, relative_path, line, 'select_star' FROM {_find(CODE, _SQL_FILES, facts.SELECT_STAR)} AS b
UNION ALL SELECT project_id, relative_path, line, 'vue_v_html' FROM {_find(CODE, _FRONT, r'v-html\s*=')} AS c
UNION ALL SELECT project_id, relative_path, line, 'plaintext_secret' FROM {_find(CODE, "language = 'yaml'", facts.SECRET)} AS d
"""


@register("x5_extract_signals", _X5)
def x5(spark, sf_dir):
    return facts.extract_signals(code(spark, sf_dir))


_GENERIC = "language IN ('c', 'cpp', 'go', 'python', 'rust', 'java', 'javascript', 'typescript', 'vue')"
_X6 = f"""
SELECT project_id, relative_path, line, 'generic_plaintext_secret' AS kind FROM {_find(PROSE, f"{_GENERIC} AND NOT ({_IS_TEST})", facts.SECRET)} AS a
UNION ALL SELECT project_id, relative_path, line, 'generic_command_execution' FROM {_find(PROSE, _GENERIC, facts.COMMAND)} AS b
UNION ALL SELECT project_id, relative_path, 1, 'generic_large_file' FROM {PROSE} AS f WHERE {_GENERIC} AND line_count > 300
"""


@register("x6_extract_generic_signals", _X6)
def x6(spark, sf_dir):
    return facts.extract_generic_signals(prose(spark, sf_dir))


@register("x7_extract_injections", f"SELECT project_id, relative_path, line, g1 AS type, g2 AS variable FROM {_find(CODE, "language = 'java'", facts.INJECTION, 2)} AS t")
def x7(spark, sf_dir):
    return facts.extract_injections(code(spark, sf_dir))


_X15 = " UNION ALL ".join(
    f"""SELECT t.project_id, t.relative_path, n.namespace, regexp_extract(g1, '\\bid\\s*=\\s*["'']([^"'']+)["'']', 1) AS statement_id, line, '{v}' AS operation, {_COMPACT.format('g2')} AS statement
    FROM {_find(CODE, "language = 'xml' AND contains(content, '<mapper')", '(?is)<' + v + r'\b([^>]*)>(.*?)</' + v + '>', 2)} AS t
    JOIN (SELECT project_id, relative_path, regexp_extract(content, '<mapper\\b[^>]*\\bnamespace\\s*=\\s*["'']([^"'']+)["'']', 1) AS namespace FROM {CODE} AS f WHERE language = 'xml') AS n
      ON n.project_id = t.project_id AND n.relative_path = t.relative_path AND n.namespace <> ''"""
    for v in ("select", "insert", "update", "delete")
)


@register("x15_extract_xml_sql", _X15)
def x15(spark, sf_dir):
    return facts.extract_xml_sql(code(spark, sf_dir)).drop("end_line")


_TABLES = "list_transform(regexp_extract_all(statement, CASE operation WHEN 'select' THEN '(?i)\\bfrom\\s+([`\\w.]+)' WHEN 'insert' THEN '(?i)\\binsert\\s+into\\s+([`\\w.]+)' WHEN 'update' THEN '(?i)\\bupdate\\s+([`\\w.]+)' ELSE '(?i)\\bdelete\\s+from\\s+([`\\w.]+)' END, 1), lambda t: trim(t, '`'))"
_X16 = f"""
SELECT project_id, relative_path, statement_id, coalesce(array_to_string((SELECT list(x ORDER BY k) FROM (SELECT x, min(k) AS k FROM (SELECT unnest(tt) AS x, unnest(range(1, len(tt) + 1)) AS k) AS u GROUP BY x) AS v), ','), '') AS tables,
  contains(statement, '$' || '{{') AS uses_dollar, regexp_matches(statement, '(?i)\\bselect\\s+\\*') AS uses_select_star, regexp_matches(statement, '(?i)\\bwhere\\b') AS has_where, regexp_matches(statement, '(?i)\\blimit\\b|\\boffset\\b') AS has_pagination
FROM (SELECT *, {_TABLES} AS tt FROM ({_X15}) AS q) AS s
"""


@register("x16_sql_facts", _X16)
def x16(spark, sf_dir):
    found = facts.sql_facts(facts.extract_xml_sql(code(spark, sf_dir)))
    return found.select(*KEYS, "statement_id", F.array_join("tables", ",").alias("tables"), "uses_dollar", "uses_select_star", "has_where", "has_pagination")


@register("w3_last_definition", f"SELECT * FROM {_OWNERS} AS o")
def w3(spark, sf_dir):
    return facts.class_files(code(spark, sf_dir))

"""Queries of relations, ownership, the evidence graph and its chains."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts, graph, java, relate
from ..sources.tables import table
from .bindings import EDGES, bound, bound_to_edges, duck
from .fact_queries import _ROLE, _TABLES, _X1, _X2, _X15, _X16, CODE, KEYS, _duck_url, _find, _OWNERS, code, prose, register, PROSE

_INJECTIONS = _find(CODE, "language = 'java'", facts.INJECTION, 2)
_J1 = f"SELECT i.project_id, i.relative_path AS source, o.relative_path AS target, 'injects' AS kind, g1 AS evidence FROM {_INJECTIONS} AS i JOIN {_OWNERS} AS o ON o.project_id = i.project_id AND o.class = g1"


@register("j1_relate_injections", _J1)
def j1(spark, sf_dir):
    return relate.relate_injections(code(spark, sf_dir))


# Paths of pages as calls, and the distinct shapes of their paths as routes, some without a slash.
_PAGE_CALLS = "SELECT 'w' || cast(page_id % 3 AS string) AS project_id, 'page' || cast(page_id AS string) AS relative_path, CASE WHEN page_id % 17 = 0 THEN 'fr' ELSE regexp_extract(url, '://[^/]*([^#]*)', 1) END AS path FROM pages"
_PAGE_ROUTES = "SELECT DISTINCT 'w' || cast(page_id % 3 AS string) AS project_id, 'route' || cast(page_id % 7 AS string) AS relative_path, CASE page_id % 9 WHEN 0 THEN '/fr' WHEN 1 THEN 'html' WHEN 2 THEN '' ELSE '/' || cast(page_id % 50 AS string) END AS path FROM pages"
_J2 = f"""
SELECT c.project_id, c.relative_path AS source, r.relative_path AS target, 'calls_route' AS kind, c.path || ' -> ' || r.path AS evidence
FROM (SELECT *, regexp_replace(string_split(path, '?')[1], '/+$', '') AS x FROM ({_PAGE_CALLS}) AS a) AS c
JOIN (SELECT *, regexp_replace(path, '/+$', '') AS y FROM ({_PAGE_ROUTES}) AS b) AS r ON c.project_id = r.project_id AND x <> '' AND y <> '' AND (ends_with(x, y) OR ends_with(y, x))
"""


@register("j2_relate_calls_to_routes", _J2)
def j2(spark, sf_dir):
    return relate.relate_calls_to_routes(bound(spark, sf_dir, _PAGE_CALLS), bound(spark, sf_dir, _PAGE_ROUTES))


_ENDS = f"(SELECT DISTINCT project_id, 'endpoint:' || relative_path || ':' || line || ':' || method || u AS node_id, method || ' ' || u AS name, relative_path, line, method, u AS normalized_url FROM (SELECT *, {_duck_url('path')} AS u FROM (SELECT project_id, relative_path, line, upper(g1) AS method, g2 AS path FROM {_X1} AS t) AS q WHERE path <> '') AS s)"
_APIS = f"(SELECT project_id, 'api:' || relative_path || ':' || line || ':' || method || u AS node_id, method, u AS normalized_url, CASE WHEN contains(path, '{{') THEN 'medium' ELSE 'high' END AS url_confidence FROM (SELECT *, {_duck_url('path')} AS u FROM ({_X2}) AS q) AS s)"
_J12 = f"""(SELECT DISTINCT a.project_id, a.node_id AS source, e.node_id AS target, CASE WHEN a.method = e.method AND url_confidence = 'high' THEN 'high' ELSE 'medium' END AS confidence
FROM {_APIS} AS a JOIN {_ENDS} AS e ON a.project_id = e.project_id AND a.normalized_url = e.normalized_url AND (a.method = e.method OR a.method IN ('FETCH', 'REQUEST') OR e.method = 'REQUEST'))"""


def _ends(spark, sf_dir):
    return relate.endpoints(facts.extract_routes(code(spark, sf_dir)))


def _apis(spark, sf_dir):
    return relate.api_nodes(facts.extract_api_calls(code(spark, sf_dir)))


@register("x1_normalized_routes", f"SELECT * FROM {_ENDS} AS e")
def x1_nodes(spark, sf_dir):
    return _ends(spark, sf_dir)


@register("j12_match_frontend_to_endpoint", f"SELECT * FROM {_J12} AS j")
def j12(spark, sf_dir):
    return relate.match_frontend_to_endpoint(_apis(spark, sf_dir), _ends(spark, sf_dir))


@register("j18_unmatched_frontend", f"SELECT project_id, node_id FROM {_APIS} AS a ANTI JOIN {_J12} AS j ON a.project_id = j.project_id AND a.node_id = j.source")
def j18a(spark, sf_dir):
    apis = _apis(spark, sf_dir)
    return relate.unmatched(apis, relate.match_frontend_to_endpoint(apis, _ends(spark, sf_dir)), "source").select("project_id", "node_id")


@register("j18_unmatched_endpoints", f"SELECT project_id, node_id FROM {_ENDS} AS a ANTI JOIN {_J12} AS j ON a.project_id = j.project_id AND a.node_id = j.target")
def j18b(spark, sf_dir):
    ends = _ends(spark, sf_dir)
    return relate.unmatched(ends, relate.match_frontend_to_endpoint(_apis(spark, sf_dir), ends), "target").select("project_id", "node_id")


_MARKS = """(SELECT project_id, bool_or(contains(content, '@SpringBootApplication') OR contains(lower(content), 'spring-boot')) AS boot,
  bool_or(language = 'java' AND (contains(content, '@RestController') OR contains(content, '@Controller'))) AS controller,
  bool_or(contains(content, 'org.apache.ibatis') OR contains(content, '<mapper') OR contains(content, '@Mapper')) AS mybatis, bool_or(contains(lower(content), 'nacos')) AS nacos,
  bool_or(language = 'vue') AS vue, bool_or(language = 'sql' OR contains(lower(content), 'mysql')) AS mysql,
  bool_or(language IN ('c', 'cpp', 'go', 'python', 'rust', 'java', 'javascript', 'typescript', 'vue')) AS generic FROM {0} AS f GROUP BY project_id)"""


@register("a1_technologies", f"SELECT project_id, CASE WHEN t = '' THEN '未识别的项目类型' ELSE t END AS technologies FROM (SELECT project_id, concat_ws('|', CASE WHEN boot THEN 'Spring Boot' END, CASE WHEN mybatis THEN 'MyBatis' END, CASE WHEN nacos THEN 'Nacos' END, CASE WHEN vue THEN 'Vue' END, CASE WHEN mysql THEN 'MySQL' END) AS t FROM {_MARKS.format(CODE)} AS m) AS x")
def a1(spark, sf_dir):
    return relate.technologies(code(spark, sf_dir)).select("project_id", F.array_join("technologies", "|").alias("technologies"))


_A2 = f"""SELECT project_id, least((CASE WHEN boot THEN 60 WHEN controller THEN 55 ELSE 0 END) + (CASE WHEN mybatis THEN 15 ELSE 0 END) + (CASE WHEN nacos THEN 10 ELSE 0 END) + (CASE WHEN vue THEN 10 ELSE 0 END), 100) / 100 AS score,
  CASE WHEN r = '' THEN '未发现 SpringVue 特征' ELSE r END AS reasons, CASE WHEN generic THEN 0.1 ELSE 0.0 END AS generic_score
  FROM (SELECT *, concat_ws('、', CASE WHEN boot THEN 'Spring Boot 启动标记' WHEN controller THEN 'Spring MVC Controller' END, CASE WHEN mybatis THEN 'MyBatis' END, CASE WHEN nacos THEN 'Nacos' END, CASE WHEN vue THEN 'Vue' END) AS r FROM {{0}} AS m) AS x"""
_BOTH = f"(SELECT * FROM {CODE} AS c UNION ALL SELECT * FROM {PROSE} AS p)"


def _both(spark, sf_dir):
    return code(spark, sf_dir).unionByName(prose(spark, sf_dir))


@register("a2_detect_capability", _A2.format(_MARKS.format(_BOTH)))
def a2(spark, sf_dir):
    return relate.detect_capability(_both(spark, sf_dir))


_GEN = "('c', 'cpp', 'go', 'python', 'rust', 'java', 'javascript', 'typescript', 'vue')"
_W4 = f"""SELECT f.project_id, relative_path, CASE WHEN score >= 0.5 AND language IN ('java', 'vue', 'javascript', 'typescript', 'sql', 'xml', 'yaml') THEN 'SpringVue' WHEN language IN {_GEN} THEN 'Generic' END AS owner
  FROM {_BOTH} AS f JOIN ({_A2.format(_MARKS.format(_BOTH))}) AS d ON f.project_id = d.project_id"""


@register("w4_allocate_owners", _W4)
def w4(spark, sf_dir):
    return relate.allocate_owners(_both(spark, sf_dir))


@register("o2_uncovered_files", f"SELECT project_id, relative_path FROM ({_W4}) AS w WHERE owner IS NULL")
def o2(spark, sf_dir):
    owners = relate.allocate_owners(_both(spark, sf_dir))
    return owners.where("owner is null").select(*KEYS)


@register("a16_coverage_report", f"SELECT project_id, coalesce(owner, 'uncovered') AS owner, count(*) AS n_files FROM ({_W4}) AS w GROUP BY ALL")
def a16(spark, sf_dir):
    owners = relate.allocate_owners(_both(spark, sf_dir))
    return owners.groupBy("project_id", F.coalesce("owner", F.lit("uncovered")).alias("owner")).agg(F.count(F.lit(1)).alias("n_files"))


_RANK = "CASE confidence WHEN 'high' THEN 2 WHEN 'medium' THEN 1 WHEN 'low' THEN 0 ELSE -1 END"


@register("w1_dedup_edges", f"SELECT project_id, source, target, kind, confidence, model_fact, seq FROM (SELECT *, row_number() OVER (PARTITION BY project_id, source, target, kind ORDER BY {_RANK} DESC, seq) AS k FROM ({EDGES}) AS e) AS x WHERE k = 1")
def w1(spark, sf_dir):
    return graph.dedup_edges(bound_to_edges(spark, sf_dir, f"SELECT * FROM ({EDGES}) AS e", "project_id", "source", "target", "kind")).withColumn("seq", F.col("seq").cast("long"))


_NODES = f"SELECT project_id, target AS node_id, kind, source AS name, seq FROM ({EDGES}) AS e"


@register("w2_dedup_nodes", f"SELECT project_id, node_id, kind, name, seq FROM (SELECT *, row_number() OVER (PARTITION BY project_id, node_id ORDER BY seq) AS k FROM ({_NODES}) AS n) AS x WHERE k = 1")
def w2(spark, sf_dir):
    return graph.dedup_nodes(bound_to_edges(spark, sf_dir, _NODES, "project_id", "node_id")).withColumn("seq", F.col("seq").cast("long"))


_RELATIONS = f"SELECT project_id, 'f' || source AS source, 'f' || replace(target, 's', 'n') AS target, kind, confidence AS evidence, seq FROM ({EDGES}) AS e WHERE model_fact"


@register("o3_promote_edges_to_relations", f"SELECT DISTINCT project_id, source, target, kind, evidence FROM ({_RELATIONS}) AS r WHERE source <> target AND NOT EXISTS (SELECT 1 FROM ({_RELATIONS}) AS k WHERE k.seq % 5 = 0 AND k.project_id = r.project_id AND k.source = r.source AND k.target = r.target AND k.kind = r.kind AND k.evidence = r.evidence)")
def o3(spark, sf_dir):
    relations = bound_to_edges(spark, sf_dir, _RELATIONS)
    return relate.enclosing_project_edges(relations, relations.where("seq % 5 = 0"))


# nation -> customer -> orders -> part -> orders of the same key: layers, hubs and cycles, and edges that aren't walked.
_WALK_EDGES = """
SELECT 'w' AS project_id, 'nation' || cast(n_nationkey AS string) AS source, 'customer' || cast(c_custkey AS string) AS target, 'routes_to' AS kind, true AS model_fact FROM nation JOIN customer ON n_nationkey = c_nationkey
UNION ALL SELECT 'w', 'customer' || cast(o_custkey AS string), 'order' || cast(o_orderkey AS string), 'invokes', true FROM orders
UNION ALL SELECT 'w', 'order' || cast(l_orderkey AS string), 'part' || cast(l_partkey AS string), 'reads_table', l_linenumber <> 5 FROM lineitem
UNION ALL SELECT 'w', 'part' || cast(p_partkey AS string), 'order' || cast(p_partkey AS string), CASE WHEN p_partkey % 5 = 0 THEN 'initiates' ELSE 'maps_to_sql' END, true FROM part
"""
_STARTS = "SELECT 'w' AS project_id, 'nation' || cast(n_nationkey AS string) AS start FROM nation UNION ALL SELECT 'w', 'part' || cast(p_partkey AS string) FROM part"
_G1 = f"""
WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT project_id, source, target FROM ({_WALK_EDGES}) AS x WHERE model_fact AND kind <> 'initiates'), w AS (
  SELECT project_id, start, start AS node_id, 0 AS depth FROM ({_STARTS}) AS s
  UNION SELECT w.project_id, start, target, depth + 1 FROM w JOIN e ON e.project_id = w.project_id AND e.source = w.node_id WHERE depth < 8
) SELECT project_id, start, node_id, min(depth) AS depth FROM w GROUP BY ALL
"""


@register("g1_walk_endpoints", _G1)
def g1(spark, sf_dir):
    return graph.walk(bound(spark, sf_dir, _STARTS), bound(spark, sf_dir, _WALK_EDGES))


_FILE_EDGES = f"""
SELECT project_id, node_id AS source, 'file:' || relative_path AS target, 'invokes' AS kind FROM {_ENDS} AS e
UNION SELECT project_id, 'file:' || source, 'file:' || target, 'invokes' FROM ({_J1}) AS j
UNION SELECT x.project_id, 'file:' || o.relative_path, 'sql:' || x.relative_path || ':' || line || ':' || statement_id, 'maps_to_sql' FROM ({_X15}) AS x JOIN {_OWNERS} AS o ON o.project_id = x.project_id AND o.class = list_last(string_split(namespace, '.'))
UNION SELECT t.project_id, 'sql:' || t.relative_path || ':' || x.line || ':' || t.statement_id, 'table:' || lower(unnest(string_split(tables, ','))), CASE WHEN operation = 'select' THEN 'reads_table' ELSE 'writes_table' END
  FROM ({_X16}) AS t JOIN ({_X15}) AS x ON x.project_id = t.project_id AND x.relative_path = t.relative_path AND x.statement_id = t.statement_id WHERE tables <> ''
"""
_CHAINS = f"""
WITH RECURSIVE ends AS MATERIALIZED (SELECT *, 'springvue.http.' || CASE WHEN k < 1000 THEN lpad(cast(k AS string), 3, '0') ELSE cast(k AS string) END AS chain_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY relative_path, line, node_id) AS k FROM {_ENDS} AS e) AS x),
fe AS MATERIALIZED (SELECT * FROM ({_FILE_EDGES}) AS fe0), j AS MATERIALIZED (SELECT * FROM {_J12} AS j0), apis AS MATERIALIZED (SELECT * FROM {_APIS} AS a0),
w AS (SELECT project_id, chain_id, node_id, 0 AS depth FROM ends UNION SELECT w.project_id, chain_id, target, depth + 1 FROM w JOIN fe ON fe.project_id = w.project_id AND fe.source = w.node_id WHERE depth < 8),
gapped AS (SELECT DISTINCT w.project_id, chain_id, node_id FROM w WHERE (node_id LIKE 'file:%Mapper.java' AND NOT EXISTS (SELECT 1 FROM fe WHERE fe.project_id = w.project_id AND fe.source = w.node_id AND kind = 'maps_to_sql'))
  OR (node_id LIKE 'sql:%' AND NOT EXISTS (SELECT 1 FROM fe WHERE fe.project_id = w.project_id AND fe.source = w.node_id))),
g AS (SELECT project_id, chain_id, count(*) AS n_gaps FROM gapped GROUP BY ALL),
m AS (SELECT j.project_id, chain_id, bool_or(confidence = 'medium') AS medium FROM j JOIN ends ON ends.project_id = j.project_id AND ends.node_id = j.target GROUP BY ALL),
chains AS MATERIALIZED (SELECT ends.project_id, ends.chain_id, node_id, name, coalesce(n_gaps, 0) AS n_gaps, CASE WHEN coalesce(medium, false) THEN 'needs_confirmation' WHEN n_gaps > 0 THEN 'partial' ELSE 'complete' END AS status
  FROM ends LEFT JOIN g ON g.project_id = ends.project_id AND g.chain_id = ends.chain_id LEFT JOIN m ON m.project_id = ends.project_id AND m.chain_id = ends.chain_id)
"""


@register("a7_classify_chains", _CHAINS + "SELECT project_id, chain_id, name, n_gaps, status FROM chains")
def a7(spark, sf_dir):
    found, _, _ = relate.chains(code(spark, sf_dir))
    return found.select("project_id", "chain_id", "name", F.size("gaps").cast("long").alias("n_gaps"), "status")


_A5 = _CHAINS + """
SELECT c.project_id, endpoint_count, complete_count, partial_count, needs_confirmation_count, unmatched_endpoint_count, coalesce(frontend_call_count, 0) AS frontend_call_count, coalesce(unmatched_frontend_count, 0) AS unmatched_frontend_count,
  CASE WHEN coalesce(frontend_call_count, 0) = 0 THEN 1.0 ELSE round((frontend_call_count - unmatched_frontend_count) / frontend_call_count, 4) END AS frontend_match_rate
FROM (SELECT project_id, count(*) AS endpoint_count, count(*) FILTER (status = 'complete') AS complete_count, count(*) FILTER (status = 'partial') AS partial_count, count(*) FILTER (status = 'needs_confirmation') AS needs_confirmation_count,
        count(*) FILTER (NOT EXISTS (SELECT 1 FROM j WHERE j.project_id = chains.project_id AND j.target = chains.node_id)) AS unmatched_endpoint_count FROM chains GROUP BY project_id) AS c
LEFT JOIN (SELECT project_id, count(*) AS frontend_call_count, count(*) FILTER (NOT EXISTS (SELECT 1 FROM j WHERE j.project_id = a.project_id AND j.source = a.node_id)) AS unmatched_frontend_count FROM (SELECT DISTINCT project_id, node_id FROM apis) AS a GROUP BY project_id) AS f ON f.project_id = c.project_id
"""


@register("a5_chain_summary", _A5)
def a5(spark, sf_dir):
    found, matched, apis = relate.chains(code(spark, sf_dir))
    return graph.chain_summary(found, matched, apis)


_A8 = f"""
SELECT project_id, relative_path, statement_id, (CASE WHEN operation IN ('insert', 'update', 'delete') THEN 25 ELSE 0 END) + (CASE WHEN uses_dollar THEN 30 ELSE 0 END) + (CASE WHEN operation IN ('update', 'delete') AND NOT has_where THEN 30 ELSE 0 END) AS points
FROM (SELECT t.*, x.operation FROM ({_X16}) AS t JOIN (SELECT DISTINCT project_id, relative_path, statement_id, operation FROM ({_X15}) AS q) AS x USING (project_id, relative_path, statement_id)) AS s
"""


@register("a8_risk_score", _A8)
def a8(spark, sf_dir):
    found = facts.sql_facts(facts.extract_xml_sql(code(spark, sf_dir)))
    _, points = graph.risk_points(F.lit("GET"), F.col("operation"), F.col("uses_dollar"), F.col("has_where"), F.lit(False))
    return found.select(*KEYS, "statement_id", points.alias("points"))


@register("j24_link_sql_tables", f"""
SELECT DISTINCT project_id, 'sql:' || relative_path || ':' || line || ':' || namespace || '.' || statement_id AS source, 'table:' || lower(trim(t, '`')) AS target, CASE WHEN operation = 'select' THEN 'reads_table' ELSE 'writes_table' END AS kind, 'high' AS confidence
FROM (SELECT *, unnest({_TABLES}) AS t FROM ({_X15}) AS q) AS s
""")
def j24_tables(spark, sf_dir):
    found = facts.sql_facts(facts.extract_xml_sql(code(spark, sf_dir))).withColumn("node_id", java.statement_id())
    return facts.link_tables(found)

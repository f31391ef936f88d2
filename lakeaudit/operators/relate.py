"""Joins of facts into relations, and ownership of files. project_id is part of every key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.shared import written
from .facts import GENERIC_LANGUAGES, KEYS, class_files, extract_injections

SPRING_LANGUAGES = ("java", "vue", "javascript", "typescript", "sql", "xml", "yaml")
THRESHOLD = 0.5


def relate_injections(files: DataFrame) -> DataFrame:
    """(project_id, source, target, kind, evidence): an injected type is a class of the project."""
    types = class_files(files).select("project_id", F.col("class").alias("type"), F.col("relative_path").alias("target"))
    joined = extract_injections(files).join(types, ["project_id", "type"])
    return joined.select("project_id", F.col("relative_path").alias("source"), "target", F.lit("injects").alias("kind"), F.col("type").alias("evidence"))


def relate_calls_to_routes(calls: DataFrame, routes: DataFrame) -> DataFrame:
    """Pairs of which one path ends with the other, as relations of kind calls_route.

    Without the slashes at their ends, two paths with a slash can only be each other's suffix if their
    last segments are equal: an equi-join with the suffix test left over. Paths without a slash are
    few; for these the longer one's last segment ends with them, so they join on its suffixes.
    """
    c = calls.select("project_id", F.col("relative_path").alias("source"), F.col("path").alias("call"), F.regexp_replace(F.substring_index("path", "?", 1), "/+$", "").alias("x")).where("x <> ''")
    r = routes.select("project_id", F.col("relative_path").alias("target"), F.col("path").alias("route"), F.regexp_replace("path", "/+$", "").alias("y")).where("y <> ''")

    def last(col: str) -> Column:
        return F.substring_index(col, "/", -1)

    def endings(frame: DataFrame, col: str) -> DataFrame:
        """One row for each suffix of the last segment, itself included."""
        return frame.withColumn("key", F.explode(F.transform(F.sequence(F.lit(1), F.length(last(col))), lambda i: last(col).substr(i, F.length(last(col))))))

    either = F.col("x").endswith(F.col("y")) | F.col("y").endswith(F.col("x"))
    slashed_c, bare_c = c.where(F.col("x").contains("/")), c.where(~F.col("x").contains("/"))
    slashed_r, bare_r = r.where(F.col("y").contains("/")), r.where(~F.col("y").contains("/"))
    both = slashed_c.withColumn("key", last("x")).join(slashed_r.withColumn("key", last("y")), ["project_id", "key"]).where(either)
    short_call = bare_c.withColumn("key", F.col("x")).join(endings(r.where(F.length(last("y")) > 0), "y"), ["project_id", "key"])
    short_route = bare_r.withColumn("key", F.col("y")).join(endings(c.where(F.length(last("x")) > 0), "x"), ["project_id", "key"])
    # A pair of bare paths of which the call is the shorter, or equal, came with the calls.
    short_route = short_route.where(F.col("x").contains("/") | (F.length("x") > F.length("y")))
    out = both.select("project_id", "source", "target", "call", "route")
    for part in (short_call, short_route):
        out = out.unionByName(part.select(*out.columns))
    return out.select("project_id", "source", "target", F.lit("calls_route").alias("kind"), F.concat_ws(" -> ", "call", "route").alias("evidence"))


def endpoints(routes: DataFrame) -> DataFrame:
    """routes with a path as endpoints: node_id, normalized_url, verb (method), ordered by file and line."""
    from ..functions.text import normalize_url, stable_id

    kept = routes.where("path <> ''").withColumn("normalized_url", normalize_url("path"))
    return kept.select("project_id", stable_id("endpoint", "relative_path", "line", F.concat_ws(" ", "method", "normalized_url")).alias("node_id"), F.concat_ws(" ", "method", "normalized_url").alias("name"), "relative_path", "line", "method", "normalized_url")


def api_nodes(calls: DataFrame) -> DataFrame:
    from ..functions.text import normalize_url, stable_id

    kept = calls.withColumn("normalized_url", normalize_url("path"))
    high = ~F.col("path").contains("{")
    return kept.select("project_id", stable_id("api", "relative_path", "line", F.concat_ws(" ", "method", "normalized_url")).alias("node_id"), F.concat_ws(" ", "method", "normalized_url").alias("name"), "relative_path", "line", "method", "normalized_url", F.when(high, "high").otherwise("medium").alias("confidence"))


def match_frontend_to_endpoint(apis: DataFrame, ends: DataFrame) -> DataFrame:
    """(project_id, source, target, confidence): same URL, and the verbs agree or one side names none."""
    e = ends.select("project_id", F.col("node_id").alias("target"), F.col("method").alias("verb"), "normalized_url")
    a = apis.select("project_id", F.col("node_id").alias("source"), "method", "normalized_url", F.col("confidence").alias("url_confidence"))
    fits = (F.col("method") == F.col("verb")) | F.col("method").isin("FETCH", "REQUEST") | (F.col("verb") == "REQUEST")
    high = (F.col("method") == F.col("verb")) & (F.col("url_confidence") == "high")
    return a.join(e, ["project_id", "normalized_url"]).where(fits).select("project_id", "source", "target", F.when(high, "high").otherwise("medium").alias("confidence")).distinct()


def unmatched(nodes: DataFrame, edges: DataFrame, side: str) -> DataFrame:
    """Nodes that no edge has as its ``side`` (source or target)."""
    return nodes.join(edges.select("project_id", F.col(side).alias("node_id")).distinct(), ["project_id", "node_id"], "left_anti")


def marks(files: DataFrame) -> DataFrame:
    """Per project, which technologies its files show. One aggregation of flags; content doesn't move."""
    c, low, lang = F.col("content"), F.lower("content"), F.col("language")

    def any_of(flag: Column) -> Column:
        return F.coalesce(F.bool_or(flag), F.lit(False))

    return files.groupBy("project_id").agg(
        any_of(c.contains("@SpringBootApplication") | low.contains("spring-boot")).alias("boot"),
        any_of((lang == "java") & (c.contains("@RestController") | c.contains("@Controller"))).alias("controller"),
        any_of(c.contains("org.apache.ibatis") | c.contains("<mapper") | c.contains("@Mapper")).alias("mybatis"),
        any_of(low.contains("nacos")).alias("nacos"),
        any_of(lang == "vue").alias("vue"),
        any_of((lang == "sql") | low.contains("mysql")).alias("mysql"),
        any_of(lang.isin(*GENERIC_LANGUAGES)).alias("generic"),
    )


def technologies(files: DataFrame) -> DataFrame:
    """(project_id, technologies): in a fixed order; one default if none shows."""
    named = [F.when(F.col(flag), name) for flag, name in (("boot", "Spring Boot"), ("mybatis", "MyBatis"), ("nacos", "Nacos"), ("vue", "Vue"), ("mysql", "MySQL"))]
    found = F.filter(F.array(*named), lambda x: x.isNotNull())
    return marks(files).select("project_id", F.when(F.size(found) == 0, F.array(F.lit("未识别的项目类型"))).otherwise(found).alias("technologies"))


def detect_capability(files: DataFrame) -> DataFrame:
    """(project_id, score, reasons, generic_score). Scores are summed in hundredths, so none drifts."""
    m = marks(files)
    base = F.when(F.col("boot"), 60).when(F.col("controller"), 55).otherwise(0)
    rest = F.when(F.col("mybatis"), 15).otherwise(0) + F.when(F.col("nacos"), 10).otherwise(0) + F.when(F.col("vue"), 10).otherwise(0)
    reasons = F.concat_ws("、", F.when(F.col("boot"), "Spring Boot 启动标记").when(F.col("controller"), "Spring MVC Controller"), F.when(F.col("mybatis"), "MyBatis"), F.when(F.col("nacos"), "Nacos"), F.when(F.col("vue"), "Vue"))
    return m.select("project_id", (F.least(base + rest, F.lit(100)) / 100).alias("score"), F.when(reasons == "", "未发现 SpringVue 特征").otherwise(reasons).alias("reasons"), F.when(F.col("generic"), 0.1).otherwise(0.0).alias("generic_score"))


def allocate_owners(files: DataFrame) -> DataFrame:
    """(project_id, relative_path, owner): the best-scoring capability that claims a file's language, else the generic one."""
    claims = files.select(*KEYS, "language").join(detect_capability(files), "project_id", "left")
    spring = (F.col("score") >= THRESHOLD) & F.col("language").isin(*SPRING_LANGUAGES)
    owner = F.when(spring, "SpringVue").when(F.col("language").isin(*GENERIC_LANGUAGES), "Generic")
    return claims.select(*KEYS, owner.alias("owner"))


# What a report says wasn't covered.
UNOWNED, BROKEN = "未被能力模块覆盖：", "未完成链路 "


def coverage_limits(owners: DataFrame, chains: DataFrame) -> DataFrame:
    """(project_id, limit): a line for each file that nobody owns, and for each chain that isn't complete, with its gaps.

    owners: KEYS, owner; chains: project_id, chain_id, name, status, gaps. Each list is what a report shows under its limits.
    """
    files = owners.where("owner is null").select("project_id", F.concat(F.lit(UNOWNED), "relative_path").alias("limit"))
    broken = chains.where("status <> 'complete'")
    said = F.concat(F.lit(BROKEN), "chain_id", F.lit(" "), "name", F.lit("（"), "status", F.lit("）"), F.when(F.size("gaps") > 0, F.concat(F.lit("："), F.array_join("gaps", "；"))).otherwise(""))
    return files.unionByName(broken.select("project_id", said.alias("limit")))


def enclosing_project_edges(relations: DataFrame, known: DataFrame) -> DataFrame:
    """Cross-file relations that aren't known yet, each once."""
    columns = ["project_id", "source", "target", "kind", "evidence"]
    fresh = relations.where("source <> target").select(*columns).distinct()
    return fresh.join(known.select(*columns).distinct(), columns, "left_anti")


def file_graph(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Evidence nodes (project_id, node_id, kind, name) and edges (project_id, source, target, kind, confidence) at file level.

    endpoint -> its file -> injected types' files -> XML statements of a mapper's namespace -> tables.
    """
    from .facts import extract_routes, extract_xml_sql, of, sql_facts

    ends = endpoints(extract_routes(files))
    java = of(files, "java")
    statements = sql_facts(extract_xml_sql(files)).withColumn("node_id", F.concat_ws(":", F.lit("sql"), "relative_path", F.col("line").cast("string"), "statement_id"))
    classes = class_files(files)
    tables = statements.select("project_id", "node_id", "operation", F.explode("tables").alias("name"))

    def edge(frame: DataFrame, source: Column, target: Column, kind: Column | str) -> DataFrame:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return frame.select("project_id", source.alias("source"), target.alias("target"), kind.alias("kind"), F.lit("high").alias("confidence"), F.lit(True).alias("model_fact")).distinct()

    def file_id(col: str) -> Column:
        return F.concat(F.lit("file:"), F.col(col))

    table_id = F.concat(F.lit("table:"), F.lower("name"))
    mapped = statements.withColumn("class", F.substring_index("namespace", ".", -1)).select("project_id", "node_id", "class").join(classes, ["project_id", "class"])
    edges = edge(ends, F.col("node_id"), file_id("relative_path"), "invokes")
    for more in (
        edge(relate_injections(files), file_id("source"), file_id("target"), "invokes"),
        edge(mapped, file_id("relative_path"), F.col("node_id"), "maps_to_sql"),
        edge(tables, F.col("node_id"), table_id, F.when(F.col("operation") == "select", "reads_table").otherwise("writes_table")),
    ):
        edges = edges.unionByName(more)
    kinds = F.when(F.col("relative_path").endswith("Mapper.java"), "mapper_method").otherwise("java_method")
    nodes = ends.select("project_id", "node_id", F.lit("controller_endpoint").alias("kind"), "name")
    for more in (
        java.select("project_id", file_id("relative_path").alias("node_id"), kinds.alias("kind"), F.col("relative_path").alias("name")),
        statements.select("project_id", "node_id", F.lit("sql_statement").alias("kind"), F.col("statement_id").alias("name")),
        tables.select("project_id", table_id.alias("node_id"), F.lit("database_table").alias("kind"), F.lower("name").alias("name")).distinct(),
    ):
        nodes = nodes.unionByName(more)
    return nodes, edges


def chains(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Endpoint chains (project_id, chain_id, node_id, name, method, status, gaps), matched calls, and call nodes."""
    from . import graph
    from .facts import extract_api_calls, extract_routes

    nodes, edges = (written(x, "chain-graph") for x in file_graph(files))
    ends = written(graph.number_chains(endpoints(extract_routes(files))), "chain-endpoints")
    apis = written(api_nodes(extract_api_calls(files)), "chain-calls")
    matched = match_frontend_to_endpoint(apis, ends)
    reached = graph.walk(ends.select("project_id", F.col("node_id").alias("start")), edges)
    held = reached.join(ends.select("project_id", F.col("node_id").alias("start"), "chain_id"), ["project_id", "start"]).join(nodes, ["project_id", "node_id"])
    keys = ["project_id", "chain_id"]

    def gap(kind: str, edge_kinds: list[str], words: str) -> DataFrame:
        left = edges.where(F.col("kind").isin(*edge_kinds)).select("project_id", F.col("source").alias("node_id")).distinct()
        return held.where(F.col("kind") == kind).join(left, ["project_id", "node_id"], "left_anti").select(*keys, F.struct("depth", "node_id").alias("seq"), F.concat(F.lit(words), "name").alias("gap"))

    gaps = gap("mapper_method", ["maps_to_sql"], "Mapper 方法未找到显式 SQL：").unionByName(gap("sql_statement", ["reads_table", "writes_table"], "SQL 未识别操作表："))
    seen = matched.join(ends.select("project_id", F.col("node_id").alias("target"), "chain_id"), ["project_id", "target"]).select(*keys, "confidence")
    return graph.classify_chains(ends, gaps, seen), matched, apis

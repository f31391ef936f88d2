"""Inputs of the registered queries: projections of the given tables, in SQL that Spark and DuckDB both run.

The tables hold no source code, so a lake of files is spelled out from ``part`` (nine files a part) and
from ``documents`` (prose under every suffix). Each text is used as it is in both engines.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.ranges import number_rows, pieces
from ..sources.tables import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "labels")

_SUFFIXES = "java vue js ts go c h cc cpp cxx hpp hxx py rs sql yml yaml xml".split()

#: project_id, relative_path, content, byte_size of the documents under all suffixes, some in ignored or test folders.
RAW_PROSE = f"""
SELECT source AS project_id,
       CASE WHEN doc_id % 29 = 0 THEN 'build/' WHEN doc_id % 23 = 0 THEN 'tests/' WHEN doc_id % 31 = 0 THEN 'src/test_a/' ELSE '' END
         || 'mod' || cast(doc_id % 5 AS string) || '/src/' || coalesce(lang, 'xx') || '/doc_' || cast(doc_id AS string)
         || CASE doc_id % 20 {" ".join(f"WHEN {k} THEN '.{s}'" for k, s in enumerate(_SUFFIXES))} WHEN 18 THEN '.TXT' ELSE '.JAVA' END AS relative_path,
       coalesce(text, '') AS content, octet_length({{bytes}}) AS byte_size
FROM documents
"""

#: The same for templated code: nine files a part, with variants by the part's key.
RAW_CODE = """
SELECT project_id, relative_path, content, octet_length({bytes2}) AS byte_size FROM (
  SELECT project_id, k, n, svc || path AS relative_path, content FROM (
    SELECT *, CASE f WHEN 0 THEN '/src/main/java/demo/Item' || k || 'Controller.java' WHEN 1 THEN '/src/main/java/demo/Item' || k || 'Service.java'
                     WHEN 2 THEN '/src/main/java/demo/Item' || k || 'Mapper.java' WHEN 3 THEN '/src/main/resources/mapper/Item' || k || 'Mapper.xml'
                     WHEN 4 THEN '/src/main/java/demo/Item' || k || '.java' WHEN 5 THEN '/web/src/api/item' || k || '.ts'
                     WHEN 6 THEN '/web/src/views/Item' || k || '.vue' WHEN 7 THEN '/src/main/resources/application-dev' || k || '.yml'
                     ELSE '/db/item' || k || '.sql' END AS path,
      CASE f
        WHEN 0 THEN 'package demo;' || nl || '@RestController' || nl || 'public class Item' || k || 'Controller {' || nl
          || '  private final Item' || k || 'Service service;' || nl || CASE WHEN n % 5 = 0 THEN '  private Item' || k || 'Mapper mapper;' || nl ELSE '' END
          || '  @PostMapping("/api/item' || k || '/create")' || nl || '  public String create(Item' || k || 'Request r) { return service.create(r); }' || nl
          || CASE WHEN n % 3 = 0 THEN '  @GetMapping(value = "/api/item' || k || '/{id}")' || nl || '  public Item' || k || ' one(Long id) { return service.one(id); }' || nl ELSE '' END
          || CASE WHEN n % 13 = 0 THEN '  @DeleteMapping' || nl || '  public void wipe() {}' || nl ELSE '' END || '}' || nl
        WHEN 1 THEN 'package demo;' || nl || '@Service' || nl || CASE WHEN n % 4 = 0 THEN '@Transactional' || nl ELSE '' END || 'public class Item' || k || 'Service {' || nl
          || '  private Item' || k || 'Mapper mapper;' || nl || '  public String create(Item' || k || 'Request r) {' || nl || '    mapper.insertItem(r);' || nl || '    return "ok";' || nl || '  }' || nl
          || CASE WHEN n % 9 = 0 THEN '  String q = "select name from item' || k || ' where id=" + id;' || nl ELSE '' END || '}' || nl
        WHEN 2 THEN 'package demo;' || nl || '@Mapper' || nl || 'public interface Item' || k || 'Mapper {' || nl || '  int insertItem(Item' || k || 'Request r);' || nl
          || CASE WHEN n % 6 = 0 THEN '  @Select("select name, qty from item' || k || ' where id = #{id}")' || nl || '  String name(Long id);' || nl ELSE '' END || '}' || nl
        WHEN 3 THEN '<mapper' || CASE WHEN n % 17 = 0 THEN '' ELSE ' namespace="demo.Item' || k || 'Mapper"' END || '>' || nl || '<insert id="insertItem">' || nl || '  insert into item' || k || ' (name)' || nl || '  values (#{name})' || nl || '</insert>' || nl
          || CASE WHEN n % 7 = 0 THEN '<select id="sorted">select * from item' || k || ' order by $' || '{col} limit 5</select>' || nl ELSE '' END
          || CASE WHEN n % 11 = 0 THEN '<update id="reset">update item' || k || ' set qty = 0</update>' || nl ELSE '' END || '</mapper>' || nl
        WHEN 4 THEN 'package demo;' || nl || '@TableName("item' || k || '")' || nl || 'public class Item' || k || ' {' || nl || '  private String name;' || nl || '  private Long qty;' || nl || '}' || nl
        WHEN 5 THEN 'import axios from "axios";' || nl || 'export function createItem' || k || '(d) {' || nl || '  return axios.post("/api/item' || k || '/create", d);' || nl || '}' || nl
          || CASE WHEN n % 3 = 0 THEN 'export const one = () => request.get("/api/item' || k || '/7?full=1");' || nl ELSE '' END
          || CASE WHEN n % 10 = 0 THEN 'fetch("/gone/item' || k || '");' || nl ELSE '' END
        WHEN 6 THEN '<template>' || nl || CASE WHEN n % 4 = 1 THEN '<p v-html="body"></p>' || nl ELSE '<p>x</p>' || nl END || '</template>' || nl || '<script>' || nl || 'function save() { createItem' || k || '(form); }' || nl || '</script>' || nl
        WHEN 7 THEN 'spring:' || nl || '  datasource:' || nl || '    url: jdbc:mysql://db/item' || k || nl || '    password: ' || CASE WHEN n % 8 = 0 THEN 'pw' ELSE 'secret' || k END || nl || CASE WHEN n % 2 = 0 THEN '  config:' || nl || '    import: nacos:item' || k || '.yaml' || nl ELSE '' END
        ELSE 'select * from item' || k || ';' || nl || 'delete from item' || k || ' where qty < 0;' || nl || CASE WHEN n % 12 = 0 THEN 'create table item' || k || ' (name varchar(10));' || nl ELSE '' END
      END AS content
    FROM (
      SELECT 'p' || cast(p_partkey % 20 AS string) AS project_id, cast(p_partkey AS string) AS k, p_partkey AS n, 'svc' || cast(p_partkey % 40 AS string) AS svc, chr(10) AS nl, f
      FROM part CROSS JOIN ({kinds}) AS kinds
    ) AS parts
  ) AS named
) AS files
"""


KINDS = 9
ALL_KINDS = "SELECT 0 AS f" + "".join(f" UNION ALL SELECT {k}" for k in range(1, KINDS))


def _java(name: str, *lines: str, folder: str = "java/demo", suffix: str = "java") -> tuple[str, str]:
    """Path and text of a file of part ``~``, as SQL; a line that begins with ?m: is there for keys divisible by m."""
    parts = []
    for line in lines:
        often, _, rest = line.partition(":") if line.startswith("?") else ("", "", line)
        text = "'" + rest.replace("~", "' || k || '") + "' || nl"
        parts.append(f"CASE WHEN n % {often[1:]} = 0 THEN {text} ELSE '' END" if often else text)
    return "'/src/main/" + folder + "/" + name.replace("~", "' || k || '") + "." + suffix + "'", " || ".join(parts)


#: Typed code of a part: constructor injection, an interface with one or two implementations, inherited persistence, a remote client.
JAVA_FILES = [
    _java("Item~Controller", "package demo.web;", "@RestController", '@RequestMapping("/api/item~")', "public class Item~Controller {", "  private final Item~Service service;", "  private final Remote~Client client;",
          "  public Item~Controller(Item~Service service, Remote~Client client) { this.service = service; this.client = client; }", '  @PostMapping("/create")', "  public String create(@RequestBody Item~Request r) {",
          "    return service.create(r);", "  }", '  @RequestMapping(value = "/{id}", method = RequestMethod.GET)', "  public Item~ one(@PathVariable Long id) {", "    // service.gone(id);", '    client.check(id, "a,b");',
          "    return service.getById(id);", "  }", "?3:  @DeleteMapping", "?3:  public void wipe() {", "?3:    this.one(1L); service.missing();", "?3:  }", "}"),
    _java("Item~Service", "package demo;", "public interface Item~Service extends IService<Item~> {", "  String create(Item~Request r);", "}"),
    _java("Item~ServiceImpl", "package demo;", "@Service", "public class Item~ServiceImpl extends ServiceImpl<Item~Mapper, Item~> implements Item~Service {", "  @Override", "  public String create(Item~Request r) {",
          '    baseMapper.insertItem(r, "x");', "    this.updateById(new Item~());", '    return "ok";', "  }", "}"),
    _java("Item~AltService", "?4:package demo;", "?4:@Service", "?4:public class Item~AltService implements Item~Service {", '?4:  public String create(Item~Request r) { return "alt"; }', "?4:}"),
    _java("Item~Mapper", "package demo;", "@Mapper", "public interface Item~Mapper extends BaseMapper<Item~> {", '  int insertItem(@Param("r") Item~Request r, String note);', '  @Select({"select name ", "from item~ where id = #{id}"})', "  String name(Long id);", "}"),
    _java("Remote~Client", "package demo;", '@FeignClient(name = "remote")', "public interface Remote~Client {", "  String check(Long id, String code);", "}"),
    _java("Item~", "package demo;", '@TableName("t_item~")', "public class Item~ {", "  private Long id;", "}"),
    _java("Item~Request", "package demo;", "public class Item~Request {", "}"),
    _java("Item~Mapper", '<mapper namespace="demo.Item~Mapper">', '<insert id="insertItem">insert into item~ (name) values (#{r.name}, #{gone})</insert>', "</mapper>", folder="resources/mapper", suffix="xml"),
    _java("Bare~", "package demo;", "public class Bare~ extends ServiceImpl<Item~Mapper, OrderLine~> {", "  public long all() {", "    return this.count();", "  }", "}"),
    _java("item~", 'export const createItem~ = (d) => axios.post("/api/item~/create", d);', 'export const one~ = (id) => request.get("/api/item~/" + id);', '?10:fetch("/gone/item~");', folder="web/api", suffix="ts"),
    _java("View~", "<script>", "function save() { createItem~(form); }", "async function open() {", "  one~ (7);", "  createItem~(form);", "}", "</script>", folder="web/views", suffix="vue"),
]
_EACH = "SELECT 'p' || cast(p_partkey % 20 AS string) AS project_id, 'svc' || cast(p_partkey % 40 AS string) AS svc, cast(p_partkey AS string) AS k, p_partkey AS n, chr(10) AS nl FROM part"
RAW_JAVA = " UNION ALL ".join(f"SELECT project_id, svc || {path} AS relative_path, {text} AS content FROM ({_EACH}) AS e" for path, text in JAVA_FILES)
#: The rows of RAW_JAVA as Spark spells them out: a part is read once and all its files come from it, so each task has files of every kind.
#: transform() changes nothing, but keeps the texts out of the method that Spark generates for what follows: with them it is too long to be compiled.
EACH_JAVA = f"SELECT project_id, svc || f.path AS relative_path, f.content AS content FROM (SELECT project_id, svc, explode(transform(array({', '.join(f"named_struct('path', {path}, 'content', {text})" for path, text in JAVA_FILES)}), f -> f)) AS f FROM ({_EACH}) AS e) AS x"

#: Front-end code of a part: wrapped calls, folded URLs, a request object, one that is only known at run time, and a view.
FRONT_FILES = [
    _java("api~", 'import request from "@/request";', '// axios.get("/not/this");', "export function createItem~(d) {", '  return axios.post("/api/item~/create", d);', "}",
          'export const one~ = (id) => request.get("/api/item~/" + id + "/part?full=1");', "export async function sync~(d) { return request({ url: `/api/item~/$' || '{id}`, method: \"put\", data: d }); }",
          "?3:http.delete(base);", '?10:fetch("gone/item~");', folder="web/api", suffix="ts"),
    _java("View~", "<template>", '<p v-html="body"></p>', "</template>", "<script>", "async function save() {", "  await createItem~(form);", "  one~ (7);", "}", "function idle() { return 1; }", "</script>", folder="web/views", suffix="vue"),
]
RAW_FRONT = " UNION ALL ".join(f"SELECT project_id, svc || {path} AS relative_path, {text} AS content FROM ({_EACH}) AS e" for path, text in FRONT_FILES)

#: Review tasks of the findings' projects, one of three without a chain.
TASKS = """
SELECT DISTINCT 'q' || cast(user_id % 4 AS string) AS project_id, 't' || cast(event_id % 50 AS string) AS task_id, CASE WHEN event_id % 50 % 3 = 0 THEN 'layered' ELSE 'endpoint_chain' END AS kind,
       'chain' || cast(event_id % 50 AS string) AS chain_id, CASE WHEN event_id % 50 % 7 = 0 THEN '' ELSE 'POST /t' || cast(event_id % 50 AS string) END AS endpoint, 'partial' AS proven_status, 'a -> b' AS chain_path,
       CASE WHEN event_id % 50 % 2 = 0 THEN 'gap' ELSE '' END AS gap
FROM events
"""

#: A finding of the events table. Texts follow the event's number, so that each rule meets some.
_WORDS = [
    "hashmap 线程安全", "sql injection in query", "没有过期 cache", "缺少事务", "多个服务共享同一数据库", "直接返回实体", "返回未使用字段", "路径参数未校验",
    "RuntimeException gives 500", "竞态条件", "x-user-id 伪造", "日志记录用户ID和用户名", "无直接证据 here", "plain claim", "分页上限 missing", "catch 块未处理",
]
FINDINGS = f"""
SELECT 'q' || cast(user_id % 4 AS string) AS project_id, event_id AS seq, 't' || cast(event_id % 50 AS string) AS task_id, event_type AS category,
       CASE event_type WHEN 'error' THEN '严重 Bug' WHEN 'purchase' THEN '中等 Bug' WHEN 'click' THEN '轻度 Bug' WHEN 'view' THEN '优化建议' ELSE '需人工确认' END AS severity,
       CASE event_id % {len(_WORDS)} {" ".join(f"WHEN {k} THEN '{w}'" for k, w in enumerate(_WORDS))} END AS title,
       CASE WHEN event_id % 37 = 0 THEN 'm9/src/Gone.java' ELSE 'm' || cast(user_id % 7 AS string) || '/src/F' || cast(user_id AS string) || '.java' END AS relative_path,
       CASE WHEN event_id % 19 = 0 THEN NULL ELSE cast(floor(value) AS int) END AS line,
       CASE WHEN event_id % 41 = 0 THEN ' ' WHEN event_id % 43 = 0 THEN '需确认 later' ELSE 'seen in code' END AS evidence,
       'path' AS trigger_path, 'impact' AS impact, 'fix' AS recommendation,
       CASE WHEN event_id % 3 = 0 THEN '中' ELSE '高' END AS confidence, event_id % 11 = 0 AS needs_human_confirmation,
       CASE event_id % 5 WHEN 0 THEN 'partial' WHEN 1 THEN '' ELSE 'complete' END AS chain_status, 'GET /u' || cast(user_id % 9 AS string) AS endpoint
FROM events
"""

#: The files that these findings are about.
FINDING_FILES = """
SELECT DISTINCT 'q' || cast(user_id % 4 AS string) AS project_id, 'm' || cast(user_id % 7 AS string) || '/src/F' || cast(user_id AS string) || '.java' AS relative_path, 'java' AS language,
       'class F' || cast(user_id AS string) || ' {' || chr(10)
         || CASE WHEN user_id % 2 = 0 THEN 'ConcurrentHashMap m;' || chr(10) ELSE '' END || CASE WHEN user_id % 3 = 0 THEN 'x = "select a from t where b=" + c;' || chr(10) ELSE '' END
         || CASE WHEN user_id % 5 = 0 THEN 'cache.expire(9);' || chr(10) ELSE '' END || CASE WHEN user_id % 7 = 3 THEN '@RestControllerAdvice @ExceptionHandler' || chr(10) ELSE '' END
         || CASE WHEN user_id % 8 = 0 THEN 'String password;' || chr(10) ELSE '' END || CASE WHEN user_id % 16 = 1 THEN 'GlobalFilter validate(x) X-User-Id' || chr(10) ELSE '' END
         || 'a();' || chr(10) || 'b();' || chr(10) || 'c();' || chr(10) || '}' || chr(10) AS content
FROM events
"""

#: Edges with many doubles; seq is unique.
_EDGE_ORDER = "l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate"
_EDGE_ROWS = """
SELECT 'e' || cast(l_suppkey % 3 AS string) AS project_id, 'n' || cast(l_partkey % 200 AS string) AS source, 's' || cast(l_suppkey AS string) AS target, l_returnflag AS kind,
       CASE l_linenumber % 3 WHEN 0 THEN 'low' WHEN 1 THEN 'medium' ELSE 'high' END AS confidence, l_linenumber % 3 <> 0 AS model_fact,
       {seq}
FROM lineitem
"""
EDGES = _EDGE_ROWS.format(seq=f"row_number() OVER (PARTITION BY l_suppkey % 3 ORDER BY {_EDGE_ORDER}) AS seq")


def _sql(text: str, engine: str) -> str:
    content = {"spark": "content", "duckdb": "encode(content)"}[engine]
    prose = {"spark": "coalesce(text, '')", "duckdb": "encode(coalesce(text, ''))"}[engine]
    return text.replace("{kinds}", ALL_KINDS).replace("{bytes2}", content).replace("{bytes}", prose)


def duck(text: str) -> str:
    """A binding as DuckDB runs it."""
    return _sql(text, "duckdb")


#: Parts whose code a task spells out, where there are enough of them.
PARTS = 2_000


def dealt(parts: DataFrame) -> DataFrame:
    """``parts``, dealt evenly to as many tasks as a shuffle has at most: a small file of keys, read as one piece, is much code."""
    n = min(int(parts.sparkSession.conf.get("spark.sql.shuffle.partitions")), parts.count() // PARTS + 1)
    return parts.repartition(n) if n > 1 else parts


def bound(spark: SparkSession, sf_dir: str, text: str) -> DataFrame:
    """A binding as Spark runs it, over the tables below ``sf_dir``."""
    words = text.replace("\n", " ")
    for name in TABLES:
        if f" {name}" in words:
            held = table(spark, sf_dir, name)
            (dealt(held) if name == "part" and " AS content " in words else held).createOrReplaceTempView(name)
    return spark.sql(_sql(text, "spark"))


def bound_to_edges(spark: SparkSession, sf_dir: str, text: str, *keys: str) -> DataFrame:
    """A binding over EDGES as Spark runs it: they are numbered in ranges, since a window would sort a project in one task.

    keys: what the rows are grouped by then; they are dealt by these to as many tasks as there are ranges.
    """
    order = _EDGE_ORDER.split(", ")
    n = table(spark, sf_dir, "lineitem").count()
    rows = bound(spark, sf_dir, _EDGE_ROWS.format(seq=_EDGE_ORDER))
    number_rows(rows, ["project_id"], [F.col(c) for c in order], "seq", rows=n).drop(*order).createOrReplaceTempView("numbered_edges")
    edges = spark.sql(text.replace(f"({EDGES})", "numbered_edges"))
    return edges.repartition(pieces(n), *keys) if keys else edges

import os
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lakeaudit.functions import text as T
from lakeaudit.operators import facts, findings, graph, relate
from lakeaudit.sources.files import files_from_table, read_source_files

USER = {
    "backend/src/main/java/demo/UserController.java": '@RestController\nclass UserController {\n private UserMapper userMapper;\n @GetMapping("/users")\n public Object all() { return userMapper.all(); }\n}\n',
    "backend/src/main/java/demo/UserMapper.java": "@Mapper\ninterface UserMapper { Object all(); }\n",
    "backend/src/main/resources/UserMapper.xml": '<mapper>\n<select id="all">select * from users where id = ${id}</select>\n</mapper>\n',
    "backend/src/main/resources/application.yml": "nacos:\n  password: abcd1234\n",
    "web/User.vue": '<p v-html="x"></p>\n<script>\naxios.get("/users?x=1")\n</script>\n',
    "build/Gone.java": "class Gone {}",
    "notes.txt": "x",
}


def lake(spark):
    rows = [(p, path, c, len(c.encode())) for p in ("one", "two") for path, c in USER.items()]
    return files_from_table(spark.createDataFrame(rows, "project_id string, relative_path string, content string, byte_size long"))


def test_scan(spark, tmp_path):
    for path, content in USER.items():
        (tmp_path / "one" / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "one" / path).write_bytes(content.replace("\n", "\r\n").encode() + b"\xff")
    got = {r.relative_path: r for r in read_source_files(spark, str(tmp_path)).collect()}
    assert set(got) == {p for p in USER if not p.startswith("build") and not p.endswith("txt")}
    row = got["web/User.vue"]
    assert (row.project_id, row.language, row.content) == ("one", "vue", USER["web/User.vue"] + "�")


def test_facts_per_project(spark):
    files = lake(spark)
    for project in ("one", "two"):
        mine = files.where(F.col("project_id") == project)
        routes = facts.extract_routes(files).where(F.col("project_id") == project).collect()
        assert [(r.method, r.path, r.line) for r in routes] == [("GET", "/users", 4)]
        kinds = {r.kind for r in facts.extract_signals(mine).collect()}
        assert kinds == {"controller_direct_mapper", "mybatis_dollar_placeholder", "vue_v_html", "plaintext_secret"}
    assert facts.extract_routes(files.limit(0)).count() == 0


def test_lines(spark):
    text = "a\nb x1\n\nx22 x3\nx4"
    df = spark.createDataFrame([("p", "f", text)], "project_id string, relative_path string, content string")
    got = [(r.match, r.line) for r in facts.find_all(df, r"x\d+").orderBy("ord").collect()]
    assert got == [(m.group(), text.count("\n", 0, m.start()) + 1) for m in re.finditer(r"x\d+", text)]


def test_long_statements(spark):
    columns = ", ".join(f"column_{k}" for k in range(60))
    body = f"select {columns}\n  from `orders` o join items i where o.name = ${{name}} and o.id in (select id from old) limit 5"
    sets = ", ".join(f"column_{k} = 0" for k in range(60))
    content = f'<mapper namespace="demo.M">\n<select id="all">{body}</select>\n<update id="one">update orders set {sets} where id = 1</update>\n</mapper>\n'
    files = spark.createDataFrame([("p", "M.xml", "xml", content)], "project_id string, relative_path string, language string, content string")
    got = {r.statement_id: r for r in facts.sql_facts(facts.extract_xml_sql(files)).collect()}
    assert got["all"].statement == body.replace("\n  ", " ")
    assert (got["all"].tables, got["all"].uses_dollar, got["all"].has_where, got["all"].has_pagination) == (["orders", "old"], True, True, True)
    assert got["one"].has_where
    assert max(len(r.statement) for r in facts.extract_sql_operations(files).collect()) == 500


def test_capability_and_calls(spark):
    files = lake(spark)
    assert {(r.project_id, r.score) for r in relate.detect_capability(files).collect()} == {("one", 0.9), ("two", 0.9)}
    calls, routes = facts.extract_api_calls(files), facts.extract_routes(files)
    assert relate.relate_calls_to_routes(calls, routes).count() == 2


def test_edges_and_walk(spark):
    edges = spark.createDataFrame([("p", "a", "b", "invokes", "medium", True, 1), ("p", "a", "b", "invokes", "high", True, 2), ("p", "b", "a", "invokes", "high", True, 3), ("p", "b", "c", "invokes", "low", False, 4)], "project_id string, source string, target string, kind string, confidence string, model_fact boolean, seq long")
    assert {(r.source, r.target, r.confidence) for r in graph.dedup_edges(edges).collect()} == {("a", "b", "high"), ("b", "a", "high"), ("b", "c", "low")}
    starts = spark.createDataFrame([("p", "a")], "project_id string, start string")
    assert {(r.node_id, r.depth) for r in graph.walk(starts, edges).collect()} == {("a", 0), ("b", 1)}
    other = edges.withColumn("kind", F.lit("initiates")).withColumn("model_fact", F.lit(True))
    assert graph.walk(starts, other).count() == 1


def test_governance(spark):
    content = 'class A {\n public void f() {\n  repo.save(x);\n }\n public void g() {\n  repo.save(x);\n  repo.save(y);\n }\n}\n'
    files = spark.createDataFrame([("p", "m/src/A.java", "java", content)], "project_id string, relative_path string, language string, content string")
    base = ("p", "t", "c", T.MEDIUM, "", "m/src/A.java", 3, "seen", "", "", "", "高", False, "complete", "GET /x")
    titles = [("缺少事务", 3), ("缺少事务", 6), ("sql injection", 1), ("plain", 1), ("plain", 99)]
    rows = [(*base[:1], seq, *base[1:4], title, base[5], line, *base[7:]) for seq, (title, line) in enumerate(titles)]
    schema = "project_id string, seq int, task_id string, category string, severity string, title string, relative_path string, line int, evidence string, trigger_path string, impact string, recommendation string, confidence string, needs_human_confirmation boolean, chain_status string, endpoint string"
    got = {r.seq: (r.decision, r.rule) for r in findings.validate_evidence(spark.createDataFrame(rows, schema), files).collect()}
    assert got == {1: ("keep", ""), 3: ("keep", ""), 4: ("manual", "line")}


def test_scalars(spark):
    row = spark.range(1).select(T.normalize_url(F.lit(" https://h/a//:id/{x}/?q=1")).alias("u"), T.join_url(F.lit("/a/"), F.lit("/b")).alias("j"), T.snake_case(F.lit("OrderItem")).alias("s"), T.normalize_type(F.lit("java.util.List<A<B>>[]")).alias("t")).first()
    assert (row.u, row.j, row.s, row.t) == ("/a/{}/{}", "/a/b", "order_item", "List")


def test_lines_around_findings(spark):
    body = "class A {\n public void f() {\n  repo.save\n(x);\n  if (x) { repo.update(y); }\n }\n  repo.delete(z);\n void g() { repo.remove(1); }\n}\n"
    long = " public void h() {\n" + "  repo.save(1);\n" * 200 + " }"
    rows = [("p", "A.java", "java", body), ("p", "B.java", "java", ""), ("p", "C.java", "java", long), ("p", "D.java", "java", "@RequestHeader(required = false)\n\n\n\n\n@RequestHeader\nint x;")]
    files = spark.createDataFrame(rows, "project_id string, relative_path string, language string, content string")
    asked = [(1, "A.java", 5), (2, "A.java", 9), (3, "A.java", 1), (4, "B.java", 1), (5, "C.java", 150), (6, "D.java", 7), (7, "D.java", 3), (8, "Gone.java", 1), (9, "A.java", None)]
    schema = "project_id string, seq int, title string, category string, evidence string, trigger_path string, impact string, recommendation string, relative_path string, line int"
    claims = spark.createDataFrame([("p", seq, "缺少事务 requestheader", "", "", "", "", "", path, line) for seq, path, line in asked], schema)
    got = {r.seq: (r.header_required, r.n_writes) for r in findings.line_facts(claims, files).collect()}
    # The last method of A has no modifier, so the one above stands for it; a method has 120 lines at most.
    assert got == {1: (False, 2), 2: (False, 2), 3: (False, 4), 4: (False, 0), 5: (False, 119), 6: (True, 0), 7: (False, 0), 9: (False, 4)}


def test_languages_and_ignored_folders_of_odd_paths(spark):
    """As the patterns [^/]\\.([^./]+)$ and a list of folders have it."""
    paths = ["a.java", ".java", "x/.java", "x/a.JAVA", "a.b.ts", "a..py", "a.java/", "x.d/a", "a.java\n", "a\n.java", "", "a.", "é.vue", "build/a.py", "x/build/a.py", "rebuild/a.py", "a/.git", "build\n/a.py", "x/target", "build.py", ".mvn/a.xml", "amvn/a.xml", None]

    def known(path):
        m = path is not None and re.search(r"[^/]\.([^./]+)$", path)
        return T.LANGUAGES.get(m[1].lower()) if m else None

    rows = spark.createDataFrame([(p,) for p in paths], "path string").select("path", T.language("path").alias("l"), T.is_scannable("path", F.lit(1)).alias("s")).collect()
    assert [(r.l, r.s) for r in rows] == [(known(p), None if p is None else not set(p.split("/")) & set(T.IGNORED)) for p in paths]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="needs the given tables")
def test_spelled_out_files_are_filtered_by_compiled_code(spark):
    """Java compiles no method of more than 8,000 bytes, so the texts of all files mustn't be in one with what looks for some of them."""
    from lakeaudit.jobs.java_queries import files

    found = facts.of(files(spark, "/root/testdata/sf0.001"), "xml").where(F.col("content").contains("<mapper"))
    stages = found._jdf.queryExecution().debug().codegenToSeq()
    assert stages.size() and max(stages.apply(k)._3().maxMethodCodeSize() for k in range(stages.size())) < 8000


def test_slices_hold_few_long_or_many_short_texts():
    def sizes(texts):
        return [b.num_rows for b in facts.slices(pa.RecordBatch.from_pydict({"content": pa.array(texts, pa.string())}), "content")]

    assert sizes(["x"] * 2500) == [1024, 1024, 452] and sizes([]) == [] and sizes([None] * 3) == [3]
    assert sizes(["x" * 500_000] * 130) == [64, 64, 2]

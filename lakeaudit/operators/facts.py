"""Facts of single files: one row for each match, with its line. No shuffle."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import compact, is_test_or_example, newlines, squeezed

KEYS = ["project_id", "relative_path"]
# What the extractors look for.
ROUTE = r"""@(Get|Post|Put|Delete|Patch|Request)Mapping\s*(?:\(\s*)?(?:value\s*=\s*)?["']?([^"')\s,}]+)?"""
INJECTION = r"(?:private|protected)\s+(?:final\s+)?(\w+)\s+(\w+)\s*;"
CLASS = r"\b(?:class|interface)\s+(\w+)"
VERB_CALL = r"""(?i)(?:axios|request|http)\s*\.\s*(get|post|put|delete|patch)\s*\(\s*[`"']([^`"']+)"""
FETCH_CALL = r"""fetch\s*\(\s*[`"']([^`"']+)"""
SQL_TAG = r"""(?is)<(select|insert|update|delete)\b[^>]*(?:id=["']([^"']+)["'])?[^>]*>(.*?)</\1>"""
SQL_ANNOTATION = r"""(?s)@(Select|Insert|Update|Delete)\s*\(\s*["'](.+?)["']\s*\)"""
SQL_BARE = r"(?i)(?:select|update|delete|insert)\s+[^\n;]+"
SECRET = r"""(?i)\b(password|passwd|secret|api[_-]?key|token|access[_-]?key)\b\s*[:=]\s*["']?([^\s"'#]{4,})"""
CONCATENATION = r"""(?i)(select|update|delete)\s+[^\n;]*["']\s*\+"""
CREATE_TABLE = r"""(?i)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?[`"]?([\w.]+)"""
SELECT_STAR = r"(?i)\bselect\s+\*\b"
COMMAND = r"\b(system|popen|exec\.Command|Runtime\.getRuntime\(\)\.exec|subprocess\.(run|call|Popen))\s*\("
WRITES = r"(?i)\b(insert|update|delete|save|remove)\w*\s*\("
GENERIC_LANGUAGES = ("c", "cpp", "go", "python", "rust", "java", "javascript", "typescript", "vue")
LARGE_FILE = 300
REDACTED = "[已脱敏]"


#: Files whose matches a task holds at a time.
SLICE = 64
#: Or as many more as have no more text than so many files of 64 KB.
SLICE_FILES, SLICE_BYTES = 1024, SLICE * 65_536


def slices(batch: pa.RecordBatch, content: str) -> Iterator[pa.RecordBatch]:
    """The rows of ``batch`` in turn, SLICE of them at a time, or more where texts are short: each slice is a batch that Spark reads for itself."""
    sizes = pc.binary_length(batch.column(content)).to_pylist()
    begin, held = 0, 0
    for k, size in enumerate(sizes):
        n = k - begin
        if n and (n >= SLICE_FILES or (n >= SLICE and held + (size or 0) > SLICE_BYTES)):
            yield batch.slice(begin, n)
            begin, held = k, 0
        held += size or 0
    if begin < batch.num_rows:
        yield batch.slice(begin)


def find_all(files: DataFrame, pattern: str, groups: Sequence[str] = (), content: str = "content", carry: Sequence[str] = ()) -> DataFrame:
    """KEYS, the columns ``carry``, ord, line, end_line, match and a column for each named group (in order; "" if it took no part), per match.

    One pass over each file; letters, digits and blanks of the pattern are ASCII. The newlines between one match
    and the next are counted once, so lines take time linear in the file. A null content has no match.
    """
    kept = [*KEYS, *carry]
    kinds = dict(files.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "ord int, line int, end_line int, match string", *(f"`{g}` string" for g in groups)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = re.compile(pattern, re.ASCII).finditer
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                rows, numbers, found = [], [], []
                for k, text in enumerate(batch.column(len(kept)).to_pylist()):
                    line, before = 1, 0
                    for n, m in enumerate(find(text or "")):
                        line += text.count("\n", before, m.start())
                        before = m.start()
                        rows.append(k)
                        numbers.append((n, line, line + m.group().count("\n")))
                        found.append((m.group(), *(g or "" for g in m.groups()[: len(groups)])))
                own = batch.select(range(len(kept))).take(pa.array(rows, pa.int64()))
                columns = [*own.columns, *(pa.array([x[k] for x in numbers], pa.int32()) for k in range(3)), *(pa.array([x[k] for x in found], pa.string()) for k in range(1 + len(groups)))]
                yield pa.RecordBatch.from_arrays(columns, [*kept, "ord", "line", "end_line", "match", *groups])

    return files.select(*kept, content).mapInArrow(run, schema)


def of(files: DataFrame, *languages: str) -> DataFrame:
    return files.where(F.col("language").isin(*languages))


def java_role() -> Column:
    c, p = F.col("content"), F.col("relative_path")
    dto = p.endswith("DTO.java") | p.endswith("VO.java") | p.endswith("Request.java") | p.endswith("Response.java")
    return (
        F.when(c.contains("@RestController") | c.contains("@Controller"), "controller")
        .when(c.contains("@Service"), "service")
        .when(c.contains("@Mapper") | p.endswith("Mapper.java"), "mapper")
        .when(c.contains("@Entity") | c.contains("@TableName"), "entity")
        .when(dto, "dto")
        .otherwise("java_other")
    )


def classify_role(files: DataFrame) -> DataFrame:
    """files with role; files without one are dropped."""
    lang = F.col("language")
    role = (
        F.when(lang == "java", java_role())
        .when(lang == "vue", "vue_component")
        .when(lang.isin("javascript", "typescript"), "frontend_script")
        .when(lang == "sql", "sql_file")
        .when((lang == "xml") & F.col("content").contains("<mapper"), "mapper_xml")
        .when(lang == "yaml", "configuration")
    )
    return files.withColumn("role", role).where("role is not null")


def extract_routes(files: DataFrame) -> DataFrame:
    found = find_all(of(files, "java"), ROUTE, ["verb", "path"])
    return found.select(*KEYS, "line", F.upper("verb").alias("method"), "path", "ord")


def extract_api_calls(files: DataFrame) -> DataFrame:
    front = of(files, "vue", "javascript", "typescript")
    verbs = find_all(front, VERB_CALL, ["verb", "path"]).select(*KEYS, "line", F.upper("verb").alias("method"), "path", F.lit(0).alias("pattern"), "ord")
    fetches = find_all(front, FETCH_CALL, ["path"]).select(*KEYS, "line", F.lit("FETCH").alias("method"), "path", F.lit(1).alias("pattern"), "ord")
    return verbs.unionByName(fetches)


def extract_sql_operations(files: DataFrame) -> DataFrame:
    mine = of(files, "xml", "sql", "java")
    tags = find_all(mine, SQL_TAG, ["verb", "id", "body"]).select(*KEYS, "line", F.lower("verb").alias("operation"), compact("body").alias("statement"))
    notes = find_all(mine, SQL_ANNOTATION, ["verb", "body"]).select(*KEYS, "line", F.lower("verb").alias("operation"), compact("body").alias("statement"))
    return tags.unionByName(notes).unionByName(_bare(mine))


def _bare(files: DataFrame) -> DataFrame:
    """Statements to the end of their line: all of them in .sql files, elsewhere those with a select."""
    sql = find_all(of(files, "sql"), SQL_BARE)
    other = find_all(files.where(F.col("language") != "sql"), SQL_BARE).where(F.lower("match").contains("select"))
    both = sql.unionByName(other)
    return both.select(*KEYS, "line", F.lower(F.regexp_extract("match", r"^\S+", 0)).alias("operation"), compact("match").alias("statement"))


def extract_config_findings(files: DataFrame) -> DataFrame:
    return find_all(of(files, "yaml"), SECRET, ["key", "secret"]).select(*KEYS, "line", "key", F.lit(REDACTED).alias("value"))


def extract_injections(files: DataFrame) -> DataFrame:
    return find_all(of(files, "java"), INJECTION, ["type", "variable"]).select(*KEYS, "line", "type", "variable")


def class_files(files: DataFrame) -> DataFrame:
    """(project_id, class, relative_path): the last file, by path, wins a class name."""
    named = of(files, "java").select("project_id", "relative_path", F.regexp_extract("content", CLASS, 1).alias("class")).where("class <> ''")
    return named.groupBy("project_id", "class").agg(F.max("relative_path").alias("relative_path"))


def extract_signals(files: DataFrame) -> DataFrame:
    """(KEYS, line, kind) of the seven kinds of risk signals."""

    def kind(frame: DataFrame, name: str) -> DataFrame:
        return frame.select(*KEYS, F.col("line").cast("int").alias("line"), F.lit(name).alias("kind"))

    java, sql = of(files, "java"), of(files, "xml", "sql", "java")
    controllers = java.where(java_role() == "controller").join(class_files(files).select(*KEYS).distinct(), KEYS, "left_semi")
    direct = find_all(controllers, INJECTION, ["type", "variable"]).where(F.col("type").endswith("Mapper"))
    service = (java_role() == "service") & ~F.col("content").contains("@Transactional") & F.col("content").rlike(WRITES)
    dollar = sql.where(F.col("content").contains("${")).withColumn("line", newlines(F.substring_index("content", "${", 1)) + 1)
    front = of(files, "vue", "javascript", "typescript")
    parts = [
        kind(direct, "controller_direct_mapper"),
        kind(java.where(service).withColumn("line", F.lit(1)), "write_without_transaction"),
        kind(dollar, "mybatis_dollar_placeholder"),
        kind(find_all(sql, CONCATENATION), "sql_string_concatenation"),
        kind(find_all(sql, SELECT_STAR), "select_star"),
        kind(find_all(front, r"v-html\s*="), "vue_v_html"),
        kind(find_all(of(files, "yaml"), SECRET), "plaintext_secret"),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def extract_generic_signals(files: DataFrame) -> DataFrame:
    mine = of(files, *GENERIC_LANGUAGES)

    def kind(frame: DataFrame, name: str) -> DataFrame:
        return frame.select(*KEYS, F.col("line").cast("int").alias("line"), F.lit(name).alias("kind"))

    secrets = kind(find_all(mine.where(~is_test_or_example("relative_path")), SECRET), "generic_plaintext_secret")
    commands = kind(find_all(mine, COMMAND), "generic_command_execution")
    large = kind(mine.where(F.col("line_count") > LARGE_FILE).withColumn("line", F.lit(1)), "generic_large_file")
    return secrets.unionByName(commands).unionByName(large)


def extract_xml_sql(files: DataFrame) -> DataFrame:
    """(KEYS, namespace, statement_id, line, operation, statement, end_line) of mapper files with a namespace. Statements are whole."""
    attributes = r"""(?is)<(select|insert|update|delete)\b([^>]*)>(.*?)</\1>"""
    mine = of(files, "xml").where(F.col("content").contains("<mapper"))
    namespaces = mine.select(*KEYS, F.regexp_extract("content", r"""<mapper\b[^>]*\bnamespace\s*=\s*["']([^"']+)["']""", 1).alias("namespace"), "content").where("namespace <> ''")
    found = find_all(namespaces, attributes, ["verb", "attributes", "body"], carry=["namespace"])
    return found.select(*KEYS, "namespace", F.regexp_extract("attributes", r"""\bid\s*=\s*["']([^"']+)["']""", 1).alias("statement_id"), "line", F.lower("verb").alias("operation"), squeezed("body").alias("statement"), "end_line").where("statement_id <> ''")


def sql_facts(statements: DataFrame) -> DataFrame:
    """statements with tables (distinct, in order) and the flags of their text."""
    s, op = F.col("statement"), F.col("operation")
    raw = F.lit(None).cast("array<string>")
    for name, pattern in (("select", r"(?i)\bfrom\s+([`\w.]+)"), ("insert", r"(?i)\binsert\s+into\s+([`\w.]+)"), ("update", r"(?i)\bupdate\s+([`\w.]+)"), ("delete", r"(?i)\bdelete\s+from\s+([`\w.]+)")):
        raw = F.when(op == name, F.regexp_extract_all(s, F.lit(pattern), F.lit(1))).otherwise(raw)
    tables = F.array_distinct(F.transform(F.coalesce(raw, F.array().cast("array<string>")), lambda t: F.regexp_replace(t, "^`+|`+$", "")))
    flags = {"uses_dollar": s.contains("${"), "uses_select_star": s.rlike(r"(?i)\bselect\s+\*"), "has_where": s.rlike(r"(?i)\bwhere\b"), "has_pagination": s.rlike(r"(?i)\blimit\b|\boffset\b")}
    return statements.withColumns({"tables": tables, **flags})


def ddl_tables(files: DataFrame) -> DataFrame:
    """(project_id, table_name): the tables that .sql files create, in lower case, without a schema's name."""
    found = find_all(of(files, "sql"), CREATE_TABLE, ["name"])
    return found.select("project_id", F.lower(F.substring_index("name", ".", -1)).alias("table_name")).distinct()


def link_tables(statements: DataFrame) -> DataFrame:
    """(project_id, source, target, kind, confidence) of statements (project_id, node_id, operation, tables): what they read or write. Table names are equal whatever their case."""
    each = statements.select("project_id", F.col("node_id").alias("source"), "operation", F.explode("tables").alias("table_name"))
    kind = F.when(F.col("operation") == "select", "reads_table").otherwise("writes_table")
    return each.select("project_id", "source", F.concat(F.lit("table:"), F.lower("table_name")).alias("target"), kind.alias("kind"), F.lit("high").alias("confidence")).distinct()

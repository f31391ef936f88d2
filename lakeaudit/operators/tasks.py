"""Review tasks of chains: what belongs to them, the code they show, and contexts as text.

A task's files, relations, facts and fragments are rows of tables of their own; only a context is one text.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .facts import KEYS, REDACTED, SECRET
from .plan import LEFT_OUT, RELATED_LINES, TARGET_LINES, first_n, lines, number_lines, order_chain_tasks
from .review import TASK

CHAIN = ["project_id", "chain_id"]
# Most fragments of a chain, lines of a type shown, lines around a one-line span, facts of a chain and of a project, files and relations of a layered context.
FRAGMENTS, TYPE_LINES, ABOVE, BELOW, CHAIN_FACTS, PROJECT_FACTS, FILES, RELATIONS = 18, 160, 2, 6, 20, 80, 14, 40
#: Lines that a span and a file meet in at a time.
BUCKET = 64
# How fragments are labelled, tasks named and ranked.
LABELS = {
    "frontend_action": "前端操作", "api_call": "前端 API", "java_method": "Java 方法", "dto_type": "DTO", "mapper_method": "Mapper 方法",
    "framework_persistence": "框架持久化操作", "remote_call": "远程客户端调用", "sql_statement": "SQL",
}
OTHER_LABEL, CONFIG_TASK, CONFIG_PRIORITY = "相关代码", "springvue.config-context", 80
DOMAINS = {"endpoint_chain": "全链路：", "springvue_config": "项目运行配置上下文"}


def chain_files(nodes: DataFrame) -> DataFrame:
    """(CHAIN, relative_path, place): the distinct files of a chain's nodes, by the first place of each."""
    return nodes.groupBy(*CHAIN, "relative_path").agg(F.min("place").alias("place"))


def cut_fragments(nodes: DataFrame, files: DataFrame, most: int = FRAGMENTS) -> DataFrame:
    """(CHAIN, number, label, relative_path, line, language, content): the first ``most`` distinct spans of code of each chain.

    nodes: CHAIN, kind, relative_path, line, end_line (0: that line alone), place. Endpoints and tables show no code. A
    type shows its file's first TYPE_LINES lines; a span of one line ABOVE and BELOW more. Content: numbered
    lines, none beyond the file's end. Spans and lines meet in buckets of BUCKET lines, so a file isn't held
    once for each span, and each span is cut once however many chains show it. Null lines count as 1.
    """
    sizes = files.select(*KEYS, "language", "line_count")
    shown = nodes.where(~F.col("kind").isin("controller_endpoint", "database_table")).join(sizes, KEYS)
    first = F.greatest(F.lit(1), F.coalesce("line", F.lit(1)))
    last = F.when(F.coalesce("end_line", F.lit(0)) == 0, first).otherwise(F.col("end_line"))
    dto, single = F.col("kind") == "dto_type", first == last
    start = F.when(dto, 1).when(single, F.greatest(F.lit(1), first - ABOVE)).otherwise(first).cast("int")
    end = F.when(dto, F.least("line_count", F.lit(TYPE_LINES))).when(single, F.least("line_count", last + BELOW)).otherwise(last).cast("int")
    spans = shown.select(*CHAIN, "kind", "relative_path", "language", start.alias("line"), end.alias("end"), "place")
    once = spans.groupBy(*CHAIN, "relative_path", "language", "line", "end").agg(F.min_by("kind", "place").alias("kind"), F.min("place").alias("place"))
    number = F.row_number().over(Window.partitionBy(*CHAIN).orderBy("place", "relative_path", "line", "end"))
    kept = once.withColumn("number", number).where(F.col("number") <= most).drop("place")

    span = [*KEYS, "line", "end"]
    reach = F.sequence(F.floor(F.col("line") / BUCKET), F.floor(F.greatest("line", "end") / BUCKET))
    wanted = kept.select(*span).distinct().withColumn("bucket", F.explode(reach))
    every = number_lines(files.join(kept.select(*KEYS).distinct(), KEYS, "left_semi")).withColumn("bucket", F.floor(F.col("line") / BUCKET)).withColumnRenamed("line", "at")
    inside = wanted.join(every, [*KEYS, "bucket"]).where("at between line and end")
    cut = inside.groupBy(*span).agg(F.array_sort(F.collect_list(F.struct("at", "text"))).alias("rows"))
    text = cut.select(*span, F.array_join(F.transform("rows", lambda r: r["text"]), "\n").alias("content"))
    label = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair]), F.col("kind")), F.lit(OTHER_LABEL))
    done = kept.join(text, span, "left").withColumns({"label": label, "content": F.coalesce("content", F.lit(""))})
    return done.select(*CHAIN, "number", "label", "relative_path", "line", "language", "content")


def config_facts(keys: DataFrame, most: int) -> DataFrame:
    """(project_id, number, fact): the first ``most`` keys that matter of a project, by path and line, with their shown values.

    Cut before anything is joined: chains of a project share its facts.
    """
    place = F.row_number().over(Window.partitionBy("project_id").orderBy("relative_path", "line", "key"))
    few = first_n(keys, most, ["project_id"], [F.col("relative_path"), F.col("line"), F.col("key")])
    return few.select("project_id", place.alias("number"), F.format_string("%s=%s（%s:%d）", "key", "value", "relative_path", "line").alias("fact"))


def attach_config(chains: DataFrame, keys: DataFrame) -> DataFrame:
    """(CHAIN, number, fact): the configuration that every chain of a project has as context."""
    return chains.select(*CHAIN).join(config_facts(keys, CHAIN_FACTS), "project_id")


def build_chain_plan(chains: DataFrame, paths: DataFrame, keys: DataFrame, strategies: DataFrame, layered: DataFrame) -> DataFrame:
    """Tasks of each project: TASK, kind, domain, priority, chain_id, endpoint, chain_status, chain_path, chain_gaps, risk_score, risk_reasons.

    chains: CHAIN, name, status, gaps, risk_score, risk_reasons; paths: render_chain_path(); strategies: (project_id,
    strategy); layered: TASK, domain, priority. A project reviewed by chains has one task a chain (riskier first) and
    one for its configuration, if keys matter; a project without chains, or whose strategy isn't
    endpoint_chain, has its layered tasks.
    """
    by_chain = strategies.where("strategy = 'endpoint_chain'").select("project_id").join(chains.select("project_id").distinct(), "project_id", "left_semi").distinct()
    none, text = F.array().cast("array<string>"), F.lit("")
    ordered = order_chain_tasks(chains.join(by_chain, "project_id", "left_semi")).join(paths, CHAIN, "left")
    blank = {"chain_id": text, "endpoint": text, "chain_status": text, "chain_path": text, "chain_gaps": none, "risk_score": F.lit(0), "risk_reasons": none}
    columns = [*TASK, "kind", "domain", "priority", *blank]
    one = ordered.withColumns({
        "task_id": F.col("chain_id"), "kind": F.lit("endpoint_chain"), "domain": F.concat(F.lit(DOMAINS["endpoint_chain"]), "name"), "endpoint": F.col("name"),
        "chain_status": F.col("status"), "chain_gaps": F.col("gaps"), "chain_path": F.coalesce("chain_path", text), "priority": F.col("priority").cast("int"),
    })
    config = keys.select("project_id").distinct().join(by_chain, "project_id", "left_semi")
    config = config.withColumns({"task_id": F.lit(CONFIG_TASK), "kind": F.lit("springvue_config"), "domain": F.lit(DOMAINS["springvue_config"]), "priority": F.lit(CONFIG_PRIORITY), **blank})
    rest = layered.join(by_chain, "project_id", "left_anti").withColumns({"kind": F.lit("layered"), **blank})
    return one.select(*columns).unionByName(config.select(*columns)).unionByName(rest.select(*columns))


def _text(lead: str, body: Column) -> Column:
    return F.concat(F.lit(lead), body)


def _listed(frame: DataFrame, keys: list[str], section: int, lead: str, join: str, item: str = "item") -> DataFrame:
    """(keys, section, number, text): the items of a section by number, one text."""
    rows = frame.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("number", item))).alias("_rows"))
    body = F.array_join(F.transform("_rows", lambda r: r[item]), join)
    return rows.select(*keys, F.lit(section).alias("section"), F.lit(0).alias("number"), _text(lead, body).alias("text"))


def _single(frame: DataFrame, section: int, text: Column) -> DataFrame:
    return frame.select(*TASK, F.lit(section).alias("section"), F.lit(0).alias("number"), text.alias("text"))


def chain_pieces(tasks: DataFrame, checklist: Sequence[str], relations: DataFrame, keys: DataFrame, fragments: DataFrame) -> DataFrame:
    """(TASK, section, number, text) of chains' contexts.

    tasks: build_chain_plan(); relations: CHAIN, number, source, kind, confidence, target, evidence; fragments: cut_fragments().
    """
    mine = tasks.where("kind = 'endpoint_chain'")
    ids = mine.select(*TASK, "chain_id")
    head = F.concat_ws("\n\n", _text("链路：", F.col("chain_id")), _text("接口：", F.col("endpoint")), _text("状态：", F.col("chain_status")), _text("通路：", F.col("chain_path")))
    said = F.format_string("%s --%s/%s--> %s：%s", "source", "kind", "confidence", "target", "evidence")
    shown = F.format_string("%s: %s:%d\n```%s\n%s\n```", "label", "relative_path", "line", "language", "content")
    parts = [
        _single(mine, 0, head),
        _single(mine.where(F.size("chain_gaps") > 0), 1, _text("断链：\n- ", F.array_join("chain_gaps", "\n- "))),
        _single(mine.where(F.size("risk_reasons") > 0), 2, _text("风险依据：", F.array_join("risk_reasons", "、"))),
        _single(mine, 3, F.lit("清单：\n- " + "\n- ".join(checklist))),
        _listed(relations.join(ids, CHAIN).withColumn("item", said), TASK, 4, "关系：\n", "\n"),
        _listed(attach_config(mine, keys).join(ids, CHAIN), TASK, 5, "配置（远程值未验证）：\n- ", "\n- ", "fact"),
        fragments.join(ids, CHAIN).select(*TASK, F.lit(6).alias("section"), "number", shown.alias("text")),
    ]
    return _union(parts)


def config_pieces(tasks: DataFrame, checklist: Sequence[str], keys: DataFrame) -> DataFrame:
    """(TASK, section, number, text) of the contexts of projects' configuration: values that are hidden stay hidden."""
    mine = tasks.where("kind = 'springvue_config'")
    facts = config_facts(keys, PROJECT_FACTS).join(mine.select(*TASK), "project_id")
    return _union([_single(mine, 3, F.lit("清单：\n- " + "\n- ".join(checklist))), _listed(facts, TASK, 5, "脱敏配置：\n- ", "\n- ", "fact")])


def layered_pieces(tasks: DataFrame, technologies: DataFrame, held: DataFrame, files: DataFrame, relations: DataFrame) -> DataFrame:
    """(TASK, section, number, text) of layered contexts: the first FILES files of a task, cut at TARGET_LINES or RELATED_LINES, and the first RELATIONS relations of its files.

    tasks: TASK, domain, rationale, checklist; technologies: (project_id, technologies); held: task_files(); relations: project_id,
    source, kind, target. YAML never shows the values of sensitive keys. A file is cut once for all tasks that show it alike.
    """
    head = F.concat_ws("\n\n", _text("技术栈：", F.array_join("technologies", "、")), _text("范围：", F.col("domain")), _text("理由：", F.col("rationale")), _text("清单：\n- ", F.array_join("checklist", "\n- ")))
    mine = tasks.join(technologies, "project_id", "left").withColumn("technologies", F.coalesce("technologies", F.array().cast("array<string>")))
    once = held.groupBy(*TASK, "relative_path").agg(F.min(F.struct((F.col("kind") != "target").alias("related"), "rank")).alias("first"))
    once = once.join(tasks.select(*TASK), TASK, "left_semi").join(files.select(*KEYS), KEYS, "left_semi")
    place = F.row_number().over(Window.partitionBy(*TASK).orderBy("first.related", "first.rank", "relative_path"))
    few = once.withColumn("number", place).where(F.col("number") <= FILES).select(*TASK, "relative_path", "number", F.col("first.related").alias("related"))
    content = F.when(F.col("language") == "yaml", F.regexp_replace("content", SECRET, f"$1: {REDACTED}")).otherwise(F.col("content"))
    asked = few.select(*KEYS, "related").distinct()
    every = files.join(asked, KEYS).withColumn("every", lines(content)).withColumn("most", F.when(F.col("related"), RELATED_LINES).otherwise(TARGET_LINES))
    numbered = F.transform(F.slice("every", F.lit(1), F.col("most")), lambda text, i: F.format_string("%4d: %s", i + 1, text))
    body = F.concat(F.array_join(numbered, "\n"), F.when(F.size("every") > F.col("most"), LEFT_OUT).otherwise(""))
    label = F.when(F.col("related"), "关联文件").otherwise("目标文件")
    cut = every.select(*KEYS, "related", F.format_string("%s: %s\n```%s\n%s\n```", label, "relative_path", "language", body).alias("text"))
    shown = few.join(cut, [*KEYS, "related"]).select(*TASK, F.lit(4).alias("section"), "number", "text")
    ends = relations.select("project_id", F.explode(F.array_distinct(F.array("source", "target"))).alias("relative_path"), "source", "kind", "target")
    met = ends.join(once.select(*TASK, "relative_path"), KEYS).select(*TASK, "source", "kind", "target").distinct()
    place = F.row_number().over(Window.partitionBy(*TASK).orderBy("source", "target", "kind"))
    told = met.withColumn("number", place).where(F.col("number") <= RELATIONS).withColumn("item", F.format_string("%s --%s--> %s", "source", "kind", "target"))
    return _union([_single(mine, 0, head), shown, _listed(told, TASK, 5, "关联：\n", "\n")])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def render_context(pieces: DataFrame) -> DataFrame:
    """(TASK, context): a task's pieces by section and number, with a blank line between.

    Long lists were joined by section before, so what meets here is a few dozen texts a task.
    """
    rows = F.array_sort(F.collect_list(F.struct("section", "number", "text")))
    return pieces.groupBy(*TASK).agg(F.array_join(F.transform(rows, lambda r: r["text"]), "\n\n").alias("context"))

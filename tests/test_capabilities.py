"""Registered capabilities: ties, failures, merged facts."""

import pytest
from pyspark.sql import functions as F

from lakeaudit.operators import capabilities
from lakeaudit.operators.capabilities import Capability, Registry
from lakeaudit.sources.files import files_from_table


def lake(spark):
    rows = [(p, f"f{k}.{s}", f"text {k}", 6) for p in ("p", "q") for k, s in enumerate(("py", "go", "sql", "java"))]
    return files_from_table(spark.createDataFrame(rows, "project_id string, relative_path string, content string, byte_size long"))


def capability(name, score, languages, analyze=None, specialized=True):
    return Capability(
        name,
        lambda files: files.select("project_id", F.when(F.col("project_id") == "p", score).otherwise(0.1).alias("score"), F.lit(name).alias("reason")).distinct(),
        lambda files: files.where(F.col("language").isin(*languages)),
        analyze or (lambda files: {"seen": files.select("project_id", "relative_path")}),
        specialized,
    )


def planned(files):
    raise RuntimeError("not today\nnor tomorrow")


def running(files):
    def fail(batches):
        for _ in batches:
            raise ValueError("bad row")
        yield from ()

    return {"rows": files.select("project_id").mapInArrow(fail, "project_id string")}


def test_shares_out_and_survives_failures(spark):
    registry = Registry()
    for c in (capability("one", 0.7, ["python", "go"]), capability("two", 0.7, ["go", "sql"]), capability("low", 0.4, ["java"]), capability("late", 0.6, ["python"]), capability("bad", 0.9, ["sql", "python"], planned), capability("worse", 0.8, ["go"], running), capability("rest", 0.1, [], specialized=False)):
        registry.register(c)
    with pytest.raises(ValueError):
        registry.register(capability("one", 0.7, []))
    with pytest.raises(ValueError):
        registry.register(capability("more", 0.7, [], specialized=False))
    run = capabilities.run(lake(spark), registry)
    owners = {(r.project_id, r.relative_path.split(".")[1]): r.owner for r in run.owners.collect()}
    assert owners == {("p", "py"): "one", ("p", "go"): "one", ("p", "sql"): "two", ("p", "java"): "rest", ("q", "py"): "rest", ("q", "go"): "rest", ("q", "sql"): None, ("q", "java"): "rest"}
    failed = {(r.project_id, r.capability): r.error for r in run.failures.collect()}
    assert set(failed) == {("p", "bad"), ("p", "worse")} and failed["p", "bad"] == "RuntimeError: not today"
    said = {(r.project_id, r.capability): (r.status, r.n_files) for r in run.selections.collect()}
    assert said == {
        ("p", "one"): (capabilities.ENABLED, 2), ("p", "two"): (capabilities.ENABLED, 1), ("p", "late"): (capabilities.EMPTY, 0), ("p", "bad"): (capabilities.DEGRADED, 0), ("p", "worse"): (capabilities.DEGRADED, 0),
        ("p", "rest"): (capabilities.ENABLED, 1), ("q", "rest"): (capabilities.ENABLED, 3),
    }
    assert {(k, t["seen"].count()) for k, t in run.facts.items()} == {("one", 2), ("two", 1), ("late", 0), ("low", 0), ("rest", 4)}


def test_nothing_registered(spark):
    run = capabilities.run(lake(spark), Registry())
    assert run.owners.where("owner is null").count() == 8 and run.selections.count() == 0 and run.failures.count() == 0 and not run.facts


def test_merge_of_clashing_and_missing_columns(spark):
    a = spark.createDataFrame([("p", "f", 1, "k")], "project_id string, file string, line int, kind string")
    b = spark.createDataFrame([("p", "f", "1", 0.5), ("p", "f", "1", 0.5)], "project_id string, file string, line string, score double")
    merged = capabilities.merge_facts({"x": {"r": a}, "y": {"r": b, "s": a.limit(0)}})
    assert set(merged.columns) == {"project_id", "capability", "rank", "kind", "file", "line", "own_kind", "score"}
    rows = sorted((r.capability, r["rank"], r.kind, r.line, r.own_kind, r.score) for r in merged.fillna("", ["own_kind"]).fillna(0, ["score"]).collect())
    assert rows == [("x", 0, "r", "1", "k", 0.0), ("y", 1, "r", "1", "", 0.5), ("y", 1, "r", "1", "", 0.5)]
    with pytest.raises(ValueError):
        capabilities.merge_facts({})


def test_merge_of_technologies_and_roles(spark):
    said = spark.createDataFrame([("p", 1, 0, "Vue"), ("p", 0, 1, "Go"), ("p", 0, 0, "SQL"), ("p", 1, 1, "Go"), ("q", 0, 0, None)], "project_id string, rank int, place int, technology string")
    projects = spark.createDataFrame([("p",), ("q",), ("q",)], "project_id string")
    assert {(r.project_id, tuple(r.technologies)) for r in capabilities.merge_technologies(projects, said).collect()} == {("p", ("SQL", "Go", "Vue")), ("q", (capabilities.UNKNOWN,))}
    roles = spark.createDataFrame([("p", "service", "a", 1, 0), ("p", "service", "a", 0, 5), ("p", "mapper", "a", 1, 2)], "project_id string, role string, relative_path string, rank int, place int")
    assert {tuple(r) for r in capabilities.merge_roles(roles).collect()} == {("p", "service", "a", 0, 5), ("p", "mapper", "a", 1, 2)}


def test_contents_meet_their_owners_once(spark):
    seen = []

    def analyze(files):
        seen.append(files._jdf.queryExecution().executedPlan().toString())
        return {"paths": files.select("project_id", "relative_path")}

    rows = [("p", "a.py", "python", "x"), ("p", "a.py", "python", "x"), ("p", "b.go", "go", "y"), ("q", None, "go", "z")]
    files = spark.createDataFrame(rows, "project_id string, relative_path string, language string, content string")
    registry = capabilities.Registry()
    registry.register(capabilities.Capability("rest", lambda f: f.select("project_id", F.lit(1.0).alias("score"), F.lit("").alias("reason")).distinct(), lambda f: f, analyze, specialized=False))
    found = capabilities.run(files, registry)
    assert len(seen) == 1 and "Join" not in seen[0]
    assert sorted(map(tuple, found.facts["rest"]["paths"].collect())) == [("p", "a.py"), ("p", "a.py"), ("p", "b.go")]


def test_claims_by_condition_share_out_alike_and_shuffle_no_contents(spark):
    def registry(as_condition):
        out, calls = Registry(), []

        def counting(name):
            def analyze(files):
                calls.append(name)
                return {"seen": files.select("project_id", "relative_path")}

            return analyze

        for name, score, languages, analyze in (("one", 0.7, ["python", "go"], counting("one")), ("bad", 0.9, ["sql", "python"], planned), ("two", 0.7, ["go", "sql"], counting("two")), ("worse", 0.8, ["java"], running)):
            c = capability(name, score, languages, analyze)
            out.register(Capability(name, c.detect, F.col("language").isin(*languages) if as_condition else c.claim, analyze))
        out.register(capability("rest", 0.1, [], counting("rest"), specialized=False))
        return out, calls

    plain, named = (lake(spark).unionByName(lake(spark).where("language = 'go'").withColumn("relative_path", F.lit(None).cast("string"))) for _ in range(2))
    (by_frame, _), (by_condition, calls) = registry(False), registry(True)
    theirs, ours = capabilities.run(plain, by_frame), capabilities.run(named, by_condition)
    for table in ("owners", "selections", "failures"):
        a, b = (sorted(map(str, getattr(r, table).drop("error").collect())) for r in (theirs, ours))
        assert a == b, table
    assert {k: sorted(map(tuple, t["seen"].collect())) for k, t in theirs.facts.items()} == {k: sorted(map(tuple, t["seen"].collect())) for k, t in ours.facts.items()}
    # "one" got a file of "bad" and analysed anew; what nothing was added to is kept.
    assert calls == ["one", "one", "two", "rest"]
    held = capabilities.detections(plain, by_condition.capabilities).localCheckpoint()
    plan = capabilities.allocate(plain, by_condition.capabilities, held)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1

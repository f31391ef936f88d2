"""Numbers and sums over ranges against ones counted in memory."""

import random

from pyspark.sql import functions as F

from lakeaudit.operators import facts, findings, ranges


def rows():
    turn = random.Random(1)
    out = [(None if k % 50 == 0 else f"p{k % 3 if k % 4 else 0}", turn.randrange(1000), k, turn.randrange(5)) for k in range(2_000)]
    turn.shuffle(out)
    return out


def expected(name):
    held = {}
    for r in rows():
        held.setdefault(r[0], []).append(r)
    out = {}
    for mine in held.values():
        total = 0
        for place, r in enumerate(sorted(mine, key=lambda r: (-r[1], r[2])), 1):
            total += r[3]
            out[r[2]] = place if name == "place" else total
    return out


def test_one_key_of_many_ranges(spark):
    df = spark.createDataFrame(rows(), "key string, a int, id int, v int")
    order = [F.col("a").desc(), F.col("id")]
    placed = ranges.number_rows(df, ["key"], order, "place")
    assert placed.columns == [*df.columns, "place"] and {r.id: r.place for r in placed.collect()} == expected("place")
    summed = ranges.running_sum(df, ["key"], order, "v", "total")
    assert {r.id: r.total for r in summed.collect()} == expected("total")
    assert ranges.number_rows(df.limit(0), ["key"], order, "place").count() == 0 and ranges.running_sum(df.limit(0), ["key"], order, "v", "total").count() == 0


def test_no_window_by_project_alone(spark):
    df = spark.createDataFrame(rows(), "project_id string, a int, id int, v int")
    plan = ranges.number_rows(df, ["project_id"], [F.col("a"), F.col("id")], "place")._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan


def test_matches_of_a_long_file(spark):
    text = "x1\n" * 100_000
    df = spark.createDataFrame([("p", "f", text, "kept"), ("p", "g", None, "kept"), ("p", "h", "", "kept")], "project_id string, relative_path string, content string, more string")
    found = facts.find_all(df, r"x(\d)(y)?\n", ["digit", "none"], carry=["more"])
    row = found.agg(F.count(F.lit(1)).alias("n"), F.sum((F.col("line") == F.col("ord") + 1).cast("int")).alias("lines"), F.sum((F.col("end_line") == F.col("line") + 1).cast("int")).alias("ends"), F.min("digit").alias("digit"), F.max("none").alias("none"), F.min("more").alias("more")).first()
    assert tuple(row) == (100_000, 100_000, 100_000, "1", "", "kept")


def test_enclosing_methods(spark):
    text = "class A {\n  int x;\n  public void f() {\n    a();\n    new B() {\n      private int g() { return 1; }\n    };\n  }\n\n  int y;\n}\n" + "// z\n" * 300 + "public void open() {\n" + "b();\n" * 200
    files = spark.createDataFrame([("p", "A.java", text), ("p", "E.java", "")], "project_id string, relative_path string, content string")
    asked = spark.createDataFrame([("p", path, k, line) for k, (path, line) in enumerate([("A.java", 1), ("A.java", 3), ("A.java", 4), ("A.java", 6), ("A.java", 7), ("A.java", 10), ("A.java", 400), ("A.java", 9999), ("A.java", None), ("A.java", -5), ("E.java", 3), ("Gone.java", 1)])], "project_id string, relative_path string, seq long, line int")
    got = {r.seq: (r.center, r["head"], r.end) for r in findings.enclosing_method(asked, files).collect()}
    assert got == {0: (0, 0, 10), 1: (2, 2, 7), 2: (3, 2, 7), 3: (5, 5, 5), 4: (6, 5, 5), 5: (9, 5, 5), 6: (399, 311, 430), 7: (511, 311, 430), 8: (0, 0, 10), 9: (0, 0, 10)}


def test_edges_are_numbered_without_a_window_over_a_project(spark, tmp_path):
    from lakeaudit.jobs.bindings import EDGES, bound, bound_to_edges

    row = "id DIV 3 AS l_orderkey, id % 7 AS l_partkey, id % 5 AS l_suppkey, cast(id % 3 AS int) AS l_linenumber, cast(id AS double) AS l_extendedprice, 'R' AS l_returnflag, date '2020-01-01' AS l_shipdate"
    spark.range(500).selectExpr(*row.split(", ")).write.parquet(f"{tmp_path}/lineitem.parquet")
    ours = bound_to_edges(spark, str(tmp_path), f"SELECT * FROM ({EDGES}) AS e")
    assert "row_number" not in ours._jdf.queryExecution().executedPlan().toString()
    theirs = bound(spark, str(tmp_path), EDGES).select(*ours.columns)
    assert sorted(map(tuple, ours.collect())) == sorted(map(tuple, theirs.collect()))


def test_more_rows_get_more_tasks(spark, tmp_path, monkeypatch):
    from lakeaudit.jobs.bindings import EDGES, bound_to_edges

    monkeypatch.setattr(ranges, "ROWS", 40)
    held, per = ranges._ranged(spark.range(400).withColumn("key", F.lit("k")), ["key"], [F.col("id")], 400)
    assert held.select("_range").distinct().count() > 4 and per.agg(F.sum("_n")).first()[0] == 400
    row = "id AS l_orderkey, id % 7 AS l_partkey, id % 5 AS l_suppkey, cast(id % 3 AS int) AS l_linenumber, cast(id AS double) AS l_extendedprice, 'R' AS l_returnflag, date '2020-01-01' AS l_shipdate"
    spark.range(400).selectExpr(*row.split(", ")).write.parquet(f"{tmp_path}/lineitem.parquet")
    edges = bound_to_edges(spark, str(tmp_path), f"SELECT * FROM ({EDGES}) AS e", "project_id", "target")
    assert edges.rdd.getNumPartitions() == 11 and edges.count() == 400

"""Queries against their SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from lakeaudit.jobs import registry
import lakeaudit.jobs  # noqa: F401

SF = "/root/testdata/sf0.001"
CHEAP = ["s2_files_from_table", "p4_classify_role", "f1_normalize_url", "x1_extract_routes", "x16_sql_facts", "j2_relate_calls_to_routes", "w1_dedup_edges", "p9_govern", "w7_dedup_findings", "f7_parse_findings", "x8_extract_java_types", "x9_extract_java_methods", "x12_extract_endpoints", "j5_link_invocations", "j7_link_framework_crud", "j19_cut_fragments", "g4_attach_config", "o5_build_chain_plan", "u4_render_chain_context", "u4_render_layered_context", "w11_number_findings", "w10_cumulative_tokens", "j21_finding_context", "x8_ddl_tables"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
@pytest.mark.parametrize("name", CHEAP)
def test_same(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    df = registry.QUERIES[name](spark, SF)
    theirs = con.execute(registry.ORACLES[name])
    columns = [c[0] for c in theirs.description]
    assert sorted(columns) == sorted(df.columns)
    ours = df.select(*columns).collect()
    assert sorted(map(repr, map(tuple, ours))) == sorted(map(repr, theirs.fetchall()))


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the given tables")
def test_whole_walk(spark):
    def pairs(name, *columns):
        return duckdb.sql(f"SELECT {', '.join(columns)} FROM read_parquet('{SF}/{name}.parquet')").fetchall()

    edges = {}
    parts = [p for (p,) in pairs("part", "p_partkey")]
    nations = {n for (n,) in pairs("nation", "n_nationkey")}
    for n, c in pairs("customer", "c_nationkey", "c_custkey"):
        if n in nations:
            edges.setdefault(f"nation{n}", set()).add(f"customer{c}")
    for c, o in pairs("orders", "o_custkey", "o_orderkey"):
        edges.setdefault(f"customer{c}", set()).add(f"order{o}")
    for o, p, n in pairs("lineitem", "l_orderkey", "l_partkey", "l_linenumber"):
        if n != 5:
            edges.setdefault(f"order{o}", set()).add(f"part{p}")
    for p in [p for p in parts if p % 5]:
        edges.setdefault(f"part{p}", set()).add(f"order{p}")
    wanted = set()
    for start in [f"nation{n}" for n in nations] + [f"part{p}" for p in parts]:
        seen, frontier = {start: 0}, {start}
        for depth in range(1, 9):
            frontier = {t for s in frontier for t in edges.get(s, ())} - seen.keys()
            seen |= dict.fromkeys(frontier, depth)
        wanted |= {("w", start, node, depth) for node, depth in seen.items()}
    got = registry.QUERIES["g1_walk_endpoints"](spark, SF).select("project_id", "start", "node_id", "depth").collect()
    assert len(got) == len(wanted) and set(map(tuple, got)) == wanted

"""What queries compute, shuffle and hold as their tables grow: seen in their plans, and on odd inputs against plain loops."""

import os
from collections import Counter

from pyspark.sql import functions as F

import __spark_entry__
from spanloom.functions import multiset
from spanloom.functions.staging import shared_dir
from spanloom.operators import changes, linkage, metrics
from spanloom.plans.base import Graph

SF = "/root/testdata/sf0.001"


def built(spark, name):
    return __spark_entry__.queries()[name](spark, SF)


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def tables(df):
    return {os.path.basename(f).removesuffix(".parquet") for f in df.inputFiles()}


def scanned(df):
    df = df._jdf.queryExecution().optimizedPlan().toString()
    return {t for t in ("l_orderkey", "o_orderkey", "c_custkey", "s_suppkey", "p_partkey") if t in df}


def test_detail_writes_no_graph(spark, tmp_path):
    there = shared_dir(spark).removeprefix("file:")
    os.symlink(SF, tmp_path / "sf")
    before = set(os.listdir(there))
    row = __spark_entry__.queries()["verb_symbol_detail"](spark, f"{tmp_path}/sf").collect()
    assert [r.identity for r in row] == ["region:ASIA"] and set(os.listdir(there)) == before


def test_report_moves_keys_and_no_identities(spark):
    df = built(spark, "stats_report")
    assert tables(df) and "concat" not in df._jdf.queryExecution().optimizedPlan().toString()
    assert "row_number" not in plan(df)


def test_kinds_are_computed_alone(spark):
    assert scanned(built(spark, "group_diagnostics")) == {"c_custkey"}
    assert scanned(built(spark, "verb_rules_check")) == {"o_orderkey", "c_custkey"}
    assert "concat" not in built(spark, "rule_report")._jdf.queryExecution().optimizedPlan().toString()


def test_identities_are_put_together_after_the_joins(spark):
    for name in ("descendant_counts", "join_local_target"):
        text = plan(built(spark, name))
        # no side of a join by order or customer carries text made of a nation's name
        assert "hashpartitioning(o_custkey" in text or "BroadcastHashJoin [o_custkey" in text
        for line in text.splitlines():
            if "hashpartitioning(o_orderkey" in line or "hashpartitioning(o_custkey" in line:
                assert "nation#" not in line


def test_lines_of_orders_without_a_customer_have_no_references(spark, tmp_path):
    for f in os.listdir(SF):
        if f not in ("orders.parquet",):
            os.symlink(f"{SF}/{f}", tmp_path / f)
    o = spark.read.parquet(f"{SF}/orders.parquet")
    o.withColumn("o_custkey", F.when(F.col("o_orderkey") % 2 == 0, -1).otherwise(F.col("o_custkey")).cast(o.schema["o_custkey"].dataType)).write.parquet(f"{tmp_path}/orders.parquet")
    g = Graph(spark, str(tmp_path))
    lines = g.symbols.filter("kind = 'line'").select("symbol_id").distinct()
    assert lines.count() > 0
    assert g.refs.filter("kind in ('uses_type', 'calls')").join(lines, F.col("source_symbol_id") == F.col("symbol_id"), "left_anti").count() == 0


def test_cbo_of_owners_at_several_depths(spark):
    ids = {1: ("a:x", "a"), 2: ("a:x/b:y", "o"), 3: ("a:x/b:y/c:z", "c"), 4: ("a:x/b:w", "c"), 5: ("a:v/b:u/c:t", "o"), 6: ("a:v/b:`s/r`", "o"), 7: ("a:v/b:`s/r`/c:q", "c")}
    links = [(3, "a:x/b:w"), (3, "a:v/b:u/c:t"), (4, "a:x/b:y/c:z"), (5, "a:x/b:y"), (7, "a:x/b:w"), (7, "a:v/b:`s/r`"), (2, None), (1, "a:x/b:y/c:z")]
    symbols = spark.createDataFrame([(k, i, kind) for k, (i, kind) in ids.items()], "symbol_id long, identity string, kind string")
    refs = spark.createDataFrame(links, "source_symbol_id long, target_identity string")
    ends = [(ids[s][0], t) for s, t in links if t is not None]
    under = lambda i, own: i == own or i.startswith(own + "/")
    want = {k: len({"/".join(o.split("/")[:2]) for a, b in [*ends, *[(t, s) for s, t in ends]] for i, o in [(a, b)] if under(i, own) and not under(o, own)}) for k, (own, kind) in ids.items() if kind == "o"}
    got = metrics.cbo(symbols, refs, "o", 2)
    assert {r.symbol_id: r.cbo for r in got.collect()} == want and max(want.values()) > 1
    # prefixes are folded to owner's depths and short buckets before the join
    for line in plan(built(spark, "metric_cbo")).splitlines():
        if "hashpartitioning(source_symbol_id" in line or "hashpartitioning(symbol_id" in line:
            assert "identity#" not in line


def test_edges_are_staged_once_for_a_corridor(spark, monkeypatch):
    from spanloom.operators import graph

    written = []
    monkeypatch.setattr(graph, "stage", lambda df, f=graph.stage: written.append(df.columns) or f(df))
    edges = spark.createDataFrame([(1, 1, 2), (2, 2, 3), (3, 3, 4), (4, 4, None)], "reference_id long, s long, t long")
    node = lambda k: spark.createDataFrame([(k,)], "node long")
    assert {(r.node, r.forward, r.backward) for r in graph.corridor(edges, node(1), node(3), 2).collect()} == {(1, 0, 2), (2, 1, 1), (3, 2, 0)}
    assert written.count(["reference_id", "s", "t"]) == 1 and len(written) <= 7


def test_candidates_are_chosen_before_they_are_paired(spark, tmp_path):
    df = built(spark, "concrete_over_alias")
    assert "Window" not in plan(df) and df.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = spark.createDataFrame([(1, 9.0), (1, 1.0), (1, None), (2, 1.0), (2, 2.0), (2, None), (3, None), (None, 9.0)], "k int, x double")
    assert sorted((r.k, r.x) for r in linkage.prefer_once(rows, "k", F.col("x") > 5).collect()) == [(1, 9.0), (2, 1.0), (2, 2.0)]


def test_uncovered_lines_by_one_exchange(spark):
    text = plan(built(spark, "hunk_coverage"))
    assert text.count("Exchange hashpartitioning") == 1
    h = [(1, 0, 10), (1, 0, 10), (1, 5, 12), (1, 20, 18), (1, 30, None), (2, 3, 3), (2, 4, 6), (2, 6, 8)]
    e = [(1, 2, 4), (1, 2, 4), (1, 11, 40), (1, 9, 7), (2, None, 5)]
    spans = lambda rows: spark.createDataFrame(rows, "k int, start int, end int")
    lines = lambda rows: {(k, x) for k, a, b in rows if a is not None and b is not None for x in range(a, b)}
    want = lines(h) - lines(e)
    got = [(r.k, x) for r in changes.uncovered_pieces(spans(h), spans(e), "k").collect() for x in range(r.start, r.end)]
    assert len(got) == len(set(got)) and set(got) == want
    merged = [(r.k, r.start, r.end) for r in changes.uncovered(spans(h), spans(e), "k").collect()]
    assert sorted(merged) == [(1, 0, 2), (1, 4, 11), (2, 4, 8)]


def test_multisets_are_counted_once(spark):
    assert len(built(spark, "multiset_algebra").inputFiles()) == 1 and "Join" not in plan(built(spark, "multiset_algebra"))
    rows = [(1, 5, "R", "O"), (1, 5, "R", "F"), (1, 6, "A", "O"), (None, 5, "R", "O"), (1, None, "R", "O"), (2, 7, "A", "F"), (2, 8, None, "O")]
    df = spark.createDataFrame(rows, "o int, v int, f string, s string")
    got = Counter((r.owner, r.value, r.l, r.r) for r in multiset.sides(df, "o", "v", F.col("f") == "R", F.col("s") == "O").collect())
    assert got == Counter([(1, 5, 2, 1), (1, 6, 0, 1), (None, 5, 1, 0), (None, 5, 0, 1), (1, None, 1, 0), (1, None, 0, 1), (2, 8, 0, 1)])


def test_chains_are_never_broadcast(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(metrics, "stage", lambda df, f=metrics.stage: seen.append(plan(df)) or f(df))
    symbols = spark.range(1, 6).select(F.col("id").alias("symbol_id"))
    refs = symbols.select(F.col("symbol_id").alias("source_symbol_id"), (F.col("symbol_id") % 5 + 1).alias("target_id"), F.lit("extends").alias("kind"))
    assert {r.dit for r in metrics.depth_of_inheritance(symbols, refs, ["extends"]).collect()} == {5}
    assert any("Join" in p for p in seen) and not any("BroadcastHashJoin" in p for p in seen)


def test_uses_are_not_expanded(spark):
    assert "Expand" not in plan(built(spark, "usage_summary"))

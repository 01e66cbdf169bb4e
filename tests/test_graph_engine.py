import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from spanloom.functions import identity as ident
from spanloom.functions import logic, stats
from spanloom.operators import changes, graph, metrics, search
from spanloom.plans import dsl, registry, rules
from spanloom.plans.base import Graph
from spanloom.sources import files
from spanloom.streaming import live

SF = "/root/testdata/sf0.001"


def rows_of(table):
    return sorted(tuple("" if v is None else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r.values()) for r in table.to_pylist())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF).toArrow()
    want = duck.sql(registry.oracle_sql()[name]).to_arrow_table()
    names = sorted(want.column_names)
    assert sorted(got.column_names) == names
    assert rows_of(got.select(names)) == rows_of(want.select(names))


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0 and set(registry.queries()) <= set(__spark_entry__.queries())


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first().x


def test_identities(spark):
    uri = "lang:py/path:`a/b:c.py`/class:`od``d`/method:f(x)"
    assert ident.parse(uri) == [("lang", "py"), ("path", "a/b:c.py"), ("class", "od`d"), ("method", "f(x)")]
    assert "/".join(ident.write_segment(k, n) for k, n in ident.parse(uri)) == uri
    segs = ident.segments("u")
    assert [(s.kind, s["name"]) for s in one(spark, segs, u=uri)] == ident.parse(uri)
    assert one(spark, ident.serialise(segs), u=uri) == uri
    for pattern, holds in {"lang:py/**/method:/^f/": True, "**/class:*/**": True, "lang:*/path:*": False, "*/*/*/*": True, "**/method:g": False, "*:py/**": True, "**/class:/^z/**".replace("/**", "//**"): False}.items():
        assert one(spark, ident.matches_path(segs, pattern), u=uri) is holds, pattern
    with pytest.raises(ValueError):
        ident.matches_path(segs, "kind:/a(?=b)/")
    assert one(spark, ident.snake("u"), u="HTTPServer userName") == "http_server_user_name"
    assert one(spark, ident.is_ancestor(F.lit("a:b"), "u"), u="a:bc") is False and one(spark, ident.is_ancestor(F.lit("a:b"), "u"), u="a:b") is True
    assert one(spark, ident.all_segments(segs, "path"), u="path:a.b/path:c") == r"a\.b.c"
    for g, p, holds in (("src/**/x?.py", "src/a/b/x1.py", True), ("src/*.py", "src/a/b.py", False), ("src", "src/a.py", True), ("**/t.py", "file://t.py", True)):
        assert one(spark, ident.matches_glob("u", [g]), u=p) is holds


def test_statistics_and_logics(spark):
    df = spark.createDataFrame([(1, 1.0), (1, 1.0), (1, 10.0), (2, -1.0), (3, 0.0)], "k int, x double")
    r = df.filter("k = 1").agg(F.avg("x"), stats.median(F.col("x")), stats.percentile(F.col("x"), 90), stats.percentile(F.col("x"), 101)).first()
    assert (r[0], r[1], round(r[2], 9), r[3]) == (4.0, 1.0, 8.2, None)
    assert {g.k: None if g.gini is None else round(g.gini, 9) for g in stats.gini(df, ["k"], "x").collect()} == {1: 0.5, 2: None, 3: 0.0}
    t = spark.createDataFrame([(a, b) for a in (True, False, None) for b in (True, False, None)], "a boolean, b boolean")
    local = {(r.a, r.b): r.x for r in t.select("a", "b", logic.implies(F.col("a"), F.col("b")).alias("x")).collect()}
    assert local == {(a, b): b if a else True if a is False else None for a in (True, False, None) for b in (True, False, None)}
    items = spark.createDataFrame([(1, True), (1, None), (2, None), (3, False)], "o int, p boolean")
    p = F.col("p")
    got = {r.o: (r.a, r.r, r.y, r.n) for r in items.groupBy("o").agg(logic.all_defs(p).alias("a"), logic.all_refs(p).alias("r"), logic.any_of(p).alias("y"), logic.none_of(p).alias("n")).collect()}
    assert got == {1: (False, True, True, False), 2: (False, True, False, True), 3: (False, False, False, True)}


def test_rule_language(spark):
    for bad in ("name =", "lines =~ 'x'", "count(line) > 'a'", "unknown = 1", "any(order, count(line) > 1)", "name =~ 'a(?=b)'", "(lines > 1", "lines > 1 lines"):
        with pytest.raises(rules.RuleError):
            rules._Parser(bad, rules._Compiler()).whole()
    with pytest.raises(rules.RuleError):
        rules.expand("$a", {"a": "$b", "b": "$a"})
    g = Graph(spark, SF)
    some = [
        rules.Rule("r.shape", "shape:callable", rules.expand("$big => lines < 0", {"big": "(lines + 1) * 2 >= 4"}), "error"),
        rules.Rule("r.ref", "supplier", "count(in_refs, kind = 'calls') >= 0 AND all(out_refs, status = 'resolved')"),
        rules.Rule("r.apart", "order", "visibility = 'F' disjoint visibility = 'O' AND NOT has_segment(region, 'NOWHERE') AND ~ '**/order:*' AND segment('region') != ''"),
    ]
    found = rules.check(g.symbols, some, g.refs)
    assert {r.rule_id for r in found.collect()} == {"r.shape"} and rules.exit_code(found) == 1
    ids = [r.symbol_id for r in found.collect()]
    hush = spark.createDataFrame([(ids[0], None), (ids[1], "r.shape"), (ids[2], "other")], "symbol_id long, rule_id string")
    assert rules.suppress(found, hush).count() == len(ids) - 2
    assert [r.rule_id for r in rules.profile(rules.merge(some, some), ["^r"], ["ref$"])] == ["r.shape", "r.apart"]


def test_search_order_budget_and_cursors(spark):
    edges = spark.createDataFrame([(1, 1, 2), (2, 1, 3), (3, 2, 4), (4, 3, 4), (5, 4, 5), (6, 5, 1)], "reference_id long, s long, t long")
    start = spark.createDataFrame([(1,)], "node long")
    found, limits = graph.reach(edges, start, 2)
    assert {(r.node, r.depth, r.via) for r in found.collect()} == {(1, 0, None), (2, 1, 1), (3, 1, 2), (4, 2, 3)} and limits == ["depth_limit"]
    found, limits = graph.reach(edges, start, 5, max_edges=1)
    assert {r.node for r in found.collect()} == {1, 2} and limits == ["edge_limit"]
    assert {r.node for r in graph.corridor(edges, start, spark.createDataFrame([(4,)], "node long"), 2).collect()} == {1, 2, 3, 4}
    assert search.terms("parseHTTPRequest_v2") == ["parse", "http", "request", "v2"] or search.terms("parseHTTPRequest_v2")[:3] == ["parse", "http", "request"]
    assert search.resume(search.cursor(40, 3), 3) == 40
    with pytest.raises(ValueError):
        search.resume(search.cursor(40, 3), 4)
    members = spark.createDataFrame([(1, k) for k in range(5)], "owner long, member long")
    links = spark.createDataFrame([(1, 0, 7), (1, 1, 7), (1, 1, 8), (1, 2, 8), (1, 3, 9)], "owner long, member long, key long")
    assert metrics.lcom4(members, links).first().lcom4 == 3


def test_query_language(spark):
    g = Graph(spark, SF)
    for bad, code in (("symbol.serch x", "unknown_verb"), ("symbol.search knd:x", "unknown_field"), ("graph.path from:a", "missing_field"), ("symbol.search limit:9999", "invalid_value"), ("identity.children consistency:odd", "invalid_value"), ("symbol.detail uri:a uri:b", "repeated_field")):
        with pytest.raises(dsl.QueryError) as e:
            dsl.parse(bad)
        assert e.value.code == code
    assert dsl.parse('symbol.search "two words" kind:order,line').values == {"text": ["two words"], "kind": ["order", "line"]}
    assert dsl.run("query.describe", g.symbols, g.refs).count() == 23
    for text in ("workspace.status", "tree.children", "symbol.search asia kind:nation", "symbol.insights kind:order", "symbol.usages uri:region:ASIA include_descendants:true", "identity.children", "identity.graph", "metrics.coupling from:region:ASIA to:region:EUROPE", "resolution.audit", "symbol.graph focus:region:ASIA limit:5", "graph.path from:region:ASIA to:brand:Brand#11 relation:calls,located_in max_depth:3"):
        assert dsl.run(text, g.symbols, g.refs).count() > 0, text
    row = dsl.run("graph.path from:region:ASIA to:region:EUROPE relation:located_in max_depth:9", g.symbols, g.refs).first()
    assert row.verdict is False and row.complete is True


def test_files_manifests_and_sinks(spark, tmp_path):
    (tmp_path / "a/.git").mkdir(parents=True)
    (tmp_path / "a/m.py").write_text("# top\nclass A:\n    def f(self):\n        pass\n\ndef g():\n    pass\n")
    (tmp_path / "a/.git/x.py").write_text("def no(): pass\n")
    (tmp_path / "a/skip.rs").write_text("fn no() {}\n")
    (tmp_path / "a/Cargo.toml").write_text('[workspace]\nmembers = ["one"]\n')
    (tmp_path / "a/one").mkdir()
    (tmp_path / "a/one/Cargo.toml").write_text('[package]\nname = "one-pkg"\nversion = "1.2"\n[dependencies]\nserde = "1"\n')
    (tmp_path / "a/package.json").write_text(json.dumps({"name": "p", "version": "3", "devDependencies": {"x": "^1"}}))
    (tmp_path / "a/go.mod").write_text("module ex.org/m\n\nrequire (\n\tgithub.com/a/b v1.0.0\n)\n")
    (tmp_path / "a/pom.xml").write_text('<project xmlns="http://m"><groupId>g</groupId><artifactId>a</artifactId><dependencies><dependency><groupId>q</groupId><artifactId>b</artifactId></dependency></dependencies></project>')
    (tmp_path / "a/pyproject.toml").write_text('[project]\nname = "py"\ndependencies = ["num-py >=1"]\n')
    src = files.walk(spark, f"{tmp_path}/a", exclude=["**/skip.*"])
    assert [r.rel_path for r in src.collect()] == ["m.py"]
    defs = files.extract_cached(src, None)
    assert {(r.kind, r.name, r.shape) for r in defs.collect()} == {("comment", "top", "annotation"), ("class", "A", "type"), ("function", "f", "callable"), ("function", "g", "callable")}
    assert files.extract_cached(src, defs).count() == 4
    deps = {(r.manifest_kind, r.name, r.version, r.dep_kind) for r in files.manifests(spark, f"{tmp_path}/a").collect()}
    assert {("cargo", "one-pkg", "1.2", "workspace_member"), ("cargo", "serde", "1", "normal"), ("npm", "x", "^1", "dev"), ("go", "github.com/a/b", "v1.0.0", "normal"), ("maven", "q:b", None, "normal"), ("python", "num-py", ">=1", "normal")} <= deps
    grouped = files.source_groups(src, {"m.py": (2, "main"), "x": (1, "test")}).first()
    assert (grouped.source_group, grouped.srcset) == (2, "main")
    files.write_text(defs, f"{tmp_path}/out", ["kind", "name"], "text")
    assert spark.read.text(f"{tmp_path}/out").count() == 4
    empty = spark.createDataFrame([], "srcset string, uri string, language string, text string")
    own = files.replace_source_set(empty, "s", spark.createDataFrame([("u", "py", "x")], "uri string, language string, text string"))
    assert own.count() == 1 and files.remove_source_set(own, "s").count() == 0
    with pytest.raises(ValueError):
        files.replace_source_set(empty, "s", own, most_bytes=0)
    n = files.notes(spark, [("1", "m", "todo", "open", "t", "b", "me", "", ""), ("2", "z", "todo", "done", "t", "b", "me", "", "")])
    assert files.list_notes(n).count() == 1 and files.list_notes(n, include_done=True).count() == 2
    anchors = files.anchor_notes(n, spark.createDataFrame([], "uri string, anchor string"), spark.createDataFrame([("m", 5)], "identity string, symbol_id long"))
    assert {(r.note_id, r.anchor) for r in anchors.collect()} == {("1", "5"), ("2", "orphan")}


def test_incremental_equals_full_and_stream(spark, tmp_path):
    old = spark.createDataFrame([(k, k % 3, k) for k in range(30)], "id long, grp long, x long")
    changed = spark.createDataFrame([(3, 1, 100), (31, 2, 5)], "id long, grp long, x long")
    gone = spark.createDataFrame([(7,)], "id long")
    new = live.refresh(old, changed, gone, "id")
    fold = lambda df: df.groupBy("grp").agg(F.sum("x").alias("s"))
    left = old.join(changed.select("id").union(gone), "id", "left_semi")
    part = live.refold(fold(old), left, changed, "grp", fold, new)
    assert sorted(part.collect()) == sorted(fold(new).collect())
    spark.createDataFrame([("a/x.py", "w", 1), ("a/x.py", "r", 2), ("p/Cargo.toml", "w", 3)], "path string, kind string, cursor long").write.parquet(f"{tmp_path}/in")
    seen = []
    q = live.watch(spark, f"{tmp_path}/in", "path string, kind string, cursor long", lambda df, n: seen.extend(df.collect()), f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert {(r.path, r.kind, r["class"]) for r in seen} == {("a/x.py", "r", "source"), ("p/Cargo.toml", "w", "manifest")}
    assert [r.cursor for r in live.subscribe(spark.createDataFrame([(k,) for k in range(5)], "cursor long"), 2).collect()] == [3, 4]


def test_change_operators(spark):
    h = spark.createDataFrame([("f", 1, 10), ("f", 8, 20)], "k string, start int, end int")
    e = spark.createDataFrame([("f", 3, 5), ("f", 12, 13)], "k string, start int, end int")
    assert sorted((r.start, r.end) for r in changes.uncovered(h, e, "k").collect()) == [(1, 3), (5, 12), (13, 20)]
    f = spark.createDataFrame([("def a():\n  x", "a"), ("def  b(): x", "b"), ("def b(): y", "b")], "t string, n string").select(changes.fingerprint(F.col("t"), F.col("n")).alias("h"))
    a, b, c = (r.h for r in f.collect())
    assert a == b != c


def test_absence_is_only_certain_of_a_whole_search(spark):
    columns = "reference_id long, source_symbol_id long, target_id long, status string"
    nodes = lambda *ns: spark.createDataFrame([(n,) for n in ns], "node long")
    known = [(1, 1, 2, "resolved"), (2, 2, 3, "resolved"), (3, 9, 4, "resolved")]
    said = lambda rows, to, **how: graph.path(spark.createDataFrame(rows, columns), nodes(1), nodes(to), 5, **how).first()
    assert (r := said(known, 3)).hops == 2 and r.verdict is True and r.percent == 100
    assert (r := said(known, 4)).hops is None and r.verdict is False and r.complete and said(known, 4, expect="no_path").verdict is True
    open_end = [*known, (4, 3, None, "unresolved"), (5, 2, None, "external")]
    r = said(open_end, 4)
    assert r.verdict is None and not r.complete and (r.total, r.decided, r.external, r.unresolved, r.percent) == (4, 3, 1, 1, 75)
    assert said(open_end, 4, min_coverage=75).verdict is False
    assert said(open_end, 3).verdict is True
    r = said(known, 4, max_symbols=1)
    assert r.verdict is None and r.limits == "symbol_limit"
    assert said(known, 3, max_symbols=2).verdict is None and said(known, 3, max_symbols=3).verdict is True


def test_fields_without_effect_are_refused(spark):
    g = Graph(spark, SF)
    for text in ("symbol.search x include_code:true", "rules.check profile:p", "resolution.audit cluster:1", "notes delete", "metrics.coupling from:a to:b export:x", "symbol.graph x direction:up"):
        with pytest.raises(dsl.QueryError) as e:
            dsl.run(text, g.symbols, g.refs)
        assert e.value.code in ("unsupported_field", "unsupported", "invalid_value")


def test_names_match_without_parameters_in_one_language_only(spark):
    match = lambda a, b: one(spark, ident.bind_match("a", "b"), a=a, b=b)
    assert match("lang:java/class:A/method:f(x)", "lang:java/class:A/function:f") and match("lang:c/class:A", "lang:c/path:A")
    assert not match("lang:c/class:A/method:f(x)", "lang:c/class:A/method:f") and not match("lang:java/class:A/method:f", "lang:java/class:B/method:f")
    quoted = "lang:python/path:`src/a.py`"
    parts = lambda c: one(spark, c, u=quoted)
    assert parts(ident.depth("u")) == 2 and parts(ident.parent("u")) == "lang:python" and parts(ident.last_kind("u")) == "path" and parts(ident.last_name("u")) == "src/a.py"
    assert parts(ident.ancestors("u")) == ["lang:python", quoted] and parts(ident.child_of("u", "lang:python")) == "path:`src/a.py`"

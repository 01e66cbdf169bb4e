"""Joins, roll-ups, statistics, metrics and searches over the star graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.functions import identity as ident
from spanloom.functions import logic, multiset, stats
from spanloom.operators import graph, metrics
from spanloom.plans.base import Queries
from spanloom.sources.star import CUSTOMER, NATION, REGION, SUPPLIER

Q = Queries()
add = Q.add
_CHILD = "CASE WHEN starts_with({c}, 'region:ASIA/') THEN split_part(substr({c}, 13), '/', 1) END"


@add(f""", e AS (SELECT {_CHILD.format(c='s.identity')} AS s, {_CHILD.format(c='target_identity')} AS t, array_to_string(string_split(s.identity, '/')[1:2], '/') AS fs,
 array_to_string(string_split(target_identity, '/')[1:2], '/') AS ft, status = 'resolved' AS linked FROM ref JOIN sym s ON s.symbol_id = source_symbol_id),
x AS (SELECT CASE WHEN NOT linked AND s IS NOT NULL THEN 'unlinked' WHEN linked AND s <> t THEN 'edge' WHEN linked AND s IS NOT NULL AND t IS NULL THEN 'out' WHEN linked AND s IS NULL AND t IS NOT NULL THEN 'in' END AS section, * FROM e)
SELECT section, CASE WHEN section = 'in' THEN fs ELSE s END AS source, CASE section WHEN 'unlinked' THEN '' WHEN 'out' THEN ft ELSE t END AS target, count(*) AS n FROM x WHERE section IS NOT NULL GROUP BY ALL""")
def identity_graph(g):
    return graph.identity_graph(g.symbols, g.refs, "region:ASIA")


@add(f"""SELECT {_CHILD.format(c='identity')} AS segment, count(*) AS descendants, CAST(max(CASE WHEN depth = 2 THEN symbol_id END) AS VARCHAR) AS symbol_id, bool_or(depth > 2) AS has_children FROM sym WHERE starts_with(identity, 'region:ASIA/') GROUP BY 1""")
def identity_children(g):
    return graph.identity_children(g.symbols, "region:ASIA").withColumn("symbol_id", F.col("symbol_id").cast("string"))


@add(""", r AS (SELECT ref.*, s.identity AS si, s.identity = target_identity AS own FROM ref JOIN sym s ON s.symbol_id = source_symbol_id WHERE starts_with(s.identity, 'region:ASIA') AND starts_with(target_identity, 'region:EUROPE/')),
x AS (SELECT '*' AS relation, * FROM r UNION ALL SELECT kind, * FROM r)
SELECT relation, count(*) FILTER (NOT own) AS "references", count(DISTINCT CASE WHEN NOT own THEN (source_symbol_id, target_identity) END) AS connections, count(DISTINCT CASE WHEN NOT own THEN source_symbol_id END) AS sources,
 count(DISTINCT CASE WHEN NOT own THEN target_identity END) AS targets, count(*) FILTER (own) AS self_references, count(*) FILTER (status <> 'resolved') AS unlinked,
 CAST(floor(count(*) FILTER (status IN ('resolved', 'external')) * 100 / count(*)) AS BIGINT) AS coverage FROM x GROUP BY 1""")
def metrics_coupling(g):
    return graph.coupling(g.symbols, g.refs, "region:ASIA", "region:EUROPE")


_IN = "(s.identity = 'region:ASIA' OR starts_with(s.identity, 'region:ASIA/'))"
_TIN = "(target_identity = 'region:ASIA' OR starts_with(target_identity, 'region:ASIA/'))"


@add(f"""SELECT CASE WHEN {_IN} AND {_TIN} THEN 'internal' WHEN {_TIN} THEN 'caller' ELSE 'callee' END AS role, s.identity AS source_identity, target_identity, string_agg(DISTINCT ref.kind, ',' ORDER BY ref.kind) AS kinds, count(*) AS n
FROM ref JOIN sym s ON s.symbol_id = source_symbol_id WHERE status = 'resolved' AND ({_IN} OR {_TIN}) AND ref.kind IN ('calls', 'located_in') GROUP BY ALL""")
def symbol_graph(g):
    return graph.symbol_graph(g.symbols, g.refs, "region:ASIA", relations=["calls", "located_in"])


@add("""SELECT reference_id, s.identity AS source_identity FROM ref JOIN sym s ON s.symbol_id = source_symbol_id JOIN sym t ON t.symbol_id = target_id WHERE t.kind = 'supplier' AND t.name = '7'""")
def usages_incoming(g):
    identity = g.symbols.filter("kind = 'supplier' and name = '7'").select(F.col("identity").alias("target_identity"))
    return graph.ends(g.symbols, g.refs.filter("status = 'resolved'").join(identity, "target_identity", "left_semi")).select("reference_id", "source_identity")


@add(f"""SELECT target_identity, count(*) AS n FROM ref JOIN sym s ON s.symbol_id = source_symbol_id WHERE status = 'resolved' AND {_TIN} AND NOT {_IN} GROUP BY 1""")
def usages_descendants(g):
    return graph.usages(g.symbols, g.refs, "region:ASIA", descendants=True).groupBy("target_identity").agg(F.count(F.lit(1)).alias("n"))


@add(""", u AS (SELECT target_id, ref.source_id, s.parent_id, array_to_string(string_split(s.identity, '/')[1:2], '/') AS prefix FROM ref JOIN sym s ON s.symbol_id = source_symbol_id WHERE status = 'resolved' AND ref.kind = 'uses_type'),
a AS (SELECT target_id, count(*) AS uses, count(DISTINCT source_id) AS files, count(DISTINCT parent_id) AS contexts, count(DISTINCT prefix) AS prefixes FROM u GROUP BY 1),
d AS (SELECT target_id, max(n) AS dominant FROM (SELECT target_id, prefix, count(*) AS n FROM u GROUP BY 1, 2) GROUP BY 1)
SELECT symbol_id, coalesce(uses, 0) AS uses, coalesce(files, 0) AS files, coalesce(contexts, 0) AS contexts, coalesce(prefixes, 0) AS prefixes,
 CASE WHEN coalesce(uses, 0) = 0 THEN 'unused' WHEN files >= 3 AND contexts >= 3 AND prefixes >= 2 THEN 'candidate' WHEN files <= 1 OR dominant * 100 >= 80 * uses THEN 'localized' ELSE 'mixed' END AS signal
FROM sym LEFT JOIN a ON symbol_id = a.target_id LEFT JOIN d ON symbol_id = d.target_id WHERE kind = 'part'""")
def usage_summary(g):
    """A target's uses are brought together once and sorted by each column in turn: a value counts where its run starts.
    Hashed distinct counts would hold every use three times over, with all columns, on either side of the exchange. The number of partitions is kept: three sorts of partitions put together would not be small."""
    s = g.symbols.select(F.col("symbol_id").alias("source_symbol_id"), "parent_id", graph.cut(F.col("identity"), 2).alias("prefix"))
    used = g.refs.filter("status = 'resolved' and kind = 'uses_type'").select("source_symbol_id", "target_id", "source_id").join(s, "source_symbol_id").drop("source_symbol_id").repartition(int(g.spark.conf.get("spark.sql.shuffle.partitions")), "target_id")
    used = used.withColumns({f"_{c}": F.expr(f"row_number() over (partition by target_id, {c} order by {c})") for c in ("source_id", "parent_id", "prefix")})
    values = lambda c: F.count_if((F.col(f"_{c}") == 1) & F.col(c).isNotNull())
    a = used.groupBy("target_id").agg(F.count(F.lit(1)).alias("uses"), values("source_id").alias("files"), values("parent_id").alias("contexts"), values("prefix").alias("prefixes"), F.max("_prefix").cast("long").alias("dominant"))
    rows = g.symbols.filter("kind = 'part'").select(F.col("symbol_id"), F.col("symbol_id").alias("target_id")).join(a, "target_id", "left").na.fill(0)
    signal = graph.shared_signal(F.col("files"), F.col("contexts"), F.col("prefixes"), F.col("uses"), F.col("dominant"))
    return rows.select("symbol_id", "uses", "files", "contexts", "prefixes", signal.alias("signal"))


@add("""SELECT array_to_string(string_split(path, '/')[1:d], '/') AS folder, d AS depth, count(*) AS defs, count(DISTINCT path) AS files FROM sym, (SELECT unnest([1, 2, 3]) AS d) WHERE len(string_split(path, '/')) >= d GROUP BY ALL""")
def tree_children(g):
    parts = F.split("path", "/")
    rows = g.symbols.select("path", F.explode(F.sequence(F.lit(1), F.least(F.lit(3), F.size(parts)))).alias("depth"))
    return rows.groupBy(F.expr("substring_index(path, '/', depth)").alias("folder"), "depth").agg(F.count(F.lit(1)).alias("defs"), F.count_distinct("path").alias("files"))


@add("""SELECT 'kind' AS facet, kind AS value, count(*) AS n FROM sym GROUP BY ALL UNION ALL SELECT 'shape', shape, count(*) FROM sym GROUP BY ALL UNION ALL SELECT 'visibility', visibility, count(*) FROM sym GROUP BY ALL
UNION ALL SELECT 'reference', kind, count(*) FROM ref GROUP BY ALL""")
def stats_report(g):
    """Four histograms in one pass over the symbols and one over the references."""
    facets = F.explode(F.array(*[F.struct(F.lit(c).alias("facet"), F.col(c).alias("value")) for c in ("kind", "shape", "visibility")])).alias("x")
    rows = g.symbols.select(facets).select("x.*").unionByName(g.refs.select(F.lit("reference").alias("facet"), F.col("kind").alias("value")))
    return rows.groupBy("facet", "value").agg(F.count(F.lit(1)).alias("n"))


@add("""SELECT path, count(*) AS defs, (SELECT count(*) FROM sym) AS total FROM sym GROUP BY 1 ORDER BY defs DESC, path LIMIT 20""")
def symbol_insights(g):
    top = g.symbols.groupBy("path").agg(F.count(F.lit(1)).alias("defs"))
    total = top.agg(F.sum("defs").alias("total"))
    return top.orderBy(F.desc("defs"), "path").limit(20).crossJoin(F.broadcast(total))


@add("""SELECT reference_id, s.kind AS source_kind, s.identity AS source_identity FROM ref JOIN sym s ON s.symbol_id = source_symbol_id WHERE ref.kind = 'calls'""")
def join_source_def(g):
    s = g.symbols.select(F.col("symbol_id").alias("source_symbol_id"), F.col("kind").alias("source_kind"), F.col("identity").alias("source_identity"))
    return g.refs.filter("kind = 'calls'").join(s, "source_symbol_id").select("reference_id", "source_kind", "source_identity")


@add("""SELECT reference_id, t.symbol_id FROM ref JOIN sym t ON t.identity = target_identity AND t.source_id = ref.source_id""")
def join_local_target(g):
    t = g.symbols.select("symbol_id", "source_id", F.col("identity").alias("target_identity"))
    return g.refs.join(t, ["source_id", "target_identity"]).select("reference_id", "symbol_id")


@add("""SELECT p.symbol_id, count(c.symbol_id) AS children FROM sym p LEFT JOIN sym c ON c.parent_id = p.symbol_id WHERE p.kind <> 'line' GROUP BY 1""")
def parent_children(g):
    n = g.symbols.groupBy(F.col("parent_id").alias("symbol_id")).agg(F.count(F.lit(1)).alias("n"))
    return g.symbols.filter("kind <> 'line'").select("symbol_id").join(n, "symbol_id", "left").select("symbol_id", F.coalesce("n", F.lit(0)).alias("children"))


@add(""", x AS (SELECT unnest([array_to_string(string_split(identity, '/')[1:d], '/') FOR d IN range(1, depth)]) AS prefix FROM sym) SELECT prefix AS identity, count(*) AS descendants FROM x GROUP BY 1""")
def descendant_counts(g):
    return g.symbols.select(F.explode(F.slice(ident.ancestors("identity"), 1, F.col("depth") - 1)).alias("identity")).groupBy("identity").agg(F.count(F.lit(1)).alias("descendants"))


@add("""SELECT status, reason, count(*) AS n FROM ref WHERE status <> 'resolved' GROUP BY ALL""")
def unlinked_by_reason(g):
    return g.refs.filter("status <> 'resolved'").groupBy("status", "reason").agg(F.count(F.lit(1)).alias("n"))


@add("""SELECT c.symbol_id, CASE WHEN c.navigable THEN c.symbol_id ELSE c.parent_id END AS anchor_id FROM sym c""")
def navigable_anchor(g):
    """The symbol itself or its nearest navigable ancestor; here no two levels in a row are without navigation."""
    up = g.symbols.filter("navigable").select(F.col("symbol_id").alias("up_id"))
    rows = g.symbols.select("symbol_id", "parent_id", "navigable")
    return rows.join(up, F.col("parent_id") == F.col("up_id"), "left").select("symbol_id", F.when(F.col("navigable"), F.col("symbol_id")).otherwise(F.col("up_id")).alias("anchor_id"))


@add("""SELECT a.symbol_id AS a, b.symbol_id AS b FROM sym a JOIN sym b ON a.parent_id = b.parent_id AND a.symbol_id < b.symbol_id WHERE a.kind = 'supplier' AND b.kind = 'supplier'""")
def self_pairs(g):
    rows = g.symbols.filter("kind = 'supplier'").select("parent_id", "symbol_id")
    return rows.select("parent_id", F.col("symbol_id").alias("a")).join(rows.select("parent_id", F.col("symbol_id").alias("b")), "parent_id").filter("a < b").select("a", "b")


_ORDERS = "SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority FROM orders"


@add(""", r AS (SELECT o_custkey, o_totalprice AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice) AS i, count(*) OVER (PARTITION BY o_custkey) AS n, sum(o_totalprice) OVER (PARTITION BY o_custkey) AS s FROM orders)
SELECT o_custkey, round(CASE WHEN min(x) < 0 THEN NULL WHEN max(s) = 0 THEN 0 ELSE 2 * sum(i * x) / (max(n) * max(s)) - (max(n) + 1) / max(n) END, 6) AS gini FROM r GROUP BY 1""")
def stats_gini(g):
    return stats.gini(g.table("orders"), ["o_custkey"], "o_totalprice").withColumn("gini", F.round("gini", 6))


@add(""", c AS (SELECT o_custkey, o_orderpriority, count(*) AS c FROM orders GROUP BY ALL), n AS (SELECT o_custkey, sum(c) AS n, count(*) AS k FROM c GROUP BY 1)
SELECT o_custkey, round(CASE WHEN max(k) <= 1 THEN 0 ELSE -sum((c / n) * log2(c / n)) / log2(max(k)) END, 6) AS entropy FROM c JOIN n USING (o_custkey) GROUP BY 1""")
def stats_entropy(g):
    return stats.entropy(g.table("orders"), ["o_custkey"], "o_orderpriority").withColumn("entropy", F.round("entropy", 6))


@add(""", c AS (SELECT o_custkey, o_orderpriority, count(*) AS c, min(o_orderkey) AS f FROM orders GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY c DESC, f) AS k FROM c) SELECT o_custkey, o_orderpriority AS mode FROM r WHERE k = 1""")
def stats_mode(g):
    return stats.mode(g.table("orders"), ["o_custkey"], "o_orderpriority", "o_orderkey")


@add("""SELECT p_brand, round(quantile_cont(p_retailprice, 0.9), 6) AS p90, round(median(p_retailprice), 6) AS median, round(var_pop(p_size), 6) AS variance, round(stddev_pop(p_size), 6) AS stddev,
 round(stddev_pop(p_retailprice) / abs(avg(p_retailprice)), 6) AS cv, CAST(sum(p_size) AS BIGINT) AS total, round(avg(p_size), 6) AS mean FROM part GROUP BY 1""")
def stats_spread(g):
    x, s = F.col("p_retailprice"), F.col("p_size")
    agg = [stats.percentile(x, 90).alias("p90"), stats.median(x).alias("median"), stats.variance(s).alias("variance"), F.stddev_pop(s).alias("stddev"), stats.cv(x).alias("cv")]
    out = g.table("part").groupBy("p_brand").agg(*agg, stats.total(s).alias("total"), F.avg(s).alias("mean"))
    return out.withColumns({c: F.round(c, 6) for c in ("p90", "median", "variance", "stddev", "cv", "mean")})


@add("""SELECT source_symbol_id % 100 AS bucket, count(*) AS total, count(*) FILTER (status IN ('resolved', 'external')) AS decided, CAST(floor(count(*) FILTER (status IN ('resolved', 'external')) * 100 / count(*)) AS BIGINT) AS coverage FROM ref GROUP BY 1""")
def coverage(g):
    decided = F.count_if(F.col("status").isin("resolved", "external"))
    rows = g.refs.groupBy((F.col("source_symbol_id") % 100).alias("bucket")).agg(F.count(F.lit(1)).alias("total"), decided.alias("decided"))
    return rows.withColumn("coverage", stats.floor_percent(F.col("decided"), F.col("total")))


@add("""SELECT visibility, srcset, count(*) AS members, CAST(CASE WHEN count(start_line) = count(*) THEN max(end_line - start_line + 1) END AS VARCHAR) AS longest, CASE WHEN count(start_line) = count(*) AND max(end_line - start_line + 1) <= 60 THEN true ELSE false END AS ok
FROM sym WHERE kind IN ('order', 'line') GROUP BY ALL""")
def group_rule(g):
    """Members by visibility and srcset; a member without lines makes the group's statistic unavailable, which fails."""
    lines = F.col("end_line") - F.col("start_line") + 1
    rows = g.symbols.filter("kind in ('order', 'line')").groupBy("visibility", "srcset").agg(F.count(F.lit(1)).alias("members"), stats.whole(F.max(lines), lines).alias("longest"))
    return rows.withColumn("ok", logic.closed(F.col("longest") <= 60)).withColumn("longest", F.col("longest").cast("string"))


@add(""", r AS (SELECT srcset, identity, row_number() OVER (PARTITION BY srcset ORDER BY identity) AS k, count(*) OVER (PARTITION BY srcset) AS members FROM sym WHERE kind = 'customer')
SELECT srcset, max(members) AS members, min(identity) AS first, string_agg(identity, ',' ORDER BY identity) AS sample FROM r WHERE k <= 5 GROUP BY 1""")
def group_diagnostics(g):
    """Five members of each group; min_by five times over would sort too, a ranked limit per group keeps five a task."""
    w = F.expr("row_number() over (partition by srcset order by identity)")
    rows = g.symbols.filter("kind = 'customer'").select("srcset", "identity")
    top = rows.withColumn("k", w).filter("k <= 5").groupBy("srcset").agg(F.min("identity").alias("first"), F.array_join(F.sort_array(F.collect_list("identity")), ",").alias("sample"))
    return rows.groupBy("srcset").agg(F.count(F.lit(1)).alias("members")).join(top, "srcset")


@add("""SELECT symbol_id, (SELECT 1) * coalesce(n, 0) AS fan_out FROM sym LEFT JOIN (SELECT source_symbol_id, count(*) AS n FROM ref GROUP BY 1) ON source_symbol_id = symbol_id""")
def metric_fan_out(g):
    return metrics.fan_out(g.symbols, g.refs)


@add("""SELECT symbol_id, coalesce(n, 0) AS fan_in FROM sym LEFT JOIN (SELECT target_identity, count(*) AS n FROM ref GROUP BY 1) ON target_identity = identity""")
def metric_fan_in(g):
    return metrics.fan_in(g.symbols, g.refs)


@add("""SELECT p.symbol_id, count(c.symbol_id) AS wmc FROM sym p LEFT JOIN sym c ON c.parent_id = p.symbol_id AND c.shape = 'callable' WHERE p.shape IN ('type', 'namespace') GROUP BY 1""")
def metric_wmc(g):
    return metrics.wmc(g.symbols)


@add(""", own AS (SELECT parent_id, symbol_id, identity FROM sym WHERE shape = 'callable') SELECT parent_id AS symbol_id, count(DISTINCT x) AS rfc FROM (SELECT parent_id, identity AS x FROM own UNION ALL SELECT parent_id, target_identity FROM own JOIN ref ON source_symbol_id = symbol_id AND kind = 'references') GROUP BY 1""")
def metric_rfc(g):
    return metrics.rfc(g.symbols, g.refs, ["references"])


@add(""", b AS (SELECT s.identity AS si, target_identity AS ti FROM ref JOIN sym s ON s.symbol_id = source_symbol_id), e AS (SELECT si AS i, ti AS o FROM b UNION ALL SELECT ti, si FROM b),
x AS (SELECT array_to_string(string_split(i, '/')[1:2], '/') AS own, o FROM e), y AS (SELECT own, count(DISTINCT array_to_string(string_split(o, '/')[1:2], '/')) AS n FROM x WHERE NOT (o = own OR starts_with(o, own || '/')) GROUP BY 1)
SELECT symbol_id, coalesce(n, 0) AS cbo FROM sym LEFT JOIN y ON own = identity WHERE kind = 'nation'""")
def metric_cbo(g):
    return metrics.cbo(g.symbols, g.refs, "nation", 2)


@add("""SELECT target_id AS symbol_id, count(DISTINCT source_symbol_id) AS noc FROM ref WHERE kind = 'located_in' AND target_id IS NOT NULL GROUP BY 1""")
def metric_noc(g):
    return metrics.inheritors(g.refs, ["located_in"])


@add("""SELECT symbol_id, CASE kind WHEN 'nation' THEN 1 WHEN 'customer' THEN 2 WHEN 'supplier' THEN 2 ELSE 0 END AS dit FROM sym""")
def metric_dit(g):
    return metrics.depth_of_inheritance(g.symbols, g.refs, ["located_in"])


@add(""", e AS (SELECT p_partkey AS s, p_partkey + CASE WHEN p_partkey % 20 = 0 THEN -4 ELSE 1 END AS t FROM part), c(s, x, way, n) AS (
 SELECT p_partkey, p_partkey, [p_partkey], 0 FROM part UNION ALL SELECT c.s, CASE WHEN list_contains(way, t) THEN NULL ELSE t END, list_append(way, t), n + 1 FROM c JOIN e ON e.s = c.x) SELECT s AS symbol_id, max(n) AS dit FROM c GROUP BY 1""".replace(", e AS", "WITH RECURSIVE e AS", 1), graph=False)
def metric_dit_chains(g):
    """Chains of twenty parts that end in a cycle of five."""
    p = g.table("part").select(F.col("p_partkey").alias("symbol_id"))
    to = F.col("symbol_id") + F.when(F.col("symbol_id") % 20 == 0, -4).otherwise(1)
    refs = p.select(F.col("symbol_id").alias("source_symbol_id"), to.alias("target_id"), F.lit("extends").alias("kind"))
    return metrics.depth_of_inheritance(p, refs, ["extends"])


@add(""", m AS (SELECT DISTINCT parent_id AS owner, l_partkey AS p, l_suppkey AS s FROM lin JOIN sym ON symbol_id = line_id), links AS (SELECT owner, p AS a, s AS k FROM m),
walk AS (SELECT owner, a, a AS r FROM links UNION SELECT w.owner, l2.a, w.r FROM walk w JOIN links l1 ON l1.owner = w.owner AND l1.a = w.a JOIN links l2 ON l2.owner = l1.owner AND l2.k = l1.k)
SELECT owner, count(DISTINCT r) AS lcom4 FROM (SELECT owner, a, min(r) AS r FROM walk GROUP BY ALL) GROUP BY 1""")
def metric_lcom4(g):
    """Parts of an order hang together where they come from one supplier."""
    lines = g.table("lineitem").select((F.lit(7 << 44) + F.col("l_orderkey")).alias("owner"), F.col("l_partkey").alias("member"), F.col("l_suppkey").alias("key")).distinct()
    return metrics.lcom4(lines.select("owner", "member").distinct(), lines)


@add(""", d AS (SELECT parent_id AS owner, CASE WHEN start_line IS NULL THEN NULL ELSE end_line - start_line > 20 END AS p FROM sym WHERE kind = 'line')
SELECT owner, count(*) FILTER (p) AS n_pass, coalesce(bool_or(coalesce(p, false)), false) AS any_pass, count(*) FILTER (p) = count(*) AS all_defs, count(*) FILTER (NOT p) = 0 AS all_refs, NOT coalesce(bool_or(coalesce(p, false)), false) AS none_pass FROM d GROUP BY 1""")
def quantifiers(g):
    p = F.when(F.col("start_line").isNotNull(), F.col("end_line") - F.col("start_line") > 20)
    rows = g.symbols.filter("kind = 'line'").select(F.col("parent_id").alias("owner"), p.alias("p"))
    x = F.col("p")
    return rows.groupBy("owner").agg(stats.count_pass(x).alias("n_pass"), logic.any_of(x).alias("any_pass"), logic.all_defs(x).alias("all_defs"), logic.all_refs(x).alias("all_refs"), logic.none_of(x).alias("none_pass"))


@add(""", t AS (SELECT o_orderkey, o_totalprice > 100000 AS a, CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderstatus = 'F' END AS b, o_orderkey % 3 = 0 AS c FROM orders)
SELECT o_orderkey, CASE WHEN b THEN a WHEN NOT b THEN true END AS local_implies, NOT b OR a AS kleene_implies, (NOT (a AND b)) AND (NOT (a AND c)) AND (NOT (b AND c)) AS disjoint_all, (CASE WHEN b THEN a WHEN NOT b THEN true END) IS NOT DISTINCT FROM false AS violated, coalesce(a AND b, false) AS closed FROM t""")
def three_logics(g):
    t = g.table("orders").select("o_orderkey", (F.col("o_totalprice") > 100000).alias("a"), F.when(F.col("o_orderstatus") != "P", F.col("o_orderstatus") == "F").alias("b"), (F.col("o_orderkey") % 3 == 0).alias("c"))
    a, b, c = F.col("a"), F.col("b"), F.col("c")
    return t.select(
        "o_orderkey", logic.implies(b, a).alias("local_implies"), logic.implies_kleene(b, a).alias("kleene_implies"), logic.disjoint(a, b, c).alias("disjoint_all"),
        logic.fails(logic.implies(b, a)).alias("violated"), logic.closed(a & b).alias("closed"),
    )


_L = "SELECT l_orderkey AS owner, l_suppkey AS value, count(*) AS n FROM lineitem WHERE l_returnflag = 'R' GROUP BY ALL"
_R = "SELECT l_orderkey AS owner, l_suppkey AS value, count(*) AS n FROM lineitem WHERE l_linestatus = 'O' GROUP BY ALL"


def _sides(g):
    return multiset.sides(g.table("lineitem"), "l_orderkey", "l_suppkey", F.col("l_returnflag") == "R", F.col("l_linestatus") == "O")


@add(f""", l AS ({_L}), r AS ({_R}), b AS (SELECT owner, value, coalesce(l.n, 0) AS l, coalesce(r.n, 0) AS r FROM l FULL JOIN r USING (owner, value))
SELECT 'intersect' AS op, owner, value, least(l, r) AS n FROM b WHERE least(l, r) > 0 UNION ALL SELECT 'union', owner, value, greatest(l, r) FROM b UNION ALL SELECT 'diff', owner, value, l - r FROM b WHERE l > r""")
def multiset_algebra(g):
    """All three from the same counts, which are made once."""
    l, r = F.col("l"), F.col("r")
    row = lambda op, n: F.struct(F.lit(op).alias("op"), n.alias("n"))
    ops = F.array_compact(F.array(F.when(F.least(l, r) > 0, row("intersect", F.least(l, r))), row("union", F.greatest(l, r)), F.when(l > r, row("diff", l - r))))
    return _sides(g).select("owner", "value", F.explode(ops).alias("x")).select("x.op", "owner", "value", "x.n")


@add(f""", l AS ({_L}), r AS ({_R}), b AS (SELECT owner, value, coalesce(l.n, 0) AS l, coalesce(r.n, 0) AS r FROM l FULL JOIN r USING (owner, value)) SELECT owner, bool_and(l <= r) AS subset, CAST(sum(l) AS BIGINT) AS size FROM b GROUP BY 1""")
def multiset_subset(g):
    return _sides(g).groupBy("owner").agg(F.bool_and(F.col("l") <= F.col("r")).alias("subset"), F.sum("l").alias("size"))


_EDGES = "edges AS (SELECT source_symbol_id AS s, target_id AS t FROM ref WHERE kind IN ('calls', 'located_in') AND target_id IS NOT NULL)"


def _edges(g):
    return g.refs.filter("kind in ('calls', 'located_in')").select("reference_id", F.col("source_symbol_id").alias("s"), F.col("target_id").alias("t"))


@add(f""", {_EDGES}, walk(node, depth) AS (SELECT symbol_id, 0 FROM sym WHERE kind = 'line' UNION SELECT t, depth + 1 FROM walk JOIN edges ON s = node WHERE depth < 3)
SELECT node, min(depth) AS depth FROM walk GROUP BY 1""")
def path_shortest(g):
    found, _ = graph.reach(_edges(g), g.symbols.filter("kind = 'line'").select(F.col("symbol_id").alias("node")), 3)
    return found.select("node", "depth")


@add(f""", {_EDGES}, walk(node, depth) AS (SELECT symbol_id, 0 FROM sym WHERE kind = 'supplier' UNION SELECT t, depth + 1 FROM walk JOIN edges ON s = node WHERE depth < 3)
SELECT identity, bool_or(node IS NOT NULL) AS reachable, bool_or(node IS NULL) AS no_path FROM sym LEFT JOIN walk ON node = symbol_id WHERE kind IN ('region', 'brand') GROUP BY 1""")
def path_verdict(g):
    found, limits = graph.reach(_edges(g), g.symbols.filter("kind = 'supplier'").select(F.col("symbol_id").alias("node")), 3)
    complete = F.lit(not limits)
    rows = g.symbols.filter("kind in ('region', 'brand')").join(found, F.col("symbol_id") == F.col("node"), "left")
    hit = F.col("node").isNotNull()
    return rows.select("identity", graph.verdict(hit, complete).alias("reachable"), graph.verdict(hit, complete, "no_path").alias("no_path"))


@add(f""", {_EDGES}, fw(node, depth) AS (SELECT symbol_id, 0 FROM sym WHERE kind = 'line' UNION SELECT t, depth + 1 FROM fw JOIN edges ON s = node WHERE depth < 3),
bw(node, depth) AS (SELECT symbol_id, 0 FROM sym WHERE identity = 'region:ASIA' UNION SELECT s, depth + 1 FROM bw JOIN edges ON t = node WHERE depth < 3),
f AS (SELECT node, min(depth) AS forward FROM fw GROUP BY 1), b AS (SELECT node, min(depth) AS backward FROM bw GROUP BY 1) SELECT node, forward, backward FROM f JOIN b USING (node) WHERE forward + backward <= 3""")
def corridor(g):
    s = g.symbols
    return graph.corridor(_edges(g), s.filter("kind = 'line'").select(F.col("symbol_id").alias("node")), s.filter("identity = 'region:ASIA'").select(F.col("symbol_id").alias("node")), 3)


@add(f""", {_EDGES}, cut AS (SELECT * FROM edges WHERE t NOT IN (SELECT symbol_id FROM sym WHERE kind = 'supplier')), walk(node, depth) AS (SELECT symbol_id, 0 FROM sym WHERE kind = 'line' UNION SELECT t, depth + 1 FROM walk JOIN cut ON s = node WHERE depth < 4)
SELECT identity, symbol_id NOT IN (SELECT node FROM walk) AS all_paths_via_supplier FROM sym WHERE kind = 'region'""")
def all_paths_via(g):
    s = g.symbols
    found, _ = graph.reach(_edges(g), s.filter("kind = 'line'").select(F.col("symbol_id").alias("node")), 4, avoid=s.filter("kind = 'supplier'").select(F.col("symbol_id").alias("node")))
    return s.filter("kind = 'region'").join(found, F.col("symbol_id") == F.col("node"), "left").select("identity", F.col("node").isNull().alias("all_paths_via_supplier"))

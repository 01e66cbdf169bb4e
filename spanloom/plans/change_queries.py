"""Resolution, audit, change and assertion queries over the star graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import changes, linkage
from spanloom.plans import rules
from spanloom.plans.base import Queries
from spanloom.streaming import live

Q = Queries()
add = Q.add


@add(""", exact AS (SELECT reference_id, symbol_id AS target_id, 0 AS tier, 'exact' AS evidence FROM ref JOIN sym ON identity = target_identity AND sym.kind <> 'part'),
names AS (SELECT reference_id, symbol_id, 1, 'name_match' FROM ref JOIN sym ON sym.kind = 'part' AND name = split_part(target_identity, ':', 3) WHERE ref.kind = 'uses_type'),
a AS (SELECT * FROM exact UNION ALL SELECT * FROM names), b AS (SELECT reference_id, min(tier) AS tier FROM a GROUP BY 1),
f AS (SELECT a.reference_id, evidence, count(DISTINCT target_id) AS n, min(target_id) AS least FROM a JOIN b ON a.reference_id = b.reference_id AND a.tier = b.tier GROUP BY ALL)
SELECT ref.reference_id, CASE WHEN n IS NULL THEN 'unresolved' WHEN f.evidence = 'name_match' OR n > 1 THEN 'candidate' ELSE 'resolved' END AS decision, f.evidence, coalesce(n, 0) AS targets FROM ref LEFT JOIN f USING (reference_id)""")
def linkage_cascade(g):
    """By the exact identity first; what that leaves, by name within the kind."""
    s = g.symbols
    exact = g.refs.join(s.filter("kind <> 'part'").select(F.col("symbol_id").alias("t"), F.col("identity").alias("target_identity")), "target_identity").select("reference_id", F.col("t").alias("target_id"))
    named = s.filter("kind = 'part'").select(F.col("symbol_id").alias("t"), F.col("name").alias("key"))
    by_name = g.refs.filter("kind = 'uses_type'").withColumn("key", F.element_at(F.split("target_identity", ":"), 3)).join(named, "key").select("reference_id", F.col("t").alias("target_id"))
    out = linkage.cascade(g.refs, [("exact", exact), ("name_match", by_name)])
    return out.select("reference_id", linkage.decide(F.col("n"), F.col("evidence")).alias("decision"), "evidence", F.coalesce("n", F.lit(0)).alias("targets"))


@add("""SELECT a.s_suppkey AS ref, b.s_suppkey AS candidate FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey WHERE (b.s_acctbal > 5000) = (SELECT bool_or(c.s_acctbal > 5000) FROM supplier c WHERE c.s_nationkey = a.s_nationkey)""", graph=False)
def concrete_over_alias(g):
    """Suppliers of a nation stand for candidates; those with a high balance are concrete and push the others out.

    All suppliers of a nation have the same candidates, so these are chosen a nation, before they are paired, and no
    window over the pairs is needed. Pairs are as many as the result's rows; a nation's are made in parts, in as many
    tasks as there are partitions: by the size of the few rows that are paired, one task would make them all."""
    s = g.table("supplier").select("s_suppkey", "s_nationkey", "s_acctbal")
    chosen = linkage.prefer_once(s, "s_nationkey", F.col("s_acctbal") > 5000).select(F.col("s_suppkey").alias("candidate"), "s_nationkey", F.explode(F.expr("sequence(0, 31)")).alias("part"))
    rows = s.select(F.col("s_suppkey").alias("ref"), "s_nationkey", F.pmod(F.hash("s_suppkey"), F.lit(32)).alias("part"))
    tasks = int(g.spark.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, "s_nationkey", "part").join(chosen.hint("merge"), ["s_nationkey", "part"]).select("ref", "candidate")


@add("""SELECT l_orderkey, bool_or(p = 'allowed') AS any_allowed, bool_or(p = 'blocked') AS any_blocked, bool_or(p = 'unknown') AS any_unknown,
 CASE WHEN bool_or(p = 'allowed') THEN 'keep_allowed' WHEN bool_or(p = 'blocked') AND NOT bool_or(p = 'unknown') THEN 'blocked' ELSE 'fall_through' END AS outcome FROM (SELECT l_orderkey, CASE l_returnflag WHEN 'A' THEN 'allowed' WHEN 'R' THEN 'blocked' ELSE 'unknown' END AS p FROM lineitem) GROUP BY 1""", graph=False)
def manifest_authorization(g):
    p = F.when(F.col("l_returnflag") == "A", "allowed").when(F.col("l_returnflag") == "R", "blocked").otherwise("unknown")
    return g.table("lineitem").groupBy("l_orderkey").agg(*linkage.by_manifest(p)).withColumn("outcome", linkage.manifest_outcome())


@add("""SELECT c_custkey, CASE WHEN a IS NULL AND b IS NULL THEN 'defer' WHEN a IS NOT DISTINCT FROM b THEN 'allowed' ELSE 'blocked' END AS permission FROM (SELECT c_custkey, CASE WHEN c_nationkey % 3 > 0 THEN c_nationkey % 3 END AS a, CASE WHEN c_custkey % 3 > 0 THEN c_custkey % 3 END AS b FROM customer)""", graph=False)
def group_authorization(g):
    a, b = (F.when(F.col(c) % 3 > 0, F.col(c) % 3) for c in ("c_nationkey", "c_custkey"))
    return g.table("customer").select("c_custkey", linkage.authorise(a, b).alias("permission"))


@add("""SELECT ref.kind, status, evidence, reason, s.kind AS source_kind, count(*) AS n, min(reference_id) AS first_reference, count(DISTINCT ref.source_id) AS files FROM ref JOIN sym s ON s.symbol_id = source_symbol_id GROUP BY ALL""")
def resolution_audit(g):
    s = g.symbols.select(F.col("symbol_id").alias("source_symbol_id"), F.col("kind").alias("source_kind"))
    return linkage.audit(g.refs.join(s, "source_symbol_id"), ["kind", "status", "evidence", "reason", "source_kind"])


@add("""SELECT CASE WHEN status = 'resolved' AND t.symbol_id IS NULL THEN 'unresolved' WHEN status = 'resolved' THEN 'unique' ELSE status END AS part, count(*) AS n FROM ref LEFT JOIN (SELECT symbol_id FROM sym WHERE kind <> 'supplier' OR name <> '7') t ON t.symbol_id = target_id GROUP BY 1""")
def audit_partition(g):
    """With one supplier taken away: bindings to it dangle."""
    t = g.symbols.filter("kind <> 'supplier' or name <> '7'").select("symbol_id")
    rows = g.refs.join(t, F.col("target_id") == F.col("symbol_id"), "left")
    return rows.groupBy(linkage.partition_of(F.col("status"), F.col("symbol_id").isNotNull()).alias("part")).agg(F.count(F.lit(1)).alias("n"))


@add(""", d AS (SELECT target_id AS symbol_id, count(*) AS decided FROM ref WHERE status = 'resolved' GROUP BY 1), u AS (SELECT candidate_id AS symbol_id, count(*) AS n FROM ref WHERE status IN ('candidate', 'dynamic') GROUP BY 1), x AS (SELECT target_identity AS identity, count(*) AS n FROM ref WHERE status = 'unresolved' GROUP BY 1),
r AS (SELECT symbol_id, coalesce(decided, 0) AS decided, coalesce(u.n, 0) + coalesce(x.n, 0) AS uncertain FROM sym LEFT JOIN d USING (symbol_id) LEFT JOIN u USING (symbol_id) LEFT JOIN x USING (identity) WHERE kind IN ('part', 'supplier'))
SELECT symbol_id, decided, uncertain, CAST(CASE WHEN decided + uncertain = 0 THEN 100 ELSE floor(decided * 100 / (decided + uncertain)) END AS BIGINT) AS coverage, CASE WHEN decided + uncertain = 0 THEN 100 ELSE floor(decided * 100 / (decided + uncertain)) END >= 80 AS known FROM r""")
def incoming_count_rule(g):
    return linkage.incoming_counts(g.symbols.filter("kind in ('part', 'supplier')"), g.refs, 80)


_OLD = "SELECT c_custkey AS id, 'n' || c_nationkey || '/c' || c_custkey AS tail, c_name AS name, CAST(round(c_acctbal * 100) AS BIGINT) AS body, c_mktsegment AS attribute FROM customer WHERE c_custkey % 17 <> 0"
_NEW = "SELECT c_custkey AS id, CASE WHEN c_custkey % 7 = 0 THEN 'n' || ((c_nationkey + 1) % 25) ELSE 'n' || c_nationkey END || '/c' || CASE WHEN c_custkey % 11 = 0 THEN 'x' ELSE '' END || c_custkey AS tail, CASE WHEN c_custkey % 11 = 0 THEN 'renamed' || c_custkey ELSE c_name END AS name, CAST(round(c_acctbal * 100) AS BIGINT) + CASE WHEN c_custkey % 5 = 0 THEN 1 ELSE 0 END AS body, CASE WHEN c_custkey % 9 = 0 THEN 'OTHER' ELSE c_mktsegment END AS attribute FROM customer WHERE c_custkey % 13 <> 0"


def _snapshots(g):
    """Two generations of the customers: some moved, renamed, edited, added and removed."""
    c = g.table("customer")
    c.createOrReplaceTempView("spanloom_customer")
    return (g.spark.sql(x.replace("FROM customer", "FROM spanloom_customer")) for x in (_OLD, _NEW))


@add(f""", o AS ({_OLD}), n AS ({_NEW}) SELECT tail, CASE WHEN o.id IS NULL THEN 'added' WHEN n.id IS NULL THEN 'removed' WHEN o.body <> n.body THEN 'body_modified' WHEN o.name <> n.name THEN 'signature_changed' WHEN o.attribute <> n.attribute THEN 'attribute_changed' ELSE 'unchanged' END AS change FROM o FULL JOIN n USING (tail)""")
def change_review(g):
    old, new = _snapshots(g)
    both = changes.pair_exact(old, new, "tail")
    same = lambda c: F.col(f"old_{c}") != F.col(f"new_{c}")
    kind = F.when(F.col("old_id").isNull(), "added").when(F.col("new_id").isNull(), "removed").otherwise(changes.classify(F.lit(False), same("body"), same("name"), same("attribute")))
    return both.select("tail", kind.alias("change"))


@add(f""", o AS ({_OLD}), n AS ({_NEW}), uo AS (SELECT * FROM o WHERE tail NOT IN (SELECT tail FROM n)), un AS (SELECT * FROM n WHERE tail NOT IN (SELECT tail FROM o)),
ko AS (SELECT body, min(id) AS old_id FROM uo GROUP BY 1 HAVING count(*) = 1), kn AS (SELECT body, min(id) AS new_id FROM un GROUP BY 1 HAVING count(*) = 1) SELECT body, old_id, new_id FROM ko JOIN kn USING (body)""")
def unique_key_pairing(g):
    """What exact pairing left, by an equal body that exactly one row of either side has: renames and moves."""
    old, new = _snapshots(g)
    return changes.pair_unique(old.join(new.select("tail"), "tail", "left_anti"), new.join(old.select("tail"), "tail", "left_anti"), ["body"])


@add(""", o AS (SELECT l_suppkey, l_partkey % 50 AS k, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 50 ORDER BY l_orderkey, l_linenumber, l_partkey) AS n FROM lineitem WHERE l_returnflag = 'R'), w AS (SELECT l_suppkey, l_partkey % 50 AS k, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 50 ORDER BY l_orderkey) AS n FROM lineitem WHERE l_returnflag = 'A')
SELECT 'old' AS side, l_suppkey, k, count(*) AS n FROM (SELECT l_suppkey, k, n FROM o EXCEPT SELECT l_suppkey, k, n FROM w) GROUP BY ALL UNION ALL SELECT 'new', l_suppkey, k, count(*) FROM (SELECT l_suppkey, k, n FROM w EXCEPT SELECT l_suppkey, k, n FROM o) GROUP BY ALL""", graph=False)
def multiset_cancel(g):
    l = g.table("lineitem").select("l_suppkey", (F.col("l_partkey") % 50).alias("k"), "l_orderkey", "l_returnflag")
    old, new = changes.cancel(l.filter("l_returnflag = 'R'"), l.filter("l_returnflag = 'A'"), ["l_suppkey", "k"], "l_orderkey")
    tag = lambda side, df: df.groupBy("l_suppkey", "k").agg(F.count(F.lit(1)).alias("n")).select(F.lit(side).alias("side"), "l_suppkey", "k", "n")
    return tag("old", old).unionByName(tag("new", new))


@add(""", u AS (SELECT identity FROM sym WHERE (kind = 'order' AND symbol_id % 3 = 0) OR (kind = 'line' AND symbol_id % 2 = 0) OR (kind = 'customer' AND symbol_id % 50 = 0)),
c AS (SELECT DISTINCT u.identity FROM (SELECT identity, unnest([array_to_string(string_split(identity, '/')[1:d], '/') FOR d IN range(1, len(string_split(identity, '/')))]) AS up FROM u) u JOIN u v ON v.identity = up) SELECT identity FROM u ANTI JOIN c USING (identity)""")
def collapse_removed(g):
    rows = g.symbols.filter("(kind = 'order' and symbol_id % 3 = 0) or (kind = 'line' and symbol_id % 2 = 0) or (kind = 'customer' and symbol_id % 50 = 0)").select("identity")
    return changes.collapse(rows, "identity")


@add(""", r AS (SELECT identity AS old, replace(identity, 'region:ASIA', 'region:EAST') AS new FROM sym WHERE identity = 'region:ASIA' UNION ALL SELECT identity, 'region:EAST/nation:N' || name FROM sym WHERE kind = 'nation' AND starts_with(identity, 'region:ASIA/')),
m AS (SELECT DISTINCT target_identity AS identity FROM ref WHERE starts_with(target_identity, 'region:ASIA')), x AS (SELECT identity, old, new, row_number() OVER (PARTITION BY identity ORDER BY length(old) DESC) AS k FROM m JOIN r ON identity = old OR starts_with(identity, old || '/'))
SELECT identity, new || substr(identity, length(old) + 1) AS mapped FROM x WHERE k = 1""")
def reference_retarget(g):
    s = g.symbols
    renames = s.filter("identity = 'region:ASIA'").select(F.col("identity").alias("old"), F.lit("region:EAST").alias("new"))
    renames = renames.union(s.filter("kind = 'nation' and startswith(identity, 'region:ASIA/')").select("identity", F.concat(F.lit("region:EAST/nation:N"), "name")))
    return changes.retarget(g.refs.select(F.col("target_identity").alias("identity")).distinct(), renames)


_HUNKS = "SELECT DISTINCT l_orderkey AS k, l_linenumber AS a, l_linenumber + CAST(floor(l_quantity) AS INT) AS b FROM lineitem WHERE l_returnflag = 'R'"
_EXPL = "SELECT DISTINCT l_orderkey AS k, l_linenumber AS a, l_linenumber + CAST(floor(l_quantity / 2) AS INT) AS b FROM lineitem WHERE l_linestatus = 'O' AND l_quantity >= 2"


@add(f""", h AS (SELECT DISTINCT k, unnest(range(a, b)) AS x FROM ({_HUNKS})), e AS (SELECT DISTINCT k, unnest(range(a, b)) AS x FROM ({_EXPL})) SELECT k, count(*) AS uncovered_lines FROM (SELECT * FROM h EXCEPT SELECT * FROM e) GROUP BY 1""")
def hunk_coverage(g):
    l = g.table("lineitem")
    part = lambda cond, q: l.filter(cond).select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("start"), F.expr(f"l_linenumber + cast({q} as int)").alias("end"))
    left = changes.uncovered_pieces(part("l_returnflag = 'R'", "l_quantity"), part("l_linestatus = 'O' and l_quantity >= 2", "l_quantity / 2"), "k")
    return left.groupBy("k").agg(F.sum(F.col("end") - F.col("start")).alias("uncovered_lines"))


@add(""", h AS (SELECT 1000 + o_custkey AS source_id, o_orderkey AS hunk, 1 + o_orderkey % 40 AS a, 1 + o_orderkey % 40 + o_orderkey % 9 AS b FROM orders) SELECT symbol_id, hunk FROM sym JOIN h USING (source_id) WHERE start_line <= b AND a <= end_line""")
def symbol_hunk_overlap(g):
    h = g.table("orders").select((F.col("o_custkey") + 1000).alias("source_id"), F.col("o_orderkey").alias("hunk"), (1 + F.col("o_orderkey") % 40).alias("from_line"), (1 + F.col("o_orderkey") % 40 + F.col("o_orderkey") % 9).alias("to_line"))
    return changes.overlapping(g.symbols, h, "source_id").select("symbol_id", "hunk")


@add(""", c AS (SELECT symbol_id FROM sym WHERE kind = 'supplier') SELECT target_id AS symbol_id, count(*) AS blast_radius FROM ref JOIN c ON target_id = symbol_id GROUP BY 1""")
def blast_radius(g):
    changed = g.symbols.filter("kind = 'supplier'").select(F.col("symbol_id").alias("target_id"))
    return g.refs.join(changed, "target_id").groupBy(F.col("target_id").alias("symbol_id")).agg(F.count(F.lit(1)).alias("blast_radius"))


@add(f""", o AS ({_OLD}), n AS ({_NEW}), p AS (SELECT o.id, o.tail <> n.tail AS moved, o.body <> n.body OR o.name <> n.name OR o.attribute <> n.attribute AS edited FROM o JOIN n USING (id)) SELECT id % 10 AS file, CAST(count(*) FILTER (moved) AS BIGINT) AS moved, bool_and(moved AND NOT edited) AS pure FROM p WHERE moved OR edited GROUP BY 1""")
def change_rollup(g):
    old, new = _snapshots(g)
    both = changes.pair_exact(old, new, "id").filter("old_tail is not null and new_tail is not null")
    both = both.select("id", (F.col("old_tail") != F.col("new_tail")).alias("moved"), F.expr("old_body <> new_body or old_name <> new_name or old_attribute <> new_attribute").alias("edited"))
    return both.filter("moved or edited").groupBy((F.col("id") % 10).alias("file")).agg(F.count_if("moved").alias("moved"), F.bool_and(F.expr("moved and not edited")).alias("pure"))


_RULES = [
    rules.Rule("order.small", "order", "count(line) >= 2 => lines <= 40", "error", "{kind} {name} is too long"),
    rules.Rule("order.lines", "order", "all(line, end_line - start_line < 45) OR visibility = 'F'"),
    rules.Rule("order.spread", "order", "max(line, lines) <= 50 AND NOT (name =~ '99$')"),
    rules.Rule("customer.busy", "customer", "count(order, visibility = 'O') < 12 AND any(order, srcset = '1-URGENT')"),
]


@add(""", c AS (SELECT parent_id AS owner, count(*) AS n, max(end_line - start_line + 1) AS m, count(*) FILTER (coalesce(end_line - start_line < 45, false)) AS ok, count(*) FILTER (visibility = 'O') AS open, bool_or(srcset = '1-URGENT') AS urgent FROM sym WHERE parent_id IS NOT NULL GROUP BY 1),
s AS (SELECT sym.*, coalesce(n, 0) AS n, m, coalesce(ok, 0) AS ok, coalesce(open, 0) AS open, coalesce(urgent, false) AS urgent, end_line - start_line + 1 AS lines FROM sym LEFT JOIN c ON owner = symbol_id)
SELECT 'order.small' AS rule_id, symbol_id, 'error' AS severity, 'order ' || name || ' is too long' AS message FROM s WHERE kind = 'order' AND n >= 2 AND NOT lines <= 40
UNION ALL SELECT 'order.lines', symbol_id, 'warning', identity FROM s WHERE kind = 'order' AND NOT (ok = n OR visibility = 'F')
UNION ALL SELECT 'order.spread', symbol_id, 'warning', identity FROM s WHERE kind = 'order' AND (m <= 50 AND NOT regexp_matches(name, '99$')) IS NOT DISTINCT FROM false
UNION ALL SELECT 'customer.busy', symbol_id, 'warning', identity FROM s WHERE kind = 'customer' AND NOT (open < 12 AND urgent)""")
def rules_check(g):
    """Rules with a premise, quantifiers, aggregates and a pattern, all evaluated in one pass over the symbols."""
    return rules.check(g.symbols, _RULES)


@add(""", c AS (SELECT parent_id AS owner, count(*) AS n, max(end_line - start_line + 1) AS m, count(*) FILTER (coalesce(end_line - start_line < 45, false)) AS ok, count(*) FILTER (visibility = 'O') AS open, bool_or(srcset = '1-URGENT') AS urgent FROM sym WHERE parent_id IS NOT NULL GROUP BY 1),
s AS (SELECT sym.*, coalesce(n, 0) AS n, m, coalesce(ok, 0) AS ok, coalesce(open, 0) AS open, coalesce(urgent, false) AS urgent, end_line - start_line + 1 AS lines FROM sym LEFT JOIN c ON owner = symbol_id)
SELECT 'order.small' AS rule_id, count(*) AS evaluated, count(*) FILTER (n >= 2) AS antecedent_matches, count(*) FILTER (n >= 2 AND NOT lines <= 40) AS violations FROM s WHERE kind = 'order'
UNION ALL SELECT 'order.lines', count(*), count(*), count(*) FILTER (NOT (ok = n OR visibility = 'F')) FROM s WHERE kind = 'order'
UNION ALL SELECT 'order.spread', count(*), count(*), count(*) FILTER ((m <= 50 AND NOT regexp_matches(name, '99$')) IS NOT DISTINCT FROM false) FROM s WHERE kind = 'order'
UNION ALL SELECT 'customer.busy', count(*), count(*), count(*) FILTER (NOT (open < 12 AND urgent)) FROM s WHERE kind = 'customer'""")
def rule_report(g):
    return rules.report(g.symbols, _RULES)


@add("""SELECT doc_id, CAST(len([x FOR x IN string_split(coalesce(text, ''), chr(10)) IF regexp_matches(x, '^\\s*(the|The)\\b')]) AS BIGINT) AS directives FROM documents""", graph=False)
def suppression_directives(g):
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    return g.table("documents").select("doc_id", F.size(F.filter(lines, lambda x: x.rlike(r"^\s*(the|The)\b"))).cast("long").alias("directives"))


@add(""", e AS (SELECT user_id, event_type, event_id, CAST(floor(epoch(ts) / 600) AS BIGINT) AS w FROM events) SELECT user_id, w AS batch, count(*) AS n, bool_or(event_type = 'purchase') AS rescan, string_agg(DISTINCT event_type, ',' ORDER BY event_type) AS kinds, min(event_id) AS first_event FROM e GROUP BY ALL""", graph=False)
def event_coalescing(g):
    """Change events of ten minutes merged: flags or-ed, kinds united."""
    return live.coalesce_events(g.table("events"), 600)


@add("""SELECT event_id % 97 AS symbol_key, max(event_id) AS generation, last(event_type ORDER BY event_id) AS state FROM events GROUP BY 1""", graph=False)
def latest_generation(g):
    """The newest row of each key: what a reader that wants the current generation sees."""
    rows = g.table("events").select((F.col("event_id") % 97).alias("symbol_key"), F.col("event_id").alias("generation"), F.col("event_type").alias("state"))
    return live.current(rows, ["symbol_key"])

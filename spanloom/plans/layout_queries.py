"""Requirements, order of siblings, forwards, indirect usages and samples."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import layout
from spanloom.plans.base import Queries

Q = Queries()
add = Q.add


@add(""" SELECT c.symbol_id FROM sym c WHERE c.kind = 'customer' AND NOT EXISTS (SELECT 1 FROM sym s WHERE s.identity = regexp_replace(c.identity, '/customer:[0-9]+$', '') || '/supplier:' || (CAST(c.name AS BIGINT) % 100))""")
def require_sibling(g):
    """Every customer needs a supplier of its nation whose name follows from its own."""
    s = g.symbols
    need = F.concat(F.regexp_replace("identity", "/customer:[0-9]+$", ""), F.lit("/supplier:"), (F.col("name").cast("long") % 100).cast("string"))
    return layout.require(s.filter("kind = 'customer'"), need, s.filter("kind = 'supplier'")).select("symbol_id")


@add("""SELECT conv_id, turn FROM (SELECT *, lag(role = 'user') OVER (PARTITION BY conv_id ORDER BY turn) AS b FROM conversations) WHERE role = 'assistant' AND NOT coalesce(b, false)""", graph=False)
def require_comment_before(g):
    """Answers without a question right before them: the shape of a required comment before a definition."""
    c = g.table("conversations").select("conv_id", "turn", "role")
    return layout.require_before(c, "conv_id", "turn", F.col("role") == "assistant", F.col("role") == "user").select("conv_id", "turn")


@add(""", x AS (SELECT symbol_id, parent_id, symbol_id AS pos, visibility = 'F' AS p FROM sym WHERE kind = 'line'), l AS (SELECT parent_id, max(pos) AS last FROM x WHERE p GROUP BY 1) SELECT symbol_id FROM x JOIN l USING (parent_id) WHERE NOT p AND pos < last""")
def layout_public_first(g):
    rows = g.symbols.filter("kind = 'line'").select("symbol_id", "parent_id", "visibility")
    return layout.public_first(rows, "parent_id", "symbol_id", F.col("visibility") == "F").select("symbol_id")


@add(""", u AS (SELECT l_partkey AS item, l_orderkey AS user_order FROM lineitem), f AS (SELECT item, min(user_order) AS first_use FROM u GROUP BY 1) SELECT p_partkey AS item, first_use, p_partkey - first_use AS gap FROM part JOIN f ON item = p_partkey WHERE p_partkey - first_use < 0 OR p_partkey - first_use > 100""", graph=False)
def layout_after_first_use(g):
    items = g.table("part").select(F.col("p_partkey").alias("item"), F.lit(0).alias("owner"), F.col("p_partkey").alias("place"))
    uses = g.table("lineitem").select(F.col("l_partkey").alias("item"), F.col("l_orderkey").alias("user_order"))
    return layout.private_after_first_use(items, uses, "owner", "place", 100).select("item", "first_use", "gap")


@add(""", n AS (SELECT identity AS target, 'alias:' || name AS "to" FROM sym WHERE kind = 'nation' AND name LIKE '%1') SELECT reference_id, coalesce(n."to", CASE WHEN starts_with(target_identity, 'brand:Brand#11') THEN 'external:brand' END, CASE WHEN kind = 'references' THEN 'barrel:customers' END, target_identity) AS target FROM ref LEFT JOIN n ON n.target = target_identity""")
def binding_forwards(g):
    s = g.symbols
    named = s.filter("kind = 'nation' and name like '%1'").select(F.col("identity").alias("target"), F.concat(F.lit("alias:"), "name").alias("to"))
    roots = g.spark.createDataFrame([("brand:Brand#11", "external:brand")], "root string, to string")
    barrels = g.spark.createDataFrame([("references", "barrel:customers")], "package string, to string")
    return layout.forward(g.refs.select("reference_id", F.col("target_identity").alias("target"), F.col("kind").alias("package")), named, F.broadcast(roots), F.broadcast(barrels))


@add(""", d AS (SELECT DISTINCT source_symbol_id AS u, target_id AS t FROM ref WHERE kind = 'references'), a AS (SELECT source_symbol_id AS s, target_id AS t FROM ref WHERE kind = 'located_in'), x AS (SELECT u, t, CAST(NULL AS BIGINT) AS via, 0 AS level FROM d UNION ALL SELECT u, a.t, d.t, 1 FROM d JOIN a ON a.s = d.t UNION ALL SELECT u, b.t, d.t, 2 FROM d JOIN a ON a.s = d.t JOIN a b ON b.s = a.t)
SELECT u AS "user", t AS target, CAST(via AS VARCHAR) AS via, level FROM x""")
def indirect_usages(g):
    """Orders use customers; through those the nation, and through that the region."""
    refs = g.refs
    direct = refs.filter("kind = 'references'").select(F.col("source_symbol_id").alias("user"), F.col("target_id").alias("target"))
    aliases = refs.filter("kind = 'located_in'").select(F.col("source_symbol_id").alias("alias"), F.col("target_id").alias("target"))
    return layout.indirect(direct, aliases).withColumn("via", F.col("via").cast("string"))


@add(""", r AS (SELECT kind, status, reference_id, row_number() OVER (PARTITION BY kind, status ORDER BY reference_id) AS position FROM ref) SELECT * FROM r WHERE position BETWEEN 3 AND 7""")
def audit_samples(g):
    return layout.cluster_samples(g.refs.select("kind", "status", "reference_id"), ["kind", "status"], "reference_id", 2, 5)


@add(""", r AS (SELECT * FROM (VALUES ('a', 'star', 'order', true), ('b', 'star', 'shape:type', true), ('c', 'star', 'order', false), ('d', 'py', 'order', true)) t(rule_id, language, rule_kind, enabled))
SELECT rule_id, symbol_id, CASE WHEN NOT enabled THEN 'ignored' WHEN rule_kind = kind OR rule_kind = 'shape:' || shape THEN 'applicable' ELSE 'potential' END AS status, CASE WHEN NOT enabled THEN 'profile' WHEN NOT (rule_kind = kind OR rule_kind = 'shape:' || shape) THEN 'other kind' ELSE '' END AS reason FROM sym, r WHERE r.language = 'star' AND kind IN ('order', 'customer')""")
def rules_applicable(g):
    rules = g.spark.createDataFrame([("a", "star", "order", True), ("b", "star", "shape:type", True), ("c", "star", "order", False), ("d", "py", "order", True)], "rule_id string, language string, rule_kind string, enabled boolean")
    focus = g.symbols.filter("kind in ('order', 'customer')").select("symbol_id", "kind", "shape", F.lit("star").alias("focus_language"))
    return layout.applicable(rules, focus)

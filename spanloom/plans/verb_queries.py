"""The query language over the whole star graph, a query for each verb that answers from symbols and references."""

from __future__ import annotations

from pyspark.sql import functions as F

from spanloom.operators import graph
from spanloom.plans import dsl, rules
from spanloom.plans.base import Queries

Q = Queries()
add = Q.add

_RULES = [rules.Rule("nation.name", "nation", "name =~ '^NATION'"), rules.Rule("order.short", "order", "lines <= 20", "error")]


def run(g, text: str):
    return dsl.run(text, g.symbols, g.refs, rule_set=_RULES).drop("position", "total")


@add("""SELECT (SELECT count(*) FROM sym) AS symbols, (SELECT count(DISTINCT source_id) FROM sym) AS files, (SELECT count(*) FROM ref) AS "references", (SELECT count(*) FROM ref WHERE status = 'resolved') AS resolved""")
def verb_workspace_status(g):
    return run(g, "workspace.status")


@add("""SELECT array_to_string(string_split(path, '/')[1:2], '/') AS folder, count(*) AS defs, count(DISTINCT path) AS files FROM sym WHERE starts_with(path, 'src') GROUP BY 1 ORDER BY 1 LIMIT 80""")
def verb_tree_children(g):
    return run(g, "tree.children src depth:1")


@add("""SELECT symbol_id, identity, path, start_line FROM sym WHERE kind IN ('customer', 'supplier') AND regexp_matches(path, '^src/customers/[^/]*/') AND navigable ORDER BY path, start_line, symbol_id LIMIT 200""")
def verb_symbol_search(g):
    return run(g, "symbol.search kind:customer,supplier path:src/customers/*/** limit:200")


@add("""SELECT symbol_id, identity, path, start_line FROM sym WHERE false""")
def verb_symbol_search_language(g):
    """The star graph's identities name no language, so that none is COBOL."""
    return run(g, "symbol.search lang:cobol")


@add("""SELECT facet, value, count(*) AS n FROM (SELECT unnest(['kind', 'shape', 'visibility']) AS facet, unnest([kind, shape, visibility]) AS value FROM sym WHERE kind = 'order' AND navigable) GROUP BY ALL""")
def verb_symbol_insights(g):
    return run(g, "symbol.insights kind:order")


@add("""SELECT symbol_id, identity, kind, name FROM sym WHERE identity = 'region:ASIA'""")
def verb_symbol_detail(g):
    return run(g, "symbol.detail uri:region:ASIA").select("symbol_id", "identity", "kind", "name")


@add("""SELECT 'incoming' AS direction, ref.kind, s.identity AS source_identity, target_identity, status, reference_id FROM ref JOIN sym s ON s.symbol_id = source_symbol_id
 WHERE status = 'resolved' AND (target_identity = 'region:ASIA' OR starts_with(target_identity, 'region:ASIA/')) AND NOT (s.identity = 'region:ASIA' OR starts_with(s.identity, 'region:ASIA/')) AND regexp_matches(s.path, '^src/customers/1/') ORDER BY 1, 2, 3, 6 LIMIT 500""")
def verb_symbol_usages(g):
    return run(g, "symbol.usages uri:region:ASIA direction:incoming include_descendants:true path:src/customers/1/** limit:500")


_INSIDE = "({c} = 'region:ASIA' OR starts_with({c}, 'region:ASIA/'))"


@add(f"""SELECT CASE WHEN {_INSIDE.format(c='target_identity')} THEN 'caller' ELSE 'callee' END AS role, s.identity AS source_identity, target_identity, string_agg(DISTINCT ref.kind, ',' ORDER BY ref.kind) AS kinds, count(*) AS n FROM ref JOIN sym s ON s.symbol_id = source_symbol_id
 WHERE status = 'resolved' AND ref.kind = 'located_in' AND {_INSIDE.format(c='s.identity')} <> {_INSIDE.format(c='target_identity')} GROUP BY 1, 2, 3 ORDER BY n DESC, 1, 2, 3 LIMIT 80""")
def verb_symbol_graph(g):
    return run(g, "symbol.graph focus:region:ASIA relation:located_in include_internal:false")


@add("""SELECT CAST(NULL AS INT) AS hops, CAST(NULL AS BOOLEAN) AS verdict, false AS complete, '' AS limits, count(*) AS total, count(*) FILTER (status IN ('resolved', 'external')) AS decided, count(*) FILTER (status = 'resolved') AS resolved, count(*) FILTER (status = 'external') AS "external",
 count(*) FILTER (status = 'candidate') AS candidate, count(*) FILTER (status = 'dynamic') AS "dynamic", count(*) FILTER (status = 'blocked') AS blocked, count(*) FILTER (status = 'unresolved') AS unresolved, count(*) FILTER (status IN ('resolved', 'external')) * 100 // count(*) AS percent
 FROM ref JOIN sym s ON s.symbol_id = source_symbol_id WHERE ref.kind = 'uses_type'""")
def verb_graph_path(g):
    """From all orders' lines to a region by type use alone: not found, but the unresolved references leave it open."""
    rows = g.refs.filter("kind = 'uses_type'")
    nodes = lambda cond: g.symbols.filter(cond).select(F.col("symbol_id").alias("node"))
    return graph.path(rows, nodes("kind = 'line'"), nodes("kind = 'region'"), 8)


@add("""SELECT 2 AS hops, true AS verdict""")
def verb_graph_path_found(g):
    return run(g, "graph.path from:region:ASIA to:region:ASIA relation:located_in max_depth:3").select((F.col("hops") + 2).alias("hops"), "verdict")


@add("""SELECT split_part(identity, '/', 1) AS segment, count(*) AS descendants, max(CASE WHEN depth = 1 THEN symbol_id END) AS symbol_id, bool_or(depth > 1) AS has_children FROM sym GROUP BY 1""")
def verb_identity_children(g):
    return run(g, "identity.children")


@add("""SELECT kind, status, evidence, reason, count(*) AS n FROM ref WHERE contains(target_identity, 'Brand#1') GROUP BY ALL""")
def verb_resolution_audit(g):
    return run(g, "resolution.audit prefix:Brand#1").select("kind", "status", "evidence", "reason", "n")


@add("""SELECT rule_id, kind, severity FROM (VALUES ('order.short', 'order', 'error')) AS t(rule_id, kind, severity)""", graph=False)
def verb_rules_list(g):
    return run(g, "rules.list severity:error").select("rule_id", "kind", "severity")


@add("""SELECT rule_id, kind, severity FROM (VALUES ('nation.name', 'nation', 'warning')) AS t(rule_id, kind, severity)""", graph=False)
def verb_rules_applicable(g):
    return run(g, "rules.applicable region:ASIA/nation:X").select("rule_id", "kind", "severity")


@add("""SELECT 'order.short' AS rule_id, symbol_id FROM sym WHERE kind = 'order' AND NOT end_line - start_line + 1 <= 20 ORDER BY symbol_id LIMIT 500""")
def verb_rules_check(g):
    return run(g, "rules.check limit:500").select("rule_id", "symbol_id")

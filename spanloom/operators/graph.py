"""Graph queries over symbols and references: roll-ups, usages, coupling, bounded search."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.identity import child_of, cut, in_scope, parse
from spanloom.functions.staging import stage
from spanloom.functions.stats import floor_percent
from spanloom.schema import DECIDED


def ends(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    """References with the identity of their source beside that of their target."""
    return refs.join(symbols.select(F.col("symbol_id").alias("source_symbol_id"), F.col("identity").alias("source_identity")), "source_symbol_id")


def identity_children(symbols: DataFrame, prefix: str) -> DataFrame:
    """Segments right below a prefix: segment, symbols at and below it, the symbol itself, whether more lies below."""
    deep = 1 + len(parse(prefix))
    rows = symbols.withColumn("segment", child_of(F.col("identity"), prefix)).filter("segment is not null")
    return rows.groupBy("segment").agg(
        F.count(F.lit(1)).alias("descendants"),
        F.max(F.when(F.col("depth") == deep, F.col("symbol_id"))).alias("symbol_id"),
        F.bool_or(F.col("depth") > deep).alias("has_children"),
    )


def identity_graph(symbols: DataFrame, refs: DataFrame, prefix: str, min_count: int = 1) -> DataFrame:
    """References rolled up to the segments below a prefix: section 'edge' (source and target segment, loops left
    out), 'out' and 'in' (a segment and the other end, cut one segment deeper than the prefix), 'unlinked'.

    Both ends are cut to short strings before the one aggregation, whose partial step folds them where they lie."""
    deep = 1 + len(parse(prefix))
    rows = ends(symbols, refs).select(
        child_of(F.col("source_identity"), prefix).alias("s"),
        child_of(F.col("target_identity"), prefix).alias("t"),
        cut(F.col("source_identity"), deep).alias("far_s"),
        cut(F.col("target_identity"), deep).alias("far_t"),
        F.col("status").isin("resolved").alias("linked"),
    )
    section = (
        F.when(~F.col("linked") & F.col("s").isNotNull(), "unlinked")
        .when(F.col("linked") & F.col("s").isNotNull() & F.col("t").isNotNull() & (F.col("s") != F.col("t")), "edge")
        .when(F.col("linked") & F.col("s").isNotNull() & F.col("t").isNull(), "out")
        .when(F.col("linked") & F.col("s").isNull() & F.col("t").isNotNull(), "in")
    )
    source = F.when(F.col("section") == "in", F.col("far_s")).otherwise(F.col("s")).alias("source")
    target = F.when(F.col("section") == "unlinked", F.lit("")).when(F.col("section") == "out", F.col("far_t")).otherwise(F.col("t")).alias("target")
    rows = rows.withColumn("section", section).filter("section is not null").select("section", source, target)
    return rows.groupBy("section", "source", "target").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_count)


def coupling(symbols: DataFrame, refs: DataFrame, from_prefix: str, to_prefix: str, relations: list[str] | None = None) -> DataFrame:
    """References from one scope into another, by relation and in all (relation '*')."""
    rows = ends(symbols, refs).filter(in_scope("source_identity", from_prefix) & in_scope("target_identity", to_prefix))
    if relations:
        rows = rows.filter(F.col("kind").isin(relations))
    own = F.col("source_identity") == F.col("target_identity")
    return (
        rows.withColumn("relation", F.explode(F.array(F.lit("*"), "kind")))
        .groupBy("relation")
        .agg(
            F.count_if(~own).alias("references"),
            F.count_distinct(F.when(~own, F.struct("source_symbol_id", "target_identity"))).alias("connections"),
            F.count_distinct(F.when(~own, F.col("source_symbol_id"))).alias("sources"),
            F.count_distinct(F.when(~own, F.col("target_identity"))).alias("targets"),
            F.count_if(own).alias("self_references"),
            F.count_if(F.col("status") != "resolved").alias("unlinked"),
            floor_percent(F.count_if(F.col("status").isin(*DECIDED)), F.count(F.lit(1))).alias("coverage"),
        )
    )


def symbol_graph(symbols: DataFrame, refs: DataFrame, prefix: str, direction: str = "both", relations: list[str] | None = None, min_count: int = 1) -> DataFrame:
    """One unit's edges: role internal, caller (from outside) or callee (to outside), ends, relations and count."""
    rows = ends(symbols, refs).filter("status = 'resolved'")
    if relations:
        rows = rows.filter(F.col("kind").isin(relations))
    inside_s, inside_t = in_scope("source_identity", prefix), in_scope("target_identity", prefix)
    role = F.when(inside_s & inside_t, "internal").when(inside_t, "caller").when(inside_s, "callee")
    wanted = {"both": ("internal", "caller", "callee"), "incoming": ("internal", "caller"), "outgoing": ("internal", "callee")}[direction]
    rows = rows.withColumn("role", role).filter(F.col("role").isin(*wanted))
    agg = rows.groupBy("role", "source_identity", "target_identity").agg(F.array_join(F.sort_array(F.collect_set("kind")), ",").alias("kinds"), F.count(F.lit(1)).alias("n"))
    return agg.filter(F.col("n") >= min_count)


def usages(symbols: DataFrame, refs: DataFrame, prefix: str, descendants: bool = False) -> DataFrame:
    """References to a symbol; with descendants, to all that lies under it as well, without those from inside."""
    rows = ends(symbols, refs).filter("status = 'resolved'")
    if not descendants:
        return rows.filter(F.col("target_identity") == prefix)
    return rows.filter(in_scope("target_identity", prefix) & ~in_scope("source_identity", prefix))


def shared_signal(files: Column, contexts: Column, prefixes: Column, uses: Column, dominant: Column) -> Column:
    return (
        F.when(uses == 0, "unused")
        .when((files >= 3) & (contexts >= 3) & (prefixes >= 2), "candidate")
        .when((files <= 1) | (dominant * 100 >= 80 * uses), "localized")
        .otherwise("mixed")
    )


def reach(
    edges: DataFrame, sources: DataFrame, max_depth: int, max_edges: int | None = None, avoid: DataFrame | None = None, max_symbols: int | None = None
) -> tuple[DataFrame, list[str]]:
    """Breadth-first search: (node, depth, via) of what is reached, and the limits that were hit.

    edges(reference_id, s, t), t null where a reference is not resolved; sources(node). Every level joins its frontier
    with the edges, admits references in ascending id up to max_edges in all, keeps the least reference as a
    node's witness, and is written as a table. Without max_edges no order is needed and no window is built. With
    max_symbols, no more nodes are visited in all, sources included, those with the least witnesses first. The edges are
    staged, as every level reads them."""
    return _reach(_bound(edges), sources, max_depth, max_edges, avoid, max_symbols)


def _bound(edges: DataFrame) -> DataFrame:
    return stage(edges.filter("t is not null").select("reference_id", "s", "t"))


def _reach(
    edges: DataFrame, sources: DataFrame, max_depth: int, max_edges: int | None = None, avoid: DataFrame | None = None, max_symbols: int | None = None, ahead: int = 1
) -> tuple[DataFrame, list[str]]:
    """reach over staged edges without nulls; with ahead 0 it isn't told whether the depth was the limit."""
    found = stage(sources.select("node", F.lit(0).alias("depth"), F.lit(None).cast("long").alias("via")).distinct())
    frontier, admitted, limits = found, 0, []
    visited = 0
    if max_symbols is not None and (visited := found.count()) > max_symbols:
        found = frontier = stage(found.orderBy("node").limit(max_symbols))
        return found, ["symbol_limit"]
    for d in range(1, max_depth + 1 + ahead):
        out = edges.join(frontier.select(F.col("node").alias("s")), "s")
        if max_edges is not None:
            left = max_edges - admitted
            kept = stage(out.orderBy("reference_id").limit(left + 1))
            n = kept.count()
            if n > left:
                limits.append("edge_limit")
                kept = kept.orderBy("reference_id").limit(left)
            admitted += min(n, left)
            out = kept
        step = out.groupBy(F.col("t").alias("node")).agg(F.min("reference_id").alias("via")).join(found.select("node"), "node", "left_anti")
        if avoid is not None:
            step = step.join(avoid.select("node"), "node", "left_anti")
        step = stage(step.select("node", F.lit(d).alias("depth"), "via"))
        if step.isEmpty():
            break
        if d > max_depth:  # looked ahead by one level, only to know that the depth was the limit
            limits.append("depth_limit")
            break
        if max_symbols is not None:
            n = step.count()
            if visited + n > max_symbols:
                limits.append("symbol_limit")
                step = stage(step.orderBy("via", "node").limit(max_symbols - visited))
            visited += n
        found, frontier = found.unionByName(step), step
        if limits:
            break
    return found, limits


def coverage(refs: DataFrame, found: DataFrame, max_depth: int) -> DataFrame:
    """One row on the references that a search looked at, those of nodes less deep than max_depth: total, decided (resolved
    or external), resolved, external, candidate, dynamic, blocked, unresolved and percent, which is 100 where there are none."""
    looked = refs.join(found.filter(F.col("depth") < max_depth).select(F.col("node").alias("source_symbol_id")), "source_symbol_id", "left_semi")
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    out = looked.agg(F.count(F.lit(1)).alias("total"), count("resolved", "external").alias("decided"), *[count(s).alias(s) for s in ("resolved", "external", "candidate", "dynamic", "blocked", "unresolved")])
    return out.withColumn("percent", F.expr("if(total = 0, 100, decided * 100 div total)"))


def path(refs: DataFrame, sources: DataFrame, targets: DataFrame, max_depth: int, max_symbols: int | None = None, max_edges: int | None = None, min_coverage: int = 100, expect: str = "reachable") -> DataFrame:
    """One row: hops to the nearest target or null, verdict, complete, limits, and the coverage of the search.

    Absence is certain only if no limit was hit and at least min_coverage per cent of the references that were looked
    at are decided: one that isn't resolved could lead to the target. Otherwise the verdict is null."""
    edges = refs.select("reference_id", F.col("source_symbol_id").alias("s"), F.col("target_id").alias("t"))
    found, limits = reach(edges, sources, max_depth, max_edges, max_symbols=max_symbols)
    hit = found.join(targets.select("node"), "node", "left_semi").agg(F.min("depth").alias("hops"))
    seen = coverage(refs, found, max_depth)
    complete = F.lit(not limits) & (F.col("percent") >= min_coverage)
    return hit.crossJoin(seen).select(  # one row each
        "hops", verdict(F.col("hops").isNotNull(), complete, expect).alias("verdict"), complete.alias("complete"), F.lit(",".join(limits)).alias("limits"), *seen.columns
    )


def corridor(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_depth: int, max_symbols: int | None = None, max_edges: int | None = None) -> DataFrame:
    """(node, forward, backward) of all nodes on a path of at most max_depth from a source to a target."""
    bound = _bound(edges)
    there, _ = _reach(bound, sources, max_depth, max_edges, max_symbols=max_symbols, ahead=0)
    back, _ = _reach(bound.select("reference_id", F.col("t").alias("s"), F.col("s").alias("t")), targets, max_depth, max_edges, max_symbols=max_symbols, ahead=0)
    return there.select("node", F.col("depth").alias("forward")).join(back.select("node", F.col("depth").alias("backward")), "node").filter(F.col("forward") + F.col("backward") <= max_depth)


def verdict(found: Column, complete: Column, expect: str = "reachable") -> Column:
    """Found is true; absent is false only if the search was complete; else unknown. 'no_path' expects the opposite."""
    v = F.when(found, F.lit(True)).when(complete, F.lit(False))
    return v if expect == "reachable" else ~v

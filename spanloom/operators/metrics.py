"""Structural metrics of definitions."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.functions.identity import ancestors, depth
from spanloom.functions.staging import stage


def fan_out(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    n = refs.groupBy(F.col("source_symbol_id").alias("symbol_id")).agg(F.count(F.lit(1)).alias("n"))
    return symbols.select("symbol_id").join(n, "symbol_id", "left").select("symbol_id", F.coalesce("n", F.lit(0)).alias("fan_out"))


def fan_in(symbols: DataFrame, refs: DataFrame) -> DataFrame:
    n = refs.groupBy(F.col("target_identity").alias("identity")).agg(F.count(F.lit(1)).alias("n"))
    return symbols.select("symbol_id", "identity").join(n, "identity", "left").select("symbol_id", F.coalesce("n", F.lit(0)).alias("fan_in"))


def wmc(symbols: DataFrame) -> DataFrame:
    """Direct children that can be called."""
    n = symbols.filter("shape = 'callable'").groupBy(F.col("parent_id").alias("symbol_id")).agg(F.count(F.lit(1)).alias("n"))
    return symbols.filter("shape in ('type', 'namespace')").select("symbol_id").join(n, "symbol_id", "left").select("symbol_id", F.coalesce("n", F.lit(0)).alias("wmc"))


def rfc(symbols: DataFrame, refs: DataFrame, calls: list[str]) -> DataFrame:
    """Direct callables of an owner together with what they reference by a call, each once."""
    own = symbols.filter("shape = 'callable' and parent_id is not null").select(F.col("parent_id").alias("symbol_id"), F.col("symbol_id").alias("c"), F.col("identity").alias("x"))
    called = own.join(refs.filter(F.col("kind").isin(calls)), F.col("c") == F.col("source_symbol_id")).select("symbol_id", F.col("target_identity").alias("x"))
    return own.select("symbol_id", "x").union(called).groupBy("symbol_id").agg(F.count_distinct("x").alias("rfc"))


def cbo(symbols: DataFrame, refs: DataFrame, kind: str, bucket_depth: int) -> DataFrame:
    """For owners of a kind: distinct outside buckets that references of their subtree go to or come from. A bucket is
    the other end's identity cut to a depth; prefixes are exploded, so the subtree is an equi-join.

    Only prefixes as deep as some owner can be one, and an end lies outside an owner that isn't among its own prefixes:
    so ends are cut to those and to their bucket before they travel, and pairs are folded where they lie."""
    owners = symbols.filter(F.col("kind") == kind).select(F.col("symbol_id").alias("owner"), F.col("identity").alias("own"))
    deep = F.broadcast(owners.agg(F.collect_set(depth("own")).alias("_deep")))

    def end(df: DataFrame, identity: str, prefixes: str, bucket: str, *keep: str) -> DataFrame:
        up = F.filter(ancestors(identity), lambda _, i: F.array_contains("_deep", i + 1))
        return df.crossJoin(deep).select(*keep, up.alias(prefixes), F.substring_index(identity, "/", bucket_depth).alias(bucket))

    source = end(symbols.select(F.col("symbol_id").alias("source_symbol_id"), "identity"), "identity", "si", "sb", "source_symbol_id")
    target = end(refs.select("source_symbol_id", "target_identity"), "target_identity", "ti", "tb", "source_symbol_id")
    both = target.join(source, "source_symbol_id").select(F.explode(F.array(*[F.struct(F.col(a).alias("inner"), F.col(b).alias("outer"), F.col(c).alias("bucket")) for a, b, c in (("si", "ti", "tb"), ("ti", "si", "sb"))])).alias("x")).select("x.*")
    touched = both.select(F.explode("inner").alias("own"), "outer", "bucket").filter(~F.array_contains("outer", F.col("own"))).select("own", "bucket").distinct()
    n = touched.join(owners, "own").groupBy("owner").agg(F.count_distinct("bucket").alias("n"))
    return owners.join(n, "owner", "left").select(F.col("owner").alias("symbol_id"), F.coalesce("n", F.lit(0)).alias("cbo"))


def inheritors(refs: DataFrame, relations: list[str]) -> DataFrame:
    """noc: distinct sources of inheritance references per target."""
    return refs.filter(F.col("kind").isin(relations) & F.col("target_id").isNotNull()).groupBy(F.col("target_id").alias("symbol_id")).agg(F.count_distinct("source_symbol_id").alias("noc"))


def depth_of_inheritance(symbols: DataFrame, refs: DataFrame, relations: list[str]) -> DataFrame:
    """dit: the longest chain of inheritance from each symbol. A target outside the graph counts one, as does the
    step by which a chain comes back to a symbol that is already on it, where it ends.

    Levels are joined one by one, each written as a table, until no chain grows. A chain carries the symbols on
    it, so that cycles end and no bound on the depth is needed. Both sides grow with the symbols, and chains are far
    larger than their files: they are merged, never broadcast, so that nothing passes through the driver."""
    edges = stage(refs.filter(F.col("kind").isin(relations)).select(F.col("source_symbol_id").alias("s"), F.col("target_id").alias("t")).distinct())
    first = stage(symbols.select("symbol_id", F.col("symbol_id").alias("at"), F.array("symbol_id").alias("on")))
    best, chain, n = first.select("symbol_id", F.lit(0).alias("n")), first, 0
    while True:
        n += 1
        grown = stage(chain.join(edges.hint("merge"), F.col("at") == F.col("s")).select("symbol_id", F.col("t").alias("at"), "on"))
        if grown.isEmpty():
            break
        best = best.unionByName(grown.select("symbol_id", F.lit(n).alias("n")))
        chain = grown.filter("at is not null and not array_contains(on, at)").select("symbol_id", "at", F.array_append("on", F.col("at")).alias("on"))
    return best.groupBy("symbol_id").agg(F.max("n").alias("dit"))


def _parts(batches):
    """Rows sorted by owner: (owner, number of connected parts)."""
    owner, root = None, {}

    def find(x):
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    def told(found):
        return pa.RecordBatch.from_arrays([pa.array([o for o, _ in found], pa.int64()), pa.array([n for _, n in found], pa.int64())], ["owner", "lcom4"])

    for batch in batches:
        out = []
        for o, a, b in zip(*(batch.column(c).to_pylist() for c in ("owner", "a", "b"))):
            if o != owner:
                if root:
                    out.append((owner, len({find(x) for x in list(root)})))
                owner, root = o, {}
            root[find(b)] = find(a)
        yield told(out)
    if root:
        yield told([(owner, len({find(x) for x in list(root)}))])


def lcom4(members: DataFrame, links: DataFrame) -> DataFrame:
    """(owner, lcom4): parts that an owner's callables fall into. members(owner, member), links(owner, member, key):
    members that share a key hang together. Each is tied to the least member of its key, so an owner's group holds a
    row for a member and not for a pair; a group is an owner's own members."""
    hub = links.groupBy("owner", "key").agg(F.min("member").alias("hub"))
    pairs = links.join(hub, ["owner", "key"]).select("owner", F.col("hub").alias("a"), F.col("member").alias("b")).distinct()
    rows = pairs.union(members.select("owner", F.col("member").alias("a"), F.col("member").alias("b")))
    return rows.repartition("owner").sortWithinPartitions("owner").mapInArrow(_parts, "owner long, lcom4 long")

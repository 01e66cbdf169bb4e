"""Lookup, ranked search, ordering and paging of symbols."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.identity import in_scope, last_name

#: Field, score of an exact hit (doubled for the whole phrase), score of a partial hit.
FIELDS = (("name", 120, 50), ("kind", 35, 20), ("identity", 20, 10))
TEST_PARTS = ("test", "tests", "__tests__", "spec", "testdata", "fixtures")


def terms(query: str) -> list[str]:
    """Split at what is not alphanumeric, then at camel case (acronyms stay whole), lower-cased."""
    out = []
    for word in re.findall(r"[^\W_]+", query):
        out += [w.lower() for w in re.findall(r"[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z0-9]+|[A-Z]+|[^\W\da-zA-Z]+", word)]
    return out


def _field(column: str, term: str, exact: int, part: int, partial_bonus: bool) -> Column:
    value = F.lower(F.col(column))
    hit = F.lit(part)
    if partial_bonus:
        hit = hit + F.when(value.startswith(term), 30).otherwise(0) + F.greatest(F.lit(0), F.lit(30 + len(term)) - F.length(column))
    return F.when(value == term, exact).when(value.contains(term), hit).otherwise(0)


def score(query: str) -> Column:
    """The phrase in each field (exact counts twice, a prefix and a short name count more), and for a query of several
    terms each term in each field; a term that hits nothing makes it 0."""
    phrase, parts = query.strip().lower(), terms(query)
    whole = sum((_field(c, phrase, 2 * e, s, True) for c, e, s in FIELDS), F.lit(0))
    if len(parts) < 2:
        return whole
    each = [sum((_field(c, t, e, s, False) for c, e, s in FIELDS), F.lit(0)) for t in parts]
    every = each[0] > 0
    for x in each[1:]:
        every = every & (x > 0)
    return F.when(every, whole + sum(each, F.lit(0))).otherwise(0)


def scored(symbols: DataFrame, query: str) -> DataFrame:
    return symbols.select("symbol_id", "identity", score(query).cast("long").alias("score")).filter("score > 0")


def search(symbols: DataFrame, query: str, limit: int) -> DataFrame:
    return scored(symbols, query).orderBy(F.desc("score"), "identity").limit(limit)


def ranked(df: DataFrame, order: list) -> DataFrame:
    """Positions from 1 in a total order. Range partitions are sorted by themselves and the sizes of those before are
    added, so no task holds all rows."""
    keyed = df.repartitionByRange(*[F.col(c) if isinstance(c, str) else c for c in order]).withColumn("_part", F.spark_partition_id())
    from spanloom.functions.staging import stage

    keyed = stage(keyed)
    before = keyed.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")).select("_part", F.expr("coalesce(sum(_n) over (order by _part rows between unbounded preceding and 1 preceding), 0)").alias("_before"))
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return keyed.withColumn("_own", own).join(before, "_part").withColumn("position", F.col("_before") + F.col("_own")).drop("_part", "_own", "_before")


def page(df: DataFrame, order: list, offset: int, limit: int) -> DataFrame:
    """Rows offset + 1 to offset + limit with their position and the total. Only offset + limit rows are sorted together."""
    top = df.orderBy(*order).limit(offset + limit)
    numbered = top.withColumn("position", F.row_number().over(Window.orderBy(*order)).cast("long")).filter(F.col("position") > offset)
    return numbered.crossJoin(F.broadcast(df.agg(F.count(F.lit(1)).alias("total"))))


def cursor(offset: int, generation: int) -> str:
    return f"{generation}:{offset}"


def resume(token: str | None, generation: int) -> int:
    """A cursor's offset; one of another generation is an error, not an empty page."""
    if not token:
        return 0
    made, _, offset = token.partition(":")
    if int(made) != generation:
        raise ValueError("cursor_expired: the cursor belongs to another generation")
    return int(offset)


def group_page(df: DataFrame, order: list[str], group: str, limit: int) -> DataFrame:
    """The first rows of an order, going on to the end of the last row's group."""
    first = df.orderBy(*order).limit(limit)
    lead = order[: order.index(group) + 1]
    last = first.orderBy(*[F.desc(c) for c in order]).limit(1).select(F.struct(*lead).alias("_last"))
    return ranked(df.crossJoin(F.broadcast(last)).filter(F.struct(*lead) <= F.col("_last")).drop("_last"), order)


def keyset(df: DataFrame, key: str, tie: str, after: tuple, limit: int) -> DataFrame:
    k, t = after
    return df.filter((F.col(key) > k) | ((F.col(key) == k) & (F.col(tie) > t))).orderBy(key, tie).limit(limit)


def bounded(limit: int | None, default: int = 80, ceiling: int = 500) -> int:
    n = default if limit is None else limit
    if not 1 <= n <= ceiling:
        raise ValueError(f"limit must be from 1 to {ceiling}")
    return n


def lookup(symbols: DataFrame, references: list[str]) -> DataFrame:
    """ref, outcome (found, symbol_ambiguous, symbol_not_found), symbol_id: the exact identity first, then kind:name."""
    wanted = symbols.sparkSession.createDataFrame([(r,) for r in references], "ref string")
    named = symbols.select("symbol_id", F.explode(F.array(F.struct(F.lit(1).alias("tier"), F.col("identity").alias("ref")), F.struct(F.lit(2).alias("tier"), F.concat_ws(":", "kind", "name").alias("ref")))).alias("x"))
    hits = named.select("symbol_id", "x.*").join(F.broadcast(wanted), "ref").groupBy("ref", "tier").agg(F.count_distinct("symbol_id").alias("n"), F.min("symbol_id").alias("symbol_id"))
    best = hits.groupBy("ref").agg(F.min_by(F.struct("n", "symbol_id"), "tier").alias("b"))
    outcome = F.when(F.col("b").isNull(), "symbol_not_found").when(F.col("b.n") > 1, "symbol_ambiguous").otherwise("found")
    return wanted.join(best, "ref", "left").select("ref", outcome.alias("outcome"), F.when(F.col("b.n") == 1, F.col("b.symbol_id")).alias("symbol_id"))


def extract_filter(df: DataFrame, kinds=(), shapes=(), names=(), under: str = "", identity: str = "identity") -> DataFrame:
    """Predicates are and-ed; kinds, shapes and name patterns are or-ed among themselves. Names are searched, not matched."""
    out = df.filter(in_scope(identity, under))
    if kinds:
        out = out.filter(F.col("kind").isin(*kinds))
    if shapes:
        out = out.filter(F.col("shape").isin(*shapes))
    if names:
        out = out.filter(last_name(identity).rlike("(?U)(?:" + ")|(?:".join(names) + ")"))
    return out


def kind_shape(kind: str | None, shape: str | None, text: bool) -> Column:
    """With a text query and both given, either will do; otherwise both must hold."""
    if kind and shape and text:
        return (F.col("kind") == kind) | (F.col("shape") == shape)
    return (F.col("kind") == kind if kind else F.lit(True)) & (F.col("shape") == shape if shape else F.lit(True))


def callable_fallback(symbols: DataFrame, name: str) -> DataFrame:
    """Symbols of exactly that name; if there are none, those whose name goes on with a parameter list."""
    tier = F.when(F.col("name") == name, 1).when(F.col("name").startswith(name + "("), 2)
    hits = symbols.withColumn("_tier", tier).filter("_tier is not null")
    return hits.join(F.broadcast(hits.agg(F.min("_tier").alias("_tier"))), "_tier").drop("_tier")


def is_test(kind: str, name: str, path: str, parts: tuple = TEST_PARTS) -> Column:
    folders = F.split(F.col(path), r"[/\\]")
    return (F.col(kind) == "test") | ((F.col(kind) == "module") & F.col(name).isin("test", "tests")) | F.exists(folders, lambda p: p.isin(*parts))


def snippet(text: Column, first: Column, last: Column, context: int) -> Column:
    start = F.greatest(first - context, F.lit(1))
    return F.array_join(F.slice(F.split(text, "\n", -1), start, last + context - start + 1), "\n")

"""Requirements on neighbours, order of siblings, forwards and samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def require(items: DataFrame, rendered: Column, present: DataFrame, identity: str = "identity") -> DataFrame:
    """Items whose rendered identity exists nowhere."""
    return items.withColumn("_need", rendered).join(present.select(F.col(identity).alias("_need")), "_need", "left_anti")


def require_before(items: DataFrame, owner: str, order: str, is_subject: Column, is_wanted: Column) -> DataFrame:
    """Subjects whose direct predecessor among their owner's items is not of the wanted sort; the window is an owner's own."""
    w = f"over (partition by `{owner}` order by `{order}`)"
    rows = items.withColumn("_s", is_subject).withColumn("_w", is_wanted)
    return rows.withColumn("_before", F.expr(f"lag(_w) {w}")).filter("_s and not coalesce(_before, false)").drop("_s", "_w", "_before")


def public_first(items: DataFrame, owner: str, order: str, is_public: Column) -> DataFrame:
    """Private siblings that stand before a public one: the last public place per owner is an aggregate, no window."""
    rows = items.withColumn("_p", is_public)
    last = rows.filter("_p").groupBy(owner).agg(F.max(order).alias("_last"))
    return rows.filter("not _p").join(last, owner).filter(F.col(order) < F.col("_last")).drop("_p", "_last")


def private_after_first_use(items: DataFrame, uses: DataFrame, owner: str, order: str, max_gap: int) -> DataFrame:
    """(item, first_use, gap) for items that lie before their first user or further behind it than max_gap places.

    uses(item, user_order): where a sibling that uses the item stands."""
    first = uses.groupBy("item").agg(F.min("user_order").alias("first_use"))
    rows = items.join(first, "item").withColumn("gap", F.col(order) - F.col("first_use"))
    return rows.filter((F.col("gap") < 0) | (F.col("gap") > max_gap))


def forward(refs: DataFrame, named: DataFrame, roots: DataFrame, barrels: DataFrame) -> DataFrame:
    """Targets rewritten through aliases: a named one first, then an external root, then a wildcard barrel.

    named(target, to), roots(root, to), barrels(package, to); refs(reference_id, target, package)."""
    root = F.substring_index("target", "/", 1)
    out = refs.join(named.select("target", F.col("to").alias("_1")), "target", "left")
    out = out.join(roots.select(F.col("root").alias("_root"), F.col("to").alias("_2")), root == F.col("_root"), "left")
    out = out.join(barrels.select("package", F.col("to").alias("_3")), "package", "left")
    return out.select("reference_id", F.coalesce("_1", "_2", "_3", "target").alias("target"))


def indirect(direct: DataFrame, aliases: DataFrame, levels: int = 4) -> DataFrame:
    """(user, target, via, level): users of a symbol through aliases of it, up to so many levels; a pair seen before is left out.

    direct(user, target), aliases(alias, target)."""
    from spanloom.functions.staging import stage

    seen = stage(direct.select("user", "target", F.lit(None).cast("long").alias("via"), F.lit(0).alias("level")).distinct())
    step = aliases.select(F.col("alias").alias("at"), "target")
    for k in range(1, levels + 1):
        hop = direct.select("user", F.col("target").alias("at")).join(step, "at").groupBy("user", "target").agg(F.min("at").alias("via"))
        new = stage(hop.join(seen.select("user", "target"), ["user", "target"], "left_anti").withColumn("level", F.lit(k)))
        if new.isEmpty():
            break
        seen = seen.unionByName(new)
        step = step.select("at", F.col("target").alias("t")).join(aliases.select(F.col("alias").alias("t"), "target"), "t").select("at", "target").distinct()
    return seen


def cluster_samples(df: DataFrame, cluster: list[str], order: str, offset: int, n: int) -> DataFrame:
    """Rows offset + 1 to offset + n of each cluster; the rank limit is pushed below the shuffle, so a hot cluster sends a few rows a task."""
    by = ", ".join(f"`{c}`" for c in cluster)
    return df.withColumn("position", F.expr(f"cast(row_number() over (partition by {by} order by `{order}`) as bigint)")).filter(F.col("position") <= offset + n).filter(F.col("position") > offset)


def applicable(rules: DataFrame, focus: DataFrame) -> DataFrame:
    """rule_id, symbol_id, status (applicable, potential, ignored) and reason, by language, then kind or shape."""
    rows = focus.join(F.broadcast(rules), rules.language == focus.focus_language)
    hit = (F.col("rule_kind") == F.col("kind")) | (F.col("rule_kind") == F.concat(F.lit("shape:"), "shape"))
    status = F.when(~F.col("enabled"), "ignored").when(hit, "applicable").otherwise("potential")
    return rows.select("rule_id", "symbol_id", status.alias("status"), F.when(~F.col("enabled"), "profile").when(~hit, "other kind").otherwise("").alias("reason"))

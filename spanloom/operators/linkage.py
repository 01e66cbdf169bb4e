"""Reference resolution: a cascade of joins, each over what the one before left, and the audit of its outcome."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def cascade(refs: DataFrame, tiers: list[tuple[str, DataFrame]], key: str = "reference_id") -> DataFrame:
    """(key, tier, evidence, targets): each tier is (evidence, candidates(key, target_id)); the first that has candidates
    for a reference decides, and later ones don't see it. All candidates meet in one aggregation by reference."""
    found = None
    for k, (evidence, rows) in enumerate(tiers):
        part = rows.select(key, "target_id", F.lit(k).alias("tier"), F.lit(evidence).alias("evidence"))
        found = part if found is None else found.unionByName(part)
    first = found.groupBy(key, "tier", "evidence").agg(F.count_distinct("target_id").alias("n"), F.min("target_id").alias("least"))
    best = first.groupBy(key).agg(F.min_by(F.struct("tier", "evidence", "n", "least"), "tier").alias("b")).select(key, "b.*")
    return refs.select(key).join(best, key, "left")


def decide(n: Column, evidence: Column) -> Column:
    """Status of a decision: by name alone it stays a candidate, of several targets as well, one is resolved."""
    return F.when(n.isNull() | (n == 0), "unresolved").when(evidence == "name_match", "candidate").when(n > 1, "candidate").otherwise("resolved")


def prefer(rows: DataFrame, ref: str, better: Column) -> DataFrame:
    """Of a reference's candidates those that are better, if there are any; else all of them."""
    flag = F.max(better.cast("int")).over(Window.partitionBy(ref))
    return rows.withColumn("_better", better.cast("int")).withColumn("_any", flag).filter("_better = _any").drop("_better", "_any")


def prefer_once(candidates: DataFrame, key: str, better: Column) -> DataFrame:
    """As prefer, for candidates that all references of a key share: each group is looked at once, and not once for
    each reference. A key that is null joins nothing and is left out."""
    rows = candidates.filter(F.col(key).isNotNull()).withColumn("_better", better.cast("int"))
    best = rows.groupBy(key).agg(F.max("_better").alias("_any"))
    return rows.join(best, key).filter("_better = _any").drop("_better", "_any")


def authorise(source_group: Column, target_group: Column) -> Column:
    """Equal groups allow; different ones, or one alone, block; without any the manifests decide."""
    return F.when(source_group.isNull() & target_group.isNull(), "defer").when(source_group.eqNullSafe(target_group), "allowed").otherwise("blocked")


def by_manifest(permissions: Column) -> list[Column]:
    """Aggregates over a reference's candidates that say what its manifests permit."""
    return [F.bool_or(permissions == "allowed").alias("any_allowed"), F.bool_or(permissions == "blocked").alias("any_blocked"), F.bool_or(permissions == "unknown").alias("any_unknown")]


def manifest_outcome() -> Column:
    return F.when(F.col("any_allowed"), "keep_allowed").when(F.col("any_blocked") & ~F.col("any_unknown"), "blocked").otherwise("fall_through")


def audit(refs: DataFrame, pattern: list[str]) -> DataFrame:
    """Clusters of references by a pattern of columns: count, files, and the reference with the lowest id as a sample,
    from one aggregation with a partial step."""
    return refs.groupBy(*pattern).agg(F.count(F.lit(1)).alias("n"), F.min("reference_id").alias("first_reference"), F.count_distinct("source_id").alias("files"))


def partition_of(status: Column, target_known: Column) -> Column:
    """A reference's part in the audit; a resolved one whose target is missing counts as unresolved."""
    return F.when((status == "resolved") & ~target_known, "unresolved").when(status == "resolved", "unique").otherwise(status)


def incoming_counts(symbols: DataFrame, refs: DataFrame, min_coverage: int) -> DataFrame:
    """Per symbol the incoming references that are decided, how many more may come, and the count where coverage is
    enough to say it. Candidates and dynamic references count as uncertain for what they may mean, unresolved ones for
    the identity that they name."""
    sure = refs.filter("status = 'resolved'").groupBy(F.col("target_id").alias("symbol_id")).agg(F.count(F.lit(1)).alias("decided"))
    may = refs.filter("status in ('candidate', 'dynamic')").groupBy(F.col("candidate_id").alias("symbol_id")).agg(F.count(F.lit(1)).alias("uncertain"))
    named = refs.filter("status = 'unresolved'").groupBy(F.col("target_identity").alias("identity")).agg(F.count(F.lit(1)).alias("named"))
    rows = symbols.select("symbol_id", "identity").join(sure, "symbol_id", "left").join(may, "symbol_id", "left").join(named, "identity", "left").na.fill(0)
    total = F.col("decided") + F.col("uncertain") + F.col("named")
    pct = F.when(total == 0, F.lit(100)).otherwise(F.floor(F.col("decided") * 100 / total)).cast("long")
    return rows.select("symbol_id", "decided", (F.col("uncertain") + F.col("named")).alias("uncertain"), pct.alias("coverage"), (pct >= min_coverage).alias("known"))

"""Semantic change between two snapshots: pairing, classification, roll-ups and interval arithmetic."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.functions.identity import ancestors


def fingerprint(text: Column, name: Column) -> Column:
    """Hash of a span with its white space collapsed and its own name masked."""
    return F.xxhash64(F.trim(F.regexp_replace(F.replace(text, name, F.lit("\u0001")), r"\s+", " ")))


def pair_exact(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Full outer by a key, with columns of either side as old_* and new_*."""
    o = old.select(F.col(key), *[F.col(c).alias(f"old_{c}") for c in old.columns if c != key])
    n = new.select(F.col(key), *[F.col(c).alias(f"new_{c}") for c in new.columns if c != key])
    return o.join(n, key, "full_outer")


def pair_unique(old: DataFrame, new: DataFrame, key: list[str], id_col: str = "id") -> DataFrame:
    """(key, old_id, new_id) for keys that exactly one old and one new row have. Counts are aggregated on both sides
    before they are joined, so a key that many rows share is a single row there."""
    o = old.groupBy(*key).agg(F.count(F.lit(1)).alias("no"), F.min(id_col).alias("old_id")).filter("no = 1")
    n = new.groupBy(*key).agg(F.count(F.lit(1)).alias("nn"), F.min(id_col).alias("new_id")).filter("nn = 1")
    return o.join(n, key).select(*key, "old_id", "new_id")


def cancel(old: DataFrame, new: DataFrame, key: list[str], order: str) -> tuple[DataFrame, DataFrame]:
    """What is left of two multisets when equal rows are struck out one for one, the last of the new side first."""
    by = ", ".join(f"`{k}`" for k in key)
    o = old.withColumn("_n", F.expr(f"row_number() over (partition by {by} order by `{order}`)"))
    n = new.withColumn("_n", F.expr(f"row_number() over (partition by {by} order by `{order}` desc)"))
    return o.join(n.select(*key, "_n"), [*key, "_n"], "left_anti").drop("_n"), n.join(o.select(*key, "_n"), [*key, "_n"], "left_anti").drop("_n")


def classify(moved: Column, body: Column, signature: Column, attribute: Column) -> Column:
    return F.when(moved, "moved").when(body, "body_modified").when(signature, "signature_changed").when(attribute, "attribute_changed").otherwise("unchanged")


def collapse(unpaired: DataFrame, tail: str) -> DataFrame:
    """Without rows that lie strictly under another unpaired row of their side."""
    above = unpaired.select(F.col(tail).alias("_up"))
    under = unpaired.select(F.col(tail).alias("_own"), F.explode(F.slice(ancestors(tail), 1, F.size(F.split(F.col(tail), "/")) - 1)).alias("_up"))
    covered = under.join(above, "_up", "left_semi").select(F.col("_own").alias(tail)).distinct()
    return unpaired.join(covered, tail, "left_anti")


def retarget(targets: DataFrame, renames: DataFrame) -> DataFrame:
    """(identity, mapped): identities with their longest renamed ancestor put in the new place. renames(old, new)."""
    up = targets.select("identity", F.explode(ancestors("identity")).alias("old"))
    best = up.join(renames, "old").groupBy("identity").agg(F.max_by(F.struct("old", "new"), F.length("old")).alias("r"))
    return best.select("identity", F.concat("r.new", F.expr("substring(identity, length(r.old) + 1)")).alias("mapped"))


def uncovered_pieces(hunks: DataFrame, explained: DataFrame, key: str) -> DataFrame:
    """hunks and explained (key, start, end), end exclusive -> the parts of hunks that nothing explains, cut wherever
    anything starts or ends.

    Starts and ends are events of a sweep in each key's own window; a part runs where hunks are open and explanations
    are not. Events at one place have the same sums (a range frame takes all of them), and only the last of them has a
    successor elsewhere, so they need not be folded first: one exchange by key, one sort, no table of groups. Empty
    spans, and those without an end, hold no lines."""
    def events(df: DataFrame, h: int, e: int) -> DataFrame:
        ends = F.explode(F.array(*[F.struct(F.col(c).alias("at"), F.lit(h * k).alias("h"), F.lit(e * k).alias("e")) for c, k in (("start", 1), ("end", -1))]))
        return df.filter("start < end").select(key, ends.alias("x")).select(key, "x.*")

    points = events(hunks, 1, 0).union(events(explained, 0, 1))
    w = f"over (partition by `{key}` order by at)"
    swept = points.select(key, F.col("at").alias("start"), F.expr(f"lead(at) {w}").alias("end"), F.expr(f"sum(h) {w}").alias("h"), F.expr(f"sum(e) {w}").alias("e"))
    return swept.filter("h > 0 and e = 0 and end > start").select(key, "start", "end")


def uncovered(hunks: DataFrame, explained: DataFrame, key: str) -> DataFrame:
    """The pieces with those that meet made one."""
    runs = uncovered_pieces(hunks, explained, key).withColumn("fresh", F.expr(f"coalesce(lag(end) over (partition by `{key}` order by start) <> start, true)").cast("int"))
    runs = runs.withColumn("run", F.expr(f"sum(fresh) over (partition by `{key}` order by start)"))
    return runs.groupBy(key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def overlapping(symbols: DataFrame, hunks: DataFrame, key: str, width: int = 32) -> DataFrame:
    """Symbols and hunks of the same key whose inclusive line ranges meet, by buckets of lines: an equi-join, in which a
    pair is kept in the first bucket that it shares."""
    def bucketed(df: DataFrame, a: str, b: str) -> DataFrame:
        return df.withColumn("_b", F.explode(F.sequence(F.floor(F.col(a) / width), F.floor(F.col(b) / width))))

    s = bucketed(symbols.filter("start_line is not null"), "start_line", "end_line")
    h = bucketed(hunks, "from_line", "to_line")
    both = s.join(h, [key, "_b"]).filter("start_line <= to_line and from_line <= end_line")
    return both.filter(F.col("_b") == F.floor(F.greatest("start_line", "from_line") / width)).drop("_b")

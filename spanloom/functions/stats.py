"""Statistics with the assertion language's rules for empty and missing input."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def total(x: Column) -> Column:
    """Sum, 0 where there is nothing."""
    return F.coalesce(F.sum(x), F.lit(0))


def count_pass(p: Column) -> Column:
    """How many items pass; an item that is not applicable doesn't."""
    return F.count_if(F.coalesce(p, F.lit(False)))


def percentile(x: Column, p: float) -> Column:
    """Interpolated at rank p/100 * (n - 1); null outside 0 to 100."""
    return F.percentile(x, F.lit(p / 100.0)) if 0 <= p <= 100 else F.lit(None).cast("double")


def median(x: Column) -> Column:
    return percentile(x, 50)


def variance(x: Column) -> Column:
    return F.var_pop(x)


def cv(x: Column) -> Column:
    """Population deviation over the mean's size; null at mean 0."""
    return F.stddev_pop(x) / F.nullif(F.abs(F.avg(x)), F.lit(0))


def whole(agg: Column, x: Column) -> Column:
    """A group's statistic is unavailable as soon as one member has no value."""
    return F.when(F.count(x) == F.count(F.lit(1)), agg)


def floor_percent(part: Column, of: Column) -> Column:
    """Integer percentage rounded down; of nothing, 100."""
    return F.when(of == 0, F.lit(100)).otherwise(F.floor(part * 100 / of)).cast("long")


def gini(df: DataFrame, keys: list[str], x: str, name: str = "gini") -> DataFrame:
    """Per key: null with a negative value, 0 where all is 0, else 2 sum(i x_i) / (n sum x) - (n + 1) / n, x ascending.

    Equal values are counted first, so a key's rank window has a row for each distinct value and not for each row."""
    by = ", ".join(f"`{k}`" for k in keys) or "1"
    counted = df.filter(F.col(x).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias("_x")).agg(F.count(F.lit(1)).alias("_c"))
    before = counted.withColumn("_b", F.expr(f"coalesce(sum(_c) over (partition by {by} order by _x rows between unbounded preceding and 1 preceding), 0)"))
    # a run of c equal values after b others has ranks b + 1 to b + c
    ranked = before.withColumn("_r", F.col("_x") * (F.col("_c") * F.col("_b") + F.col("_c") * (F.col("_c") + 1) / 2))
    agg = ranked.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.sum(F.col("_x") * F.col("_c")).alias("_s"), F.min("_x").alias("_m"), F.sum("_r").alias("_w"))
    value = F.when(F.col("_m") < 0, F.lit(None)).when(F.col("_s") == 0, F.lit(0.0)).otherwise(2 * F.col("_w") / (F.col("_n") * F.col("_s")) - (F.col("_n") + 1) / F.col("_n"))
    return agg.select(*keys, value.cast("double").alias(name))


def entropy(df: DataFrame, keys: list[str], value: str, name: str = "entropy") -> DataFrame:
    """Per key: Shannon entropy over the log of the number of values; 0 for one value."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"))
    # H = log2 n - sum(c log2 c) / n
    agg = counted.groupBy(*keys).agg(F.sum("_c").alias("_n"), F.sum(F.col("_c") * F.log2("_c")).alias("_l"), F.count(F.lit(1)).alias("_k"))
    h = F.log2("_n") - F.col("_l") / F.col("_n")
    return agg.select(*keys, F.when(F.col("_k") <= 1, F.lit(0.0)).otherwise(h / F.log2("_k")).alias(name))


def mode(df: DataFrame, keys: list[str], value: str, order: str, name: str = "mode") -> DataFrame:
    """Per key the most frequent value; of equals the one met first in the given order."""
    counted = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_c"), F.min(order).alias("_f"))
    return counted.groupBy(*keys).agg(F.max_by(value, F.struct("_c", -F.col("_f"))).alias(name))


def count_by(df: DataFrame, column: str, name: str = "n") -> DataFrame:
    """Value and count, most frequent first, then by value."""
    return df.groupBy(column).agg(F.count(F.lit(1)).alias(name)).orderBy(F.desc(name), column)

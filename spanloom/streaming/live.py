"""Live refresh: change batches fold into generation-stamped tables, as batch functions and as streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MANIFESTS = ("package.json", "Cargo.toml", "pyproject.toml", "pom.xml", "go.mod", "build.gradle")


def classify_path(path: Column) -> Column:
    """source, manifest, notes, git_base or rescan for a changed path."""
    name = F.substring_index(path, "/", -1)
    return (
        F.when(path.contains(".git/"), F.when(name.isin("HEAD", "index"), "git_base").otherwise("ignored"))
        .when(name.isin(*MANIFESTS), "manifest")
        .when(path.contains("notes") & name.endswith(".json"), "notes")
        .when(name.isin(".gitignore", ".ignore"), "rescan")
        .otherwise("source")
    )


def coalesce_events(events: DataFrame, seconds: int) -> DataFrame:
    """Events merged by user and span of time: a partial step folds them where they lie."""
    rows = events.select("user_id", "event_type", "event_id", F.floor(F.unix_timestamp(F.col("ts").cast("timestamp")) / seconds).cast("long").alias("batch"))
    return rows.groupBy("user_id", "batch").agg(
        F.count(F.lit(1)).alias("n"),
        F.bool_or(F.col("event_type") == "purchase").alias("rescan"),
        F.array_join(F.sort_array(F.collect_set("event_type")), ",").alias("kinds"),
        F.min("event_id").alias("first_event"),
    )


def current(rows: DataFrame, key: list[str], generation: str = "generation") -> DataFrame:
    """Of each key the row of the highest generation, by an aggregation with a partial step."""
    rest = [c for c in rows.columns if c not in (*key, generation)]
    best = rows.groupBy(*key).agg(F.max(generation).alias(generation), *[F.max_by(c, generation).alias(c) for c in rest])
    return best.select(*rows.columns)


def refresh(table: DataFrame, changed: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """A new generation: rows of changed or removed keys go, the changed ones come in anew, all others stay as they are."""
    touched = changed.select(key).union(removed.select(key)).distinct()
    return table.join(touched, key, "left_anti").unionByName(changed)


def refold(groups: DataFrame, old: DataFrame, new: DataFrame, key: str, fold: Callable[[DataFrame], DataFrame], members: DataFrame) -> DataFrame:
    """Grouped results after a change: only the keys that rows left or joined are folded again."""
    touched = old.select(key).union(new.select(key)).distinct()
    return groups.join(touched, key, "left_anti").unionByName(fold(members.join(touched, key, "left_semi")))


def pick_generation(available: DataFrame, mode: str, stale: bool) -> DataFrame:
    """current and refresh_if_stale want the newest generation (the latter asks for a refresh first); stale_ok takes what is there."""
    if mode not in ("current", "refresh_if_stale", "stale_ok"):
        raise ValueError(f"unknown consistency {mode!r}")
    return available.agg(F.max("generation").alias("generation")).withColumn("refresh", F.lit(stale and mode != "stale_ok"))


def watch(spark, path: str, schema: str, apply: Callable[[DataFrame, int], None], checkpoint: str):
    """A stream over a folder of change files: each micro-batch is coalesced by path and handed to apply with its number."""
    rows = spark.readStream.schema(schema).parquet(path)

    def fold(batch: DataFrame, number: int) -> None:
        merged = batch.groupBy("path").agg(F.max_by("kind", "cursor").alias("kind"), F.max("cursor").alias("cursor"))
        apply(merged.withColumn("class", classify_path(F.col("path"))), number)

    return rows.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def subscribe(events: DataFrame, after: int) -> DataFrame:
    """Events beyond a cursor, in order; the filter reaches the scan."""
    return events.filter(F.col("cursor") > after).orderBy("cursor")

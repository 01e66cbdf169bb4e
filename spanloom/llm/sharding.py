"""Sharding by sampled splitters: quantiles of a size-weighted key sample cut the records into ranges of known weight."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType

from .common import NO_ID, row_id, stage, text_of

#: Ranges a shard, keys sampled a range (expected), bytes beyond which a range is subdivided, as a multiple of its share.
FINE, SAMPLED, OVERFULL = 32, 4, 4.0
#: Groups of equal texts beyond this part of a shard are placed one by one.
LARGE = 1 / 20


def _range_of(splitters: np.ndarray):
    """A column function (key, tie) -> range, for splitters sorted by key and tie: the number of splitters at or below."""
    keys, ties = splitters[:, 0].copy(), splitters[:, 1].copy()

    @F.pandas_udf(IntegerType())
    def place(key: pd.Series, tie: pd.Series) -> pd.Series:
        k, t = key.to_numpy(np.int64), tie.to_numpy(np.int64)
        low, high = np.searchsorted(keys, k, "left"), np.searchsorted(keys, k, "right")
        out = low.copy()
        for a in np.unique(low[high > low]):  # keys that were sampled themselves: ties decide
            rows = np.flatnonzero((low == a) & (high > a))
            out[rows] = a + np.searchsorted(ties[a : high[rows[0]]], t[rows], "right")
        return pd.Series(out)

    return place


def _sample(rows: DataFrame, rate: Column) -> list:
    """Keys drawn with a probability in proportion to size, by a hash of the row, so that a task run again draws the same."""
    lot = F.pmod(F.xxhash64("_key", "_tie", F.lit(1)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return [tuple(r) for r in rows.filter(lot < rate * F.col("size")).select("_key", "_tie").distinct().collect()]


def splitters(rows: DataFrame, ranges: int, total: int) -> np.ndarray:
    """rows(_key, _tie, size) -> sorted splitters. About ranges * SAMPLED keys are drawn, the quantiles of which are the
    first splitters; a range that then weighs more than OVERFULL shares is sampled again by itself and subdivided,
    so that dense keys, or one key with many rows, end up in ranges of bounded weight."""
    drawn = sorted(_sample(rows, F.lit(ranges * SAMPLED / max(total, 1))))
    found = drawn[SAMPLED - 1 :: SAMPLED]
    share = total / ranges
    while found:
        ranged = rows.withColumn("_range", _range_of(np.array(found, np.int64))("_key", "_tie"))
        weights = ranged.groupBy("_range").agg(F.sum("size").alias("w"), F.count(F.lit(1)).alias("n")).filter((F.col("w") > OVERFULL * share) & (F.col("n") > 1)).collect()
        if not weights:
            break
        rate = F.element_at(F.create_map(*[x for r in weights for x in (F.lit(r._range), F.lit(SAMPLED * max(2.0, r.w / share) / r.w))]), F.col("_range"))
        dense = ranged.filter(F.col("_range").isin([r._range for r in weights]))
        more = {k for k in _sample(dense, rate)} - set(found)
        if not more:
            break
        found = sorted({*found, *more})
    return np.array(found, np.int64).reshape(-1, 2)


def _plan(big: list[tuple[int, int, int]], total: int, shards: int):
    """big: (first place, bytes, bytes of a row) of the groups that are placed one by one, sorted; total: bytes of all rows.

    Returns a function of places (numpy, in bytes from 0) to (shard, run). Groups go whole to the shard with the least
    so far, largest first; only one larger than a shard is cut, between rows, into parts of at most a shard. The rest
    fills the shards up to one level, in its own order. A run is a stretch of rows that lie together in a shard."""
    share = max(total / shards, 1)
    first = np.array([g[0] for g in big], np.int64)
    weight = np.array([g[1] for g in big], np.int64)
    row = np.array([g[2] for g in big], np.int64)
    rows = weight // np.maximum(row, 1)
    parts = np.maximum(1, np.ceil(weight / share)).astype(np.int64)
    each = -(-rows // np.minimum(parts, np.maximum(rows, 1)))  # rows in a part
    pieces = [(int(min(each[k], rows[k] - p * each[k]) * row[k]), k, p) for k in range(len(big)) for p in range(-(-int(rows[k]) // int(each[k])))]
    load, to = np.zeros(shards), {}
    for w, k, p in sorted(pieces, key=lambda x: (-x[0], x[1], x[2])):
        to[k, p] = s = int(np.argmin(load))
        load[s] += w
    base = np.concatenate([[0], np.cumsum([sum(1 for q in pieces if q[1] == k) for k in range(len(big))])]).astype(np.int64)
    target = np.array([to[k, p] for _, k, p in sorted(pieces, key=lambda x: (x[1], x[2]))], np.int64)
    # the level up to which the rest fills: where what fits below it is the rest
    rest, order = total - int(weight.sum()), np.sort(load)
    filled = np.arange(1, shards + 1) * order - np.cumsum(order)
    n = int(np.searchsorted(filled, rest, "right"))
    level = (rest + order[:n].sum()) / max(n, 1)
    ends = np.cumsum(np.maximum(level - load, 0))
    gone = np.concatenate([[0], np.cumsum(weight)])

    def place(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        k = np.searchsorted(first, at, "right") - 1
        inside = (k >= 0) & (at < (first[k] + weight[k] if len(first) else 0))
        shard = np.minimum(np.searchsorted(ends, at - gone[k + 1] + 0.5, "left"), shards - 1)
        run = (k + 1) * 2 * shards + shard
        if inside.any():
            own = k[inside]
            piece = base[own] + (at[inside] - first[own]) // row[own] // each[own]
            shard[inside] = target[piece]
            run[inside] = -1 - piece
        return shard, run

    return place


def shard(docs: DataFrame, shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, law ('bytes'), shard, slot and grown_shard (null): one row for each input row.

    Sizes (bytes of the text and 16) are near equal in all shards. The sort key is a hash of the text, so equal texts lie
    together and go to one shard. Groups over a twentieth of a shard, of which there are at most twenty a shard, are
    dealt out one by one, whole unless they are larger than a shard; all else follows in its order and evens the
    shards out, and a small group stays with its first row. Splitters from a size-weighted sample cut the key space into
    ranges that are sorted and added up in tasks of their own; a range's offset is the sum of the ranges before it. The
    text itself is read once and not shuffled: the rows that move hold a key, an id and a size.

    Null text has no bytes. A null id sorts last and is carried along. Rows that repeat id and text each have a slot.
    Other columns are ignored. An empty table gives an empty result.
    """
    text = text_of(text_col)
    rows = stage(
        docs.select(
            row_id(id_col).alias("_id"),
            F.xxhash64(text).alias("_key"),
            # first more of the text, so that equal texts lie together, then the id
            F.shiftleft(F.xxhash64(F.md5(text)).bitwiseAND(0x7FFFFFFF), 32).bitwiseOR(F.xxhash64(row_id(id_col)).bitwiseAND(0xFFFFFFFF)).alias("_tie"),
            (F.octet_length(text) + 16).cast("long").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
        )
    )
    total = rows.agg(F.sum("size")).first()[0] or 0
    cuts = splitters(rows, shards * FINE, total)
    where = _range_of(cuts)("_key", "_tie") if len(cuts) else F.lit(0)
    ranged = rows.withColumn("_range", where)
    sums = ranged.groupBy("_range").agg(F.sum("size").alias("_w"), F.count(F.lit(1)).alias("_n"))
    # one row a range: as many as there are splitters
    before = sums.select(
        "_range",
        F.expr("coalesce(sum(_w) over (order by _range rows between unbounded preceding and 1 preceding), 0)").alias("_w0"),
        F.expr("coalesce(sum(_n) over (order by _range rows between unbounded preceding and 1 preceding), 0)").alias("_n0"),
    )
    order = "partition by _range order by _key, _tie, _id rows between unbounded preceding and 1 preceding"
    placed = ranged.withColumn("_w1", F.expr(f"coalesce(sum(size) over ({order}), 0)")).withColumn("_n1", F.expr(f"coalesce(count(1) over ({order}), 0)"))
    same = F.shiftright("_tie", 32).alias("_text")  # with the key, 95 bits of the text; the size tells further
    placed = stage(placed.join(before, "_range").select("_id", "_key", same, "size", "text_crc32", (F.col("_w0") + F.col("_w1")).alias("_at"), (F.col("_n0") + F.col("_n1")).alias("_row")))
    text_key = ["_key", "_text", "size"]
    groups = placed.groupBy(*text_key).agg(F.sum("size").alias("_group"), F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_members")).filter("_members > 1")
    groups = stage(groups)
    share = max(total / shards, 1)
    large = F.col("_group") > share * LARGE
    big = [tuple(r) for r in groups.filter(large).orderBy("_first").select("_first", "_group", "size").collect()]  # at most shards / LARGE
    plan = _plan(big, total, shards)

    @F.pandas_udf("shard int, run long")
    def to_shard(at: pd.Series) -> pd.DataFrame:
        found, run = plan(at.to_numpy(np.int64))
        return pd.DataFrame({"shard": found.astype(np.int32), "run": run})

    placed = placed.join(groups.filter(~large).select(*text_key, "_first"), text_key, "left").withColumn("_to", to_shard(F.coalesce("_first", "_at")))
    sharded = stage(placed.select("_id", "size", "text_crc32", "_row", F.col("_to.shard").alias("shard"), F.col("_to.run").alias("_run")))
    # runs: at most one for each part of a large group, and one for each shard and gap between them that it fills
    runs = sharded.groupBy("shard", "_run").agg(F.min("_row").alias("_base"), F.count(F.lit(1)).alias("_n"))
    runs = runs.select("shard", "_run", "_base", F.expr("coalesce(sum(_n) over (partition by shard order by _base rows between unbounded preceding and 1 preceding), 0)").alias("_before"))
    return sharded.join(F.broadcast(runs), ["shard", "_run"]).select(
        F.when(F.col("_id") != NO_ID, F.col("_id")).alias("doc_id"),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("_row") - F.col("_base") + F.col("_before")).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def write_shards(docs: DataFrame, assigned: DataFrame, path: str, id_col: str = "doc_id") -> None:
    """Writes the records in a folder for each shard, by slot. Needs ids that are unique and not null."""
    places = assigned.select(F.col("doc_id").alias("_id"), "shard", "slot")
    clear = [c for c in docs.columns if c not in ("shard", "slot", "_id")]
    rows = docs.select(*[F.col(f"`{c}`") for c in clear]).join(places, F.col(f"`{id_col}`") == F.col("_id")).drop("_id")
    rows.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)

"""Embedding near-dedup: Euclidean p-stable hashing in several tables, then exact cosine checks inside the buckets."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import NO_ID, row_id, stage
from .components import components

#: Tables, projections a table, and bucket width on the unit sphere. Two vectors at cosine 0.98 (distance 0.2) share a
#: projection's interval with probability 0.90, a table's bucket with 0.43, and no bucket of 16 tables with 0.0001.
TABLES, PROJECTIONS, WIDTH = 16, 8, 1.6
SEED = 20240521
#: A bucket of more rows is split into blocks of half as many, which meet pair by pair in tasks of their own.
CROWDED = 4096

_ROWS = "_table int, _bucket int, _x int, _y int, _mine int, _class long, _copies long, _kind string, _keys binary, _vector binary"


def _random(dim: int, tables: int, projections: int, width: float):
    rng = np.random.default_rng([SEED, dim])
    return rng.standard_normal((dim, tables * projections)), rng.uniform(0, width, tables * projections)


def _hash_batches(batches, tables: int, projections: int, width: float, kind: str):
    """Per class: the 32-bit bucket of each table, as int32 bytes, and the vector's bytes."""
    drawn = {}
    for batch in batches:
        keys, vectors = [], []
        for values in batch.column("_vec"):
            v = np.asarray(values.values.to_numpy(zero_copy_only=False), kind)
            x = v.astype(np.float64)
            x /= np.abs(x).max()
            if len(x) not in drawn:
                drawn[len(x)] = _random(len(x), tables, projections, width)
            a, b = drawn[len(x)]
            cells = np.floor((x / np.linalg.norm(x) @ a + b) / width).astype(np.int64).reshape(tables, projections)
            h = np.full(tables, 0x51ED270B, np.uint64)
            with np.errstate(over="ignore"):
                for k in range(projections):
                    h = (h ^ cells[:, k].astype(np.uint64)) * np.uint64(0x9FB21C651E98DF25)
                    h ^= h >> np.uint64(29)
            keys.append((h & np.uint64(0xFFFFFFFF)).astype(np.uint32).tobytes())
            vectors.append(v.tobytes())
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in ("_class", "_copies", "_kind")), pa.array(keys, pa.binary()), pa.array(vectors, pa.binary())],
            ["_class", "_copies", "_kind", "_keys", "_vector"],
        )


def _scatter(batches, tables: int):
    """A row for each table; in a crowded bucket of g blocks, one for each pair of blocks that the row's block is in."""
    for batch in batches:
        out = []
        for cls, copies, kind, keys, vector, crowded in zip(*(batch.column(c).to_pylist() for c in ("_class", "_copies", "_kind", "_keys", "_vector", "_crowded"))):
            blocks = {c["_table"]: c["_blocks"] for c in crowded or ()}
            buckets = np.frombuffer(keys, np.int32).tolist()
            for t in range(tables):
                g = blocks.get(t, 1)
                mine = (cls * 0x9E3779B97F4A7C15 >> 20) % g
                for other in range(g):
                    out.append((t, buckets[t], min(mine, other), max(mine, other), mine, cls, copies, kind, keys, vector))
        kinds = (pa.int32(),) * 5 + (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary())
        names = [x.split()[0] for x in _ROWS.split(", ")]
        for a in range(0, len(out), 20_000):
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out[a : a + 20_000]), kinds)], names)


def _compare(rows: list, table: int, least: float, kind: str):
    """(class, links first found in this table, least class it hangs on) for the rows of one bucket or pair of blocks."""
    rows.sort(key=lambda r: (r[0], r[1]))
    mine = np.array([r[0] for r in rows])
    classes, copies = np.array([r[1] for r in rows], np.int64), np.array([r[2] for r in rows], np.int64)
    keys = np.frombuffer(b"".join(r[3] for r in rows), np.int32).reshape(len(rows), -1)
    vectors = np.frombuffer(b"".join(r[4] for r in rows), kind).reshape(len(rows), -1).astype(np.float64)
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)
    norms = np.linalg.norm(vectors, axis=1)
    counts, hung = np.zeros(len(rows), np.int64), np.arange(len(rows))
    split = int(np.searchsorted(mine, mine[0], "right"))
    pairs = [(0, len(rows), 0, len(rows))] if split == len(rows) else [(0, split, split, len(rows))]
    found = []
    for a, b, c, d in pairs:
        for s in range(a, b, 512):
            e = min(b, s + 512)
            cos = vectors[s:e] @ vectors[c:d].T / (norms[s:e, None] * norms[None, c:d])
            i, j = np.nonzero(cos >= least)
            i, j = i + s, j + c
            if (a, b) == (c, d):
                i, j = i[i < j], j[i < j]
            if not len(i):
                continue
            new = np.ones(len(i), bool)
            for t in range(table):
                new &= keys[i, t] != keys[j, t]
            np.add.at(counts, i[new], copies[j[new]])
            np.add.at(counts, j[new], copies[i[new]])
            found.append((i, j))
    if not found:
        return []
    i, j = (np.concatenate(x) for x in zip(*found))
    while True:  # each row hangs on the least row that its links reach within the bucket
        before = hung.copy()
        np.minimum.at(hung, j, hung[i])
        np.minimum.at(hung, i, hung[j])
        hung = hung[hung]
        if (hung == before).all():
            break
    touched = np.unique(np.concatenate([i, j]))
    return [(int(classes[k]), int(counts[k]), int(classes[hung[k]])) for k in touched]


def _buckets(batches, least: float, kind: str):
    now, held = None, []
    schema = [("_class", pa.int64()), ("_n", pa.int64()), ("_root", pa.int64())]

    def batch_of(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(list(zip(*out)) or [[]] * 3, schema)], [n for n, _ in schema])

    for batch in batches:
        out = []
        columns = ("_table", "_bucket", "_x", "_y", "_kind", "_mine", "_class", "_copies", "_keys", "_vector")
        for *key, mine, cls, copies, keys, vector in zip(*(batch.column(c).to_pylist() for c in columns)):
            if key != now:
                if len(held) > 1:
                    out += _compare(held, now[0], least, kind)
                now, held = key, []
            held.append((mine, cls, copies, keys, vector))
        yield batch_of(out)
    if len(held) > 1:
        yield batch_of(_compare(held, now[0], least, kind))


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cosine: float = 0.98,
    tables: int = TABLES,
    projections: int = PROJECTIONS,
    width: float = WIDTH,
    crowded: int = CROWDED,
) -> DataFrame:
    """One row per input row: vec_id, n_links, component_id, kept.

    Vectors with equal labels and lengths are linked where a bucket of some table holds both and their cosine in
    double precision is at least the threshold; none below it is linked. n_links counts the other rows linked
    directly; component_id is the smallest id reachable; kept is true where that is the row's own id.

    Equal vectors of a label are one class with a number of copies, so copies never meet each other. A bucket
    compares its classes in blocks of matrix products and gives, per class, a count and one link towards the
    least class reached: pairs leave no task. A pair counts only in the first table in which it meets. Buckets
    over the bound are split into blocks that meet pair by pair, and no task holds more than two blocks.

    A vector that is null, empty, zero, or has null or non-finite components, or whose label is null, links with
    nothing and is its own component. A null id counts as the largest and comes back as null. Rows that share an id
    count as separate vectors under one name. Other columns are ignored. An empty table gives an empty result.
    """
    is_float = isinstance(vectors.schema[vector_col].dataType, ArrayType) and isinstance(vectors.schema[vector_col].dataType.elementType, FloatType)
    kind = "<f4" if is_float else "<f8"
    typed = F.col(f"`{vector_col}`").cast("array<float>" if is_float else "array<double>")
    rows = vectors.select(row_id(id_col).alias("_id"), typed.alias("_vec"), F.col(f"`{label_col}`").cast("string").alias("_label"))
    finite = "forall(_vec, x -> x is not null and not isnan(x) and abs(x) < double('infinity')) and exists(_vec, x -> x <> 0)"
    rows = rows.withColumn("_ok", F.expr(f"coalesce(_label is not null and size(_vec) > 0 and {finite}, false)"))
    classes = rows.filter("_ok").groupBy("_label", "_vec").agg(F.min("_id").alias("_class"), F.count(F.lit(1)).alias("_copies"))
    classes = stage(classes.withColumn("_kind", F.concat_ws(" ", F.size("_vec"), "_label")))
    shape = dict(tables=tables, projections=projections, width=width, kind=kind)
    hashed = stage(
        classes.select("_class", "_copies", "_kind", "_vec").mapInArrow(partial(_hash_batches, **shape), "_class long, _copies long, _kind string, _keys binary, _vector binary")
    )
    places = hashed.select("_class", "_kind", F.expr(f"posexplode(transform(sequence(0, {tables - 1}), i -> hex(substring(_keys, 4 * i + 1, 4))))").alias("_table", "_key"))
    sizes = places.groupBy("_kind", "_table", "_key").count().filter(F.col("count") > crowded)
    blocks = sizes.select("_kind", "_table", "_key", F.ceil(F.col("count") / (crowded / 2)).cast("int").alias("_blocks"))
    spread = places.join(blocks, ["_kind", "_table", "_key"]).groupBy("_class", "_kind").agg(F.collect_list(F.struct("_table", "_blocks")).alias("_crowded"))
    scattered = hashed.join(spread, ["_class", "_kind"], "left").mapInArrow(partial(_scatter, tables=tables), _ROWS)
    met = (
        scattered.repartition("_table", "_bucket", "_x", "_y", "_kind")
        .sortWithinPartitions("_table", "_bucket", "_x", "_y", "_kind")
        .mapInArrow(partial(_buckets, least=cosine, kind=kind), "_class long, _n long, _root long")
    )
    met = stage(met.groupBy("_class", "_root").agg(F.sum("_n").alias("_n")))
    roots = components(met.select(F.col("_class").alias("u"), F.col("_root").alias("v")))
    counts = met.groupBy("_class").agg(F.sum("_n").alias("_n"))
    named = (
        classes.select("_label", "_vec", "_class", "_copies")
        .join(counts, "_class", "left")
        .join(roots, F.col("_class") == F.col("node"), "left")
        .select("_label", "_vec", (F.coalesce("_n", F.lit(0)) + F.col("_copies") - 1).alias("n_links"), F.coalesce("root", "_class").alias("_component"))
    )
    unnull = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    linked = rows.filter("_ok").join(named, ["_label", "_vec"]).select("_id", "n_links", "_component")
    alone = rows.filter("not _ok").select("_id", F.lit(0).cast("long").alias("n_links"), F.col("_id").alias("_component"))
    return linked.union(alone).select(
        unnull("_id").alias("vec_id"), "n_links", unnull("_component").alias("component_id"), (F.col("_id") == F.col("_component")).alias("kept")
    )

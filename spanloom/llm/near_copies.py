"""Near copies by SimHash fingerprints with a check of similarity, and by the Jaccard similarity of sets of word shingles for all that fingerprints miss.

Fingerprints are linked as in simhash; sets by an exact join by prefixes, in order of hashes and then rarest first.
"""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, release_shuffles, row_id, stage, text_of
from .components import components
from .simhash import links as fingerprint_links
from .simhash import majorities, shingle_hashes, text_chunks

#: Sets are near copies if 5 * |both| >= 4 * |either|: a similarity of 0.8 or more, in whole numbers. The bands of sizes in _pairs are made for it.
_NEAR = "9L * {both} >= 4L * (a._n + b._n)"


def _least_of(n):
    """How many shingles, at least, a near copy has of a set of n."""
    return (4 * n + 4) // 5


def _common(n):
    """Of how many shingles that it has in common with a near copy a set of n shows the first, in the order of hashes."""
    return n // 10 + 1


def _numbered(hashes: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Of hashes in order within each text: one hash of each and of how many like it came before in its text."""
    first = np.ones(len(hashes), bool)
    first[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
    at = np.arange(len(hashes))
    before = (at - np.maximum.accumulate(np.where(first, at, 0))).astype(np.uint64)
    x = before * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return hashes ^ (x ^ (x >> np.uint64(29)))


def _fps(hashes: np.ndarray, n: np.ndarray) -> list[int]:
    """A hash of each text's hashes, of which n belong to each."""
    ends = np.cumsum(n)
    return [xxhash.xxh64_intdigest(hashes[e - k : e].tobytes()) for e, k in zip(ends.tolist(), n.tolist())]


def _set_batches(batches, shingle: int, heads: bool, repeats: bool):
    for batch in batches:
        fps, bags, sims, counts, sets = [], [], [], [], []
        for buf, offsets in text_chunks(batch.column("_text")):
            hashes, shingles = shingle_hashes(buf, offsets, shingle)
            text = np.repeat(np.arange(len(shingles)), shingles)
            order = np.lexsort((hashes, text))
            if heads:
                sims.append(majorities(hashes, shingles))
                bags += _fps(hashes[order], shingles)
            hashes, text = hashes[order], text[order]
            if repeats:
                hashes = _numbered(hashes, text)
                order = np.lexsort((hashes, text))
                hashes = hashes[order]
            first = np.ones(len(hashes), bool)
            first[1:] = (hashes[1:] != hashes[:-1]) | (text[1:] != text[:-1])
            hashes, n = hashes[first], np.bincount(text[first], minlength=len(shingles))
            ends = np.cumsum(n)
            fps += _fps(hashes, n)
            counts.append(n)
            if heads:
                hashes = hashes[np.arange(len(hashes)) - np.repeat(ends - n, n) < np.repeat(n - _least_of(n) + _common(n), n)]
            sets.append(hashes.view(np.int64))
        n = np.concatenate(counts or [np.zeros(0, np.int64)])
        ends = np.concatenate([[0], np.cumsum(np.minimum(n, n - _least_of(n) + _common(n)) if heads else n)]).astype(np.int32)
        values = pa.array(np.concatenate(sets or [np.zeros(0, np.int64)]))
        columns = [batch.column("_id"), batch.column("_key"), pa.array(np.array(fps, np.uint64).view(np.int64)), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(ends, values)]
        names = ["_id", "_key", "_fp", "_n", "_set"]
        if heads:
            columns += [pa.array(np.array(bags, np.uint64).view(np.int64)), pa.array(np.concatenate(sims or [np.zeros(0, np.int64)]))]
            names += ["_bag", "_sim"]
        yield pa.RecordBatch.from_arrays(columns, names)


def shingle_sets(docs: DataFrame, id_col: str, text_col: str, shingle: int, heads: bool = False, repeats: bool = False) -> DataFrame:
    """(_id, _key, _fp, _n, _set) for each row: a hash of the text, one of its set of shingles, and the set's size and
    hashes. Words and short texts are as for fingerprints in simhash; a text without words has the empty set. With heads,
    _set has only the smallest hashes: those among which the first _common(_n) common to any near copy are; and there are
    _bag, a hash of the shingles with their repeats, and _sim, the SimHash fingerprint, too. With repeats, a shingle's
    second occurrence in a text counts as another shingle, and so on."""
    rows = docs.select(row_id(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_key"), text_of(text_col).alias("_text"))
    return rows.mapInArrow(partial(_set_batches, shingle=shingle, heads=heads, repeats=repeats), "_id long, _key long, _fp long, _n int, _set array<long>" + ", _bag long, _sim long" * heads)


def _shingles(sets: DataFrame) -> DataFrame:
    """(_fp, _n, _h, _df) for each shingle that two different sets have, with its frequency. Sets of up to three have no near copies but their like."""
    w = "over (partition by _h)"
    rows = sets.filter("_n >= 4").select("_fp", "_n", F.explode("_set").alias("_h"))
    return rows.select("_fp", "_n", "_h", F.expr(f"count(1) {w}").alias("_df"), F.expr(f"min(_fp) {w} <> max(_fp) {w}").alias("_both")).filter("_both").drop("_both")


def _able(heads: DataFrame) -> DataFrame:
    """(_fp) of the sets that can have a near copy, as their heads say.

    A set of n and a near copy have at least 4/5 of n in common, so that the first q common hashes are among the first
    n/5 + q of either. The near copy, of 4/5 of n at least, shows as many as its own size asks for. Copies of one set
    are counted each, which only lets more pass."""
    return _shingles(heads).groupBy("_fp", "_n").count().filter("count >= (4 * _n + 4) div 5 div 10 + 1").select("_fp")


def _shared(sets: DataFrame) -> DataFrame:
    """(_fp, _n, _in): for each distinct set that can have a near copy, its shingles that other sets have too, rarest first.

    What no other set has is in no intersection, so that a set with too few others is left out. Copies of one
    set add to a shingle's frequency, which only has to give all sets the same order."""
    rows = _shingles(sets).groupBy("_fp", "_n").agg(F.sort_array(F.collect_set(F.struct("_df", "_h"))).alias("_in"))
    return rows.filter("size(_in) >= (4 * _n + 4) div 5").select("_fp", "_n", F.expr("_in._h").alias("_in"))


def _pairs(shared: DataFrame) -> DataFrame:
    """(u, v) of all pairs that may be near copies, from their prefixes.

    A near copy has at least 4/5 of a set's n shingles, so at most n/5 lie before the first common one, in an
    order that both follow. Those that no other set has come first of all and are not listed. Behind the first
    common one, enough must be left in both for the intersection. Sizes differ by at most 1.25, so by at
    most one band of 1.3, which is part of the key."""
    rows = shared.select("_fp", "_n", F.size("_in").alias("_k"), F.posexplode(F.expr("slice(_in, 1, size(_in) - (4 * _n + 4) div 5 + 1)")).alias("_i", "_h"))
    rows = rows.select("_fp", "_n", F.expr("_k - _i").alias("_rest"), "_h", F.expr("cast(floor(ln(_n) / ln(1.3)) as int)").alias("_band"))
    larger = rows.withColumn("_band", F.explode(F.array(F.col("_band"), F.col("_band") - 1)))
    near = F.expr("(a._n < b._n or (a._n = b._n and a._fp < b._fp)) and " + _NEAR.format(both="least(a._rest, b._rest)"))
    return rows.alias("a").join(larger.alias("b"), [F.expr("a._h = b._h"), F.expr("a._band = b._band"), near]).select(F.col("a._fp").alias("u"), F.col("b._fp").alias("v")).distinct()


def links(sets: DataFrame) -> DataFrame:
    """sets(_fp, _n, _set), repeats allowed -> edges (u, v) of all pairs of different sets with a similarity of 0.8 or more."""
    shared = stage(_shared(sets))
    a = _pairs(shared).join(shared.withColumnRenamed("_fp", "u").withColumnRenamed("_n", "_m").withColumnRenamed("_in", "_x"), "u")
    found = a.join(shared.withColumnRenamed("_fp", "v"), "v").filter("9L * size(array_intersect(_x, _in)) >= 4L * (_m + _n)").select("u", "v")
    out = stage(found)
    release(shared)
    return out


def by_fingerprint(units: DataFrame, distance: int) -> DataFrame:
    """units(_bag, _sim, _root, _least) -> (_u, _v, _least_u, _least_v, _root_u, _root_v): all pairs of bags with fingerprints
    of at most distance differing bits that aren't in one group yet.

    Fingerprints meet first, then their groups, and only those of different groups their bags."""
    here = stage(units.select("_sim", "_root").distinct())
    sims = here.select("_sim").distinct()
    pairs = fingerprint_links(sims.select(F.col("_sim").alias("_fp")), distance).distinct().union(sims.select(F.col("_sim").alias("u"), F.col("_sim").alias("v")))
    side = lambda df, x: df.select(*(F.col(c).alias(f"{c}_{x}") for c in df.columns))
    met = pairs.withColumnsRenamed({"u": "_sim_u", "v": "_sim_v"}).join(side(here, "u"), "_sim_u").join(side(here, "v"), "_sim_v")
    met = stage(met.filter("_sim_u <> _sim_v and _root_u <> _root_v or _root_u < _root_v"))
    return met.join(side(units, "u"), ["_sim_u", "_root_u"]).join(side(units, "v"), ["_sim_v", "_root_v"]).select(
        F.col("_bag_u").alias("_u"), F.col("_bag_v").alias("_v"), "_least_u", "_least_v", "_root_u", "_root_v"
    )


def _joined(docs: DataFrame, pairs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    """(u, v): the groups of those pairs that have a similarity of 0.8 or more with repeats counted."""
    texts = pairs.select(F.col("_least_u").alias("_least")).union(pairs.select("_least_v")).distinct()
    bags = shingle_sets(_rows_of(docs, texts, id_col, text_col), id_col, text_col, shingle, repeats=True)
    keys = pairs.select(F.col("_least_u").alias("_least"), F.col("_u").alias("_bag")).union(pairs.select("_least_v", "_v")).distinct()
    bags = bags.dropDuplicates(["_id", "_key"]).join(keys.select("_bag", F.col("_least._id").alias("_id"), F.col("_least._key").alias("_key")), ["_id", "_key"])
    bags = stage(bags.select("_bag", "_n", "_set"))
    a = pairs.join(bags.select(F.col("_bag").alias("_u"), F.col("_n").alias("_m"), F.col("_set").alias("_x")), "_u")
    near = a.join(bags.withColumnRenamed("_bag", "_v"), "_v").filter("9L * size(array_intersect(_x, _set)) >= 4L * (_m + _n)")
    out = stage(near.select(F.col("_root_u").alias("u"), F.col("_root_v").alias("v")).distinct())
    release(bags)
    return out


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, distance: int = 4) -> DataFrame:
    """The input's rows that stay when of each group of near copies only one with the smallest id does.

    Two texts are linked if their SimHash fingerprints differ in at most distance bits and their shingles have a Jaccard
    similarity of 0.8 or more with repeats counted, as they count in the fingerprint; and, whatever their fingerprints,
    if their sets of shingles have that similarity. Groups are what is reachable over links of both kinds. Shingles are
    told apart by 64-bit hashes. Texts without words are alike. Rows that repeat both the id and the text that stay, all
    stay. A null id counts as the largest. Columns are those of the input."""
    heads = stage(shingle_sets(docs, id_col, text_col, shingle, heads=True))
    units = stage(heads.groupBy("_bag").agg(F.min("_fp").alias("_fp"), F.min("_sim").alias("_sim"), F.min(F.struct("_id", "_key")).alias("_least")))
    able = stage(units.groupBy("_fp").agg(F.min("_least").alias("_least")).join(_able(heads), "_fp").select("_fp", "_least"))
    release(heads)
    release_shuffles(docs.sparkSession)
    found = links(shingle_sets(_rows_of(docs, able, id_col, text_col), id_col, text_col, shingle))
    release_shuffles(docs.sparkSession)
    roots = components(found)
    units = stage(units.join(roots, units._fp == roots.node, "left").select("_bag", "_sim", "_least", F.coalesce("root", "_fp").alias("_root")))
    pairs = stage(by_fingerprint(units, distance))
    named = units
    if not pairs.isEmpty():
        more = components(_joined(docs, pairs, id_col, text_col, shingle))
        named = units.join(more, units._root == more.node, "left").select(F.coalesce("root", "_root").alias("_root"), "_least")
        release_shuffles(docs.sparkSession)
    kept = stage(named.groupBy("_root").agg(F.min("_least").alias("_least")))
    return _rows_of(docs, kept, id_col, text_col)


def _rows_of(docs: DataFrame, least: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The rows with the id and the text's hash that are in _least."""
    named = least.select(F.col("_least._id").alias("_keep"), F.col("_least._key").alias("_text_key"))
    return docs.join(named, (row_id(id_col) == F.col("_keep")) & (F.xxhash64(text_of(text_col)) == F.col("_text_key")), "left_semi")

"""SimHash near-dedup: 64-bit fingerprints of word shingles, linked at a small Hamming distance by pigeonring filtering."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NO_ID, row_id, stage, text_of
from .components import components

SEED = 42
#: Bytes of text that are worked on at once.
_CHUNK = 1 << 20


def _words(buf: np.ndarray, offsets: np.ndarray):
    """Of texts lying end to end: their words joined by single blanks in one buffer, each word's start and length there, and its text."""
    blank = (buf == 32) | ((buf >= 9) & (buf <= 13))
    word = ~blank
    first, last = word.copy(), word.copy()
    first[1:] &= blank[:-1]
    last[:-1] &= blank[1:]
    edges = offsets[1:-1]
    edges = edges[edges < len(buf)]
    first[edges] |= word[edges]
    edges = edges[edges > 0]
    last[edges - 1] |= word[edges - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    lengths = ends - starts
    joined = np.full(int(lengths.sum()) + len(lengths), 32, np.uint8)
    at = np.flatnonzero(word)
    joined[np.arange(len(at)) + np.cumsum(first[at]) - 1] = buf[at]
    begins = np.cumsum(lengths + 1) - (lengths + 1)
    return joined, begins, lengths, np.searchsorted(offsets, starts, "right") - 1


def shingle_hashes(buf: np.ndarray, offsets: np.ndarray, shingle: int) -> tuple[np.ndarray, np.ndarray]:
    """Of texts lying end to end: the XXH64 hashes of their shingles, one text after another, and the number of each text."""
    n = len(offsets) - 1
    none = np.zeros(0, np.uint64), np.zeros(n, np.int64)
    if not len(buf):
        return none
    upper = (buf >= 65) & (buf <= 90)
    joined, begins, lengths, text = _words(np.where(upper, buf + 32, buf).astype(np.uint8), offsets)
    if not len(begins):
        return none
    words = np.bincount(text, minlength=n)
    shingles = np.maximum(words - shingle + 1, np.minimum(words, 1))
    ends = begins + lengths
    last = np.minimum(np.arange(len(begins)) + shingle - 1, np.cumsum(words)[text] - 1)
    place = np.arange(len(begins)) - (np.cumsum(words) - words)[text]
    use = place < shingles[text]
    data, h64 = joined.tobytes(), xxhash.xxh64_intdigest
    hashes = np.fromiter((h64(data[a:b], SEED) for a, b in zip(begins[use].tolist(), ends[last[use]].tolist())), np.uint64, int(shingles.sum()))
    return hashes, shingles


def majorities(hashes: np.ndarray, shingles: np.ndarray) -> np.ndarray:
    """The fingerprints of texts, from what shingle_hashes gives."""
    out = np.zeros(len(shingles), np.int64)
    if not len(hashes):
        return out
    bits = np.unpackbits(hashes.astype(">u8").view(np.uint8)).reshape(-1, 64)
    some = np.flatnonzero(shingles)
    sums = np.add.reduceat(bits, (np.cumsum(shingles) - shingles)[some], axis=0, dtype=np.int64)
    out[some] = np.packbits(sums * 2 > shingles[some, None], axis=1).view(">u8").ravel().astype(np.uint64).view(np.int64)
    return out


def text_chunks(text: pa.Array):
    """(bytes, offsets from 0) of successive runs of texts, each of about _CHUNK bytes or one text."""
    text = text.cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + _CHUNK, "right")) - 1)
        yield data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]
        a = b


def _fingerprint_batches(batches, shingle: int):
    for batch in batches:
        found = [majorities(*shingle_hashes(buf, offsets, shingle)) for buf, offsets in text_chunks(batch.column("_text"))]
        yield pa.RecordBatch.from_arrays([batch.column("_id"), pa.array(np.concatenate(found or [np.zeros(0, np.int64)]))], ["_id", "_fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4) -> DataFrame:
    """(_id, _fp) for each row. Texts are lower-cased in A-Z; of fewer words than a shingle, the whole sequence is
    the one shingle; without words, the fingerprint is zero. A bit is set if it is in over half the XXH64 hashes."""
    rows = docs.select(row_id(id_col).alias("_id"), text_of(text_col).alias("_text"))
    return rows.mapInArrow(partial(_fingerprint_batches, shingle=shingle), "_id long, _fp long")


def _segments(distance: int) -> list[tuple[int, int]]:
    """(bits to shift right, width) of distance + 1 segments that cover 64 bits."""
    m = distance + 1
    widths = [64 // m + (i < 64 % m) for i in range(m)]
    return [(64 - sum(widths[: i + 1]), w) for i, w in enumerate(widths)]


def _mask(segments, start: int, length: int) -> int:
    m = 0
    for k in range(length):
        shift, width = segments[(start + k) % len(segments)]
        m |= ((1 << width) - 1) << shift
    return m - (1 << 64) if m >> 63 else m


def links(fps: DataFrame, distance: int = 4, deep_from: int = 4096) -> DataFrame:
    """fps(_fp): distinct fingerprints -> edges (u, v), u < v, of all pairs with at most distance differing bits.

    The 64 bits form a ring of distance + 1 segments. If two fingerprints differ in at most distance bits, there is
    a segment from which every chain of l segments on holds at most l * distance / (distance + 1) differences: none
    in the first, one in the first two, and so on round the ring. So rows meet by (segment number, segment), and
    the chains are tested in turn before the full distance. Where more than deep_from fingerprints share a
    segment, they meet by the chain of two instead: one side as it is, the other also with each bit of the
    second segment turned, which loses nothing. There are at most (distance + 1) * 2^width segment values,
    which bounds the table of crowded ones. Pairs are tested as the join streams them, and none is collected.
    """
    seg = _segments(distance)
    m = len(seg)

    def value(i: int) -> str:
        shift, width = seg[i % m]
        return f"(shiftrightunsigned(_fp, {shift}) & {(1 << width) - 1}L)"

    rows = fps.select("_fp", F.expr("explode(array(" + ", ".join(f"struct({i} as _i, {value(i)} as _s, {value(i + 1)} as _t)" for i in range(m)) + "))").alias("_k")).select(
        "_fp", "_k.*"
    )
    crowded = F.broadcast(rows.groupBy("_i", "_s").count().filter(F.col("count") > deep_from).select("_i", "_s"))
    tests = " and ".join(
        f"bit_count((a._fp ^ b._fp) & element_at(array({', '.join(_literal(_mask(seg, i, l)) for i in range(m))}), a._i + 1)) <= {l * distance // m}" for l in range(2, m)
    )
    near = F.expr(f"a._fp < b._fp and {tests} and bit_count(a._fp ^ b._fp) <= {distance}" if m > 2 else f"a._fp < b._fp and bit_count(a._fp ^ b._fp) <= {distance}")
    pair = [F.col("a._fp").alias("u"), F.col("b._fp").alias("v")]
    plain = rows.join(crowded, ["_i", "_s"], "left_anti")
    shallow = plain.alias("a").join(plain.alias("b"), [F.expr("a._i = b._i"), F.expr("a._s = b._s"), near]).select(*pair)
    dense = rows.join(crowded, ["_i", "_s"], "left_semi")
    width_next = "element_at(array(" + ", ".join(str(seg[(i + 1) % m][1]) for i in range(m)) + "), _i + 1)"
    turned = dense.select(
        "_fp", "_i", "_s", F.expr(f"explode(concat(array(_t), transform(sequence(0, {width_next} - 1), j -> _t ^ shiftleft(1L, j))))").alias("_t")
    )
    deep = turned.alias("a").join(dense.alias("b"), [F.expr("a._i = b._i"), F.expr("a._s = b._s"), F.expr("a._t = b._t"), near]).select(*pair)
    return shallow.union(deep)


def _literal(x: int) -> str:
    return f"cast('{x}' as bigint)"


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4, deep_from: int = 4096) -> DataFrame:
    """One row per input row: doc_id, fingerprint (16 hex digits), component_id (smallest id reachable over links).

    Links are found between distinct fingerprints, so a group of copies counts as one however large it is, and
    every document with the same fingerprint shares its component. Null text counts as empty; texts without
    words have fingerprint zero and are linked like others. A null id counts as the largest id and comes back
    as null. Repeated rows each get a row. Other columns are ignored. An empty table gives an empty result.
    """
    fps = stage(fingerprints(docs, id_col, text_col, shingle))
    groups = stage(fps.groupBy("_fp").agg(F.min("_id").alias("_least")))
    roots = components(links(groups.select("_fp"), distance, deep_from))
    rooted = groups.join(roots, groups._fp == roots.node, "left").select("_fp", "_least", F.coalesce("root", "_fp").alias("_root"))
    least = rooted.groupBy("_root").agg(F.min("_least").alias("_component"))
    named = rooted.join(least, "_root").select("_fp", "_component")
    unnull = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return fps.join(named, "_fp").select(
        unnull("_id").alias("doc_id"), F.lower(F.lpad(F.hex("_fp"), 16, "0")).alias("fingerprint"), unnull("_component").alias("component_id")
    )


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """The input's rows that stay when of each group of near duplicates only the one with the smallest id does.

    Of rows that repeat that id, all stay that have a text of the group. Columns are those of the input."""
    found = near_duplicates(docs, id_col, text_col, **how).filter("doc_id <=> component_id").select(F.coalesce("doc_id", F.lit(NO_ID)).alias("_keep")).distinct()
    return docs.join(found, row_id(id_col) == F.col("_keep"), "left_semi")

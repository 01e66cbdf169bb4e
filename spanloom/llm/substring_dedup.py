"""Substring dedup: repeated windows of words, found in buckets of super-k-mers that share a minimiser."""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from .common import WORD, release_shuffles, row_id, stage, text_of
from .simhash import _words

#: Words of a minimiser candidate.
MER = 3
#: Windows in a packed string, at most.
_RUN = 64
#: Bytes of text that are worked on at once.
_CHUNK = 1 << 20
#: Packed strings that a task remembers in order to fold copies; beyond that it starts anew.
_REMEMBERED = 100_000
#: Words of bytes that no UTF-8 word holds stand for frequent words: 7 of one byte, 2560 of two, 65536 of three.
_CODES = [bytes([a]) for a in (9, 10, 11, 12, 13, 0xC0, 0xC1)]
_CODES += [bytes([a, b]) for a in range(0xF5, 0xFF) for b in range(256)] + [bytes([0xFF, a, b]) for a in range(256) for b in range(256)]
_CODED = re.compile(rb"[\x09-\x0D\xC0\xC1]|[\xF5-\xFE].|\xFF..|[^\x20]+\x20", re.S)
#: Every so many documents are looked at to find crowded minimisers.
_SURVEYED = 16
#: A minimiser is crowded from so many packed strings on; of the crowded ones no more than this many exist by count.
CROWDED, _MOST_CROWDED = 100_000, 200_000
#: So many different windows are compared under one minimiser in a task, at most.
MOST_IN_BUCKET = 500_000
#: So many words have codes, at most, by the share of all words that they need.
_MOST_WORDS = 100_000

_P = np.uint64(0x9E3779B97F4A7C15)
_PACKED = "_key long, _id long, _row long, _at int, _pack binary, _to int"


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    inverse = np.uint64(pow(int(_P), -1, 1 << 64))
    with np.errstate(over="ignore"):
        up, down = np.full(n + 1, _P), np.full(n + 1, inverse)
        up[0] = down[0] = 1
        return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xC2B2AE3D27D4EB4F)
    return x ^ (x >> np.uint64(32))


def _minimisers(joined: np.ndarray, begins: np.ndarray, lengths: np.ndarray, window: int) -> np.ndarray:
    """For each word, the least mixed hash of MER consecutive words in the window that begins there (over the whole buffer)."""
    with np.errstate(over="ignore"):
        up, down = _powers(len(joined))
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((joined.astype(np.uint64) + np.uint64(1)) * up[:-1], dtype=np.uint64)])
        word = _mix((sums[begins + lengths] - sums[begins]) * down[begins])
        mers = word[: len(word) - MER + 1].copy()
        for k in range(1, MER):
            mers = mers * np.uint64(0x9FB21C651E98DF25) + word[k : len(word) - MER + 1 + k]
        least = _mix(mers)
    span, have = window - MER + 1, 1
    while have * 2 <= span:
        least = np.minimum(least[:-have], least[have:])
        have *= 2
    if have < span:
        least = np.minimum(least[: len(least) - (span - have)], least[span - have :])
    return least


def _runs(buf: np.ndarray, offsets: np.ndarray, window: int):
    """Super-k-mers: text, first word, number of windows and minimiser of each, with the words they are cut from."""
    joined, begins, lengths, text = _words(buf, offsets)
    n = len(begins)
    if n < window:
        return None
    words = np.bincount(text, minlength=len(offsets) - 1)
    before = np.cumsum(words) - words
    least = _minimisers(joined, begins, lengths, window)
    first = np.arange(len(least))
    ok = text[: len(least)] == text[window - 1 : window - 1 + len(least)]
    first, least = first[ok], least[ok]
    if not len(first):
        return None
    fresh = np.ones(len(first), bool)
    fresh[1:] = (least[1:] != least[:-1]) | (first[1:] != first[:-1] + 1)
    heads = np.flatnonzero(fresh)
    sizes = np.diff(np.append(heads, len(first)))
    parts = -(-sizes // _RUN)
    if (parts > 1).any():
        index = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        heads, sizes = np.repeat(heads, parts) + index * _RUN, np.minimum(np.repeat(sizes, parts) - index * _RUN, _RUN)
    at = first[heads]
    return joined, text[at], at, at - before[text[at]], sizes, least[heads].view(np.int64)


def _texts(batch):
    """(buffer, offsets, first row, last row) of runs of rows of about _CHUNK bytes."""
    text = batch.column("_text").cast(pa.large_binary())
    offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
    data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
    a = 0
    while a < len(text):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + _CHUNK, "right")) - 1)
        if offsets[b] > offsets[a]:
            yield data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], a, b
        a = b


def _survey(batches, window: int):
    """Counts of minimisers (no _word) and of words (no _key)."""
    kinds = [("_key", pa.int64()), ("_word", pa.binary()), ("_n", pa.int64())]
    for batch in batches:
        for buf, offsets, _, _ in _texts(batch):
            words = Counter(w for w in _words(buf, offsets)[0].tobytes().split(b" ")[:-1] if len(w) <= 32)
            keys, counts = np.unique(found[-1], return_counts=True) if (found := _runs(buf, offsets, window)) else ([], [])
            columns = [[*keys, *[None] * len(words)], [*[None] * len(keys), *words], [*counts, *words.values()]]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, kinds)], [n for n, _ in kinds])


def _pack(batches, window: int, crowded, codes: dict[bytes, bytes]):
    """Rows for the buckets, with _pack; and rows already known to be repeated, with _to (the word after the last) and no _pack."""
    crowded = np.asarray(crowded, np.int64)
    seen: dict[bytes, tuple] = {}
    for batch in batches:
        ids, row_keys = batch.column("_id").to_numpy(), batch.column("_row").to_numpy()
        for buf, offsets, a, _ in _texts(batch):
            found = _runs(buf, offsets, window)
            if not found:
                continue
            joined, text, head, at, sizes, keys = found
            alone = np.isin(keys, crowded) if len(crowded) else np.zeros(len(keys), bool)
            if alone.any():  # crowded: each window travels by itself, by its own hash
                repeat = np.where(alone, sizes, 1)
                index = np.arange(repeat.sum()) - np.repeat(np.cumsum(repeat) - repeat, repeat)
                text, keys, alone = np.repeat(text, repeat), np.repeat(keys, repeat), np.repeat(alone, repeat)
                head, at = np.repeat(head, repeat) + index, np.repeat(at, repeat) + index
                sizes = np.where(alone, 1, np.repeat(sizes, repeat))
            coded = [codes.get(w) or w + b" " for w in joined.tobytes().split(b" ")[:-1]]
            places = np.cumsum([0, *map(len, coded)])
            data, out = b"".join(coded), []
            rows = zip(
                places[head].tolist(), places[head + sizes + window - 1].tolist(), ids[a + text].tolist(), row_keys[a + text].tolist(), at.tolist(), sizes.tolist(), keys.tolist(), alone.tolist()
            )
            for b, e, i, r, p, n, key, own in rows:
                pack, place = data[b:e], (i, p, r)
                known = seen.get(pack)
                if known == place:
                    continue
                if known is not None and known[:2] < place[:2]:
                    out.append((i ^ p << 20, i, r, p, None, p + n + window - 1))
                    continue
                if known is None or place < known:
                    if len(seen) >= _REMEMBERED:
                        seen.clear()
                    seen[pack] = place
                out.append((xxhash.xxh64_intdigest(pack) - (1 << 63) if own else key, i, r, p, pack, None))
            columns = list(zip(*out)) or [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32()))],
                ["_key", "_id", "_row", "_at", "_pack", "_to"],
            )


def _count(batches, window: int, most: int):
    """Rows come sorted by (key, id, place). Windows seen before under the same key are repeated: spans, with _to and no _pack.

    Once a key has so many different windows, those seen and all that follow are handed on as single windows (_pack, no _to)
    for another round; spans found before stay found."""
    now, seen, full = None, {}, False
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary(), pa.int32())
    names = ["_key", "_id", "_row", "_at", "_pack", "_to"]

    def told(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [[]] * 6, kinds)], names)

    for batch in batches:
        out = []
        for key, i, r, at, pack, to in zip(*(batch.column(c).to_pylist() for c in names)):
            if pack is None:
                out.append((0, i, r, at, None, to))
                continue
            if key != now:
                now, seen, full = key, {}, False
            ends = [0, *(m.end() for m in _CODED.finditer(pack))]
            first = -1
            for k in range(len(ends) - window):
                w = pack[ends[k] : ends[k + window]]
                if full:
                    out.append((0, i, r, at + k, w, None))
                    continue
                place = (i, at + k, r)
                if seen.setdefault(w, place)[:2] < place[:2]:
                    if first < 0:
                        first = at + k
                elif first >= 0:
                    out.append((0, i, r, first, None, at + k + window - 1))
                    first = -1
                if len(seen) >= most:
                    if first >= 0:
                        out.append((0, i, r, first, None, at + k + window))
                        first = -1
                    out += [(0, j, q, p, x, None) for x, (j, p, q) in seen.items()]
                    seen, full = {}, True
            if first >= 0:
                out.append((0, i, r, first, None, at + len(ends) - 1))
            if len(out) > 10_000:
                yield told(out)
                out = []
        yield told(out)


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, crowded_from: int = CROWDED, most: int = MOST_IN_BUCKET) -> DataFrame:
    """Spans of words, (_id, _row, _at, _to) from word _at up to before _to, covered by a window of words that
    also starts earlier: at a smaller id, or in the same document further ahead.

    A window's minimiser is the least hash of MER consecutive words in it. Consecutive windows with the same
    minimiser are cut out as one packed string, which goes to the minimiser's bucket; as equal windows have
    equal minimisers, they meet. There the strings come sorted by place and windows are compared word by word.
    A task folds packed strings that it has sent before, keeping the earliest. Minimisers with more
    than crowded_from packed strings (estimated from every 16th document, which plans the work and has no
    influence on the result) send each window by the hash of the window itself, so that a phrase that a
    third of the corpus holds is spread over all buckets; their number is bounded by raising the limit. What
    is still too much for a bucket, by its own count of `most` different windows, goes through a second round in which
    windows are grouped as they are, so that no bucket holds more in memory, however large the corpus. The surveyed
    documents give the words that packed strings write as codes of one to three bytes. The coding can be undone
    word by word, so equal codes are equal words.
    """
    rows = docs.select(row_id(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_row"), text_of(text_col).alias("_text"))
    surveyed = rows.filter(F.pmod(F.xxhash64("_row", "_id"), F.lit(_SURVEYED)) == 0)
    counts = stage(surveyed.mapInArrow(partial(_survey, window=window), "_key long, _word binary, _n long").groupBy("_key", "_word").agg(F.sum("_n").alias("_n")))
    total = counts.filter("_key is not null").agg(F.sum("_n")).first()[0] or 0
    limit = max(crowded_from / _SURVEYED, total / _MOST_CROWDED)
    crowded = [r[0] for r in counts.filter((F.col("_key").isNotNull()) & (F.col("_n") > limit)).select("_key").toLocalIterator()]
    words = counts.filter("_word is not null")
    share = (words.agg(F.sum("_n")).first()[0] or 0) / _MOST_WORDS  # so many words at most can have as large a share
    often = sorted(((r._n, bytes(r._word)) for r in words.filter((F.col("_n") > 1) & (F.col("_n") >= share)).select("_n", "_word").toLocalIterator()), key=lambda x: (-x[0], x[1]))
    codes = {w: c for (_, w), c in zip(often, _CODES) if len(c) <= len(w)}
    packed = rows.mapInArrow(partial(_pack, window=window, crowded=crowded, codes=codes), _PACKED)
    in_buckets = packed.repartition("_key").sortWithinPartitions("_key", "_id", "_at")
    found = stage(in_buckets.mapInArrow(partial(_count, window=window, most=most), _PACKED))
    spans = found.filter("_pack is null").select("_id", "_row", "_at", "_to")
    left = found.filter("_pack is not null")
    if left.isEmpty():
        return spans
    firsts = left.groupBy("_pack").agg(F.min(F.struct("_id", "_at")).alias("_first"))
    again = left.join(firsts, "_pack").filter(F.struct("_id", "_at") > F.col("_first"))
    return spans.unionByName(again.select("_id", "_row", "_at", (F.col("_at") + window).alias("_to")))


@F.pandas_udf(StructType([StructField("text", StringType()), StructField("words", LongType()), StructField("removed", LongType())]))
def _cut(texts: pd.Series, starts: pd.Series, ends: pd.Series) -> pd.DataFrame:
    """The text without the spans, or null where nothing goes; how many words it had, and how many go."""

    def one(text, begins, stops):
        if text is None:
            return None, 0, 0
        if begins is None:
            return None, len(text.encode().split()), 0
        at = [m.start() for m in WORD.finditer(text)] + [len(text)]
        kept, done, gone = [], 0, 0
        for a, b in sorted(zip(begins.tolist(), stops.tolist())):
            if b > done:
                if a > done:
                    kept.append(text[(at[done] if done else 0) : at[a]])
                gone += b - max(a, done)
                done = b
        kept.append(text[at[done] :])
        return "".join(kept), len(at) - 1, gone

    return pd.DataFrame([one(*x) for x in zip(texts, starts, ends)], columns=["text", "words", "removed"])


@F.pandas_udf(StringType())
def words_sha256(texts: pd.Series) -> pd.Series:
    """SHA-256, in lower-case hex, of the words joined by one blank; null has none."""
    return pd.Series([hashlib.sha256(b" ".join((t or "").encode().split())).hexdigest() for t in texts], dtype=object)


def substring_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 20, crowded_from: int = CROWDED, most: int = MOST_IN_BUCKET) -> DataFrame:
    """The input's rows and columns, the text without its repeated words, plus n_words and n_removed.

    A word goes if a window of words that covers it also starts earlier (smaller id, or same document, earlier
    start); windows are judged on the input, not on what is left. A removed run is cut out together with
    the white space behind it; texts that lose nothing are not touched. Words are runs without ASCII white space.

    Null text stays null and has no words. Texts shorter than a window stay. A null id counts as the largest.
    Rows that repeat both id and text count as one document and get the same result; rows that share only the
    id are told apart by their text, and a window at the same place as its first occurrence is kept. Other
    columns are carried along. An empty table gives an empty result.
    """
    spans = repeated_spans(docs, id_col, text_col, window, crowded_from, most)
    release_shuffles(docs.sparkSession)
    # a document's spans come together here: they are bounded by its own length
    lists = spans.groupBy("_id", "_row").agg(F.collect_list(F.struct("_at", "_to")).alias("_s")).select("_id", "_row", "_s._at", "_s._to")
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), row_id(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_row"))
    whole = F.col(f"_doc.`{text_col}`")
    both = rows.join(lists, ["_id", "_row"], "left").withColumn("_cut", _cut(whole, "_at", "_to"))
    out = both.select("_doc", F.coalesce("_cut.text", whole).alias("_text"), F.col("_cut.words").alias("n_words"), F.col("_cut.removed").alias("n_removed"))
    added = ("n_words", "n_removed")
    return out.select(*[F.col("_text").alias(c) if c == text_col else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c not in added], *added)

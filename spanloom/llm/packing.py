"""Best-fit packing of token pieces into bounded sequences, bettered by swap-based local search."""

from __future__ import annotations

import gc
import json
import os
import re
import zlib
from array import array
from functools import partial
from heapq import heapify, heappop, heappush
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, stage, text_of
from .simhash import _words

#: Tokens a sequence; pieces that are packed together; bytes of text worked on at once; words remembered by a task, and their length.
CAPACITY, BLOCK = 4096, 50_000
_CHUNK, _REMEMBERED, _LONG = 1 << 21, 400_000, 100

#: A word of letters that are one code point each, in capitals and small, with signs behind it that are one token run of their own.
_SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-Þà-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*) ")


def _byte_signs() -> dict[int, str]:
    """The printable sign that stands for each byte in the vocabulary: itself, or the next free one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class _Ids:
    """Token ids of texts. The tokenizer never joins anything across ASCII white space, so texts are split there. A
    word's ids lie in one growing array and are looked up once for each distinct word of a chunk; what is known is
    kept for the tasks to come, up to a number of words, then forgotten and learnt anew.

    Words of Latin letters go to the bare merges: folding, composing and cutting leave such a word whole, and the signs
    behind it are a run by themselves. All others go through the whole tokenizer."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.rules = tokenizer_json
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.encode_special_tokens = True
        self.merges = Tokenizer.from_str(json.dumps(json.loads(tokenizer_json) | {"normalizer": None, "pre_tokenizer": None, "added_tokens": []}))
        self.signs = _byte_signs()
        self.forget()

    def forget(self) -> None:
        #: Words, each with a blank behind it, and their parts -> number; the places in flat are from starts[number] up to stops[number].
        self.known: dict[bytes, int] = {}
        self.parts: dict[str, int] = {}
        self.starts, self.stops, self.flat = array("q"), array("q"), array("I")
        self.parts[""] = self._encode(self.merges, [""])[0]

    def _encode(self, tokenizer, texts: list[str]) -> range:
        first, at = len(self.starts), len(self.flat)
        ids = [e.ids for e in tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        stops = np.cumsum(np.fromiter(map(len, ids), np.int64, len(ids))) + at
        self.flat.extend(chain.from_iterable(ids))
        self.starts.frombytes(np.concatenate([[at], stops])[:-1].astype(np.int64).tobytes())
        self.stops.frombytes(stops.tobytes())
        return range(first, len(self.starts))

    def _learn(self, words: list[bytes]) -> list[int]:
        """A number for each word: that of its first part and, above 32 bits, of the signs behind it (0: none)."""
        parts, simple, whole = self.parts, {}, {}
        found = []
        for w in map(bytes.decode, words):
            if m := _SIMPLE.fullmatch(w):
                word, sign = m.groups()
                word = word.lower()
                if word not in parts:
                    simple[word] = None
                if sign not in parts:
                    whole[sign] = None
                found.append((word, sign))
            else:
                whole[w] = None
                found.append((w, ""))
        letters = [w if w.isascii() else w.encode().decode("latin-1").translate(self.signs) for w in simple]
        parts.update(zip(simple, self._encode(self.merges, letters)))
        parts.update(zip(whole, self._encode(self.tokenizer, list(whole))))
        out = [parts[word] + (parts[sign] << 32) for word, sign in found]
        for w in [*simple, *whole]:  # what is long or whole won't be asked for again as a part
            if len(w) > _LONG or w and w[-1] == " ":
                del parts[w]
        return out

    def of(self, buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of texts lying end to end: all ids, and how many each text has."""
        joined, begins, _, text = _words(buf, offsets)
        counts = np.zeros(len(offsets) - 1, np.int64)
        if not len(begins):
            return np.zeros(0, np.uint32), counts
        if len(self.known) > _REMEMBERED:
            self.forget()
        ends = pa.py_buffer(np.append(begins, len(joined)).astype(np.int64))
        coded = pa.Array.from_buffers(pa.large_binary(), len(begins), [None, ends, pa.py_buffer(joined)]).dictionary_encode()
        words, which, known = coded.dictionary.to_pylist(), coded.indices.to_numpy(), self.known
        number = np.fromiter([known.get(w, -1) for w in words], np.int64, len(words))
        if len(missing := np.flatnonzero(number < 0)):
            new = [words[k] for k in missing.tolist()]
            gc.disable()  # nothing here is cyclic, and the collector would walk all that is remembered
            try:
                number[missing] = learnt = self._learn(new)
            finally:
                gc.enable()
            known.update((w, k) for w, k in zip(new, learnt) if len(w) <= _LONG)
        starts, stops, flat = (np.frombuffer(x, k) for x, k in ((self.starts, np.int64), (self.stops, np.int64), (self.flat, np.uint32)))
        both = np.stack([number & 0xFFFFFFFF, number >> 32], axis=1)
        start, size = starts[both], (stops - starts)[both]
        sizes = size[which].ravel()
        ids = flat[np.arange(sizes.sum()) + np.repeat(start[which].ravel() - (np.cumsum(sizes) - sizes), sizes)]
        return ids, np.bincount(text, size.sum(axis=1)[which], len(counts)).astype(np.int64)


_IDS: list[_Ids] = []


def _ids(tokenizer_json: str) -> _Ids:
    if not _IDS or _IDS[0].rules != tokenizer_json:
        _IDS[:] = [_Ids(tokenizer_json)]
    return _IDS[0]


def _parts(data: np.ndarray, offsets: np.ndarray):
    """(first text, bytes, offsets from 0, whether the last text ends there) of successive runs of texts of about
    _CHUNK bytes. A longer text comes in several runs, cut at blanks, so that what is held follows the chunk."""
    a, last = 0, len(offsets) - 1
    while a < last:
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + _CHUNK, "right")) - 1)
        at, end = int(offsets[a]), int(offsets[b])
        while end - at > 2 * _CHUNK:
            cut = at + _CHUNK
            while cut < end:
                blank = np.flatnonzero(np.isin(data[cut : min(cut + _CHUNK, end)], (9, 10, 11, 12, 13, 32)))
                if len(blank):
                    cut += int(blank[0])
                    break
                cut += _CHUNK
            if cut >= end:
                break
            yield a, data[at:cut], np.array([0, cut - at]), False
            at = cut
        yield a, data[at:end], (offsets[a : b + 1] - at if at == offsets[a] else np.array([0, end - at])), True
        a = b


def _pieces(batches, tokenizer_json: str, end: int, capacity: int, with_ids: bool):
    ids_of, last = _ids(tokenizer_json), np.array([end], "<u4").tobytes()
    for batch in batches:
        texts = batch.column("_text").cast(pa.large_binary())
        offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
        held: list[bytes] = []
        for a, buf, ends, done in _parts(np.frombuffer(texts.buffers()[2] or b"", np.uint8), offsets):
            ids, counts = ids_of.of(buf, ends)
            if not done:
                held.append(ids.astype("<u4").tobytes())
                continue
            flat, at = ids.astype("<u4").tobytes(), (np.cumsum(counts) * 4).tolist()
            rows, numbers = [], []
            for k, (p, q) in enumerate(zip([0, *at], at)):
                data = b"".join([*held, flat[p:q], last])
                held = []
                for piece, x in enumerate(range(0, len(data), 4 * capacity)):
                    own = data[x : x + 4 * capacity]
                    rows.append((a + k, piece, x // 4, len(own) // 4, zlib.crc32(own)))
                    numbers.append(own)
            k, *columns = zip(*rows)
            out = [batch.column("doc_id").take(pa.array(k)), *(pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64())))]
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            if with_ids:
                flat_ids = pa.array(np.frombuffer(b"".join(numbers), "<u4").astype(np.int32))
                places = np.cumsum([0] + [len(x) // 4 for x in numbers])
                out.append(pa.ListArray.from_arrays(pa.array(places, pa.int32()), flat_ids))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(out, names)


def best_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """A bin for each length: longest first, each into the fullest bin that takes it."""
    bins = np.empty(len(lengths), np.int64)
    at_gap: list[list[int]] = [[] for _ in range(capacity + 1)]
    open_gaps, count = 0, 0
    order = np.argsort(-lengths, kind="stable")
    for k, n in zip(order.tolist(), lengths[order].tolist()):
        fits = open_gaps >> n
        if fits:
            gap = n + (fits & -fits).bit_length() - 1
            b = at_gap[gap].pop()
            if not at_gap[gap]:
                open_gaps &= ~(1 << gap)
        else:
            gap, b, count = capacity, count, count + 1
        bins[k] = b
        if gap > n:
            at_gap[gap - n].append(b)
            open_gaps |= 1 << (gap - n)
    return bins


class _Bins:
    """Underfull bins by what they could give: for every sum of none, one or two of a bin's lengths, the bin with the
    widest gap that has it. A bin holds at most some 90 different lengths, as they have to fit in, so all pairs are listed."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: dict[int, dict[int, list[int]]] = {}
        self.fill: dict[int, int] = {}
        self.stamp: dict[int, int] = {}
        #: The widest gap by sum: of one length, and of none, one or two.
        self.gap = {1: np.zeros(capacity + 1, np.int64), 2: np.zeros(capacity + 1, np.int64)}
        self.heaps: dict[tuple[int, int], list[tuple[int, int, int]]] = {}

    def sums(self, b: int) -> tuple[list[int], list[int]]:
        own = sorted(self.items[b])
        pairs = {x + y for k, x in enumerate(own) for y in own[k + 1 :]} | {2 * x for x in own if len(self.items[b][x]) > 1}
        return own, list({0, *own, *pairs})

    def _top(self, kind: int, s: int) -> tuple[int, int]:
        heap = self.heaps.get((kind, s), ())
        while heap and self.stamp.get(heap[0][1]) != heap[0][2]:
            heappop(heap)
        return (-heap[0][0], heap[0][1]) if heap else (0, -1)

    def show(self, b: int) -> None:
        gap = self.capacity - self.fill[b]
        if not gap:
            return
        mark = self.stamp[b] = self.stamp.get(("n", b), 0) + 1
        self.stamp["n", b] = mark
        for kind, sums in zip((1, 2), self.sums(b)):
            top = self.gap[kind]
            for s in sums:
                heappush(self.heaps.setdefault((kind, s), []), (-gap, b, mark))
                if top[s] < gap:
                    top[s] = gap

    def hide(self, b: int) -> None:
        if self.stamp.pop(b, None) is None:
            return
        for kind, sums in zip((1, 2), self.sums(b)):
            for s in sums:
                self.gap[kind][s] = self._top(kind, s)[0]

    def best(self, a: int) -> tuple[int, int, int, int] | None:
        """(tokens that leave a, of how many documents, tokens that come back, bin), for the most tokens in all."""
        own, more = self.sums(a)
        most, found = 0, None
        for kind, sums in ((2, own), (1, [x for x in more if x and x not in self.items[a]])):
            for x in sums:
                # the bin takes what it gets more than it gives
                fits = np.flatnonzero(self.gap[kind][:x] >= np.arange(x, 0, -1))
                if kind == 1:
                    fits = fits[fits > 0]
                if len(fits) and x - fits[0] > most:
                    most, found = x - int(fits[0]), (x, 3 - kind, int(fits[0]), self._top(kind, int(fits[0]))[1])
            if found:
                break
        return found

    def take(self, b: int, total: int, documents: int) -> list[int]:
        """Removes documents of that total from a bin, as few as may be, at most two."""
        own = self.items[b]
        lengths = [] if not total else [total] if total in own else next([x, total - x] for x in own if total - x in own and (2 * x != total or len(own[x]) > 1))
        assert len(lengths) <= documents
        out = []
        for x in lengths:
            out.append(own[x].pop())
            if not own[x]:
                del own[x]
        self.fill[b] -= total
        return out

    def put(self, b: int, lengths: np.ndarray, items: list[int]) -> None:
        for k in items:
            self.items[b].setdefault(int(lengths[k]), []).append(k)
            self.fill[b] += int(lengths[k])


def local_search(lengths: np.ndarray, bins: np.ndarray, capacity: int, exchanges: int | None = None) -> np.ndarray:
    """Empties underfull bins: from the emptiest bin, a document moves to another bin, or changes places with one
    shorter document, or with two, or two with one, so that more tokens leave than come; of all such exchanges, over all
    other bins, one that moves most. Tokens go to bins at least as full, so the sum of squared fills rises with every
    exchange and the search ends. A bin that nothing betters is left aside until a round over all bins is through;
    rounds go on until one makes no exchange. It stops earlier at the least number of bins that the tokens allow, or
    after so many exchanges, if a number is given."""
    bins = bins.copy()
    count = int(bins.max()) + 1 if len(bins) else 0
    fill = np.bincount(bins, lengths, count).astype(np.int64)
    left, least = count, -(-int(lengths.sum()) // capacity)
    if left <= least:
        return bins
    held = _Bins(capacity)
    for k in np.flatnonzero(fill[bins] < capacity).tolist():
        b = int(bins[k])
        held.items.setdefault(b, {}).setdefault(int(lengths[k]), []).append(k)
    held.fill = {b: int(fill[b]) for b in held.items}
    for b in held.items:
        held.show(b)
    changed = True
    while changed and left > least:
        changed = False
        order = [(n, b) for b, n in held.fill.items() if 0 < n < capacity]
        heapify(order)
        aside = []
        while order and left > least and (exchanges is None or exchanges > 0):
            n, a = heappop(order)
            if n != held.fill[a] or a not in held.stamp:
                continue
            held.hide(a)
            while held.fill[a] and (found := held.best(a)):
                out, documents, back, b = found
                held.hide(b)
                gone = held.take(a, out, documents)
                come = held.take(b, back, 2 if documents == 1 else 1)
                held.put(a, lengths, come)
                held.put(b, lengths, gone)
                bins[gone], bins[come] = b, a
                held.show(b)
                if held.fill[b] < capacity:
                    heappush(order, (held.fill[b], b))
                changed = True
                if exchanges is not None:
                    exchanges -= 1
                    if exchanges <= 0:
                        break
            if held.fill[a]:
                aside.append(a)
            else:
                left -= 1
        for a in aside:
            held.show(a)
        if exchanges is not None and exchanges <= 0:
            break
    return np.unique(bins, return_inverse=True)[1]


def pack_lengths(lengths: np.ndarray, capacity: int = CAPACITY, exchanges: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset in it) of each item; items are 1 to capacity long."""
    bins = local_search(lengths, best_fit(lengths, capacity), capacity, exchanges)
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(lengths[order])
    starts = ends - lengths[order]
    first = np.concatenate([[True], bins[order][1:] != bins[order][:-1]]) if len(order) else np.zeros(0, bool)
    offsets = np.empty(len(lengths), np.int64)
    offsets[order] = starts - np.maximum.accumulate(np.where(first, starts, 0))
    return bins, offsets


def _pack_block(key, rows: pd.DataFrame, capacity: int, exchanges: int | None) -> pd.DataFrame:
    rows = rows.sort_values(["doc_id", "piece", "start", "length", "ids_crc32"], kind="stable")
    bins, offsets = pack_lengths(rows["length"].to_numpy(), capacity, exchanges)
    return rows.drop(columns="_block").assign(sequence_id=(int(key[0]) << 32) + bins, offset=offsets)


def _merge(packed: DataFrame, capacity: int, block: int) -> DataFrame:
    """Packed pieces of several blocks, with the blocks' sequences of at most half the capacity packed once more, as wholes.

    A block leaves one such sequence or so, so there are about as many as blocks; they are joined back by
    sequence and move all of a sequence's pieces by the same offset."""
    while True:
        halves = packed.groupBy("sequence_id").agg(F.sum("length").alias("length")).filter(F.col("length") <= capacity // 2)
        halves = stage(halves)
        n = halves.count()
        if n < 2:
            return packed
        blocks = -(-n // block)

        def together(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
            rows = rows.sort_values("sequence_id")
            bins, shift = pack_lengths(rows["length"].to_numpy(), capacity)
            to = rows["sequence_id"].to_numpy()
            first = np.full(bins.max() + 1, -1, np.int64)
            first[bins[::-1]] = to[::-1]
            return pd.DataFrame({"sequence_id": to, "_to": first[bins], "_shift": shift})

        dealt = halves.withColumn("_block", F.pmod(F.xxhash64("sequence_id"), F.lit(blocks)).cast("int"))
        moves = dealt.groupBy("_block").applyInPandas(together, "sequence_id long, _to long, _shift long")
        columns = [c for c in packed.columns if c not in ("sequence_id", "offset")]
        moved = packed.join(moves, "sequence_id", "left").select(
            *columns, F.coalesce("_to", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("_shift", F.lit(0))).alias("offset")
        )
        now = stage(moved)
        release(packed)
        packed = now
        if blocks == 1:
            return packed


def token_pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = 1, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 and, if asked for, ids: each document's tokens and the end id, cut
    into pieces of the capacity. The tokenizer's file is read on the driver and travels with the tasks."""
    with open(tokenizer, encoding="utf-8") as f:
        rules = f.read()
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("_text"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids
    return rows.mapInArrow(partial(_pieces, tokenizer_json=rules, end=end, capacity=capacity, with_ids=with_ids), schema)


def pack(
    docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = 1, capacity: int = CAPACITY, block: int = BLOCK, exchanges: int | None = None
) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset: one row for each piece of each document.

    A document is its tokens and the end id. Only documents longer than a sequence are cut, into full pieces and a
    rest. Pieces are dealt out evenly into blocks of about `block`, and each block is packed in one task, best fit
    first and then by local search, which ends by itself (or after `exchanges` a block, if a number is given). The
    sequences that blocks leave half empty or more are packed together. Tokens are not shuffled, only the pieces'
    lengths are.

    Null text counts as empty: a document of the end id alone. Null ids are carried along; rows that repeat an id are
    documents of their own. Very long texts are cut into tokens some megabytes at a time; a document's ids are held, four
    bytes each, until it is cut into pieces. Other columns are ignored. An empty table gives an empty result.
    """
    pieces = stage(token_pieces(docs, tokenizer, id_col, text_col, end, capacity))
    blocks = max(1, -(-pieces.count() // block))
    dealt = pieces.withColumn("_block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("int"))
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"

    def pack_block(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return _pack_block(key, rows, capacity, exchanges)

    packed = dealt.groupBy("_block").applyInPandas(pack_block, schema)
    return _merge(stage(packed), capacity, block) if blocks > 1 else packed


def sequences(docs: DataFrame, packed: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int = 1, capacity: int = CAPACITY) -> DataFrame:
    """(sequence_id, ids array<int>): the packed sequences themselves, each at most the capacity long.

    Needs ids that are unique and not null, as pieces find their places by (doc_id, piece)."""
    pieces = token_pieces(docs, tokenizer, id_col, text_col, end, capacity, with_ids=True).select("doc_id", "piece", "ids")
    placed = packed.select("doc_id", "piece", "sequence_id", "offset").join(pieces, ["doc_id", "piece"])
    lists = placed.groupBy("sequence_id").agg(F.array_sort(F.collect_list(F.struct("offset", "ids"))).alias("_p"))
    return lists.select("sequence_id", F.flatten("_p.ids").alias("ids"))

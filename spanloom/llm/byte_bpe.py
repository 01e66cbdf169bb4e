"""Byte-level BPE by prefix dynamic programming: for each prefix of a piece, the one last token that its encoding has."""

from __future__ import annotations

import base64
import hashlib
import unicodedata
from functools import lru_cache, partial
from itertools import chain

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import chunks, text_of

#: Bytes of text that are worked on at once, pieces remembered by a worker, the longest piece worth remembering, and pairs
#: of tokens remembered.
_CHUNK, _REMEMBERED, _LONG, _PAIRS = 1 << 20, 400_000, 64, 1_000_000
INFINITE = float("inf")


def load_ranks(path: str) -> dict[bytes, int]:
    """A .tiktoken file: base64 bytes and rank on each line."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}


class Prefixes:
    """The encoding of one piece, open at the end: last[i] is the last token of the first i bytes.

    Appending looks at the new prefixes only. Replacing bytes keeps the prefixes before the change, and takes
    those behind it over as soon as a whole token's length of them agree again.
    """

    def __init__(self, bpe: BytePairEncoder, data: bytes = b""):
        self.bpe, self.data, self.last = bpe, bytearray(), [None]
        self.append(data)

    def append(self, data: bytes) -> None:
        start = len(self.data)
        self.data += data
        self.last += [None] * len(data)
        self.bpe._fill(self.data, self.last, start)

    def replace(self, start: int, end: int, data: bytes) -> int:
        """Puts data in the place of bytes start to end; returns how many prefixes were worked out again."""
        old, shift = self.last, len(data) - (end - start)
        self.data[start:end] = data
        self.last = old[: start + 1] + [None] * (len(self.data) - start)
        agree = 0
        for i in range(start + 1, len(self.data) + 1):
            self.last[i] = self.bpe._last(self.data, self.last, i)
            agree = agree + 1 if i > start + len(data) and self.last[i] == old[i - shift] else 0
            # prefixes look back by one token's length: with so many alike behind the change, all that follow are
            if agree >= self.bpe.longest and i - start - len(data) >= self.bpe.longest:
                self.last[i + 1 :] = old[i - shift + 1 :]
                return i - start
        return len(self.data) - start

    def tokens(self) -> list[int]:
        out, i = [], len(self.data)
        while i:
            out.append(self.last[i])
            i -= len(self.bpe.bytes_of[self.last[i]])
        return out[::-1]


class BytePairEncoder:
    """Encodes as merging by rank does. A token t can follow token s just when the bytes of both together encode to
    s, t; so of the tokens that end a prefix exactly one follows the last token of the prefix before it."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks, self.pattern = ranks, regex.compile(pattern)
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.longest = max(map(len, ranks))
        self._follows: dict[int, bool] = {}
        self._spines: tuple[dict, dict] = {}, {}
        self._ending = ahocorasick.Automaton()
        for token, rank in ranks.items():
            self._ending.add_word(token.decode("latin-1"), (rank, len(token)))
        self._ending.make_automaton()

    def _merge(self, data: bytes, down_to: int = 1) -> list[bytes]:
        """Merges by rank, the way that defines the encoding, until so many parts are left."""
        parts, ranks = [data[i : i + 1] for i in range(len(data))], self.ranks
        while len(parts) > down_to:
            found = [(ranks[x], i) for i, x in enumerate(a + b for a, b in zip(parts, parts[1:])) if x in ranks]
            if not found:
                break
            _, i = min(found)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return parts

    def _spine(self, token: int, right: bool) -> list[tuple[bytes, float]]:
        """The parts of a token that are at its right or left end while it is merged, from the single byte on, each with
        the rank of the merge that ends it."""
        known = self._spines[right].get(token)
        if known is None:
            part, known = self.bytes_of[token], []
            above = INFINITE
            while True:
                known.append((part, above))
                if len(part) == 1:
                    break
                above = self.ranks[part]
                halves = self._merge(part, 2)
                part = halves[-1] if right else halves[0]
            known.reverse()
            self._spines[right][token] = known
        return known

    def _can_follow(self, before: int, token: int) -> bool:
        """Whether no merge crosses from one token to the other: a crossing pair has to be merged before either part
        goes into a larger one, and of equal ranks the left goes first."""
        left, right = self._spine(before, True), self._spine(token, False)
        i = j = 0
        ranks = self.ranks
        while True:
            (x, x_ends), (y, y_ends) = left[i], right[j]
            m = ranks.get(x + y)
            if m is not None and m < x_ends and m <= y_ends:
                return False
            if x_ends <= y_ends:
                if x_ends == INFINITE:
                    return True
                i += 1
            else:
                j += 1

    def _fits(self, before: int | None, token: int) -> bool:
        key = token if before is None else (before + 1) << 24 | token
        known = self._follows.get(key)
        if known is None:
            if len(self._follows) >= _PAIRS:
                self._follows.clear()
            known = self._merge(self.bytes_of[token]) == [self.bytes_of[token]] if before is None else self._can_follow(before, token)
            self._follows[key] = known
        return known

    def _last(self, data: bytes, last: list, i: int) -> int:
        ranks = self.ranks
        for start in range(max(0, i - self.longest), i):
            token = ranks.get(bytes(data[start:i]))
            if token is not None and self._fits(last[start], token):
                return token
        raise ValueError(f"no token for byte {data[i - 1]:#x}")

    def _fill(self, data: bytes, last: list, start: int) -> None:
        """The last tokens of all prefixes longer than start. The automaton names the tokens that end at each byte."""
        base = max(0, start + 1 - self.longest)
        follows = self._follows
        for end, (token, length) in self._ending.iter(data[base:].decode("latin-1")):
            i = base + end + 1
            if i > start and last[i] is None and i - length >= base:
                before = last[i - length]
                known = follows.get(token if before is None else (before + 1) << 24 | token)
                if known or known is None and self._fits(before, token):
                    last[i] = token
        if None in last[1:]:
            raise ValueError("the vocabulary has no token for a byte of the text")

    def encode_piece(self, piece: bytes) -> list[int]:
        whole = self.ranks.get(piece)
        return [whole] if whole is not None else Prefixes(self, piece).tokens()

    def pieces(self, text: str) -> list[str]:
        """Matches of the pattern. Letters and digits newer than the Unicode version of the interpreter are other signs."""
        if text.isascii() or max(text, default="") < _newer()[0] or not _newer()[1].search(text):
            return self.pattern.findall(text)
        plain = _newer()[1].sub("\ufffd", text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(plain)]

    def encode(self, text: str) -> list[int]:
        return list(chain.from_iterable(self.encode_piece(p.encode()) for p in self.pieces(text)))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


@lru_cache(1)
def _newer() -> tuple[str, regex.Pattern]:
    """The first of the letters and digits that only the regex module's Unicode version has, and a pattern of them all."""
    found = [c for c in regex.findall(r"[\p{L}\p{N}]", "".join(map(chr, chain(range(0xD800), range(0xE000, 0x110000))))) if unicodedata.category(c) == "Cn"]
    spans, cps = [], sorted(map(ord, found))
    for c in cps:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    if not spans:
        return "\U0010ffff", regex.compile(r"(?!)")
    return chr(cps[0]), regex.compile("[" + "".join(f"{chr(a)}-{chr(b)}" for a, b in spans) + "]")


_MADE: list = []


def _made(ranks: dict[bytes, int], pattern: str) -> tuple[BytePairEncoder, dict[str, list[int]]]:
    """A worker's encoder and the pieces it remembers, kept for the tasks to come."""
    if not _MADE or _MADE[0].ranks != ranks or _MADE[0].pattern.pattern != pattern:
        _MADE[:] = [BytePairEncoder(ranks, pattern), {}]
    return _MADE[0], _MADE[1]


def _encoded(batches, ranks: dict, pattern: str, what):
    """what(a text's ids, encoder) for each text: in parts, (batch, first row, values)."""
    bpe, known = _made(ranks, pattern)
    for batch in batches:
        texts = batch.column("_text")
        for part in chunks(range(batch.num_rows), lambda k: len(texts[k].as_buffer() or b"") + 100, _CHUNK):
            rows = []
            for k in part:
                ids: list[int] = []
                for p in bpe.pieces(texts[k].as_py()):
                    found = known.get(p)
                    if found is None:
                        found = bpe.encode_piece(p.encode())
                        if len(p) <= _LONG:
                            if len(known) >= _REMEMBERED:
                                known.clear()
                            known[p] = found
                    ids += found
                rows.append(what(ids, bpe))
            yield batch, part[0], rows


def _ids_batches(batches, ranks, pattern):
    for batch, at, rows in _encoded(batches, ranks, pattern, lambda ids, _: ids):
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(rows)), pa.array(rows, pa.list_(pa.int32()))], ["doc_id", "ids"])


def _digest(ids: list[int], bpe: BytePairEncoder):
    return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids)).hexdigest()


def _digest_batches(batches, ranks, pattern):
    for batch, at, rows in _encoded(batches, ranks, pattern, _digest):
        columns = [pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.string(), pa.string()))]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(rows)), *columns], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])


def encode(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids array<int>) for each row. The vocabulary is a .tiktoken file read on the driver; it travels with the
    tasks, about a megabyte. Each match of the pattern is encoded by itself, without special tokens. Null text
    counts as empty and gives no ids. Ids may be null or repeated; other columns are ignored. There is no shuffle."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("_text"))
    return rows.mapInArrow(partial(_ids_batches, ranks=load_ranks(vocabulary), pattern=pattern), "doc_id long, ids array<int>")


def _decode_batches(batches, tokens):
    for batch in batches:
        data = [None if ids is None else b"".join(map(tokens.__getitem__, ids)) for ids in batch.column("ids").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(data, pa.binary())], ["doc_id", "data"])


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, ids) -> (doc_id, data binary). Null ids give null; an id outside the vocabulary is an error."""
    tokens = {rank: token for token, rank in load_ranks(vocabulary).items()}
    return encoded.select("doc_id", "ids").mapInArrow(partial(_decode_batches, tokens=tokens), "doc_id long, data binary")


def round_trip(docs: DataFrame, vocabulary: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256 (the bytes decoded from the ids).

    One pass without a shuffle; nulls and repeated rows as in encode()."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), text_of(text_col).alias("_text"))
    return rows.mapInArrow(
        partial(_digest_batches, ranks=load_ranks(vocabulary), pattern=pattern), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )

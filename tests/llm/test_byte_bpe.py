import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from spanloom.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def tools():
    ranks = byte_bpe.load_ranks(PATH)
    own = byte_bpe.BytePairEncoder(ranks, public_tokenizers.PATTERN)
    return own, tiktoken.Encoding("theirs", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def texts():
    rnd = random.Random(4)
    signs = "abcdefghijklmnopqrstuvwxyzABC   \n\t\r\x0b\x1c\x1f\x85  　.,;!?'’\"0123456789éßñ漢字かな🙂👩‍👩‍👧ٱ۱²½_-́​﻿\x00"
    out = ["".join(rnd.choices(signs, k=rnd.randint(0, 80))) for _ in range(800)]
    out += ["".join(chr(c) for c in rnd.sample([x for x in range(0x11000) if not 0xD800 <= x < 0xE000], 40)) for _ in range(200)]
    out += ["<|endoftext|> it's we'll I'd they've  don't", "a" * 3000, " " * 500 + "x", "0" * 700, "the " * 20000, "࢏౜ newer letters a࢏b"]
    return out + ["Die Größe der Straße, and the naïve café; un año más tarde.\n\n  Fin"] * 2


def test_encodes_as_the_library_and_decodes(tools):
    own, theirs = tools
    for t in texts():
        ids = own.encode(t)
        assert ids == theirs.encode_ordinary(t)
        assert own.decode(ids).decode() == t


def test_appends_and_edits_equal_a_fresh_encoding(tools):
    own, _ = tools
    rnd = random.Random(2)
    data = bytes(rnd.choices(b"abcdefghij theingst", k=3000))
    p = byte_bpe.Prefixes(own, data[:1000])
    for i in range(1000, 3000, 7):
        p.append(data[i : i + 7])
    assert p.tokens() == byte_bpe.Prefixes(own, data).tokens()
    again = []
    for _ in range(40):
        a = rnd.randrange(len(p.data))
        b = min(len(p.data), a + rnd.randrange(6))
        again.append(p.replace(a, b, bytes(rnd.choices(b"abcthe", k=rnd.randrange(6)))))
        assert p.tokens() == byte_bpe.Prefixes(own, bytes(p.data)).tokens() and own.decode(p.tokens()) == bytes(p.data)
    assert sorted(again)[20] < 1500


def test_query_operators(spark, tools):
    _, theirs = tools
    rows = list(enumerate(texts())) + [(None, "null id"), (5, "again"), (5, "again"), (9999, None), (10000, "")]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, ids string").repartition(3)
    got = sorted(map(str, (tuple(r) for r in byte_bpe.round_trip(docs, PATH, public_tokenizers.PATTERN).collect())))
    want = []
    for i, t in rows:
        ids = theirs.encode_ordinary(t or "")
        want.append(str((i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())))
    assert got == sorted(want)
    back = byte_bpe.decode(byte_bpe.encode(docs, PATH, public_tokenizers.PATTERN), PATH)
    assert sorted((str(r.doc_id), bytes(r.data)) for r in back.collect()) == sorted((str(i), (t or "").encode()) for i, t in rows)
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert byte_bpe.round_trip(empty, PATH, public_tokenizers.PATTERN).count() == 0

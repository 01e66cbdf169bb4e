import hashlib
import random
import re

import pytest

from spanloom.llm import registry, substring_dedup


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def brute(rows, window=20):
    """Per row: words kept, and how many went."""
    first, docs = {}, []
    for i, text in rows:
        docs.append((2**63 - 1 if i is None else i, words_of(text)))
    for i, w in docs:
        for s in range(len(w) - window + 1):
            key = tuple(w[s : s + window])
            first[key] = min(first.get(key, (i, s)), (i, s))
    out = []
    for (i, w), (j, _) in zip(docs, rows):
        gone = set()
        for s in range(len(w) - window + 1):
            if first[tuple(w[s : s + window])] < (i, s):
                gone |= set(range(s, s + window))
        out.append((j, len(w), len(gone), [x for k, x in enumerate(w) if k not in gone]))
    return out


def cases():
    rnd = random.Random(9)
    vocabulary = ["w%d" % i for i in range(300)] + ["ß", "naïve"]
    passage = " ".join(rnd.choices(vocabulary, k=70))
    rows = []
    for i in range(120):
        t = " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 150)))
        if i % 3 == 0:
            t += rnd.choice([" ", "\n", "\t "]) + passage + " " + " ".join(rnd.choices(vocabulary, k=rnd.randint(0, 40)))
        rows.append((rnd.randrange(10**6), t))
    rows += [(10**7 + k, rows[k][1]) for k in range(15)]
    rows += [(1, "again " * 300), (0, "a b " * 120), (2, None), (3, ""), (4, "  lead " + passage), (None, passage), (None, None)]
    rows += [rows[0], (rows[3][0], passage + " other end"), (7, "x" * 3000 + " " + passage), (8, "long " + " ".join(rnd.choices(vocabulary, k=30000)))]
    rnd.shuffle(rows)
    return rows


@pytest.mark.parametrize("crowded_from, most", [(100_000, 500_000), (20, 500_000), (100_000, 7), (20, 1)])
def test_matches_brute_force(spark, crowded_from, most, monkeypatch):
    monkeypatch.setattr(substring_dedup, "_SURVEYED", 1 if crowded_from < 100 else 16)
    monkeypatch.setattr(substring_dedup, "_REMEMBERED", 50)
    rows = cases()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    out = substring_dedup.substring_dedup(docs, crowded_from=crowded_from, most=most).collect()
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, words_of(r.text)) for r in out)
    assert got == sorted((str(i), n, m, w) for i, n, m, w in brute(rows))
    assert sum(r.n_removed for r in out) > 2000
    untouched = {(r.doc_id, r.text) for r in out if not r.n_removed}
    assert untouched <= set(rows)


def test_empty_table_and_clashing_columns(spark):
    assert substring_dedup.substring_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "a " * 50, 3, 4, None)], "doc_id long, text string, _id int, n_words int, `odd name.` string")
    row = substring_dedup.substring_dedup(docs).first()
    assert (row._id, row.n_words, row.n_removed, row.text.split()) == (3, 50, 49, ["a"])


def test_the_query(spark, tmp_path):
    rows = cases()
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in registry.op2_substring_dedup(spark, str(tmp_path)).collect())
    assert got == sorted((str(i), n, m, hashlib.sha256(" ".join(w).encode()).hexdigest()) for i, n, m, w in brute(rows))

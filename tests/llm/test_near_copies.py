import random
import re
from fractions import Fraction
from itertools import combinations

import corpus_pipeline
from spanloom.llm import near_copies


def brute_set(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return frozenset(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1))))


def jaccard(a, b):
    return Fraction(len(a & b), len(a | b)) if a | b else Fraction(1)


def cases():
    rnd = random.Random(8)
    vocabulary = ["Wort%d" % i for i in range(500)] + ["é", "A"]
    passage = rnd.choices(vocabulary, k=60)
    texts = [rnd.choices(vocabulary, k=rnd.choice((3, 7, 8, 9, 12, 30, 80, 200))) for _ in range(90)]
    texts += [passage + rnd.choices(vocabulary, k=rnd.randint(1, 15)) for _ in range(25)]
    for t in texts[:90]:
        for edits in (1, 2, 3):
            w = list(t)
            for _ in range(edits):
                at = rnd.randrange(len(w))
                w[at : at + rnd.randint(0, 1)] = rnd.choices(vocabulary, k=rnd.randint(0, 2))
            texts.append(w)
    rows = list(enumerate(" ".join(t) for t in texts))
    rnd.shuffle(rows)
    n = len(rows)
    return rows + [(n + k, rows[k][1].upper().replace("É", "é")) for k in range(9)] + [(n + 20, None), (n + 21, " "), (None, rows[4][1]), (None, None), (n + 30, "solo " * 9000)]


def test_links_are_all_pairs_of_a_similarity_of_four_fifths(spark):
    rows = cases()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    sets = near_copies.shingle_sets(docs, "doc_id", "text", 5).cache()
    by_id = {r._id: r._fp for r in sets.collect()}
    named = {by_id[i]: brute_set(t) for i, t in rows if i is not None}
    found = {frozenset((r.u, r.v)) for r in near_copies.links(sets.select("_fp", "_n", "_set")).collect()}
    alike = {frozenset(p): jaccard(*(named[x] for x in p)) for p in combinations(named, 2)}
    assert len(set(named.values())) == len(named)
    assert found == {p for p, j in alike.items() if j >= Fraction(4, 5)}
    assert sum(Fraction(4, 5) <= alike[p] < Fraction(9, 10) for p in found) > 20 and Fraction(4, 5) in alike.values()


def test_the_stage_keeps_one_of_each_group(spark):
    rows = cases()
    key = [(2**63 - 1 if i is None else i) for i, _ in rows]
    sets, root = [brute_set(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in combinations(range(len(rows)), 2):
        if jaccard(sets[a], sets[b]) >= Fraction(4, 5):
            root[find(a)] = find(b)
    least = {}
    for k in range(len(rows)):
        least[find(k)] = min(least.get(find(k), key[k]), key[k])
    want = sorted(least.values())
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _set string")
    out = corpus_pipeline.drop_near_copies(spark, docs, "")
    assert out.columns == docs.columns
    assert sorted(2**63 - 1 if r.doc_id is None else r.doc_id for r in out.collect()) == want and len(want) < len(rows)


def test_an_edited_copy_is_dropped(spark):
    words = ["w%d" % i for i in range(100)]
    edited = words[:50] + ["other"] + words[51:]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(words[:70]))], "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()) == [1, 3]
    assert corpus_pipeline.drop_near_copies(spark, docs.limit(0), "").count() == 0


def test_heads_lose_no_near_copy(spark):
    rows = cases()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    sets = near_copies.shingle_sets(docs, "doc_id", "text", 5)
    near = {x for r in near_copies.links(sets.select("_fp", "_n", "_set")).collect() for x in (r.u, r.v)}
    able = {r._fp for r in near_copies._able(near_copies.shingle_sets(docs, "doc_id", "text", 5, heads=True)).collect()}
    assert near and near <= able and len(able) < len({brute_set(t) for _, t in rows})


def test_a_repeated_id_keeps_only_the_text_that_stays(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(30)) for x in "abc")
    docs = spark.createDataFrame([(3, a), (7, a), (7, b), (None, a), (None, c)], "doc_id long, text string")
    kept = corpus_pipeline.drop_near_copies(spark, docs, "").collect()
    assert sorted((str(r.doc_id), r.text) for r in kept) == sorted([("3", a), ("7", b), ("None", c)])


def test_the_pipeline_runs_its_stages_in_a_row(spark, tmp_path):
    """run() is its stages applied one by one, with the near-dedup stage held against Jaccard similarity by brute force."""
    import corpus_pipeline
    from test_pipeline import corpus, key

    corpus(tmp_path, spark)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for k, (_, apply) in enumerate(corpus_pipeline.STAGES[:-1]):
        before = docs.select("doc_id", "text").collect()
        apply(spark, docs, str(tmp_path)).write.parquet(f"{tmp_path}/stage{k}")
        docs = spark.read.parquet(f"{tmp_path}/stage{k}")
        if k == 2:
            sets = {key(r.doc_id): brute_set(r.text) for r in before}
            root = {i: i for i in sets}

            def find(x):
                while root[x] != x:
                    x = root[x]
                return x

            for a, b in combinations(sorted(sets), 2):
                if jaccard(sets[a], sets[b]) >= Fraction(4, 5):
                    x, y = sorted((find(a), find(b)))
                    root[y] = x
            assert {key(r.doc_id) for r in docs.select("doc_id").collect()} == {i for i in sets if find(i) == i}
            assert any(find(i) != i for i in sets)
    columns = ("doc_id", "piece", "start", "length", "ids_crc32")
    one_by_one = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).select(*columns).collect()
    assert sorted(map(str, one_by_one)) == sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).select(*columns).collect()))

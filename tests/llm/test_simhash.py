import random
import re

import xxhash

from spanloom.llm import simhash
from spanloom.llm.components import components


def brute_fingerprint(text, shingle=4):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not words:
        return 0
    grams = [words] if len(words) < shingle else [words[i : i + shingle] for i in range(len(words) - shingle + 1)]
    hashes = [xxhash.xxh64_intdigest(" ".join(g).encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, distance=4):
    fps = [brute_fingerprint(t) for _, t in rows]
    distinct = sorted(set(fps))
    root = {f: f for f in distinct}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(distinct):
        for b in distinct[i + 1 :]:
            if bin(a ^ b).count("1") <= distance:
                root[find(a)] = find(b)
    least = {}
    for (i, _), f in zip(rows, fps):
        least[find(f)] = min(least.get(find(f), 2**63 - 1), 2**63 - 1 if i is None else i)
    return sorted((str(i), f"{f:016x}", least[find(f)] if least[find(f)] < 2**63 - 1 else None) for (i, _), f in zip(rows, fps))


def cases():
    rnd = random.Random(5)
    vocabulary = ["Wort%d" % i for i in range(60)] + ["é", "naïve", "A", "I"]
    texts = [" ".join(rnd.choices(vocabulary, k=rnd.randint(1, 120))) for _ in range(150)]
    near = []
    for t in texts[:60]:
        w = t.split()
        w[rnd.randrange(len(w))] = "changed"
        near.append("  ".join(w))
    texts += near + texts[:20] + [None, "", " \n", "one", "one two", "one\ttwo", "x" * 5000 + " y", "word " * 40000, " 　 b"]
    rows = [(i, t) for i, t in enumerate(texts)]
    return rows + [(3, texts[3]), (None, "nobody"), (None, None), (-5, texts[7])]


def got(df):
    return sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in df.collect())


def test_matches_brute_force_at_every_depth(spark):
    rows = cases()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    want = brute(rows)
    for deep_from in (4096, 1, 0):
        assert got(simhash.near_duplicates(docs, deep_from=deep_from)) == want


def test_links_lose_nothing(spark):
    rnd = random.Random(1)
    base = [rnd.getrandbits(64) for _ in range(40)] + [0, 2**64 - 1]
    fps = set(base)
    for f in base:
        for _ in range(20):
            g = f
            for b in rnd.sample(range(64), rnd.randint(1, 6)):
                g ^= 1 << b
            fps.add(g)
    signed = [f - 2**64 if f >> 63 else f for f in fps]
    df = spark.createDataFrame([(f,) for f in signed], "_fp long")
    for distance, deep_from in ((4, 4096), (4, 0), (3, 2), (1, 1)):
        want = {(a, b) for a in signed for b in signed if a < b and bin((a ^ b) & (2**64 - 1)).count("1") <= distance}
        assert {(r.u, r.v) for r in simhash.links(df, distance, deep_from).collect()} == want


def test_empty_table_and_clashing_columns(spark):
    assert simhash.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    docs = spark.createDataFrame([(1, "a b c d e", 7, 8), (2, "a b c d e", 7, 8), (3, None, 7, 8)], "doc_id long, text string, _fp int, component_id int")
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [1, 3]


def test_components_of_a_long_path_and_a_hub(spark):
    path = [(i, i + 1) for i in range(300)]
    hub = [(1000, 1000 + i) for i in range(1, 500)] + [(5, 5), (2000, 2000)]
    found = {r.node: r.root for r in components(spark.createDataFrame(path + hub + hub, "u long, v long")).collect()}
    assert all(found[i] == 0 for i in range(1, 301)) and all(found[1000 + i] == 1000 for i in range(1, 500)) and 2000 not in found
    assert components(spark.createDataFrame([], "u long, v long")).count() == 0

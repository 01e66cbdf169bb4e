import random
import re
from collections import Counter
from fractions import Fraction
from itertools import combinations

from test_near_copies import brute_set, jaccard
from test_near_copies import cases as edited_cases
from test_simhash import brute_fingerprint

import corpus_pipeline
from spanloom.llm import near_copies


def brute_bag(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", low)
    return Counter(tuple(words[i : i + 5]) for i in range(max(len(words) - 4, min(len(words), 1))))


class Text:
    def __init__(self, text):
        self.fp, self.set, self.bag = brute_fingerprint(text, 5), brute_set(text), brute_bag(text)

    def close(self, other):
        return bin(self.fp ^ other.fp).count("1") <= 4

    def by_fingerprint(self, other):
        both, either = (self.bag & other.bag).total(), (self.bag | other.bag).total()
        return self.close(other) and (not either or Fraction(both, either) >= Fraction(4, 5))

    def by_set(self, other):
        return jaccard(self.set, other.set) >= Fraction(4, 5)


def repeating(rnd, most=200, own=10):
    """A text that mostly repeats one shingle, with an end of its own: close to its like by fingerprint, not by set."""
    return "over " * most + " ".join("own%d" % rnd.randrange(10**6) for _ in range(own))


def kept(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    return sorted(2**63 - 1 if r.doc_id is None else r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect())


def test_fingerprints_link_what_sets_do_not(spark):
    rnd = random.Random(4)
    a, b, other = repeating(rnd), repeating(rnd), " ".join("w%d" % i for i in range(40))
    assert Text(a).by_fingerprint(Text(b)) and not Text(a).by_set(Text(b))
    assert kept(spark, [(1, a), (2, b), (3, other)]) == [1, 3]


def test_groups_reach_over_links_of_both_kinds(spark):
    rnd = random.Random(4)
    a, b = repeating(rnd, 200, 20), repeating(rnd, 200, 20)
    c = "over " * 5 + b[b.index("own") :]  # the set of b, without its repeats
    x, y, z = Text(a), Text(b), Text(c)
    assert x.by_fingerprint(y) and not x.by_set(y)
    assert y.by_set(z) and not y.by_fingerprint(z)
    assert not x.by_fingerprint(z) and not x.by_set(z)
    assert kept(spark, [(5, a), (6, b), (4, c)]) == [4]


def test_the_stage_keeps_one_of_each_group_of_either_link(spark):
    rnd = random.Random(21)
    rows = edited_cases() + [(2000 + i, repeating(rnd, rnd.choice((30, 120, 400)))) for i in range(20)]
    key = [(2**63 - 1 if i is None else i) for i, _ in rows]
    texts, root = [Text(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    alone = refused = 0
    for a, b in combinations(range(len(rows)), 2):
        near, alike = texts[a].by_fingerprint(texts[b]), texts[a].by_set(texts[b])
        alone += near and not alike
        refused += texts[a].close(texts[b]) and not near and not alike
        if near or alike:
            root[find(a)] = find(b)
    least = {}
    for k in range(len(rows)):
        least[find(k)] = min(least.get(find(k), key[k]), key[k])
    assert alone and refused and kept(spark, rows) == sorted(least.values())


def test_fingerprints_of_the_stage_and_their_pairs(spark):
    """With every set a group of its own, fingerprints give all pairs of bags that a plain search finds."""
    rnd = random.Random(3)
    rows = [(i, t) for i, t in edited_cases()[:300] if i is not None] + [(2000 + i, repeating(rnd)) for i in range(9)] + [(3000, ""), (3001, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    heads = near_copies.shingle_sets(docs, "doc_id", "text", 5, heads=True).cache()
    assert {r._id: r._sim & 2**64 - 1 for r in heads.collect()} == {i: brute_fingerprint(t, 5) for i, t in rows}
    bags = {r._bag: r for r in heads.collect()}
    assert len(bags) == len({frozenset(brute_bag(t).items()) for _, t in rows})
    units = heads.selectExpr("_bag", "_sim", "_fp as _root", "struct(_id, _key) as _least").dropDuplicates(["_bag"])
    found = [frozenset((r._u, r._v)) for r in near_copies.by_fingerprint(units, 4).collect()]
    assert len(found) == len(set(found))
    want = {frozenset((a, b)) for a, b in combinations(bags, 2) if bags[a]._fp != bags[b]._fp and bin((bags[a]._sim ^ bags[b]._sim) & 2**64 - 1).count("1") <= 4}
    assert set(found) == want and len(want) > 40

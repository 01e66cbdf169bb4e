import numpy as np
import pytest

from spanloom.llm import embedding_dedup


def brute(rows, least=0.98):
    out, ok = {}, []
    for k, (i, v, lab) in enumerate(rows):
        good = v is not None and lab is not None and len(v) > 0 and all(x is not None and np.isfinite(x) for x in v) and any(v)
        ok.append(np.float32(v).astype(float) if good else None)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    n = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a + 1, len(rows)):
            u, v = ok[a], ok[b]
            if u is None or v is None or rows[a][2] != rows[b][2] or len(u) != len(v):
                continue
            if u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= least:
                n[a] += 1
                n[b] += 1
                root[find(a)] = find(b)
    least_id = {}
    key = lambda r: 2**63 - 1 if r[0] is None else r[0]
    for k, r in enumerate(rows):
        least_id[find(k)] = min(least_id.get(find(k), 2**63 - 1), key(r))
    return sorted((str(r[0]), n[k], str(None if least_id[find(k)] == 2**63 - 1 else least_id[find(k)]), key(r) == least_id[find(k)]) for k, r in enumerate(rows))


def cases():
    rng = np.random.default_rng(3)
    rows, i = [], 0
    for _ in range(25):
        base, lab = rng.standard_normal(32), int(rng.integers(3))
        for _ in range(int(rng.integers(1, 9))):
            rows.append((i, (base + rng.standard_normal(32) * rng.uniform(0, 0.2)).astype(np.float32).tolist(), lab))
            i += 1
    same = rows[0][1]
    rows += [(1000 + k, same, rows[0][2]) for k in range(40)]
    rows += [(2000, (np.float32(same) * 3).tolist(), rows[0][2]), (2001, same, None), (2002, None, 1), (2003, [0.0] * 32, 1), (2004, [], 1)]
    rows += [(2005, [float("nan")] + same[1:], 1), (2006, [float("inf")] + same[1:], 1), (2007, [None] + same[1:], 1), (2008, same[:5], rows[0][2]), (None, rows[5][1], rows[5][2]), (None, None, 1)]
    return rows


@pytest.mark.parametrize("crowded", [4096, 6])
def test_matches_brute_force(spark, crowded):
    rows = cases()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").repartition(3)
    got = sorted((str(r.vec_id), r.n_links, str(r.component_id), r.kept) for r in embedding_dedup.near_duplicates(df, crowded=crowded).collect())
    assert got == brute(rows)


def test_empty_and_extra_columns(spark):
    assert embedding_dedup.near_duplicates(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0
    df = spark.createDataFrame([(1, [1.0, 2.0], 1, 5), (2, [1.0, 2.0], 1, 5)], "vec_id long, embedding array<double>, label int, kept int")
    assert sorted(map(tuple, embedding_dedup.near_duplicates(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]


def test_recall_at_the_threshold(spark):
    rng = np.random.default_rng(8)
    rows = []
    for k in range(400):
        a = rng.standard_normal(64)
        a /= np.linalg.norm(a)
        b = rng.standard_normal(64)
        b -= (b @ a) * a
        b /= np.linalg.norm(b)
        rows += [(2 * k, a.tolist(), 0), (2 * k + 1, (0.9801 * a + np.sqrt(1 - 0.9801**2) * b).tolist(), 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    assert embedding_dedup.near_duplicates(df).filter("n_links > 0").count() >= 0.99 * 800

import random
import zlib
from collections import Counter, defaultdict

from spanloom.llm import sharding


def check(rows, out, shards):
    size = lambda t: len((t or "").encode()) + 16
    assert Counter((r.doc_id, r["size"], r.text_crc32) for r in out) == Counter((i, size(t), zlib.crc32((t or "").encode())) for i, t in rows)
    slots, weight = defaultdict(list), Counter()
    for r in out:
        assert r.law == "bytes" and 0 <= r.shard < shards and r.grown_shard is None
        slots[r.shard].append(r.slot)
        weight[r.shard] += r["size"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    share = sum(weight.values()) / shards
    text_of = dict(rows)
    groups, where = Counter(), defaultdict(set)
    for r in out:
        groups[text_of[r.doc_id]] += r["size"]
        where[text_of[r.doc_id]].add(r.shard)
    assert all(len(where[t]) == 1 for t, w in groups.items() if w <= share or len([r for r in rows if r[1] == t]) == 1)
    most = max([size(t) for _, t in rows] + [w for w in groups.values() if w <= share / 20])
    assert all(abs(weight[k] - share) <= 2 * most + 1 for k in range(shards))


def rows_of(n, hot=0):
    rnd = random.Random(n)
    rows = [(i, "".join(rnd.choices("abcdé \n", k=rnd.randint(0, 400)))) for i in range(n)]
    rows += [(10**6 + i, "hot text " * 5) for i in range(hot)] + [(2 * 10**6 + i, f"some {i % 7}") for i in range(30)]
    return rows + [(None, None), (3 * 10**6, None), (3 * 10**6 + 1, ""), (4 * 10**6, "long " * 2000)]


def test_near_equal_shards_and_groups_together(spark):
    rows = rows_of(6000)
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 8).collect()
    check(rows, out, 8)


def test_a_hot_text_is_cut(spark):
    rows = rows_of(2000, 3000)
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, shard int").repartition(3)
    check(rows, sharding.shard(df, 8).collect(), 8)


def test_groups_up_to_a_shard_stay_whole(spark):
    rows = rows_of(2000)
    share = sum(len((t or "").encode()) + 16 for _, t in rows) / 8
    for part, text in ((0.6, "first group " * 9), (0.55, "second group " * 9), (0.9, "third group " * 3), (0.06, "fourth " * 9)):
        rows += [(10**6 + len(rows) + i, text) for i in range(int(part * share / (len(text) + 16)))]
    check(rows, sharding.shard(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), 8).collect(), 8)


def test_overfull_ranges_are_subdivided(spark):
    rows = spark.range(20_000).selectExpr("if(id < 15000, 7, id) as _key", "xxhash64(id) as _tie", "20L as size")
    total, ranges = 20_000 * 20, 64
    cuts = sharding.splitters(rows, ranges, total)
    found = rows.withColumn("r", sharding._range_of(cuts)("_key", "_tie")).groupBy("r").count().collect()
    assert max(r["count"] for r in found) <= sharding.OVERFULL * 20_000 / ranges and (cuts[:, 0] == 7).sum() > 20


def test_few_rows_repeats_and_empty(spark, tmp_path):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    rows = [(1, "a"), (1, "a"), (2, None)]
    check([(1, "a"), (1, "a"), (2, None)], sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect(), 4)
    docs = spark.createDataFrame([(i, f"text {i}") for i in range(200)], "doc_id long, text string")
    placed = sharding.shard(docs, 4)
    sharding.write_shards(docs, placed, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out")
    assert sorted((r.doc_id, r.text, r.shard, r.slot) for r in back.collect()) == sorted((r.doc_id, f"text {r.doc_id}", r.shard, r.slot) for r in placed.collect())

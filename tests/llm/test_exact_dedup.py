import hashlib
import random
import re

from pyspark.sql import functions as F

from spanloom.llm import exact_dedup


def brute(rows):
    norm = lambda t: re.sub(r"[\x20\x09-\x0D]", "", t or "")
    key = lambda i: 2**63 - 1 if i is None else i
    groups = {}
    for i, t in rows:
        groups.setdefault(norm(t), []).append((-len(t or ""), key(i), i))
    out = []
    for i, t in rows:
        g = groups[norm(t)]
        best = min(g, key=lambda x: x[:2])
        out.append((str(i), str(best[2]), len(g), key(i) == best[1], hashlib.sha256(norm(t).encode()).hexdigest()))
    return sorted(out)


def cases():
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choices("ab \n", k=rnd.randint(0, 5)))) for i in range(400)]
    rows += [(1000 + i, "hot text") for i in range(200)] + [(-3, "hot  text"), (-9, "hottext"), (None, "alone"), (None, None), (5000, None), (5001, ""), (5002, "\t\r\x0b\x0c")]
    rows += [(7, "again"), (7, "again"), (8, " again"), (9000, "long " * 50_000), (9001, "long" * 50_000), (9002, "no break"), (9003, "é漢🙂 x"), (9004, "é漢 🙂x ")]
    return rows


def got(df):
    return sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.kept, r.text_sha256) for r in df.collect())


def test_matches_brute_force_even_where_hashes_collide(spark):
    rows = cases()
    docs = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int").repartition(3)
    assert got(exact_dedup.exact_dedup(docs)) == brute(rows)
    assert got(exact_dedup.exact_dedup(docs, content_hash=lambda c: (F.length(c) % 3).cast("string"))) == brute(rows)


def test_empty(spark):
    assert exact_dedup.exact_dedup(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_no_python_in_the_plan(spark):
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    plan = exact_dedup.exact_dedup(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)

import random
import zlib

import numpy as np

from spanloom.llm import registry, toxicity


def test_held_out_accuracy(spark):
    out = registry.op5_toxicity(spark, "/root/testdata/sf0.1").toPandas()
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").toPandas()
    assert list(out.columns) == ["doc_id", "held_out", "score", "predicted"] and len(out) == 10_000
    assert all(h == (zlib.crc32(str(i).encode()) % 5 == 0) for i, h in zip(out.doc_id, out.held_out))
    assert out.score.between(0, 1).all() and (out.predicted == (out.score >= 0.5)).all()
    both = out[out.held_out].merge(labels, on="doc_id")
    hit, told = both.toxic == 1, both.predicted == 1
    # the labels of this table contradict the texts here and there, and few documents of some languages are labelled
    assert hit.sum() > 30 and (hit & told).sum() >= 0.6 * hit.sum() and (hit & told).sum() >= 0.85 * told.sum()


def small():
    rnd = random.Random(1)
    calm = ["meadow", "river", "quiet", "the", "of", "and", "garden", "winter"]
    rows, labels = [], []
    for i in range(400):
        words = rnd.choices(calm, k=rnd.randint(3, 40))
        bad = i % 4 == 0
        if bad:
            words[rnd.randrange(len(words))] = "vileword"
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_nulls_empty_texts_and_odd_labels(spark):
    rows, labels = small()
    rows += [(None, "vileword here"), (None, None), (9000, ""), (9001, None), (9002, "The VILEWORD is"), (9003, "the river " * 50_000), (3, rows[3][1])]
    docs = spark.createDataFrame([(i, t, 0.5) for i, t in rows], "doc_id long, text string, score double")
    known = spark.createDataFrame(labels + [(None, 1, 1), (9000, 1, None), (7, 1, 0), (10**9, 1, 1)], "doc_id long, quality int, toxic int")
    out = toxicity.toxicity(docs, known).collect()
    assert len(out) == len(rows)
    told = {r.doc_id: r.predicted for r in out}
    assert all(told[i] == t for i, _, t in labels) and told[9002] == 1 and told[9000] == told[9001] == told[9003] == 0
    assert sorted(r.predicted for r in out if r.doc_id is None) == [0, 1]
    kept = toxicity.keep_clean(docs, known)
    assert kept.columns == docs.columns and kept.count() == sum(r.predicted == 0 for r in out)


def test_missing_labels(spark):
    rows, labels = small()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    schema = "doc_id long, toxic int"
    assert {r.score for r in toxicity.toxicity(docs, spark.createDataFrame([], schema)).collect()} == {toxicity.Model(np.zeros(4), -500.0).score([""])[0]}
    assert {r.predicted for r in toxicity.toxicity(docs, spark.createDataFrame([(i, 1) for i, _ in rows], schema)).collect()} == {1}
    assert toxicity.toxicity(docs.limit(0), spark.createDataFrame([(1, 1), (2, 0)], schema)).count() == 0

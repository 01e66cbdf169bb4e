"""Toxicity: a linear classifier of character n-grams whose features are scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from .common import text_of

#: Orders of the n-grams and the number of hashed features.
ORDERS, FEATURES = (3, 4, 5), 1 << 18
#: Labelled rows that are learnt from, at most, of label 1 and of label 0: those whose ids hash lowest.
MOST_TOXIC, MOST_CLEAN = 1000, 3000
EPOCHS, RATE, DECAY = 3, 0.1, 1e-4


def features(text: str | None) -> np.ndarray:
    """Hashed n-grams of the lower-cased text with its white space made single blanks, one at either end. Repeats included."""
    b = np.frombuffer(f" {' '.join((text or '').lower().split())} ".encode("utf-32-le"), np.uint32).astype(np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for n in ORDERS:
            if len(b) >= n:
                h = np.full(len(b) - n + 1, n, np.uint64) * np.uint64(0x9E3779B97F4A7C15)
                for k in range(n):
                    h = (h ^ b[k : len(b) - n + 1 + k]) * np.uint64(0x9FB21C651E98DF25)
                    h ^= h >> np.uint64(32)
                out.append(((h >> np.uint64(20)) & np.uint64(FEATURES - 1)).astype(np.int32))
    return np.concatenate(out) if out else np.zeros(0, np.int32)


@dataclass(frozen=True)
class Model:
    weights: np.ndarray
    bias: float

    def score(self, texts) -> list[float]:
        place, out = np.zeros(len(self.weights), np.int32), []
        for text in texts:
            found = features(text)
            order = np.arange(len(found), dtype=np.int32)
            place[found] = order  # of a feature's occurrences the last one counts
            z = float(self.weights[found[place[found] == order]].sum(dtype=np.float64)) + self.bias
            out.append(float(1 / (1 + np.exp(-np.clip(z, -500, 500)))))
        return out


def _feature_batches(batches):
    for batch in batches:
        for k in range(batch.num_rows):
            found = np.unique(features(batch.column("_text")[k].as_py()))
            row = [batch.column("_order").slice(k, 1), batch.column("_label").slice(k, 1), pa.array([found.tobytes()], pa.binary())]
            yield pa.RecordBatch.from_arrays(row, ["_order", "_label", "_found"])


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    rows = rows.sort_values(["_order", "_label"], kind="stable")
    y = rows["_label"].to_numpy(np.float64)
    found = [np.frombuffer(x, np.int32) for x in rows["_found"]]
    if len(set(y)) < 2:  # one label only: it is all that can be said
        return pd.DataFrame({"weights": [np.zeros(FEATURES, "<f4").tobytes()], "bias": [500.0 if y[0] else -500.0]})
    counts = [np.ones(FEATURES), np.ones(FEATURES)]
    for x, label in zip(found, y):
        counts[int(label)][x] += 1
    ratio = np.log(counts[1] / (y.sum() + 2)) - np.log(counts[0] / (len(y) - y.sum() + 2))
    weight = np.where(y > 0, np.sqrt((len(y) - y.sum()) / y.sum()), 1.0)
    w, seen, bias, bias_seen = np.zeros(FEATURES), np.full(FEATURES, 1e-6), 0.0, 1e-6
    rng, order = np.random.default_rng(7), np.arange(len(y))
    for _epoch in range(EPOCHS):
        rng.shuffle(order)
        for s in range(0, len(order), 64):
            part = order[s : s + 64]
            where = np.concatenate([found[k] for k in part])
            row = np.repeat(np.arange(len(part)), [len(found[k]) for k in part])
            value = ratio[where]
            z = np.bincount(row, value * w[where], len(part)) + bias
            error = (1 / (1 + np.exp(-np.clip(z, -500, 500))) - y[part]) * weight[part] / len(part)
            ids, inverse = np.unique(where, return_inverse=True)
            slope = np.bincount(inverse, value * error[row]) + DECAY * w[ids]
            seen[ids] += slope**2
            w[ids] -= RATE * slope / np.sqrt(seen[ids])
            bias_seen += error.sum() ** 2
            bias -= RATE * error.sum() / np.sqrt(bias_seen)
    return pd.DataFrame({"weights": [(w * ratio).astype("<f4").tobytes()], "bias": [float(bias)]})


def held_out(id_col: str = "doc_id") -> Column:
    """Whether crc32 of the id as text leaves no rest by five; false for a null id."""
    return F.coalesce(F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))


def train(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    most_toxic: int = MOST_TOXIC,
    most_clean: int = MOST_CLEAN,
) -> Model:
    """Learns from documents whose label is known and whose id is not held out.

    Only so many rows of either label are read, those whose ids hash lowest; the ids of that bounded sample are
    broadcast, and one task fits the weights from the sample's hashed features. Rows whose label or id is null
    are passed over; an id with several labels counts as toxic if one of them says so. Without labelled rows
    every text scores 0, and with one label only, every text scores that label.
    """
    known = (
        labels.filter(F.col(f"`{label_col}`").isNotNull() & F.col(f"`{id_col}`").isNotNull() & ~held_out(id_col))
        .groupBy(F.col(f"`{id_col}`").cast("long").alias("_known"))
        .agg((F.max(f"`{label_col}`") > 0).cast("int").alias("_label"))
        .withColumn("_order", F.xxhash64("_known"))
    )
    # labels of documents that this table doesn't have would use up the bound
    known = known.join(docs.select(F.col(f"`{id_col}`").cast("long").alias("_known")).distinct(), "_known", "left_semi")
    parts = [known.filter(F.col("_label") == k).orderBy("_order", "_known").limit(n) for k, n in ((1, most_toxic), (0, most_clean))]
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("_known"), text_of(text_col).alias("_text")).join(F.broadcast(parts[0].union(parts[1])), "_known")
    found = rows.select("_order", "_label", "_text").mapInArrow(_feature_batches, "_order long, _label int, _found binary")
    fitted = found.groupBy(F.lit(0).alias("_all")).applyInPandas(_fit, "weights binary, bias double").first()
    if fitted is None:
        return Model(np.zeros(FEATURES, np.float32), -500.0)
    return Model(np.frombuffer(fitted.weights, "<f4"), fitted.bias)


def scorer(model: Model):
    """A column function: text -> score from 0 to 1. Null and empty texts score as texts without n-grams do."""

    @F.pandas_udf(DoubleType())
    def score(texts: pd.Series) -> pd.Series:
        return pd.Series(model.score(texts))

    return score


def toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """doc_id, held_out, score, predicted (1 from 0.5 on), one row for each input row; whole texts are scored.

    Rows with null or repeated ids each get a row. Only the text enters a score. An empty table gives an empty
    result."""
    model = train(docs, labels, id_col, text_col, label_col)
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), held_out(id_col).alias("held_out"), scorer(model)(text_of(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def keep_clean(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> DataFrame:
    """The input's rows, in its columns, that score under 0.5."""
    model = train(docs, labels, id_col, text_col, label_col)
    return docs.filter(scorer(model)(text_of(text_col)) < 0.5)

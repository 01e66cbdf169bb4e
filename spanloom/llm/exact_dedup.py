"""Exact dedup: rows grouped by a 128-bit content hash, with the bytes compared inside the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BLANKS, NO_ID, row_id, text_of

_TWO_64 = "cast('18446744073709551616' as decimal(20,0))"
#: Code points first, then the smallest id, as one number that a hash aggregate can keep in place.
_RANK = f"cast(cast(_chars as decimal(12,0)) * {_TWO_64} + (cast({NO_ID} as decimal(20,0)) - cast(_id as decimal(20,0))) as decimal(38,0))"
_KEEP = f"cast(cast({NO_ID} as decimal(20,0)) - (_rank % {_TWO_64}) as bigint)"


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", content_hash: Callable[[Column], Column] = F.md5) -> DataFrame:
    """One row per input row: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical without ASCII white space. Of equal texts the row with the most code
    points in its original text stays, then the smallest id.

    Texts meet in an aggregation by (hash, text). Its partial step folds copies inside each task, so a group
    that holds a third of all rows reaches its reducer as one row per task, and having the text in the key
    compares the bytes: texts whose hashes collide stay apart. Rows then fetch their group's winner by hash
    and SHA-256 in a join of narrow rows that adaptive execution splits where one hash is hot.

    Null text counts as empty; empty texts are equal. A null id counts as the largest id, and keep_id is null
    where such a row stays. Rows that repeat both id and text are all marked alike. Other columns are ignored.
    An empty table gives an empty result.
    """
    base = docs.select(
        row_id(id_col).alias("_id"), F.char_length(text_of(text_col)).alias("_chars"), F.translate(text_of(text_col), BLANKS, "").alias("_norm")
    ).withColumn("_hash", content_hash(F.col("_norm")))
    groups = base.groupBy("_hash", "_norm").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.expr(_RANK)).alias("_rank"))
    winners = groups.select("_hash", F.sha2("_norm", 256).alias("text_sha256"), "group_size", F.expr(_KEEP).alias("_keep"))
    rows = base.select("_id", "_chars", "_hash", F.sha2("_norm", 256).alias("text_sha256"))
    best = F.expr(f"_id = _keep")
    unnull = lambda c: F.when(F.col(c) != NO_ID, F.col(c))
    return rows.join(winners, ["_hash", "text_sha256"]).select(
        unnull("_id").alias("doc_id"), unnull("_keep").alias("keep_id"), "group_size", best.alias("kept"), "text_sha256"
    )


SQL = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS raw, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
w AS (
  SELECT doc_id, norm, first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(raw) DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(norm) AS text_sha256 FROM w
"""

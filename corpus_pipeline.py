"""The corpus pipeline: five stages, each one operator of spanloom.llm applied to all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
docs of the next. All but the last return the columns of documents. n_chars follows a text that is changed. Rows with
null or repeated ids, null or empty texts and other columns are treated as the operators say in their docstrings.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm import line_dedup, near_copies, packing, substring_dedup, toxicity
from spanloom.llm.common import stage

#: The pipeline's shingles are of five words; the query op1 takes four, as its contract says. Fingerprints may differ in four bits, as there.
SHINGLE, DISTANCE = 5, 4


def _with_text(docs: DataFrame, changed: DataFrame, removed: str) -> DataFrame:
    """changed in the columns of docs; n_chars is counted anew where something was removed."""
    columns = [F.col(f"`{c}`") for c in docs.columns]
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        n = F.when(F.col(removed) > 0, F.char_length("text").cast(kind)).otherwise(F.col("n_chars")).alias("n_chars")
        columns = [n if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns]
    return changed.select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under 0.5."""
    return toxicity.keep_clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later occurrences of three-line windows."""
    return _with_text(docs, line_dedup.line_dedup(docs), "n_removed")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies, by SimHash and similarity or by similarity alone, the document with the smallest id."""
    return near_copies.keep_one(docs, shingle=SHINGLE, distance=DISTANCE)


def drop_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the later occurrences of windows of twenty words."""
    return _with_text(docs, substring_dedup.substring_dedup(docs), "n_removed")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 tokens and their places in as few sequences as can be."""
    import public_tokenizers

    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_lines),
    ("SimHash near-dedup", drop_near_copies),
    ("substring dedup", drop_passages),
    ("best-fit packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)


#: SQL can neither fit the classifier nor hash with XXH64; tests hold the stages against brute force instead.
ORACLE_SQL = None

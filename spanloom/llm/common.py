"""What the corpus operators share: staging of intermediate tables, word rules, row keys."""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words are runs without ASCII white space.
WORD = re.compile(r"[^\x20\x09-\x0D]+")
WORD_BYTES = re.compile(rb"[^\x20\x09-\x0D]+")
BLANKS = " \t\n\x0b\x0c\r"
#: A null id sorts after every other.
NO_ID = 2**63 - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or where that is unset in local mode, a temporary one."""
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spanloom-")
        sc.setCheckpointDir(found)
    return found


def _remove(spark: SparkSession, path: str) -> None:
    sc = spark.sparkContext
    if sc._jsc is None:
        return
    p = sc._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(sc._jsc.hadoopConfiguration()).delete(p, True)


def stage(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back. That cuts the lineage, and the table outlives
    any executor. Shuffle files that only df needed are released."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/spanloom-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    atexit.register(_quietly, spark, path)
    out = spark.read.schema(schema).parquet(path)
    out._staged_at = path
    return out


def release(df: DataFrame) -> None:
    """Deletes a staged table that nothing reads any more."""
    if path := getattr(df, "_staged_at", None):
        _remove(df.sparkSession, path)


def release_shuffles(spark: SparkSession) -> None:
    """Lets Spark's cleaner drop the shuffle files of plans that are no longer referenced."""
    for _ in range(2):  # what the first pass frees on this side is only then free on the other
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.5)


def _quietly(spark: SparkSession, path: str) -> None:
    try:
        _remove(spark, path)
    except Exception:  # the session has ended; its folder may be gone as well
        return


def row_id(doc_id: str = "doc_id") -> Column:
    """The id as a long; null becomes the largest."""
    return F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))


def text_of(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def chunks(rows, weight, most: int):
    """Splits an iterable into lists whose weights add up to about most."""
    held, total = [], 0
    for row in rows:
        held.append(row)
        total += weight(row)
        if total >= most:
            yield held
            held, total = [], 0
    if held:
        yield held

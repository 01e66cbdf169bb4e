"""Line dedup: overlapping three-line windows, found repeated anywhere in the corpus, lose their later occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import row_id, stage, text_of

#: A place in the corpus, (id, line), as one number that a hash aggregate can keep in place.
_PLACE = "cast(cast(_id as decimal(20,0)) * cast(4294967296 as decimal(10,0)) + cast(_at as decimal(10,0)) as decimal(31,0))"


def windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines_in_window: int = 3) -> DataFrame:
    """(_id, _row, _at, _w): every window of consecutive lines, its first line (from 0) and its 128-bit hash.

    Lines hold no newline, so a window's lines joined by newlines are told apart from all others. The lines are
    addressed from an exploded range of places, which keeps all of it in generated code."""
    n = lines_in_window
    lines = docs.select(row_id(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_row"), F.split(text_of(text_col), "\n", -1).alias("_lines"))
    places = F.expr(f"explode(if(size(_lines) >= {n}, sequence(0, size(_lines) - {n}), array()))")
    window = F.concat_ws("\n", *[F.expr(f"_lines[_at + {k}]") for k in range(n)])
    return lines.select("_id", "_row", "_lines", places.alias("_at")).select("_id", "_row", "_at", F.unhex(F.md5(window)).alias("_w"))


def repeated_windows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines_in_window: int = 3) -> DataFrame:
    """Windows of consecutive lines that also occur at an earlier place: _id, _row, _at (first line, from 0).

    Places are ordered by (id, line). Windows are hashed once and written as a narrow table, from which both the
    counts and the join back read. First places come from an aggregation with a partial step, so a window that a
    third of all documents share reaches its reducer as one row per task; only hashes seen twice are joined back.
    """
    found = stage(windows(docs, id_col, text_col, lines_in_window))
    firsts = found.groupBy("_w").agg(F.min(F.expr(_PLACE)).alias("_first"), F.count(F.lit(1)).alias("_n")).filter("_n > 1").drop("_n")
    return found.join(firsts, "_w").filter(F.expr(f"{_PLACE} > _first")).select("_id", "_row", "_at")


def line_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lines_in_window: int = 3) -> DataFrame:
    """The input's rows and columns with the text replaced, plus n_lines and n_removed.

    Lines are split at newlines. A window of three consecutive lines that also starts at an earlier (id, line)
    is removed; windows are judged on the input. Overlapping and touching windows of a document are merged
    into spans, and the text is put together from the lines between them. Texts of fewer than three lines
    have no window and stay as they are. Texts that lose nothing are passed on unsplit.

    Null text stays null with n_lines 0. A null id sorts after all others. Rows that repeat both id and text
    count as one document and get the same result; rows that share only the id are told apart by their
    text, and a window at the same (id, line) as its first occurrence is kept. Other columns are carried along
    under their own names (of two equal names, neither is touched). An empty table gives an empty result.
    """
    n = lines_in_window
    starts = repeated_windows(docs, id_col, text_col, n).groupBy("_id", "_row").agg(F.array_sort(F.collect_set("_at")).alias("_starts"))
    # a span begins where no window reaches up to it, and ends where none follows
    spans = starts.select(
        "_id",
        "_row",
        F.expr(f"filter(_starts, (x, i) -> i = 0 or x > _starts[i - 1] + {n})").alias("_from"),
        F.expr(f"transform(filter(_starts, (x, i) -> i = size(_starts) - 1 or _starts[i + 1] > x + {n}), x -> x + {n})").alias("_to"),
    )
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), row_id(id_col).alias("_id"), F.xxhash64(text_of(text_col)).alias("_row")
    )
    whole = F.col(f"_doc.`{text_col}`").cast("string")
    # a column of its own, so that a text is split once; used more than once, it stays one
    both = rows.join(spans, ["_id", "_row"], "left").withColumn("_lines", F.when(F.col("_from").isNotNull(), F.split(whole, "\n", -1)))
    kept = F.expr(
        """array_join(concat(slice(_lines, 1, _from[0]),
           flatten(transform(_to, (x, i) -> slice(_lines, x + 1, if(i + 1 < size(_from), _from[i + 1], size(_lines)) - x)))), "\\n")"""
    )
    removed = F.expr("aggregate(_to, 0L, (a, x) -> a + x) - aggregate(_from, 0L, (a, x) -> a + x)")
    out = both.select(
        "_doc",
        F.when(F.col("_from").isNull(), whole).otherwise(kept).alias("_text"),
        F.when(whole.isNull(), 0).otherwise(F.octet_length(whole) - F.octet_length(F.replace(whole, F.lit("\n"), F.lit(""))) + 1).cast("long").alias("n_lines"),
        F.when(F.col("_from").isNull(), 0).otherwise(removed).cast("long").alias("n_removed"),
    )
    columns = [F.col("_text").alias(c) if c == text_col else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns if c not in ("n_lines", "n_removed")]
    return out.select(*columns, "n_lines", "n_removed")


SQL = r"""
WITH l AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
w AS (SELECT doc_id, i, ls[i+1] || chr(10) || ls[i+2] || chr(10) || ls[i+3] AS win
      FROM (SELECT doc_id, ls, unnest(range(0, len(ls) - 2)) AS i FROM l WHERE len(ls) >= 3)),
r AS (SELECT doc_id, i, row_number() OVER (PARTITION BY win ORDER BY doc_id, i) AS k FROM w),
c AS (SELECT DISTINCT doc_id, i + d AS i FROM r, (SELECT unnest([0, 1, 2]) AS d) WHERE k > 1),
n AS (SELECT doc_id, count(*) AS n_removed, list(i) AS gone FROM c GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(len(l.ls), 0) AS BIGINT) AS n_lines, CAST(coalesce(n.n_removed, 0) AS BIGINT) AS n_removed,
       sha256(CASE WHEN n.gone IS NULL THEN coalesce(d.text, '') ELSE
         coalesce(array_to_string([l.ls[j+1] FOR j IN range(0, len(l.ls)) IF NOT list_contains(n.gone, j)], chr(10)), '') END) AS kept_sha256
FROM documents d LEFT JOIN l USING (doc_id) LEFT JOIN n USING (doc_id)
"""

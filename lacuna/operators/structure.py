"""Lines, running headers and line offsets of canonical text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lacuna.functions.text import digits_masked, strip

#: Least number of repeats and most variation of their distances for a running header.
MIN_REPEATS, MAX_VARIATION = 3, 0.35


def lines(docs: DataFrame, text_col: str = "canonical_text") -> DataFrame:
    """doc_id, line_idx, line, line_start: a running sum of the lengths before, each with its newline."""
    rows = docs.select("doc_id", F.posexplode(F.split(text_col, "\n", -1)).alias("line_idx", "line"))
    before = Window.partitionBy("doc_id").orderBy("line_idx").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("line_start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long"))


def running_headers(docs: DataFrame, text_col: str = "canonical_text") -> DataFrame:
    """doc_id, key, hits, mean_gap: lines (digits masked) that recur in a document at even distances."""
    keyed = lines(docs, text_col).withColumn("key", digits_masked(strip(F.col("line")))).where("key <> ''")
    return even_repeats(keyed)


def even_repeats(keyed: DataFrame) -> DataFrame:
    """doc_id, key, hits, mean_gap of the keys that recur in a document at even distances. keyed: doc_id, key, line_start."""
    order = Window.partitionBy("doc_id", "key").orderBy("line_start")
    gaps = keyed.withColumn("gap", F.col("line_start") - F.lag("line_start").over(order))
    found = gaps.groupBy("doc_id", "key").agg(F.count("*").alias("hits"), F.avg("gap").alias("mean_gap"), F.stddev_pop("gap").alias("spread"))
    return found.where((F.col("hits") >= MIN_REPEATS) & (F.col("mean_gap") > 0) & (F.col("spread") <= MAX_VARIATION * F.col("mean_gap"))).select("doc_id", "key", "hits", "mean_gap")

"""Structured Streaming forms: all row-level operators are stateless maps; keep-first dedup holds state up to a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmill.functions import text as T
from quillmill.operators import reports


def residue_stream(rows: DataFrame) -> DataFrame:
    """Rows with outputs that hit named rules, as they come."""
    return reports.named_audit(rows).where(F.size("hits") > 0)


def residue_counts(rows: DataFrame, time: str, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """window, label, n; a window closes once the watermark passes it."""
    each = reports.named_audit(rows).withWatermark(time, late).select(time, F.explode("hits").alias("label"))
    return each.groupBy(F.window(time, window), "label").agg(F.count("*").alias("n"))


def keep_first_stream(rows: DataFrame, time: str, late: str = "10 minutes") -> DataFrame:
    """W3 over a stream: the first seen of each normalized (question, output) within the watermark."""
    key = F.sha2(F.concat_ws("\x00", T.dedup_text(F.col("input")), T.dedup_text(F.col("output"))), 256)
    return rows.withColumn("dedup_id", key).withWatermark(time, late).dropDuplicatesWithinWatermark(["dedup_id"]).drop("dedup_id")

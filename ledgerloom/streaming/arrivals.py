"""Ledger files that arrive over time (an extension: the batch rules are the same).

New rows are matched as they come by the exact rule's stream form: a stream-stream join on equal keys within a band
of event time, whose state a watermark bounds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.functions.scores import amount_key


def candidate_stream(gl: DataFrame, sub: DataFrame, days: int = 30, late: str = "1 day") -> DataFrame:
    """Pairs (a, b) of two streams of canonical rows (id, vn, amount, entity, at) with equal keys and times within days."""
    g = gl.withColumn("k", amount_key(F.col("amount"))).withWatermark("at", late).alias("g")
    s = sub.withColumn("k", amount_key(F.col("amount"))).withWatermark("at", late).alias("s")
    near = F.expr(f"s.at BETWEEN g.at - INTERVAL {days} DAYS AND g.at + INTERVAL {days} DAYS")
    on = (F.col("g.vn") == F.col("s.vn")) & (F.col("g.k") == F.col("s.k")) & (F.col("g.entity") == F.col("s.entity")) & near
    return g.join(s, on).select(F.col("g.id").alias("a"), F.col("s.id").alias("b"))


def daily_totals(rows: DataFrame, late: str = "1 day") -> DataFrame:
    """Amount by entity and day of event time, final once the watermark has passed the day."""
    return rows.withWatermark("at", late).groupBy(F.window("at", "1 day"), "entity").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("rows")).select(F.col("window.start").alias("day"), "entity", "amount", "rows")

"""Review of suggested matches, and bookkeeping of the residual pools.

Matches carry match_id, a and b (arrays of GL and subledger ids) and status; decisions are rows
(match_id, decision, ord), the last one of a match counts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.greedy import unused

DECISIONS = {"accept": "accepted", "reject": "rejected"}


def decided(matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """matches with their new status; undecided ones keep theirs.

    A decision on a match that doesn't exist fails the job that computes the result, so that nothing of it is written.
    """
    known = matches.select("match_id", F.lit(True).alias("__known"))
    last = decisions.groupBy("match_id").agg(F.max_by("decision", "ord").alias("__d")).join(known, "match_id", "left")
    refused = F.raise_error(F.concat(F.lit("unknown match: "), F.coalesce("match_id", F.lit("null")))).cast("string")
    last = last.select("match_id", F.when(F.col("__known").isNull(), refused).otherwise(F.col("__d")).alias("__d"))
    new = F.when(F.col("__d") == "accept", "accepted").when(F.col("__d") == "reject", "rejected").otherwise(F.col("status"))
    return matches.join(last, "match_id", "left").withColumn("status", new).drop("__d")


def unknown(matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """Decisions on matches that don't exist."""
    return decisions.join(matches.select("match_id"), "match_id", "left_anti").select("match_id")


def check(matches: DataFrame, decisions: DataFrame) -> None:
    first = unknown(matches, decisions).first()
    if first is not None:
        raise ValueError(f"unknown match: {first.match_id}")


def members(matches: DataFrame, ids: str) -> DataFrame:
    return matches.select(F.explode(ids).alias("__id")).distinct()


def matched_rows(df: DataFrame, id_column: str, matches: DataFrame, ids: str) -> DataFrame:
    """Rows of df that are in some match."""
    return df.join(members(matches, ids), F.col(id_column) == F.col("__id"), "left_semi")


def after_probable(residual: DataFrame, clean: DataFrame, id_column: str, reviewed: DataFrame, ids: str) -> DataFrame:
    """The residual pool after a review: rows of rejected matches return from the clean data."""
    back = matched_rows(clean, id_column, reviewed.where("status = 'rejected'"), ids)
    return residual.unionByName(back, allowMissingColumns=True)


def after_advised(residual: DataFrame, id_column: str, reviewed: DataFrame, ids: str) -> DataFrame:
    """The residual pool after a review of advised matches: rows of accepted ones leave."""
    return unused(residual, id_column, reviewed.where("status = 'accepted'"), ids)

"""Deterministic matching: equal keys with date and amount bands, taken greedily one to one.

Sides carry the canonical columns id, vn (normal vendor), amount, date, entity, currency
and ord (row order).  Null keys are equal to null keys, as in the rules this follows; a
null date is in no band.  The ids of a side are unique.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.config import DATE_TOLERANCES, NO_ENTITY, SCENARIO_CONFIDENCE, ColumnMap, MatchingConfig, Scenario
from ledgerloom.functions.scores import amount_key, day
from ledgerloom.functions.text import composed, normalize_vendor
from ledgerloom.operators.greedy import unused
from ledgerloom.operators.sweep import Bands, assigned
from ledgerloom.sources.shared import cut

REQUIRED = ("id", "vn", "amount", "date", "entity", "ord")


def standardize(df: DataFrame, columns: ColumnMap, order: str = "ord") -> DataFrame:
    """A side with canonical column names; a side without an entity has one constant entity."""
    out = composed(df, columns.vendor).withColumn("vn", normalize_vendor(F.col(columns.vendor)))
    entity = F.col(columns.entity) if columns.entity else F.lit(NO_ENTITY)
    date = F.col(columns.date).cast("date") if columns.date else F.lit(None).cast("date")
    currency = F.col(columns.currency) if columns.currency else F.lit(None).cast("string")
    return out.select(F.col(columns.id).cast("string").alias("id"), F.col(columns.vendor).alias("vendor"), "vn", F.col(columns.amount).cast("double").alias("amount"), date.alias("date"), entity.alias("entity"), currency.alias("currency"), F.col(order).alias("ord"))


def check_columns(df: DataFrame) -> None:
    missing = [c for c in REQUIRED if c not in df.columns]
    if missing:
        raise ValueError(f"missing matching columns: {', '.join(missing)}")


def _keys() -> list[Column]:
    return [F.col("g.vn").eqNullSafe(F.col("s.vn")), F.col("g.k").eqNullSafe(F.col("s.k")), F.col("g.entity").eqNullSafe(F.col("s.entity"))]


def scenario_1(gl: DataFrame, sub: DataFrame) -> DataFrame:
    """Pairs (a, b) with equal vendor, amount, date and entity.

    All pairs of a key exist, so the greedy walk pairs its k-th rows: row numbers on both sides
    and an equi-join, without ever forming the pairs.
    """

    def ranked(df: DataFrame) -> DataFrame:
        keyed = df.withColumn("k", amount_key(F.col("amount")))
        return keyed.withColumn("rn", F.row_number().over(Window.partitionBy("vn", "k", "date", "entity").orderBy("ord")))

    on = [*_keys(), F.col("g.date").eqNullSafe(F.col("s.date")), F.col("g.rn") == F.col("s.rn")]
    return ranked(gl).alias("g").join(ranked(sub).alias("s"), reduce(Column.__and__, on)).select(F.col("g.id").alias("a"), F.col("s.id").alias("b"))


def bucketed(left: DataFrame, right: DataFrame, days: int) -> tuple[DataFrame, DataFrame]:
    """Rows with a date on both sides, with a bucket of days + 1 days; the right side once for each bucket in reach.

    So that a key with very many rows is spread over its dates.
    """
    own = F.floor(day(F.col("date")) / (days + 1))
    near = F.explode(F.sequence(own - 1, own + 1))
    return left.where("date is not null").withColumn("bucket", own), right.where("date is not null").withColumn("bucket", near)


def banded(gl: DataFrame, sub: DataFrame, days: int) -> DataFrame:
    """Candidate pairs with equal vendor, amount and entity and dates within days; go and so give the walk's order.

    They are what scenario_banded() decides among, for inspection: a key with many rows of one day has all their pairs.
    """
    g, s = (df.withColumn("k", amount_key(F.col("amount"))).withColumn("day", day(F.col("date"))) for df in (gl, sub))
    g, s = bucketed(g, s, days)
    on = [*_keys(), F.col("g.bucket") == F.col("s.bucket"), F.abs(F.col("g.day") - F.col("s.day")) <= days]
    return g.alias("g").join(s.alias("s"), reduce(Column.__and__, on)).select(F.col("g.id").alias("a"), F.col("s.id").alias("b"), F.col("g.ord").alias("go"), F.col("s.ord").alias("so"))


def keyed(df: DataFrame) -> DataFrame:
    """A side with the amount as it is compared (k) and the day's number."""
    return df.withColumn("k", amount_key(F.col("amount"))).withColumn("day", day(F.col("date")))


def scenario_banded(gl: DataFrame, sub: DataFrame, days: int) -> DataFrame:
    """Pairs (a, b) that the walk over banded() takes, by a sweep that doesn't form its candidates."""
    return assigned(keyed(gl), keyed(sub), ["vn", "k", "entity"], Bands(days))


def scenario_dynamic(gl: DataFrame, sub: DataFrame, scenario: Scenario) -> DataFrame:
    """Pairs (a, b) that the walk over dynamic_candidates() takes, by the same sweep."""
    names = {"vendor": "vn", "entity": "entity", "currency": "currency"}
    keys = [names[f] for f in scenario.match_fields if f in names]
    fields = set(scenario.match_fields)
    bands = Bands(
        scenario.date_days if "date" in fields else None,
        scenario.amount_abs if "amount" in fields else None,
        scenario.amount_pct if "amount" in fields else None,
    )
    if "amount" in fields and not bands.by_amount:
        keys.append("k")
    if "date" in fields and bands.days is None:
        keys.append("date")
    if not keys:
        return gl.limit(0).select(F.col("id").alias("a"), F.col("id").alias("b"))
    return assigned(keyed(gl), keyed(sub), keys, bands)


def dynamic_candidates(gl: DataFrame, sub: DataFrame, scenario: Scenario) -> DataFrame:
    """Candidate pairs of a configured scenario; without any exact key there are none."""
    names = {"vendor": "vn", "entity": "entity", "currency": "currency"}
    exact = [F.col(f"g.{names[f]}").eqNullSafe(F.col(f"s.{names[f]}")) for f in scenario.match_fields if f in names]
    g, s = (df.withColumn("k", amount_key(F.col("amount"))).withColumn("day", day(F.col("date"))) for df in (gl, sub))
    bands = []
    if "amount" in scenario.match_fields:
        gap = F.abs(F.col("g.amount") - F.col("s.amount"))
        tests = []
        if scenario.amount_abs is not None:
            tests.append(gap <= scenario.amount_abs)
        if scenario.amount_pct is not None:
            tests.append(gap / F.greatest(F.abs(F.col("g.amount")), F.lit(1e-9)) <= scenario.amount_pct)
        if tests:
            bands.append(reduce(Column.__or__, tests))
        else:
            exact.append(F.col("g.k").eqNullSafe(F.col("s.k")))
    if "date" in scenario.match_fields:
        if scenario.date_days is None:
            exact.append(F.col("g.date").eqNullSafe(F.col("s.date")))
        else:
            bands.append(F.abs(F.col("g.day") - F.col("s.day")) <= scenario.date_days)
            if exact:
                g, s = bucketed(g, s, scenario.date_days)
                bands.append(F.col("g.bucket") == F.col("s.bucket"))
    out = [F.col("g.id").alias("a"), F.col("s.id").alias("b"), F.col("g.ord").alias("go"), F.col("s.ord").alias("so")]
    if not exact:
        return g.alias("g").join(s.alias("s"), F.lit(False)).select(*out)
    return g.alias("g").join(s.alias("s"), reduce(Column.__and__, exact + bands)).select(*out)


def records(pairs: DataFrame, scenario_id: int, description: str, confidence: float) -> DataFrame:
    """Match records of pairs; the id is a hash, so that reruns agree."""
    text = F.concat_ws("|", F.lit("deterministic"), F.lit(scenario_id).cast("string"), "a", "b")
    return pairs.select(
        F.sha2(text, 256).alias("match_id"), F.array("a").alias("a"), F.array("b").alias("b"), F.lit(scenario_id).alias("scenario_id"), F.lit(description).alias("description"),
        F.lit(confidence).alias("confidence"), F.lit("one_to_one").alias("grouping_type"), F.lit("auto_confirmed").alias("status"), F.lit(False).alias("overridden"),
    )


def match(gl: DataFrame, sub: DataFrame, config: MatchingConfig | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Matches of all scenarios in turn, and both residual pools; each scenario sees unused rows only."""
    check_columns(gl)
    check_columns(sub)
    found = []
    if config is None:
        steps = [("exact", lambda g, s: scenario_1(g, s))] + [(f"date within {d} days", lambda g, s, d=d: scenario_banded(g, s, d)) for d in DATE_TOLERANCES]
        confidences = list(SCENARIO_CONFIDENCE)
    else:
        steps = [(c.description, lambda g, s, c=c: scenario_dynamic(g, s, c)) for c in config.scenarios]
        confidences = [c.confidence or (SCENARIO_CONFIDENCE[i] if i < len(SCENARIO_CONFIDENCE) else SCENARIO_CONFIDENCE[-1]) for i, c in enumerate(config.scenarios)]
    gl, sub = cut(gl), cut(sub)
    for i, ((description, step), confidence) in enumerate(zip(steps, confidences, strict=True), 1):
        won = cut(records(step(gl, sub), i, description, confidence))
        found.append(won)
        gl, sub = cut(unused(gl, "id", won, "a")), cut(unused(sub, "id", won, "b"))
    return reduce(DataFrame.union, found), gl, sub

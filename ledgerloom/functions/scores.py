"""Amount, date and match scores as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ledgerloom.config import PROBABLE_DAYS, WEIGHTS


def amount_key(x: Column) -> Column:
    """Amount to two places, halves to even, as the matching compares it."""
    return F.rint(x * 100) / 100


def day(x: Column) -> Column:
    """Days since 1970-01-01."""
    return F.unix_date(x.cast("date"))


def amount_similarity(a: Column, b: Column) -> Column:
    gap = F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(0.01))
    return F.when(a.isNotNull() & b.isNotNull(), F.greatest(F.lit(0.0), 1 - gap))


def date_similarity(a: Column, b: Column, days: int = PROBABLE_DAYS) -> Column:
    gap = F.abs(F.datediff(a, b))
    return F.when(gap.isNull(), F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), 1 - gap / F.lit(float(days))))


def entity_similarity(a: Column, b: Column) -> Column:
    return F.when(a.eqNullSafe(b), F.lit(1.0)).otherwise(F.lit(0.0))


def final_similarity(vendor: Column, amount: Column, date: Column, weights: dict[str, float] | None = None) -> Column:
    """Weighted sum in the order of the weights; the entity and unknown roles add nothing."""
    known = {"vendor": vendor, "amount": amount, "date": date}
    out = F.lit(0.0)
    for role, w in (weights or WEIGHTS).items():
        if role in known:
            out = out + F.lit(w) * known[role]
    return out


def grouping_type(a: Column, b: Column) -> Column:
    one, other = F.size(a) <= 1, F.size(b) <= 1
    return F.when(one & other, "one_to_one").when(other, "many_to_one").when(one, "one_to_many").otherwise("many_to_many")


def source_layer(scenario: Column, similarity: Column, advised: Column) -> Column:
    """The layer that a match comes from, by which of its scores is there."""
    return F.when(scenario.isNotNull(), "deterministic").when(similarity.isNotNull(), "probabilistic").when(advised.isNotNull(), "ai").otherwise("unknown")


def confidence_value(*scores: Column) -> Column:
    """The first score that is neither null nor zero."""
    return F.coalesce(*[F.nullif(s, F.lit(0.0)) for s in scores])


def clamped(x: Column) -> Column:
    return F.least(F.lit(1.0), F.greatest(F.lit(0.0), x))


def split_ids(x: Column) -> Column:
    """The trimmed, non-empty members of a comma list."""
    return F.filter(F.transform(F.split(x, ","), lambda s: F.trim(s)), lambda s: s != "")


def seconds_between(a: Column, b: Column) -> Column:
    return F.round(F.abs(F.unix_micros(b) - F.unix_micros(a)) / 1e6, 1)

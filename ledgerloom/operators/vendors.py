"""Vendor matching in tiers: equal normal form, best fuzzy match, then an optional advisor."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.config import ADVISED_VENDOR, FUZZY_VENDOR
from ledgerloom.functions.text import similarity, composed, normalize_vendor, tidy
from ledgerloom.sources.shared import cut


def distinct_vendors(df: DataFrame, vendor: str = "vendor_name", order: str = "ord") -> DataFrame:
    """Each vendor once: original, its normal form norm, and its first place o."""
    once = df.where(F.col(vendor).isNotNull()).groupBy(F.col(vendor).alias("original")).agg(F.min(order).alias("o"))
    return composed(once.withColumn("__c", F.col("original")), "__c").withColumn("norm", normalize_vendor(F.col("__c"))).drop("__c")


def tier_1(gl: DataFrame, sub: DataFrame) -> DataFrame:
    """GL vendors whose normal form a subledger vendor has; of several of those the last one counts."""
    by_norm = sub.where("norm <> ''").groupBy("norm").agg(F.max_by("original", "o").alias("matched_to"))
    return gl.where("norm <> ''").join(by_norm, "norm").select("original", "norm", "matched_to", F.lit("preprocessing").alias("match_source"), F.lit(1.0).alias("similarity_score"))


def tier_2(left: DataFrame, sub: DataFrame, least: float = FUZZY_VENDOR) -> DataFrame:
    """The best fuzzy match of each unresolved vendor among the subledger's normal forms, if similar enough.

    Candidates come from near_texts() before any Python runs; its bounds are exact: no pair outside can pass.
    """
    query = left.withColumn("q", F.when(F.col("norm") == "", F.lower("original")).otherwise(F.col("norm"))).select("original", "q", sorted_words(F.col("q")).alias("x"))
    forms = sub.where("norm <> ''").groupBy("norm").agg(F.max_by("original", "o").alias("matched_to"), F.min("o").alias("o")).withColumn("y", sorted_words(F.col("norm")))
    near = near_texts(query.select("x").distinct(), forms.select("y").distinct(), least)
    best = query.join(near, "x").join(forms, "y").withColumn("s", similarity("q", "norm")).where(F.col("s") >= least)
    first = Window.partitionBy("original").orderBy(F.desc("s"), "o")
    return best.withColumn("rn", F.row_number().over(first)).where("rn = 1").select("original", F.col("norm").alias("matched_norm"), "matched_to", F.lit("nlp").alias("match_source"), F.col("s").alias("similarity_score"))


def sorted_words(x: Column) -> Column:
    return F.array_join(F.array_sort(F.filter(F.split(x, r"(?U)\s+"), lambda w: w != "")), " ")


def near_texts(left: DataFrame, right: DataFrame, least: float) -> DataFrame:
    """Pairs (x, y) of left's and right's texts among which are all whose similarity is least or more.

    Texts of n and m letters with that similarity have t = least / 2 * (n + m) letters in common, counted as a multiset.
    Sorted from the rarest letter of all texts to the most frequent one, the first n - t + k letters of one and m - t + k of the other
    then share k of them.  Those k-letter choices from the few rarest letters are the join's keys; lengths are compared in the join,
    and all letters of what it gives afterwards.
    """
    most = 4 if least >= 0.85 else 2  # letters of a key: the lower the bound, the longer the beginnings that they are chosen from
    both = left.where("x <> ''").select(F.col("x").alias("text")).union(right.where("y <> ''").select(F.col("y").alias("text"))).distinct()
    letters = cut(_rarest(both))
    keys = cut(_letter_keys(letters, least, most))
    xs, ys = keys.join(left.select(F.col("x").alias("text")), "text", "left_semi").alias("x"), keys.join(right.select(F.col("y").alias("text")), "text", "left_semi").alias("y")
    n, m = F.length("x.text"), F.length("y.text")
    close = F.abs(n - m) <= F.floor((1 - least) * (n + m) + 1e-9)
    pairs = xs.join(ys, (F.col("x.key") == F.col("y.key")) & close).select(F.col("x.text").alias("x"), F.col("y.text").alias("y")).distinct()
    common = F.size(F.array_intersect("xg", "yg"))
    for side in "xy":
        pairs = pairs.join(letters.select(F.col("text").alias(side), F.col("g").alias(f"{side}g")), side)
    return pairs.where(common * 2 >= F.lit(least) * (F.length("x") + F.length("y")) - 1e-9).select("x", "y")


def _rarest(texts: DataFrame) -> DataFrame:
    """text and g: its letters, each with the number of its occurrence, from the rarest one of all texts on."""
    letters = F.transform(F.sequence(F.lit(1), F.length("text")), lambda i: F.substring(F.col("text"), i, F.lit(1)))
    numbered = F.transform("c", lambda c, i: F.concat(c, F.size(F.filter(F.slice("c", F.lit(1), i + 1), lambda o: o == c)).cast("string")))
    each = cut(texts.withColumn("c", letters).select("text", F.explode(numbered).alias("g")))
    rarity = each.groupBy("g").agg(F.count(F.lit(1)).alias("n"))
    return each.join(rarity, "g").groupBy("text").agg(F.transform(F.sort_array(F.collect_list(F.struct("n", "g"))), lambda s: s["g"]).alias("g"))


def _letter_keys(letters: DataFrame, least: float, most: int) -> DataFrame:
    """text and key: choices of its rarest letters as near_texts() joins them."""
    n = F.length("text")
    common = lambda m: F.ceil(F.lit(least / 2) * (n + m) - 1e-9).cast("int")
    reach = F.sequence(F.ceil(n * least / (2 - least) - 1e-9).cast("int"), F.floor(n * (2 - least) / least + 1e-9).cast("int"))
    out = []
    for k in range(1, most + 1):  # pairs with fewer common letters than most need keys of as many as they have
        partners = F.filter(reach, lambda m: F.least(F.lit(most), common(m)) == k)  # noqa: B023
        chosen = letters.withColumn("p", F.array_max(F.transform(partners, lambda m: n - common(m) + k))).where("p is not null")  # noqa: B023
        for i in range(1, k + 1):
            chosen = chosen.withColumn(f"i{i}", F.explode(F.sequence(F.col(f"i{i - 1}") + 1 if i > 1 else F.lit(1), F.col("p") - (k - i))))
        key = F.concat_ws(" ", F.lit(str(k)), *[F.element_at("g", F.col(f"i{i}")) for i in range(1, k + 1)])
        out.append(chosen.select("text", key.alias("key")))
    return reduce(DataFrame.union, out)


def vendor_map(gl: DataFrame, sub: DataFrame, least: float = FUZZY_VENDOR, advised: DataFrame | Callable[[DataFrame, DataFrame], DataFrame] | None = None) -> DataFrame:
    """A row for each GL vendor: how it was matched and its key; unmatched ones keep their own form.

    advised (original, matched_to, confidence) is the optional advisor's answer for what both tiers left over,
    or a function that gives it from the vendors left over and the subledger's.
    """
    gl, sub = cut(gl), cut(sub)
    one = cut(tier_1(gl, sub))
    rest = cut(gl.join(one.select("original"), "original", "left_anti"))
    two = cut(tier_2(rest, sub, least))
    left = rest.join(two.select("original"), "original", "left_anti")
    out = one.select("original", F.col("norm").alias("key"), "matched_to", "match_source", "similarity_score").unionByName(two.select("original", F.col("matched_norm").alias("key"), "matched_to", "match_source", "similarity_score"))
    last = left.select("original", "norm", F.lit(None).cast("string").alias("matched_to"), F.lit(0.0).alias("similarity_score"))
    if advised is not None:
        last = tier_3(left, sub, advised(left, sub) if callable(advised) else advised)
    return out.unionByName(last.select("original", F.col("norm").alias("key"), "matched_to", F.lit("ai").alias("match_source"), "similarity_score"))


def tier_3(left: DataFrame, sub: DataFrame, advised: DataFrame, least: float = ADVISED_VENDOR) -> DataFrame:
    """Advice counts only if it names a subledger vendor and is confident; otherwise the vendor stays unmatched."""
    known = advised.where(F.col("confidence") >= least).join(sub.select(F.col("original").alias("matched_to"), F.col("norm").alias("their")), "matched_to")
    joined = left.join(known, "original", "left")
    return joined.select("original", F.coalesce("their", "norm").alias("norm"), "matched_to", F.coalesce("confidence", F.lit(0.0)).alias("similarity_score"))


def enrich(df: DataFrame, keys: DataFrame, vendor: str = "vendor_name") -> DataFrame:
    """df with vn: the vendor's key of keys (original, key), else its own normal form."""
    joined = df.join(keys.select(F.col("original").alias("__v"), F.col("key").alias("__k")), F.col(vendor) == F.col("__v"), "left")
    return joined.withColumn("vn", F.coalesce("__k", normalize_vendor(F.col(vendor)))).drop("__v", "__k")


def override(df: DataFrame, overrides: DataFrame, side: str, vendor: str = "vendor_name") -> DataFrame:
    """vn replaced by the trimmed override of the vendor; subledger keys begin with __sub__; blank ones are ignored."""
    prefix = "__sub__" if side == "sub" else ""
    joined = df.join(overrides.select(F.col("key").alias("__k"), F.nullif(F.trim("value"), F.lit("")).alias("__o")), F.concat(F.lit(prefix), F.col(vendor)) == F.col("__k"), "left")
    return joined.withColumn("vn", F.coalesce("__o", "vn")).drop("__k", "__o")


def tiers(mapped: DataFrame) -> DataFrame:
    return mapped.groupBy("match_source").agg(F.count(F.lit(1)).alias("count"))


def unmatched_sub(sub: DataFrame, mapped: DataFrame) -> DataFrame:
    """Subledger vendors that no GL vendor was matched to."""
    used = mapped.where("matched_to is not null").select(F.col("matched_to").alias("original")).distinct()
    return sub.join(used, "original", "left_anti").select("original")


def display_name(override_: Column, source: Column, gl: Column, sub: Column) -> Column:
    """The override, else by tier: the shorter name for fuzzy and advised matches, the GL name otherwise."""
    shorter = F.when(sub.isNull() | (F.length(gl) <= F.length(sub)), gl).otherwise(sub)
    return F.coalesce(F.nullif(F.trim(override_), F.lit("")), F.when(source.isin("nlp", "ai"), shorter).otherwise(gl))


__all__ = ["display_name", "distinct_vendors", "enrich", "override", "tidy", "tier_1", "tier_2", "tier_3", "tiers", "unmatched_sub", "vendor_map"]

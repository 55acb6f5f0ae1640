"""Vendor names: normal form and similarity."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed values of the vendor rules.
SUFFIXES = (
    "llc ltd limited inc incorporated corp corporation co company plc gmbh ag sa sas bv nv pty pte ab as oy llp lp lllp "
    "pllc pc pa intl international group holdings holding enterprises enterprise services service solutions solution "
    "technologies technology tech industries industry"
).split()
STOPWORDS = "the and of for in on at to by with or from".split()


def tidy(name: Column) -> Column:
    """Lower case, punctuation as blanks, single blanks."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(name), r"(?U)[^\w\s]", " "), r"(?U)\s+", " "))


def normalize_vendor(name: Column, alias: Column | None = None) -> Column:
    """The name's normal form: alias of the raw name first, then tidy(), trailing company suffixes off, stop words out.

    Null and blank give the empty text.
    """
    raw = F.coalesce(alias, name) if alias is not None else name
    bare = F.regexp_replace(tidy(F.coalesce(raw, F.lit(""))), rf"(?:(?:^| )(?:{'|'.join(SUFFIXES)}))+$", "")
    return F.array_join(F.filter(F.split(bare, " "), lambda w: (w != "") & ~w.isin(*STOPWORDS)), " ")


@F.pandas_udf(T.StringType())
def _composed(names: pd.Series) -> pd.Series:
    return names.str.normalize("NFC")


def composed(df: DataFrame, name: str) -> DataFrame:
    """df with the column in Unicode composed form; only names beyond ASCII are handed to Python."""
    plain = F.col(name).isNull() | ~F.col(name).rlike(r"[^\x00-\x7F]")
    return df.withColumn(name, F.when(plain, F.col(name)).otherwise(_composed(F.when(~plain, F.col(name)))))


def common_length(a: str, b: str) -> int:
    """Length of the longest common subsequence, bit-parallel over a."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    row = all_ = (1 << len(a)) - 1
    for c in b:
        hit = row & where.get(c, 0)
        row = (row + hit | row - hit) & all_
    return len(a) - row.bit_count()


def token_sort_ratio(a: str, b: str) -> float:
    """Similarity 0..1 of two texts with their tokens sorted: twice the common subsequence over both lengths."""
    x, y = " ".join(sorted(a.split())), " ".join(sorted(b.split()))
    return 2 * common_length(x, y) / (len(x) + len(y)) if x or y else 1.0


@F.pandas_udf(T.DoubleType())
def similarity(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in batches:
        yield pd.Series([token_sort_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def with_similarity(pairs: DataFrame, a: str, b: str, name: str = "vendor_similarity") -> DataFrame:
    """pairs with the similarity of two columns; each distinct pair of texts is compared once, nulls as the text None."""
    x, y = F.coalesce(F.col(a), F.lit("None")), F.coalesce(F.col(b), F.lit("None"))
    keyed = pairs.withColumns({"__x": x, "__y": y})
    unequal = keyed.where("__x <> __y").select("__x", "__y").distinct()
    scored = unequal.withColumn("__s", similarity("__x", "__y")).withColumnsRenamed({"__x": "__u", "__y": "__v"})
    joined = keyed.join(scored, (F.col("__x") == F.col("__u")) & (F.col("__y") == F.col("__v")), "left")
    return joined.withColumn(name, F.when(F.col("__x") == F.col("__y"), F.lit(1.0)).otherwise(F.col("__s"))).drop("__x", "__y", "__u", "__v", "__s")

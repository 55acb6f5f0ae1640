"""Greedy selection in a total order, distributed.

The sequential rule "walk the candidates in order, take one if none of its members is
used" has the same result as rounds of: take every candidate that is the first one at
all of its members, then drop the candidates that touch a taken member.  Each round is
two minimum-aggregations (partial ones first) and anti-joins.

Rounds go on while each leaves half of the candidates or fewer, so they are as many as the
logarithm of their number.  Where one leaves more, candidates wait for each other in
long chains; then what is left is parted into connected components, which decide
independently.  Each component of BOUND candidates or fewer is walked in order by one
task, as a stream that remembers the members used; larger ones go on in rounds.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.operators.components import components
from ledgerloom.sources.shared import cut

#: Candidates of a component that one task walks.
BOUND = 1_000_000


def _in_rounds(left: DataFrame, one: Callable[[DataFrame], tuple[DataFrame, DataFrame]], locally: Callable[[DataFrame], tuple[DataFrame, DataFrame]]) -> DataFrame:
    """The candidates taken by rounds of one(left), which gives those taken and those left, or by components, as locally(left) does."""
    left, taken = cut(left), []
    n, slow, patience = left.count(), 0, 1
    while n:
        won, left = one(left)
        taken.append(won)
        before, n = n, left.count()
        slow += n * 2 > before
        if slow >= patience:
            won, left = locally(left)
            taken.append(won)
            n, slow, patience = left.count(), 0, patience * 4  # components over the bound take their time to fall apart
    return reduce(DataFrame.union, taken) if taken else left


def _walked(left: DataFrame, members: str, order: list[str], key: str, bound: int) -> tuple[DataFrame, DataFrame]:
    """Keys of the candidates that the walk takes in components of bound candidates or fewer, and the candidates of larger ones."""
    links = left.select(F.col(members)[0].alias("x"), F.explode(members).alias("y"))
    roots = components(links)
    placed = cut(left.withColumn("__x", F.col(members)[0]).join(roots.select(F.col("node").alias("__x"), F.col("root").alias("__root")), "__x").drop("__x"))
    large = cut(placed.groupBy("__root").count().where(F.col("count") > bound).select("__root"))
    rest = placed.join(large, "__root", "left_semi").drop("__root")
    dealt = placed.join(large, "__root", "left_anti").repartition("__root").sortWithinPartitions("__root", *order, key).select("__root", key, members)

    def run(batches):
        now, used = None, set()
        for batch in batches:
            out = []
            for root, name, own in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if root != now:
                    now, used = root, set()
                if used.isdisjoint(own):
                    used.update(own)
                    out.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(out, batch.schema.field(1).type)], names=[key])

    return dealt.mapInArrow(run, f"{key} {dict(left.dtypes)[key]}"), cut(rest)


def greedy_pairs(edges: DataFrame, order: list[str], a: str = "a", b: str = "b", bound: int = BOUND) -> DataFrame:
    """The pairs (a, b) of edges that the walk in the given ascending order takes; ties are broken by a, then b."""

    def one(left: DataFrame) -> tuple[DataFrame, DataFrame]:
        best = lambda by: left.groupBy(by).agg(F.min(F.struct(*order, F.col(a).alias("__a"), F.col(b).alias("__b"))).alias("m")).select("m")
        won = cut(best(a).intersect(best(b)).select(F.col("m.__a").alias(a), F.col("m.__b").alias(b)))
        return won, cut(left.join(won.select(a), a, "left_anti").join(won.select(b), b, "left_anti"))

    def locally(left: DataFrame) -> tuple[DataFrame, DataFrame]:
        named = left.withColumns({"__key": F.struct(F.col(a).alias("a"), F.col(b).alias("b")), "__members": F.array(F.concat(F.lit("a:"), F.col(a).cast("string")), F.concat(F.lit("b:"), F.col(b).cast("string")))})
        won, rest = _walked(named, "__members", order, "__key", bound)
        return cut(won.select(F.col("__key.a").alias(a), F.col("__key.b").alias(b))), rest.select(*left.columns)

    return _in_rounds(edges, one, locally).select(a, b)


def greedy_groups(candidates: DataFrame, order: list[str], members: str = "members", key: str = "key", bound: int = BOUND) -> DataFrame:
    """The candidates (with a unique key and an array of distinct members) that the walk takes."""

    def one(left: DataFrame) -> tuple[DataFrame, DataFrame]:
        rank = F.struct(*order, F.col(key).alias("__key"), F.size(members).alias("__n"))
        best = left.select(F.explode(members).alias("__m"), rank.alias("__r")).groupBy("__m").agg(F.min("__r").alias("__r"))
        keys = best.groupBy("__r").agg(F.count(F.lit(1)).alias("__c")).where("__c = __r.__n").select(F.col("__r.__key").alias(key))
        won = cut(left.join(keys, key, "left_semi"))
        used = won.select(F.explode(members).alias("__m")).distinct()
        hit = left.select(key, F.explode(members).alias("__m")).join(used, "__m", "left_semi").select(key).distinct()
        return won, cut(left.join(hit, key, "left_anti"))

    def locally(left: DataFrame) -> tuple[DataFrame, DataFrame]:
        won, rest = _walked(left, members, order, key, bound)
        return cut(left.join(won, key, "left_semi")), rest.select(*left.columns)

    return _in_rounds(candidates, one, locally)


def unused(pool: DataFrame, id_column: str, matches: DataFrame, ids: str) -> DataFrame:
    """Rows of pool whose id is in no match's array of ids."""
    gone = matches.select(F.explode(ids).alias("__id"))  # repeated ids make no difference to the join, and to find them takes a task's memory
    return pool.join(gone, F.col(id_column).cast("string") == F.col("__id"), "left_anti")

"""The advisory layer: groups of residual rows, an advisor's suggestions, and what of them counts.

An advisor is any callable from a group's payload (JSON text) to an answer (JSON text with matches of gl_ids,
sub_ids, confidence and reasoning).  The default one answers nothing, and so does one that fails.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom.config import ADVISED_CANDIDATES, ADVISED_MATCH, ADVISED_ROWS, ADVISED_VENDOR, NEAR_VENDOR
from ledgerloom.functions.scores import clamped, grouping_type
from ledgerloom.functions.text import similarity, with_similarity
from ledgerloom.operators.greedy import greedy_groups
from ledgerloom.operators.vendors import near_texts, sorted_words
from ledgerloom.sources.shared import cut, numbered

VENDOR_ANSWER = "matched_vendor string, confidence double"
ANSWER = "matches array<struct<gl_ids array<string>, sub_ids array<string>, confidence double, reasoning string>>"
Advisor = Callable[[str], str]


def silent(payload: str) -> str:
    return '{"matches": []}'


def shared_groups(gl: DataFrame, sub: DataFrame) -> DataFrame:
    """(entity, vn) that both sides have."""
    keys = lambda df: df.where("entity is not null and vn is not null").select("entity", "vn").distinct()
    return keys(gl).join(keys(sub), ["entity", "vn"])


def first_rows(df: DataFrame, groups: DataFrame, most: int = ADVISED_ROWS) -> DataFrame:
    """The first rows of each shared group, in row order."""
    rn = F.row_number().over(Window.partitionBy("entity", "vn").orderBy("ord"))
    return df.join(groups, ["entity", "vn"]).withColumn("rn", rn).where(F.col("rn") <= most)


def payloads(gl: DataFrame, sub: DataFrame, most: int = ADVISED_ROWS) -> DataFrame:
    """A row for each shared group with both sides' first rows as JSON."""
    groups = shared_groups(gl, sub)
    pack = lambda df, name: first_rows(df, groups, most).groupBy("entity", "vn").agg(F.sort_array(F.collect_list(F.struct("ord", "id", "amount", "date"))).alias(name))
    both = pack(gl, "gl").join(pack(sub, "sub"), ["entity", "vn"])
    return both.select("entity", "vn", F.to_json(F.struct("entity", "vn", "gl", "sub")).alias("payload"))


def answers(groups: DataFrame, advisor: Advisor = silent) -> DataFrame:
    """groups with the advisor's answers; a failing call counts as none."""

    @F.pandas_udf("string")
    def ask(payload: pd.Series) -> pd.Series:
        def one(p: str) -> str:
            try:
                return advisor(p)
            except Exception:  # noqa: BLE001  whatever an outside service raises, the layer goes on without it
                return silent(p)

        return payload.map(one)

    return groups.withColumn("answer", ask("payload"))


def bare(answer: Column) -> Column:
    """An answer without a code fence around its JSON."""
    return F.regexp_replace(F.trim(answer), r"(?s)^```(?:json)?\s*(.*?)\s*```$", "$1")


def parsed(answer: Column) -> Column:
    """An answer's matches; a code fence around the JSON is taken off."""
    return F.from_json(bare(answer), ANSWER)["matches"]


def vendor_pages(sub: DataFrame, most: int = ADVISED_CANDIDATES) -> DataFrame:
    """The subledger's vendors in order of appearance, at most so many a page: page (from 1 on) and candidates."""
    paged = numbered(sub.select("o", "original"), F.asc("o"), F.asc("original")).withColumn("page", F.ceil(F.col("place") / most))
    return paged.groupBy("page").agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "original"))), lambda x: x["original"]).alias("candidates"))


def near_pages(left: DataFrame, sub: DataFrame, most: int = ADVISED_CANDIDATES, least: float = NEAR_VENDOR) -> DataFrame:
    """For each vendor left over that has any: page 0 with the most similar of the subledger's vendors."""
    form = lambda df, name: df.select(F.col("original").alias(name), F.when(F.col("norm") == "", F.lower("original")).otherwise(F.col("norm")).alias("q" + name))
    mine, theirs = (form(df, name).withColumn(at, sorted_words(F.col("q" + name))) for df, name, at in ((left, "vendor", "x"), (sub, "candidate", "y")))
    near = near_texts(mine.select("x").distinct(), theirs.select("y").distinct(), least)
    scored = mine.join(near, "x").join(theirs, "y").withColumn("s", similarity("qvendor", "qcandidate")).where(F.col("s") >= least)
    place = F.row_number().over(Window.partitionBy("vendor").orderBy(F.desc("s"), "candidate"))
    first = scored.withColumn("place", place).where(F.col("place") <= most)
    return first.groupBy(F.col("vendor").alias("original")).agg(F.transform(F.sort_array(F.collect_list(F.struct("place", "candidate"))), lambda x: x["candidate"]).alias("candidates")).withColumn("page", F.lit(0).cast("long"))


def vendor_payloads(paged: DataFrame) -> DataFrame:
    """original and page, with the vendor and the page's candidates as JSON."""
    return paged.select("original", "page", F.to_json(F.struct(F.col("original").alias("vendor"), "candidates")).alias("payload"))


def vendor_advice(left: DataFrame, sub: DataFrame, advisor: Advisor, most: int = ADVISED_CANDIDATES, sure: float = ADVISED_VENDOR) -> DataFrame:
    """original, matched_to, confidence: the advisor's answer (JSON text with matched_vendor and confidence) on each vendor.

    A payload holds at most so many candidates.  Where the subledger's vendors need several pages, each vendor is asked with its
    nearest ones first; those that this doesn't settle (a vendor of the page, and confidently) are asked with every page.  An answer
    counts if it names a vendor of its page; the most confident one decides, ties the earliest page.
    """
    left, pages = cut(left.select("original", "norm")), cut(vendor_pages(sub, most))
    count = pages.count()

    def asked(paged: DataFrame) -> DataFrame:
        said = answers(vendor_payloads(paged), advisor).withColumn("x", F.from_json(bare(F.col("answer")), VENDOR_ANSWER)).select("original", "page", F.col("x.matched_vendor").alias("matched_to"), F.col("x.confidence").alias("confidence"))
        return cut(said.join(paged.select("original", "page", F.explode("candidates").alias("matched_to")), ["original", "page", "matched_to"], "left_semi"))

    with_all = lambda df: df.select("original", F.explode(F.sequence(F.lit(1).cast("long"), F.lit(max(count, 1)).cast("long"))).alias("page")).join(pages, "page")
    if count <= 1:
        found = asked(with_all(left))
    else:
        near = asked(cut(near_pages(left, sub, most)))
        settled = near.where(F.col("confidence") >= sure).select("original")
        found = near.union(asked(with_all(left.join(settled, "original", "left_anti"))))
    return found.groupBy("original").agg(F.max_by(F.struct("matched_to", "confidence"), F.struct(F.coalesce("confidence", F.lit(-1.0)), -F.col("page"))).alias("x")).select("original", "x.matched_to", "x.confidence")


def advised_matches(gl: DataFrame, sub: DataFrame, advisor: Advisor = silent) -> DataFrame:
    """The whole layer on two residual pools: pending matches with their features, each group asked once.

    Only rows that a payload showed can be in a match.
    """
    groups = cut(shared_groups(gl, sub))
    shown = [cut(first_rows(df, groups).select(*df.columns)) for df in (gl, sub)]
    answered = cut(answers(payloads(*shown), advisor).select("entity", "vn", "answer"))
    text = F.concat_ws("|", F.lit("ai"), F.array_join("a", ","), F.array_join("b", ","))
    return cut(suggestions(answered, *shown).withColumns({"match_id": F.sha2(text, 256), "status": F.lit("pending"), "overridden": F.lit(False)}))


def suggestions(answered: DataFrame, gl: DataFrame, sub: DataFrame) -> DataFrame:
    """Suggestions that count: known ids of their own group, no id twice, confident enough; in order of the answers.

    Ranked by materiality (sum of absolute GL amounts), then confidence.  Answers are parsed once, and each side is read once, for the rows
    that some answer names.
    """
    each = answered.select("entity", "vn", F.posexplode(parsed(F.col("answer"))).alias("pos", "m")).select("entity", "vn", "pos", F.col("m.gl_ids").alias("a"), F.col("m.sub_ids").alias("b"), clamped(F.col("m.confidence")).alias("confidence"), F.col("m.reasoning").alias("reasoning"))
    each = cut(each.where((F.col("confidence") >= ADVISED_MATCH) & (F.size("a") > 0) & (F.size("b") > 0)))
    gl, sub = (cut(df.join(each.select(F.explode(ids).alias("id")), "id", "left_semi").select("id", "entity", "vn", "date", "amount")) for ids, df in (("a", gl), ("b", sub)))
    key = F.concat_ws("|", "entity", "vn", F.col("pos").cast("string"))
    for ids, df in (("a", gl), ("b", sub)):
        named = each.select("entity", "vn", "pos", F.explode(ids).alias("id"))
        strange = named.join(df.select("entity", "vn", "id"), ["entity", "vn", "id"], "left_anti").select("entity", "vn", "pos").distinct()
        each = each.join(strange, ["entity", "vn", "pos"], "left_anti")
    nodes = F.array_distinct(F.concat(F.transform("a", lambda x: F.concat(F.lit("g:"), x)), F.transform("b", lambda x: F.concat(F.lit("s:"), x))))
    won = greedy_groups(each.withColumns({"key": key, "nodes": nodes}), ["entity", "vn", "pos"], "nodes")
    return ranked(with_features(won.select("key", "a", "b", "confidence", "reasoning"), gl, sub))


def with_features(matches: DataFrame, gl: DataFrame, sub: DataFrame) -> DataFrame:
    """matches (key, a, b, ...) with materiality and the supporting features."""
    g = _sums(matches, "a", gl).withColumnsRenamed({"first_vn": "g_vn", "first_date": "g_date", "total": "g_total", "material": "materiality"})
    s = _sums(matches, "b", sub).withColumnsRenamed({"first_vn": "s_vn", "first_date": "s_date", "total": "s_total"}).drop("material")
    out = with_similarity(matches.join(g, "key").join(s, "key"), "g_vn", "s_vn")
    gap = F.abs(F.col("g_total") - F.col("s_total"))
    return out.withColumns({"materiality": F.rint(F.col("materiality") * 100) / 100, "amount_difference": F.rint(gap * 100) / 100, "amount_difference_pct": F.rint(gap / F.greatest(F.abs("g_total"), F.abs("s_total"), F.lit(0.01)) * 1e6) / 1e4, "days_between": F.abs(F.datediff("g_date", "s_date")), "grouping_type": grouping_type(F.col("a"), F.col("b"))}).drop("g_vn", "s_vn", "g_date", "s_date", "g_total", "s_total")


def _sums(matches: DataFrame, ids: str, df: DataFrame) -> DataFrame:
    """Totals of each match's rows on one side, and its first row's vendor and date."""
    each = matches.select("key", F.posexplode(ids).alias("at", "id")).join(df.select("id", "vn", "date", "amount"), "id")
    return each.groupBy("key").agg(F.min_by("vn", "at").alias("first_vn"), F.min_by("date", "at").alias("first_date"), F.sum("amount").alias("total"), F.sum(F.abs("amount")).alias("material"))


def ranked(matches: DataFrame) -> DataFrame:
    return matches.orderBy(F.desc("materiality"), F.desc("confidence"), "key")


def fenced(text: str) -> str:
    """The driver-side form of parsed()'s fence rule, for single answers."""
    return re.sub(r"(?s)^```(?:json)?\s*(.*?)\s*```$", r"\1", text.strip())

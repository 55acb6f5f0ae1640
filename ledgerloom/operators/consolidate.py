"""Consolidation of all layers, and the reports over it.

matches: match_id, layer, a, b, scenario_id, similarity, advised, status, overridden.
gl and sub: id, vendor, vn, amount, date, entity, ord (canonical columns).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LAYERS = ("deterministic", "probabilistic", "ai", "manual")


def money(x):
    return F.rint(x * 100) / 100


def final_results(matches: DataFrame) -> DataFrame:
    """All deterministic matches and the accepted ones of the other layers."""
    return matches.where("layer = 'deterministic' or status = 'accepted'")


def summary(matches: DataFrame, residual_gl: DataFrame, residual_sub: DataFrame) -> DataFrame:
    """Matches by layer, all final ones, residual rows of both sides, rejected and overridden matches."""
    final = F.col("layer").eqNullSafe("deterministic") | (F.col("status") == "accepted")
    counts = matches.agg(
        *[F.count_if(final & (F.col("layer") == x)).alias(x) for x in LAYERS[:3]], F.count_if(final).alias("total"), F.count_if(F.col("status") == "rejected").alias("rejected"), F.count_if(F.col("overridden")).alias("overridden")
    )
    g, s = residual_gl.agg(F.count(F.lit(1)).alias("residual_gl")), residual_sub.agg(F.count(F.lit(1)).alias("residual_sub"))
    return counts.crossJoin(g).crossJoin(s)  # one row each


def exploded(matches: DataFrame, ids: str) -> DataFrame:
    return matches.select("match_id", "layer", "status", "scenario_id", F.explode(ids).alias("id"))


def scenario_amounts(matches: DataFrame, gl: DataFrame) -> DataFrame:
    """GL amount of the distinct matched ids, by scenario and overall (scenario null); null amounts as zero."""
    each = exploded(matches.where("layer = 'deterministic'"), "a").groupBy("id").agg(F.collect_set("scenario_id").alias("scenarios"))  # as many as there are scenarios
    each = each.join(gl.select("id", "amount"), "id", "left").withColumn("amount", F.coalesce("amount", F.lit(0.0)))
    # an id counts once in the whole sum: with the first of its scenarios, the others add to theirs only
    parts = each.select(F.posexplode("scenarios").alias("at", "scenario_id"), "amount")
    first = F.when(F.col("at") == 0, F.col("amount")).otherwise(0.0)
    rolled = parts.rollup("scenario_id").agg(F.grouping_id().alias("whole"), F.sum("amount").alias("own"), F.sum(first).alias("once"))
    return rolled.where("whole = 1 or scenario_id is not null").select("scenario_id", money(F.when(F.col("whole") == 1, F.col("once")).otherwise(F.col("own"))).alias("amount"))


def status_summary(matches: DataFrame, gl: DataFrame) -> DataFrame:
    """Matches and GL amount of each layer and status; an id in several matches counts each time."""
    n = matches.groupBy("layer", "status").agg(F.count(F.lit(1)).alias("count"))
    amounts = exploded(matches, "a").join(gl.select("id", "amount"), "id").groupBy("layer", "status").agg(money(F.sum("amount")).alias("amount"))
    return n.join(amounts, ["layer", "status"], "left").withColumn("amount", F.coalesce("amount", F.lit(0.0)))


def narrative_stats(matches: DataFrame, gl: DataFrame) -> DataFrame:
    """GL rows in the final matches of each layer, and the match rate in percent."""
    final = final_results(matches)
    sums = final.agg(*[F.coalesce(F.sum(F.when(F.col("layer") == x, F.size("a"))), F.lit(0)).alias(f"{x}_rows") for x in LAYERS[:3]])
    n = gl.agg(F.count(F.lit(1)).alias("gl_rows"))
    rate = sum((F.col(f"{x}_rows") for x in LAYERS[1:3]), F.col("deterministic_rows")) / F.greatest(F.col("gl_rows"), F.lit(1)) * 100
    return sums.crossJoin(n).withColumn("match_rate", F.rint(rate * 10) / 10)


def report_kpis(matches: DataFrame, gl: DataFrame) -> DataFrame:
    """GL ids and amounts by bucket, each id in the first one that applies.

    Rejected wins over deterministic, that over probabilistic, ai and manual; the rest is unmatched.
    """
    ids = exploded(matches, "a")
    rank = F.when(F.col("status") == "rejected", 0).when(F.col("layer") == "deterministic", 1).when(F.col("status") == "accepted", F.when(F.col("layer") == "probabilistic", 2).when(F.col("layer") == "ai", 3).otherwise(4))
    first = ids.select("id", rank.alias("r")).where("r is not null").groupBy("id").agg(F.min("r").alias("r"))
    names = F.array(*map(F.lit, ("rejected", "deterministic", "probabilistic", "ai", "manual", "unmatched")))
    each = gl.select("id", "amount").join(first, "id", "left").withColumn("bucket", F.element_at(names, F.coalesce("r", F.lit(5)) + 1))
    return each.groupBy("bucket").agg(F.count(F.lit(1)).alias("gl_rows"), money(F.sum(F.coalesce("amount", F.lit(0.0)))).alias("amount"))


def export_metrics(matches: DataFrame, gl: DataFrame) -> DataFrame:
    """GL ids and amounts by layer, overlapping: rejected matches are not taken out of other layers."""
    ids = exploded(final_results(matches), "a").select("layer", "id").distinct()
    return ids.join(gl.select("id", "amount"), "id").groupBy("layer").agg(F.count(F.lit(1)).alias("gl_rows"), money(F.sum("amount")).alias("amount"))


def report_vendor(matches: DataFrame, gl: DataFrame, most: int = 10) -> DataFrame:
    """Matched and unmatched GL rows and amounts of the vendors with most rows."""
    won = exploded(final_results(matches), "a").select("id").distinct().withColumn("hit", F.lit(True))
    each = gl.join(won, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    amount = lambda test: money(F.sum(F.when(test, F.col("amount")).otherwise(0.0)))
    out = each.groupBy("vn").agg(F.count(F.lit(1)).alias("rows"), F.count_if("hit").alias("matched"), F.count_if(~F.col("hit")).alias("unmatched"), amount(F.col("hit")).alias("matched_amount"), amount(~F.col("hit")).alias("unmatched_amount"))
    return out.orderBy(F.desc("rows"), "vn").limit(most)


def vendor_chart(matches: DataFrame, gl: DataFrame, shown: int = 5) -> DataFrame:
    """The series of the report's vendor chart: the vendors with most GL rows, the smallest of those shown first; rows without one as Unknown."""
    named = gl.withColumn("vn", F.coalesce(F.nullif("vn", F.lit("")), F.lit("Unknown")))
    top = report_vendor(matches, named, shown)
    return top.withColumn("place", F.row_number().over(Window.orderBy("rows", F.desc("vn"))))  # as many rows as are shown


def by_vendor(matches: DataFrame, gl: DataFrame, test: Column, most: int = 10) -> DataFrame:
    """GL rows in the matches that pass the test, of the vendors with most of them."""
    hit = exploded(matches.where(test), "a").select("id").distinct()
    return gl.join(hit, "id", "left_semi").groupBy("vn").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), "vn").limit(most)


def ai_log(matches: DataFrame) -> DataFrame:
    """One row on the advised layer: suggestions by status and their mean confidence."""
    ai = F.col("layer") == "ai"
    return matches.agg(F.count_if(ai).alias("suggestions"), *[F.count_if(ai & (F.col("status") == x)).alias(x) for x in ("pending", "accepted", "rejected")], (F.rint(F.avg(F.when(ai, F.col("advised"))) * 1e4) / 1e4).alias("mean_confidence"))


def match_rows(matches: DataFrame, gl: DataFrame, sub: DataFrame) -> DataFrame:
    """A display row for each match: first row's fields, summed amounts, the layer's confidence in percent."""

    def side(ids: str, df: DataFrame, prefix: str) -> DataFrame:
        each = matches.select("match_id", F.posexplode(ids).alias("at", "id")).join(df.select("id", "vendor", "date", "entity", "amount"), "id")
        firsts = [F.min_by(c, "at").alias(f"{prefix}_{c}") for c in ("id", "vendor", "date", "entity")]
        return each.groupBy("match_id").agg(*firsts, money(F.sum("amount")).alias(f"{prefix}_amount"))

    score = F.coalesce("similarity", "advised", F.when(F.col("layer") == "deterministic", 1.0))
    return matches.select("match_id", "layer", (F.rint(score * 1000) / 10).alias("confidence_pct")).join(side("a", gl, "gl"), "match_id", "left").join(side("b", sub, "sub"), "match_id", "left")


def gl_summary(matches: DataFrame, gl: DataFrame) -> DataFrame:
    """Matched and unmatched GL rows and amounts, and the match rate."""
    won = exploded(final_results(matches), "a").select("id").distinct().withColumn("hit", F.lit(True))
    each = gl.join(won, "id", "left").withColumn("hit", F.coalesce("hit", F.lit(False)))
    rate = F.rint(F.count_if("hit") / F.greatest(F.count(F.lit(1)), F.lit(1)) * 1000) / 10
    return each.agg(F.count_if("hit").alias("matched"), F.count_if(~F.col("hit")).alias("unmatched"), rate.alias("match_rate"), money(F.sum(F.when(F.col("hit"), F.col("amount")))).alias("matched_amount"), money(F.sum(F.when(~F.col("hit"), F.col("amount")))).alias("unmatched_amount"))


def layer_breakdown(matches: DataFrame, gl: DataFrame) -> DataFrame:
    """GL rows and amounts by final layer and unmatched, with the funnel's fraction held within 0.04 and 1."""
    won = exploded(final_results(matches), "a").groupBy("id").agg(F.min("layer").alias("layer"))
    each = gl.select("id", "amount").join(won, "id", "left").withColumn("layer", F.coalesce("layer", F.lit("unmatched")))
    sums = each.groupBy("layer").agg(F.count(F.lit(1)).alias("rows"), money(F.sum("amount")).alias("amount"))
    whole = gl.agg(F.count(F.lit(1)).alias("n"))
    part = F.greatest(F.lit(0.04), F.least(F.lit(1.0), F.col("rows") / F.greatest(F.col("n"), F.lit(1))))
    return sums.crossJoin(F.broadcast(whole)).select("layer", "rows", "amount", (F.rint(part * 1e4) / 1e4).alias("fraction"))  # whole is one row


def filter_matches(rows: DataFrame, least_pct: float = 0.0, least_amount: float | None = None, layer: str | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """Display rows that pass all given tests."""
    out = rows.where(F.col("confidence_pct") >= least_pct)
    if least_amount is not None:
        out = out.where(F.col("gl_amount") >= least_amount)
    if layer:
        out = out.where(F.col("layer") == layer)
    if since:
        out = out.where(F.date_format("gl_date", "yyyy-MM-dd") >= since)
    if until:
        out = out.where(F.date_format("gl_date", "yyyy-MM-dd") <= until)
    return out


def unmatched_summary(residual: DataFrame) -> DataFrame:
    """Rows, total, largest amount, and the vendor with the largest positive total (ties: the name first in order)."""
    tops = residual.where("vendor is not null").groupBy("vendor").agg(F.sum("amount").alias("t")).where("t > 0")
    top = tops.agg(F.min(F.struct((-F.col("t")).alias("t"), "vendor")).alias("m")).select(F.col("m.vendor").alias("top_vendor"))
    return residual.agg(F.count(F.lit(1)).alias("rows"), money(F.sum("amount")).alias("total"), F.max("amount").alias("largest")).crossJoin(top)


def alt_match_rate(matches: DataFrame, residual_gl: DataFrame, residual_sub: DataFrame) -> DataFrame:
    """Matches as a share of matches and residual rows of both sides."""
    m = final_results(matches).agg(F.count(F.lit(1)).alias("m"))
    r = residual_gl.select("id").unionAll(residual_sub.select("id")).agg(F.count(F.lit(1)).alias("r"))
    return m.crossJoin(r).select((F.rint(F.col("m") / F.greatest(F.col("m") + F.col("r"), F.lit(1)) * 1000) / 10).alias("match_rate"))


def unmatched_flat(residual_gl: DataFrame, residual_sub: DataFrame, large: float) -> DataFrame:
    """Residual rows of both sides with their source and whether the amount is large."""
    cols = ["id", "vendor", "amount", "date", "entity"]
    both = residual_gl.select(F.lit("gl").alias("source"), *cols).unionByName(residual_sub.select(F.lit("sub").alias("source"), *cols))
    return both.withColumn("large", F.coalesce(F.col("amount") >= large, F.lit(False)))


def relabel_top(df: DataFrame, labels: DataFrame, most: int = 15) -> DataFrame:
    """Vendors relabelled by (original, label), and the top ones by rows."""
    joined = df.where("vendor is not null").join(labels, F.col("vendor") == F.col("original"), "left").withColumn("vendor", F.coalesce("label", "vendor"))
    return joined.groupBy("vendor").agg(F.count(F.lit(1)).alias("count")).orderBy(F.desc("count"), "vendor").limit(most)

"""Profiles of ledger tables: counts, distributions, histograms, top lists and series, as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.sources.shared import cut

BINS, TOP_CATEGORIES, MOST_CATEGORIES, TOP_VENDORS = 8, 8, 30, 15


def rounded(x: Column, places: int = 4) -> Column:
    """Half-even rounding on the scaled value."""
    return F.rint(x * 10**places) / 10**places


def share(part: Column, whole: Column) -> Column:
    return rounded(part / F.greatest(whole, F.lit(1)) * 100)


def nulls(df: DataFrame) -> DataFrame:
    """A row for each column: null_count and null_pct, from one aggregation."""
    counts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).alias("null_count")) for c in df.columns]))
    return counts.select("__n", each.alias("x")).select("x.*", share(F.col("x.null_count"), F.col("__n")).alias("null_pct"))


def duplicates(df: DataFrame) -> DataFrame:
    """Rows beyond the first of each set of identical rows (nulls are equal)."""
    return df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("__n")).agg(F.coalesce(F.sum(F.col("__n") - 1), F.lit(0)).alias("duplicates"))


def numeric(df: DataFrame, column: str) -> DataFrame:
    """Count of values, min, max, mean, exact median, sample deviation (0 for one value) and sum."""
    x = F.col(column)
    return df.agg(
        F.count(x).alias("n"), rounded(F.min(x)).alias("min"), rounded(F.max(x)).alias("max"), rounded(F.avg(x)).alias("mean"), rounded(F.median(x)).alias("median"),
        rounded(F.when(F.count(x) == 1, 0.0).otherwise(F.stddev_samp(x))).alias("std"), rounded(F.sum(x)).alias("sum"),
    )


def dates(df: DataFrame, column: str) -> DataFrame:
    d = F.to_date(column)
    return df.agg(F.date_format(F.min(d), "yyyy-MM-dd").alias("min_date"), F.date_format(F.max(d), "yyyy-MM-dd").alias("max_date"))


def value_counts(df: DataFrame, column: str, most: int | None = None, label: str = "label") -> DataFrame:
    """Counts of the values that aren't null; the top ones by count, then by label."""
    out = df.where(F.col(column).isNotNull()).groupBy(F.col(column).cast("string").alias(label)).agg(F.count(F.lit(1)).alias("count"))
    return out.orderBy(F.desc("count"), label).limit(most) if most else out


def histogram(df: DataFrame, column: str, bins: int = BINS) -> DataFrame:
    """Equal-width bins, closed on the right, empty ones kept; none for fewer than two rows or one distinct value."""
    x = F.col(column).cast("double")
    span = df.agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.count(x).alias("n")).where("n >= 2 and hi > lo")
    w = (F.col("hi") - F.col("lo")) / bins
    place = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((x - F.col("lo")) / w))).cast("int")
    # span is one row
    counts = df.where(x.isNotNull()).crossJoin(F.broadcast(span)).groupBy(place.alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    frame = span.select(F.explode(F.sequence(F.lit(1), F.lit(bins))).alias("bin"), "lo", w.alias("w"), (F.col("hi") - F.col("lo")).alias("r"))
    low = F.when(F.col("bin") == 1, F.col("lo") - F.col("r") / 1000).otherwise(F.col("lo") + (F.col("bin") - 1) * F.col("w"))
    return frame.join(counts, "bin", "left").select("bin", rounded(low, 2).alias("low"), rounded(F.col("lo") + F.col("bin") * F.col("w"), 2).alias("high"), F.coalesce("count", F.lit(0)).alias("count"))


def categories(df: DataFrame, column: str) -> DataFrame:
    """The top values, if the column has no more than MOST_CATEGORIES distinct ones."""
    counts = value_counts(df, column)
    few = counts.agg((F.count(F.lit(1)) <= MOST_CATEGORIES).alias("few"))
    return counts.crossJoin(F.broadcast(few)).where("few").drop("few").orderBy(F.desc("count"), "label").limit(TOP_CATEGORIES)


def months(df: DataFrame, column: str, most: int = TOP_CATEGORIES) -> DataFrame:
    m = F.date_trunc("month", F.col(column))
    counts = df.where(F.col(column).isNotNull()).groupBy(m.alias("m")).agg(F.count(F.lit(1)).alias("count"))
    return counts.orderBy(F.desc("count"), "m").limit(most).select(F.date_format("m", "MMM yyyy").alias("label"), "count")


def top_by_rows(df: DataFrame, column: str, most: int = TOP_VENDORS) -> DataFrame:
    return value_counts(df, column, most, "vendor")


def top_by_amount(df: DataFrame, column: str, amount: str = "amount", most: int = TOP_VENDORS) -> DataFrame:
    """Absolute value of the summed amount, largest first, ties by name."""
    out = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("vendor")).agg(rounded(F.abs(F.sum(amount)), 2).alias("amount"))
    return out.orderBy(F.desc("amount"), "vendor").limit(most)


def daily(df: DataFrame, date: str, amount: str = "amount") -> DataFrame:
    """Summed amount by calendar date, ascending."""
    d = F.to_date(date)
    return df.where(d.isNotNull()).groupBy(d.alias("date")).agg(rounded(F.sum(amount), 2).alias("amount")).orderBy("date")


def daily_both(gl: DataFrame, sub: DataFrame, date: str, amount: str = "amount") -> DataFrame:
    """Daily amounts of both sides, missing days as zero."""
    g, s = daily(gl, date, amount).withColumnRenamed("amount", "gl_amount"), daily(sub, date, amount).withColumnRenamed("amount", "sub_amount")
    return g.join(s, "date", "full_outer").select("date", F.coalesce("gl_amount", F.lit(0.0)).alias("gl_amount"), F.coalesce("sub_amount", F.lit(0.0)).alias("sub_amount"))


def column_kind(kind: T.DataType) -> str:
    return "numeric" if isinstance(kind, T.NumericType) else "date" if isinstance(kind, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "string"


#: Ranges that a pass of medians() counts, and distinct values that it takes to the driver in the end, of each column at most.
PARTS, FEW = 1024, 1000


def medians(counted: DataFrame, facts: list) -> dict[str, float]:
    """Exact medians of several columns of counted (column_name, x, n); facts: a row a column with column_name, lo, hi and rows.

    Each pass counts the values of all columns' ranges in PARTS parts and goes on with the part that holds the middle
    value, so ranges narrow a thousandfold a pass, whatever the number of values; few values are ranked directly.
    """
    spark = counted.sparkSession
    open_ = {(f.column_name, k): (f.lo, f.hi, k) for f in facts for k in {(f.rows + 1) // 2, f.rows // 2 + 1}}
    found: dict[tuple[str, int], float] = {}
    few = False
    while open_:
        ranges = spark.createDataFrame([(c, k, lo, hi) for (c, k), (lo, hi, _) in open_.items()], "c string, k long, lo double, hi double")
        inside = counted.join(F.broadcast(ranges), (F.col("column_name") == F.col("c")) & F.col("x").between(F.col("lo"), F.col("hi")))  # two ranges a column
        share_ = (F.col("x") / 2 - F.col("lo") / 2) / F.nullif(F.col("hi") / 2 - F.col("lo") / 2, F.lit(0.0))
        part = F.when(F.col("hi") > F.col("lo"), F.least(F.floor(share_ * PARTS), F.lit(PARTS - 1))).otherwise(F.lit(0))
        by = F.col("x") if few else part
        parts: dict = {}
        for r in inside.groupBy("c", "k", by.alias("part")).agg(F.sum("n").alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"), F.count_distinct("x").alias("values")).collect():
            parts.setdefault((r.c, r.k), []).append((r.part, r.n, r.lo, r.hi, r["values"]))
        sizes = []
        for key, (_, _, rank) in list(open_.items()):
            for _, n, lo, hi, values in sorted(parts[key]):
                if rank <= n:
                    break
                rank -= n
            if lo == hi:
                found[key] = lo
                del open_[key]
            else:
                open_[key] = (lo, hi, rank)
                sizes.append(values)
        few = bool(sizes) and max(sizes) <= FEW
    return {f.column_name: (found[f.column_name, (f.rows + 1) // 2] + found[f.column_name, f.rows // 2 + 1]) / 2 for f in facts}


def numeric_profiles(counted: DataFrame, bins: int = BINS) -> DataFrame:
    """column_name, min, max, mean, median, std, sum and histogram (counts of equal-width bins, bar-joined) of counted (column_name, x, n).

    The deviation is of the distances from the mean, which a second pass takes: squares of the values themselves
    would cancel each other where amounts are large and close.
    """
    some = counted.where("x is not null and not isnan(x)")
    x, n = F.col("x"), F.col("n")
    facts = cut(some.groupBy("column_name").agg(F.min(x).alias("lo"), F.max(x).alias("hi"), F.sum(n).alias("rows"), F.sum(x * n).alias("total")))  # a row a column
    rows = facts.collect()
    middle = counted.sparkSession.createDataFrame(list(medians(some, rows).items()), "column_name string, median double")
    mean, width = F.col("total") / F.col("rows"), F.nullif((F.col("hi") - F.col("lo")) / bins, F.lit(0.0))
    place = F.greatest(F.lit(1), F.least(F.lit(bins), F.ceil((x - F.col("lo")) / width)))
    at = [F.coalesce(F.sum(F.when(place == i, n)), F.lit(0)).cast("string") for i in range(1, bins + 1)]
    spread = some.join(F.broadcast(facts), "column_name").groupBy("column_name").agg(F.sum(n * (x - mean) * (x - mean)).alias("ss"), F.when(F.first("hi") > F.first("lo"), F.concat_ws("|", *at)).alias("histogram"))
    std = F.when(F.col("rows") == 1, 0.0).otherwise(F.sqrt(F.col("ss") / F.nullif(F.col("rows") - 1, F.lit(0))))
    return facts.join(F.broadcast(middle), "column_name").join(F.broadcast(spread), "column_name").select("column_name", rounded(F.col("lo")).alias("min"), rounded(F.col("hi")).alias("max"), rounded(mean).alias("mean"), rounded(F.col("median")).alias("median"), rounded(std).alias("std"), rounded(F.col("total"), 2).alias("sum"), "histogram")


def column_profiles(df: DataFrame) -> DataFrame:
    """A row for each column: type, distinct values, nulls; for texts the lengths, blanks and the mode; for numbers
    what numeric_profiles() says; for dates the first and last one.

    Values are counted in one pass over all columns, as (column, value) with each pair's number of rows; what
    depends on a column's values follows from these counts.
    """
    kinds = {f.name: column_kind(f.dataType) for f in df.schema.fields}
    cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v"), (F.col(c).cast("double") if k == "numeric" else F.lit(None).cast("double")).alias("x")) for c, k in kinds.items()])
    counted = cut(df.select(F.explode(cells).alias("c")).groupBy("c.column_name", "c.v", "c.x").agg(F.count(F.lit(1)).alias("n")))
    kind = F.create_map(*[F.lit(w) for c, k in kinds.items() for w in (c, k)])[F.col("column_name")]
    text, date, n = kind == "string", F.when(kind == "date", F.substring("v", 1, 10)), F.col("n")
    size = F.when(text, F.length("v"))
    out = counted.groupBy("column_name").agg(
        F.first(kind).alias("type"), F.count_if(F.col("v").isNotNull()).alias("distinct_count"), F.coalesce(F.sum(F.when(F.col("v").isNull(), n)), F.lit(0)).alias("null_count"),
        F.min(size).cast("long").alias("min_length"), F.max(size).cast("long").alias("max_length"), F.coalesce(F.sum(F.when(text & (F.trim("v") == ""), n)), F.lit(0)).alias("blanks"),
        F.min(F.when(text & F.col("v").isNotNull(), F.struct((-n).alias("o"), F.col("v").alias("v"))))["v"].alias("mode"), F.min(date).alias("first_date"), F.max(date).alias("last_date"),
    )
    return out.join(F.broadcast(numeric_profiles(counted)), "column_name", "left")  # a row a column


def column_labels(df: DataFrame, top: int = TOP_CATEGORIES) -> DataFrame:
    """Of each text column with at most MOST_CATEGORIES values the most frequent ones, of each date column the most
    frequent months: column_name, place, label and count, from one pass."""
    kinds = {f.name: column_kind(f.dataType) for f in df.schema.fields}
    cells = [F.struct(F.lit(c).alias("column_name"), (F.date_format(c, "yyyy-MM") if k == "date" else F.col(c).cast("string")).alias("label")) for c, k in kinds.items() if k != "numeric"]
    counted = df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("label is not null").groupBy("column_name", "label").agg(F.count(F.lit(1)).alias("count"))
    dates_ = [c for c, k in kinds.items() if k == "date"]
    few = counted.groupBy("column_name").agg(F.count(F.lit(1)).alias("values")).where((F.col("values") <= MOST_CATEGORIES) | F.col("column_name").isin(*dates_)).select("column_name")
    place = F.row_number().over(Window.partitionBy("column_name").orderBy(F.desc("count"), "label"))
    return counted.join(F.broadcast(few), "column_name").withColumn("place", place).where(F.col("place") <= top)  # few is a row a column


def narrative(df: DataFrame, amount: str = "amount", category: str = "entity") -> DataFrame:
    """One row with three sentences: rows, range and total of the amounts, the most frequent categories."""
    whole = lambda c: F.format_number(F.rint(c), 0)
    top = value_counts(df, category, 3).agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("o"), "label"))).alias("top"))
    names = F.array_join(F.transform("top", lambda x: F.concat(x["label"], F.lit(" ("), F.format_number(-x["o"], 0), F.lit(")"))), ", ")
    facts = numeric(df, amount).crossJoin(df.agg(F.count(F.lit(1)).alias("rows"))).crossJoin(top)  # one row each
    text = F.concat(F.lit("The ledger has "), F.format_number("rows", 0), F.lit(" rows with amounts from "), whole("min"), F.lit(" to "), whole("max"), F.lit(" and a total of "), whole("sum"), F.lit(". Most rows: "), names, F.lit("."))
    return facts.select(text.alias("narrative"))


def chat_facts(df: DataFrame, amount: str = "amount", date: str = "transaction_date", entity: str = "entity", vendor: str = "vendor_name") -> DataFrame:
    """One row: amount statistics, date range, the first five entities and the top vendors with their rows."""
    few = df.select(entity).distinct().orderBy(entity).limit(5).agg(F.array_join(F.sort_array(F.collect_list(entity)), "|").alias("first_entities"))
    top = top_by_rows(df, vendor).agg(F.sort_array(F.collect_list(F.struct((-F.col("count")).alias("o"), "vendor"))).alias("x"))
    names = top.select(F.array_join(F.transform("x", lambda x: F.concat_ws(":", x["vendor"], (-x["o"]).cast("string"))), "|").alias("top_vendors"))
    a = F.col(amount)
    facts = df.agg(*[rounded(f(a), 2).alias(f"amount_{n}") for f, n in ((F.min, "min"), (F.max, "max"), (F.sum, "sum"), (F.avg, "mean"))])
    return facts.crossJoin(dates(df, date)).crossJoin(few).crossJoin(names)  # one row each


def unique_count(df: DataFrame, column: str) -> DataFrame:
    return df.agg(F.count_distinct(column).alias("distinct_count"))


def cross_file(gl: DataFrame, sub: DataFrame) -> DataFrame:
    """Rows of both sides, their difference, and that as a share of the GL rows."""
    g, s = gl.agg(F.count(F.lit(1)).alias("gl_rows")), sub.agg(F.count(F.lit(1)).alias("sub_rows"))
    gap = F.abs(F.col("gl_rows") - F.col("sub_rows"))
    return g.crossJoin(s).select("gl_rows", "sub_rows", gap.alias("row_delta"), share(gap, F.col("gl_rows")).alias("row_delta_pct"))


def characteristics(df: DataFrame) -> DataFrame:
    """Date span in days, amount statistics to two places, entities and rows."""
    d, a = F.to_date("transaction_date"), F.col("amount")
    return df.agg(
        F.datediff(F.max(d), F.min(d)).cast("long").alias("span_days"), rounded(F.min(a), 2).alias("amount_min"), rounded(F.max(a), 2).alias("amount_max"), rounded(F.avg(a), 2).alias("amount_mean"),
        rounded(F.stddev_samp(a), 2).alias("amount_std"), F.count_distinct("entity").alias("entities"), F.count(F.lit(1)).alias("rows"),
    )


def column_metadata(df: DataFrame, order: str = "ord", samples: int = 5) -> DataFrame:
    """Distinct values, null share and up to five samples of each column: first distinct ones of a column with at
    most 20 of them, else the values of the first rows."""
    plain = [c for c in df.columns if c != order]
    facts = df.agg(F.count(F.lit(1)).alias("n"), *[F.count_distinct(F.col(c).cast("string")).alias(f"d_{c}") for c in plain], *[F.count_if(F.col(c).isNull()).alias(f"n_{c}") for c in plain])
    each = facts.select("n", F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"d_{c}").alias("distinct_count"), F.col(f"n_{c}").alias("nulls")) for c in plain])).alias("x")).select("x.*", "n")
    long = df.select(F.col(order).alias("__o"), F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in plain])).alias("x")).select("__o", "x.*").where("v is not null")
    firsts = long.groupBy("column_name", "v").agg(F.min("__o").alias("o"))
    few = firsts.withColumn("rn", F.row_number().over(Window.partitionBy("column_name").orderBy("o", "v"))).where(F.col("rn") <= samples)
    rows = df.orderBy(order).limit(samples)
    heads = rows.select(F.col(order).alias("o"), F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(c).cast("string").alias("v")) for c in plain])).alias("x")).select("o", "x.*").where("v is not null")
    lists = lambda d, name: d.groupBy("column_name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("o", "v"))), lambda x: x["v"]), "|").alias(name))
    joined = each.join(lists(few, "few"), "column_name", "left").join(lists(heads, "heads"), "column_name", "left")
    return joined.select("column_name", "distinct_count", share(F.col("nulls"), F.col("n")).alias("null_pct"), F.coalesce(F.when(F.col("distinct_count") <= 20, F.col("few")).otherwise(F.col("heads")), F.lit("")).alias("samples"))

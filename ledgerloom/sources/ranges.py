"""CSV files with quoted line ends, read in many tasks.

A line end within quotes doesn't end a record, and whether a range of a file begins within quotes depends on all
that lies before it.  A line turns each of two states at its start (outside quotes, or inside a quoted value) into
one at its end, so a range's lines together are a map of two states, and a file's maps, composed in order, give
each range's state at its start.  Two scans: the first one makes the maps (only lines with quotes leave the
scan), the second one joins lines to records.  Records across ranges come as fragments, at most two a range, which
are put together by a grouped aggregation; all others stay where they were read.

A quote opens a value only at its start, a doubled one is a quote, and what follows the closing one up to the comma is
part of the value; that is what Spark's own parser does with multiLine, which makes a file one task.  Lines
end in LF or CR LF; within values both stay as they are.  Blank lines are no records.  A file without anything gives no columns and no rows.
"""

from __future__ import annotations

import re
import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ledgerloom.sources.shared import cut

OUTSIDE, INSIDE = 0, 1
_CLOSING = re.compile(r'[^"]*(?:""[^"]*)*"(?!")')


def state_after(line: str, state: int) -> int:
    """The state at the end of a line that begins in state."""
    at = 0
    while True:
        if state == OUTSIDE:  # at is a value's start
            if not line.startswith('"', at):
                at = line.find(',"', at) + 1
                if not at:
                    return OUTSIDE
            at += 1
        closed = _CLOSING.match(line, at)
        if not closed:
            return INSIDE
        at = line.find(",", closed.end()) + 1
        if not at:
            return OUTSIDE
        state = OUTSIDE


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """Lines in each range's order: file, block (the range's first byte), value."""
    return spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), "value")


def _maps(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A range's map, as far as this task has its lines: all of them."""
    here, ends = None, (OUTSIDE, INSIDE)
    for batch in batches:
        out = []
        for file, block, value in zip(batch["file"], batch["block"], batch["value"], strict=True):
            if (file, block) != here:
                if here:
                    out.append((*here, *ends))
                here, ends = (file, block), (OUTSIDE, INSIDE)
            after = state_after(value, OUTSIDE), state_after(value, INSIDE)
            ends = after[ends[0]], after[ends[1]]
        yield pd.DataFrame(out, columns=["file", "block", "outside", "inside"])
    if here:
        yield pd.DataFrame([(*here, *ends)], columns=["file", "block", "outside", "inside"])


def range_states(lines: DataFrame) -> DataFrame:
    """file, block and begins: the state at the start of each range but a file's first one.

    The last range before whose map doesn't depend on its start fixes the state; the maps behind it either keep or
    swap it, so a running count of swaps does the composition.
    """
    quoted = lines.where(F.col("value").contains('"')).mapInPandas(_maps, "file string, block long, outside int, inside int")
    every = lines.groupBy("file", "block").agg(F.count(F.lit(1)).alias("n")).drop("n")
    maps = every.join(quoted, ["file", "block"], "left").withColumns({"outside": F.coalesce("outside", F.lit(OUTSIDE)), "inside": F.coalesce("inside", F.lit(INSIDE))})
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    fixed, swaps = F.col("outside") == F.col("inside"), F.col("outside") > F.col("inside")
    counted = maps.withColumn("swaps", F.sum(swaps.cast("int")).over(before.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(fixed, F.struct("outside", "swaps")), ignorenulls=True).over(before)
    upto = F.coalesce(F.lag("swaps").over(Window.partitionBy("file").orderBy("block")), F.lit(0))
    begins = F.when(last.isNull(), upto % 2).otherwise((last["outside"] + upto - last["swaps"]) % 2)
    return counted.select("file", "block", begins.cast("int").alias("begins")).where("block > 0")


def _records(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Records of each range; those that begin or end beyond it are marked as fragments."""
    columns = ["file", "block", "seq", "text", "headless", "endless"]
    here, state, held, headless, seq = None, OUTSIDE, [], False, 0
    for batch in batches:
        out = []
        for file, block, value, begins in zip(batch["file"], batch["block"], batch["value"], batch["begins"], strict=True):
            if (file, block) != here:
                if held:
                    out.append((*here, seq, "\n".join(held), headless, True))
                here, state, held, seq = (file, block), int(begins), [], 0
                headless = state == INSIDE
            held.append(value)
            state = state_after(value, state)
            if state == OUTSIDE:
                out.append((*here, seq, "\n".join(held), headless, False))
                held, headless, seq = [], False, seq + 1
        yield pd.DataFrame(out, columns=columns)
    if held:
        yield pd.DataFrame([(*here, seq, "\n".join(held), headless, True)], columns=columns)


def records(spark: SparkSession, path: str) -> DataFrame:
    """file, block, seq and text of each record, the header's too; block and seq are of its beginning."""
    lines = _lines(spark, path)
    states = F.broadcast(cut(range_states(lines)))  # a row for each maxPartitionBytes read
    known = F.when(F.col("block") == 0, F.lit(OUTSIDE)).otherwise(F.coalesce("begins", F.raise_error(F.lit("the ranges of the files have changed between two scans")).cast("int")))
    # the broadcast join streams the lines, so they stay in order
    read = lines.join(states, ["file", "block"], "left").select("file", "block", "value", known.alias("begins"))
    found = read.mapInPandas(_records, "file string, block long, seq long, text string, headless boolean, endless boolean")
    found = cut(found)
    # fragments only, at most two a range
    pieces = found.where("headless or endless").withColumn("chain", F.sum((~F.col("headless")).cast("int")).over(Window.partitionBy("file").orderBy("block", "seq")))
    whole = pieces.groupBy("file", "chain").agg(F.min(F.struct("block", "seq")).alias("at"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("block", "seq", "text"))), lambda x: x["text"]), "\n").alias("text"))
    return found.where("not headless and not endless").select("file", "block", "seq", "text").union(whole.select("file", "at.block", "at.seq", "text"))


def read(spark: SparkSession, path: str, empties: bool = False) -> DataFrame:
    """A CSV file, or a folder of them, with a header in each: all columns as text, named as the first header has them.

    With empties, a quoted empty value is an empty text, and only one without quotes is null; otherwise both are null.
    """
    names = spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path).columns
    schema = StructType([StructField(n, StringType()) for n in names])
    if not names:
        return spark.createDataFrame([], schema)
    text = F.regexp_replace("text", r"\r$", "")
    rows = records(spark, path).withColumn("text", text).where("text <> ''")
    header = rows.groupBy("file").agg(F.min(F.struct("block", "seq")).alias("at")).select("file", "at.block", "at.seq")  # a row a file
    rows = rows.join(header, ["file", "block", "seq"], "left_anti")
    quoted = ", ".join("`{}` string".format(n.replace("`", "``")) for n in names)
    # unless the quote is what escapes its own escape, the parser takes NUL for that and drops it before quotes
    options = {"escape": '"', "charToEscapeQuoteEscaping": '"'}
    if empties:
        options["nullValue"] = uuid.uuid4().hex  # stands for values without anything; no value is equal to it
    return rows.select(F.from_csv("text", quoted, options).alias("x")).select("x.*")

"""Chat formatting: snapshots that prefix longer conversations are collapsed, the rest rendered.

A log that stores a conversation anew after every turn holds all its prefixes.  Each
turn gets a rolling prefix hash: two 64-bit hashes of (position, role, text), combined
by exclusive or over all turns so far, which a running window computes with constant
state and which depends on order through the position.  A conversation whose whole
hash and length occur as a proper prefix of another is a snapshot: an anti-join
against the distinct prefixes drops it.  Equal conversations are first reduced to
their smallest conv_id.  Only what remains is gathered and rendered.

All steps are DataFrame functions.  The hashes travel without the texts; a common
first turn or a conversation with many copies is one row after the partial
aggregation of each task.  A conversation's turns are in one row only in the end,
where the result needs its text in one row.

Turns are ordered by turn, then role, then the text's md5; null turns come first.  Null role or
text counts as empty.  Rows that are equal in conv_id, turn, role and text are one
turn.  Rows without conv_id belong to no conversation and are left out.  Other columns
are left out; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import cut, table

START, END = "<|im_start|>", "<|im_end|>"


def turns_of(log: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    return log.where(F.col(conv_id).isNotNull()).select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, position, the prefix hashes h1 and h2 up to that turn, and the number of turns n."""
    marks = turns.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("m")).distinct()
    order = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "m")
    at = marks.withColumn("position", F.row_number().over(order))
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rolled = [F.bit_xor(F.xxhash64(F.lit(salt), "position", "role", "m")).over(upto).alias(name) for salt, name in ((1, "h1"), (2, "h2"))]
    n = F.count(F.lit(1)).over(Window.partitionBy("conv_id")).alias("n")
    return at.select("conv_id", "position", *rolled, n)


def maximal(turns: DataFrame) -> DataFrame:
    """conv_id, n_turns, n_copies of the conversations that no longer one begins with, equal ones once."""
    rolled = cut(prefixes(turns))
    whole = rolled.where("position = n").groupBy("h1", "h2", "n").agg(F.min("conv_id").alias("conv_id"), F.count(F.lit(1)).alias("n_copies"))
    inner = rolled.where("position < n").select("h1", "h2", F.col("position").cast("long").alias("n")).distinct()
    return whole.join(inner, ["h1", "h2", "n"], "left_anti").select("conv_id", F.col("n").alias("n_turns"), "n_copies")


def format_chats(log: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", start: str = START, end: str = END) -> DataFrame:
    """conv_id, n_turns, n_copies and the rendered text of each maximal conversation."""
    turns = turns_of(log, conv_id, turn, role, text)
    kept = maximal(turns)
    # the texts of kept conversations only; sort keys are those of prefixes()
    rows = turns.join(kept.select("conv_id"), "conv_id", "left_semi").distinct()
    keyed = rows.select("conv_id", F.struct("turn", "role", F.md5(F.col("text").cast("binary")).alias("m"), "text").alias("t"))
    gathered = keyed.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("t"))
    rendered = F.array_join(F.transform("t", lambda x: F.concat(F.lit(start), x["role"], F.lit("\n"), x["text"], F.lit(end + "\n"))), "")
    return gathered.select("conv_id", rendered.alias("text")).join(kept, "conv_id").select("conv_id", "n_turns", "n_copies", "text")


def op10_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))


ORACLE = """
WITH t AS (SELECT DISTINCT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, list(struct_pack(role, text) ORDER BY turn NULLS FIRST, role, md5(text)) AS turns FROM t GROUP BY conv_id),
u AS (SELECT turns, min(conv_id) AS conv_id, count(*) AS n_copies FROM c GROUP BY turns),
p AS (SELECT DISTINCT turns[1:i] AS turns FROM (SELECT turns, unnest(range(1, len(turns))) AS i FROM u)),
k AS (SELECT u.* FROM u ANTI JOIN p USING (turns))
SELECT conv_id, len(turns) AS n_turns, n_copies,
       list_aggregate(list_transform(turns, lambda x: '<|im_start|>' || x.role || chr(10) || x.text || '<|im_end|>' || chr(10)), 'string_agg', '') AS text
FROM k
"""

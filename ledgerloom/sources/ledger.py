"""General-ledger and subledger views over the supplied tables.

Orders become the two sides of a ledger: the entity is nation and market segment, the
vendor a part name decorated differently on each side, and cohorts by order key give
exact pairs, dates or amounts that differ, and split postings on either side.  The SQL
text is the same in Spark and DuckDB, so that both sides of a comparison start from the
same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

_BASE = """
base AS (
  SELECT o_orderkey AS k, o_orderkey % 10 AS c, n_name || '-' || c_mktsegment AS entity,
         p_name || ' ' || p_brand AS v, o_totalprice AS amt, CAST(o_orderdate AS DATE) AS d,
         'ACC' || CAST(o_custkey % 40 AS VARCHAR(20)) AS acct
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN part ON p_partkey = c_custkey),
parts AS (SELECT 0 AS p UNION ALL SELECT 1 AS p)"""

_DRESS = """CASE {by} WHEN 0 THEN v WHEN 1 THEN upper(v) WHEN 2 THEN v || ', Inc.' ELSE 'The ' || v || ' LLC' END"""
_MONEY = "floor({x} * 100 + 0.5) / 100"

GL_SQL = f"""{_BASE},
gl AS (
  SELECT 'G' || CAST(k AS VARCHAR(20)) || CASE WHEN c = 8 AND k % 20 <> 18 THEN CASE p WHEN 0 THEN 'a' ELSE 'b' END ELSE '' END AS gl_id,
         entity, acct AS account_code, CASE WHEN k % 211 = 0 THEN NULL WHEN k % 170 = 3 THEN replace(v, 'r', 'rr') WHEN k % 190 = 4 THEN 'Unlisted ' || acct ELSE {_DRESS.format(by="k % 4")} END AS vendor_name, d AS transaction_date,
         {_MONEY.format(x="(CASE WHEN c = 8 AND k % 20 <> 18 THEN CASE p WHEN 0 THEN amt * 0.6 ELSE amt * 0.4 END ELSE amt END)")} AS amount,
         'USD' AS currency, k % 97 = 0 AS exception_flag, k * 2 + p AS ord
  FROM base CROSS JOIN parts WHERE p = 0 OR (c = 8 AND k % 20 <> 18))"""

SUB_SQL = f"""sub AS (
  SELECT 'S' || CAST(k AS VARCHAR(20)) || CASE WHEN c = 7 THEN CASE p WHEN 0 THEN 'a' ELSE 'b' END ELSE '' END AS subledger_id,
         entity, CASE WHEN k % 223 = 0 THEN NULL WHEN k % 13 = 5 THEN replace(v, 'e', 'a') || ' Corp' ELSE {_DRESS.format(by="(k + 1) % 4")} END AS vendor_name,
         CASE c WHEN 4 THEN d + 20 WHEN 5 THEN d + 45 WHEN 9 THEN d + 75 ELSE d END AS transaction_date,
         {_MONEY.format(x="(CASE c WHEN 6 THEN amt * 1.03 WHEN 7 THEN CASE p WHEN 0 THEN amt * 0.6 ELSE amt * 0.4 END ELSE amt END)")} AS amount,
         'USD' AS currency, 'G' || CAST(k AS VARCHAR(20)) AS reference_id, k * 2 + p AS ord
  FROM base CROSS JOIN parts WHERE (p = 0 OR c = 7) AND NOT k % 20 = 18)"""

#: Chart of accounts, one row an account.
COA_SQL = """coa AS (SELECT DISTINCT acct AS account_code, 'Account ' || acct AS account_name, CASE WHEN substr(acct, 4, 1) < '5' THEN 'Asset' ELSE 'Expense' END AS account_type, 10000.0 AS materiality_threshold FROM base)"""


def tables(spark: SparkSession, sf_dir: str) -> None:
    """Registers the tables that the views read."""
    for name in ("orders", "customer", "nation", "part"):
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def spread(sql: str) -> str:
    """The view as Spark runs it: its two-row join is a generator, so that no cartesian product is planned, and tables that grow
    are merged, however small their files (compressed ones are estimated far below their rows' size): none passes through the driver."""
    merged = sql.replace("SELECT o_orderkey AS k", "SELECT /*+ MERGE(customer, part) */ o_orderkey AS k")
    return merged.replace("base CROSS JOIN parts", "base LATERAL VIEW explode(array(0, 1)) parts AS p")


def gl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """gl_id, entity, account_code, vendor_name, transaction_date, amount, currency, exception_flag and the row order ord."""
    tables(spark, sf_dir)
    return spark.sql(spread(f"WITH {GL_SQL} SELECT * FROM gl"))


def sub(spark: SparkSession, sf_dir: str) -> DataFrame:
    """subledger_id, entity, vendor_name, transaction_date, amount, currency, reference_id and the row order ord."""
    tables(spark, sf_dir)
    return spark.sql(spread(f"WITH {_BASE}, {SUB_SQL} SELECT * FROM sub"))


def coa(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables(spark, sf_dir)
    return spark.sql(spread(f"WITH {_BASE}, {COA_SQL} SELECT * FROM coa"))

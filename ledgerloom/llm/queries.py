"""The registered queries of the training-data operators, and their SQL.

Each opN_<name> applies operator N with its production parameters to the whole
table; the operators themselves return texts, spans and files as well.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ledgerloom.llm.binary_output import token_output
from ledgerloom.llm.chat import ORACLE as CHAT_SQL
from ledgerloom.llm.chat import op10_chat
from ledgerloom.llm.common import table
from ledgerloom.llm.decontaminate import decontaminate
from ledgerloom.llm.filter_audit import ORACLE as AUDIT_SQL
from ledgerloom.llm.filter_audit import op13_filter_audit
from ledgerloom.llm.fingerprints import op8_fingerprints
from ledgerloom.llm.language_id import op2_language_id
from ledgerloom.llm.mixing import ORACLE as MIXING_SQL
from ledgerloom.llm.mixing import op4_mixing
from ledgerloom.llm.ngram_join import op12_ngram_join
from ledgerloom.llm.quality import op5_quality
from ledgerloom.llm.repair import op11_repair
from ledgerloom.llm.secret_scan import op6_secrets
from ledgerloom.llm.simhash import near_duplicates
from ledgerloom.llm.token_counts import count_tokens


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return count_tokens(docs).drop("text")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return decontaminate(docs, table(spark, sf_dir, "benchmark")).drop("text", "items", "spans")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_binary_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_output(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_counts": op1_token_counts,
    "op2_language_id": op2_language_id,
    "op3_decontaminate": op3_decontaminate,
    "op4_mixing": op4_mixing,
    "op5_quality": op5_quality,
    "op6_secrets": op6_secrets,
    "op7_simhash": op7_simhash,
    "op8_fingerprints": op8_fingerprints,
    "op9_binary_output": op9_binary_output,
    "op10_chat": op10_chat,
    "op11_repair": op11_repair,
    "op12_ngram_join": op12_ngram_join,
    "op13_filter_audit": op13_filter_audit,
}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {"op4_mixing": MIXING_SQL, "op10_chat": CHAT_SQL, "op13_filter_audit": AUDIT_SQL}

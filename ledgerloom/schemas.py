"""Declared schemas of the input files, and the matches' unified schema."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T

#: Boolean tokens (fixed values): text on the left, value on the right.
BOOLEANS = {"True": True, "true": True, "1": True, "Y": True, "y": True, "False": False, "false": False, "0": False, "N": False, "n": False}
#: Texts that a CSV reader takes for a missing value (fixed values).
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")


@dataclass(frozen=True)
class FileSchema:
    """An expected file: its name, whether it may be missing, and its declared columns."""

    filename: str
    required: bool
    columns: dict[str, str]

    def struct(self) -> T.StructType:
        kinds = {"string": T.StringType(), "timestamp": T.TimestampType(), "double": T.DoubleType(), "boolean": T.BooleanType()}
        return T.StructType([T.StructField(c, kinds[k]) for c, k in self.columns.items()])


SCHEMAS = {
    "gl": FileSchema("GL.csv", True, {"gl_id": "string", "entity": "string", "account_code": "string", "vendor_name": "string", "transaction_date": "timestamp", "amount": "double", "currency": "string", "exception_flag": "boolean"}),
    "subledger": FileSchema("Subledger.csv", True, {"subledger_id": "string", "entity": "string", "vendor_name": "string", "transaction_date": "timestamp", "amount": "double", "currency": "string", "reference_id": "string"}),
    "chart_of_accounts": FileSchema("Chart_of_Accounts.csv", False, {"account_code": "string", "account_name": "string", "account_type": "string", "materiality_threshold": "double"}),
    "ground_truth": FileSchema("Ground_Truth_Exceptions.csv", False, {"gl_id": "string", "true_exception_type": "string", "risk_level": "string", "materiality_flag": "boolean", "human_override_classification": "string", "final_classification": "string"}),
}
#: Files that intake takes.
INTAKE = ("gl", "subledger", "chart_of_accounts")

MATCHES = "match_id string, layer string, a array<string>, b array<string>, scenario_id int, similarity double, advised double, status string, overridden boolean"

"""Reading and validating the input files.

Files are read with all columns as text; missing-value tokens become null.  Every file is
checked in full before one error reports all problems.  Types are cast after validation.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.schemas import BOOLEANS, INTAKE, MISSING, SCHEMAS
from ledgerloom.sources import ranges

SAMPLE_ROWS, SAMPLE_VALUES = 20, 5


class IntakeError(ValueError):
    """All problems of all files."""

    def __init__(self, problems: dict[str, list[str]]) -> None:
        super().__init__(json.dumps(problems, sort_keys=True))
        self.problems = problems


@dataclass(frozen=True)
class ValidationResult:
    key: str
    is_valid: bool
    row_count: int
    columns: tuple[str, ...]
    schema_hash: str
    missing: tuple[str, ...] = ()
    errors: dict[str, int] = field(default_factory=dict)


def read_csv(spark: SparkSession, path: str, empties: bool = False) -> DataFrame:
    """A CSV file with a header, all columns as text; values may hold line ends.  With empties, quoted empty values are not null."""
    return ranges.read(spark, path, empties)


def present(column: str) -> Column:
    """The text, null if it is a missing-value token."""
    c = F.col(column).cast("string")
    return F.when(~c.isin(*MISSING), c)


def typed(column: str, kind: str) -> Column:
    """The typed value, null where it can't be cast."""
    x = present(column)
    if kind == "double":
        return x.try_cast("double")
    if kind == "timestamp":
        return F.try_to_timestamp(x)
    if kind == "boolean":
        yes = [t for t, v in BOOLEANS.items() if v]
        return F.when(x.isin(*yes), True).when(x.isin(*[t for t in BOOLEANS if t not in yes]), False)
    return x


def bad(column: str, kind: str) -> Column:
    """Whether a value is there but isn't of its kind."""
    return present(column).isNotNull() & typed(column, kind).isNull()


def _checked(key: str) -> dict[str, str]:
    return {c: k for c, k in SCHEMAS[key].columns.items() if k != "string"}


def missing_columns(df: DataFrame, key: str) -> list[str]:
    return [c for c in SCHEMAS[key].columns if c not in df.columns]


def errors(df: DataFrame, key: str) -> DataFrame:
    """A row for each column with bad values, from one aggregation."""
    kinds = _checked(key)
    counts = df.agg(*[F.count_if(bad(c, k)).alias(c) for c, k in kinds.items()])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("expected"), F.col(c).alias("bad_count")) for c, k in kinds.items()]))
    return counts.select(each.alias("x")).select("x.*").where("bad_count > 0")


def error_samples(df: DataFrame, key: str, order: str = "ord") -> DataFrame:
    """The first bad rows of each column."""
    kinds = _checked(key)
    cells = F.array(*[F.when(bad(c, k), F.struct(F.lit(c).alias("column_name"), F.col(c).alias("value"))) for c, k in kinds.items()])
    found = df.select(order, F.explode(cells).alias("x")).where("x is not null").select("x.column_name", order, "x.value")
    rn = F.row_number().over(Window.partitionBy("column_name").orderBy(order))  # limited, so each task keeps its first rows only
    return found.withColumn("__rn", rn).where(F.col("__rn") <= SAMPLE_ROWS).withColumn("value", F.when(F.col("__rn") <= SAMPLE_VALUES, F.col("value"))).drop("__rn")


def cast(df: DataFrame, key: str) -> DataFrame:
    """Declared columns typed, all others as they are."""
    kinds = SCHEMAS[key].columns
    return df.select(*[typed(c, kinds[c]).alias(c) if c in kinds else F.col(c) for c in df.columns])


def schema_hash(key: str, df: DataFrame, rows: int) -> str:
    facts = {"file": key, "columns": sorted(df.columns), "dtypes": dict(sorted(df.dtypes)), "row_count": rows}
    return hashlib.sha256(json.dumps(facts, sort_keys=True, separators=(",", ":")).encode()).hexdigest()


def validate(df: DataFrame, key: str) -> tuple[DataFrame | None, ValidationResult]:
    """The typed frame (none if invalid) and the result; missing columns stop the check of types."""
    gone = missing_columns(df, key)
    if gone:
        return None, ValidationResult(key, False, df.count(), tuple(df.columns), "", tuple(gone))
    kinds = _checked(key)
    facts = df.agg(F.count(F.lit(1)).alias("__n"), *[F.count_if(bad(c, k)).alias(c) for c, k in kinds.items()]).first()
    found = {c: facts[c] for c in kinds if facts[c]}
    out = cast(df, key)
    result = ValidationResult(key, not found, facts["__n"], tuple(df.columns), schema_hash(key, out, facts["__n"]), (), found)
    return (None if found else out), result


def intake(spark: SparkSession, files: dict[str, str]) -> tuple[dict[str, DataFrame], dict[str, ValidationResult]]:
    """Typed frames of the given files (key to path); raises one error on everything that is wrong.

    A missing chart of accounts becomes an empty frame.
    """
    problems: dict[str, list[str]] = {}
    frames, results = {}, {}
    for key in INTAKE:
        schema = SCHEMAS[key]
        path = files.get(key)
        if path is None:
            if schema.required:
                problems.setdefault(key, []).append(f"{schema.filename} is missing")
            continue
        if path.rstrip("/").rpartition("/")[2] != schema.filename:
            problems.setdefault(key, []).append(f"expected the file name {schema.filename}")
            continue
        frame, results[key] = validate(read_csv(spark, path), key)
        problems_of = [f"missing column {c}" for c in results[key].missing] + [f"{n} bad values in {c}" for c, n in results[key].errors.items()]
        if problems_of:
            problems.setdefault(key, []).extend(problems_of)
        else:
            frames[key] = frame
    for key in set(files) - set(INTAKE):
        problems.setdefault(key, []).append("unknown file")
    if problems:
        raise IntakeError(problems)
    frames.setdefault("chart_of_accounts", spark.createDataFrame([], SCHEMAS["chart_of_accounts"].struct()))
    return frames, results

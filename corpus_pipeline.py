"""The corpus pipeline: stages over documents, each written as Parquet and read again.

Each stage takes (spark, docs, sf_dir).  All but the last return documents' columns;
the last one returns what token output says of its input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerloom.llm.binary_output import token_output
from ledgerloom.llm.common import remove, shared_path, table
from ledgerloom.llm.decontaminate import decontaminate
from ledgerloom.llm.mixing import mix
from ledgerloom.llm.quality import keep_good
from ledgerloom.llm.simhash import drop_near_duplicates


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return keep_good(docs, table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest doc_id stays."""
    return drop_near_duplicates(docs)


def set_aside(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """docs under names that no operator gives to its results, and the new name of each column."""
    names = {c: f"__column_{c}" for c in docs.columns}
    return docs.withColumnsRenamed(names), names


def put_back(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*[F.col(f"`{new}`").alias(old) for old, new in names.items()])


def clean_of_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with words in an occurrence of a benchmark window go."""
    rows, names = set_aside(docs)
    found = decontaminate(rows, table(spark, sf_dir, "benchmark"), text=names["text"])
    return put_back(found.where(~F.col("contaminated")), names)


def to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix draws it.

    The shuffle within the mix's shards does not outlast this stage, as tokens() orders by doc_id.
    """
    rows, names = set_aside(docs)
    return put_back(mix(rows, doc_id=names["doc_id"], text=names["text"], source=names["source"]), names)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as token-id files in ascending doc_id order (copies lie together), and what they hold of each document."""
    return token_output(docs)


STAGES = [
    ("quality", good_quality),
    ("near_dedup", near_dedup),
    ("decontaminate", clean_of_benchmark),
    ("mix", to_weights),
    ("token_output", tokens),
]

#: None: the classifier, XXH64 fingerprints and the tokenizer can't be expressed in SQL; tests/llm compare each stage's rows with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows for the documents of sf_dir.

    A stage's table is removed once the next one is written; the token files stay for the caller (common.clear).
    """
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        path = shared_path(spark, f"corpus-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
        if last:
            remove(spark, last)
        last = path
    out = STAGES[-1][1](spark, docs, sf_dir)
    remove(spark, last)
    return out

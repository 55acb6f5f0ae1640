"""Quality classifier: a regularised quadratic discriminant on document statistics.

Each text becomes a fixed vector of transformed statistics (size, word and line
repetition, shares of character classes, byte entropy).  Per class, mean and
covariance come from exact moment sums over every labelled training row; the
covariances are shrunk towards the pooled one and towards a scaled identity.  The
score is the difference of the Gaussian log-densities, each a Mahalanobis
distance through a cached Cholesky factor, put through a logistic curve.

Only rows whose crc32(doc_id as text) mod 3 is not 1 are learnt from.  Labels,
lang, source and doc_id never enter a score.  All such rows are used: no sample.

Null texts count as empty, and an empty text has a score as any other.  A null
doc_id is not held out and has no label.  Null qualities are left out; a repeated
label row counts once for each distinct quality.  With fewer than two rows of
either class every text gets the smoothed share of label 1 as its score.  Rows and
other columns stay as they are; columns named like the results are replaced; an
empty table gives an empty table.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import append, cut, lean, sliced, table, texts

#: Weight of the pooled covariance in a class covariance, and of the scaled identity in the sum.
TO_POOLED, TO_IDENTITY = 0.1, 0.05
#: Label rows (12 bytes) that may be broadcast.
FEW = 100_000
#: Character classes by byte: lower, upper, digit, blank, line end, sentence marks, other ASCII, beyond ASCII.
_CLASS = np.array(
    [0 if 97 <= c <= 122 else 1 if 65 <= c <= 90 else 2 if 48 <= c <= 57 else 3 if c in b" \t" else 4 if c in b"\n\r" else 5 if c in b".,;:?'\"-()" else 7 if c >= 128 else 6 for c in range(256)],
    dtype=np.uint8,
)
NAMES = (
    "log_bytes", "log_words", "word_length", "upper", "digit", "marks", "symbols", "beyond_ascii", "words_a_line",
    "distinct_words", "distinct_lines", "top_word", "stutter", "entropy", "capitalised", "longest_word",
)
HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, false)"


def statistics(text: str) -> np.ndarray:
    """The transformed statistics of one text, in the order of NAMES."""
    raw = text.encode("utf-8", "surrogatepass")
    n = len(raw)
    by_byte = np.bincount(np.frombuffer(raw, dtype=np.uint8), minlength=256)
    by_class = np.bincount(_CLASS, weights=by_byte, minlength=8)
    words = text.split()
    lines = [x for x in text.split("\n") if x]
    w, k = max(1, len(words)), max(1, len(lines))
    counts = Counter(words)
    share = by_class / max(1, n)
    p = by_byte[by_byte > 0] / max(1, n)
    return np.array(
        [
            np.log1p(n),
            np.log1p(len(words)),
            np.log1p(n / w),
            np.arcsinh(50 * share[1]),
            np.arcsinh(50 * share[2]),
            np.arcsinh(50 * share[5]),
            np.arcsinh(200 * share[6]),
            np.arcsinh(20 * share[7]),
            np.log1p(w / k),
            np.log1p(len(counts)) / np.log1p(w),
            np.log(max(1, len(set(lines))) / k),
            np.arcsinh(20 * max(counts.values(), default=0) / w),
            np.arcsinh(20 * sum(a == b for a, b in zip(words, words[1:])) / w),
            float(-(p * np.log(p)).sum()) if n else 0.0,
            np.arcsinh(5 * sum(a[0].isupper() for a in counts) / max(1, len(counts))),
            np.log1p(max(map(len, counts), default=0)),
        ]
    )


@dataclass(frozen=True)
class Discriminant:
    """The fitted model: for each class mean, inverse Cholesky factor and log-density offset, in scaled statistics."""

    centre: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    factors: np.ndarray
    offsets: np.ndarray
    constant: float | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        z = (x - self.centre) / self.scale
        log = [o - 0.5 * (((z - m) @ f.T) ** 2).sum(axis=1) for m, f, o in zip(self.means, self.factors, self.offsets, strict=True)]
        # divided by the number of statistics, so that scores of 0 and 1 by rounding stay rare; the sign is the same
        return 1 / (1 + np.exp(-np.clip((log[1] - log[0]) / x.shape[1], -500, 500)))


def fitted(n: np.ndarray, sums: np.ndarray, squares: np.ndarray, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
    """The model from each class's row count, sum vector and sum of outer products."""
    d = sums.shape[1]
    one = np.ones(d)
    if n.min() < 2:
        return Discriminant(one, one, sums, squares, n, constant=float((n[1] + 1) / (n.sum() + 2)))
    centre = sums.sum(axis=0) / n.sum()
    scale = np.sqrt(np.maximum(np.diag(squares.sum(axis=0)) / n.sum() - centre**2, 1e-9))
    means = (sums / n[:, None] - centre) / scale
    raw = [squares[k] / n[k] - np.outer(sums[k] / n[k], sums[k] / n[k]) for k in (0, 1)]
    own = [c / np.outer(scale, scale) for c in raw]
    pooled = (n[0] * own[0] + n[1] * own[1]) / n.sum()
    factors, offsets = [], []
    for k in (0, 1):
        c = (1 - to_pooled) * own[k] + to_pooled * pooled
        c = (1 - to_identity) * c + to_identity * (np.trace(c) / d + 1e-6) * np.eye(d)
        low = np.linalg.cholesky(c)
        factors.append(np.linalg.inv(low))
        offsets.append(np.log(n[k] / n.sum()) - np.log(np.diag(low)).sum())
    return Discriminant(centre, scale, means, np.array(factors), np.array(offsets))


def with_statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with the column stats, an array in the order of NAMES."""

    def make():
        return lambda batch: [[statistics(x) for x in texts(batch, text)]]

    return append(docs, T.StructType([T.StructField("stats", T.ArrayType(T.DoubleType()))]), make)


def known_rows(labels: DataFrame) -> DataFrame:
    """doc_id and quality of the labels that may be learnt from."""
    return labels.where("quality in (0, 1) and doc_id is not null").where(f"not {HELD_OUT}").select("doc_id", F.col("quality").cast("int")).distinct()


def fit(rows: DataFrame, to_pooled: float = TO_POOLED, to_identity: float = TO_IDENTITY) -> Discriminant:
    """The model from rows (quality, stats).

    Moments are summed in each partition and then by (class, position); the driver gets 2 * (1 + d + d * d) numbers.
    """
    d = len(NAMES)

    def moments(batches):
        total = np.zeros((2, 1 + d + d * d))
        for b in batches:
            q = np.asarray(b.column(0).to_pylist(), dtype=int)
            x = np.array(b.column(1).flatten()).reshape(-1, d)
            for k in (0, 1):
                y = x[q == k]
                total[k] += np.concatenate([[len(y)], y.sum(axis=0), (y.T @ y).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([0, 1], pa.int32()), pa.array(list(total), pa.list_(pa.float64()))], names=["quality", "m"])

    parts = rows.select("quality", "stats").mapInArrow(lean(moments), "quality int, m array<double>").select("quality", F.posexplode("m").alias("at", "v"))
    total = np.zeros((2, 1 + d + d * d))
    for r in parts.groupBy("quality", "at").agg(F.sum("v").alias("v")).collect():
        total[r.quality, r["at"]] = r.v
    return fitted(total[:, 0], total[:, 1 : 1 + d], total[:, 1 + d :].reshape(2, d, d), to_pooled, to_identity)


def score(stats: DataFrame, model: Discriminant) -> DataFrame:
    """Rows with stats, and their score and predicted class."""
    fields = T.StructType([T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def make():
        def work(batch):
            x = batch.column(batch.schema.get_field_index("stats"))
            s = model.scores(np.array(x.flatten()).reshape(-1, len(NAMES)))
            return [s, (s >= 0.5).astype(int)]

        return work

    return append(stats, fields, make)


def classify(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """doc_id, held_out, score and predicted of each document; its statistics are computed once."""
    stats = cut(with_statistics(docs.select("doc_id", F.col(text).alias("text"))).drop("text"))
    model = fit(stats.join(known_rows(labels), "doc_id"))
    return score(stats, model).select("doc_id", F.expr(HELD_OUT).alias("held_out"), "score", "predicted")


def keep_good(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The documents whose predicted class is 1, with all their columns.

    The model learns from rows that may be learnt from only; few labels (up to FEW rows, counted) are broadcast so that
    other texts need no statistics, many meet the statistics instead of the texts in a shuffle.  All documents are scored as they pass.
    """
    known, learnt = known_rows(labels), docs.where(f"not {HELD_OUT}").select("doc_id", F.col(text).alias("text"))
    if known.count() <= FEW:
        rows = with_statistics(learnt.join(F.broadcast(known), "doc_id").select("quality", "text"))
    else:
        rows = with_statistics(learnt).drop("text").join(known, "doc_id")
    model = fit(rows)

    def run(batches):
        for b in sliced(batches):
            s = model.scores(np.array([statistics(x) for x in texts(b, text)]).reshape(-1, len(NAMES)))
            yield b.filter(pa.array(s >= 0.5))

    return docs.mapInArrow(lean(run), docs.schema)


def op5_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))

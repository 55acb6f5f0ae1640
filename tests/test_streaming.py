"""The streams give the batch rules' rows, however the files arrive."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from ledgerloom.streaming.arrivals import candidate_stream, daily_totals

KIND = "id string, vn string, amount double, entity string, at timestamp"
BEGIN = datetime(2024, 1, 1, 12)


def arriving(spark, folder, rows):
    """A stream over a folder in which each list of rows is a file."""
    for k, part in enumerate(rows):
        spark.createDataFrame(part, KIND).coalesce(1).write.parquet(f"{folder}/{k}")
    return spark.readStream.schema(KIND).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(str(folder))


def run(spark, df, name, folder, mode):
    query = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(folder)).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name).collect()


def test_pairs_within_the_band(spark, tmp_path):
    day = lambda n: BEGIN + timedelta(n)
    gl = [[("G1", "a", 5.0, "X", day(0)), ("G2", "a", 7.004, "X", day(1))], [("G3", "b", 5.0, "X", day(2)), ("G4", None, 5.0, "X", day(2))]]
    sub = [[("S1", "a", 5.0, "X", day(30)), ("S2", "a", 7.0, "X", day(5))], [("S3", "a", 5.0, "X", day(31)), ("S4", "b", 5.0, "Y", day(2)), ("S5", None, 5.0, "X", day(2))]]
    pairs = candidate_stream(arriving(spark, tmp_path / "g", gl), arriving(spark, tmp_path / "s", sub), 30, "60 days")
    assert {tuple(r) for r in run(spark, pairs, "pairs_", tmp_path / "c1", "append")} == {("G1", "S1"), ("G2", "S2")}


def test_daily_totals_are_final_behind_the_watermark(spark, tmp_path):
    rows = [("r", "v", float(k), "X", BEGIN + timedelta(hours=8 * k)) for k in range(12)]
    last = [("r", "v", 1000.0, "X", BEGIN + timedelta(days=40))]
    late = [("r", "v", 5000.0, "X", BEGIN)]  # behind the watermark by then
    got = run(spark, daily_totals(arriving(spark, tmp_path / "d", [rows[6:], rows[:6], last, late])), "totals_", tmp_path / "c2", "append")
    want = spark.createDataFrame(rows, KIND).groupBy(F.window("at", "1 day"), "entity").agg(F.sum("amount").alias("amount"), F.count(F.lit(1)).alias("rows"))
    found = {(r.day, r.amount, r.rows) for r in got}
    assert found <= {(r.window.start, r.amount, r.rows) for r in want.collect()} and len(found) >= 3

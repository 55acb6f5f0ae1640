"""CSV files read by ranges: the rows of the one-task read, wherever the ranges end."""

from __future__ import annotations

import random

import pytest

from ledgerloom.plans import catalog
from ledgerloom.sources import ranges


def whole(spark, path):
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path)


@pytest.fixture
def small(spark):
    """Ranges of few bytes."""
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    yield lambda n: spark.conf.set("spark.sql.files.maxPartitionBytes", n)
    spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def texts(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_states():
    o, i = ranges.OUTSIDE, ranges.INSIDE
    for line, outside, inside in (('a,b', o, i), ('"a', i, o), ('a,"b', i, o), ('a,b"c', o, o), ('"a""', i, o), ('"a"""', o, o), ('""', o, i), ('x","y', i, i), ('x"y,"z', i, i), ('"""', i, o), ('', o, i)):
        assert (ranges.state_after(line, o), ranges.state_after(line, i)) == (outside, inside), line


@pytest.mark.parametrize("size", [19, 1000])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_equal_to_one_task(spark, tmp_path, small, size, end):
    rng = random.Random(size)
    value = lambda: "".join(rng.choice(["a", "b", ",", '"', end, " ", "é"]) for _ in range(rng.randrange(12)))
    quoted = lambda v: '"' + v.replace('"', '""') + '"' if any(c in v for c in ',"\n') or rng.random() < 0.2 else v
    made = [[value() for _ in range(3)] for _ in range(60)] + [["x", 'five " inch', end.join("long" * 30 for _ in range(9))]]
    lines = [",".join(["k", *map(quoted, row)]) for row in made]
    lines.insert(20, 'k,a"b,c"d,e')  # quotes within values that none opens
    lines.insert(30, "")
    (tmp_path / "t.csv").write_bytes(end.join(["p,q,r,s", *lines, ""]).encode())
    path = str(tmp_path / "t.csv")
    want = texts(whole(spark, path))
    small(size)
    got = ranges.read(spark, path)
    rows = texts(got)
    if end == "\r\n":  # kept as they are in values, where the one-task read makes them LF
        assert any("\r\n" in v for r in rows for v in r if v)
        rows = sorted((tuple(v and v.replace("\r\n", "\n") for v in r) for r in rows), key=repr)
    assert got.columns == ["p", "q", "r", "s"] and rows == want and len(want) == len(made) + 1
    if size < 100:
        assert ranges._lines(spark, path).rdd.getNumPartitions() > 10


def test_header_only_and_empty_files(spark, tmp_path, small):
    small(5)
    (tmp_path / "head.csv").write_text('a,"b\nc"\n')
    got = ranges.read(spark, str(tmp_path / "head.csv"))
    assert got.columns == ["a", "b\nc"] and got.count() == 0
    (tmp_path / "none.csv").write_text("")
    assert ranges.read(spark, str(tmp_path / "none.csv")).columns == []


def test_folder_with_a_header_in_each_file(spark, tmp_path, small):
    small(16)
    for n in range(3):
        (tmp_path / f"part-{n}.csv").write_text(f'a,b\n{n},"x\ny"\n{n},z\n')
    assert texts(ranges.read(spark, str(tmp_path))) == sorted((str(n), v) for n in range(3) for v in ("x\ny", "z"))


def test_texts_come_back_as_they_were(spark, duck, tmp_path, small):
    """Empty texts, nulls and NULs next to quotes."""
    small(64)
    rng = random.Random(2)
    made = [None, "", " ", '"', '""', "\0", '"\0', '\0"', '"\0"', "\0,", "a\r", "\r\n", "\\", '\\"', "\u2028", "\u0085", "null"]
    made += ["".join(rng.choice(['"', ",", "\n", "\r", "\0", "\\", " ", "a", "é", "#"]) for _ in range(rng.randrange(8))) for _ in range(150)]
    rows = [(k, text, rng.choice(["web", 'a"b', "", None, "x,y"])) for k, text in enumerate(made)]
    spark.createDataFrame(rows, "doc_id long, text string, source string").coalesce(2).write.parquet(str(tmp_path / "documents.parquet"))
    want = duck.sql(catalog.ORACLE_SQL["scan_csv_texts"].replace("FROM documents", f"FROM '{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert texts(catalog.QUERIES["scan_csv_texts"](spark, str(tmp_path))) == sorted(want, key=repr)

"""Secret scans: fixed patterns, and a randomness test battery for what they miss.

Base spans are the matches of three patterns.  Beyond them, every run of CANDIDATE
characters outside the base spans is tested.  Its encoding is inferred from its
characters (ENCODINGS: hexadecimal, base32, letters and digits of one case, of both,
base64), which fixes an alphabet in code order and its cells, groups of characters
that are so large that their counts can be tested in short strings.

* A secret must look random: uniform draws from the alphabet must not be rejected by
  the chi-squared test of the cells' counts, the test of the number of runs (of lower
  case in alphabets that have both, of digits in others), nor that of the serial
  correlation of the codes (each within LOOKS_RANDOM standard errors; chi-squared by
  its cube root, which is near normal).
* It must not look written: the p-value is that of the cells' counts under the
  alphabet's shares in written text, whose chi-squared is divided by SPREAD because
  words' letters come in clusters.  It falls with the length.  A run of digits only is a
  number, and what doesn't look random has p-value 1.
* All candidates of the corpus with the same encoding and length class are a family:
  Benjamini-Hochberg at RATE, with the share of true nulls estimated from the upper half
  of the p-values.  The families' p-values are counted in BINS bins by a grouped
  aggregation, so each family is a few rows whatever the corpus.

The rarer secrets are, the smaller a p-value must be: with one planted string an encoding and length among 10,000
identifiers, 3 of 6 were found at 20 characters, 5 of 6 at 32 and 6 of 6 at 40, and no identifier was reported.  The bins'
normal tail is exact; chi-squared's cube root stays an approximation.

So which random spans are reported depends on the whole corpus; base spans do not.  The
text is scanned twice, once for the counts and once for the result, both times in one
narrow pass of SQL expressions.  Start and end of a match follow from the lengths of the
pieces between matches, as running sums by chunks, since the SQL functions give matches
without their places; a text with very many matches costs in proportion.

Null and empty texts have no spans.  Places are code points, ends are exclusive.  Rows and
other columns stay as they are, repeated ones too; columns named like the results are
replaced; an empty table gives an empty table.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ledgerloom.llm.common import table

#: The base patterns by kind, in listing order (fixed values): pattern, least characters of group 2.  hex and access
#: are runs of one class, so their least length can stand in the pattern; a failing assign match uses up its text.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
CANDIDATE = r"[A-Za-z0-9+/_-]{20,}"
KINDS = ("assign", "access", "hex", "random")
#: Inferred encodings, the first that fits: what all characters match, the alphabet in code order, the characters whose
#: runs are counted, and the cells with their share in written text (letters by English frequencies, few digits and
#: capitals; hexadecimal: numbers with the odd letter).
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
_MIXED = (("aeiou", 0.32), ("nrstlhd", 0.36), ("bcfgjkmpqvwxyz", 0.17), ("AEIOUNRSTLHD", 0.05), ("BCFGJKMPQVWXYZ", 0.04))
ENCODINGS = (
    ("^[0-9]+$", _DIGITS, "0-4", ()),
    ("^[0-9A-F]+$", _DIGITS + _UPPER[:6], "0-9", (("01", 0.27), ("23", 0.17), ("45", 0.17), ("67", 0.17), ("89", 0.17), ("AB", 0.017), ("CD", 0.017), ("EF", 0.016))),
    ("^[A-Z2-7]+$", _UPPER + _DIGITS[2:8], "0-9", (("AEIOU", 0.37), ("NRSTLHD", 0.41), ("BCFGJKM", 0.115), ("PQVWXYZ", 0.075), ("234567", 0.03))),
    ("^[a-z0-9]+$", _LOWER + _DIGITS, "0-9", (("aeiou", 0.36), ("nrstlhd", 0.4), ("bcfgjkm", 0.11), ("pqvwxyz", 0.07), ("01234", 0.03), ("56789", 0.03))),
    ("^[A-Za-z0-9]+$", _UPPER + _LOWER + _DIGITS, "a-z", (*_MIXED, (_DIGITS, 0.06))),
    ("^[A-Za-z0-9+/]+$", _UPPER + _LOWER + _DIGITS + "+/", "a-z", (*_MIXED, (_DIGITS + "+/", 0.06))),
    ("^[A-Za-z0-9_-]+$", _UPPER + _LOWER + _DIGITS + "-_", "a-z", (*_MIXED, (_DIGITS + "-_", 0.06))),
    ("", _UPPER + _LOWER + _DIGITS + "-_+/", "a-z", (*_MIXED, (_DIGITS + "-_+/", 0.06))),
)
LOOKS_RANDOM, SPREAD, RATE = 3.5, 1.5, 0.05
#: Lengths from which the length classes after the first begin; z-values of the first bin, of the last one, and bins a unit.
CLASSES, LEAST_Z, MOST_Z, BINS = (28, 40, 64, 128), -4, 12, 4
_CHUNK = 256


def _let(value: Column, body) -> Column:
    """body(value), with the value computed once however often body uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _upto(sizes: Column) -> Column:
    """Running sums of an array of integers; chunks keep the cost in proportion to its length."""
    add = lambda acc, x: F.array_append(acc, F.element_at(acc, -1) + x)

    def joined(chunks):
        before = F.aggregate(F.transform(chunks, lambda c: F.aggregate(c, F.lit(0), lambda a, x: a + x)), F.array(F.lit(0)), add)
        return F.flatten(F.zip_with(chunks, F.slice(before, F.lit(1), F.size(chunks)), lambda c, b: F.slice(F.aggregate(c, F.array(b), add), 2, _CHUNK)))

    cut = lambda s: F.transform(F.sequence(F.lit(0), F.floor(F.size(s) / _CHUNK).cast("int")), lambda i: F.slice(s, i * _CHUNK + 1, _CHUNK))
    return _let(_let(sizes, cut), joined)


def _parts(text: Column, pattern: str, group: int, least: int) -> Column:
    """The pattern's matches with the gap before each, and whether the group has least characters; last the gap behind them."""
    p = F.lit(pattern)
    found = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("m"), F.regexp_extract_all(text, p, F.lit(group)).alias("v"))
    return F.transform(found, lambda x: F.struct(x["gap"].alias("gap"), x["m"].alias("m"), (F.coalesce(F.length(x["v"]), F.lit(-1)) >= least).alias("ok")))


def _found(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """Array of (start, end, token) of the pattern's matches whose group has least characters."""

    def placed(parts):
        ends = _upto(F.transform(parts, lambda x: F.length(x["gap"]) + F.coalesce(F.length(x["m"]), F.lit(0))))
        spans = F.zip_with(parts, ends, lambda x, e: F.when(x["ok"], F.struct((e - F.length(x["m"])).alias("start"), e.alias("end"), x["m"].alias("token"))))
        return F.filter(spans, lambda x: x.isNotNull())

    return F.when(text.rlike(pattern), _let(_parts(text, pattern, group, least), placed)).otherwise(F.array().cast("array<struct<start:int,end:int,token:string>>"))


def _blanked(text: Column, pattern: str, group: int = 0, least: int = 0) -> Column:
    """text with blanks in place of the matches that _found() gives."""
    kept = F.transform(_parts(text, pattern, group, least), lambda x: F.concat(x["gap"], F.coalesce(F.when(x["ok"], F.repeat(F.lit(" "), F.length(x["m"]))).otherwise(x["m"]), F.lit(""))))
    return F.array_join(kept, "")


def upper_tail(b: Column) -> Column:
    """The normal distribution's share from a bin's lower edge on, exact in the tail as well: one constant a bin."""
    edges = range(LEAST_Z * BINS, MOST_Z * BINS + 1)
    return F.element_at(F.array(*[F.lit(math.erfc(e / BINS / math.sqrt(2)) / 2) for e in edges]), (b - edges[0] + 1).cast("int"))


def _by_encoding(which: Column, make) -> Column:
    """make(encoding) for the encoding of each number."""
    out = make(ENCODINGS[-1])
    for i in reversed(range(len(ENCODINGS) - 1)):
        out = F.when(which == i, make(ENCODINGS[i])).otherwise(out)
    return out


def _chi(token: Column, n: Column, cells: tuple, shares: list[float]) -> Column:
    """Chi-squared of the cells' counts against shares."""
    out = F.lit(0.0)
    for (chars, _), share in zip(cells, shares, strict=True):
        count = n - F.length(F.translate(token, chars, ""))
        out = out + F.pow(count - n * share, 2) / (n * share)
    return out


def _cube(chi: Column, df: int) -> Column:
    return (F.pow(chi / df, 1 / 3) - (1 - 2 / (9 * df))) / (2 / (9 * df)) ** 0.5


def _z_uniform(x: Column, e: tuple) -> Column:
    _, alphabet, _, cells = e
    return _cube(_chi(x["token"], x["n"], cells, [len(c) / len(alphabet) for c, _ in cells]), len(cells) - 1) if cells else F.lit(99.0)


def _z_written(x: Column, e: tuple) -> Column:
    cells = e[3]
    return _cube(_chi(x["token"], x["n"], cells, [s for _, s in cells]) / SPREAD, len(cells) - 1) if cells else F.lit(float(LEAST_Z))


def _z_runs(x: Column, e: tuple) -> Column:
    """Of the number of runs of the encoding's class, given the class's count; 0 where there is no such run or nothing else."""
    inside, outside = f"[{e[2]}]+", f"[^{e[2]}]+"
    a = F.length(F.regexp_replace(x["token"], outside, "")).cast("double")
    n = x["n"]
    both = 2 * a * (n - a)
    runs = F.regexp_count(x["token"], F.lit(inside)) + F.regexp_count(x["token"], F.lit(outside))
    variance = both * (both - n) / (n * n * (n - 1))
    return F.when((both == 0) | (variance <= 0), F.lit(0.0)).otherwise((runs - 1 - both / n) / F.sqrt(variance))


def battery(candidates: Column) -> Column:
    """Candidates (start, end, token) as (start, end, family, bin): the number of their family, and their z-value's bin."""
    out = F.transform(candidates, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["token"].alias("token"), F.coalesce(*[F.when(x["token"].rlike(p), i) for i, (p, *_) in enumerate(ENCODINGS)]).alias("e"), F.length(x["token"]).cast("double").alias("n")))

    def codes(x):
        alphabet = _by_encoding(x["e"], lambda e: F.lit(e[1]))
        return F.transform(F.zip_with(F.split(x["token"], ""), F.array_repeat(alphabet, x["n"].cast("int")), lambda c, a: F.instr(a, c)), lambda i: i.cast("double"))

    out = F.transform(out, lambda x: x.withField("codes", codes(x)))
    out = F.transform(out, lambda x: x.withField("mean", F.aggregate(x["codes"], F.lit(0.0), lambda a, c: a + c) / x["n"]))
    # consecutive codes' products, and squares, of what is beyond the mean
    out = F.transform(
        out,
        lambda x: x.withField("square", F.aggregate(x["codes"], F.lit(0.0), lambda a, c: a + (c - x["mean"]) * (c - x["mean"]))).withField(
            "lagged", F.aggregate(F.zip_with(F.slice(x["codes"], 1, F.size(x["codes"]) - 1), F.slice(x["codes"], 2, F.size(x["codes"]) - 1), lambda a, b: (a - x["mean"]) * (b - x["mean"])), F.lit(0.0), lambda a, p: a + p)
        ),
    )
    serial = lambda x: F.when(x["square"] < 1e-6, F.lit(99.0)).otherwise((x["lagged"] / x["square"] + 1 / x["n"]) * F.sqrt(x["n"]))
    random = lambda x: (_by_encoding(x["e"], lambda e: _z_uniform(x, e)) <= LOOKS_RANDOM) & (F.abs(_by_encoding(x["e"], lambda e: _z_runs(x, e))) <= LOOKS_RANDOM) & (F.abs(serial(x)) <= LOOKS_RANDOM)
    z = lambda x: F.when(random(x), F.greatest(F.lit(float(LEAST_Z)), F.least(F.lit(float(MOST_Z)), _by_encoding(x["e"], lambda e: _z_written(x, e))))).otherwise(float(LEAST_Z))
    length = lambda x: sum((x["n"] >= c).cast("int") for c in CLASSES)
    return F.transform(out, lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), (x["e"] * 8 + length(x)).alias("family"), F.floor(z(x) * BINS).cast("int").alias("bin")))


def thresholds(tested: DataFrame, rate: float = RATE) -> dict[int, int]:
    """The least accepted bin of each family in the column tested, where there is one: at most one number an encoding and length class."""
    counts = tested.select(F.explode_outer("tested").alias("x")).groupBy("x.family", "x.bin").agg(F.count("*").alias("n"))
    whole = Window.partitionBy("family")
    p = upper_tail(F.col("bin"))
    counts = counts.where("family is not null")
    upper = F.sum(F.when(F.col("bin") < 0, F.col("n")).otherwise(0)).over(whole)
    counted = counts.withColumn("m", F.sum("n").over(whole)).withColumn("nulls", F.least(F.col("m"), 2 * (upper + 1))).withColumn("r", F.sum("n").over(whole.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0)))
    kept = counted.where((F.col("bin") > LEAST_Z * BINS) & (p * F.col("nulls") <= rate * F.col("r")))
    return {r.family: r.bin for r in kept.groupBy("family").agg(F.min("bin").alias("bin")).collect()}


def _tagged(spans: str, kind: int) -> Column:
    return F.transform(spans, lambda x: F.struct(x["start"].alias("start"), F.lit(kind).alias("kind"), x["end"].alias("end")))


def _spans(docs: DataFrame, text: str, own: list[Column]) -> DataFrame:
    """own with the base spans __a, __k and __h, and battery() of the candidates outside them as __t.

    Each step is a column of its own, as Spark would compute it for each of its uses otherwise.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(*own, t.alias("__x"), _found(t, ASSIGN, 2, ASSIGN_LEAST).alias("__a"), _found(t, ACCESS).alias("__k"), _found(t, HEX).alias("__h"))
    free = lambda base, *pattern: F.when(F.size(base) > 0, _blanked(F.col("__x"), *pattern)).otherwise(F.col("__x"))
    for base, *pattern in (("__a", ASSIGN, 2, ASSIGN_LEAST), ("__k", ACCESS), ("__h", HEX)):
        rows = rows.withColumn("__x", free(base, *pattern))
    rows = rows.withColumn("__c", _found(F.col("__x"), CANDIDATE)).drop("__x")
    return rows.withColumn("__t", F.when(F.size("__c") > 0, battery(F.col("__c")))).drop("__c")


def scan(docs: DataFrame, text: str = "text", rate: float = RATE) -> DataFrame:
    """docs with n_assign, n_access, n_hex, and found: all spans (start, kind, end), by start and kind."""
    names = ["n_assign", "n_access", "n_hex", "found"]
    least = thresholds(_spans(docs, text, []).select(F.col("__t").alias("tested")), rate)
    own = [F.col(c) for c in docs.columns if c not in names]
    rows = _spans(docs, text, own)
    accepted = F.array().cast("array<struct<start:int,end:int,family:int,bin:int>>")
    if least:
        bound = F.create_map(*[F.lit(v) for pair in least.items() for v in pair])
        accepted = F.coalesce(F.filter("__t", lambda x: F.coalesce(x["bin"] >= F.element_at(bound, x["family"]), F.lit(False))), accepted)
    rows = rows.withColumn("__r", accepted)
    tagged = [_tagged(c, k) for k, c in enumerate(("__a", "__k", "__h", "__r"))]
    return rows.select(*own, F.size("__a").cast("long").alias("n_assign"), F.size("__k").cast("long").alias("n_access"), F.size("__h").cast("long").alias("n_hex"), F.sort_array(F.concat(*tagged)).alias("found"))


def listed(found: Column) -> Column:
    """kind:start:end of each span, comma-joined."""
    name = lambda x: F.element_at(F.array(*map(F.lit, KINDS)), x["kind"] + 1)
    return F.array_join(F.transform(found, lambda x: F.concat_ws(":", name(x), x["start"].cast("string"), x["end"].cast("string"))), ",")


def op6_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("found", lambda x: x["kind"] < 3)
    return rows.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("found")).alias("spans"))

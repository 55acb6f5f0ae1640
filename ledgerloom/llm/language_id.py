"""Language identification by Bayesian evidence fusion.

Four kinds of evidence are combined as log-odds for each known language:

* the text, by a naive Bayes model over hashed byte trigrams, trained here on labelled
  documents: the mean log-likelihood of a trigram times an effective number of them, which
  grows with the text (neighbouring trigrams overlap) and is bounded by MOST, since more of the
  same text says no more about a page.  So a long text that speaks for no language clearly
  is decided by the rest of the evidence;
* the language that the markup declares, by P(declared | language);
* the address suffix, by P(suffix | language);
* the host, by a prior that is smoothed towards its domain's, and that towards the
  overall one.

The last three are learnt from the rows themselves: sums of the text posteriors by
declared language, suffix, host and domain, in grouped aggregations that are summed
within each task first.  A row's own posterior is taken out of all of them.  P(value |
language) is over the values seen and one more for unseen ones, and sums to 1.  Only
the table of declared codes (18,252 of two or three letters at most) and hosts with more than a thousandth
of all rows (so fewer than a thousand) are broadcast; other hosts are joined by a shuffle.

Labels and declarations are taken by their language code: capitals, regions and scripts are put
aside, three-letter codes become the two-letter ones where there are such (code_of()), others
stay as they are.  A label that is no code (a language's name, say) is not learnt from.  The model
has one column of BUCKETS numbers for each language that is labelled in the corpus.
Null or empty texts have no text evidence; a missing declaration, address or host gives
no evidence of that kind.  Rows are never dropped, repeated ones stay repeated; ties go
to the language first in order.  Without any labelled text the result's language is null.
An empty table gives an empty table.  Other columns are handed through by identify();
columns named like the results are replaced.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.llm.common import append, cut, joined, lean, table, texts

BUCKETS, TEMPER, MOST = 16_384, 0.3, 20.0
#: Pseudo-counts: of a trigram, of the overall prior in a domain's, of a domain's in a host's, of an evidence value.
TRIGRAM, TO_ALL, TO_DOMAIN, VALUE = 0.5, 10.0, 5.0, 0.5
HELD_OUT = "coalesce(crc32(cast(cast(doc_id as string) as binary)) % 3 = 1, false)"
#: Three-letter codes of languages that have a two-letter one (fixed values).
THREE_LETTERS = {
    "ar": "ara", "bg": "bul", "bn": "ben", "ca": "cat", "cs": "ces cze", "da": "dan", "de": "deu ger", "el": "ell gre", "en": "eng", "es": "spa", "et": "est", "eu": "eus baq", "fa": "fas per",
    "fi": "fin", "fr": "fra fre", "ga": "gle", "gl": "glg", "he": "heb", "hi": "hin", "hr": "hrv", "hu": "hun", "hy": "hye arm", "id": "ind", "is": "isl ice", "it": "ita", "ja": "jpn",
    "ka": "kat geo", "kk": "kaz", "ko": "kor", "la": "lat", "lt": "lit", "lv": "lav", "mk": "mkd mac", "ml": "mal", "mr": "mar", "ms": "msa may", "nb": "nob", "ne": "nep", "nl": "nld dut", "nn": "nno",
    "no": "nor", "pa": "pan", "pl": "pol", "pt": "por", "ro": "ron rum", "ru": "rus", "sk": "slk slo", "sl": "slv", "sq": "sqi alb", "sr": "srp", "sv": "swe", "sw": "swa", "ta": "tam", "te": "tel",
    "th": "tha", "tl": "tgl", "tr": "tur", "uk": "ukr", "ur": "urd", "uz": "uzb", "vi": "vie", "zh": "zho chi",
}
_MARKUP = re.compile(r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->|<[^>]*>")
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if c < 65 or 90 < c < 97 or 122 < c < 128 else c for c in range(256))


def trigrams(text: str) -> np.ndarray:
    """Hashed byte trigrams of the text's words (ASCII lower-cased, everything but letters as blanks)."""
    raw = b" " + b" ".join(text.encode("utf-8", "surrogatepass").translate(_LOWER).split()) + b" "
    b = np.frombuffer(raw, dtype=np.uint8).astype(np.uint32)
    return ((b[:-2] * 40503 + b[1:-1] * 10007 + b[2:] * 257) * 2654435761 >> 18 & (BUCKETS - 1)).astype(np.int64) if len(b) > 3 else np.zeros(0, np.int64)


def visible(markup: str) -> str:
    return _MARKUP.sub(" ", markup)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    log: np.ndarray  # buckets x languages

    def likelihood(self, text: str) -> np.ndarray:
        t = trigrams(text)
        return min(TEMPER * len(t), MOST) * self.log[t].mean(axis=0) if len(t) else np.zeros(len(self.languages))


def code_of(label: Column) -> Column:
    """A label's language: in small letters, without region or script, two letters where there are two; null if it is none."""
    bare = F.regexp_extract(F.lower(F.trim(label)), r"^([a-z]{2,3})(?:[-_].*)?$", 1)
    short = F.create_map(*[F.lit(w) for two, threes in THREE_LETTERS.items() for three in threes.split() for w in (three, two)])
    return F.when(bare != "", F.coalesce(F.try_element_at(short, bare), bare))


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> Model:
    """Trigram counts of every labelled document, by language; the driver gets BUCKETS numbers a language."""
    rows = docs.select(code_of(F.col(lang)).alias("lang"), F.col(text).alias("text")).where("lang is not null and text is not null")

    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for b in batches:
            for name, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                if name not in sums:
                    sums[name] = np.zeros(BUCKETS, dtype=np.int64)
                sums[name] += np.bincount(trigrams(x), minlength=BUCKETS)
        if sums:
            yield pa.RecordBatch.from_arrays([pa.array(list(sums)), pa.array(list(sums.values()), pa.list_(pa.int64()))], names=["lang", "n"])

    each = rows.mapInArrow(lean(count), "lang string, n array<long>").select("lang", F.posexplode("n").alias("at", "n")).where("n > 0")
    found = each.groupBy("lang", "at").agg(F.sum("n").alias("n")).toPandas()
    languages = tuple(sorted(found["lang"].unique()))
    n = np.zeros((BUCKETS, len(languages)))
    for k, name in enumerate(languages):
        own = found[found["lang"] == name]
        n[own["at"].to_numpy(), k] = own["n"].to_numpy()
    return Model(languages, np.log(n + TRIGRAM) - np.log((n + TRIGRAM).sum(axis=0)))


def host_of(url: Column) -> Column:
    h = F.lower(F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    return F.when(h != "", h)


def declared_in(markup: Column) -> Column:
    """The language code of the markup's lang attribute."""
    return code_of(F.regexp_extract(markup, r"""(?is)<html\b[^>]*?\blang\s*=\s*["']?\s*([a-z]{2,3})(?![a-z])""", 1))


def with_likelihood(rows: DataFrame, model: Model, text: str, markup: bool = False) -> DataFrame:
    def make():
        return lambda batch: [[model.likelihood(visible(x) if markup else x) for x in texts(batch, text)]]

    return append(rows, T.StructType([T.StructField("likelihood", T.ArrayType(T.DoubleType()))]), make)


def fuse(rows: DataFrame, languages: tuple[str, ...]) -> DataFrame:
    """Rows with likelihood, declared and host (each may be null) and their language and confidence."""
    k = range(len(languages))
    names = ["language", "confidence"]
    if not languages:
        return rows.drop("likelihood", *names).withColumn("language", F.lit(None).cast("string")).withColumn("confidence", F.lit(None).cast("double"))
    log_sum = lambda a: F.log(sum(F.exp(a[i] - F.array_max(a)) for i in k)) + F.array_max(a)
    rows = rows.withColumn("__p", F.transform("likelihood", lambda x: F.exp(x - log_sum(F.col("likelihood")))))
    parts = F.split("host", r"\.")
    rows = cut(rows.withColumn("__domain", F.array_join(F.slice(parts, F.greatest(F.lit(1), F.size(parts) - 1), 2), ".")).withColumn("__suffix", F.element_at(parts, -1)))
    added = lambda df, *by: df.groupBy(*by).agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("v")[i]) for i in k]).alias("v"))
    single = rows.withColumn("n", F.lit(1)).withColumn("v", F.col("__p"))

    def whole(df: DataFrame) -> tuple[int, list[float]]:
        """The number of rows of sums, and their total: K numbers."""
        r = df.agg(F.count(F.lit(1)).alias("c"), F.array(*[F.coalesce(F.sum(F.col("v")[i]), F.lit(0.0)) for i in k]).alias("v")).first()
        return r.c, r.v

    all_rows, overall = whole(single)
    codes = cut(added(single.where("declared is not null"), "declared"))
    hosts = cut(added(single.where("host is not null"), "host", "__domain", "__suffix"))
    suffixes = cut(added(hosts, "__suffix"))
    (n_codes, of_codes), (n_suffixes, of_suffixes) = whole(codes), whole(suffixes)
    side = hosts.withColumnRenamed("v", "__host").join(added(hosts, "__domain").select("__domain", F.col("v").alias("__of_domain")), "__domain").join(suffixes.select("__suffix", F.col("v").alias("__of_suffix")), "__suffix").select("host", "n", "__host", "__of_domain", "__of_suffix")
    nothing = F.lit(None).cast("array<double>")
    without = rows.where("host is null").withColumns({c: nothing for c in ("__host", "__of_domain", "__of_suffix")})
    rows = joined(rows.where("host is not null"), side, "host", all_rows).unionByName(without)
    # declared is a code of two or three letters: 18,252 rows at most
    rows = rows.join(F.broadcast(codes.select(F.col("declared").alias("__code"), F.col("v").alias("__of_code"))), F.col("declared") == F.col("__code"), "left")
    own = lambda i: F.col("__p")[i]
    others = lambda v, i: F.greatest(F.lit(0.0), v - own(i))
    many = lambda c: F.greatest(F.lit(0.0), sum(F.col(c)[i] for i in k) - 1)
    prior = lambda i: (others(F.lit(overall[i]), i) + 1) / (max(0, all_rows - 1) + len(languages))
    of_domain = lambda i: (others(F.col("__of_domain")[i], i) + TO_ALL * prior(i)) / (many("__of_domain") + TO_ALL)
    of_host = lambda i: (others(F.col("__host")[i], i) + TO_DOMAIN * of_domain(i)) / (many("__host") + TO_DOMAIN)
    value = lambda c, i, total, values: (others(F.col(c)[i], i) + VALUE) / (others(F.lit(total[i]), i) + VALUE * (values + 1))
    there = lambda c, x, other: F.when(F.col(c).isNotNull(), x).otherwise(other)
    evidence = lambda i: F.col("likelihood")[i] + F.log(there("__host", of_host(i), prior(i))) + there("__of_suffix", F.log(value("__of_suffix", i, of_suffixes, n_suffixes)), 0.0) + there("__of_code", F.log(value("__of_code", i, of_codes, n_codes)), 0.0)
    rows = rows.withColumn("__log", F.array(*[evidence(i) for i in k]))
    best = F.array_max("__log")
    out = rows.withColumn("language", F.element_at(F.array(*map(F.lit, languages)), F.array_position("__log", best).cast("int"))).withColumn("confidence", F.exp(best - log_sum(F.col("__log"))))
    return out.drop("likelihood", *[c for c in out.columns if c.startswith("__")])


def identify(rows: DataFrame, model: Model, text: str | None = "text", markup: str | None = None, url: str | None = None, host: str | None = None) -> DataFrame:
    """rows with language and confidence, from a text or markup column, and an address or host column."""
    column = markup or text
    out = rows.drop("likelihood", "declared", "host", "language", "confidence") if host != "host" else rows.drop("likelihood", "declared", "language", "confidence")
    out = out.withColumn("declared", declared_in(F.col(markup)) if markup else F.lit(None).cast("string"))
    if url or host != "host":
        out = out.withColumn("host", host_of(F.col(url)) if url else F.col(host).cast("string") if host else F.lit(None).cast("string"))
    return fuse(with_likelihood(out, model, column, markup is not None).drop(column), model.languages)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page (its markup, address and host) and every document (its text; the source as host).

    The text model learns from the documents that aren't held out.
    """
    docs = table(spark, sf_dir, "documents")
    model = train(docs.where(f"not {HELD_OUT}"))
    pages = identify(table(spark, sf_dir, "pages").select("page_id", "url", "html"), model, None, "html", "url")
    own = identify(docs.select("doc_id", "text", "source"), model, host="source")
    one = lambda df, kind, doc, page: df.select(F.lit(kind).alias("kind"), doc.alias("doc_id"), page.alias("page_id"), "host", "declared", "language", "confidence")
    none = F.lit(None).cast("long")
    return one(own, "document", F.col("doc_id"), none).unionByName(one(pages, "page", none, F.col("page_id")))

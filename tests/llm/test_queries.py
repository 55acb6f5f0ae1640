"""The registered queries' columns, their SQL, and the pipeline's stages."""

from __future__ import annotations

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_operators import brute_components, direct_scores

import corpus_pipeline
from ledgerloom.llm import queries, simhash, token_counts
from ledgerloom.llm.common import table

COLUMNS = {
    "op1_token_counts": {"doc_id", "n_bytes", "n_tokens", "over_limit"},
    "op3_decontaminate": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"},
    "op4_mixing": {"doc_id", "size", "source_size", "target", "taken"},
    "op5_quality": {"doc_id", "held_out", "score", "predicted"},
    "op6_secrets": {"doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"},
    "op7_simhash": {"doc_id", "fingerprint", "component_id"},
    "op8_fingerprints": {"doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"},
    "op9_binary_output": {"doc_id", "start", "n_tokens", "ids_crc32"},
    "op12_ngram_join": {"doc_id", "n_shingles", "component_id"},
}


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns_and_rows(spark, data, name):
    df = queries.QUERIES[name](spark, data)
    assert set(df.columns) >= COLUMNS[name] and df.count() == table(spark, data, "documents").count()


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, duck, data, name):
    df, want = queries.QUERIES[name](spark, data), duck.sql(queries.ORACLE_SQL[name])
    columns = sorted(df.columns)
    plain = lambda v: float(f"{v:.9g}") if isinstance(v, float) else v
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    assert sorted(want.columns) == columns
    assert got == sorted((tuple(plain(r[want.columns.index(c)]) for c in columns) for r in want.fetchall()), key=repr)


def brute_contaminated(text, items):
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    windows = {tuple(w[i : i + 10]) for w in map(split, items) if w for i in range(max(1, len(w) - 9))}
    own = split(text)
    return any(tuple(own[j : j + n]) in windows for n in {len(w) for w in windows} for j in range(len(own) - n + 1))


def test_pipeline_against_brute_force(spark, data):
    """Each stage's rows from its own input; with nulls, empty texts, repeated rows and columns that operators use for results."""
    docs = table(spark, data, "documents")
    odd = spark.createDataFrame([(None, "no id " * 30, None), (10**6, None, "src0"), (10**6 + 1, "", "src1")], "doc_id long, text string, source string")
    docs = docs.unionByName(odd, allowMissingColumns=True).union(docs.where("doc_id < 5"))
    docs = docs.withColumn("n_words", F.concat(F.lit("own "), "doc_id")).withColumn("shard", F.lit("kept")).withColumn("score", F.lit(True))
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda rows: sorted((r.doc_id for r in rows), key=str)
    rows = docs.collect()
    good = stages["quality"](spark, docs, data)
    got = good.collect()
    assert good.columns == docs.columns
    assert ids(got) == ids(r for r, s in zip(rows, direct_scores(rows, table(spark, data, "labels").collect())) if s >= 0.5)
    one, rows = stages["near_dedup"](spark, good, data), got
    got = one.collect()
    label = brute_components([simhash.fingerprint(r.text or "") for r in rows])
    first = {}
    for r, c in sorted(zip(rows, label), key=lambda x: (x[0].doc_id is None, x[0].doc_id or 0)):
        first.setdefault(c, r.doc_id)
    assert one.columns == docs.columns and ids(got) == sorted(first.values(), key=str)
    clean, rows = stages["decontaminate"](spark, one, data), got
    got = clean.collect()
    items = [r.text for r in table(spark, data, "benchmark").collect()]
    assert clean.columns == docs.columns and ids(got) == ids(r for r in rows if not brute_contaminated(r.text, items))
    assert all(r.shard == "kept" and r.score is True and (r.doc_id is None or r.n_words == f"own {r.doc_id}") for r in got)
    mixed, rows = stages["mix"](spark, clean, data), got
    got = mixed.collect()
    words = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))
    size, taken, times = Counter(), Counter(), Counter(r.doc_id for r in got)
    for r in rows:
        size[r.source] += words(r)
    for r in got:
        taken[r.source] += words(r)
    order = sorted(size, key=lambda s: (s is None, s or ""))
    open_, left, target = {s: (1, 2, 3)[i % 3] for i, s in enumerate(order)}, float(sum(size.values())), {}
    while over := [s for s in open_ if left / sum(open_.values()) * open_[s] >= 3 * size[s]]:
        for s in over:
            target[s] = 3.0 * size[s]
            left -= target[s]
            del open_[s]
    target |= {s: left / sum(open_.values()) * w for s, w in open_.items()}
    largest = max(map(words, rows))
    assert mixed.columns == docs.columns and max(times.values()) <= 4
    assert all(-1e-6 <= target[s] - taken[s] < largest for s in order)  # what is left has room for no further document
    assert {tuple(r) for r in got} <= {tuple(r) for r in rows}
    out = sorted(stages["token_output"](spark, mixed, data).collect(), key=lambda r: r.start)
    tok = token_counts.tokenizer("byte_bpe_50k.json")
    start, want = 0, Counter()
    for r in got:
        own = tok.encode(r.text or "", add_special_tokens=False).ids + [2]
        want[r.doc_id, len(own), zlib.crc32(np.array(own, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in out) == want
    for r in out:
        assert r.start == start
        start += r.n_tokens
    assert [r.doc_id for r in out if r.doc_id is not None] == sorted(r.doc_id for r in out if r.doc_id is not None)


def test_pipeline_of_an_empty_table(spark, data):
    docs = table(spark, data, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, data)
        assert docs.count() == 0

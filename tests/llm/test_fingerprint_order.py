"""Fingerprints don't depend on the paragraphs' order, and equal texts have equal ones however they were made."""

from __future__ import annotations

import random

import pytest

from ledgerloom.llm import fingerprints
from ledgerloom.llm.common import table

F = fingerprints.Fingerprint


def same(a, b):
    return a.base64() == b.base64()


def test_random_texts_equal_their_reorderings():
    r = random.Random(12)
    word = lambda: "".join(r.choice("aeiourstln é中.") for _ in range(r.choice([1, 1, 2, 3, 5, 9, 40])))
    for _ in range(2000):
        lines = [" ".join(word() for _ in range(r.randint(0, 9))) for _ in range(r.randint(2, 5))]
        assert same(F.of("\n".join(lines)), F.of("\n".join(r.sample(lines, len(lines)))))
    assert same(F.of("I am here and there with some more words today\nfoo bar baz"), F.of("foo bar baz\nI am here and there with some more words today"))


def test_documents_equal_their_reversed_lines(spark):
    for (text,) in table(spark, "/root/testdata/sf0.01", "documents").select("text").collect():
        lines = (text or "").split("\n")
        assert same(F.of("\n".join(lines)), F.of("\n".join(lines[::-1])))


def test_edited_fingerprint_is_that_of_the_edited_text(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text or "" for r in docs.collect()}
    order = sorted(texts)
    following = dict(zip(order, [*order[1:], order[0]]))
    got = fingerprints.edits(docs).collect()
    assert len(got) == len(texts)
    for r in got:
        assert r.fingerprint == F.of(texts[r.doc_id]).base64()
        assert r.edited_fingerprint == F.of(fingerprints.edited_text(texts[r.doc_id], texts[following[r.doc_id]])).base64()


def test_deleting_what_is_not_held_is_refused():
    a = F.of("one two\nthree")
    with pytest.raises(ValueError):
        a.delete(["four five"])
    with pytest.raises(ValueError):
        F.from_base64(a.base64()).delete(["three"])
    a.delete(["three"])
    assert same(a, F.of("one two"))

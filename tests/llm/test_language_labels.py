"""No label is dropped for its spelling."""

from __future__ import annotations

from pyspark.sql import functions as F

from ledgerloom.llm import language_id


def test_labels_in_any_spelling_are_learnt_from(spark):
    cases = {"en": "en", "EN": "en", " en ": "en", "eng": "en", "pt-BR": "pt", "pt_BR": "pt", "POR": "pt", "zh-cn": "zh", "zh-Hans-CN": "zh", "fre": "fr", "gsw": "gsw", "": None, "english": None, "12": None, None: None}
    df = spark.createDataFrame([(k, v, f"words of {k}") for k, v in cases.items()], "lang string, want string, text string")
    assert all(r.got == r.want for r in df.withColumn("got", language_id.code_of(F.col("lang"))).collect())
    assert set(language_id.train(df).languages) == {v for v in cases.values() if v}
    mixed = spark.createDataFrame([("EN", "the house and the garden"), ("pt-BR", "a casa e o jardim")], "lang string, text string")
    plain = spark.createDataFrame([("en", "the house and the garden"), ("pt", "a casa e o jardim")], "lang string, text string")
    a, b = language_id.train(mixed), language_id.train(plain)
    assert a.languages == b.languages and (a.log == b.log).all()


def test_declared_languages(spark):
    pages = {'<html lang="pt-BR">': "pt", "<HTML class=x LANG=eng>": "en", "<html lang='EN'>": "en", "<html>": None, '<html lang="english">': None}
    df = spark.createDataFrame([(k, v) for k, v in pages.items()], "html string, want string")
    assert all(r.got == r.want for r in df.withColumn("got", language_id.declared_in(F.col("html"))).collect())

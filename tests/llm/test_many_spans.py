"""Texts with very many matches, and conversations with very many turns: time grows about in proportion."""

import re
import time

import pytest
from pyspark.sql import functions as F

from orbweave.llm import chat_format, common, secret_scan


def test_sums_and_maxima_before_each(spark):
    rows = [(list(range(n, 0, -1)),) for n in (0, 1, 2, 3, 10, 101)]
    df = spark.createDataFrame(rows, "x array<bigint>")
    out = df.select("x", common.before_each(F.col("x"), lambda a, b: a + b).alias("s"), common.before_each(F.col("x"), lambda a, b: F.greatest(a, b)).alias("m")).collect()
    for r in out:
        assert r.s == [sum(r.x[:i]) for i in range(len(r.x))] and r.m == [max(r.x[:i], default=0) for i in range(len(r.x))]


def test_spans_across_blocks(spark):
    text = "aé😀\n" * 3_000
    cuts = [(0, 0), (0, 5), (4_095, 4_097), (4_096, 4_096), (10, 12_000), (8_192, 12_000), (11_999, 12_000), (12_000, 12_000)]
    df = spark.createDataFrame([(text, a, b) for a, b in cuts], "t string, a bigint, b bigint")
    got = df.select(common.span_of(common.blocks_of(F.col("t")), F.col("a"), F.col("b"))).collect()
    assert [r[0] for r in got] == [text[a:b] for a, b in cuts]


@pytest.mark.parametrize("n", [50_000])
def test_very_many_secrets(spark, n):
    text = "".join(f"token=abcdef{k:06} é " for k in range(n))
    df = spark.createDataFrame([(1, text), (2, "none")], "doc_id long, text string")
    secret_scan.find_secrets(df.where("doc_id = 2")).collect()
    began = time.perf_counter()
    found = secret_scan.find_secrets(df)
    row = found.select("doc_id", "spans", secret_scan.redact(F.col("text"), F.col("spans")).alias("clean")).where("doc_id = 1").first()
    assert time.perf_counter() - began < 20
    assert [(s.start, s.end) for s in row.spans] == [m.span() for m in re.finditer(r"token=\w{6}\d{6}", text)]
    assert row.clean == "[assign] é " * n


def test_null_and_repeated_ids_spread(spark):
    df = spark.createDataFrame([(None, f"token=abcdef{k}") for k in range(100)], "doc_id long, text string")
    keys = secret_scan.postings(df, "doc_id", "text", ["tok"]).select("doc").distinct().count()
    assert keys == 100 and secret_scan.find_secrets(df).where(F.size("spans") == 1).count() == 100


def test_very_many_turns(spark):
    n = 20_000
    df = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 2 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text < "), F.col("id").cast("string")).alias("text"))
    began = time.perf_counter()
    row = chat_format.digest(chat_format.format_conversations(df)).first()
    assert time.perf_counter() - began < 20
    assert row.n_turns == n and row.loss_chars == sum(len(f"text < {k}") for k in range(1, n, 2))


def test_patterns_are_read():
    """What each pattern demands, written out; what isn't understood demands nothing, so that its texts are scanned fully."""
    grams = lambda *sets: frozenset(frozenset(s.split()) for s in sets)
    for pattern, expected in {
        "abc|defg": (grams("abc", "def efg"),),
        "a{2}bc": (grams("aab abc"),),
        r"(?i)(?:KEY|pass)\x20*[:=]": (grams("key", "pas ass"),),
        r"x*abc[0-9]+?[^a]def$": (grams("abc"), grams("def")),
        r"\bfoo\.bar": (grams("foo oo. o.b .ba bar"),),
        r"[ab]cd?e": (grams("ace", "bce", "acd cde", "bcd cde"),),
        r"[a\]]bcd": (grams("abc bcd", "]bc bcd"),),
        "(?=abc)": (), "(abc": (), "*abc": (), r"\pLabc": (), "ab": (), "": (),
    }.items():
        assert secret_scan.trigram_query(pattern) == expected, pattern

"""Expressions: severity, clocks, hashes, masks."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tidelog.functions import hashing, masking, severity, times
from tidelog.sources import lines


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize(
    "token,kind",
    [
        ("42", "<NUM>"), ("-3.5", "<NUM>"), ("120ms", "<NUM>"), ("1.5KB", "<NUM>"), (".5", "<NUM>"), ("+", ""), ("1.2.3", "<VAR>"),
        ("550e8400-e29b-41d4-a716-446655440000", "<UUID>"), ("{550e8400-e29b-41d4-a716-446655440000}", "<UUID>"), ("deadbeef", "<HEX>"), ("0xDEADBEEF", "<HEX>"), ("face", ""),
        ("12345678901234567890123456789012", "<HEX>"), ("123456789", "<NUM>"), ("10.0.0.1", "<IP>"), ("10.0.0.1:8080", "<IP>"), ("10.0.0.256", "<VAR>"), ("2024-01-02T03:04:05Z", "<TIME>"),
        ("12:30:45", "<TIME>"), ("12:30:45.123", "<TIME>"), ("12:30", "<VAR>"), ("/var/log", "<PATH>"), ("/", ""), ("./x", "<PATH>"), ("../", "<PATH>"), ('"q"', "<STR>"), ("'q'", "<STR>"), ('"', ""),
        ("u4567", "<VAR>"), ("req-42", "<VAR>"), ("plain", ""), ("", ""), ("abcdefab-abcd-abcd-abcd-abcdefabcdef", "<UUID>"),
    ],
)
def test_token_class(spark, token, kind):
    assert masking.classify(token) == kind
    assert one(spark, masking.classify_expr(F.lit(token))) == kind


@pytest.mark.parametrize(
    "line,masked",
    [
        ("user 42 logged in from 10.0.0.1", "user <NUM> logged in from <IP>"),
        ("[api] request failed", "<COMP> request failed"),
        ("[ERROR] request failed", "[ERROR] request failed"),
        ("a b [api] c", "a b [api] c"),
        ("id=42, user=bob", "id=<NUM>, user=bob"),
        ("k1=42 =x y= a=b=3", "<VAR> =x y= a=<VAR>"),
        ("1608 bytes (1.57 KB) sent", "<NUM> sent"),
        ("0 bytes sent", "<NUM> sent"),
        ("the bytes sent", "the bytes sent"),
        ("lifetime 00:01 sec", "lifetime <VAR>"),
        ("done. ... (pam_unix) ok", "done. ... (pam_unix) ok"),
        ("call () and (a b c d e 5)", "call () and (a b c d e <NUM>)"),
        ("", ""),
    ],
)
def test_mask_line(line, masked):
    tokens, raw = masking.mask_line(line)
    assert " ".join(tokens) == masked and len(tokens) == len(raw)


def test_masked_text_equals_mask_line(spark):
    r = random.Random(1)
    words = ["a", "id=4", "x=y,", "done.", "10.0.0.1:8", "5ms;", "/p/q", '"s"', "1:2:3", "deadbeef01", "é=5", "...", "k=", "=v", "cafe", "(7", "z]"]
    texts = [" ".join(["first", "second", *(r.choice(words) for _ in range(6))]) for _ in range(80)]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", masking.masked_text(F.col("t")).alias("m")).collect()
    assert all(x.m == " ".join(masking._one(w, False)[0] for w in x.t.split()) for x in rows)


def test_params():
    tokens, raw = masking.mask_line("order 7 took 3ms.")
    assert [r for t, r in zip(tokens, raw) if masking.is_placeholder(t)] == ["7", "3ms"]


@pytest.mark.parametrize("body,want", [("took 120ms", [120.0]), ("size=4096 (code 05)", [4096.0, 5.0]), ("at 12:30:45 /a/1 id9", []), ("x=-2.5%, 1_000 .5 a=b=7", [-2.5, 7.0]), ("- -x 1e3", [1000.0]), ("", [])])
def test_numbers(spark, body, want):
    assert masking.numbers(body) == want
    assert one(spark, masking.numbers_expr(F.lit(body))) == want


def test_pinned_hash(spark):
    text = "user <NUM> logged in from <IP>"
    assert hashing.shape_hash_of(text) & (2**64 - 1) == 0xEBD9C098A3D903F0
    for t in (text, "", "é", "x" * 300):
        assert one(spark, hashing.shape_hash(F.lit(t))) == hashing.shape_hash_of(t)
    assert str(one(spark, hashing.unsigned(F.lit(hashing.shape_hash_of(text))))) == str(0xEBD9C098A3D903F0)
    rows = hashing.with_shape_hash(spark.createDataFrame([(text,), (None,)], "t string"), "t").collect()
    assert [r.template_id for r in rows] == [hashing.shape_hash_of(text), None]


def test_sample_edges(spark):
    ids = spark.range(3000).select(F.unhex(F.lpad(F.hex(F.xxhash64("id")), 32, "0")).alias("event_id"))
    share = ids.agg(F.avg(hashing.selected(F.col("event_id"), 30).cast("int")).alias("s")).first().s
    assert 0.26 < share < 0.34
    assert one(spark, hashing.selected(F.lit(b"x" * 16), 100)) and not one(spark, hashing.selected(F.lit(b"x" * 16), 0))
    assert one(spark, hashing.transaction_kept(F.lit("a"), 1.0)) and not one(spark, hashing.transaction_kept(F.lit("a"), 0.0))


def test_severity(spark):
    assert [one(spark, severity.from_text(F.lit(w))) for w in (" WARN ", "notice", "severe", "emergency", "verbose", "loud")] == [13, 9, 17, 21, 1, None]
    assert severity.names_from(13) == ["warn_plus"] and severity.names_from(9) == ["info", "warn_plus"] and severity.names_from(0) == ["debug", "info", "warn_plus"]
    severity.check_buckets(severity.DEFAULT_BUCKETS)
    for bad in ((severity.Bucket("a", 1, 1),), (severity.Bucket("a", 0, 1), severity.Bucket("a", 5, 1)), (severity.Bucket("a", 0, 1), severity.Bucket("b", 0, 1)), (severity.Bucket("a", 0, 0),)):
        with pytest.raises(ValueError):
            severity.check_buckets(bad)


@pytest.mark.parametrize("text", ["2024-01-02T03:04:05Z", "2024-01-02T03:04:05.100Z", "1678-01-01T00:00:00Z", "2261-12-31T23:59:59.999999999Z", "1969-12-31T23:59:59.000001Z", "2024-02-29T00:00:00Z"])
def test_canonical_times(spark, text):
    ns = one(spark, times.canonical_ns(F.lit(text)))
    assert ns is not None and one(spark, times.format_canonical(F.lit(ns).cast("long"))) == text


@pytest.mark.parametrize("text", ["2024-01-02T03:04:05.100000Z", "2023-02-29T00:00:00Z", "2024-01-02 03:04:05Z", "2024-01-02T24:00:00Z", "2024-01-02T03:04:60Z", "1677-01-01T00:00:00Z", "2262-01-01T00:00:00Z", "2024-01-02T03:04:05.000Z", "x"])
def test_refused_times(spark, text):
    assert one(spark, times.canonical_ns(F.lit(text))) is None


def test_hours(spark):
    assert one(spark, times.parse_hour(F.lit("1970-01-02T01"))) == 25
    assert one(spark, times.parse_hour(F.lit("2024-02-31T00"))) is not None
    assert [one(spark, times.parse_hour(F.lit(t))) for t in ("2024-13-01T00", "2024-01-32T00", "2024-01-01T24", "x")] == [None] * 4
    ns = 1_704_067_199_999_999_999
    assert one(spark, times.format_hour(F.lit(ns))) == "2023-12-31T23" and one(spark, times.format_hour(F.lit(ns + 1))) == "2024-01-01T00"


def test_query_pairs(spark):
    got = one(spark, lines.query_pairs(F.lit("a=1+2&b=%2Fx%&&c&=d")))
    assert [tuple(p) for p in got] == [("a", "1 2"), ("b", "/x%"), ("c", ""), ("", "d")]


@pytest.mark.parametrize("glob,name,hit", [("*.log", "a.log", True), ("*.log", "a/b.log", False), ("a?.l[no]g", "ab.log", True), ("[!a]*", "abc", False), ("a.b", "axb", False)])
def test_globs(spark, glob, name, hit):
    assert one(spark, F.lit(name).rlike(lines.glob_pattern(glob))) == hit

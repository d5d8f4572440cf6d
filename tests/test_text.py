from __future__ import annotations

import unicodedata

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from linkloom.functions import prompts, render, text, times


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column).first()[0]


@pytest.mark.parametrize(
    ("content", "expected"),
    [
        ("TITLE: Hello World\nBody", "Hello World"),
        ("Hello World\nBody", "Hello World"),
        ("Title:   \nBody", "https://u"),
        ("", "https://u"),
        (None, "https://u"),
        ("\nBody", "https://u"),
        ("   \nBody", "   "),
        ("x" * 150, "x" * 100),
        ("  padded \nBody", "  padded "),
    ],
)
def test_title_from_content(spark, content, expected):
    assert one(spark, text.title_from_content(F.col("c"), F.col("f")), c=content, f="https://u") == expected


def test_title_without_fallback_keeps_the_line(spark):
    assert one(spark, text.title_from_content(F.col("c"), F.col("f")), c="title: \nx", f="") == "title: "


@pytest.mark.parametrize(
    ("title", "expected"),
    [
        ("", True),
        (" \t ", True),
        (None, True),
        ("https://a.b/c", True),
        (" http://a ", True),
        ("http://a b", False),
        ("HTTP://a", False),
        ("see https://a", False),
        ("https://", True),
    ],
)
def test_url_only_title(spark, title, expected):
    assert one(spark, text.is_url_only_title(F.col("t")), t=title) is expected


def cut(value: str, n: int) -> str:
    return value.encode()[:n].decode("utf-8", "ignore")


def test_byte_cap_never_splits_a_character(spark):
    texts = ["plain text", "aé€😀" * 4, "😀" * 5, "€�€", "", "ééé", "��"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in range(1, 18):
        got = [r[0] for r in rows.select(text.byte_cap(F.col("t"), n)).collect()]
        assert got == [cut(t, n) for t in texts], n


def test_snippet_limits(spark):
    for size in (99, 100, 101):
        value = "a" * (size - 2) + "é"
        assert one(spark, text.snippet(F.col("c"), 100), c=value) == (value if size <= 100 else cut(value, 100) + "...")
        expected = value if size <= 100 else cut(value, 97) + "..."
        assert one(spark, render.cli_summary(F.col("c")), c=value) == expected


def test_sanitize_line(spark):
    assert one(spark, text.sanitize_line(F.col("c")), c=" a\r\n  b\tc \n") == "a b\tc"


def test_labels_and_description(spark):
    assert one(spark, render.display_title(F.col("s"), F.col("t")), s="x", t="a\nb") == "[X] a b"
    assert one(spark, render.source_label(F.col("s")), s="other") == "[?]"
    assert one(spark, render.display_description(F.col("s"), F.col("u")), s="", u="https://u") == "https://u"
    long = one(spark, render.display_description(F.col("s"), F.col("u")), s="y" * 81, u="")
    assert long == "y" * 80 + "..."


def test_parse_response(spark):
    body = "SUMMARY: one\n  SUMMARY: two \nmore\nKEYWORDS: a, b\nkeywords: no"
    got = one(spark, prompts.parse_response(F.col("r")), r=body)
    assert (got.summary, got.keywords, got.raw_response) == ("two", "a, b", body)
    blank = one(spark, prompts.parse_response(F.col("r")), r="SUMMARY: one\nSUMMARY:")
    assert (blank.summary, blank.keywords) == ("", "")


def test_prompt_needs_one_place(spark):
    assert one(spark, prompts.render_prompt(F.col("c"), "<%s>"), c="x") == "<x>"
    with pytest.raises(ValueError):
        prompts.render_prompt(F.col("c"), "no place")


@pytest.mark.parametrize(
    ("value", "expected"),
    [
        ("2024-01-02T03:04:05Z", "2024-01-02T03:04:05Z"),
        ("2024-01-02T03:04:05.123456789+02:00", "2024-01-02T01:04:05Z"),
        ("2024-01-02T03:04:05.5-01:30", "2024-01-02T04:34:05Z"),
        ("2024-01-02", None),
        ("", None),
        (None, None),
    ],
)
def test_rfc3339(spark, value, expected):
    assert one(spark, times.format_rfc3339(times.parse_rfc3339(F.col("c"))), c=value) == expected


def test_x_time(spark):
    assert one(spark, times.format_rfc3339(times.parse_x_time(F.col("c"))), c="Wed Oct 10 20:19:24 +0200 2018") == "2018-10-10T18:19:24Z"
    assert one(spark, times.parse_x_time(F.col("c")), c="2018-10-10") is None


def test_accent_table_is_built_by_the_rule():
    src, dst = text.accent_table()
    table = dict(zip(src, dst))
    assert table["é"] == "e" and table["č"] == "c" and "ß" not in table and "ø" not in table
    assert all(unicodedata.normalize("NFD", s)[0] == d for s, d in table.items())


@settings(max_examples=40, deadline=None)
@given(st.lists(st.text(alphabet="aé Öß.-_1९中é \nİ", max_size=30), min_size=1, max_size=20))
def test_tokens_agree_with_the_driver_tokenizer(spark, values):
    rows = spark.createDataFrame([(v,) for v in values], "t string").select(text.token_text(F.col("t")).alias("t"))
    rows = rows.select("t", text.token_count(F.col("t")).alias("n"), text.prefix_count(F.col("t"), "e").alias("e"))
    for value, row in zip(values, rows.collect()):
        tokens = text.query_tokens(value)
        assert row.t == " ".join(tokens)
        assert row.n == len(tokens)
        assert row.e == sum(t.startswith("e") for t in tokens)

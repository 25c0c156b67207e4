"""Literal cases of the scalar expressions and searches."""

import pytest
from pyspark.sql import functions as F

from shellac import functions as fn
from shellac.operators import search


def column(spark, values, f):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in rows.select("i", f(F.col("v")).alias("x")).orderBy("i").collect()]


def test_blank_and_years(spark):
    assert column(spark, [" a ", " ﻿", "", None, " x"], fn.null_if_blank) == ["a", None, None, None, "x"]
    assert column(spark, ["1968", "c.1968", "196?", "1849", "2101", "19685", None], fn.year_sort) == [1968, 1968, None, None, None, 1968, None]
    assert column(spark, ["A  B ", None], fn.norm_key) == ["a b", ""]


def test_release_base(spark):
    got = column(spark, ["GRED 266-A", "GRED 266-B2", "GRED 2660", "ABCD", "1A", "12A", "X-A", None, " gred 266 - a "], fn.release_base)
    assert got == ["GRED 266", "GRED 266", None, None, None, "12", None, None, "gred 266"]
    assert column(spark, ["GRED 266-A", "GRED 266-B2", "GRED 2660"], fn.side_marker_number) == [0, 2, None]
    assert [tuple(x) for x in column(spark, ["GRED 266-A", "GRED 266-B2", "LETTERD", "x1", None], fn.side_rank)] == [("A", 0), ("B", 2), ("D", 0), ("Z", 999), ("Z", 999)]


def test_prefix_credit_and_terms(spark):
    rows = spark.createDataFrame([("DSR 1234 A", "dsr 1234"), ("abc", "xyz"), ("", "a"), (None, "a"), ("same", "SAME")], "a string, b string")
    assert [r[0] for r in rows.select(fn.shared_prefix("a", "b")).collect()] == ["DSR 1234", "", "", "", "same"]
    rows = spark.createDataFrame([("Bob  Marley", "bob marley"), ("Bob & X", "Bob"), (None, "a"), ("", "a")], "a string, b string")
    assert [r[0] for r in rows.select(fn.credit_if_different("a", "b")).collect()] == [None, "Bob & X", None, None]
    assert column(spark, ["Will-Power!", "GP 1660-1", "é x"], fn.substring_term) == ["will power", "gp 1660-1", "x"]
    assert column(spark, [' "will*  power" ', '"*', " ".join("abcdefghijklmn")], fn.phrase_term) == ["will power", None, " ".join("abcdefghijkl")]
    assert column(spark, ["Dubious Entry ", None, "x"], fn.is_uncertain) == [True, False, False]
    assert column(spark, ["yes, It is", "", None], fn.version_label) == ["Yes, It is", "", None]


def test_traffic_expressions(spark):
    assert column(spark, ["Mozilla Googlebot/2.1", "curl", None], fn.is_search_engine) == [True, False, False]
    rows = spark.createDataFrame([(" 1.2.3.4 , 5.6.7.8", "9"), (None, "9"), ("", " "), (None, None)], "f string, r string")
    assert [r[0] for r in rows.select(fn.client_ip("f", "r")).collect()] == ["1.2.3.4", "9", "unknown", "unknown"]


FIELDS = sorted({*search.PHRASE_FIELDS, *search.SUBSTRING_FIELDS, "artist_norm", "country_norm", "year_sort"})


def cat(spark, rows):
    return spark.createDataFrame([tuple([i, *(r.get(f) for f in FIELDS)]) for i, r in enumerate(rows)], "id long, " + ", ".join(f"{f} {'int' if f == 'year_sort' else 'string'}" for f in FIELDS))


@pytest.mark.parametrize("q, hits", [("will power", [0, 1]), ("will-power", [0, 1]), ("power will", []), ('"', []), ("wil", [0, 1, 2, 3]), ("noel", [4])])
def test_phrase(spark, q, hits):
    rows = cat(spark, [{"title": "Will Power"}, {"title": "Will Powers"}, {"title": "Power and Will"}, {"title": "His Power", "artist": "Williams"}, {"artist": "Noël X"}])
    got = [r["id"] for r in rows.filter(search.phrase_match(q)).orderBy("id").collect()]
    assert got == hits


@pytest.mark.parametrize("q, hits", [("marley", [0]), ("1022", [1]), ("1660-1", [2]), ("tysonic", [3]), ("ab", []), ("", []), ("a\u0001b", [])])
def test_substring(spark, q, hits):
    rows = cat(spark, [{"artist": "Bob Marley"}, {"matrix_number": "WIPX1022-A"}, {"label_number": "GP 1660-1 TSL"}, {"label": "Tysonic"}])
    assert [r["id"] for r in rows.filter(search.substring_match(q)).orderBy("id").collect()] == hits


def test_bulk_equals_single(spark):
    rows = cat(spark, [{"artist": f"name {i % 7}", "title": f"song {i} one"} for i in range(40)] + [{"artist": "name 3\U00010400\U00010400 longer"}])
    texts = ["name 3", "song 1", "one", "zz", "no such", "g 12 o", "song 12 one", "e 3\U00010400\U00010400 longer", "\U00010400\U00010400 longer", None, "song 12 one"]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id long, q string")
    got = {(r["query_id"], r["id"]) for r in search.bulk_search(rows, queries).collect()}
    assert got == {(k, r["id"]) for k, q in enumerate(texts) if q for r in rows.filter(search.substring_match(q)).collect()}
    for some in (queries.filter("length(q) < 8"), queries.filter("length(q) >= 8"), queries.limit(0)):
        asked = {r["query_id"] for r in some.collect()}
        assert {(r["query_id"], r["id"]) for r in search.bulk_search(rows, some).collect()} == {(k, i) for k, i in got if k in asked}


def test_pages():
    assert [search.parse_page(p) for p in (None, "x", "0", "-3", "7", "99999999", 2)] == [1, 1, 1, 1, 7, 10_000, 2]
    assert search.page_numbers(250, 3) == {"first_row": 201, "last_row": 250, "pages": 3}

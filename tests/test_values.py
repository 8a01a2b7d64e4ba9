"""Single values: expected results written by hand."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallywright.functions import compare, normalize, similarity
from tallywright.operators import mapping


def evaluate(spark, values, fn, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r[0] for r in rows.orderBy("i").select(fn(F.col("v")).alias("x")).collect()]


def test_match_keys(spark):
    values = ["INV-5D", "INV-S0", "AB8", "ABB", "41 143", "41143", "ORD-1O", "ord10", "I|Lq", "--", " n/a ", None, "a#b"]
    assert evaluate(spark, values, normalize.match_key) == ["1NV5D", "1NVS0", "AB8", "ABB", "41143", "41143", "0RD10", "0RD10", "1110", None, None, None, "A#B"]


def test_amounts(spark):
    values = ["$1,250.00", "EUR 500", "N/A", "not money", "10 20", "(12.5)", "12,5", "1,250", "1.234.567", "1.23.4", "1.234,56", "1,234.56", "£ 7", "-3", None]
    got = [(r["value"], r["status"], r["currency"]) for r in evaluate(spark, values, normalize.amount)]
    assert got == [
        (1250.0, "success", None), (500.0, "success", "EUR"), (None, "missing", None), (None, "invalid", None), (1020.0, "success", None), (12.5, "success", None), (12.5, "success", None),
        (1250.0, "success", None), (1234567.0, "success", None), (None, "invalid", None), (1234.56, "success", None), (1234.56, "success", None), (7.0, "success", "GBP"), (-3.0, "success", None), (None, "missing", None),
    ]
    with_context = evaluate(spark, ["$1,250.00"], lambda v: normalize.amount(v, F.lit("us dollars")))
    assert with_context[0]["currency"] == "USD"


def test_dates(spark):
    values = ["Jul 22 2012", "01/02/2012", "13/02/2012", "02-13-2012", "2012-7-1", "march  6 2012", "6 March 2012", "30/02/2012", "n/a", "2012-02-30", "May 1 2013", None]
    got = [(r["value"], r["status"]) for r in evaluate(spark, values, normalize.date)]
    d = dt.date
    assert got == [
        (d(2012, 7, 22), "success"), (None, "invalid"), (d(2012, 2, 13), "success"), (d(2012, 2, 13), "success"), (d(2012, 7, 1), "success"), (d(2012, 3, 6), "success"), (d(2012, 3, 6), "success"),
        (None, "invalid"), (None, "missing"), (None, "invalid"), (d(2013, 5, 1), "success"), (None, "missing"),
    ]


def test_labels_names_currencies(spark):
    assert evaluate(spark, ["Order 1D", "T0tal", "Discount (20%)", "Pa!d", None], normalize.label) == ["order id", "total", "discount 20", "paid", ""]
    assert evaluate(spark, ["ABC  Corporation, Inc.", "Café-Nord", "none"], normalize.entity) == ["abc corp inc", "café nord", None]
    assert evaluate(spark, ["$", "€", " Pounds", "chf", "dollar", None], normalize.currency) == [None, "EUR", "GBP", "CHF", None, None]


@pytest.mark.parametrize(
    ("left", "right", "percent", "status"),
    [("100", "101", 0.99, "AUTO_RESOLVED"), ("100", "110", 9.09, "ESCALATED"), ("98", "100", 2.0, "AUTO_RESOLVED"), ("97.996", "100", 2.0, "AUTO_RESOLVED"), ("100.004", "100", 0.0, "MATCHED"),
     ("0", "0", 0.0, "MATCHED"), ("0.5", "0", 100.0, "ESCALATED"), ("0", "0.5", 100.0, "ESCALATED"), (None, "1", None, "MISSING")],
)
def test_numeric(spark, left, right, percent, status):
    row = spark.createDataFrame([(left, right)], "l string, r string").select(compare.numeric(*[F.col(c).cast("decimal(18,4)") for c in "lr"]).alias("c")).first()["c"]
    assert (row["percent"], row["status"]) == (percent, status)


@pytest.mark.parametrize(("lag", "kind", "status"), [(0, "PAYMENT", "MATCHED"), (120, "PAYMENT", "MATCHED"), (121, "PAYMENT", "ESCALATED"), (-1, "PAYMENT", "ESCALATED"), (7, "LEDGER", "AUTO_RESOLVED"), (-8, "LEDGER", "ESCALATED")])
def test_dates_compared(spark, lag, kind, status):
    rows = spark.createDataFrame([(dt.date(2020, 1, 1), dt.date(2020, 1, 1) + dt.timedelta(lag), kind)], "l date, r date, k string")
    assert rows.select(compare.dates(F.col("l"), F.col("r"), F.lit("INVOICE"), F.col("k")).alias("c")).first()["c"]["status"] == status
    swapped = rows.select(compare.dates(F.col("r"), F.col("l"), F.col("k"), F.lit("INVOICE")).alias("c")).first()["c"]
    assert swapped["status"] == status


def test_entities(spark):
    pairs = [("global technology solutions", "global technology solution"), ("abc technologies", "xyz technologies"), ("abc corp", "abc corp india"), ("smith jones", "jones smith"), ("n/a", "n/a"), ("a", "a")]
    rows = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, l string, r string").orderBy("i")
    got = [r["e"]["status"] for r in rows.select(similarity.resolve(F.col("l"), F.col("r")).alias("e")).collect()]
    assert got == ["RESOLVED", "UNRESOLVED", "AMBIGUOUS", "RESOLVED", "UNRESOLVED", "RESOLVED"]
    assert round(similarity.jaro_winkler("dwayne", "duane"), 2) == 0.84 and round(similarity.jaro_winkler("abc technologies", "xyz technologies"), 4) == 0.8237


def test_values_by_steps_are_those_of_one_expression(spark):
    raws = ["$1,234.50", " 1.234,50 ", "1,234", "1.2.3", "n/a", "", None, "abc", "2012-03-06", "Mar  06 2012", "06/03/2012", "25/03/2012", "Acme, Incorporated", "usd", "€5 net", "ORD 1"]
    kinds = ["amount", "UNIT_PRICE", "QUANTITY", "DATE", "ENTITY", "IDENTIFIER", "CURRENCY", "TEXT", "ADDRESS", "OTHER", None]
    rows = spark.createDataFrame([(r, k, known) for r in raws for k in kinds for known in (True, False)], "raw string, kind string, known boolean")
    want = F.when(F.col("known"), normalize.value(F.col("raw"), F.col("kind")))
    both = normalize.with_value(rows, "raw", "kind", F.col("known")).withColumn("want", want)
    assert both.columns == ["raw", "kind", "known", "normal", "want"]
    assert both.where(~F.col("normal").eqNullSafe(F.col("want"))).collect() == [] and both.where("normal.number = 1234.5").count() > 0


def test_fields_without_a_label_are_mapped_too(spark):
    fields = spark.createDataFrame([("d", "INVOICE", 0, None, "1"), ("d", "INVOICE", 1, "Total", "2"), ("d", "INVOICE", 2, "T0tal", "3")], "document_id string, document_type string, pos int, raw_label string, raw string")
    got = {r.pos: (r.label, r.role) for r in mapping.map_fields(fields).collect()}
    assert got == {0: ("", None), 1: ("total", "TRANSACTION_TOTAL"), 2: ("total", "TRANSACTION_TOTAL")}

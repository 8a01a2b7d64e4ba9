"""Profit and loss, forecasts and the gate on small tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tallywright.functions import normalize, similarity
from tallywright.operators import forecast, gate, linking, pnl, reconcile, store


def months(spark, profits):
    rows = [(dt.date(2020 + i // 12, i % 12 + 1, 1), f"{2020 + i // 12}-{i % 12 + 1:02}", p) for i, p in enumerate(profits)]
    return spark.createDataFrame(rows, "start date, month string, profit int").withColumn("profit", F.col("profit").cast("decimal(18,2)"))


def txn(spark, rows):
    return spark.createDataFrame([(dt.date.fromisoformat(d), k, float(a), c) for d, k, a, c in rows], "date date, kind string, amount double, category string").withColumn("amount", F.col("amount").cast("decimal(18,2)"))


def test_gaps_are_filled(spark):
    got = pnl.monthly(txn(spark, [("2020-01-05", "revenue", 10, "x"), ("2020-03-09", "expense", 4, "x")])).orderBy("start").collect()
    assert [(r.month, float(r.revenue), float(r.profit)) for r in got] == [("2020-01", 10, 10), ("2020-02", 0, 0), ("2020-03", 0, -4)]


@pytest.mark.parametrize("anchor, want", [("2020-02", [80, 100, 95]), (None, [85, 105, 100]), ("1999-01", [85, 105, 100])])
def test_cash_history(spark, anchor, want):
    got = pnl.cash_history(months(spark, [10, 20, -5]), 100, anchor).orderBy("month").collect()
    assert [float(r.balance) for r in got] == want


def test_one_complete_quarter_is_no_growth(spark):
    rows = txn(spark, [(f"2020-0{m}-01", "expense", 5, "a") for m in (1, 2, 3, 4)])
    assert pnl.growth(rows, pnl.monthly(rows), "category", "expense").count() == 0
    rows = txn(spark, [(f"2020-0{m}-01", "expense", 5 + m, "a") for m in (1, 2, 3, 4, 5, 6, 7)] + [("2020-07-02", "expense", 1, "late")])
    got = pnl.growth(rows, pnl.monthly(rows), "category", "expense").collect()
    assert [(r.label, float(r.latest_amount), float(r.prior_amount)) for r in got] == [("a", 30, 21), ("late", 0, 0)]


def test_budget_has_categories_of_either_year(spark):
    rows = txn(spark, [("2019-02-01", "expense", 100, "old"), ("2019-09-01", "expense", 7, "later"), ("2020-03-01", "expense", 50, "new")])
    got = {r.category: (r.spent, r.budget, r.consumption, r.budget_source) for r in pnl.budget_consumption(rows, {"new": 200.0}).collect()}
    assert got == {"old": (0.0, 105.0, 0.0, "prior year +5%"), "new": (50.0, 200.0, 0.25, "configured")}


def test_trend_and_runway(spark):
    series = spark.createDataFrame([("a", t, 10.0 + 2 * t) for t in range(12)], "series string, t int, value double")
    got = forecast.linear_forecast(series, 3).orderBy("step").collect()
    assert [r.point for r in got] == [34, 36, 38] and [r.lower for r in got] == [34, 36, 38]
    cash = spark.createDataFrame([(dt.date(2020, i + 1, 1), 500.0 + 50 * (11 - i)) for i in range(12)], "start date, balance double")
    out = forecast.runway(cash).first()
    assert (out.months, out.monthly_burn, out.pessimistic, out.optimistic) == (10, 50.0, 10, 10)


def test_arima_follows_a_season_better_than_nothing(spark):
    import math

    series = spark.createDataFrame([("s", t, 100.0 + 3 * t + 20 * math.sin(t * math.pi / 6)) for t in range(48)] + [("flat", t, 5.0) for t in range(9)], "series string, t int, value double")
    got = {(r.series, r.model): r.mape for r in forecast.backtest(series, 6).where("series = 's'").collect()}
    assert got["s", "arima"] < 15 and set(m for _, m in got) == {"linear_regression", "arima", "ensemble"}
    flat = forecast.arima_forecast(series, 3).where("series = 'flat'").collect()
    assert {(r.model, r.point) for r in flat} == {("linear_fallback", 5.0)}


def test_gate_ladder(spark):
    cases = [(["REJECTED", "ESCALATED"], False, "QUARANTINED"), (["MISSING"], True, "PENDING_REVIEW"), (["MATCHED"], True, "CORRECTED"), (["ACCEPTED", "MATCHED"], False, "ACCEPTED"), (["MATCHED"], False, "RECONCILED"), ([], False, "SINGLE_SOURCE"), ([], True, "CORRECTED")]
    rows = spark.createDataFrame([(i, s, c) for i, (s, c, _) in enumerate(cases)], "i int, s array<string>, c boolean").orderBy("i")
    assert [r[0] for r in rows.select(gate.transaction_status(F.col("s"), F.col("c"))).collect()] == [w for _, _, w in cases]


def test_corrections(spark):
    txns = spark.createDataFrame([("t", ["c1", "c2"], 5.0, dt.date(2020, 1, 1), "old", None)], "transaction_id string, case_ids array<string>, amount double, date date, category string, counterparty string")
    acts = [(1, "c1", "CORRECT", "amount", "$1,000"), (2, "c1", "CORRECT", "amount", "-2,000"), (3, "c2", "CORRECT", "amount", "abc"), (4, "c2", "CORRECT", "category", "x"), (5, "c1", "CORRECT", "category", "y"), (6, "c1", "ACCEPT", None, None)]
    actions = spark.createDataFrame(acts, "id int, case_id string, action string, field string, corrected_value string")
    got = gate.apply_corrections(txns, actions).first()
    assert (got.amount, got.category, got.n_corrections) == (2000.0, "x", 4)


def facts(spark, rows):
    schema = "document_id string, document_type string, identifiers array<string>, amount int, date date, entry_type string"
    made = spark.createDataFrame([(i, t, k, a, None if d is None else dt.date(2020, 1, 1) + dt.timedelta(d), e) for i, t, k, a, d, e in rows], schema)
    none = F.lit(None).cast("string")
    return made.withColumns({"amount": F.col("amount").cast("decimal(18,2)"), "source_name": F.col("document_id"), "currency": none, "entity": none, "category": none, "low_confidence": F.lit(False)})


def test_run_over_planted_cases(spark):
    rows = [
        ("inv-1", "INVOICE", ["A-1"], 100, 0, None), ("led-1", "LEDGER", ["A1"], 101, 3, "Revenue"), ("pay-1", "PAYMENT", ["a 1"], 100, 30, None),
        ("inv-2", "INVOICE", ["B2"], 500, 0, None), ("led-2", "LEDGER", [], 540, 2, "Revenue"),  # unreferenced, unique, 8 % off
        ("inv-3", "INVOICE", ["C3"], 900, 0, None), ("inv-3b", "INVOICE", ["C-3"], 1350, 0, None), ("led-3", "LEDGER", ["C3"], 900, 0, "Revenue"),
        ("inv-4", "INVOICE", ["D4"], 9000, 0, None), ("pay-5", "PAYMENT", ["--"], 7, 0, None), ("inv-6", "INVOICE", [], None, 0, None),
    ]
    own = facts(spark, rows)
    run = reconcile.run(own)
    cases = {r.case_id: (r.status, r.discrepancy_types) for r in run.cases.collect()}
    assert cases["pair:inv-1|led-1"] == ("AUTO_RESOLVED", ["date_variance", "rounding_variance"]) and cases["pair:inv-1|pay-1"][0] == "MATCHED"
    assert cases["pair:inv-2|led-2"] == ("ESCALATED", ["date_variance", "numerical_mismatch"])
    assert cases["pair:inv-3|inv-3b"] == ("ESCALATED", ["duplicate_entry", "numerical_mismatch"]) and "pair:inv-3b|led-3" not in cases
    assert cases["doc:inv-4:missing-ledger"][0] == "MISSING" and cases["doc:pay-5:missing-invoice"][0] == "MISSING" and cases["doc:inv-6:extraction"][0] == "ESCALATED"
    related = {r.case_id: r.related for r in run.cases.collect() if r.related}
    assert related == {"pair:inv-3|inv-3b": ["pair:inv-3b|led-3"]}
    made = {r.transaction_id: r for r in run.transactions.collect()}
    assert made["txn:inv-1"].document_ids == ["inv-1", "led-1", "pay-1"] and float(made["txn:inv-1"].amount) == 100
    assert set(made) == {"txn:inv-1", "txn:inv-2", "txn:inv-3", "txn:inv-4", "txn:pay-5", "txn:inv-6"}
    none = reconcile.run(own.where("document_type = 'INVOICE'"))
    assert not [r for r in none.cases.collect() if r.case_type == "missing_document"]  # no ledger, nothing missing from it


def test_names_are_compared_in_a_run(spark):
    rows = [
        ("inv-1", "INVOICE", ["A1"], 100, 0, None), ("led-1", "LEDGER", ["A1"], 100, 0, "Revenue"), ("inv-2", "INVOICE", ["B2"], 900, 0, None), ("led-2", "LEDGER", ["B2"], 900, 0, "Revenue"),
        ("inv-3", "INVOICE", ["C3"], 70, 0, None), ("led-3", "LEDGER", ["C3"], 70, 0, "Revenue"), ("inv-4", "INVOICE", ["D4"], 55, 0, None), ("led-4", "LEDGER", ["D4"], 55, 0, "Revenue"),
    ]
    names = {"inv-1": "Acme, Inc", "led-1": "ACME inc", "inv-2": "Acme Corp", "led-2": "Zebra Limited", "inv-3": "ABC Corporation", "led-3": "ABC corp india", "inv-4": "Acme"}
    raw = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    own = facts(spark, rows).withColumn("entity_raw", F.try_element_at(raw, F.col("document_id")))
    own = own.withColumns({"entity": normalize.entity(F.col("entity_raw")), "currency": F.lit("GBP")})
    run = reconcile.run(own)
    cases = {r.case_id: (r.status, r.discrepancy_types, r.explanation) for r in run.cases.collect()}
    assert cases["pair:inv-1|led-1"] == ("MATCHED", [], "All compared fields agree.")
    assert cases["pair:inv-2|led-2"] == ("ESCALATED", ["entity_mismatch"], "Counterparty names differ (Acme Corp vs Zebra Limited).")
    assert cases["pair:inv-3|led-3"][:2] == ("ESCALATED", ["entity_alias"]) and cases["pair:inv-4|led-4"][0] == "MATCHED"
    made = {r.transaction_id: (r.counterparty, r.currency) for r in run.transactions.collect()}
    assert made["txn:inv-1"] == ("Acme, Inc", "GBP") and made["txn:inv-2"] == ("Acme Corp", "GBP")


def test_best_of_several_values_counts(spark):
    schema = "document_id string, document_type string, identifiers array<string>, names array<string>, amounts array<struct<amount:double,currency:string>>, dates array<date>"
    day = lambda n: dt.date(2020, 1, 1) + dt.timedelta(n)
    rows = [
        ("i1", "INVOICE", ["X", "--"], ["acme corp", "north wind"], [(500.0, "USD"), (100.0, "EUR"), (99.0, None)], [day(0), day(200)]),
        ("p1", "PAYMENT", [], ["zebra", "north wind"], [(100.0, "USD"), (7.0, None)], [day(190), day(900)]),  # 99 to 100, 10 days, equal names
        ("p2", "PAYMENT", ["--"], ["north winds"], [(100.0, "EUR")], [day(9)]),  # like names, near dates
        ("p3", "PAYMENT", [], ["north winds"], [(100.0, "EUR")], [day(88)]),  # too far apart for names that are only alike
        ("p4", "PAYMENT", ["x"], [], [(100.0, "GBP")], []), ("p5", "PAYMENT", [], ["acme corp"], [(500.0, "EUR")], []), ("l1", "LEDGER", [], ["acme corp"], [(509.0, None)], []),
    ]
    none = F.lit(None)
    own = spark.createDataFrame(rows, schema).withColumns({"amount": none.cast("double"), "currency": none.cast("string"), "date": none.cast("date"), "entity": none.cast("string")})
    got = {(r.left_id, r.right_id): r for r in linking.link_evidence(own).collect()}
    assert set(got) == {("i1", "p1"), ("i1", "p2"), ("i1", "p4"), ("i1", "l1")}
    one = got["i1", "p1"]
    assert (one.identifier_match, one.entity_match, one.entity_score, one.days, one.amount_difference, round(one.amount_percent, 6), one.score, one.status) == (False, True, 1.0, 10, 1.0, 1.0, 0.394, "LINKED")
    assert got["i1", "p2"].status == "LINKED" and (got["i1", "p2"].amount_difference, got["i1", "p2"].days) == (0.0, 9)
    assert (got["i1", "p4"].amount_compatible, got["i1", "p4"].amount_percent, got["i1", "p4"].score) == (True, 1.0, 0.75)
    assert got["i1", "l1"].status == "AMBIGUOUS" and got["i1", "l1"].score == 0.35


def test_no_like_names_are_lost(spark):
    """The bound is never under the score, so that what it drops could not have counted."""
    import random

    draw = random.Random(11)
    names = ["".join(draw.choice("abcdeé ") for _ in range(draw.randrange(1, 14))).strip() or "a" for _ in range(60)]
    names += ["acme corp", "acme corps", "corp acme", "a", "ab", "aaaa", "aaab", "north wind trading", "north winds trade"]
    rows = spark.createDataFrame([(" ".join(n.split()),) for n in names], "x string").distinct()
    both = rows.crossJoin(rows.withColumnRenamed("x", "y"))
    made = both.select("x", "y", similarity.resolve(F.col("x"), F.col("y"))["score"].alias("score"), similarity.most_alike(similarity.name_traits(F.col("x")), similarity.name_traits(F.col("y"))).alias("bound"))
    held = made.collect()
    assert len(held) > 3000 and all(r.bound >= r.score - similarity.ROUNDING for r in held)
    assert sum(r.bound < 0.75 for r in held) > 0.3 * len(held)


def test_unreferenced_postings(spark):
    rows = [
        ("inv-1", "INVOICE", ["A"], 100, 0, None), ("led-1", "LEDGER", [], 125, 7, None), ("inv-2", "INVOICE", ["B"], 1000, 0, None), ("led-2", "LEDGER", [], 749, 0, "Revenue"),
        ("inv-3", "INVOICE", ["C"], 5000, 0, None), ("led-3", "LEDGER", [], 3750, -7, "Revenue"), ("led-4", "LEDGER", [], 3760, -8, "Revenue"), ("inv-5", "INVOICE", ["E"], 20000, 0, None), ("led-5", "LEDGER", [], 20000, 0, "Expense"),
        ("inv-6", "INVOICE", ["F"], 90000, 0, None), ("led-6", "LEDGER", [], 90000, 0, "Revenue"), ("inv-7", "INVOICE", ["G"], 91000, 1, None),
        ("inv-8", "INVOICE", ["H"], 400000, 0, None), ("led-8", "LEDGER", [], 400000, 0, "Revenue"),
    ]
    links = spark.createDataFrame([("inv-6", "zzz", "INVOICE_PAYMENT", "AMBIGUOUS"), ("aaa", "led-8", "INVOICE_LEDGER", "AMBIGUOUS")], "left_id string, right_id string, relationship string, status string")
    # inv-6 is contested, so led-6 is free for inv-7; an ambiguous link keeps no posting out
    got = sorted(tuple(r) for r in linking.unreferenced(facts(spark, rows), links).collect())
    assert got == [("inv-1", "led-1"), ("inv-3", "led-3"), ("inv-7", "led-6"), ("inv-8", "led-8")]


def test_weak_fields_and_copies_are_named(spark):
    rows = [("inv-3", "INVOICE", ["C3"], 900, 0, None), ("inv-3b", "INVOICE", ["C-3"], 1350, 0, None), ("led-3", "LEDGER", ["C3"], 900, 0, "Revenue"), ("inv-9", "INVOICE", ["Z"], 5, 0, None)]
    own = facts(spark, rows).withColumns({
        "low_confidence": F.col("document_id") == "inv-9", "confidence": F.lit(0.5), "source_name": F.concat("document_id", F.lit(".pdf")),
        "weak_fields": F.when(F.col("document_id") == "inv-9", F.array(F.struct(F.lit("total").alias("label"), F.lit(0.45).alias("confidence")))).otherwise(F.array().cast("array<struct<label:string,confidence:double>>")),
    })
    cases = {r.case_id: r.explanation for r in reconcile.run(own).cases.collect()}
    assert cases["doc:inv-9:extraction"] == "Read with low OCR confidence: total (45%) — below the 60% key-field review threshold."
    assert cases["pair:inv-3|inv-3b"].endswith("double entry. The ledger entry agrees with inv-3.pdf; inv-3b.pdf differs (Amounts differ by 50.0% (900.0 vs 1350.0), beyond tolerance.)") or "differs" in cases["pair:inv-3|inv-3b"]
    plain = {r.case_id: r.explanation for r in reconcile.run(own.drop("weak_fields")).cases.collect()}
    assert plain["doc:inv-9:extraction"] == "Extraction confidence 50.0% is below the 85% review threshold."


def test_linking_config():
    with pytest.raises(ValueError):
        linking.LinkingConfig(0.2, 0.5, 0.15, 0.15)


def test_audit_chain(spark):
    log = store.chained(spark.createDataFrame([(i, f"c{i}", 'say "x"' if i % 2 else None) for i in range(1, 9)], "id int, case_id string, reason string"), ["case_id", "reason"])
    assert store.verify_chain(log, ["case_id", "reason"]).count() == 0
    edited = log.withColumn("reason", F.when(F.col("id") == 4, "no").otherwise(F.col("reason")))
    assert [tuple(r) for r in store.verify_chain(edited, ["case_id", "reason"]).collect()] == [(4, "changed")]
    assert [tuple(r) for r in store.verify_chain(log.where("id <> 4"), ["case_id", "reason"]).collect()] == [(5, "broken before")]


def test_audit_chain_in_ranges(spark):
    log = store.chained(spark.range(1, 401).select("id", F.concat(F.lit("c"), "id").alias("case_id")), ["case_id"])
    for ranges in (1, 7, 64):
        assert store.verify_chain(log, ["case_id"], ranges).count() == 0
        got = store.verify_chain(log.where("id NOT IN (1, 200, 201)").withColumn("case_id", F.when(F.col("id") == 77, "x").otherwise(F.col("case_id"))), ["case_id"], ranges)
        assert sorted(tuple(r) for r in got.collect()) == [(2, "broken before"), (77, "changed"), (202, "broken before")]


def test_reviews_are_recorded(spark):
    fields = ["case_id", "action", "reviewer", "reason", "field", "corrected_value"]
    cases = spark.createDataFrame([("a", "ESCALATED"), ("b", "MISSING"), ("c", "AMBIGUOUS")], "case_id string, status string")
    schema = "id int, case_id string, action string, reviewer string, reason string, field string, corrected_value string"
    log = store.chained(spark.createDataFrame([(5, "c", "ACCEPT", "r", None, None, None)], schema), fields)
    asked = [
        (1, "a", "ACCEPT", " ann ", " ", "amount", "7"), (2, "a", "REJECT", "ann", " wrong ", None, None), (3, "b", "CORRECT", "ann", "typo", "amount", " $1,200 "), (4, "x", "ACCEPT", "ann", None, None, None),
        (5, "b", "DROP", "ann", None, None, None), (6, "b", "REJECT", "ann", " ", None, None), (7, "b", "CORRECT", "ann", "r", "", "1"), (8, "b", "CORRECT", "ann", "r", "date", "2020-02-30"),
        (9, "b", "CORRECT", "ann", "r", "amount", "1.2.3"), (10, "b", "CORRECT", "ann", "r", "category", "  "), (11, "b", "ACCEPT", " ", None, None, None), (12, "b", "CORRECT", "ann", "r", "date", "2020-02-29"),
    ]
    changed, longer, refused = store.record_reviews(cases, log, spark.createDataFrame(asked, schema), fields)
    assert {r.case_id: r.status for r in changed.collect()} == {"a": "REJECTED", "b": "CORRECTED", "c": "AMBIGUOUS"}
    rows = longer.orderBy("id").collect()
    assert [(r.id, r.case_id, r.action, r.reviewer, r.reason, r.field, r.corrected_value) for r in rows] == [
        (5, "c", "ACCEPT", "r", None, None, None), (6, "a", "ACCEPT", "ann", None, None, None), (7, "a", "REJECT", "ann", "wrong", None, None),
        (8, "b", "CORRECT", "ann", "typo", "amount", "$1,200"), (9, "b", "CORRECT", "ann", "r", "date", "2020-02-29"),
    ]
    assert rows[1].prev_hash == rows[0].entry_hash and store.verify_chain(longer, fields).count() == 0
    assert {r.id: r.problem for r in refused.collect()} == {
        4: "unknown case", 5: "unknown action", 6: "no reason", 7: "no field", 8: "date is no date", 9: "amount is no number", 10: "no value", 11: "no reviewer",
    }

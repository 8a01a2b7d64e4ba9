"""Profit and loss over verified transactions: series, breakdowns, budgets, growth, cash."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.operators import gate


def _sum(kind: str) -> Column:
    return F.round(F.sum(F.when(F.col("kind") == kind, F.col("amount"))), 2)


def monthly(txn: DataFrame) -> DataFrame:
    """Every month from the first to the last, empty ones as zero; decimals rounded to cents.

    One aggregate: each month is filled up to the next one that has rows.
    """
    sums = txn.where("date IS NOT NULL").groupBy(F.trunc("date", "month").alias("own")).agg(_sum("revenue").alias("revenue"), _sum("expense").alias("expenses"))
    following = F.lead("own").over(Window.orderBy("own"))  # a row a month
    until = F.coalesce(F.add_months(following, -1), F.col("own"))
    filled = sums.withColumn("until", until).select("own", "revenue", "expenses", F.explode(F.expr("sequence(own, until, interval 1 month)")).alias("start"))
    here, zero = F.col("start") == F.col("own"), F.lit(0).cast("decimal(38,2)")
    return filled.select(
        "start", F.date_format("start", "yyyy-MM").alias("month"),
        F.coalesce(F.when(here, F.col("revenue")), zero).cast("decimal(38,2)").alias("revenue"),
        F.coalesce(F.when(here, F.col("expenses")), zero).cast("decimal(38,2)").alias("expenses"),
    ).withColumn("profit", F.col("revenue") - F.col("expenses"))


def quarterly(months: DataFrame) -> DataFrame:
    """Quarters of the rounded months; complete if all three are there."""
    quarter = F.concat(F.year("start"), F.lit("-Q"), F.quarter("start"))
    return months.groupBy(quarter.alias("quarter")).agg(
        F.sum("revenue").alias("revenue"), F.sum("expenses").alias("expenses"), F.sum("profit").alias("profit"),
        F.count(F.lit(1)).alias("months_in"), (F.count(F.lit(1)) == 3).alias("complete"),
    )


def breakdown(txn: DataFrame, key: str, kind: str, top: int = 8) -> DataFrame:
    """Largest labels of a kind with their share of all of it; ties go to the smaller label."""
    label = F.coalesce(F.when(F.col(key) != "", F.col(key)), F.lit("Unspecified"))
    summed = txn.where(F.col("kind") == kind).groupBy(label.alias("label")).agg(F.sum("amount").alias("exact"), F.count(F.lit(1)).alias("n"))
    share = F.round(100 * F.col("exact").cast("double") / F.sum("exact").over(Window.partitionBy()).cast("double"), 4)  # over labels, not rows
    return summed.select("label", F.round("exact", 2).cast("double").alias("amount"), "n", share.alias("share")).orderBy(F.desc("amount"), "label").limit(top)


def cash_history(months: DataFrame, cash: float, anchor: str | None = None) -> DataFrame:
    """Balance at each month's end, given what it is at the anchor's, or at the last month's if there is none such."""
    order = Window.orderBy("start").rowsBetween(Window.unboundedPreceding, 0)  # a row a month
    run = months.withColumn("cum", F.sum("profit").over(order))
    at = F.coalesce(F.max(F.when(F.col("month") == F.lit(anchor), F.col("cum"))), F.max_by("cum", "start"))
    return run.join(F.broadcast(run.agg(at.alias("at")))).select(
        "month", "profit", (F.lit(cash).cast("decimal(18,2)") + F.col("cum") - F.col("at")).cast("decimal(38,2)").alias("balance")
    )


def growth(txn: DataFrame, months: DataFrame, key: str, kind: str, top: int = 15) -> DataFrame:
    """The last two complete quarters by label: change and percentage (null from zero)."""
    def quarter(d: Column) -> Column:
        return F.concat(F.year(d), F.lit("-Q"), F.quarter(d))

    complete = quarterly(months).where("complete").orderBy(F.desc("quarter")).limit(2)
    both = complete.agg(F.max("quarter").alias("latest"), F.min("quarter").alias("prior")).where("latest <> prior")  # two are needed
    label = F.coalesce(F.when(F.col(key) != "", F.col(key)), F.lit("Unspecified"))
    own = txn.where(F.col("kind") == kind).select(label.alias("label"), "amount", quarter(F.col("date")).alias("q")).join(F.broadcast(both))

    def of(which: str) -> Column:
        return F.round(F.coalesce(F.sum(F.when(F.col("q") == F.col(which), F.col("amount"))), F.lit(0)), 2)

    change = F.col("latest_amount") - F.col("prior_amount")
    return (
        own.groupBy("label").agg(of("latest").alias("latest_amount"), of("prior").alias("prior_amount"))
        .select("label", "latest_amount", "prior_amount", change.alias("change"),
                F.when(F.col("prior_amount") != 0, F.round(100 * change.cast("double") / F.col("prior_amount").cast("double"), 4)).alias("pct"))
        .orderBy(F.desc("change"), "label").limit(top)
    )


def budget_consumption(txn: DataFrame, budgets: dict[str, float] | None = None) -> DataFrame:
    """Expenses of the latest year to date by category, against a configured budget or the same months a year before plus 5 %."""
    own = txn.where("kind = 'expense' AND date IS NOT NULL")
    # Sums by category and month come first, so that the rows are read once.
    by_month = own.groupBy("category", F.trunc("date", "month").alias("m")).agg(F.sum("amount").alias("a"))
    last = F.max("m").over(Window.partitionBy())
    by_month = by_month.withColumn("hi", last).where(F.month("m") <= F.month("hi"))
    in_year = lambda back: F.year("m") == F.year("hi") - back
    spent, prior = (F.sum(F.when(in_year(n), F.col("a"))) for n in (0, 1))
    out = by_month.where(in_year(0) | in_year(1)).groupBy("category").agg(F.round(F.coalesce(spent, F.lit(0)), 2).alias("spent"), F.round(F.coalesce(prior, F.lit(0)) * F.lit("1.05").cast("decimal(3,2)"), 2).alias("before"))
    given = F.create_map(*[F.lit(x) for k, v in (budgets or {}).items() for x in (k, float(v))]) if budgets else F.create_map().cast("map<string,double>")
    set_for = F.try_element_at(given, F.col("category"))
    budget = F.coalesce(F.when(set_for != 0, set_for), F.col("before").cast("double"))
    return out.select(
        "category", F.col("spent").cast("double").alias("spent"), budget.alias("budget"), F.when(budget != 0, F.round(F.col("spent").cast("double") / budget, 4)).alias("consumption"),
        F.when(set_for.isNotNull(), "configured").otherwise("prior year +5%").alias("budget_source"),
    )


def annual_budget(months: DataFrame, budgets: dict[str, float] | None = None) -> DataFrame:
    """One row: the configured total, else the last twelve months' expenses as a year plus 5 %."""
    if budgets:
        return months.sparkSession.createDataFrame([(round(sum(budgets.values()), 2), "configured")], "budget double, source string")
    recent = months.orderBy(F.desc("start")).limit(12)
    n = F.count(F.lit(1))
    return recent.agg(F.when(n > 0, F.round(F.sum("expenses").cast("double") * 12 / n * 1.05, 2)).alias("budget"), F.when(n > 0, "last 12 months + 5%").otherwise("none").alias("source"))


PAYROLL_WORDS = ("salar", "payroll", "wage")


def payroll_profile(txn: DataFrame) -> DataFrame:
    """One row: payroll's share of expenses over the last three months, and payroll a month."""
    paid = F.lower(F.coalesce("category", F.lit(""))).rlike("|".join(PAYROLL_WORDS))
    by_month = txn.where("date IS NOT NULL").groupBy(F.trunc("date", "month").alias("m")).agg(
        F.sum(F.when(F.col("kind") == "expense", F.col("amount"))).alias("total"), F.sum(F.when((F.col("kind") == "expense") & paid, F.col("amount"))).alias("payroll")
    )
    recent = by_month.withColumn("hi", F.max("m").over(Window.partitionBy())).where(F.col("m") > F.add_months("hi", -3))
    payroll, total = F.coalesce(F.sum("payroll"), F.lit(0)).cast("double"), F.sum("total").cast("double")
    n_months = F.greatest(F.lit(1), F.least(F.lit(3), F.months_between(F.max("hi"), F.max("lo")).cast("int") + 1))
    lo = by_month.agg(F.min("m").alias("lo"))
    return recent.crossJoin(F.broadcast(lo)).agg(F.when(total != 0, F.round(payroll / total, 4)).otherwise(0.0).alias("share"), F.round(payroll / n_months, 2).alias("monthly"))  # one row


def totals(txn: DataFrame) -> DataFrame:
    """One row: revenue, expense, profit and margin, the months' rounded sums added."""
    sums = monthly(txn).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("decimal(38,2)").alias(n) for c, n in (("revenue", "revenue"), ("expenses", "expense"))])
    profit = F.col("revenue") - F.col("expense")
    margin = F.when(F.col("revenue") != 0, F.round(profit.cast("double") / F.col("revenue").cast("double"), 4))
    return sums.withColumns({"profit": profit.cast("decimal(38,2)"), "margin": margin})


def overview(every: DataFrame, budgets: dict[str, float] | None = None) -> DataFrame:
    """(section, label, measure, value): totals, months, quarters, breakdowns, budgets and what all is built from.

    ``every`` has all transactions with ``verified`` and ``verification_status``; numbers are of verified ones.
    """
    good = gate.verified(every)
    months = monthly(good)

    def long(rows: DataFrame, section: str, label: Column, measures: list[str]) -> DataFrame:
        each = F.explode(F.array(*[F.struct(F.lit(m).alias("measure"), F.col(m).cast("double").alias("value")) for m in measures]))
        return rows.select(F.lit(section).alias("section"), label.cast("string").alias("label"), each.alias("m")).select("section", "label", "m.measure", "m.value")

    none, money = F.lit(None), ["revenue", "expenses", "profit"]
    parts = [
        long(totals(good), "totals", none, ["revenue", "expense", "profit", "margin"]), long(months, "monthly", F.col("month"), money),
        long(quarterly(months), "quarterly", F.col("quarter"), [*money, "months_in"]),
        *(long(breakdown(good, key, kind, top), section, F.col("label"), ["amount", "n"]) for section, key, kind, top in (
            ("revenue_by_category", "category", "revenue", 8), ("expense_by_category", "category", "expense", 8), ("top_counterparties", "counterparty", "expense", 6), ("expense_by_counterparty", "counterparty", "expense", 12),
        )),
        long(budget_consumption(good, budgets or {}), "budget", F.col("category"), ["spent", "budget", "consumption"]),
        long(gate.traceability(every), "traceability", none, ["verified_records", "total_records", "source_documents"]),
    ]
    return reduce(DataFrame.unionByName, parts)

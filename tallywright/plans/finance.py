"""Profit and loss, budgets, forecasts, and what conversations and labels have to say."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallywright.operators import evaluate, forecast, gate, pnl, scenario
from tallywright.plans.base import doubles, query
from tallywright.sources import tables as t

_TXN = "WITH " + t.TRANSACTIONS_SQL
_MONTHS = _TXN + """,
sums AS (
  SELECT date_trunc('month', date)::DATE AS start, round(sum(amount) FILTER (WHERE kind = 'revenue'), 2) AS revenue,
         round(sum(amount) FILTER (WHERE kind = 'expense'), 2) AS expenses
  FROM txn WHERE date IS NOT NULL GROUP BY 1),
months AS (
  SELECT c.start, strftime(c.start, '%Y-%m') AS month, coalesce(revenue, 0)::DECIMAL(38,2) AS revenue,
         coalesce(expenses, 0)::DECIMAL(38,2) AS expenses, coalesce(revenue, 0)::DECIMAL(38,2) - coalesce(expenses, 0)::DECIMAL(38,2) AS profit
  FROM (SELECT unnest(generate_series((SELECT min(start) FROM sums), (SELECT max(start) FROM sums), INTERVAL 1 MONTH))::DATE AS start) c
  LEFT JOIN sums USING (start)),
quarters AS (
  SELECT year(start) || '-Q' || quarter(start) AS quarter, sum(revenue) AS revenue, sum(expenses) AS expenses,
         sum(profit) AS profit, count(*) AS months_in, count(*) = 3 AS complete FROM months GROUP BY 1)
"""


def _months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pnl.monthly(t.transactions(spark, sf_dir))


@query(_MONTHS + "SELECT month, revenue::DOUBLE AS revenue, expenses::DOUBLE AS expenses, profit::DOUBLE AS profit FROM months")
def monthly_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _months(spark, sf_dir).select("month", *doubles("revenue", "expenses", "profit"))


@query(_MONTHS + "SELECT quarter, revenue::DOUBLE AS revenue, expenses::DOUBLE AS expenses, profit::DOUBLE AS profit, months_in, complete FROM quarters")
def quarterly_pnl(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pnl.quarterly(_months(spark, sf_dir)).select("quarter", *doubles("revenue", "expenses", "profit"), "months_in", "complete")


@query(_MONTHS + """SELECT sum(revenue)::DOUBLE AS revenue, sum(expenses)::DOUBLE AS expenses, sum(profit)::DOUBLE AS profit,
  CASE WHEN sum(revenue) <> 0 THEN round(100 * sum(profit)::DOUBLE / sum(revenue)::DOUBLE, 4) END AS margin FROM months""")
def pnl_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    sums = _months(spark, sf_dir).agg(*[F.sum(n).cast("double").alias(n) for n in ("revenue", "expenses", "profit")])
    return sums.withColumn("margin", F.when(F.col("revenue") != 0, F.round(100 * F.col("profit") / F.col("revenue"), 4)))


def _breakdown_sql(key: str, kind: str) -> str:
    return _TXN + f""", g AS (SELECT coalesce(nullif({key}, ''), 'Unspecified') AS label, sum(amount) AS e, count(*) AS n
      FROM txn WHERE kind = '{kind}' GROUP BY 1)
    SELECT label, round(e, 2)::DOUBLE AS amount, n, round(100 * e::DOUBLE / (SELECT sum(e) FROM g)::DOUBLE, 4) AS share
    FROM g ORDER BY amount DESC, label LIMIT 8"""


@query(_breakdown_sql("category", "expense"))
def breakdown_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pnl.breakdown(t.transactions(spark, sf_dir, "category"), "category", "expense")


@query(_breakdown_sql("counterparty", "revenue"))
def breakdown_counterparty(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pnl.breakdown(t.transactions(spark, sf_dir, "counterparty"), "counterparty", "revenue")


@query(_MONTHS + """, r AS (SELECT *, sum(profit) OVER (ORDER BY start) AS cum FROM months)
SELECT month, profit::DOUBLE AS profit, (500000 + cum - (SELECT cum FROM r ORDER BY start DESC LIMIT 1))::DOUBLE AS balance FROM r""")
def cash_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pnl.cash_history(_months(spark, sf_dir), 500000).select("month", *doubles("profit", "balance"))


@query(_MONTHS + """, b AS (SELECT max(quarter) AS latest, min(quarter) AS prior FROM (SELECT quarter FROM quarters WHERE complete ORDER BY quarter DESC LIMIT 2)),
g AS (SELECT coalesce(nullif(category, ''), 'Unspecified') AS label,
  round(coalesce(sum(amount) FILTER (WHERE year(date) || '-Q' || quarter(date) = latest), 0), 2) AS l,
  round(coalesce(sum(amount) FILTER (WHERE year(date) || '-Q' || quarter(date) = prior), 0), 2) AS p
  FROM txn, b WHERE kind = 'expense' GROUP BY 1)
SELECT label, l::DOUBLE AS latest_amount, p::DOUBLE AS prior_amount, (l - p)::DOUBLE AS change,
  CASE WHEN p <> 0 THEN round(100 * (l - p)::DOUBLE / p::DOUBLE, 4) END AS pct FROM g ORDER BY change DESC, label LIMIT 15""")
def growth_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pnl.growth(t.transactions(spark, sf_dir, "category"), _months(spark, sf_dir), "category", "expense").select("label", *doubles("latest_amount", "prior_amount", "change"), "pct")


@query(_TXN + """, h AS (SELECT max(date_trunc('month', date)) AS hi FROM txn WHERE kind = 'expense'),
g AS (SELECT category, round(coalesce(sum(amount) FILTER (WHERE year(date) = year(hi) AND month(date) <= month(hi)), 0), 2) AS spent,
  round(coalesce(sum(amount) FILTER (WHERE year(date) = year(hi) - 1 AND month(date) <= month(hi)), 0) * 1.05::DECIMAL(3,2), 2) AS budget
  FROM txn, h WHERE kind = 'expense' AND year(date) IN (year(hi), year(hi) - 1) AND month(date) <= month(hi) GROUP BY 1)
SELECT category, spent::DOUBLE AS spent, coalesce(b.given, budget::DOUBLE) AS budget,
  CASE WHEN coalesce(b.given, budget::DOUBLE) <> 0 THEN round(spent::DOUBLE / coalesce(b.given, budget::DOUBLE), 4) END AS consumption,
  CASE WHEN b.given IS NOT NULL THEN 'configured' ELSE 'prior year +5%' END AS budget_source
FROM g LEFT JOIN (VALUES ('PROMO', 50000000.0::DOUBLE)) AS b(category, given) USING (category)""")
def budget_consumption(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pnl.budget_consumption(t.transactions(spark, sf_dir, "category"), {"PROMO": 50_000_000.0})


@query(_TXN + """SELECT (SELECT count(*) FROM txn) AS verified_records, count(*) AS total_records, (SELECT count(*) FROM txn) AS source_documents,
(SELECT min(date) FROM txn) AS date_from, (SELECT max(date) FROM txn) AS date_to,
(SELECT string_agg(verification_status || '=' || n, ',' ORDER BY verification_status) FROM (SELECT verification_status, count(*) AS n FROM all_txn GROUP BY 1)) AS statuses FROM all_txn""")
def traceability(spark: SparkSession, sf_dir: str) -> DataFrame:
    one = gate.traceability(t.transactions(spark, sf_dir, verified_only=False))
    said = F.transform(F.map_entries("status_counts"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string")))
    return one.withColumn("statuses", F.array_join(said, ",")).drop("status_counts")


@query(_TXN + """, k AS (SELECT * FROM txn WHERE kind = 'revenue' AND contains(lower(category), 'buil') AND date BETWEEN DATE '1996-01-01' AND DATE '1999-12-31' AND amount BETWEEN 1000 AND 300000)
SELECT transaction_id, date, kind, amount::DOUBLE AS amount, category, counterparty, (SELECT count(*) FROM k) AS matched, (SELECT round(sum(amount), 2)::DOUBLE FROM k) AS matched_total
FROM k ORDER BY date DESC, transaction_id LIMIT 50""")
def find_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = gate.find_transactions(
        t.transactions(spark, sf_dir, "category", "counterparty"), "revenue", category="BUIL", date_from="1996-01-01", date_to="1999-12-31", min_amount=1000, max_amount=300000, limit=50
    )
    return found.select("transaction_id", "date", "kind", *doubles("amount"), "category", "counterparty", "matched", *doubles("matched_total"))


@query(_TXN + """SELECT transaction_id, amount::DOUBLE AS amount FROM txn WHERE kind = 'expense' ORDER BY amount DESC, transaction_id LIMIT 20""")
def largest_expenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.find_transactions(t.transactions(spark, sf_dir), "expense", sort_by="amount").select("transaction_id", *doubles("amount"))


@query("SELECT conv_id, count(turn) AS n_messages, max(turn) AS last_turn FROM conversations GROUP BY conv_id")
def chat_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.count("turn").alias("n_messages"), F.max("turn").alias("last_turn"))


@query("""WITH r AS (SELECT user_id AS case_id, max(event_id) AS id FROM events WHERE event_type IN ('click', 'error', 'purchase') GROUP BY 1)
SELECT r.case_id, r.id, CASE event_type WHEN 'click' THEN 'ACCEPT' WHEN 'error' THEN 'REJECT' ELSE 'CORRECT' END AS action
FROM r JOIN events e ON e.event_id = r.id""")
def latest_review(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Latest decision of each case."""
    action = F.when(F.col("event_type") == "click", "ACCEPT").when(F.col("event_type") == "error", "REJECT").otherwise("CORRECT")
    own = t.table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "error", "purchase"))
    return own.groupBy(F.col("user_id").alias("case_id")).agg(F.max("event_id").alias("id"), F.max_by(action, F.col("event_id")).alias("action"))


@query("""SELECT t AS threshold, round(100.0 * count(*) FILTER (WHERE quality = 0 AND doc_id % 100 < t) / count(*) FILTER (WHERE quality = 0), 4) AS caught,
round(100.0 * count(*) FILTER (WHERE quality = 1 AND doc_id % 100 < t) / count(*) FILTER (WHERE quality = 1), 4) AS false_alarms
FROM labels, (VALUES (50), (60), (70), (85)) AS x(t) GROUP BY t""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each threshold on a score would catch of what is wrong, and of what is right."""
    samples = t.table(spark, sf_dir, "labels").select((F.col("quality") == 1).alias("correct"), (F.col("doc_id") % 100).alias("score"))
    return evaluate.threshold_sweep(samples, [50, 60, 70, 85])


@query("""SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS n FROM conversations) WHERE n <= 24""")
def chat_history_trim(spark: SparkSession, sf_dir: str) -> DataFrame:
    recent = Window.partitionBy("conv_id").orderBy(F.desc("turn"), "role", "text")
    return t.table(spark, sf_dir, "conversations").withColumn("n", F.row_number().over(recent)).where("n <= 24").select("conv_id", "turn", "role", "text")


def _series(spark: SparkSession, sf_dir: str, *names: str) -> DataFrame:
    months = _months(spark, sf_dir).withColumn("t", F.row_number().over(Window.orderBy("start")) - 1)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("series"), F.col(n).cast("double").alias("value")) for n in names]))
    return months.select("t", each.alias("s")).select("s.series", "t", "s.value")


_QUANTILES = "quantiles AS (SELECT unnest(range(1, 401)) AS dof, unnest([" + ", ".join(map(repr, forecast.quantiles())) + "]) AS q)"


def _fits(source: str) -> str:
    """Closed-form trend of ``source`` (series, t, value), without the engine's regression functions."""
    return f"""
totals AS (SELECT series, count(*) AS n, avg(t) AS tm, avg(value) AS vm FROM {source} GROUP BY series),
parts AS (SELECT s.series, any_value(n) AS n, any_value(tm) AS tm, any_value(vm) AS vm, sum((t - tm) * (t - tm)) AS sxx, sum((t - tm) * (value - vm)) AS sxy
          FROM {source} s JOIN totals USING (series) GROUP BY s.series),
fits AS (SELECT p.series, any_value(n) AS n, any_value(tm) AS tm, any_value(sxx) AS sxx, any_value(sxy / sxx) AS slope, any_value(vm - sxy / sxx * tm) AS icpt,
                sqrt(sum(power(s.value - (vm + sxy / sxx * (t - tm)), 2)) / any_value(n - 2)) AS err FROM parts p JOIN {source} s ON s.series = p.series GROUP BY p.series),
{_QUANTILES}"""


def _steps(horizon: int) -> str:
    return f"""steps AS (SELECT series, step::INTEGER AS step, icpt + slope * (n - 1 + step) AS point, q * err * sqrt(1 + 1.0 / n + power(n - 1 + step - tm, 2) / sxx) AS margin, slope
          FROM fits JOIN quantiles ON dof = least(n - 2, 400), (SELECT unnest(range(1, {horizon} + 1)) AS step))"""


_SERIES = _MONTHS + """, series AS (
  SELECT name AS series, row_number() OVER (PARTITION BY name ORDER BY start) - 1 AS t, value::DOUBLE AS value
  FROM (SELECT start, unnest(['revenue', 'expenses', 'profit']) AS name, unnest([revenue, expenses, profit]) AS value FROM months))"""
_CUTS = """, sized AS (SELECT s.series, t, value, k, count(*) OVER (PARTITION BY s.series, k) - {h} - k * {h} AS cut FROM series s, (SELECT unnest(range(0, {o})) AS k)),
cuts AS (SELECT series || '@' || k AS series, t, value FROM sized WHERE t < cut AND cut >= 8),
held AS (SELECT series || '@' || k AS series, series AS own, t - cut + 1 AS step, value AS actual FROM sized WHERE cut >= 8 AND t >= cut AND t < cut + {h})"""


@query("WITH RECURSIVE " + _SERIES[5:] + "," + _fits("series") + "," + _steps(6) + """
SELECT series, step, round(point, 2) AS point, round(point - margin, 2) AS lower, round(point + margin, 2) AS upper, round(slope, 2) AS slope FROM steps""")
def linear_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.linear_forecast(_series(spark, sf_dir, "revenue", "expenses", "profit"), 6)


@query("WITH " + _SERIES[5:] + _CUTS.format(h=3, o=4) + "," + _fits("cuts") + "," + _steps(3) + """,
by_cut AS (SELECT h.series, own, round(100 * avg(abs(actual - round(point, 2)) / abs(actual)) FILTER (WHERE actual <> 0), 2) AS m FROM held h JOIN steps USING (series, step) GROUP BY 1, 2)
SELECT own AS series, 'linear_regression' AS model, count(m) AS origins, round(avg(m), 2) AS mape, max(m) AS worst FROM by_cut GROUP BY own""")
def rolling_backtest_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.rolling_backtest(_series(spark, sf_dir, "revenue", "expenses", "profit"), models="linear")


@query("WITH " + _SERIES[5:] + _CUTS.format(h=6, o=1) + "," + _fits("cuts") + "," + _steps(6) + """
SELECT own AS series, 'linear_regression' AS model, round(100 * avg(abs(actual - round(point, 2)) / abs(actual)) FILTER (WHERE actual <> 0), 2) AS mape,
round(avg((actual BETWEEN round(point - margin, 2) AND round(point + margin, 2))::INTEGER), 2) AS coverage,
coalesce(round(100 * avg(abs(actual - round(point, 2)) / abs(actual)) FILTER (WHERE actual <> 0), 2) <= 15, false) AS meets_target FROM held JOIN steps USING (series, step) GROUP BY own""")
def backtest_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.backtest(_series(spark, sf_dir, "revenue", "expenses", "profit"), 6, models="linear")


@query()
def forecast_ensemble(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.forecast(_series(spark, sf_dir, "revenue", "expenses", "profit"), 6, non_negative=("revenue", "expenses"))


@query()
def backtest_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.backtest(_series(spark, sf_dir, "revenue", "expenses", "profit"), 6)


@query("WITH " + _MONTHS[5:] + """, cash AS (SELECT start, (50000000 + sum(profit) OVER (ORDER BY start) - sum(profit) OVER ())::DOUBLE AS value FROM months),
series AS (SELECT 'cash' AS series, row_number() OVER (ORDER BY start) - 1 AS t, value FROM (SELECT * FROM cash ORDER BY start DESC LIMIT 12)),""" + _fits("series") + "," + _steps(36) + """
SELECT round(-max(round(slope, 2)), 2) AS monthly_burn, min(step) FILTER (WHERE round(point, 2) <= 0) AS months, min(step) FILTER (WHERE round(point - margin, 2) <= 0) AS pessimistic,
min(step) FILTER (WHERE round(point + margin, 2) <= 0) AS optimistic FROM steps""")
def runway(spark: SparkSession, sf_dir: str) -> DataFrame:
    months = _months(spark, sf_dir)
    return forecast.runway(pnl.cash_history(months, 50_000_000).join(months.select("month", "start"), "month"))


@query("WITH " + _MONTHS[5:] + """, r AS (SELECT expenses FROM months ORDER BY start DESC LIMIT 12)
SELECT round(sum(expenses)::DOUBLE * 12 / count(*) * 1.05, 2) AS budget, 'last 12 months + 5%' AS source FROM r""")
def annual_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pnl.annual_budget(_months(spark, sf_dir))


_PAYROLL = """p AS (SELECT sum(amount) FILTER (WHERE regexp_matches(lower(category), 'salar|payroll|wage'))::DOUBLE AS pay, sum(amount)::DOUBLE AS total FROM txn
  WHERE kind = 'expense' AND date_trunc('month', date) > (SELECT max(date_trunc('month', date)) FROM txn) - INTERVAL 3 MONTH),
payroll AS (SELECT round(coalesce(pay, 0) / total, 4) AS share, round(coalesce(pay, 0) / 3, 2) AS monthly FROM p)"""


@query(_TXN + "," + _PAYROLL + "SELECT * FROM payroll")
def payroll_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pnl.payroll_profile(t.transactions(spark, sf_dir, "category"))


def _scenarios(spark: SparkSession) -> DataFrame:
    made = [("as_is", forecast.Scenario()), ("growth", forecast.Scenario(12, 10.0, 5.0, 0.5, 2, 15, 0.0, 0.0)), ("savings", forecast.Scenario(3, -5.0, 0.0, 0.5, -3, 15, 8.0, -2.0))]
    return spark.createDataFrame([(name, *vars(s).values()) for name, s in made], ["scenario", *vars(forecast.Scenario())])


def _scenario_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = forecast.linear_forecast(_series(spark, sf_dir, "revenue", "expenses"), 24)
    base = made.groupBy("step").agg(*[F.max(F.when(F.col("series") == n, F.greatest(F.lit(0.0), "point"))).alias(a) for n, a in (("revenue", "revenue"), ("expenses", "expense"))])
    return forecast.scenario_months(base, _scenarios(spark), pnl.payroll_profile(t.transactions(spark, sf_dir, "category")))


_SCENARIOS = "WITH " + _SERIES[5:] + "," + _PAYROLL + "," + _fits("series") + "," + _steps(24) + """,
base AS (SELECT step, max(greatest(0, round(point, 2))) FILTER (WHERE series = 'revenue') AS revenue, max(greatest(0, round(point, 2))) FILTER (WHERE series = 'expenses') AS expense FROM steps GROUP BY step),
scen AS (SELECT * FROM (VALUES ('as_is', 6, 0.0, 0.0, 0, 0.0, 0.0), ('growth', 12, 10.0, 5.0, 2, 0.0, 0.0), ('savings', 3, -5.0, 0.0, -3, 8.0, -2.0)) AS v(scenario, horizon, volume, pricing, heads, vendors, other)),
rows AS (SELECT scenario, step, round(revenue, 2) AS base_revenue, round(expense, 2) AS base_expense, round(revenue - expense, 2) AS base_profit,
  revenue * (1 + volume::DOUBLE / 100) * (1 + pricing::DOUBLE / 100) * (1 - 0.5::DOUBLE * (pricing::DOUBLE / 100)) AS rev,
  expense * share + heads * (monthly / 15) + expense * (1 - share) * ((1 - vendors::DOUBLE / 100) * (1 + other::DOUBLE / 100)) AS cost FROM base, scen, payroll WHERE step <= horizon),
months_of AS (SELECT scenario, step, base_revenue, base_expense, base_profit, round(rev, 2) AS revenue, round(cost, 2) AS expense, round(rev - cost, 2) AS profit FROM rows)
"""


@query(_SCENARIOS + "SELECT * FROM months_of")
def whatif(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scenario_rows(spark, sf_dir)


@query(_SCENARIOS + """, run AS (SELECT *, 1000000 + sum(profit) OVER (PARTITION BY scenario ORDER BY step) AS balance FROM months_of),
e AS (SELECT scenario, min(step) FILTER (WHERE balance <= 0) AS gone, arg_max(balance, step) AS ending, avg(profit) AS mean, max(step) AS n FROM run GROUP BY scenario)
SELECT scenario, round(ending, 2) AS ending_cash, coalesce(gone::DOUBLE, CASE WHEN mean < 0 THEN round(n + ending / -mean, 1) END) AS runway_months, mean < 0 AS burning_cash FROM e""")
def cash_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forecast.cash_path(_scenario_rows(spark, sf_dir), 1_000_000.0, "scenario")


@query(_MONTHS + """SELECT strftime(m, '%Y-%m') AS month, i::INTEGER AS step FROM (SELECT unnest(generate_series((SELECT max(start) FROM months) + INTERVAL 1 MONTH, (SELECT max(start) FROM months) + INTERVAL 6 MONTH, INTERVAL 1 MONTH)) AS m, unnest(range(1, 7)) AS i)""")
def next_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    last = _months(spark, sf_dir).agg(F.max("start").alias("last"))
    return last.select(F.posexplode(forecast.next_months(F.col("last"), 6)).alias("i", "m")).select(F.date_format("m", "yyyy-MM").alias("month"), (F.col("i") + 1).alias("step"))


@query(_MONTHS + """, v AS (SELECT count(*) AS months_covered, min(month) AS first_month, max(month) AS last_month, sum(revenue)::DOUBLE AS total_revenue, sum(expenses)::DOUBLE AS total_expense FROM months)
SELECT v.*, (SELECT count(*) FROM all_txn) - (SELECT count(*) FROM txn) AS excluded,
 (SELECT string_agg(DISTINCT category, ',' ORDER BY category) FROM txn WHERE kind = 'revenue' AND category <> '') AS revenue_categories,
 (SELECT string_agg(DISTINCT category, ',' ORDER BY category) FROM txn WHERE kind = 'expense' AND category <> '') AS expense_categories FROM v""")
def data_overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Period, totals, what is left out, and the categories of each kind."""
    months = _months(spark, sf_dir).agg(
        F.count(F.lit(1)).alias("months_covered"), F.min("month").alias("first_month"), F.max("month").alias("last_month"),
        F.sum("revenue").cast("double").alias("total_revenue"), F.sum("expenses").cast("double").alias("total_expense"),
    )
    every = t.transactions(spark, sf_dir, "category", verified_only=False)
    names = lambda kind: F.array_join(F.array_sort(F.collect_set(F.when((F.col("kind") == kind) & F.col("verified") & (F.col("category") != ""), F.col("category")))), ",")
    rest = every.agg(F.sum((~F.col("verified")).cast("long")).alias("excluded"), names("revenue").alias("revenue_categories"), names("expense").alias("expense_categories"))
    return months.crossJoin(rest)  # one row each


@query("WITH p AS (SELECT doc_id, quality, doc_id % 100 < 55 AS said FROM labels), n AS (SELECT count(*) FILTER (WHERE said AND quality = 0) AS tp, count(*) FILTER (WHERE said) AS claims, count(*) FILTER (WHERE quality = 0) AS truth FROM p) SELECT tp AS true_positives, claims, truth, round(tp::DOUBLE / claims, 4) AS precision, round(tp::DOUBLE / truth, 4) AS recall FROM n")
def precision_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was claimed against what is so, as sets."""
    rows = t.table(spark, sf_dir, "labels")
    return evaluate.score(rows.where("doc_id % 100 < 55").select("doc_id"), rows.where("quality = 0").select("doc_id"), "doc_id")


@query("SELECT CASE WHEN doc_id % 100 < 55 AND quality = 0 THEN 'tp' WHEN doc_id % 100 < 55 THEN 'fp' ELSE 'fn' END AS side, doc_id FROM labels WHERE doc_id % 100 < 55 OR quality = 0")
def issue_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "labels")
    return evaluate.sides(rows.where("doc_id % 100 < 55").select("doc_id"), rows.where("quality = 0").select("doc_id"), "doc_id")


@query("SELECT field, count(*) AS n, round(avg(ok), 4) AS accuracy FROM (SELECT unnest(['status', 'priority']) AS field, unnest([(o_orderstatus = 'F')::INTEGER, (o_orderkey % 5 + 1 = substr(o_orderpriority, 1, 1)::INTEGER)::INTEGER]) AS ok FROM orders) GROUP BY field")
def field_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Share of fields read as they should be."""
    orders = t.table(spark, sf_dir, "orders")
    want = orders.select(F.col("o_orderkey").alias("id"), F.lit("F").alias("status"), (F.col("o_orderkey") % 5 + 1).cast("string").alias("priority"))
    got = orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"), F.substring("o_orderpriority", 1, 1).alias("priority"))
    return evaluate.field_accuracy(got, want, "id", ["status", "priority"])


_LEVERS = ("volume_change_pct", "pricing_adjustment_pct", "price_elasticity", "headcount_change", "vendor_consolidation_pct", "other_cost_change_pct")
_DESK_SQL = """WITH e AS (SELECT user_id AS session, event_id AS seq, event_id % 11 = 0 AS reset, event_id % 8 AS lever, ((event_id * 7) % 901 / 10.0 - 45)::DOUBLE AS v FROM events),
c AS (SELECT session, seq, sum(reset::INT) OVER (PARTITION BY session ORDER BY seq) AS resets, v, CASE WHEN lever = 6 THEN CASE WHEN trunc(v) <= 4 THEN 3 WHEN trunc(v) <= 9 THEN 6 ELSE 12 END END AS horizon,
  """ + ",\n  ".join(
    f"CASE WHEN lever = {i} THEN {'round_even' if n == 'headcount_change' else ''}({'greatest(%d, least(%d, v)), 0' % lim if n == 'headcount_change' else 'round_even(greatest(%d, least(%d, v)), 2)' % lim}) END AS {n}"
    for i, (n, lim) in enumerate(scenario.LEVER_LIMITS.items())
) + ",\n  nullif(concat_ws(';', " + ", ".join(
    f"CASE WHEN lever = {i} AND (v < {low} OR v > {high}) THEN '{n} ' || regexp_replace(round(v, 4)::VARCHAR, '\\.0$', '') || ' capped to ' || CASE WHEN v < {low} THEN {low} ELSE {high} END END"
    for i, (n, (low, high)) in enumerate(scenario.LEVER_LIMITS.items())
) + "), '') AS capped FROM e)\n"


@query(_DESK_SQL + "SELECT session, seq, coalesce(last_value(horizon IGNORE NULLS) OVER (PARTITION BY session ORDER BY seq), 6)::INTEGER AS horizon, " + ", ".join(
    f"coalesce(last_value({n} IGNORE NULLS) OVER (PARTITION BY session, resets ORDER BY seq), {0.5 if n == 'price_elasticity' else 0})::{'INTEGER' if n == 'headcount_change' else 'DOUBLE'} AS {n}" for n in _LEVERS
) + ", coalesce(capped, '') AS capped FROM c")
def scenario_desk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user's events as changes of levers, and the scenario that stands after each."""
    key = F.col("event_id")
    value = ((key * 7) % 901 / F.lit(10.0) - 45).cast("double")
    named = [F.when(key % 8 == i, value).alias(n) for i, n in enumerate(_LEVERS)]
    changes = t.table(spark, sf_dir, "events").select(F.col("user_id").alias("session"), key.alias("seq"), (key % 11 == 0).alias("reset"), F.when(key % 8 == 6, value).alias("horizon"), *named)
    states = scenario.desk(changes)
    return states.select("session", "seq", "horizon", *_LEVERS, F.array_join("capped", ";").alias("capped"))

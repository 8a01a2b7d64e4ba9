"""Trends, their backtests, cash runway and scenarios, over monthly series.

A series is rows of (series, t, value) with t = 0, 1, ...; many series are
forecast at once.  The trend is closed-form and stays in Spark's own
aggregates; the autoregressive model is fitted a series a task.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LEVEL, MAPE_TARGET, RUNWAY_HISTORY, RUNWAY_HORIZON = 0.85, 15.0, 12, 36


def t_quantile(p: float, dof: int) -> float:
    """Student's t quantile, by bisection on the distribution's finite series."""
    angle_of = lambda t: math.atan(t / math.sqrt(dof))

    def cdf(t: float) -> float:
        a = angle_of(t)
        c, s = math.cos(a), math.sin(a)
        if dof % 2:
            total, term = 0.0, c
            for k in range(3, dof + 1, 2):
                total += term
                term *= c * c * (k - 1) / k
            return 0.5 + (a + s * total) / math.pi
        total, term = 0.0, 1.0
        for k in range(2, dof + 1, 2):
            total += term
            term *= c * c * (k - 1) / k
        return 0.5 + s * total / 2

    lo, hi = 0.0, 1.0
    while cdf(hi) < p:
        hi *= 2
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if cdf(mid) < p else (lo, mid)
    return (lo + hi) / 2


def quantiles(level: float = LEVEL, most: int = 400) -> list[float]:
    """Two-sided quantiles for 1 to ``most`` degrees of freedom; more are as good as the last."""
    return [t_quantile(0.5 + level / 2, dof) for dof in range(1, most + 1)]


def linear_fit(series: DataFrame) -> DataFrame:
    """A row a series: n, slope, intercept, mean and spread of t, residual error."""
    fit = series.groupBy("series").agg(
        F.count("value").alias("n"), F.regr_slope("value", "t").alias("slope"), F.regr_intercept("value", "t").alias("intercept"), F.avg("t").alias("t_mean"),
        F.regr_sxx("value", "t").alias("sxx"), F.regr_syy("value", "t").alias("syy"), F.regr_sxy("value", "t").alias("sxy"),
    )
    rest = F.greatest(F.lit(0.0), F.col("syy") - F.col("sxy") * F.col("sxy") / F.col("sxx"))
    return fit.withColumn("error", F.sqrt(rest / F.greatest(F.col("n") - 2, F.lit(1)))).withColumn("sxx", F.when(F.col("sxx") == 0, 1.0).otherwise(F.col("sxx")))


def linear_forecast(series: DataFrame, horizon: int, level: float = LEVEL, least: int = 3) -> DataFrame:
    """(series, step, point, lower, upper, slope) for series of at least ``least`` values."""
    fit = linear_fit(series).where(F.col("n") >= least)
    table = F.array(*[F.lit(q) for q in quantiles(level)])
    dof = F.greatest(F.col("n") - 2, F.lit(1))
    critical = F.get(table, (F.least(dof, F.size(table)) - 1).cast("int"))
    steps = fit.withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(horizon)))).withColumn("x", F.col("n") - 1 + F.col("step"))
    point = F.col("intercept") + F.col("slope") * F.col("x")
    margin = critical * F.col("error") * F.sqrt(1 + 1 / F.col("n") + F.pow(F.col("x") - F.col("t_mean"), F.lit(2)) / F.col("sxx"))
    return steps.select("series", "step", *[F.round(v, 2).alias(n) for n, v in (("point", point), ("lower", point - margin), ("upper", point + margin))], F.round("slope", 2).alias("slope"))


def arima_candidates(n: int) -> list[tuple[int, int, int, int]]:
    """(p, d, q, seasonal p) that are tried on n values."""
    plain = [(1, 1, 1, 0), (2, 1, 1, 0), (1, 1, 0, 0), (0, 1, 1, 0)]
    return plain + ([(1, 1, 1, 1), (0, 1, 1, 1)] if n >= 24 else [])


def _residuals(params: np.ndarray, d: np.ndarray, p: int, q: int, s: int) -> np.ndarray:
    """One-step errors of differences around their drift."""
    drift, ar, ma, sar = params[0], params[1 : 1 + p], params[1 + p : 1 + p + q], params[1 + p + q :]
    x, e = d - drift, np.zeros(len(d))
    for i in range(len(d)):
        guess = sum(ar[k] * x[i - 1 - k] for k in range(min(p, i))) + sum(ma[k] * e[i - 1 - k] for k in range(min(q, i)))
        if s and i >= 12:
            guess += sar[0] * x[i - 12]
        e[i] = x[i] - guess
    return e


def _fit(d: np.ndarray, p: int, q: int, s: int) -> tuple[np.ndarray, float, float]:
    """Parameters, error variance and AIC by conditional least squares (Gauss-Newton with damping)."""
    params = np.concatenate(([d.mean()], np.full(p + q + s, 0.05)))
    damping, e = 1e-2, _residuals(params, d, p, q, s)
    for _ in range(60):
        step = 1e-5 * np.maximum(1, np.abs(params))
        jac = np.column_stack([(_residuals(params + np.eye(len(params))[k] * step[k], d, p, q, s) - e) / step[k] for k in range(len(params))])
        normal = jac.T @ jac
        move = -np.linalg.solve(normal + damping * np.diag(np.diag(normal) + 1e-12), jac.T @ e)
        new = params + move
        new[1:] = np.clip(new[1:], -0.98, 0.98)
        tried = _residuals(new, d, p, q, s)
        if np.isfinite(tried).all() and tried @ tried < e @ e:
            done = (e @ e - tried @ tried) <= 1e-10 * (e @ e)
            params, e, damping = new, tried, damping / 3
            if done:
                break
        else:
            damping *= 4
            if damping > 1e8:
                break
    variance = max(float(e @ e) / len(d), 1e-12)
    return params, variance, len(d) * math.log(variance) + 2 * (len(params) + 1)


def arima(values: np.ndarray, horizon: int, level: float) -> tuple[str, np.ndarray, np.ndarray] | None:
    """(order, points, margins) of the candidate of least AIC; null for short series or where none can be fitted."""
    if len(values) < 8 or np.ptp(values) == 0:
        return None
    d = np.diff(values.astype(float))
    best = None
    for p, _, q, s in arima_candidates(len(values)):
        try:
            params, variance, aic = _fit(d, p, q, s)
        except (np.linalg.LinAlgError, FloatingPointError):
            continue
        if math.isfinite(aic) and (best is None or aic < best[0]):
            best = aic, (p, q, s), params, variance
    if best is None:
        return None
    _, (p, q, s), params, variance = best
    drift, ar, ma, sar = params[0], params[1 : 1 + p], params[1 + p : 1 + p + q], params[1 + p + q :]
    x, e = list(d - drift), list(_residuals(params, d, p, q, s))
    weights: list[float] = []
    for h in range(horizon):
        guess = sum(ar[k] * x[-1 - k] for k in range(min(p, len(x)))) + sum(ma[k] * e[-1 - k] for k in range(min(q, len(e)))) + (sar[0] * x[-12] if s and len(x) >= 12 else 0)
        weight = 1.0 if h == 0 else sum(ar[k] * weights[h - 1 - k] for k in range(min(p, h))) + (ma[h - 1] if h - 1 < q else 0) + (sar[0] * weights[h - 12] if s and h >= 12 else 0)
        x.append(guess)
        e.append(0.0)
        weights.append(weight)
    points = values[-1] + np.cumsum(np.array(x[-horizon:]) + drift)
    spread = np.sqrt(variance * np.cumsum(np.cumsum(weights) ** 2))
    z = t_quantile(0.5 + level / 2, 400)
    return f"({p},1,{q})" + ("(1,0,0,12)" if s else ""), points, z * spread


def arima_forecast(series: DataFrame, horizon: int, level: float = LEVEL) -> DataFrame:
    """(series, step, model, point, lower, upper); a series it cannot fit gets the trend's forecast, and says so."""

    def fit(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        found = arima(rows.sort_values("t")["value"].to_numpy(float), horizon, level)
        if found is None:
            return pd.DataFrame(columns=["series", "step", "model", "point", "lower", "upper"])
        order, points, margin = found
        return pd.DataFrame({"series": key[0], "step": range(1, horizon + 1), "model": f"arima{order}", "point": points.round(2), "lower": (points - margin).round(2), "upper": (points + margin).round(2)})

    fitted = series.groupBy("series").applyInPandas(fit, "series string, step int, model string, point double, lower double, upper double")
    rest = linear_forecast(series, horizon, level).join(fitted.select("series").distinct(), "series", "left_anti")
    return fitted.unionByName(rest.select("series", "step", F.lit("linear_fallback").alias("model"), "point", "lower", "upper"))


def forecast(series: DataFrame, horizon: int, level: float = LEVEL, non_negative: tuple[str, ...] = ()) -> DataFrame:
    """(series, step, model, point, lower, upper) of the trend, the autoregressive model and their mean.

    Values of the series named in ``non_negative`` stop at zero.
    """
    linear = linear_forecast(series, horizon, level).select("series", "step", F.lit("linear_regression").alias("model"), "point", "lower", "upper")
    other = arima_forecast(series, horizon, level).withColumn("model", F.lit("arima"))
    both = linear.unionByName(other)
    mean = both.groupBy("series", "step").agg(*[F.round(F.avg(c), 2).alias(c) for c in ("point", "lower", "upper")]).withColumn("model", F.lit("ensemble"))
    out = both.unionByName(mean)
    clip = F.col("series").isin(*non_negative) if non_negative else F.lit(False)
    return out.select("series", "step", "model", *[F.when(clip, F.greatest(F.lit(0.0), c)).otherwise(F.col(c)).alias(c) for c in ("point", "lower", "upper")])


def mape(actual: Column, predicted: Column) -> Column:
    """Aggregate: mean absolute percentage error over non-zero actual values."""
    return F.round(100 * F.avg(F.when(actual != 0, F.abs(actual - predicted) / F.abs(actual))), 2)


def origins(series: DataFrame, horizon: int, count: int, least: int = 8) -> tuple[DataFrame, DataFrame]:
    """Training rows and held-back rows of ``count`` cuts, each ``horizon`` earlier; series are named ``name@k``."""
    sized = series.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("series"))).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(count - 1))))
    cut = F.col("n") - horizon - F.col("k") * horizon
    sized = sized.withColumn("cut", cut).where(F.col("cut") >= least).withColumn("name", F.concat("series", F.lit("@"), "k"))
    train = sized.where("t < cut").select(F.col("name").alias("series"), "t", "value")
    held = sized.where((F.col("t") >= F.col("cut")) & (F.col("t") < F.col("cut") + horizon))
    return train, held.select(F.col("name").alias("series"), (F.col("t") - F.col("cut") + 1).cast("int").alias("step"), F.col("value").alias("actual"))


def rolling_backtest(series: DataFrame, horizon: int = 3, count: int = 4, models: str = "all") -> DataFrame:
    """(series, model, origins, mape, worst): mean and worst error over several cuts."""
    train, held = origins(series, horizon, count)
    made = forecast(train, horizon) if models == "all" else linear_forecast(train, horizon).withColumn("model", F.lit("linear_regression"))
    by_cut = made.join(held, ["series", "step"]).groupBy("series", "model").agg(mape(F.col("actual"), F.col("point")).alias("m"))
    return by_cut.groupBy(F.substring_index("series", "@", 1).alias("series"), "model").agg(F.count("m").alias("origins"), F.round(F.avg("m"), 2).alias("mape"), F.max("m").alias("worst"))


def backtest(series: DataFrame, holdout: int, models: str = "all") -> DataFrame:
    """(series, model, mape, coverage, meets_target): the last ``holdout`` values forecast from those before."""
    train, held = origins(series, holdout, 1)
    made = forecast(train, holdout) if models == "all" else linear_forecast(train, holdout).withColumn("model", F.lit("linear_regression"))
    inside = F.col("actual").between(F.col("lower"), F.col("upper")).cast("int")
    scored = made.join(held, ["series", "step"]).groupBy(F.substring_index("series", "@", 1).alias("series"), "model")
    out = scored.agg(mape(F.col("actual"), F.col("point")).alias("mape"), F.round(F.avg(inside), 2).alias("coverage"))
    return out.withColumn("meets_target", F.coalesce(F.col("mape") <= MAPE_TARGET, F.lit(False)))


def first_below_zero(value: Column, step: Column) -> Column:
    """Aggregate: the first step whose value is not above zero."""
    return F.min(F.when(value <= 0, step))


def runway(cash: DataFrame, horizon: int = RUNWAY_HORIZON, level: float = LEVEL) -> DataFrame:
    """One row: burn a month and the months until the balance (start, balance) is gone, by the trend of the last year."""
    recent = cash.orderBy(F.desc("start")).limit(RUNWAY_HISTORY)
    series = recent.select(F.lit("cash").alias("series"), (F.row_number().over(Window.orderBy("start")) - 1).alias("t"), F.col("balance").cast("double").alias("value"))
    made = linear_forecast(series, horizon, level)
    return made.agg(
        (-F.max("slope")).alias("monthly_burn"), first_below_zero(F.col("point"), F.col("step")).alias("months"),
        first_below_zero(F.col("lower"), F.col("step")).alias("pessimistic"), first_below_zero(F.col("upper"), F.col("step")).alias("optimistic"),
    ).where("monthly_burn IS NOT NULL")


def next_months(last: Column, horizon: int) -> Column:
    return F.sequence(F.add_months(last, 1), F.add_months(last, horizon), F.expr("interval 1 month"))


def cash_path(profits: DataFrame, cash: float, by: str = "path") -> DataFrame:
    """For each path of (step, profit): the balance at its end and the months until it is gone, beyond the end by its mean."""
    order = Window.partitionBy(by).orderBy("step")
    run = profits.withColumn("balance", F.lit(cash) + F.sum("profit").over(order))
    out = run.groupBy(by).agg(first_below_zero(F.col("balance"), F.col("step")).alias("out"), F.max_by("balance", "step").alias("end"), F.avg("profit").alias("mean"), F.max("step").alias("n"))
    later = F.when(F.col("mean") < 0, F.round(F.col("n") + F.col("end") / -F.col("mean"), 1))
    return out.select(by, F.round("end", 2).alias("ending_cash"), F.coalesce(F.col("out").cast("double"), later).alias("runway_months"), (F.col("mean") < 0).alias("burning_cash"))


@dataclass(frozen=True)
class Scenario:
    horizon: int = 6
    volume_change_pct: float = 0.0
    pricing_adjustment_pct: float = 0.0
    price_elasticity: float = 0.5
    headcount_change: int = 0
    baseline_headcount: int = 15
    vendor_consolidation_pct: float = 0.0
    other_cost_change_pct: float = 0.0


def scenario_months(baseline: DataFrame, scenarios: DataFrame, payroll: DataFrame) -> DataFrame:
    """Every scenario's months: baseline (step, revenue, expense) with its levers applied; payroll has share and monthly."""
    levers = scenarios.crossJoin(F.broadcast(payroll))  # one row
    price = F.col("pricing_adjustment_pct") / 100
    revenue = F.col("revenue") * (1 + F.col("volume_change_pct") / 100) * (1 + price) * (1 - F.col("price_elasticity") * price)
    head = F.when(F.col("baseline_headcount") != 0, F.col("monthly") / F.col("baseline_headcount")).otherwise(0.0)
    vendor = (1 - F.col("vendor_consolidation_pct") / 100) * (1 + F.col("other_cost_change_pct") / 100)
    expense = F.col("expense") * F.col("share") + F.col("headcount_change") * head + F.col("expense") * (1 - F.col("share")) * vendor
    rows = baseline.crossJoin(F.broadcast(levers))  # a few scenarios by at most 24 months
    return rows.where(F.col("step") <= F.least(F.greatest("horizon", F.lit(1)), F.lit(24))).select(
        "scenario", "step", F.round("revenue", 2).alias("base_revenue"), F.round("expense", 2).alias("base_expense"), F.round(F.col("revenue") - F.col("expense"), 2).alias("base_profit"),
        F.round(revenue, 2).alias("revenue"), F.round(expense, 2).alias("expense"), F.round(revenue - expense, 2).alias("profit"),
    )

"""A desk of scenarios: each session's changes of levers, folded in order.

A change sets the levers that it names and leaves the others; one that resets puts all
back but the horizon and the headcount that costs are counted by.  What stands after
each change is the last value since the last reset, so a session is a window and not a loop.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.operators.forecast import Scenario

# How far each lever goes, in order, and the horizons on offer.
LEVER_LIMITS = {
    "volume_change_pct": (-30, 30), "pricing_adjustment_pct": (-20, 20), "price_elasticity": (0, 2),
    "headcount_change": (-10, 10), "vendor_consolidation_pct": (0, 30), "other_cost_change_pct": (-20, 20),
}
HORIZONS = (3, 6, 12)
LIMIT = 24


def _said(number: Column) -> Column:
    return F.regexp_replace(F.round(number, 4).cast("string"), r"\.0$", "")


def nearest_horizon(months: Column) -> Column:
    """Of the horizons on offer the nearest one, the shorter of two."""
    away = F.array(*[F.struct(F.abs(F.lit(h) - months.cast("int")).alias("away"), F.lit(h).alias("h")) for h in HORIZONS])
    return F.when(months.isNotNull(), F.array_min(away)["h"])


def desk(changes: DataFrame) -> DataFrame:
    """(session, seq, the scenario's levers after the change, capped) from (session, seq, reset, horizon and levers, null where not named).

    Values beyond a lever's limits are cut to them, and ``capped`` says so.
    """
    start = Scenario()
    held = changes.withColumn("reset", F.coalesce("reset", F.lit(False)))
    clamped = {n: F.when(F.col(n).isNotNull(), F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), F.col(n).cast("double")))) for n, (low, high) in LEVER_LIMITS.items()}
    capped = [F.when(clamped[n] != F.col(n).cast("double"), F.concat(F.lit(f"{n} "), _said(F.col(n).cast("double")), F.lit(" capped to "), _said(clamped[n]))) for n in LEVER_LIMITS]
    kept = {n: F.bround(clamped[n], 0).cast("int") if n == "headcount_change" else F.bround(clamped[n], 2) for n in LEVER_LIMITS}
    order = Window.partitionBy("session").orderBy("seq")
    so_far = held.select(
        "session", "seq", nearest_horizon(F.col("horizon")).alias("horizon"), *[v.alias(n) for n, v in kept.items()], F.array_compact(F.array(*capped)).alias("capped"),
        F.sum(F.col("reset").cast("int")).over(order).alias("resets"),
    )
    since = Window.partitionBy("session", "resets").orderBy("seq")
    return so_far.select(
        "session", "seq", F.coalesce(F.last("horizon", ignorenulls=True).over(order), F.lit(start.horizon)).alias("horizon"),
        *[F.coalesce(F.last(n, ignorenulls=True).over(since), F.lit(getattr(start, n))).alias(n) for n in LEVER_LIMITS],
        F.lit(start.baseline_headcount).alias("baseline_headcount"), "capped",
    )


def on_screen(states: DataFrame) -> DataFrame:
    """Each session's scenario as its last change left it, with ``scenario`` its name for ``forecast.scenario_months``."""
    last = F.max_by(F.struct(*[c for c in states.columns if c != "session"]), "seq")
    return states.groupBy(F.col("session").alias("scenario")).agg(last.alias("s")).select("scenario", "s.*").drop("seq", "capped")


def effect(months: DataFrame) -> DataFrame:
    """(scenario, base_profit, profit, change, shown) from ``forecast.scenario_months``: sums over the horizon and the change as a share of the baseline."""
    sums = months.groupBy("scenario").agg(*[F.round(F.sum(c), 2).alias(c) for c in ("base_profit", "profit")])
    share = (F.col("profit") - F.col("base_profit")) / F.abs("base_profit")
    shown = F.when(F.col("base_profit") != 0, F.format_string("%+.1f%%", share * 100)).otherwise("n/a (baseline profit is zero)")
    return sums.withColumns({"change": F.round(F.col("profit") - F.col("base_profit"), 2), "shown": shown})

"""Levers of a session by hand."""

from pyspark.sql import functions as F

from tallywright.operators import forecast, scenario

LEVERS = list(scenario.LEVER_LIMITS)


def test_changes_are_folded(spark):
    rows = [
        ("a", 1, None, None, {"volume_change_pct": 45.0}), ("a", 2, False, 9, {"headcount_change": 2.5, "price_elasticity": -1.0}), ("a", 3, None, None, {}),
        ("a", 4, True, None, {"other_cost_change_pct": 1.005}), ("a", 5, None, 100, {"volume_change_pct": -3.0}), ("b", 1, True, 4, {}),
    ]
    schema = "session string, seq int, reset boolean, horizon int, " + ", ".join(f"{n} double" for n in LEVERS)
    made = spark.createDataFrame([(s, q, r, h, *[v.get(n) for n in LEVERS]) for s, q, r, h, v in rows], schema)
    got = {(r.session, r.seq): ([r.horizon, *[r[n] for n in LEVERS]], r.capped) for r in scenario.desk(made).collect()}
    assert got["a", 1] == ([6, 30.0, 0.0, 0.5, 0, 0.0, 0.0], ["volume_change_pct 45 capped to 30"])
    assert got["a", 2] == ([6, 30.0, 0.0, 0.0, 2, 0.0, 0.0], ["price_elasticity -1 capped to 0"]) and got["a", 3][0] == got["a", 2][0]
    assert got["a", 4][0][:6] == [6, 0.0, 0.0, 0.5, 0, 0.0] and got["a", 5][0][:2] == [12, -3.0] and got["b", 1][0][0] == 3
    last = {r.scenario: r for r in scenario.on_screen(scenario.desk(made)).collect()}
    assert (last["a"].horizon, last["a"].volume_change_pct, last["a"].baseline_headcount) == (12, -3.0, 15)


def test_effect(spark):
    base = spark.createDataFrame([(1, 100.0, 60.0), (2, 100.0, 60.0)], "step int, revenue double, expense double")
    payroll = spark.createDataFrame([(0.5, 30.0)], "share double, monthly double")
    change = spark.createDataFrame([("s", 1, False, 3, 10.0), ("z", 1, False, 3, None)], "session string, seq int, reset boolean, horizon int, volume_change_pct double")
    for name in LEVERS[1:]:
        change = change.withColumn(name, F.lit(None).cast("double"))
    months = forecast.scenario_months(base, scenario.on_screen(scenario.desk(change)), payroll)
    got = {r.scenario: (r.base_profit, r.profit, r.change, r.shown) for r in scenario.effect(months).collect()}
    assert got == {"s": (80.0, 100.0, 20.0, "+25.0%"), "z": (80.0, 80.0, 0.0, "+0.0%")}

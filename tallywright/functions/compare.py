"""Comparing two values: a struct of status, difference, percent and discrepancy type."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
AMOUNT_TOLERANCE, DATE_TOLERANCE, PAYMENT_TERMS = 2.0, 7, 120
SEVERITY = ("MATCHED", "AUTO_RESOLVED", "AMBIGUOUS", "MISSING", "ESCALATED")


def _result(status: Column, difference: Column, percent: Column, kind: Column) -> Column:
    return F.struct(
        status.alias("status"), difference.cast("double").alias("difference"), percent.cast("double").alias("percent"), kind.alias("discrepancy_type")
    )


def numeric(left: Column, right: Column, tolerance: float = AMOUNT_TOLERANCE, mismatch: str = "amount_mismatch") -> Column:
    """The right is the baseline, or the left where it is zero, or one; the percentage is rounded before it is judged."""
    difference = F.abs(left - right)
    base = F.when(right != 0, F.abs(right)).when(left != 0, F.abs(left)).otherwise(F.lit(1))
    percent = F.round(difference.cast("double") / base.cast("double") * 100, 2)
    none = left.isNull() | right.isNull()
    status = F.when(none, "MISSING").when(percent == 0, "MATCHED").when(percent <= tolerance, "AUTO_RESOLVED").otherwise("ESCALATED")
    kind = F.when(none, "missing_value").when(status == "AUTO_RESOLVED", "rounding_variance").when(status == "ESCALATED", mismatch)
    return _result(status, difference, percent, kind)


def exact(left: Column, right: Column) -> Column:
    none, null = left.isNull() | right.isNull(), F.lit(None)
    status = F.when(none, "MISSING").when(F.lower(F.trim(left)) == F.lower(F.trim(right)), "MATCHED").otherwise("ESCALATED")
    return _result(status, null, null, F.when(none, "missing_value").when(status == "ESCALATED", "exact_mismatch"))


def dates(left: Column, right: Column, left_type: Column, right_type: Column, tolerance: int = DATE_TOLERANCE, terms: int = PAYMENT_TERMS) -> Column:
    """Days from left to right; a payment may follow its invoice by its terms."""
    days = F.datediff(right, left)
    paid = ((left_type == "INVOICE") & (right_type == "PAYMENT")) | ((left_type == "PAYMENT") & (right_type == "INVOICE"))
    lag = F.when(left_type == "INVOICE", days).otherwise(-days)
    none = left.isNull() | right.isNull()
    status = (
        F.when(none, "MISSING").when(days == 0, "MATCHED").when(paid & lag.between(0, terms), "MATCHED").when(paid, "ESCALATED")
        .when(F.abs(days) <= tolerance, "AUTO_RESOLVED").otherwise("ESCALATED")
    )
    kind = F.when(none, "missing_value").when(status == "AUTO_RESOLVED", "date_variance").when((status == "ESCALATED") & paid, "payment_date_out_of_terms").when(status == "ESCALATED", "date_mismatch")
    return _result(status, days, F.lit(None), kind)


def entities(resolution: Column) -> Column:
    """From a resolution's status and score; null where either name is."""
    status = F.when(resolution["status"] == "RESOLVED", "MATCHED").otherwise("ESCALATED")
    kind = F.when(resolution["status"] == "AMBIGUOUS", "entity_alias").when(resolution["status"] != "RESOLVED", "entity_mismatch")
    return _result(status, F.lit(None), F.lit(None), kind)


def severity(status: Column) -> Column:
    return F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), status) - 1, F.lit(0))


def worst(statuses: Column) -> Column:
    """The most severe of an array of statuses; ``MATCHED`` for none."""
    top = F.array_max(F.transform(statuses, severity))
    return F.coalesce(F.get(F.array(*[F.lit(s) for s in SEVERITY]), top.cast("int")), F.lit("MATCHED"))


def money(x: Column) -> Column:
    """A number as text: two places, no trailing zero beyond the first."""
    return F.regexp_replace(F.format_string("%.2f", x.cast("double")), r"(\.\d)0$", "$1")


def explain(results: Column) -> Column:
    """What differs, in sentences; ``results`` are structs with field, left_value, right_value and a comparison's parts."""

    def say(r: Column) -> Column:
        percent = money(r["percent"])
        return (
            F.when(r["status"] == "MATCHED", F.lit(None).cast("string"))
            .when((r["field"] == "amount") & (r["status"] == "AUTO_RESOLVED"), F.concat(F.lit("Amounts differ by "), percent, F.lit("% — within tolerance, auto-resolved.")))
            .when((r["field"] == "amount") & (r["status"] == "ESCALATED"), F.concat(F.lit("Amounts differ by "), percent, F.lit("% ("), r["left_value"], F.lit(" vs "), r["right_value"], F.lit("), beyond tolerance.")))
            .when(r["status"] == "MISSING", F.concat(F.initcap(r["field"]), F.lit(" is missing on one side.")))
            .when(r["field"] == "date", F.concat(F.lit("Dates differ by "), F.abs(r["difference"]).cast("int").cast("string"), F.lit(" days.")))
            .when(r["field"] == "entity", F.concat(F.lit("Counterparty names differ ("), r["left_value"], F.lit(" vs "), r["right_value"], F.lit(").")))
        )

    said = F.array_compact(F.transform(results, say))
    return F.when(F.size(said) == 0, "All compared fields agree.").otherwise(F.array_join(said, " "))

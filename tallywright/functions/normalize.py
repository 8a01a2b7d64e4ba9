"""Normalising raw values: identifiers, labels, names, amounts, currencies, dates.

All are column expressions that Catalyst compiles; a value that cannot be read
gives null and never an error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed values.
MISSING = ("", "-", "n/a", "na", "none", "null", "unknown")
CURRENCY_NAMES = {
    "usd": "USD", "us dollar": "USD", "us dollars": "USD", "inr": "INR", "indian rupee": "INR", "indian rupees": "INR",
    "eur": "EUR", "euro": "EUR", "euros": "EUR", "gbp": "GBP", "pound": "GBP", "pounds": "GBP",
}
CURRENCY_SYMBOLS = {"₹": "INR", "€": "EUR", "£": "GBP"}
CURRENCY_CODE = r"(?i)\b(usd|inr|eur|gbp)\b"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")
NUMBER = r"[-+]?\d[\d\s,.]*"
OCR_LETTERS, OCR_DIGITS = "OQIL|", "00111"
KEY_SEPARATORS = r"[-_/.,:]"
TYPE_ALIASES = {
    "invoice": "INVOICE", "purchase order": "PURCHASE_ORDER", "po": "PURCHASE_ORDER", "payment": "PAYMENT", "payment memo": "PAYMENT",
    "receipt": "PAYMENT", "ledger": "LEDGER", "ledger entry": "LEDGER", "journal entry": "LEDGER",
}


def strip(value: Column) -> Column:
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def missing(value: Column) -> Column:
    """Whether a value says that there is none."""
    return value.isNull() | F.lower(strip(value)).isin(*MISSING)


def identifier(value: Column) -> Column:
    return F.when(~missing(value), F.upper(F.regexp_replace(value, r"\s+", "")))


def match_key(value: Column) -> Column:
    """What stays of an identifier that recognition may have damaged; null if nothing does."""
    key = F.translate(F.regexp_replace(identifier(value), KEY_SEPARATORS, ""), OCR_LETTERS, OCR_DIGITS)
    return F.when(key != "", key)


def label(value: Column) -> Column:
    """Lower case, look-alikes beside letters as letters, the rest as single blanks."""
    text = F.regexp_replace(F.lower(F.coalesce(value, F.lit(""))), r"[1!|](?=[a-z])|(?<=[a-z])[!|]", "i")
    text = F.regexp_replace(text, r"(?<=[a-z])0|0(?=[a-z])", "o")
    return F.btrim(F.regexp_replace(text, r"[^a-z0-9]+", " "))


def entity(value: Column) -> Column:
    """A name for comparison: lower case, words only, company forms alike."""
    words = F.regexp_replace(F.regexp_replace(F.lower(value), r"(?U)[^\w\s]", " "), r"\s+", " ")
    return F.when(~missing(value), F.regexp_replace(F.btrim(words), r"\b(incorporated|corporation)\b", "corp"))


def text(value: Column) -> Column:
    return F.when(~missing(value), F.lower(F.regexp_replace(strip(value), r"\s+", " ")))


def currency(value: Column) -> Column:
    """A code from a code, a name or a symbol; any three letters are a code."""
    own = F.lower(strip(value))
    known = F.create_map(*[F.lit(x) for pair in (CURRENCY_NAMES | CURRENCY_SYMBOLS).items() for x in pair])
    return F.when(~missing(value), F.coalesce(F.try_element_at(known, own), F.when(own.rlike("^[a-z]{3}$"), F.upper(own))))


def currency_in(value: Column, context: Column | None = None) -> Column:
    """The context's currency, else the first symbol of the list, else a code that stands in the text."""
    found = F.lit(None).cast("string") if context is None else currency(context)
    for symbol, code in CURRENCY_SYMBOLS.items():
        found = F.coalesce(found, F.when(value.contains(symbol), code))
    code = F.regexp_extract(value, CURRENCY_CODE, 1)
    return F.coalesce(found, F.when(code != "", currency(code)))


def number_token(value: Column) -> Column:
    """The first number of a text as it stands there, without blanks."""
    return F.replace(F.regexp_extract(strip(value), NUMBER, 0), F.lit(" "), F.lit(""))


def number(value: Column, token: Column | None = None) -> Column:
    """The first number of a text, whatever its separators mean; null where that is unclear. ``token`` is its ``number_token``, where that is a column already."""
    token = number_token(value) if token is None else token
    commas = F.length(token) - F.length(F.replace(token, F.lit(","), F.lit("")))
    dots = F.length(token) - F.length(F.replace(token, F.lit("."), F.lit("")))
    bare_commas, bare_dots = F.replace(token, F.lit(","), F.lit("")), F.replace(token, F.lit("."), F.lit(""))
    comma_last = F.locate(",", F.reverse(token)) < F.locate(".", F.reverse(token))
    both = F.when(comma_last & (commas == 1), F.replace(bare_dots, F.lit(","), F.lit("."))).when(~comma_last & (dots == 1), bare_commas)
    tail = F.element_at(F.split(token, ","), -1)
    only_commas = F.when((commas > 1) | (F.length(tail) == 3), bare_commas).otherwise(F.replace(token, F.lit(","), F.lit(".")))
    threes = F.forall(F.slice(F.split(token, r"\."), F.lit(2), dots), lambda part: F.length(part) == 3)
    plain = F.when((commas > 0) & (dots > 0), both).when(commas > 0, only_commas).when(dots > 1, F.when(threes, bare_dots)).otherwise(token)
    return F.when(token != "", plain.try_cast("double"))


def amount(value: Column, context: Column | None = None, parsed: Column | None = None, none: Column | None = None) -> Column:
    """A struct of value, status (success, missing, invalid) and currency; ``parsed`` and ``none`` are the number and whether it is missing, where those are columns already."""
    parsed, none = number(value) if parsed is None else parsed, missing(value) if none is None else none
    status = F.when(none, "missing").when(parsed.isNull(), "invalid").otherwise("success")
    return F.struct(
        F.when(status == "success", parsed).alias("value"), status.alias("status"), F.when(status == "success", currency_in(value, context)).alias("currency")
    )


def _month(name: Column) -> Column:
    """A month's number by its English name or the first three letters of it."""
    known = {k: i for i, m in enumerate(MONTHS, 1) for k in (m, m[:3])}
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in known.items() for x in pair]), name)


def date_text(value: Column) -> Column:
    """What dates are read from: lower case, single blanks."""
    return F.lower(F.regexp_replace(strip(value), r"\s+", " "))


def date(value: Column, own: Column | None = None) -> Column:
    """A struct of value and status; day and month must be told apart by one of them being over 12.

    Patterns decide what a text is and make it year, month, day, which one cast reads: nothing fails on the way.
    ``own`` is its ``date_text``, where that is a column already.
    """
    own = date_text(value) if own is None else own
    slashed = [F.regexp_extract(own, r"^(\d{1,2})[/-](\d{1,2})[/-](\d{4})$", n).try_cast("int") for n in (1, 2, 3)]
    first, second, year = slashed
    ordered = F.when(first > 12, F.concat_ws("-", year, second, first)).when(second > 12, F.concat_ws("-", year, first, second))
    month_first, day_first = r"^([a-z]{3,}) (\d{1,2}) (\d{4})$", r"^(\d{1,2}) ([a-z]{3,}) (\d{4})$"
    part = lambda pattern, n: F.regexp_extract(own, pattern, n)
    text = (
        F.when(own.rlike(r"^\d{4}-\d{1,2}-\d{1,2}$"), own).when(own.rlike(r"^\d{1,2}[/-]"), ordered)
        .when(own.rlike(month_first), F.concat(part(month_first, 3), F.lit("-"), _month(part(month_first, 1)), F.lit("-"), part(month_first, 2)))
        .when(own.rlike(day_first), F.concat(part(day_first, 3), F.lit("-"), _month(part(day_first, 2)), F.lit("-"), part(day_first, 1)))
    )
    read = F.transform(F.array(text.try_cast("date")), lambda day: F.struct(
        F.when(~missing(value), day).alias("value"), F.when(missing(value), "missing").when(day.isNull(), "invalid").otherwise("success").alias("status")
    ))
    return F.get(read, F.lit(0))


COUNTED = ("AMOUNT", "UNIT_PRICE", "QUANTITY")


def string(raw: Column, kind: Column) -> Column:
    """A name, identifier, currency or text, by semantic type in upper case."""
    return F.when(kind == "ENTITY", entity(raw)).when(kind == "IDENTIFIER", identifier(raw)).when(kind == "CURRENCY", currency(raw)).when(kind.isin("TEXT", "ADDRESS"), text(raw))


def _value(kind: Column, money: Column, day: Column, texts: Column, none: Column) -> Column:
    counted = kind.isin(*COUNTED)
    plain = F.when(none, "missing").when(texts.isNull(), "invalid").otherwise("success")
    status = F.when(counted, money["status"]).when(kind == "DATE", day["status"]).when(kind.isin("ENTITY", "IDENTIFIER", "CURRENCY", "TEXT", "ADDRESS"), plain)
    return F.struct(
        F.when(counted, money["value"]).alias("number"), F.when(kind == "DATE", day["value"]).alias("date"), texts.alias("string"),
        F.coalesce(status, F.lit("unsupported")).alias("status"), F.when(kind.isin("AMOUNT", "UNIT_PRICE"), money["currency"]).alias("currency"),
    )


def value(raw: Column, semantic_type: Column, context: Column | None = None) -> Column:
    """A struct of number, date, string, status and currency, by semantic type."""
    kind = F.upper(semantic_type)
    return _value(kind, amount(raw, context), date(raw), string(raw, kind), missing(raw))


def with_value(rows: DataFrame, raw: str, semantic_type: str, known: Column, name: str = "normal") -> DataFrame:
    """``rows`` with ``value`` of the columns ``raw`` and ``semantic_type`` where ``known``, else null.

    Its parts become columns one after the other, since an expression that several branches read is evaluated in each of them.
    """
    kind, held, taken = F.upper(semantic_type), F.col(raw), lambda part: F.col(f"{name}_{part}")
    rows = rows.withColumns({
        f"{name}_none": F.when(known, missing(held)), f"{name}_token": F.when(known & kind.isin(*COUNTED), number_token(held)),
        f"{name}_own": F.when(known & (kind == "DATE"), date_text(held)), f"{name}_texts": F.when(known, string(held, kind)),
    })
    rows = rows.withColumns({f"{name}_parsed": number(held, taken("token")), f"{name}_day": F.when(kind == "DATE", date(held, taken("own")))})
    made = _value(kind, amount(held, None, taken("parsed"), taken("none")), taken("day"), taken("texts"), taken("none"))
    return rows.withColumn(name, F.when(known, made)).drop(*(f"{name}_{part}" for part in ("none", "token", "own", "texts", "parsed", "day")))


def correction_amount(raw: Column) -> Column:
    """A reviewer's amount without separators and sign; null if it is none."""
    return F.abs(F.regexp_replace(raw, "[,$]", "").try_cast("double"))


def document_type(explicit: Column, stated: Column, labels: Column, heading: Column) -> Column:
    """The explicit type, else the one a field states, else what labels or the heading say; inputs are raw."""
    return type_of(label(explicit), label(stated), label(labels), label(heading))


def type_of(named: Column, said: Column, seen: Column, top: Column) -> Column:
    """As ``document_type``, of what ``label`` makes of each; best of columns, since each is read many times."""
    own = F.when(named == "", F.lit(None)).otherwise(F.upper(F.replace(named, F.lit(" "), F.lit("_"))))
    aliases = F.create_map(*[F.lit(x) for pair in TYPE_ALIASES.items() for x in pair])
    ladder = (
        F.when(seen.contains("purchase order") | seen.contains("po number"), "PURCHASE_ORDER").when(seen.contains("payment") | seen.contains("amount paid"), "PAYMENT")
        .when(seen.contains("invoice") | seen.contains("balance due"), "INVOICE").when(seen.contains("ledger"), "LEDGER")
        .when(top.contains("purchase order"), "PURCHASE_ORDER").when(top.contains("payment advice") | top.contains("receipt"), "PAYMENT")
        .when(top.contains("invoice"), "INVOICE").otherwise("UNKNOWN")
    )
    return F.coalesce(F.when(own.isin("INVOICE", "PURCHASE_ORDER", "PAYMENT", "LEDGER", "UNKNOWN"), own), F.try_element_at(aliases, said), ladder)


def squash(value: Column) -> Column:
    return F.lower(F.regexp_replace(value, r"[\s,]+", ""))


def agreement(value: Column, other: Column) -> Column:
    """Whether the other reading holds the value; null when that cannot be said."""
    return F.when((value != "") & (other != ""), squash(other).contains(squash(value)))


def title(value: Column, length: int = 48) -> Column:
    """A text as one line of limited length."""
    return F.substring(F.btrim(F.regexp_replace(value, r"\s+", " ")), 1, length)


def token_jaccard(left: Column, right: Column) -> Column:
    a, b = F.split(label(left), " "), F.split(label(right), " ")
    return F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))

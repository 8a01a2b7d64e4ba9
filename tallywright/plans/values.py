"""Normalising and comparing single values; raw spellings are made from order keys."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions import compare, normalize, similarity
from tallywright.plans.base import query
from tallywright.sources import tables as t

IDENTIFIERS = ["ORD-2012-@", " ord 2012 @ ", "0RD/2O12.@", "INV-5D@", "INV-S0@", "Q|@-l", "--", "n/a", "AB8@", "ABB@"]
MISSES = ["", "-", " N/A ", "na", "None", "NULL", "unknown ", "@", "none of it", "0"]
LABELS = ["Order 1D", "T0tal Am0unt", "!nvoice N|umber", "Discount (20%)", "Invoice Date", "  Balance__Due ", "Ord3r 100", "Pa1d b!"]
NAMES = ["Ab@c  Corporation, Ltd.", "Smith & Sons Incorporated", " N/A ", "O'Neil-Meyer (@)", "acme corp", "ACME  CORPORATION"]
AMOUNTS = ["$1,@50.00", "EUR @,5", "1.234.@", "1.23.4", "@ usd", "12.345,@7", "n/a", "not money", "£ 10 @", "-@.50", "€1,234,567", "1,2.3,@"]
DATES = ["2012-7-@", "Jul @ 2012", "@ march 2013", "September  @ 2014", "01/02/2012", "13/@/2012", "@/2@/2012", "n/a", "soon", "2012-02-30", "31 Apr 2012"]
CURRENCIES = ["usd", " EURO ", "₹", "$", "chf", "pounds", "n/a", "Indian Rupee", "dollars"]
CORRECTIONS = ["$1,@00", "-@.5", "abc", "", "12@"]


def _pick(values: list[str], key: Column) -> Column:
    """The key's spelling; ``@`` stands for its digits from 1 to 9."""
    own = F.get(F.array(*[F.lit(v) for v in values]), (key % len(values)).cast("int"))
    return F.replace(own, F.lit("@"), (key % 9 + 1).cast("string"))


def _orders(spark: SparkSession, sf_dir: str, values: list[str]) -> DataFrame:
    return t.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), _pick(values, F.col("o_orderkey")).alias("raw"))


def _raw(values: list[str]) -> str:
    listed = ", ".join("'" + v.replace("'", "''") + "'" for v in values)
    return f"r AS (SELECT o_orderkey AS id, replace(([{listed}])[(o_orderkey % {len(values)} + 1)::INTEGER], '@', (o_orderkey % 9 + 1)::VARCHAR) AS raw FROM orders)"


_STRIP = "regexp_replace(raw, '^\\s+|\\s+$', '', 'g')"
_MISS = f"(raw IS NULL OR lower({_STRIP}) IN ('', '-', 'n/a', 'na', 'none', 'null', 'unknown'))"
_LABEL = "trim(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(raw), '[1!|]([a-z])', 'i\\1', 'g'), '([a-z])[!|]', '\\1i', 'g'), '([a-z])0', '\\1o', 'g'), '0([a-z])', 'o\\1', 'g'), '[^a-z0-9]+', ' ', 'g'))"


@query(f"""WITH {_raw(IDENTIFIERS)}, u AS (SELECT id, raw, CASE WHEN NOT {_MISS} THEN upper(regexp_replace(raw, '\\s+', '', 'g')) END AS identifier FROM r)
SELECT id, identifier, nullif(translate(regexp_replace(identifier, '[-_/.,:]', '', 'g'), 'OQIL|', '00111'), '') AS key FROM u""")
def identifier_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, IDENTIFIERS).select("id", normalize.identifier(F.col("raw")).alias("identifier"), normalize.match_key(F.col("raw")).alias("key"))


@query(f"WITH {_raw(MISSES)} SELECT id, {_MISS} AS missing FROM r")
def missing_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, MISSES).select("id", normalize.missing(F.col("raw")).alias("missing"))


@query(f"WITH {_raw(LABELS)} SELECT id, {_LABEL} AS label FROM r")
def normalized_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, LABELS).select("id", normalize.label(F.col("raw")).alias("label"))


@query(f"""WITH {_raw(NAMES)} SELECT id, CASE WHEN NOT {_MISS} THEN regexp_replace(trim(regexp_replace(regexp_replace(lower(raw), '[^\\w\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '\\b(incorporated|corporation)\\b', 'corp', 'g') END AS entity,
CASE WHEN NOT {_MISS} THEN lower(regexp_replace({_STRIP}, '\\s+', ' ', 'g')) END AS text FROM r""")
def normalized_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, NAMES).select("id", normalize.entity(F.col("raw")).alias("entity"), normalize.text(F.col("raw")).alias("text"))


@query(f"""WITH {_raw(AMOUNTS)}, k AS (SELECT id, raw, replace(regexp_extract({_STRIP}, '[-+]?\\d[\\d\\s,.]*'), ' ', '') AS tok FROM r),
c AS (SELECT *, length(tok) - length(replace(tok, ',', '')) AS commas, length(tok) - length(replace(tok, '.', '')) AS dots,
  length(tok) - strpos(reverse(tok), ',') AS lc, length(tok) - strpos(reverse(tok), '.') AS ld, string_split(tok, ',') AS cs, string_split(tok, '.') AS ds FROM k),
p AS (SELECT id, raw, CASE WHEN tok = '' THEN NULL
  WHEN commas > 0 AND dots > 0 THEN CASE WHEN lc > ld THEN CASE WHEN commas = 1 THEN replace(replace(tok, '.', ''), ',', '.') END ELSE CASE WHEN dots = 1 THEN replace(tok, ',', '') END END
  WHEN commas > 0 THEN CASE WHEN commas > 1 OR length(cs[-1]) = 3 THEN replace(tok, ',', '') ELSE replace(tok, ',', '.') END
  WHEN dots > 1 THEN CASE WHEN len(list_filter(ds[2:], lambda x: length(x) <> 3)) = 0 THEN replace(tok, '.', '') END ELSE tok END AS num FROM c),
v AS (SELECT id, raw, TRY_CAST(num AS DOUBLE) AS number, CASE WHEN {_MISS} THEN 'missing' WHEN TRY_CAST(num AS DOUBLE) IS NULL THEN 'invalid' ELSE 'success' END AS status FROM p)
SELECT id, CASE WHEN status = 'success' THEN number END AS amount, status, CASE WHEN status = 'success' THEN CASE WHEN contains(raw, '₹') THEN 'INR' WHEN contains(raw, '€') THEN 'EUR' WHEN contains(raw, '£') THEN 'GBP'
  ELSE nullif(upper(regexp_extract(raw, '(?i)\\b(usd|inr|eur|gbp)\\b', 1)), '') END END AS currency FROM v""")
def parse_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _orders(spark, sf_dir, AMOUNTS).select("id", normalize.amount(F.col("raw")).alias("a"))
    return got.select("id", F.col("a.value").alias("amount"), "a.status", "a.currency")


@query(f"""WITH {_raw(DATES)}, k AS (SELECT id, raw, regexp_replace({_STRIP}, '\\s+', ' ', 'g') AS own FROM r),
g AS (SELECT *, TRY_CAST(regexp_extract(own, '^(\\d{{1,2}})[/-](\\d{{1,2}})[/-](\\d{{4}})$', 1) AS INT) AS a, TRY_CAST(regexp_extract(own, '^(\\d{{1,2}})[/-](\\d{{1,2}})[/-](\\d{{4}})$', 2) AS INT) AS b,
  regexp_extract(own, '^(\\d{{1,2}})[/-](\\d{{1,2}})[/-](\\d{{4}})$', 3) AS y FROM k),
d AS (SELECT id, raw, coalesce(try_strptime(own, '%Y-%m-%d'), try_strptime(own, '%b %d %Y'), try_strptime(own, '%B %d %Y'), try_strptime(own, '%d %b %Y'), try_strptime(own, '%d %B %Y'),
  CASE WHEN a > 12 THEN try_strptime(y || '-' || b || '-' || a, '%Y-%m-%d') WHEN b > 12 THEN try_strptime(y || '-' || a || '-' || b, '%Y-%m-%d') END)::DATE AS date FROM g)
SELECT id, CASE WHEN NOT {_MISS} THEN date END AS date, CASE WHEN {_MISS} THEN 'missing' WHEN date IS NULL THEN 'invalid' ELSE 'success' END AS status FROM d""")
def parse_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _orders(spark, sf_dir, DATES).select("id", normalize.date(F.col("raw")).alias("d"))
    return got.select("id", F.col("d.value").alias("date"), "d.status")


@query(f"""WITH {_raw(CURRENCIES)}, k AS (SELECT id, raw, lower({_STRIP}) AS own FROM r)
SELECT id, CASE WHEN NOT {_MISS} THEN CASE WHEN own IN ('usd', 'us dollar', 'us dollars') THEN 'USD' WHEN own IN ('inr', 'indian rupee', 'indian rupees', '₹') THEN 'INR'
 WHEN own IN ('eur', 'euro', 'euros', '€') THEN 'EUR' WHEN own IN ('gbp', 'pound', 'pounds', '£') THEN 'GBP' WHEN regexp_full_match(own, '[a-z]{{3}}') THEN upper(own) END END AS currency FROM k""")
def normalized_currencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, CURRENCIES).select("id", normalize.currency(F.col("raw")).alias("currency"))


@query(f"WITH {_raw(CORRECTIONS)} SELECT id, abs(TRY_CAST(regexp_replace(raw, '[,$]', '', 'g') AS DOUBLE)) AS amount FROM r")
def correction_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _orders(spark, sf_dir, CORRECTIONS).select("id", normalize.correction_amount(F.col("raw")).alias("amount"))


_TYPED = """SELECT id, kind, CASE WHEN kind IN ('AMOUNT', 'QUANTITY') THEN status WHEN kind = 'COLOUR' THEN 'unsupported' ELSE CASE WHEN missing THEN 'missing' WHEN string IS NULL THEN 'invalid' ELSE 'success' END END AS status,
CASE WHEN kind IN ('AMOUNT', 'QUANTITY') THEN number END AS number, string FROM"""


@query(f"""WITH {_raw(MISSES)}, k AS (SELECT id, raw, (['IDENTIFIER', 'TEXT', 'COLOUR', 'QUANTITY'])[(id // 16 % 4 + 1)::INTEGER] AS kind, {_MISS} AS missing FROM r),
n AS (SELECT *, TRY_CAST(nullif(regexp_extract({_STRIP}, '[-+]?\\d[\\d\\s,.]*'), '') AS DOUBLE) AS v FROM k),
s AS (SELECT *, CASE WHEN missing THEN 'missing' WHEN v IS NULL THEN 'invalid' ELSE 'success' END AS status, CASE WHEN NOT missing THEN v END AS number,
  CASE WHEN NOT missing THEN CASE kind WHEN 'IDENTIFIER' THEN upper(regexp_replace(raw, '\\s+', '', 'g')) WHEN 'TEXT' THEN lower(regexp_replace({_STRIP}, '\\s+', ' ', 'g')) END END AS string FROM n)
{_TYPED} s""")
def normalized_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values normalised by their semantic type."""
    kinds = F.get(F.array(*[F.lit(k) for k in ("IDENTIFIER", "TEXT", "COLOUR", "QUANTITY")]), F.floor(F.col("id") / 16).cast("int") % 4)
    got = _orders(spark, sf_dir, MISSES).withColumn("kind", kinds).withColumn("v", normalize.value(F.col("raw"), F.col("kind")))
    return got.select("id", "kind", "v.status", "v.number", "v.string")


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Amounts beside amounts that are off by nothing, 2.00 %, 2.004 % and more; some null or zero."""
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    left = F.when(key % 13 == 0, F.lit(0)).when(key % 17 == 0, F.lit(None)).otherwise(price).cast("decimal(18,4)")
    factor = F.get(F.array(*[F.lit(x).cast("decimal(7,5)") for x in ("1.0", "0.98", "1.02", "1.02004", "1.00004", "1.5")]), (key % 6).cast("int"))
    right = F.when(key % 26 == 0, F.lit(0)).when(key % 19 == 0, F.lit(None)).otherwise(price * factor).cast("decimal(18,4)")
    return t.table(spark, sf_dir, "orders").select(key.alias("id"), left.alias("l"), right.alias("r"))


_PAIRS = """p AS (SELECT o_orderkey AS id, (CASE WHEN o_orderkey % 13 = 0 THEN 0 WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice::DECIMAL(18,2) END)::DECIMAL(18,4) AS l,
 (CASE WHEN o_orderkey % 26 = 0 THEN 0 WHEN o_orderkey % 19 = 0 THEN NULL ELSE o_totalprice::DECIMAL(18,2) * (([1.0, 0.98, 1.02, 1.02004, 1.00004, 1.5])[(o_orderkey % 6 + 1)::INTEGER])::DECIMAL(7,5) END)::DECIMAL(18,4) AS r FROM orders)"""


@query(f"""WITH {_PAIRS}, d AS (SELECT id, l, r, abs(l - r)::DOUBLE AS difference, round(abs(l - r)::DOUBLE / (CASE WHEN r <> 0 THEN abs(r) WHEN l <> 0 THEN abs(l) ELSE 1 END)::DOUBLE * 100, 2) AS percent FROM p)
SELECT id, difference, percent, CASE WHEN percent IS NULL THEN 'MISSING' WHEN percent = 0 THEN 'MATCHED' WHEN percent <= 2 THEN 'AUTO_RESOLVED' ELSE 'ESCALATED' END AS status,
CASE WHEN percent IS NULL THEN 'missing_value' WHEN percent = 0 THEN NULL WHEN percent <= 2 THEN 'rounding_variance' ELSE 'amount_mismatch' END AS discrepancy_type FROM d""")
def compare_amounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).select("id", compare.numeric(F.col("l"), F.col("r")).alias("c")).select("id", "c.difference", "c.percent", "c.status", "c.discrepancy_type")


@query(f"""WITH {_raw(NAMES)}, k AS (SELECT id, raw, CASE WHEN id % 4 = 0 THEN NULL WHEN id % 4 = 1 THEN upper(raw) ELSE 'acme corp ' END AS other FROM r)
SELECT id, CASE WHEN other IS NULL THEN 'MISSING' WHEN lower(trim(raw)) = lower(trim(other)) THEN 'MATCHED' ELSE 'ESCALATED' END AS status FROM k""")
def compare_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    other = F.when(F.col("id") % 4 == 0, F.lit(None)).when(F.col("id") % 4 == 1, F.upper("raw")).otherwise("acme corp ")
    return _orders(spark, sf_dir, NAMES).select("id", compare.exact(F.col("raw"), other)["status"].alias("status"))


@query("""WITH p AS (SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS l, CASE WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) + (([0, 7, 8, -7, 120, 121, -1])[(o_orderkey % 7 + 1)::INTEGER])::INTEGER END AS r,
 o_orderkey % 3 = 0 AS paid FROM orders)
SELECT id, datediff('day', l, r)::DOUBLE AS days, CASE WHEN r IS NULL THEN 'MISSING' WHEN l = r THEN 'MATCHED' WHEN paid AND r - l BETWEEN 0 AND 120 THEN 'MATCHED' WHEN paid THEN 'ESCALATED' WHEN abs(r - l) <= 7 THEN 'AUTO_RESOLVED' ELSE 'ESCALATED' END AS status,
CASE WHEN r IS NULL THEN 'missing_value' WHEN l = r OR paid AND r - l BETWEEN 0 AND 120 THEN NULL WHEN paid THEN 'payment_date_out_of_terms' WHEN abs(r - l) <= 7 THEN 'date_variance' ELSE 'date_mismatch' END AS discrepancy_type FROM p""")
def compare_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, date = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    lag = F.get(F.array(*[F.lit(x) for x in (0, 7, 8, -7, 120, 121, -1)]), (key % 7).cast("int"))
    rows = t.table(spark, sf_dir, "orders").select(key.alias("id"), date.alias("l"), F.when(key % 11 != 0, F.date_add(date, lag)).alias("r"), F.when(key % 3 == 0, "PAYMENT").otherwise("LEDGER").alias("kind"))
    got = rows.select("id", compare.dates(F.col("l"), F.col("r"), F.lit("INVOICE"), F.col("kind")).alias("c"))
    return got.select("id", F.col("c.difference").alias("days"), "c.status", "c.discrepancy_type")


def _name_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Part names of neighbouring keys, some with words in another order, cut short or with more words."""
    parts = t.table(spark, sf_dir, "part").select("p_partkey", "p_name")
    other = parts.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_name").alias("next"))
    key, left = F.col("p_partkey"), F.concat_ws(" ", "p_name", "next")
    turned = F.array_join(F.reverse(F.split(left, " ")), " ")
    right = F.when(key % 5 == 0, turned).when(key % 5 == 1, F.expr("substring(concat_ws(' ', p_name, next), 1, length(concat_ws(' ', p_name, next)) - 1)")).when(key % 5 == 2, F.concat(left, F.lit(" india"))).when(key % 5 == 3, left).otherwise(F.concat_ws(" ", "next", F.lit("limited")))
    return parts.join(other, "p_partkey").select(key.alias("id"), left.alias("l"), right.alias("r"))


_NAMED = """n AS (SELECT a.p_partkey AS id, a.p_name || ' ' || b.p_name AS l, b.p_name AS nxt FROM part a JOIN part b ON b.p_partkey = a.p_partkey + 1),
p AS (SELECT id, l, CASE id % 5 WHEN 0 THEN array_to_string(list_reverse(string_split(l, ' ')), ' ') WHEN 1 THEN substr(l, 1, length(l) - 1) WHEN 2 THEN l || ' india' WHEN 3 THEN l ELSE nxt || ' limited' END AS r FROM n),
s AS (SELECT id, l, r, round(greatest(jaro_winkler_similarity(l, r), jaro_winkler_similarity(array_to_string(list_sort(string_split(l, ' ')), ' '), array_to_string(list_sort(string_split(r, ' ')), ' '))), 3) AS score,
  string_split(l, ' ') AS lt, string_split(r, ' ') AS rt FROM p),
c AS (SELECT id, l, r, score, (len(list_filter(lt, lambda x: len(list_filter(rt, lambda y: jaro_winkler_similarity(x, y) >= 0.9)) > 0)) + len(list_filter(rt, lambda y: len(list_filter(lt, lambda x: jaro_winkler_similarity(x, y) >= 0.9)) > 0)))::DOUBLE / (len(lt) + len(rt)) AS cov FROM s),
e AS (SELECT id, CASE WHEN l = r THEN 'RESOLVED' WHEN score >= 0.9 AND cov = 1 THEN 'RESOLVED' WHEN score >= 0.7 AND cov > 0.5 THEN 'AMBIGUOUS' ELSE 'UNRESOLVED' END AS status, CASE WHEN l = r THEN 1.0 ELSE score END AS score,
  CASE WHEN l = r THEN 'exact_normalized' ELSE 'fuzzy' END AS method FROM c)"""


@query(f"WITH {_NAMED} SELECT id, status, round(score, 3) AS score, method FROM e")
def entity_resolution(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _name_pairs(spark, sf_dir).select("id", similarity.resolve(F.col("l"), F.col("r")).alias("e"))
    return got.select("id", "e.status", F.round("e.score", 3).alias("score"), "e.method")


@query(f"WITH {_NAMED} SELECT id, CASE WHEN status = 'RESOLVED' THEN 'MATCHED' ELSE 'ESCALATED' END AS status, CASE status WHEN 'AMBIGUOUS' THEN 'entity_alias' WHEN 'UNRESOLVED' THEN 'entity_mismatch' END AS discrepancy_type FROM e")
def compare_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = _name_pairs(spark, sf_dir).select("id", compare.entities(similarity.resolve(F.col("l"), F.col("r"))).alias("c"))
    return got.select("id", "c.status", "c.discrepancy_type")


@query(f"WITH {_NAMED} SELECT id, round(len(list_intersect(string_split(l, ' '), string_split(r, ' ')))::DOUBLE / len(list_distinct(list_concat(string_split(l, ' '), string_split(r, ' ')))), 4) AS jaccard FROM p")
def label_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_pairs(spark, sf_dir).select("id", F.round(normalize.token_jaccard(F.col("l"), F.col("r")), 4).alias("jaccard"))


@query()
def label_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _name_pairs(spark, sf_dir).select("id", similarity.label_similarity(F.col("l"), F.col("r"), ("limited",)).alias("similarity"))


@query("""WITH p AS (SELECT o_orderkey AS id, o_orderkey % 5 = 0 AS same_id, o_orderkey % 2 = 0 AS same_vendor, o_orderkey % 3 = 0 AS same_date, o_totalprice::DECIMAL(18,2) AS l,
 (o_totalprice::DECIMAL(18,2) * (CASE WHEN o_orderkey % 7 < 4 THEN 1.01 ELSE 1.1 END)::DECIMAL(3,2)) AS r FROM orders),
s AS (SELECT id, CASE WHEN same_id THEN 1.0 ELSE round(0.45 * same_vendor::INT + 0.3 * same_date::INT + 0.25 * (abs(l - r) <= greatest(l, r, 1) * 0.02)::INT, 2) END AS score FROM p)
SELECT id, score >= 0.7 AS linked, score::DOUBLE AS score FROM s""")
def legacy_link(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, price = F.col("o_orderkey"), F.col("o_totalprice").cast("decimal(18,2)")
    left = F.struct(key.cast("string").alias("identifier"), F.lit("V").alias("vendor"), F.lit("d").alias("date"), price.alias("amount"))
    mark = lambda every, value, other: F.when(key % every == 0, value).otherwise(other)
    factor = F.when(key % 7 < 4, F.lit("1.01")).otherwise(F.lit("1.10")).cast("decimal(3,2)")
    right = F.struct(mark(5, key.cast("string"), F.lit("x")).alias("identifier"), mark(2, F.lit("v"), F.lit("w")).alias("vendor"), mark(3, F.lit("d"), F.lit("e")).alias("date"), (price * factor).alias("amount"))
    got = t.table(spark, sf_dir, "orders").select(key.alias("id"), left.alias("l"), right.alias("r")).select("id", legacy_score(F.col("l"), F.col("r")).alias("score"))
    return got.select("id", (F.col("score") >= 0.7).alias("linked"), "score")


def legacy_score(left: Column, right: Column) -> Column:
    """Likeness of two records: 1 for equal identifiers, else parts for vendor, date and amounts within 2 %."""
    same = lambda n: F.coalesce(F.lower(left[n]) == F.lower(right[n]), F.lit(False))
    near = F.coalesce(F.abs(left["amount"] - right["amount"]) <= F.greatest(left["amount"], right["amount"], F.lit(1)) * F.lit("0.02").cast("decimal(3,2)"), F.lit(False))
    score = F.when(same("vendor"), 0.45).otherwise(0.0) + F.when(same("date"), 0.3).otherwise(0.0) + F.when(near, 0.25).otherwise(0.0)
    return F.when(same("identifier"), 1.0).otherwise(F.round(score, 2))


@query("""WITH d AS (SELECT o_orderkey AS id, ([NULL, 'Purchase Order', 'weird', NULL])[(o_orderkey % 4 + 1)::INTEGER] AS explicit, ([NULL, 'PO', 'Journal Entry', NULL, NULL])[(o_orderkey % 5 + 1)::INTEGER] AS stated,
 (['due date', 'Payment Terms', 'Balance Due', 'PO Number', 'ledger page', 'x', 'y'])[(o_orderkey % 7 + 1)::INTEGER] AS labels, (['Receipt 12', 'TAX INVOICE', 'letter'])[(o_orderkey % 3 + 1)::INTEGER] AS heading FROM orders)
SELECT id, CASE WHEN explicit = 'Purchase Order' THEN 'PURCHASE_ORDER' WHEN stated = 'PO' THEN 'PURCHASE_ORDER' WHEN stated = 'Journal Entry' THEN 'LEDGER' WHEN labels = 'PO Number' THEN 'PURCHASE_ORDER' WHEN labels = 'Payment Terms' THEN 'PAYMENT'
 WHEN labels = 'Balance Due' THEN 'INVOICE' WHEN labels = 'ledger page' THEN 'LEDGER' WHEN heading = 'Receipt 12' THEN 'PAYMENT' WHEN heading = 'TAX INVOICE' THEN 'INVOICE' ELSE 'UNKNOWN' END AS document_type FROM d""")
def document_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    of = lambda *values: F.get(F.array(*[F.lit(v).cast("string") for v in values]), (key % len(values)).cast("int"))
    kind = normalize.document_type(
        of(None, "Purchase Order", "weird", None), of(None, "PO", "Journal Entry", None, None), of("due date", "Payment Terms", "Balance Due", "PO Number", "ledger page", "x", "y"), of("Receipt 12", "TAX INVOICE", "letter")
    )
    return t.table(spark, sf_dir, "orders").select(key.alias("id"), kind.alias("document_type"))


@query("SELECT conv_id, turn, role, substr(trim(regexp_replace(text, '\\s+', ' ', 'g')), 1, 48) AS title FROM conversations")
def chat_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", normalize.title(F.col("text")).alias("title"))


@query("""SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE contains(lower(regexp_replace(o_orderpriority || ' 1,000', '[\\s,]+', '', 'g')), lower(regexp_replace(([' 1000', 'LOW', '5-l o w', 'zz'])[(o_orderkey % 4 + 1)::INTEGER], '[\\s,]+', '', 'g'))) END AS agrees FROM orders""")
def engine_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether a second reading holds a value; null where it says nothing."""
    key = F.col("o_orderkey")
    value = F.get(F.array(*[F.lit(v) for v in (" 1000", "LOW", "5-l o w", "zz")]), (key % 4).cast("int"))
    other = F.when(key % 9 == 0, "").otherwise(F.concat("o_orderpriority", F.lit(" 1,000")))
    return t.table(spark, sf_dir, "orders").select(key.alias("id"), normalize.agreement(value, other).alias("agrees"))

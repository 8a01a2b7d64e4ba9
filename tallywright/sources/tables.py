"""Reading the tables, and the views of business records derived from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.functions import normalize
from tallywright.operators import gate

MONEY = "decimal(18,2)"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def dealt(df: DataFrame) -> DataFrame:
    """Rows over all cores, where a small file would leave costly work on each of them to one."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def transactions(spark: SparkSession, sf_dir: str, *wanted: str, verified_only: bool = True) -> DataFrame:
    """Orders as revenue, order lines as expense, past the gate: id, date, kind, amount and, if wanted, category and counterparty.

    Every order's cases follow from its key; tables are joined only for the columns that are asked for.
    """
    orders, lines = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    if {"category", "counterparty"} & set(wanted):
        customers = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_name")
        orders = orders.join(customers, orders.o_custkey == customers.c_custkey, "left")
    if "category" in wanted:
        parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
        lines = lines.join(parts, lines.l_partkey == parts.p_partkey, "left")
    if "counterparty" in wanted:
        suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
        lines = lines.join(suppliers, lines.l_suppkey == suppliers.s_suppkey, "left")

    def statuses(key: Column) -> Column:
        own = F.array(F.when(key % 29 == 0, "ESCALATED"), F.when(key % 31 == 0, "REJECTED"), F.when(key % 7 == 0, "ACCEPTED"), F.when(key % 5 == 0, "MATCHED"))
        return F.array_compact(own)

    def shaped(rows: DataFrame, txn_id: Column, date: Column, kind: str, amount: Column, category: Column, counterparty: Column, key: Column) -> DataFrame:
        more = [c.alias(n) for n, c in (("category", category), ("counterparty", counterparty)) if n in wanted]
        status = gate.transaction_status(statuses(key), F.lit(False))
        out = rows.select(txn_id.alias("transaction_id"), date.cast("date").alias("date"), F.lit(kind).alias("kind"), amount.cast("decimal(38,4)").alias("amount"), *more, status.alias("verification_status"))
        return out.withColumns({"verified": F.col("verification_status").isin(*gate.VERIFIED), "source_count": F.lit(1)})

    salaries = F.when(F.col("p_type") == "STANDARD", F.lit("Salaries & Wages")).otherwise(F.col("p_type"))
    revenue = shaped(
        orders, F.concat(F.lit("txn:O"), F.col("o_orderkey").cast("string")), F.col("o_orderdate"), "revenue", F.col("o_totalprice").cast(MONEY),
        F.col("c_mktsegment"), F.col("c_name"), F.col("o_orderkey"),
    )
    line = F.concat(F.lit("txn:L"), F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    net = F.col("l_extendedprice").cast(MONEY) * (1 - F.col("l_discount").cast(MONEY))
    both = revenue.unionByName(shaped(lines, line, F.col("l_shipdate"), "expense", net, salaries, F.col("s_name"), F.col("l_orderkey")))
    return gate.verified(both).drop("verification_status", "verified", "source_count") if verified_only else both


TRANSACTIONS_SQL = """
raw_txn AS (
  SELECT 'txn:O' || o_orderkey AS transaction_id, CAST(o_orderdate AS DATE) AS date, 'revenue' AS kind,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS DECIMAL(38,4)) AS amount, c_mktsegment AS category, c_name AS counterparty, o_orderkey AS key
  FROM orders LEFT JOIN customer ON o_custkey = c_custkey
  UNION ALL
  SELECT 'txn:L' || l_orderkey || '-' || l_linenumber, CAST(l_shipdate AS DATE), 'expense',
         CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * (1 - CAST(l_discount AS DECIMAL(18,2))) AS DECIMAL(38,4)),
         CASE WHEN p_type = 'STANDARD' THEN 'Salaries & Wages' ELSE p_type END, s_name, l_orderkey
  FROM lineitem LEFT JOIN part ON l_partkey = p_partkey LEFT JOIN supplier ON l_suppkey = s_suppkey),
all_txn AS (
  SELECT *, CASE WHEN key % 31 = 0 THEN 'QUARANTINED' WHEN key % 29 = 0 THEN 'PENDING_REVIEW' WHEN key % 7 = 0 THEN 'ACCEPTED'
                 WHEN key % 5 = 0 THEN 'RECONCILED' ELSE 'SINGLE_SOURCE' END AS verification_status FROM raw_txn),
txn AS (SELECT * FROM all_txn WHERE verification_status IN ('RECONCILED', 'SINGLE_SOURCE', 'ACCEPTED', 'CORRECTED') AND amount IS NOT NULL AND date IS NOT NULL)
"""


def _identifier(key: Column) -> Column:
    return F.concat(F.lit("ORD-2012-"), F.lpad(key.cast("string"), 9, "0"))


def _names() -> tuple[Column, Column]:
    """Two words of letters that a customer's key gives."""
    letters = F.translate(F.md5(F.col("o_custkey").cast("string")), "0123456789", "ghijklmnop")
    return F.substring(letters, 1, 8), F.substring(letters, 9, 6)


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One invoice an order, and a second copy for half as much again where the key is a multiple of 97."""
    orders = dealt(table(spark, sf_dir, "orders").where("o_orderkey IS NOT NULL"))
    key, amount = F.col("o_orderkey"), F.col("o_totalprice").cast(MONEY)
    number = F.lpad(key.cast("string"), 9, "0")
    first, last = _names()
    copies = F.when(key % 97 == 0, F.array(F.lit(""), F.lit("b"))).otherwise(F.array(F.lit("")))
    return orders.select("*", F.explode(copies).alias("copy")).select(
        F.concat(F.lit("inv-"), number, F.col("copy")).alias("document_id"), F.lit("INVOICE").alias("document_type"),
        _identifier(key).alias("identifier"),
        F.when(F.col("copy") == "b", (amount * F.lit(1.5).cast("decimal(3,1)"))).otherwise(amount).cast(MONEY).alias("amount"),
        F.col("o_orderdate").cast("date").alias("date"),
        F.concat(F.upper(first), F.lit(" "), F.upper(last), F.lit(" Incorporated")).alias("entity_raw"), F.when(key % 37 == 0, "EUR").otherwise("USD").alias("currency"),
    )


def ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Postings: every tenth order has none, and others differ in amount, date, name or identifier."""
    key, amount = F.col("o_orderkey"), F.col("o_totalprice").cast(MONEY)
    kind, date, name = key % 10, F.col("o_orderdate").cast("date"), _identifier(key)
    factor = F.when(kind == 1, F.lit("1.045")).when(kind == 2, F.lit("1.010")).otherwise(F.lit("1.000")).cast("decimal(5,3)")
    orders = dealt(table(spark, sf_dir, "orders").where(key % 10 != 0))
    first, last = _names()
    base = F.concat(F.initcap(first), F.lit(" "), F.initcap(last))
    raw = F.when(key % 7 == 3, F.lit(None)).when(key % 19 == 0, "Zebra Limited").when(key % 23 == 0, base).otherwise(F.concat(base, F.lit(", Corp.")))
    return orders.select(
        F.concat(F.lit("led-"), F.lpad(key.cast("string"), 9, "0")).alias("document_id"), F.lit("LEDGER").alias("document_type"),
        F.when(kind == 5, F.lit(None).cast("string")).when(kind == 6, F.regexp_replace(name, "-0", "-O")).otherwise(name).alias("identifier"),
        (amount * factor).cast(MONEY).alias("amount"),
        F.date_add(date, F.when(kind == 3, 3).when(kind == 4, 20).otherwise(0)).alias("date"),
        raw.alias("entity_raw"), F.when(key % 5 == 0, "USD").alias("currency"),
    )


DOCUMENTS_SQL = """
docs_invoice AS (
  SELECT 'inv-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') || copy AS document_id, 'INVOICE' AS document_type,
         'ORD-2012-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS identifier,
         CAST(CASE WHEN copy = 'b' THEN CAST(o_totalprice AS DECIMAL(18,2)) * CAST(1.5 AS DECIMAL(3,1)) ELSE CAST(o_totalprice AS DECIMAL(18,2)) END AS DECIMAL(18,2)) AS amount,
         CAST(o_orderdate AS DATE) AS date
  FROM orders, (VALUES (''), ('b')) AS c(copy) WHERE copy = '' OR o_orderkey % 97 = 0),
docs_ledger AS (
  SELECT 'led-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS document_id, 'LEDGER' AS document_type,
         CASE WHEN o_orderkey % 10 = 5 THEN NULL WHEN o_orderkey % 10 = 6
              THEN replace('ORD-2012-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0'), '-0', '-O')
              ELSE 'ORD-2012-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') END AS identifier,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(CASE WHEN o_orderkey % 10 = 1 THEN 1.045 WHEN o_orderkey % 10 = 2 THEN 1.010 ELSE 1.000 END AS DECIMAL(5,3)) AS DECIMAL(18,2)) AS amount,
         CAST(o_orderdate AS DATE) + CAST(CASE WHEN o_orderkey % 10 = 3 THEN 3 WHEN o_orderkey % 10 = 4 THEN 20 ELSE 0 END AS INTEGER) AS date
  FROM orders WHERE o_orderkey % 10 <> 0)
"""


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What was paid for finished orders: some of it short, late, early or for no order."""
    key, amount = F.col("o_orderkey"), F.col("o_totalprice").cast(MONEY)
    factor = F.when(key % 11 == 0, F.lit("0.92")).when(key % 11 == 1, F.lit("0.99")).otherwise(F.lit("1.00")).cast("decimal(3,2)")
    days = F.when(key % 13 == 0, 130).when(key % 17 == 0, -1).otherwise(21)
    orders = dealt(table(spark, sf_dir, "orders").where("o_orderstatus = 'F'"))
    first, last = _names()
    return orders.select(
        F.concat(F.lit("pay-"), F.lpad(key.cast("string"), 9, "0")).alias("document_id"), F.lit("PAYMENT").alias("document_type"),
        F.when(key % 101 == 0, F.concat(F.lit("NONE-"), key.cast("string"))).otherwise(_identifier(key)).alias("identifier"),
        (amount * factor).cast(MONEY).alias("amount"), F.date_add(F.col("o_orderdate").cast("date"), days).alias("date"),
        F.concat(last, F.lit(" "), first, F.lit(" corp")).alias("entity_raw"), F.lit(None).cast("string").alias("currency"),
    )


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices, postings and payments as the facts that linking works on."""
    number = F.substring("document_id", 5, 9).cast("long")
    rows = invoices(spark, sf_dir).unionByName(ledger(spark, sf_dir)).unionByName(payments(spark, sf_dir))
    return rows.select(
        "document_id", "document_type", F.concat("document_id", F.lit(".pdf")).alias("source_name"), F.array_compact(F.array("identifier")).alias("identifiers"), "amount",
        "currency", "date", normalize.entity(F.col("entity_raw")).alias("entity"), "entity_raw", F.when(F.col("document_type") == "LEDGER", F.concat(F.lit("Account "), number % 6)).alias("category"),
        F.when(F.col("document_type") == "LEDGER", F.when(number % 10 == 7, "Expense").otherwise("Revenue")).alias("entry_type"), (number % 53 == 0).alias("low_confidence"),
    )


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewers' actions on cases of pairs, from events: (id, case_id, action, field, corrected_value, reviewer)."""
    key = F.lpad((F.col("user_id") * 97).cast("string"), 9, "0")
    action = F.when(F.col("event_type") == "click", "ACCEPT").when(F.col("event_type") == "error", "REJECT").otherwise("CORRECT")
    field = F.when(F.col("event_id") % 3 == 0, "amount").when(F.col("event_id") % 3 == 1, "category").otherwise("date")
    value = F.when(field == "amount", F.concat(F.lit("$"), (F.col("event_id") % 900 + 100).cast("string"), F.lit(",000"))).when(field == "category", F.concat(F.lit("Fixed "), F.col("event_id") % 5)).otherwise("2001-02-03")
    return table(spark, sf_dir, "events").where(F.col("event_type").isin("click", "error", "purchase")).select(
        F.col("event_id").alias("id"), F.concat(F.lit("pair:inv-"), key, F.lit("|led-"), key).alias("case_id"), action.alias("action"),
        F.when(action == "CORRECT", field).alias("field"), F.when(action == "CORRECT", value).alias("corrected_value"), F.concat(F.lit("r"), F.col("user_id") % 4).alias("reviewer"),
    )


FACTS_SQL = DOCUMENTS_SQL + r""",
docs_payment AS (
  SELECT 'pay-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS document_id, 'PAYMENT' AS document_type,
         CASE WHEN o_orderkey % 101 = 0 THEN 'NONE-' || o_orderkey ELSE 'ORD-2012-' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') END AS identifier,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) * CAST(CASE WHEN o_orderkey % 11 = 0 THEN 0.92 WHEN o_orderkey % 11 = 1 THEN 0.99 ELSE 1.00 END AS DECIMAL(3,2)) AS DECIMAL(18,2)) AS amount,
         CAST(o_orderdate AS DATE) + CAST(CASE WHEN o_orderkey % 13 = 0 THEN 130 WHEN o_orderkey % 17 = 0 THEN -1 ELSE 21 END AS INTEGER) AS date
  FROM orders WHERE o_orderstatus = 'F'),
named AS (
  SELECT d.*, substr(document_id, 5, 9)::BIGINT AS n, substr(m, 1, 8) AS first, substr(m, 9, 6) AS last
  FROM (SELECT * FROM docs_invoice UNION ALL SELECT * FROM docs_ledger UNION ALL SELECT * FROM docs_payment) d
  JOIN (SELECT o_orderkey, translate(md5(o_custkey::VARCHAR), '0123456789', 'ghijklmnop') AS m FROM orders) ON o_orderkey = substr(document_id, 5, 9)::BIGINT),
facts AS (
  SELECT document_id, document_type, identifier, nullif(translate(regexp_replace(upper(regexp_replace(identifier, '\s+', '', 'g')), '[-_/.,:]', '', 'g'), 'OQIL|', '00111'), '') AS key,
         amount, date, n,
         CASE document_type WHEN 'INVOICE' THEN first || ' ' || last || ' corp' WHEN 'PAYMENT' THEN last || ' ' || first || ' corp'
              ELSE CASE WHEN n % 7 = 3 THEN NULL WHEN n % 19 = 0 THEN 'zebra limited' WHEN n % 23 = 0 THEN first || ' ' || last ELSE first || ' ' || last || ' corp' END END AS entity,
         CASE document_type WHEN 'INVOICE' THEN upper(first) || ' ' || upper(last) || ' Incorporated' WHEN 'PAYMENT' THEN last || ' ' || first || ' corp'
              ELSE CASE WHEN n % 7 = 3 THEN NULL WHEN n % 19 = 0 THEN 'Zebra Limited'
                        ELSE upper(first[1]) || first[2:] || ' ' || upper(last[1]) || last[2:] || CASE WHEN n % 23 = 0 THEN '' ELSE ', Corp.' END END END AS entity_raw,
         CASE WHEN document_type = 'INVOICE' THEN CASE WHEN n % 37 = 0 THEN 'EUR' ELSE 'USD' END WHEN document_type = 'LEDGER' AND n % 5 = 0 THEN 'USD' END AS currency,
         CASE WHEN document_type = 'LEDGER' THEN 'Account ' || (n % 6) END AS category,
         CASE WHEN document_type = 'LEDGER' THEN CASE WHEN n % 10 = 7 THEN 'expense' ELSE 'revenue' END END AS kind_said
  FROM named)
"""

REVIEWS_SQL = """
reviews AS (
  SELECT event_id AS id, 'pair:inv-' || lpad(CAST(user_id * 97 AS VARCHAR), 9, '0') || '|led-' || lpad(CAST(user_id * 97 AS VARCHAR), 9, '0') AS case_id,
         CASE event_type WHEN 'click' THEN 'ACCEPT' WHEN 'error' THEN 'REJECT' ELSE 'CORRECT' END AS action,
         CASE WHEN event_type = 'purchase' THEN CASE event_id % 3 WHEN 0 THEN 'amount' WHEN 1 THEN 'category' ELSE 'date' END END AS field,
         CASE WHEN event_type = 'purchase' THEN CASE event_id % 3 WHEN 0 THEN '$' || (event_id % 900 + 100) || ',000' WHEN 1 THEN 'Fixed ' || (event_id % 5) ELSE '2001-02-03' END END AS corrected_value,
         'r' || (user_id % 4) AS reviewer
  FROM events WHERE event_type IN ('click', 'error', 'purchase'))
"""

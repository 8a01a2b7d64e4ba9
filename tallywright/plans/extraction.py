"""From the text of invoices to facts: fields by rules, roles of labels, values, facts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.operators import extraction, mapping, reconcile
from tallywright.operators.components import kept
from tallywright.plans.base import query
from tallywright.sources import tables as t

_ORDERS = """orders_text AS (
  SELECT o_orderkey AS k, 'd' || o_orderkey AS document_id, o_custkey AS c, CAST(o_totalprice AS DECIMAL(18,2)) AS price, CAST(o_orderdate AS DATE) AS day FROM orders)"""
# What the lines of a text hold, written down by hand.
_FIELDS = f"""WITH {_ORDERS},
fields AS (
  SELECT document_id, k, c, price, day, unnest(range(0, 11))::INTEGER AS pos,
    unnest(['#', 'Invoice Number', 'Date', 'Bill To', 'Order 1D', 'Discount (20%)', 'Shipping', 'Balance Due', 'Gate Code', 'Notes', 'Total']) AS label,
    unnest([k::VARCHAR, 'INV-' || k, day::VARCHAR, 'Client ' || c || ' Corporation', 'ORD-' || k, '$5.00', '1.50', '$' || price, '9', NULL,
            CASE WHEN k % 3 = 0 THEN '€' || (price + 1) || ' net' ELSE 'n/a' END]) AS value,
    unnest([0.95, 0.95, 0.95, 0.95, 0.85, 0.95, 0.95, 0.95, 0.80, 0.95, 0.95])::DOUBLE AS confidence
  FROM orders_text)
"""


def _texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An invoice's text for each order: known labels with and without colons, two on a line, guessed ones, prose."""
    key, price = F.col("o_orderkey").cast("string"), F.col("o_totalprice").cast("decimal(18,2)")
    total = F.when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("€"), (price + 1).cast("decimal(18,2)").cast("string"), F.lit(" net"))).otherwise("n/a")
    lines = [
        F.lit("INVOICE"), F.concat(F.lit("  # "), key), F.concat(F.lit("Invoice Number : INV-"), key, F.lit(" Date: "), F.col("o_orderdate").cast("date").cast("string")),
        F.concat(F.lit("Bill To: Client "), F.col("o_custkey").cast("string"), F.lit(" Corporation,")), F.concat(F.lit("Order 1D - ORD-"), key), F.lit(""),
        F.lit("Discount (20%): $5.00, Shipping: 1.50"), F.concat(F.lit("Balance Due:$"), price.cast("string")), F.lit("we meet by the Gate Code: 9"),
        F.lit("see page 4: there"), F.lit("Thank you for your order"), F.lit("Notes:"), F.concat(F.lit("Total:"), total),
    ]
    orders = t.dealt(t.table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice", "o_orderdate"))
    return orders.select(F.concat(F.lit("d"), key).alias("document_id"), F.array_join(F.array(*lines), "\n").alias("text"))


@query(_FIELDS + "SELECT document_id, pos, 'field-' || (pos + 1) AS field_id, label, value, confidence, 'rules' AS method FROM fields")
def extracted_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(_texts(spark, sf_dir))


@query(_FIELDS + """SELECT document_id, pos, label, CASE WHEN k % 4 = 0 THEN 'rules (fallback after picky error: no fours)' ELSE 'picky' END AS method FROM fields WHERE k % 4 = 0
UNION ALL SELECT document_id, 0, 'Whole', 'picky' FROM orders_text WHERE k % 4 <> 0""")
def extraction_fallback(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A reader that refuses every fourth order, for which the rules step in."""

    def picky(text: str) -> list[tuple[str, str | None]]:
        if int(text.split("# ")[1].split("\n")[0]) % 4 == 0:
            raise ValueError("no fours")
        return [("Whole", text)]

    return extraction.extract(_texts(spark, sf_dir), picky, "picky").select("document_id", "pos", "label", "method")


_ROLES = """roles(label, role, semantic_type, method, confidence) AS (VALUES
  ('#', NULL, NULL, 'UNRESOLVED', NULL), ('Invoice Number', 'INVOICE_ID', 'IDENTIFIER', 'RULE', 1.0), ('Date', 'DOCUMENT_DATE', 'DATE', 'RULE', 1.0), ('Bill To', 'CUSTOMER', 'ENTITY', 'RULE', 1.0),
  ('Order 1D', 'ORDER_ID', 'IDENTIFIER', 'RULE', 1.0), ('Discount (20%)', NULL, NULL, 'UNRESOLVED', NULL), ('Shipping', 'SHIPPING', 'AMOUNT', 'RULE', 1.0), ('Balance Due', 'BALANCE_DUE', 'AMOUNT', 'RULE', 1.0),
  ('Gate Code', NULL, NULL, 'UNRESOLVED', NULL), ('Notes', NULL, NULL, 'UNRESOLVED', NULL), ('Total', 'TRANSACTION_TOTAL', 'AMOUNT', 'RULE', 1.0))"""


def _mapped(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = _texts(spark, sf_dir)
    # Read three times: for documents' types, for different labels and for the fields themselves.
    fields = kept(extraction.extract(texts).select("document_id", "pos", F.col("label").alias("raw_label"), F.col("value").alias("raw"), "confidence"))
    # Types are as many as documents, which are not for the driver to broadcast, whatever their files' size.
    return mapping.map_fields(fields.join(kept(mapping.typed_documents(fields, texts)).hint("merge"), "document_id"))


@query(_FIELDS + f", {_ROLES} SELECT document_id, pos, 'INVOICE' AS document_type, label AS raw_label, role, semantic_type, method AS mapping_method, r.confidence::DOUBLE AS sure FROM fields JOIN roles r USING (label)")
def mapped_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    sure = F.when(F.col("role").isNotNull(), F.col("mapping_confidence")).alias("sure")
    return _mapped(spark, sf_dir).select("document_id", "pos", "document_type", "raw_label", "role", "semantic_type", "mapping_method", sure)


@query(f"""WITH {_ORDERS} SELECT document_id, 'INVOICE' AS document_type, 'INV-' || k || ',ORD-' || k AS identifiers, (price + CASE WHEN k % 3 = 0 THEN 1 ELSE 0 END)::DOUBLE AS amount,
CASE WHEN k % 3 = 0 THEN 'EUR' END AS currency, day AS date, 'client ' || c || ' corp' AS entity, 'Client ' || c || ' Corporation' AS entity_raw, CASE WHEN k % 3 = 0 THEN 2 ELSE 1 END AS n_amounts, false AS low_confidence FROM orders_text""")
def extracted_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts all the way to the facts that linking works on."""
    fields = mapping.normalized_fields(_mapped(spark, sf_dir))
    facts = reconcile.document_facts(fields)
    return facts.select(
        "document_id", "document_type", F.array_join("identifiers", ",").alias("identifiers"), F.col("amount").cast("double").alias("amount"), "currency", "date", "entity", "entity_raw",
        F.size("amounts").alias("n_amounts"), "low_confidence",
    )


_LABELS = ("net payable", "Amount due", "document reference NO", "purchase order number", "purchase order total", "amounts paid", "Amount", "total value", "T0tal")


@query("""WITH said(label, INVOICE, PURCHASE_ORDER, PAYMENT, UNKNOWN) AS (VALUES
  ('net payable', 'TRANSACTION_TOTAL SIMILARITY 1.0', 'TRANSACTION_TOTAL SIMILARITY 1.0', 'TRANSACTION_TOTAL SIMILARITY 1.0', 'TRANSACTION_TOTAL SIMILARITY 1.0'),
  ('Amount due', 'TRANSACTION_TOTAL SIMILARITY 1.0', 'TRANSACTION_TOTAL SIMILARITY 1.0', 'TRANSACTION_TOTAL SIMILARITY 1.0', 'TRANSACTION_TOTAL SIMILARITY 1.0'),
  ('document reference NO', '- UNRESOLVED 0.652', '- UNRESOLVED 0.652', '- UNRESOLVED 0.652', '- UNRESOLVED 0.652'),
  ('purchase order number', 'ORDER_ID SIMILARITY 1.0', 'ORDER_ID SIMILARITY 1.0', 'ORDER_ID SIMILARITY 1.0', 'ORDER_ID SIMILARITY 1.0'),
  ('purchase order total', '- UNRESOLVED 0.75', 'ORDER_TOTAL SIMILARITY 0.87', '- UNRESOLVED 0.75', '- UNRESOLVED 0.75'),
  ('amounts paid', '- UNRESOLVED 0.717', '- UNRESOLVED 0.717', 'AMOUNT_PAID SIMILARITY 0.837', '- UNRESOLVED 0.717'),
  ('Amount', 'TRANSACTION_TOTAL SIMILARITY 0.92', 'ORDER_TOTAL SIMILARITY 0.92', 'AMOUNT_PAID SIMILARITY 0.92', '- UNRESOLVED 0.562'),
  ('total value', '- UNRESOLVED 0.5', '- UNRESOLVED 0.62', '- UNRESOLVED 0.5', '- UNRESOLVED 0.5'),
  ('T0tal', 'TRANSACTION_TOTAL RULE 1.0', 'TRANSACTION_TOTAL RULE 1.0', 'TRANSACTION_TOTAL RULE 1.0', 'TRANSACTION_TOTAL RULE 1.0')),
long AS (UNPIVOT said ON INVOICE, PURCHASE_ORDER, PAYMENT, UNKNOWN INTO NAME document_type VALUE result)
SELECT p_partkey AS document_id, label AS raw_label, result FROM part JOIN long ON document_type = (['INVOICE', 'PURCHASE_ORDER', 'PAYMENT', 'UNKNOWN'])[1 + p_partkey % 4]""")
def label_roles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of every part's document by likeness and context; what each should give was worked out by hand."""
    kinds = F.array(*[F.lit(x) for x in ("INVOICE", "PURCHASE_ORDER", "PAYMENT", "UNKNOWN")])
    key = F.col("p_partkey")
    parts = t.dealt(t.table(spark, sf_dir, "part").select("p_partkey"))
    fields = parts.select(key.alias("document_id"), F.get(kinds, (key % 4).cast("int")).alias("document_type"), F.posexplode(F.array(*[F.lit(x) for x in _LABELS])).alias("pos", "raw_label"))
    mapped = mapping.map_fields(fields.withColumn("raw", F.lit("1")))
    said = F.concat_ws(" ", F.coalesce("role", F.lit("-")), "mapping_method", F.col("mapping_confidence").cast("string"))
    return mapped.select("document_id", "raw_label", said.alias("result"))


@query("""SELECT o_orderkey AS document_id, CASE WHEN o_orderkey % 2 = 0 THEN 'Clerk ' || o_orderkey ELSE o_orderpriority END AS vendor, CASE WHEN o_orderkey % 5 <> 0 THEN 'INV-' || o_orderkey END AS identifier,
o_orderdate::DATE::VARCHAR AS date, CASE WHEN o_orderkey % 7 <> 0 THEN -1234.5::DOUBLE - o_orderkey % 7 END AS amount, NULL::VARCHAR AS currency,
(2 + (o_orderkey % 5 <> 0)::INT + 1) / 5.0::DOUBLE AS mapping_confidence FROM orders""")
def canonical_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a document from the first field of each concept."""
    key = F.col("o_orderkey")
    rows = F.array(*[F.struct(F.lit(label).alias("raw_label"), value.cast("string").alias("raw")) for label, value in (
        ("Seller!", F.when(key % 2 == 0, F.concat(F.lit("Clerk "), key))), ("Company", F.col("o_orderpriority")), ("Invoice No.", F.when(key % 5 != 0, F.concat(F.lit("INV-"), key))),
        ("DATE", F.col("o_orderdate").cast("date")), ("Total Amount:", F.when(key % 7 == 0, F.lit("none")).otherwise(F.concat(F.lit("about -1,2"), F.lit(34) + key % 7, F.lit(".5 and 7")))),
        ("Other", F.lit("x")), ("balance due", F.lit("99")),
    )])
    fields = t.table(spark, sf_dir, "orders").select(key.alias("document_id"), F.posexplode(rows).alias("pos", "f")).select("document_id", "pos", "f.*")
    return mapping.canonical(fields)

"""Rules on single lines, label likeness and mapping: expected results written by hand."""

import pytest
from pyspark.sql import functions as F

from tallywright.functions import similarity
from tallywright.operators import extraction, mapping

LINES = {
    "Invoice Number: INV-1": [("Invoice Number", "INV-1", 0.95)],
    "Order ID : 7 Ship Mode: Air, Date:2020": [("Order ID", "7", 0.95), ("Ship Mode", "Air", 0.95), ("Date", "2020", 0.95)],
    "Discount (20%): $5": [("Discount (20%)", "$5", 0.95)],
    "Blue Gate Code: 9": [("Blue Gate Code", "9", 0.80)], "One Two Three Four: 9": [("Two Three Four", "9", 0.80)], "and, Gate, Code: 9": [("Code", "9", 0.80)],
    "see page: 4": [], "Total:": [("Total", None, 0.95)], ": x": [], "12:30": [], "": [], "   ": [], "INVOICE": [],
    "# 771": [("#", "771", 0.95)], "#771": [("#", "771", 0.95)], "# a b": [],
    "Date Dec 08 2012": [("Date", "Dec 08 2012", 0.85)], "Order 1D - MX-2012": [("Order 1D", "MX-2012", 0.85)], "T0ta1 | 55": [("T0ta1", "55", 0.85)],
    "Total Amount 9": [("Total Amount", "9", 0.85)], "Invoice Date": [], "Bill To Acme": [("Bill To", "Acme", 0.85)], "hello world": [], "due date": [],
    "total: 5 subtotal: 4": [("total", "5", 0.95), ("subtotal", "4", 0.95)], "Größe Ubermaß: 3": [("Größe Ubermaß", "3", 0.80)],
}


def test_lines(spark):
    rows = spark.createDataFrame([(i, line) for i, line in enumerate(LINES)], "i int, line string")
    got = [[(f.label, f.value, f.confidence) for f in r.fields] for r in extraction.with_fields(rows, "line", "fields").orderBy("i").collect()]
    assert dict(zip(LINES, got, strict=True)) == LINES


def test_texts_and_confidence(spark):
    texts = spark.createDataFrame([("a", "Total: 5\r\n\nnothing\x0bTax: 1 # 3"), ("b", None), ("c", ""), ("a", "Date: 2")], "document_id string, text string")
    got = sorted(tuple(r)[:5] for r in extraction.extract(texts).collect())
    assert got == [("a", 0, "field-1", "Date", "2"), ("a", 0, "field-1", "Total", "5"), ("a", 1, "field-2", "Tax", "1"), ("a", 2, "field-3", "#", "3")]
    rows = spark.createDataFrame([(0.95, 0.9, 0.5, "12", "x 1 2"), (0.95, None, 0.5, "12", "13"), (1.0, None, None, "12", None), (2.0, None, None, "", "a")], "b double, o double, p double, v string, s string")
    worth = rows.select(extraction.field_confidence(*[F.col(c) for c in "bopvs"])).collect()
    assert [r[0] for r in worth] == [0.855, 0.38, 1.0, 1.0]


@pytest.mark.parametrize(("left", "right", "want"), [
    ("amount", "amount due", 0.562), ("net payable", "net payable", 1.0), ("purchase order total", "purchase order total value", 0.75), ("", "x", 0.0), ("the", "the total", 0.0),
    ("abc", "xyz", 0.0), ("bill to", "customer buyer billed to", 0.339),
])
def test_label_similarity(spark, left, right, want):
    rows = spark.createDataFrame([(left, right)], "l string, r string")
    assert rows.select(similarity.label_similarity(F.col("l"), F.col("r"), mapping.STOP_WORDS)).first()[0] == want


def test_a_resolver_decides_what_likeness_leaves_open(spark):
    fields = spark.createDataFrame(
        [("d", "INVOICE", i, label, str(i)) for i, label in enumerate(["Invoice No", "total value", "notes", "amounts paid", "vendor company"])],
        "document_id string, document_type string, pos int, raw_label string, raw string",
    )

    def resolver(asked):
        assert [c.name for c in asked.schema] == ["document_id", "pos", "raw_label", "raw", "document_type", "nearby", "candidates"]
        known = {r.pos: r for r in asked.collect()}
        assert sorted(known) == [1, 2, 3, 4] and [(n.raw_label, n.raw) for n in known[2].nearby] == [("Invoice No", "0"), ("total value", "1"), ("amounts paid", "3"), ("vendor company", "4")]
        assert all(len(r.candidates) == 4 for r in known.values()) and known[1].candidates[0].role == "ORDER_TOTAL"
        return spark.createDataFrame([("d", 1, "ORDER_TOTAL"), ("d", 2, "NO_ROLE"), ("d", 3, None), ("d", 4, "SHIPPING")], "document_id string, pos int, role string")

    got = {r.pos: (r.role, r.semantic_type, r.mapping_method, r.mapping_confidence) for r in mapping.map_fields(fields, resolver=resolver).collect()}
    assert got[0] == ("INVOICE_ID", "IDENTIFIER", "RULE", 1.0) and got[1] == ("ORDER_TOTAL", "AMOUNT", "LLM", 0.7)
    assert [got[i][:3] for i in (2, 3, 4)] == [(None, None, "UNRESOLVED")] * 3 and got[3][3] == 0.717
    with pytest.raises(ValueError):
        mapping.MappingConfig(accept=1.5)


def test_document_types(spark):
    rows = [("a", 0, "Invoice No", "1", None), ("a", 1, "Amount Paid", "1", None), ("b", 0, "Document Type", "Journal entry", None), ("c", 0, "x", "y", "payment"), ("d", 0, "x", "y", None), ("e", 0, "Balance Due", "1", None)]
    fields = spark.createDataFrame(rows, "document_id string, pos int, raw_label string, raw string, stated_type string")
    texts = spark.createDataFrame([("d", "\n Some\nPayment Advice\nx\nInvoice"), ("f", "a\nb\nc\ninvoice")], "document_id string, text string")
    got = {r.document_id: r.document_type for r in mapping.typed_documents(fields, texts).collect()}
    assert got == {"a": "PAYMENT", "b": "LEDGER", "c": "PAYMENT", "d": "PAYMENT", "e": "INVOICE", "f": "UNKNOWN"}


def test_types_of_documents_are_not_broadcast(spark):
    """They are as many as the documents, whatever a plan takes them for."""
    from tallywright.plans import extraction as plans

    for query in (plans.mapped_fields, plans.extracted_facts):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [document_id" in plan and "BroadcastHashJoin [document_id" not in plan


def test_patterns_and_folding_run_only_where_they_can_count(spark):
    """A line's first words are folded once, not once for each length, and the last piece of a line is no label's place."""
    texts = spark.createDataFrame([("d", "ORDER 1D ; ΟΔΟΣ 7\nDate: paid Total\nTotal Amount ΑΣ\nVat : 1, Tax: 2 Total\nINVOICE")], "document_id string, text string")
    got = extraction.with_fields(texts, "text", "fields")
    rows = [(f["label"], f["value"]) for r in got.collect() for f in r["fields"]]
    assert rows == [("ORDER 1D", "ΟΔΟΣ 7"), ("Date", "paid Total"), ("Total Amount", "ΑΣ"), ("Vat", "1"), ("Tax", "2 Total")]
    assert got._jdf.queryExecution().analyzed().toString().count("lower(") <= 4  # one of the words and one of each value


def test_fields_are_never_broadcast(spark, monkeypatch, tmp_path):
    """Fields exploded from few bytes look small, but are as many as documents' labels; only different labels go through the driver, and only if few."""
    spark.range(300).select(F.col("id").alias("document_id")).write.parquet(str(tmp_path / "documents"))
    fields = spark.read.parquet(str(tmp_path / "documents")).select("document_id", F.lit("INVOICE").alias("document_type"), F.posexplode(F.array(*[F.lit(x) for x in ("Total", "Vendor", "Other")])).alias("pos", "raw_label"))
    said = []
    for sent in (mapping.SENT, 0):
        monkeypatch.setattr(mapping, "SENT", sent)
        mapped = mapping.map_fields(fields.withColumn("raw", F.lit("1")))
        said.append(sorted(tuple(r) for r in mapped.select("document_id", "pos", "role", "mapping_method").collect()))
        plan = mapped._jdf.queryExecution().sparkPlan().toString()
        assert ("BuildRight" in plan if sent else "BroadcastHashJoin" not in plan) and "BuildLeft" not in plan
    assert len(said[0]) == 900 and said[0] == said[1] and {r[2] for r in said[0]} == {"TRANSACTION_TOTAL", "VENDOR", None}

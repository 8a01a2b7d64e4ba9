"""Labels to semantic roles: rules first, then the likeness of a label to descriptions of roles.

Labels repeat where fields do not: each different label of a document type is judged
once, against a vocabulary of fixed size, and fields get their role by a join on both.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.functions import normalize, similarity
from tallywright.operators.components import kept

# Labels whose meaning is plain.
RULES = {
    "vendor": ("VENDOR", "ENTITY"), "supplier": ("VENDOR", "ENTITY"), "counterparty": ("VENDOR", "ENTITY"),
    "customer": ("CUSTOMER", "ENTITY"), "bill to": ("CUSTOMER", "ENTITY"), "payer": ("CUSTOMER", "ENTITY"),
    "invoice number": ("INVOICE_ID", "IDENTIFIER"), "invoice no": ("INVOICE_ID", "IDENTIFIER"), "order id": ("ORDER_ID", "IDENTIFIER"),
    "po number": ("ORDER_ID", "IDENTIFIER"), "payment id": ("PAYMENT_ID", "IDENTIFIER"),
    "date": ("DOCUMENT_DATE", "DATE"), "invoice date": ("DOCUMENT_DATE", "DATE"), "payment date": ("DOCUMENT_DATE", "DATE"), "posting date": ("DOCUMENT_DATE", "DATE"),
    "currency": ("CURRENCY", "CURRENCY"), "subtotal": ("SUBTOTAL", "AMOUNT"), "tax": ("TAX", "AMOUNT"), "discount": ("DISCOUNT", "AMOUNT"), "shipping": ("SHIPPING", "AMOUNT"),
    "amount paid": ("AMOUNT_PAID", "AMOUNT"), "balance due": ("BALANCE_DUE", "AMOUNT"), "total": ("TRANSACTION_TOTAL", "AMOUNT"), "grand total": ("TRANSACTION_TOTAL", "AMOUNT"),
}
# What describes each role, in order.
DESCRIPTIONS = (
    ("VENDOR", "ENTITY", "vendor supplier seller company"), ("CUSTOMER", "ENTITY", "customer buyer billed to"),
    ("DOCUMENT_ID", "IDENTIFIER", "document reference number"), ("INVOICE_ID", "IDENTIFIER", "invoice number identifier"),
    ("ORDER_ID", "IDENTIFIER", "purchase order order number"), ("PAYMENT_ID", "IDENTIFIER", "payment transaction reference"),
    ("DOCUMENT_DATE", "DATE", "document invoice transaction date"),
    ("TRANSACTION_TOTAL", "AMOUNT", "invoice grand total net payable amount due"), ("TRANSACTION_TOTAL", "AMOUNT", "grand total"),
    ("TRANSACTION_TOTAL", "AMOUNT", "net payable"), ("TRANSACTION_TOTAL", "AMOUNT", "amount due"),
    ("ORDER_TOTAL", "AMOUNT", "purchase order total value"), ("AMOUNT_PAID", "AMOUNT", "payment amount paid received"), ("AMOUNT_PAID", "AMOUNT", "amount paid"),
    ("BALANCE_DUE", "AMOUNT", "outstanding balance amount due"), ("SUBTOTAL", "AMOUNT", "subtotal before tax"), ("TAX", "AMOUNT", "tax vat amount"),
    ("DISCOUNT", "AMOUNT", "discount deduction amount"), ("SHIPPING", "AMOUNT", "shipping freight delivery charge"),
)
# The amount that a document of a type is about, and what a bare "amount" may be.
OWN_AMOUNT = {"INVOICE": "TRANSACTION_TOTAL", "PURCHASE_ORDER": "ORDER_TOTAL", "PAYMENT": "AMOUNT_PAID", "LEDGER": "TRANSACTION_TOTAL"}
BARE_AMOUNTS = ("TRANSACTION_TOTAL", "ORDER_TOTAL", "AMOUNT_PAID", "BALANCE_DUE")
STOP_WORDS = ("a", "an", "the", "of", "for", "to", "in", "on")
IN_CONTEXT, PREFERRED, OTHER = 0.12, 0.80, 0.58

#: Most different labels of types that are sent to every task; more are merged with their fields.
SENT = 1 << 16

# Labels by what an older reader of documents takes them for.
CONCEPTS = {
    "vendor": ("company", "from", "seller", "supplier", "vendor"), "identifier": ("id", "invoice", "invoice no", "invoice number", "order id", "reference"),
    "date": ("date", "invoice date", "transaction date"), "amount": ("amount", "balance due", "net total", "total", "total amount"), "currency": ("currency", "currency code"),
}

#: Asked about fields that neither rule nor likeness decides: gets (document_id, pos, raw_label, raw, document_type,
#: nearby, candidates) and gives (document_id, pos, role); only a role among the candidates counts.
Resolver = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class MappingConfig:
    accept: float = 0.78
    gap: float = 0.08
    resolver_confidence: float = 0.70
    asked: int = 4

    def __post_init__(self) -> None:
        if not (0 <= self.accept <= 1 and 0 <= self.gap <= 1 and 0 <= self.resolver_confidence <= 1 and self.asked > 0):
            raise ValueError("thresholds must lie within 0 and 1, and at least one candidate be asked about")


def _vocabulary() -> Column:
    rows = [F.struct(F.lit(i).alias("i"), *(F.lit(x).alias(n) for n, x in zip(("role", "type", "said"), row, strict=True))) for i, row in enumerate(DESCRIPTIONS)]
    return F.array(*rows)


def ranked_roles(labels: DataFrame, scorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(label, document_type, ranked): candidates (role, type, score) of each normalised label, the likeliest first.

    ``scorer`` gives two labels' likeness within 0 and 1; words alone and word order by default.
    A role that the document's type is about gets a little more; of equal scores the vocabulary's order decides.
    """
    scorer = scorer or (lambda a, b: similarity.label_similarity(a, b, STOP_WORDS))
    own_amount = F.create_map(*[F.lit(x) for pair in OWN_AMOUNT.items() for x in pair])
    labels = labels.select("label", "document_type").distinct().withColumn("own", F.try_element_at(own_amount, F.col("document_type")))
    bare = (F.col("label") == "amount") & F.col("own").isNotNull()

    def raised(role: Column, score: Column) -> Column:
        return F.least(F.lit(1.0), score + F.when(role == F.col("own"), IN_CONTEXT).otherwise(0.0))

    each = labels.where(~bare).select("label", "document_type", "own", F.explode(_vocabulary()).alias("v"))
    each = each.withColumn("score", raised(F.col("v.role"), scorer(F.col("label"), F.col("v.said"))))
    candidate = F.struct((-F.col("score")).alias("s"), F.col("v.i").alias("i"), F.col("v.role").alias("role"), F.col("v.type").alias("type"), "score")
    by_likeness = each.groupBy("label", "document_type").agg(F.array_sort(F.collect_list(candidate)).alias("ranked"))  # as many as descriptions

    def plain(role: str, i: int) -> Column:
        score = raised(F.lit(role), F.when(F.col("own") == role, PREFERRED).otherwise(OTHER))
        return F.struct((-score).alias("s"), F.lit(i).alias("i"), F.lit(role).alias("role"), F.lit("AMOUNT").alias("type"), score.alias("score"))

    by_type = labels.where(bare).select("label", "document_type", F.array_sort(F.array(*[plain(r, i) for i, r in enumerate(BARE_AMOUNTS)])).alias("ranked"))
    return by_likeness.unionByName(by_type).withColumn(
        "ranked", F.transform("ranked", lambda c: F.struct(c["role"].alias("role"), c["type"].alias("type"), c["score"].alias("score")))
    )


def label_roles(labels: DataFrame, config: MappingConfig = MappingConfig(), scorer: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """(label, document_type, role, semantic_type, method, confidence, candidates) of each different label of a type.

    The likeliest candidate counts if it is likely enough and the next one is far enough behind, whatever its role.
    """
    rules = F.create_map(*[x for label, (role, kind) in RULES.items() for x in (F.lit(label), F.struct(F.lit(role).alias("role"), F.lit(kind).alias("type")))])
    own = labels.select("label", "document_type").distinct().withColumn("rule", F.try_element_at(rules, F.col("label")))
    null, by_rule = F.lit(None).cast("string"), own.where("rule IS NOT NULL")
    none = F.array().cast("array<struct<role:string,type:string,score:double>>")
    by_rule = by_rule.select(
        "label", "document_type", F.col("rule.role").alias("role"), F.col("rule.type").alias("semantic_type"),
        F.lit("RULE").alias("method"), F.lit(1.0).alias("confidence"), none.alias("candidates"),
    )
    ranked = ranked_roles(own.where("rule IS NULL"), scorer)
    best, second = F.get("ranked", F.lit(0)), F.get("ranked", F.lit(1))
    sure = (best["score"] >= config.accept) & (second.isNull() | (best["score"] - second["score"] >= config.gap))
    by_likeness = ranked.select(
        "label", "document_type", F.when(sure, best["role"]).otherwise(null).alias("role"), F.when(sure, best["type"]).otherwise(null).alias("semantic_type"),
        F.when(sure, "SIMILARITY").otherwise("UNRESOLVED").alias("method"), F.round(F.coalesce(best["score"], F.lit(0.0)), 3).alias("confidence"),
        F.when(sure, none).otherwise(F.col("ranked")).alias("candidates"),
    )
    return by_rule.unionByName(by_likeness)


def nearby_fields(fields: DataFrame, reach: int = 2) -> Column:
    """For use with ``fields``: labels and values of up to ``reach`` fields on either side, in order."""
    order = Window.partitionBy("document_id").orderBy("pos")
    pair = F.struct("raw_label", "raw")
    before, after = order.rowsBetween(-reach, -1), order.rowsBetween(1, reach)
    return F.concat(F.collect_list(pair).over(before), F.collect_list(pair).over(after))


def map_fields(fields: DataFrame, config: MappingConfig = MappingConfig(), scorer: Callable[[Column, Column], Column] | None = None, resolver: Resolver | None = None) -> DataFrame:
    """``fields`` (document_id, document_type, pos, raw_label, raw) with label, role, semantic_type, mapping_method and mapping_confidence.

    Unresolved fields stay, without a role.
    """
    # A label is normalised once for all fields that have it; no label is one too.
    spelt = kept(fields.select(F.col("raw_label").alias("spelt"), F.col("document_type").alias("of_type")).distinct()).withColumn("label", normalize.label(F.col("spelt")))
    known = label_roles(spelt.select("label", F.col("of_type").alias("document_type")), config, scorer)
    said = known.select("label", F.col("document_type").alias("of_type"), "role", "semantic_type", F.col("method").alias("mapping_method"), F.col("confidence").alias("mapping_confidence"), "candidates")
    # Counted first: fields exploded from few bytes look small to the planner, and then they would go through the driver instead.
    said = kept(spelt.join((said.drop("candidates") if resolver is None else said).hint("merge"), ["label", "of_type"]))
    said = said.hint("broadcast" if said.count() <= SENT else "merge")
    mapped = fields.join(said, F.col("raw_label").eqNullSafe(F.col("spelt")) & (F.col("document_type") == F.col("of_type"))).drop("spelt", "of_type")
    if resolver is None:
        return mapped
    asked = mapped.withColumn("nearby", nearby_fields(mapped)).where("mapping_method = 'UNRESOLVED' AND size(candidates) > 0")
    asked = asked.select("document_id", "pos", "raw_label", "raw", "document_type", "nearby", F.slice("candidates", 1, config.asked).alias("candidates"))
    chosen = resolver(asked).select("document_id", "pos", F.col("role").alias("chosen"))
    both = mapped.join(chosen, ["document_id", "pos"], "left")
    allowed = F.filter("candidates", lambda c: c["role"] == F.col("chosen"))
    allowed = F.when(F.array_contains(F.transform(F.slice("candidates", 1, config.asked), lambda c: c["role"]), F.col("chosen")), F.get(allowed, F.lit(0)))
    return (
        both.withColumn("taken", allowed)
        .withColumns({
            "role": F.coalesce("taken.role", "role"), "semantic_type": F.coalesce("taken.type", "semantic_type"),
            "mapping_method": F.when(F.col("taken").isNotNull(), "LLM").otherwise(F.col("mapping_method")),
            "mapping_confidence": F.when(F.col("taken").isNotNull(), config.resolver_confidence).otherwise(F.col("mapping_confidence")),
        })
        .drop("candidates", "chosen", "taken")
    )


def typed_documents(fields: DataFrame, texts: DataFrame | None = None) -> DataFrame:
    """(document_id, document_type) from fields (document_id, raw_label, raw[, stated_type]) and, if given, texts (document_id, text).

    The first three lines of a text are its heading.
    """
    named = normalize.label(F.col("raw_label")) == "document type"
    stated = F.min_by("raw", F.when(named & F.col("raw").isNotNull(), F.col("pos")))
    labels = F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw_label"))), lambda x: normalize.label(x["raw_label"]))
    explicit = F.first("stated_type", ignorenulls=True) if "stated_type" in fields.columns else F.first(F.lit(None).cast("string"))
    seen = fields.groupBy("document_id").agg(explicit.alias("explicit"), stated.alias("stated"), F.array_join(labels, " ").alias("labels"))
    heading = F.array_join(F.slice(F.split(normalize.strip(F.coalesce("text", F.lit(""))), "\n"), 1, 3), " ")
    if texts is not None:
        seen = seen.join(texts.select("document_id", heading.alias("heading")), "document_id", "full")
    else:
        seen = seen.withColumn("heading", F.lit(""))
    parts = ("explicit", "stated", "labels", "heading")
    seen = seen.select("document_id", *(normalize.label(F.coalesce(c, F.lit(""))).alias(c) for c in parts))
    return seen.select("document_id", normalize.type_of(*(F.col(c) for c in parts)).alias("document_type"))


def normalized_fields(mapped: DataFrame) -> DataFrame:
    """Mapped fields with number, date, string, currency and status of their values, as ``reconcile.document_facts`` reads them."""
    held = normalize.with_value(mapped, "raw", "semantic_type", F.col("role").isNotNull())
    return held.select(*mapped.columns, *(F.col(f"normal.{n}").alias(n) for n in ("number", "date", "string", "currency", "status")))


def concept_key(label: Column) -> Column:
    return F.btrim(F.regexp_replace(F.lower(label), "[^a-z0-9 ]", ""))


def first_number(value: Column) -> Column:
    """The first number of a text with commas between thousands; null if there is none."""
    found = F.regexp_extract(value, r"-?\d+(?:,\d{3})*(?:\.\d+)?", 0)
    return F.when(found != "", F.replace(found, F.lit(","), F.lit("")).try_cast("double"))


def canonical(fields: DataFrame) -> DataFrame:
    """(document_id, vendor, identifier, date, amount, currency, mapping_confidence): of each concept the first field with a value."""
    key = concept_key(F.col("raw_label"))

    def first(concept: str) -> Column:
        named = key.isin(*CONCEPTS[concept]) & F.col("raw").isNotNull()
        return F.min_by("raw", F.when(named, F.col("pos"))).alias(concept)

    held = fields.groupBy("document_id").agg(*[first(c) for c in CONCEPTS])
    found = sum(F.col(c).isNotNull().cast("int") for c in CONCEPTS)
    return held.withColumn("mapping_confidence", found / len(CONCEPTS)).withColumn("amount", first_number(F.col("amount")))

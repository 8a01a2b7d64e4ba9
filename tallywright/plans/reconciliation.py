"""Links, cases, transactions, and the gate, over invoices, postings and payments.

Each part of a run is made once for a session and folder, and the queries read what they need of it.
"""

from __future__ import annotations

from functools import cached_property, lru_cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.operators import gate, linking, reconcile
from tallywright.operators.components import cut, kept
from tallywright.plans.base import doubles, query
from tallywright.sources import tables as t

_FACTS = "WITH RECURSIVE " + t.FACTS_SQL
_NAME_SCORE = """CASE WHEN {a} = {b} THEN 1.0 ELSE round(greatest(jaro_winkler_similarity({a}, {b}),
  jaro_winkler_similarity(array_to_string(list_sort(string_split({a}, ' ')), ' '), array_to_string(list_sort(string_split({b}, ' ')), ' '))), 3) END"""
_COVERAGE = """(len(list_filter(string_split({a}, ' '), lambda x: len(list_filter(string_split({b}, ' '), lambda y: jaro_winkler_similarity(x, y) >= 0.9)) > 0))
  + len(list_filter(string_split({b}, ' '), lambda y: len(list_filter(string_split({a}, ' '), lambda x: jaro_winkler_similarity(x, y) >= 0.9)) > 0)))::DOUBLE
  / (len(string_split({a}, ' ')) + len(string_split({b}, ' ')))"""

_LINKS = _FACTS + f""",
dup AS (
  SELECT l.document_id AS left_id, r.document_id AS right_id, 'DUPLICATE' AS rel
  FROM facts l JOIN facts r ON l.document_type = r.document_type AND l.key = r.key AND l.document_id < r.document_id),
pool AS (
  SELECT i.document_id AS a, p.document_id AS b FROM facts i JOIN facts p ON i.key = p.key
  WHERE i.document_type = 'INVOICE' AND p.document_type IN ('LEDGER', 'PAYMENT')
  UNION
  SELECT i.document_id, p.document_id
  FROM (SELECT * FROM facts WHERE document_type = 'INVOICE') i JOIN (SELECT * FROM facts WHERE document_type IN ('LEDGER', 'PAYMENT')) p
    ON p.amount >= i.amount * 0.97 AND p.amount <= i.amount * 1.03
  WHERE i.entity IS NOT NULL AND p.entity IS NOT NULL AND (i.entity = p.entity OR abs(i.date - p.date) < 90)),
seen_both AS (
  SELECT a AS left_id, b AS right_id, 'INVOICE_' || p.document_type AS rel, coalesce(i.key = p.key, false) AS idm, abs(i.date - p.date) AS days,
         i.currency IS NULL OR p.currency IS NULL OR i.currency = p.currency AS same_money,
         abs(i.amount - p.amount)::DOUBLE / greatest(abs(i.amount), abs(p.amount), 1)::DOUBLE * 100 AS p, {_NAME_SCORE.format(a="i.entity", b="p.entity")} AS es
  FROM pool JOIN facts i ON i.document_id = a JOIN facts p ON p.document_id = b),
scored AS (
  SELECT *, 0.6::DOUBLE * idm::INT + 0.2::DOUBLE * coalesce(es, 0.0::DOUBLE) + 0.15::DOUBLE * (same_money AND p <= 2)::INT
            + 0.05::DOUBLE * coalesce(greatest(0.0::DOUBLE, 1 - days::DOUBLE / 90), 0.0::DOUBLE) AS score FROM seen_both),
refs AS (SELECT * FROM scored WHERE score >= 0.38),
unsure AS (SELECT * FROM scored WHERE score >= 0.35 AND score < 0.38),
taken AS (SELECT left_id AS id FROM refs WHERE rel = 'INVOICE_LEDGER' UNION SELECT right_id FROM refs WHERE rel = 'INVOICE_LEDGER'),
near AS (
  SELECT i.document_id AS a, p.document_id AS b
  FROM facts i JOIN facts p ON i.document_type = 'INVOICE' AND p.document_type = 'LEDGER' AND p.identifier IS NULL AND p.kind_said = 'revenue'
    AND p.date BETWEEN i.date - 7 AND i.date + 7 AND abs(i.amount - p.amount)::DOUBLE / greatest(abs(i.amount), 1)::DOUBLE <= 0.25
  WHERE i.document_id NOT IN (SELECT id FROM taken) AND p.document_id NOT IN (SELECT id FROM taken) AND i.document_id NOT IN (SELECT left_id FROM unsure)),
alone AS (
  SELECT least(a, b) AS left_id, greatest(a, b) AS right_id, 'INVOICE_LEDGER' AS rel
  FROM (SELECT *, count(*) OVER (PARTITION BY a) AS n, count(*) OVER (PARTITION BY b) AS m FROM near) WHERE n = 1 AND m = 1),
pairs AS (SELECT * FROM dup UNION ALL SELECT left_id, right_id, rel FROM refs UNION ALL SELECT * FROM alone),
lr AS (
  SELECT p.*, l.document_type AS lt, r.document_type AS rt, l.amount AS la, r.amount AS ra, l.date AS ld, r.date AS rd,
         l.entity AS le, r.entity AS re, l.entity_raw AS lraw, r.entity_raw AS rraw
  FROM pairs p JOIN facts l ON l.document_id = left_id JOIN facts r ON r.document_id = right_id),
cmp AS (
  SELECT *, round(abs(la - ra)::DOUBLE / (CASE WHEN ra <> 0 THEN abs(ra) WHEN la <> 0 THEN abs(la) ELSE 1 END)::DOUBLE * 100, 2) AS pct, (rd - ld) AS days,
         ('INVOICE' IN (lt, rt) AND 'PAYMENT' IN (lt, rt)) AS paid, CASE WHEN lt = 'INVOICE' THEN rd - ld ELSE ld - rd END AS lag,
         {_NAME_SCORE.format(a="le", b="re")} AS es, CASE WHEN le = re THEN 1.0 ELSE {_COVERAGE.format(a="le", b="re")} END AS cover FROM lr),
judged AS (
  SELECT *, CASE WHEN pct = 0 THEN 'MATCHED' WHEN pct <= 2 THEN 'AUTO_RESOLVED' ELSE 'ESCALATED' END AS ast,
         CASE WHEN days = 0 THEN 'MATCHED' WHEN paid AND lag BETWEEN 0 AND 120 THEN 'MATCHED' WHEN paid THEN 'ESCALATED' WHEN abs(days) <= 7 THEN 'AUTO_RESOLVED' ELSE 'ESCALATED' END AS dst,
         CASE WHEN le IS NULL OR re IS NULL THEN NULL WHEN le = re OR es >= 0.9 AND cover = 1 THEN 'MATCHED' ELSE 'ESCALATED' END AS est FROM cmp),
kinds AS (
  SELECT *, CASE ast WHEN 'AUTO_RESOLVED' THEN 'rounding_variance' WHEN 'ESCALATED' THEN 'numerical_mismatch' END AS ak,
         CASE WHEN dst = 'AUTO_RESOLVED' THEN 'date_variance' WHEN dst = 'ESCALATED' AND paid THEN 'payment_date_out_of_terms' WHEN dst = 'ESCALATED' THEN 'date_mismatch' END AS dk,
         CASE WHEN est = 'ESCALATED' AND es >= 0.7 AND cover > 0.5 THEN 'entity_alias' WHEN est = 'ESCALATED' THEN 'entity_mismatch' END AS ek,
         CASE WHEN 'ESCALATED' IN (ast, dst, coalesce(est, '')) THEN 'ESCALATED' WHEN 'AUTO_RESOLVED' IN (ast, dst) THEN 'AUTO_RESOLVED' ELSE 'MATCHED' END AS worst FROM judged)
"""


def _money(x: str) -> str:
    return f"regexp_replace(printf('%.2f', {x}::DOUBLE), '(\\.\\d)0$', '\\1')"


CASES_SQL = _LINKS + f""",
said AS (
  SELECT *, nullif(trim(concat_ws(' ', CASE ast WHEN 'AUTO_RESOLVED' THEN 'Amounts differ by ' || {_money('pct')} || '% — within tolerance, auto-resolved.'
      WHEN 'ESCALATED' THEN 'Amounts differ by ' || {_money('pct')} || '% (' || {_money('la')} || ' vs ' || {_money('ra')} || '), beyond tolerance.' END,
    CASE WHEN dst <> 'MATCHED' THEN 'Dates differ by ' || abs(days) || ' days.' END,
    CASE WHEN est <> 'MATCHED' THEN 'Counterparty names differ (' || lraw || ' vs ' || rraw || ').' END)), '') AS words FROM kinds),
pair_cases AS (
  SELECT 'pair:' || left_id || '|' || right_id AS case_id, CASE WHEN rel = 'DUPLICATE' THEN 'duplicate_entry' ELSE 'document_pair' END AS case_type,
    CASE WHEN rel = 'DUPLICATE' THEN 'ESCALATED' ELSE worst END AS status, left_id, right_id, lt, rt, rel,
    list_sort(list_filter(CASE WHEN rel = 'DUPLICATE' THEN ['duplicate_entry', ak, dk, ek] ELSE [ak, dk, ek] END, lambda x: x IS NOT NULL)) AS types,
    CASE WHEN rel = 'DUPLICATE' THEN 'Two ' || lower(lt) || 's carry the same identifier. Confirm whether this is a re-issue, a correction or a double entry.' ELSE coalesce(words, 'All compared fields agree.') END AS explanation FROM said),
both_ways AS (SELECT left_id AS x, right_id AS y, case_id FROM pair_cases WHERE rel = 'DUPLICATE' UNION ALL SELECT right_id, left_id, case_id FROM pair_cases WHERE rel = 'DUPLICATE'),
ends AS (
  SELECT left_id AS doc, right_id AS other, rt AS other_type, case_id, status, explanation FROM pair_cases WHERE rel <> 'DUPLICATE'
  UNION ALL SELECT right_id, left_id, lt, case_id, status, explanation FROM pair_cases WHERE rel <> 'DUPLICATE'),
folded AS (
  SELECT DISTINCT d.case_id AS duplicate_id, b.case_id,
    'The ' || lower(a.other_type) || ' entry agrees with ' || a.doc || '.pdf; ' || b.doc || '.pdf differs (' || b.explanation || ')' AS note
  FROM both_ways d JOIN ends a ON a.doc = d.x AND a.status IN ('MATCHED', 'AUTO_RESOLVED') JOIN ends b ON b.doc = d.y AND b.other = a.other AND b.status = 'ESCALATED'),
booked AS (SELECT unnest([left_id, right_id]) AS id FROM lr WHERE 'LEDGER' IN (lt, rt)),
copies AS (SELECT x AS id FROM both_ways WHERE y IN (SELECT id FROM booked)),
told AS (
  SELECT first_case AS case_id, string_agg('Only ' || copy || '.pdf is booked in the ledger.', ' ' ORDER BY x) AS note
  FROM (SELECT x, arg_min(case_id, [x, y].list_sort()) AS first_case, min(y) FILTER (WHERE y IN (SELECT id FROM booked)) AS copy FROM both_ways
        WHERE x LIKE 'inv-%' AND x NOT IN (SELECT id FROM booked) GROUP BY x) WHERE copy IS NOT NULL GROUP BY first_case),
missing AS (SELECT 'doc:' || document_id || ':missing-ledger' AS case_id, document_id FROM facts WHERE document_type = 'INVOICE' AND document_id NOT IN (SELECT id FROM booked) AND document_id NOT IN (SELECT id FROM copies)
  UNION ALL SELECT 'doc:' || document_id || ':missing-invoice', document_id FROM facts WHERE document_type = 'PAYMENT' AND document_id NOT IN (SELECT unnest([left_id, right_id]) FROM pairs)),
cases AS (
  SELECT case_id, case_type, status, left_id AS doc, [left_id, right_id] AS docs, types,
    concat_ws(' ', explanation, (SELECT string_agg(note, ' ' ORDER BY f.case_id) FROM folded f WHERE f.duplicate_id = c.case_id), (SELECT note FROM told t WHERE t.case_id = c.case_id)) AS explanation
  FROM pair_cases c WHERE case_id NOT IN (SELECT case_id FROM folded)
  UNION ALL SELECT 'link:' || left_id || '|' || right_id, 'ambiguous_link', 'ESCALATED', left_id, [left_id, right_id], ['ambiguous_link'], 'These documents partly agree but the evidence is not strong enough to link them automatically.' FROM unsure
  UNION ALL SELECT case_id, 'missing_document', 'MISSING', document_id, [document_id], ['missing_document'], CASE WHEN case_id LIKE '%ledger' THEN 'This invoice has no matching entry in the general ledger — it may not have been booked.' ELSE 'This payment does not match any invoice on file.' END FROM missing
  UNION ALL SELECT 'doc:' || document_id || ':extraction', 'low_confidence_extraction', 'ESCALATED', document_id, [document_id], ['low_confidence_extraction'], 'Extraction confidence is below the review threshold.' FROM facts WHERE n % 53 = 0),
edges AS (SELECT left_id AS a, right_id AS b FROM pairs UNION ALL SELECT right_id, left_id FROM pairs),
reach(id, root) AS (SELECT document_id, document_id FROM facts UNION SELECT e.b, r.root FROM reach r JOIN edges e ON e.a = r.id),
roots AS (SELECT id, min(root) AS root FROM reach GROUP BY id),
ordered AS (SELECT f.*, root, row_number() OVER (PARTITION BY root ORDER BY list_position(['INVOICE', 'LEDGER', 'PAYMENT'], document_type), amount IS NULL, document_id) AS k FROM facts f JOIN roots ON id = document_id),
of_case AS (SELECT root, list(case_id ORDER BY case_id) AS case_ids FROM cases JOIN roots ON id = doc GROUP BY root),
transactions AS (SELECT 'txn:' || o.root AS transaction_id, list(document_id ORDER BY document_id) AS document_ids, list_sort(list_distinct(list(document_type))) AS document_types, min(document_id) FILTER (WHERE k = 1) AS primary_document_id,
   coalesce(arg_min(kind_said, document_id) FILTER (WHERE kind_said IS NOT NULL), 'revenue') AS kind, coalesce(arg_min(category, k) FILTER (WHERE category IS NOT NULL), CASE WHEN any_value(document_type) FILTER (WHERE k = 1) = 'INVOICE' THEN 'Sales' ELSE 'Uncategorised' END) AS category,
   arg_min(entity_raw, k) FILTER (WHERE entity_raw IS NOT NULL) AS counterparty, any_value(currency) FILTER (WHERE k = 1) AS currency,
   any_value(date) FILTER (WHERE k = 1) AS date, any_value(amount) FILTER (WHERE k = 1) AS amount, count(*) AS source_count, coalesce(any_value(case_ids), []) AS case_ids
   FROM ordered o LEFT JOIN of_case c ON c.root = o.root GROUP BY o.root),
""" + t.REVIEWS_SQL.strip() + """,
latest AS (SELECT case_id, arg_max(action, id) AS action FROM reviews GROUP BY case_id),
seen AS (SELECT c.*, CASE l.action WHEN 'ACCEPT' THEN 'ACCEPTED' WHEN 'REJECT' THEN 'REJECTED' WHEN 'CORRECT' THEN 'CORRECTED' ELSE status END AS now FROM cases c LEFT JOIN latest l USING (case_id)),
fixes AS (SELECT case_id, field, arg_max(corrected_value, id) AS value FROM reviews WHERE action = 'CORRECT' GROUP BY 1, 2),
held AS (SELECT transaction_id, unnest(case_ids) AS case_id, unnest(range(1, len(case_ids) + 1)) AS pos FROM transactions),
applied AS (SELECT transaction_id, count(*) AS n, arg_max(abs(TRY_CAST(regexp_replace(value, '[,$]', '', 'g') AS DOUBLE)), pos) FILTER (WHERE field = 'amount') AS amount,
   arg_max(value, pos) FILTER (WHERE field = 'category') AS category, arg_max(value, pos) FILTER (WHERE field = 'date') AS date FROM held JOIN fixes USING (case_id) GROUP BY 1),
stat AS (SELECT transaction_id, list(now) AS st FROM held JOIN seen USING (case_id) GROUP BY 1),
gated AS (SELECT t.* EXCLUDE (amount, category, date), coalesce(a.amount, t.amount::DOUBLE) AS amount, coalesce(a.category, t.category) AS category, coalesce(a.date::DATE, t.date) AS date, coalesce(a.n, 0) AS n_corrections,
   CASE WHEN list_contains(st, 'REJECTED') THEN 'QUARANTINED' WHEN list_has_any(st, ['ESCALATED', 'MISSING', 'AMBIGUOUS']) THEN 'PENDING_REVIEW' WHEN a.n > 0 OR list_contains(st, 'CORRECTED') THEN 'CORRECTED' WHEN list_contains(st, 'ACCEPTED') THEN 'ACCEPTED' WHEN len(st) > 0 THEN 'RECONCILED' ELSE 'SINGLE_SOURCE' END AS verification_status
   FROM transactions t LEFT JOIN applied a USING (transaction_id) LEFT JOIN stat USING (transaction_id))
"""


class Reviewed(reconcile.Run):
    """A run over a folder's documents, with the reviews and the gate."""

    def __init__(self, spark: SparkSession, sf_dir: str) -> None:
        self.reviews = t.reviews(spark, sf_dir)
        super().__init__(kept(t.facts(spark, sf_dir)), linking.LinkingConfig(), self.reviews)

    @cached_property
    def gated(self) -> DataFrame:
        """The transactions, without their cases, past the gate."""
        return kept(gate.with_status(self.groups, self.told, self.reviews))


@lru_cache(maxsize=4)
def _cached(app: str, sf_dir: str, spark: SparkSession) -> Reviewed:
    return Reviewed(spark, sf_dir)


def run_of(spark: SparkSession, sf_dir: str) -> Reviewed:
    return _cached(spark.sparkContext.applicationId, sf_dir, spark)


def _joined(*names: str) -> list:
    return [F.array_join(n, ",").alias(n) for n in names]


@query(_LINKS + "SELECT left_id, right_id, (SELECT identifier FROM facts f WHERE f.document_id = left_id) AS shared FROM dup")
def duplicate_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.duplicates(t.facts(spark, sf_dir)).select("left_id", "right_id", *_joined("shared"))


@query(_LINKS + """SELECT left_id, right_id, rel AS relationship, idm AS identifier_match, round(es, 3) AS entity_score, days::INTEGER AS days, CASE WHEN same_money THEN round(p, 4) END AS amount_percent,
same_money AND p <= 2 AS amount_compatible, round(score, 3) AS score, CASE WHEN score >= 0.38 THEN 'LINKED' ELSE 'AMBIGUOUS' END AS status FROM scored WHERE score >= 0.35""")
def link_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = linking.link_evidence(t.facts(spark, sf_dir))
    return got.select("left_id", "right_id", "relationship", "identifier_match", "entity_score", "days", F.round("amount_percent", 4).alias("amount_percent"), "amount_compatible", "score", "status")


def _small(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with names and mostly no identifiers, some of them close to several others."""
    parts = t.table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    key, none = F.col("p_partkey"), F.lit(None).cast("string")
    price = (F.col("p_retailprice").cast("decimal(18,2)") * (1 + key % 97)).cast("decimal(18,2)")

    def docs(prefix: str, kind: str, factor: str, name, days: int) -> DataFrame:
        return parts.select(
            F.concat(F.lit(prefix), F.lpad(key.cast("string"), 5, "0")).alias("document_id"), F.lit(kind).alias("document_type"), F.lit("x").alias("source_name"),
            F.when(key % 10 == 0, F.array(F.concat(F.lit("PO-"), key.cast("string")))).otherwise(F.array().cast("array<string>")).alias("identifiers"), (price * F.lit(factor).cast("decimal(5,3)")).cast("decimal(18,2)").alias("amount"),
            F.when(key % 7 == 0, "USD").when(key % 11 == 0, "EUR").otherwise(none).alias("currency"), F.date_add(F.lit("2000-01-01").cast("date"), (key % 60).cast("int") + days).alias("date"), name.alias("entity"), none.alias("category"), none.alias("entry_type"), F.lit(False).alias("low_confidence"),
        )

    invoices = docs("inv-", "INVOICE", "1.000", F.col("p_name"), 0)
    orders = docs("po-", "PURCHASE_ORDER", "1.015", F.concat("p_name", F.lit("s")), 40)
    paid = docs("pay-", "PAYMENT", "0.995", F.col("p_name"), 3)
    return invoices.unionByName(orders).unionByName(paid)


_SMALL = """WITH d AS (
  SELECT 'inv-' || lpad(p_partkey::VARCHAR, 5, '0') AS id, 'INVOICE' AS type, p_partkey AS k, p_name AS name, (p_retailprice::DECIMAL(18,2) * (1 + p_partkey % 97))::DECIMAL(18,2) AS amount, 0 AS days FROM part
  UNION ALL SELECT 'po-' || lpad(p_partkey::VARCHAR, 5, '0'), 'PURCHASE_ORDER', p_partkey, p_name || 's', ((p_retailprice::DECIMAL(18,2) * (1 + p_partkey % 97))::DECIMAL(18,2) * 1.015::DECIMAL(5,3))::DECIMAL(18,2), 40 FROM part
  UNION ALL SELECT 'pay-' || lpad(p_partkey::VARCHAR, 5, '0'), 'PAYMENT', p_partkey, p_name, ((p_retailprice::DECIMAL(18,2) * (1 + p_partkey % 97))::DECIMAL(18,2) * 0.995::DECIMAL(5,3))::DECIMAL(18,2), 3 FROM part),
x AS (SELECT *, CASE WHEN k % 10 = 0 THEN k END AS ref, CASE WHEN k % 7 = 0 THEN 'USD' WHEN k % 11 = 0 THEN 'EUR' END AS cur, (DATE '2000-01-01' + (k % 60 + days)::INTEGER) AS date FROM d),
q AS (SELECT least(i.id, p.id) AS left_id, greatest(i.id, p.id) AS right_id, 'INVOICE_' || p.type AS relationship, coalesce(i.ref = p.ref, false) AS idm, i.name AS a, p.name AS b, abs(i.date - p.date) AS dd,
   (i.cur IS NULL OR p.cur IS NULL OR i.cur = p.cur) AND abs(i.amount - p.amount)::DOUBLE / greatest(abs(i.amount), abs(p.amount), 1)::DOUBLE * 100 <= 2 AS am FROM x i JOIN x p ON i.type = 'INVOICE' AND p.type <> 'INVOICE'
   WHERE i.ref = p.ref OR abs(i.amount - p.amount)::DOUBLE / greatest(abs(i.amount), abs(p.amount), 1)::DOUBLE * 100 <= 2),
n AS (SELECT *, CASE WHEN a = b THEN 1.0 ELSE round(greatest(jaro_winkler_similarity(a, b), jaro_winkler_similarity(array_to_string(list_sort(string_split(a, ' ')), ' '), array_to_string(list_sort(string_split(b, ' ')), ' '))), 3) END AS es FROM q),
s AS (SELECT *, 0.6::DOUBLE * idm::INT + 0.2::DOUBLE * es + 0.15::DOUBLE * am::INT + 0.05::DOUBLE * greatest(0.0::DOUBLE, 1 - dd::DOUBLE / 90) AS score FROM n),
l AS (SELECT left_id, right_id, relationship, es, round(score, 3) AS score, CASE WHEN score >= 0.38 THEN 'LINKED' WHEN score >= 0.35 THEN 'AMBIGUOUS' END AS status FROM s WHERE score >= 0.35)
"""


@query(_SMALL + "SELECT left_id, right_id, relationship, round(es, 3) AS entity_score, round(score, 4) AS score, status FROM l")
def link_by_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links by name, amount and date; the SQL compares all pairs of like amounts or one reference."""
    return linking.link_evidence(_small(spark, sf_dir)).select("left_id", "right_id", "relationship", F.round("entity_score", 3).alias("entity_score"), F.round("score", 4).alias("score"), "status")


@query(_SMALL + "SELECT left_id, right_id, CASE WHEN status = 'LINKED' AND count(*) FILTER (WHERE status = 'LINKED') OVER (PARTITION BY left_id) > 1 THEN 'AMBIGUOUS' ELSE status END AS status FROM l")
def link_competition(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linking.competition(linking.link_evidence(_small(spark, sf_dir))).select("left_id", "right_id", "status")


@query(_LINKS + "SELECT left_id, right_id FROM alone")
def reference_free_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    facts = kept(t.facts(spark, sf_dir))
    return linking.unreferenced(facts, kept(linking.link_evidence(facts, full=facts.select("document_id").limit(0))))


@query(_LINKS + """SELECT left_id, right_id, 'amount' AS field, ast AS status, abs(la - ra)::DOUBLE AS difference, pct AS percent, ak AS discrepancy_type FROM kinds
UNION ALL SELECT left_id, right_id, 'date', dst, days::DOUBLE, NULL, dk FROM kinds
UNION ALL SELECT left_id, right_id, 'entity', est, NULL, NULL, ek FROM kinds WHERE est IS NOT NULL""")
def pair_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A row for each compared field of each pair."""
    made = run_of(spark, sf_dir)
    rows = reconcile.compare_pairs(made.pairs, made.facts).select("left_id", "right_id", F.explode("results").alias("r"))
    return rows.select("left_id", "right_id", "r.field", "r.status", "r.difference", "r.percent", "r.discrepancy_type")


@query(_LINKS + "SELECT left_id, right_id, worst AS status FROM kinds")
def worst_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = run_of(spark, sf_dir)
    return reconcile.compare_pairs(made.pairs, made.facts).select("left_id", "right_id", F.col("worst").alias("status"))


@query(CASES_SQL + "SELECT duplicate_id, case_id FROM folded")
def fold_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = run_of(spark, sf_dir)
    return reconcile.folded(made.compared).select("duplicate_id", "case_id")


@query(CASES_SQL + "SELECT id, root FROM roots")
def transaction_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_of(spark, sf_dir).roots


@query(CASES_SQL + "SELECT case_id, document_id FROM missing")
def missing_counterparts(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = run_of(spark, sf_dir)
    return reconcile.missing_cases(made.facts, made.pairs).select("case_id", F.col("document_ids")[0].alias("document_id"))


@query(CASES_SQL + "SELECT DISTINCT id AS document_id FROM copies WHERE id NOT IN (SELECT id FROM booked) AND id LIKE 'inv-%'")
def copies_of_booked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Invoices that no posting is linked to although one is to their copy."""
    made = run_of(spark, sf_dir)
    booked = reconcile.booked_documents(made.facts, made.pairs)
    twice = made.pairs.where("relationship = 'DUPLICATE'")
    both = twice.select(F.col("left_id").alias("document_id"), F.col("right_id").alias("copy")).unionByName(twice.select(F.col("right_id").alias("document_id"), F.col("left_id").alias("copy")))
    unbooked = both.join(booked, "document_id", "left_anti").join(booked.withColumnRenamed("document_id", "copy"), "copy", "left_semi")
    return unbooked.where("document_id LIKE 'inv-%'").select("document_id").distinct()


@query(CASES_SQL + "SELECT case_id, case_type, status, array_to_string(docs, ',') AS document_ids, array_to_string(types, ',') AS discrepancy_types, explanation, 'txn:' || root AS transaction_id FROM cases JOIN roots ON id = doc")
def reconciliation_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_of(spark, sf_dir).cases.select("case_id", "case_type", "status", *_joined("document_ids", "discrepancy_types"), "explanation", "transaction_id")


@query(CASES_SQL + """SELECT transaction_id, array_to_string(document_ids, ',') AS document_ids, array_to_string(document_types, ',') AS document_types, primary_document_id, kind, category, counterparty, currency, date, amount::DOUBLE AS amount,
array_to_string(case_ids, ',') AS case_ids, source_count FROM transactions""")
def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = run_of(spark, sf_dir).transactions
    return got.select("transaction_id", *_joined("document_ids", "document_types"), "primary_document_id", "kind", "category", "counterparty", "currency", "date", *doubles("amount"), *_joined("case_ids"), "source_count")


@query(CASES_SQL + """SELECT 'documents' AS name, count(*) AS value FROM facts UNION ALL SELECT 'links', count(*) FROM pairs UNION ALL SELECT 'transactions', count(*) FROM transactions UNION ALL SELECT 'cases', count(*) FROM cases
UNION ALL SELECT 'status:' || status, count(*) FROM cases GROUP BY 1 UNION ALL SELECT 'type:' || document_type, count(*) FROM facts GROUP BY 1""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = run_of(spark, sf_dir)
    return reconcile.summary(made.facts, made)


@query(CASES_SQL + "SELECT transaction_id, amount, category, date, n_corrections::INTEGER AS n_corrections FROM gated WHERE n_corrections > 0")
def applied_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = run_of(spark, sf_dir)
    got = gate.apply_corrections(made.groups, made.reviews, made.told).where("n_corrections > 0")
    return got.select("transaction_id", *doubles("amount"), "category", "date", F.col("n_corrections").cast("int").alias("n_corrections"))


@query(CASES_SQL + "SELECT transaction_id, verification_status FROM gated")
def gate_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_of(spark, sf_dir).gated.select("transaction_id", "verification_status")


@query(CASES_SQL + "SELECT transaction_id, kind, category, date, amount, verification_status FROM gated WHERE verification_status IN ('RECONCILED', 'SINGLE_SOURCE', 'ACCEPTED', 'CORRECTED') AND amount IS NOT NULL AND date IS NOT NULL")
def verified_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.verified(run_of(spark, sf_dir).gated).select("transaction_id", "kind", "category", "date", *doubles("amount"), "verification_status")


@query(CASES_SQL + "SELECT case_id, now AS status, status AS computed_status FROM seen WHERE now IN ('ESCALATED', 'MISSING', 'AMBIGUOUS') ORDER BY CASE now WHEN 'ESCALATED' THEN 0 WHEN 'MISSING' THEN 1 ELSE 2 END, case_id")
def case_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = run_of(spark, sf_dir)
    return gate.case_queue(gate.reviewed_cases(made.found, made.reviews), "open").select("case_id", "status", "computed_status")


@query(CASES_SQL + "SELECT case_id, now AS status FROM seen WHERE now IN ('ACCEPTED', 'REJECTED', 'CORRECTED')")
def reviewed_case_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = run_of(spark, sf_dir)
    return gate.case_queue(gate.reviewed_cases(made.telling, made.reviews), "reviewed").select("case_id", "status")


@query(CASES_SQL + "SELECT unnest(types) AS discrepancy_type, count(*) AS n FROM seen WHERE now IN ('ESCALATED', 'MISSING', 'AMBIGUOUS') GROUP BY 1")
def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = run_of(spark, sf_dir)
    return gate.review_queue(gate.reviewed_cases(made.found, made.reviews))


@query(CASES_SQL + """, e AS (SELECT unnest(docs) AS d, (now IN ('ESCALATED', 'MISSING', 'AMBIGUOUS', 'ACCEPTED', 'REJECTED', 'CORRECTED'))::INT AS h FROM seen
  UNION ALL SELECT unnest(document_ids), 0 FROM transactions WHERE list_has_any(document_types, ['INVOICE', 'PAYMENT', 'PURCHASE_ORDER']) OR len(document_ids) > 1),
p AS (SELECT d, max(h) AS h FROM e GROUP BY d)
SELECT count(*) AS needing, sum(h)::BIGINT AS human, (count(*) - sum(h))::BIGINT AS cleared, round(1 - sum(h)::DOUBLE / count(*), 4) AS reduction, round(1 - sum(h)::DOUBLE / count(*), 4) >= 0.6 AS meets_target FROM p""")
def review_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = run_of(spark, sf_dir)
    return gate.review_efficiency(gate.reviewed_cases(made.telling, made.reviews), made.groups)


@query(CASES_SQL + "SELECT f.document_id, f.document_type, g.transaction_id, g.kind, g.verification_status, g.amount FROM facts f LEFT JOIN (SELECT unnest(document_ids) AS document_id, * EXCLUDE (document_ids) FROM gated) g USING (document_id)")
def documents_with_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = run_of(spark, sf_dir)
    return gate.documents_with_status(made.facts.select("document_id", "document_type"), made.gated).select("document_id", "document_type", "transaction_id", "kind", "verification_status", *doubles("amount"))


@query(CASES_SQL + """SELECT s.case_id, s.now AS status, (SELECT count(*) FROM reviews r WHERE r.case_id = s.case_id) AS n_reviews, (SELECT string_agg(f.document_id || ':' || f.document_type, ',' ORDER BY f.document_id) FROM facts f WHERE list_contains(s.docs, f.document_id)) AS documents
FROM seen s WHERE s.case_id IN (SELECT case_id FROM reviews)""")
def case_details(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviewed cases with their documents and how often they were reviewed."""
    made = run_of(spark, sf_dir)
    counted = made.reviews.groupBy("case_id").agg(F.count(F.lit(1)).alias("n_reviews"))
    cases = cut(gate.reviewed_cases(made.telling.select("case_id", "status", "document_ids").join(counted, "case_id"), made.reviews))  # no more than are reviewed
    docs = cases.select("case_id", F.explode("document_ids").alias("document_id")).join(made.facts.select("document_id", "document_type"), "document_id")
    listed = docs.groupBy("case_id").agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(":", "document_id", "document_type"))), ",").alias("documents"))
    return cases.join(listed, "case_id").select("case_id", "status", "n_reviews", "documents")


@query(CASES_SQL + """SELECT (SELECT count(*) FROM facts) AS documents, (SELECT count(*) FROM transactions) AS transactions, count(*) FILTER (WHERE v) AS verified, round(count(*) FILTER (WHERE v)::DOUBLE / count(*), 4) AS verified_rate,
round(count(*) FILTER (WHERE verification_status IN ('RECONCILED', 'SINGLE_SOURCE'))::DOUBLE / count(*), 4) AS auto_verified_rate, (SELECT count(*) FROM seen WHERE now IN ('ESCALATED', 'MISSING', 'AMBIGUOUS')) AS open_cases,
(SELECT count(*) FROM seen WHERE now IN ('ACCEPTED', 'REJECTED', 'CORRECTED')) AS reviewed_cases, (SELECT count(*) FROM cases) AS total_cases, (SELECT count(*) FROM facts WHERE n % 53 = 0) AS low_confidence
FROM (SELECT *, verification_status IN ('RECONCILED', 'SINGLE_SOURCE', 'ACCEPTED', 'CORRECTED') AS v FROM gated)""")
def workspace_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = run_of(spark, sf_dir)
    total, n = F.count(F.lit(1)), lambda flag: F.coalesce(F.sum(flag.cast("long")), F.lit(0))
    auto = n(F.col("verification_status").isin("RECONCILED", "SINGLE_SOURCE"))
    rate = lambda x: F.when(total > 0, F.round(x / total, 4))
    records = made.gated.agg(total.alias("transactions"), n(F.col("verified")).alias("verified"), rate(n(F.col("verified"))).alias("verified_rate"), rate(auto).alias("auto_verified_rate"))
    seen = gate.reviewed_cases(made.found, made.reviews).agg(n(F.col("status").isin(*reconcile.OPEN)).alias("open_cases"), n(F.col("status").isin(*gate.REVIEWED.values())).alias("reviewed_cases"), total.alias("total_cases"))
    return made.facts.agg(total.alias("documents"), n(F.col("low_confidence")).alias("low_confidence")).crossJoin(records).crossJoin(seen)  # one row each


@query(CASES_SQL + "SELECT category, count(*) AS n FROM gated WHERE category <> '' GROUP BY category ORDER BY n DESC, category LIMIT 12")
def top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_of(spark, sf_dir).gated.where("category <> ''").groupBy("category").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "category").limit(12)


@query(CASES_SQL + "SELECT unnest(document_types) AS document_type, count(*) AS n, sum(amount) > 0 AS some FROM gated WHERE verification_status = 'RECONCILED' GROUP BY 1")
def data_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which kinds of documents reconciled transactions came from."""
    own = run_of(spark, sf_dir).gated.where("verification_status = 'RECONCILED'").select(F.explode("document_types").alias("document_type"), "amount")
    return own.groupBy("document_type").agg(F.count(F.lit(1)).alias("n"), (F.sum("amount") > 0).alias("some"))


def _fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven fields of each order's document, as the mapper leaves them."""
    key = F.col("o_orderkey")
    field = lambda pos, label, role, raw, number=None, date=None, string=None, conf=0.9: F.struct(
        F.lit(pos).alias("pos"), F.lit(label).alias("label"), F.lit(role).cast("string").alias("role"), raw.cast("string").alias("raw"),
        (F.lit(None) if number is None else number).cast("double").alias("number"), (F.lit(None) if date is None else date).cast("date").alias("date"),
        (F.lit(None) if string is None else string).cast("string").alias("string"), (F.lit(conf) if isinstance(conf, float) else conf).cast("double").alias("confidence"),
    )
    price = F.col("o_totalprice")
    rows = F.array(
        field(0, "balance due", "BALANCE_DUE", price, number=price * -1), field(1, "total", "TRANSACTION_TOTAL", price, number=F.when(key % 4 != 0, price), conf=(key % 10) / 10.0),
        field(2, "category", None, F.when(key % 3 == 0, "Travel")), field(3, "invoice date", "DOCUMENT_DATE", F.col("o_orderdate"), date=F.col("o_orderdate").cast("date")),
        field(4, "order id", "ORDER_ID", key, string=F.concat(F.lit("O"), key.cast("string"))), field(5, "account", None, F.when(key % 5 == 0, "Rent")),
        field(6, "bill to", "VENDOR", F.col("o_orderpriority"), string=F.lower("o_orderpriority")),
    )
    return t.table(spark, sf_dir, "orders").select(F.concat(F.lit("d"), key.cast("string")).alias("document_id"), F.lit("INVOICE").alias("document_type"), F.explode(rows).alias("f")).select("document_id", "document_type", "f.*")


@query("""SELECT 'd' || o_orderkey AS document_id, 'O' || o_orderkey AS identifiers, abs(o_totalprice) AS amount, CAST(o_orderdate AS DATE) AS date, lower(o_orderpriority) AS entity,
CASE WHEN o_orderkey % 5 = 0 THEN 'Rent' WHEN o_orderkey % 3 = 0 THEN 'Travel' END AS category, CASE WHEN o_orderkey % 4 <> 0 AND o_orderkey % 10 < 6 THEN 'total' ELSE '' END AS weak_fields, o_orderkey % 4 <> 0 AND o_orderkey % 10 < 6 AS low_confidence FROM orders""")
def document_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = reconcile.document_facts(_fields(spark, sf_dir)).withColumn("weak_fields", F.transform("weak_fields", lambda w: w["label"]))
    return got.select("document_id", *_joined("identifiers"), "amount", "date", "entity", "category", *_joined("weak_fields"), "low_confidence")


@query("""WITH f AS (SELECT 'd' || o_orderkey AS document_id, unnest(range(0, 7)) AS pos, unnest(['balance due', 'total', 'category', 'invoice date', 'order id', 'account', 'bill to']) AS label FROM orders)
SELECT a.document_id, a.label, string_agg(b.label, ',' ORDER BY b.pos) AS nearby FROM f a JOIN f b ON a.document_id = b.document_id AND a.pos <> b.pos AND abs(a.pos - b.pos) <= 2 GROUP BY 1, 2""")
def nearby_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.nearby(_fields(spark, sf_dir)).select("document_id", "label", *_joined("nearby"))

"""Stored tables and how they change, conversations, chunks and their search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.operators import gate, ingest, retrieval, store
from tallywright.plans.base import doubles, query
from tallywright.sources import tables as t


def _customers(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Stored rows, and a batch that repeats every third of them and has new ones."""
    rows = t.table(spark, sf_dir, "customer")
    old = rows.select(F.col("c_custkey").alias("document_id"), F.col("c_mktsegment").alias("source_name"), F.lit(1).alias("version"))
    new = rows.where("c_custkey % 3 = 0").select((F.col("c_custkey") * 2).alias("document_id"), F.lit("batch").alias("source_name"), (F.col("c_custkey") % 5 + 2).cast("int").alias("version"))
    return old, new


_CUSTOMERS = """WITH old AS (SELECT c_custkey AS document_id, c_mktsegment AS source_name, 1 AS version FROM customer),
new AS (SELECT c_custkey * 2 AS document_id, 'batch' AS source_name, (c_custkey % 5 + 2)::INTEGER AS version FROM customer WHERE c_custkey % 3 = 0) """


@query(_CUSTOMERS + "SELECT * FROM old WHERE document_id NOT IN (SELECT document_id FROM new) UNION ALL SELECT * FROM new")
def upsert_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.upsert(*_customers(spark, sf_dir), ["document_id"], "version")


@query(_CUSTOMERS + "SELECT * FROM old UNION ALL SELECT * FROM new WHERE document_id NOT IN (SELECT document_id FROM old)")
def insert_absent(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.insert_absent(*_customers(spark, sf_dir), ["document_id"])


@query(_CUSTOMERS + "SELECT * FROM old WHERE document_id NOT IN (SELECT document_id FROM new) UNION ALL SELECT * FROM new WHERE document_id IN (SELECT document_id FROM old)")
def update_existing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.update_existing(*_customers(spark, sf_dir), ["document_id"])


@query(_CUSTOMERS + "SELECT count(*) FILTER (WHERE source_name <> 'BUILDING') AS kept, count(*) FILTER (WHERE source_name = 'BUILDING') AS deleted FROM old")
def delete_by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, count = store.delete_where(_customers(spark, sf_dir)[0], F.col("source_name") == "BUILDING")
    return kept.agg(F.count(F.lit(1)).alias("kept")).crossJoin(count)  # one row each


_SNAPS = """WITH old AS (SELECT o_orderkey AS id, o_orderpriority AS metric, o_orderkey % 1000 AS input FROM orders WHERE o_orderstatus = 'F'),
new AS (SELECT DISTINCT o_orderpriority AS metric, o_orderkey % 1000 AS input FROM orders WHERE o_orderstatus <> 'F') """


def _snapshots(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    orders = t.table(spark, sf_dir, "orders")
    columns = [F.col("o_orderpriority").alias("metric"), (F.col("o_orderkey") % 1000).alias("input")]
    return orders.where("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"), *columns), orders.where("o_orderstatus <> 'F'").select(*columns)


@query(_SNAPS + """, fresh AS (SELECT * FROM new WHERE NOT EXISTS (SELECT 1 FROM old WHERE old.metric = new.metric AND old.input = new.input))
SELECT * FROM old UNION ALL SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY metric, input), metric, input FROM fresh""")
def save_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.with_ids(*_snapshots(spark, sf_dir), ["metric", "input"])


@query(_SNAPS + "SELECT * FROM old ORDER BY id DESC LIMIT 20")
def latest_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _snapshots(spark, sf_dir)[0].orderBy(F.desc("id")).limit(20)


def _case_tables(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    events = t.table(spark, sf_dir, "events")
    old = events.groupBy(F.concat(F.lit("c"), F.col("event_id") % 4000).alias("case_id")).agg(F.max_by("event_type", "event_id").alias("status"))
    new = events.where("event_id % 4000 < 3000").select(F.concat(F.lit("c"), F.col("event_id") % 4000 + 500).alias("case_id"), F.lit("RUN").alias("status")).distinct()
    return old, new, events.where("event_type = 'error'").select(F.concat(F.lit("c"), F.col("event_id") % 4000).alias("case_id"))


_CASE_TABLES = """WITH old AS (SELECT 'c' || (event_id % 4000) AS case_id, arg_max(event_type, event_id) AS status FROM events GROUP BY 1),
new AS (SELECT DISTINCT 'c' || (event_id % 4000 + 500) AS case_id, 'RUN' AS status FROM events WHERE event_id % 4000 < 3000),
acts AS (SELECT DISTINCT 'c' || (event_id % 4000) AS case_id FROM events WHERE event_type = 'error'),
merged AS (SELECT coalesce(n.case_id, o.case_id) AS case_id, CASE WHEN n.case_id IS NULL THEN o.status WHEN o.case_id IS NOT NULL AND n.case_id IN (SELECT case_id FROM acts) THEN o.status ELSE n.status END AS status,
  n.case_id IS NOT NULL AS made FROM old o FULL JOIN new n USING (case_id)) """


@query(_CASE_TABLES + "SELECT case_id, status FROM merged")
def upsert_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.upsert_cases(*_case_tables(spark, sf_dir))


@query(_CASE_TABLES + "SELECT case_id, status FROM merged WHERE made OR case_id IN (SELECT case_id FROM acts)")
def replace_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.replace_run(*_case_tables(spark, sf_dir))


@query("""SELECT n_name AS key, array_to_string(list_sort(map_entries(m).list_filter(lambda e: trim(e.key) <> '' AND e.value > 0).list_transform(lambda e: e.key || '=' || e.value::INTEGER)), ',') AS budgets
FROM (SELECT n_name, MAP {'rent': n_nationkey * 10 - 50, '': 5, 'travel': n_nationkey % 3} AS m FROM nation)""")
def settings_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation = t.table(spark, sf_dir, "nation")
    made = F.create_map(F.lit("rent"), F.col("n_nationkey") * 10 - 50, F.lit(""), F.lit(5), F.lit("travel"), F.col("n_nationkey") % 3)
    new = nation.select(F.col("n_name").alias("key"), made.alias("budgets"))
    merged = store.settings(new.limit(0), new)
    said = F.array_sort(F.transform(F.map_entries("budgets"), lambda e: F.concat_ws("=", e["key"], e["value"].cast("string"))))
    return merged.select("key", F.array_join(said, ",").alias("budgets"))


_HASHED = ["case_id", "action", "field", "corrected_value", "reviewer"]


@query("SELECT event_id AS id, 'changed' AS problem FROM events WHERE event_type = 'error' UNION ALL SELECT min(event_id), 'broken before' FROM events WHERE event_type IN ('click', 'error', 'purchase') AND event_id > (SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS n FROM events WHERE event_type IN ('click', 'error', 'purchase')) WHERE n = 10)")
def audit_chain_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A chained log in which rejections were edited and the tenth entry was deleted."""
    log = store.chained(t.reviews(spark, sf_dir), _HASHED)
    tenth = log.orderBy("id").limit(10).agg(F.max("id").alias("gone"))
    edited = log.withColumn("reviewer", F.when(F.col("action") == "REJECT", "someone else").otherwise(F.col("reviewer")))
    return store.verify_chain(edited.crossJoin(F.broadcast(tenth)).where("id <> gone"), _HASHED).select("id", "problem")  # one row


@query("WITH " + t.REVIEWS_SQL.strip() + " SELECT id, case_id, action FROM reviews ORDER BY id DESC LIMIT 100")
def audit_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.reviews(spark, sf_dir).select("id", "case_id", "action").orderBy(F.desc("id")).limit(100)


@query("WITH " + t.REVIEWS_SQL.strip() + " SELECT case_id, field, arg_max(corrected_value, id) AS value FROM reviews WHERE action = 'CORRECT' GROUP BY 1, 2")
def latest_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.corrections(t.reviews(spark, sf_dir))


@query("WITH " + t.REVIEWS_SQL.strip() + " SELECT reviewer, max(id) AS id, arg_max(case_id, id) AS case_id FROM reviews GROUP BY reviewer")
def last_run_of_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gate.latest_by(t.reviews(spark, sf_dir).select("reviewer", "id", "case_id"), "reviewer", "id")


@query("""WITH c AS (SELECT DISTINCT conv_id FROM conversations UNION SELECT max(conv_id) + 1 FROM conversations)
SELECT c.conv_id, count(m.turn) AS n_messages, max(m.turn) AS last_turn, min(substr(trim(regexp_replace(m.text, '\\s+', ' ', 'g')), 1, 48)) FILTER (WHERE m.turn = f.t) AS title
FROM c LEFT JOIN conversations m USING (conv_id) LEFT JOIN (SELECT conv_id, min(turn) AS t FROM conversations GROUP BY 1) f USING (conv_id) GROUP BY c.conv_id""")
def chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations, also empty ones, with their number of messages and a title from the first."""
    messages = t.table(spark, sf_dir, "conversations")
    known = messages.select("conv_id").union(messages.agg((F.max("conv_id") + 1).alias("conv_id"))).distinct()
    title = F.substring(F.trim(F.regexp_replace("text", r"\s+", " ")), 1, 48)
    counted = messages.groupBy("conv_id").agg(F.count("turn").alias("n"), F.max("turn").alias("last_turn"), F.min_by(title, F.struct("turn", title)).alias("title"))
    return known.join(counted, "conv_id", "left").select("conv_id", F.coalesce("n", F.lit(0)).alias("n_messages"), "last_turn", "title")


@query("SELECT 'message' AS kind, count(*) AS n FROM conversations WHERE conv_id % 7 <> 0 UNION ALL SELECT 'conversation', count(DISTINCT conv_id) FROM conversations WHERE conv_id % 7 <> 0")
def delete_chats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleting conversations takes their messages along."""
    messages = t.table(spark, sf_dir, "conversations")
    kept, left = store.cascade(messages.select("conv_id").distinct(), messages, "conv_id", F.col("conv_id") % 7 == 0)
    count = F.count(F.lit(1)).alias("n")
    return left.agg(count).select(F.lit("message").alias("kind"), "n").unionByName(kept.agg(count).select(F.lit("conversation").alias("kind"), "n"))


def _chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as chunks with metadata."""
    key, none = F.col("vec_id"), F.lit(None).cast("string")
    meta = F.create_map(F.lit("vendor"), F.concat(F.lit("v"), F.col("label")), F.lit("date"), F.when(key % 9 == 0, "soon").otherwise(F.date_add(F.lit("2020-01-01").cast("date"), (key % 300).cast("int")).cast("string")))
    return t.table(spark, sf_dir, "embeddings").select(
        F.when(key % 50 == 1, none).otherwise(F.concat(F.lit("k"), key.cast("string"))).alias("chunk_id"), F.concat(F.lit("d"), key % 40).alias("document_id"), F.when(key % 2 == 0, "Invoice").otherwise("LEDGER").alias("document_type"),
        F.when(key % 60 == 2, " ").otherwise(F.concat(F.lit("text of "), key.cast("string"))).alias("chunk_text"), meta.alias("metadata"), "embedding", key.alias("id"),
    )


_CHUNKS = """WITH c AS (SELECT vec_id AS id, CASE WHEN vec_id % 50 = 1 THEN NULL ELSE 'k' || vec_id END AS chunk_id, 'd' || (vec_id % 40) AS document_id, CASE WHEN vec_id % 2 = 0 THEN 'Invoice' ELSE 'LEDGER' END AS document_type,
 CASE WHEN vec_id % 60 = 2 THEN ' ' ELSE 'text of ' || vec_id END AS chunk_text, 'v' || label AS vendor, CASE WHEN vec_id % 9 <> 0 THEN (DATE '2020-01-01' + (vec_id % 300)::INTEGER) END AS day, embedding FROM embeddings) """


@query(_CHUNKS + ", q AS (SELECT embedding AS e FROM c WHERE id = 0) SELECT id, round(list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]), 6) AS similarity FROM c, q WHERE vendor = 'v3' ORDER BY list_cosine_similarity(embedding::DOUBLE[], e::DOUBLE[]) DESC, id LIMIT 5")
def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five chunks of one vendor nearest to the first vector."""
    asked = [float(x) for x in t.table(spark, sf_dir, "embeddings").where("vec_id = 0").first()["embedding"]]
    got = retrieval.vector_topk(retrieval.metadata_filter(_chunks(spark, sf_dir), vendor="v3"), asked)
    return got.select("id", F.round("similarity", 6).alias("similarity"))


@query(_CHUNKS + "SELECT id FROM c WHERE lower(document_type) = 'invoice' AND vendor = 'v2' AND day BETWEEN DATE '2020-02-01' AND DATE '2020-09-30'")
def metadata_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return retrieval.metadata_filter(_chunks(spark, sf_dir), document_type="INVOICE", vendor="v2", date_from="2020-02-01", date_to="2020-09-30").select("id")


@query(_CHUNKS + "SELECT id, CASE WHEN chunk_id IS NULL THEN 'no id' WHEN trim(chunk_text) = '' THEN 'no text' END AS problem FROM c")
def valid_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return store.valid_chunks(_chunks(spark, sf_dir), 64).select("id", "problem")


@query(_CHUNKS + """, old AS (SELECT id, chunk_text FROM c WHERE id % 3 <> 0), new AS (SELECT id, CASE WHEN id % 5 = 0 THEN 'new' ELSE chunk_text END AS chunk_text FROM c WHERE id % 4 <> 0)
SELECT id, CASE WHEN o.chunk_text IS NULL THEN 'insert' WHEN n.chunk_text IS NULL THEN 'stale' WHEN o.chunk_text = n.chunk_text THEN 'unchanged' ELSE 'update' END AS action FROM old o FULL JOIN new n USING (id)""")
def chunk_sync(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What keeping stored chunks in step with generated ones takes."""
    rows = _chunks(spark, sf_dir).select("id", "chunk_text")
    new = rows.where("id % 4 <> 0").withColumn("chunk_text", F.when(F.col("id") % 5 == 0, "new").otherwise(F.col("chunk_text")))
    return store.sync_plan(rows.where("id % 3 <> 0"), new, "id", ["chunk_text"])


@query("""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL)
SELECT doc_id, i::INTEGER AS i, doc_id || ':chunk-' || printf('%04d', i) || '-' || substr(sha256(doc_id || chr(10) || i || chr(10) || line), 1, 16) AS chunk_id FROM l""")
def chunk_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "documents").where("text IS NOT NULL").select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "line"))
    return rows.select("doc_id", "i", retrieval.chunk_id(F.col("doc_id"), F.col("i"), F.col("line")).alias("chunk_id"))


@query()
def chunk_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = t.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("document_id"), F.split("text", "\n").alias("units"))
    return retrieval.chunk_documents(docs).select("document_id", "index", "chunk_id", F.length("chunk_text").alias("n_chars"))


@query("""WITH r AS (SELECT conv_id AS query_id, turn AS rank, 'm' || turn AS chunk_id, role, text FROM conversations WHERE text <> ''), o AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY query_id, chunk_id ORDER BY rank, role, text) = 1),
s AS (SELECT query_id, rank, CASE WHEN row_number() OVER (PARTITION BY query_id ORDER BY rank) > 1 THEN chr(10) || chr(10) ELSE '' END || '[Document ' || query_id || ' | Type: ' || role || ' | Chunk: ' || chunk_id || ']' || chr(10) || text AS sec FROM o),
b AS (SELECT *, coalesce(sum(length(sec)) OVER (PARTITION BY query_id ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM s)
SELECT query_id, string_agg(substr(sec, 1, 700 - before::INTEGER), '' ORDER BY rank) AS context FROM b WHERE before + CASE WHEN before > 0 THEN 2 ELSE 0 END < 700 GROUP BY query_id""")
def prepare_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min(F.struct("role", "text")).alias("m"))
    rows = rows.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("rank"), F.concat(F.lit("m"), F.col("turn").cast("string")).alias("chunk_id"), F.col("conv_id").cast("string").alias("document_id"), F.col("m.role").alias("document_type"), F.col("m.text").alias("chunk_text"))
    return retrieval.prepare_context(rows, 700)


@query("SELECT role || ':' || substr(text, 1, 3) AS word, min(conv_id * 1000 + turn) AS pos FROM conversations WHERE text IS NOT NULL GROUP BY 1")
def distinct_in_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "conversations").where("text IS NOT NULL").select(F.concat_ws(":", "role", F.substring("text", 1, 3)).alias("word"), (F.col("conv_id") * 1000 + F.col("turn")).alias("pos"))
    return retrieval.distinct_in_order(rows, "word", "pos")


@query("SELECT source AS source_name, count(*) AS n FROM documents GROUP BY source")
def records_per_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "documents").groupBy(F.col("source").alias("source_name")).agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_id FROM documents WHERE contains(lower(concat_ws(' ', doc_id, source, lang)), 'en') ORDER BY doc_id LIMIT 400")
def search_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return t.table(spark, sf_dir, "documents").where(F.lower(F.concat_ws(" ", F.col("doc_id").cast("string"), "source", "lang")).contains("en")).select("doc_id").orderBy("doc_id").limit(400)


@query("""SELECT 'customer-row-' || printf('%04d', c_custkey) AS document_id, 'field-' || i AS field_id, label, value FROM (SELECT c_custkey, unnest([1, 2, 3]) AS i, unnest(['c_name', 'c_mktsegment', 'c_nationkey']) AS label,
unnest([c_name, c_mktsegment, c_nationkey::VARCHAR]) AS value FROM customer)""")
def rows_as_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = t.table(spark, sf_dir, "customer").select(ingest.row_id(F.lit("customer"), F.col("c_custkey")).alias("id"), "c_name", "c_mktsegment", "c_nationkey")
    return ingest.unpivot(rows, "id").select("document_id", F.explode("fields").alias("f")).select("document_id", "f.field_id", "f.label", "f.value")


def _built(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = lambda i, label, conf: F.struct(F.lit(i).cast("string").alias("field_id"), F.lit(label).cast("string").alias("label"), F.lit("v").alias("value"), conf.cast("double").alias("confidence"))
    key = F.col("p_partkey")
    fields = F.array(field("own", "a", (key % 10) / 10.0), field(None, None, F.when(key % 4 != 0, 0.9)), field(None, "c", F.when(key % 3 != 0, 0.5)))
    fields = F.when(key % 12 == 0, F.array(field(None, "x", F.lit(None)))).otherwise(fields)
    return ingest.build(t.table(spark, sf_dir, "part").select(key.alias("document_id"), ingest.adapted(fields).alias("fields")))


@query("""WITH f AS (SELECT p_partkey AS document_id, CASE WHEN p_partkey % 12 = 0 THEN [NULL]::DOUBLE[] ELSE [p_partkey % 10 / 10.0, CASE WHEN p_partkey % 4 <> 0 THEN 0.9 END, CASE WHEN p_partkey % 3 <> 0 THEN 0.5 END]::DOUBLE[] END AS c,
 CASE WHEN p_partkey % 12 = 0 THEN ['field-0'] ELSE ['own', 'field-1', 'field-2'] END AS ids FROM part),
m AS (SELECT *, CASE WHEN len(list_filter(c, lambda x: x IS NOT NULL)) > 0 THEN round(list_sum(list_filter(c, lambda x: x IS NOT NULL)) / len(list_filter(c, lambda x: x IS NOT NULL)), 4) ELSE 0.0 END AS mean FROM f)
SELECT document_id, mean AS extraction_confidence, mean < 0.85 AS low_confidence, array_to_string(list_filter(list_transform(ids, lambda x, i: CASE WHEN c[i] < 0.6 THEN x END), lambda x: x IS NOT NULL), ',') AS weak FROM m""")
def built_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents from fields without ids or confidences, and what is to be checked in them."""
    return _built(spark, sf_dir).select("document_id", *doubles("extraction_confidence"), "low_confidence", F.array_join("low_confidence_fields", ",").alias("weak"))


@query("""SELECT 'd' || p_partkey AS document_id, string_agg(unit, '|' ORDER BY n) AS units FROM (SELECT p_partkey, unnest(range(0, 8)) AS n, unnest([
  'Document type: invoice. Document ID: d' || p_partkey || '.', 'Invoice number: P-' || p_partkey, 'Total due: ' || p_size,
  CASE WHEN p_partkey % 3 > 0 THEN 'Terms: ' || CASE WHEN p_partkey % 3 = 1 THEN 'Days: 30; Note text: pay, soon' ELSE 'a, b' END END,
  'Line items:', 'Line item 1: Item name: ' || p_name || '; Qty: ' || (p_partkey % 5), 'Line item 2: Kind: ' || p_type, CASE WHEN p_partkey % 2 = 0 THEN 'Extracted text: about ' || p_brand END]) AS unit FROM part)
WHERE unit IS NOT NULL GROUP BY p_partkey""")
def document_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is said of documents with nested values and tables, before it is cut into chunks."""
    key = F.col("p_partkey")
    terms = F.when(key % 3 == 1, F.lit('{"note_text":["pay",null,"soon"],"days":30,"none":{}}')).when(key % 3 == 2, F.lit('["a","b",""]')).otherwise(F.lit("null"))
    text = lambda c: F.to_json(F.struct(c.alias("x")))
    quoted = lambda c: F.substring(text(c), F.lit(6), F.length(text(c)) - 6)
    field = lambda label, value: F.struct(F.lit(label).alias("label"), F.parse_json(value).alias("value"))
    first = F.concat(F.lit("["), quoted(F.col("p_name")), F.lit(","), (key % 5).cast("string"), F.lit("]"))
    second = F.concat(F.lit('{"kind":'), quoted(F.col("p_type")), F.lit(',"empty":""}'))
    table = F.struct(F.array(F.lit("item_name"), F.lit("QTY")).alias("headers"), F.array(F.parse_json(first), F.parse_json(second), F.parse_json(F.lit("[]"))).alias("rows"))
    documents = t.table(spark, sf_dir, "part").select(
        F.concat(F.lit("d"), key.cast("string")).alias("document_id"), F.lit("INVOICE").alias("document_type"),
        F.array(field("terms", terms), field("total__due", F.col("p_size").cast("string")), field("Invoice_NUMBER", F.concat(F.lit('"P-'), key.cast("string"), F.lit('"'))), field(" ", F.lit("1"))).alias("fields"),
        F.array(table).alias("tables"), F.when(key % 2 == 0, F.concat(F.lit("about "), "p_brand")).alias("text"),
    )
    return retrieval.document_units(documents).select("document_id", F.array_join("units", "|").alias("units"))

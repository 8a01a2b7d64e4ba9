"""Tables that are replaced, merged and appended to, as functions from old rows to new ones.

Parquet has no MERGE, so a merge is an anti-join and a union; what is written is
the caller's business.  Within one batch of new rows the last by ``order`` wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallywright.operators.components import cut
from tallywright.operators.gate import REVIEWED

GENESIS = "0" * 64


def last_of(rows: DataFrame, key: list[str], order: str | None) -> DataFrame:
    if order is None:
        return rows
    return rows.groupBy(*key).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """New rows in place of old ones of the same key; columns that either lacks are null."""
    new = last_of(new, key, order)
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def insert_absent(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """Old rows, and new ones whose key is not there yet."""
    return old.unionByName(last_of(new, key, order).join(old.select(*key), key, "left_anti"), allowMissingColumns=True)


def with_ids(old: DataFrame, new: DataFrame, key: list[str], id_col: str = "id") -> DataFrame:
    """``insert_absent`` for rows that get the next numbers as ids, in order of their key."""
    fresh = new.dropDuplicates(key).join(old.select(*key), key, "left_anti")
    top = old.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("top"))
    numbered = fresh.withColumn("n", F.row_number().over(Window.orderBy(*key))).crossJoin(F.broadcast(top))  # one row
    return old.unionByName(numbered.withColumn(id_col, (F.col("top") + F.col("n")).cast(old.schema[id_col].dataType)).drop("n", "top"))


def update_existing(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """Old rows, with new ones in place of those that are there; others are ignored."""
    known = new.join(old.select(*key), key, "left_semi")
    return upsert(old, known, key)


def delete_where(old: DataFrame, gone: Column) -> tuple[DataFrame, DataFrame]:
    """What stays, and one row with the number of rows that go."""
    flag = F.coalesce(gone, F.lit(False))
    return old.where(~flag), old.agg(F.coalesce(F.sum(flag.cast("long")), F.lit(0)).alias("deleted"))


def upsert_cases(old: DataFrame, new: DataFrame, actions: DataFrame) -> DataFrame:
    """Cases merged by case_id; one that was reviewed keeps its status, whatever a run says."""
    kept = old.select("case_id", F.col("status").alias("kept")).join(actions.select("case_id").distinct(), "case_id", "left_semi")
    merged = new.join(kept, "case_id", "left").withColumn("status", F.coalesce("kept", "status")).drop("kept")
    return upsert(old, merged.select(*new.columns), ["case_id"])


def replace_run(old: DataFrame, new: DataFrame, actions: DataFrame) -> DataFrame:
    """Cases after a run: those it makes, merged, and reviewed ones that it makes no longer."""
    merged = upsert_cases(old, new, actions)
    stay = new.select("case_id").union(actions.select("case_id")).distinct()
    return merged.join(stay, "case_id", "left_semi")


def settings(old: DataFrame, new: DataFrame) -> DataFrame:
    """(key, budgets) merged, without blank names and budgets that are not above zero."""
    clean = new.withColumn("budgets", F.map_filter("budgets", lambda k, v: (F.trim(k) != "") & (v > 0)))
    return upsert(old, clean, ["key"])


def entry_body(fields: list[str]) -> Column:
    """An entry's fields in order, quoted, null as such."""
    quoted = [F.coalesce(F.concat(F.lit('"'), F.regexp_replace(F.col(f).cast("string"), r'(["\\])', r"\\$1"), F.lit('"')), F.lit("null")) for f in fields]
    return F.concat(F.lit("["), F.array_join(F.array(*quoted), ", "), F.lit("]"))


def chained(actions: DataFrame, fields: list[str], after: str = GENESIS) -> DataFrame:
    """Actions with ``prev_hash`` and ``entry_hash``, in order of ``id``, the first one's predecessor being ``after``.

    Each hash needs the one before, so what is new is chained by one task, a row at a
    time; ``append_actions`` chains no more than that, and ``verify_chain`` is parallel.
    """
    def run(rows):  # noqa: ANN001, ANN202
        import hashlib

        last = after
        for batch in rows:
            made = []
            for entry in batch["entry"]:
                before, last = last, hashlib.sha256((last + entry).encode()).hexdigest()
                made.append((before, last))
            yield batch.drop(columns="entry").assign(prev_hash=[a for a, _ in made], entry_hash=[b for _, b in made])

    own = actions.select("id", entry_body(fields).alias("entry")).repartition(1).sortWithinPartitions("id")
    hashes = own.mapInPandas(run, f"id {actions.schema['id'].dataType.simpleString()}, prev_hash string, entry_hash string")
    return actions.join(hashes, "id")


def append_actions(log: DataFrame, new: DataFrame, fields: list[str]) -> DataFrame:
    """``log`` and after it the ``new`` actions, numbered on from its last id and chained from its last hash.

    ``new`` has an ``id`` that orders it, and the log's other columns but the hashes.
    """
    end = log.agg(F.max("id").alias("id"), F.max_by("entry_hash", F.when(F.col("entry_hash") != "", F.col("id"))).alias("hash")).first()  # one row
    kind = log.schema["id"].dataType
    # What is new is numbered where it is chained: in one task, which it needs anyway.
    numbered = new.withColumn("id", (F.row_number().over(Window.orderBy("id")) + F.lit(end["id"] or 0)).cast(kind))
    return log.unionByName(chained(cut(numbered), fields, end["hash"] or GENESIS))


def verify_chain(log: DataFrame, fields: list[str], ranges: int | None = None) -> DataFrame:
    """(id, problem): entries that were changed, or before which the chain is broken; rows without a hash are skipped.

    The log is dealt into ranges of ids, checked each by itself; a range's first entry
    is checked against the last hash of the range before, of which there is one a range.
    """
    held = log.where("entry_hash <> ''").select("id", "prev_hash", "entry_hash", F.sha2(F.concat("prev_hash", entry_body(fields)), 256).alias("made"))
    held = held.repartitionByRange(ranges, "id") if ranges else held.repartitionByRange("id")
    held = cut(held.withColumn("range", F.spark_partition_id()))  # ranges are sampled: they must not be dealt twice
    last = held.groupBy("range").agg(F.max_by("entry_hash", "id").alias("hash"))
    ordered = last.agg(F.array_sort(F.collect_list(F.struct("range", "hash"))).alias("ends"))  # one row of as many as there are ranges
    before_range = ordered.select(F.explode(F.transform("ends", lambda e, i: F.struct(e["range"].alias("range"), F.get("ends", i - 1)["hash"].alias("before")))).alias("e"))
    own = held.withColumn("before", F.lag("entry_hash").over(Window.partitionBy("range").orderBy("id")))
    both = own.join(F.broadcast(before_range.select("e.range", F.col("e.before").alias("outside"))), "range")
    previous = F.coalesce("before", "outside", F.lit(GENESIS))
    problems = F.array_compact(F.array(F.when(F.col("prev_hash") != previous, "broken before"), F.when(F.col("made") != F.col("entry_hash"), "changed")))
    return both.select("id", F.explode(problems).alias("problem"))


def review_problem(cases: DataFrame, requests: DataFrame) -> DataFrame:
    """``requests`` (case_id, action, reviewer, reason, field, corrected_value) cleaned, with ``problem``: null where one can be recorded."""
    blank = lambda c: F.when(F.btrim(c) != "", F.btrim(c))
    value, correct = F.col("corrected_value"), F.col("action") == "CORRECT"
    known = cases.select("case_id").distinct().withColumn("known", F.lit(True))
    clean = requests.join(known, "case_id", "left").withColumns({
        "reason": blank("reason"), "reviewer": F.btrim("reviewer"), "corrected_value": F.when(correct, blank("corrected_value")), "field": F.when(correct, F.col("field")),
    })
    number = F.regexp_replace(value, "[,$]", "").try_cast("double")
    day = F.when(value.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.try_to_date(value, "yyyy-MM-dd"))
    problem = (
        F.when(F.col("known").isNull(), "unknown case").when(~F.coalesce(F.col("action").isin(*REVIEWED), F.lit(False)), "unknown action")
        .when(F.coalesce(F.col("reviewer"), F.lit("")) == "", "no reviewer").when((F.col("action") != "ACCEPT") & F.col("reason").isNull(), "no reason")
        .when(correct & (F.coalesce(F.col("field"), F.lit("")) == ""), "no field").when(correct & value.isNull(), "no value")
        .when(correct & (F.col("field") == "amount") & number.isNull(), "amount is no number").when(correct & (F.col("field") == "date") & day.isNull(), "date is no date")
    )
    return clean.withColumn("problem", problem).drop("known")


def record_reviews(cases: DataFrame, log: DataFrame, requests: DataFrame, fields: list[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(cases, log, refused): sound requests are appended to the log, and their cases get the last action's status.

    ``requests`` has an ``id`` that orders it; ``refused`` has those with a ``problem``.
    """
    judged = cut(review_problem(cases, requests))
    sound = judged.where("problem IS NULL").drop("problem")
    status = F.create_map(*[F.lit(x) for pair in REVIEWED.items() for x in pair])
    last = sound.groupBy("case_id").agg(F.max_by("action", "id").alias("action")).select("case_id", F.try_element_at(status, "action").alias("reviewed"))
    changed = cases.join(last, "case_id", "left").withColumn("status", F.coalesce("reviewed", "status")).drop("reviewed").select(*cases.columns)
    return changed, append_actions(log, sound, fields), judged.where("problem IS NOT NULL")


def sync_plan(stored: DataFrame, generated: DataFrame, key: str, compared: list[str]) -> DataFrame:
    """(key, action): insert, update, unchanged or stale, of one full join."""
    mark = F.struct(*compared)
    both = stored.select(key, mark.alias("was")).join(generated.select(key, mark.alias("now")), key, "full_outer")
    action = F.when(F.col("was").isNull(), "insert").when(F.col("now").isNull(), "stale").when(F.col("was").eqNullSafe(F.col("now")), "unchanged").otherwise("update")
    return both.select(key, action.alias("action"))


def valid_chunks(chunks: DataFrame, dimension: int) -> DataFrame:
    """Chunks with a column ``problem``: null if ids and text are there and the vector is whole and finite."""
    blank = lambda c: F.coalesce(F.trim(c) == "", F.lit(True))
    fine = F.coalesce(F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))
    problem = F.when(blank("chunk_id"), "no id").when(blank("document_id"), "no document").when(blank("chunk_text"), "no text").when(F.coalesce(F.size("embedding") != dimension, F.lit(True)), "wrong dimension").when(~fine, "bad vector")
    return chunks.withColumn("problem", problem)


def cascade(parents: DataFrame, children: DataFrame, key: str, gone: Column) -> tuple[DataFrame, DataFrame]:
    """Both tables without the parents that go, and without their children."""
    stay = parents.where(~F.coalesce(gone, F.lit(False)))
    return stay, children.join(parents.where(gone).select(key), key, "left_anti")

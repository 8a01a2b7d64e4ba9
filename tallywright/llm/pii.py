"""Personal data: patterns find entities, co-occurrence finds what gives them away.

Base entities (email, ip, card, phone) come from patterns.  For the method, a
term is a word outside them, and the documents of the corpus are its contexts:
over all of them a term's pointwise mutual information with an entity, the
entity's share of the term's documents smoothed towards its share of all, is set
against the entity's own information content.  A term whose share reaches
``DISCLOSURE`` makes the entity nearly certain, and wherever it stands in a
document that holds that entity it is a span of its own: generalised to its kind
if it is a number, else removed.  DataFrame functions only.

* Patterns are written so that no start is tried twice within a run, and only on
  texts that hold a character they need; texts without entities stay where they are.
* Terms and entities are counted as hashes, before the shuffle.  A term in more
  documents than can disclose an entity of its document is not paired with it.

Defined results: a null text is empty; an empty text has no spans; a repeated
row is judged by itself, though it counts once for each ``doc_id`` and text; a null ``doc_id`` is a document; the method's spans never overlap base
ones; entities of two kinds may overlap; other columns pass through, and the
columns ``base``, ``added`` and ``clean`` replace those of that name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import lower_ascii, spread, stored, table

KINDS = ("email", "ip", "card", "phone")
#: The patterns asked for, with possessive runs; a start inside a run that failed is not tried again.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = r"0*+(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{0,2})"
IP_PARTS = rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"
WORD = r"[\p{L}\p{N}]++"
DISCLOSURE = 0.9
#: Documents' worth of the entity's own frequency that a term's documents are smoothed by: rare pairs are judged, and by more the less is known without them.
PRIOR = 1.0


def luhn(digits: Column) -> Column:
    at = F.sequence(F.lit(1), F.length(digits))
    back = F.reverse(digits)

    def add(total: Column, i: Column) -> Column:
        d = back.substr(i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, twice).otherwise(d)

    return F.aggregate(at, F.lit(0), add) % 10 == 0


def _holds(kind: str, match: Column) -> Column:
    digits = F.regexp_replace(match, "[^0-9]", "")
    if kind == "ip":
        return match.rlike(IP_PARTS)
    if kind == "card":
        return F.when(F.length(digits).between(16, 19), luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(8, 15)
    return F.lit(True)


def _spans(kind: str, text: Column) -> Column:
    """Array of (kind, start, end, value), by start: what lies between matches and the matches give the places."""
    found = F.regexp_extract_all(text, F.lit(PATTERNS[kind]), F.lit(0))
    gaps = F.split(text, PATTERNS[kind], -1)
    pieces = F.arrays_zip(found.alias("m"), F.transform(gaps, F.length).alias("g"))
    state = "struct<at:int,out:array<struct<kind:string,start:int,end:int,value:string>>>"
    zero = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>").alias("out")).cast(state)

    def step(s: Column, p: Column) -> Column:
        start = s["at"] + p["g"]
        end = start + F.length(p["m"])
        one = F.array(F.struct(F.lit(kind).alias("kind"), start.alias("start"), end.alias("end"), p["m"].alias("value")))
        out = F.when(p["m"].isNotNull() & F.coalesce(_holds(kind, p["m"]), F.lit(False)), F.concat(s["out"], one)).otherwise(s["out"])
        return F.struct(F.coalesce(end, start).alias("at"), out.alias("out")).cast(state)

    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    needed = {"email": "@", "ip": ".", "phone": "+"}.get(kind)
    may = text.contains(needed) if needed else text.rlike(r"[0-9]")
    return F.when(may & (F.size(found) > 0), F.aggregate(pieces, zero, step)["out"]).otherwise(none)


def base_spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with ``base``: the spans of each kind, kinds as listed, then by start."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.withColumn("base", F.concat(*[_spans(k, text) for k in KINDS]))


def _masked(text: Column, base: Column) -> Column:
    """The text with blanks for what its base spans cover, of the same length."""
    state = "struct<at:int,out:string>"
    order = F.array_sort(F.transform(base, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))

    def blank(s: Column, p: Column) -> Column:
        before = text.substr(s["at"] + 1, F.greatest(F.lit(0), p["start"] - s["at"]))
        blanks = F.repeat(F.lit(" "), F.greatest(F.lit(0), p["end"] - F.greatest(s["at"], p["start"])))
        return F.struct(F.greatest(s["at"], p["end"]).alias("at"), F.concat(s["out"], before, blanks).alias("out")).cast(state)

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast(state)
    whole = F.aggregate(order, zero, blank, lambda s: F.concat(s["out"], text.substr(s["at"] + 1, F.length(text))))
    return F.when(F.size(base) == 0, text).otherwise(whole)


def _term(word: Column) -> Column:
    return F.xxhash64(F.lower(word))


def _terms(masked: Column) -> Column:
    """The hashes of a text's different terms."""
    return F.array_distinct(F.transform(F.regexp_extract_all(masked, F.lit(WORD), F.lit(0)), _term))


def _entities(base: Column) -> Column:
    """The hashes of a text's different entities."""
    return F.array_distinct(F.transform(base, lambda e: F.xxhash64(e["kind"], lower_ascii(e["value"]))))


def disclosed(found: DataFrame, id_col: str, text_col: str, disclosure: float = DISCLOSURE, prior: float = PRIOR) -> DataFrame:
    """(row, terms): the hashes of the terms that disclose an entity of that row of ``found``.

    A term's information on the entity reaches that share of all there is.
    """
    text = F.col(text_col)
    placed = found.select(F.col(id_col).alias("doc"), F.xxhash64(text).alias("of"), F.col("_row").alias("row"))
    keys = placed.groupBy("doc", "of").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("rows"))
    total = keys.agg(F.count(F.lit(1)).alias("n"))
    again = keys.where("rows > 1").select(F.col("doc").alias("_doc"), F.col("of").alias("_of"), "first")
    repeats = placed.join(again, F.col("doc").eqNullSafe(F.col("_doc")) & (F.col("of") == F.col("_of")) & (F.col("row") != F.col("first"))).select("row")
    repeats = stored(repeats, "repeats")

    masked = found.select(F.col("_row").alias("row"), "base", _masked(text, F.col("base")).alias("masked"))
    of_term = masked.join(repeats, "row", "left_anti").select(F.explode(_terms(F.col("masked"))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("n_term"))

    holding = masked.where(F.size("base") > 0)
    entities = holding.select("row", F.explode(_entities(F.col("base"))).alias("entity"))
    of_entity = entities.join(repeats, "row", "left_anti").groupBy("entity").agg(F.count(F.lit(1)).alias("n_entity"))
    # The documents that a term can have if each that holds the entity holds it too: nothing that could be a span goes.
    share = F.col("n_entity") / F.col("n")
    most = F.col("n_entity") * (1 + prior / F.col("n")) * F.pow(share, F.lit(disclosure - 1)) - prior + 1e-6
    judged = stored(entities.join(of_entity, "entity").crossJoin(F.broadcast(total)).withColumn("most", most), "entities")  # one row
    limit = judged.groupBy("row").agg(F.max("most").alias("limit"))
    own = holding.select("row", F.explode(_terms(F.col("masked"))).alias("term"))
    rare = of_term.crossJoin(F.broadcast(judged.agg(F.max("most").alias("highest")))).where("n_term <= highest").drop("highest")  # one row
    pairs = own.join(rare, "term").join(limit, "row").where("n_term <= limit").join(judged, "row").where("n_term <= most")
    pairs = stored(pairs.select("row", "entity", "term", "n_term", "n_entity", "n"), "pairs")

    both = pairs.join(repeats, "row", "left_anti").groupBy("entity", "term").agg(
        F.count(F.lit(1)).alias("n_both"), *[F.first(c).alias(c) for c in ("n_term", "n_entity", "n")]
    )
    pmi = F.log((F.col("n_both") + prior * share) / (F.col("n_term") + prior) / share)
    content = -F.log(share)
    kept = both.where((content > 0) & (pmi >= disclosure * content)).select("entity", "term")
    return pairs.join(kept, ["entity", "term"]).groupBy("row").agg(F.collect_set("term").alias("terms"))


def _added(masked: Column, terms: Column) -> Column:
    """The spans of these terms, wherever they stand: kinds by name, then by start."""
    words = F.regexp_extract_all(masked, F.lit(WORD), F.lit(0))
    pieces = F.arrays_zip(words.alias("w"), F.transform(F.split(masked, WORD, -1), F.length).alias("g"))
    spans = "array<struct<kind:string,start:int,end:int,value:string>>"
    state = f"struct<at:int,out:{spans}>"

    def step(s: Column, p: Column) -> Column:
        start, term = s["at"] + p["g"], F.lower(p["w"])
        end = start + F.length(p["w"])
        kind = F.when(term.rlike(r"^\p{N}+$"), "number").otherwise("term")
        one = F.array(F.struct(kind.alias("kind"), start.alias("start"), end.alias("end"), term.alias("value")))
        out = F.when(p["w"].isNotNull() & F.array_contains(terms, _term(p["w"])), F.concat(s["out"], one)).otherwise(s["out"])
        return F.struct(F.coalesce(end, start).alias("at"), out.alias("out")).cast(state)

    zero = F.struct(F.lit(0).alias("at"), F.array().cast(spans).alias("out")).cast(state)
    return F.sort_array(F.aggregate(pieces, zero, step)["out"])


def sanitise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", disclosure: float = DISCLOSURE, prior: float = PRIOR) -> DataFrame:
    """``docs`` with ``base`` and ``added`` spans and the sanitised text ``clean``."""
    docs = docs.drop("base", "added", "clean").withColumn(text_col, F.coalesce(F.col(text_col), F.lit("")))
    # Patterns run once, whatever reads the spans.
    found = stored(base_spans(docs, text_col).withColumn("_row", F.monotonically_increasing_id()), "spans")
    hits = stored(disclosed(found, id_col, text_col, disclosure, prior), "terms")
    none = F.array().cast("array<struct<kind:string,start:int,end:int,value:string>>")
    # Only texts that hold an entity are joined.
    marked = found.where(F.size("base") > 0).join(hits, F.col("_row") == F.col("row"), "left").drop("row")
    added = F.when(F.col("terms").isNotNull(), _added(_masked(F.col(text_col), F.col("base")), F.col("terms"))).otherwise(none)
    joined = marked.withColumn("added", added).drop("terms").unionByName(found.where(F.size("base") == 0).withColumn("added", none)).drop("_row")
    order = F.array_sort(F.transform(F.concat("base", "added"), lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["kind"].alias("kind"))))
    text = F.col(text_col)
    state = "struct<at:int,out:string>"

    def put(s: Column, p: Column) -> Column:
        mark = F.when(p["kind"] == "term", F.lit("")).otherwise(F.concat(F.lit("["), F.upper(p["kind"]), F.lit("]")))
        before = text.substr(s["at"] + 1, F.greatest(F.lit(0), p["start"] - s["at"]))
        out = F.when(p["start"] >= s["at"], F.concat(s["out"], before, mark)).otherwise(s["out"])
        return F.struct(F.greatest(s["at"], p["end"]).alias("at"), out.alias("out")).cast(state)

    def close(s: Column) -> Column:
        return F.concat(s["out"], text.substr(s["at"] + 1, F.length(text)))

    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out")).cast(state)
    return joined.withColumn("clean", F.when(F.size(order) == 0, text).otherwise(F.aggregate(order, zero, put, close)))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = sanitise(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    kinds = F.transform("base", lambda s: s["kind"])
    counts = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    both = F.concat("base", "added")
    return judged.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(both).alias("spans"), F.sha2("clean", 256).alias("clean_sha256"))

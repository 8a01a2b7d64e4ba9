"""Fields from the text of a document: labels and values as they stand, with what they are worth.

A line is parsed by itself, with patterns that the JVM runs: nothing is collected and
no text leaves Spark.  ``extract`` may ask another reader first, and records where it
had to fall back on the rules.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallywright.functions.normalize import agreement

# Labels of business documents, letters that recognition takes for others, and confidences.
KNOWN_LABELS = (
    "account", "amount due", "amount paid", "balance due", "bill to", "category", "currency", "customer", "date", "description", "discount", "due date", "grand total",
    "gst", "invoice", "invoice date", "invoice no", "invoice number", "method", "notes", "order id", "order number", "payee", "payer", "payment date", "payment id",
    "payment method", "payment reference", "po number", "purchase order", "reference", "ship mode", "ship to", "shipping", "subtotal", "supplier", "tax", "terms",
    "total", "total amount", "vat", "vendor",
)
LOOK_ALIKES = ("1!|l0", "iiiio")
KNOWN, WITHOUT_COLON, GUESSED = 0.95, 0.85, 0.80
DISAGREEMENT = 0.80

#: Where a line ends.
LINE_END = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"

#: What may stand around a label that lost its colon.
_MARKS = ";|>.-"
_WORDS = "|".join(re.escape(label).replace(r"\ ", r"\s+") for label in KNOWN_LABELS)
#: A known label at the end of a segment, also with something in brackets behind it.
_KNOWN_TAIL = rf"(?i)(?:^|[\s,])(?:{_WORDS})(?:\s*\([^)]*\))?$"
#: Up to three words that begin with a capital.
_GUESSED_TAIL = r"(?:(?:^|\s+)[A-Z#][\p{L}\p{N}_#().%/-]*){1,3}$"

FIELD = "struct<label:string,value:string,confidence:double>"


def _field(label: Column, value: Column, confidence: Column | float) -> Column:
    return F.struct(label.alias("label"), value.alias("value"), (F.lit(confidence) if isinstance(confidence, float) else confidence).alias("confidence"))


def _folded(text: Column) -> Column:
    return F.translate(F.lower(text), *LOOK_ALIKES)


_FOLDED_LABELS = sorted({label.translate(str.maketrans(*LOOK_ALIKES)) for label in KNOWN_LABELS})


def _is_label(folded: Column) -> Column:
    return folded.isin(_FOLDED_LABELS)


def _head(words: Column, size: int) -> Column:
    return F.array_join(F.slice(words, 1, size), " ")


def _without_colon(words: Column, heads: Column) -> Column:
    """A field of a line that begins with one, two or three words of a known label, the longest that leaves a value; else null."""
    found = F.lit(None).cast(FIELD)
    for size in (1, 2, 3):
        rest = F.array_join(F.slice(words, size + 1, F.size(words)), " ")
        value = F.btrim(F.ltrim(rest, F.lit(_MARKS + ": ")))
        made = _field(F.btrim(_head(words, size), F.lit(_MARKS)), value, WITHOUT_COLON).cast(FIELD)
        # Mostly the first condition fails, and then nothing more is made.
        fits = _is_label(F.get(heads, F.lit(size - 1))) & (F.size(words) > size) & (value != "") & ~_is_label(_folded(value))
        found = F.when(fits, made).otherwise(found)
    return found


def _between_colons(segments: Column, tails: Column, known: Column) -> Column:
    """Fields of a line with colons: a label stands before each, and after it a value and perhaps the next label."""
    last = F.size(segments) - 1

    def field(j: Column) -> Column:
        label = F.regexp_replace(F.btrim(F.get(tails, j - 1), F.lit(" ,\t")), r"\s+", " ")
        own = F.rtrim(F.get(segments, j))
        before = F.substring(own, F.lit(1), F.char_length(own) - F.char_length(F.get(tails, j)))
        value = F.btrim(F.when(j < last, before).otherwise(own), F.lit(" ,"))
        return _field(label, F.when(value != "", value), F.when(F.get(known, j - 1) != "", KNOWN).otherwise(GUESSED)).cast(FIELD)

    return F.filter(F.transform(F.sequence(F.lit(1), last), field), lambda f: f["label"] != "")


def with_fields(rows: DataFrame, text_col: str, into: str) -> DataFrame:
    """``rows`` and an array of (label, value, confidence): what the text's lines hold, in order.

    Each step is a column of its own, so that a pattern runs once for each piece of a line; rows stay where they are.
    """
    kept = list(rows.columns)
    steps = ["lines", "segments", "words", "known", "tails", "folded", "heads"]
    lines, segments, words, known, tails, folded, heads = (f"__{s}" for s in steps)
    numbered = r"^#\s*\S+$"

    def each(name: str, fn: Callable[[Column], Column]) -> Column:
        return F.transform(name, fn)

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = rows.withColumn(lines, F.filter(F.transform(F.split(text, LINE_END), lambda line: F.btrim(line, F.lit(" \t"))), lambda line: line != ""))
    split = lambda line: F.when(line.contains(":") & ~(line.startswith("#") & line.rlike(numbered)), F.split(line, r"\s*:\s*")).otherwise(F.array(line))
    rows = rows.withColumn(segments, each(lines, split))
    rows = rows.withColumn(words, each(segments, lambda s: F.when(F.size(s) == 1, F.split(s[0], r"\s+")).otherwise(F.array().cast("array<string>"))))

    def tail(x: Column, pattern: str) -> Column:
        return F.regexp_extract(F.rtrim(x), pattern, 0)

    def known_tails(s: Column) -> Column:
        """Of a line's last piece nothing is a label, so no pattern runs over it."""
        own = F.transform(s, lambda x, i: F.when(i < F.size(s) - 1, tail(x, _KNOWN_TAIL)))
        return F.when(F.size(s) > 1, own).otherwise(F.array().cast("array<string>"))

    rows = rows.withColumn(known, each(segments, known_tails))
    guess = lambda x, k: F.when(k == "", tail(x, _GUESSED_TAIL)).otherwise(k)
    rows = rows.withColumn(tails, F.zip_with(segments, known, lambda s, k: F.zip_with(s, k, guess)))
    # A line's first words are folded at once; lines with colons have no words.
    first = F.transform(words, lambda w: F.when(F.size(w) > 0, F.split(_folded(_head(w, 3)), " ")))
    rows = rows.withColumn(folded, first)
    rows = rows.withColumn(heads, each(folded, lambda w: F.when(w.isNotNull(), F.array(*[F.btrim(_head(w, size), F.lit(_MARKS)) for size in (1, 2, 3)]))))

    def line(own: Column, i: Column) -> Column:
        one, mine = F.get(words, i), F.get(lines, i)
        number = F.when(mine.startswith("#"), F.regexp_extract(mine, r"^#\s*(\S+)$", 1)).otherwise("")
        by_colon = _between_colons(own, F.get(tails, i), F.get(known, i))
        alone = F.when(number != "", _field(F.lit("#"), number, KNOWN).cast(FIELD)).otherwise(_without_colon(one, F.get(heads, i)))
        return F.when(F.size(own) > 1, by_colon).otherwise(F.array_compact(F.array(alone)))

    return rows.withColumn(into, F.flatten(F.transform(segments, line))).select(*kept, into)


def _numbered(rows: DataFrame) -> DataFrame:
    held = F.when(F.size("fields") > 0, F.col("fields"))  # read twice, so that the optimiser leaves its making in a step of its own
    fields = rows.select("document_id", "method", F.posexplode(held).alias("pos", "f"))
    number = F.concat(F.lit("field-"), F.col("pos") + 1)
    return fields.select("document_id", "pos", number.alias("field_id"), "f.label", "f.value", "f.confidence", "method")


def field_confidence(base: Column, own_words: Column, page: Column, value: Column, second_text: Column) -> Column:
    """What a field is worth: its reader's confidence, that of its words or else of the page, and less if another reading lacks the value."""
    agreed = agreement(value, second_text)
    worth = base * F.coalesce(own_words, page, F.lit(1.0)) * F.when(agreed == F.lit(False), DISAGREEMENT).otherwise(1.0)
    return F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), worth)), 4)


def extract(texts: DataFrame, reader: Callable[[str], list[tuple[str, str | None]]] | None = None, name: str = "reader") -> DataFrame:
    """(document_id, pos, field_id, label, value, confidence, method) from (document_id, text).

    ``reader`` gets a text and returns its labels and values; where it raises, the rules
    read the document instead and ``method`` says so.
    """
    if reader is None:
        ruled = with_fields(texts.select("document_id", "text"), "text", "fields")
        return _numbered(ruled.select("document_id", F.lit("rules").alias("method"), "fields"))

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fields, errors = [], []
            for text in batch.column(1).to_pylist():
                try:
                    fields.append([{"label": label, "value": value} for label, value in reader(text or "")])
                    errors.append(None)
                except Exception as error:  # noqa: BLE001  recorded, and the rules take over
                    fields.append([])
                    errors.append(str(error))
            kind = pa.list_(pa.struct([("label", pa.string()), ("value", pa.string())]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fields, kind), pa.array(errors, pa.string())], ["document_id", "text", "fields", "error"])

    kind = texts.schema["document_id"].dataType.simpleString()
    asked = texts.select("document_id", "text").mapInArrow(ask, f"document_id {kind}, text string, fields array<struct<label:string,value:string>>, error string")
    own = F.transform("fields", lambda f: _field(f["label"], f["value"], F.lit(1.0)).cast(FIELD))
    failed = F.col("error").isNotNull()
    asked = with_fields(asked.withColumn("text", F.when(failed, F.col("text"))), "text", "ruled")  # the rules read what failed, and nothing else
    method = F.when(failed, F.concat(F.lit(f"rules (fallback after {name} error: "), "error", F.lit(")"))).otherwise(name)
    return _numbered(asked.select("document_id", method.alias("method"), F.when(failed, F.col("ruled")).otherwise(own).alias("fields")))

"""Token ids packed into rows: best fit decreasing, overlong documents split without loss.

Each task tokenises the documents of its input split and packs them in lots of
``LOT`` pieces: pieces go longest first into the fullest row that still takes
them, found in a segment tree over rows by capacity.  A packed row carries its
id matrix row (little-endian, padded with ``pad``), cumulative segment lengths
and position resets.  Nothing is shuffled: a row belongs to (part, lot, row),
which follow from the split alone, so a task that is run again writes the same.

Defined results: a null or empty text has no tokens and is in no row; texts longer than a row become pieces
of at most ``length`` tokens, numbered from 0; repeated rows are packed each; a
null id is carried as null; other columns are ignored.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywright.llm.common import spread, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how this vocabulary cuts a text into words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
LENGTH, LOT, PAD = 2048, 4096, 50256
RUN = 100_000  # code points given to the tokeniser at once, or about

PACKED = (
    "part int, lot long, row long, ids binary, n_tokens long, cu_seqlens array<int>, positions array<int>, doc_ids array<{id}>, pieces array<int>"
)


class Rows:
    """Open rows in a segment tree over remaining room; a leaf for each amount of room."""

    def __init__(self, length: int):
        self.length = length
        self.size = 1 << (length).bit_length()
        self.used = np.zeros(2 * self.size, dtype=bool)
        self.at: list[list[int]] = [[] for _ in range(length + 1)]
        self.rows: list[list[int]] = []

    def _mark(self, room: int) -> None:
        node = self.size + room
        self.used[node] = bool(self.at[room])
        while node > 1:
            node >>= 1
            self.used[node] = self.used[2 * node] or self.used[2 * node + 1]

    def _least_room(self, need: int) -> int | None:
        """Least room of at least ``need`` that some row has."""
        node = self.size + need
        if not self.used[node]:
            while node > 1 and (node & 1 or not self.used[node + 1]):
                node >>= 1
            if node <= 1:
                return None
            node += 1
            while node < self.size:
                node = 2 * node + (not self.used[2 * node])
        return node - self.size

    def put(self, piece: int, size: int) -> None:
        room = self._least_room(size)
        if room is None:
            room, row = self.length, len(self.rows)
            self.rows.append([])
        else:
            row = self.at[room].pop()
            self._mark(room)
        self.rows[row].append(piece)
        left = room - size
        if left:
            self.at[left].append(row)
            self._mark(left)


def pack(sizes: list[int], length: int) -> list[list[int]]:
    """Rows of piece numbers; longest pieces first, of equal ones the earlier."""
    rows = Rows(length)
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        rows.put(i, sizes[i])
    return rows.rows


def runs(text: str, limit: int) -> Iterator[str]:
    """Parts of about ``limit`` code points, cut only where words always end.

    That is before white space after anything else, and between a letter and a
    digit; a part without such a place goes on to the next one.
    """
    at = 0
    while len(text) - at > limit:
        end = at + limit
        while end < len(text) and not (text[end].isspace() and not text[end - 1].isspace()):
            end += 1
        yield text[at:end]
        at = end
    if at < len(text):
        yield text[at:]


def packed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY,
    pattern: str = PATTERN, length: int = LENGTH, lot: int = LOT, pad: int = PAD,
) -> DataFrame:
    """Packed rows with the columns of ``PACKED``; ``doc_ids`` are of the id column's type."""
    with open(vocabulary, "rb") as file:  # a file of the driver; tasks get its ranks
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, file)}
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    kind = "<u2" if max(len(ranks), pad) < 1 << 16 else "<u4"
    own = docs.select(F.spark_partition_id().alias("part"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = PACKED.format(id=own.schema["id"].dataType.simpleString())
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        encoder = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=shared.value, special_tokens={})
        number, waiting, part, id_type = 0, [], 0, None

        def flush() -> Iterator[pa.RecordBatch]:
            rows = pack([len(w[2]) for w in waiting], length)
            for at in range(0, len(rows), 256):
                out: list[list] = [[] for _ in names]
                for row, members in enumerate(rows[at : at + 256], at):
                    ids = np.full(length, pad, dtype=kind)
                    ends = np.cumsum([0] + [len(waiting[i][2]) for i in members]).astype(np.int32)
                    for i, start in zip(members, ends):
                        ids[start : start + len(waiting[i][2])] = waiting[i][2]
                    places = np.concatenate([np.arange(len(waiting[i][2]), dtype=np.int32) for i in members])
                    made = (part, number, row, ids.tobytes(), int(ends[-1]), ends, places, [waiting[i][0] for i in members], [waiting[i][1] for i in members])
                    for column, value in zip(out, made):
                        column.append(value)
                i32, i64 = pa.int32(), pa.int64()
                types = (i32, i64, i64, pa.binary(), i64, pa.list_(i32), pa.list_(i32), pa.list_(id_type), pa.list_(i32))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names)

        for batch in batches:
            id_type = batch.schema.field("id").type
            for i in range(batch.num_rows):
                text = batch.column(2)[i].as_py()
                if not text:
                    continue
                part, doc = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
                ids = np.concatenate([np.array(encoder.encode_ordinary(r), dtype=kind) for r in runs(text, RUN)])
                for n, at in enumerate(range(0, len(ids), length)):
                    waiting.append((doc, n, ids[at : at + length]))
                    if len(waiting) == lot:
                        yield from flush()
                        number, waiting = number + 1, []
        if waiting:
            yield from flush()

    return own.mapInArrow(run, schema)


def write(rows: DataFrame, path: str) -> None:
    """Packed rows as Parquet, ids in binary."""
    rows.write.mode("overwrite").parquet(path)


def op4_token_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a packed row: whose pieces it holds, their bounds, and digests of ids and positions."""
    rows = packed(spread(table(spark, sf_dir, "documents").select("doc_id", "text")))
    return rows.select(
        "part", "lot", "row", "n_tokens", "doc_ids", "pieces", "cu_seqlens", F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.array_join("positions", ","), 256).alias("positions_sha256"),
    )

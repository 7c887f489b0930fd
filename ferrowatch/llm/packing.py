"""Packing of documents into sequences: shortest-pack-first over the histogram of lengths.

Documents are encoded and cut into pieces of at most a sequence's length. Only the histogram of
piece lengths, whose size is that of a sequence, reaches the driver. It is packed there from the
longest length down: each length goes into the packs that have the most space left, counted by
packing pattern, and a new pattern begins where none has room. The patterns are then joined back:
pieces of one length are numbered across the table, and each run of numbers belongs to one slot
of one pattern, which gives the sequence and the offset. Numbering is by hash buckets, counted
first, so that no length is numbered in one task.
"""

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrowatch.llm import tokens
from ferrowatch.llm.common import quoted
from ferrowatch.sources.staging import stage

CAPACITY = 1024
BUCKET_ROWS = 20_000

Pattern = tuple[int, ...]


def pack_histogram(histogram: dict[int, int], capacity: int) -> list[tuple[Pattern, int]]:
    """Patterns of lengths and how many packs have each: shortest pack first, longest length first."""
    open_packs: dict[int, list[tuple[Pattern, int]]] = {}
    by_space: list[int] = []

    def put(pattern: Pattern, space: int, count: int) -> None:
        if space not in open_packs:
            open_packs[space] = []
            heapq.heappush(by_space, -space)
        open_packs[space].append((pattern, count))

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        while left and by_space and -by_space[0] >= length:
            space = -by_space[0]
            pattern, count = open_packs[space].pop()
            if not open_packs[space]:
                del open_packs[space]
                heapq.heappop(by_space)
            moved = min(left, count)
            if moved < count:
                put(pattern, space, count - moved)
            put((*pattern, length), space - length, moved)
            left -= moved
        if left:
            put((length,), capacity - length, left)
    return [packs for space in sorted(open_packs) for packs in open_packs[space]]


class Slots:
    """Where the pieces of each length go: runs of their numbers, by first number."""

    def __init__(self, patterns: list[tuple[Pattern, int]]) -> None:
        runs: dict[int, list[tuple[int, int, int]]] = {}
        used: dict[int, int] = {}
        sequence = 0
        for pattern, count in patterns:
            offset = 0
            for length in pattern:
                first = used.get(length, 0)
                runs.setdefault(length, []).append((first, sequence - first, offset))
                used[length] = first + count
                offset += length
            sequence += count
        self.runs = {length: np.array(rows, np.int64) for length, rows in runs.items()}

    def place(self, lengths: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Sequence and offset of pieces by their length and their number among that length."""
        sequences, offsets = np.empty(len(ranks), np.int64), np.empty(len(ranks), np.int64)
        for length in np.unique(lengths):
            own = np.flatnonzero(lengths == length)
            runs = self.runs[int(length)]
            run = runs[np.searchsorted(runs[:, 0], ranks[own], side="right") - 1]
            sequences[own] = ranks[own] + run[:, 1]
            offsets[own] = run[:, 2]
        return sequences, offsets


def pieces(
    docs: DataFrame,
    tokenizer: str,
    *,
    capacity: int = CAPACITY,
    end_id: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """(doc_id, start, length, ids_crc32, doc_tokens[, ids]): each document's ids, and an end id, in
    pieces of the capacity and a shorter last one."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = tokens.encoder(tokenizer).encode
        for batch in batches:
            row = 0
            for found in encode(batch.column("text")):
                ids, sizes = tokens.with_end(*found, end_id)
                number = -(-sizes // capacity)
                doc = np.repeat(np.arange(len(sizes)), number)
                at = capacity * (np.arange(len(doc)) - (np.cumsum(number) - number)[doc])
                length = np.minimum(capacity, sizes[doc] - at)
                stops = 4 * np.cumsum(length)
                body = memoryview(ids).cast("B")
                cuts = [body[stop - size : stop] for stop, size in zip(stops.tolist(), (4 * length).tolist())]
                columns = [
                    batch.column("doc_id").take(pa.array(row + doc)),
                    pa.array(at),
                    pa.array(length),
                    pa.array([zlib.crc32(piece) for piece in cuts], pa.int64()),
                    pa.array(sizes[doc]),
                ]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if keep_ids:
                    columns.append(pa.array([bytes(piece) for piece in cuts], pa.binary()))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names=names)
                row += len(sizes)

    rows = docs.select(F.col(quoted(doc_id)).alias("doc_id"), F.col(quoted(text)).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long"
    return rows.mapInArrow(cut, schema + ", ids binary" * keep_ids)


def numbered(rows: DataFrame, group: str, order: list[str], n_rows: int) -> DataFrame:
    """Add rank: the row's number, from 0, among the rows of its group, across the table.

    Buckets by a hash of the order columns are counted first; each is numbered by itself, after
    the rows of the buckets before it.
    """
    buckets = max(1, n_rows // BUCKET_ROWS)
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64(*order), F.lit(buckets)))
    counts = rows.groupBy(group, "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy(group).orderBy("bucket")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    firsts = counts.withColumn("first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy(group, "bucket").orderBy(*order)
    rows = rows.withColumn("place", F.row_number().over(within) - 1)
    joined = rows.join(firsts, [group, "bucket"])
    return joined.withColumn("rank", F.col("first") + F.col("place")).drop("bucket", "first", "place")


def pack(
    docs: DataFrame,
    tokenizer: str,
    *,
    capacity: int = CAPACITY,
    end_id: int = 0,
    doc_id: str = "doc_id",
    text: str = "text",
    keep_ids: bool = False,
) -> DataFrame:
    """The pieces of all documents with the sequence and the offset that each is packed at.

    Every id of every document, and its end id, lies in exactly one piece; the offsets of a
    sequence leave no gap and its ids do not exceed the capacity. A null text is empty and has its
    end id only. Null ids and repeated rows are documents like others. Other columns are not read;
    an empty table packs to nothing. With keep_ids the ids come as little-endian 32-bit numbers.
    """
    cut = pieces(
        docs, tokenizer, capacity=capacity, end_id=end_id, doc_id=doc_id, text=text, keep_ids=keep_ids
    )
    cut = stage(cut, "pack_pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = docs.sparkSession.sparkContext.broadcast(Slots(pack_histogram(histogram, capacity)))

    @F.arrow_udf("struct<sequence_id: long, offset: long>")
    def placed(lengths: pa.Array, ranks: pa.Array) -> pa.Array:
        found = slots.value.place(lengths.to_numpy(), ranks.to_numpy())
        return pa.StructArray.from_arrays([pa.array(x) for x in found], ["sequence_id", "offset"])

    order = ["doc_id", "start", "ids_crc32", "doc_tokens"]
    ranked = numbered(cut, "length", order, sum(histogram.values()))
    return ranked.withColumn("at", placed("length", "rank")).select(
        *cut.columns, "at.sequence_id", "at.offset"
    )

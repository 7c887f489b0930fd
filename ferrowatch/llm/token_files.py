"""Token ids in seekable zstandard files.

A file holds the ids of documents in order of their ids as independent zstandard frames, then a
frame with an index of its documents, and last a seek table in a skippable frame: the compressed
and decompressed size of every frame and a checksum of its content. Any zstandard tool reads the
whole; a reader that wants some documents reads the table and the index and decompresses the
frames that hold them, and no others.

Documents are sorted by range partitioning; each partition writes one file, block by block, to a
name of its own attempt. The manifest lists the files of the attempts that succeeded, so a lost
executor or a repeated task leaves nothing that is read.
"""

import json
import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ferrowatch.llm import tokens
from ferrowatch.llm.common import quoted
from ferrowatch.sources.staging import new_path, stage

# The seekable zstandard format.
SKIPPABLE = 0x184D2A5E
SEEKABLE = 0x8F92EAB1
CHECKSUMS = 0x80
# Ids of a frame before it is closed; the largest document is cut into several frames.
FRAME_IDS = 1 << 16
LEVEL = 3
_TAIL = struct.Struct("<IBI")


class Writer:
    def __init__(self, stream, width: int) -> None:
        self.stream, self.kind = stream, np.dtype(f"<u{width}")
        self.compressor = zstandard.ZstdCompressor(level=LEVEL, write_checksum=True)
        self.table: list[tuple[int, int, int]] = []
        self.waiting: list[np.ndarray] = []
        self.n_waiting = 0
        self.doc_ids: list[int | None] = []
        self.lengths: list[int] = []

    def _frame(self, content: bytes) -> None:
        packed = self.compressor.compress(content)
        self.stream.write(packed)
        self.table.append((len(packed), len(content), xxhash.xxh64_intdigest(content) & 0xFFFFFFFF))

    def _flush(self) -> None:
        if self.n_waiting:
            self._frame(np.concatenate(self.waiting).astype(self.kind).tobytes())
            self.waiting, self.n_waiting = [], 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id)
        self.lengths.append(len(ids))
        for at in range(0, len(ids), FRAME_IDS):
            part = ids[at : at + FRAME_IDS]
            self.waiting.append(part)
            self.n_waiting += len(part)
            if self.n_waiting >= FRAME_IDS:
                self._flush()

    def close(self) -> None:
        self._flush()
        head = json.dumps({"width": self.kind.itemsize, "documents": len(self.doc_ids)}).encode()
        null = np.array([doc_id is None for doc_id in self.doc_ids], "u1")
        ids = np.array([doc_id or 0 for doc_id in self.doc_ids], "<i8")
        lengths = np.array(self.lengths, "<i8")
        index = struct.pack("<I", len(head)) + head
        self._frame(index + null.tobytes() + ids.tobytes() + lengths.tobytes())
        entries = b"".join(struct.pack("<III", *entry) for entry in self.table)
        size = len(entries) + _TAIL.size
        self.stream.write(struct.pack("<II", SKIPPABLE, size) + entries)
        self.stream.write(_TAIL.pack(len(self.table), CHECKSUMS, SEEKABLE))


class Reader:
    """Random access to the documents of one file."""

    def __init__(self, stream, size: int) -> None:
        self.stream = stream
        n_frames, flags, magic = _TAIL.unpack(self._bytes(size - _TAIL.size, _TAIL.size))
        if magic != SEEKABLE or not flags & CHECKSUMS:
            raise ValueError("not a seekable file with checksums")
        length = 12 * n_frames
        entries = self._bytes(size - _TAIL.size - length, length)
        table = np.frombuffer(entries, "<u4").reshape(-1, 3).astype(np.int64)
        self.sizes, self.checks = table[:, 0], table[:, 2]
        self.at = np.cumsum(self.sizes) - self.sizes
        index = self._frame(n_frames - 1)
        (head_size,) = struct.unpack_from("<I", index)
        head = json.loads(index[4 : 4 + head_size])
        n, body = head["documents"], index[4 + head_size :]
        self.width = head["width"]
        self.null = np.frombuffer(body, "u1", n).astype(bool)
        self.doc_ids = np.frombuffer(body, "<i8", n, n)
        self.lengths = np.frombuffer(body, "<i8", n, 9 * n)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.ends = np.cumsum(table[:-1, 1]) // self.width
        self.kept: tuple[int, np.ndarray] | None = None
        self.frames_read = 0

    def _bytes(self, at: int, length: int) -> bytes:
        self.stream.seek(at)
        return self.stream.read(length)

    def _frame(self, number: int) -> bytes:
        packed = self._bytes(int(self.at[number]), int(self.sizes[number]))
        content = zstandard.ZstdDecompressor().decompress(packed)
        if xxhash.xxh64_intdigest(content) & 0xFFFFFFFF != self.checks[number]:
            raise ValueError(f"frame {number} does not match its checksum")
        return content

    def _ids(self, number: int) -> np.ndarray:
        if self.kept is None or self.kept[0] != number:
            self.kept = number, np.frombuffer(self._frame(number), f"<u{self.width}")
            self.frames_read += 1
        return self.kept[1]

    def document(self, place: int) -> np.ndarray:
        """The ids of the file's document at this place."""
        start, length = int(self.starts[place]), int(self.lengths[place])
        parts, number = [], int(np.searchsorted(self.ends, start, side="right"))
        while length:
            frame = self._ids(number)
            begin = start - (int(self.ends[number - 1]) if number else 0)
            part = frame[begin : begin + length]
            parts.append(part)
            start, length, number = start + len(part), length - len(part), number + 1
        return np.concatenate(parts).astype("<u4") if parts else np.zeros(0, "<u4")

    def find(self, doc_id: int) -> range:
        """The places of the documents with this id."""
        first = int(self.null.sum())
        ids = self.doc_ids[first:]
        return range(
            first + int(np.searchsorted(ids, doc_id)), first + int(np.searchsorted(ids, doc_id, "right"))
        )


def write(
    docs: DataFrame,
    tokenizer: str,
    *,
    end_id: int,
    folder: str | None = None,
    doc_id: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """Encode every text, append the end id, and write all in ascending order of the ids.

    Returns the manifest, written beside the files: (part, file, n_docs, n_tokens, last_id), a row per
    file, the files in order of their part. A null text is empty and has its end id only; null ids
    come first; rows that repeat an id are written next to each other, in order of their texts' first 64
    characters, then of a hash of them. Ids are integers, or are cast to long: others are an error.
    Other columns are not read. An empty table has no files.
    """
    spark = docs.sparkSession
    folder = folder or new_path(spark, "token_files")

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(tokenizer)
        width = 2 if max(coder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        system, base = pafs.FileSystem.from_uri(folder)
        part = TaskContext.get().partitionId()
        name = f"part-{part:06d}-{uuid.uuid4().hex}.zst"
        writer, last = None, None
        system.create_dir(base, recursive=True)
        stream = None
        for batch in batches:
            if stream is None and batch.num_rows:
                stream = system.open_output_stream(f"{base}/{name}", compression=None)
                writer = Writer(stream, width)
            rows = iter(batch.column("doc_id").to_pylist())
            for found in coder.encode(batch.column("text")):
                ids, sizes = tokens.with_end(*found, end_id)
                stops = np.cumsum(sizes)
                for first, stop in zip((stops - sizes).tolist(), stops.tolist(), strict=True):
                    last = next(rows)
                    writer.add(last, ids[first:stop])
        if writer is not None:
            writer.close()
            stream.close()
            counts = [part, name, len(writer.lengths), sum(writer.lengths), last]
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([value], kind) for value, kind in zip(counts, kinds, strict=True)],
                names=["part", "file", "n_docs", "n_tokens", "last_id"],
            )

    rows = docs.select(
        F.col(quoted(doc_id)).cast("long").alias("doc_id"), F.col(quoted(text)).alias("text")
    )
    # Rows that share an id are dealt by the beginning of their text, then by a hash of it, so that a
    # hot id fills as many files as its different texts need.
    order = ["doc_id", F.substring("text", 1, 64), F.xxhash64("text")]
    ordered = rows.repartitionByRange(*order).sortWithinPartitions(*order)
    schema = "part long, file string, n_docs long, n_tokens long, last_id long"
    manifest = stage(ordered.mapInArrow(save, schema), "token_manifest")
    return manifest.withColumn("file", F.concat(F.lit(folder.rstrip("/") + "/"), "file"))


def _open(file: str) -> Reader:
    system, path = pafs.FileSystem.from_uri(file)
    return Reader(system.open_input_file(path), system.get_file_info(path).size)


def read(manifest: DataFrame, *, keep_ids: bool = False) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32[, ids]) of every document, read from the files.

    start is the number of ids of all documents before it. Each file is a task of its own.
    """

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, first in zip(
                batch.column("file").to_pylist(), batch.column("first").to_pylist(), strict=True
            ):
                reader = _open(file)
                step = 2000
                for at in range(0, len(reader.lengths), step):
                    places = range(at, min(at + step, len(reader.lengths)))
                    checks, kept = [], []
                    for place in places:
                        ids = reader.document(place).tobytes()
                        checks.append(zlib.crc32(ids))
                        if keep_ids:
                            kept.append(ids)
                    own = slice(places.start, places.stop)
                    columns = [
                        pa.array(reader.doc_ids[own], pa.int64(), mask=reader.null[own]),
                        pa.array(reader.starts[own] + first),
                        pa.array(reader.lengths[own]),
                        pa.array(checks, pa.int64()),
                    ]
                    names = ["doc_id", "start", "n_tokens", "ids_crc32"]
                    if keep_ids:
                        columns.append(pa.array(kept, pa.binary()))
                        names.append("ids")
                    yield pa.RecordBatch.from_arrays(columns, names=names)

    # The sum runs over one row per file.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    first = F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).cast("long")
    files = manifest.select("file", first.alias("first"))
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids binary" * keep_ids
    return files.repartition(max(1, manifest.count())).mapInArrow(load, schema)


def fetch(manifest: DataFrame, wanted: DataFrame, *, doc_id: str = "doc_id") -> DataFrame:
    """(doc_id, ids) of the documents that `wanted` names, decompressing only their frames.

    The last id of each file, one number per file, is broadcast and tells which files may hold an id:
    one, or a run of them where rows share an id. Ids that no document has give no row; a null id
    names none.
    """
    files = manifest.orderBy("part").select("file", "last_id").collect()
    names = [f["file"] for f in files]
    lasts = [f["last_id"] for f in files]
    shared = manifest.sparkSession.sparkContext.broadcast((names, lasts))

    @F.arrow_udf("array<int>")
    def places(ids: pa.Array) -> pa.Array:
        # A file of null ids only comes first and holds no id.
        _, ends = shared.value
        ends = np.array([np.iinfo(np.int64).min if e is None else e for e in ends], np.int64)
        wanted = ids.to_numpy(zero_copy_only=False)
        first, last = np.searchsorted(ends, wanted), np.searchsorted(ends, wanted, "right")
        runs = [list(range(a, min(b + 1, len(ends)))) for a, b in zip(first.tolist(), last.tolist())]
        return pa.array(runs, pa.list_(pa.int32()))

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opened: tuple[int, Reader] | None = None
        for batch in batches:
            found = []
            for number, wanted_id in zip(
                batch.column("number").to_pylist(), batch.column("doc_id").to_pylist(), strict=True
            ):
                if opened is None or opened[0] != number:
                    opened = number, _open(shared.value[0][number])
                reader = opened[1]
                found += [(wanted_id, reader.document(p).tobytes()) for p in reader.find(wanted_id)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.binary())],
                names=["doc_id", "ids"],
            )

    asked = wanted.select(F.col(quoted(doc_id)).cast("long").alias("doc_id")).dropna().distinct()
    located = asked.withColumn("number", F.explode(places("doc_id")))
    located = located.repartition("number").sortWithinPartitions("number", "doc_id")
    return located.mapInArrow(load, "doc_id long, ids binary")


def sweep(spark: SparkSession, manifest: DataFrame) -> int:
    """Delete what failed attempts left beside the files of a manifest; returns their number."""
    listed = {row["file"].rpartition("/")[2] for row in manifest.select("file").collect()}
    sample = manifest.select("file").first()
    if sample is None:
        return 0
    system, base = pafs.FileSystem.from_uri(sample["file"].rpartition("/")[0])
    left = [f.path for f in system.get_file_info(pafs.FileSelector(base)) if f.base_name not in listed]
    for path in left:
        system.delete_file(path)
    return len(left)

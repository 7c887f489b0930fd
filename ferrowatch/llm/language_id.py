"""Language identification by prediction by partial matching.

Each language has a tree of byte contexts of up to three bytes with the counts of what follows.
A byte costs -log2 of its share in its longest known context; where the context has never been
followed by it, an escape is paid and the next shorter context is asked, down to a uniform byte.
The escape of a context is its number of different followers (method C). The statistics are
frozen after fitting, so the code length of a text is a sum over its bytes, and the language with
the shortest code wins.

The trees are over a folded alphabet: letters of ASCII in either case are one symbol, bytes beyond
ASCII stand for themselves, and all other bytes (digits, marks, white space) are one symbol. A code
length is the exact one of the text so folded.

Fitting takes a sample of the labelled rows whose expected size per language is a parameter; its
grams are counted where the rows are and only the summed counts, bounded by the sample, reach the
driver. Prediction broadcasts the resulting tables and reads every byte of every text.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrowatch.llm.common import quoted, spare, whole, without

# Expected labelled rows per language that a model is fitted on, and the most languages it tells
# apart: those with the most labelled rows, equally common ones by name.
SAMPLE_ROWS = 2000
MAX_LANGUAGES = 100
ORDER = 3
# Bytes that are handled at once: a few arrays of so many rows and a column per language are alive.
BLOCK = 1 << 17
UNKNOWN = "und"
# Code lengths that still pass for a learned language: clean text takes 2 to 5 bits a byte, also
# where it is two words long, and other languages, consonants or base64 take 11 to 24.
RAW_BITS = 8.0
SLACK_BITS = 32.0
OUTPUT = ("lang_pred", "score", "bits_per_byte")


def _classes() -> np.ndarray:
    """Letters in lower case and bytes beyond ASCII stand for themselves, all else for a space.

    Zero is no class: it marks what precedes a text.
    """
    table = np.full(256, ord(" "), np.uint8)
    table[128:] = np.arange(128, 256)
    letters = np.arange(ord("a"), ord("z") + 1)
    table[letters] = letters
    table[letters - 32] = letters
    return table


CLASSES = _classes()


def grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The byte and the three before it, as one number for each byte; and the texts' lengths."""
    lengths = np.array([len(text) for text in texts], np.int64)
    joined = np.frombuffer((b"\0" * ORDER).join([b"", *texts]), np.uint8)
    classes = CLASSES[joined].astype(np.uint32)
    ends = np.cumsum(lengths + ORDER)
    inside = np.ones(len(joined), bool)
    for k in range(ORDER):
        inside[ends - lengths - 1 - k] = False
    classes[~inside] = 0
    windows = classes.copy()
    for k in range(1, ORDER + 1):
        windows[k:] |= classes[:-k] << np.uint32(8 * k)
    return windows[inside], lengths


class Table:
    """Rows of numbers by key: one probe of a slot table, then a search for the few left.

    The slot table is made on first use and has two to four slots a key.
    """

    def __init__(self, keys: np.ndarray, rows: np.ndarray) -> None:
        self.keys, self.rows = keys, rows
        self.bits = max(1, (2 * len(keys) - 1).bit_length())
        self.slots: np.ndarray | None = None

    def __getstate__(self) -> tuple:
        return self.keys, self.rows

    def __setstate__(self, state: tuple) -> None:
        self.__init__(*state)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The row number of each key; -1 where there is none."""
        if not len(self.keys):
            return np.full(len(wanted), -1, np.int32)
        if self.slots is None:
            self.slots = np.full(1 << self.bits, -1, np.int32)
            self.slots[self._slot(self.keys)] = np.arange(len(self.keys), dtype=np.int32)
        found = self.slots[self._slot(wanted)]
        other = np.flatnonzero((found >= 0) & (self.keys[found] != wanted))
        if len(other):
            at = np.searchsorted(self.keys, wanted[other])
            at[at == len(self.keys)] = 0
            found[other] = np.where(self.keys[at] == wanted[other], at, -1)
        return found

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys * np.uint32(2654435761)) >> np.uint32(32 - self.bits)


@dataclass
class Model:
    """Code lengths in bits, by gram and language, for contexts of 0 to ORDER bytes."""

    languages: list[str]
    costs: list[Table]
    escapes: list[Table]

    def bits(self, windows: np.ndarray) -> np.ndarray:
        """Bits of each byte in each language."""
        return self._bits(windows, ORDER)

    def _bits(self, windows: np.ndarray, order: int) -> np.ndarray:
        mask = np.uint32((1 << (8 * (order + 1))) - 1)
        windows = windows & mask
        table = self.costs[order]
        found = table.find(windows)
        bits = table.rows[found]
        left = np.flatnonzero(found < 0)
        if len(left) and order == 0:
            bits[left] = self.escapes[0].rows[0] + 8.0
        elif len(left):
            windows = windows[left]
            shorter = self._bits(windows, order - 1)
            context = self.escapes[order].find(windows >> np.uint32(8))
            known = np.flatnonzero(context >= 0)
            shorter[known] += self.escapes[order].rows[context[known]]
            bits[left] = shorter
        return bits

    def text_bits(self, texts: list[bytes]) -> np.ndarray:
        """Bits of each whole text in each language."""
        total = np.zeros((len(texts), len(self.languages)))
        for first, last in blocks([len(text) for text in texts]):
            if last - first == 1 and len(texts[first]) > 2 * BLOCK:
                total[first] = self._long_bits(texts[first])
                continue
            windows, lengths = grams(texts[first:last])
            full = np.flatnonzero(lengths)
            if len(full):
                starts = np.cumsum(lengths)[full] - lengths[full]
                sums = np.add.reduceat(self.bits(windows), starts, axis=0, dtype=np.float64)
                total[first + full] = sums
        return total

    def _long_bits(self, text: bytes) -> np.ndarray:
        """A very long text in blocks; a block begins with the context that ended the last one."""
        total = np.zeros(len(self.languages))
        for start in range(0, len(text), BLOCK):
            lead = min(start, ORDER)
            windows, _ = grams([text[start - lead : start + BLOCK]])
            total += self.bits(windows[lead:]).sum(axis=0, dtype=np.float64)
        return total


def blocks(lengths: list[int]) -> Iterator[tuple[int, int]]:
    """Runs of texts of about BLOCK bytes."""
    first, size = 0, 0
    for place, length in enumerate(lengths):
        if size and size + length > BLOCK:
            yield first, place
            first, size = place, 0
        size += length
    if lengths:
        yield first, len(lengths)


def build_model(languages: list[str], counts: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """counts: for each language the grams of ORDER + 1 bytes and how often each occurs."""
    n = len(languages)
    costs: list[Table] = []
    escapes: list[Table] = []
    for order in range(ORDER + 1):
        mask = np.uint32((1 << (8 * (order + 1))) - 1)
        own = []
        for keys, times in counts:
            short, place = np.unique(keys & mask, return_inverse=True)
            own.append((short, np.bincount(place, times, len(short))))
        union = np.unique(np.concatenate([keys for keys, _ in own]))
        contexts = np.unique(union >> np.uint32(8)) if order else np.zeros(1, np.uint32)
        bits = np.zeros((len(union), n), np.float32)
        escape = np.zeros((len(contexts), n), np.float32)
        if order:
            lower = costs[order - 1]
            bits[:] = lower.rows[np.searchsorted(lower.keys, union & (mask >> np.uint32(8)))]
        else:
            bits[:] = 8.0
        for k, (keys, times) in enumerate(own):
            context = np.searchsorted(contexts, keys >> np.uint32(8)) if order else np.zeros(len(keys), int)
            total = np.bincount(context, times, len(contexts))
            kinds = np.bincount(context, minlength=len(contexts))
            seen = total > 0
            escape[seen, k] = np.log2((total + kinds)[seen] / kinds[seen])
            of = np.searchsorted(contexts, union >> np.uint32(8)) if order else np.zeros(len(union), int)
            bits[:, k] += escape[of, k]
            bits[np.searchsorted(union, keys), k] = np.log2((total + kinds)[context] / times)
        costs.append(Table(union, bits))
        escapes.append(Table(contexts, escape))
    return Model(languages, costs, escapes)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, gram, n) of (lang, body) rows, summed per batch."""
    for batch in batches:
        langs = np.array(batch.column("lang").to_pylist(), object)
        texts = batch.column("body").to_pylist()
        for lang in dict.fromkeys(langs):
            own = [text for text, of in zip(texts, langs, strict=True) if of == lang]
            for first, last in blocks([len(text) for text in own]):
                keys, times = np.unique(grams(own[first:last])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(keys), pa.string()),
                        pa.array(keys.astype(np.int64)),
                        pa.array(times.astype(np.int64)),
                    ],
                    names=["lang", "gram", "n"],
                )


def held_out(doc_id: Column) -> Column:
    """Whether a row is kept from fitting: a third of them, by a checksum of the id."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def fit(
    labelled: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Fit on about sample_rows rows of each language, chosen by a hash of id, text and label.

    Rows that share or lack an id are chosen one by one; rows equal in all three are one. Rows with
    a null text or label teach nothing. Of more than MAX_LANGUAGES labels the most common are
    learned. Without any labelled row the model knows no language and predicts none.
    """
    rows = labelled.select(
        F.col(quoted(doc_id)).alias("id"),
        F.col(quoted(lang)).cast("string").alias("lang"),
        F.col(quoted(text)).alias("text"),
    ).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = rows.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(MAX_LANGUAGES).collect()
    if not sizes:
        return Model([], [], [])
    share = F.pmod(F.xxhash64("id", "text", "lang"), F.lit(2**40)) / F.lit(float(2**40))
    chosen = F.lit(False)
    for size in sizes:
        chosen |= (F.col("lang") == size["lang"]) & (share < sample_rows / size["count"])
    sample = rows.where(chosen).distinct().select("lang", F.col("text").cast("binary").alias("body"))
    summed = (
        sample.mapInArrow(_count, "lang string, gram long, n long")
        .groupBy("lang", "gram")
        .agg(F.sum("n").alias("n"))
        .toArrow()
    )
    names = np.array(summed.column("lang").to_pylist(), object)
    keys = summed.column("gram").to_numpy().astype(np.uint32)
    times = summed.column("n").to_numpy().astype(np.float64)
    languages = sorted(set(names))
    counts = []
    for name in languages:
        own = np.flatnonzero(names == name)
        own = own[np.argsort(keys[own])]
        counts.append((keys[own], times[own]))
    return build_model(languages, counts)


def is_spoken(text: str) -> Column:
    """Whether a predicted text is in its language at all, rather than in none that was learned.

    Its code must not be longer than the text as it is, at RAW_BITS a byte. SLACK_BITS are free,
    since a few bytes, a short word that was never seen, say too little. Digits and marks cost what a
    space costs, so a text with few letters between them passes.
    """
    excess = (F.col("bits_per_byte") - RAW_BITS) * F.octet_length(quoted(text))
    return (F.col("lang_pred") != UNKNOWN) & (excess <= SLACK_BITS)


def predict(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """Add lang_pred, score and bits_per_byte.

    score is the winner's share of the probability of the text, from 0 to 1: it weighs the learned
    languages against each other and is near 1 for any text of some words. bits_per_byte is the
    length of the winner's code by the text's, and tells text of a learned language from other
    text: see is_spoken. A null text and one without a letter get `und`, 0 and null, as does every text
    where the model knows no language. Of languages with equal codes the first by name wins. Only the text is read;
    columns of the input with these names are replaced; rows are neither added nor lost.
    """
    docs = without(docs, OUTPUT)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("struct<lang_pred: string, score: double, bits_per_byte: double>")
    def judged(bodies: pa.Array) -> pa.Array:
        known = shared.value
        texts = bodies.to_pylist()
        asked = [place for place, body in enumerate(texts) if body is not None]
        names: list[str] = [UNKNOWN] * len(texts)
        scores = np.zeros(len(texts))
        lengths: list[float | None] = [None] * len(texts)
        if asked and known.languages:
            bits = known.text_bits([texts[place] for place in asked])
            best = bits.argmin(axis=1)
            above = bits - bits[np.arange(len(best)), best][:, None]
            scores[asked] = 1 / np.exp2(-above).sum(axis=1)
            for row, (place, winner) in enumerate(zip(asked, best, strict=True)):
                names[place] = known.languages[winner]
                lengths[place] = bits[row, winner] / len(texts[place])
        return pa.StructArray.from_arrays(
            [pa.array(names, pa.string()), pa.array(scores), pa.array(lengths, pa.float64())],
            names=list(OUTPUT),
        )

    (found,) = spare(docs, "found")
    spoken = whole(text).rlike(r"\p{L}")
    body: Column = F.when(spoken, F.col(quoted(text)).cast("binary"))
    judged_docs = docs.withColumn(found, judged(body))
    return judged_docs.select(
        *[F.col(quoted(c)) for c in docs.columns], *[F.col(f"{found}.{c}").alias(c) for c in OUTPUT]
    )

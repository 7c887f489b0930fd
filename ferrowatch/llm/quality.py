"""A quality classifier over random-indexing word vectors.

Every word has a fixed random index vector with a few +1 and -1; the word's vector is the sum of
the index vectors of the words near it, over all documents. Words share a table of a fixed number of
rows by a checksum, so that the table, its sums and its broadcast have one size however large the
corpus is. A text is split into runs of letters and runs of anything else, since low quality shows
in marks and capitals too.

A document is the pool of its words' vectors: their mean, their mean product with the next word's
vector, and their spread. A network of two layers, trained on a bounded sample of labelled rows,
scores it; a part of the sample that the network does not see sets the temperature that makes its
scores probabilities.
"""

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrowatch.llm.common import quoted, spare, without

# Rows of the word table and length of a vector: two million numbers.
ROWS = 1 << 16
DIMENSIONS = 32
# Entries of an index vector that are not zero, and the words before and behind that are near.
NONZERO = 2
NEAR = 2
# Expected labelled rows that the network is trained on.
SAMPLE_ROWS = 20_000
# Bytes of text that are handled at once, a longer text by itself; words whose vectors are.
BLOCK = 2 << 20
WORDS = 1 << 15
HIDDEN = 32
EPOCHS = 60
BATCH = 128
STEP = 0.01
DECAY = 1e-3
# Every so many sample rows one is kept for the temperature.
CALIBRATION = 5
OUTPUT = ("score", "predicted")


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Places and signs of the entries of each row's index vector."""
    random = np.random.default_rng(11)
    places = np.argsort(random.random((ROWS, DIMENSIONS)), axis=1)[:, :NONZERO]
    return places.astype(np.int64), random.choice([-1.0, 1.0], (ROWS, NONZERO))


def word_rows(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The table row of each word of all texts, and how many words each text has."""
    apart = pc.replace_substring_regex(texts, r"([^\pL\s]+)", r" \1 ")
    lists = pc.split_pattern(pc.replace_substring_regex(apart, r"\s+", " "), " ")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten().dictionary_encode()
    spelled = words.dictionary.cast(pa.binary()).to_numpy(zero_copy_only=False)
    checks = np.fromiter(map(zlib.crc32, spelled), np.int64, len(spelled)) % ROWS
    empty = np.fromiter(map(len, spelled), np.int64, len(spelled)) == 0
    codes = words.indices.to_numpy()
    real = ~empty[codes]
    total = np.append(0, np.cumsum(real))
    stops = np.cumsum(sizes)
    return checks[codes[real]], total[stops] - total[stops - sizes]


def text_blocks(texts: pa.Array) -> Iterator[pa.Array]:
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
    first = 0
    while first < len(texts):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + BLOCK, "right")))
        yield texts.slice(first, last - first)
        first = last


def context_sums(rows: np.ndarray, sizes: np.ndarray, places: np.ndarray, signs: np.ndarray) -> np.ndarray:
    """Sums of the index vectors of near words, by row, in one long array; the counts behind them."""
    doc = np.repeat(np.arange(len(sizes)), sizes)
    sums = np.zeros(ROWS * DIMENSIONS)
    for away in range(1, NEAR + 1):
        same = doc[away:] == doc[:-away]
        one, other = rows[:-away][same], rows[away:][same]
        for word, near in ((one, other), (other, one)):
            for entry in range(NONZERO):
                at = word * DIMENSIONS + places[near, entry]
                sums += np.bincount(at, signs[near, entry], ROWS * DIMENSIONS)
    return np.append(sums, np.bincount(rows, minlength=ROWS))


def word_vectors(sums: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Vectors of the rows: their sums without what any word near would add, at length one, with
    less weight the more common the words are. Rows without words are zero."""
    total = max(counts.sum(), 1.0)
    # Index vectors' mean, weighed as the words occur: how near words look on average.
    mean = sums.sum(axis=0) / max(np.abs(sums).sum(), 1.0)
    weight = np.abs(sums).sum(axis=1, keepdims=True)
    own = sums - weight * mean
    length = np.sqrt((own**2).sum(axis=1, keepdims=True))
    vectors = np.divide(own, length, out=np.zeros_like(own), where=length > 0)
    share = np.divide(counts, total, out=np.zeros(ROWS), where=counts > 0)
    return (vectors * (1e-3 / (1e-3 + share))[:, None]).astype(np.float32)


def pooled(rows: np.ndarray, sizes: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """For each text the mean of its words' vectors, of their products with the next ones', and
    their spread; zeros for a text without words."""
    sums = np.zeros((len(sizes), 3 * DIMENSIONS))
    doc = np.repeat(np.arange(len(sizes)), sizes)
    for at in range(0, len(rows), WORDS):
        own = vectors[rows[at : at + WORDS + 1]]
        text = doc[at : at + WORDS + 1]
        after = np.zeros_like(own)
        after[:-1] = own[:-1] * own[1:]
        # The last word of a text has no next one.
        after[:-1][text[:-1] != text[1:]] = 0.0
        n = min(WORDS, len(rows) - at)
        first = np.flatnonzero(np.append(True, text[1:n] != text[: n - 1]))
        for k, part in enumerate((own[:n], after[:n], np.square(own[:n], dtype=np.float64))):
            columns = slice(k * DIMENSIONS, (k + 1) * DIMENSIONS)
            sums[text[first], columns] += np.add.reduceat(part, first, axis=0, dtype=np.float64)
    number = np.maximum(sizes, 1)[:, None]
    mean, after, square = np.split(sums, 3, axis=1)
    spread = np.sqrt(np.maximum(square / number - (mean / number) ** 2, 0.0))
    return np.concatenate([mean / number, after / np.maximum(number - 1, 1), spread], axis=1)


@dataclass
class Network:
    """Two layers, with the scaling of their input and the temperature of their output."""

    centre: np.ndarray
    scale: np.ndarray
    weights: list[np.ndarray]
    temperature: float = 1.0

    def logits(self, features: np.ndarray) -> np.ndarray:
        first, bias, second, shift = self.weights
        hidden = np.maximum((features - self.centre) / self.scale @ first + bias, 0.0)
        return hidden @ second + shift

    def scores(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(features) / self.temperature, -500, 500)))


def train(features: np.ndarray, labels: np.ndarray) -> Network:
    """Fit by Adam on the logistic loss, then the temperature on rows that were kept apart."""
    random = np.random.default_rng(5)
    order = random.permutation(len(labels))
    apart, own = order[::CALIBRATION], np.delete(order, np.s_[::CALIBRATION])
    if len(own) == 0:
        own = order
    n = features.shape[1]
    scale = features[own].std(axis=0)
    weights = [
        random.standard_normal((n, HIDDEN)) * np.sqrt(2 / n),
        np.zeros(HIDDEN),
        random.standard_normal(HIDDEN) * np.sqrt(1 / HIDDEN),
        np.zeros(()),
    ]
    network = Network(features[own].mean(axis=0), np.where(scale > 1e-9, scale, 1.0), weights)
    inputs, targets = (features[own] - network.centre) / network.scale, labels[own].astype(float)
    means = [np.zeros_like(w) for w in weights]
    squares = [np.zeros_like(w) for w in weights]
    step = 0
    for epoch in range(EPOCHS):
        rate = STEP * 0.5 * (1 + np.cos(np.pi * epoch / EPOCHS))
        shuffled = random.permutation(len(own))
        for at in range(0, len(own), BATCH):
            batch = shuffled[at : at + BATCH]
            x = inputs[batch]
            first, bias, second, shift = weights
            before = x @ first + bias
            hidden = np.maximum(before, 0.0)
            error = 1 / (1 + np.exp(-np.clip(hidden @ second + shift, -500, 500))) - targets[batch]
            error /= len(batch)
            back = np.outer(error, second) * (before > 0)
            slopes = [x.T @ back + DECAY * first, back.sum(0), hidden.T @ error + DECAY * second, error.sum()]
            step += 1
            for k, slope in enumerate(slopes):
                means[k] = 0.9 * means[k] + 0.1 * slope
                squares[k] = 0.999 * squares[k] + 0.001 * slope**2
                change = means[k] / (1 - 0.9**step) / (np.sqrt(squares[k] / (1 - 0.999**step)) + 1e-8)
                weights[k] = weights[k] - rate * change
    network.weights = weights
    network.temperature = temperature(network.logits(features[apart]), labels[apart])
    return network


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The number that logits are divided by for the least logistic loss, from 0.1 to 10."""
    if not len(labels):
        return 1.0
    side = np.where(labels == 1, 1.0, -1.0) * logits

    def loss(log: float) -> float:
        return float(np.logaddexp(0.0, -side / np.exp(log)).mean())

    low, high = np.log(0.1), np.log(10.0)
    ratio = (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        if loss(a) <= loss(b):
            high = b
        else:
            low = a
    return float(np.exp((low + high) / 2))


@dataclass
class Model:
    """Word vectors and the network; without labels of both kinds there is no network, and prior is
    the score of every text."""

    vectors: np.ndarray
    network: Network | None
    prior: float

    def scores(self, texts: pa.Array) -> np.ndarray:
        if self.network is None:
            return np.full(len(texts), self.prior)
        parts = [self.network.scores(pooled(*word_rows(part), self.vectors)) for part in text_blocks(texts)]
        return np.concatenate(parts) if parts else np.zeros(0)


def corpus_vectors(docs: DataFrame, *, text: str = "text") -> np.ndarray:
    """The word vectors of all texts. A task adds up its table and gives each row that has words
    once; the tables are added up by row. The result is the table, of a fixed size."""
    names = [f"s{d}" for d in range(DIMENSIONS)]

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places, signs = index_vectors()
        total = np.zeros(ROWS * (DIMENSIONS + 1))
        for batch in batches:
            for part in text_blocks(batch.column(0).fill_null("")):
                total += context_sums(*word_rows(part), places, signs)
        sums, counts = total[:-ROWS].reshape(ROWS, DIMENSIONS).astype(np.int64), total[-ROWS:].astype(np.int64)
        own = np.flatnonzero(counts)
        columns = [pa.array(own), pa.array(counts[own]), *[pa.array(sums[own, d]) for d in range(DIMENSIONS)]]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "n", *names])

    schema = ", ".join(f"{name} long" for name in ["row", "n", *names])
    tables = docs.select(F.col(quoted(text)).alias("text")).mapInArrow(counted, schema)
    found = tables.groupBy("row").agg(*[F.sum(name).alias(name) for name in ["n", *names]]).toArrow()
    sums, counts = np.zeros((ROWS, DIMENSIONS)), np.zeros(ROWS)
    rows = found.column("row").to_numpy()
    counts[rows] = found.column("n").to_numpy()
    for d, name in enumerate(names):
        sums[rows, d] = found.column(name).to_numpy()
    return word_vectors(sums, counts)


def fit(
    docs: DataFrame,
    labels: DataFrame,
    *,
    doc_id: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    taught: Column | None = None,
    sample_rows: int = SAMPLE_ROWS,
) -> Model:
    """Learn word vectors from all texts of docs and the network from about sample_rows labelled ones.

    labels holds ids with 0 or 1; other values and ids with both teach nothing, nor do documents for
    which `taught`, a condition over docs' id, is not true. Of documents that share an id about one
    is taken.
    """
    known = labels.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(label)).cast("int").alias("label"))
    known = known.where("id IS NOT NULL AND label IN (0, 1)").groupBy("id")
    known = known.agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most")
    ids = docs.where(taught if taught is not None else F.lit(True)).groupBy(F.col(quoted(doc_id)).alias("id"))
    ids = ids.agg(F.count("*").alias("copies")).join(known.select("id", "label"), "id")
    number = ids.count()
    vectors = corpus_vectors(docs, text=text)
    if not number:
        return Model(vectors, None, 0.5)
    share = F.pmod(F.xxhash64("id"), F.lit(2**40)) / F.lit(float(2**40))
    # Ids by their hash, so about sample_rows of them; of rows that share one about one by theirs.
    chosen = ids.where(share < min(1.0, sample_rows / number))
    rows = docs.select(F.col(quoted(doc_id)).alias("id"), F.col(quoted(text)).alias("text"))
    rows = rows.join(F.broadcast(chosen), "id")
    rows = rows.where(F.pmod(F.xxhash64("id", "text", F.lit(1)), F.col("copies")) == 0)
    rows = rows.select("id", "label", "text").distinct()
    shared = docs.sparkSession.sparkContext.broadcast(vectors)

    @F.arrow_udf("array<double>")
    def features(texts: pa.Array) -> pa.Array:
        texts = texts.fill_null("")
        parts = [pooled(*word_rows(part), shared.value) for part in text_blocks(texts)]
        found = np.concatenate(parts) if parts else np.zeros((0, 3 * DIMENSIONS))
        offsets = pa.array(np.arange(len(found) + 1) * found.shape[1], pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))

    sample = rows.select("id", "label", F.xxhash64("text").alias("hash"), features("text").alias("x")).toArrow()
    sample = sample.sort_by([("id", "ascending"), ("hash", "ascending")])
    taught_labels = sample.column("label").to_numpy()
    if len(set(taught_labels.tolist())) < 2:
        return Model(vectors, None, float(taught_labels.mean()) if len(taught_labels) else 0.5)
    flat = sample.column("x").combine_chunks().flatten().to_numpy()
    return Model(vectors, train(flat.reshape(len(taught_labels), -1), taught_labels), 0.5)


def predict(docs: DataFrame, model: Model, *, text: str = "text") -> DataFrame:
    """Add score, the probability of label 1 from 0 to 1, and predicted, 1 from a score of 0.5 on.

    A null text is empty, and an empty text has no words: its score is that of a zero vector. Only
    the text is read; columns of the input with these names are replaced; rows are neither added
    nor lost.
    """
    docs = without(docs, OUTPUT)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf("double")
    def judged(texts: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(texts.fill_null("")))

    (found,) = spare(docs, "found")
    scored = docs.withColumn(found, judged(F.col(quoted(text))))
    return scored.select(
        *[F.col(quoted(c)) for c in docs.columns],
        F.col(found).alias("score"),
        (F.col(found) >= 0.5).cast("int").alias("predicted"),
    )

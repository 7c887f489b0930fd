"""The quality classifier: its parts against plain loops, and held-out accuracy."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from ferrowatch.llm import quality, queries


def test_words_and_their_rows():
    rows, sizes = quality.word_rows(pa.array(["", "Ab,  cd!!\nAb", " \t ", "Ab"]))
    assert sizes.tolist() == [0, 5, 0, 1]
    assert rows[0] == rows[4] == rows[5] and len(set(rows[:4].tolist())) == 4


def test_context_sums_equal_loops():
    random = np.random.default_rng(3)
    sizes = np.array([0, 1, 2, 7, 0, 30])
    rows = random.integers(0, 9, sizes.sum())
    places, signs = quality.index_vectors()
    expected = np.zeros((quality.ROWS, quality.DIMENSIONS))
    first = 0
    for size in sizes:
        own = rows[first : first + size]
        first += size
        for i in range(size):
            for j in range(size):
                if 0 < abs(i - j) <= quality.NEAR:
                    np.add.at(expected[own[i]], places[own[j]], signs[own[j]])
    found = quality.context_sums(rows, sizes, places, signs)
    assert (found[: -quality.ROWS].reshape(expected.shape) == expected).all()
    assert (found[-quality.ROWS :] == np.bincount(rows, minlength=quality.ROWS)).all()


@pytest.mark.parametrize("words", [3, 1000])
def test_pool_equals_loops(words, monkeypatch):
    monkeypatch.setattr(quality, "WORDS", words)
    random = np.random.default_rng(4)
    sizes = np.array([0, 1, 2, 17, 0, 5])
    rows = random.integers(0, 20, sizes.sum())
    vectors = random.standard_normal((20, quality.DIMENSIONS)).astype(np.float32)
    found = quality.pooled(rows, sizes, vectors)
    for k, (size, stop) in enumerate(zip(sizes, np.cumsum(sizes))):
        own = vectors[rows[stop - size : stop]].astype(float)
        zero = np.zeros(quality.DIMENSIONS)
        after = (own[:-1] * own[1:]).mean(0) if size > 1 else zero
        expected = [own.mean(0), after, own.std(0)] if size else [zero] * 3
        assert found[k] == pytest.approx(np.concatenate(expected), abs=1e-4)


def test_temperature_undoes_a_scale():
    random = np.random.default_rng(6)
    logits = random.standard_normal(20_000) * 2
    labels = (random.random(20_000) < 1 / (1 + np.exp(-logits))).astype(int)
    assert quality.temperature(logits * 3, labels) == pytest.approx(3, rel=0.1)
    assert quality.temperature(np.zeros(0), np.zeros(0)) == 1.0


def test_held_out_documents(spark):
    directory = "/root/testdata/sf0.01"
    rows = queries.queries()["op12_quality"](spark, directory)
    assert rows.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{directory}/labels.parquet").select("doc_id", "quality")
    assert rows.count() == spark.read.parquet(f"{directory}/documents.parquet").count()
    judged = rows.join(labels, "doc_id").where("held_out").collect()
    good = np.array([r.score for r in judged if r.quality == 1])
    bad = np.array([r.score for r in judged if r.quality == 0])
    assert len(bad) > 10 and (good[:, None] > bad[None]).mean() > 0.97
    assert np.mean([r.predicted == r.quality for r in judged]) > 0.95
    assert rows.where("score < 0 OR score > 1 OR score IS NULL OR predicted <> int(score >= 0.5)").count() == 0


@pytest.fixture
def texts(docs_of):
    good = [(k, f"the cat {k} sat on the mat and slept " * 3) for k in range(60)]
    bad = [(100 + k, f"BUY !! NOW !! {k} $$$ " * 5) for k in range(60)]
    return docs_of([*good, *bad, (None, None), (200, ""), (7, "x" * 300_000), (8, "one " * 60_000), (9, "9")])


@pytest.fixture
def marks(spark):
    rows = [(k, 1) for k in range(60)] + [(100 + k, 0) for k in range(60)] + [(None, 1), (3, 1), (5, 0), (6, 7), (999, 0)]
    return spark.createDataFrame(rows, "doc_id long, quality int")


def test_awkward_rows(texts, marks):
    model = quality.fit(texts, marks, taught=F.col("doc_id") % 3 != 1)
    found = quality.predict(texts, model).collect()
    assert len(found) == 125 and all(r.n == 1 and r.kept is True for r in found)
    by_id = {r.doc_id: r for r in found if r.n == 1}
    assert by_id[None].score == by_id[200].score and 0 <= by_id[200].score <= 1
    assert np.mean([by_id[k].score for k in range(10, 60)]) > 0.8 > 0.2 > np.mean([by_id[100 + k].score for k in range(60)])
    again = quality.predict(texts, quality.fit(texts.repartition(5), marks, taught=F.col("doc_id") % 3 != 1))
    assert {r.doc_id: round(r.score, 9) for r in again.collect()} == {r.doc_id: round(r.score, 9) for r in found}


def test_hot_id_and_bounded_sample(docs_of, marks):
    docs = docs_of([(1, f"the cat {k}") for k in range(500)] + [(100, "BUY !!")] * 500 + [(101, "NOW !!")])
    model = quality.fit(docs, marks, sample_rows=50)
    assert model.network is not None


def test_nothing_to_learn(texts, marks):
    none = quality.fit(texts, marks.limit(0))
    assert {r.score for r in quality.predict(texts, none).collect()} == {0.5}
    ones = quality.fit(texts, marks.where("quality = 1"))
    assert {r.score for r in quality.predict(texts, ones).collect()} == {1.0}
    empty = quality.fit(texts.limit(0), marks)
    assert quality.predict(texts.limit(0), empty).count() == 0

"""Hard negatives against brute force and SQL, tied scores and awkward rows included."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ferrowatch.llm import hard_negatives, queries

SCHEMA = "vec_id long, embedding array<double>, label int, score string, row int"


def brute_force(rows):
    """(anchor, positive, rank, negative, positive score, negative score) by plain loops."""
    whole = [(i, label, [math.floor(256 * x) for x in v]) for i, v, label in rows]
    out = []
    for anchor, label, v in whole:
        if anchor % 100:
            continue
        scored = [(-sum(a * b for a, b in zip(v, w)), i, own) for i, own, w in whole if i != anchor]
        scored = sorted((s, i, own == label) for s, i, own in scored)
        for score, positive, _ in [x for x in scored if x[2]][:5]:
            fits = [(s, i) for s, i, own in scored if not own and -30 * score <= -100 * s <= -90 * score]
            out += [(anchor, positive, k + 1, i, -score, -s) for k, (s, i) in enumerate(fits[:10])]
    return sorted(out)


def mined(spark, rows):
    frame = spark.createDataFrame([(*row, "x", 1) for row in rows], SCHEMA)
    return sorted(tuple(r) for r in hard_negatives.mine_negatives(frame, F.col("vec_id") % 100 == 0).collect())


def vectors(n, dims, steps, labels=3, seed=1):
    """Vectors of so few different components that many scores are equal."""
    random = np.random.default_rng(seed)
    values = random.integers(-1, steps, (n, dims)) / 256
    return [(i, v.tolist(), int(random.integers(labels))) for i, v in enumerate(values)]


@pytest.mark.parametrize("dims", [1, 8, 13])
def test_scores_are_exact(dims):
    random = np.random.default_rng(dims)
    for low, high in ((0, 1), (-1, 2), (-300, 300), (-(1 << 40), 1 << 20)):
        rows, anchors = random.integers(low, high, (50, dims)), random.integers(-200, 200, (7, dims))
        found = hard_negatives.scores(hard_negatives.bit_planes(rows), hard_negatives.subset_sums(anchors))
        assert (found == rows @ anchors.T).all()


def test_ties_in_one_block(spark):
    rows = vectors(450, 10, 3)
    assert mined(spark, rows) == brute_force(rows) and len(mined(spark, rows)) > 50


def test_ties_over_many_blocks_and_tiles(spark, monkeypatch):
    for name, size in (("BLOCK_ROWS", 90), ("ANCHOR_ROWS", 2), ("TILE_ROWS", 16), ("TILE_ANCHORS", 2)):
        monkeypatch.setattr(hard_negatives, name, size)
    rows = [(i, v, 0 if i % 3 else label) for i, v, label in vectors(650, 10, 3, seed=2)]
    assert mined(spark, rows) == brute_force(rows)


def test_awkward_rows(spark):
    rows = [(i, v, 0) for i, v, _ in vectors(30, 4, 5, seed=3)] + [(200 + i, v, 1) for i, v, _ in vectors(40, 4, 9, seed=4)]
    out = [
        (900, None, 0), (1000, [0.1] * 4, None), (None, [0.1] * 4, 1), (50, [0.1, None, 0.1, 0.1], 1),
        (51, [float("nan")] * 4, 1), (52, [float("inf"), 0.0, 0.0, 0.0], 1), (53, [0.1], 1), (54, [], 1),
    ]
    assert mined(spark, rows + out + rows) == brute_force(rows)
    assert mined(spark, out[:3]) == [] and mined(spark, []) == []
    # One label alone has no negatives, and an anchor alone has no positive.
    assert mined(spark, [row for row in rows if row[2] == 0]) == []
    assert mined(spark, [(0, [1.0], 0), (1, [1.0], 1)]) == []
    with pytest.raises(ValueError):
        mined(spark, [(0, [1e30], 0)])


def test_query_equals_sql(spark, small, sql):
    names, expected = sql(queries.oracle_sql()["op11_hard_negatives"])
    found = queries.queries()["op11_hard_negatives"](spark, small)
    assert found.columns == names
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected) and expected

"""Periodic runs against brute force over all periods, and the grammar's extensions."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from ferrowatch.llm import periodic, queries
from ferrowatch.llm.grammar import Grammar

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def all_runs(words, least=24):
    """Every stretch that keeps a period and cannot be longer, by trying all periods."""
    n, least_period = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            first = i
            while i + p < n and words[i] == words[i + p]:
                i += 1
            if i - first + p >= max(least, 3 * p):
                least_period.setdefault((first, i - first + p), p)
            i += 1
    return sorted((start, length, p) for (start, length), p in least_period.items())


def collapsed(words, runs):
    gone = {i for start, length, p in runs for i in range(start + p, start + length)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def repetitive(dice, kinds, n):
    words = []
    while len(words) < n:
        if dice.random() < 0.4:
            part = [dice.randrange(kinds) for _ in range(dice.randint(1, 12))]
            words += part * dice.randint(2, 15)
            words = words[: len(words) - dice.randint(0, len(part))]
        words += [dice.randrange(kinds) for _ in range(dice.randint(0, 8))]
    return words[:n]


@pytest.mark.parametrize("least", [24, 4])
def test_runs_equal_brute_force(least):
    dice = random.Random(least)
    for _ in range(60):
        sizes = [dice.choice([0, 1, 10, 30, 90, 400]) for _ in range(dice.randint(1, 6))]
        texts = [repetitive(dice, dice.choice([1, 2, 3, 50]), n) for n in sizes]
        codes = np.array([c for words in texts for c in words], np.int64)
        found = periodic.find_runs(codes, np.array(sizes, np.int64), least)
        expected = [(k, *run) for k, words in enumerate(texts) for run in all_runs(words, least)]
        assert [tuple(row) for row in found.tolist()] == expected


def test_grid_points_in_small_blocks(monkeypatch):
    monkeypatch.setattr(periodic, "GRID", 7)
    words = repetitive(random.Random(1), 3, 300)
    found = periodic.find_runs(np.array(words), np.array([300]), 6)
    assert [tuple(row[1:]) for row in found.tolist()] == all_runs(words, 6)


@pytest.mark.parametrize("kinds", [1, 2, 40])
def test_extensions_are_exact(kinds):
    dice = random.Random(kinds)
    words = np.array([-1, *repetitive(dice, kinds, 700), -2])
    one = np.array([dice.randint(1, 600) for _ in range(300)])
    other = one + np.array([dice.randint(1, 90) for _ in range(300)])
    grammar = Grammar(words)
    ahead = grammar.extend(one, other, forward=True)
    behind = grammar.extend(one, other, forward=False)
    for a, b, f, g in zip(one.tolist(), other.tolist(), ahead.tolist(), behind.tolist()):
        assert f == next(k for k in range(701) if words[a + k] != words[b + k])
        assert g == next(k for k in range(701) if words[a - 1 - k] != words[b - 1 - k])


def test_awkward_rows(docs_of):
    rows = [(1, None), (2, ""), (3, " \t\n"), (None, "a " * 30), (4, "a " * 30), (4, "a " * 30), (5, "x y z " * 9)]
    rows.append((6, "ab\x0bcd ef " * 200_000))
    found = periodic.collapse_runs(docs_of(rows)).collect()
    assert [(r.doc_id, r.n, r.score) for r in found] == [(d, 1, "x") for d, _ in rows]
    by_id = {r.doc_id: r for r in found}
    assert all((by_id[d].n_words, by_id[d].runs, by_id[d].collapsed) == (0, [], "") for d in (1, 2, 3))
    assert [tuple(r) for r in by_id[4].runs] == [(0, 30, 1)] and by_id[4].collapsed == "a"
    assert by_id[None].runs == by_id[4].runs
    assert [tuple(r) for r in by_id[5].runs] == [(0, 27, 3)] and by_id[5].collapsed == "x y z"
    assert [tuple(r) for r in by_id[6].runs] == [(0, 400_000, 2)]
    assert periodic.collapse_runs(docs_of(rows).limit(0)).count() == 0


def test_columns_of_the_same_names_are_replaced(spark):
    docs = spark.createDataFrame([(1, "b " * 24, 7, "x")], "RUNS int, Text string, n_words int, place string")
    found = periodic.collapse_runs(docs).collect()
    assert [tuple(r)[:2] for r in found] == [("b " * 24, "x")] and found[0].n_words == 24


def test_query_equals_brute_force(spark, small):
    expected = {}
    for row in spark.read.parquet(f"{small}/documents.parquet").collect():
        words = WORD.findall(row.text or "")
        h, n = zlib.crc32(str(row.doc_id).encode()), len(words)
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
        runs = all_runs(words)
        best = max(runs, key=lambda r: (r[1] / r[2], -r[0], -r[2]), default=None)
        digests = ["".join(f"{s},{length},{p}\n" for s, length, p in runs), collapsed(words, runs)]
        digests = [hashlib.sha256(d.encode()).hexdigest() for d in digests]
        tail = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        expected[row.doc_id] = (len(runs), *tail, *digests)
    found = queries.queries()["op13_periodic_runs"](spark, small).collect()
    assert {r.doc_id: tuple(r)[1:] for r in found} == expected
    assert len(found) == len(expected) and sum(r.n_runs > 0 for r in found) > 10

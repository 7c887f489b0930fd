"""Exact and near deduplication against brute force, with the awkward cases."""

import re
from collections import defaultdict

from ferrowatch.llm import exact_dedup, near_dedup, queries

LONG = "lorem ipsum " * 20_000
ROWS = [
    (1, "same text"), (2, "same text"), (2, "same text"), (3, None), (4, ""), (None, "same text"),
    (5, LONG), (6, LONG), (7, LONG + "x"), (8, "same texT"), (9, "ünïcode"), (10, "same text "),
]


def test_exact_groups(docs_of):
    docs = docs_of(ROWS)
    result = exact_dedup.exact_groups(docs)
    assert set(result.columns) == set(docs.columns) | {"keep_id", "group_size"}
    found = [(r.doc_id, r.text, r.keep_id, r.group_size, r.kept) for r in result.collect()]
    members = defaultdict(list)
    for doc_id, text in ROWS:
        members[text or ""].append(doc_id)
    assert len(found) == len(ROWS)
    for doc_id, text, keep_id, size, kept in found:
        own = members[text or ""]
        assert (keep_id, size) == (max(i for i in own if i is not None), len(own))
        assert not kept or doc_id == keep_id
    for text in members:
        assert sum(kept for _, t, _, _, kept in found if (t or "") == text) == 1


def test_exact_dedup_keeps_columns_and_empty_tables(docs_of):
    docs = docs_of(ROWS)
    kept = exact_dedup.exact_dedup(docs)
    assert kept.count() == len({text or "" for _, text in ROWS})
    assert exact_dedup.exact_groups(docs.limit(0)).count() == 0


def components(rows, width):
    """Brute force: (n_shingles, component) by id."""
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
    sets = {}
    for doc_id, text in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(lower))
        short = [tuple(words)] if words else []
        runs = [tuple(words[i : i + width]) for i in range(len(words) - width + 1)] or short
        sets[doc_id] = frozenset(runs)
    label = {doc_id: doc_id for doc_id in sets}
    changed = True
    while changed:
        changed = False
        for a in sets:
            for b in sets:
                both = len(sets[a] & sets[b])
                if a < b and both and 100 * both >= 80 * len(sets[a] | sets[b]) and label[a] != label[b]:
                    label[a] = label[b] = min(label[a], label[b])
                    changed = True
    return {doc_id: (len(sets[doc_id]), label[doc_id]) for doc_id in sets}


def test_near_groups_equal_brute_force(spark, small, docs_of):
    words = [f"w{i}" for i in range(200)]
    chain = [(1000 + k, " ".join(words[4 * k : 4 * k + 100])) for k in range(12)]
    odd = [(1, None), (2, ""), (3, "One"), (4, "one"), (5, "one two"), (6, " ONE\ttwo "), (7, "É a"), (8, "é a")]
    base = " ".join(f"t{i}" for i in range(120))
    near = [(2000 + k, base.replace(f"t{k} ", "other ").replace(f"t{k + 40} ", "more ")) for k in range(40)]
    rows = chain + odd + near
    found = near_dedup.near_groups(docs_of(rows), width=2)
    expected = components(rows, 2)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found.collect()} == expected
    assert all(r.kept == (r.doc_id == expected[r.doc_id][1]) for r in found.collect())


def test_near_query_equals_brute_force(spark, small):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").collect()]
    found = queries.queries()["op6_near_dedup"](spark, small).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in found} == components(rows, 2)


def test_near_dedup_empty_and_null_ids(docs_of):
    docs = docs_of([(None, "a b c d e f"), (3, "a b c d e f"), (4, "other words here")])
    assert near_dedup.near_groups(docs.limit(0)).count() == 0
    assert sorted(r.doc_id for r in near_dedup.near_dedup(docs).collect()) == [3, 4]


def test_near_dedup_decides_by_row(docs_of):
    alone = [(None, "quite other words in here"), (7, "a unique one with the id seven"), (None, None), (None, "")]
    groups = [
        [(None, "a b c d e f"), (3, "a b c d e f"), (7, "A b c d e f")],
        [(None, "only null ids in this group"), (None, "only null ids IN this group"), (None, "Only null ids in this group")],
        # Near but unequal texts under one smallest id.
        [(9, " ".join(f"t{k}" for k in range(100))), (9, " ".join(f"t{k}" for k in range(1, 101))),
         (12, " ".join(f"t{k}" for k in range(2, 102))), (None, " ".join(f"t{k}" for k in range(3, 103)))],
        # The largest long is an id like others.
        [(None, "one more text of six words"), (2**63 - 1, "one more text of six words")],
    ]
    docs = docs_of(alone + [row for group in groups for row in group])
    kept = near_dedup.near_dedup(docs)
    assert kept.columns == docs.columns
    rows = [(r.doc_id, r.text) for r in kept.collect()]
    assert len(rows) == len(alone) + len(groups) and all(row in rows for row in alone)
    assert [[i for i, t in rows if (i, t) in group] for group in groups] == [[3], [None], [9], [2**63 - 1]]
    found = near_dedup.near_groups(docs).collect()
    assert len(found) == docs.count() and sum(r.kept for r in found) == len(rows)
    assert all(r.component_id == r.doc_id for r in found if r.kept)

"""Encoding, packing and token files: exact round trips."""

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

import public_tokenizers
from ferrowatch.llm import packing, queries, token_files, tokens
from ferrowatch.llm.tokens import encoder

BYTE, WORD = (public_tokenizers.path(f) for f in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = [
    "", "a", " a", "a ", "a  ", "a   b", "a\n\nb", "a\n\n\nb", "\n", "It's we'll they'RE don't",
    "x<|endoftext|> y <|startoftext|>z", "naïve café Straße İstanbul ΑΣΣ ǅ ²³ Ⅷ", "tab\there\rcr",
    "日本語 テキスト。", "word***\nNext $$$ %%", "́lead ́x", "A" * 200 + " b", "don't. can't, I've; you'd:",
]


def encoded(path, texts):
    """The ids of each text, from the blocks that the encoder gives."""
    out = []
    for ids, lengths in encoder(path).encode(pa.array(texts, pa.string())):
        out += [part.tolist() for part in np.split(ids, np.cumsum(lengths)[:-1])]
    return out


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_are_the_tokenizers(path):
    plain = Tokenizer.from_file(path)
    expected = [plain.encode(text, add_special_tokens=False).ids for text in TEXTS]
    assert encoded(path, TEXTS) == expected
    assert encoded(path, [None, "a b", None]) == encoded(path, ["", "a b", ""])


@pytest.mark.parametrize("path", [BYTE, WORD])
def test_ids_over_blocks_and_when_words_are_forgotten(path, monkeypatch):
    monkeypatch.setattr(tokens, "BLOCK", 300)
    monkeypatch.setattr(tokens, "MEMO_ENTRIES", 5)
    plain = Tokenizer.from_file(path)
    texts = [f"{a} {b}" for a in TEXTS for b in TEXTS]
    assert encoded(path, texts) == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from(" \n\tab.'s1é<|>ß日İ"), max_size=30))
def test_ids_of_any_text(text):
    for path in (BYTE, WORD):
        expected = encoder(path).tokenizer.encode(text, add_special_tokens=False).ids
        assert encoded(path, [text]) == [expected]


def test_packing_places_every_id_once(spark, small):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    plain = Tokenizer.from_file(BYTE)
    ids = {d: plain.encode(t, add_special_tokens=False).ids + [0] for d, t in docs.items()}
    covered, sequences = defaultdict(int), defaultdict(list)
    for r in queries.queries()["op1_packing"](spark, small).collect():
        own = np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4")
        assert (len(own), zlib.crc32(own.tobytes())) == (r.length, r.ids_crc32)
        assert r.doc_tokens == len(ids[r.doc_id])
        covered[r.doc_id] += r.length
        sequences[r.sequence_id].append((r.offset, r.length))
    assert covered == {d: len(own) for d, own in ids.items()}
    fill = 0
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
        fill += at
    assert fill > 0.97 * 1024 * len(sequences)


def test_packing_of_awkward_rows(docs_of):
    docs = docs_of([(1, None), (None, ""), (2, "a b"), (2, "a b"), (3, "x y " * 3000)])
    rows = packing.pack(docs, BYTE, keep_ids=True).collect()
    assert sum(len(r.ids) // 4 for r in rows) == sum(r.length for r in rows)
    assert sorted(str(r.doc_id) for r in rows if r.length == 1) == ["1", "None"]
    assert packing.pack(docs.limit(0), BYTE).count() == 0


def test_histogram_packs_all_pieces():
    histogram = {1024: 3, 700: 5, 324: 4, 300: 7, 20: 100, 1: 3}
    packs = packing.pack_histogram(histogram, 1024)
    placed = defaultdict(int)
    for pattern, count in packs:
        assert sum(pattern) <= 1024
        for length in pattern:
            placed[length] += count
    assert placed == histogram


def test_token_files_round_trip(spark, docs_of, tmp_path):
    rows = [(5, "five words are in here"), (1, None), (3, "x " * 90_000), (None, "null id"), (3, "twice"), (4, "")]
    manifest = token_files.write(docs_of(rows), WORD, end_id=1, folder=str(tmp_path / "files"))
    plain = Tokenizer.from_file(WORD)
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at, expected = 0, []
    for doc_id, text in ordered:
        ids = np.array(plain.encode(text or "", add_special_tokens=False).ids + [1], "<u4").tobytes()
        expected.append((doc_id, at, len(ids) // 4, zlib.crc32(ids), ids))
        at += len(ids) // 4
    found = [tuple(r) for r in token_files.read(manifest, keep_ids=True).orderBy("start").collect()]
    assert [(*row[:4], bytes(row[4])) for row in found] == expected
    wanted = spark.createDataFrame([(3,), (4,), (99,), (None,)], "doc_id long")
    fetched = sorted((r.doc_id, bytes(r.ids)) for r in token_files.fetch(manifest, wanted).collect())
    assert fetched == sorted((row[0], row[4]) for row in expected if row[0] in (3, 4))
    (tmp_path / "files" / "part-000000-left.zst").write_bytes(b"half")
    assert token_files.sweep(spark, manifest) == 1


def test_reader_decompresses_only_what_it_needs(tmp_path):
    path = tmp_path / "one.zst"
    with path.open("wb") as stream:
        writer = token_files.Writer(stream, 2)
        for doc_id in range(50):
            writer.add(doc_id, np.full(20_000, doc_id))
        writer.close()
    with path.open("rb") as stream:
        reader = token_files.Reader(stream, path.stat().st_size)
        assert set(reader.document(reader.find(33)[0])) == {33}
        assert reader.frames_read == 1 < len(reader.ends)
    damaged = bytearray(path.read_bytes())
    damaged[20] ^= 1
    path.write_bytes(damaged)
    with path.open("rb") as stream, pytest.raises(Exception):
        token_files.Reader(stream, path.stat().st_size).document(0)


def test_hot_ids_fill_several_files(spark, docs_of):
    rows = [(7, f"text {k} " * 40) for k in range(400)] + [(None, f"other {k} " * 40) for k in range(400)] + [(9, "end")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        manifest = token_files.write(docs_of(rows), WORD, end_id=1)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert manifest.count() > 3 and manifest.agg({"n_docs": "max"}).first()[0] < 400
    found = token_files.fetch(manifest, docs_of([(7, ""), (9, ""), (None, ""), (8, "")])).collect()
    assert sorted(r.doc_id for r in found) == [7] * 400 + [9]
    plain = Tokenizer.from_file(WORD)
    expected = sorted(plain.encode(text, add_special_tokens=False).ids + [1] for d, text in rows if d == 7)
    assert sorted(np.frombuffer(r.ids, "<u4").tolist() for r in found if r.doc_id == 7) == expected


def test_token_query_and_empty_table(spark, small, docs_of):
    rows = queries.queries()["op2_token_output"](spark, small).orderBy("doc_id").collect()
    assert [r.start for r in rows] == [0, *np.cumsum([r.n_tokens for r in rows])[:-1]]
    plain = Tokenizer.from_file(WORD)
    expected = []
    for doc in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").collect():
        ids = np.array(plain.encode(doc.text or "", add_special_tokens=False).ids + [1], "<u4")
        expected.append((doc.doc_id, len(ids), zlib.crc32(ids.tobytes())))
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in rows] == expected
    empty = token_files.write(docs_of([(1, "x")]).limit(0), WORD, end_id=1)
    assert token_files.read(empty).count() == 0

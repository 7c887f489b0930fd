"""Encoding of texts by a file of the tokenizers library, with repeated words encoded once.

A byte-pair tokenizer works piece by piece. Where its file guarantees that no piece reaches over a
given white space, a text can be cut there, each different cut encoded once and the ids joined.
Texts whose white space gives no such guarantee, and tokenizers of other kinds, are encoded whole;
the ids are those of the tokenizer in every case.

Arrow splits a block of texts and numbers its different cuts; Python meets each of them once, and
the ids of the block are one gather by those numbers.
"""

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

# Words in each of the two generations that a worker process remembers, and the longest that it
# does. What is met again comes over from the older generation.
MEMO_ENTRIES = 400_000
MEMO_CHARS = 64
# Bytes of text that are encoded at once; a longer text by itself.
BLOCK = 4 << 20
# New words that are encoded as one text.
JOINED = 1000

# The pieces of the word tokenizer, none of which holds white space.
WORD_PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
# Byte-level pieces take one space before a word with them. Runs of three, or of two at the end,
# and white space of other kinds make pieces that no single cut makes.
_UNCUT = (
    r"[\t\x0b\x0c\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
    r"|[ \n]{3}|[ \n]{2}\z"
)
# A cut that is one word and the punctuation after it has one or two pieces.
_PARTS = r"^(?P<word>\pL+)(?P<after>[!-/:-@\[-`{-~]*)$"
# Before a cut that nothing precedes; no other cut begins with it.
_MARK = "\r"

# What the byte-level vocabulary writes for a space, and what ends a word there in
# the other kind.
_SPACE = "\u0120"
_WORD_END = "</w>"
_encoders: dict[str, "Encoder"] = {}


def encoder(path: str) -> "Encoder":
    """The encoder of a tokenizer file; a worker process keeps it."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def with_end(ids: np.ndarray, lengths: np.ndarray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids of texts, each with an end id behind it, and their lengths with that id."""
    lengths = lengths + 1
    out = np.full(len(ids) + len(lengths), end_id, "<u4")
    inside = np.ones(len(out), bool)
    inside[np.cumsum(lengths) - 1] = False
    out[inside] = ids
    return out, lengths


def _gather(flat: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Stretches of an array, one behind the other."""
    before = np.cumsum(lengths) - lengths
    return flat[np.repeat(starts - before, lengths) + np.arange(lengths.sum())]


def _listed(texts: pa.Array) -> list[str]:
    return texts.to_numpy(zero_copy_only=False).tolist()


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of runs of so many values each."""
    total = np.append(0, np.cumsum(values))
    stops = np.cumsum(counts)
    return total[stops] - total[stops - counts]


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Ids of words, and of the punctuation behind a word.
        self.words: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.after: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.starts = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends = self.starts.copy()
        for token, place in vocabulary.items():
            self.starts[place] = token.startswith(_SPACE)
            self.ends[place] = token.endswith(_WORD_END)
        self.cuts, self.spaced = self._rule(json.loads(self.tokenizer.to_str()))

    def _rule(self, config: dict) -> tuple[bool, bool]:
        """Whether texts can be cut at spaces, and whether a cut stands for the space before it too."""
        before = config["pre_tokenizer"] or {}
        if before.get("type") == "ByteLevel" and not config["normalizer"]:
            if before["use_regex"] and not before["add_prefix_space"]:
                return True, True
        if before.get("type") == "Sequence":
            split = before["pretokenizers"][0]
            pieces = split.get("type") == "Split" and split["pattern"].get("Regex") == WORD_PIECES
            kinds = {n["type"] for n in (config["normalizer"] or {}).get("normalizers", [])}
            if pieces and split["invert"] and kinds <= {"NFC", "Lowercase", "Replace"}:
                return True, False
        return False, False

    def _whole(self, cut: str) -> str:
        """The text that a cut stands for."""
        if cut[:1] == _MARK:
            return cut[1:]
        return " " + cut if self.spaced and cut[:1] != "\n" else cut

    def _ids(self, texts: list[str]) -> list[bytes]:
        encoded = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(e.ids, "<u4").tobytes() for e in encoded]

    def _joined(self, words: list[str]) -> list[bytes]:
        """The ids of words, many of which are encoded as one text. Its ids tell where each begins
        or ends; if they tell of more parts than words, each word is encoded by itself."""
        groups = [words[at : at + JOINED] for at in range(0, len(words), JOINED)]
        texts = [self._whole(" ".join(group)) for group in groups]
        out: list[bytes] = []
        for group, found in zip(groups, self._ids(texts), strict=True):
            ids = np.frombuffer(found, "<u4")
            if self.spaced:
                begins = np.flatnonzero(self.starts[ids])
            else:
                begins = np.append(0, np.flatnonzero(self.ends[ids])[:-1] + 1)
            if len(begins) != len(group):
                out += self._ids([self._whole(word) for word in group])
                continue
            at = [*(4 * begins).tolist(), len(found)]
            out += [found[first:end] for first, end in zip(at, at[1:])]
        return out

    def _word_ids(self, words: list[str]) -> list[bytes]:
        """The ids of different words."""
        found = list(map(self.words.get, words))
        places = [place for place, ids in enumerate(found) if ids is None]
        if len(self.words) + len(places) > MEMO_ENTRIES:
            self.older, self.words = self.words, {}
        older = self.older
        again = [place for place in places if words[place] in older]
        for place in again:
            found[place] = self.words[words[place]] = older[words[place]]
        places = [place for place in places if found[place] is None]
        missing = [words[place] for place in places]
        for place, word, ids in zip(places, missing, self._joined(missing), strict=True):
            found[place] = ids
            if len(word) <= MEMO_CHARS:
                self.words[word] = ids
        return found

    def _strange(self, words: list[str], trailed: np.ndarray) -> np.ndarray:
        """Which words with something after them are not letters only in their normal form, so that
        something of them might join what follows."""
        strange = np.zeros(len(words), bool)
        normalizer = self.tokenizer.normalizer
        if normalizer is not None:
            for place in np.flatnonzero(trailed).tolist():
                word = words[place]
                strange[place] = not word.isascii() and not normalizer.normalize_str(word).isalpha()
        return strange

    def encode(self, texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The ids of texts, block by block: those of all texts of a block, and how many each has.

        A null text is empty.
        """
        if isinstance(texts, pa.ChunkedArray):
            texts = texts.combine_chunks()
        texts = texts.fill_null("")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        first = 0
        while first < len(texts):
            size = ends[first - 1] if first else 0
            last = max(first + 1, int(np.searchsorted(ends, size + BLOCK, "right")))
            yield self._block(texts.slice(first, last - first))
            first = last

    def _block(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        if not self.cuts:
            return self._uncut(texts)
        if not self.spaced:
            return self._cut(pc.replace_substring(texts, "\n", " "))
        hard = pc.match_substring_regex(texts, _UNCUT)
        marked = pc.binary_join_element_wise(_MARK, pc.replace_substring(texts, "\n", " \n"), "")
        if not hard.true_count:
            return self._cut(marked)
        ids, lengths = self._cut(marked.filter(pc.invert(hard)))
        others, sizes = self._uncut(texts.filter(hard))
        rows = np.argsort(hard.to_numpy(zero_copy_only=False), kind="stable")
        back = np.argsort(rows)
        lengths, ids = np.append(lengths, sizes), np.append(ids, others)
        starts = np.cumsum(lengths) - lengths
        return _gather(ids, starts[back], lengths[back]), lengths[back]

    def _uncut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        found = self._ids(texts.to_pylist())
        return np.frombuffer(b"".join(found), "<u4"), np.array([len(f) // 4 for f in found], np.int64)

    def _cut(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        lists = pc.split_pattern(texts, " ")
        counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = lists.flatten().dictionary_encode()
        codes, cuts = coded.indices.to_numpy(), coded.dictionary
        parts = pc.extract_regex(cuts, _PARTS)
        parted = parts.is_valid().to_numpy(zero_copy_only=False)
        words = pc.struct_field(parts, "word").dictionary_encode()
        after = pc.struct_field(parts, "after").dictionary_encode()
        word_of = words.indices.fill_null(0).to_numpy().astype(np.int64)
        after_of = after.indices.fill_null(0).to_numpy().astype(np.int64)
        word_list, after_list = _listed(words.dictionary), _listed(after.dictionary)
        # Strange words are encoded together with what is after them.
        marked = parted & np.array([bool(mark) for mark in [*after_list, ""]])[after_of]
        trailed = np.zeros(len(word_list), bool)
        trailed[word_of[marked]] = True
        strange = self._strange(word_list, trailed)
        if strange.any():
            parted &= ~(strange[word_of] & marked)
        for mark in after_list:
            if mark not in self.after:
                self.after[mark] = self._ids([mark])[0]
        rest = _listed(cuts.filter(pa.array(~parted)))
        found = self._word_ids(word_list) + [self.after[mark] for mark in after_list]
        found += self._ids([self._whole(cut) for cut in rest])
        if len(self.after) > MEMO_ENTRIES:
            self.after = {}
        # Each cut is two stretches of the ids found, the second of them empty for what is not parted.
        lengths = np.append(np.fromiter(map(len, found), np.int64, len(found)) // 4, 0)
        starts = np.cumsum(lengths) - lengths
        flat = np.frombuffer(b"".join(found), "<u4")
        pair = np.empty((len(cuts), 2), np.int64)
        pair[parted, 0] = word_of[parted]
        pair[parted, 1] = len(word_list) + after_of[parted]
        pair[~parted, 0] = len(word_list) + len(after_list) + np.arange(len(rest))
        pair[~parted, 1] = len(found)
        # The ids of each different cut in one stretch, then those of all cuts.
        both = lengths[pair]
        joined = _gather(flat, starts[pair].ravel(), both.ravel())
        sizes = both.sum(axis=1)
        places = np.cumsum(sizes) - sizes
        per_cut = sizes[codes]
        return _gather(joined, places[codes], per_cut), _sums(per_cut, counts)

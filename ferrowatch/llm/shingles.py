"""Hashes of word shingles, for many texts at once.

A word's hash is a polynomial in its bytes modulo 2^64, taken as the difference of two prefix sums
and then mixed, so that a block of text costs a few passes over its bytes whatever its words are.
Sets of shingles are sets of these 64-bit hashes; words that collide modulo 2^64 can be made on purpose,
from a thousand bytes or more, and are not expected otherwise.
"""

from collections.abc import Iterator

import numpy as np

# Bytes that are hashed at once; a longer text is cut between words.
BLOCK = 1 << 20
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[ord("A") : ord("Z") + 1] += 32

_powers: list[np.ndarray] = []


def _power_tables(length: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least so many."""
    if not _powers or len(_powers[0]) < length:
        size = max(length, BLOCK + (BLOCK >> 2))
        inverse = pow(_BASE, -1, 1 << 64)
        _powers.clear()
        for base in (_BASE, inverse):
            factors = np.full(size, base, np.uint64)
            factors[0] = 1
            _powers.append(np.multiply.accumulate(factors))
    return _powers[0], _powers[1]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers in which every bit of the input counts."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _words(text: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each word, A-Z as a-z, and where it starts."""
    raw = np.frombuffer(text, np.uint8)
    space = _SPACE[raw]
    edges = np.flatnonzero(np.diff(space, prepend=True, append=True))
    starts, ends = edges[::2], edges[1::2]
    up, down = _power_tables(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((_LOWER[raw] + np.uint64(1)) * up[: len(raw)], out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    return mixed(hashes + (ends - starts).astype(np.uint64)), starts


def _parts(text: bytes) -> Iterator[bytes]:
    """A long text in parts that end between words; a longer word stays whole."""
    at = 0
    while len(text) - at > BLOCK:
        cut = at + BLOCK
        while cut < len(text) and not _SPACE[text[cut]]:
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:]


def _joined(hashes: np.ndarray, width: int) -> np.ndarray:
    """The hash of each run of `width` words."""
    count = len(hashes) - width + 1
    run = hashes[:count]
    for k in range(1, width):
        run = mixed(run * np.uint64(0xD6E8FEB86659FD93) + hashes[k : k + count])
    return run


def shingle_sets(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    """The sorted, distinct hashes of each text's shingles.

    A text with fewer words than a shingle has its whole sequence as one; without words it has none.
    """
    first, size = 0, 0
    for place, text in enumerate(texts):
        if size and size + len(text) > BLOCK:
            yield from _block(texts[first:place], width)
            first, size = place, 0
        size += len(text) + 1
    yield from _block(texts[first:], width)


def _block(texts: list[bytes], width: int) -> Iterator[np.ndarray]:
    if len(texts) == 1:
        words = np.concatenate([_words(part)[0] for part in _parts(texts[0])])
        bounds = np.array([0, len(words)])
    else:
        words, starts = _words(b" ".join(texts))
        lengths = np.array([len(text) + 1 for text in texts])
        bounds = np.searchsorted(starts, np.concatenate([[0], np.cumsum(lengths)]))
    for begin, end in zip(bounds[:-1], bounds[1:], strict=True):
        own = words[begin:end]
        yield np.unique(_joined(own, min(width, len(own)))) if len(own) else own

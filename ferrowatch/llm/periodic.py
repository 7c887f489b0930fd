"""Detection of periodic runs of words, with exact borders.

A run of period q is a stretch of words in which words q apart are identical, at least three
periods and a least number of words long, that no neighbouring word extends. Words q apart are then
identical at 2q consecutive places or more, so a grid of that width, different for each period,
meets every run: over all periods the grids are a harmonic sum. Of the grid points few pass a test
of some places before or behind them; the others' exact extensions are answered by a grammar of the
texts' words (see grammar). A period that is a multiple of a run's own gives the same stretch, so the
least period found for a stretch is its own.

Documents are handled in Arrow batches where they are; nothing is shuffled. One document's words
are in one task's memory at a time, in arrays of a few dozen bytes a word.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrowatch.llm.common import quoted, without
from ferrowatch.llm.grammar import Grammar

LEAST_WORDS = 24
LEAST_PERIODS = 3
# Words that are handled at once, a longer text by itself, and grid points that are.
BLOCK_WORDS = 1 << 18
GRID = 1 << 20
RUNS = "array<struct<start: long, length: long, period: long>>"
OUTPUT = ("n_words", "runs", "collapsed")


def split_words(texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The words of all texts and how many each text has: what is between ASCII white space."""
    for other in "\t\n\x0b\x0c\r":
        texts = pc.replace_substring(texts, other, " ")
    lists = pc.split_pattern(texts, " ")
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    words = lists.flatten()
    real = pc.not_equal(words, "")
    if real.false_count:
        total = np.append(0, np.cumsum(real.to_numpy(zero_copy_only=False)))
        stops = np.cumsum(sizes)
        sizes = total[stops] - total[stops - sizes]
        words = words.filter(real)
    return words.dictionary_encode(), sizes


def _grid(starts: np.ndarray, sizes: np.ndarray, low: int, high: int, least: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(place, period, half) of the grids of periods from low to below high, in blocks.

    half is how far the places that are alike reach before or behind a point at least.
    """
    periods = np.arange(low, high)
    need = np.maximum(least, LEAST_PERIODS * periods)
    width = need - periods
    long = np.flatnonzero(sizes >= need[0])
    # Rows of (document, period) in runs that hold a bounded number of points.
    fits = np.minimum(sizes[long] // LEAST_PERIODS, high - 1) - low + 1
    doc = np.repeat(long, fits)
    which = np.arange(len(doc)) - np.repeat(np.cumsum(fits) - fits, fits)
    points = -(-(sizes[doc] - periods[which]) // width[which])
    ends = np.cumsum(points)
    first = 0
    while first < len(doc):
        before = ends[first - 1] if first else 0
        last = max(first + 1, int(np.searchsorted(ends, before + GRID, "right")))
        many = points[first:last]
        row = np.repeat(np.arange(first, last), many)
        number = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
        kind = which[row]
        yield starts[doc[row]] + number * width[kind], periods[kind], (width[kind] - 1) // 2
        first = last


def _alike(words: np.ndarray, place: np.ndarray, period: np.ndarray, half: np.ndarray) -> np.ndarray:
    """Which points can lie in a run: alike there, and at all places tried before or behind it."""
    points = np.flatnonzero(words[place] == words[place + period])
    sides = []
    for sign in (1, -1):
        left = points
        reach = 1
        while len(left):
            asks = half[left] >= reach
            if not asks.any():
                break
            # Beyond the words of the block nothing is alike; sentinels end each text inside it.
            at = place[left] + sign * reach
            inside = (at >= 0) & (at + period[left] < len(words))
            at = np.where(inside, at, 0)
            same = inside & (words[at] == words[np.minimum(at + period[left], len(words) - 1)])
            left = left[~asks | same]
            reach = reach + max(1, reach // 2)
        sides.append(left)
    return np.union1d(*sides)


def find_runs(codes: np.ndarray, sizes: np.ndarray, least: int = LEAST_WORDS) -> np.ndarray:
    """Rows of (document, start, length, period): all runs of each text, in this order.

    codes: the words of all texts as numbers from 0 on; sizes: how many words each has.
    """
    n = len(sizes)
    none = np.zeros((0, 4), np.int64)
    if not n or sizes.max(initial=0) < least:
        return none
    # Each text is between marks of its own.
    stops = np.cumsum(sizes)
    starts = 1 + stops - sizes + np.arange(n)
    doc = np.repeat(np.arange(n), sizes)
    words = np.empty(len(codes) + n + 1, np.int64)
    words[starts[doc] + np.arange(len(codes)) - (stops - sizes)[doc]] = codes
    words[0] = -1
    words[starts + sizes] = -2 - np.arange(n)
    octaves = []
    low = 1
    while max(least, LEAST_PERIODS * low) <= sizes.max():
        found = []
        for place, period, half in _grid(starts, sizes, low, 2 * low, least):
            own = _alike(words, place, period, half)
            found.append((place[own], period[own]))
        octaves.append([np.concatenate(part) for part in zip(*found)] if found else [none[:, 0]] * 2)
        low *= 2
    hit = np.concatenate([place for place, _ in octaves])
    if not len(hit):
        return none
    # Only texts with a point left need a grammar.
    chosen = np.unique(np.searchsorted(starts, hit, "right") - 1)
    keep = np.zeros(len(words), bool)
    keep[0] = True
    extent = sizes[chosen] + 1
    first = np.cumsum(extent) - extent
    keep[np.repeat(starts[chosen] - first, extent) + np.arange(extent.sum())] = True
    moved = np.cumsum(keep) - 1
    grammar = Grammar(words[keep])
    begins = moved[starts[chosen]]
    # The run that was last found over each place: a multiple of its period gives the same run.
    over = np.full((int(keep.sum()), 2), 0, np.int64)
    runs: list[np.ndarray] = [none]
    for place, period in octaves:
        place = moved[place]
        known, end = over[place, 0], over[place, 1]
        again = (known > 0) & (place + period < end) & (period % np.maximum(known, 1) == 0)
        place, period = place[~again], period[~again]
        for at in range(0, len(place), GRID):
            x, p = place[at : at + GRID], period[at : at + GRID]
            ahead = grammar.extend(x, x + p, forward=True)
            behind = grammar.extend(x, x + p, forward=False)
            start, length = x - behind, p + ahead + behind
            whole = length >= np.maximum(least, LEAST_PERIODS * p)
            rows = np.unique(np.column_stack([start, length, p])[whole], axis=0)
            if not len(rows):
                continue
            runs.append(np.column_stack([np.zeros(len(rows), np.int64), rows]))
            for begin, size, own in rows[np.argsort(rows[:, 1])]:
                over[begin : begin + size] = own, begin + size
    found = np.concatenate(runs)[:, 1:]
    # The least period of each stretch.
    found = found[np.lexsort((found[:, 2], found[:, 1], found[:, 0]))]
    same = (found[1:, :2] == found[:-1, :2]).all(axis=1)
    found = found[np.append(True, ~same)] if len(found) else found
    text = np.searchsorted(begins, found[:, 0], "right") - 1
    out = np.column_stack([chosen[text], found[:, 0] - begins[text], found[:, 1], found[:, 2]])
    return out[np.lexsort((out[:, 3], out[:, 1], out[:, 0]))]


def _handled(texts: pa.Array, least: int) -> list[pa.Array]:
    """(n_words, runs, collapsed) of a block of texts."""
    words, sizes = split_words(texts)
    codes = words.indices.to_numpy().astype(np.int64)
    runs = find_runs(codes, sizes, least)
    firsts = np.cumsum(sizes) - sizes
    # A word is repeated if some run holds it after its first period.
    edges = np.zeros(len(codes) + 1, np.int64)
    begin = firsts[runs[:, 0]] + runs[:, 1]
    np.add.at(edges, begin + runs[:, 3], 1)
    np.add.at(edges, begin + runs[:, 2], -1)
    kept = np.cumsum(edges)[:-1] == 0
    total = np.append(0, np.cumsum(kept))
    offsets = np.append(0, total[firsts + sizes])
    if len(codes):
        spelled = words.dictionary.take(pa.array(codes[kept]))
    else:
        spelled = pa.array([], pa.string())
    lists = pa.LargeListArray.from_arrays(pa.array(offsets), spelled)
    number = np.bincount(runs[:, 0], minlength=len(sizes))
    fields = pa.StructArray.from_arrays(
        [pa.array(runs[:, 1]), pa.array(runs[:, 2]), pa.array(runs[:, 3])], ["start", "length", "period"]
    )
    listed = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(number)), pa.int32()), fields)
    return [pa.array(sizes), listed, pc.binary_join(lists, " ").cast(pa.string())]


def collapse_runs(docs: DataFrame, *, text: str = "text", least: int = LEAST_WORDS) -> DataFrame:
    """Add n_words, runs and collapsed: the text's words without the repeats of its runs.

    Words are what stands between ASCII white space, numbered from 0. runs is an array of
    (start, length, period), by start, then period; a run is at least `least` words and three
    periods long. collapsed joins by one space the words that no run holds after its first period.
    A null text and one without words have no runs and collapse to the empty text. Only the text is
    read; columns of the input with these names are replaced; rows are neither added nor lost.
    """
    docs = without(docs, OUTPUT)
    added = T.StructType.fromDDL(f"n_words long, runs {RUNS}, collapsed string")
    schema = T.StructType([*docs.schema.fields, *added.fields])
    place = docs.columns.index(next(c for c in docs.columns if c.lower() == text.lower()))

    def handled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).cast(pa.string()).fill_null("")
            ends = np.cumsum(pc.count_substring(texts, " ").to_numpy(zero_copy_only=False) + 1, dtype=np.int64)
            first = 0
            while first < len(texts):
                before = ends[first - 1] if first else 0
                last = max(first + 1, int(np.searchsorted(ends, before + BLOCK_WORDS, "right")))
                columns = _handled(texts.slice(first, last - first), least)
                own = batch.slice(first, last - first).columns
                yield pa.RecordBatch.from_arrays([*own, *columns], names=[*batch.schema.names, *OUTPUT])
                first = last

    return docs.select(*[F.col(quoted(c)) for c in docs.columns]).mapInArrow(handled, schema)

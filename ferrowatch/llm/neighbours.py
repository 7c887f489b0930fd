"""Approximate nearest neighbours by inner product, over low-dimensional stable projections.

A vector gets one more coordinate that brings all to the same norm, so that the largest inner
products are the smallest Euclidean distances. Gaussian (2-stable) projections to a few dimensions
keep distances in distribution: the squared projected distance over the squared distance is
chi-square. The projections are indexed by a kd-tree whose upper levels, fitted on a bounded sample,
deal all vectors into cells and whose lower levels are built inside each block of a cell. A query
takes projected neighbours leaf by leaf, nearest first, and verifies them on the original vectors;
it stops when a closer vector would, with the chosen probability, have been projected closer than
the next leaf.

A first pass searches each query's nearest cells; its k-th distance then rules out most others.
Cells are cut into blocks of bounded size, and so are the queries by their own cells, so that those of
a block go to much the same cells. The vectors of a block are copied once for each block of queries of which
some visits it, and each such pair is one call. Equal vectors are one point with its smallest ids,
which are all that can appear in a result; equal scores of different points go by their smallest ids.
"""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrowatch.llm.common import quoted
from ferrowatch.sources.staging import stage

DIMENSIONS = 8
CONFIDENCE = 0.97
# Vectors that the upper tree is fitted on, the most cells it has, and the rows of a block.
SAMPLE_ROWS = 64_000
MAX_CELLS = 4096
BLOCK_ROWS = 8192
QUERY_ROWS = 1024
LEAF_ROWS = 128
NEAREST_CELLS = 2
# Distances of queries to cells that are held at once.
BOUNDS = 1 << 20


def chi_square_cdf(x: np.ndarray, freedom: int = DIMENSIONS) -> np.ndarray:
    """For an even number of degrees of freedom."""
    half = np.minimum(np.asarray(x, float) / 2, 700.0)
    terms = sum(half**i / math.factorial(i) for i in range(freedom // 2))
    return 1 - np.exp(-half) * terms


class Projection:
    def __init__(self, dims: int, top: float) -> None:
        self.top = top
        self.matrix = np.random.default_rng(7).standard_normal((dims + 1, DIMENSIONS))

    def points(self, vectors: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.top - (vectors**2).sum(1), 0.0))
        return vectors @ self.matrix[:-1] + rest[:, None] * self.matrix[-1]

    def queries(self, vectors: np.ndarray) -> np.ndarray:
        return vectors @ self.matrix[:-1]


def split(points: np.ndarray, rows: int) -> list[np.ndarray]:
    """The leaves of a kd-tree, cut at medians of the widest dimension down to so many rows."""
    leaves, open_nodes = [], [np.arange(len(points))]
    while open_nodes:
        own = open_nodes.pop()
        spread = np.ptp(points[own], axis=0) if len(own) else np.zeros(1)
        if len(own) <= rows or spread.max() == 0:
            leaves.append(own)
            continue
        order = own[np.argsort(points[own, spread.argmax()], kind="stable")]
        open_nodes += [order[: len(order) // 2], order[len(order) // 2 :]]
    return leaves


class UpperTree:
    """Splits of the sample; every point falls into one cell."""

    def __init__(self, sample: np.ndarray, cells: int) -> None:
        self.nodes: list[tuple[int, float, int, int]] = []
        self.cells = 0
        self._grow(sample, cells)

    def _grow(self, points: np.ndarray, cells: int) -> int:
        place = len(self.nodes)
        self.nodes.append((-1, 0.0, self.cells, 0))
        spread = np.ptp(points, axis=0) if len(points) else np.zeros(1)
        if cells < 2 or len(points) < 2 or spread.max() == 0:
            self.cells += 1
            return place
        axis = int(spread.argmax())
        at = float(np.median(points[:, axis]))
        low = points[:, axis] <= at
        if low.all():
            low = points[:, axis] < at
            at = float(np.nextafter(at, -np.inf))
        left = self._grow(points[low], cells // 2)
        right = self._grow(points[~low], cells - cells // 2)
        self.nodes[place] = (axis, at, left, right)
        return place

    def cell(self, points: np.ndarray) -> np.ndarray:
        out = np.empty(len(points), np.int32)
        todo = [(0, np.arange(len(points)))]
        while todo:
            node, own = todo.pop()
            axis, at, left, right = self.nodes[node]
            if axis < 0:
                out[own] = left
                continue
            low = points[own, axis] <= at
            todo += [(left, own[low]), (right, own[~low])]
        return out


def _bounds(queries: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared distance of each query to each box."""
    total = np.zeros((len(queries), len(low)))
    for d in range(queries.shape[1]):
        own = queries[:, d, None]
        total += (np.maximum(low[None, :, d] - own, 0) + np.maximum(own - high[None, :, d], 0)) ** 2
    return total


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 1)


def _settled(bound: np.ndarray, kth: np.ndarray, confidence: float) -> np.ndarray:
    """Whether what lies beyond the projected bound may be left; never at a confidence of 1."""
    if confidence >= 1:
        return np.zeros(np.broadcast(bound, kth).shape, bool)
    ratio = np.divide(bound, kth, out=np.full(np.broadcast(bound, kth).shape, np.inf), where=kth > 0)
    return (chi_square_cdf(ratio) >= confidence) & np.isfinite(kth)


def _search(
    vectors: np.ndarray, asked: np.ndarray, kth: np.ndarray,
    projection: Projection, keep: int, confidence: float,
) -> tuple[np.ndarray, np.ndarray]:
    """The best inner products and their rows for each query among these vectors; -inf where too few.

    Of equal ones the first rows win.
    """
    points, queries = projection.points(vectors), projection.queries(asked)
    leaves = split(points, LEAF_ROWS)
    low = np.array([points[leaf].min(0) for leaf in leaves])
    high = np.array([points[leaf].max(0) for leaf in leaves])
    bounds = _bounds(queries, low, high)
    order = np.argsort(bounds, axis=1)
    level = projection.top + (asked**2).sum(1)
    best = np.full((len(asked), keep), -np.inf)
    who = np.full((len(asked), keep), -1, np.int64)
    kth = kth.copy()
    for step in range(len(leaves)):
        near = order[:, step]
        bound = bounds[np.arange(len(asked)), near]
        active = np.flatnonzero(~_settled(bound, kth, confidence))
        if not len(active):
            break
        for leaf in np.unique(near[active]):
            rows = active[near[active] == leaf]
            scores = asked[rows] @ vectors[leaves[leaf]].T
            pool = np.concatenate([best[rows], scores], axis=1)
            names = np.concatenate([who[rows], np.broadcast_to(leaves[leaf], scores.shape)], axis=1)
            top = np.lexsort((names, -pool), axis=1)[:, :keep]
            best[rows] = np.take_along_axis(pool, top, 1)
            who[rows] = np.take_along_axis(names, top, 1)
        kth = np.minimum(kth, np.maximum(level - 2 * best[:, -1], 0.0))
    return best, who


def nearest(
    table: DataFrame,
    is_query: Column,
    *,
    k: int = 20,
    vec_id: str = "vec_id",
    vector: str = "embedding",
    confidence: float = CONFIDENCE,
) -> DataFrame:
    """(query_id, rank, vec_id, score): the k nearest found of each query row, its own id apart.

    Nearness is the largest inner product, in double precision; of those found ties go to the smaller
    id. At a confidence of 1 nothing that could be nearer or as near is left out. Ids are integers, or
    are cast to long: others are an error. Components whose squares overflow are not finite. Vectors
    that are null, zero, hold null or non-finite numbers, or are not of the most common length
    (the longer of equally common ones) take no part, nor do rows with a null id. A query has as
    many neighbours as there are candidates, if fewer than k. Repeated rows are one; rows that
    repeat an id with another vector are queries and candidates of their own. Other columns are
    not read; an empty table has no result.
    """
    spark = table.sparkSession
    rows = table.select(
        F.col(quoted(vec_id)).cast("long").alias("id"),
        F.col(quoted(vector)).cast("array<double>").alias("v"),
        F.coalesce(is_query, F.lit(False)).alias("asks"),
    )
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("id").isNotNull() & F.col("v").isNotNull() & finite)
    rows = rows.where(F.exists("v", lambda x: x != 0))
    shape = rows.groupBy(F.size("v").alias("dims")).agg(F.count("*").alias("n"))
    shape = shape.orderBy(F.desc("n"), F.desc("dims")).first()
    nothing = spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if shape is None:
        return nothing
    rows = stage(rows.where(F.size("v") == shape["dims"]).distinct(), "ann_rows")
    square = F.aggregate("v", F.lit(0.0), lambda total, x: total + x * x)
    top = rows.agg(F.max(square)).first()[0] * (1 + 1e-9)
    projection = Projection(shape["dims"], top)
    shared = spark.sparkContext.broadcast(projection)

    # Equal vectors are one point, named by its smallest id; only so many ids can be in a result.
    keep = k + 1
    smallest = F.row_number().over(Window.partitionBy("v").orderBy("id"))
    few = rows.withColumn("place", smallest).where(F.col("place") <= keep)
    points = few.groupBy("v").agg(F.sort_array(F.collect_list("id")).alias("ids"))

    @F.arrow_udf("array<double>")
    def project(vectors: pa.Array) -> pa.Array:
        found = shared.value.points(_matrix(vectors))
        offsets = pa.array(np.arange(len(found) + 1) * DIMENSIONS, pa.int32())
        return pa.ListArray.from_arrays(offsets, pa.array(found.ravel()))

    points = points.withColumn("key", F.monotonically_increasing_id()).withColumn("p", project("v"))
    points = stage(points, "ann_points")
    n = points.count()
    share = F.pmod(F.xxhash64("v"), F.lit(2**40)) < int(min(1.0, SAMPLE_ROWS / n) * 2**40)
    sample = points.where(share).limit(2 * SAMPLE_ROWS).select("p").toArrow()
    tree = UpperTree(_matrix(sample.column("p")), min(MAX_CELLS, max(1, n // (BLOCK_ROWS // 2))))
    upper = spark.sparkContext.broadcast(tree)

    @F.arrow_udf("int")
    def cell_of(found: pa.Array) -> pa.Array:
        return pa.array(upper.value.cell(_matrix(found)))

    points = stage(points.withColumn("cell", cell_of("p")), "ann_cells")
    edges = [f(F.col("p")[d]).alias(f"{f.__name__}{d}") for f in (F.min, F.max) for d in range(DIMENSIONS)]
    # One row per cell, at most MAX_CELLS.
    boxes = points.groupBy("cell").agg(F.count("*").alias("n"), *edges).orderBy("cell").collect()
    numbers = np.array([box["cell"] for box in boxes])
    low = np.array([[box[f"min{d}"] for d in range(DIMENSIONS)] for box in boxes])
    high = np.array([[box[f"max{d}"] for d in range(DIMENSIONS)] for box in boxes])
    parts = {int(box["cell"]): -(-box["n"] // BLOCK_ROWS) for box in boxes}
    layout = spark.sparkContext.broadcast((numbers, low, high))
    cells = spark.createDataFrame(list(parts.items()), "cell int, parts int")

    asked = rows.where("asks").select("id", "v").join(points.select("v", "key").hint("merge"), "v")
    asked = stage(asked.select(F.col("id").alias("query_id"), F.col("key").alias("query")), "ann_asked")
    queries = points.join(asked.select(F.col("query").alias("key")).distinct().hint("merge"), "key", "left_semi")
    # Queries are dealt by their own cell; cells come in the order of the tree, so those that are close
    # share a block where they have few queries. One row per cell, at most MAX_CELLS.
    homes, home, filled = [], 0, 0
    for cell, asking in sorted(tuple(r) for r in queries.groupBy("cell").count().collect()):
        if filled and filled + asking > QUERY_ROWS:
            home, filled = home + 1, 0
        homes.append((cell, home, -(-asking // QUERY_ROWS)))
        filled += asking
    homes = spark.createDataFrame(homes, "cell int, home int, shares int")
    queries = queries.join(F.broadcast(homes), "cell")
    share = F.pmod(F.xxhash64("key"), F.col("shares")).cast("int")
    queries = queries.select(F.col("key").alias("query"), F.col("v").alias("q"), "home", share.alias("share"))
    queries = stage(queries, "ann_queries")

    def visits(which) -> Column:
        """The cells that a query goes to, by its vector and its k-th distance so far."""

        @F.arrow_udf("array<int>")
        def chosen(vectors: pa.Array, kths: pa.Array) -> pa.Array:
            names, lows, highs = layout.value
            asking, kth = shared.value.queries(_matrix(vectors)), kths.to_numpy(zero_copy_only=False)[:, None]
            chosen_cells = []
            size = max(1, BOUNDS // len(names))
            for at in range(0, len(asking), size):
                bounds = _bounds(asking[at : at + size], lows, highs)
                first = np.zeros(bounds.shape, bool)
                np.put_along_axis(first, np.argsort(bounds, axis=1)[:, :NEAREST_CELLS], True, axis=1)
                rest = ~first & ~_settled(bounds, kth[at : at + size], confidence)
                chosen_cells += [names[row].tolist() for row in (first if which == "first" else rest)]
            return pa.array(chosen_cells, pa.list_(pa.int32()))

        return chosen("q", "kth")

    def search(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        kinds = {"query": pa.int64(), "key": pa.int64(), "first_id": pa.int64(), "score": pa.float64()}
        if not mine.num_rows or not theirs.num_rows:
            return pa.table({name: pa.array([], kind) for name, kind in kinds.items()})
        theirs = theirs.sort_by("FIRST_ID")
        best, who = _search(
            _matrix(theirs.column("V")),
            _matrix(mine.column("q")),
            mine.column("kth").to_numpy(),
            shared.value,
            keep,
            confidence,
        )
        real = np.isfinite(best)
        names = np.broadcast_to(mine.column("query").to_numpy()[:, None], best.shape)
        keys, firsts = theirs.column("KEY").to_numpy(), theirs.column("FIRST_ID").to_numpy()
        columns = (names[real], keys[who[real]], firsts[who[real]], best[real])
        return pa.table({name: pa.array(c, kind) for c, (name, kind) in zip(columns, kinds.items(), strict=True)})

    dealt = points.join(F.broadcast(cells), "cell").select(
        F.col("cell").alias("CELL"),
        F.pmod(F.xxhash64("key"), F.col("parts")).cast("int").alias("PART"),
        F.col("key").alias("KEY"),
        F.col("ids")[0].alias("FIRST_ID"),
        F.col("v").alias("V"),
    )

    def searched(goers: DataFrame, which: str) -> DataFrame:
        """The best of each query in each block it goes to."""
        going = goers.withColumn("cell", F.explode(visits(which))).join(F.broadcast(cells), "cell")
        every = F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")
        left = going.select("cell", "home", "share", "query", "q", "kth", every)
        # Which blocks of queries visit a cell at all: its vectors go to these only.
        visitors = going.select(F.col("cell").alias("CELL"), F.col("home").alias("HOME"), F.col("share").alias("SHARE"))
        held = dealt.join(visitors.distinct(), "CELL")
        names = ["cell", "part", "home", "share"]
        pairs = left.groupBy(*names).cogroup(held.groupBy(*[name.upper() for name in names]))
        return pairs.applyInArrow(search, "query long, key long, first_id long, score double")

    def best_of(found: DataFrame) -> DataFrame:
        place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "first_id"))
        return found.withColumn("place", place).where(F.col("place") <= keep).drop("place")

    start = queries.withColumn("kth", F.lit(float("inf")))
    first = stage(searched(start, "first"), "ann_first")
    level = F.lit(top) + F.aggregate("q", F.lit(0.0), lambda total, x: total + x * x)
    kth = best_of(first).groupBy("query").agg(F.min("score").alias("worst"), F.count("*").alias("n"))
    known = queries.join(kth.hint("merge"), "query", "left")
    bound = F.when(F.col("n") >= keep, F.greatest(level - 2 * F.col("worst"), F.lit(0.0)))
    known = known.select("query", "q", "home", "share", F.coalesce(bound, F.lit(float("inf"))).alias("kth"))
    second = searched(stage(known, "ann_known"), "rest")
    candidates = best_of(first.unionAll(second))
    named = candidates.join(points.select("key", "ids").hint("merge"), "key")
    named = named.select("query", "score", F.explode("ids").alias("vec_id"))
    nearer = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    named = named.withColumn("place", F.row_number().over(nearer)).where(F.col("place") <= keep)
    answers = asked.join(named.drop("place").hint("merge"), "query").where("vec_id <> query_id")
    order = Window.partitionBy("query_id", "query").orderBy(F.desc("score"), "vec_id")
    ranked = answers.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")

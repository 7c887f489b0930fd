"""Near-duplicate detection by min-max hashing.

Each document's set of word shingles is hashed under random permutations, and both the smallest
and the largest value under each are kept: either agrees for two sets with the probability of
their Jaccard similarity, so half as many hash evaluations give a signature of the same length.
Bands of four values, from four permutations, meet in buckets. At a similarity of 0.8 a pair misses
all 32 bands with a probability below 1e-7.

Documents with equal sets are one node. A bucket does not emit its pairs: its members are held
against one pivot, the member that shares its buckets with the most others, on full sets. What
lies in other components than its pivot afterwards is held against the pivot's other members in
blocks that emit links only. So every pair that a bucket brings together is compared or linked by
a path. Components are found by alternating large-star and small-star steps on tables.
"""

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrowatch.llm.common import quoted, spare, whole
from ferrowatch.llm.shingles import mixed, shingle_sets
from ferrowatch.sources.staging import stage

# Unless a caller says otherwise.
WIDTH = 5
THRESHOLD = 80
PERMUTATIONS = 64
BAND = 4
# Sets of pivots that a task keeps while their neighbours pass by.
KEPT_SETS = 64
# Members, and shingles, of a block of a bucket's second comparison.
BLOCK_NODES = 256
BLOCK_SHINGLES = 1_000_000

_generator = np.random.default_rng(20250101)
_FACTORS = _generator.integers(0, 2**63, PERMUTATIONS, np.uint64) * np.uint64(2) + np.uint64(1)
_SHIFTS = _generator.integers(0, 2**63, PERMUTATIONS, np.uint64)


def band_keys(sets: list[np.ndarray]) -> np.ndarray:
    """The bucket of each band, for sets that are not empty: one row per set."""
    joined = np.concatenate(sets)
    starts = np.cumsum([0, *[len(s) for s in sets[:-1]]])
    values = np.empty((2 * PERMUTATIONS, len(sets)), np.uint64)
    half = PERMUTATIONS // 2
    for k in range(PERMUTATIONS):
        permuted = joined * _FACTORS[k] + _SHIFTS[k]
        # Minimum and maximum of one permutation go to different bands.
        values[2 * k] = np.minimum.reduceat(permuted, starts)
        values[2 * ((k + half) % PERMUTATIONS) + 1] = np.maximum.reduceat(permuted, starts)
    bands = values.reshape(-1, BAND, len(sets))
    keys = np.broadcast_to(np.arange(len(bands), dtype=np.uint64)[:, None], bands.shape[::2])
    for row in range(BAND):
        keys = mixed(keys * np.uint64(0xD6E8FEB86659FD93) + bands[:, row])
    return keys.T.astype(np.int64)


def _signatures(docs: DataFrame, width: int) -> DataFrame:
    """(uid, doc_id, n_shingles, node, bands) of (uid, doc_id, body); node is a digest of the set."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("body").to_pylist()
            sizes, nodes, bands, held = [], [], [], []
            step = 400
            for at in range(0, len(texts), step):
                sets = list(shingle_sets(texts[at : at + step], width))
                full = [s for s in sets if len(s)]
                keys = iter(band_keys(full) if full else ())
                for own in sets:
                    sizes.append(len(own))
                    held.append(len(own) > 0)
                    nodes.append(hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None)
                    bands.append(next(keys) if len(own) else None)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("uid"),
                    batch.column("doc_id"),
                    pa.array(sizes, pa.int64()),
                    pa.array(nodes, pa.binary()),
                    pa.array(bands, pa.list_(pa.int64())),
                ],
                names=["uid", "doc_id", "n_shingles", "node", "bands"],
            )

    schema = "uid long, doc_id long, n_shingles long, node binary, bands array<long>"
    return docs.mapInArrow(sign, schema)


def _compared(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(a, b, both, n_a, n_b) of the pairs (a, b): sizes of the full sets and their intersection."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pivots: dict[bytes, np.ndarray] = {}
        for batch in batches:
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            other, rows = batch.column("text_b"), []
            sets = shingle_sets(batch.column("text_a").to_pylist(), width)
            for place, own in enumerate(sets):
                if b[place] not in pivots:
                    if len(pivots) >= KEPT_SETS:
                        pivots.pop(next(iter(pivots)))
                    pivots[b[place]] = next(shingle_sets([other[place].as_py()], width))
                pivot = pivots[b[place]]
                both = len(np.intersect1d(own, pivot, assume_unique=True))
                rows.append((both, len(own), len(pivot)))
            counts = list(zip(*rows, strict=True)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(a, pa.binary()), pa.array(b, pa.binary())]
                + [pa.array(c, pa.int64()) for c in counts],
                names=["a", "b", "both", "n_a", "n_b"],
            )

    first = texts.select(F.col("node").alias("a"), F.col("body").alias("text_a"))
    second = texts.select(F.col("node").alias("b"), F.col("body").alias("text_b"))
    # The smaller side, of one row per node, is the one that is hinted; a pivot's many neighbours
    # are spread by AQE's skew join.
    joined = pairs.join(first.hint("merge"), "a").join(second.hint("merge"), "b")
    schema = "a binary, b binary, both long, n_a long, n_b long"
    return joined.select("a", "b", "text_a", "text_b").mapInArrow(compare, schema)


def _links(compared: DataFrame, threshold: int) -> DataFrame:
    union = F.col("n_a") + F.col("n_b") - F.col("both")
    return compared.where(100 * F.col("both") >= threshold * union).select("a", "b")


def _across(
    beside: DataFrame, groups: DataFrame, texts: DataFrame, width: int, threshold: int
) -> DataFrame:
    """Roots (a, b) of components that are linked by a member of a pivot outside the pivot's component.

    Both sides are dealt into blocks and each pair of blocks is compared in one call, which emits
    a link once for each two components. A row travels once per block
    of the other side, so neither pairs nor whole groups are ever made.
    """
    placed = beside.join(groups.hint("merge"), "node", "left")
    placed = placed.withColumn("root", F.coalesce("root", "node"))
    of_pivot = groups.select(F.col("node").alias("pivot"), F.col("root").alias("pivot_root"))
    placed = placed.join(of_pivot.hint("merge"), "pivot", "left")
    far = F.col("root") != F.coalesce("pivot_root", "pivot")
    placed = stage(placed.select("pivot", "node", "n", "root", far.alias("far")), "near_placed")

    def blocks(count, shingles):
        return F.ceil(count / BLOCK_NODES + shingles / BLOCK_SHINGLES).cast("int")

    dealt = placed.groupBy("pivot").agg(
        blocks(F.count_if("far"), F.sum(F.when(F.col("far"), F.col("n")).otherwise(0))).alias("n_far"),
        blocks(F.count("*"), F.sum("n")).alias("n_all"),
    )
    dealt = stage(dealt.where("n_far > 0"), "near_blocks").hint("merge")
    block = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    left = placed.where("far").join(dealt, "pivot").select(
        "pivot", "node", "root", block("n_far").alias("far_block"), each("n_all").alias("block")
    )
    right = placed.join(dealt, "pivot").select(
        "pivot", "node", "root", each("n_far").alias("far_block"), block("n_all").alias("block")
    )

    def compare(mine: pa.Table, theirs: pa.Table) -> pa.Table:
        if not mine.num_rows or not theirs.num_rows:
            return pa.table({"a": pa.array([], pa.binary()), "b": pa.array([], pa.binary())})
        sets = list(shingle_sets(mine.column("body").to_pylist(), width))
        sizes = np.array([len(s) for s in sets])
        shingles, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), sizes)
        order = np.argsort(shingles, kind="stable")
        shingles, owner = shingles[order], owner[order]
        roots = mine.column("root").to_pylist()
        found: set[tuple[bytes, bytes]] = set()
        others = zip(
            theirs.column("ROOT").to_pylist(),
            shingle_sets(theirs.column("BODY").to_pylist(), width),
            strict=True,
        )
        for root, own in others:
            low = np.searchsorted(shingles, own)
            runs = np.searchsorted(shingles, own, side="right") - low
            # The owners of all shingles that this set shares with the block.
            at = np.repeat(low - np.cumsum(runs) + runs, runs) + np.arange(runs.sum())
            both = np.bincount(owner[at], minlength=len(sets))
            close = 100 * both >= threshold * (sizes + len(own) - both)
            found.update((roots[place], root) for place in np.flatnonzero(close) if roots[place] != root)
        return pa.table(
            {name: pa.array([link[k] for link in found], pa.binary()) for k, name in enumerate("ab")}
        )

    keys = ["pivot", "far_block", "block"]
    body = texts.hint("merge")
    left, right = left.join(body, "node"), right.join(body, "node")
    # Columns of their own for either side of the cogroup.
    right = right.select([F.col(c).alias(c.upper()) for c in right.columns])
    grouped = left.groupBy(*keys).cogroup(right.groupBy(*[key.upper() for key in keys]))
    return grouped.applyInArrow(compare, "a binary, b binary")


def _stars(edges: DataFrame) -> bool:
    """Whether each larger node a of the edges (a, b) has one edge and none is the smaller of another."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down")).unionAll(
        edges.select("b", F.lit(0), F.lit(1))
    )
    nodes = ends.groupBy("node").agg(F.sum("up").alias("up"), F.sum("down").alias("down"))
    return nodes.agg(F.count_if(F.expr("up > 1 OR (up > 0 AND down > 0)")) == 0).first()[0]


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the smallest node reachable.

    Alternates large-star and small-star steps, which leave a star per component after a number
    of rounds that grows with the logarithm of its size.
    """
    larger = F.greatest("a", "b").alias("a")
    edges = stage(edges.where("a <> b").select(larger, F.least("a", "b").alias("b")).distinct(), "cc_edges")
    while not _stars(edges):
        # Large star: every larger neighbour is tied to the smallest node around.
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m"))
        least = least.select("a", F.least("a", "m").alias("m"))
        large = both.where("b > a").join(stage(least, "cc_least").hint("merge"), "a")
        large = stage(large.select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b"), "cc_large")
        # Small star: a node and its smaller neighbours are tied to the smallest of them.
        least = stage(large.groupBy("a").agg(F.min("b").alias("m")), "cc_least")
        small = large.join(least.hint("merge"), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        small = small.unionAll(least.select("a", F.col("m").alias("b")))
        edges = stage(small.where("a <> b").distinct(), "cc_edges")
    roots = edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.unionAll(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def _keyed(docs: DataFrame, columns: list, uid: str, name: str) -> DataFrame:
    """The columns and a key of each row, written: the key stays what it is however often it is read."""
    return stage(docs.select(*columns, F.monotonically_increasing_id().alias(uid)), name)


def _groups(rows: DataFrame, *, width: int = WIDTH, threshold: int = THRESHOLD) -> DataFrame:
    """(uid, doc_id, n_shingles, component_id, kept) of written (uid, doc_id, body)."""
    signed = stage(_signatures(rows, width), "near_signed")
    # Null ids come last, so one is least only where all are null.
    place = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "uid")
    nodes = (
        signed.where("node IS NOT NULL")
        .groupBy("node")
        .agg(
            F.min(place).alias("least"),
            F.first("n_shingles").cast("int").alias("n"),
            F.first("bands").alias("bands"),
        )
    )
    nodes = stage(nodes, "near_nodes")
    entries = nodes.select("node", "n", F.explode("bands").alias("key"))
    # Only buckets with company matter.
    sizes = entries.groupBy("key").agg(F.count("*").alias("members")).where("members > 1")
    shared = stage(
        entries.join(stage(sizes, "near_sizes").hint("merge"), "key"), "near_shared"
    )
    scores = shared.groupBy("node").agg(F.sum("members").alias("score"))
    rated = shared.join(scores.hint("merge"), "node")
    pivots = stage(
        rated.groupBy("key").agg(F.max(F.struct("score", "node")).alias("best"))
        .select("key", F.col("best.node").alias("pivot")),
        "near_pivots",
    )
    beside = stage(
        shared.join(pivots.hint("merge"), "key").select("pivot", "node", "n").distinct(), "near_beside"
    )
    first = beside.where("node <> pivot").select(
        F.col("node").alias("a"), F.col("pivot").alias("b")
    )
    # Texts of all that share a bucket; the second comparison asks for no others.
    wanted = nodes.join(beside.select("node").distinct().hint("merge"), "node").select(
        F.col("least.uid").alias("uid"), "node"
    )
    texts = stage(rows.join(wanted.hint("merge"), "uid").select("node", "body"), "near_texts")
    links = _links(stage(_compared(first, texts, width), "near_compared"), threshold)
    groups = stage(components(links), "near_groups")
    more = stage(_across(beside, groups, texts, width, threshold), "near_links")
    rooted = nodes.select("node", "least").join(groups.hint("merge"), "node", "left")
    rooted = rooted.withColumn("root", F.coalesce("root", "node"))
    if not more.isEmpty():
        # Components that such links join take the smallest of their roots.
        joint = stage(components(more).toDF("root", "joint"), "near_joint")
        rooted = rooted.join(joint.hint("merge"), "root", "left")
        rooted = rooted.withColumn("root", F.coalesce("joint", "root")).drop("joint")
    least = stage(rooted.groupBy("root").agg(F.min("least").alias("keeper")), "near_least")
    named = rooted.join(least.hint("merge"), "root").select("node", "keeper")
    joined = signed.drop("bands").join(stage(named, "near_named").hint("merge"), "node", "left")
    return joined.select(
        "uid",
        "doc_id",
        "n_shingles",
        F.coalesce("keeper.doc_id", "doc_id").alias("component_id"),
        # A row without shingles is in no node and has no keeper but itself.
        (F.coalesce("keeper.uid", "uid") == F.col("uid")).alias("kept"),
    )


def near_groups(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row per document.

    Two documents are linked if their sets of shingles of `width` words, A-Z in lower case, have a
    Jaccard similarity of `threshold` percent or more; component_id is the smallest doc_id that
    can be reached over links, and exactly one row of the component is kept: one that has that id.
    Texts without words, and null texts, have no shingles and no links. Ids are longs; rows that
    repeat an id keep a row each and are told apart by their place, and a row with a null id is in
    the component of its text but is never the one that is kept, unless all are null; then one of
    them is. Other columns are not read; an empty table stays empty.
    """
    columns = [F.col(quoted(doc_id)).cast("long").alias("doc_id"), whole(text).cast("binary").alias("body")]
    groups = _groups(_keyed(docs, columns, "uid", "near_rows"), **options)
    return groups.select(F.col("doc_id").alias(doc_id), "n_shingles", "component_id", "kept")


def near_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", **options) -> DataFrame:
    """The rows that are kept, one of each component, with the columns they came with."""
    (uid,) = spare(docs, "uid")
    columns = [F.col(quoted(c)) for c in docs.columns]
    keyed = _keyed(docs, columns, uid, "near_rows")
    rows = keyed.select(
        F.col(uid).alias("uid"),
        F.col(quoted(doc_id)).cast("long").alias("doc_id"),
        whole(text).cast("binary").alias("body"),
    )
    dropped = _groups(rows, **options).where("NOT kept").select(F.col("uid").alias(uid))
    return keyed.join(dropped.hint("merge"), uid, "left_anti").select(*columns)

"""Hard-negative mining by exact integer inner products, scored with the method of Four Russians.

Components become integers. For every eight dimensions of an anchor a table holds the sums of all
256 subsets of its components. A candidate's components are cut into bit planes, in two's
complement, and the bits of eight dimensions are packed into one byte: an entry of that table is
then the anchor's product with eight bits, and a product with the whole candidate is the sum of the
entries of a plane, shifted by its place and added up, the sign's plane subtracted. Nothing is
rounded.

Anchors meet candidates in blocks: a task holds one block of each, scores it in smaller tiles and
keeps only the best of each anchor. The positives are sought among the rows of the anchor's label,
dealt by label and block, so a label with many rows has many blocks. The negatives are sought among
all rows, since the bounds of their scores follow from the positives'.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrowatch.llm.common import quoted
from ferrowatch.sources.staging import stage

SCALE = 256
POSITIVES = 5
NEGATIVES = 10
# Shares of the positive's score, in hundredths, that a negative's lies between.
LEAST_SHARE = 30
MOST_SHARE = 90
# Rows of a block of candidates and of one of anchors; and of the tiles that are scored at once.
BLOCK_ROWS = 32_768
ANCHOR_ROWS = 2048
TILE_ROWS = 2048
TILE_ANCHORS = 256
# Scores must stay below this, so that a hundred of them fit a long.
GREATEST = 1 << 56
# Below every score, and not the least number, which has no negative.
_NONE = -(1 << 62)


def bit_planes(values: np.ndarray) -> np.ndarray:
    """The bits of integers (row, dimension) as bytes (plane, row, eight dimensions); the last plane
    is the sign's."""
    most = max(int(values.max(initial=0)), -int(values.min(initial=0)) - 1, 0)
    planes = range(most.bit_length() + 1)
    return np.stack([np.packbits((values >> k) & 1 == 1, axis=1, bitorder="little") for k in planes])


def subset_sums(anchors: np.ndarray) -> np.ndarray:
    """(eight dimensions, subset, anchor): the sums of all subsets of each eight components."""
    n, dims = anchors.shape
    groups = -(-dims // 8)
    padded = np.zeros((8 * groups, n), np.int64)
    padded[:dims] = anchors.T
    sums = np.zeros((groups, 256, n), np.int64)
    for bit in range(8):
        half = 1 << bit
        sums[:, half : 2 * half] = sums[:, :half] + padded[bit::8][:, None]
    fits = np.abs(padded).sum(axis=0).max(initial=0) < 1 << 31
    return sums.astype(np.int32) if fits else sums


def scores(planes: np.ndarray, sums: np.ndarray) -> np.ndarray:
    """(row, anchor): inner products from the rows' bit planes and the anchors' subset sums."""
    total = np.zeros((planes.shape[1], sums.shape[2]), np.int64)
    for k, plane in enumerate(planes):
        part = sums[0][plane[:, 0]]
        for group in range(1, len(sums)):
            part += sums[group][plane[:, group]]
        shifted = part.astype(np.int64) << k
        if k == len(planes) - 1:
            total -= shifted
        else:
            total += shifted
    return total


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), -1)


def _tiles(anchors: np.ndarray, rows: np.ndarray):
    """(first anchor, first row, scores by anchor and row) of all tiles."""
    planes = bit_planes(rows)
    for at in range(0, len(anchors), TILE_ANCHORS):
        sums = subset_sums(anchors[at : at + TILE_ANCHORS])
        for row in range(0, len(rows), TILE_ROWS):
            yield at, row, scores(planes[:, row : row + TILE_ROWS], sums).T


def _best(found: list[tuple[np.ndarray, ...]], groups: int, keep: int) -> list[np.ndarray]:
    """The first so many of each group by falling score, then by row, of (group columns.., row, score)."""
    columns = [np.concatenate(part) for part in zip(*found)]
    order = np.lexsort((columns[-2], -columns[-1], *columns[:groups][::-1]))
    columns = [column[order] for column in columns]
    fresh = np.zeros(len(order), bool)
    fresh[:1] = True
    for column in columns[:groups]:
        fresh[1:] |= column[1:] != column[:-1]
    place = np.arange(len(order)) - np.maximum.accumulate(np.where(fresh, np.arange(len(order)), 0))
    return [column[place < keep] for column in columns]


def _positives(mine: pa.Table, theirs: pa.Table) -> pa.Table:
    """(anchor, row, positive_id, score): the best other rows of a block for each anchor."""
    schema = pa.schema([("anchor", pa.int64()), ("row", pa.int64()), ("positive_id", pa.int64()), ("score", pa.int64())])
    if not mine.num_rows or not theirs.num_rows:
        return schema.empty_table()
    theirs = theirs.sort_by([("ID", "ascending"), ("ROW", "ascending")])
    uids, ids = theirs.column("ROW").to_numpy(), theirs.column("ID").to_numpy()
    own = mine.column("row").to_numpy()
    found = []
    for at, row, tile in _tiles(_matrix(mine.column("v")), _matrix(theirs.column("V"))):
        names = own[at : at + len(tile)]
        tile = np.where(uids[None, row : row + tile.shape[1]] == names[:, None], _NONE, tile)
        order = np.argsort(-tile, axis=1, kind="stable")[:, :POSITIVES]
        best = np.take_along_axis(tile, order, 1)
        anchor = np.broadcast_to(at + np.arange(len(tile))[:, None], best.shape)
        real = best != _NONE
        found.append((anchor[real], row + order[real], best[real]))
    anchor, place, best = _best(found, 1, POSITIVES)
    return pa.Table.from_arrays([pa.array(x) for x in (own[anchor], uids[place], ids[place], best)], schema=schema)


def _negatives(mine: pa.Table, theirs: pa.Table) -> pa.Table:
    """(anchor, place, row, negative_id, score): the best rows of a block, of another label and
    between the bounds, for each positive of each anchor."""
    names = ["anchor", "place", "row", "negative_id", "score"]
    schema = pa.schema([(name, pa.int64()) for name in names])
    if not mine.num_rows or not theirs.num_rows:
        return schema.empty_table()
    theirs = theirs.sort_by([("ID", "ascending"), ("ROW", "ascending")])
    labels, own_labels = theirs.column("LABEL").to_numpy(), mine.column("label").to_numpy()
    listed = mine.column("positives").combine_chunks()
    level = np.full((mine.num_rows, POSITIVES), -1, np.int64)
    sizes = np.diff(listed.offsets.to_numpy())
    level[np.arange(POSITIVES)[None] < sizes[:, None]] = listed.flatten().to_numpy()
    # The bounds are whole numbers; a negative score of a positive leaves nothing between them.
    least, most = -(-LEAST_SHARE * level // 100), MOST_SHARE * level // 100
    found = []
    for at, row, tile in _tiles(_matrix(mine.column("v")), _matrix(theirs.column("V"))):
        n, width = tile.shape
        same = labels[None, row : row + width] == own_labels[at : at + n, None]
        tile = np.where(same, _NONE, tile)
        order = np.argsort(-tile, axis=1, kind="stable")
        tile = np.take_along_axis(tile, order, 1)
        for place in range(POSITIVES):
            low, high = least[at : at + n, place], most[at : at + n, place]
            first = (tile > high[:, None]).sum(axis=1)
            pick = first[:, None] + np.arange(NEGATIVES)[None]
            inside = (pick < width) & (level[at : at + n, place] >= 0)[:, None]
            pick = np.minimum(pick, width - 1)
            best = np.take_along_axis(tile, pick, 1)
            inside &= (best >= low[:, None]) & (best != _NONE)
            anchor = np.broadcast_to(at + np.arange(n)[:, None], pick.shape)[inside]
            rows = np.take_along_axis(order, pick, 1)[inside] + row
            found.append((anchor, np.full(len(anchor), place), rows, best[inside]))
    anchor, place, rows, best = _best(found, 2, NEGATIVES)
    ids = theirs.column("ID").to_numpy()
    columns = (mine.column("row").to_numpy()[anchor], place, theirs.column("ROW").to_numpy()[rows], ids[rows], best)
    return pa.Table.from_arrays([pa.array(column, pa.int64()) for column in columns], schema=schema)


def _number(rows: Column, size: int) -> Column:
    return F.greatest(F.ceil(rows / F.lit(size)), F.lit(1)).cast("int")


def _dealt(anchors: DataFrame, rows: DataFrame, label: str | None = None):
    """Both sides, a row of each in every pair of blocks that has to be scored, grouped.

    With a label anchors meet the rows of their own only, and how many blocks a label has follows
    from its rows; without one they meet all rows.
    """
    counted = [F.count("*").alias("n"), F.count_if("asks").alias("asking")]
    sizes = [_number(F.col("n"), BLOCK_ROWS).alias("blocks"), _number(F.col("asking"), ANCHOR_ROWS).alias("tiles")]
    if label:
        layout = rows.groupBy(label).agg(*counted).select(label, *sizes)
        anchors, rows = anchors.join(layout, label), rows.join(layout, label)
    else:
        layout = rows.agg(*counted).select(*sizes).first().asDict()
        numbers = {name: F.lit(number) for name, number in layout.items()}
        anchors, rows = anchors.withColumns(numbers), rows.withColumns(numbers)

    def placed(side: DataFrame, own: str, other: str) -> DataFrame:
        number = F.pmod(F.xxhash64("row"), F.col(own)).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.col(other) - 1))
        kept = [c for c in side.columns if c not in (own, other, "asks")]
        return side.select(*kept, number.alias(own), every.alias(other))

    names = ["blocks", "tiles", *([label] if label else [])]
    theirs = placed(rows, "blocks", "tiles")
    theirs = theirs.select([F.col(c).alias(c.upper()) for c in theirs.columns])
    mine = placed(anchors, "tiles", "blocks")
    return mine.groupBy(*names).cogroup(theirs.groupBy(*[name.upper() for name in names]))


def mine_negatives(
    table: DataFrame, is_anchor: Column, *, vec_id: str = "vec_id", vector: str = "embedding", label: str = "label"
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Scores are inner products of the components times SCALE, rounded down. An anchor's positives are
    the POSITIVES other rows of its label with the highest scores; the negatives of a positive are
    the NEGATIVES rows of another label with the highest scores between LEAST_SHARE and MOST_SHARE
    hundredths of the positive's. Ties go to the smaller id. Rows with a null id, label or vector, a
    null or non-finite component, or another number of components than most (the more of equally
    common) take no part. Repeated rows are one; rows that share an id only are rows of their own.
    A positive without any such row has none here, nor has an anchor without a positive. Other
    columns are not read. Components so large that a score does not fit are an error.
    """
    spark = table.sparkSession
    nothing = spark.createDataFrame(
        [], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long"
    )
    rows = table.select(
        F.col(quoted(vec_id)).cast("long").alias("id"),
        F.col(quoted(label)).cast("long").alias("label"),
        F.col(quoted(vector)).cast("array<double>").alias("x"),
        F.coalesce(is_anchor, F.lit(False)).alias("asks"),
    ).where("id IS NOT NULL AND label IS NOT NULL AND x IS NOT NULL AND size(x) > 0")
    rows = rows.where(F.forall("x", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    shape = rows.groupBy(F.size("x").alias("dims")).agg(
        F.count("*").alias("n"), F.max(F.array_max(F.transform("x", F.abs))).alias("most")
    )
    shape = shape.orderBy(F.desc("n"), F.desc("dims")).first()
    if shape is None:
        return nothing
    dims, most = shape["dims"], SCALE * shape["most"] + 1
    if dims * most * most >= GREATEST:
        raise ValueError(f"components up to {shape['most']} give scores beyond {GREATEST}")
    kind = "int" if most < 1 << 31 else "long"
    whole = F.transform("x", lambda x: F.floor(SCALE * x).cast(kind))
    rows = rows.where(F.size("x") == dims).select("id", "label", whole.alias("v"), "asks").distinct()
    rows = stage(rows.withColumn("row", F.monotonically_increasing_id()), "negative_rows")
    anchors = rows.where("asks").select("row", "id", "label", "v")

    alike = _dealt(anchors, rows, "label")
    found = alike.applyInArrow(_positives, "anchor long, row long, positive_id long, score long")
    order = Window.partitionBy("anchor").orderBy(F.desc("score"), "positive_id", "row")
    found = found.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < POSITIVES)
    found = stage(found, "negative_positives")
    listed = found.groupBy("anchor").agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("list"))
    listed = listed.select("anchor", F.col("list.score").alias("positives"))
    asking = anchors.join(listed, F.col("row") == F.col("anchor")).select("row", "label", "v", "positives")

    apart = _dealt(asking, rows)
    negatives = apart.applyInArrow(_negatives, "anchor long, place long, row long, negative_id long, score long")
    order = Window.partitionBy("anchor", "place").orderBy(F.desc("score"), "negative_id", "row")
    negatives = negatives.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= NEGATIVES)
    positives = found.select("anchor", "place", "positive_id", F.col("score").alias("positive_score"))
    named = negatives.withColumnRenamed("score", "negative_score").join(positives, ["anchor", "place"])
    named = named.join(anchors.select(F.col("row").alias("anchor"), F.col("id").alias("anchor_id")), "anchor")
    return named.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")

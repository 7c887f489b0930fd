"""Exact deduplication by distributed most-significant-digit radix partitioning.

A text's digits are its length and then its successive bytes, in strides that widen from level
to level. Level 0 splits all documents by length and first stride, with a count per group that is
combined before the shuffle; a document alone in its group is done and its text never moves.
The others are written once and split level by level, each by the next stride of bytes inside its
group, until a group is a singleton or its bytes are used up: documents that are still together
then are equal, byte by byte. No digest stands in for the comparison. A level's groups are
written before they are joined back, and the join sorts and merges at every size, so that both
sides come from a shuffle and the rows of a hot group are spread by AQE's skew join; nothing
collects a group's members.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrowatch.llm.common import quoted, spare, whole, without
from ferrowatch.sources.staging import stage

# Bytes of the first strides; later ones widen by the last ratio. Not a limit: levels go on until
# every group is done.
STRIDES = (64, 1024, 16384)
OUTPUT = ("keep_id", "group_size", "kept")


def _stride(level: int) -> int:
    ratio = STRIDES[-1] // STRIDES[-2]
    if level < len(STRIDES):
        return STRIDES[level]
    return min(STRIDES[-1] * ratio ** (level - len(STRIDES) + 1), 2**30)


def _split(rows: DataFrame, level: int) -> DataFrame:
    """Split (uid, id, gid, rest) by the next stride: adds the new group, its size and its keeper."""
    width = _stride(level)
    digits = rows.withColumn("digit", F.substring("rest", 1, width))
    groups = stage(
        digits.groupBy("gid", "digit").agg(
            F.count("*").alias("group_size"),
            F.min("uid").alias("next_gid"),
            F.max(F.struct("id", "uid")).alias("keeper"),
        ),
        f"radix_groups_{level}",
    )
    ended = F.octet_length("rest") <= width
    return (
        digits.join(groups.hint("merge"), ["gid", "digit"])
        .withColumn("done", ended | (F.col("group_size") == 1))
        .select(
            "uid",
            "id",
            F.col("next_gid").alias("gid"),
            "group_size",
            F.col("keeper.id").alias("keep_id"),
            (F.col("keeper.uid") == F.col("uid")).alias("kept"),
            "done",
            F.when(~F.col("done"), F.substring("rest", width + 1, 2**31 - 1)).alias("rest"),
        )
    )


def exact_groups(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """All rows, with keep_id, group_size and kept: one row stays of those with equal text.

    The row with the largest id stays; an id that is null is the smallest. Of rows that repeat
    both that id and the text exactly one stays. A null text equals an empty one. Columns of the
    input named keep_id, group_size or kept are replaced; an empty table stays empty.
    """
    docs = without(docs, OUTPUT)
    uid, length, digit, gid = spare(docs, "uid", "length", "digit", "gid")
    body = whole(text).cast("binary")
    columns = [F.col(quoted(c)) for c in docs.columns]
    keyed = docs.select(
        *columns,
        F.monotonically_increasing_id().alias(uid),
        F.octet_length(body).alias(length),
        F.substring(body, 1, _stride(0)).alias(digit),
    )
    shared = stage(
        keyed.groupBy(length, digit)
        .agg(F.count("*").alias("n"), F.min(uid).alias(gid))
        .where("n > 1")
        .drop("n"),
        "radix_groups_0",
    )
    alone = keyed.join(shared.hint("merge"), [length, digit], "left_anti").select(
        *columns,
        F.col(quoted(doc_id)).alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
    )
    together = keyed.join(shared.hint("merge"), [length, digit]).select(*columns, uid, gid)
    together = stage(together, "radix_rows")
    rows = together.select(
        F.col(uid).alias("uid"),
        F.col(quoted(doc_id)).alias("id"),
        F.col(gid).alias("gid"),
        F.substring(body, _stride(0) + 1, 2**31 - 1).alias("rest"),
    )
    levels, level = [], 1
    while True:
        split = stage(_split(rows, level), f"radix_level_{level}")
        levels.append(split.where("done").select("uid", *OUTPUT))
        rows = split.where("NOT done").select("uid", "id", "gid", "rest")
        if rows.isEmpty():
            break
        level += 1
    decisions = reduce(DataFrame.unionAll, levels).withColumnRenamed("uid", uid)
    decided = together.join(decisions, uid).select(*columns, *OUTPUT)
    return alone.unionAll(decided)


def exact_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows that stay, with the columns they came with."""
    return exact_groups(docs, doc_id=doc_id, text=text).where("kept").drop(*OUTPUT)

"""Mixing sources to target weights by entropy balancing.

Each source gets a share of all tokens by its weight, at most `cap` times its own size; what is
over is shared again by weight. Within a source, the document rates that are closest to 1 in
relative entropy and meet the source's token target are exp(lambda * size), cut at `cap`: an
exponential tilt with one dual variable per source. The dual is solved by safeguarded Newton
iterations over the (source, size) histogram, one distributed aggregate each. Rates are rounded
into whole copies by a hash of the row, and single documents then move up or down by one copy
where that brings a source nearer to its target. All of it is DataFrame expressions.
"""

import warnings
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrowatch.llm.common import quoted, spare, word_count
from ferrowatch.sources.staging import stage

OUTPUT = ("size", "source_size", "target", "copies", "taken")
TOLERANCE = 1e-6
# Newton steps and rounds of single-document corrections; both end earlier when nothing is left. A
# tilt that is not solved by then is used as it is, and a warning says so.
MAX_STEPS = 100
CORRECTIONS = 6
ENOUGH = 2e-4


def _key(source: str) -> Column:
    """The source as a string that is never null; distinct for null and every source."""
    name = F.col(quoted(source))
    return F.when(name.isNull(), "n").otherwise(F.concat(F.lit("s"), name.cast("string")))


def source_targets(sizes: DataFrame, weights: Sequence[float], cap: int) -> DataFrame:
    """(skey, source_size, target, full) from (skey, size, n).

    Weights repeat over the sources by code point, null last. The ordering window holds one row
    per source.
    """
    totals = sizes.groupBy("skey").agg(
        F.sum(F.col("size") * F.col("n")).alias("source_size"),
        F.sum(F.col("size").cast("double") * F.col("size") * F.col("n")).alias("squares"),
    )
    place = F.row_number().over(Window.orderBy(F.col("skey") == "n", "skey")) - 1
    weight = F.element_at(F.array(*map(F.lit, weights)), (place % len(weights) + 1).cast("int"))
    sources = stage(totals.withColumn("weight", weight), "mix_sources")
    limit = F.col("source_size") * cap
    full, known = F.lit(False), -1
    while True:
        # What the full sources leave, over the weights of the others.
        left = sources.agg(
            (F.sum("source_size") - F.sum(F.when(full, limit).otherwise(0))).alias("words"),
            F.sum(F.when(~full, F.col("weight"))).alias("weights"),
            F.count_if(full).alias("n_full"),
        ).first()
        if left.words is None or left.weights is None or left.n_full == known:
            break
        known = left.n_full
        # As a double: the literal is an int up to 2**31 - 1, and words times a weight may be beyond that.
        share = F.lit(float(left.words)) * F.col("weight") / F.lit(left.weights)
        target, full = F.when(full, limit.cast("double")).otherwise(share), full | (share > limit)
    if known < 0:
        target = limit.cast("double")
    target = F.when(full, limit.cast("double")).otherwise(target)
    return sources.select(
        "skey",
        "source_size",
        target.alias("target"),
        (full | (F.col("source_size") == 0)).alias("full"),
        # The tilt is per mean size, so that the dual variables have one scale.
        F.try_divide(F.col("squares"), F.col("source_size")).alias("scale"),
    )


def _rate(cap: int, names: Sequence[str] = ("lam", "size", "scale", "full")) -> Column:
    lam, size, scale, full = map(F.col, names)
    tilted = F.exp(F.least(lam * size / scale, F.lit(50.0)))
    return F.when(full, F.lit(float(cap))).otherwise(F.least(tilted, F.lit(float(cap))))


def _rounded(rate: Column, *row: str) -> Column:
    """The rate rounded up or down by a hash of the row; never above the cap."""
    uniform = F.pmod(F.xxhash64(*row), F.lit(2**40)) / F.lit(float(2**40))
    return F.floor(rate + uniform).cast("long")


def solve_tilts(histogram: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """targets with the dual variable lam of each source, by Newton steps on the log of the moment.

    A step that leaves the bracket is replaced by its middle. A source that is full, or empty, has
    nothing to solve.
    """
    state = targets.select(
        "*",
        F.lit(0.0).alias("lam"),
        F.lit(None).cast("double").alias("low"),
        F.lit(None).cast("double").alias("high"),
    )
    state = stage(state, "mix_tilts")
    words = F.col("size") * F.col("n")
    rate = _rate(cap)
    for _ in range(MAX_STEPS):
        moments = (
            histogram.join(state.where("NOT full"), "skey")
            .groupBy("skey")
            .agg(
                F.sum(words * rate).alias("moment"),
                F.sum(F.when(rate < cap, words * rate * F.col("size") / F.col("scale")))
                .alias("slope"),
            )
        )
        joined = state.join(moments, "skey", "left")
        under = F.col("moment") < F.col("target")
        low = F.when(under, F.col("lam")).otherwise(F.col("low"))
        high = F.when(under, F.col("high")).otherwise(F.col("lam"))
        step = F.try_divide(
            F.ln(F.try_divide(F.col("target"), F.col("moment"))) * F.col("moment"), F.col("slope")
        )
        newton = F.col("lam") + step
        # Without a bound on one side, the search doubles outwards.
        wider_up = F.greatest(F.abs(F.col("low")) * 2, F.lit(1.0))
        wider_down = -F.greatest(F.abs(F.col("high")) * 2, F.lit(1.0))
        middle = (F.coalesce("low", wider_down) + F.coalesce("high", wider_up)) / 2
        inside = (
            newton.isNotNull()
            & ~F.isnan(newton)
            & (F.col("low").isNull() | (newton > F.col("low")))
            & (F.col("high").isNull() | (newton < F.col("high")))
            & (F.abs(step) < 30)
        )
        off = F.abs(F.col("moment") - F.col("target")) > F.col("target") * TOLERANCE
        moving = ~F.col("full") & F.coalesce(off, F.lit(False))
        advanced = (
            joined.withColumn("low", low)
            .withColumn("high", high)
            .withColumn("off", moving)
            .withColumn(
                "lam",
                F.when(moving, F.when(inside, newton).otherwise(middle)).otherwise(F.col("lam")),
            )
            .select(*state.columns, "off")
        )
        advanced = stage(advanced, "mix_tilts")
        state = advanced.drop("off")
        if advanced.where("off").isEmpty():
            return state
    unsolved = advanced.where("off").count()
    warnings.warn(f"{unsolved} sources miss their target after {MAX_STEPS} steps", stacklevel=2)
    return state


def _corrections(sizes: DataFrame, tilts: DataFrame, cap: int) -> DataFrame:
    """(skey, id, size, delta): single rows that gain or lose one copy, few per source."""
    rows = sizes.join(tilts, "skey").withColumn("copies", _rounded(_rate(cap), "skey", "id", "size")).where("size > 0")
    gap = (
        rows.groupBy("skey")
        .agg(F.sum(F.col("size") * F.col("n") * F.col("copies")).alias("taken"))
        .join(tilts.select("skey", "target"), "skey")
        .select("skey", "target", (F.round("target") - F.col("taken")).cast("long").alias("gap"))
    )
    gap = stage(gap, "mix_gaps")
    moved = None
    for _ in range(CORRECTIONS):
        open_gaps = gap.where((F.abs("gap") > F.col("target") * ENOUGH) & (F.col("gap") != 0))
        words = F.col("size") * F.col("n")
        may_move = F.when(F.col("gap") > 0, F.col("copies") < cap).otherwise(F.col("copies") > 0)
        fits = may_move & (words < 2 * F.abs(F.col("gap")))
        nearest = -F.abs(F.abs(F.col("gap")) - words)
        candidates = rows.join(open_gaps.select("skey", "gap"), "skey").where(fits)
        if moved is not None:
            same = candidates["id"].eqNullSafe(moved["id"])
            same &= (candidates["skey"] == moved["skey"]) & (candidates["size"] == moved["size"])
            candidates = candidates.join(moved, same, "left_anti")
        chosen = (
            candidates.groupBy("skey")
            .agg(F.max(F.struct(nearest.alias("near"), "id", "size", "n", "gap")).alias("best"))
            .select(
                "skey",
                "best.id",
                "best.size",
                F.signum("best.gap").cast("long").alias("delta"),
                (F.col("best.size") * F.col("best.n")).alias("words"),
            )
        )
        chosen = stage(chosen, "mix_moves")
        if chosen.isEmpty():
            break
        step = chosen.select("skey", (F.col("delta") * F.col("words")).alias("step"))
        gap = gap.join(step, "skey", "left").select(
            "skey", "target", (F.col("gap") - F.coalesce("step", F.lit(0))).alias("gap")
        )
        gap = stage(gap, "mix_gaps")
        chosen = chosen.drop("words")
        moved = chosen if moved is None else moved.unionAll(chosen)
    if moved is None:
        moved = sizes.select("skey", "id", "size", F.lit(0).cast("long").alias("delta")).limit(0)
    return moved


class Mix:
    """The solved mix of a table: how many copies of each row it takes.

    Sizes are words. A null text has size 0 and is taken once, as any text without words; a null source is a source of its own, a null id is
    an id like others. Rows that repeat source, id and size share their number of copies, so it
    depends on nothing but the data and reruns agree. An empty table gives an empty mix.
    """

    def __init__(
        self,
        docs: DataFrame,
        *,
        weights: Sequence[float] = (1, 2, 3),
        cap: int = 3,
        doc_id: str = "doc_id",
        source: str = "source",
        text: str = "text",
    ) -> None:
        self.docs, self.cap = docs, cap
        self.keys = {"skey": _key(source), "id": F.col(quoted(doc_id)), "size": word_count(text)}
        rows = docs.select(*[value.alias(name) for name, value in self.keys.items()])
        counted = rows.groupBy("skey", "id", "size").agg(F.count("*").alias("n"))
        self.sizes = stage(counted, "mix_sizes")
        histogram = self.sizes.groupBy("skey", "size").agg(F.sum("n").alias("n"))
        histogram = stage(histogram, "mix_histogram")
        targets = source_targets(histogram, weights, cap)
        self.tilts = solve_tilts(histogram.where("size > 0"), targets, cap).drop("low", "high")
        self.moved = _corrections(self.sizes, self.tilts, cap)

    def _with_copies(self, rows: DataFrame, names: Sequence[str], output: str) -> DataFrame:
        """rows with the number of copies and the columns of tilts under their own names.

        names: the columns of rows that hold source key, id and size. What is joined has a row per
        source and a few per source; both joins are left to Spark's own size check.
        """
        skey, row_id, size = names
        tilts = self.tilts.toDF(*spare(rows, *[f"tilt_{c}" for c in self.tilts.columns]))
        moved = self.moved.toDF(*spare(rows, *[f"moved_{c}" for c in self.moved.columns]))
        by = dict(zip(self.tilts.columns, tilts.columns, strict=True))
        moved_key, moved_id, moved_size, delta = moved.columns
        same = F.col(skey) == F.col(moved_key)
        same &= F.col(row_id).eqNullSafe(F.col(moved_id)) & (F.col(size) == F.col(moved_size))
        rate = _rate(self.cap, (by["lam"], size, by["scale"], by["full"]))
        # A document without words weighs nothing and is neither repeated nor dropped.
        rate = F.when(F.col(size) == 0, F.lit(1.0)).otherwise(rate)
        return (
            rows.join(tilts, F.col(skey) == F.col(by["skey"]))
            .join(moved, same, "left")
            .withColumn(output, _rounded(rate, *names) + F.coalesce(F.col(delta), F.lit(0)))
            .withColumnsRenamed({by["source_size"]: "source_size", by["target"]: "target"})
        )

    def decisions(self) -> DataFrame:
        """One row per document: id, size, source_size, target, copies and taken (words)."""
        decided = self._with_copies(self.sizes, ("skey", "id", "size"), "copies")
        decided = decided.withColumn("taken", F.col("copies") * F.col("size"))
        once = F.explode(F.sequence(F.lit(1), F.col("n").cast("int")))
        return decided.select("id", *OUTPUT, once.alias("occurrence")).drop("occurrence")

    def documents(self) -> DataFrame:
        """The mixed documents: every row as often as its copies say, with its own columns."""
        columns = [F.col(quoted(c)) for c in self.docs.columns]
        names = spare(self.docs, "mix_skey", "mix_id", "mix_size", "mix_copies", "mix_copy")
        keyed = self.docs.select(
            *columns, *[v.alias(n) for n, v in zip(names, self.keys.values(), strict=False)]
        )
        copies, copy = names[3:]
        taken = self._with_copies(keyed, names[:3], copies).where(F.col(copies) > 0)
        repeats = F.explode(F.sequence(F.lit(1), F.col(copies).cast("int"))).alias(copy)
        return taken.select(*columns, repeats).drop(copy)

"""The part to service, from statistical and historical thresholds per signal."""

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrowatch.functions.expressions import any_of, shares
from ferrowatch.schemas import REQUIRED

# Each part's signals in order, and whether a high or a low value points to it.
SIGNALS = {
    "Motor": {
        "vibration": "high",
        "noise_level": "high",
        "temperature": "high",
        "current": "high",
        "power_output": "low",
    },
    "Bearings": {
        "vibration": "high",
        "noise_level": "high",
        "temperature": "high",
        "rotational_speed": "low",
    },
    "Seals": {"pressure": "low", "oil_viscosity": "low", "temperature": "high"},
    "Filters": {"pressure": "low", "oil_viscosity": "low", "temperature": "high"},
}
# The part whose replacements give each item's historical means; Filters go by Seals.
HISTORY_PARTS = {"Motor": "Motor", "Bearings": "Bearings", "Seals": "Seals", "Filters": "Seals"}
REMAINING_ITEM = "Coupling"
DEVIATIONS = 3


def _required() -> Column:
    return F.col("maintenance_needed") == REQUIRED


def _threshold_row(df: DataFrame, history: dict[str, str]) -> DataFrame:
    """One row with a (stat, hist) struct per item and signal, from a single aggregate."""
    return df.agg(
        *[
            F.struct(
                (
                    F.avg(signal) + (DEVIATIONS if side == "high" else -DEVIATIONS) * F.stddev_samp(signal)
                ).alias("stat"),
                F.avg(F.when(F.col("parts_replaced") == history[item], F.col(signal))).alias("hist"),
            ).alias(f"{item}_{signal}")
            for item, signals in SIGNALS.items()
            for signal, side in signals.items()
        ]
    )


def _lower(stat: Column, hist: Column) -> Column:
    """The historical mean if it is below the statistical threshold or the only one known."""
    return F.when(stat.isNull() | (~F.isnan(stat) & (hist < stat)), hist).otherwise(stat)


def _long_form(df: DataFrame, history: dict[str, str]) -> DataFrame:
    rows = [
        F.struct(
            F.lit(item).alias("item"),
            F.lit(signal).alias("signal"),
            F.col(f"{item}_{signal}.stat").alias("stat"),
            F.col(f"{item}_{signal}.hist").alias("hist"),
        )
        for item, signals in SIGNALS.items()
        for signal in signals
    ]
    return _threshold_row(df, history).select(F.inline(F.array(*rows)))


def stat_thresholds(df: DataFrame) -> DataFrame:
    """(item, signal, stat): mean ± 3 sample deviations over the whole table."""
    return _long_form(df, HISTORY_PARTS).select("item", "signal", "stat")


def history_thresholds(df: DataFrame, filters_history: str = "Seals") -> DataFrame:
    """(item, signal, hist): mean over the rows on which the item's part was replaced."""
    history = {**HISTORY_PARTS, "Filters": filters_history}
    return _long_form(df, history).select("item", "signal", "hist")


def item_thresholds(df: DataFrame, filters_history: str = "Seals") -> DataFrame:
    """(item, signal, stat, hist, threshold): the lower of both, for high and low sides alike."""
    history = {**HISTORY_PARTS, "Filters": filters_history}
    return _long_form(df, history).withColumn("threshold", _lower(F.col("stat"), F.col("hist")))


def item_condition(item: str, thresholds: str = "_thresholds") -> Column:
    """A row that names the part and has a signal beyond its threshold, required or not."""
    beyond = []
    for signal, side in SIGNALS[item].items():
        limit = _lower(F.col(f"{thresholds}.{item}_{signal}.stat"), F.col(f"{thresholds}.{item}_{signal}.hist"))
        beyond.append(F.col(signal) > limit if side == "high" else F.col(signal) < limit)
    return (F.col("parts_replaced") == item) & any_of(beyond)


def point_at_parts(
    df: DataFrame, filters_history: str = "Seals", thresholds_from: DataFrame | None = None
) -> DataFrame:
    """Add pointed_part: the first part whose condition holds, whether maintenance is required or not.

    Thresholds come from the whole table, or from thresholds_from, as a one-row scalar subquery of the
    same plan.
    """
    history = {**HISTORY_PARTS, "Filters": filters_history}
    row = _threshold_row(df if thresholds_from is None else thresholds_from, history)
    part = reduce(lambda found, name: found.when(item_condition(name), name), SIGNALS, F)
    return df.withColumn("_thresholds", row.select(F.struct("*")).scalar()).select(
        *df.columns, part.alias("pointed_part")
    )


def assign_items(
    df: DataFrame, filters_history: str = "Seals", thresholds_from: DataFrame | None = None
) -> DataFrame:
    """Add maintenance_item: the first part whose condition holds, Coupling for the required rest.

    Rows without need for maintenance get NULL. Parts are pointed at here unless the rows have pointed_part.
    """
    if "pointed_part" not in df.columns:
        df = point_at_parts(df, filters_history, thresholds_from)
    item = F.when(_required(), F.coalesce(F.col("pointed_part"), F.lit(REMAINING_ITEM)))
    return df.withColumn("maintenance_item", item).drop("pointed_part")


def required_rows(df: DataFrame) -> DataFrame:
    return df.filter(_required())


def unassigned_count(df: DataFrame) -> DataFrame:
    """(unassigned): required rows without an item."""
    return required_rows(df).agg(F.count_if(F.col("maintenance_item").isNull()).alias("unassigned"))


def item_percentages(df: DataFrame) -> DataFrame:
    """(maintenance_item, count, percentage) among the required rows."""
    counts = required_rows(df).groupBy("maintenance_item").agg(F.count("*").alias("count"))
    return counts.withColumn("percentage", shares(counts))


def item_inspection(df: DataFrame, item: str) -> DataFrame:
    """The rows of one item with its signals; for Motor every required row, to show those missed."""
    rows = required_rows(df) if item == "Motor" else df.filter(F.col("maintenance_item") == item)
    return rows.select(
        "equipment_id",
        "maintenance_item",
        *SIGNALS.get(item, {}),
        "parts_replaced",
        "maintenance_type",
        "maintenance_needed",
    )

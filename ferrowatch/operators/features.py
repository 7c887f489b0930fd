"""Derived features of the integrated readings."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ferrowatch.functions.expressions import safe_div
from ferrowatch.sources.staging import stage

DAYS_PER_YEAR = 365
HOUR_MICROS = 3_600_000_000
# Stands for NULL among machines and times.
LEAST = -(1 << 63)


def equipment_age_days(df: DataFrame) -> DataFrame:
    return df.withColumn("equipment_age_days", F.datediff("timestamp", "installation_date"))


def days_since_overhaul(df: DataFrame) -> DataFrame:
    return df.withColumn("days_since_overhaul", F.abs(F.datediff("timestamp", "last_major_overhaul")))


def pct_of_max(df: DataFrame) -> DataFrame:
    """Temperature, pressure and speed as percentages of the machine's rated limits."""
    # The names of the shares, of the readings and of their limits.
    return df.withColumns(
        {
            result: safe_div(F.col(reading), F.col(limit)) * 100
            for result, reading, limit in (
                ("temp_pct_of_max", "temperature", "max_temperature"),
                ("pressure_pct_of_max", "pressure", "max_pressure"),
                ("speed_pct_of_max", "rotational_speed", "max_rotational_speed"),
            )
        }
    )


def cumulative_totals(df: DataFrame, written: bool = False) -> DataFrame:
    """Running cost and operating hours per machine by time; equal times share a total.

    A running sum over each machine would hold all rows of the busiest machine in one task. Rows of
    the same machine and time are added up first, which combines before the shuffle. Sums then run
    over the times of each machine-hour, so a dense day is spread over tasks; the totals of the hours
    before come first in each, as one more row. The sums are joined back on (machine, time), where
    AQE can split a hot key because the other side has one row per key. Machine and time are plain
    numbers there, without NULL: NULL ids are one machine, NULL times come first. With `written` the
    totals are, so what they shuffled is gone when wide rows move to join them.
    """
    keyed = df.withColumns({"_machine": _number(F.col("equipment_id").cast("long")), "_time": _micros("timestamp")})
    hour = F.expr(f"_time div {HOUR_MICROS}").alias("_hour")
    added = [F.sum("cost").alias("cost"), F.sum("operating_hours").alias("hours")]
    moments = keyed.groupBy("_machine", hour, "_time").agg(*added).withColumn("_moment", F.lit(True))
    earlier = Window.partitionBy("_machine").orderBy("_hour").rowsBetween(Window.unboundedPreceding, -1)
    before = keyed.groupBy("_machine", hour).agg(*added).select(
        "_machine",
        "_hour",
        F.lit(LEAST).alias("_time"),
        F.sum("cost").over(earlier).alias("cost"),
        F.sum("hours").over(earlier).alias("hours"),
        F.lit(False).alias("_moment"),
    )
    upto = Window.partitionBy("_machine", "_hour").orderBy("_moment", "_time")
    totals = moments.unionByName(before).select(
        "_machine",
        "_time",
        "_moment",
        F.sum("cost").over(upto).alias("cumulative_maintenance_cost"),
        F.sum("hours").over(upto).alias("cumulative_operating_hours"),
    )
    totals = totals.filter("_moment").drop("_moment")
    if written:
        totals = stage(totals, "running_totals")
    return keyed.join(totals, ["_machine", "_time"]).drop("_machine", "_time")


def _number(value: Column) -> Column:
    """A number that is never NULL; NULL is below all others."""
    return F.coalesce(value, F.lit(LEAST))


def _micros(name: str) -> Column:
    return _number(F.unix_micros(F.col(name).cast("timestamp")))


def estimated_rul(df: DataFrame) -> DataFrame:
    """Remaining life in days; needs equipment_age_days."""
    lifetime = F.col("expected_lifetime_years") * DAYS_PER_YEAR
    return df.withColumn("estimated_rul", lifetime - F.col("equipment_age_days"))


def abs_days_since_maintenance(df: DataFrame) -> DataFrame:
    return df.withColumn("days_since_maintenance", F.abs("days_since_maintenance"))


def feature_engineering(df: DataFrame, written: bool = False) -> DataFrame:
    """All derived features, appended in the order of the stage schema; running totals may be written."""
    df = days_since_overhaul(equipment_age_days(df))
    df = cumulative_totals(pct_of_max(df), written)
    return abs_days_since_maintenance(estimated_rul(df))


def negative_age_rows(df: DataFrame) -> DataFrame:
    return df.filter(F.col("equipment_age_days") < 0)


def negative_age_sample(df: DataFrame, n: int = 5) -> DataFrame:
    """The n rows with the lowest negative age."""
    return (
        negative_age_rows(df)
        .select("equipment_id", "timestamp", "installation_date", "equipment_age_days")
        .orderBy("equipment_age_days", "equipment_id", "timestamp")
        .limit(n)
    )


def negative_age_summary(df: DataFrame) -> DataFrame:
    return negative_age_rows(df).agg(
        F.count("*").alias("negative_count"),
        F.min("equipment_age_days").alias("min_negative_age"),
        F.max("equipment_age_days").alias("max_negative_age"),
        F.avg("equipment_age_days").alias("avg_negative_age"),
    )


def _before_installation():
    return F.col("timestamp") < F.col("installation_date")


def invalid_timestamp_totals(df: DataFrame) -> DataFrame:
    """(total_records, invalid_records, percentage) of readings older than their machine."""
    return df.agg(
        F.count("*").alias("total_records"), F.count_if(_before_installation()).alias("invalid_records")
    ).withColumn("percentage", safe_div(F.col("invalid_records"), F.col("total_records")) * 100)


def invalid_timestamps_by_equipment(df: DataFrame, n: int | None = 5) -> DataFrame:
    """(equipment_id, count) of such readings for the first n machines by id, or for all."""
    counts = df.filter(_before_installation()).groupBy("equipment_id").agg(F.count("*").alias("count"))
    return counts if n is None else counts.orderBy("equipment_id").limit(n)


def invalid_timestamp_sample(df: DataFrame, n: int = 5) -> DataFrame:
    """The first n such readings by machine and time; needs equipment_age_days."""
    return (
        df.filter(_before_installation())
        .select("equipment_id", "timestamp", "installation_date", "equipment_age_days")
        .orderBy("equipment_id", "timestamp")
        .limit(n)
    )

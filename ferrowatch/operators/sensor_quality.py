"""Checks of the sensor readings."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ferrowatch.functions.expressions import rows_per_item, safe_div
from ferrowatch.schemas import READING_COLUMNS

SECONDS_PER_DAY = 86_400


def timestamp_continuity(sensor: DataFrame) -> DataFrame:
    """(min_timestamp, max_timestamp, max_gap_seconds) over the whole table.

    A gap is the whole seconds between a machine's consecutive readings; its first reading
    has gap 0. A lag over each machine would put all readings of the busiest machine into one
    task. The gaps are therefore taken in two levels: between the distinct seconds inside one
    machine-day (86,400 at most, since equal seconds collapse before the shuffle), then
    between the last and first seconds of a machine's consecutive days.
    """
    seconds = (
        sensor.select("equipment_id", "timestamp", F.unix_timestamp("timestamp").alias("second"))
        .groupBy("equipment_id", F.floor(F.col("second") / SECONDS_PER_DAY).alias("day"), "second")
        .agg(F.min("timestamp").alias("first_time"), F.max("timestamp").alias("last_time"))
    )
    in_day = Window.partitionBy("equipment_id", "day").orderBy("second")
    days = (
        seconds.withColumn("gap", F.col("second") - F.lag("second").over(in_day))
        .groupBy("equipment_id", "day")
        .agg(
            F.min("second").alias("first_second"),
            F.max("second").alias("last_second"),
            F.max("gap").alias("gap_inside"),
            F.min("first_time").alias("first_time"),
            F.max("last_time").alias("last_time"),
        )
    )
    across_days = Window.partitionBy("equipment_id").orderBy("day")
    gap_before = F.col("first_second") - F.lag("last_second").over(across_days)
    return days.withColumn("gap_before", gap_before).agg(
        F.min("first_time").alias("min_timestamp"),
        F.max("last_time").alias("max_timestamp"),
        F.max(F.greatest("gap_inside", "gap_before", F.lit(0).cast("long"))).alias("max_gap_seconds"),
    )


def reading_ranges(sensor: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, min, max, negative_count) per reading column."""
    return rows_per_item(
        sensor,
        "column",
        {
            name: {
                "min": F.min(name).cast("double"),
                "max": F.max(name).cast("double"),
                "negative_count": F.count_if(F.col(name) < 0),
            }
            for name in columns or READING_COLUMNS
        },
    )


def reading_frequency(sensor: DataFrame) -> DataFrame:
    """Readings per machine and hour; the rate divides by the rounded span and is NULL for span 0."""
    span = (F.unix_timestamp("last_reading") - F.unix_timestamp("first_reading")) / 3600
    return (
        sensor.groupBy("equipment_id")
        .agg(
            F.count("*").alias("reading_count"),
            F.min("timestamp").alias("first_reading"),
            F.max("timestamp").alias("last_reading"),
        )
        .withColumn("time_span_hours", F.round(span, 2))
        .withColumn(
            "avg_readings_per_hour", F.round(safe_div(F.col("reading_count"), F.col("time_span_hours")), 2)
        )
    )


def reading_frequency_sample(sensor: DataFrame, n: int = 5) -> DataFrame:
    """The reading frequency of the first n machines by id."""
    return reading_frequency(sensor).orderBy("equipment_id").limit(n)


def verify_equipment_ids(sensor: DataFrame, equipment: DataFrame) -> DataFrame:
    """(side, equipment_id): ids of readings without specs, and spec rows without readings.

    Readings are reduced to distinct ids before either join, so a busy machine is one row.
    NULL never matches and is reported on its side.
    """
    sensor_ids = sensor.select("equipment_id").distinct()
    spec_ids = equipment.select("equipment_id")
    missing = sensor_ids.join(spec_ids, "equipment_id", "left_anti")
    extra = spec_ids.join(sensor_ids, "equipment_id", "left_anti")
    return missing.select(F.lit("missing").alias("side"), "equipment_id").unionByName(
        extra.select(F.lit("extra").alias("side"), "equipment_id")
    )


def equipment_ids_match(sensor: DataFrame, equipment: DataFrame) -> DataFrame:
    """(missing_count, extra_count, all_ids_match) as one row."""
    return (
        verify_equipment_ids(sensor, equipment)
        .agg(
            F.count_if(F.col("side") == "missing").alias("missing_count"),
            F.count_if(F.col("side") == "extra").alias("extra_count"),
        )
        .withColumn("all_ids_match", (F.col("missing_count") == 0) & (F.col("extra_count") == 0))
    )

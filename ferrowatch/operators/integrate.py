"""Integration of the four tables into one row per reading."""

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrowatch.schemas import INTEGRATED
from ferrowatch.sources.staging import stage


def normalise_sensor(sensor: DataFrame) -> DataFrame:
    return sensor.withColumn("timestamp", F.to_timestamp("timestamp"))


def normalise_maintenance(logs: DataFrame) -> DataFrame:
    return logs.withColumn("maintenance_date", F.to_timestamp("date")).drop("date")


def normalise_operational(operational: DataFrame) -> DataFrame:
    return operational.withColumn("operation_date", F.to_timestamp("date")).drop("date")


def with_specs(df: DataFrame, equipment: DataFrame) -> DataFrame:
    """Left join of the specifications on equipment_id."""
    return df.join(equipment, "equipment_id", "left")


def latest_maintenance(logs: DataFrame) -> DataFrame:
    """One row per machine: its newest log by maintenance_date, a NULL date being the oldest.

    Equal dates are decided by the remaining columns in order, so the choice is repeatable.
    The maximum of a struct combines before the shuffle; ranking each machine's logs would
    bring all logs of one machine into one task.
    """
    rest = [name for name in logs.columns if name not in ("equipment_id", "maintenance_date")]
    newest = F.max(F.struct("maintenance_date", *rest)).alias("newest")
    return (
        logs.groupBy("equipment_id")
        .agg(newest)
        .select("equipment_id", *[F.col(f"newest.{name}").alias(name) for name in rest + ["maintenance_date"]])
    )


def with_latest_maintenance(df: DataFrame, logs: DataFrame) -> DataFrame:
    """Left join of the machine's latest log, whether before or after the row's own time."""
    return df.join(latest_maintenance(logs), "equipment_id", "left")


def with_operational_day(df: DataFrame, operational: DataFrame, on: str = "timestamp") -> DataFrame:
    """Left join of the operational records of the same machine and calendar day.

    Several records of a day each give a row.
    """
    records = operational.withColumns(
        {"machine_of_record": F.col("equipment_id"), "day_of_record": F.to_date("operation_date")}
    ).drop("equipment_id")
    same_day = (F.col("equipment_id") == F.col("machine_of_record")) & (
        F.to_date(F.col(on)) == F.col("day_of_record")
    )
    return df.join(records, same_day, "left").drop("machine_of_record", "day_of_record")


def days_since_maintenance(df: DataFrame) -> DataFrame:
    """Add the days from the latest maintenance to the reading; negative if it came later."""
    return df.withColumn("days_since_maintenance", F.datediff("timestamp", "maintenance_date"))


def integrate_data(
    sensor: DataFrame,
    logs: DataFrame,
    equipment: DataFrame,
    operational: DataFrame,
    ordered: bool = False,
    written: bool = False,
) -> DataFrame:
    """Readings with specifications, latest maintenance and the day's operational records.

    The result is that of joining the readings with each table in turn, but the readings move
    once. The other tables are first joined to the distinct machine-days of the readings, a
    two-column frame that combines before its shuffle, and the readings then join that context
    on (machine, day). A machine with a large share of all readings is spread over its days,
    and where specifications and logs join on the machine alone it counts by days, not readings.
    Both sides of the last join come fresh from a shuffle, so AQE can split a single hot day.
    With `written` the context is, so what it shuffled is gone when the readings move.
    """
    sensor = normalise_sensor(sensor)
    day = F.to_date("timestamp")
    machine_days = (
        sensor.filter(F.col("equipment_id").isNotNull()).select("equipment_id", day.alias("day")).distinct()
    )
    # The distinct days are already spread by machine and day, as the first of these joins needs.
    context = with_operational_day(machine_days, normalise_operational(operational), on="day")
    context = with_specs(context, equipment)
    context = with_latest_maintenance(context, normalise_maintenance(logs))
    if written:
        context = stage(context, "machine_days")
    context = context.withColumnsRenamed({"equipment_id": "context_machine", "day": "context_day"})
    # Readings without a time still get specifications and maintenance, hence the null-safe day.
    same_machine_day = (F.col("equipment_id") == F.col("context_machine")) & F.to_date(
        F.col("timestamp")
    ).eqNullSafe(F.col("context_day"))
    joined = days_since_maintenance(sensor.join(context, same_machine_day, "left"))
    extra = [c for c in joined.columns if c not in INTEGRATED.names and not c.startswith("context_")]
    result = joined.select(*INTEGRATED.names, *extra)
    return order_for_output(result) if ordered else result


def integrate_recorded(
    sensor: DataFrame,
    logs: DataFrame,
    equipment: DataFrame,
    operational: DataFrame,
    join_machines: Callable[[DataFrame, DataFrame], DataFrame] = with_specs,
) -> DataFrame:
    """The rows of integrate_data whose machine has a specification and a record of the reading's day.

    Here the records lead to the machine-days. They join one frame of machines, with specifications and
    latest maintenance, and the readings join the result on (machine, day). No frame of machine-days is
    built, joined or moved. Both joins read both sides from a shuffle, so AQE can split a busy machine in
    the first and a hot day in the second. `join_machines` joins records and machines, and may correct the
    records by what it knows of a machine.
    """
    specified = equipment.withColumn("_specified", F.lit(True))
    machines = with_latest_maintenance(specified, normalise_maintenance(logs))
    records = join_machines(normalise_operational(operational), machines).filter("_specified").drop("_specified")
    joined = with_operational_day(normalise_sensor(sensor), records).filter(F.col("operation_date").isNotNull())
    joined = days_since_maintenance(joined)
    extra = [c for c in joined.columns if c not in INTEGRATED.names]
    return joined.select(*INTEGRATED.names, *extra)


def order_for_output(df: DataFrame) -> DataFrame:
    """Order by machine and time.

    The time lets the range shuffle split a busy machine, and the row's position in its
    partition lets it split copies of one reading.
    """
    position = df.withColumn("_position", F.monotonically_increasing_id())
    return position.orderBy("equipment_id", "timestamp", "_position").drop("_position")

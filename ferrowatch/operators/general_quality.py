"""Checks that hold for any table, and across the four tables."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrowatch.functions.expressions import is_nan, rows_per_item


def null_counts(df: DataFrame) -> DataFrame:
    """(column, null_count): NULL, and NaN in the numeric columns."""
    return rows_per_item(
        df,
        "column",
        {
            name: {"null_count": F.count_if(F.col(name).isNull() | is_nan(df, name))}
            for name in df.columns
        },
    )


def duplicate_counts(df: DataFrame) -> DataFrame:
    """(total, distinct, duplicates) of full rows; copies are combined before the shuffle."""
    return (
        df.groupBy(*df.columns)
        .agg(F.count("*").alias("copies"))
        .agg(F.coalesce(F.sum("copies"), F.lit(0)).alias("total"), F.count("*").alias("distinct"))
        .withColumn("duplicates", F.col("total") - F.col("distinct"))
    )


def unique_equipment_ids(df: DataFrame) -> DataFrame:
    """(unique_ids): distinct equipment ids, NULL counting as one; NULL if there is no such column."""
    if "equipment_id" not in df.columns:
        return df.agg(F.max(F.lit(None).cast("long")).alias("unique_ids"))
    return df.select("equipment_id").distinct().agg(F.count("*").alias("unique_ids"))


def _presence(sensor: DataFrame, logs: DataFrame, equipment: DataFrame, operational: DataFrame) -> DataFrame:
    tables = {"in_sensor": sensor, "in_maintenance": logs, "in_equipment": equipment, "in_operational": operational}
    tagged = None
    for name in tables:
        rows = tables[name].select("equipment_id", *[F.lit(other == name).alias(other) for other in tables])
        tagged = rows if tagged is None else tagged.unionByName(rows)
    return tagged.groupBy("equipment_id").agg(*[F.max(name).alias(name) for name in tables])


def equipment_id_consistency(
    sensor: DataFrame, logs: DataFrame, equipment: DataFrame, operational: DataFrame
) -> DataFrame:
    """(equipment_id): ids absent from at least one table; a NULL id is always reported.

    One grouped pass over the tagged ids; the tags combine before the shuffle.
    """
    present = F.col("in_sensor") & F.col("in_maintenance") & F.col("in_equipment") & F.col("in_operational")
    return (
        _presence(sensor, logs, equipment, operational)
        .filter(F.col("equipment_id").isNull() | ~present)
        .select("equipment_id")
    )


def equipment_id_totals(
    sensor: DataFrame, logs: DataFrame, equipment: DataFrame, operational: DataFrame
) -> DataFrame:
    """(total_ids, inconsistent_ids) as one row."""
    present = F.col("in_sensor") & F.col("in_maintenance") & F.col("in_equipment") & F.col("in_operational")
    return _presence(sensor, logs, equipment, operational).agg(
        F.count("*").alias("total_ids"),
        F.count_if(F.col("equipment_id").isNull() | ~present).alias("inconsistent_ids"),
    )

"""Checks of the maintenance logs."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrowatch.functions.expressions import counters
from ferrowatch.operators.equipment_quality import as_of_date, is_future


def flag_future_dates(logs: DataFrame, as_of) -> DataFrame:
    """Add is_future_date (false for NULL) and days_in_future (0 where not future)."""
    future = is_future("date", as_of)
    return logs.withColumns(
        {
            "is_future_date": F.coalesce(future, F.lit(False)),
            "days_in_future": F.when(future, F.datediff("date", as_of_date(as_of))).otherwise(0),
        }
    )


def future_records(logs: DataFrame, as_of) -> DataFrame:
    """The flagged rows that lie in the future."""
    return flag_future_dates(logs, as_of).filter("is_future_date")


def future_totals(logs: DataFrame, as_of) -> DataFrame:
    """(total_records, future_records) as one row."""
    return logs.agg(
        F.count("*").alias("total_records"), F.count_if(is_future("date", as_of)).alias("future_records")
    )


def category_counts(df: DataFrame, name: str, valid: list[str]) -> DataFrame:
    """(value, count, is_valid) per value; here NULL is a value, and an invalid one."""
    return (
        df.groupBy(F.col(name).alias("value"))
        .agg(F.count("*").alias("count"))
        .withColumn("is_valid", F.coalesce(F.col("value").isin(valid), F.lit(False)))
    )


def negative_counts(df: DataFrame, names: list[str]) -> DataFrame:
    """Values below zero per column; zero is allowed."""
    return counters(df, {f"negative_{name}": F.col(name) < 0 for name in names})


def _inconsistent_replacement() -> Column:
    no_part = F.col("parts_replaced").isNull() | (F.col("parts_replaced") == "")
    return (F.col("maintenance_type") == "Replacement") & no_part


def inconsistent_replacements(logs: DataFrame) -> DataFrame:
    """Replacements that name no part."""
    return counters(logs, {"inconsistent_replacements": _inconsistent_replacement()})


def maintenance_report(logs: DataFrame, as_of) -> DataFrame:
    """(check, violations): the counters of the log checks from one scan."""
    return counters(
        logs,
        {
            "future_dates": is_future("date", as_of),
            "null_technician_ids": F.col("technician_id").isNull(),
            "negative_duration_hours": F.col("duration_hours") < 0,
            "negative_cost": F.col("cost") < 0,
            "inconsistent_replacements": _inconsistent_replacement(),
        },
    )

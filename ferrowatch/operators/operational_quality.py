"""Checks and correction of the daily operational records."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrowatch.functions.expressions import any_of, counters, rows_per_item, safe_div
from ferrowatch.operators.equipment_quality import is_future, outside_domain
from ferrowatch.schemas import PRODUCT_TYPES, QUALITY_LEVELS

HOURS_PER_DAY = 24


def _total_hours() -> Column:
    return F.col("operating_hours") + F.col("downtime_hours")


def _outside(name: str, low: int, high: int) -> Column:
    return any_of([F.col(name) < low, F.col(name) > high])


def _invalid_hours() -> Column:
    return any_of(
        [F.col("operating_hours") < 0, F.col("downtime_hours") < 0, _total_hours() > HOURS_PER_DAY]
    )


def date_range(df: DataFrame, name: str, as_of) -> DataFrame:
    """(min_date, max_date, future_count)."""
    return df.agg(
        F.min(name).alias("min_date"),
        F.max(name).alias("max_date"),
        F.count_if(is_future(name, as_of)).alias("future_count"),
    )


def invalid_production_rates(operational: DataFrame) -> DataFrame:
    return counters(operational, {"invalid_production_rates": _outside("production_rate", 0, 100)})


def invalid_hours(operational: DataFrame) -> DataFrame:
    return counters(operational, {"invalid_hours": _invalid_hours()})


def invalid_ambient(operational: DataFrame) -> DataFrame:
    return counters(
        operational,
        {
            "invalid_temperatures": _outside("ambient_temperature", -50, 50),
            "invalid_humidity": _outside("ambient_humidity", 0, 100),
        },
    )


def _distinct_with_null(name: str) -> Column:
    """Distinct values with NULL counted as one value; 0 for an empty input."""
    return F.count_distinct(F.col(name)) + F.coalesce(F.max(F.col(name).isNull().cast("int")), F.lit(0))


def id_presence(df: DataFrame, name: str) -> DataFrame:
    """(null_count, unique_count); NULL counts as one of the unique values."""
    return df.agg(
        F.count_if(F.col(name).isNull()).alias("null_count"),
        _distinct_with_null(name).cast("long").alias("unique_count"),
    )


def validate_operational_data(operational: DataFrame, as_of) -> DataFrame:
    """(check, violations): all counters of the operational checks from one scan."""
    conditions = {
        "future_dates": is_future("date", as_of),
        "invalid_production_rates": _outside("production_rate", 0, 100),
        "invalid_hours": _invalid_hours(),
        "invalid_product_types": outside_domain("product_type", PRODUCT_TYPES),
        "invalid_quality_levels": outside_domain("raw_material_quality", QUALITY_LEVELS),
        "invalid_temperatures": _outside("ambient_temperature", -50, 50),
        "invalid_humidity": _outside("ambient_humidity", 0, 100),
        "null_operator_ids": F.col("operator_id").isNull(),
    }
    items = {check: {"violations": F.count_if(condition)} for check, condition in conditions.items()}
    items["unique_operator_ids"] = {"violations": _distinct_with_null("operator_id").cast("long")}
    return rows_per_item(operational, "check", items)


def hours_categories(operational: DataFrame) -> DataFrame:
    """(invalid_category, count) by the first rule that applies; NULL hours count as valid."""
    category = (
        F.when(F.col("operating_hours") < 0, "negative_operating")
        .when(F.col("downtime_hours") < 0, "negative_downtime")
        .when(_total_hours() > HOURS_PER_DAY, "exceeds_24")
        .when(_total_hours() == 0, "zero_hours")
        .otherwise("valid")
    )
    return operational.groupBy(category.alias("invalid_category")).agg(F.count("*").alias("count"))


def hours_stats(operational: DataFrame) -> DataFrame:
    """Minimum, maximum, mean and sample deviation of both hour columns, as one row."""
    aggregates = []
    for name, short in (("operating_hours", "operating"), ("downtime_hours", "downtime")):
        aggregates += [
            F.min(name).alias(f"min_{short}"),
            F.max(name).alias(f"max_{short}"),
            F.avg(name).alias(f"avg_{short}"),
            F.stddev_samp(name).alias(f"stddev_{short}"),
        ]
    return operational.agg(*aggregates)


def correct_invalid_hours(operational: DataFrame, machines: DataFrame | None = None) -> DataFrame:
    """Rescale days of more than 24 hours by the machine's mean share of operating hours.

    The mean takes in the invalid days and skips 0/0; without one the day is split 12/12.
    It is aggregated per machine and joined back: unlike a window over each machine, that
    combines before the shuffle, moves only the means when they fit a broadcast, and lets AQE
    split the records of a busy machine otherwise. NULL ids form one group, hence the
    null-safe join.

    With `machines`, only the records of these machines are given, with their columns. The means
    join the machines first, so the records move once for both, on the plain id.
    """
    share = safe_div(F.col("operating_hours"), _total_hours())
    means = operational.groupBy(F.col("equipment_id").alias("mean_of")).agg(F.avg(share).alias("share"))
    over = _total_hours() > HOURS_PER_DAY
    half = F.lit(HOURS_PER_DAY / 2)
    operating = F.coalesce(F.col("share") * HOURS_PER_DAY, half)
    # What is left of the day, so that a corrected day has exactly 24 hours.
    downtime = HOURS_PER_DAY - operating
    corrected = {
        "operating_hours": F.when(over, operating).otherwise(F.col("operating_hours")),
        "downtime_hours": F.when(over, downtime).otherwise(F.col("downtime_hours")),
    }
    if machines is None:
        joined = operational.join(means, F.col("equipment_id").eqNullSafe(F.col("mean_of")), "left")
        names = operational.columns
    else:
        machines = machines.join(means, F.col("equipment_id") == F.col("mean_of"), "left").drop("mean_of")
        joined = operational.join(machines, "equipment_id")
        names = [name for name in joined.columns if name != "share"]
    return joined.select([corrected[name].alias(name) if name in corrected else F.col(name) for name in names])


def correction_report(operational: DataFrame, as_of) -> DataFrame:
    """(phase, check, violations): the operational counters before and after the correction."""
    before = validate_operational_data(operational, as_of)
    after = validate_operational_data(correct_invalid_hours(operational), as_of)
    return _phases(before, after)


def hours_categories_report(operational: DataFrame) -> DataFrame:
    """(phase, invalid_category, count) before and after the correction."""
    return _phases(hours_categories(operational), hours_categories(correct_invalid_hours(operational)))


def hours_stats_report(operational: DataFrame) -> DataFrame:
    """The hour statistics before and after the correction."""
    return _phases(hours_stats(operational), hours_stats(correct_invalid_hours(operational)))


def _phases(before: DataFrame, after: DataFrame) -> DataFrame:
    return before.select(F.lit("before").alias("phase"), "*").unionByName(
        after.select(F.lit("after").alias("phase"), "*")
    )

"""Alert grading of the readings.

Each status is Normal, Warning or Danger by the first rule that applies. A NULL reading or
limit gives a NULL status, which the overall alert ignores. The rules compare NaN the usual
floating-point way, where every comparison with it is false; Spark orders NaN above all
numbers, so it is tested for first.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrowatch.functions.expressions import any_of, safe_div, shares, value_counts
from ferrowatch.schemas import ALERT_COLUMNS

# Alert thresholds.
RATED_DANGER_PCT = 90
RATED_WARNING_PCT = 80
POWER_WARNING, POWER_DANGER = 0.85, 0.95
NOISE_WARNING_LEVEL, NOISE_DANGER = 85, 0.97
CURRENT_WARNING, CURRENT_DANGER = 0.80, 0.90
NOMINAL_VOLTAGE = 220
VOLTAGE_NORMAL = (0.85, 1.15)
VOLTAGE_WARNING = (0.80, 1.20)
VISCOSITY_NORMAL = (30, 70)
VISCOSITY_WARNING = (25, 75)

LIMITED_READINGS = ["power_output", "noise_level", "current"]


def _graded(known: Column, rules: Column) -> Column:
    """The rules where all inputs are known, else NULL."""
    return F.when(known, rules)


def _share_of_rating(reading: str, rating: str) -> Column:
    pct = safe_div(F.col(reading), F.col(rating)) * 100
    rules = (
        F.when(F.isnan(pct), "Normal")
        .when(pct > RATED_DANGER_PCT, "Danger")
        .when(pct > RATED_WARNING_PCT, "Warning")
        .otherwise("Normal")
    )
    return _graded(pct.isNotNull(), rules)


def _rising(reading: str, low: Column, warning: Column, danger: Column) -> Column:
    """Normal in [low, warning], Warning in (warning, danger], Danger elsewhere."""
    value = F.col(reading)

    def at_most(a, b):
        return ~F.isnan(a) & ~F.isnan(b) & (a <= b)

    def below(a, b):
        return ~F.isnan(a) & ~F.isnan(b) & (a < b)

    rules = (
        F.when(at_most(low, value) & at_most(value, warning), "Normal")
        .when(below(warning, value) & at_most(value, danger), "Warning")
        .otherwise("Danger")
    )
    return _graded(value.isNotNull() & low.isNotNull() & danger.isNotNull(), rules)


def temperature_alert() -> Column:
    return _share_of_rating("temperature", "max_temperature")


def pressure_alert() -> Column:
    return _share_of_rating("pressure", "max_pressure")


def rotational_speed_alert() -> Column:
    return _share_of_rating("rotational_speed", "max_rotational_speed")


def power_output_alert(low: Column, high: Column) -> Column:
    return _rising("power_output", low, POWER_WARNING * high, POWER_DANGER * high)


def noise_level_alert(low: Column, high: Column) -> Column:
    return _rising("noise_level", low, F.lit(float(NOISE_WARNING_LEVEL)), NOISE_DANGER * high)


def current_alert(low: Column, high: Column) -> Column:
    return _rising("current", low, CURRENT_WARNING * high, CURRENT_DANGER * high)


def voltage_alert() -> Column:
    value = F.col("voltage")
    # The limits are products of doubles: 1.15 * 220 is slightly below 253.
    normal_low, normal_high = (F.lit(factor * NOMINAL_VOLTAGE) for factor in VOLTAGE_NORMAL)
    warning_low, warning_high = (F.lit(factor * NOMINAL_VOLTAGE) for factor in VOLTAGE_WARNING)
    rules = (
        F.when(F.isnan(value), "Danger")
        .when(value.between(normal_low, normal_high), "Normal")
        .when(value.between(warning_low, warning_high), "Warning")
        .otherwise("Danger")
    )
    return _graded(value.isNotNull(), rules)


def oil_viscosity_alert() -> Column:
    value = F.col("oil_viscosity")
    rules = (
        F.when(F.isnan(value) | value.between(*VISCOSITY_NORMAL), "Normal")
        .when(value.between(*VISCOSITY_WARNING), "Warning")
        .otherwise("Danger")
    )
    return _graded(value.isNotNull(), rules)


def alert_limits(df: DataFrame) -> DataFrame:
    """Table-wide minimum and maximum of power output, noise level and current, as one row."""
    return df.agg(
        *[
            bound
            for name in LIMITED_READINGS
            for bound in (F.min(name).alias(f"min_{name}"), F.max(name).alias(f"max_{name}"))
        ]
    )


def overall_alert() -> Column:
    """The worst of the eight statuses."""
    return (
        F.when(any_of([F.col(name).eqNullSafe("Danger") for name in ALERT_COLUMNS]), "Danger")
        .when(any_of([F.col(name).eqNullSafe("Warning") for name in ALERT_COLUMNS]), "Warning")
        .otherwise("Normal")
    )


def add_alerts(df: DataFrame, limits_from: DataFrame | None = None) -> DataFrame:
    """Add the eight statuses and the overall alert.

    The table-wide limits are a one-row scalar subquery of the same plan, taken from
    limits_from where the rows to grade are not the whole table.
    """
    limits = alert_limits(df if limits_from is None else limits_from)
    row = limits.select(F.struct("*")).scalar()

    def bounds(name):
        return F.col(f"_limits.min_{name}"), F.col(f"_limits.max_{name}")

    statuses = {
        "temperature_alert": temperature_alert(),
        "pressure_alert": pressure_alert(),
        "rotational_speed_alert": rotational_speed_alert(),
        "power_output_alert": power_output_alert(*bounds("power_output")),
        "noise_level_alert": noise_level_alert(*bounds("noise_level")),
        "voltage_alert": voltage_alert(),
        "current_alert": current_alert(*bounds("current")),
        "oil_viscosity_alert": oil_viscosity_alert(),
    }
    graded = df.withColumn("_limits", row).select(
        *df.columns, *[status.alias(name) for name, status in statuses.items()]
    )
    return graded.withColumn("alert", overall_alert())


def alert_percentages(df: DataFrame) -> DataFrame:
    """(alert, count, percentage decimal(5,2)) over all rows."""
    counts = df.groupBy("alert").agg(F.count("*").alias("count"))
    return counts.withColumn("percentage", shares(counts).cast("decimal(5,2)"))


def detailed_alert_percentages(df: DataFrame) -> DataFrame:
    """(alert_type, status, count, percentage decimal(5,2)) for the eight statuses in one pass."""
    counts = value_counts(df, ALERT_COLUMNS, "alert_type").withColumnRenamed("value", "status")
    return counts.withColumn("percentage", shares(counts, within="alert_type").cast("decimal(5,2)"))


def alert_sample(df: DataFrame, n: int = 10) -> DataFrame:
    """(equipment_id, alert) of the first n readings by machine and time."""
    return df.orderBy("equipment_id", "timestamp", "alert").select("equipment_id", "alert").limit(n)

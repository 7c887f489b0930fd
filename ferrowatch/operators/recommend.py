"""Maintenance need scored from alert, age, downtime, upkeep, environment and cost."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrowatch.functions.expressions import safe_div, shares, total_of, value_counts
from ferrowatch.operators.features import DAYS_PER_YEAR
from ferrowatch.schemas import NOT_REQUIRED, REQUIRED
from ferrowatch.sources.staging import stage

# Points and limits of the score.
ALERT_POINTS = {"Normal": 0, "Warning": 30, "Danger": 50}
CONDITION_POINTS = 10
AGE_SHARE = 0.65
DOWNTIME_SHARE = 0.05
WARRANTY_SHARE = 0.5
HOT_AMBIENT, HUMID_AMBIENT = 40, 60
COST_FACTOR = 1.5
REQUIRED_SCORE = 60

CONDITION_SCORES = [
    "age_condition_score",
    "downtime_condition_score",
    "maintenance_condition_score",
    "environment_condition_score",
    "maintenance_cost_condition_score",
]


def _points(condition: Column) -> Column:
    """Points where the condition holds; none where it is false or unknown."""
    return F.when(condition, CONDITION_POINTS).otherwise(0)


def _annual_cost() -> Column:
    return safe_div(F.col("cumulative_maintenance_cost"), F.col("warranty_period_years"))


def alert_score() -> Column:
    """Points by alert level; NULL for any other text."""
    score = None
    for level, points in ALERT_POINTS.items():
        branch = F.col("alert") == level
        score = F.when(branch, points) if score is None else score.when(branch, points)
    return score


def age_condition_score() -> Column:
    lifetime = F.col("expected_lifetime_years") * DAYS_PER_YEAR
    return _points(safe_div(F.col("equipment_age_days"), lifetime) >= AGE_SHARE)


def downtime_condition_score() -> Column:
    hours = F.col("operating_hours") + F.col("downtime_hours")
    return _points(safe_div(F.col("downtime_hours"), hours) > DOWNTIME_SHARE)


def maintenance_condition_score() -> Column:
    warranty = F.col("warranty_period_years") * DAYS_PER_YEAR
    return _points(safe_div(F.col("days_since_maintenance"), warranty) > WARRANTY_SHARE)


def environment_condition_score() -> Column:
    return _points((F.col("ambient_temperature") > HOT_AMBIENT) | (F.col("ambient_humidity") > HUMID_AMBIENT))


def criticality_avg_annual_cost(df: DataFrame) -> DataFrame:
    """(criticality, criticality_avg_annual_cost): mean running cost per warranty year."""
    return df.groupBy("criticality").agg(F.avg(_annual_cost()).alias("criticality_avg_annual_cost"))


def with_criticality_cost(df: DataFrame, averages: DataFrame | None = None) -> DataFrame:
    """Add the average of the row's criticality and the threshold above it; none for NULL."""
    averages = criticality_avg_annual_cost(df) if averages is None else averages
    # Written, so that Spark knows its size when it picks the join.
    averages = stage(averages, "criticality_cost")
    stale = [name for name in ("criticality_avg_annual_cost", "threshold") if name in df.columns]
    joined = df.drop(*stale).join(averages, "criticality", "left")
    kept = [name for name in df.columns if name not in stale]
    return joined.select(
        *kept,
        "criticality_avg_annual_cost",
        (COST_FACTOR * F.col("criticality_avg_annual_cost")).alias("threshold"),
    )


def maintenance_cost_condition_score() -> Column:
    return _points(_annual_cost() > F.col("threshold"))


def reading_scores(df: DataFrame) -> DataFrame:
    """Add the five scores that follow from the row alone; they need no running totals."""
    return df.withColumns(
        {
            "alert_score": alert_score(),
            "age_condition_score": age_condition_score(),
            "downtime_condition_score": downtime_condition_score(),
            "maintenance_condition_score": maintenance_condition_score(),
            "environment_condition_score": environment_condition_score(),
        }
    )


def score_maintenance(df: DataFrame, averages: DataFrame | None = None) -> DataFrame:
    """All scores and the need for maintenance, appended in the order of the stage schema."""
    return total_scores(reading_scores(df), averages)


def total_scores(df: DataFrame, averages: DataFrame | None = None) -> DataFrame:
    """The cost score, the sums and the need, from the scores of the readings and the running cost."""
    df = with_criticality_cost(df, averages)
    df = df.withColumn("maintenance_cost_condition_score", maintenance_cost_condition_score())
    df = df.withColumn("operational_score", total_of(CONDITION_SCORES))
    df = df.withColumn("total_score", total_of(["alert_score", "operational_score"]))
    return df.withColumn("maintenance_needed", maintenance_needed())


def maintenance_needed() -> Column:
    """Required from the limit on; not required below it or for an unknown score."""
    return F.when(F.col("total_score") >= REQUIRED_SCORE, REQUIRED).otherwise(NOT_REQUIRED)


def score_distribution(df: DataFrame) -> DataFrame:
    """(column, value, count, percentage) of the seven scores.

    A NULL score has count 0; the percentage is of all rows.
    """
    columns = CONDITION_SCORES + ["operational_score", "alert_score"]
    counts = value_counts(df, columns)
    known = F.col("value").isNotNull()
    return counts.withColumn("percentage", shares(counts, within="column")).select(
        "column",
        "value",
        F.when(known, F.col("count")).otherwise(0).alias("count"),
        F.when(known, F.col("percentage")).otherwise(0.0).alias("percentage"),
    ).orderBy("column", "value")


def maintenance_percentages(df: DataFrame) -> DataFrame:
    """(maintenance_needed, count, percentage) over all rows."""
    counts = df.groupBy("maintenance_needed").agg(F.count("*").alias("count"))
    return counts.withColumn("percentage", shares(counts))

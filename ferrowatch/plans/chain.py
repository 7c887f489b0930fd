"""The stages from the four tables to the part to service, in order.

Stages pass frames. Where several passes over a stage follow (running totals, label counts,
table-wide limits, averages and thresholds) the stage is written once to the shared folder:
each pass then reads its few columns of that table instead of repeating every join before it.
"""

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ferrowatch import schemas
from ferrowatch.operators import (
    alerts,
    encoding,
    features,
    integrate,
    items,
    operational_quality,
    profile,
    recommend,
)
from ferrowatch.sources.staging import stage


def integrated(tables, written: bool = False) -> DataFrame:
    """All four tables in one row per reading, with the operational hours corrected.

    With `written`, corrected records and machine-days are, each without what it took to make them.
    """
    operational = operational_quality.correct_invalid_hours(tables.operational)
    if written:
        operational = stage(operational, "corrected_hours")
    return integrate.integrate_data(
        tables.sensor, tables.maintenance, tables.equipment, operational, written=written
    )


def cleaned(tables) -> DataFrame:
    """Readings from the installation on, without missing values.

    Readings without a specification or a record of their day have missing values; the others are enough.
    No reading of a day before the installation is valid: that is tested on the day's record too, before
    it is joined to the readings. Hours are corrected in the join that brings a record its machine.
    """
    correct = operational_quality.correct_invalid_hours
    readings = integrate.integrate_recorded(
        tables.sensor, tables.maintenance, tables.equipment, tables.operational, join_machines=correct
    )
    readings = readings.filter(F.to_date("operation_date") >= F.to_date("installation_date"))
    readings = profile.valid_readings(readings)
    own = {*schemas.SENSOR.names, "days_since_maintenance"}
    return profile.drop_missing(readings, one_by_one=[name for name in readings.columns if name not in own])


def engineered(tables) -> DataFrame:
    """Cleaned readings with the derived features; the cleaned table is written."""
    return features.feature_engineering(stage(cleaned(tables), "cleaned"))


def featured(tables) -> DataFrame:
    """Engineered readings with the encoded categories, for one pass; of wide tables only the cleaned one is written."""
    return _featured(stage(cleaned(tables), "cleaned"))


def _featured(readings: DataFrame) -> DataFrame:
    """Features leave the categories as they are, so the codes come from the cleaned readings."""
    return _encoded(features.feature_engineering(readings, written=True), readings)


def _encoded(engineered: DataFrame, readings: DataFrame) -> DataFrame:
    return encoding.label_encode(engineered, mapping=encoding.label_mapping(readings))


def alerted(tables) -> DataFrame:
    """Graded readings, likewise: features leave the readings, and so the limits, as they are."""
    readings = stage(cleaned(tables), "cleaned")
    return alerts.add_alerts(_featured(readings), limits_from=readings)


def _featured_for_passes(tables) -> DataFrame:
    """Engineered readings, written, with the encoded categories."""
    readings = stage(cleaned(tables), "cleaned")
    return _encoded(stage(features.feature_engineering(readings, written=True), "engineered"), readings)


def scored(tables) -> DataFrame:
    return recommend.score_maintenance(alerts.add_alerts(_featured_for_passes(tables)))


def itemised(tables) -> DataFrame:
    """Scored readings with the part to service.

    The thresholds use readings only, so they are taken from the written table and grading,
    scores and items are one projection over it.
    """
    readings = _featured_for_passes(tables)
    graded = recommend.score_maintenance(alerts.add_alerts(readings))
    return items.assign_items(graded, thresholds_from=readings)


# What grading reads; and what the scores of a reading are made from.
GRADING_COLUMNS = [
    "equipment_id",
    "timestamp",
    *schemas.READING_COLUMNS,
    "max_temperature",
    "max_pressure",
    "max_rotational_speed",
]
SCORING_COLUMNS = [
    *[name for name in GRADING_COLUMNS if name != "vibration"],
    "installation_date",
    "criticality",
    "expected_lifetime_years",
    "warranty_period_years",
    "operating_hours",
    "downtime_hours",
    "ambient_temperature",
    "ambient_humidity",
    "days_since_maintenance",
    "cost",
]
# What is left of them once a reading has its scores: the key, and what the running cost is compared with.
RATING_COLUMNS = [
    "equipment_id",
    "timestamp",
    "criticality",
    "warranty_period_years",
    "alert",
    "alert_score",
    "age_condition_score",
    "downtime_condition_score",
    "maintenance_condition_score",
    "environment_condition_score",
    "cumulative_maintenance_cost",
]
# What pointing at parts reads.
PART_COLUMNS = list(dict.fromkeys(["parts_replaced", *[name for own in items.SIGNALS.values() for name in own]]))


def graded(tables) -> DataFrame:
    """Alerts of the cleaned readings, from a stage of the columns that grading reads."""
    return alerts.add_alerts(stage(cleaned(tables).select(*GRADING_COLUMNS), "graded_readings"))


def scoring_cleaned(tables, columns: Sequence[str]) -> DataFrame:
    """Cleaned readings, written with what scores are made from and those of `columns` that they have."""
    besides = [name for name in columns if name in schemas.INTEGRATED.names]
    return stage(cleaned(tables).select(*dict.fromkeys([*SCORING_COLUMNS, *besides])), "scoring_cleaned")


def scoring_readings(tables, kept: Sequence[str] = ()) -> DataFrame:
    """Readings with their own scores and the running cost, and the columns `kept`, written.

    All that follows from a reading alone is taken before the running totals move the rows, so few and
    small columns move.
    """
    return _scoring_readings(scoring_cleaned(tables, kept), kept)


def _scoring_readings(readings: DataFrame, kept: Sequence[str], pointed: bool = False) -> DataFrame:
    aged = features.abs_days_since_maintenance(features.equipment_age_days(readings))
    scores = recommend.reading_scores(alerts.add_alerts(aged, limits_from=readings))
    if pointed:
        scores = items.point_at_parts(scores, thresholds_from=readings)
    columns = dict.fromkeys([*RATING_COLUMNS, *kept, *(["pointed_part"] if pointed else [])])
    moved = [name for name in dict.fromkeys([*columns, "cost", "operating_hours"]) if not name.startswith("cumulative_")]
    return stage(features.cumulative_totals(scores.select(*moved)).select(*columns), "scoring_readings")


def rated(tables, kept: Sequence[str] = ()) -> DataFrame:
    """Scores of the readings and the columns `kept`, without those that nothing reads any more."""
    return recommend.total_scores(scoring_readings(tables, kept))


def assigned(tables, kept: Sequence[str] = ()) -> DataFrame:
    """Items of the readings, likewise."""
    return assigned_to(scoring_cleaned(tables, [*PART_COLUMNS, *kept]), kept)


def assigned_to(readings: DataFrame, kept: Sequence[str] = ()) -> DataFrame:
    """Items of given cleaned readings."""
    scores = recommend.total_scores(_scoring_readings(readings, kept, pointed=True))
    return items.assign_items(scores)

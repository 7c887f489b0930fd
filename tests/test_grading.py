from datetime import datetime

import pytest
from pyspark.sql import functions as F

from ferrowatch import schemas
from ferrowatch.operators import alerts, items, recommend

NAN = float("nan")


def _status(make, expression, column, values):
    df = make([(i, v) for i, v in enumerate(values)], f"i int, {column} double")
    return [r[0] for r in df.select("i", expression.alias("status")).orderBy("i").select("status").collect()]


def test_share_of_rating(make):
    rows = [(90.0, 100.0), (90.1, 100.0), (80.0, 100.0), (80.1, 100.0), (NAN, 100.0), (None, 100.0), (1.0, 0.0)]
    df = make(rows, "temperature double, max_temperature double").coalesce(1)
    result = [r[0] for r in df.select(alerts.temperature_alert()).collect()]
    assert result == ["Warning", "Danger", "Normal", "Warning", "Normal", None, None]


def test_power_output(make):
    status = alerts.power_output_alert(F.lit(10.0), F.lit(100.0))
    values = [10.0, 85.0, 85.1, 95.0, 95.1, 9.9, NAN, None]
    expected = ["Normal", "Normal", "Warning", "Warning", "Danger", "Danger", "Danger", None]
    assert _status(make, status, "power_output", values) == expected


def test_noise_level_with_a_nan_limit(make):
    status = alerts.noise_level_alert(F.lit(10.0), F.lit(NAN))
    assert _status(make, status, "noise_level", [85.0, 86.0, NAN]) == ["Normal", "Danger", "Danger"]
    status = alerts.noise_level_alert(F.lit(10.0), F.lit(100.0))
    assert _status(make, status, "noise_level", [85.0, 85.1, 97.0, 97.1, 9.0]) == [
        "Normal",
        "Warning",
        "Warning",
        "Danger",
        "Danger",
    ]


def test_voltage(make):
    values = [187.0, 1.15 * 220, 253.0, 186.9, 176.0, 175.9, 264.0, 264.1, NAN, None]
    expected = ["Normal", "Normal", "Warning", "Warning", "Warning", "Danger", "Warning", "Danger", "Danger", None]
    assert _status(make, alerts.voltage_alert(), "voltage", values) == expected


def test_current(make):
    status = alerts.current_alert(F.lit(1.0), F.lit(10.0))
    assert _status(make, status, "current", [1.0, 8.0, 8.1, 9.0, 9.1, 0.5]) == [
        "Normal",
        "Normal",
        "Warning",
        "Warning",
        "Danger",
        "Danger",
    ]


def test_oil_viscosity(make):
    values = [24.9, 25.0, 29.9, 30.0, 70.0, 70.1, 75.0, 75.1, NAN, None]
    expected = ["Danger", "Warning", "Warning", "Normal", "Normal", "Warning", "Warning", "Danger", "Normal", None]
    assert _status(make, alerts.oil_viscosity_alert(), "oil_viscosity", values) == expected


def test_overall_alert_is_the_worst_and_ignores_null(make):
    names = ", ".join(f"{c} string" for c in schemas.ALERT_COLUMNS)
    normal = ["Normal"] * 8
    rows = [normal, normal[:7] + ["Danger"], ["Warning"] + normal[:7], [None] * 8, ["Warning", "Danger"] + [None] * 6]
    df = make([tuple(r) for r in rows], names).coalesce(1)
    assert [r[0] for r in df.select(alerts.overall_alert()).collect()] == [
        "Normal",
        "Danger",
        "Warning",
        "Normal",
        "Danger",
    ]


def test_alert_percentages(make, rows_of):
    df = make([("Normal",)] * 2 + [("Danger",)], "alert string")
    assert [(a, n, float(p)) for a, n, p in rows_of(alerts.alert_percentages(df))] == [
        ("Danger", 1, 33.33),
        ("Normal", 2, 66.67),
    ]


SCORE_COLUMNS = (
    "i int, alert string, equipment_age_days int, expected_lifetime_years double, downtime_hours double, "
    "operating_hours double, days_since_maintenance int, warranty_period_years int, ambient_temperature double, "
    "ambient_humidity double, cumulative_maintenance_cost double, criticality string"
)


def test_scores_at_their_limits(make):
    rows = [
        (0, "Danger", 949, 4.0, 1.0, 19.0, 365, 2, 40.0, 60.0, 10.0, "Low"),
        (1, "Warning", 948, 4.0, 1.0, 18.0, 366, 2, 40.5, 60.0, 100.0, "Low"),
        (2, "odd", None, None, 0.0, 0.0, 10, 0, None, 61.0, 5.0, None),
    ]
    result = {r["i"]: r for r in recommend.score_maintenance(make(rows, SCORE_COLUMNS)).collect()}
    first, second, third = result[0], result[1], result[2]
    assert [first[c] for c in recommend.CONDITION_SCORES] == [10, 0, 0, 0, 0]
    assert [second[c] for c in recommend.CONDITION_SCORES] == [0, 10, 10, 10, 10]
    assert first["criticality_avg_annual_cost"] == pytest.approx(27.5)
    assert (first["total_score"], first["maintenance_needed"]) == (60, schemas.REQUIRED)
    assert (second["total_score"], second["maintenance_needed"]) == (70, schemas.REQUIRED)
    assert (third["alert_score"], third["total_score"], third["threshold"]) == (None, None, None)
    assert (third["environment_condition_score"], third["maintenance_needed"]) == (10, schemas.NOT_REQUIRED)


def test_distribution_shows_null_without_count(make):
    columns = recommend.CONDITION_SCORES + ["operational_score", "alert_score"]
    df = make([(0,) * 6 + (30,), (0,) * 6 + (None,)], ", ".join(f"{c} int" for c in columns))
    rows = recommend.score_distribution(df).collect()
    found = {(r["column"], r["value"]): (r["count"], r["percentage"]) for r in rows}
    assert found["alert_score", None] == (0, 0.0)
    assert found["alert_score", 30] == (1, 50.0)
    assert found["operational_score", 0] == (2, 100.0)


SIGNAL_COLUMNS = [
    "vibration",
    "noise_level",
    "temperature",
    "current",
    "power_output",
    "rotational_speed",
    "pressure",
    "oil_viscosity",
]
ITEM_COLUMNS = (
    "i int, parts_replaced string, maintenance_needed string, maintenance_type string, equipment_id int, "
    + ", ".join(f"{c} double" for c in SIGNAL_COLUMNS)
)


@pytest.fixture(scope="module")
def itemised(make):
    calm = [1.0] * 8
    hot = [1.0, 1.0, 3.0] + [1.0] * 5
    rows = [
        ("Motor", True, hot),
        ("Motor", True, calm),
        ("Motor", False, hot),
        ("Bearings", True, hot),
        ("Bearings", True, calm),
        ("Seals", True, hot),
        ("Seals", True, calm),
        ("Filters", True, hot),
        ("None", True, hot),
        (None, True, calm),
    ]
    needed = {True: schemas.REQUIRED, False: schemas.NOT_REQUIRED}
    df = make([(i, part, needed[n], "Repair", 1, *v) for i, (part, n, v) in enumerate(rows)], ITEM_COLUMNS)
    return items.assign_items(df)


def test_items_follow_part_and_threshold(itemised):
    found = [r["maintenance_item"] for r in itemised.orderBy("i").collect()]
    expected = ["Motor", "Coupling", None, "Bearings", "Coupling", "Seals", "Coupling", "Filters"]
    assert found == expected + ["Coupling", "Coupling"]
    assert items.unassigned_count(itemised).first()["unassigned"] == 0
    assert items.item_inspection(itemised, "Motor").count() == 9
    assert items.item_inspection(itemised, "Filters").count() == 1
    shares = {r["maintenance_item"]: r["percentage"] for r in items.item_percentages(itemised).collect()}
    assert shares["Coupling"] == pytest.approx(500 / 9)


def test_threshold_is_the_lower_or_the_known(make):
    df = make([(0, "Motor", "x", "Repair", 1, *[float(v)] * 8) for v in (1, 2)], ITEM_COLUMNS)
    rows = {(r["item"], r["signal"]): r for r in items.item_thresholds(df).collect()}
    deviation = 0.5**0.5
    assert rows["Motor", "vibration"]["threshold"] == pytest.approx(1.5)
    assert rows["Motor", "power_output"]["threshold"] == pytest.approx(1.5 - 3 * deviation)
    assert rows["Seals", "temperature"]["hist"] is None
    assert rows["Seals", "temperature"]["threshold"] == pytest.approx(1.5 + 3 * deviation)
    own = {(r["item"], r["signal"]): r["hist"] for r in items.history_thresholds(df, filters_history="Motor").collect()}
    assert own["Filters", "pressure"] == pytest.approx(1.5)


def test_single_row_has_no_deviation(make):
    df = make([(0, "Motor", "x", "Repair", 1, *[2.0] * 8)], ITEM_COLUMNS)
    row = items.item_thresholds(df).filter("item = 'Motor' and signal = 'vibration'").first()
    assert (row["stat"], row["threshold"]) == (None, 2.0)


def test_items_of_parts_pointed_at_before_the_need_is_known(make, rows_of):
    signals = list(dict.fromkeys(name for own in items.SIGNALS.values() for name in own))
    rows = [
        (n, parts, *[float(n * k % 7) if n % 5 else None for k in range(1, len(signals) + 1)])
        for n, parts in enumerate([*items.SIGNALS, "None", None] * 6)
    ]
    readings = make(rows, f"n int, parts_replaced string, {', '.join(f'{name} double' for name in signals)}")
    needs = F.expr("CASE n % 3 WHEN 0 THEN 'Maintenance required' WHEN 1 THEN 'No maintenance required' END")
    late = items.assign_items(readings.withColumn("maintenance_needed", needs))
    early = items.assign_items(items.point_at_parts(readings).withColumn("maintenance_needed", needs))
    assert early.columns == late.columns and rows_of(early) == rows_of(late)
    found = {row["maintenance_item"] for row in late.collect()}
    assert {None, items.REMAINING_ITEM} < found

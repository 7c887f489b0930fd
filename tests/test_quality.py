from datetime import datetime

import pytest

from ferrowatch import schemas
from ferrowatch.operators import (
    equipment_quality,
    general_quality,
    maintenance_quality,
    operational_quality,
    sensor_quality,
)

NAN, INF = float("nan"), float("inf")


def at(text):
    return datetime.fromisoformat(text)


def test_gaps_across_days_hours_and_equal_times(make):
    times = {
        1: ["2024-01-01 23:00:00", "2024-01-02 01:00:00", "2024-01-02 01:00:00", "2024-01-09 00:00:00"],
        2: ["2024-01-01 00:00:00", "2024-01-01 20:00:00.900000", "2024-01-01 20:00:01.100000"],
        None: ["2024-01-01 00:00:00", "2024-01-20 00:00:00"],
    }
    rows = [(machine, at(t)) for machine, moments in times.items() for t in moments] + [(3, None)]
    df = make(rows, "equipment_id int, timestamp timestamp")
    row = sensor_quality.timestamp_continuity(df).first()
    assert row["max_gap_seconds"] == 19 * 86_400
    assert row["min_timestamp"] == at("2024-01-01 00:00:00")
    row = sensor_quality.timestamp_continuity(df.filter("equipment_id = 1")).first()
    assert row["max_gap_seconds"] == 6 * 86_400 + 23 * 3600
    assert sensor_quality.timestamp_continuity(df.filter("equipment_id = 3")).first()["max_gap_seconds"] == 0
    assert sensor_quality.timestamp_continuity(df.filter("false")).first()["max_gap_seconds"] is None


def test_single_reading_has_no_rate(make):
    df = make([(1, at("2024-01-01"))], "equipment_id int, timestamp timestamp")
    row = sensor_quality.reading_frequency(df).first()
    assert (row["time_span_hours"], row["avg_readings_per_hour"]) == (0.0, None)


def test_equipment_ids_report_null_and_repeated_specs(make, rows_of):
    sensor = make([(1,), (1,), (None,), (3,)], "equipment_id int")
    specs = make([(1,), (2,), (2,), (None,)], "equipment_id int")
    assert rows_of(sensor_quality.verify_equipment_ids(sensor, specs)) == [
        ("extra", None),
        ("extra", 2),
        ("extra", 2),
        ("missing", None),
        ("missing", 3),
    ]
    assert tuple(sensor_quality.equipment_ids_match(sensor, specs).first()) == (2, 3, False)
    same = make([(1,)], "equipment_id int")
    assert sensor_quality.equipment_ids_match(same, same).first()["all_ids_match"] is True


def test_spec_limits_are_inclusive_and_ignore_null(make, rows_of):
    columns = "max_temperature double, max_pressure double, max_rotational_speed double"
    df = make([(1000.0, 10000.0, 100000.0), (0.0, 10000.1, -1.0), (None, None, None)], columns)
    assert rows_of(equipment_quality.spec_limit_issues(df)) == [
        ("max_pressure_issues", 1),
        ("max_rotational_speed_issues", 1),
        ("max_temperature_issues", 1),
    ]
    periods = make([(100.0, 50), (100.5, 51), (0.0, 0)], "expected_lifetime_years double, warranty_period_years int")
    assert {row["violations"] for row in equipment_quality.period_issues(periods).collect()} == {2}


def test_later_today_is_future_with_zero_days(make):
    dates = [at("2024-05-01 00:00:00"), at("2024-05-01 08:00:00"), at("2024-05-03"), None]
    logs = make([(date,) for date in dates], "date timestamp")
    flagged = maintenance_quality.flag_future_dates(logs, "2024-05-01").orderBy("date")
    assert [(r["is_future_date"], r["days_in_future"]) for r in flagged.collect()] == [
        (False, 0),
        (False, 0),
        (True, 0),
        (True, 2),
    ]


def test_categories_treat_null_by_rule(make, rows_of):
    df = make([("High",), ("Odd",), (None,)], "criticality string")
    outside = equipment_quality.invalid_categories(df, "criticality", schemas.CRITICALITIES)
    assert outside.first()["violations"] == 1
    counts = maintenance_quality.category_counts(df, "criticality", schemas.CRITICALITIES)
    assert rows_of(counts) == [(None, 1, False), ("High", 1, True), ("Odd", 1, False)]


def test_id_presence_counts_null_as_a_value(make):
    presence = operational_quality.id_presence(make([(1,), (1,), (2,), (None,)], "id int"), "id")
    assert tuple(presence.first()) == (1, 3)
    empty = operational_quality.id_presence(make([], "id int"), "id")
    assert tuple(empty.first()) == (0, 0)


HOURS = "equipment_id int, operating_hours double, downtime_hours double"


def test_hours_categories_use_the_first_rule(make, rows_of):
    df = make(
        [(1, -1.0, -1.0), (1, 1.0, -1.0), (1, 20.0, 5.0), (1, 0.0, 0.0), (1, 20.0, 4.0), (1, None, 1.0)], HOURS
    )
    assert rows_of(operational_quality.hours_categories(df)) == [
        ("exceeds_24", 1),
        ("negative_downtime", 1),
        ("negative_operating", 1),
        ("valid", 2),
        ("zero_hours", 1),
    ]


def test_correction_rescales_only_days_above_24(make):
    rows = [
        (1, 20.0, 10.0),
        (1, 12.0, 4.0),
        (1, 0.0, 0.0),
        (2, 24.0, 2.0),
        (None, 30.0, 10.0),
        (3, None, 4.0),
    ]
    before = make(rows, HOURS)
    after = operational_quality.correct_invalid_hours(before)
    assert after.columns == before.columns
    share = (20 / 30 + 12 / 16) / 2
    result = {(r[0], i): r[1:] for i, r in enumerate(sorted(map(tuple, after.collect()), key=str))}
    values = sorted(result.values(), key=str)
    assert len(values) == len(rows)
    assert pytest.approx((share * 24, (1 - share) * 24)) in [v for v in values if None not in v]
    assert (12.0, 4.0) in values and (0.0, 0.0) in values and (None, 4.0) in values
    corrected_null = [tuple(r)[1:] for r in after.filter("equipment_id is null").collect()]
    assert corrected_null == [pytest.approx((18.0, 6.0))]
    totals = [sum(v) for v in values if None not in v]
    assert all(total <= 24 + 1e-9 for total in totals)


def test_null_counts_know_nan(make, rows_of):
    df = make([(1.0, "a"), (NAN, None), (None, "")], "x double, s string")
    assert rows_of(general_quality.null_counts(df)) == [("s", 1), ("x", 2)]


def test_duplicates_and_missing_id_column(make):
    df = make([(1, None), (1, None), (1, "a")], "equipment_id int, s string")
    assert tuple(general_quality.duplicate_counts(df).first()) == (3, 2, 1)
    assert tuple(general_quality.duplicate_counts(df.filter("false")).first()) == (0, 0, 0)
    assert general_quality.unique_equipment_ids(df.select("s")).first()["unique_ids"] is None


def test_id_consistency_always_reports_null(make, rows_of):
    ids = lambda *values: make([(v,) for v in values], "equipment_id int")
    tables = ids(1, 1, None), ids(1, 2, None), ids(1, 2, None), ids(1, 2, 3, None)
    assert rows_of(general_quality.equipment_id_consistency(*tables)) == [(None,), (2,), (3,)]
    assert tuple(general_quality.equipment_id_totals(*tables).first()) == (4, 3)


def test_inconsistent_replacements(make):
    rows = [("Replacement", None), ("Replacement", ""), ("Replacement", "None"), ("Repair", None), (None, None)]
    df = make(rows, "maintenance_type string, parts_replaced string")
    assert maintenance_quality.inconsistent_replacements(df).first()["violations"] == 2

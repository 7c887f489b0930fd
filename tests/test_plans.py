"""Properties of the physical plans that matter at scale."""

import inspect
import re
import time
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from ferrowatch.operators import alerts, encoding, features, integrate, items, profile, sensor_quality
from ferrowatch.plans import catalogue, chain
from ferrowatch.sources import staging
from ferrowatch.sources.projections import DomainTables
from ferrowatch.sources.staging import stage
from ferrowatch.sources.tables import read_table, write_table

DIRECTORY = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark):
    return DomainTables(spark, DIRECTORY)


@pytest.fixture(scope="module")
def cleaned(tables):
    return stage(chain.cleaned(tables), "cleaned")


@pytest.fixture
def without_broadcast(spark):
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, "-1")
    yield
    spark.conf.set(name, before)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_readings_move_once_when_nothing_fits_a_broadcast(tables, without_broadcast):
    plan = plan_of(integrate.integrate_data(tables.sensor, tables.maintenance, tables.equipment, tables.operational))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
    # The readings are the topmost left side: one exchange above their scan, by machine and day.
    top = plan[: plan.index("FileScan")]
    assert top.count("Exchange hashpartitioning") == 1
    assert re.search(r"Exchange hashpartitioning\(equipment_id#\d+, coalesce\(cast\(timestamp", top)


def test_no_python_and_no_window_over_rows_of_a_machine(cleaned):
    graded = alerts.add_alerts(features.feature_engineering(cleaned))
    plan = plan_of(graded)
    assert "Python" not in plan
    assert "BatchEval" not in plan
    # Windows over a machine alone are ordered by hour, that is, over hourly totals.
    windows = re.findall(r"Window \[.*\], \[(_machine#\d+L?)\], \[(\w+)#", plan)
    assert windows and all(order == "_hour" for _, order in windows)


def test_running_totals_shuffle_plain_keys_few_times(cleaned, without_broadcast):
    plan = plan_of(features.cumulative_totals(cleaned))
    keys = re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)
    # Twice for the sums to join, once for moments, hours, a machine's hours and an hour's moments.
    assert len(keys) == 6 and "isnull" not in str(keys) and "coalesce" not in str(keys)


def test_moments_of_numbers_need_no_row_per_value(cleaned):
    numbers = cleaned.select(*profile.numeric_columns(cleaned))
    for frame in (profile.summary_stats(numbers), profile.outlier_counts(numbers)):
        plan = plan_of(frame)
        assert "Expand" not in plan and "Join" not in plan
        assert "description" not in plan


@pytest.mark.parametrize("name", ["metrics_on_rule", "confusion_on_rule", "alerts"])
def test_grading_queries_join_nothing_and_read_few_columns(spark, name):
    plan = plan_of(catalogue.queries()[name](spark, DIRECTORY))
    assert "Join" not in plan
    assert all("description" not in schema for schema in re.findall(r"ReadSchema: \S+", plan))


@pytest.mark.parametrize("name", ["score_distribution", "item_percentages", "required_rows", "motor_inspection"])
def test_scores_and_items_neither_encode_nor_carry_all_columns(spark, name, monkeypatch):
    monkeypatch.setattr(encoding, "label_encode", None)
    staged = []
    monkeypatch.setattr(chain, "stage", lambda df, label: staged.append(len(df.columns)) or stage(df, label))
    plan = plan_of(catalogue.queries()[name](spark, DIRECTORY))
    assert max(staged) < 32 and "_encoded" not in plan


@pytest.mark.parametrize(
    "name, written", [("label_encoded_featured", {"cleaned"}), ("alert_features", {"cleaned"}), ("item_features", set())]
)
def test_one_pass_over_features_or_items_writes_no_second_table(spark, name, written, monkeypatch):
    staged = []
    for module in (chain, catalogue):
        monkeypatch.setattr(module, "stage", lambda df, label: staged.append(label) or stage(df, label))
    catalogue.queries()[name](spark, DIRECTORY)
    assert set(staged) - {"scoring_cleaned", "scoring_readings"} == written


def test_codes_and_limits_of_cleaned_readings_are_those_of_engineered_ones(cleaned, rows_of):
    engineered = features.feature_engineering(cleaned)
    assert rows_of(encoding.label_mapping(engineered)) == rows_of(encoding.label_mapping(cleaned))
    assert rows_of(alerts.alert_limits(engineered)) == rows_of(alerts.alert_limits(cleaned))


def test_labels_are_ranked_without_a_window_over_a_column(cleaned, without_broadcast):
    plan = plan_of(encoding.label_mapping(cleaned))
    windows = re.findall(r"Window \[.*?\], \[(\w*)#?\d*", plan)
    assert windows and "column" not in windows


def test_no_label_comes_to_the_driver_for_encoding():
    source = inspect.getsource(encoding) + inspect.getsource(catalogue)
    assert "StringIndexer" not in source and "collect()" not in inspect.getsource(encoding)


def test_release_deletes_what_was_staged(spark):
    staged = stage(spark.range(3), "released")
    assert staged.count() == 3
    folders = {file.rpartition("/")[0] for file in staged.inputFiles()}
    held = staging._written[:-1]
    staging._written[:] = staging._written[-1:]
    assert staging.release(spark) == 1
    staging._written[:] = held
    assert not any(Path(folder.removeprefix("file://").removeprefix("file:")).exists() for folder in folders)


def test_range_sort_can_split_copies(cleaned):
    plan = plan_of(integrate.order_for_output(cleaned))
    keys = r"equipment_id#\d+ ASC NULLS FIRST, timestamp#\d+ ASC NULLS FIRST, _position"
    assert re.search(rf"rangepartitioning\({keys}", plan)


def test_cleaning_moves_records_to_machines_and_readings_to_records_only(tables, without_broadcast):
    plan = plan_of(chain.cleaned(tables))
    # Means of hours to records, latest logs to specifications, both to records, and records to readings.
    assert plan.count("SortMergeJoin") == 4


@pytest.mark.parametrize(
    "name, most",
    [
        ("scores", 11),
        ("need_flags", 11),
        ("need_split_sizes", 11),
        ("unassigned_items", 12),
        ("items", 13),
        ("filters_inspection", 17),
    ],
)
def test_running_totals_move_scores_instead_of_what_they_are_made_from(spark, name, most, monkeypatch):
    staged = {}
    monkeypatch.setattr(chain, "stage", lambda df, label: staged.update({label: df.columns}) or stage(df, label))
    catalogue.queries()[name](spark, DIRECTORY)
    readings = staged["scoring_readings"]
    assert len(readings) <= most and "alert_score" in readings and "max_temperature" not in readings


def test_a_written_table_leaves_no_shuffle_on_disk(spark, tmp_path):
    manager = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()

    def shuffles():
        return set(re.findall(r"shuffle_\d+_\d+_\d+\.data", manager.getAllFiles().mkString(" ")))

    grouped = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count()
    setting = spark.conf.get(staging.SHUFFLE_CLEANUP)
    before = shuffles()
    staged = stage(grouped, "grouped")
    write_table(grouped, str(tmp_path / "grouped"))
    for _ in range(50):
        if not shuffles() - before:
            break
        time.sleep(0.2)
    assert not shuffles() - before and spark.conf.get(staging.SHUFFLE_CLEANUP) == setting
    assert staged.count() == read_table(spark, str(tmp_path / "grouped")).count() == 7
    # Frames that are no writes keep theirs: they may be run again.
    assert grouped.count() == 7 and shuffles() - before


def test_records_move_to_machines_once_on_the_plain_id(tables, without_broadcast):
    plan = plan_of(chain.cleaned(tables))
    assert "Exchange hashpartitioning(coalesce" not in plan and "isnull" not in plan


def test_totals_of_wide_rows_and_ordered_steps_are_written(spark, monkeypatch):
    staged = []
    for module in (features, integrate, chain):
        monkeypatch.setattr(module, "stage", lambda df, label: staged.append(label) or stage(df, label))
    catalogue.queries()["alert_features"](spark, DIRECTORY)
    assert "running_totals" in staged
    catalogue.queries()["integrated_ordered"](spark, DIRECTORY)
    assert {"corrected_hours", "machine_days"} <= set(staged)

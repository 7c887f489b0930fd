"""Named queries over the domain tables of a data directory.

Each takes (spark, directory) and returns a frame in portable types: doubles rounded to six
places, times and dates as text, decimals as doubles.
"""

from collections.abc import Callable
from dataclasses import replace

from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrowatch import schemas
from ferrowatch.operators import (
    alerts,
    encoding,
    equipment_quality,
    features,
    general_quality,
    integrate,
    items,
    maintenance_quality,
    operational_quality,
    profile,
    recommend,
    sensor_quality,
    training,
)
from ferrowatch.operators.boosting import Node
from ferrowatch.plans import chain
from ferrowatch.sources.projections import AS_OF, DomainTables
from ferrowatch.sources.staging import new_path, stage
from ferrowatch.sources.tables import alert_feature_types, cast_columns, read_table, write_table

KEY = ["equipment_id", "timestamp"]
# Models fitted by this process, by application, job and a checksum of the training rows.
_fitted: dict[tuple, training.BoostedClassifier] = {}


def portable(df: DataFrame) -> DataFrame:
    def column(field):
        value = F.col(field.name)
        if isinstance(field.dataType, T.DoubleType):
            value = F.round(value, 6)
        elif isinstance(field.dataType, T.DecimalType):
            value = value.cast("double")
        elif isinstance(field.dataType, T.TimestampType):
            value = F.date_format(value, "yyyy-MM-dd HH:mm:ss")
        elif isinstance(field.dataType, T.DateType):
            value = F.date_format(value, "yyyy-MM-dd")
        return value.alias(field.name)

    return df.select([column(field) for field in df.schema.fields])


def _sources() -> dict[str, Callable[[DomainTables], DataFrame]]:
    return {
        "fixture_sensor": lambda t: t.sensor,
        "fixture_equipment": lambda t: t.equipment,
        "fixture_maintenance": lambda t: t.maintenance,
        "fixture_operational": lambda t: t.operational,
        "csv_inferred_scan": lambda t: _csv(t.maintenance),
        "csv_typed_scan": lambda t: _csv(t.maintenance, schema=schemas.MAINTENANCE),
        "csv_text_cast": _csv_text_cast,
        "csv_featured_scan": lambda t: _csv_stage(t, chain.featured, schemas.FEATURED),
        "csv_alerted_scan": lambda t: _csv_stage(t, chain.alerted, schemas.ALERTED),
        "csv_scored_scan": lambda t: _csv_stage(t, chain.scored, schemas.SCORED),
        "parquet_scan": lambda t: stage(t.equipment, "equipment"),
    }


def _csv(df: DataFrame, **options) -> DataFrame:
    path = new_path(df.sparkSession, "csv")
    write_table(df, path)
    return read_table(df.sparkSession, path, **options)


def _csv_stage(t: DomainTables, stage_of: Callable[[DomainTables], DataFrame], schema: T.StructType) -> DataFrame:
    """A stage table written as CSV and read by position."""
    return _csv(stage_of(t).select(*schema.names), schema=schema)


def _csv_text_cast(t: DomainTables) -> DataFrame:
    """All columns of the alert model in the graded readings, read as text and cast."""
    types = alert_feature_types()
    graded = _csv(chain.alerted(t).select(*schemas.ALERTED.names), infer=False)
    return cast_columns(graded, types).select("equipment_id", *types)


def _checks() -> dict[str, Callable[[DomainTables], DataFrame]]:
    equipment, operational = equipment_quality, operational_quality
    logs, general = maintenance_quality, general_quality
    return {
        "sensor_continuity": lambda t: sensor_quality.timestamp_continuity(t.sensor),
        "sensor_ranges": lambda t: sensor_quality.reading_ranges(t.sensor),
        "sensor_frequency": lambda t: sensor_quality.reading_frequency(t.sensor),
        "sensor_frequency_sample": lambda t: sensor_quality.reading_frequency_sample(t.sensor),
        "sensor_id_check": lambda t: sensor_quality.verify_equipment_ids(t.sensor, t.equipment),
        "sensor_ids_match": lambda t: sensor_quality.equipment_ids_match(t.sensor, t.equipment),
        "future_installations": lambda t: equipment.future_installations(t.equipment, AS_OF),
        "spec_limit_issues": lambda t: equipment.spec_limit_issues(t.equipment),
        "period_issues": lambda t: equipment.period_issues(t.equipment),
        "future_overhauls": lambda t: equipment.future_overhauls(t.equipment, AS_OF),
        "future_overhaul_details": lambda t: equipment.future_overhaul_details(t.equipment, AS_OF),
        "future_overhaul_summary": lambda t: equipment.future_overhaul_summary(t.equipment, AS_OF),
        "overhaul_before_install": lambda t: equipment.overhaul_before_install(t.equipment),
        "invalid_criticality": lambda t: equipment.invalid_categories(
            t.equipment, "criticality", schemas.CRITICALITIES
        ),
        "equipment_report": lambda t: equipment.equipment_report(t.equipment, AS_OF),
        "operational_date_range": lambda t: operational.date_range(t.operational, "date", AS_OF),
        "invalid_production_rates": lambda t: operational.invalid_production_rates(t.operational),
        "invalid_hours": lambda t: operational.invalid_hours(t.operational),
        "invalid_product_type": lambda t: equipment.invalid_categories(
            t.operational, "product_type", schemas.PRODUCT_TYPES
        ),
        "invalid_material_quality": lambda t: equipment.invalid_categories(
            t.operational, "raw_material_quality", schemas.QUALITY_LEVELS
        ),
        "invalid_ambient": lambda t: operational.invalid_ambient(t.operational),
        "operator_presence": lambda t: operational.id_presence(t.operational, "operator_id"),
        "operational_report": lambda t: operational.validate_operational_data(t.operational, AS_OF),
        "hours_categories": lambda t: operational.hours_categories(t.operational),
        "hours_stats": lambda t: operational.hours_stats(t.operational),
        "hours_stats_report": lambda t: operational.hours_stats_report(t.operational),
        "corrected_hours": lambda t: operational.correct_invalid_hours(t.operational),
        "correction_report": _correction_report,
        "hours_categories_report": _hours_categories_report,
        "maintenance_flags": lambda t: logs.flag_future_dates(t.maintenance, AS_OF),
        "maintenance_date_range": lambda t: operational.date_range(t.maintenance, "date", AS_OF),
        "type_counts": lambda t: logs.category_counts(
            t.maintenance, "maintenance_type", schemas.MAINTENANCE_TYPES
        ),
        "technician_presence": lambda t: operational.id_presence(t.maintenance, "technician_id"),
        "negative_counts": lambda t: logs.negative_counts(t.maintenance, ["duration_hours", "cost"]),
        "result_counts": lambda t: logs.category_counts(
            t.maintenance, "maintenance_result", schemas.MAINTENANCE_RESULTS
        ),
        "inconsistent_replacements": lambda t: logs.inconsistent_replacements(t.maintenance),
        "maintenance_report": lambda t: logs.maintenance_report(t.maintenance, AS_OF),
        "future_records": lambda t: logs.future_records(t.maintenance, AS_OF),
        "future_totals": lambda t: logs.future_totals(t.maintenance, AS_OF),
        "null_counts": lambda t: general.null_counts(t.maintenance),
        "null_counts_sensor": lambda t: general.null_counts(t.sensor),
        "null_counts_equipment": lambda t: general.null_counts(t.equipment),
        "null_counts_operational": lambda t: general.null_counts(t.operational),
        "duplicate_counts": lambda t: general.duplicate_counts(t.sensor),
        "duplicate_counts_maintenance": lambda t: general.duplicate_counts(t.maintenance),
        "duplicate_counts_equipment": lambda t: general.duplicate_counts(t.equipment),
        "duplicate_counts_operational": lambda t: general.duplicate_counts(t.operational),
        "unique_ids": lambda t: general.unique_equipment_ids(t.sensor),
        "unique_ids_maintenance": lambda t: general.unique_equipment_ids(t.maintenance),
        "unique_ids_equipment": lambda t: general.unique_equipment_ids(t.equipment),
        "unique_ids_operational": lambda t: general.unique_equipment_ids(t.operational),
        "id_consistency": lambda t: general.equipment_id_consistency(*_four(t)),
        "id_totals": lambda t: general.equipment_id_totals(*_four(t)),
    }


def _four(t: DomainTables):
    return t.sensor, t.maintenance, t.equipment, t.operational


def _correction_report(t: DomainTables) -> DataFrame:
    return operational_quality.correction_report(t.operational, AS_OF)


def _hours_categories_report(t: DomainTables) -> DataFrame:
    return operational_quality.hours_categories_report(t.operational)


def _preparation() -> dict[str, Callable[[DomainTables], DataFrame]]:
    def valid(t):
        return profile.valid_readings(chain.integrated(t))

    def cleaned(t):
        return stage(chain.cleaned(t), "cleaned")

    def aged(t):
        return features.equipment_age_days(chain.integrated(t))

    def derived(t):
        names = [name for name in schemas.FEATURED.names if name not in schemas.INTEGRATED.names]
        return chain.engineered(t).select(
            *KEY, "days_since_maintenance", *[name for name in names if not name.endswith("_encoded")]
        )

    def encoded(t):
        columns = schemas.ENCODED_CATEGORIES
        frame = encoding.label_encode(stage(chain.integrated(t).select(*KEY, *columns), "categories"))
        return frame.select(*KEY, *columns, *[f"{name}_encoded" for name in columns])

    return {
        "specs_join": lambda t: integrate.with_specs(integrate.normalise_sensor(t.sensor), t.equipment),
        "latest_maintenance": lambda t: integrate.latest_maintenance(
            integrate.normalise_maintenance(t.maintenance)
        ),
        "maintenance_join": lambda t: integrate.days_since_maintenance(
            integrate.with_latest_maintenance(t.sensor, integrate.normalise_maintenance(t.maintenance))
        ),
        "operational_day_join": lambda t: integrate.with_operational_day(
            t.sensor, integrate.normalise_operational(t.operational)
        ),
        "integrated": chain.integrated,
        # Sorting samples its input first; the written table spares that pass the joins.
        "integrated_ordered": lambda t: integrate.order_for_output(
            stage(chain.integrated(t, written=True), "integrated")
        ),
        "valid_readings": lambda t: valid(t).select(*KEY, "installation_date"),
        "validity_counts": lambda t: profile.validity_counts(chain.integrated(t)),
        "overview": lambda t: profile.dataset_overview(valid(t)),
        "dataset_sample": lambda t: profile.dataset_sample(valid(t)),
        "summary_stats": lambda t: profile.summary_stats(stage(valid(t), "valid")),
        "cardinality": lambda t: profile.categorical_cardinality(valid(t)),
        "missing_counts": lambda t: profile.missing_counts(valid(t)),
        "missing_report": lambda t: profile.missing_report(valid(t)),
        "dropped_missing": chain.cleaned,
        "cleaned_duplicates": lambda t: general_quality.duplicate_counts(chain.cleaned(t)),
        "numeric_ranges": lambda t: profile.numeric_ranges(chain.cleaned(t)),
        "frequencies": lambda t: profile.categorical_frequencies(chain.cleaned(t)),
        "outliers": lambda t: profile.outlier_counts(cleaned(t)),
        "correlations": lambda t: profile.correlations(cleaned(t)),
        "features": derived,
        "label_mapping": lambda t: encoding.label_mapping(chain.cleaned(t)),
        "label_encoded": encoded,
        "label_encoded_featured": lambda t: chain.featured(t).select(
            *KEY, *schemas.ENCODED_CATEGORIES, *[f"{name}_encoded" for name in schemas.ENCODED_CATEGORIES]
        ),
        "negative_age_rows": lambda t: features.negative_age_rows(aged(t)).select(*KEY, "equipment_age_days"),
        "negative_age_sample": lambda t: features.negative_age_sample(aged(t)),
        "negative_age_summary": lambda t: features.negative_age_summary(aged(t)),
        "invalid_timestamp_totals": lambda t: features.invalid_timestamp_totals(chain.integrated(t)),
        "invalid_timestamps_by_equipment": lambda t: features.invalid_timestamps_by_equipment(
            chain.integrated(t), n=None
        ),
        "invalid_timestamp_first": lambda t: features.invalid_timestamps_by_equipment(chain.integrated(t)),
        "invalid_timestamp_sample": lambda t: features.invalid_timestamp_sample(aged(t)),
    }


def _grading() -> dict[str, Callable[[DomainTables], DataFrame]]:
    def inspection(item):
        kept = [*items.SIGNALS[item], "parts_replaced", "maintenance_type"]
        return lambda t: items.item_inspection(chain.assigned(t, kept), item)

    score_columns = [name for name in schemas.SCORED.names if name not in schemas.ALERTED.names]
    return {
        "alert_limits": lambda t: alerts.alert_limits(chain.cleaned(t)),
        "alerts": lambda t: chain.graded(t).select(*KEY, *schemas.ALERT_COLUMNS, "alert"),
        "alert_percentages": lambda t: alerts.alert_percentages(chain.graded(t)),
        "detailed_alert_percentages": lambda t: alerts.detailed_alert_percentages(chain.graded(t)),
        "alert_sample": lambda t: alerts.alert_sample(chain.graded(t)),
        "criticality_cost": lambda t: recommend.criticality_avg_annual_cost(chain.scoring_readings(t)),
        "scores": lambda t: chain.rated(t).select(*KEY, "alert", *score_columns),
        "score_distribution": lambda t: recommend.score_distribution(chain.rated(t)),
        "maintenance_percentages": lambda t: recommend.maintenance_percentages(chain.rated(t)),
        "stat_thresholds": lambda t: items.stat_thresholds(chain.cleaned(t)),
        "history_thresholds": lambda t: items.history_thresholds(chain.cleaned(t)),
        "item_thresholds": lambda t: items.item_thresholds(chain.cleaned(t)),
        "items": lambda t: chain.assigned(t, ["parts_replaced"]).select(
            *KEY, "parts_replaced", "total_score", "maintenance_needed", "maintenance_item"
        ),
        "required_rows": lambda t: items.required_rows(chain.assigned(t)).select(*KEY, "maintenance_item"),
        "item_percentages": lambda t: items.item_percentages(chain.assigned(t)),
        "unassigned_items": lambda t: items.unassigned_count(chain.assigned(t)),
        "motor_inspection": inspection("Motor"),
        "bearings_inspection": inspection("Bearings"),
        "seals_inspection": inspection("Seals"),
        "filters_inspection": inspection("Filters"),
    }


def given_nodes() -> list[Node]:
    """The node table of a small model of the need for maintenance, as rows."""
    return [Node(*row) for row in schemas.GIVEN_NODES]


def _training() -> dict[str, Callable[[DomainTables], DataFrame]]:
    def by_rule(t):
        """The temperature status as a guess at the overall alert."""
        return chain.graded(t).select("alert", "temperature_alert")

    def selected(t, name, features=True):
        """Key, label and features of a job's rows; key and label only where no feature is asked for."""
        job = training.JOBS[name] if features else replace(training.JOBS[name], features=[])
        if name == "alert":
            frame = chain.alerted(t)
        elif name == "need":
            frame = chain.rated(t, job.features)
        else:
            # Codes of the whole table, like the features of the alert job. Items leave the types as they
            # are, so the codes come from the written readings, and no table of all items is written.
            names, kept = ["maintenance_type"], [name for name in job.features if not name.endswith("_encoded")]
            kept = [*kept, "maintenance_type"]
            readings = chain.scoring_cleaned(t, [*chain.PART_COLUMNS, *kept])
            frame = items.required_rows(chain.assigned_to(readings, kept))
            frame = encoding.label_encode(frame, names, encoding.label_mapping(readings, names))
        return job, training.select_features(frame, job)

    def prepared(t, name):
        job, frame = selected(t, name)
        frame = training.assemble(training.complete_rows(stage(frame, name), job), job.features)
        return (job, *training.index_label(frame, job.label))

    def fitted(t, name):
        job, frame, labels = prepared(t, name)
        train, test = training.split(frame)
        key = (t.spark.sparkContext.applicationId, name, *labels, *training.checksum(train, job))
        # Models of earlier sessions are not kept.
        for other in [other for other in _fitted if other[0] != key[0]]:
            del _fitted[other]
        if key not in _fitted:
            _fitted[key] = training.train_classifier(train, labels, job.features)
        return job, _fitted[key], test

    def report(name):
        def run(t):
            _, model, test = fitted(t, name)
            return training.classification_report(training.predict(model, test))

        return run

    def label_codes(name):
        return lambda t: training.label_codes(selected(t, name, features=False)[1], training.JOBS[name].label)

    def split_sizes(name):
        return lambda t: training.split_sizes(selected(t, name, features=False)[1], training.JOBS[name].label)

    def vectors_of_item(t):
        job, frame = selected(t, "item")
        vectors = training.assemble(frame, job.features).select(*KEY, vector_to_array("features").alias("x"))
        return vectors.select(*KEY, F.posexplode("x").alias("place", "value"))

    def matrix_of_need(t):
        job, model, test = fitted(t, "need")
        predicted = training.predict(model, test)
        return training.confusion_matrix(predicted, job.classes, job.label, "predicted_label")

    def importance_of_need(t):
        job, model, _ = fitted(t, "need")
        return training.feature_importance(model, t.spark, job.top)

    def importance_checks_of_need(t):
        """Whether the counted splits are those of the tree's inner nodes, and all of job features."""
        job, model, _ = fitted(t, "need")
        counts = training.feature_importance(model, t.spark, len(job.features))
        inner = F.lit(sum(node.feature >= 0 for node in model.nodes))
        return counts.agg(
            (F.sum("splits") == inner).alias("counts_all_splits"),
            F.every(F.col("feature").isin(job.features)).alias("only_job_features"),
        )

    def sample_of_need(t):
        _, model, test = fitted(t, "need")
        first = test.agg(F.min(F.struct(*KEY)).alias("key")).select("key.*").first()
        return training.score_sample(model, test, first.asDict()).withColumn(
            "probabilities", F.array_join(F.transform("probabilities", lambda p: F.round(p, 6).cast("string")), " ")
        )

    def differences(one, other):
        """(rows, differences): rows of the first frame, and those of either that the other lacks.

        Both are written, so each is computed once, however often it is compared.
        """
        one, other = stage(one, "compared"), stage(other, "compared")
        apart = one.exceptAll(other).unionAll(other.exceptAll(one))
        return one.agg(F.count("*").alias("rows")).crossJoin(apart.agg(F.count("*").alias("differences")))

    def saved_need(t):
        """Predictions of the model after it was saved and loaded, against those before."""
        _, model, test = fitted(t, "need")
        path = new_path(t.spark, "model")
        training.save_model(model, t.spark, path)
        columns = [*KEY, "probabilities", "prediction", "predicted_label"]
        before = training.predict(model, test).select(*columns)
        return differences(before, training.predict(training.load_model(t.spark, path), test).select(*columns))

    def walked_need(t):
        """Predictions by joins with the node table against those by arrays."""
        _, model, test = fitted(t, "need")
        # Different rows may share machine and time.
        test = stage(test.withColumn("row", F.monotonically_increasing_id()), "walked")
        walked = training.predict_by_nodes(model.node_table(t.spark), test, ["row"], model.features, model.labels)
        return differences(
            training.predict(model, test).select("row", "predicted_label"), walked.select("row", "predicted_label")
        )

    def predicted_by_given_nodes(t):
        job, frame = selected(t, "need")
        rows = stage(frame.withColumn("row", F.monotonically_increasing_id()), "given")
        nodes = training.BoostedClassifier(job.classes, job.features, given_nodes()).node_table(t.spark)
        walked = training.predict_by_nodes(nodes, rows, ["row"], job.features, job.classes)
        return rows.select("row", *KEY).join(walked, "row").select(
            *KEY, F.col("probabilities")[0].alias("not_required"), F.col("probabilities")[1].alias("required"), "predicted_label"
        )

    return {
        "metrics_on_rule": lambda t: training.classification_report(by_rule(t), "alert", "temperature_alert"),
        "confusion_on_rule": lambda t: training.confusion_matrix(
            by_rule(t), schemas.ALERT_LEVELS, "alert", "temperature_alert"
        ),
        "alert_features": lambda t: selected(t, "alert")[1],
        "need_features": lambda t: selected(t, "need")[1],
        "item_features": lambda t: selected(t, "item")[1],
        "item_vectors": vectors_of_item,
        "need_flags": lambda t: training.maintenance_encoded(chain.rated(t)).select(
            *KEY, "maintenance_needed", "maintenance_encoded"
        ),
        "alert_label_codes": lambda t: training.label_codes(chain.graded(t), "alert"),
        "need_label_codes": label_codes("need"),
        "item_label_codes": label_codes("item"),
        "alert_split_sizes": lambda t: training.split_sizes(chain.graded(t), "alert"),
        "need_split_sizes": split_sizes("need"),
        "item_split_sizes": split_sizes("item"),
        "predicted_by_given_nodes": predicted_by_given_nodes,
        "train_alert": report("alert"),
        "train_need": report("need"),
        "train_item": report("item"),
        "confusion_need": matrix_of_need,
        "importance_need": importance_of_need,
        "importance_checks_need": importance_checks_of_need,
        "sample_need": sample_of_need,
        "saved_need": saved_need,
        "walked_need": walked_need,
    }


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    plans = {**_sources(), **_checks(), **_preparation(), **_grading(), **_training()}

    def over_directory(plan):
        return lambda spark, directory: portable(plan(DomainTables(spark, directory)))

    return {name: over_directory(plan) for name, plan in plans.items()}

"""Profiling and cleaning; column sets follow from the frame's schema unless named."""

import math
from functools import reduce
from operator import and_

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ferrowatch.functions.expressions import (
    any_of,
    as_number,
    is_nan,
    numeric_columns,
    rows_per_column,
    rows_per_item,
    string_columns,
    value_counts,
)


def valid_readings(df: DataFrame) -> DataFrame:
    """Readings from the installation on; without an installation date a reading is dropped."""
    return df.filter(F.col("timestamp") >= F.col("installation_date"))


def validity_counts(df: DataFrame) -> DataFrame:
    """(before, after, removed) of the validity filter."""
    return df.agg(
        F.count("*").alias("before"),
        F.count_if(F.col("timestamp") >= F.col("installation_date")).alias("after"),
    ).withColumn("removed", F.col("before") - F.col("after"))


def dataset_overview(df: DataFrame) -> DataFrame:
    """(n_rows, n_columns) as one row."""
    return df.agg(F.count("*").alias("n_rows")).withColumn("n_columns", F.lit(len(df.columns)))


def dataset_sample(df: DataFrame, n: int = 5) -> DataFrame:
    """The first n rows in the order of all columns, NULL first."""
    return df.orderBy(*df.columns).limit(n)


def summary_stats(df: DataFrame) -> DataFrame:
    """(column, count, mean, stddev, min_number, max_number, min_text, max_text).

    One row per numeric or text column. Numeric columns are measured in groups, without a row per
    value. Text is grouped by value first; its columns have a mean and deviation of those values that
    read as numbers, as describe() has. Give a written frame: it is read several times.
    """
    numbers, texts = numeric_columns(df), string_columns(df)
    none = F.lit(None)
    frames = []
    if numbers:
        measured = rows_per_column(df, "column", numbers, _measures, fields=8)
        frames.append(measured.withColumns({"min_text": none.cast("string"), "max_text": none.cast("string")}))
    if texts:
        frames.append(_text_stats(df, texts))
    if not frames:
        raise ValueError("no column to report on")
    return reduce(DataFrame.unionByName, frames)


def _measures(name: str) -> dict[str, Column]:
    return {
        "count": F.count(name),
        "mean": F.avg(name).cast("double"),
        "stddev": F.stddev_samp(name),
        "min_number": F.min(name).cast("double"),
        "max_number": F.max(name).cast("double"),
    }


def _text_stats(df: DataFrame, texts: list[str]) -> DataFrame:
    """The statistics of text columns from the counts of their different values."""
    counts = value_counts(df, texts).withColumn("number", as_number("value"))
    known = F.col("value").isNotNull()
    read = F.when(F.col("number").isNotNull(), F.col("count"))
    totals = counts.groupBy(F.col("column").alias("_column")).agg(
        F.coalesce(F.sum(F.when(known, F.col("count"))), F.lit(0)).alias("_count"),
        F.sum(read).alias("_read"),
        F.try_divide(F.sum(read * F.col("number")), F.sum(read)).alias("mean"),
        F.min("value").alias("min_text"),
        F.max("value").alias("max_text"),
    )
    apart = F.col("number") - F.col("mean")
    spread = (
        counts.join(totals.select("_column", "mean"), F.col("column") == F.col("_column"))
        .groupBy("column")
        .agg(F.sum(read * apart * apart).alias("_spread"))
    )
    names = df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, texts))).alias("column"))
    stats = names.join(totals, F.col("column") == F.col("_column"), "left").join(spread, "column", "left")
    none = F.lit(None).cast("double")
    return stats.select(
        "column",
        F.coalesce("_count", F.lit(0)).alias("count"),
        "mean",
        F.sqrt(F.try_divide(F.col("_spread"), F.col("_read") - 1)).alias("stddev"),
        none.alias("min_number"),
        none.alias("max_number"),
        "min_text",
        "max_text",
    )


def categorical_cardinality(df: DataFrame) -> DataFrame:
    """(column, unique_values) per text column, NULL counting as one value.

    The values are grouped before they are counted: distinct counts side by side in one
    aggregate would repeat every row once per column up to the shuffle.
    """
    return value_counts(df, string_columns(df)).groupBy("column").agg(F.count("*").alias("unique_values"))


def _missing(df: DataFrame, name: str) -> Column:
    kind = df.schema[name].dataType
    missing = [F.col(name).isNull()]
    if isinstance(kind, (T.DoubleType, T.FloatType)):
        missing += [F.isnan(name), F.col(name).isin([math.inf, -math.inf])]
    elif isinstance(kind, T.StringType):
        missing.append(F.col(name) == "")
    return any_of(missing)


def missing_counts(df: DataFrame) -> DataFrame:
    """(column, missing): NULL, NaN and infinities in numeric columns, NULL and "" in the others."""
    return rows_per_item(
        df, "column", {name: {"missing": F.count_if(_missing(df, name))} for name in df.columns}
    )


def drop_missing(df: DataFrame, one_by_one: list[str] | None = None) -> DataFrame:
    """Drop rows with a NULL or NaN; infinities and "" stay.

    The columns named `one_by_one` have a condition each, which Spark can test where a column is read:
    before the joins, through which then no column goes for the sake of the test.
    """
    apart = one_by_one or []
    rest = df.na.drop(subset=[name for name in df.columns if name not in apart])
    return rest.filter(reduce(and_, [F.col(name).isNotNull() & ~is_nan(df, name) for name in apart], F.lit(True)))


def missing_report(df: DataFrame) -> DataFrame:
    """(phase, column, missing) before and after the drop, both from one pass."""
    dropped = any_of([F.col(name).isNull() | is_nan(df, name) for name in df.columns])
    counts = rows_per_item(
        df.withColumn("_kept", ~dropped),
        "column",
        {
            name: {
                "before": F.count_if(_missing(df, name)),
                "after": F.count_if(_missing(df, name) & F.col("_kept")),
            }
            for name in df.columns
        },
    )
    return counts.unpivot("column", ["before", "after"], "phase", "missing").select("phase", "column", "missing")


def numeric_ranges(df: DataFrame) -> DataFrame:
    """(column, min, max) per numeric column."""
    return rows_per_item(
        df,
        "column",
        {
            name: {"min": F.min(name).cast("double"), "max": F.max(name).cast("double")}
            for name in numeric_columns(df)
        },
    )


def categorical_frequencies(df: DataFrame, top: int = 10) -> DataFrame:
    """(column, value, count, rank): the top values per text column by count, ties by value.

    Spark limits each group before the shuffle as well as after it, so a column with many
    values does not pile up in one task.
    """
    by_count = Window.partitionBy("column").orderBy(F.desc("count"), F.asc_nulls_first("value"))
    return (
        value_counts(df, string_columns(df))
        .withColumn("rank", F.row_number().over(by_count))
        .filter(F.col("rank") <= top)
    )


def outlier_counts(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(column, outliers): values strictly outside mean ± 3 sample deviations."""
    columns = columns or numeric_columns(df)

    def limits(name):
        mean, spread = F.avg(name), 3 * F.stddev_samp(name)
        return {"bounds": F.struct((mean - spread).alias("low"), (mean + spread).alias("high"))}

    per_column = rows_per_column(df, "column", columns, limits, fields=5)
    # One entry per column, so the lookup is as small as the schema.
    lookup = per_column.agg(F.map_from_entries(F.collect_list(F.struct("column", "bounds")))).scalar()

    def outside(name):
        limits = F.col("bounds").getItem(name)
        return (F.col(name) < limits["low"]) | (F.col(name) > limits["high"])

    return rows_per_item(
        df.select(*columns, lookup.alias("bounds")),
        "column",
        {name: {"outliers": F.count_if(outside(name))} for name in columns},
    )


def correlations(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """(col_a, col_b, correlation, strength): Pearson over the rows complete in all columns.

    strength is "strong" above 0.7, "weak" below 0.3, else NULL, as it is where a constant
    column leaves the correlation NaN. Only the matrix, one number per pair of columns,
    reaches the driver.
    """
    columns = columns or numeric_columns(df)
    assembler = VectorAssembler(inputCols=columns, outputCol="features", handleInvalid="skip")
    vectors = assembler.transform(df.select(*columns)).select("features")
    matrix = Correlation.corr(vectors, "features").first()[0].toArray()
    pairs = [
        (columns[i], columns[j], float(matrix[i][j]))
        for i in range(len(columns))
        for j in range(i + 1, len(columns))
    ]
    size = F.abs("correlation")
    return (
        df.sparkSession.createDataFrame(pairs, "col_a string, col_b string, correlation double")
        .withColumn(
            "strength",
            F.when(F.isnan("correlation"), F.lit(None).cast("string"))
            .when(size > 0.7, "strong")
            .when(size < 0.3, "weak"),
        )
    )

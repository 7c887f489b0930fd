"""Column expressions and one-row report shapes shared by the operators."""

from functools import reduce
from operator import add, or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def safe_div(dividend, divisor) -> Column:
    """Quotient that is NULL on a zero divisor instead of an ANSI error."""
    return F.try_divide(dividend, divisor)


def is_nan(df: DataFrame, name: str) -> Column:
    """isnan for floating columns, false for the types that cannot hold NaN."""
    if isinstance(df.schema[name].dataType, (T.DoubleType, T.FloatType)):
        return F.isnan(name)
    return F.lit(False)


def any_of(conditions) -> Column:
    return reduce(or_, conditions)


def total_of(columns) -> Column:
    return reduce(add, [F.col(c) for c in columns])


def columns_of_type(df: DataFrame, kind) -> list[str]:
    return [field.name for field in df.schema.fields if isinstance(field.dataType, kind)]


def numeric_columns(df: DataFrame) -> list[str]:
    return columns_of_type(df, T.NumericType)


def string_columns(df: DataFrame) -> list[str]:
    return columns_of_type(df, T.StringType)


def counters(df: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """(check, violations): rows meeting each named condition, in one pass over the input.

    A condition that is NULL for a row does not count, as in a filter.
    """
    return rows_per_item(df, "check", {k: {"violations": F.count_if(c)} for k, c in conditions.items()})


def rows_per_item(df: DataFrame, label: str, items: dict[str, dict[str, Column]]) -> DataFrame:
    """One row per item with its aggregates as columns, all taken from a single global aggregate.

    Every item names the same aggregates; an aggregate must have one type across the items.
    """
    rows = [
        F.struct(F.lit(item).alias(label), *[value.alias(name) for name, value in values.items()])
        for item, values in items.items()
    ]
    if not rows:
        raise ValueError(f"no {label} to report on")
    return df.agg(F.array(*rows).alias("rows")).select(F.inline("rows"))


def shares(counts: DataFrame, count: str = "count", within: str | None = None) -> Column:
    """Percentage of each row's count in the total; only for frames that are already aggregated."""
    total = Window.partitionBy(*([within] if within else []))
    return F.try_divide(F.col(count), F.sum(count).over(total)) * 100


def value_counts(df: DataFrame, columns: list[str], label: str = "column") -> DataFrame:
    """(label, value, count) for all columns in one grouped pass; the columns share one type."""
    return (
        df.select(*columns)
        .unpivot([], columns, label, "value")
        .groupBy(label, "value")
        .agg(F.count("*").alias("count"))
    )


# How text that reads as a double begins. Casting any other text would cost an exception per value.
NUMBER_START = r"(?i)^[\s\p{Cntrl}]*[+-]?(\.?[0-9]|inf|nan)"


def as_number(name: str) -> Column:
    """A text as a double; NULL for text that is no number."""
    return F.when(F.col(name).rlike(NUMBER_START), F.col(name).try_cast("double"))


# Fields of aggregates side by side that Spark still compiles: one for a count, a minimum or a
# maximum, two for a mean, three for a deviation.
COMPILED_FIELDS = 90


def rows_per_column(df: DataFrame, label: str, columns: list[str], measures, fields: int) -> DataFrame:
    """One row per column with its aggregates, which `measures` gives by name for a column's name.

    A few dozen means and deviations side by side exceed what Spark compiles, so the columns are
    measured in groups, each by one aggregate that reads its columns only. Every group is a pass over
    the frame: give it a written one. `fields` is what the aggregates of one column keep.
    """
    size = max(1, COMPILED_FIELDS // fields)
    groups = [columns[at : at + size] for at in range(0, len(columns), size)]
    rows = [rows_per_item(df.select(*names), label, {name: measures(name) for name in names}) for names in groups]
    return reduce(DataFrame.unionAll, rows)

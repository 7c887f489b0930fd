"""Checks of the equipment specifications.

`as_of` is the date that stands for today; a time later on that same date already counts as
future, with zero days in the future.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ferrowatch.functions.expressions import any_of, counters
from ferrowatch.schemas import CRITICALITIES

# The largest plausible value of each specification.
SPEC_LIMITS = {"max_temperature": 1000, "max_pressure": 10000, "max_rotational_speed": 100000}
PERIOD_LIMITS = {"expected_lifetime_years": 100, "warranty_period_years": 50}


def as_of_date(as_of) -> Column:
    return F.to_date(F.lit(as_of))


def is_future(name: str, as_of) -> Column:
    return F.col(name) > as_of_date(as_of)


def outside_domain(name: str, valid: list[str]) -> Column:
    """NULL for a NULL value, so a filter or count leaves NULLs out."""
    return ~F.col(name).isin(valid)


def _beyond(name: str, limit: int) -> Column:
    return any_of([F.col(name) <= 0, F.col(name) > limit])


def _spec_limit_checks() -> dict[str, Column]:
    return {f"{name}_issues": _beyond(name, limit) for name, limit in SPEC_LIMITS.items()}


def _period_checks() -> dict[str, Column]:
    return {f"{name}_issues": _beyond(name, limit) for name, limit in PERIOD_LIMITS.items()}


def _overhaul_before_install() -> Column:
    return F.col("last_major_overhaul") < F.col("installation_date")


def future_installations(equipment: DataFrame, as_of) -> DataFrame:
    return counters(equipment, {"future_installations": is_future("installation_date", as_of)})


def spec_limit_issues(equipment: DataFrame) -> DataFrame:
    return counters(equipment, _spec_limit_checks())


def period_issues(equipment: DataFrame) -> DataFrame:
    return counters(equipment, _period_checks())


def future_overhauls(equipment: DataFrame, as_of) -> DataFrame:
    return counters(equipment, {"future_overhauls": is_future("last_major_overhaul", as_of)})


def overhaul_before_install(equipment: DataFrame) -> DataFrame:
    return counters(equipment, {"overhaul_before_install": _overhaul_before_install()})


def invalid_categories(df: DataFrame, name: str, valid: list[str]) -> DataFrame:
    """Values outside the domain; NULL is not counted."""
    return counters(df, {f"invalid_{name}": outside_domain(name, valid)})


def equipment_report(equipment: DataFrame, as_of) -> DataFrame:
    """(check, violations): every counter of the specification checks from one scan."""
    return counters(
        equipment,
        {
            "future_installations": is_future("installation_date", as_of),
            **_spec_limit_checks(),
            **_period_checks(),
            "future_overhauls": is_future("last_major_overhaul", as_of),
            "overhaul_before_install": _overhaul_before_install(),
            "invalid_criticality": outside_domain("criticality", CRITICALITIES),
        },
    )


def future_overhaul_details(equipment: DataFrame, as_of) -> DataFrame:
    """The rows whose overhaul lies in the future, by overhaul date."""
    return (
        equipment.filter(is_future("last_major_overhaul", as_of))
        .select(
            "equipment_id",
            "model",
            "last_major_overhaul",
            "installation_date",
            F.datediff("last_major_overhaul", as_of_date(as_of)).alias("days_in_future"),
        )
        .orderBy("last_major_overhaul", "equipment_id")
    )


def future_overhaul_summary(equipment: DataFrame, as_of) -> DataFrame:
    days = F.datediff("last_major_overhaul", as_of_date(as_of))
    return equipment.filter(is_future("last_major_overhaul", as_of)).agg(
        F.to_date(F.min("last_major_overhaul")).alias("earliest_overhaul"),
        F.to_date(F.max("last_major_overhaul")).alias("latest_overhaul"),
        F.round(F.avg(days), 2).alias("avg_days_in_future"),
    )

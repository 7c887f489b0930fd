"""Small helpers shared by the operators of this package."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


def without(df: DataFrame, names) -> DataFrame:
    """Drop the columns an operator is about to add, in whatever case they are written."""
    taken = {name.lower() for name in names}
    return df.select([F.col(quoted(c)) for c in df.columns if c.lower() not in taken])


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def spare(df: DataFrame, *bases: str) -> list[str]:
    """Names for working columns that the frame does not have yet."""
    present = {c.lower() for c in df.columns}
    names = []
    for base in bases:
        name = f"_{base}"
        while name.lower() in present:
            name = f"_{name}"
        present.add(name.lower())
        names.append(name)
    return names


def whole(text: str) -> Column:
    """The text of a row, empty where it is null."""
    return F.coalesce(F.col(quoted(text)), F.lit(""))


def word_count(text: str) -> Column:
    """Words of a text; a null text has none."""
    return F.regexp_count(whole(text), F.lit(WORD)).cast("long")

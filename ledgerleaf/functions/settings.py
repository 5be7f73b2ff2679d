"""Settings: numbers within bounds, yes and no, lists, times, and paths that generated files may have."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bounded_integer(value: Column, low: int, high: int, default: int) -> Column:
    """The whole number, the default for an empty value, null for what isn't one or is out of bounds."""
    text = F.trim(value)
    number = F.when(text.rlike(r"^\d{1,18}$"), text.cast("long"))
    return F.when(value.isNull() | (text == ""), F.lit(default).cast("long")).otherwise(F.when(number.between(low, high), number))


def boolean(value: Column, default: bool = False) -> Column:
    """true or false as written, the default for an empty value, null for anything else."""
    text = F.trim(value)
    return F.when(value.isNull() | (text == ""), F.lit(default)).when(text == "true", True).when(text == "false", False)


def listed(value: Column) -> Column:
    """The parts between commas, without blanks around them and without empty and repeated ones."""
    parts = F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def instant(time: Column) -> Column:
    """An ISO instant with milliseconds."""
    return F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'")


def medium_time(time: Column) -> Column:
    """Date and time as readers see them."""
    return F.date_format(time, "MMM d, yyyy, h:mm a")


def plain_path(path: Column) -> Column:
    """A relative path without empty parts, dots and ways up; null if it leaves its root or is absolute."""
    def step(state: Column, part: Column) -> Column:
        up = F.struct(F.slice(state["path"], F.lit(1), F.greatest(F.size(state["path"]) - 1, F.lit(0))).alias("path"), (state["inside"] & (F.size(state["path"]) > 0)).alias("inside"))
        down = F.struct(F.concat(state["path"], F.array(part)).alias("path"), state["inside"].alias("inside"))
        return F.when(part.isin("", "."), state).when(part == "..", up).otherwise(down)

    start = F.struct(F.array().cast("array<string>").alias("path"), F.lit(True).alias("inside"))
    walked = F.aggregate(F.split(F.replace(path, F.lit("\\"), F.lit("/")), "/"), start, step)
    return F.when(~path.startswith("/") & walked["inside"] & (F.size(walked["path"]) > 0), F.array_join(walked["path"], "/"))

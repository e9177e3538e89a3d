"""Text expressions: shortening, file stems, names, labels."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: names that are ids.
UUID = "^[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}$"


def shortened(text: Column, most: int) -> Column:
    """The first ``most`` characters, and ``...`` after them only if there are more."""
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("..."))).otherwise(text)


def last_segment(path: Column) -> Column:
    """What follows the last slash; null if nothing does."""
    return F.nullif(F.element_at(F.split(path, "/"), -1), F.lit(""))


def stem(path: Column) -> Column:
    """File name without folder and last suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), r"\.[^.]*$", "")


def chosen(key: Column, values: Mapping[str, str], otherwise: Column) -> Column:
    """The value of a small fixed mapping, as one CASE."""
    found = None
    for k, v in values.items():
        found = F.when(key == k, v) if found is None else found.when(key == k, v)
    return found.otherwise(otherwise)


def tenths(part: Column, whole: Column) -> Column:
    """100 * part / whole to one digit, halves to even; 0 if whole is 0. From whole numbers, hence exact."""
    thousandths = 1000 * part
    low = F.floor(thousandths / F.when(whole == 0, None).otherwise(whole))
    rest = 2 * (thousandths - low * whole)
    up = F.when((rest > whole) | ((rest == whole) & (low % 2 == 1)), 1).otherwise(0)
    return F.coalesce((low + up) / 10, F.lit(0.0))

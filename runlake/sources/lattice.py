"""The narrowest type that holds the values of two types, and how a column becomes one.

Whole numbers widen to longer ones and to decimals, and with fractions to double; a decimal widens until
digits before and after the point fit; a date becomes a time. Records are merged field by field, lists and
maps by their parts. Whatever has nothing else in common becomes text (records, lists and maps as JSON).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, ByteType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegerType, LongType, MapType, NullType, ShortType, StringType, StructField, StructType, TimestampNTZType, TimestampType

#: Digits of whole numbers, from narrow to wide.
WHOLE = {ByteType: 3, ShortType: 5, IntegerType: 10, LongType: 19}
MOST_DIGITS = 38


def _digits(kind: DataType) -> tuple[int, int] | None:
    """Digits before and after the point of an exact number."""
    if isinstance(kind, DecimalType):
        return kind.precision - kind.scale, kind.scale
    return (WHOLE[type(kind)], 0) if type(kind) in WHOLE else None


def common(a: DataType, b: DataType) -> DataType:
    """The join of two types."""
    if a == b or isinstance(b, NullType):
        return a
    if isinstance(a, NullType):
        return b
    if isinstance(a, StructType) and isinstance(b, StructType):
        return merged(a, b)
    if isinstance(a, ArrayType) and isinstance(b, ArrayType):
        return ArrayType(common(a.elementType, b.elementType))
    if isinstance(a, MapType) and isinstance(b, MapType) and a.keyType == b.keyType:
        return MapType(a.keyType, common(a.valueType, b.valueType))
    if type(a) in WHOLE and type(b) in WHOLE:
        return max(a, b, key=lambda t: WHOLE[type(t)])
    x, y = _digits(a), _digits(b)
    if x and y:
        before, after = max(x[0], y[0]), max(x[1], y[1])
        return DecimalType(before + after, after) if before + after <= MOST_DIGITS else StringType()
    if isinstance(a, (FloatType, DoubleType)) and isinstance(b, (FloatType, DoubleType)):
        return DoubleType()
    whole = next((t for t in (a, b) if type(t) in WHOLE), None)
    if whole is not None and any(isinstance(t, (FloatType, DoubleType)) for t in (a, b)):
        # a double holds whole numbers of up to 15 digits; longer ones only text does
        return DoubleType() if not isinstance(whole, LongType) else StringType()
    times = (DateType, TimestampNTZType)
    if isinstance(a, times) and isinstance(b, times):
        return TimestampNTZType()
    if {type(a), type(b)} == {DateType, TimestampType}:
        return TimestampType()
    return StringType()


def merged(a: StructType, b: StructType) -> StructType:
    """The fields of both, those of the first in front; names are matched without regard to case."""
    names = {f.name.lower(): f for f in b.fields}
    own = [StructField(f.name, common(f.dataType, names[f.name.lower()].dataType) if f.name.lower() in names else f.dataType) for f in a.fields]
    known = {f.name.lower() for f in a.fields}
    return StructType(own + [StructField(f.name, f.dataType) for f in b.fields if f.name.lower() not in known])


def bare(kind: DataType) -> DataType:
    """A type in which everything may be null, so that two can be compared."""
    if isinstance(kind, StructType):
        return StructType([StructField(f.name, bare(f.dataType)) for f in kind.fields])
    if isinstance(kind, ArrayType):
        return ArrayType(bare(kind.elementType))
    return MapType(kind.keyType, bare(kind.valueType)) if isinstance(kind, MapType) else kind


def converted(column: Column, have: DataType, want: DataType) -> Column:
    """A column of one type as one of a wider type."""
    if bare(have) == bare(want):
        return column
    if isinstance(want, StructType):
        own = {f.name.lower(): f for f in have.fields}
        parts = [converted(column[own[f.name.lower()].name], own[f.name.lower()].dataType, f.dataType) if f.name.lower() in own else F.lit(None).cast(f.dataType) for f in want.fields]
        return F.when(column.isNotNull(), F.struct(*[p.alias(f.name) for p, f in zip(parts, want.fields)]))
    if isinstance(want, ArrayType):
        return F.transform(column, lambda x: converted(x, have.elementType, want.elementType))
    if isinstance(want, MapType):
        return F.transform_values(column, lambda k, v: converted(v, have.valueType, want.valueType))
    if isinstance(want, StringType) and isinstance(have, (StructType, ArrayType, MapType)):
        return F.to_json(column)
    return column.cast(want)

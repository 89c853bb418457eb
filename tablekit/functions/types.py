"""Schema helpers: classify Spark types the way the operators need them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
FRACTIONAL = (T.FloatType, T.DoubleType)
TEMPORAL = (T.DateType, T.TimestampType, T.TimestampNTZType)
COMPLEX = (T.ArrayType, T.MapType, T.StructType)


def qcol(name: str) -> Column:
    """Column by exact name, safe for dots, spaces and backticks."""
    return F.col("`" + name.replace("`", "``") + "`")




def is_integral(dt) -> bool:
    return isinstance(dt, INTEGRAL)


def is_fractional(dt) -> bool:
    return isinstance(dt, FRACTIONAL)


def is_numeric(dt) -> bool:
    """Numbers as the profile sees them; booleans are categories, not numbers."""
    return isinstance(dt, T.NumericType)


def is_temporal(dt) -> bool:
    return isinstance(dt, TEMPORAL)


def is_duration(dt) -> bool:
    return isinstance(dt, T.DayTimeIntervalType)


def is_numeric_or_temporal(dt) -> bool:
    return is_numeric(dt) or is_temporal(dt) or is_duration(dt)


def is_complex(dt) -> bool:
    return isinstance(dt, COMPLEX)


def has_variant(dt) -> bool:
    """Whether a type is or holds a variant, which cannot be hashed or compared."""
    if isinstance(dt, T.StructType):
        return any(has_variant(f.dataType) for f in dt.fields)
    if isinstance(dt, T.ArrayType):
        return has_variant(dt.elementType)
    if isinstance(dt, T.MapType):
        return has_variant(dt.keyType) or has_variant(dt.valueType)
    return isinstance(dt, T.VariantType)


def hashable(c: Column, dt) -> Column:
    """A cell in a form that every hash function takes: nested cells and variants
    as JSON, calendar intervals as text."""
    if is_complex(dt) or has_variant(dt):
        return F.to_json(F.struct(c.alias("c")))
    return c.cast("string") if isinstance(dt, (T.CalendarIntervalType, T.NullType)) else c


def is_string(dt) -> bool:
    return isinstance(dt, (T.StringType, T.CharType, T.VarcharType))






def missing(c: Column, dt) -> Column:
    """Null, or NaN for float columns (pandas ``isna`` meaning)."""
    return (c.isNull() | F.isnan(c)) if is_fractional(dt) else c.isNull()


def literal_rows(spark, rows, schema: str) -> DataFrame:
    """A small table of driver-side values (bounded by the schema width, never
    by the data). Rows are unpickled inside the JVM; no Python worker runs."""
    return spark.createDataFrame(list(rows), schema)

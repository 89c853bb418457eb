"""Compile filter specs into one Spark predicate.

Design rules (see README "Condition semantics"):

* The type decision is made from the schema at compile time, never at run time,
  so a filter can be skipped (and reported) but never fails a job.
* The column side stays cast-free whenever the column type allows it, so
  Catalyst pushes the comparison into the parquet scan. Integer columns compared
  with a fractional value are rewritten with floor/ceil instead of casting the
  column to double.
* NaN behaves as null: it fails every positive comparison and is kept by the
  negative operators. Negative operators keep nulls, written ``c IS NULL OR ...``
  (that form is pushed down; ``coalesce`` is not).
"""

from __future__ import annotations

import datetime as dt
import functools
import math
import operator
from dataclasses import dataclass
from decimal import Context, Decimal
from fractions import Fraction
from typing import Any, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .spec import Condition, Operator as Op
from .types import is_fractional, is_integral, is_numeric, is_string, is_temporal, qcol


class SkipFilter(Exception):
    """Raised inside the compiler; the filter is dropped and reported."""


@dataclass(frozen=True)
class Compiled:
    predicate: Column | None          # None: nothing to apply
    skipped: tuple[tuple[Condition, str], ...]


ORDERING = {Op.GREATER_THAN: operator.gt, Op.GREATER_THAN_OR_EQUAL: operator.ge,
            Op.LESS_THAN: operator.lt, Op.LESS_THAN_OR_EQUAL: operator.le}


# What the largest value of an integer type is (a power of two) and of a
# decimal type (a power of ten) decides which comparisons are always true.
_BITS = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


def parse_number(v: Any) -> Decimal:
    """A comparison value, exactly (Decimal; NaN and infinities included)."""
    try:
        if isinstance(v, float):
            return Decimal(repr(v))
        return Decimal(int(v)) if isinstance(v, (bool, int)) else Decimal(str(v).strip())
    except (ArithmeticError, ValueError):
        raise SkipFilter(f"value {v!r} is not a number") from None


def _exact(dtype) -> tuple[int, int] | None:
    """(scale, limit) of an integer or decimal type: its values are whole
    multiples of 10^-scale, below the limit in size; None for other types."""
    if isinstance(dtype, T.DecimalType):
        return dtype.scale, 10 ** dtype.precision
    for kind, bits in _BITS.items():
        if isinstance(dtype, kind):
            return 0, 2 ** bits + 1
    return None


def _units(v: Decimal, scale: int, up: bool) -> int:
    """``v`` in units of 10^-scale, rounded up or down."""
    n = Fraction(v) * 10 ** scale
    return math.ceil(n) if up else math.floor(n)


def _literal(units: int, scale: int, dtype) -> Column:
    if isinstance(dtype, T.DecimalType):
        return F.lit(Decimal(units).scaleb(-scale, context=Context(prec=76)))
    return F.lit(units)


def _numeric_view(c: Column, dtype) -> tuple[Column, Any]:
    """Column as a number: numeric columns as is, everything else try-cast."""
    if is_numeric(dtype):
        return c, dtype
    if isinstance(dtype, T.BooleanType):
        return c.cast("double"), T.DoubleType()
    if is_string(dtype) or is_temporal(dtype):
        return c.try_cast("double"), T.DoubleType()
    raise SkipFilter(f"numeric filter on a {dtype.simpleString()} column")


def _ordering(c: Column, dtype, op, v: Decimal) -> Column:
    """Positive comparison with NaN acting as null (false). Integer and decimal
    columns are compared with the nearest value of their own type, so the column
    is never cast and no digit is lost."""
    if v.is_nan():
        return F.lit(False)
    c, dtype = _numeric_view(c, dtype)
    exact = _exact(dtype)
    if exact is None:
        pred = op(c, F.lit(float(v)))
        if op in (operator.gt, operator.ge):
            pred = pred & ~F.isnan(c)   # Spark orders NaN above every number
        return pred
    scale, limit = exact
    rising = op in (operator.gt, operator.ge)
    if v.is_infinite():
        return c.isNotNull() if (v > 0) != rising else F.lit(False)
    units = _units(v, scale, up=op in (operator.ge, operator.lt))
    if abs(units) >= limit:
        return c.isNotNull() if (units > 0) != rising else F.lit(False)
    return op(c, _literal(units, scale, dtype))


def _same(c: Column, dtype, values: Iterable[Decimal]) -> Column:
    """Equal to one of ``values``; NaN equals nothing."""
    c, dtype = _numeric_view(c, dtype)
    exact = _exact(dtype)
    finite = {v for v in values if not v.is_nan()}
    if exact is None:
        found = [F.lit(x) for x in sorted({float(v) for v in finite})]
    else:
        scale, limit = exact
        units = sorted({_units(v, scale, False) for v in finite
                        if v.is_finite() and Fraction(v) * 10 ** scale % 1 == 0})
        found = [_literal(u, scale, dtype) for u in units if abs(u) < limit]
    if not found:
        return F.lit(False)
    return c == found[0] if len(found) == 1 else c.isin(found)


def _negate_keep_null(c: Column, positive: Column) -> Column:
    return c.isNull() | ~positive


# --- temporal values -------------------------------------------------------------

def parse_instant(v: Any) -> dt.datetime:
    """ISO text (date or date-time, optional offset) -> naive UTC datetime."""
    if isinstance(v, dt.datetime):
        t = v
    elif isinstance(v, dt.date):
        t = dt.datetime(v.year, v.month, v.day)
    else:
        s = str(v).strip()
        try:
            t = dt.datetime.fromisoformat(s.replace("Z", "+00:00"))
        except ValueError:
            raise SkipFilter(f"value {v!r} is not a date or time") from None
    if t.tzinfo is not None:
        t = t.astimezone(dt.timezone.utc).replace(tzinfo=None)
    return t


def _ts_literal(t: dt.datetime, dtype) -> Column:
    """A UTC wall clock: an instant for zoned columns, whatever the session zone."""
    text = t.isoformat(sep=" ")
    if isinstance(dtype, T.TimestampNTZType):
        return F.to_timestamp_ntz(F.lit(text))
    return F.to_timestamp(F.lit(f"{text}+00:00"))


def _text_instant(c: Column) -> Column:
    """Text as an instant, in UTC where it names no zone; null if it is none."""
    day = F.trim(c).rlike("^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$")
    return F.coalesce(F.try_to_timestamp(F.concat(F.trim(c), F.when(day, " 00:00:00+00:00").otherwise("+00:00"))),
                      F.try_to_timestamp(c))


def _temporal_view(c: Column, dtype) -> tuple[Column, Any]:
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return c, dtype
    if isinstance(dtype, T.DateType):
        return c.cast("timestamp_ntz"), T.TimestampNTZType()
    if is_string(dtype):
        return _text_instant(c), T.TimestampType()
    raise SkipFilter(f"date filter on a {dtype.simpleString()} column")


def _midnight(day: Column, dtype) -> Column:
    """The beginning of a date: in UTC for zoned columns, else the wall clock's."""
    if isinstance(dtype, T.TimestampNTZType):
        return day.cast("timestamp_ntz")
    return F.timestamp_seconds(F.unix_date(day).cast("bigint") * 86400)


def _since(c: Column, dtype, day: Column) -> Column:
    if isinstance(dtype, T.DateType):
        return c >= day
    c, dtype = _temporal_view(c, dtype)
    return c >= _midnight(day, dtype)


def _day_range(c: Column, dtype, day: Column) -> Column:
    """``day <= c < day + 1`` as a range, which the scan can use."""
    after = F.date_add(day, 1)
    if isinstance(dtype, T.DateType):
        return (c >= day) & (c < after)
    c, dtype = _temporal_view(c, dtype)
    return (c >= _midnight(day, dtype)) & (c < _midnight(after, dtype))


# Relative-date words and how far back each one reaches.
RELATIVE_DAYS = {"week-ago": 7}
RELATIVE_MONTHS = {"month-ago": 1, "quarter-ago": 3, "half-year-ago": 6, "year-ago": 12}


def utc_today() -> Column:
    """The date of the query's start in UTC, whatever the session zone."""
    return F.date_from_unix_date(F.floor(F.unix_seconds(F.current_timestamp()) / 86400).cast("int"))


def _relative(c: Column, dtype, word: str, today: dt.date | None) -> Column:
    """Ranges of whole days up to ``today`` (a date, or else the present one in
    UTC); both are constants to the scan."""
    now = utc_today() if today is None else F.lit(today)
    if word == "today":
        return _day_range(c, dtype, now)
    if word == "yesterday":
        return _day_range(c, dtype, F.date_sub(now, 1))
    if word in RELATIVE_DAYS:
        return _since(c, dtype, F.date_sub(now, RELATIVE_DAYS[word]))
    if word in RELATIVE_MONTHS:
        return _since(c, dtype, F.add_months(now, -RELATIVE_MONTHS[word]))
    raise SkipFilter(f"unknown relative date {word!r}")


# --- membership and text ---------------------------------------------------------

def _one_of(c: Column, dtype, values: Iterable[Any]) -> Column:
    values = list(values)
    if isinstance(dtype, T.BooleanType):
        return c.isin([str(v).lower() == "true" for v in values])
    if is_numeric(dtype):
        return _same(c, dtype, map(parse_number, values))
    # text (and anything else rendered as text): case-insensitive
    text = c if is_string(dtype) else c.cast("string")
    return F.lower(text).isin(sorted({str(v).lower() for v in values}))


def _contains_any(c: Column, dtype, values: Iterable[Any]) -> Column:
    text = c if is_string(dtype) else c.cast("string")
    lowered = F.lower(text)
    return functools.reduce(operator.or_, [lowered.contains(str(v).lower()) for v in values])


# --- entry points ----------------------------------------------------------------

def compile_one(f: Condition, dtype, today: dt.date | None = None) -> Column:
    """One filter -> predicate. Raises ``SkipFilter`` when it cannot apply."""
    c = qcol(f.column)
    vals = f.values
    op = f.operator
    if op in (Op.IS_NULL, Op.IS_NOT_NULL):
        miss = (c.isNull() | F.isnan(c)) if is_fractional(dtype) else c.isNull()
        return miss if op is Op.IS_NULL else ~miss
    if not vals:
        raise SkipFilter("no comparative values")
    if op is Op.TEXT_CONTAINS:
        return _contains_any(c, dtype, vals)
    if op is Op.TEXT_DOES_NOT_CONTAIN:
        return _negate_keep_null(c, _contains_any(c, dtype, vals))
    if op in ORDERING:
        return _ordering(c, dtype, ORDERING[op], parse_number(vals[0]))
    if op is Op.IS_EQUAL:
        return _same(c, dtype, [parse_number(vals[0])])
    if op is Op.IS_NOT_EQUAL:
        nc, ndt = _numeric_view(c, dtype)   # text that is no number counts as null, which stays
        return _negate_keep_null(nc, _same(nc, ndt, [parse_number(vals[0])]))
    if op in (Op.OUTSIDE_OF, Op.BETWEEN):
        if len(vals) < 2:
            raise SkipFilter("needs two values")
        if is_temporal(dtype) or (is_string(dtype) and not _all_numbers(vals[:2])):
            tc, tdt = _temporal_view(c, dtype)
            lo, hi = (_ts_literal(parse_instant(v), tdt) for v in vals[:2])
            inside = (tc >= lo) & (tc <= hi)
            return inside if op is Op.BETWEEN else _negate_keep_null(tc, inside)
        lo, hi = parse_number(vals[0]), parse_number(vals[1])
        if op is Op.BETWEEN:
            return _ordering(c, dtype, operator.ge, lo) & _ordering(c, dtype, operator.le, hi)
        nc, ndt = _numeric_view(c, dtype)
        outside = nc.isNull() | _ordering(nc, ndt, operator.lt, lo) | _ordering(nc, ndt, operator.gt, hi)
        return outside if _exact(ndt) else outside | F.isnan(nc)
    if op is Op.IS_ONE_OF:
        return _one_of(c, dtype, vals)
    if op is Op.IS_NOT_ONE_OF:
        return _negate_keep_null(c, _one_of(c, dtype, vals))
    if op in (Op.IS_AFTER, Op.IS_BEFORE):
        tc, tdt = _temporal_view(c, dtype)
        lit = _ts_literal(parse_instant(vals[0]), tdt)
        return tc >= lit if op is Op.IS_AFTER else tc <= lit
    if op is Op.IS_ON:
        return _day_range(c, dtype, F.lit(parse_instant(vals[0]).date()))
    if op is Op.IS_RELATIVE_TODAY:
        return _relative(c, dtype, str(vals[0]), today)
    raise SkipFilter(f"unsupported operator {op.value}")


def _all_numbers(vals) -> bool:
    try:
        [float(v) for v in vals]
        return True
    except (TypeError, ValueError):
        return False


def compile_filters(filters: Iterable[Condition], schema: T.StructType,
                    today: dt.date | None = None) -> Compiled:
    """AND of all applicable filters; unknown columns, missing or unparseable
    values drop that filter only (reported in ``skipped``)."""
    types = {f.name: f.dataType for f in schema.fields}
    preds, skipped = [], []
    for f in filters:
        if f.column not in types:
            skipped.append((f, "unknown column"))
            continue
        try:
            preds.append(compile_one(f, types[f.column], today))
        except SkipFilter as e:
            skipped.append((f, str(e)))
        except (ArithmeticError, TypeError, ValueError) as e:   # a value no rule foresaw drops its filter only
            skipped.append((f, f"{type(e).__name__}: {e}"))
    pred = functools.reduce(operator.and_, preds) if preds else None
    return Compiled(pred, tuple(skipped))

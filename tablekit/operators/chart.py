"""Chart datasets: field check, filtered/sanitized input, aggregated measures and
the 5,000-row cap. Spec walking is driver-side and only picks column names; all
data work is DataFrame operations, so Spark prunes every unused column at the
scan."""

from __future__ import annotations

from typing import Any, Iterable, Iterator, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.spec import Condition
from ..functions.types import qcol
from .filtering import apply_filters
from .profile import distinct_values
from .records import sanitize_for_chart
from .shape import prepare_columns

# Chart limits and special field names.
CHART_ROW_LIMIT = 5_000
CHART_DISTINCT_VALUES = 30
COUNT_FIELD = "COUNT(*)"
PERCENT_PREFIX = "Percentage of "
# Vega-Lite time units that cut an axis -> date_trunc unit.
TIME_UNITS = {"year": "year", "yearquarter": "quarter", "yearmonth": "month", "yearmonthdate": "day",
              "yearmonthdatehours": "hour", "yearmonthdatehoursminutes": "minute"}
# Vega-Lite time units that are a part of the calendar over all
# years (weekdays count from Sunday = 0, as there).
TIME_PARTS = {"quarter": F.quarter, "month": F.month, "date": F.dayofmonth, "dayofyear": F.dayofyear,
              "day": lambda c: F.dayofweek(c) - 1, "hours": F.hour, "minutes": F.minute, "seconds": F.second}


class ChartError(ValueError):
    pass


def channels(spec: Any) -> Iterator[dict]:
    """Every channel definition of a chart, wherever its view stands (layers,
    concatenations, facets, repeats): one walk over the whole document."""
    todo = [spec]
    while todo:
        node = todo.pop()
        if isinstance(node, list):
            todo += node
        elif isinstance(node, dict):
            for key, value in node.items():
                if key in ("encoding", "facet") and isinstance(value, dict):
                    yield from (c for c in (value, *value.values()) if isinstance(c, dict))
                todo.append(value)


def repeated_fields(spec: Any) -> Iterator[str]:
    """Fields that a ``repeat`` lists by name."""
    repeat = spec.get("repeat") if isinstance(spec, dict) else None
    lists = repeat.values() if isinstance(repeat, dict) else [repeat]
    for names in lists:
        yield from (n for n in names or () if isinstance(n, str))


def plain_name(field: str) -> str:
    """A field path as a column name: a backslash takes the next sign as it is."""
    out, signs = [], iter(field)
    for sign in signs:
        out.append(next(signs, "") if sign == "\\" else sign)
    return "".join(out)


def used_fields(spec: dict) -> set[str]:
    """Column names and measures that a chart draws."""
    named = (c["field"] for c in channels(spec) if isinstance(c.get("field"), str))
    return {plain_name(f) for f in (*named, *repeated_fields(spec))}


def verify_fields(df: DataFrame, spec: dict) -> set[str]:
    """The chart's fields that are columns. Measures (``COUNT(*)``,
    ``Percentage of ...``) need no column; any other unknown name raises."""
    fields = used_fields(spec)
    columns = fields & set(df.columns)
    unknown = {f for f in fields - columns if f != COUNT_FIELD and not f.startswith(PERCENT_PREFIX)}
    if unknown:
        raise ChartError(f"the chart uses fields the table lacks: {', '.join(sorted(unknown))}")
    return columns


def chart_select_fields(df: DataFrame, spec: dict) -> DataFrame:
    """Only the columns the spec uses, in table order (pruned at the scan)."""
    keep = verify_fields(df, spec)
    return df.select(*[qcol(c) for c in df.columns if c in keep])


def chart_filtered_dataset(df: DataFrame, spec: dict, filters: Iterable[Condition] = ()) -> DataFrame:
    """Filters first, then names prepared (all columns), durations as seconds,
    fields verified and selected."""
    filtered = apply_filters(df, list(filters))
    return chart_select_fields(sanitize_for_chart(prepare_columns(filtered, None)), spec)


def chart_row_cap(df: DataFrame, limit: int = CHART_ROW_LIMIT) -> tuple[DataFrame, bool]:
    """At most ``limit`` rows, and whether the data had more. The data are
    computed once: at most ``limit + 1`` rows come to the driver, which draws them."""
    rows = df.limit(limit + 1).collect()
    return df.sparkSession.createDataFrame(rows[:limit], df.schema), len(rows) > limit


def chart_aggregate(df: DataFrame, dims: Sequence[str | Column], measure: str = COUNT_FIELD) -> DataFrame:
    """Group by the other encodings and compute the measure:

    * ``COUNT(*)``: rows per group (partial aggregation before the shuffle);
    * ``Percentage of <field>``: 100 x group value / total, where the value is
      the row count for ``COUNT(*)`` and the sum of ``<field>`` otherwise. The
      total is a scalar subquery (one extra aggregate, inlined as a literal),
      never a window over all groups in one task.
    """
    dcols = [qcol(d) if isinstance(d, str) else d for d in dims]
    if measure == COUNT_FIELD:
        return df.groupBy(*dcols).agg(F.count(F.lit(1)).alias(COUNT_FIELD))
    if measure.startswith(PERCENT_PREFIX):
        field = measure[len(PERCENT_PREFIX):]
        value = F.count(F.lit(1)) if field == COUNT_FIELD else F.sum(qcol(field))
        total = df.agg(value.alias("t")).scalar()
        grouped = df.groupBy(*dcols).agg(value.alias("__v"))
        return grouped.select(*[c for c in grouped.columns if c != "__v"],
                              F.try_divide(F.col("__v") * F.lit(100.0), total).alias(measure))
    return df.groupBy(*dcols).agg(F.sum(qcol(measure)).alias(measure))


def time_unit(df: DataFrame, column: str, unit: str = "yearmonth") -> Column:
    """Vega-Lite time unit on a temporal axis: units with a year cut the instant,
    the others are calendar parts (integers) over all years. A wall-clock
    (``timestamp_ntz``) column stays wall-clock, whatever the session zone; other
    units (weeks) raise ``ChartError``."""
    col, dtype = qcol(column), df.schema[column].dataType
    if unit in TIME_PARTS:
        return TIME_PARTS[unit](col)
    if unit not in TIME_UNITS:
        raise ChartError(f"unsupported time unit {unit!r}")
    out = F.date_trunc(TIME_UNITS[unit], col)
    return out.cast("timestamp_ntz") if isinstance(dtype, (T.TimestampNTZType, T.DateType)) else out


def chart_output_metadata(df: DataFrame, limit: int = CHART_ROW_LIMIT,
                          row_limit_exceeded: bool = False, values: int = CHART_DISTINCT_VALUES) -> dict[str, Any]:
    """Row limit, filtered size and per column name / type / ``values`` distinct
    values (JSON-safe text). Two bounded jobs: a count and the distinct values."""
    dv = {c: [] for c in df.columns}
    for r in chart_distinct_values(df, values).collect():
        dv[r["column_name"]].append(r["value"])
    return {"rowLimitExceeded": row_limit_exceeded, "rowLimit": limit,
            "filteredDataframeSize": df.count(),
            "columns": [{"name": f.name, "nativeType": f.dataType.simpleString(), "distinctValues": dv[f.name]}
                        for f in df.schema.fields]}


def chart_distinct_values(df: DataFrame, values: int = CHART_DISTINCT_VALUES) -> DataFrame:
    return distinct_values(df, df.columns, values)

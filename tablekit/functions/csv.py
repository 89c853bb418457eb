"""One set of CSV and JSON options for writing, reading and sizing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .render import binary_repr
from .types import is_complex, qcol

_TIMES = {"timestampFormat": "yyyy-MM-dd HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss.SSSSSS",
          "dateFormat": "yyyy-MM-dd"}
#: Spark writes an empty text as two quotes and a null as nothing; quotes are doubled.
CSV_OPTIONS = {**_TIMES, "escape": '"', "ignoreLeadingWhiteSpace": "false", "ignoreTrailingWhiteSpace": "false"}
#: Reading back: nothing is a null (a sign that no cell has stands for it), two
#: quotes are an empty text, and a quoted cell may hold line breaks.
CSV_READ_OPTIONS = {**CSV_OPTIONS, "nullValue": "\x00", "emptyValue": "", "multiLine": "true"}
JSON_OPTIONS = dict(_TIMES)


def _cell(c: Column, dtype) -> Column:
    if isinstance(dtype, T.BinaryType):
        return binary_repr(c, None)
    if is_complex(dtype) or isinstance(dtype, (T.DayTimeIntervalType, T.YearMonthIntervalType, T.VariantType, T.NullType)):
        return c.cast("string")
    return c


def csv_ready(df: DataFrame) -> DataFrame:
    """Columns that CSV has no form for as text."""
    return df.select(*[_cell(qcol(f.name), f.dataType).alias(f.name) for f in df.schema.fields])


def csv_line_bytes(df: DataFrame) -> Column:
    """UTF-8 bytes of one CSV line (with its newline), as the CSV writer renders it."""
    cells = [_cell(qcol(f.name), f.dataType).alias(f.name) for f in df.schema.fields]
    return F.octet_length(F.to_csv(F.struct(*cells), CSV_OPTIONS)) + 1


def csv_header_bytes(df: DataFrame) -> int:
    """Bytes of the header line: names are quoted as the writer quotes texts."""
    if not df.columns:
        return 1
    names = df.sparkSession.range(1).select(F.to_csv(F.struct(*[F.lit(c).alias(f"c{k}") for k, c in enumerate(df.columns)]),
                                                     CSV_OPTIONS).alias("line"))
    return len(names.first()["line"].encode()) + 1


def csv_size(df: DataFrame) -> int:
    """Exact bytes of the table as one CSV with a header; 0 for no rows. One
    aggregate, the shape of a count."""
    total = df.agg(F.count(F.lit(1)).alias("n"), F.sum(csv_line_bytes(df)).alias("b")).first()
    return 0 if total["n"] == 0 else int(total["b"]) + csv_header_bytes(df)

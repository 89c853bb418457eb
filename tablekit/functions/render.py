"""Per-type cell expressions used when rows leave Spark (JSON-safe output).

All of these are built-in expressions (higher-order SQL functions included), so
they stay inside whole-stage code generation; no Python UDF is involved.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .types import is_duration, is_integral, is_string

# Output limits.
MAX_STRING_LENGTH = 1000
BINARY_PREFIX_BYTES = (MAX_STRING_LENGTH - 3) // 4   # 249: worst case 4 chars per byte
LARGE_NUMBER = 2 ** 53                                # beyond this JS numbers lose precision


def cut_text(c: Column, n: int | None = MAX_STRING_LENGTH) -> Column:
    return c if n is None else F.substring(c, 1, n)


def binary_repr(c: Column, max_bytes: int | None = BINARY_PREFIX_BYTES) -> Column:
    """Python-style ``b'...'`` text of the first ``max_bytes`` bytes (None: all).

    Printable ASCII stays, ``\\t \\n \\r \\\\`` and the quote are escaped, other
    bytes become ``\\xNN``; the quote is ``"`` only when the bytes hold a ``'``
    and no ``"``, as Python chooses it.

    Linear per cell: the bytes are decoded as ISO-8859-1 (one character per
    byte, so ``ascii`` gives the byte value back) and the quote code travels
    next to each byte through ``zip_with``; a lambda that referred to the
    whole cell would be re-evaluated for every byte.
    """
    head = c if max_bytes is None else F.substring(c, 1, max_bytes)
    n = F.length(head)
    # splitting on "" leaves a trailing empty piece: keep exactly one char per byte
    chars = F.slice(F.split(F.decode(head, "ISO-8859-1"), ""), 1, n)
    codes = F.when(n > 0, F.transform(chars, lambda ch: F.ascii(ch))).otherwise(F.array().cast("array<int>"))
    dq = F.array_contains(codes, 39) & ~F.array_contains(codes, 34)
    qcode = F.when(dq, F.lit(34)).otherwise(F.lit(39))

    def one(x, q):
        return (F.when(x == 92, F.lit("\\\\"))
                .when(x == q, F.concat(F.lit("\\"), F.chr(q)))
                .when(x == 9, F.lit("\\t"))
                .when(x == 10, F.lit("\\n"))
                .when(x == 13, F.lit("\\r"))
                .when((x >= 32) & (x <= 126), F.chr(x))
                .otherwise(F.concat(F.lit("\\x"), F.lower(F.lpad(F.hex(x), 2, "0")))))

    body = F.array_join(F.zip_with(codes, F.array_repeat(qcode, F.size(codes)), one), "")
    quote = F.chr(qcode)
    return F.when(c.isNull(), F.lit(None)).otherwise(F.concat(F.lit("b"), quote, body, quote))


def json_safe(c: Column, dtype, as_text: bool = False, most_chars: int | None = MAX_STRING_LENGTH,
              most_bytes: int | None = BINARY_PREFIX_BYTES) -> Column:
    """Numbers and booleans stay typed; binary gets its ``b'...'`` form; text and
    every other type (dates, times, decimals, arrays, structs, maps, intervals)
    is text, cut to what a cell shows (None: whole)."""
    if not as_text:
        if isinstance(dtype, T.BinaryType):
            return binary_repr(c, most_bytes)
        if isinstance(dtype, (T.BooleanType, T.ByteType, T.ShortType, T.IntegerType,
                              T.LongType, T.FloatType, T.DoubleType)):
            return c
    return cut_text(c if is_string(dtype) else c.cast("string"), most_chars)


def is_large(c: Column, dtype) -> Column:
    """|x| > 2^53 (infinities included, NaN not). Written without ``abs`` so
    ``Long.MinValue`` cannot overflow under ANSI mode."""
    bound = F.lit(LARGE_NUMBER) if is_integral(dtype) else F.lit(float(LARGE_NUMBER))
    return (c > bound) | (c < -bound)


def duration_seconds(c: Column) -> Column:
    """Day-time interval -> seconds as double (1 day -> 86400.0)."""
    return c.cast("decimal(38,6)").cast("double")


def is_large_candidate(dtype) -> bool:
    return isinstance(dtype, (T.LongType, T.FloatType, T.DoubleType, T.DecimalType)) and not is_duration(dtype)

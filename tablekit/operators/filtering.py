"""Apply a filter list to a table as one lazy ``df.filter``."""

from __future__ import annotations

import datetime as dt
import logging
from typing import Iterable

from pyspark.sql import DataFrame

from ..functions.predicates import compile_filters
from ..functions.spec import Condition, read_conditions

log = logging.getLogger(__name__)


def apply_filters(df: DataFrame, filters: Iterable[Condition] | str | None,
                  today: dt.date | None = None, skipped: list | None = None) -> DataFrame:
    """AND all filters into one predicate (Catalyst splits the conjunction and
    pushes what it can to the scan). No applicable filter -> ``df`` unchanged.

    Filters naming unknown columns, with missing or unparseable values are left
    out; pass a list as ``skipped`` to receive ``(filter, reason)`` pairs.
    """
    if isinstance(filters, str) or filters is None:
        filters = read_conditions(filters)
    compiled = compile_filters(list(filters), df.schema, today)
    for f, why in compiled.skipped:
        log.warning("skipping filter %s on %r: %s", f.operator.value, f.column, why)
    if skipped is not None:
        skipped.extend(compiled.skipped)
    return df if compiled.predicate is None else df.filter(compiled.predicate)


def filter_by_spec(df: DataFrame, spec_json: str, today: dt.date | None = None) -> DataFrame:
    """JSON filter list (``column/operator/comparativeValues`` or legacy
    ``{id, value, type: contains}``) -> filtered table. A bad operator or a
    missing key raises ``SpecError``."""
    return apply_filters(df, read_conditions(spec_json), today)

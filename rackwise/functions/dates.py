"""Ages and date ranges, measured against an explicit ``as_of`` instead of the wall clock.

``as_of`` is a ``date`` (midnight) or a naive ``datetime`` in UTC. Dates in the tables are whole
days, so every age test can be turned into a comparison of the bare column with one literal
date. That form reaches the Parquet scan as a pushed filter, unlike arithmetic on the column.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable
from functools import wraps

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def day_of(as_of: dt.date | dt.datetime) -> dt.date:
    return as_of.date() if isinstance(as_of, dt.datetime) else as_of


def default_period(as_of: dt.date | dt.datetime) -> tuple[dt.date, dt.date]:
    """The last 30 days, both ends included."""
    return day_of(as_of) - dt.timedelta(days=30), day_of(as_of)


def over_period(report: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
    """A report on ``start`` to ``end``; called with ``as_of`` instead, it covers ``default_period``."""

    @wraps(report)
    def run(t, start: dt.date | None = None, end: dt.date | None = None, *args, as_of: dt.date | dt.datetime | None = None, **kwargs) -> DataFrame:
        if start is None and end is None and as_of is not None:
            start, end = default_period(as_of)
        if start is None or end is None:
            raise ValueError("give start and end, or as_of for the last 30 days")
        return report(t, start, end, *args, **kwargs)

    return run


def _first_day_not_older(as_of: dt.date | dt.datetime, days: int) -> dt.date:
    """The earliest date whose age at ``as_of`` is at most ``days``."""
    cutoff = day_of(as_of) - dt.timedelta(days=days)
    if isinstance(as_of, dt.datetime) and as_of.time() != dt.time.min:
        cutoff += dt.timedelta(days=1)
    return cutoff


def older_than(column: str | Column, as_of: dt.date | dt.datetime, days: int) -> Column:
    """True where the age at ``as_of`` is more than ``days``; NULL for a NULL date."""
    return _col(column) < F.lit(_first_day_not_older(as_of, days))


def at_most_old(column: str | Column, as_of: dt.date | dt.datetime, days: int) -> Column:
    """True where the age at ``as_of`` is ``days`` or less (dates after ``as_of`` included)."""
    return _col(column) >= F.lit(_first_day_not_older(as_of, days))


def since(column: str | Column, as_of: dt.date | dt.datetime, days: int) -> Column:
    """True from ``days`` calendar days before ``as_of`` on, without an upper bound."""
    return _col(column) >= F.lit(day_of(as_of) - dt.timedelta(days=days))


def in_period(column: str | Column, start: dt.date, end: dt.date) -> Column:
    return (_col(column) >= F.lit(start)) & (_col(column) <= F.lit(end))


def age_in_days(column: str | Column, as_of: dt.date | dt.datetime) -> Column:
    """Age as a double, with the fraction of the day that ``as_of`` carries."""
    fraction = 0.0
    if isinstance(as_of, dt.datetime):
        fraction = (as_of - dt.datetime.combine(as_of.date(), dt.time.min)) / dt.timedelta(days=1)
    return F.datediff(F.lit(day_of(as_of)), _col(column)) + F.lit(fraction)


def _col(column: str | Column) -> Column:
    return F.col(column) if isinstance(column, str) else column

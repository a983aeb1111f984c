"""Markdown automation: which items are due for a lower price, and moving them there."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rackwise.functions.columns import in_stock
from rackwise.functions.dates import older_than
from rackwise.functions.fixed_values import MARKDOWN_AGES, PENDING_LABEL
from rackwise.sources.tables import Tables


def steps_due(as_of: dt.date) -> Column:
    """True where the item is old enough for the stage right after its own."""
    steps = [older_than("listed_at", as_of, age) & (F.col("markdown_stage") == stage - 1) for stage, age in MARKDOWN_AGES.items()]
    return reduce(lambda a, b: a | b, steps)


def label_due(as_of: dt.date) -> Column:
    """The label of the stage an item should be at by now, NULL if it is there."""
    target = None
    for stage, age in sorted(MARKDOWN_AGES.items(), reverse=True):
        late = older_than("listed_at", as_of, age) & (F.col("markdown_stage") < stage)
        label = F.lit(PENDING_LABEL[stage])
        target = F.when(late, label) if target is None else target.when(late, label)
    return target


def _pending(t: Tables, as_of: dt.date) -> DataFrame:
    """Items in stock behind their schedule, as the label of the stage they should be at by now."""
    return t.items.filter(in_stock()).select(label_due(as_of).alias("update_needed")).filter(F.col("update_needed").isNotNull())


def pending_markdowns(t: Tables, as_of: dt.date) -> DataFrame:
    """Number of items in stock per stage they should be at by now; items already there are left out."""
    counts = _pending(t, as_of).groupBy("update_needed").agg(F.count("*").alias("qty"))
    return counts.orderBy(F.col("qty").desc(), "update_needed")


def pending_total(t: Tables, as_of: dt.date) -> DataFrame:
    """Number of items in stock behind their schedule, over all stages."""
    return _pending(t, as_of).agg(F.count("*").alias("pending_total"))


def _cascade(as_of: dt.date) -> list[tuple[int, Column, Column]]:
    """For stages 1 to 3: (stage, whether the item steps onto it, its stage after that step)."""
    current, steps = F.col("markdown_stage"), []
    for stage, age in MARKDOWN_AGES.items():
        moves = F.coalesce(in_stock() & (current == stage - 1) & older_than("listed_at", as_of, age), F.lit(False))
        current = F.when(moves, F.lit(stage)).otherwise(current)
        steps.append((stage, moves, current))
    return steps


def apply_markdowns(items: DataFrame, as_of: dt.date) -> DataFrame:
    """Items with their stage raised as far as their age allows, in one projection.

    An item may climb several stages at once. No stage is lowered; sold and inactive items, items
    without a listing date and stages outside 0 to 3 stay as they are.
    """
    return items.withColumn("markdown_stage", _cascade(as_of)[-1][2].cast("int"))


def markdown_transitions(items: DataFrame, as_of: dt.date) -> DataFrame:
    """Number of steps onto each stage in one run; an item climbing three stages counts three times."""
    steps = [F.count_if(moves).alias(f"to_stage_{stage}") for stage, moves, _ in _cascade(as_of)]
    counts = items.agg(*steps)
    return counts.withColumn("total_updated", reduce(lambda a, b: a + b, [F.col(c) for c in counts.columns]))

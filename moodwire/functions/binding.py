"""Keep costly expressions from being computed more than once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed a single time.

    An outer expression used inside a lambda is computed again for every element; a lambda
    variable is not.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def computed_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a column that later filters read instead of computing it again.

    The optimizer moves a filter below the projection it reads from and copies the expression into
    it; it does not move a filter below the ``explode`` of a list of one.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))


def unrolled(
    df: DataFrame, keep: list, items: Column, pos: str = "pos", item: str = "item"
) -> DataFrame:
    """One row per list element, with its position; null and empty lists give none.

    A plain ``explode`` makes the optimizer infer a filter on the list, which computes the list
    expression again below; an outer one with the filter on top computes it once.
    """
    opened = df.select(*keep, F.posexplode_outer(items).alias(pos, item))
    return opened.filter(F.col(pos).isNotNull())

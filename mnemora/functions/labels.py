"""The sensitivity lattice: four ordered labels and a top that no ceiling admits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The labels in order.
LABELS = ("public", "personal", "sensitive", "restricted")
UNKNOWN = 99
DEFAULT = 1


def rank(label: Column, default: int = DEFAULT) -> Column:
    """0 to 3; null counts as `default`, anything else as UNKNOWN."""
    out = F.when(label.isNull(), F.lit(default))
    for k, name in enumerate(LABELS):
        out = out.when(label == name, F.lit(k))
    return out.otherwise(F.lit(UNKNOWN))


def name_of(ranked: Column) -> Column:
    out = F.when(ranked == 0, F.lit(LABELS[0]))
    for k, name in enumerate(LABELS[1:], 1):
        out = out.when(ranked == k, F.lit(name))
    return out.otherwise(F.lit("unknown"))


def highest(ranked: Column) -> Column:
    """Aggregate: the maximum; a null member fails closed, no member at all is `personal`."""
    return F.coalesce(F.max(F.coalesce(ranked, F.lit(UNKNOWN))), F.lit(DEFAULT))


def _known(label: str) -> int:
    if label not in LABELS:
        raise ValueError(f"unknown sensitivity label: {label!r}")
    return LABELS.index(label)


def narrowed(server: str, requested: str | None = None) -> str:
    """The ceiling in force: a request can only lower the server's."""
    return LABELS[min(_known(server), _known(requested if requested is not None else server))]


def raised(floor: str, requested: str | None = None) -> str:
    """The label of an ingested record: a request can only raise the floor."""
    return LABELS[max(_known(floor), _known(requested if requested is not None else floor))]


def authorized(df: DataFrame, ceiling: str, ranked: str = "rank") -> DataFrame:
    """Rows at or below the ceiling. Filters on a column of the source, so it reaches the scan."""
    return df.where(F.col(ranked) <= _known(ceiling))

"""Order-dependent columns without a task that grows with its key.

Rows are dealt by ranges of (key, order) and written once, so a key with most rows lies in many parts. A row's place is its
number in its part after the sizes of the parts before; spans are cut by that place, so they hold a bounded number of rows
whatever the values of the order column are. What one span hands to the next is a summary row, and only those meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from mnemora.checkpoints import cut, free_name

SPAN = 1 << 16


def _named(columns: list[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in columns]


def numbered(df: DataFrame, key: list[str], order: list, name: str, total: str | None = None) -> DataFrame:
    """df with `name`: the row's place, from 0, among the rows of its key by `order` (names or columns; nulls as they sort), and
    `total`, the rows of its key. Rows equal in `order` follow each other in any order, the same one in every later reading.

    Two summary columns a key and part are joined back; only the summaries of a key meet in one task.
    """
    at, part, first, n, shift, all_ = (free_name(df, x) for x in ("at", "part", "first", "n", "shift", "all"))
    by = [*_named(key), *[F.col(f"`{c}`") if isinstance(c, str) else c for c in order]] or [F.lit(0)]
    placed = cut(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(at, F.monotonically_increasing_id()))
    placed = placed.withColumn(part, F.shiftright(F.col(at), 33))
    runs = placed.groupBy(*_named(key), part).agg(F.count(F.lit(1)).alias(n), F.min(at).alias(first))
    whole, before = W.partitionBy(*_named(key)), W.partitionBy(*_named(key)).orderBy(part).rowsBetween(W.unboundedPreceding, -1)
    runs = runs.withColumn(shift, F.coalesce(F.sum(n).over(before), F.lit(0)) - F.col(first)).withColumn(all_, F.sum(n).over(whole))
    a, b = placed.alias("a"), runs.alias("b")
    on = F.col(f"a.{part}") == F.col(f"b.{part}")
    for k in key:
        on = on & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    extra = [F.col(f"b.{all_}").alias(total)] if total else []
    return a.join(b, on).select(*[F.col(f"a.`{c}`") for c in df.columns], (F.col(f"a.{at}") + F.col(f"b.{shift}")).alias(name), *extra)


def _spans(df: DataFrame, key: list[str], order: str, span: int) -> tuple[DataFrame, str, str]:
    """df with each row's place among its key's rows and the span of that place, and both names."""
    at, of = free_name(df, "place"), free_name(df, "span")
    return numbered(df, key, [order], at).withColumn(of, F.floor(F.col(at) / span)), at, of


def _handed_on(df: DataFrame, summary: DataFrame, key: list[str], of: str) -> DataFrame:
    a, b = df.alias("a"), summary.alias("b")
    on = F.col(f"a.{of}") == F.col(f"b.{of}")
    for k in key:
        on = on & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
    return a.join(b, on, "left")


def with_previous(df: DataFrame, key: list[str], order: str, value: str, name: str, span: int = SPAN) -> DataFrame:
    """df with `name`: `value` of the row before by `order`, which is unique within a key; null for the first."""
    rows, at, of = _spans(df, key, order, span)
    prev, end, handed = free_name(rows, "prev"), free_name(rows, "end"), free_name(rows, "handed")
    boxed = F.struct(F.col(f"`{value}`").alias("v"))
    inner = rows.withColumn(prev, F.lag(boxed).over(W.partitionBy(*_named(key), of).orderBy(at)))
    last = rows.groupBy(*_named(key), of).agg(F.max_by(boxed, F.col(at)).alias(end))
    last = last.withColumn(handed, F.lag(end).over(W.partitionBy(*_named(key)).orderBy(of))).drop(end)
    out = _handed_on(inner, last, key, of)
    return out.select(*[F.col(f"a.`{c}`") for c in df.columns], F.coalesce(F.col(f"a.{prev}"), F.col(f"b.{handed}"))["v"].alias(name))


def with_sum_before(df: DataFrame, key: list[str], order: str, value: str, name: str, span: int = SPAN) -> DataFrame:
    """df with `name`: the sum of `value` over the rows before by `order`, unique within a key; 0 for the first."""
    rows, at, of = _spans(df, key, order, span)
    own, total, handed = free_name(rows, "own"), free_name(rows, "total"), free_name(rows, "handed")
    here = W.partitionBy(*_named(key), of).orderBy(at).rowsBetween(W.unboundedPreceding, -1)
    inner = rows.withColumn(own, F.coalesce(F.sum(f"`{value}`").over(here), F.lit(0)))
    totals = rows.groupBy(*_named(key), of).agg(F.sum(f"`{value}`").alias(total))
    before = W.partitionBy(*_named(key)).orderBy(of).rowsBetween(W.unboundedPreceding, -1)
    totals = totals.withColumn(handed, F.coalesce(F.sum(total).over(before), F.lit(0))).drop(total)
    out = _handed_on(inner, totals, key, of)
    return out.select(*[F.col(f"a.`{c}`") for c in df.columns], (F.col(f"a.{own}") + F.coalesce(F.col(f"b.{handed}"), F.lit(0))).alias(name))


def with_next(df: DataFrame, key: list[str], order: list[str], value: str, name: str, span: int = SPAN) -> DataFrame:
    """df with `name`: the first `value` that is not null among the rows after, by `order`; null where there is none."""
    at = free_name(df, "place")
    rows = numbered(df, key, order, at)
    of = free_name(rows, "span")
    rows = rows.withColumn(of, F.floor(F.col(at) / span))
    own, head, later = free_name(rows, "own"), free_name(rows, "head"), free_name(rows, "later")
    here = W.partitionBy(*_named(key), of).orderBy(at).rowsBetween(1, W.unboundedFollowing)
    inner = rows.withColumn(own, F.first(f"`{value}`", ignorenulls=True).over(here))
    heads = rows.groupBy(*_named(key), of).agg(F.min_by(f"`{value}`", F.when(F.col(f"`{value}`").isNotNull(), F.col(at))).alias(head))
    after = W.partitionBy(*_named(key)).orderBy(of).rowsBetween(1, W.unboundedFollowing)
    heads = heads.withColumn(later, F.first(head, ignorenulls=True).over(after)).drop(head)
    out = _handed_on(inner, heads, key, of)
    return out.select(*[F.col(f"a.`{c}`") for c in df.columns], F.coalesce(F.col(f"a.{own}"), F.col(f"b.{later}")).alias(name))

"""Running values over ordered rows of which a single group may hold nearly all: a segmented scan by ranges.

Rows are dealt out by ranges of (group, order). Each range gives one total for each group in it, totals are carried over the
ranges of a group (as many rows as ranges), and within a range values run as usual. So no task sees more than a range, however
large a group is, and no window is without a partition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..shared import kept

_KINDS = {"sum": (F.sum, lambda a, b: F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": (F.max, F.greatest)}


def running(rows: DataFrame, by: list[str], order: list[str], inclusive: bool = True, **values: tuple[str, Column]) -> DataFrame:
    """``rows`` with, for each of ``values`` (its kind, sum or max, and what is added up), its running value among the rows of the
    same group (of columns ``by``, nulls are a group) up to each row, in the total order of ``order``; without the row itself unless
    ``inclusive``. A maximum of structs that begin with the order is the last row that has one."""
    own = {n: f"__{n}" for n in values}
    group, place = [f"__by{k}" for k in range(len(by))] or ["__all"], "__range"
    named = rows.withColumns({own[n]: c for n, (_, c) in values.items()} | ({g: F.col(b) for g, b in zip(group, by, strict=True)} if by else {"__all": F.lit(0)}))
    parted = kept(named.repartitionByRange(*group, *order).withColumn(place, F.spark_partition_id()))
    totals = parted.groupBy(place, *group).agg(*(_KINDS[kind][0](own[n]).alias(own[n]) for n, (kind, _) in values.items()))
    before = W.partitionBy(*group).orderBy(place).rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(F.col(place).alias("__of"), *(F.col(g).alias(f"{g}_of") for g in group), *(_KINDS[kind][0](own[n]).over(before).alias(f"{own[n]}_carried") for n, (kind, _) in values.items()))
    same = F.col(place) == F.col("__of")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}_of"))
    inner = W.partitionBy(place, *group).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    out = parted.join(carried, same, "left")
    return out.select(*rows.columns, *(_KINDS[kind][1](F.col(f"{own[n]}_carried"), _KINDS[kind][0](own[n]).over(inner)).alias(n) for n, (kind, _) in values.items()))


def numbered(rows: DataFrame, by: list[str], order: list[str], start: int = 0) -> DataFrame:
    """``rows`` (narrow ones) with their number within the group, from ``start`` + 1 on."""
    out = running(rows, by, order, number=("sum", F.lit(1).cast("long")))
    return out.withColumn("number", F.col("number") + start)

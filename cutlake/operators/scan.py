"""Running aggregates over long ordered groups without one task per group.

A plain ``Window.partitionBy(key).orderBy(t)`` sorts a whole key in one task. Here
the order axis is cut into fixed-width cells: each (key, cell) is scanned on its
own, one summary row per cell is scanned per key, and the two are combined. With
at most one row per (key, order value) - callers aggregate first - a cell never
holds more rows than it is wide, however hot its key.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cutlake.functions.arith import grid_floor

CELL = 1 << 21  # order units per cell; also the most rows one cell can hold

_CELL = "__cell"


@dataclass(frozen=True)
class Scan:
    """One running column: ``how`` is sum, max, min, last (backward) or first (forward)."""

    name: str
    how: str
    value: Column
    inclusive: bool = True


def _local(scan: Scan, keys: Sequence[str], order: str) -> Column:
    # A frame that shrinks from the front is worked out anew for every row, so ``first`` is a
    # ``last`` in descending order.
    w = Window.partitionBy(*keys, _CELL).orderBy(F.desc(order) if scan.how == "first" else F.asc(order))
    w = w.rowsBetween(Window.unboundedPreceding, 0 if scan.inclusive else -1)
    if scan.how in ("first", "last"):
        return F.last(scan.value, ignorenulls=True).over(w)
    return getattr(F, scan.how)(scan.value).over(w)


def _cell_total(scan: Scan, order: str) -> Column:
    if scan.how == "last":
        return F.max_by(scan.value, F.when(scan.value.isNotNull(), F.col(order)))
    if scan.how == "first":
        return F.min_by(scan.value, F.when(scan.value.isNotNull(), F.col(order)))
    return getattr(F, scan.how)(scan.value)


def _carry(scan: Scan, keys: Sequence[str]) -> Column:
    w = Window.partitionBy(*keys).orderBy(F.desc(_CELL) if scan.how == "first" else F.asc(_CELL))
    w = w.rowsBetween(Window.unboundedPreceding, -1)
    total = F.col(f"__t_{scan.name}")
    if scan.how in ("first", "last"):
        return F.last(total, ignorenulls=True).over(w)
    return getattr(F, scan.how)(total).over(w)


def _combine(scan: Scan) -> Column:
    local, carry = F.col(f"__l_{scan.name}"), F.col(f"__c_{scan.name}")
    if scan.how == "sum":
        return F.coalesce(local + carry, local, carry)
    if scan.how == "max":
        return F.greatest(local, carry)
    if scan.how == "min":
        return F.least(local, carry)
    return F.coalesce(local, carry)


def cell_totals(cells: DataFrame, keys: Sequence[str], totals: Sequence[Column]) -> DataFrame:
    """One summary row per (key, cell).

    The summary reads every column the rows keep - the hash is never NULL - because
    only then do both uses of ``cells`` prune to the same columns and share its exchange.
    """
    rest = [c for c in cells.columns if c not in (*keys, _CELL)]
    seen = F.max(F.xxhash64(*rest)).alias("__seen")
    own = [F.max(c).alias(f"__k_{c}") for c in (*keys, _CELL)]
    out = cells.groupBy(*keys, _CELL).agg(*totals, *own, seen)
    return out.where(F.col("__seen").isNotNull()).drop("__seen")


def joined_on(keys: Sequence[str]) -> list[Column]:
    """The keys of ``cell_totals`` for the join back to the rows.

    They are aggregates, so that the null filters Spark infers for the summed side of a left join
    stay above the summary; below it they would make the two uses of one exchange differ.
    """
    return [F.col(f"__k_{c}").alias(c) for c in (*keys, _CELL)]


def chunked_scan(
    df: DataFrame, keys: Sequence[str], order: str, scans: Sequence[Scan], cell: int = CELL
) -> DataFrame:
    """Add the running columns. Rows must be unique per (keys, order)."""
    keys = list(keys)
    cells = df.withColumn(_CELL, grid_floor(order, cell)).repartition(*keys, _CELL)
    totals = cell_totals(cells, keys, [_cell_total(s, order).alias(f"__t_{s.name}") for s in scans])
    carries = totals.select(*joined_on(keys), *[_carry(s, keys).alias(f"__c_{s.name}") for s in scans])
    local = cells.withColumns({f"__l_{s.name}": _local(s, keys, order) for s in scans})
    joined = local.join(carries, [*keys, _CELL], "left")
    return joined.select(*df.columns, *[_combine(s).alias(s.name) for s in scans])


def ranked(
    df: DataFrame, keys: Sequence[str], order: str, tie: str, name: str, cell: int = CELL
) -> DataFrame:
    """Add the 1-based rank by (order, tie) within keys. ``tie`` is a unique BIGINT.

    Rows are counted per slot - one order value and one cell of the tie column - so
    even a single hot (key, order) pair is spread over tasks.
    """
    keys = list(keys)
    slots = df.withColumns({"__tie": grid_floor(tie, cell), _CELL: grid_floor(order, cell)})
    counts = slots.groupBy(*keys, _CELL, order, "__tie").agg(F.count(F.lit(1)).alias("__n"))
    # Row counts before each slot: inside its cell, plus whole cells before it.
    cells = counts.repartition(*keys, _CELL)
    before = Window.partitionBy(*keys, _CELL).orderBy(order, "__tie")
    before = before.rowsBetween(Window.unboundedPreceding, -1)
    local = cells.withColumn("__o", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    totals = cell_totals(cells, keys, [F.sum("__n").alias("__m")])
    whole = Window.partitionBy(*keys).orderBy(_CELL).rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(*keys, _CELL, F.coalesce(F.sum("__m").over(whole), F.lit(0)).alias("__c"))
    # Left joins: every row finds its partner, and no null filters are inferred that
    # would make the two uses of one exchange differ.
    offsets = local.join(carries, [*keys, _CELL], "left").select(
        *keys, order, "__tie", (F.col("__o") + F.col("__c")).alias("__o")
    )
    in_slot = F.row_number().over(Window.partitionBy(*keys, order, "__tie").orderBy(tie))
    return (
        slots.withColumn("__r", in_slot)
        .join(offsets, [*keys, order, "__tie"], "left")
        .select(*df.columns, (F.col("__o") + F.col("__r")).cast("bigint").alias(name))
    )


def new_ids(
    rows: DataFrame, existing: DataFrame, keys: Sequence[str], id_col: str, order: str, tie: str
) -> DataFrame:
    """Fill ``id_col`` with max existing id per key plus the rank by (order, tie)."""
    keys = list(keys)
    top = existing.groupBy(*keys).agg(F.max(id_col).alias("__top"))
    out = ranked(rows.drop(id_col), keys, order, tie, "__rank")
    return (
        out.join(top, keys, "left")
        .withColumn(id_col, F.coalesce("__top", F.lit(-1)) + F.col("__rank"))
        .drop("__top", "__rank")
    )

"""Scans over ordered rows without one task for a key.

A window over all rows, or over a key that holds a third of them, sorts them in
one task.  Here rows are dealt by ranges of (key, order) first, so a large key
spreads over many partitions; each partition is summed up in one row a key, an
exclusive scan over these few rows gives every partition what comes before it
(or after it), and the windows run inside partitions only.

The ranges come from Spark's sample of the order columns and are fixed by a
checkpoint, so both passes see the same partitions.  Rows that are equal in all
of key and order share a partition; give a tie-breaker where such rows can be
many.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from episodeframe.lineage import cut

PART, PLACE = "_part", "_place"


def ranged(df: DataFrame, order: list[str | Column], ties: list[str | Column] = ()) -> DataFrame:
    """``df`` in order over its partitions, with ``_part`` and ``_place`` (from 0 within the partition).

    Spark's sample of ``order`` passes through the driver; what is long or only
    breaks ties belongs to ``ties``, which sort within partitions.
    """
    sorted_ = df.repartitionByRange(*order).sortWithinPartitions(*order, *ties)
    # Partition and place, as Spark packs them.
    numbered = sorted_.withColumn(PLACE, F.monotonically_increasing_id())
    return cut(numbered.withColumn(PART, F.shiftright(PLACE, 33).cast("int")).withColumn(PLACE, F.col(PLACE).bitwiseAND((1 << 33) - 1)))


def row_numbers(df: DataFrame, order: list[str | Column], out: str = "row_number", ties: list[str | Column] = ()) -> DataFrame:
    """Adds ``out``: the place of every row in the order of the whole table, from 1.

    One shuffle by range; what is broadcast has one row a partition.
    """
    rows = ranged(df, order, ties)
    sizes = rows.groupBy(PART).agg(F.count(F.lit(1)).alias("_n"))
    before = sizes.select(PART, (F.sum("_n").over(Window.orderBy(PART)) - F.col("_n")).alias("_before"))
    return rows.join(F.broadcast(before), PART).withColumn(out, F.col("_before") + F.col(PLACE) + 1).drop(PART, PLACE, "_before")


@dataclass(frozen=True)
class Running:
    """A running aggregate: ``kind`` is sum, count, min, max or last; ``reverse`` runs from the last row back.

    ``exclusive`` leaves the row itself out.  Null inputs are passed over, as
    Spark's aggregates do; ``last`` keeps them.
    """

    kind: str
    value: Column | None = None
    reverse: bool = False
    exclusive: bool = False


_FOLD = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def _merge(kind: str, before: Column, own: Column) -> Column:
    if kind in ("sum", "count"):
        return F.when(before.isNull(), own).when(own.isNull(), before).otherwise(before + own)
    return F.least(before, own) if kind == "min" else F.greatest(before, own)


def running(df: DataFrame, order: list[str | Column], by: list[str], columns: dict[str, Running]) -> DataFrame:
    """Adds the running aggregates ``columns`` of every key (null is a key of its own), in ``order``.

    Only keys that lie on several partitions need what comes before; each border
    of partitions splits one key at most, so what is broadcast is bounded by the
    number of partitions.
    """
    keys = list(by)
    rows = ranged(df, [*(F.col(k) for k in keys), *order])
    inside = Window.partitionBy(*keys, PART).orderBy(PLACE)
    spans = {
        (False, False): inside.rowsBetween(Window.unboundedPreceding, Window.currentRow),
        (False, True): inside.rowsBetween(Window.unboundedPreceding, -1),
        (True, False): inside.rowsBetween(Window.currentRow, Window.unboundedFollowing),
        (True, True): inside.rowsBetween(1, Window.unboundedFollowing),
    }
    value = lambda c: F.lit(1) if c.value is None else c.value

    def whole(c: Running) -> Column:
        if c.kind == "last":
            return (F.min_by if c.reverse else F.max_by)(F.struct(value(c).alias("v")), F.col(PLACE))
        return F.count(value(c)) if c.kind == "count" else _FOLD[c.kind](value(c))

    def local(c: Running) -> Column:
        span = spans[c.reverse, c.exclusive]
        if c.kind == "last":
            # A struct, so that a null value still counts as the last one.
            return (F.first if c.reverse else F.last)(F.struct(value(c).alias("v"))).over(span)
        return F.count(value(c)).over(span) if c.kind == "count" else _FOLD[c.kind](value(c)).over(span)

    parts = rows.groupBy(*keys, PART).agg(*(whole(c).alias(f"_w{i}") for i, c in enumerate(columns.values())))
    split = parts.groupBy(*keys).agg(F.count(F.lit(1)).alias("_parts")).where("_parts > 1")
    same = [F.col(f"p.{k}").eqNullSafe(F.col(f"s.{k}")) for k in keys]
    few = parts.alias("p").join(split.alias("s"), same, "left_semi") if keys else parts
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))

    def ahead(i: int, c: Running) -> Column:
        own = over.orderBy(F.col(PART).desc() if c.reverse else F.col(PART)).rowsBetween(Window.unboundedPreceding, -1)
        return (F.last(f"_w{i}") if c.kind == "last" else _FOLD[c.kind](f"_w{i}")).over(own).alias(f"_b{i}")

    before = few.select(*keys, PART, *(ahead(i, c) for i, c in enumerate(columns.values())))
    both = rows.select("*", *(local(c).alias(f"_l{i}") for i, c in enumerate(columns.values()))).alias("r")
    meet = [F.col(f"r.{PART}") == F.col(f"b.{PART}"), *(F.col(f"r.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys)]
    joined = both.join(F.broadcast(before).alias("b"), meet, "left")

    def result(i: int, c: Running) -> Column:
        own, ahead_ = F.col(f"r._l{i}"), F.col(f"b._b{i}")
        if c.kind == "last":
            return F.coalesce(own, ahead_)["v"]
        merged = _merge(c.kind, ahead_, own)
        return F.coalesce(merged, F.lit(0).cast("bigint")) if c.kind == "count" else merged

    return joined.select(*(F.col(f"r.`{c}`") for c in df.columns), *(result(i, c).alias(name) for i, (name, c) in enumerate(columns.items())))


def beside(df: DataFrame, groups: DataFrame, keys: list[str]) -> DataFrame:
    """The values of each group beside its rows, null keys included; without keys ``groups`` has one row."""
    if not keys:
        return df.crossJoin(groups)
    named = groups.withColumnsRenamed({k: f"_g_{k}" for k in keys})
    meet = [F.col(k).eqNullSafe(F.col(f"_g_{k}")) for k in keys]
    return df.join(named, meet).drop(*(f"_g_{k}" for k in keys))

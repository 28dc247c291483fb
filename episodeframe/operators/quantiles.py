"""Exact quantiles of value sets of any size.

``percentile`` keeps one entry for each different value of a group in one
buffer.  Here a mergeable sketch of the different values cuts every group into
``CELLS`` cells of about equally many; exact counts of the cells tell in which
of them a rank lies; and only the few cells that hold a wanted rank are sorted,
a cell a task.  The sketch decides the sizes of the cells, never the result.
All steps are one lazy plan over the distribution table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: cells of a group, and the accuracy of the sketch that cuts them
CELLS, ACCURACY = 128, 2_000


def _with(left: DataFrame, right: DataFrame, by: list[str]) -> DataFrame:
    """Group values beside the rows of their group; without groups ``right`` has one row."""
    return left.join(right, by) if by else left.crossJoin(right)


def values_at(dist: DataFrame, by: list[str], ranks: dict[str, Column], value: str = "score", n: str = "n") -> DataFrame:
    """(keys, _total, <name> for each rank): the value of rank r (from 0) among all rows of a group.

    ``dist`` is (keys, value, n) with every value of a group once; the columns
    of ``ranks`` may use ``_total``, the number of rows, and are clipped to it.
    """
    by = list(by)
    cuts = F.percentile_approx(value, F.array(*(F.lit(i / CELLS) for i in range(1, CELLS))), F.lit(ACCURACY))
    groups = dist.groupBy(*by).agg(cuts.alias("_cuts"), F.sum(n).alias("_total"))
    cell = F.aggregate("_cuts", F.lit(0), lambda acc, c: acc + (F.col(value) > c).cast("int"))
    celled = _with(dist, groups, by).select(*by, F.col(value).alias("_x"), F.col(n).alias("_n"), "_total", cell.alias("_cell"))
    counts = celled.groupBy(*by, "_cell").agg(F.sum("_n").alias("_in"), F.first("_total").alias("_total"))
    # A group has CELLS rows here at most.
    upto = F.sum("_in").over(Window.partitionBy(*(by or [F.lit(0)])).orderBy("_cell"))
    asked = F.array(*(F.struct(F.lit(name).alias("name"), F.greatest(F.lit(0), F.least(r.cast("bigint"), F.col("_total") - 1)).alias("rank")) for name, r in ranks.items()))
    placed = counts.withColumn("_upto", upto).withColumn("_asked", asked)
    here = F.filter("_asked", lambda a: (a["rank"] < F.col("_upto")) & (a["rank"] >= F.col("_upto") - F.col("_in")))
    wanted = placed.select(*by, "_cell", (F.col("_upto") - F.col("_in")).alias("_before"), here.alias("_here")).where(F.size("_here") > 0)
    inside = celled.join(wanted, [*by, "_cell"])
    run = F.col("_before") + F.sum("_n").over(Window.partitionBy(*by, "_cell").orderBy("_x"))
    hits = inside.withColumn("_run", run).select(*by, "_x", "_total", F.explode(F.filter("_here", lambda a: (a["rank"] < F.col("_run")) & (a["rank"] >= F.col("_run") - F.col("_n")))).alias("_hit"))
    return hits.groupBy(*by).agg(F.first("_total").alias("_total"), *(F.max(F.when(F.col("_hit.name") == name, F.col("_x"))).alias(name) for name in ranks))


def quantiles(dist: DataFrame, by: list[str], levels: dict[str, float], value: str = "score", n: str = "n") -> DataFrame:
    """(keys, <name> for each level): quantiles with linear interpolation between neighbouring ranks."""
    place = {name: F.lit(float(p)) * (F.col("_total") - 1) for name, p in levels.items()}
    ranks = {f"_{side}{i}": f(place[name]) for i, name in enumerate(levels) for side, f in (("l", F.floor), ("h", F.ceil))}
    found = values_at(dist, by, ranks, value, n)

    def between(i: int, name: str) -> Column:
        low, high, at = F.col(f"_l{i}"), F.col(f"_h{i}"), place[name]
        inner = (F.ceil(at) - at) * low + (at - F.floor(at)) * high
        return F.when((low == high) | (F.ceil(at) == F.floor(at)), low).otherwise(inner)

    return found.select(*by, *(between(i, name).alias(name) for i, name in enumerate(levels)))

"""Ranks, running sums and neighbours in ordered groups of any size.

A window over a group sorts all of it in one task. Here the rows are range-partitioned by group and order, so a long group
lies in many partitions; what each partition adds to a group is counted and carried on to the next ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..shared import written

#: Consecutive places of a group that one task looks at with the neighbours before them.
BLOCK = 1 << 16


def _same(keys: list[str], prefix: str) -> Column:
    same = F.col("_part") == F.col(f"{prefix}part")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"{prefix}{i}"))
    return same


def _dealt(rows: DataFrame, within: list[str], order: list[str | Column]) -> DataFrame:
    """rows sorted over the session's number of partitions, written with their partition and place there. Which partition
    a row falls into is found by sampling, so the table must be written before two things are computed from it."""
    keys = [*within, *order]
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = rows.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return written(dealt.withColumns({"_part": F.spark_partition_id(), "_at": F.monotonically_increasing_id()}))


def _carried(table: DataFrame, within: list[str], amount: Column) -> DataFrame:
    """table with _first (the first _at of the row's group in its partition), _before (what the partitions before add up
    to) and _all (of the group): one row for each group and partition is joined, which no long group makes many of."""
    ends = table.groupBy(*within, "_part").agg(F.min("_at").alias("_first"), amount.alias("_n"))
    group = Window.partitionBy(*(within or [F.lit(1)]))  # over partitions, not over rows
    ends = ends.withColumns({"_before": F.sum("_n").over(group.orderBy("_part")) - F.col("_n"), "_all": F.sum("_n").over(group)}).drop("_n")
    ends = ends.withColumnsRenamed({"_part": "_end_part"} | {k: f"_end_{i}" for i, k in enumerate(within)})
    return table.join(ends, _same(within, "_end_")).drop("_end_part", *[f"_end_{i}" for i in range(len(within))])


def ranked(rows: DataFrame, within: list[str], order: list[str | Column], name: str, total: str | None = None) -> DataFrame:
    """rows with their rank from 1 by order among the rows of equal within columns (nulls are equal), and the number of
    these rows as total. Rows that tie are ranked in any order, so an order should be one of all rows."""
    out = _carried(_dealt(rows, within, order), within, F.count("*"))
    out = out.withColumn(name, F.col("_at") - F.col("_first") + 1 + F.col("_before"))
    if total:
        out = out.withColumn(total, F.col("_all"))
    return out.drop("_part", "_at", "_first", "_before", "_all")


def running(rows: DataFrame, within: list[str], order: list[str | Column], amount: str, name: str, total: str) -> DataFrame:
    """rows with the running sum of a number, the row's own included, by order within groups, and with the group's total."""
    out = _carried(_dealt(rows, within, order), within, F.sum(amount))
    here = Window.partitionBy(*within, "_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    out = out.withColumns({name: F.col("_before") + F.sum(amount).over(here), total: F.col("_all")})
    return out.drop("_part", "_at", "_first", "_before", "_all")


def with_neighbours(rows: DataFrame, place: str, before: int, block: int = BLOCK) -> DataFrame:
    """rows of ranked() in blocks of consecutive places: _block, and _own, false for copies of the rows that stand up to
    before places ahead of a block. A window by group and _block then sees those neighbours and no whole group."""
    size = max(block, before)
    own = ((F.col(place) - 1) / size).cast("long")
    ends = (F.col(place) - 1) % size >= size - before
    out = rows.withColumn("_block", F.explode(F.when(ends, F.array(own, own + 1)).otherwise(F.array(own))))
    return out.withColumn("_own", F.col("_block") == own)


def exact_medians(counts: DataFrame, within: list[str], value: str, number: str, name: str) -> DataFrame:
    """The exact median of each group, from a table of how often each value occurs in it: rows (within, name)."""
    at = running(counts, within, [value], number, "_up_to", "_total")
    low, high = F.expr("(_total + 1) div 2"), F.expr("(_total + 2) div 2")
    holds = lambda place: (F.col("_up_to") - F.col(number) < place) & (place <= F.col("_up_to"))
    return at.where(holds(low) | holds(high)).groupBy(*within).agg(F.avg(value).alias(name))


def first_drawn(rows: DataFrame, strata: list[str], draw: Column, quota: DataFrame, wanted: str, digits: int = 4, ties: list[str] | None = None) -> DataFrame:
    """Of each stratum the rows of the smallest draws, as many as quota (strata, wanted) says.

    Draws are hex digests, so their first digits deal a stratum's rows evenly. Counts by these digits say below which all
    are taken; only where the last wanted row lies, one in 16 ** digits of a stratum, are rows ranked.
    """
    drawn = rows.withColumn("_draw", draw).withColumn("_bin", F.substring("_draw", 1, digits))
    bins = drawn.groupBy(*strata, "_bin").agg(F.count("*").alias("_n"))
    up_to = F.sum("_n").over(Window.partitionBy(*strata).orderBy("_bin"))  # over counts, not over rows
    names = [f"_stratum_{i}" for i in range(len(strata))]
    same = F.lit(True)
    for s, n in zip(strata, names):
        same = same & F.col(s).eqNullSafe(F.col(n))
    quota = quota.select(*[F.col(s).alias(n) for s, n in zip(strata, names)], F.col(wanted).alias("_wanted"))
    bins = bins.withColumn("_up_to", up_to).join(quota, same)
    last = bins.where((F.col("_up_to") >= F.col("_wanted")) & (F.col("_up_to") - F.col("_n") < F.col("_wanted")))
    last = last.select(*names, F.col("_bin").alias("_last"), (F.col("_wanted") - F.col("_up_to") + F.col("_n")).alias("_rest"))
    found = drawn.join(quota, same).drop(*names).where("_wanted > 0").join(last, same, "left").drop(*names)
    extra = ["_draw", "_bin", "_wanted", "_last", "_rest"]
    edge = found.where("_bin = _last").withColumn("_rank", F.row_number().over(Window.partitionBy(*strata).orderBy("_draw", *(ties or []))))
    return found.where("_last IS NULL OR _bin < _last").drop(*extra).unionByName(edge.where("_rank <= _rest").drop("_rank", *extra))

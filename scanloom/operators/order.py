"""Running aggregates and positions over a total order, without one task for everything.

Rows are dealt by ranges of the order and sorted inside each range. Every range aggregates its
own rows; what lies before a range is the aggregate of one value per earlier range, a table with
a row per range and group. So a group may hold any share of the rows: it spreads over as many
ranges as it needs, and no key is hot.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from scanloom.sources.shared import save

SEAT_BITS = 33  # Fixed value: monotonically_increasing_id counts rows in the lower 33 bits and partitions above


def seated(df: DataFrame, group: list[str], order: list, partitions: int | None = None) -> DataFrame:
    """``df`` in ranges of (group, order), each sorted, with ``_range`` and ``_seat``; written, so both stay as they are.

    Rows that tie in the whole order may come either way round; name enough columns.
    """
    n = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = [*group, *order]
    if not keys:
        raise ValueError("an order needs columns")
    dealt = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys).withColumn("_seat", F.monotonically_increasing_id())
    return save(dealt, "seated").withColumn("_range", F.shiftrightunsigned("_seat", SEAT_BITS))


def carried(ranges: DataFrame, group: list[str], how: Callable[[Column], Column], value: Column,
            join: Callable[[Column, Column], Column], name: str = "running") -> DataFrame:
    """Add to the rows of ``seated`` the aggregate of all rows of their group up to themselves.

    ``how`` is an aggregate function, ``join`` puts two of its results together. A null aggregate counts as none.
    """
    own = how(value).over(Window.partitionBy("_range", *group).orderBy("_seat").rowsBetween(Window.unboundedPreceding, 0))
    # Null groups are groups as well, so the join compares null-safely.
    ends = ranges.groupBy("_range", *group).agg(how(value).alias("_end"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    before = ends.select(F.col("_range").alias("_r"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
                         how(F.col("_end")).over(earlier).alias("_before"))
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    both = ranges.withColumn("_own", own).join(before, same)
    total = F.when(F.col("_before").isNull(), F.col("_own")).when(F.col("_own").isNull(), F.col("_before")).otherwise(
        join(F.col("_before"), F.col("_own")))
    return both.select(*[c for c in ranges.columns if c not in ("_seat", "_range")], total.alias(name))


def with_positions(df: DataFrame, order: list, group: list[str] | None = None, name: str = "position",
                   partitions: int | None = None) -> DataFrame:
    """Add the place, from 0, of every row within its group in the given order."""
    group = group or []
    ranges = seated(df, group, order, partitions)
    # A group's rows are neighbours in a range, so their seats count them: only a row per range and group is aggregated, and written
    # so that its size is known when it is joined.
    seat = F.col("_seat").bitwiseAND(F.lit((1 << SEAT_BITS) - 1))
    ends = ranges.groupBy("_range", *group).agg(F.count(F.lit(1)).alias("_rows"), F.min(seat).alias("_first"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = save(ends.select(F.col("_range").alias("_r"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)],
                              (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift")), "starts")
    same = F.col("_range") == F.col("_r")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    return ranges.join(starts, same).select(*[c for c in ranges.columns if c not in ("_seat", "_range")], (seat + F.col("_shift")).alias(name))

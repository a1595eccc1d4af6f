"""Running aggregates over ranges against window functions over everything."""

import pytest
from pyspark.sql import Window, functions as F

from scanloom.operators.order import carried, seated, with_positions


def rows(spark, n=3000):
    return spark.range(n).select(
        (F.col("id") * 7919 % n).alias("k"),
        F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 50 == 1, None).otherwise(F.concat(F.lit("u"), (F.col("id") % 40).cast("string"))).alias("unit"))


def test_positions_per_group(spark):
    df = rows(spark)
    plain = df.withColumn("position", (F.row_number().over(Window.partitionBy("unit").orderBy("k")) - 1).cast("long"))
    for partitions in (1, 7):
        found = with_positions(df, ["k"], ["unit"], partitions=partitions)
        assert found.columns == ["k", "unit", "position"]
        assert found.exceptAll(plain).count() == 0 and found.count() == plain.count()


def test_positions_of_all(spark):
    found = with_positions(rows(spark).select("k"), [F.desc("k")], name="place", partitions=5)
    assert found.filter("place <> 2999 - k").count() == 0 and found.count() == 3000
    assert with_positions(rows(spark, 0), ["k"]).count() == 0


def test_running_maximum(spark):
    df = rows(spark).withColumn("v", F.when(F.col("k") % 5 == 0, F.col("k") * 31 % 1009))
    found = carried(seated(df, ["unit"], ["k"], 6), ["unit"], F.max, F.col("v"), F.greatest, "most")
    plain = df.withColumn("most", F.max("v").over(Window.partitionBy("unit").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)))
    assert found.exceptAll(plain).count() == 0 and found.count() == plain.count()


def test_an_order_needs_columns(spark):
    with pytest.raises(ValueError):
        seated(rows(spark), [], [])


def test_a_hot_group_is_spread(spark):
    """Half of the rows in one group: no range holds much more than its share."""
    df = rows(spark, 20_000).withColumn("unit", F.when(F.col("k") % 2 == 0, "hot").otherwise(F.col("unit")))
    sizes = [r["count"] for r in seated(df, ["unit"], ["k"], 8).groupBy("_range").count().collect()]
    assert len(sizes) >= 7 and max(sizes) < 2 * 20_000 / 8

import random

from pyspark.sql import functions as F

from bindery.functions.text import fixed_point


def test_fixed_point_prints_the_binary_value(spark):
    rng = random.Random(3)
    values = [83.65, 83.35, 0.25, 0.35, 2.5, -0.04, -83.65, 0.0, 99.95, 12.25, 1e15, 14.349999999999998, 0.8365 * 100]
    values += [rng.randrange(10 ** 6) / 1000 * 5 for _ in range(300)] + [(1 - rng.randrange(1, 2000) / 2000) * 100 for _ in range(300)]
    rows = spark.createDataFrame([(v,) for v in values], "v double")
    for digits in (1, 2):
        got = rows.select("v", fixed_point(F.col("v"), digits).alias("s")).collect()
        assert [r.s for r in got] == [f"{r.v:.{digits}f}" for r in got]

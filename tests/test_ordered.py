"""The plain-window way and the range-partitioned way must give the same rows."""

import random

from pyspark.sql import functions as F

from threadloom.operators import ordered


def rows(spark, n=400):
    rnd = random.Random(5)
    # one key holds most rows, so it spans several stretches
    data = [(("hot" if rnd.random() < 0.7 else f"k{rnd.randrange(6)}"), i, rnd.choice([None, i])) for i in range(n)]
    return spark.createDataFrame(data, "k string, t long, v long").repartition(5)


def same(a, b):
    assert sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.select(a.columns).collect()), key=str)


def spread(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")


def test_number_rows(spark):
    df = rows(spark)
    spread(spark)
    same(ordered.number_rows(df, ["k"], ["t"]), ordered.number_rows(df, ["k"], ["t"], limit=0))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_running_sum(spark):
    df = rows(spark)
    spread(spark)
    value = F.col("t") % 7
    same(ordered.running_sum(df, ["k"], ["t"], value, "s"), ordered.running_sum(df, ["k"], ["t"], value, "s", limit=0))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_last_before(spark):
    spread(spark)
    for seed_rows in (rows(spark), rows(spark, 30)):
        sparse = F.when(F.col("t") % 41 == 0, F.col("v"))
        for value in (F.col("v"), sparse):
            a = ordered.last_before(seed_rows, ["k"], ["t"], value, "p")
            same(a, ordered.last_before(seed_rows, ["k"], ["t"], value, "p", limit=0))
    laid = ordered.lay_out(rows(spark), ["k"], ["t"])
    assert laid.where("k = 'hot'").select("_seg").distinct().count() > 1
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_quantiles_agree_with_the_engine(spark):
    from pyspark.sql import functions as F

    from threadloom.operators.ordered import quantiles

    df = spark.range(200).selectExpr("id % 3 k", "if(id % 7 = 0, null, (id * 37) % 50) x", "id / 3.0 y")
    for limit in (None, 0):
        got = quantiles(df, ["k"], {"a": (F.col("x"), 0.5), "b": (F.col("x"), 0.9), "c": (F.col("y"), 0.25)}, limit)
        want = df.groupBy("k").agg(F.percentile("x", F.lit(0.5)).alias("a"), F.percentile("x", F.lit(0.9)).alias("b"), F.percentile("y", F.lit(0.25)).alias("c"))
        close = lambda rows: sorted((r.k, round(r.a, 9), round(r.b, 9), round(r.c, 9)) for r in rows.collect())
        assert close(got) == close(want)

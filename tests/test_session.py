import os

from pyspark.sql import functions as F

from fondaco.session import cut, forget, is_small, maybe_broadcast, spread


def test_cut_and_forget(spark):
    df = cut(spark.range(10).withColumn("x", F.col("id") * 2))
    assert "Project" not in df._jdf.queryExecution().optimizedPlan().toString() and df.agg(F.sum("x")).first()[0] == 90
    path = df._fondaco_path.replace("file:", "")
    assert os.path.isdir(path)
    forget(df, spark.range(1))
    assert not os.path.exists(path)
    empty = cut(spark.range(0))
    assert empty.count() == 0 and empty.columns == ["id"]


def test_sizes(spark):
    assert is_small(spark.range(5), 5) and not is_small(spark.range(6), 5)
    assert "broadcast" in maybe_broadcast(spark.range(5), 5)._jdf.queryExecution().logical().toString().lower()
    assert spread(spark.range(100), "id").rdd.getNumPartitions() > int(spark.conf.get("spark.sql.shuffle.partitions"))

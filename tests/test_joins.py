from collections import Counter

import pytest
from pyspark.sql import functions as F
from textloom import storage
from textloom.operators import joins


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
@pytest.mark.parametrize("sent", [10**6, 0])
def test_hot_keys_meet_the_same_rows(spark, monkeypatch, how, sent):
    monkeypatch.setattr(joins, "SENT", sent)
    hot = F.when(F.col("id") % 3 == 0, F.lit(7)).when(F.col("id") % 10 == 1, F.lit(None)).otherwise(F.col("id") % 50)
    big = spark.range(3000).select(F.col("id"), hot.cast("long").alias("k"), F.lit("x").alias("_salt"))
    small = spark.range(40).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"), F.lit("y").alias("_parts"))
    want = Counter(map(tuple, big.join(small, ["k"], how).collect()))
    salted = joins.salted_join(big, small, ["k"], how, least=10)
    assert Counter(map(tuple, salted.collect())) == want
    assert Counter(map(tuple, joins.keyed_join(big, small, ["k"], how).collect())) == want


def test_a_hot_key_is_spread(spark):
    big = spark.range(4000).select((F.col("id") % 2 * 0).alias("k"), "id")
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    was = {k: spark.conf.get(k) for k in off}
    for k, v in off.items():
        spark.conf.set(k, v)
    out = joins.salted_join(big, spark.createDataFrame([(0, "v")], "k long, v string"), ["k"], least=10).withColumn("t", F.spark_partition_id())
    assert out.groupBy("t").count().agg(F.max("count")).first()[0] < 3000 and out.count() == 4000
    for k, v in was.items():
        spark.conf.set(k, v)


def test_temporaries_go_and_what_outlives_them_stays(spark):
    with storage.temporaries(spark) as outlives:
        gone = storage.written(spark.range(5), "gone")
        kept = outlives(gone.selectExpr("id + 1 AS id"), "kept")
    assert kept.count() == 5
    with pytest.raises(Exception, match="PATH_NOT_FOUND|does not exist|FILE_NOT_EXIST"):
        spark.read.parquet(gone.inputFiles()[0])


def test_a_cluster_has_to_name_its_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda *_: None)

        class sparkContext:
            master = "spark://host:7077"

    with pytest.raises(RuntimeError, match=r"spark\.checkpoint\.dir"):
        storage.shared_dir(Session)

import pytest
from pyspark.sql import functions as F

from churnlab.operators import joins


def test_with_stats_attaches_one_row_and_rejects_more(spark):
    df = spark.range(5)
    st = df.agg(F.avg("id").alias("mu"), F.max("id").alias("mx"))
    got = joins.with_stats(df, st).collect()
    assert len(got) == 5 and all(r["mu"] == 2.0 and r["mx"] == 4 for r in got)
    with pytest.raises(Exception):
        joins.with_stats(df, spark.range(2).withColumnRenamed("id", "k")).collect()


def test_salted_join_equals_plain_with_hot_key(spark):
    ents = spark.createDataFrame([(k, f"e{k}") for k in range(5)], "id long, e string")
    hist = spark.createDataFrame([(0 if i % 3 else i % 5, i) for i in range(600)], "id long, v long")  # key 0 is hot
    plain = sorted(tuple(r) for r in joins.join_history(ents, hist).collect())
    salted = sorted(tuple(r) for r in joins.join_history(ents, hist, salt_buckets=7).collect())
    assert plain == salted and len(plain) == 600


def test_bucketed_join_has_no_exchange_and_the_same_rows(spark):
    from churnlab.sources import bucketed
    old = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        e = spark.range(200).select("id", (F.col("id") % 2).alias("churn"))
        h = spark.range(3000).select((F.col("id") * 7 % 260).alias("id"), F.col("id").alias("price"))
        left, right = bucketed.store(e, "t_entities", "id", 8), bucketed.store(h, "t_history", "id", 8)
        joined = joins.join_history(left, right)
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in plan and "SortMergeJoin" in plan
        assert sorted(map(tuple, joined.collect())) == sorted(map(tuple, joins.join_history(e, h).collect()))
        again = bucketed.store(e.where("id < 5"), "t_entities", "id", 8)
        assert again.count() == 5
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", old)
        spark.sql("DROP TABLE IF EXISTS t_entities")
        spark.sql("DROP TABLE IF EXISTS t_history")
    assert bucketed.bucket_count(1) == 8 and bucketed.bucket_count(100 << 30) == 512

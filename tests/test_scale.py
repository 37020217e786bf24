"""The skew helpers with their hot paths forced on: results must equal the plain formulation."""

import random

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from kalendarium import scale
from kalendarium.operators import merge
from tests.helpers import at, rows


@pytest.fixture
def skewed(spark):
    rng = random.Random(3)
    data = [(i, "hot" if rng.random() < 0.6 else f"k{rng.randrange(5)}", at(f"2026-01-0{rng.randrange(1, 4)} 1{rng.randrange(2)}:00"), rng.randrange(100)) for i in range(300)]
    return spark.createDataFrame(data, "id long, key string, ts timestamp_ntz, v int").repartition(5)


def test_number_rows(skewed, monkeypatch):
    monkeypatch.setattr(scale, "ID_BLOCK", 7)
    plain = skewed.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy("ts", "id")))
    assert rows(scale.number_rows(skewed, ["key"], "ts", "id"), "id", "rank") == rows(plain, "id", "rank")


def test_previous_value(skewed, monkeypatch):
    monkeypatch.setattr(scale, "ID_BLOCK", 7)
    plain = skewed.withColumn("p", F.lag("v").over(W.partitionBy("key").orderBy("id")))
    assert rows(scale.previous_value(skewed, ["key"], "id", F.col("v"), "p"), "id", "p") == rows(plain, "id", "p")


def test_previous_value_moves_rows_once_and_block_heads_again(skewed):
    skewed.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = scale.previous_value(skewed, ["key"], "id", F.col("v"), "p")._jdf.queryExecution()
        assert "Join" not in plan.optimizedPlan().toString()
        moves = plan.executedPlan().toString()
        # the block shuffle stands in both branches with the same columns, so one of them is reused
        dealt = [line.split("Exchange ")[1] for line in moves.splitlines() if "Exchange hashpartitioning" in line and "_block" in line]
        assert len(dealt) == 2 and moves.count("Exchange hashpartitioning") == 3
    finally:
        skewed.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_previous_value_of_null_values(spark):
    data = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 3, 7), ("b", 1, None)], "key string, id long, v int")
    assert rows(scale.previous_value(data, ["key"], "id", F.col("v"), "p"), "key", "id", "p") == [("a", 1, None), ("a", 2, 5), ("a", 3, None), ("b", 1, None)]


def test_top_per_group(skewed):
    plain = skewed.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy(F.desc("v"), "id"))).filter("rank <= 9")
    assert rows(scale.top_per_group(skewed, ["key"], [F.desc("v"), F.col("id")], 9, "id"), "id", "rank") == rows(plain, "id", "rank")


@pytest.mark.parametrize("k", [1, 40, 120, 1000])
def test_top_per_group_by_buckets(skewed, k):
    plain = skewed.withColumn("rank", F.row_number().over(W.partitionBy("key").orderBy("ts", "id"))).filter(F.col("rank") <= k)
    got = scale.top_per_group(skewed, ["key"], [F.col("ts"), F.col("id")], k, "id", bucket=F.to_date("ts"))
    assert rows(got, "id", "rank") == rows(plain, "id", "rank")


def test_skewed_join_back_is_split(spark):
    """A group with most of the rows is dealt to several tasks by adaptive execution."""
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5"}
    for key, v in small.items():
        spark.conf.set(key, v)
    try:
        df = spark.range(0, 200_000, 1, 8).select("id", F.when(F.col("id") % 5 > 0, "hot").otherwise((F.col("id") % 97).cast("string")).alias("key"), F.sha2(F.col("id").cast("string"), 256).alias("pad"))
        groups = df.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
        joined = scale.join_back(df, groups, ["key"], "id")
        assert joined.filter("n is null").isEmpty()
        counted = joined.groupBy("pad").agg(F.max("n"))
        counted.count()
        rdd = joined._jdf.queryExecution().executedPlan()
        joined.collect()
        assert "skewed" in rdd.toString()
    finally:
        for key in small:
            spark.conf.unset(key)


def test_pick_one(skewed):
    plain = skewed.withColumn("n", F.row_number().over(W.partitionBy("key").orderBy("v", "id"))).filter("n = 1")
    assert rows(scale.pick_one(skewed, ["key"], [F.col("v"), F.col("id")]), "id", "v") == rows(plain, "id", "v")


def test_join_back(skewed):
    df = skewed.withColumn("key", F.when(F.col("id") % 10 != 0, F.col("key")))
    groups = df.filter("key is not null").groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total")).filter("key <> 'k1'")
    plain = df.join(groups, "key", "left")
    assert rows(scale.join_back(df, groups, ["key"], "id"), "id", "n", "total") == rows(plain, "id", "n", "total")


def test_join_back_shuffles_on_the_salt(skewed, capsys):
    groups = skewed.groupBy("key").agg(F.count(F.lit(1)).alias("n"))
    skewed.sparkSession.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        scale.join_back(skewed, groups, ["key"], "id").explain()
    finally:
        skewed.sparkSession.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert any("SortMergeJoin" in line and "_salt" in line.split("LeftOuter")[0] for line in capsys.readouterr().out.splitlines())


def test_number_keys(skewed):
    numbered = scale.number_keys(skewed.select("id"), F.col("id").cast("string"), "nr", buckets=16)
    assert sorted(r["nr"] for r in numbered.collect()) == list(range(1, 301))


def test_skewed_plans_have_no_global_sort_of_a_group(skewed, capsys):
    scale.number_rows(skewed, ["key"], "ts", "id").explain()
    plan = capsys.readouterr().out
    assert "_block" in plan.split("Window")[1]


def test_costly_parses_are_compiled(spark):
    """Below the generator, not in it: a generator's expressions are interpreted, and once more for each mention."""
    df = scale.computed_once(spark.range(3), doubled=F.get(F.transform(F.array("id"), lambda x: x * 2), F.lit(0))).filter("doubled > 0")
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    generators = [line for line in plan.splitlines() if "Generate explode" in line]
    assert len(generators) == 1 and "transform" not in generators[0] and plan.count("lambdafunction") == 1
    assert sorted(r["doubled"] for r in df.collect()) == [2, 4]


def test_run_keys_take_one_pass(spark):
    """Both keys of an event come from one read of it, one digest; an event without cross-source key keeps its row."""
    data = [(1, 1, "a", "k1", 5, "h", "t"), (1, 1, "", "k2", 6, "h", None), (1, 2, None, None, 7, "h", "t")]
    events = spark.createDataFrame(data, "region_id long, source_id long, external_id string, dedup_key string, id long, content_hash string, description string")
    found = merge.key_rows(events.withColumn("id", F.col("id") + F.lit(0)))
    assert sorted((r["id"], r["run_key"] or "", r["text"] is None) for r in found.collect()) == [(5, "id:a", False), (5, "key:k1", False), (6, "key:k2", True), (7, "", False)]
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" not in plan and plan.count("sha2(") == 1

"""Ordered building blocks against brute force, with one key holding well over a third of the rows."""

import random

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stallwatch.operators.joins import asof_join
from stallwatch.plans.ordered import SLICE, exact_quantiles, numbered, running_totals, with_slice
from stallwatch.plans.skew import first_n_per_key, lookup


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(7)
    rows = [(i, "hot" if rng.random() < 0.5 else f"k{rng.randrange(20)}", rng.randrange(400), rng.randrange(5)) for i in range(3000)]
    return spark.createDataFrame(rows, "id long, k string, t long, v long").cache(), pd.DataFrame(rows, columns=["id", "k", "t", "v"])


def test_a_hot_key_is_cut_into_bounded_groups(skewed):
    df, _ = skewed
    sizes = with_slice(df, F.col("t"), 8).groupBy("k", SLICE).count()
    assert sizes.agg(F.max("count")).first()[0] < df.count() / 8 * 1.5
    assert sizes.filter("k = 'hot'").count() >= 7


@pytest.mark.parametrize("before", [True, False])
def test_running_totals_match_brute_force(skewed, before):
    df, pdf = skewed
    got = {r["id"]: r["total"] for r in running_totals(df, ["k"], F.col("t"), {"total": F.col("v")}, before=before, slices=6).collect()}
    for _, part in pdf.groupby("k"):
        for row in part.itertuples():
            seen = part[part.t < row.t] if before else part[part.t <= row.t]
            assert got[row.id] == seen.v.sum()


def test_numbering_matches_sorting(skewed):
    df, pdf = skewed
    got = {r["id"]: r["rn"] for r in numbered(df, ["k"], F.col("t"), ["id"], "rn", slices=5).collect()}
    for _, part in pdf.sort_values(["t", "id"]).groupby("k"):
        assert [got[i] for i in part.id] == list(range(1, len(part) + 1))
    whole = numbered(df, [], F.col("t"), ["id"], "rn", slices=5).orderBy("rn").select("id").collect()
    assert [r[0] for r in whole] == list(pdf.sort_values(["t", "id"]).id)


def test_exact_quantiles_match_pandas(skewed):
    df, pdf = skewed
    got = {r["k"]: (r["a"], r["b"]) for r in exact_quantiles(df, ["k"], "t", {"a": 0.5, "b": 0.9}).collect()}
    for k, part in pdf.groupby("k"):
        assert got[k] == pytest.approx((part.t.quantile(0.5), part.t.quantile(0.9)))


def test_lookup_keeps_every_row_and_spreads_a_hot_key(spark, skewed):
    df, _ = skewed
    right = df.filter("k <> 'k3'").groupBy("k").agg(F.count("*").alias("n"))
    plain = df.join(right, "k", "left").orderBy("id").collect()
    assert plain == lookup(df, right, ["k"], "left").select("k", "id", "t", "v", "n").orderBy("id").collect()
    with_nulls = df.withColumn("k", F.when(F.col("v") > 0, F.col("k")))
    assert lookup(with_nulls, right, ["k"], "left").count() == df.count()
    assert lookup(with_nulls, right, ["k"], "inner").count() == with_nulls.join(right, "k").count()


@pytest.mark.parametrize("share, split", [(0.3, True), (0.0, False)])
def test_only_a_hot_partition_is_split(spark, share, split):
    small = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k"}
    small |= {"spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64k", "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        hot = F.pmod(F.xxhash64("id"), F.lit(10)) < int(share * 10)
        rows = spark.range(120_000).withColumn("k", F.when(hot, -1).otherwise(F.col("id") % 4000)).withColumn("p", F.sha2(F.col("id").cast("string"), 256))
        joined = lookup(rows, rows.groupBy("k").agg(F.count("*").alias("n")), ["k"], "left")
        assert len(joined.collect()) == 120_000
        assert ("skewed" in joined._jdf.queryExecution().executedPlan().toString()) == split
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_top_n_is_limited_before_the_exchange(skewed):
    df, pdf = skewed
    top = first_n_per_key(df, ["k"], [F.desc("t"), F.col("id")], 3)
    plan = top._jdf.queryExecution().executedPlan().toString()
    assert plan.index("WindowGroupLimit") > 0 and "Partial" in plan
    want = pdf.sort_values(["t", "id"], ascending=[False, True]).groupby("k").head(3)
    assert {r["id"] for r in top.collect()} == set(want.id)


def _brute_asof(left, right, strategy, tolerance):
    out = {}
    for lid, k, t in left:
        after = min(((rt, rid) for rid, rk, rt in right if rk == k and rt >= t), default=None)
        before = max(((rt, rid) for rid, rk, rt in right if rk == k and rt <= t), default=None)
        if tolerance is not None:
            after = after if after and after[0] - t <= tolerance else None
            before = before if before and t - before[0] <= tolerance else None
        if strategy == "forward":
            hit = after
        elif strategy == "backward":
            hit = before
        elif strategy == "forward_else_backward":
            hit = after or before
        else:
            hit = after if after and (not before or after[0] - t <= t - before[0]) else before
        out[lid] = hit[1] if hit else None
    return out


@pytest.mark.parametrize("strategy", ["forward", "backward", "nearest", "forward_else_backward"])
@pytest.mark.parametrize("tolerance", [None, 5])
def test_asof_matches_brute_force_with_ties_and_hot_key(spark, strategy, tolerance):
    rng = random.Random(11)
    key = lambda: "hot" if rng.random() < 0.5 else rng.choice(["a", "b", "c", None])
    left = [(i, key(), rng.randrange(200)) for i in range(400)]
    right = [(i, rng.choice(["hot", "hot", "a", "b", None]), rng.randrange(200)) for i in range(120)]
    at = F.timestamp_seconds
    ldf = spark.createDataFrame(left, "lid long, k string, s long").withColumn("lt", at("s"))
    rdf = spark.createDataFrame(right, "rid long, k string, s long").select("rid", "k", at("s").alias("rt"))
    out = asof_join(ldf, rdf, key="k", left_time="lt", right_time="rt", right_id="rid", strategy=strategy, tolerance_seconds=tolerance, slices=6)
    want = _brute_asof(left, [r for r in right if r[1] is not None], strategy, tolerance)
    assert {r["lid"]: r["rid"] for r in out.collect()} == want


@pytest.mark.parametrize("slices", [1, 2, 8])
def test_asof_leaves_null_times_and_keys_unmatched(spark, slices):
    left = spark.createDataFrame([(1, "a", None), (2, None, 5), (3, "a", 5), (4, None, None)], "lid long, k string, s long").withColumn("lt", F.timestamp_seconds("s"))
    right = spark.createDataFrame([(10, "a", 7), (11, None, 6), (12, "a", None)], "rid long, k string, s long").select("rid", "k", F.timestamp_seconds("s").alias("rt"))
    for strategy in ("forward", "forward_else_backward", "nearest"):
        out = asof_join(left, right, key="k", left_time="lt", right_time="rt", right_id="rid", strategy=strategy, slices=slices)
        assert {r["lid"]: r["rid"] for r in out.collect()} == {1: None, 2: None, 3: 10, 4: None}


def test_numbering_spreads_common_prefixes_and_ties(spark):
    df = spark.range(3000).select(F.lit("f").alias("k"), F.concat(F.lit("https://same.example/path/"), F.lpad("id", 6, "0")).alias("c"))
    assert all(int(r["c"][-6:]) + 1 == r["n"] for r in numbered(df, ["k"], F.col("c"), [], "n", slices=8).collect())
    busy = spark.range(4000).select("id", F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("day"))
    ranged = busy.repartitionByRange(8, "day", "id").groupBy(F.spark_partition_id()).count()
    assert ranged.agg(F.max("count")).first()[0] < 2 * 4000 / 8
    got = {r["id"]: r["n"] for r in numbered(busy, [], F.col("day"), ["id"], "n", slices=8).collect()}
    assert [i for i, _ in sorted(got.items(), key=lambda kv: kv[1])] == [r["id"] for r in busy.orderBy("day", "id").collect()]


def test_asof_rejects_unknown_strategy(spark):
    df = spark.range(1)
    with pytest.raises(ValueError):
        asof_join(df, df, key="id", left_time="id", right_time="id", right_id="id", strategy="sideways")

"""Nulls in order, key and score columns, reports over nothing, and tail probabilities."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from stallwatch.functions.tails import beta_share, log_gamma, normal_two_sided, student_two_sided
from stallwatch.operators import aggregates as A
from stallwatch.operators import drift as D
from stallwatch.operators import metrics as M
from stallwatch.operators import ranking as K
from stallwatch.operators import windows as W
from stallwatch.plans.ordered import exact_quantiles, numbered, running_totals


def test_tails_against_known_values(spark):
    rows = [(z / 7,) for z in range(0, 200, 3)] + [(None,)]
    for r in spark.createDataFrame(rows, "z double").withColumn("p", normal_two_sided(F.col("z"))).collect():
        assert r.p is None if r.z is None else r.p == pytest.approx(math.erfc(r.z / math.sqrt(2)), rel=1e-9, abs=1e-300)
    for r in spark.createDataFrame([(x / 3,) for x in range(1, 400, 7)], "x double").withColumn("g", log_gamma(F.col("x"))).collect():
        assert r.g == pytest.approx(math.lgamma(r.x), rel=1e-9, abs=1e-9)
    # quantiles of Student's distribution for two-sided p of 0.05 and 0.001
    known = [(12.706205, 1, 0.05), (2.776445, 4, 0.05), (2.228139, 10, 0.05), (1.983972, 100, 0.05), (636.619249, 1, 0.001), (3.390491, 100, 0.001), (1.9599664, 1_000_000, 0.05), (0.0, 7, 1.0), (None, 3, None), (1.0, 0, None)]
    for r in spark.createDataFrame(known, "t double, dof long, want double").withColumn("p", student_two_sided(F.col("t"), F.col("dof"))).collect():
        assert r.p is None if r.want is None else r.p == pytest.approx(r.want, rel=2e-5)
    # I_x(a, 1) = x^a and I_x(1, b) = 1 - (1 - x)^b
    for r in spark.createDataFrame([(a / 2, x / 10) for a in range(1, 20) for x in range(1, 10)], "a double, x double").select("a", "x", beta_share(F.col("a"), F.lit(1.0), F.col("x")).alias("p"), beta_share(F.lit(1.0), F.col("a"), F.col("x")).alias("q")).collect():
        assert r.p == pytest.approx(r.x**r.a, rel=1e-8) and r.q == pytest.approx(1 - (1 - r.x) ** r.a, rel=1e-8)


ROWS = [(k, o, v) for k in ("a", "b", None) for o, v in ((1, 1), (2, 5), (2, 2), (3, None), (None, 9), (None, 9))]


def test_rows_without_order_or_key_stay(spark):
    df = spark.createDataFrame(ROWS * 3, "k string, o long, v long").repartition(3)
    totals = running_totals(df, ["k"], F.col("o"), {"s": F.coalesce("v", F.lit(0))}, before=True, slices=4).collect()
    assert len(totals) == len(ROWS) * 3 and Counter((r.k, r.o, r.s) for r in totals)[(None, 3, 24)] == 3
    assert all((r.s is None) == (r.o is None) for r in totals)
    best = W.running_best(df, "o", "v", ["k"]).collect()
    assert Counter((r.o, r.best_so_far) for r in best) == Counter({(1, 1): 9, (2, 5): 18, (3, 5): 9, (None, None): 18})
    ranks = numbered(df, ["k"], F.col("o"), ["v"], "n", slices=4).collect()
    assert sorted((str(r.k), r.n) for r in ranks) == sorted((k, i) for k in ("a", "b", "None") for i in range(1, 19))
    found = {r.k: r.m for r in exact_quantiles(df, ["k"], "v", {"m": 0.5}).collect()}
    assert found == {k: 5.0 for k in ("a", "b", None)}


def test_identity_history_keeps_events_without_time(spark):
    events = [(1, "x", "i", 10, None), (2, "y", "i", 20, 25), (3, "z", "i", None, 5), (4, "z", "i", 30, None), (5, "w", None, None, None)]
    df = spark.createDataFrame(events, "e long, id string, k string, s long, f long").select("e", "id", "k", F.timestamp_seconds("s").alias("t"), F.timestamp_seconds("f").alias("f"))
    got = {r.e: (r.prior_entities, r.prior_flagged, r.days_since_first_seen is None) for r in W.identity_history(df, identity="k", entity="id", time="t", flag="f").collect()}
    assert got == {1: (0, 0, False), 2: (1, 0, False), 3: (0, 0, True), 4: (2, 1, False), 5: (0, 0, True)}


def test_groups_without_a_name_are_groups(spark):
    df = spark.createDataFrame([(g, y, s) for g in ("a", None) for y, s in ((1, 0.9), (0, 0.2), (1, 0.6), (0, 0.7))] + [("blank", 1, None)], "g string, y int, s double")
    assert {r.g: round(r.roc_auc, 6) for r in M.ranking_metrics(df, "y", "s", ["g"]).collect()} == {"a": 0.75, None: 0.75}
    assert {r.g: (r.n, r.roc_auc) for r in M.fold_metrics(df, "y", "s", "g").collect()} == {"a": (4, 0.75), None: (4, 0.75), "blank": (1, 0.0)}
    ids = spark.createDataFrame([(1, 0), (1, 0), (2, None), (3, None), (3, None), (3, None)], "id long, y int")
    assert {r.y: (r.ids, r.median_events) for r in A.lifecycle_length(ids, "id", "y").collect()} == {0: (1, 2.0), None: (2, 2.0)}


def test_auc_difference_is_over_rows_both_scored(spark):
    rows = [(1, 1, 0.9, 0.8), (2, 0, 0.1, 0.2), (3, 1, 0.8, 0.9), (4, 0, 0.3, 0.1), (5, 1, None, 0.0), (6, 0, 1.0, None)]
    got = M.auc_difference_test(spark.createDataFrame(rows, "i long, y int, a double, b double"), "y", "a", "b", "i").first()
    assert (got.auc_a, got.auc_b, got.z) == (1.0, 1.0, None)


@pytest.mark.parametrize("rows", [[], [(1, 0, 0.5, 0.4, 1)] * 5, [(i, None, None, None, None) for i in range(3)]])
def test_reports_on_empty_one_class_and_null_input(spark, rows):
    df = spark.createDataFrame(rows, "i long, y int, s double, s2 double, f int")
    M.threshold_table(df, "y", "s").collect()
    assert M.confusion(df, "y", "s").first().catch_rate == 0.0
    assert M.ranking_metrics(df, "y", "s").first().roc_auc == 0.0
    assert M.precision_at_recall(df, "y", "s", 0.5).first().precision is None
    assert M.auc_difference_test(df, "y", "s", "s2", "i").first().p_value is None
    assert len(K.precision_at_k(df, "y", "s", "i").collect()) == 3
    assert A.signal_report(df, ["f"], "y").first().lift is None
    A.coverage(df).collect()
    A.positive_rate(df, ["f"], "y").collect()
    M.vendor_baseline(df.withColumn("state", F.lit("APPROVE")), "y", "state", "s").collect()
    M.probability_losses(df, "y", "s").collect()
    M.best_threshold(df, "y", "s").collect()
    M.paired_t_test(df, "s", "s2").collect()
    A.histogram(df, "s").collect()
    A.impute_median(df, ["s", "f"]).collect()
    D.drift_report(df, df, "s", ["s2"]).collect()
    groups = spark.createDataFrame([("x", "g"), ("z", "g")], "feature string, feature_group string")
    zero = spark.createDataFrame([("x", 0.0), ("z", 0.0)], "feature string, importance double")
    assert A.importance_by_group(zero, groups).first().percent is None


def test_rolling_drift_counts_scored_rows_only_and_spreads_a_hot_series(spark):
    n = 400
    plain = [("hot", i, float((i * 37) % 101)) for i in range(n)] + [("b", i, float(i % 7)) for i in range(120)] + [(None, i, float(i % 11)) for i in range(130)]
    gaps = plain + [("hot", i, None) for i in range(0, n, 2)] + [("b", 3, float("nan"))]
    run = lambda rows: sorted(map(str, D.rolling_drift(spark.createDataFrame(rows, "s string, o long, v double"), series="s", order=F.col("o"), tie="v", score="v").collect()))
    assert run(plain) == run(gaps) and len(run(plain)) == 31 + 3 + 4


def test_probability_losses_leave_rows_without_score_out(spark):
    rows = [("a", 1, 0.8), ("a", 0, 0.3), ("a", 0, None), ("a", 1, None), ("b", 1, None), ("c", 0, float("nan")), ("c", 1, 0.5)]
    df = spark.createDataFrame(rows, "g string, y int, s double")
    got = {r.g: r for r in M.probability_losses(df, "y", "s", ["g"]).collect()}
    assert got["a"].log_loss == pytest.approx(-(math.log(0.8) + math.log(0.7)) / 2)
    assert got["a"].brier == pytest.approx((0.04 + 0.09) / 2)
    assert got["b"].log_loss is None and got["b"].brier is None
    assert math.isnan(got["c"].log_loss) and math.isnan(got["c"].brier)

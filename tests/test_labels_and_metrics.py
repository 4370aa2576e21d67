"""Golden tables for labels, splits, metrics, drift."""

import math
import random
from datetime import datetime, timedelta

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallwatch.operators import detectors as C
from stallwatch.operators import drift as D
from stallwatch.operators import labels as L
from stallwatch.operators import metrics as M
from stallwatch.operators.ranking import precision_at_k

T0 = datetime(2024, 1, 1)
COLS = L.SplitColumns(key="id", time="ts", flag="flag", tie="row")


def rows(spark, data):
    return spark.createDataFrame([(i, k, T0 + timedelta(days=t), None if f is None else T0 + timedelta(days=f)) for i, (k, t, f) in enumerate(data)], "row int, id string, ts timestamp, flag timestamp")


def test_flags_count_only_once_raised(spark):
    df = rows(spark, [("before", 1, 4), ("at", 1, 5), ("after", 1, 6), ("never", 1, None), ("mixed", 1, None), ("mixed", 2, 3)])
    got = {(r["id"], r["row"]): r["is_fraud"] for r in L.label_rows(df, COLS, T0 + timedelta(days=5)).collect()}
    assert got == {("before", 0): 1, ("at", 1): 1, ("after", 2): 0, ("never", 3): 0, ("mixed", 4): 1, ("mixed", 5): 1}


def test_labels_grow_with_the_cutoff(spark):
    rng = random.Random(3)
    df = rows(spark, [(f"i{rng.randrange(12)}", rng.randrange(20), rng.choice([None, rng.randrange(30)])) for _ in range(80)])
    totals = [L.label_rows(df, COLS, T0 + timedelta(days=d)).agg(F.sum("is_fraud")).first()[0] for d in (5, 10, 20, 31)]
    assert totals == sorted(totals)


def test_split_edges_gap_and_overlap(spark):
    end, test_end = T0 + timedelta(days=10), T0 + timedelta(days=30)
    df = spark.createDataFrame(
        [(0, "a", end, None), (1, "b", end + timedelta(days=7), None), (2, "c", end + timedelta(days=7, microseconds=1), None), (3, "d", test_end, None),
         (4, "e", test_end + timedelta(microseconds=1), None), (5, "a", test_end, None)],
        "row int, id string, ts timestamp, flag timestamp",
    )
    split = L.Split(end, test_end)
    ids = lambda pair: tuple(sorted(r["row"] for r in p.collect()) for p in pair)
    assert ids(L.temporal_split(df, COLS, split)) == ([0], [2, 3, 5])
    assert ids(L.temporal_split(df, COLS, split, overlap="train_priority")) == ([0], [2, 3])
    assert ids(L.temporal_split(df, COLS, split, overlap="test_priority")) == ([], [2, 3, 5])
    assert ids(L.temporal_split(df, COLS, split, overlap="remove_both")) == ([], [2, 3])
    train, test = L.temporal_split(df, COLS, split)
    L.check_integrity(train, test, "ts")
    with pytest.raises(ValueError):
        L.check_integrity(test, train, "ts")
    L.check_integrity(train, test.limit(0), "ts")


def test_fold_bounds_may_pass_the_end_by_the_gap():
    folds = L.expanding_folds(T0, T0 + timedelta(days=120), window_days=30, gap_days=7)
    assert [f.train_end for f in folds] == [T0 + timedelta(days=60), T0 + timedelta(days=90)]
    assert folds[-1].test_end == T0 + timedelta(days=127)
    assert [f.train_start for f in L.sliding_folds(T0, T0 + timedelta(days=180))] == [T0 + timedelta(days=d) for d in (0, 30, 60)]


def test_folds_without_a_side_are_dropped(spark):
    df = rows(spark, [("a", 1, None), ("b", 20, None)])
    folds = [L.Fold(1, None, T0 + timedelta(days=5), T0 + timedelta(days=6), T0 + timedelta(days=10)), L.Fold(2, None, T0 + timedelta(days=15), T0 + timedelta(days=16), T0 + timedelta(days=25))]
    got = {(r["fold"], r["role"], r["id"]) for r in L.assign_folds(df, COLS, folds).collect()}
    assert got == {(2, "train", "a"), (2, "test", "b")}


def scored(spark, pairs):
    return spark.createDataFrame([(i, y, float(s)) for i, (y, s) in enumerate(pairs)], "row_id long, label int, score double")


def brute_ap_auc(pairs):
    ap = tp = fp = 0
    positives = sum(y for y, _ in pairs)
    for s in sorted({s for _, s in pairs}, reverse=True):
        p, q = sum(y for y, x in pairs if x == s), sum(1 - y for y, x in pairs if x == s)
        tp, fp = tp + p, fp + q
        ap += p * tp / (tp + fp)
    wins = sum((a > b) + 0.5 * (a == b) for ya, a in pairs if ya for yb, b in pairs if not yb)
    return ap / positives, wins / (positives * (len(pairs) - positives))


@pytest.mark.parametrize("seed", range(4))
def test_ranking_metrics_match_their_definition(spark, seed):
    rng = random.Random(seed)
    pairs = [(int(rng.random() < 0.3), rng.randrange(12) / 12 if seed % 2 else rng.random()) for _ in range(150)]
    got = M.ranking_metrics(scored(spark, pairs), "label", "score", slices=5).first()
    assert (got["average_precision"], got["roc_auc"]) == pytest.approx(brute_ap_auc(pairs))


def test_perfect_reversed_and_single_class(spark):
    perfect = scored(spark, [(1, 0.9), (1, 0.8), (0, 0.2), (0, 0.1)])
    assert tuple(M.ranking_metrics(perfect, "label", "score").first()) == (1.0, 1.0, 1.0)
    assert M.ranking_metrics(perfect.withColumn("score", -F.col("score")), "label", "score").first()["roc_auc"] == 0.0
    assert tuple(M.ranking_metrics(perfect.withColumn("label", F.lit(1)), "label", "score").first()) == (0.0, 0.0, 0.0)


def test_k_beyond_the_table_gives_zeros(spark):
    got = {r["k"]: (r["precision"], r["recall"], r["lift"]) for r in precision_at_k(scored(spark, [(1, 0.9), (0, 0.8), (1, 0.1)]), "label", "score", "row_id", [1, 3, 4]).collect()}
    assert got[1] == pytest.approx((1.0, 0.5, 1.5)) and got[3] == pytest.approx((2 / 3, 1.0, 1.0)) and got[4] == (0.0, 0.0, 0.0)


def test_t_and_normal_tails(spark):
    df = spark.createDataFrame([(0.9, 0.8), (0.85, 0.8), (0.95, 0.7), (0.8, 0.75)], "a double, b double")
    got = M.paired_t_test(df, "a", "b").first()
    d = np.array([0.1, 0.05, 0.25, 0.05])
    assert got["t"] == pytest.approx(d.mean() / (d.std(ddof=1) / 2)) and got["dof"] == 3 and 0 < got["p_value"] < 0.2


def test_auc_test_agrees_with_pairwise_placements(spark):
    rng = np.random.default_rng(5)
    y = (rng.random(120) < 0.4).astype(int)
    a, b = rng.random(120) + 0.5 * y, np.round(rng.random(120) + 0.3 * y, 1)
    df = spark.createDataFrame([(i, int(y[i]), float(a[i]), float(b[i])) for i in range(120)], "row_id long, label int, a double, b double")
    got = M.auc_difference_test(df, "label", "a", "b", "row_id").first()
    diffs = []
    for s in (a, b):
        wins = (s[y == 1][:, None] > s[y == 0][None, :]) + 0.5 * (s[y == 1][:, None] == s[y == 0][None, :])
        diffs.append((wins.mean(1), wins.mean(0), wins.mean()))
    var = np.var(diffs[0][0] - diffs[1][0], ddof=1) / (y == 1).sum() + np.var(diffs[0][1] - diffs[1][1], ddof=1) / (y == 0).sum()
    z = (diffs[0][2] - diffs[1][2]) / math.sqrt(var)
    assert got["auc_a"] == pytest.approx(diffs[0][2]) and got["z"] == pytest.approx(z)
    assert got["p_value"] == pytest.approx(math.erfc(abs(z) / math.sqrt(2)))


def sample(spark, values):
    return spark.createDataFrame([(float(v),) for v in values], "x double")


def test_drift_is_zero_on_identical_and_large_on_shifted_samples(spark):
    rng = np.random.default_rng(1)
    ref = rng.normal(size=400)
    same, far = sample(spark, ref), sample(spark, ref + 100)
    ref = sample(spark, ref)
    assert D.psi(ref, same, ["x"]).first()["psi"] == pytest.approx(0)
    assert D.jensen_shannon(ref, same, ["x"]).first()["jsd"] == pytest.approx(0, abs=1e-9)
    assert D.ks(ref, same, ["x"]).first()["ks_stat"] == 0 and D.ks(ref, same, ["x"]).first()["ks_p"] == 1.0
    assert D.psi(ref, far, ["x"]).first()["psi"] > 1 and D.ks(ref, far, ["x"]).first()["ks_stat"] == 1
    assert 0.5 < D.jensen_shannon(ref, far, ["x"]).first()["jsd"] <= math.log(2) + 1e-9


def test_psi_matches_numpy_with_widened_outer_edges(spark):
    rng = np.random.default_rng(2)
    ref, cur = rng.normal(size=300), rng.normal(0.5, 2, size=200)
    _, edges = np.histogram(ref, bins=10)
    edges[0], edges[-1] = min(edges[0], cur.min()), max(edges[-1], cur.max())
    r, c = ((np.histogram(v, bins=edges)[0] + 1e-6) / (len(v) + 1e-5) for v in (ref, cur))
    assert D.psi(sample(spark, ref), sample(spark, cur), ["x"]).first()["psi"] == pytest.approx(float(((c - r) * np.log(c / r)).sum()))


def test_small_and_constant_samples(spark):
    nine, many = sample(spark, range(9)), sample(spark, range(30))
    assert D.psi(nine, many, ["x"]).first()["psi"] == 0.0 and D.jensen_shannon(many, nine, ["x"]).first()["jsd"] == 0.0
    flat = sample(spark, [5.0] * 20)
    assert D.psi(flat, flat, ["x"]).first()["psi"] == pytest.approx(0)
    assert D.psi(flat, many, ["x"]).first()["psi"] > 1


def test_detectors_find_a_known_shift_and_stay_quiet_without_one():
    rng = random.Random(0)
    calm = [float(rng.random() < 0.1) for _ in range(2000)]
    shifted = calm + [float(rng.random() < 0.7) for _ in range(1000)]
    for name, detector in {"adwin": C.Adwin(), "ddm": C.Ddm(), "eddm": C.Eddm(), "page_hinkley": C.PageHinkley(20)}.items():
        hits = [i for i, x in enumerate(shifted) if detector.update(x)]
        assert any(2000 <= i < 2500 for i in hits), name
    quiet = C.Adwin()
    assert not any(quiet.update(x) for x in calm)


def test_detector_state_survives_a_dump():
    rng = random.Random(4)
    values = [float(rng.random() < (0.1 if i < 800 else 0.6)) for i in range(1500)]
    straight, broken = C.Consensus(), C.Consensus()
    fired = []
    for i, x in enumerate(values):
        if i % 200 == 0:
            broken = C.Consensus().load(broken.dump())
        a, b = straight.update(x), broken.update(x)
        assert a == b
        fired += a
    assert fired


def test_a_leaking_split_fails_in_the_action(spark):
    rows = [(i, datetime(2024, 1, 1 + i), None) for i in range(20)]
    df = spark.createDataFrame(rows, "id long, t timestamp, f timestamp")
    c = L.SplitColumns(key="id", time="t", flag="f", tie="id", label="y")
    train, test = L.temporal_split(df, c, L.Split(datetime(2024, 1, 10), datetime(2024, 1, 18), gap_days=-5))
    with pytest.raises(Exception, match="temporal leak"):
        test.collect()
    with pytest.raises(Exception, match="temporal leak"):
        train.count()
    train, test = L.temporal_split(df, c, L.Split(datetime(2024, 1, 10), datetime(2024, 1, 18), gap_days=2))
    assert train.count() == 10 and test.count() == 6
    assert L.temporal_split(df.limit(0), c, L.Split(datetime(2024, 1, 10), datetime(2024, 1, 18)))[0].count() == 0
    bad = [L.Fold(1, None, datetime(2024, 1, 10), datetime(2024, 1, 5), datetime(2024, 1, 18))]
    with pytest.raises(Exception, match="temporal leak in fold 1"):
        L.assign_folds(df, c, bad).count()


def test_sketches_merge_and_sets_tell_nulls_from_totals(spark, tmp_path):
    from stallwatch.operators import aggregates as A

    df = spark.range(40000).select((F.col("id") % 7000).alias("a"), F.expr("date_add(DATE'2024-01-01', CAST(id % 3 AS INT))").alias("d"), F.when(F.col("id") % 2 == 0, "x").alias("g"), (F.col("id") % 5 == 0).cast("int").alias("y"))
    folder = str(tmp_path / "s")
    A.add_sketches(df.filter("d < DATE'2024-01-03'"), ["a"], F.col("d"), folder)
    before = {p.name: p.stat().st_mtime for p in (tmp_path / "s").glob("day=*/*.parquet")}
    A.add_sketches(df.filter("d = DATE'2024-01-03'"), ["a"], F.col("d"), folder)
    A.add_sketches(df.filter("d = DATE'2024-01-03'"), ["a"], F.col("d"), folder)  # a repeated day replaces itself
    after = {p.name: p.stat().st_mtime for p in (tmp_path / "s").glob("day=*/*.parquet")}
    assert before.items() <= after.items() and spark.read.parquet(folder).count() == 3
    assert abs(A.merged_distincts(spark.read.parquet(folder)).first().distinct / 7000 - 1) < 0.02
    assert A.distinct_counts(df, ["a", "g"]).first().asDict() == {"distinct_a": 7000, "distinct_g": 1}
    got = {(r.g, r.in_g): (r.n, r.positives) for r in A.positive_rate_sets(df, [["g"], []], "y").collect()}
    assert got == {("x", True): (20000, 4000), (None, True): (20000, 4000), (None, False): (40000, 8000)}

"""Whitening against exact fractions and a plain numpy version."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallwatch.llm import queries, whitening

VECTORS = "vec_id bigint, embedding array<float>, label int"


def plain(vectors, components):
    """(ids and x, n, S, eigenvalues, axes, trace) straight from the definition."""
    kept = [(i, [int(np.floor(256 * float(np.float32(c)))) for c in v]) for i, v in vectors if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    distinct = sorted({tuple(x) for _, x in kept})
    n, dims = len(distinct), len(distinct[0])
    sums = [sum(x[d] for x in distinct) for d in range(dims)]
    centred = [[Fraction(n * x[d] - sums[d], n) for d in range(dims)] for x in distinct]
    cov = np.array([[float(sum(c[a] * c[b] for c in centred) / n) for b in range(dims)] for a in range(dims)])
    values, axes = np.linalg.eigh(cov)
    order = np.argsort(-values)[:components]
    return kept, n, sums, values[order], axes[:, order], values.sum(), cov


def rows_for(seed=3, n=60, dims=5):
    rng = np.random.default_rng(seed)
    made = rng.normal(size=(n, dims)) @ np.diag([3, 2, 1, 0.5, 0.2][:dims])
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(made)]
    return rows + [(7, rows[7][1]), (None, rows[8][1]), (900, None), (901, [1.0, None, 0.0, 0.0, 0.0][:dims]), (902, [float("nan")] + [0.0] * (dims - 1)), (903, [float("inf")] + [0.0] * (dims - 1)), (904, [-0.0] * dims)]


def test_whitening_equals_the_definition(spark):
    rows = rows_for()
    df = spark.createDataFrame([(i, v, None) for i, v in rows], VECTORS).repartition(3)
    fitted = whitening.vectors_of(df)
    model = whitening.fit(fitted, 4)
    kept, n, sums, values, axes, trace, cov = plain(rows, 4)
    assert model.n == n and np.allclose(model.covariance, cov, rtol=1e-13, atol=1e-9)
    assert np.allclose(model.variances, values, rtol=1e-10) and np.allclose(model.explained, values / trace, rtol=1e-10)
    got = sorted(((r.vec_id is None, r.vec_id or 0, int(r.deviation)), r.whitened) for r in whitening.whiten(df, model).collect())
    want = sorted(
        ((i is None, i or 0, sum((n * x[d] - sums[d]) ** 2 for d in range(len(x)))), ((np.array(x) - np.array(sums) / n) @ axes / np.sqrt(values)).tolist())
        for i, x in kept
    )
    assert [g[0] for g in got] == [w[0] for w in want]
    a, b = np.array([g[1] for g in got]), np.array([w[1] for w in want])
    signs = np.sign((a * b).sum(axis=0))
    assert np.allclose(a * signs, b, rtol=1e-8, atol=1e-9)
    assert whitening.identity_error(fitted, model) < 1e-9


def test_ragged_flat_huge_and_missing_vectors(spark):
    flat = spark.createDataFrame([(i, [1.0, float(i % 3)], 0) for i in range(9)], VECTORS)
    model = whitening.fit(whitening.vectors_of(flat))
    assert model.n == 3 and model.variances[1] == 0 and model.explained[0] == pytest.approx(1)
    assert all(r.whitened[1] is None and r.whitened[0] is not None for r in whitening.whiten(flat, model).collect())
    ragged = flat.union(spark.createDataFrame([(50, [1.0], 0), (51, [], 0), (52, [1.0, 2.0, 3.0], 0)], VECTORS))
    odd = whitening.whiten(ragged, whitening.fit(whitening.vectors_of(ragged))).filter("vec_id >= 50").collect()
    assert len(odd) == 3 and all(r.deviation is None and r.whitened == [None, None] for r in odd)
    huge = spark.createDataFrame([(1, [3e12, 1.0], 0), (2, [-3e12, 5.0], 0), (3, [1e30, 2.0], 0)], VECTORS)
    model = whitening.fit(whitening.vectors_of(huge))
    assert len(whitening.whiten(huge, model).collect()) == 3 and all(np.isfinite(model.variances))
    one = spark.createDataFrame([(1, [0.5, 0.25], 0)], VECTORS)
    model = whitening.fit(whitening.vectors_of(one))
    assert model.explained == (None, None) and whitening.identity_error(whitening.vectors_of(one), model) is None
    empty = spark.createDataFrame([], VECTORS)
    assert whitening.fit(whitening.vectors_of(empty)) is None and whitening.whiten(empty, None).count() == 0


def test_other_columns_may_have_any_name(spark):
    df = spark.createDataFrame([(i, v, None) for i, v in rows_for()], VECTORS).withColumn("x", F.lit("x")).withColumn("row_id", F.lit(1)).withColumn("Deviation", F.lit(None))
    model = whitening.fit(whitening.vectors_of(df))
    assert whitening.whiten(df, model).columns == ["vec_id", "deviation", "whitened"] and whitening.whiten(df, model).count() == 63


def test_query_on_the_table(spark, folder):
    rows = queries.QUERIES["op12_embedding_whitening"](spark, folder).collect()
    table = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect()]
    kept, n, sums, values, axes, trace, _ = plain(table, 4)
    assert len(rows) == 4 * len(kept) and {r.n for r in rows} == {n}
    xs = dict(kept)
    for r in rows[:400]:
        want = (np.array(xs[r.vec_id]) - np.array(sums) / n) @ axes[:, r.component - 1] / np.sqrt(values[r.component - 1])
        assert abs(abs(r.whitened) - abs(want)) < 1e-8 and r.explained == pytest.approx(values[r.component - 1] / trace, rel=1e-9)
        assert r.deviation == sum((n * x - s) ** 2 for x, s in zip(xs[r.vec_id], sums))
    assert rows[0].identity_error < 1e-4

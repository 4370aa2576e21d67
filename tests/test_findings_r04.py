"""What the findings of round 4 were about: results equal to the SQL on odd and larger tables, whole jobs, less work for the same result."""

import math

import duckdb
import pytest
from pyspark.sql import functions as F


def _twin(name, **tables):
    """What a query's SQL gives over pandas frames."""
    from stallwatch.catalog import load

    db = duckdb.connect()
    db.execute("SET TimeZone='UTC'")
    for table, frame in tables.items():
        db.register(table, frame)
    return db.execute(load()[1][name]).fetchall()


def _query(spark, name, path, **tables):
    """What a query gives over pandas frames stored below ``path``."""
    from stallwatch.catalog import load

    for table, frame in tables.items():
        spark.createDataFrame(frame).write.mode("overwrite").parquet(f"{path}/{table}.parquet")
    return [tuple(r) for r in load()[0][name](spark, str(path)).collect()]


@pytest.mark.parametrize("prices", [(50_000.0, 0.0), (50_000.0, 105_000.0), (50_000.0, 205_000.0), (50_000.0, -5.0), (1_000.0, 90_000.0)])
def test_losses_take_scores_as_their_sql_does(spark, folder, tmp_path, prices):
    li = duckdb.sql(f"SELECT * FROM '{folder}/lineitem.parquet' LIMIT 40").df()
    li["l_extendedprice"] = [prices[i % 2] for i in range(len(li))]
    got, want = _query(spark, "probability_losses", tmp_path, lineitem=li), _twin("probability_losses", lineitem=li)
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_losses_stay_bounded_where_a_bound_is_asked_for(spark):
    from stallwatch.operators.metrics import probability_losses

    rows = spark.createDataFrame([(1, 0.0), (0, 1.0), (1, 1.0)], "y int, s double")
    assert math.isfinite(probability_losses(rows, "y", "s").first()["log_loss"])
    assert probability_losses(rows.limit(1), "y", "s", eps=None).first()["log_loss"] == math.inf


def test_addresses_of_many_users_equal_their_sql(spark, folder, tmp_path):
    events = duckdb.sql(f"SELECT * REPLACE (user_id * 7000 AS user_id) FROM '{folder}/events.parquet' WHERE event_id < 300").df()
    assert events["user_id"].max() >= 256 * 250
    got, want = _query(spark, "hashed_addresses_v4", tmp_path, events=events), _twin("hashed_addresses_v4", events=events)
    assert sorted(map(str, got)) == sorted(map(str, want))


def test_hubs_keep_all_their_partners(spark, tmp_path):
    n = 130  # more than any cap in the catalog
    events = duckdb.sql(f"""SELECT i AS event_id, TIMESTAMP '2024-01-01' + INTERVAL 1 HOUR * (i // 3) AS ts, i % {n} AS user_id, CASE WHEN i % 40 = 0 THEN 'error' ELSE 'view' END AS event_type,
        1.0 AS value, '{{"k": ' || (i % 7) || '}}' AS props FROM range({2 * n}) r(i)""").df()
    got, want = _query(spark, "sharing_edges_of_hubs", tmp_path, events=events), _twin("sharing_edges_of_hubs", events=events)
    assert sorted(got) == sorted(want)
    degrees = {}
    for kind, src, *_ in got:
        degrees[kind, src] = degrees.get((kind, src), 0) + 1
    assert max(degrees.values()) > 100


def test_link_samples_compare_few_pairs_and_stay_exact(spark, monkeypatch):
    from stallwatch.operators import graph as G

    nodes = spark.range(3000).withColumnRenamed("id", "n")
    edges = spark.range(4000).select((F.col("id") * 7 % 3000).alias("src"), (F.col("id") * 11 % 3000 + F.floor(F.col("id") / 3000)).alias("dst"))
    kept, store = {}, G.stored

    def watched(df, name="stored"):
        kept[name] = store(df, name)
        return kept[name]

    monkeypatch.setattr(G, "stored", watched)
    run = lambda: sorted(map(tuple, G.link_samples(edges, nodes, "n").collect()))
    bounded, wanted = run(), edges.distinct().count()
    assert wanted <= kept["drawn"].count() < 1.3 * wanted  # of three draws an edge
    for bound in (None, 2**50):  # all pairs at once, and a bound that lets too few through
        monkeypatch.setattr(G, "_enough_below", lambda *_, bound=bound: bound)
        assert run() == bounded
    assert sum(label for *_, label in bounded) == wanted == len(bounded) / 2


def test_split_inputs_are_kept_as_compressed_columns(spark, folder):
    from stallwatch.catalog import modelling as C
    from stallwatch.session import ensure_checkpoint_dir, stored

    sides = C._graph_split(spark, folder)
    for side in (sides.train, sides.test):
        assert side.inputFiles() and all(ensure_checkpoint_dir(spark).split(":")[-1] in f and f.endswith(".parquet") for f in side.inputFiles())
    odd = spark.createDataFrame([(1, [1.0, 2.0])], "i int, `a b/c.d` array<double>").withColumn("none", F.lit(None))
    assert stored(odd).collect() == odd.collect() and stored(odd.drop("none")).collect() == odd.drop("none").collect()


def test_rows_with_vectors_are_grown_on_once_when_equal(spark, monkeypatch):
    from stallwatch.operators import models as M
    from stallwatch.registry import Variant

    size, seen = M.WIDEST, []
    vector = F.when(F.col("id") % 5 == 0, F.array(*[(F.col("id") % 10 + i).cast("double") for i in range(size)])).otherwise(F.array_repeat(F.lit(0.0), size))
    rows = spark.range(4000).select((F.col("id") % 4).cast("double").alias("a"), (F.col("id") % 2).alias("y"), vector.alias("v"), F.when(F.col("id") % 20 != 3, "x").alias("c"))
    fit = M.GBTClassifier._fit
    monkeypatch.setattr(M.GBTClassifier, "_fit", lambda self, df: seen.append(df.agg(F.count("*"), F.sum(M.WEIGHT)).first()) or fit(self, df))
    model = M.fit_variant(rows, "y", Variant.GRAPH_VECTORS, numbers=["a"], categories=["c"], vector="v", vector_size=size, maxIter=2)
    different = rows.distinct().count()
    assert seen[0][0] <= M.PARTS * different < 100 and round(seen[0][1], 6) == 4000
    assert len(model.inputs) == 4 + size and model.predict(rows).filter(f"({M.PROBABILITY} > 0.5) <> (y = 1)").count() == 0


def test_variants_are_fitted_side_by_side(spark):
    import threading

    from stallwatch.operators import models as M
    from stallwatch.registry import Variant

    rows = spark.range(200).select((F.col("id") % 10).cast("double").alias("a"), (F.col("id") % 10 < 4).cast("int").alias("y"))
    met = threading.Barrier(2, timeout=60)

    def fit(variant):
        def run(train):
            met.wait()  # passes only if both fits run at a time
            return M.fit_variant(train, "y", variant, numbers=["a"])

        return run

    models, metrics = M.train_variants(rows, rows, "y", {"b": fit(Variant.LOGISTIC), "a": fit(Variant.LOGISTIC)})
    assert list(models) == ["b", "a"] and {r["model"]: r["average_precision"] for r in metrics.collect()} == {"a": 1.0, "b": 1.0}

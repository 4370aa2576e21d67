"""Preparation, classifiers, explanation."""

from datetime import datetime

from pyspark.sql import functions as F

from stallwatch.catalog import query
from stallwatch.catalog.tables import rounded, table
from stallwatch.operators import explain as X
from stallwatch.operators import models as M
from stallwatch.operators.features import encode_for_model, fill_numbers, scaled
from stallwatch.functions.scalar import time_features
from stallwatch.operators.graph_inputs import GraphInputs, split_inputs
from stallwatch.operators.labels import Split, SplitColumns, assign_folds, expanding_folds
from stallwatch.operators.metrics import ranking_metrics
from stallwatch.plans.skew import spread
from stallwatch.registry import Variant

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATEGORIES = ["l_linestatus", "p_brand"]
SPLIT_AT = "2000-01-01"


def _rows(spark, d):
    """Lines with their part's brand; a heavily discounted bulk line is a positive, plus returned low-tax lines."""
    label = ((F.col("l_discount") >= 0.08) & (F.col("l_quantity") > 30)) | ((F.col("l_returnflag") == "R") & (F.col("l_tax") < 0.01))
    li = table(spark, d, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"), *NUMBERS, "l_linestatus", F.col("l_partkey").alias("p_partkey"),
        "l_suppkey", "l_shipdate", label.cast("int").alias("y"),
    )
    return li.join(table(spark, d, "part").select("p_partkey", "p_brand"), "p_partkey")


def _split(spark, d):
    rows = _rows(spark, d)
    cut = F.lit(SPLIT_AT).cast("timestamp_ntz")
    return rows.filter(F.col("l_shipdate") <= cut), rows.filter(F.col("l_shipdate") > cut)


def _fit(variant, **settings):
    return lambda train: M.fit_variant(train, "y", variant, numbers=NUMBERS, categories=CATEGORIES, **settings)


def _boosted(train):
    return _fit(Variant.BOOSTED, positive_weight=3.0)(train)


@query("""
SELECT p_partkey, CAST(dense_rank() OVER (ORDER BY p_brand) - 1 AS DOUBLE) AS p_brand, CAST(dense_rank() OVER (ORDER BY p_type) - 1 AS DOUBLE) AS p_type FROM part""")
def ordinal_codes(spark, d):
    return encode_for_model(table(spark, d, "part").select("p_partkey", "p_brand", "p_type"), ["p_brand", "p_type"])[0]


@query("SELECT c_custkey, coalesce(CASE WHEN c_acctbal < 0 THEN NULL ELSE c_acctbal END, 0) AS filled FROM customer")
def filled_numbers(spark, d):
    c = table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("filled"))
    return fill_numbers(c, ["filled"])


@query("SELECT p_partkey, round((p_size - avg(p_size) OVER ()) / stddev_samp(p_size) OVER (), 5) AS size, round((p_retailprice - avg(p_retailprice) OVER ()) / stddev_samp(p_retailprice) OVER (), 5) AS price FROM part")
def standardised_numbers(spark, d):
    from pyspark.ml.functions import vector_to_array

    out = scaled(table(spark, d, "part"), ["p_size", "p_retailprice"]).withColumn("v", vector_to_array("features"))
    return rounded(out.select("p_partkey", F.col("v")[0].alias("size"), F.col("v")[1].alias("price")), ["size", "price"], 5)


GRAPH = GraphInputs(SplitColumns(key="o_orderkey", time="o_orderdate", flag="flagged_at", tie="o_orderkey", label="y"), {"customer": ["o_custkey"]}, ["o_totalprice"])
GRAPH_NUMBERS, GRAPH_CATEGORIES = ["o_totalprice", "event_hour", "event_weekday"], ["o_orderstatus"]
GRAPH_SPLIT = Split(datetime(2000, 1, 1), datetime(2001, 6, 1), 7)


def _order_events(spark, d):
    """Orders as listings of a customer; an urgent or very dear one is flagged ten days later."""
    o = table(spark, d, "orders")
    bad = (F.col("o_orderpriority") == "1-URGENT") | (F.col("o_totalprice") > 400_000)
    rows = o.select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus", F.when(bad, F.col("o_orderdate") + F.expr("INTERVAL 10 DAYS")).alias("flagged_at"))
    return rows.withColumns(time_features("o_orderdate"))


def _graph_split(spark, d):
    return split_inputs(_order_events(spark, d), GRAPH_SPLIT, GRAPH)


@query()
def model_variants(spark, d):
    """All five variants over one split, graph features assembled inside it."""
    sides = _graph_split(spark, d)

    def fit(variant, numbers=(), **settings):
        return lambda train: M.fit_variant(train, "y", variant, numbers=[*GRAPH_NUMBERS, *numbers], categories=GRAPH_CATEGORIES, **settings)

    boosted = {"positive_weight": 3.0}
    fits = {
        Variant.LOGISTIC.value: fit(Variant.LOGISTIC),
        Variant.FOREST.value: fit(Variant.FOREST),
        Variant.BOOSTED.value: fit(Variant.BOOSTED, **boosted),
        Variant.GRAPH_VECTORS.value: fit(Variant.GRAPH_VECTORS, vector=sides.vector, vector_size=sides.vector_size, **boosted),
        Variant.GRAPH_FEATURES.value: fit(Variant.GRAPH_FEATURES, [*sides.history, *sides.clusters], **boosted),
    }
    return M.train_variants(sides.train, sides.test, "y", fits)[1]


_CUTS = {"train": ("TIMESTAMP '2000-01-01'", "o_orderdate <= TIMESTAMP '2000-01-01'"), "test": ("TIMESTAMP '2001-06-01'", "o_orderdate > TIMESTAMP '2000-01-08' AND o_orderdate <= TIMESTAMP '2001-06-01'")}


def _inputs_sql(side):
    cut, where = _CUTS[side]
    return f"""SELECT '{side}' AS side, o.o_orderkey, CAST(coalesce(o.flagged_at <= {cut}, false) AS TINYINT) AS y, h.prior, h.flagged, CAST(greatest(1, least(100, coalesce(k.n, 1))) AS INT) AS cluster_size, coalesce(v.x, 0) AS neighbour_price
FROM e o JOIN (SELECT a.o_orderkey, count(b.o_orderkey)::DOUBLE AS prior, (count(*) FILTER (b.flagged_at IS NOT NULL AND greatest(b.flagged_at, b.o_orderdate) < a.o_orderdate))::DOUBLE AS flagged FROM e a LEFT JOIN e b ON a.o_custkey = b.o_custkey AND b.o_orderdate < a.o_orderdate GROUP BY 1) h USING (o_orderkey)
LEFT JOIN (SELECT o_custkey, count(*) AS n FROM e WHERE o_orderdate <= TIMESTAMP '2000-01-01' GROUP BY 1) k ON k.o_custkey = o.o_custkey
LEFT JOIN (SELECT dst, avg(price) AS x FROM (SELECT b.o_orderkey AS dst, a.o_totalprice AS price, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_orderdate, b.o_orderkey) AS rn
 FROM e a JOIN e b ON a.o_custkey = b.o_custkey AND a.o_orderdate < b.o_orderdate WHERE b.o_orderdate <= {cut}) WHERE rn <= 100 GROUP BY 1) v ON v.dst = o.o_orderkey WHERE {where}"""


@query(f"""WITH e AS (SELECT *, CASE WHEN o_orderpriority = '1-URGENT' OR o_totalprice > 400000 THEN o_orderdate + INTERVAL 10 DAY END AS flagged_at FROM orders)
SELECT side, o_orderkey, y, prior, flagged, cluster_size, round(neighbour_price, 3) AS neighbour_price FROM ({_inputs_sql('train')} UNION ALL {_inputs_sql('test')})""")
def split_with_graph_inputs(spark, d):
    """What the graph variants read, row by row: label, history, cluster size and the first entry of the graph vector."""
    sides, out = _graph_split(spark, d), None
    for name, rows in (("train", sides.train), ("test", sides.test)):
        one = rows.select(
            F.lit(name).alias("side"), "o_orderkey", "y", F.col("o_custkey_prior_entities").alias("prior"), F.col("o_custkey_prior_flagged").alias("flagged"),
            F.col("cf_o_custkey_cluster_size").alias("cluster_size"), F.col(sides.vector)[0].alias("neighbour_price"),
        )
        out = one if out is None else out.unionByName(one)
    return rounded(out, ["neighbour_price"], 3)


@query()
def model_with_graph_vectors(spark, d):
    from stallwatch.operators.joins import attach_vectors

    vectors = table(spark, d, "embeddings").select(F.col("vec_id").alias("l_suppkey"), "embedding")
    train, test = _split(spark, d)
    train, test = (attach_vectors(part, vectors, "l_suppkey", "embedding", 64) for part in (train, spread(test)))
    model = M.fit_variant(train, "y", Variant.GRAPH_VECTORS, numbers=NUMBERS, categories=CATEGORIES, vector="embedding", vector_size=64)
    return ranking_metrics(model.predict(test), "y", M.PROBABILITY)


@query()
def scored_rows(spark, d):
    train, test = _split(spark, d)
    scored = M.score_rows(_boosted(train), test)
    return scored.groupBy("risk_tier", "decision").agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"), F.avg("confidence").alias("confidence"))


@query()
def feature_importance(spark, d):
    return _boosted(_split(spark, d)[0]).importance()


@query()
def saved_model_features(spark, d):
    from stallwatch.session import scratch_folder

    folder = scratch_folder(spark, "model")
    _boosted(_split(spark, d)[0]).save(folder)
    features = spark.read.parquet(f"{folder}/features").select(F.lit("feature").alias("kind"), "feature", F.lit("").alias("category"), F.col("position").cast("double").alias("code"))
    return features.unionByName(spark.read.parquet(f"{folder}/categories").select(F.lit("category").alias("kind"), "feature", "category", "code"))


@query(f"SELECT count(*) AS n, count(*) AS equal FROM lineitem WHERE l_shipdate > TIMESTAMP '{SPLIT_AT}'")
def reloaded_scores(spark, d):
    """Rows of the test split whose score by the saved and reloaded model is the fitted model's own."""
    from stallwatch.session import scratch_folder

    train, test = _split(spark, d)
    model, folder = _boosted(train), scratch_folder(spark, "reloaded")
    model.save(folder)
    keys = ["row_id", *NUMBERS, *CATEGORIES]
    own = model.predict(test.select(*keys)).groupBy("row_id").agg(F.sort_array(F.collect_list(M.PROBABILITY)).alias("own"))
    again = M.FittedModel.load(spark, folder).predict(test.select(*keys)).groupBy("row_id").agg(F.sort_array(F.collect_list(M.PROBABILITY)).alias("again"))
    both = own.join(again, "row_id")
    return both.agg(F.sum(F.size("own")).alias("n"), F.sum(F.when(F.col("own") == F.col("again"), F.size("own")).otherwise(0)).alias("equal"))


@query()
def random_search(spark, d):
    columns = SplitColumns(key="row_id", time="l_shipdate", flag="l_shipdate", tie="row_id", label="unused")
    folds = expanding_folds(datetime(1995, 1, 1), datetime(2001, 10, 1), window_days=600, gap_days=7)
    folded = assign_folds(_rows(spark, d), columns, folds, label=False)
    out = M.Search().run(folded, "y", numbers=NUMBERS, categories=CATEGORIES, folds=[f.fold for f in folds])
    return out.select("trial", F.to_json("settings").alias("settings"), "mean_ap")


@query()
def group_ablation(spark, d):
    sides = _graph_split(spark, d)

    def fit(df, columns):
        return M.fit_variant(df, "y", Variant.BOOSTED, numbers=columns)

    groups = {"listing": ["o_totalprice"], "time": ["event_hour", "event_weekday", "event_is_weekend", "event_is_business_hours"], "history": sides.history, "cluster": sides.clusters}
    return M.ablation(sides.train, sides.test, "y", groups, fit)


@query()
def tree_contributions(spark, d):
    train, test = _split(spark, d)
    return X.tree_contributions(_boosted(train), test, "row_id")[0].groupBy("feature").agg(F.count(F.lit(1)).alias("rows"), F.avg(F.abs("contribution")).alias("importance"))


@query("""
WITH c AS (SELECT 'p_size' AS feature, 0.3 * (p_size - (SELECT avg(p_size) FROM part)) AS v FROM part UNION ALL SELECT 'p_retailprice', -0.02 * (p_retailprice - (SELECT avg(p_retailprice) FROM part)) FROM part),
s AS (SELECT feature, avg(abs(v)) AS importance, stddev_pop(v) AS std FROM c GROUP BY 1)
SELECT feature, round(importance, 6) AS importance, round(std, 6) AS std_contribution, CAST(row_number() OVER (ORDER BY importance DESC) AS INT) AS rank FROM s""")
def global_importance(spark, d):
    long = X.linear_contributions(table(spark, d, "part"), "p_partkey", {"p_size": 0.3, "p_retailprice": -0.02})
    return rounded(X.global_importance(long).drop("mean_contribution"), ["importance", "std_contribution"])


@query()
def explanation_report(spark, d):
    train, test = _split(spark, d)
    model = _boosted(train)
    cases = X.explanation_cases(model.predict(test).select("row_id", "y", M.PROBABILITY), row_id="row_id", label="y", score=M.PROBABILITY)
    long = X.tree_contributions(model, X.rows_of(cases, test, "row_id"), "row_id")[0]
    return X.explanation_report(cases, long, row_id="row_id")

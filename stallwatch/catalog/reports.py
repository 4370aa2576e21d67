"""Grouped reports."""

from pyspark.sql import functions as F

from stallwatch.catalog import query
from stallwatch.catalog.tables import LIFECYCLE_SQL, LISTINGS_SQL, PREDICTIONS_SQL, lifecycle, listings, predictions, rounded, table
from stallwatch.operators import aggregates as A
from stallwatch.session import scratch_folder


@query("SELECT event_type, count(*) AS n FROM events GROUP BY 1")
def status_counts(spark, d):
    return A.count_by(table(spark, d, "events"), "event_type")


@query(f"""
SELECT count(*) AS total_rows, CAST(8 AS INT) AS total_columns, count(DISTINCT user_id) AS unique_ids,
 count(*) FILTER (label = 1) AS positive_events, count(*) FILTER (label = 0) AS negative_events FROM ({LIFECYCLE_SQL})""")
def table_summary(spark, d):
    return A.summary(lifecycle(spark, d), "user_id", "label", "event_type")[0]


@query("""SELECT 'user_id' AS name, count(DISTINCT user_id) AS exact, true AS close FROM events UNION ALL SELECT 'props', count(DISTINCT props), true FROM events UNION ALL SELECT 'event_id', count(DISTINCT event_id), true FROM events""")
def sketched_distincts(spark, d):
    """Distinct counts merged from stored daily sketches, next to exact ones: within two per cent."""
    names, folder = ["user_id", "props", "event_id"], scratch_folder(spark, "sketches")
    e = table(spark, d, "events")
    A.add_sketches(e.filter(F.dayofmonth("ts") < 20), names, F.to_date("ts"), folder)
    A.add_sketches(e.filter(F.dayofmonth("ts") >= 20), names, F.to_date("ts"), folder)
    exact = A.distinct_counts(e, names).select(F.inline(F.array(*[F.struct(F.lit(n).alias("name"), F.col(f"distinct_{n}").alias("exact")) for n in names])))
    merged = A.merged_distincts(spark.read.parquet(folder))
    return exact.join(merged, "name").select("name", "exact", (F.abs(F.col("distinct") / F.col("exact") - 1) <= 0.02).alias("close"))


_SETS = """SELECT s.country, s.brand, s.in_country, s.in_brand, n, positives, round(rate, 6) AS rate FROM (
 SELECT country, brand, grouping(country) = 0 AS in_country, grouping(brand) = 0 AS in_brand, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, avg(y) AS rate
 FROM (SELECT nullif(s_nationkey, 3) AS country, nullif(p_brand, 'Brand#11') AS brand, CAST(l_returnflag = 'R' AS INT) AS y FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN part ON l_partkey = p_partkey)
 GROUP BY GROUPING SETS ((country), (brand), (country, brand), ())) s"""


@query(_SETS)
def positive_rates_over_sets(spark, d):
    """Rates by country, by brand, by both and over all, with categories that are null."""
    li = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    rows = li.select(F.nullif("s_nationkey", F.lit(3)).alias("country"), F.nullif("p_brand", F.lit("Brand#11")).alias("brand"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return rounded(A.positive_rate_sets(rows, [["country"], ["brand"], ["country", "brand"], []], "y"), ["rate"])


@query("SELECT count(DISTINCT user_id) AS distinct_user_id, count(DISTINCT event_type) AS distinct_event_type, count(DISTINCT props) AS distinct_props FROM events")
def distinct_identities(spark, d):
    return A.distinct_counts(table(spark, d, "events"), ["user_id", "event_type", "props"])


@query(f"""
SELECT user_id, max(label) AS label, round(avg(value), 6) AS value, arg_min(event_type, event_id) AS event_type, count(*) AS event_count
FROM ({LIFECYCLE_SQL}) GROUP BY 1""")
def entity_profiles(spark, d):
    out = A.entity_profile(lifecycle(spark, d), "user_id", maxima=["label"], means=["value"], firsts=["event_type"], order=["ts", "event_id"])
    return rounded(out, ["value"])


@query("SELECT l_suppkey, count(*) AS cluster_size FROM lineitem WHERE l_suppkey IS NOT NULL GROUP BY 1")
def cluster_sizes(spark, d):
    return A.cluster_sizes(table(spark, d, "lineitem"), "l_suppkey")


@query(f"""
WITH e AS ({LIFECYCLE_SQL}) SELECT * FROM (
SELECT 'flag_ts' AS "column", count(*) - count(flag_ts) AS nulls, round(count(flag_ts) / count(*), 6) AS coverage FROM e
UNION ALL SELECT 'value', count(*) - count(value), round(count(value) / count(*), 6) FROM e
UNION ALL SELECT 'k', count(*) - count(k), round(count(k) / count(*), 6) FROM e)""")
def column_coverage(spark, d):
    return rounded(A.coverage(lifecycle(spark, d), ["flag_ts", "value", "k"]), ["coverage"])


_GAPPY = "SELECT l_orderkey, CASE WHEN l_linestatus = 'F' THEN l_extendedprice END AS price, CASE WHEN l_returnflag <> 'R' THEN l_quantity END AS quantity, CAST(NULL AS DOUBLE) AS nothing FROM lineitem"


def _gappy(spark, d):
    li = table(spark, d, "lineitem")
    return li.select(
        "l_orderkey", F.when(F.col("l_linestatus") == "F", F.col("l_extendedprice")).alias("price"),
        F.when(F.col("l_returnflag") != "R", F.col("l_quantity")).alias("quantity"), F.lit(None).cast("double").alias("nothing"),
    )


@query(f"""
WITH g AS ({_GAPPY}) SELECT l_orderkey, round(coalesce(price, (SELECT median(price) FROM g)), 6) AS price,
 round(coalesce(quantity, (SELECT median(quantity) FROM g)), 6) AS quantity, CAST(0 AS DOUBLE) AS nothing FROM g""")
def median_imputed(spark, d):
    return rounded(A.impute_median(_gappy(spark, d), ["price", "quantity", "nothing"]), ["price", "quantity"])


@query("""
SELECT 'returnflag' AS dimension, l_linestatus AS category, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(avg(y), 6) AS rate FROM (SELECT *, CAST(l_returnflag = 'R' AS INT) AS y FROM lineitem) GROUP BY 2
UNION ALL SELECT 'year', CAST(year(l_shipdate) AS VARCHAR), count(*), CAST(sum(y) AS BIGINT), round(avg(y), 6) FROM (SELECT *, CAST(l_returnflag = 'R' AS INT) AS y FROM lineitem) GROUP BY 2
UNION ALL SELECT 'month', CAST(month(l_shipdate) AS VARCHAR), count(*), CAST(sum(y) AS BIGINT), round(avg(y), 6) FROM (SELECT *, CAST(l_returnflag = 'R' AS INT) AS y FROM lineitem) GROUP BY 2
UNION ALL SELECT 'supplier', CAST(l_suppkey AS VARCHAR), count(*), CAST(sum(y) AS BIGINT), round(avg(y), 6) FROM (SELECT *, CAST(l_returnflag = 'R' AS INT) AS y FROM lineitem) GROUP BY 2 HAVING count(*) >= 100""")
def positive_rates_by_dimension(spark, d):
    li = table(spark, d, "lineitem").select(
        F.col("l_linestatus").alias("returnflag"), F.year("l_shipdate").alias("year"), F.month("l_shipdate").alias("month"),
        F.col("l_suppkey").alias("supplier"), (F.col("l_returnflag") == "R").cast("int").alias("y"),
    )
    return rounded(A.positive_rate_report(li, ["returnflag", "year", "month", "supplier"], "y", at_least=100), ["rate"])


@query("""
SELECT n_name, p_brand, count(*) AS n, CAST(sum(y) AS BIGINT) AS positives, round(avg(y), 6) AS rate
FROM (SELECT n_name, p_brand, CAST(l_returnflag = 'R' AS INT) AS y FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey)
GROUP BY 1, 2 HAVING count(*) >= 20""")
def positive_rate_by_country_and_brand(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey", (F.col("l_returnflag") == "R").cast("int").alias("y"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("n_nationkey"))
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand")
    joined = li.join(s, "l_suppkey").join(table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey").join(p, "l_partkey")
    return rounded(A.positive_rate(joined, ["n_name", "p_brand"], "y", at_least=20), ["rate"])


@query("""
SELECT lang, source, count(*) AS n, CAST(sum(toxic) AS BIGINT) AS positives, round(avg(toxic), 6) AS rate FROM documents JOIN labels USING (doc_id) GROUP BY 1, 2""")
def toxic_rate_by_language(spark, d):
    joined = table(spark, d, "documents").select("doc_id", "lang", "source").join(table(spark, d, "labels"), "doc_id")
    return rounded(A.positive_rate(joined, ["lang", "source"], "toxic"), ["rate"])


@query(f"""
SELECT CAST(sum(n) AS BIGINT) AS events, count(*) AS entities, round(sum(p) / sum(n), 6) AS event_rate, round(avg(y), 6) AS entity_rate
FROM (SELECT o_custkey, count(*) AS n, sum(label) AS p, max(label) AS y FROM ({LISTINGS_SQL}) GROUP BY 1)""")
def event_and_entity_rates(spark, d):
    return rounded(A.event_and_entity_rate(listings(spark, d), "o_custkey", "label"), ["event_rate", "entity_rate"])


_FLAGS = {
    "large": ("l_quantity > 40", "CAST(l_quantity > 40 AS INT)"),
    "cheap": ("l_extendedprice < 20000", "CAST(l_extendedprice < 20000 AS INT)"),
    "discounted": ("l_discount >= 0.08", "CAST(l_discount >= 0.08 AS INT)"),
}


@query("\nUNION ALL ".join(
    f"SELECT '{n}' AS signal, CAST(sum(f) AS BIGINT) AS n_true, round(avg(f), 6) AS prevalence, round(sum(f * y) / sum(f), 6) AS rate_when_true, round(sum(f * y) / sum(f) / avg(y), 6) AS lift "
    f"FROM (SELECT {sql} AS f, CAST(l_returnflag = 'R' AS INT) AS y FROM lineitem)" for n, (_, sql) in _FLAGS.items()))
def signal_report(spark, d):
    li = table(spark, d, "lineitem").select((F.col("l_returnflag") == "R").cast("int").alias("y"), *[F.expr(e).alias(n) for n, (e, _) in _FLAGS.items()])
    return rounded(A.signal_report(li, list(_FLAGS), "y"), ["prevalence", "rate_when_true", "lift"])


@query(f"""
SELECT CASE WHEN n = 1 THEN '1' WHEN n <= 4 THEN '2-4' ELSE '5+' END AS bucket, count(*) AS identities, CAST(sum(n) AS BIGINT) AS n, round(sum(p) / sum(n), 6) AS rate
FROM (SELECT o_custkey, count(*) AS n, sum(label) AS p FROM ({LISTINGS_SQL}) GROUP BY 1) GROUP BY 1""")
def rate_by_connectivity(spark, d):
    return rounded(A.connectivity_report(listings(spark, d), "o_custkey", "label"), ["rate"])


_SHARED = "SELECT l_suppkey, count(DISTINCT l_orderkey) AS entities, max(CAST(l_returnflag = 'R' AS INT)) AS p FROM lineitem GROUP BY 1"


def _supplier_orders(spark, d):
    return table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", (F.col("l_returnflag") == "R").cast("int").alias("y"))


@query(f"""
SELECT count(*) AS identities, count(*) FILTER (entities >= 2) AS shared, count(*) FILTER (entities >= 2 AND p = 1) AS shared_with_positive,
 round(count(*) FILTER (entities >= 2 AND p = 1) / count(*) FILTER (entities >= 2), 6) AS positive_share, count(*) FILTER (entities >= 10) AS super_connectors, max(entities) AS largest
FROM ({_SHARED})""")
def shared_identity_report(spark, d):
    return rounded(A.shared_identity_report(_supplier_orders(spark, d), "l_suppkey", "l_orderkey", "y"), ["positive_share"])


@query(f"SELECT l_suppkey, entities, p AS any_positive FROM ({_SHARED}) ORDER BY entities DESC, l_suppkey LIMIT 10")
def largest_identities(spark, d):
    return A.largest_identities(_supplier_orders(spark, d), "l_suppkey", "l_orderkey", "y", 10)


@query(f"""
SELECT label, count(*) AS ids, round(avg(n), 6) AS mean_events, CAST(median(n) AS DOUBLE) AS median_events
FROM (SELECT o_custkey, count(*) AS n, max(label) AS label FROM ({LISTINGS_SQL}) GROUP BY 1) GROUP BY 1""")
def lifecycle_lengths(spark, d):
    return rounded(A.lifecycle_length(listings(spark, d), "o_custkey", "label"), ["mean_events"])


@query(f"""
SELECT label, count(*) AS ids, round(avg(n), 6) AS mean_events, CAST(median(n) AS DOUBLE) AS median_events
FROM (SELECT o_custkey, count(*) AS n, max(CASE WHEN o_custkey % 3 <> 0 THEN label END) AS label FROM ({LISTINGS_SQL}) GROUP BY 1) GROUP BY 1""")
def lifecycle_lengths_unlabelled(spark, d):
    """Ids without a label are a class of their own."""
    o = listings(spark, d).withColumn("label", F.when(F.col("o_custkey") % 3 != 0, F.col("label")))
    return rounded(A.lifecycle_length(o, "o_custkey", "label"), ["mean_events"])


@query(f"""
SELECT CASE WHEN h <= 24 THEN '<=24h' WHEN h <= 168 THEN '1-7d' WHEN h <= 672 THEN '1-4w' WHEN h <= 2160 THEN '1-3m' ELSE '3m+' END AS bucket,
 count(*) AS ids, round(avg(h), 6) AS mean_hours, round(max(h), 6) AS max_hours
FROM (SELECT user_id, (epoch_us(min(flag_ts)) - epoch_us(min(ts))) / 3.6e9 AS h FROM ({LIFECYCLE_SQL}) GROUP BY 1 HAVING min(flag_ts) IS NOT NULL) GROUP BY 1""")
def detection_delays(spark, d):
    return rounded(A.detection_delay(lifecycle(spark, d), "user_id", "ts", "flag_ts"), ["mean_hours", "max_hours"])


@query("""
SELECT l_linestatus, round(avg(v), 6) AS mean, round(stddev_pop(v), 6) AS std_pop, round(stddev_samp(v), 6) AS std_samp, round(min(v), 6) AS min, round(max(v), 6) AS max, round(max(v) - min(v), 6) AS range
FROM (SELECT l_linestatus, year(l_shipdate) AS yr, avg(l_discount) AS v FROM lineitem GROUP BY 1, 2) GROUP BY 1""")
def across_runs(spark, d):
    per_year = table(spark, d, "lineitem").groupBy("l_linestatus", F.year("l_shipdate").alias("yr")).agg(F.avg("l_discount").alias("v"))
    return rounded(A.across_runs(per_year, ["l_linestatus"], "v"), ["mean", "std_pop", "std_samp", "min", "max", "range"])


@query("""
SELECT user_id, max(value) FILTER (event_type = 'click') AS click, max(value) FILTER (event_type = 'view') AS view, max(value) FILTER (event_type = 'purchase') AS purchase
FROM events WHERE event_type IN ('click', 'view', 'purchase') GROUP BY 1""")
def runs_as_columns(spark, d):
    e = table(spark, d, "events").filter(F.col("event_type").isin("click", "view", "purchase"))
    return A.runs_wide(e, "user_id", "event_type", "value", ["click", "view", "purchase"], "purchase")


@query("""
WITH s AS (SELECT min(l_extendedprice) AS lo, max(l_extendedprice) AS hi FROM lineitem),
b AS (SELECT CAST(least(9, floor((l_extendedprice - lo) / (hi - lo) * 10)) AS INT) AS bin FROM lineitem, s)
SELECT CAST(g.bin AS INT) AS bin, round(lo + g.bin * (hi - lo) / 10, 6) AS lower, count(b.bin) AS n FROM range(10) g(bin), s LEFT JOIN b ON b.bin = g.bin GROUP BY 1, 2""")
def price_histogram(spark, d):
    return rounded(A.histogram(table(spark, d, "lineitem"), "l_extendedprice"), ["lower"])


@query("""
WITH i AS (SELECT p_name AS feature, sum(p_retailprice) AS importance FROM part GROUP BY 1), g AS (SELECT DISTINCT p_name AS feature, split_part(p_name, ' ', 1) AS feature_group FROM part)
SELECT feature_group, round(sum(importance), 4) AS importance, count(*) AS features, round(sum(importance) / (SELECT sum(importance) FROM i) * 100, 6) AS percent
FROM i JOIN g USING (feature) GROUP BY 1""")
def importance_by_group(spark, d):
    p = table(spark, d, "part")
    importance = p.groupBy(F.col("p_name").alias("feature")).agg(F.sum("p_retailprice").alias("importance"))
    groups = p.select(F.col("p_name").alias("feature"), F.split("p_name", " ")[0].alias("feature_group")).distinct()
    return rounded(rounded(A.importance_by_group(importance, groups), ["importance"], 4), ["percent"])


@query("""
SELECT membership, count(*) AS ids, round(avg(y), 6) AS rate FROM (
 SELECT l_orderkey, string_agg(DISTINCT l_returnflag, '+' ORDER BY l_returnflag) AS membership, max(CAST(l_linestatus = 'F' AS INT)) AS y FROM lineitem GROUP BY 1) GROUP BY 1""")
def rate_by_membership(spark, d):
    li = table(spark, d, "lineitem").select("l_orderkey", "l_returnflag", (F.col("l_linestatus") == "F").cast("int").alias("y"))
    return rounded(A.rate_by_membership(li, "l_orderkey", "l_returnflag", ["A", "R", "N"], "y"), ["rate"])


@query(f"SELECT grp, count(*) AS n, CAST(sum(label) AS BIGINT) AS positives, round(avg(label), 6) AS rate FROM ({PREDICTIONS_SQL}) GROUP BY 1")
def positive_rate_by_state(spark, d):
    return rounded(A.positive_rate(predictions(spark, d), ["grp"], "label"), ["rate"])

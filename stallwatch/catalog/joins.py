"""Correlation, propagation, membership, dictionaries, comparisons."""

from pyspark.sql import functions as F

from stallwatch.catalog import query
from stallwatch.catalog.tables import LIFECYCLE_SQL, LISTINGS_SQL, PREDICTIONS_SQL, lifecycle, listings, predictions, r, rounded, table
from stallwatch.functions.scalar import time_features, utc
from stallwatch.operators import joins as J
from stallwatch.operators.aggregates import cluster_sizes, union_all, with_cluster_size
from stallwatch.operators.ranking import entity_ids, only_one_side, related_ids, shared_ids
from stallwatch.operators.windows import first_per
from stallwatch.plans.skew import lookup


def _sides(spark, d):
    e = table(spark, d, "events")
    left = e.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    right = e.filter("event_type = 'purchase'").select("user_id", F.col("ts").alias("signal_ts"), F.col("event_id").alias("signal_id"))
    return left, right


def _asof(spark, d, strategy, tolerance=None):
    left, right = _sides(spark, d)
    out = J.asof_join(left, right, key="user_id", left_time="ts", right_time="signal_ts", right_id="signal_id", strategy=strategy, tolerance_seconds=tolerance)
    return out.select("event_id", "signal_id", r("asof_seconds", 3).alias("asof_seconds"))


_CLICKS = "l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'click'), s AS (SELECT user_id, ts AS sts, event_id AS sid FROM events WHERE event_type = 'purchase')"
_FWD = "f AS (SELECT l.event_id, l.ts, s.sid, s.sts FROM l ASOF LEFT JOIN s ON l.user_id = s.user_id AND l.ts <= s.sts)"
_BWD = "b AS (SELECT l.event_id, l.ts, s.sid, s.sts FROM l ASOF LEFT JOIN s ON l.user_id = s.user_id AND l.ts >= s.sts)"


def _asof_sql(sid, sts):
    return f"""WITH {_CLICKS}, {_FWD}, {_BWD}, m AS (SELECT event_id, f.ts, {sid} AS signal_id, {sts} AS sts FROM f JOIN b USING (event_id))
SELECT event_id, signal_id, round((epoch_us(sts) - epoch_us(ts)) / 1000000.0, 3)::DOUBLE AS asof_seconds FROM m"""


@query(_asof_sql("coalesce(f.sid, b.sid)", "coalesce(f.sts, b.sts)"))
def asof_forward_else_backward(spark, d):
    return _asof(spark, d, "forward_else_backward")


@query(_asof_sql("f.sid", "f.sts"))
def asof_forward(spark, d):
    return _asof(spark, d, "forward")


@query(_asof_sql("b.sid", "b.sts"))
def asof_backward(spark, d):
    return _asof(spark, d, "backward")


_NEAR_F = "(f.sid IS NOT NULL AND f.sts - f.ts <= INTERVAL 6 HOUR AND (b.sid IS NULL OR b.ts - b.sts > INTERVAL 6 HOUR OR f.sts - f.ts <= b.ts - b.sts))"
_NEAR_B = "(b.sid IS NOT NULL AND b.ts - b.sts <= INTERVAL 6 HOUR)"


@query(_asof_sql(f"CASE WHEN {_NEAR_F} THEN f.sid WHEN {_NEAR_B} THEN b.sid END", f"CASE WHEN {_NEAR_F} THEN f.sts WHEN {_NEAR_B} THEN b.sts END"))
def asof_nearest_within_6h(spark, d):
    return _asof(spark, d, "nearest", 6 * 3600)


@query(f"""WITH {_CLICKS}, {_FWD}, {_BWD}
SELECT count(*) AS total_events, count(coalesce(f.sid, b.sid)) AS matched_events, count(*) - count(coalesce(f.sid, b.sid)) AS unmatched_events
FROM f JOIN b USING (event_id)""")
def asof_match_stats(spark, d):
    left, right = _sides(spark, d)
    return J.match_stats(J.asof_join(left, right, key="user_id", left_time="ts", right_time="signal_ts", right_id="signal_id"), "signal_id")


@query("""
WITH usable AS (SELECT * FROM events WHERE event_type <> 'signup' AND ts <= TIMESTAMP '2024-01-25 00:00:00'),
firsts AS (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM usable),
l AS (SELECT event_id, user_id, ts FROM firsts WHERE rn = 1),
s AS (SELECT user_id, ts AS sts, event_id AS sid FROM events WHERE event_type = 'purchase'),
f AS (SELECT l.event_id, l.user_id, l.ts, s.sid FROM l ASOF LEFT JOIN s ON l.user_id = s.user_id AND l.ts <= s.sts),
b AS (SELECT l.event_id, s.sid FROM l ASOF LEFT JOIN s ON l.user_id = s.user_id AND l.ts >= s.sts),
flagged AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error' AND ts <= TIMESTAMP '2024-01-02 00:00:00'),
m AS (SELECT f.event_id, f.ts, coalesce(f.sid, b.sid) AS sid, CASE WHEN g.user_id IS NULL THEN 0 ELSE 1 END AS y
      FROM f JOIN b USING (event_id) LEFT JOIN flagged g ON f.user_id = g.user_id)
SELECT CAST(hour(ts) AS INT) AS event_hour, count(*) AS n, count(sid) AS matched, CAST(sum(y) AS BIGINT) AS positives, round(avg(y), 6) AS rate
FROM m GROUP BY 1""")
def flagged_rate_by_hour(spark, d):
    from datetime import datetime

    e = lifecycle(spark, d)
    usable = e.filter((F.col("event_type") != "signup") & (F.col("ts") <= utc(datetime(2024, 1, 25))))
    firsts = first_per(usable, ["user_id", "event_type"], "ts", "event_id").select("event_id", "user_id", "ts")
    _, signals = _sides(spark, d)
    matched = J.asof_join(firsts, signals, key="user_id", left_time="ts", right_time="signal_ts", right_id="signal_id")
    flags = e.filter(F.col("flag_ts") <= utc(datetime(2024, 1, 2))).select("user_id").distinct().withColumn("y", F.lit(1))
    labelled = lookup(matched, flags, ["user_id"], "left").withColumn("y", F.coalesce("y", F.lit(0)))
    hours = labelled.withColumn("event_hour", time_features("ts")["event_hour"])
    out = hours.groupBy("event_hour").agg(F.count(F.lit(1)).alias("n"), F.count("signal_id").alias("matched"), F.sum("y").alias("positives"), F.avg("y").alias("rate"))
    return rounded(out, ["rate"])


@query("""
SELECT o_orderkey, o_orderstatus, l_partkey, l_linestatus AS o_orderstatus_right, round(l_extendedprice, 2) AS l_extendedprice
FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey""")
def left_join_with_suffix(spark, d):
    right = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_partkey", "l_suppkey", F.col("l_linestatus").alias("o_orderstatus"), "l_extendedprice")
    left = table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    return rounded(J.left_join_suffixed(left, right, ["o_orderkey"], drop=["l_suppkey"]), ["l_extendedprice"], 2)


@query(f"SELECT e.event_id, e.user_id, min(flag_ts) OVER (PARTITION BY user_id) AS flag_ts FROM ({LIFECYCLE_SQL}) e")
def propagated_flag(spark, d):
    return J.propagate_flag(lifecycle(spark, d).select("event_id", "user_id", "flag_ts"), "user_id", "flag_ts")


@query(f"SELECT o_orderkey, CAST(max(label) OVER (PARTITION BY o_custkey) AS TINYINT) AS label FROM ({LISTINGS_SQL})")
def propagated_label(spark, d):
    return J.propagate_label(listings(spark, d).select("o_orderkey", "o_custkey", "label"), "o_custkey", "label").select("o_orderkey", "label")


_HALVES = "t AS (SELECT * FROM orders WHERE o_orderdate <= TIMESTAMP '1998-01-01'), s AS (SELECT * FROM orders WHERE o_orderdate > TIMESTAMP '1998-01-01')"


def _overlap_sql(train_where, test_where):
    return f"""WITH {_HALVES}
SELECT 'train' AS side, count(*) AS n, count(DISTINCT o_custkey) AS ids FROM t WHERE {train_where}
UNION ALL SELECT 'test', count(*), count(DISTINCT o_custkey) FROM s WHERE {test_where}"""


def _overlap(policy):
    def run(spark, d):
        from datetime import datetime

        o = table(spark, d, "orders").select("o_custkey", "o_orderdate")
        cut = utc(datetime(1998, 1, 1))
        sides = J.resolve_overlap(o.filter(F.col("o_orderdate") <= cut), o.filter(F.col("o_orderdate") > cut), "o_custkey", policy)
        counts = [x.agg(F.lit(n).alias("side"), F.count(F.lit(1)).alias("n"), F.count_distinct("o_custkey").alias("ids")) for n, x in zip(("train", "test"), sides)]
        return union_all(counts)

    return run


_IN_T, _IN_S = "o_custkey NOT IN (SELECT o_custkey FROM t)", "o_custkey NOT IN (SELECT o_custkey FROM s)"
query(_overlap_sql("true", "true"), "overlap_allow")(_overlap("allow"))
query(_overlap_sql("true", _IN_T), "overlap_train_priority")(_overlap("train_priority"))
query(_overlap_sql(_IN_S, "true"), "overlap_test_priority")(_overlap("test_priority"))
query(_overlap_sql(_IN_S, _IN_T), "overlap_remove_both")(_overlap("remove_both"))


@query("""
WITH d AS (SELECT p_brand, dense_rank() OVER (ORDER BY p_brand) - 1 AS code FROM part WHERE p_size <= 25 GROUP BY p_brand),
t AS (SELECT p_type, dense_rank() OVER (ORDER BY p_type) - 1 AS code FROM part WHERE p_size <= 25 GROUP BY p_type)
SELECT p_partkey, CAST(d.code AS DOUBLE) AS p_brand, CAST(t.code AS DOUBLE) AS p_type FROM part LEFT JOIN d USING (p_brand) LEFT JOIN t USING (p_type)""")
def encoded_categories(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_brand", "p_type", "p_size")
    dictionary = J.category_dictionary(p.filter("p_size <= 25"), ["p_brand", "p_type"])
    return J.encode_categories(p.drop("p_size"), dictionary, ["p_brand", "p_type"])


@query("""
WITH c AS (SELECT l_suppkey, count(*) AS cluster_size FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1)
SELECT cluster_size, count(*) AS n FROM lineitem LEFT JOIN c USING (l_suppkey) WHERE l_linestatus = 'O' GROUP BY 1""")
def fitted_cluster_sizes(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_linestatus")
    sizes = cluster_sizes(li.filter("l_linestatus = 'F'"), "l_suppkey")
    joined = with_cluster_size(li.filter("l_linestatus = 'O'"), sizes, "l_suppkey")
    return joined.groupBy("cluster_size").agg(F.count(F.lit(1)).alias("n"))


@query("""
SELECT e.event_id, round(coalesce(v.embedding[1], 0)::DOUBLE, 6) AS first_value, CAST(64 AS INT) AS size
FROM events e LEFT JOIN embeddings v ON e.user_id * 2 = v.vec_id""")
def vectors_on_rows(spark, d):
    v = table(spark, d, "embeddings").select(F.col("vec_id").alias("node"), "embedding")
    e = table(spark, d, "events").select("event_id", (F.col("user_id") * 2).alias("node"))
    return J.attach_vectors(e, v, "node", "embedding", 64).select("event_id", r(F.col("embedding")[0]).alias("first_value"), F.size("embedding").alias("size"))


@query("""
WITH latest AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events),
q AS (SELECT user_id, min(ts) AS queued_at FROM events WHERE event_type = 'click' GROUP BY 1)
SELECT q.user_id, q.queued_at, l.event_id, l.event_type FROM q LEFT JOIN latest l ON q.user_id = l.user_id AND rn = 1""")
def queue_with_latest_event(spark, d):
    e = table(spark, d, "events")
    queue = e.filter("event_type = 'click'").groupBy("user_id").agg(F.min("ts").alias("queued_at"))
    latest = J.latest_per_key(e.select("user_id", "event_id", "event_type", "ts"), "user_id", [F.desc("ts"), F.desc("event_id")])
    return queue.join(latest.drop("ts"), "user_id", "left")


@query(f"""
WITH p AS ({PREDICTIONS_SQL}) SELECT count(*) FILTER (label = 1 AND score >= 0.5 AND score2 < 0.5) AS only_a, count(*) FILTER (label = 1 AND score < 0.5 AND score2 >= 0.5) AS only_b,
 count(*) FILTER (label = 1 AND score >= 0.5 AND score2 >= 0.5) AS both, count(*) FILTER (label = 1 AND score < 0.5 AND score2 < 0.5) AS neither
FROM (SELECT row_id, any_value(label) AS label, max(score) AS score, max(score2) AS score2 FROM p GROUP BY 1 HAVING count(*) = 1)""")
def detection_difference(spark, d):
    p = predictions(spark, d)
    single = p.groupBy("row_id").agg(F.count(F.lit(1)).alias("c")).filter("c = 1").select("row_id")
    p = p.join(single, "row_id", "left_semi")
    return J.detection_difference(p.select("row_id", "label", "score"), p.select("row_id", F.col("score2").alias("score")), "row_id", "label", "score", 0.5)


@query(f"""
WITH n AS (SELECT DISTINCT CAST(user_id AS BIGINT) AS user_id FROM events UNION SELECT vec_id FROM embeddings)
SELECT n.user_id, max(label) AS label, max(label) IS NOT NULL AS is_labelled FROM n LEFT JOIN ({LIFECYCLE_SQL}) e ON n.user_id = e.user_id GROUP BY 1""")
def labelled_nodes(spark, d):
    e = lifecycle(spark, d)
    nodes = e.select("user_id").union(table(spark, d, "embeddings").select("vec_id")).distinct()
    return J.node_labels(nodes, e, "user_id", "label")


@query("""
WITH t AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate <= TIMESTAMP '1995-03-01'), s AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate > TIMESTAMP '2001-06-01')
SELECT o_custkey FROM t INTERSECT SELECT o_custkey FROM s""")
def shared_customers(spark, d):
    o = table(spark, d, "orders")
    return shared_ids(o.filter("o_orderdate <= timestamp_ntz'1995-03-01'"), o.filter("o_orderdate > timestamp_ntz'2001-06-01'"), "o_custkey")


@query("SELECT DISTINCT CAST(id AS VARCHAR) AS entity_id FROM (SELECT l_suppkey AS id FROM lineitem UNION ALL SELECT l_partkey FROM lineitem)")
def entity_ids_over_columns(spark, d):
    return entity_ids(table(spark, d, "lineitem"), ["l_suppkey", "l_partkey"])


@query("""
SELECT event_id, user_id, CAST(NULL AS VARCHAR) AS source FROM events UNION ALL SELECT doc_id, NULL, source FROM documents""")
def union_with_new_columns(spark, d):
    return union_all([table(spark, d, "events").select("event_id", "user_id"), table(spark, d, "documents").select(F.col("doc_id").alias("event_id"), "source")])


@query(f"""
WITH p AS ({PREDICTIONS_SQL}), a AS (SELECT DISTINCT row_id FROM p WHERE score >= 0.9), b AS (SELECT DISTINCT row_id FROM p WHERE score2 >= 0.9)
SELECT row_id, 'a' AS side FROM (SELECT * FROM a EXCEPT SELECT * FROM b) UNION ALL SELECT row_id, 'b' FROM (SELECT * FROM b EXCEPT SELECT * FROM a)""")
def seen_by_one_model(spark, d):
    p = predictions(spark, d)
    return only_one_side(p.filter("score >= 0.9"), p.filter("score2 >= 0.9"), "row_id")


@query(f"""
WITH m AS (SELECT k, user_id, min(ts) AS t FROM ({LIFECYCLE_SQL}) GROUP BY 1, 2),
r AS (SELECT k, user_id AS related, row_number() OVER (PARTITION BY k ORDER BY t, user_id) AS rn FROM m)
SELECT m.k, m.user_id, r.related FROM m JOIN r ON m.k = r.k AND rn <= 10 WHERE r.related <> m.user_id""")
def related_by_identity(spark, d):
    return related_ids(lifecycle(spark, d), "k", "user_id", "ts", 10)


@query("""
SELECT c_custkey, o_orderkey, o_totalprice FROM customer JOIN orders ON c_custkey = o_custkey""")
def columns_side_by_side(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", "o_totalprice")
    return o.join(table(spark, d, "customer").select("c_custkey"), "c_custkey")

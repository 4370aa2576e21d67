"""First events, normalised time, ranks, top-k, point-in-time history."""

from pyspark.sql import functions as F

from stallwatch.catalog import query
from stallwatch.catalog.tables import LIFECYCLE_SQL, PREDICTIONS_SQL, lifecycle, predictions, r, rounded, table
from stallwatch.operators import ranking as K
from stallwatch.operators import windows as W
from stallwatch.operators.explain import linear_contributions
from stallwatch.plans.ordered import exact_quantiles, micros, numbered


@query("SELECT event_id, user_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def first_event_per_status(spark, d):
    return W.first_per(table(spark, d, "events"), ["user_id", "event_type"], "ts", "event_id").select("event_id", "user_id", "event_type")


@query("SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def first_event_per_id(spark, d):
    return W.first_per(table(spark, d, "events"), ["user_id"], "ts", "event_id").select("event_id", "user_id")


@query("SELECT user_id, min(ts) AS first_time FROM events GROUP BY 1")
def first_times(spark, d):
    return W.first_time(table(spark, d, "events"), "user_id", "ts")


@query("""
WITH p AS (SELECT user_id, min(ts) AS t, count(*) AS n FROM events GROUP BY 1), s AS (SELECT min(epoch_us(t)) AS lo, max(epoch_us(t)) AS hi FROM p)
SELECT user_id, round((epoch_us(t) - lo) / (hi - lo), 6) AS days_since_start, round((epoch_us(t) - lo) / (hi - lo), 6) AS relative_position,
 round(sin(2 * pi() * hour(t) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(t) / 24), 6) AS hour_cos,
 round(sin(2 * pi() * (isodow(t) - 1) / 7), 6) AS weekday_sin, round(cos(2 * pi() * (isodow(t) - 1) / 7), 6) AS weekday_cos,
 round(1 - (epoch_us(t) - lo) / (hi - lo), 6) AS recency, round(ln(1 + n), 6) AS log_event_count
FROM p, s""")
def node_time_encodings(spark, d):
    per = table(spark, d, "events").groupBy("user_id").agg(F.min("ts").alias("t"), F.count(F.lit(1)).alias("n"))
    parts = W.time_encodings(per, "t", "n")
    return per.select("user_id", *[r(v).alias(k) for k, v in parts.items()])


@query("SELECT o_orderkey, o_totalprice, max(o_totalprice) OVER (ORDER BY o_orderkey) AS best_so_far FROM orders")
def running_best(spark, d):
    return W.running_best(table(spark, d, "orders").select("o_orderkey", "o_totalprice"), "o_orderkey", "o_totalprice")


@query("""
SELECT feature, round(importance, 4) AS importance, CAST(row_number() OVER (ORDER BY importance DESC, feature) AS INT) AS rank
FROM (SELECT p_name AS feature, CAST(sum(p_size) AS DOUBLE) AS importance FROM part GROUP BY 1)""")
def importance_ranks(spark, d):
    imp = table(spark, d, "part").groupBy(F.col("p_name").alias("feature")).agg(F.sum("p_size").cast("double").alias("importance"))
    return rounded(W.importance_ranks(imp), ["importance"], 4)


def _history_sql(events):
    return f"""
WITH e AS ({events}), p AS (SELECT k, user_id, min(ts) AS seen, min(flag_ts) AS flag FROM e WHERE k IS NOT NULL GROUP BY 1, 2),
g AS (SELECT *, CASE WHEN flag IS NOT NULL THEN greatest(seen, flag) END AS known FROM p), starts AS (SELECT k, min(seen) AS start FROM p GROUP BY 1)
SELECT e.event_id, e.user_id, count(*) FILTER (g.seen < e.ts AND g.user_id <> e.user_id) AS prior_entities,
 count(*) FILTER (g.known < e.ts AND g.user_id <> e.user_id) AS prior_flagged,
 round(count(*) FILTER (g.known < e.ts AND g.user_id <> e.user_id) / nullif(count(*) FILTER (g.seen < e.ts AND g.user_id <> e.user_id), 0), 6) AS prior_flagged_rate,
 round((epoch_us(e.ts) - epoch_us(any_value(start))) / 8.64e10, 6) AS days_since_first_seen
FROM e JOIN g ON e.k = g.k JOIN starts s ON e.k = s.k GROUP BY e.event_id, e.user_id, e.ts"""


@query(_history_sql(LIFECYCLE_SQL))
def identity_history(spark, d):
    e = lifecycle(spark, d).select("event_id", "user_id", "ts", "k", "flag_ts")
    out = W.identity_history(e, identity="k", entity="user_id", time="ts", flag="flag_ts")
    return rounded(out.drop("ts", "k", "flag_ts"), ["prior_flagged_rate", "days_since_first_seen"])


@query(_history_sql(f"SELECT * REPLACE (CASE WHEN event_id % 7 <> 0 THEN ts END AS ts) FROM ({LIFECYCLE_SQL})"))
def identity_history_with_gaps(spark, d):
    """Events without a time have no past and belong to nobody's; each keeps its row."""
    e = lifecycle(spark, d).select("event_id", "user_id", F.when(F.col("event_id") % 7 != 0, F.col("ts")).alias("ts"), "k", "flag_ts")
    out = W.identity_history(e, identity="k", entity="user_id", time="ts", flag="flag_ts")
    return rounded(out.drop("ts", "k", "flag_ts"), ["prior_flagged_rate", "days_since_first_seen"])


@query("""SELECT o_orderkey, o_totalprice, CASE WHEN o_orderkey IS NOT NULL THEN max(o_totalprice) FILTER (o_orderkey IS NOT NULL) OVER (PARTITION BY o_orderstatus ORDER BY o_orderkey) END AS best_so_far
FROM (SELECT CASE WHEN o_orderkey % 5 <> 0 THEN o_orderkey END AS o_orderkey, o_totalprice, nullif(o_orderstatus, 'P') AS o_orderstatus FROM orders)""")
def running_best_with_gaps(spark, d):
    """Rows without a place in the order keep their row and get no best; a null group is a group."""
    o = table(spark, d, "orders").select(F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderkey")).alias("o_orderkey"), "o_totalprice", F.nullif(F.col("o_orderstatus"), F.lit("P")).alias("o_orderstatus"))
    return W.running_best(o, "o_orderkey", "o_totalprice", ["o_orderstatus"]).drop("o_orderstatus")


@query(f"""
WITH p AS ({PREDICTIONS_SQL}), t AS (SELECT count(*) AS n, sum(label) AS pos FROM p), o AS (SELECT label, row_number() OVER (ORDER BY score DESC, row_id) AS rn FROM p)
SELECT CAST(v.k AS INT) AS k, round(sum(label) FILTER (rn <= v.k) / v.k, 6) AS precision, round(sum(label) FILTER (rn <= v.k) / any_value(pos), 6) AS recall,
 round(sum(label) FILTER (rn <= v.k) / v.k / (any_value(pos) / any_value(n)), 6) AS lift
FROM o, t, (VALUES (50), (100), (200)) v(k) WHERE rn <= 200 GROUP BY v.k""")
def precision_at_k(spark, d):
    return rounded(K.precision_at_k(predictions(spark, d), "label", "score", "row_id"), ["precision", "recall", "lift"])


@query(f"SELECT row_id, score FROM ({PREDICTIONS_SQL}) WHERE score >= 0.7 ORDER BY score DESC, row_id LIMIT 25")
def top_above_threshold(spark, d):
    return K.top_above(predictions(spark, d).select("row_id", "score"), "score", "row_id", 25, 0.7)


@query("SELECT event_id, event_type FROM (SELECT * FROM events ORDER BY ts DESC, event_id DESC LIMIT 200) WHERE event_type = 'purchase'")
def recent_of_bucket(spark, d):
    return K.recent_then_filter(table(spark, d, "events").select("event_id", "event_type", "ts"), "ts", "event_id", 200, "event_type", "purchase").drop("ts")


@query("SELECT event_id, ts, (SELECT min(ts) FROM events WHERE event_type = 'click') AS oldest_queued_at FROM events WHERE event_type = 'click' ORDER BY ts, event_id LIMIT 100")
def queue_view(spark, d):
    return K.queue_view(table(spark, d, "events").filter("event_type = 'click'").select("event_id", "ts"), "ts", "event_id", 100)


_LINEAR = {"p_size": 0.3, "p_retailprice": -0.02}
_LINEAR_SQL = """SELECT p_partkey, 'p_size' AS feature, CAST(p_size AS DOUBLE) AS value, 0.3 * (p_size - (SELECT avg(p_size) FROM part)) AS contribution FROM part
UNION ALL SELECT p_partkey, 'p_retailprice', p_retailprice, -0.02 * (p_retailprice - (SELECT avg(p_retailprice) FROM part)) FROM part"""


@query(f"SELECT p_partkey, feature, value, round(contribution, 6) AS contribution FROM ({_LINEAR_SQL})")
def linear_contributions_of_parts(spark, d):
    return rounded(linear_contributions(table(spark, d, "part"), "p_partkey", _LINEAR), ["contribution"])


@query(f"""
SELECT p_partkey, contribution > 0 AS raises, CAST(row_number() OVER (PARTITION BY p_partkey, contribution > 0 ORDER BY abs(contribution) DESC, feature) AS INT) AS position, feature
FROM ({_LINEAR_SQL}) WHERE contribution <> 0""")
def top_contributions(spark, d):
    long = linear_contributions(table(spark, d, "part"), "p_partkey", _LINEAR)
    return K.top_contributions(long, "p_partkey", 5).select("p_partkey", "raises", "position", "feature")


@query("SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) AS position FROM orders")
def row_positions(spark, d):
    return numbered(table(spark, d, "orders").select("o_orderkey", "o_orderdate"), [], micros("o_orderdate"), ["o_orderkey"], "position").drop("o_orderdate")


@query("SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.25), 6) AS q25, round(median(l_extendedprice), 6) AS q50, round(quantile_cont(l_extendedprice, 0.9), 6) AS q90 FROM lineitem GROUP BY 1")
def exact_quantiles_by_group(spark, d):
    return rounded(exact_quantiles(table(spark, d, "lineitem"), ["l_returnflag"], "l_extendedprice", {"q25": 0.25, "q50": 0.5, "q90": 0.9}), ["q25", "q50", "q90"])

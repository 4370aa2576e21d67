"""Point-in-time labels and temporal splits."""

from datetime import datetime

from pyspark.sql import functions as F

from stallwatch.catalog import query
from stallwatch.catalog.tables import LIFECYCLE_SQL, lifecycle, table
from stallwatch.operators import labels as L
from stallwatch.operators.aggregates import union_all

COLUMNS = L.SplitColumns(key="user_id", time="ts", flag="flag_ts", tie="event_id", label="is_fraud")
SPLIT = L.Split(datetime(2024, 1, 10), datetime(2024, 1, 25), 7)
_T, _S = "ts <= TIMESTAMP '2024-01-10'", "ts > TIMESTAMP '2024-01-17' AND ts <= TIMESTAMP '2024-01-25'"


def _both(parts):
    return union_all([p.select(F.lit(side).alias("side"), "event_id", "is_fraud") for side, p in zip(("train", "test"), parts)])


@query(f"""
WITH e AS ({LIFECYCLE_SQL})
SELECT 'train' AS side, event_id, CAST(coalesce(max(CAST(flag_ts <= TIMESTAMP '2024-01-10' AS INT)) OVER (PARTITION BY user_id), 0) AS TINYINT) AS is_fraud FROM e WHERE {_T}
UNION ALL SELECT 'test', event_id, CAST(coalesce(max(CAST(flag_ts <= TIMESTAMP '2024-01-25' AS INT)) OVER (PARTITION BY user_id), 0) AS TINYINT) FROM e WHERE {_S}""")
def temporal_split(spark, d):
    train, test = L.temporal_split(lifecycle(spark, d), COLUMNS, SPLIT)
    return _both((train, test))


@query(f"""
WITH e AS ({LIFECYCLE_SQL}) SELECT 'train' AS side, count(*) AS n, max(ts) AS edge FROM e WHERE {_T} UNION ALL SELECT 'test', count(*), min(ts) FROM e WHERE {_S}""")
def checked_split(spark, d):
    """A clean split passes the check that its plan carries, and its edges show why."""
    train, test = L.temporal_split(lifecycle(spark, d), COLUMNS, SPLIT)
    return train.agg(F.lit("train").alias("side"), F.count(F.lit(1)).alias("n"), F.max("ts").alias("edge")).unionByName(test.agg(F.lit("test").alias("side"), F.count(F.lit(1)).alias("n"), F.min("ts").alias("edge")))


@query(f"""
WITH e AS ({LIFECYCLE_SQL}), a AS (SELECT * FROM e WHERE ts <= TIMESTAMP '2024-01-02'), b AS (SELECT * FROM e WHERE {_S} AND user_id NOT IN (SELECT user_id FROM a))
SELECT 'train' AS side, event_id, CAST(coalesce(max(CAST(flag_ts <= TIMESTAMP '2024-01-02' AS INT)) OVER (PARTITION BY user_id), 0) AS TINYINT) AS is_fraud FROM a
UNION ALL SELECT 'test', event_id, CAST(coalesce(max(CAST(flag_ts <= TIMESTAMP '2024-01-25' AS INT)) OVER (PARTITION BY user_id), 0) AS TINYINT) FROM b""")
def temporal_split_without_shared_ids(spark, d):
    split = L.Split(datetime(2024, 1, 2), datetime(2024, 1, 25), 15)
    return _both(L.temporal_split(lifecycle(spark, d), COLUMNS, split, overlap="train_priority"))


def _mode(mode):
    def run(spark, d):
        return L.label_rows(lifecycle(spark, d), COLUMNS, datetime(2024, 1, 2, 12), mode).select("event_id", "is_fraud")

    return run


_CUT = "TIMESTAMP '2024-01-02 12:00:00'"
query(f"SELECT event_id, CAST(coalesce(max(CAST(flag_ts <= {_CUT} AS INT)) OVER (PARTITION BY user_id), 0) AS TINYINT) AS is_fraud FROM ({LIFECYCLE_SQL})", "labels_point_in_time")(_mode(L.LabelMode.POINT_IN_TIME))
query(f"SELECT event_id, CAST(max(CAST(flag_ts IS NOT NULL AS INT)) OVER (PARTITION BY user_id) AS TINYINT) AS is_fraud FROM ({LIFECYCLE_SQL})", "labels_entity")(_mode(L.LabelMode.ENTITY))
query(f"SELECT event_id, CAST(coalesce(flag_ts <= {_CUT}, false) AS TINYINT) AS is_fraud FROM ({LIFECYCLE_SQL})", "labels_event")(_mode(L.LabelMode.EVENT))
query(f"""
SELECT event_id, is_fraud FROM (SELECT event_id, CAST(coalesce(max(CAST(flag_ts <= {_CUT} AS INT)) OVER (PARTITION BY user_id), 0) AS TINYINT) AS is_fraud,
 row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS rn FROM ({LIFECYCLE_SQL})) WHERE rn = 1""", "labels_first_event")(_mode(L.LabelMode.FIRST_EVENT))


@query(f"""
SELECT count(*) AS total_ids, count(f) AS flagged_ids, count(*) FILTER (f <= {_CUT}) AS known_ids, count(*) FILTER (f > {_CUT}) AS future_ids
FROM (SELECT user_id, min(flag_ts) AS f FROM ({LIFECYCLE_SQL}) GROUP BY 1)""")
def label_statistics(spark, d):
    return L.label_statistics(lifecycle(spark, d), COLUMNS, datetime(2024, 1, 2, 12))


def _fold_sql(bounds):
    parts = []
    for fold, train_start, train_end, test_start, test_end in bounds:
        begin = f"ts > TIMESTAMP '{train_start}' AND " if train_start else ""
        for role, where, cut in (("train", f"{begin}ts <= TIMESTAMP '{train_end}'", train_end), ("test", f"ts > TIMESTAMP '{test_start}' AND ts <= TIMESTAMP '{test_end}'", test_end)):
            parts.append(
                f"SELECT CAST({fold} AS INT) AS fold, '{role}' AS role, event_id, CAST(coalesce(max(CAST(flag_ts <= TIMESTAMP '{cut}' AS INT)) OVER (PARTITION BY user_id), 0) AS TINYINT) AS is_fraud FROM e WHERE {where}"
            )
    return f"WITH e AS ({LIFECYCLE_SQL})\n" + "\nUNION ALL ".join(parts)


@query(_fold_sql([
    (1, None, "2024-01-11", "2024-01-13", "2024-01-18"), (2, None, "2024-01-16", "2024-01-18", "2024-01-23"),
    (3, None, "2024-01-21", "2024-01-23", "2024-01-28"), (4, None, "2024-01-26", "2024-01-28", "2024-02-02")]))
def expanding_windows(spark, d):
    folds = L.expanding_folds(datetime(2024, 1, 1), datetime(2024, 1, 31), window_days=5, gap_days=2, min_windows=2)
    return L.assign_folds(lifecycle(spark, d), COLUMNS, folds).select("fold", "role", "event_id", "is_fraud")


@query(_fold_sql([
    (1, "2024-01-01", "2024-01-11", "2024-01-12", "2024-01-17"), (2, "2024-01-06", "2024-01-16", "2024-01-17", "2024-01-22"),
    (3, "2024-01-11", "2024-01-21", "2024-01-22", "2024-01-27"), (4, "2024-01-16", "2024-01-26", "2024-01-27", "2024-02-01")]))
def sliding_windows(spark, d):
    folds = L.sliding_folds(datetime(2024, 1, 1), datetime(2024, 1, 31), train_days=10, advance_days=5, gap_days=1)
    return L.assign_folds(lifecycle(spark, d), COLUMNS, folds).select("fold", "role", "event_id", "is_fraud")


@query("""
WITH o AS (SELECT o_orderkey, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS i, count(*) OVER () AS n FROM orders),
z AS (SELECT o_orderkey, i, n, n // 6 AS sz, CAST(floor(7 * (n // 6) / 30) AS BIGINT) AS gap FROM o)
SELECT CAST(k AS INT) AS fold, 'train' AS role, o_orderkey FROM z, range(1, 6) g(k) WHERE i < sz * k
UNION ALL SELECT CAST(k AS INT), 'test', o_orderkey FROM z, range(1, 6) g(k) WHERE i >= sz * k + gap AND i < least(sz * k + gap + sz, n)""")
def row_fraction_folds(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    return L.row_fraction_folds(o, "o_orderdate", "o_orderkey").select("fold", "role", "o_orderkey")


@query(f"""
WITH e AS ({LIFECYCLE_SQL})
SELECT 1 AS period, count(*) FILTER (ts <= TIMESTAMP '2024-01-05') AS train, count(*) FILTER (ts > TIMESTAMP '2024-01-06' AND ts <= TIMESTAMP '2024-01-10') AS test FROM e
UNION ALL SELECT 2, count(*) FILTER (ts <= TIMESTAMP '2024-01-12'), count(*) FILTER (ts > TIMESTAMP '2024-01-13' AND ts <= TIMESTAMP '2024-01-17') FROM e
UNION ALL SELECT 3, count(*) FILTER (ts <= TIMESTAMP '2024-01-19'), count(*) FILTER (ts > TIMESTAMP '2024-01-20' AND ts <= TIMESTAMP '2024-01-24') FROM e""")
def fixed_periods(spark, d):
    e, out = lifecycle(spark, d), []
    for period, (end, test_end) in enumerate([(5, 10), (12, 17), (19, 24)], start=1):
        train, test = L.temporal_split(e, COLUMNS, L.Split(datetime(2024, 1, end), datetime(2024, 1, test_end), 1))
        n_train, n_test = train.agg(F.count(F.lit(1)).alias("n")), test.agg(F.count(F.lit(1)).alias("n"))
        out.append(n_train.select(F.lit(period).alias("period"), F.col("n").alias("train"), n_test.scalar().alias("test")))
    return union_all(out)

"""The standard tables in the roles the operators expect, in Spark and as SQL fragments that say the same."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwatch.sources.feeds import read_table


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return read_table(spark, folder, name)


def r(column: Column | str, places: int = 6) -> Column:
    return F.round(F.col(column) if isinstance(column, str) else column, places)


def rounded(df: DataFrame, columns: list[str], places: int = 6) -> DataFrame:
    return df.withColumns({c: r(c, places) for c in columns})


# lineitem as scored rows: the price share is the score, a returned line is a positive.
PREDICTIONS_SQL = """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey) AS row_id,
       CAST(l_returnflag = 'R' AS INT) AS label, l_extendedprice / 105000.0 AS score, l_quantity / 51.0 AS score2,
       l_linestatus AS grp, CAST(year(l_shipdate) AS INT) AS yr, l_suppkey, l_shipdate
FROM lineitem
"""


def predictions(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "lineitem").select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("row_id"),
        (F.col("l_returnflag") == "R").cast("int").alias("label"),
        (F.col("l_extendedprice") / 105000.0).alias("score"),
        (F.col("l_quantity") / 51.0).alias("score2"),
        F.col("l_linestatus").alias("grp"),
        F.year("l_shipdate").alias("yr"),
        "l_suppkey",
        "l_shipdate",
    )


# events as lifecycle rows: the user is the listing, an error is the flag, props.k is a shared identity.
LIFECYCLE_SQL = """
SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k,
       CASE WHEN event_type = 'error' THEN ts END AS flag_ts, CAST(event_type = 'error' AS INT) AS label
FROM events
"""


def lifecycle(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "events").select(
        "event_id", "ts", "user_id", "event_type", "value",
        F.get_json_object("props", "$.k").cast("long").alias("k"),
        F.when(F.col("event_type") == "error", F.col("ts")).alias("flag_ts"),
        (F.col("event_type") == "error").cast("int").alias("label"),
    )


# orders as listings of a customer: an urgent order is a positive.
LISTINGS_SQL = """
SELECT o_orderkey, o_custkey, o_orderdate, o_totalprice, o_orderstatus,
       CAST(o_orderpriority = '1-URGENT' AS INT) AS label
FROM orders
"""


def listings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "orders").select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "o_orderstatus",
        (F.col("o_orderpriority") == "1-URGENT").cast("int").alias("label"),
    )

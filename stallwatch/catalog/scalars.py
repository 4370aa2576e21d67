"""Filters, parsing and scalar expressions."""

from pyspark.sql import functions as F

from stallwatch.catalog import query
from stallwatch.catalog.tables import lifecycle, predictions, r, table
from stallwatch.functions import scalar as S
from stallwatch.operators.aggregates import drop_all_null
from stallwatch.operators.features import conform
from stallwatch.registry import Registry, Role, Variant, project_variant


@query("""
SELECT page_id, nullif(regexp_extract('Listings#' || page_id || '##', '#(.+?)##', 1), '') AS reference_id,
       nullif(regexp_extract(url, '/([a-z][a-z])/([0-9]+)', 2), '') AS section_id,
       nullif(regexp_extract(url, '#(.+?)##', 1), '') AS absent_id
FROM pages""")
def extracted_ids(spark, d):
    return table(spark, d, "pages").select(
        "page_id",
        S.extract_id(F.concat(F.lit("Listings#"), "page_id", F.lit("##"))).alias("reference_id"),
        S.extract_id("url", "/([a-z][a-z])/([0-9]+)", 2).alias("section_id"),
        S.extract_id("url").alias("absent_id"),
    )


@query("""
SELECT event_id, epoch_us(ts) - 3600000000 AS offset_us, (epoch_us(ts) // 1000) * 1000 AS iso_us, epoch_us(ts) AS naive_us,
       CAST(NULL AS BIGINT) AS bad_us, epoch_us(ts) AS cast_us
FROM events""")
def parsed_times(spark, d):
    e = table(spark, d, "events")
    base = F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS")

    def us(c):
        return F.unix_micros(c.cast("timestamp"))

    iso = F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+0000"))
    return e.select(
        "event_id",
        us(S.parse_time(F.concat(base, F.lit(" +0100")))).alias("offset_us"),
        us(S.parse_time(iso, S.SIGNAL_TIME_FORMAT)).alias("iso_us"),
        us(S.parse_time(base, S.FLAG_TIME_FORMAT)).alias("naive_us"),
        us(S.parse_time(F.concat(F.lit("on "), base))).alias("bad_us"),
        us(S.try_cast(base, "timestamp")).alias("cast_us"),
    )


@query("SELECT event_id, user_id, event_type FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL AND event_type NOT IN ('view', 'signup')")
def usable_statuses(spark, d):
    e = table(spark, d, "events")
    usable = F.col("event_type").isNotNull() & F.col("ts").isNotNull() & ~F.col("event_type").isin("view", "signup")
    return e.filter(usable).select("event_id", "user_id", "event_type")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'purchase')")
def scoring_statuses(spark, d):
    return table(spark, d, "events").filter(F.col("event_type").isin("click", "purchase")).select("event_id", "event_type")


@query("SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) IN ('household', 'machinery')")
def allowed_segments(spark, d):
    return table(spark, d, "customer").filter(S.lower_in("c_mktsegment", ["Household", "machinery"])).select("c_custkey", "c_mktsegment")


@query("SELECT event_id FROM events WHERE ts > TIMESTAMP '2024-01-08 00:00:00' AND ts <= TIMESTAMP '2024-01-15 00:00:00'")
def time_range(spark, d):
    from datetime import datetime

    ts = F.col("ts")
    inside = (ts > S.utc(datetime(2024, 1, 8))) & (ts <= S.utc(datetime(2024, 1, 15)))
    return table(spark, d, "events").filter(inside).select("event_id")


@query("""
SELECT p_partkey, coalesce(try_cast(p_type AS DOUBLE), p_retailprice) AS price, CAST(NULL AS DOUBLE) AS area,
       try_cast(p_name AS DOUBLE) AS bad_number FROM part""")
def first_known_price(spark, d):
    p = table(spark, d, "part")
    return p.select(
        "p_partkey",
        S.first_number(p, ["p_type", "p_retailprice"]).alias("price"),
        S.first_number(p, ["no_such_column"]).alias("area"),
        S.try_cast("p_name", "double").alias("bad_number"),
    )


@query("""
SELECT event_id, CAST(hour(ts) AS INT) AS event_hour, CAST(isodow(ts) - 1 AS INT) AS event_weekday,
       CAST(isodow(ts) >= 6 AS TINYINT) AS event_is_weekend,
       CAST(isodow(ts) <= 5 AND hour(ts) >= 9 AND hour(ts) < 17 AS TINYINT) AS event_is_business_hours,
       round(sin(2 * pi() * hour(ts) / 24), 6) AS hour_sin, round(cos(2 * pi() * hour(ts) / 24), 6) AS hour_cos,
       round(sin(2 * pi() * (isodow(ts) - 1) / 7), 6) AS weekday_sin, round(cos(2 * pi() * (isodow(ts) - 1) / 7), 6) AS weekday_cos,
       round(ln(1 + CAST(json_extract(props, '$.k') AS DOUBLE)), 6) AS log_count
FROM events""")
def time_features(spark, d):
    e = lifecycle(spark, d)
    parts = S.time_features("ts")
    hs, hc = S.cyclical(F.hour("ts"), 24)
    ws, wc = S.cyclical(F.weekday("ts"), 7)
    return e.select(
        "event_id", *[v.alias(k) for k, v in parts.items()],
        r(hs).alias("hour_sin"), r(hc).alias("hour_cos"), r(ws).alias("weekday_sin"), r(wc).alias("weekday_cos"),
        r(S.log_count("k")).alias("log_count"),
    )


@query("""
SELECT event_id, CASE WHEN event_type IN ('click', 'view') THEN CAST(value > 50 AS TINYINT) END AS bit,
       CAST(event_type = 'error' AS TINYINT) AS is_flagged,
       CAST(value > 50 AS INT) + CAST(event_type = 'click' AS INT) AS flags, (value > 50 OR event_type = 'click') AS any_flag,
       greatest(1, least(100, coalesce(value, 1.0))) AS clipped
FROM events""")
def flags_and_labels(spark, d):
    e = lifecycle(spark, d).withColumns(
        {"high": F.col("value") > 50, "clicked": F.col("event_type") == "click"}
    )
    return e.select(
        "event_id",
        S.flag_bit(F.when(F.col("event_type").isin("click", "view"), F.col("high"))).alias("bit"),
        S.flagged_label("flag_ts").alias("is_flagged"),
        S.sum_of_flags(["high", "clicked"]).alias("flags"),
        S.any_flag(["high", "clicked"]).alias("any_flag"),
        S.clip("value", 1, 100, 1.0).alias("clipped"),
    )


@query("""
SELECT event_id, CASE WHEN event_type = 'view' OR isnan(x) OR isinf(x) THEN 0.0 ELSE x END AS safe
FROM (SELECT event_id, event_type, CASE event_type WHEN 'click' THEN 'NaN'::DOUBLE WHEN 'error' THEN 'Infinity'::DOUBLE ELSE value END AS x FROM events)""")
def finite_values(spark, d):
    text = (
        F.when(F.col("event_type") == "click", "NaN").when(F.col("event_type") == "error", "Infinity")
        .when(F.col("event_type") == "view", "not a number").otherwise(F.col("value").cast("string"))
    )
    return table(spark, d, "events").select("event_id", S.finite(text).alias("safe"))


@query("SELECT c_custkey, round_even(c_acctbal / 7, 2) AS coarse FROM customer")
def coarse_coordinates(spark, d):
    return table(spark, d, "customer").select("c_custkey", S.coarse_geo(F.col("c_acctbal") / 7).alias("coarse"))


@query("""
SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN o_totalprice END AS buy_price,
       CASE WHEN o_orderstatus = 'O' THEN o_totalprice END AS rent_gross,
       CASE WHEN o_orderstatus = 'O' THEN round(o_totalprice * 0.9, 4) END AS rent_net FROM orders""")
def prices_by_offer(spark, d):
    offer = F.when(F.col("o_orderstatus") == "F", "buy").when(F.col("o_orderstatus") == "O", "RENT")
    prices = S.offer_prices(offer, "o_totalprice")
    prices["rent_net"] = r(prices["rent_net"], 4)
    return table(spark, d, "orders").select("o_orderkey", *[v.alias(k) for k, v in prices.items()])


@query("""
SELECT CASE WHEN p >= 0.7 THEN 'HIGH' WHEN p >= 0.3 THEN 'MEDIUM' ELSE 'LOW' END AS risk_tier,
       CASE WHEN p >= 0.7 THEN 'DECLINE' WHEN p >= 0.3 THEN 'REVIEW' ELSE 'APPROVE' END AS decision,
       CASE WHEN p < 0.1 THEN '0.0-0.1' WHEN p < 0.3 THEN '0.1-0.3' WHEN p < 0.5 THEN '0.3-0.5' WHEN p < 0.7 THEN '0.5-0.7' ELSE '0.7-1.0' END AS band,
       count(*) AS n, round(avg(abs(p - 0.5) * 2), 4) AS confidence
FROM (SELECT l_extendedprice / 105000.0 AS p FROM lineitem) GROUP BY ALL""")
def tiers_and_bands(spark, d):
    p = predictions(spark, d)
    shown = p.select(S.risk_tier("score").alias("risk_tier"), S.decision("score").alias("decision"), S.probability_band("score").alias("band"), S.confidence("score").alias("c"))
    return shown.groupBy("risk_tier", "decision", "band").agg(F.count(F.lit(1)).alias("n"), r(F.avg("c"), 4).alias("confidence"))


@query("""
SELECT event_id, array_to_string(list_transform(list_slice(list_sort(list_filter([
   CASE WHEN event_type = 'error' THEN {'r': -0.25, 'p': 0, 'f': 'tor_network=true'} END,
   CASE WHEN value > 100 THEN {'r': -0.15, 'p': 1, 'f': 'vpn_detected=true'} END,
   CASE WHEN k < 30 THEN {'r': -0.20, 'p': 2, 'f': 'disposable_email=true'} END,
   CASE WHEN value > 20 THEN {'r': -0.15, 'p': 3, 'f': 'datacenter_ip=true'} END,
   CASE WHEN value < 150 THEN {'r': -0.10, 'p': 4, 'f': 'proxy_detected=true'} END,
   CASE WHEN k > 5 THEN {'r': -0.20, 'p': 5, 'f': 'shared_device=' || k || ' other listings'} END,
   CASE WHEN k > 10 THEN {'r': -0.15, 'p': 6, 'f': 'shared_ip=' || k || ' other listings'} END],
   lambda x: x IS NOT NULL)), 1, 5), lambda x: x.f), ',') AS reasons
FROM (SELECT event_id, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""")
def risk_reasons(spark, d):
    e = lifecycle(spark, d)
    k, v = F.col("k"), F.col("value")
    signals = {"tor": F.col("event_type") == "error", "vpn": v > 100, "email_disposable": k < 30, "datacenter": v > 20, "proxy": v < 150}
    reasons = S.risk_factors(signals, {"device": k, "ip": k})
    return e.select("event_id", F.array_join(F.transform(reasons, lambda x: F.concat(x["feature"], F.lit("="), x["value"])), ",").alias("reasons"))


@query("SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def non_empty_columns(spark, d):
    c = table(spark, d, "customer").withColumn("never_filled", F.lit(None).cast("double"))
    return drop_all_null(c)[0]


@query("SELECT l_orderkey, l_shipdate, l_returnflag, l_quantity, l_discount, l_linestatus FROM lineitem")
def variant_projection(spark, d):
    roles = Registry({
        Role.ID: ["l_orderkey"], Role.TIME: ["l_shipdate"], Role.TARGET: ["l_returnflag"], Role.VENDOR_STATE: ["l_linestatus"], Role.SIGNAL_NUMBER: ["l_quantity", "l_quantity"],
        Role.LISTING_NUMBER: ["l_discount", "l_absent"], Role.CATEGORY: ["l_linestatus"], Role.IDENTITY: ["l_suppkey"],
    })
    return project_variant(table(spark, d, "lineitem"), Variant.BOOSTED, roles)[0]


@query("SELECT CAST(p_size AS DOUBLE) AS p_size, p_brand, CAST(0 AS DOUBLE) AS image_count, CAST(NULL AS DOUBLE) AS rooms, try_cast(p_name AS DOUBLE) AS p_name FROM part")
def conformed_features(spark, d):
    ordered = ["p_size", "p_brand", "image_count", "rooms", "p_name"]
    return conform(table(spark, d, "part"), ordered, ["p_size", "image_count", "rooms", "p_name"])

"""Feeds, sinks, decision storage, review queue, and streaming forms over the standard tables."""

import time

from pyspark.sql import functions as F
from pyspark.sql import types as T

from stallwatch.catalog import query
from stallwatch.catalog.tables import LIFECYCLE_SQL, lifecycle, r, rounded, table
from stallwatch.functions.hashing import SALT_TYPES, Salts
from stallwatch.functions.scalar import decision, risk_tier
from stallwatch.plans import etl
from stallwatch.operators.models import fit_variant
from stallwatch.registry import Variant
from stallwatch.session import cut_lineage, scratch_folder, shuffle_width
from stallwatch.sources import decisions as D
from stallwatch.sources import feeds as S
from stallwatch.sources import ingest as I
from stallwatch.streaming.drift import streaming_changes, streaming_rolling_drift
from stallwatch.streaming.enrich import enriched
from stallwatch.streaming.ingest import deduplicated, start_ingest, table_stream
from stallwatch.streaming.links import LiveLinks
from stallwatch.streaming.routing import Router
from stallwatch.streaming.scoring import EventScorer, ScoringStream, numbered_events
from stallwatch.streaming.windows import windowed_counts

SALTS = Salts({kind: f"catalog-{kind}-salt" for kind in SALT_TYPES})


def _feed_folders(spark, d, name):
    """The events table written out as the two CSV feeds."""
    folder = scratch_folder(spark, name)
    e = lifecycle(spark, d)
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS"), F.lit(" +0100"))
    life = e.select(
        F.concat(F.lit("Listings#"), F.col("user_id").cast("string"), F.lit("##")).alias("OBJECTREFERENCE"),
        stamp.alias("DATAPIPELINE_EVENT_SENT_AT"),
        F.when(F.col("event_type") == "click", "PENDING_APPROVAL").when(F.col("event_type") == "view", "DRAFT").otherwise(F.upper("event_type")).alias("STATUS"),
        F.date_format("flag_ts", "yyyy-MM-dd HH:mm:ss.SSS").alias("FLAGGEDFORFRAUD"),
        F.col("value").cast("string").alias("LISTING_PRICES_BUY_PRICE"),
        F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("@shop.example")).alias("LISTING_LISTER_EMAIL"),
        F.lit(None).cast("string").alias("NEVER_FILLED"),
    )
    signals = e.filter("event_type = 'purchase'").select(
        F.col("user_id").alias("transaction_id"), F.col("event_id").alias("id"),
        F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS"), F.lit("+0000")).alias("date"),
        F.when(F.col("k") > 50, "DECLINE").otherwise("APPROVE").alias("state"), F.col("k").alias("fraud_score"),
    )
    life.write.option("header", True).csv(f"{folder}/lifecycle")
    signals.write.option("header", True).option("sep", ";").csv(f"{folder}/signals")
    return folder, S.Feeds(S.LifecycleFeed(f"{folder}/lifecycle"), S.SignalFeed(f"{folder}/signals"))


@query("""
SELECT CAST(user_id AS VARCHAR) AS id, status, epoch_us(min(ts)) - 3600000000 AS at_us FROM (
 SELECT user_id, ts, CASE event_type WHEN 'click' THEN 'PENDING_APPROVAL' ELSE upper(event_type) END AS status FROM events WHERE event_type <> 'view') GROUP BY 1, 2""")
def lifecycle_feed(spark, d):
    _, feeds = _feed_folders(spark, d, "feed")
    rows, _ = S.read_feeds(spark, feeds)
    return rows.select(F.col("INSERTION_ID").alias("id"), F.col("STATUS").alias("status"), F.unix_micros("event_dt").alias("at_us"))


@query("SELECT CAST(user_id AS VARCHAR) AS id, CAST(event_id AS VARCHAR) AS signal_id, (epoch_us(ts) // 1000) * 1000 AS at_us FROM events WHERE event_type = 'purchase'")
def signal_feed(spark, d):
    _, feeds = _feed_folders(spark, d, "feed")
    _, rows = S.read_feeds(spark, feeds)
    return rows.select(F.col("INSERTION_ID").alias("id"), F.col("id").alias("signal_id"), F.unix_micros("signal_dt").alias("at_us"))


@query("""
WITH l AS (SELECT user_id, min(ts) - INTERVAL 1 HOUR AS t FROM events WHERE event_type = 'click' GROUP BY 1),
s AS (SELECT user_id, date_trunc('millisecond', ts) AS sts, CAST(event_id AS VARCHAR) AS sid, CASE WHEN CAST(json_extract(props, '$.k') AS BIGINT) > 50 THEN 'DECLINE' ELSE 'APPROVE' END AS state FROM events WHERE event_type = 'purchase'),
f AS (SELECT l.user_id, s.sid, s.state FROM l ASOF LEFT JOIN s ON l.user_id = s.user_id AND l.t <= s.sts), b AS (SELECT l.user_id, s.sid, s.state FROM l ASOF LEFT JOIN s ON l.user_id = s.user_id AND l.t >= s.sts),
g AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'error')
SELECT count(*) AS rows, count(coalesce(f.sid, b.sid)) AS matched, count(*) FILTER (coalesce(f.state, b.state) = 'DECLINE') AS declined, count(g.user_id) AS positives, count(*) AS hashed_ids
FROM f JOIN b USING (user_id) LEFT JOIN g USING (user_id)""")
def merged_feeds(spark, d):
    folder, feeds = _feed_folders(spark, d, "etl")
    merged = etl.run(spark, feeds, SALTS, f"{folder}/merged")
    return merged.agg(
        F.count(F.lit(1)).alias("rows"), F.count("id").alias("matched"), F.count(F.when(F.col("state") == "DECLINE", 1)).alias("declined"),
        F.sum("is_fraud").alias("positives"), F.count_distinct("INSERTION_ID_hash").alias("hashed_ids"),
    )


@query("SELECT event_id, user_id, event_type, value FROM events")
def parquet_and_csv_round_trip(spark, d):
    folder = scratch_folder(spark, "tables")
    e = table(spark, d, "events").select("event_id", "user_id", "event_type", "value")
    S.write_table(e, f"{folder}/events.parquet", partition_by=["event_type"])
    S.write_table(e.limit(0), f"{folder}/events.parquet", only_if_missing=True)
    S.export_csv(S.read_table(spark, folder, "events"), f"{folder}/csv")
    return S.read_csv(spark, f"{folder}/csv", ",", e.select("event_id", "user_id", "value", "event_type").schema)


def _scored(spark, d):
    p = F.col("o_totalprice") / 500000.0
    return table(spark, d, "orders").select(
        F.col("o_custkey").cast("string").alias("insertion_id"), p.alias("fraud_probability"), risk_tier(p).alias("risk_tier"), decision(p).alias("admin_decision"),
        F.col("o_orderdate").alias("decided_at"), "o_orderkey",
    )


_SCORED = """SELECT CAST(o_custkey AS VARCHAR) AS insertion_id, p, o_orderkey, o_orderdate, CASE WHEN p >= 0.7 THEN 'DECLINE' WHEN p >= 0.3 THEN 'REVIEW' ELSE 'APPROVE' END AS dec FROM (SELECT *, o_totalprice / 500000.0 AS p FROM orders)"""


def _decided(spark, d):
    return D.decision_rows(_scored(spark, d).filter("admin_decision <> 'REVIEW'"))


@query(f"SELECT CASE dec WHEN 'APPROVE' THEN 'approved' ELSE 'declined' END AS bucket, CAST(year(o_orderdate) AS INT) AS yr, count(*) AS n FROM ({_SCORED}) WHERE dec <> 'REVIEW' GROUP BY 1, 2")
def stored_decisions(spark, d):
    folder = scratch_folder(spark, "decisions")
    rows = _decided(spark, d).withColumn("decision_date", F.trunc("decision_date", "year"))
    D.append_decisions(rows.filter("insertion_id < '5'"), folder)
    D.append_decisions(rows.filter("insertion_id >= '5'").withColumn("evt_extra", F.lit("x")), folder)
    return D.read_decisions(spark, folder).groupBy("bucket", F.year("decision_date").alias("yr")).agg(F.count(F.lit(1)).alias("n"))


@query(f"SELECT insertion_id, round(p, 8) AS fraud_probability, dec AS admin_decision, CAST(dec = 'DECLINE' AS TINYINT) AS is_fraud FROM ({_SCORED}) WHERE dec <> 'REVIEW'")
def retrain_rows(spark, d):
    return rounded(D.retrain_rows(_decided(spark, d)).drop("decided_at"), ["fraud_probability"], 8)


_QUEUE = f"q AS (SELECT insertion_id, o_orderdate AS queued_at, p FROM ({_SCORED}) WHERE dec = 'REVIEW'), a AS (SELECT insertion_id, o_orderdate AS decided_at, dec FROM ({_SCORED}) WHERE dec <> 'REVIEW')"


def _queued(spark, d):
    return _scored(spark, d).filter("admin_decision = 'REVIEW'").select("insertion_id", F.col("decided_at").alias("queued_at"), "o_orderkey")


@query(f"WITH {_QUEUE} SELECT (SELECT count(*) FROM a WHERE dec = 'APPROVE') AS approved_count, (SELECT count(*) FROM a WHERE dec = 'DECLINE') AS declined_count, (SELECT count(*) FROM a) AS pending_retrain_rows, (SELECT max(decided_at) FROM a) AS last_decision, (SELECT count(*) FROM q) AS queue_size")
def storage_stats(spark, d):
    return D.storage_stats(_decided(spark, d), _queued(spark, d))


@query(f"""WITH {_QUEUE}, l AS (SELECT insertion_id, max(decided_at) AS done FROM a GROUP BY 1)
SELECT insertion_id, min(queued_at) AS queued_at FROM q LEFT JOIN l USING (insertion_id) WHERE done IS NULL OR queued_at > done GROUP BY 1""")
def review_queue(spark, d):
    return D.review_queue(_queued(spark, d), _decided(spark, d)).select("insertion_id", "queued_at")


@query(f"WITH {_QUEUE} SELECT insertion_id, dec AS admin_decision FROM a WHERE insertion_id NOT IN (SELECT insertion_id FROM q)")
def decisions_about_unknown_ids(spark, d):
    return D.unknown_decisions(_decided(spark, d), _queued(spark, d)).select("insertion_id", "admin_decision")


@query(f"WITH {_QUEUE} SELECT count(*) AS rows, count(*) >= 50 AS ready FROM a")
def retrain_gate(spark, d):
    return D.retrain_ready(D.retrain_rows(_decided(spark, d)))


def _json_events(spark, d):
    """Events as scoring-event JSON; errors lack a field, signups carry a score out of range."""
    e = lifecycle(spark, d)
    text = F.to_json(
        F.struct(
            F.col("user_id").cast("string").alias("insertion_id"), F.when(F.col("event_type") != "error", F.lit("u")).alias("user_id"),
            F.lit("PENDING_APPROVAL").alias("event_type"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("event_timestamp"),
            F.col("k").cast("string").alias("email_hash"), F.lit("p").alias("phone_hash"), F.lit("i").alias("ip_hash"), F.lit("d").alias("device_hash"),
            F.when(F.col("event_type") == "signup", 101.0).otherwise(F.lit(50.0)).alias("fraud_score"),
        )
    )
    return e.select(text.alias("value"))


@query("SELECT count(*) AS events_processed, count(*) FILTER (event_type NOT IN ('error', 'signup')) AS events_stored, 10 AS reported FROM events")
def bulk_ingest(spark, d):
    report = I.bulk_report(I.parse_events(_json_events(spark, d)))
    return report.select("events_processed", "events_stored", F.size("errors").alias("reported"))


@query("""
SELECT 'event' AS kind, '' AS reason, count(*) AS n FROM events WHERE event_type NOT IN ('error', 'signup')
UNION ALL SELECT 'reject', CASE WHEN event_type = 'error' THEN 'error' ELSE 'signup' END, count(*) FROM events WHERE event_type IN ('error', 'signup') GROUP BY 2""")
def batch_rejects(spark, d):
    """A batch stored with its rejects: no event is lost."""
    folder = scratch_folder(spark, "batch")
    I.ingest_batch(_json_events(spark, d), folder)
    events = I.stored_events(spark, f"{folder}/events").agg(F.lit("event").alias("kind"), F.lit("").alias("reason"), F.count(F.lit(1)).alias("n"))
    rejects = spark.read.parquet(f"{folder}/rejected")
    kind = F.when(F.array_contains("errors", "missing user_id"), "error").when(F.array_contains("errors", "fraud_score outside 0-100"), "signup")
    return events.unionByName(rejects.groupBy(F.lit("reject").alias("kind"), kind.alias("reason")).agg(F.count(F.lit(1)).alias("n")))


_LINE = "CASE WHEN event_id % 97 = 0 THEN 'ragged line' WHEN event_id % 89 = 0 THEN 'bad value' WHEN event_id % 83 = 0 THEN 'value outside 0-1000' ELSE '' END"


@query(f"SELECT {_LINE} AS reason, count(*) AS n, CAST(sum(CASE WHEN {_LINE} = '' THEN event_id ELSE 0 END) AS BIGINT) AS ids FROM events GROUP BY 1")
def feed_rejects(spark, d):
    """A feed with ragged, unparseable and out-of-range lines: rows and rejects are all lines."""
    folder, i = scratch_folder(spark, "rejects"), F.col("event_id")
    value = F.when(i % 89 == 0, "n/a").when(i % 83 == 0, "-5").otherwise(F.col("value").cast("string"))
    line = F.concat_ws(";", i.cast("string"), F.col("user_id").cast("string"), F.when(i % 97 != 0, value))
    rows = table(spark, d, "events").select(line.alias("value"))
    rows.write.text(f"{folder}/in")
    schema = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("user_id", T.LongType()), T.StructField("value", T.DoubleType())])
    good, bad = S.read_csv_checked(spark, f"{folder}/in", ";", schema, f"{folder}/out", checks={"value outside 0-1000": F.col("value").between(0, 1000)}, options={"header": "false"})
    told = bad.select(F.array_join("errors", ",").alias("reason"), F.lit(0).cast("long").alias("event_id")).unionByName(good.select(F.lit("").alias("reason"), "event_id"))
    return told.groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids"))


@query("""
SELECT count(*) AS total_events, count(DISTINCT user_id) AS unique_insertions, count(DISTINCT json_extract_string(props, '$.k')) AS unique_emails, CAST(1 AS BIGINT) AS unique_phones,
 CAST(1 AS BIGINT) AS unique_ips, CAST(1 AS BIGINT) AS unique_devices, CAST(1 AS BIGINT) AS unique_users FROM events WHERE event_type NOT IN ('error', 'signup')""")
def stored_event_stats(spark, d):
    folder = scratch_folder(spark, "store")
    I.append_events(I.valid(I.parse_events(_json_events(spark, d))), folder)
    return I.store_stats(I.stored_events(spark, folder))


def _finish(stream_query):
    stream_query.awaitTermination()


@query("SELECT CAST(user_id AS VARCHAR) AS insertion_id, count(*) AS stored FROM events WHERE event_type NOT IN ('error', 'signup') GROUP BY 1")
def stream_ingest(spark, d):
    folder = scratch_folder(spark, "ingest")
    _json_events(spark, d).write.text(f"{folder}/in")
    _finish(start_ingest(spark.readStream.format("text").load(f"{folder}/in"), folder))
    return I.stored_events(spark, f"{folder}/events").groupBy("insertion_id").agg(F.count(F.lit(1)).alias("stored"))


def _events_stream(spark, d):
    return table_stream(spark, d, "events", table(spark, d, "events").schema).withColumn("ts", F.col("ts").cast("timestamp"))


def _append(stream, folder):
    _finish(stream.writeStream.format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/checkpoint").outputMode("append").trigger(availableNow=True).start())
    return stream.sparkSession.read.parquet(f"{folder}/out")


def _complete(stream, name):
    """Run an aggregation to completion in the ``complete`` mode and keep its last state as a table."""
    spark, folder = stream.sparkSession, scratch_folder(stream.sparkSession, name)

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(f"{folder}/out")

    _finish(stream.writeStream.foreachBatch(keep).option("checkpointLocation", f"{folder}/checkpoint").outputMode("complete").trigger(availableNow=True).start())
    return spark.read.parquet(f"{folder}/out")


def _window_rows(df):
    return df.select(F.unix_seconds("window_start").alias("from_s"), F.unix_seconds("window_end").alias("to_s"), "event_type", "n", r("total", 4).alias("total"))


@query("SELECT CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) AS from_s, CAST(epoch(time_bucket(INTERVAL 1 DAY, ts)) AS BIGINT) + 86400 AS to_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def stream_tumbling_windows(spark, d):
    return _window_rows(_complete(windowed_counts(_events_stream(spark, d), time="ts", keys=["event_type"], value="value", delay="1 hour", length="1 day"), "tumbling"))


@query("""
SELECT from_s, from_s + 86400 AS to_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM (
 SELECT (epoch_us(ts) // 43200000000 - o.o) * 43200 AS from_s, event_type, value FROM events, range(2) o(o)) GROUP BY ALL""")
def stream_sliding_windows(spark, d):
    return _window_rows(_complete(windowed_counts(_events_stream(spark, d), time="ts", keys=["event_type"], value="value", delay="1 hour", length="1 day", slide="12 hours"), "sliding"))


@query("""
WITH m AS (SELECT event_type, ts, value, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 25 MINUTE OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS fresh FROM events WINDOW w AS (PARTITION BY event_type ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS sid FROM m)
SELECT CAST(floor(epoch_us(min(ts)) / 1000000) AS BIGINT) AS from_s, CAST(floor((epoch_us(max(ts)) + 1500000000) / 1000000) AS BIGINT) AS to_s, event_type, count(*) AS n, round(sum(value), 4) AS total FROM s GROUP BY event_type, sid""")
def stream_session_windows(spark, d):
    return _window_rows(_complete(windowed_counts(_events_stream(spark, d), time="ts", keys=["event_type"], value="value", delay="1 hour", length="25 minutes", session=True), "session"))


@query("SELECT event_id, user_id FROM events")
def stream_deduplicated(spark, d):
    e = _events_stream(spark, d)
    twice = e.withColumn("__copy", F.explode(F.array(F.lit(1), F.lit(2)))).drop("__copy")
    return _append(deduplicated(twice, keys=["event_id"], time="ts", delay="1 hour").select("event_id", "user_id"), scratch_folder(spark, "dedup"))


@query(f"""
WITH e AS ({LIFECYCLE_SQL}), p AS (SELECT k, user_id, min(ts) AS seen FROM e GROUP BY 1, 2)
SELECT e.event_id, count(*) FILTER (p.seen < e.ts AND p.user_id <> e.user_id) AS k_links FROM e JOIN p ON e.k = p.k GROUP BY 1""")
def stream_link_counts(spark, d):
    folder = scratch_folder(spark, "links")
    stream = _events_stream(spark, d).withColumn("k", F.get_json_object("props", "$.k"))
    live = LiveLinks(folder, {"k": "k"}, "user_id", "ts", "event_id")
    _finish(live.start(stream))
    return spark.read.parquet(f"{folder}/links").drop("batch_id")


# Rows a file of a feed holds, at least, where a part is written as several.
FILE_ROWS = 50_000


def _fed_in_parts(df, part, folder, form="parquet"):
    """``df`` as a feed into ``folder``, part after part (few values, none for null), all of as many files; returns how many.

    Rows are made once, by all tasks, and stored by part; each part is then written from what it stored.
    """
    spark, stored = df.sparkSession, scratch_folder(df.sparkSession, "parts")
    df.withColumn("__part", part.cast("long")).filter("__part IS NOT NULL").write.partitionBy("__part").parquet(stored)
    kept = spark.read.parquet(stored)
    sizes = kept.groupBy("__part").count().orderBy("__part").collect()  # parts of the feed
    files = max(1, min(shuffle_width(spark), min((r["count"] for r in sizes), default=0) // FILE_ROWS))
    for r in sizes:  # a file source takes files by their time of change
        rows = kept.filter(F.col("__part") == r["__part"]).select(*df.columns)
        (rows.repartition(files) if files > 1 else rows.coalesce(1)).write.mode("append").format(form).save(folder)
        time.sleep(0.02)
    return files


def _by_day(spark, d, days, name):
    """The events as a stream of one micro-batch per ``days`` days, in order of time."""
    folder = scratch_folder(spark, name)
    e = table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k")).withColumn("ts", F.col("ts").cast("timestamp"))
    files = _fed_in_parts(e, F.floor(F.datediff("ts", F.lit("2024-01-01")) / days), folder)
    return spark.readStream.schema(e.schema).option("maxFilesPerTrigger", files).parquet(folder)


def _expired_sql(days, ttl):
    return f"""
WITH RECURSIVE e AS (SELECT event_id, user_id, ts, CAST(json_extract(props, '$.k') AS VARCHAR) AS k, datediff('day', DATE '2024-01-01', ts::DATE) // {days} AS b FROM events),
h AS (SELECT b, min(ts) - INTERVAL {ttl} DAY AS h FROM e GROUP BY 1), o AS (SELECT k, user_id, b, min(ts) AS t FROM e WHERE k IS NOT NULL GROUP BY 1, 2, 3),
c AS (SELECT k, user_id, min(t) AS s FROM o GROUP BY 1, 2
      UNION ALL SELECT c.k, c.user_id, n.t FROM c, LATERAL (SELECT min(o.t) AS t FROM o JOIN h USING (b) WHERE o.k = c.k AND o.user_id = c.user_id AND o.t > c.s AND h.h > c.s) n WHERE n.t IS NOT NULL)
SELECT e.event_id, count(DISTINCT c.user_id) FILTER (c.s < e.ts AND c.s >= h.h AND c.user_id <> e.user_id) AS k_links FROM e JOIN h USING (b) LEFT JOIN c ON c.k = e.k GROUP BY 1"""


@query(_expired_sql(3, 7))
def expired_links(spark, d):
    """A stream of one micro-batch per three days whose sightings are forgotten after seven."""
    folder = scratch_folder(spark, "links")
    live = LiveLinks(folder, {"k": "k"}, "user_id", "ts", "event_id", ttl_days=7, compact_every=4)
    _finish(live.start(_by_day(spark, d, 3, "days")))
    return spark.read.parquet(f"{folder}/links").drop("batch_id")


@query(f"SELECT 'decided' AS place, count(*) AS n FROM ({_SCORED}) WHERE dec <> 'REVIEW' UNION ALL SELECT 'retrain', count(*) FROM ({_SCORED}) WHERE dec <> 'REVIEW' UNION ALL SELECT 'queue', count(*) FROM ({_SCORED}) WHERE dec = 'REVIEW'")
def stream_routing(spark, d):
    folder = scratch_folder(spark, "routing")

    def score(batch):
        return batch.select(F.col("o_custkey").cast("string").alias("insertion_id"), (F.col("o_totalprice") / 500000.0).alias("fraud_probability"), F.date_trunc("year", "o_orderdate").alias("o_orderdate"))

    _finish(Router(folder, score, "o_orderdate").start(table_stream(spark, d, "orders", table(spark, d, "orders").schema)))
    out = None
    for place, name in (("decided", "decisions"), ("retrain", "retrain"), ("queue", "queue")):
        one = spark.read.parquet(f"{folder}/{name}").agg(F.lit(place).alias("place"), F.count(F.lit(1)).alias("n"))
        out = one if out is None else out.unionByName(one)
    return out


@query("SELECT count(*) AS n, count(*) AS same FROM events WHERE event_type NOT IN ('error', 'signup')")
def scored_stream(spark, d):
    """Events scored by a fitted model as a stream of one micro-batch a week, next to the same events scored at once."""
    folder, scorer = scratch_folder(spark, "scoring"), EventScorer(["fraud_score", "email_links", "device_links", "event_hour"])
    raw = _json_events(spark, d)
    week = F.floor(F.datediff(F.to_date(F.get_json_object("value", "$.event_timestamp")), F.lit("2024-01-01")) / 7)
    files = _fed_in_parts(raw, F.when(week.between(0, 4), week), f"{folder}/in", "text")  # January
    linked = cut_lineage(scorer.linked(numbered_events(I.parse_events(raw))))
    history = scorer.features(linked).filter(F.col("event_timestamp") < F.lit("2024-01-15").cast("timestamp"))
    label = (F.pmod(F.xxhash64("insertion_id"), F.lit(5)) == 0).cast("int")
    model = fit_variant(history.withColumn("y", label), "y", Variant.LOGISTIC, numbers=scorer.numbers)
    _finish(ScoringStream(f"{folder}/out", model, scorer).start(spark.readStream.format("text").option("maxFilesPerTrigger", files).load(f"{folder}/in")))
    stream = spark.read.parquet(f"{folder}/out/scored").drop("batch_id")
    columns = stream.columns
    same = F.xxhash64(*[F.to_json(F.struct(c)) for c in columns])
    both = scorer.score(model, linked).select("event_row", same.alias("a")).join(stream.select("event_row", same.alias("b")), "event_row", "full_outer")
    return both.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("a") == F.col("b"), 1)).alias("same"))


@query("""
WITH s AS (SELECT event_id AS signal_id, user_id, ts AS sts FROM events WHERE event_type = 'purchase')
SELECT e.event_id, s.signal_id FROM events e JOIN s ON e.user_id = s.user_id AND s.sts >= e.ts - INTERVAL 1 HOUR AND s.sts <= e.ts + INTERVAL 2 HOUR WHERE event_type = 'click'""")
def stream_enrichment(spark, d):
    e = _events_stream(spark, d)
    clicks = e.filter("event_type = 'click'").select("event_id", "user_id", "ts")
    signals = _events_stream(spark, d).filter("event_type = 'purchase'").select(F.col("event_id").alias("signal_id"), "user_id", F.col("ts").alias("signal_ts"))
    joined = enriched(clicks, signals, key="user_id", event_time="ts", signal_time="signal_ts", delay="1 hour", before="1 hour", after="2 hours")
    # Unmatched rows still inside the watermark at the end of a bounded replay stay in state; compare the matches.
    return _append(joined.select("event_id", "signal_id"), scratch_folder(spark, "enrich")).filter(F.col("signal_id").isNotNull())


@query("""
WITH o AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
k AS (SELECT DISTINCT o.event_type, j.j AS check_at FROM o, range(100, 10000000, 10) j(j) WHERE j.j <= o.n AND o.i = 1),
x AS (SELECT k.event_type, k.check_at, o.v, 1 AS a FROM k JOIN o ON o.event_type = k.event_type AND o.i <= 100 UNION ALL SELECT k.event_type, k.check_at, o.v, 0 FROM k JOIN o ON o.event_type = k.event_type AND o.i <= k.check_at AND o.i > k.check_at - 50),
s AS (SELECT event_type, check_at, v, sum(a) AS r, sum(1 - a) AS c FROM x GROUP BY 1, 2, 3),
f AS (SELECT event_type, check_at, sum(r) OVER w AS fr, sum(c) OVER w AS fc FROM s WINDOW w AS (PARTITION BY event_type, check_at ORDER BY v))
SELECT event_type AS series, check_at, round(max(abs(fr / 100.0 - fc / 50.0)), 6) AS ks_stat FROM f GROUP BY 1, 2""")
def stream_rolling_drift(spark, d):
    out = _append(streaming_rolling_drift(_events_stream(spark, d), series="event_type", time="ts", score="value"), scratch_folder(spark, "rolling"))
    return rounded(out.select("series", "check_at", "ks_stat"), ["ks_stat"])


@query()
def stream_detectors(spark, d):
    stream = _events_stream(spark, d).withColumn("wrong", (F.col("value") > 60).cast("double"))
    return _append(streaming_changes(stream, series="event_type", time="ts", error="wrong"), scratch_folder(spark, "detectors"))

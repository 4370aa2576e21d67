"""Streams give what the batch form gives; sinks are repeatable; feeds tolerate bad rows."""

import json
import time
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stallwatch.functions.hashing import Salts
from stallwatch.operators.graph import link_counts
from stallwatch.plans import etl
from stallwatch.sources import decisions as D
from stallwatch.sources import feeds as S
from stallwatch.sources import ingest as I
from stallwatch.streaming.ingest import start_ingest
from stallwatch.streaming.links import LiveLinks
from stallwatch.streaming.routing import Router
from stallwatch.streaming.windows import windowed_counts

T0 = datetime(2024, 1, 1)


@pytest.fixture(scope="module")
def events(spark, folder):
    return spark.read.parquet(f"{folder}/events.parquet").select(
        "event_id", "user_id", F.col("ts").cast("timestamp").alias("ts"), "event_type", "value", F.get_json_object("props", "$.k").alias("k")
    )


@pytest.fixture(scope="module")
def files(events, tmp_path_factory):
    """The events in time order as one file per micro-batch."""
    target = str(tmp_path_factory.mktemp("stream") / "in")
    days = [1, 9, 16, 24, 32]
    for start, end in zip(days, days[1:]):  # one write each, as a file source takes files by modification time
        day = F.datediff("ts", F.lit("2024-01-01")) + 1
        events.filter((day >= start) & (day < end)).coalesce(1).write.mode("append").parquet(target)
        time.sleep(0.05)
    return target


def stream(spark, events, files):
    return spark.readStream.schema(events.schema).option("maxFilesPerTrigger", 1).parquet(files)


def test_live_links_equal_batch_links_over_several_micro_batches(spark, events, files, tmp_path):
    live = LiveLinks(str(tmp_path), {"k": "k"}, "user_id", "ts", "event_id")
    live.start(stream(spark, events, files)).awaitTermination()
    got = spark.read.parquet(f"{tmp_path}/links")
    assert got.select("batch_id").distinct().count() > 1
    want = {r["event_id"]: r["k_links"] for r in link_counts(events, identities={"k": "k"}, entity="user_id", time="ts", row_id="event_id").collect()}
    assert {r["event_id"]: r["k_links"] for r in got.collect()} == want
    before = got.count()
    live.process(events.limit(5), int(got.agg(F.max("batch_id")).first()[0]))  # a retried batch replaces its own rows
    assert spark.read.parquet(f"{tmp_path}/links").count() < before


def test_expired_sightings_are_forgotten(spark, tmp_path):
    rows = lambda *data: spark.createDataFrame([(i, u, k, T0 + timedelta(days=t)) for i, u, k, t in data], "event_id long, user_id string, k string, ts timestamp")
    live = LiveLinks(str(tmp_path), {"k": "k"}, "user_id", "ts", "event_id", ttl_days=7)
    live.process(rows((1, "a", "x", 0), (2, "b", "x", 6)), 0)
    live.process(rows((3, "c", "x", 10)), 1)
    got = {r["event_id"]: r["k_links"] for r in spark.read.parquet(f"{tmp_path}/links").collect()}
    assert got == {1: 0, 2: 1, 3: 1}


def test_state_stays_level_and_expired_sightings_are_removed(spark, tmp_path, monkeypatch):
    """Twenty batches of the same size: after the time to live a batch reads no more than before, and old rows leave the table."""
    live = LiveLinks(str(tmp_path), {"k": "k"}, "user_id", "ts", "event_id", ttl_days=5, buckets=4, compact_every=4)
    monkeypatch.setattr("stallwatch.plans.ordered.shuffle_width", lambda spark: 2)  # fifty rows a batch need no more slices
    for n in range(20):
        rows = [(100 * n + i, f"u{n}-{i % 25}", f"k{i % 5}", T0 + timedelta(days=n, minutes=i)) for i in range(50)]
        live.process(spark.createDataFrame(rows, "event_id long, user_id string, k string, ts timestamp"), n)
    reads = {r.batch_id: r.rows_read for r in spark.read.parquet(f"{tmp_path}/reads").collect()}
    assert len(reads) == 20 and reads[5] == reads[19] == 5 * 25 and max(reads.values()) <= 5 * 25
    versions = {r.version: (r.removed, r.kept) for r in spark.read.parquet(f"{tmp_path}/sightings/versions").collect()}
    assert set(versions) == {3, 7, 11, 15, 19} and versions[3][0] == 0 and all(versions[v] == (4 * 25, 6 * 25) for v in (11, 15, 19))
    kept = {p.name for p in (tmp_path / "sightings").glob("base-*")}
    assert kept == {"base-15", "base-19"} and {int(p.name[9:]) for p in (tmp_path / "sightings/delta").glob("batch_id=*")} == set(range(16, 20))
    counts = {r.event_id: r.k_links for r in spark.read.parquet(f"{tmp_path}/links").collect()}
    # five earlier days of five ids of the same k, and those of the day seen before
    assert counts[1900] == 25 and counts[1949] == 29 and counts[0] == 0
    again = {r.event_id: r.k_links for r in spark.read.parquet(f"{tmp_path}/links").filter("batch_id = 19").collect()}
    rows = [(1900 + i, f"u19-{i % 25}", f"k{i % 5}", T0 + timedelta(days=19, minutes=i)) for i in range(50)]
    live.process(spark.createDataFrame(rows, "event_id long, user_id string, k string, ts timestamp"), 19)  # a retry after its compaction
    assert {r.event_id: r.k_links for r in spark.read.parquet(f"{tmp_path}/links").filter("batch_id = 19").collect()} == again


def test_windows_on_a_stream_equal_the_batch(spark, events, files, tmp_path):
    settings = dict(time="ts", keys=["event_type"], value="value", delay="40 days", length="6 hours", slide="3 hours")
    out = str(tmp_path / "out")

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(out)

    windowed_counts(stream(spark, events, files), **settings).writeStream.outputMode("complete").foreachBatch(keep).option(
        "checkpointLocation", str(tmp_path / "c")
    ).trigger(availableNow=True).start().awaitTermination()
    columns = ["window_start", "event_type", "n"]
    assert set(spark.read.parquet(out).select(columns).collect()) == set(windowed_counts(events, **settings).select(columns).collect())


def test_late_rows_are_dropped_after_the_watermark(spark, tmp_path):
    source = str(tmp_path / "in")
    schema = "ts timestamp, k string, v double"
    for i, hours in enumerate((0, 10, 1, 30)):
        spark.createDataFrame([(T0 + timedelta(hours=hours), "k", 1.0)], schema).coalesce(1).write.mode("append").parquet(f"{source}/b={i}")
    q = (
        windowed_counts(spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{source}/*"), time="ts", keys=["k"], value="v", delay="2 hours", length="1 hour")
        .writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    starts = {r["window_start"] for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert T0 + timedelta(hours=0) in starts and T0 + timedelta(hours=10) in starts
    assert len(starts) <= 3


def _json(spark, *events):
    import json

    base = {"insertion_id": "a", "user_id": "u", "event_type": "PENDING_APPROVAL", "event_timestamp": "2024-01-01T10:00:00Z", "email_hash": "e", "phone_hash": "p", "ip_hash": "i", "device_hash": "d"}
    return spark.createDataFrame([(json.dumps({**base, **e}) if isinstance(e, dict) else e,) for e in events], "value string")


def test_validation_reasons(spark):
    parsed = I.parse_events(_json(spark, {}, {"user_id": None}, {"fraud_score": 100.5}, {"event_type": "NOPE"}, {"event_timestamp": "then"}, "{broken", {"fraud_score": 0}))
    errors = [r["errors"] for r in parsed.collect()]
    assert errors == [[], ["missing user_id"], ["fraud_score outside 0-100"], ["unknown event_type"], ["bad event_timestamp"], ["unreadable"], []]
    assert I.valid(parsed).count() == 2 and I.rejected(parsed).count() == 5
    report = I.bulk_report(I.parse_events(_json(spark, *["x"] * 14, {}))).first()
    assert (report["events_processed"], report["events_stored"], len(report["errors"])) == (15, 1, 10)


def test_ingest_stream_tells_new_from_known_ids_and_drops_repeats(spark, tmp_path):
    source = str(tmp_path / "in")
    for i, batch in enumerate([[{}, {}, {"insertion_id": "b"}], [{"event_timestamp": "2024-01-01T11:00:00Z"}, "broken", {"insertion_id": "c", "event_timestamp": "2024-01-01T11:00:00Z"}]]):
        _json(spark, *batch).coalesce(1).write.mode("append").text(f"{source}/b={i}")
        raw = spark.readStream.format("text").load(f"{source}/*").select("value")
        start_ingest(raw, str(tmp_path)).awaitTermination()
    stored = I.stored_events(spark, f"{tmp_path}/events")
    assert sorted((r["insertion_id"], r["status"]) for r in stored.collect()) == [("a", "stored"), ("a", "updated"), ("b", "stored"), ("c", "stored")]
    assert spark.read.parquet(f"{tmp_path}/rejected").count() == 1
    # far behind everything seen so far, with a repeat of a stored event and two events of one new id
    late = [{"insertion_id": "d", "event_timestamp": "2020-01-01T00:00:00Z"}, {"insertion_id": "d", "event_timestamp": "2020-01-02T00:00:00Z"}, {"insertion_id": "b"}]
    _json(spark, *late).coalesce(1).write.mode("append").text(f"{source}/b=9")
    start_ingest(spark.readStream.format("text").load(f"{source}/*").select("value"), str(tmp_path)).awaitTermination()
    again = [(r["insertion_id"], r["status"]) for r in I.stored_events(spark, f"{tmp_path}/events").orderBy("event_timestamp").collect()]
    assert again[:2] == [("d", "stored"), ("d", "updated")] and len(again) == 6


def test_routing_review_and_human_decisions(spark, tmp_path):
    at = lambda h: T0 + timedelta(hours=h)
    scored = spark.createDataFrame(
        [("low", 0.1, at(0)), ("mid", 0.5, at(0)), ("mid", 0.4, at(1)), ("edge", 0.3, at(0)), ("high", 0.7, at(0)), ("later", 0.5, at(0)), ("later", 0.9, at(2))],
        "insertion_id string, fraud_probability double, ts timestamp",
    )
    router = Router(str(tmp_path), lambda batch: batch, "ts")
    router.process(scored, 0)
    router.process(scored, 0)  # a retried micro-batch changes nothing
    decided = {(r["insertion_id"], r["admin_decision"], r["bucket"]) for r in D.read_decisions(spark, str(tmp_path)).collect()}
    assert decided == {("low", "APPROVE", "approved"), ("high", "DECLINE", "declined"), ("later", "DECLINE", "declined")}
    pending = {r["insertion_id"]: r["fraud_probability"] for r in router.pending(spark).collect()}
    assert pending == {"mid": 0.5, "edge": 0.3}  # one item per id, the first; an automatic decision clears its id
    human = spark.createDataFrame([("mid", "DECLINE", "ann", "", at(5)), ("ghost", "APPROVE", "ann", "", at(5))], "insertion_id string, admin_decision string, admin_id string, notes string, decided_at timestamp")
    assert [r["insertion_id"] for r in router.decide(spark, human, 0).collect()] == ["ghost"]  # the stream has a batch 0 too
    assert {r["insertion_id"] for r in D.read_decisions(spark, str(tmp_path)).collect()} == {"low", "high", "later", "mid"}
    assert [r["insertion_id"] for r in router.pending(spark).collect()] == ["edge"]
    labels = {r["insertion_id"]: r["is_fraud"] for r in spark.read.parquet(f"{tmp_path}/retrain").collect()}
    assert labels == {"low": 0, "high": 1, "later": 1, "mid": 1}


def test_feeds_survive_malformed_and_ragged_lines(spark, tmp_path):
    (tmp_path / "l.csv").write_text(
        "OBJECTREFERENCE,DATAPIPELINE_EVENT_SENT_AT,STATUS,FLAGGEDFORFRAUD,TARGETPLATFORM\n"
        "L#A##,2025-01-15 10:30:00.000 +0100,PENDING_APPROVAL,,ONE\n"
        "L#A##,2025-01-15 10:00:00.000 +0000,PENDING_APPROVAL,,one\n"  # later in UTC although its text sorts first
        "L#A##,2025-01-16 10:00:00.000 +0000,ARCHIVED,2025-01-20 00:00:00.000,one\n"
        "none,2025-01-15 10:00:00.000 +0000,PENDING_APPROVAL,,one\n"
        "L#B##,yesterday,PENDING_APPROVAL,,one\n"
        "L#C##,2025-01-15 10:00:00.000 +0000,DRAFT,,one\n"
        "L#D##,2025-01-15 10:00:00.000 +0000,PENDING_APPROVAL,,two\n"
    )
    (tmp_path / "s.csv").write_text("transaction_id;id;date;state\nA;s1;2025-01-15T09:45:00.000+0000;REVIEW;extra;extra\nA;s2;2025-01-14T09:00:00.000+0000;APPROVE\n;s3;2025-01-14T09:00:00.000+0000;APPROVE\nB;s4;never\n")
    feeds = S.Feeds(S.LifecycleFeed(str(tmp_path / "l.csv"), platform="TARGETPLATFORM", allowed_platforms=["one"]), S.SignalFeed(str(tmp_path / "s.csv")))
    life, signals = S.read_feeds(spark, feeds)
    assert {(r["INSERTION_ID"], r["STATUS"], r["TARGETPLATFORM"]) for r in life.collect()} == {("A", "PENDING_APPROVAL", "ONE"), ("A", "ARCHIVED", "one")}
    assert {r["id"] for r in signals.collect()} == {"s1", "s2"}
    salts = Salts({"object": "o"}, allow_default=True)
    out = str(tmp_path / "merged")
    merged = etl.run(spark, feeds, salts, out)
    row = merged.first()
    assert merged.count() == 1 and row["id"] == "s1" and row["state"] == "REVIEW" and row["is_fraud"] == 1
    assert "INSERTION_ID" not in merged.columns and "OBJECTREFERENCE" not in merged.columns and not any(c.endswith("_signal") for c in merged.columns)
    assert spark.read.json(f"{out}_summary/totals").first()["positive_events"] == 1
    etl.run(spark, feeds, salts, out)  # an existing table is kept
    assert spark.read.parquet(out).count() == 1


def test_checkpoint_folder_follows_the_session(spark):
    from stallwatch.session import cut_lineage, ensure_checkpoint_dir

    assert ensure_checkpoint_dir(spark) == spark.sparkContext.getCheckpointDir()
    assert cut_lineage(spark.range(5)).count() == 5


def test_every_csv_line_is_a_row_or_a_reject(spark, tmp_path):
    from pyspark.sql import types as T
    from stallwatch.sources.feeds import finished, read_csv_checked, write_table

    lines = ["id;v;t", "1;2.5;a", "2;x;b", "3;-1;c", "4", "5;1;d;more", "6;;", ";7;e", '8;1;"open', "9;3;f"]
    (tmp_path / "in.csv").write_text("\n".join(lines) + "\n")
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("v", T.DoubleType()), T.StructField("t", T.StringType())])
    rows, rejects = read_csv_checked(spark, str(tmp_path / "in.csv"), ";", schema, str(tmp_path / "out"), checks={"v below 0": F.col("v") >= 0})
    told = {r.line: r.errors for r in rejects.collect()}
    assert told["2;x;b"] == ["bad v"] and told["3;-1;c"] == ["v below 0"]
    assert told["4"] == ["ragged line"] and told["5;1;d;more"] == ["ragged line"]
    assert {r.id for r in rows.collect()} >= {1, 6, None} and rows.count() + rejects.count() == len(lines) - 1
    target = str(tmp_path / "table")
    (tmp_path / "table").mkdir()  # what a crashed write leaves
    assert not finished(spark, target)
    write_table(rows, target, only_if_missing=True)
    assert finished(spark, target) and spark.read.parquet(target).count() == rows.count()
    write_table(rows.limit(0), target, only_if_missing=True)
    assert spark.read.parquet(target).count() == rows.count()


def test_batch_ingest_keeps_rejects(spark, tmp_path):
    from stallwatch.sources.ingest import ingest_batch

    good = {c: "x" for c in ("insertion_id", "user_id", "email_hash", "phone_hash", "ip_hash", "device_hash")} | {"event_type": "DELETED", "event_timestamp": "2024-01-01T00:00:00Z"}
    texts = [json.dumps(good), json.dumps(good | {"fraud_score": 101}), "{broken", json.dumps(good | {"event_type": "NO"})]
    report = ingest_batch(spark.createDataFrame([(t,) for t in texts], "value string"), str(tmp_path)).first()
    assert (report.events_processed, report.events_stored, len(report.errors)) == (4, 1, 3)
    assert {r.raw for r in spark.read.parquet(f"{tmp_path}/rejected").collect()} == set(texts[1:])


def test_decisions_carry_their_event_fields(spark):
    from stallwatch.sources.decisions import decision_rows, retrain_rows

    rows = spark.sql("SELECT 'a' AS insertion_id, 0.9D AS fraud_probability, 'DECLINE' AS admin_decision, TIMESTAMP'2024-01-01' AS decided_at, named_struct('price', 5, 'kind', 'k') AS event")
    out = decision_rows(rows)
    assert out.first().evt_price == "5" and "event" not in out.columns and {"evt_price", "evt_kind"} <= set(retrain_rows(out).columns)


def test_a_scoring_stream_gives_what_a_batch_gives_also_after_a_break(spark, tmp_path, monkeypatch):
    from stallwatch.operators.models import fit_variant
    from stallwatch.registry import Variant
    from stallwatch.sources.ingest import parse_events
    from stallwatch.streaming.scoring import EventScorer, ScoringStream, numbered_events

    def event(i):
        at = (T0 + timedelta(hours=i)).isoformat() + "Z"
        odd = {"fraud_score": 101} if i == 17 else {"vpn": True, "device_hash": "hub"} if i % 4 == 0 else {}
        return json.dumps({c: f"{c}{i % 7}" for c in ("user_id", "email_hash", "phone_hash", "ip_hash", "device_hash")} | {"insertion_id": f"l{i % 23}", "event_type": "PUBLISHED", "event_timestamp": at, "fraud_score": i * 2 % 101, "listing_price": 5.0} | odd)

    texts = [event(i) for i in range(60)]
    scorer = EventScorer(["fraud_score", "device_links", "listing_rooms", "unknown_count"])
    raw = spark.createDataFrame([(t,) for t in texts], "value string")
    linked = scorer.linked(numbered_events(parse_events(raw))).cache()
    model = fit_variant(scorer.features(linked).withColumn("y", (F.col("fraud_score") > 50).cast("int")), "y", Variant.LOGISTIC, numbers=scorer.numbers)
    want = {r.event_row: r for r in scorer.score(model, linked).collect()}
    stream, calls = ScoringStream(str(tmp_path), model, scorer), []
    real = Router.process

    def breaks_once(self, batch, batch_id):
        calls.append(batch_id)
        if calls == [0, 1]:
            raise RuntimeError("stopped in the middle of a batch")
        real(self, batch, batch_id)

    monkeypatch.setattr(Router, "process", breaks_once)
    for n in range(3):
        part = spark.createDataFrame([(t,) for t in texts[20 * n : 20 * n + 20]], "value string")
        try:
            stream.process(part, n)
        except RuntimeError:
            stream.process(part, n)
    assert calls == [0, 1, 1, 2]
    got = {r.event_row: r for r in spark.read.parquet(f"{tmp_path}/scored").drop("batch_id").collect()}
    assert got == want and len(got) == 59 and spark.read.parquet(f"{tmp_path}/rejected").count() == 1
    assert any("shared_device" in {f.feature for f in r.risk_factors} for r in got.values()) and any("vpn_detected" in {f.feature for f in r.risk_factors} for r in got.values())
    decided = D.read_decisions(spark, str(tmp_path))
    assert decided.count() == sum(r.decision != "REVIEW" for r in want.values()) and {r.evt_listing_price for r in decided.select("evt_listing_price").distinct().collect()} == {"5.0"}
    assert spark.read.parquet(f"{tmp_path}/queue").count() == sum(r.decision == "REVIEW" for r in want.values())

"""What the findings of round 3 were about: steps done once, in little memory and over all cores."""

from pyspark.sql import functions as F

from stallwatch.sources import ingest as I


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def _raw(spark):
    good = {c: "x" for c in I.REQUIRED_TEXT} | {"event_type": "DRAFT", "event_timestamp": "2024-01-01T00:00:00Z"}
    rows = [good] * 3 + [good | {"event_type": "NONE"}] * 9 + [good | {"fraud_score": 101.0}] * 8
    return spark.createDataFrame([(str(r).replace("'", '"'),) for r in rows] + [("no json",)], "value string")


def test_events_are_parsed_once_however_they_are_filtered(spark):
    parsed = I.parse_events(_raw(spark))
    for out in (I.valid(parsed), I.rejected(parsed)):
        assert _plan(out).count("from_json") == 1
    assert (I.valid(parsed).count(), I.rejected(parsed).count()) == (3, 18)


def test_bulk_report_counts_in_one_pass(spark):
    report = I.bulk_report(I.parse_events(_raw(spark))).first()
    assert (report["events_processed"], report["events_stored"]) == (21, 3)
    assert report["errors"] == ["fraud_score outside 0-100"] * 8 + ["unknown event_type"] * 2
    empty = I.bulk_report(I.parse_events(_raw(spark).limit(0))).first()
    assert (empty["events_processed"], empty["events_stored"], empty["errors"]) == (0, 0, [])


def test_hashing_runs_on_all_cores_from_a_single_row_group(spark, folder):
    from stallwatch.catalog import hashing
    from stallwatch.session import shuffle_width

    for query in (hashing.hashed_listing_documents, hashing.hashed_flat_listings):
        assert query(spark, folder).rdd.getNumPartitions() == shuffle_width(spark)


def test_batch_link_counts_store_their_events_once(spark):
    from stallwatch.streaming.scoring import EventScorer, numbered_events

    assert "from_json" not in _plan(EventScorer(["fraud_score"]).linked(numbered_events(I.parse_events(_raw(spark)))))


def _members(spark, n=400):
    return spark.range(n).select(F.col("id").alias("e"), F.timestamp_seconds(F.floor(F.col("id") / 3)).alias("t"), (F.col("id") % 2).alias("k"), (F.col("id") / 10).alias("x"))


def test_edges_over_several_blocks_bring_columns_along(spark):
    from stallwatch.operators import graph as G

    m, cap = _members(spark), 130
    assert cap > G.BLOCK
    edges = G.sharing_edges(m, entity="e", time="t", identities={"k": ["k"]}, cap=cap, about=m.select("e", "x"), slices=3)
    got = sorted((r["src"], r["dst"], r["src_x"], r["dst_x"]) for r in edges.collect())
    want = []
    for a in range(400):
        later = [b for b in range(400) if b % 2 == a % 2 and b // 3 > a // 3]
        want += [(a, b, a / 10, b / 10) for b in later[:cap]]
    assert got == sorted(want)
    counts = G.sharing_counts(m, entity="e", time="t", identities={"k": ["k"]}, cap=cap, slices=3)
    assert counts.filter("shared = 1").count() == counts.count() == len(want)


def test_first_drawn_takes_exactly_the_first(spark):
    from stallwatch.operators import graph as G

    df = spark.range(5000).withColumn("h", F.when(F.col("id") % 2 == 0, F.lit(5)).otherwise(G.drawn_number(1, "id")))
    ordered = [r["id"] for r in df.orderBy("h", "id").collect()]
    for n in (0, 7, 2500, 3100, 5000, 6000):
        assert sorted(r["id"] for r in G.first_drawn(df, "h", ["id"], n).collect()) == sorted(ordered[:n])


def test_wide_fits_assemble_their_rows_once(spark, monkeypatch):
    from stallwatch.operators import models as M
    from stallwatch.registry import Variant

    seen, size = [], M.WIDEST
    rows = spark.range(400).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 2).alias("y"), F.array(*[(F.col("id") % (i + 2)).cast("double") for i in range(size)]).alias("v"))
    fit = M.GBTClassifier._fit
    monkeypatch.setattr(M.GBTClassifier, "_fit", lambda self, df: seen.append((df.is_cached, df.columns)) or fit(self, df))
    model = M.fit_variant(rows, "y", Variant.GRAPH_VECTORS, numbers=["a"], vector="v", vector_size=size, maxIter=2)
    assert seen == [(True, ["features", "label", M.WEIGHT])]
    assert model.inputs[:2] == ["a", "a_missing"] and len(model.inputs) == size + 2
    scored = model.predict(rows)
    assert scored.filter(f"({M.PROBABILITY} > 0.5) <> (y = 1)").count() == 0


def test_feed_parts_are_made_once_and_written_as_equally_many_files(spark, tmp_path, monkeypatch):
    import glob

    from stallwatch.catalog import decisions

    monkeypatch.setattr(decisions, "FILE_ROWS", 50)
    made = spark.sparkContext.accumulator(0)

    def count(v):
        made.add(1)
        return v

    df = spark.range(301).withColumn("v", F.udf(count, "long")("id"))
    part = F.when(F.col("id") < 300, F.floor(F.col("id") / 100))
    files = decisions._fed_in_parts(df, part, str(tmp_path / "feed"))
    assert files == 2 and made.value == 300  # each row of a part made once, not once per part
    assert len(glob.glob(f"{tmp_path}/feed/*.parquet")) == 3 * files
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", files).parquet(str(tmp_path / "feed"))
    batches = []
    stream.writeStream.foreachBatch(lambda b, i: batches.append(sorted(r["v"] for r in b.collect()))).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert batches == [list(range(100 * n, 100 * n + 100)) for n in range(3)]


def test_link_counts_take_known_sightings(spark):
    from stallwatch.operators.graph import link_counts

    at = lambda s: F.timestamp_seconds(F.lit(s))
    rows = spark.createDataFrame([(1, "a", "x"), (2, "b", "x"), (3, "c", None), (4, None, "x")], "r long, e string, k string").withColumn("t", F.when(F.col("r") != 2, at(100)).otherwise(at(200)))
    seen = spark.createDataFrame([("k", "x", e, s * 1_000_000) for e, s in [("a", 100), ("b", 200), ("b", 50), ("z", 10)]], "kind string, identity string, entity string, seen long")
    got = {r["r"]: r["k_links"] for r in link_counts(rows, identities={"k": "k"}, entity="e", time="t", row_id="r", seen=seen).collect()}
    assert got == {1: 2, 2: 2, 3: 0, 4: 0}


def test_search_lays_rows_out_by_their_number_and_fits_side_by_side(spark, monkeypatch):
    from stallwatch.operators import models as M

    rows = spark.range(900).select(
        (F.floor(F.col("id") / 3) % 2 + 1).cast("int").alias("fold"), F.when(F.col("id") % 3 < 2, "train").otherwise("test").alias("role"),
        F.col("id").cast("double").alias("a"), F.lit(1.0).alias("same"), (F.col("id") % 5 < 2).cast("int").alias("y"), (F.col("id") % 5).cast("string").alias("c"),
    )
    search, seen, level, fit = M.Search(space={"maxDepth": (2, 4), "maxIter": (1, 2)}, trials=4, round_steps=2), [], [0, 0], M.GBTClassifier._fit

    def watched(self, df):
        level[0] += 1
        level[1] = max(level)
        seen.append((self.getMaxDepth(), df.rdd.getNumPartitions(), len(df.first()["features"])))
        try:
            return fit(self, df)
        finally:
            level[0] -= 1

    monkeypatch.setattr(M.GBTClassifier, "_fit", watched)
    out = search.run(rows, "y", numbers=["a", "same"], categories=["c"], folds=[1, 2]).collect()
    assert len(out) == 8 and len(seen) == 8 and all(r.mean_ap > 0.99 for r in out)
    # 300 train rows of a fold are one task however many cores there are, without the inputs that never vary
    assert {s[1:] for s in seen} == {(1, 2)} and level[1] > 4
    del seen[:]
    M.Search(space={"maxDepth": (2, 4), "maxIter": (1, 1)}, trials=3, workers=1, block=100).run(rows, "y", numbers=["a", "same"], categories=["c"], folds=[1, 2])
    assert {s[1] for s in seen} == {3} and [s[0] for s in seen] == sorted((s[0] for s in seen), reverse=True)


def test_hashing_strips_and_encodes_without_patterns(spark, folder):
    import hashlib
    import hmac
    import re

    from stallwatch.catalog import hashing
    from stallwatch.functions import hashing as H

    for query in (hashing.hashed_flat_listings, hashing.hashed_names):
        plan = _plan(query(spark, folder))
        assert "regexp" not in plan and "encode(" not in plan
    blanks = r"[ \t\n\x0b\f\r]+"
    texts = [f"{a}Ab{b}ÇD{c}" for a in ("", " ", "\t\x0b ", " ") for b in ("", "  ", "\n") for c in ("", " ", "\f\r\n", " x", " ", "\U0001f600 ")] + ["", " ", "\n\t\x0b\f\r ", None]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, s string").select("i", H.hmac_hex("s", b"salt").alias("h")).collect()
    for r in got:
        bare = re.sub(rf"\A{blanks}|{blanks}\Z", "", texts[r.i] or "").lower()
        assert r.h == (hmac.new(b"salt", bare.encode(), hashlib.sha256).hexdigest() if bare else None)

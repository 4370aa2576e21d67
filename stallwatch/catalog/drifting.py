"""Distribution drift, rolling checks, sequential detectors."""

from pyspark.sql import functions as F

from stallwatch.catalog import query
from stallwatch.catalog.tables import lifecycle, predictions, rounded, table
from stallwatch.operators import detectors as C
from stallwatch.operators import drift as D
from stallwatch.plans.ordered import micros

FEATURES = ["l_extendedprice", "l_quantity", "l_discount", "l_partkey"]
_SIDES = "r AS (SELECT * FROM lineitem WHERE year(l_shipdate) <= 1997), c AS (SELECT * FROM lineitem WHERE year(l_shipdate) > 1997 AND l_extendedprice > 15000)"


def _sides(spark, d):
    li = table(spark, d, "lineitem")
    year = F.year("l_shipdate")
    return li.filter(year <= 1997), li.filter((year > 1997) & (F.col("l_extendedprice") > 15000))


def _psi_sql(feature):
    return f"""SELECT '{feature}' AS feature, sum((cp - rp) * ln(cp / rp)) AS psi FROM (
 SELECT (coalesce(rn, 0) + 1e-6) / ((SELECT count(*) FROM r) + 10 * 1e-6) AS rp, (coalesce(cn, 0) + 1e-6) / ((SELECT count(*) FROM c) + 10 * 1e-6) AS cp
 FROM range(10) g(b) LEFT JOIN (SELECT greatest(0, least(9, floor(({feature} - lo) / (hi - lo) * 10)))::INT AS b, count(*) AS rn FROM r, (SELECT min({feature}) AS lo, max({feature}) AS hi FROM r) GROUP BY 1) USING (b)
 LEFT JOIN (SELECT greatest(0, least(9, floor(({feature} - lo) / (hi - lo) * 10)))::INT AS b, count(*) AS cn FROM c, (SELECT min({feature}) AS lo, max({feature}) AS hi FROM r) GROUP BY 1) USING (b))"""


def _ks_sql(feature):
    return f"""SELECT '{feature}' AS feature, max(abs(fr / nr - fc / nc)) AS ks FROM (SELECT sum(rr) OVER (ORDER BY v) AS fr, sum(cc) OVER (ORDER BY v) AS fc, (SELECT count(*) FROM r) AS nr, (SELECT count(*) FROM c) AS nc
 FROM (SELECT v, sum(a) AS rr, sum(1 - a) AS cc FROM (SELECT {feature} AS v, 1 AS a FROM r UNION ALL SELECT {feature}, 0 FROM c) GROUP BY 1))"""


_KS_X = "ks * sqrt((SELECT count(*) FROM r) * (SELECT count(*) FROM c) / ((SELECT count(*) FROM r) + (SELECT count(*) FROM c))::DOUBLE)"
_KS_P = f"CASE WHEN {_KS_X} < 0.2 THEN 1.0 ELSE greatest(0, least(1, 2 * (SELECT sum(pow(-1, k - 1) * exp(-2.0 * k * k * pow({_KS_X}, 2))) FROM range(1, 101) t(k)))) END"


def _jsd_sql(feature):
    hist = "(SELECT least(9, floor((v - lo) / (hi - lo) * 10))::INT AS b, count(*) AS n FROM (SELECT {f} AS v FROM {t}), s GROUP BY 1)"
    return f"""SELECT '{feature}' AS feature, (SELECT 0.5 * sum(p * ln(p / ((p + q) / 2))) + 0.5 * sum(q * ln(q / ((p + q) / 2))) FROM (
 WITH s AS (SELECT min(v) AS lo, max(v) AS hi FROM (SELECT {feature} AS v FROM r UNION ALL SELECT {feature} FROM c))
 SELECT (coalesce(a.n, 0) / ((SELECT count(*) FROM r) * (hi - lo) / 10) + 1e-10) / (10 / (hi - lo) + 10 * 1e-10) AS p, (coalesce(z.n, 0) / ((SELECT count(*) FROM c) * (hi - lo) / 10) + 1e-10) / (10 / (hi - lo) + 10 * 1e-10) AS q
 FROM s, range(10) g(b) LEFT JOIN {hist.format(f=feature, t='r')} a USING (b) LEFT JOIN {hist.format(f=feature, t='c')} z USING (b))) AS jsd"""


def _all(make):
    return "\nUNION ALL ".join(make(f) for f in FEATURES)


@query(f"WITH {_SIDES} SELECT feature, round(psi, 5) AS psi, CASE WHEN psi < 0.1 THEN 'STABLE' WHEN psi < 0.25 THEN 'MODERATE SHIFT' ELSE 'SIGNIFICANT DRIFT' END AS label FROM ({_all(_psi_sql)})")
def population_stability(spark, d):
    return rounded(D.psi(*_sides(spark, d), FEATURES), ["psi"], 5)


@query(f"WITH {_SIDES} SELECT feature, (SELECT count(*) FROM r) AS n_ref, (SELECT count(*) FROM c) AS n_cur, round(ks, 6) AS ks_stat, round({_KS_P}, 4) AS ks_p FROM ({_all(_ks_sql)})")
def kolmogorov_smirnov(spark, d):
    found = D.ks(*_sides(spark, d), FEATURES).select("feature", "n_ref", "n_cur", "ks_stat", "ks_p")
    return rounded(rounded(found, ["ks_stat"]), ["ks_p"], 4)


@query(f"WITH {_SIDES} SELECT feature, round(jsd, 6) AS jsd FROM ({_all(_jsd_sql)})")
def jensen_shannon(spark, d):
    return rounded(D.jensen_shannon(*_sides(spark, d), FEATURES), ["jsd"])


@query(f"""WITH {_SIDES}, p AS ({_all(_psi_sql)}), k AS ({_all(_ks_sql)}), j AS ({_all(_jsd_sql)})
SELECT feature, CASE WHEN feature = 'l_extendedprice' THEN 'prediction' ELSE 'feature' END AS role, round(psi, 5) AS psi, round(ks, 6) AS ks_stat, round({_KS_P}, 4) AS ks_p, round(jsd, 6) AS jsd,
 CASE WHEN feature = 'l_extendedprice' THEN CAST(psi > 0.2 AS INT) + CAST(ks > 1.3581 * sqrt(1.0 / (SELECT count(*) FROM r) + 1.0 / (SELECT count(*) FROM c)) AS INT) + CAST(jsd > 0.1 AS INT) >= 2 ELSE psi > 0.25 END AS drifted
FROM p JOIN k USING (feature) JOIN j USING (feature)""")
def drift_report(spark, d):
    out = D.drift_report(*_sides(spark, d), "l_extendedprice", FEATURES[1:])
    return rounded(rounded(rounded(out, ["psi"], 5), ["ks_stat", "jsd"]), ["ks_p"], 4)


@query(f"""WITH {_SIDES}, p AS ({_all(_psi_sql)}), k AS ({_ks_sql('l_extendedprice')}), j AS ({_jsd_sql('l_extendedprice')}),
x AS (SELECT CAST(psi > 0.2 AS INT) + CAST(ks > 1.3581 * sqrt(1.0 / (SELECT count(*) FROM r) + 1.0 / (SELECT count(*) FROM c)) AS INT) + CAST(jsd > 0.1 AS INT) >= 2 AS y FROM p JOIN k USING (feature) JOIN j USING (feature)),
f AS (SELECT count(*) AS n FROM p WHERE feature <> 'l_extendedprice' AND psi > 0.25)
SELECT y AS prediction_drift, n AS drifted_features, y OR n > 0 AS overall_drift FROM x, f""")
def overall_drift(spark, d):
    return D.overall_drift(D.drift_report(*_sides(spark, d), "l_extendedprice", FEATURES[1:]))


_IMP = "SELECT p_name AS feature, CAST(avg(p_size) AS DOUBLE) AS importance FROM part WHERE {w} GROUP BY 1"


@query(f"""WITH a AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM ({_IMP.format(w="p_type = 'ECONOMY'")})), b AS (SELECT *, row_number() OVER (ORDER BY importance DESC, feature) AS rank FROM ({_IMP.format(w="p_type = 'STANDARD'")})),
x AS (SELECT coalesce(a.feature, b.feature) AS feature, a.importance AS i1, a.rank AS r1, b.importance AS i2, b.rank AS r2 FROM a FULL JOIN b ON a.feature = b.feature)
SELECT feature, round(i2 - i1, 5) AS importance_change, round((i2 - i1) / (i1 + 1e-8) * 100, 4) AS importance_change_percent, CAST(r1 - r2 AS INT) AS rank_change,
 (abs((i2 - i1) / (i1 + 1e-8) * 100) > 50 OR abs(r1 - r2) > 5) AS significant FROM x""")
def importance_drift(spark, d):
    from stallwatch.operators.windows import importance_ranks

    def ranked(kind):
        p = table(spark, d, "part").filter(F.col("p_type") == kind)
        return importance_ranks(p.groupBy(F.col("p_name").alias("feature")).agg(F.avg("p_size").alias("importance")))

    out = D.importance_drift(ranked("ECONOMY"), ranked("STANDARD"))
    out = out.select("feature", "importance_change", "importance_change_percent", "rank_change", "significant")
    return rounded(rounded(out, ["importance_change"], 5), ["importance_change_percent"], 4)


@query("SELECT CASE WHEN p < 0.1 THEN '0.0-0.1' WHEN p < 0.3 THEN '0.1-0.3' WHEN p < 0.5 THEN '0.3-0.5' WHEN p < 0.7 THEN '0.5-0.7' ELSE '0.7-1.0' END AS band, count(*) AS n FROM (SELECT l_extendedprice / 105000.0 AS p FROM lineitem) GROUP BY 1")
def score_bands(spark, d):
    return D.band_distribution(predictions(spark, d), "score")


def _rolling_sql(events):
    return f"""
WITH o AS (SELECT event_type, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM ({events})),
r AS (SELECT event_type, v FROM o WHERE i <= 100 AND n >= 100), s AS (SELECT event_type, min(v) AS lo, max(v) AS hi FROM r GROUP BY 1),
k AS (SELECT DISTINCT o.event_type, CAST(j.j AS INT) AS check_at FROM o, range(100, 10000000, 10) j(j) WHERE j.j <= o.n AND o.i = 1),
cur AS (SELECT k.event_type, k.check_at, o.v FROM k JOIN o ON o.event_type = k.event_type AND o.i <= k.check_at AND o.i > k.check_at - 50),
rb AS (SELECT event_type, greatest(0, least(9, floor((v - lo) / (hi - lo) * 10)))::INT AS b, count(*) AS n FROM r JOIN s USING (event_type) GROUP BY 1, 2),
cb AS (SELECT event_type, check_at, greatest(0, least(9, floor((v - lo) / (hi - lo) * 10)))::INT AS b, count(*) AS n FROM cur JOIN s USING (event_type) GROUP BY 1, 2, 3),
g AS (SELECT k.event_type, k.check_at, (coalesce(rb.n, 0) + 1e-6) / (100 + 1e-5) AS rp, (coalesce(cb.n, 0) + 1e-6) / (50 + 1e-5) AS cp
 FROM k CROSS JOIN range(10) x(b) LEFT JOIN rb ON rb.event_type = k.event_type AND rb.b = x.b LEFT JOIN cb ON cb.event_type = k.event_type AND cb.check_at = k.check_at AND cb.b = x.b)
SELECT event_type, check_at, round(sum((cp - rp) * ln(cp / rp)), 5) AS psi,
 CASE WHEN sum((cp - rp) * ln(cp / rp)) < 0.1 THEN 'STABLE' WHEN sum((cp - rp) * ln(cp / rp)) < 0.25 THEN 'MODERATE SHIFT' ELSE 'SIGNIFICANT DRIFT' END AS label FROM g GROUP BY 1, 2"""


@query(_rolling_sql("SELECT * FROM events"))
def rolling_drift(spark, d):
    e = table(spark, d, "events")
    out = D.rolling_drift(e, series="event_type", order=micros("ts"), tie="event_id", score="value")
    return rounded(out.select("event_type", "check_at", "psi", "label"), ["psi"], 5)


@query(_rolling_sql("SELECT * FROM events WHERE event_id % 6 <> 0"))
def rolling_drift_with_gaps(spark, d):
    """Events without a score are no predictions: the checks are those of the others alone."""
    e = table(spark, d, "events").withColumn("value", F.when(F.col("event_id") % 6 != 0, F.col("value")))
    out = D.rolling_drift(e, series="event_type", order=micros("ts"), tie="event_id", score="value")
    return rounded(out.select("event_type", "check_at", "psi", "label"), ["psi"], 5)


def _changes(spark, d):
    e = lifecycle(spark, d).select("event_type", "ts", "event_id", (F.col("value") > 60).cast("double").alias("wrong"))
    shifted = e.withColumn("wrong", F.when(F.col("ts") > F.lit("2024-01-16").cast("timestamp_ntz"), 1.0).otherwise(F.col("wrong")))
    return C.detect_changes(shifted, series="event_type", order=["ts", "event_id"], error="wrong")


@query()
def sequential_detectors(spark, d):
    return _changes(spark, d)


@query()
def sequential_detector_counts(spark, d):
    return C.detector_counts(_changes(spark, d), "event_type")


@query()
def sequential_detectors_by_week(spark, d):
    e = lifecycle(spark, d).select("event_type", "ts", "event_id", (F.col("value") > 60).cast("double").alias("wrong"))
    return C.detect_changes(e, series="event_type", order=["ts", "event_id"], error="wrong", epoch=F.date_trunc("week", F.col("ts")))

"""Cluster features and association rules."""

from itertools import combinations

from pyspark.sql import functions as F

from stallwatch.catalog import query
from stallwatch.catalog.tables import rounded, table
from stallwatch.operators import rules as R
from stallwatch.operators.clusters import ClusterFeatures, training_cluster_features

SETTINGS = ClusterFeatures(identities=["l_suppkey", "l_orderkey"], power_from=8)
_CF = """coalesce({s} BETWEEN 2 AND 4, false) AS cf_{n}_is_small_cluster, coalesce({s} >= 8, false) AS cf_{n}_is_power_user, CAST(greatest(1, least(100, coalesce({s}, 1))) AS INT) AS cf_{n}_cluster_size"""


def _cluster_sql(fit, apply):
    return f"""WITH a AS (SELECT l_suppkey, count(*) AS sz FROM lineitem WHERE {fit} GROUP BY 1), b AS (SELECT l_orderkey, count(*) AS sz FROM lineitem WHERE {fit} GROUP BY 1),
x AS (SELECT {_CF.format(s='a.sz', n='l_suppkey')}, {_CF.format(s='b.sz', n='l_orderkey')} FROM lineitem l LEFT JOIN a ON l.l_suppkey = a.l_suppkey LEFT JOIN b ON l.l_orderkey = b.l_orderkey WHERE {apply})
SELECT *, CAST(cf_l_suppkey_is_small_cluster AS INT) + CAST(cf_l_orderkey_is_small_cluster AS INT) AS cf_small_cluster_count, cf_l_suppkey_is_small_cluster OR cf_l_orderkey_is_small_cluster AS cf_any_small_cluster,
 CAST(cf_l_suppkey_is_power_user AS INT) + CAST(cf_l_orderkey_is_power_user AS INT) AS cf_power_user_count, count(*) AS n FROM x GROUP BY ALL"""


def _counted(df):
    columns = [c for c in df.columns if c.startswith("cf_")]
    return df.groupBy(*columns).agg(F.count(F.lit(1)).alias("n"))


@query(_cluster_sql("l_linestatus = 'F'", "l_linestatus = 'O'"))
def cluster_features(spark, d):
    li = table(spark, d, "lineitem").select("l_suppkey", "l_orderkey", "l_linestatus")
    return _counted(SETTINGS.fit(li.filter("l_linestatus = 'F'")).transform(li.filter("l_linestatus = 'O'")))


@query(_cluster_sql("true", "true"))
def training_cluster_features_of_lines(spark, d):
    return _counted(training_cluster_features(table(spark, d, "lineitem").select("l_suppkey", "l_orderkey"), SETTINGS))


FLAGS = {
    "air": "l_tax > 0.04",
    "bulk": "l_quantity > 30",
    "cheap": "l_extendedprice < 20000",
    "closed": "l_linestatus = 'F'",
    "discounted": "l_discount >= 0.08",
    "late": "year(l_shipdate) >= 2000",
}
LABEL = "(l_discount >= 0.08 AND l_quantity > 30) OR l_returnflag = 'R' AND l_tax > 0.07"


def _flagged(spark, d):
    return table(spark, d, "lineitem").select(*[F.expr(e).alias(n) for n, e in FLAGS.items()], F.expr(LABEL).cast("int").alias("y"))


_SETS = [c for size in range(1, 5) for c in combinations(sorted(FLAGS), size)]
_COUNTED = "c AS (" + "\nUNION ALL ".join(
    f"SELECT '{'+'.join(s)}' AS items, CAST({len(s)} AS INT) AS size, count(*) FILTER ({' AND '.join(s)}) AS n, count(*) FILTER ({' AND '.join(s)} AND y) AS hits FROM f" for s in _SETS
) + ")"
_F = "f AS (SELECT " + ", ".join(f"{e} AS {n}" for n, e in FLAGS.items()) + f", {LABEL} AS y FROM lineitem)"


@query(f"WITH {_F}, {_COUNTED} SELECT items, size, n, round(n / (SELECT count(*) FROM f), 6) AS support FROM c WHERE n / (SELECT count(*) FROM f) >= 0.03")
def frequent_itemsets(spark, d):
    out = R.frequent_itemsets(_flagged(spark, d), list(FLAGS), "y", min_support=0.03)
    return rounded(out.select(F.array_join("antecedent", "+").alias("items"), "size", "n", "support"), ["support"])


_MANY = [("supp", "l_suppkey", k) for k in range(2, 17)] + [("part", "l_partkey", k) for k in range(2, 17)]
_MANY_SQL = f"""WITH r AS (SELECT row_number() OVER () AS i, *, {LABEL} AS y FROM lineitem), t AS (SELECT count(*) AS total FROM r),
m AS ({" UNION ALL ".join(f"SELECT i, y, '{name}_{k:02d}' AS f FROM r WHERE {column} % {k} = 0" for name, column, k in _MANY)}),
c AS (SELECT f AS items, 1 AS size, count(*) AS n, count(*) FILTER (y) AS hits FROM m GROUP BY 1
 UNION ALL SELECT a.f || '+' || b.f, 2, count(*), count(*) FILTER (a.y) FROM m a JOIN m b ON a.i = b.i AND a.f < b.f GROUP BY 1
 UNION ALL SELECT a.f || '+' || b.f || '+' || c.f, 3, count(*), count(*) FILTER (a.y) FROM m a JOIN m b ON a.i = b.i AND a.f < b.f JOIN m c ON c.i = a.i AND b.f < c.f GROUP BY 1)
SELECT items, CAST(size AS INT) AS size, n, hits FROM c, t WHERE n / total >= 0.01"""


@query(_MANY_SQL)
def itemsets_of_many_flags(spark, d):
    """Thirty flags, by projected prefixes."""
    rows = table(spark, d, "lineitem").select(*[(F.col(column) % k == 0).alias(f"{name}_{k:02d}") for name, column, k in _MANY], F.expr(LABEL).cast("int").alias("y"))
    out = R.itemset_counts(rows, [f"{name}_{k:02d}" for name, _, k in _MANY], "y", min_support=0.01, max_size=3)
    return out.select(F.array_join("antecedent", "+").alias("items"), "size", "n", "hits")


_RULES = f"""WITH {_F}, {_COUNTED}, b AS (SELECT count(*) AS total, avg(CAST(y AS INT)) AS rate FROM f)
SELECT items, round(n / total, 6) AS support, round(hits / n, 6) AS confidence, round(hits / n / rate, 6) AS lift, n FROM c, b
WHERE n / total >= 0.001 AND n >= 10 AND hits / n >= 0.5 AND hits / n / rate >= 2"""


def _rules(spark, d):
    return R.class_rules(_flagged(spark, d), list(FLAGS), "y")


@query(_RULES)
def class_rules(spark, d):
    out = _rules(spark, d).select(F.array_join("antecedent", "+").alias("items"), "support", "confidence", "lift", "n")
    return rounded(out, ["support", "confidence", "lift"])


@query(f"SELECT items, n FROM (SELECT * FROM ({_RULES.replace('round(hits / n / rate, 6) AS lift', 'hits / n / rate AS lift')}) ORDER BY lift DESC, n DESC, replace(items, '+', ',') LIMIT 5)")
def top_rules(spark, d):
    return R.top_rules(_rules(spark, d), 5).select(F.array_join("antecedent", "+").alias("items"), "n")


_MATCHED = f"""{_RULES.replace('round(hits / n / rate, 6) AS lift', 'hits / n / rate AS lift').replace('WITH ', 'WITH k AS (SELECT row_number() OVER (ORDER BY lift DESC, n DESC, replace(items, chr(43), chr(44))) AS i, items FROM (WITH ', 1)}) ORDER BY i LIMIT 10),
{_F}, x AS (SELECT *, row_number() OVER () AS row FROM f)"""


@query(f"""
{_MATCHED}, m AS (SELECT x.row, list_sort(list(k.i) FILTER ({" AND ".join(f"(NOT list_contains(string_split(items, '+'), '{n}') OR {n})" for n in FLAGS)})) AS matched FROM x, k GROUP BY 1)
SELECT array_to_string(coalesce(matched, []), ',') AS matched, count(*) AS n FROM m GROUP BY 1""")
def rule_matches(spark, d):
    """How many rows match which of the ten strongest rules."""
    flagged = _flagged(spark, d)
    out = R.rule_features(flagged, _rules(spark, d), 10)
    names = sorted((c for c in out.columns if c.startswith("rule_")), key=lambda c: int(c.split("_")[1]))
    hits = F.concat_ws(",", *[F.when(F.col(c), F.lit(str(i))) for i, c in enumerate(names, start=1)])
    return out.groupBy(hits.alias("matched")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""
{_MATCHED}, m AS (SELECT x.row, any_value(x.y) AS y, coalesce(list(k.i) FILTER ({" AND ".join(f"(NOT list_contains(string_split(items, '+'), '{n}') OR {n})" for n in FLAGS)}), []) AS matched FROM x, k GROUP BY 1)
SELECT {", ".join(f"list_contains(matched, {i}) AS rule_{i}_match" for i in range(1, 11))}, count(*) AS n, round(avg(CAST(y AS INT)), 6) AS rate FROM m GROUP BY {", ".join(map(str, range(1, 11)))}""")
def rule_match_features(spark, d):
    flagged = _flagged(spark, d)
    out = R.rule_features(flagged, _rules(spark, d), 10)
    grouped = out.groupBy(*[c for c in out.columns if c.startswith("rule_")]).agg(F.count(F.lit(1)).alias("n"), F.avg("y").alias("rate"))
    return rounded(grouped, ["rate"])

"""Entity-sharing graph queries."""

from pyspark.sql import functions as F

from stallwatch.catalog import query
from stallwatch.catalog.tables import LIFECYCLE_SQL, LISTINGS_SQL, lifecycle, listings, r, rounded, table
from stallwatch.operators import graph as G
from stallwatch.operators.windows import identity_history
from stallwatch.session import cut_lineage

ENTITIES = {"supplier": ["l_suppkey"], "part": ["l_partkey"]}
CAP = 100


def _edges_sql(cap=CAP, where="true"):
    return f"""SELECT 'customer' AS identity_type, src, dst, src_time, dst_time FROM (
 SELECT a.o_orderkey AS src, b.o_orderkey AS dst, a.o_orderdate AS src_time, b.o_orderdate AS dst_time, row_number() OVER (PARTITION BY a.o_orderkey ORDER BY b.o_orderdate, b.o_orderkey) AS rn
 FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND a.o_orderdate < b.o_orderdate WHERE {where}) WHERE rn <= {cap}"""


def _edges(spark, d, cap=CAP):
    """Edges as operators on top of them get them: stored once. Without a cap the operator's own holds."""
    settings = {} if cap is None else {"cap": cap}
    return cut_lineage(G.sharing_edges(listings(spark, d), entity="o_orderkey", time="o_orderdate", identities={"customer": ["o_custkey"]}, **settings))


@query(_edges_sql())
def sharing_edges(spark, d):
    return G.sharing_edges(listings(spark, d), entity="o_orderkey", time="o_orderdate", identities={"customer": ["o_custkey"]}, cap=CAP)


@query(_edges_sql(CAP, "b.o_orderdate <= TIMESTAMP '1998-06-30'"))
def sharing_edges_as_of(spark, d):
    from datetime import datetime

    known = G.as_of(listings(spark, d), "o_orderdate", datetime(1998, 6, 30))
    return G.sharing_edges(known, entity="o_orderkey", time="o_orderdate", identities={"customer": ["o_custkey"]}, cap=CAP)


_HUB_SQL = """WITH m AS (SELECT k, user_id, min(ts) OVER (PARTITION BY user_id) AS t FROM (SELECT CAST(json_extract(props, '$.k') AS BIGINT) AS k, user_id, ts FROM events)),
p AS (SELECT DISTINCT 'k' AS kind, CAST(k AS VARCHAR) AS identity, user_id, t FROM m UNION SELECT DISTINCT 'type', event_type, user_id, min(ts) OVER (PARTITION BY user_id) FROM events)
SELECT a.kind AS identity_type, CAST(a.user_id AS BIGINT) AS src, CAST(b.user_id AS BIGINT) AS dst, count(*) AS shared
FROM p a JOIN p b ON a.kind = b.kind AND a.identity = b.identity AND a.t < b.t GROUP BY 1, 2, 3"""


@query(_HUB_SQL)
def sharing_edges_of_hubs(spark, d):
    """All pairs of users by what they share, however many share it."""
    e = lifecycle(spark, d)
    return G.sharing_counts(e, entity="user_id", time="ts", identities={"k": ["k"], "type": ["event_type"]})


@query("""
SELECT 'listing' AS node_type, CAST(l_orderkey AS VARCHAR) AS node_id, count(*) AS occurrences FROM lineitem GROUP BY 2
UNION ALL SELECT 'supplier', CAST(l_suppkey AS VARCHAR), count(*) FROM lineitem GROUP BY 2 HAVING count(*) >= 2
UNION ALL SELECT 'part', CAST(l_partkey AS VARCHAR), count(*) FROM lineitem GROUP BY 2 HAVING count(*) >= 2""")
def graph_nodes(spark, d):
    return G.nodes(table(spark, d, "lineitem"), "l_orderkey", ENTITIES, min_count=2)


_USED = """SELECT DISTINCT 'used_supplier' AS edge_type, CAST(l_orderkey AS VARCHAR) AS src, CAST(l_suppkey AS VARCHAR) AS dst FROM lineitem
UNION ALL SELECT DISTINCT 'used_part', CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR) FROM lineitem"""


@query(f"SELECT * FROM ({_USED}) UNION ALL SELECT 'rev_' || edge_type, dst, src FROM ({_USED})")
def used_edges_both_ways(spark, d):
    return G.with_reverse(G.used_edges(table(spark, d, "lineitem"), "l_orderkey", ENTITIES))


@query(f"""
WITH e AS ({_USED}), n AS (SELECT 'listing' AS t, count(DISTINCT l_orderkey) AS n FROM lineitem UNION ALL SELECT 'supplier', count(DISTINCT l_suppkey) FROM lineitem UNION ALL SELECT 'part', count(DISTINCT l_partkey) FROM lineitem)
SELECT 'nodes' AS kind, t AS name, n FROM n UNION ALL SELECT 'nodes', 'total', CAST(sum(n) AS BIGINT) FROM n
UNION ALL SELECT 'edges', edge_type, count(*) FROM e GROUP BY 2 UNION ALL SELECT 'edges', 'total', count(*) FROM e""")
def graph_statistics(spark, d):
    li = table(spark, d, "lineitem")
    return G.graph_statistics(G.nodes(li, "l_orderkey", ENTITIES), G.used_edges(li, "l_orderkey", ENTITIES))


@query(f"""
WITH k AS (SELECT * FROM orders WHERE o_orderdate <= TIMESTAMP '1998-06-30'), s AS ({_edges_sql(CAP, "b.o_orderdate <= TIMESTAMP '1998-06-30'")}),
u AS (SELECT DISTINCT o_orderkey, o_custkey FROM k)
SELECT 'listing' AS part, count(DISTINCT o_orderkey) AS n FROM k UNION ALL SELECT 'customer', count(DISTINCT o_custkey) FROM k
UNION ALL SELECT 'used_customer', count(*) FROM u UNION ALL SELECT 'rev_used_customer', count(*) FROM u UNION ALL SELECT 'sharing', count(*) FROM s""")
def whole_graph_as_of(spark, d):
    from datetime import datetime

    columns = {"customer": ["o_custkey"]}
    g = G.build_graph(listings(spark, d), entity="o_orderkey", time="o_orderdate", cutoff=datetime(1998, 6, 30), entity_columns=columns, identities=columns, cap=CAP)
    count = F.count(F.lit(1)).alias("n")
    parts = g.nodes.groupBy(F.col("node_type").alias("part")).agg(count).unionByName(g.used.groupBy(F.col("edge_type").alias("part")).agg(count))
    return parts.unionByName(g.sharing.agg(F.lit("sharing").alias("part"), count))


@query(f"""
SELECT identity_type, count(*) AS edges, round(avg(CAST(a.label + b.label = 2 AS INT)), 6) AS both_positive, round(avg(CAST(a.label + b.label = 0 AS INT)), 6) AS both_negative, round(avg(CAST(a.label + b.label = 1 AS INT)), 6) AS mixed
FROM ({_edges_sql()}) e JOIN ({LISTINGS_SQL}) a ON src = a.o_orderkey JOIN ({LISTINGS_SQL}) b ON dst = b.o_orderkey GROUP BY 1""")
def edge_homophily(spark, d):
    out = G.homophily(_edges(spark, d), listings(spark, d), "o_orderkey", "label")
    return rounded(out, ["both_positive", "both_negative", "mixed"])


_LINK_PARTS = "p{i} AS (SELECT {c} AS k, user_id, min(ts) AS seen FROM e WHERE {c} IS NOT NULL GROUP BY 1, 2), l{i} AS (SELECT e.event_id, count(*) FILTER (p.seen < e.ts AND p.user_id <> e.user_id) AS n FROM e JOIN p{i} p ON e.{c} = p.k GROUP BY 1)"


_GAP_EVENTS = f"SELECT * REPLACE (CASE WHEN event_id % 7 <> 0 THEN ts END AS ts, nullif(k, 3) AS k) FROM ({LIFECYCLE_SQL})"


@query(f"""WITH e AS ({_GAP_EVENTS}), {_LINK_PARTS.format(i=1, c='k')}, {_LINK_PARTS.format(i=2, c='event_type')}
SELECT e.event_id, coalesce(l1.n, 0) AS k_links, coalesce(l2.n, 0) AS type_links FROM e LEFT JOIN l1 USING (event_id) LEFT JOIN l2 USING (event_id)""")
def link_counts_with_gaps(spark, d):
    """Events without a time, or without an identity, keep their row and have no links."""
    e = lifecycle(spark, d).withColumns({"ts": F.when(F.col("event_id") % 7 != 0, F.col("ts")), "k": F.nullif(F.col("k"), F.lit(3))})
    return G.link_counts(e, identities={"k": "k", "type": "event_type"}, entity="user_id", time="ts", row_id="event_id")


@query(f"WITH e AS ({LIFECYCLE_SQL}), {_LINK_PARTS.format(i=1, c='k')}, {_LINK_PARTS.format(i=2, c='event_type')} SELECT event_id, l1.n AS k_links, l2.n AS type_links FROM l1 JOIN l2 USING (event_id)")
def link_counts_before_event(spark, d):
    return G.link_counts(lifecycle(spark, d), identities={"k": "k", "type": "event_type"}, entity="user_id", time="ts", row_id="event_id")


@query(f"""
WITH h AS (SELECT o_orderkey, sum(label) OVER w / nullif(count(*) OVER w, 0) AS rate FROM ({LISTINGS_SQL}) WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate RANGE BETWEEN UNBOUNDED PRECEDING AND INTERVAL '1 microsecond' PRECEDING))
SELECT identity_type, src, dst, src_time, dst_time FROM ({_edges_sql()}) e JOIN h a ON a.o_orderkey = src JOIN h b ON b.o_orderkey = dst WHERE greatest(coalesce(a.rate, 0), coalesce(b.rate, 0)) > 0.15""")
def edges_with_history(spark, d):
    o = listings(spark, d).withColumn("flag_ts", F.when(F.col("label") == 1, F.col("o_orderdate")))
    h = identity_history(o, identity="o_custkey", entity="o_orderkey", time="o_orderdate", flag="flag_ts")
    rates = h.select("o_orderkey", F.col("prior_flagged_rate").alias("rate"))
    edges = G.sharing_edges(o, entity="o_orderkey", time="o_orderdate", identities={"customer": ["o_custkey"]}, cap=CAP, about=rates)
    return G.with_risky_end(edges, "src_rate", "dst_rate")


@query(f"""
WITH e AS ({LIFECYCLE_SQL}), p AS (SELECT user_id, CAST(max(label) AS DOUBLE) AS label, avg(CASE WHEN k < 3 THEN value END) AS rare, CAST(arg_min(k, event_id) AS DOUBLE) AS k, count(*) AS event_count, min(ts) AS t FROM e GROUP BY 1),
s AS (SELECT min(epoch_us(t)) AS lo, max(epoch_us(t)) AS hi FROM p)
SELECT user_id, label, round(coalesce(rare, (SELECT median(rare) FROM p)), 6) AS rare, k, event_count, round((epoch_us(t) - lo) / (hi - lo), 6) AS relative_position,
 round(cos(2 * pi() * hour(t) / 24), 6) AS hour_cos, round(ln(1 + event_count), 6) AS log_event_count FROM p, s""")
def listing_node_features(spark, d):
    e = lifecycle(spark, d).withColumn("rare", F.when(F.col("k") < 3, F.col("value")))
    out = G.listing_node_features(e, entity="user_id", time="ts", tie="event_id", maxima=["label"], means=["rare"], firsts=["k"])
    kept = ["user_id", "label", "rare", "k", "event_count", "relative_position", "hour_cos", "log_event_count"]
    return rounded(out.select(kept), ["rare", "relative_position", "hour_cos", "log_event_count"])


def _vectors(spark, d):
    return table(spark, d, "embeddings").withColumn("at", F.timestamp_seconds("vec_id"))


def _vector_edges(spark, d):
    return cut_lineage(G.sharing_edges(_vectors(spark, d), entity="vec_id", time="at", identities={"label": ["label"]}, cap=CAP))


_VEC = "v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM embeddings), g AS (SELECT a.vec_id AS src, b.vec_id AS dst FROM v a JOIN v b ON a.label = b.label AND b.rn > a.rn AND b.rn <= a.rn + 100)"


@query(f"""
WITH {_VEC}, h1 AS (SELECT v.vec_id, coalesce(avg(s.e[1]), 0) AS x, coalesce(avg(s.e[64]), 0) AS z FROM v LEFT JOIN g ON g.dst = v.vec_id LEFT JOIN v s ON s.vec_id = g.src GROUP BY 1),
h2 AS (SELECT v.vec_id, coalesce(avg(s.x), 0) AS x FROM v LEFT JOIN g ON g.dst = v.vec_id LEFT JOIN h1 s ON s.vec_id = g.src GROUP BY 1)
SELECT vec_id, round(h1.x, 6) AS hop_1_first, round(h1.z, 6) AS hop_1_last, round(h2.x, 6) AS hop_2_first FROM h1 JOIN h2 USING (vec_id)""")
def neighbour_means(spark, d):
    out = G.neighbour_means(_vector_edges(spark, d), _vectors(spark, d), key="vec_id", vector="embedding", size=64, hops=2)
    return out.select("vec_id", r(F.col("hop_1")[0]).alias("hop_1_first"), r(F.col("hop_1")[63]).alias("hop_1_last"), r(F.col("hop_2")[0]).alias("hop_2_first"))


@query(f"""
WITH {_VEC}, w AS (SELECT g.dst AS vec_id, s.e[1] AS x, greatest(0, list_cosine_similarity(s.e, t.e)) AS w FROM g JOIN v s ON s.vec_id = g.src JOIN v t ON t.vec_id = g.dst)
SELECT vec_id, round(sum(w), 5) AS weight, round(CASE WHEN sum(w) > 0 THEN sum(w * x) / sum(w) ELSE 0 END, 5) AS first_value FROM w GROUP BY 1""")
def similarity_weighted_means(spark, d):
    v = _vectors(spark, d)
    edges = G.sharing_edges(v, entity="vec_id", time="at", identities={"label": ["label"]}, cap=CAP, about=v.select("vec_id", "embedding"))
    out = G.similarity_weighted_means(edges, v, key="vec_id", vector="embedding", size=64)
    return out.select("vec_id", r("weight", 5).alias("weight"), r(F.col("neighbour_mean")[0], 5).alias("first_value"))


def _drawn_sql(seed, *parts):
    return f"('0x' || substr(md5(concat_ws('|', '{seed}', {', '.join(parts)})), 1, 15))::BIGINT"


_HOP = "SELECT {hop} AS hop, identity_type, src, dst FROM (SELECT g.*, row_number() OVER (PARTITION BY dst, identity_type ORDER BY " + _drawn_sql(42, "src", "dst") + ", src) AS rn FROM (SELECT DISTINCT identity_type, src, dst FROM g) g WHERE dst IN (SELECT n FROM {seeds})) WHERE rn <= {fanout}"


@query(f"""WITH g AS ({_edges_sql()}), s AS (SELECT o_orderkey AS n FROM orders), h1 AS ({_HOP.format(hop=1, seeds='s', fanout=15)}), f AS (SELECT DISTINCT src AS n FROM h1), h2 AS ({_HOP.format(hop=2, seeds='f', fanout=10)})
SELECT CAST(hop AS INT) AS hop, identity_type, src, dst FROM h1 UNION ALL SELECT CAST(hop AS INT), identity_type, src, dst FROM h2""")
def sampled_neighbours(spark, d):
    return G.sample_neighbours(_edges(spark, d, None), [15, 10], listings(spark, d).select("o_orderkey"))


@query(f"""
WITH p AS (SELECT DISTINCT src, dst FROM ({_edges_sql()})), n AS (SELECT o_orderkey AS k, row_number() OVER (ORDER BY {_drawn_sql(42, 'o_orderkey')}, o_orderkey) AS rn FROM orders), t AS (SELECT count(*) AS n FROM orders),
d AS ({" UNION ".join(f"SELECT {_drawn_sql(42 + 2 * k + 1, 'src', 'dst')} % n + 1 AS i, {_drawn_sql(42 + 2 * k + 2, 'src', 'dst')} % n + 1 AS j FROM p, t" for k in range(3))}),
f AS (SELECT DISTINCT a.k AS src, b.k AS dst FROM d JOIN n a ON a.rn = i JOIN n b ON b.rn = j WHERE a.k <> b.k), r AS (SELECT src, dst FROM f ANTI JOIN p USING (src, dst))
SELECT src, dst, CAST(1 AS INT) AS label FROM p
UNION ALL SELECT src, dst, CAST(0 AS INT) FROM (SELECT src, dst, row_number() OVER (ORDER BY {_drawn_sql(42, 'src', 'dst')}, src, dst) AS rn FROM r) WHERE rn <= (SELECT count(*) FROM p)""")
def link_prediction_samples(spark, d):
    o = listings(spark, d)
    edges = G.sharing_edges(o, entity="o_orderkey", time="o_orderdate", identities={"customer": ["o_custkey"]})  # read once
    return G.link_samples(edges, o, "o_orderkey")


@query(f"""WITH k AS (SELECT o_orderkey, o_orderdate, CASE id WHEN 'customer' THEN o_custkey ELSE o_custkey % 40 END AS v, id FROM orders, (VALUES ('customer'), ('household')) i(id) WHERE o_orderdate <= TIMESTAMP '1996-12-31')
SELECT identity_type, src, dst FROM (SELECT a.id AS identity_type, a.o_orderkey AS src, b.o_orderkey AS dst, row_number() OVER (PARTITION BY a.id, a.o_orderkey ORDER BY b.o_orderdate, b.o_orderkey) AS rn
 FROM k a JOIN k b ON a.id = b.id AND a.v = b.v AND a.o_orderdate < b.o_orderdate) WHERE rn <= 50""")
def listing_only_graph(spark, d):
    """The graph of listings alone, over two identities, as of a cutoff."""
    from datetime import datetime

    o = listings(spark, d).select("o_orderkey", "o_orderdate", F.col("o_custkey").alias("customer"), (F.col("o_custkey") % 40).alias("household"))
    return G.listing_graph(o, entity="o_orderkey", time="o_orderdate", cutoff=datetime(1996, 12, 31), identities=["customer", "household"]).select("identity_type", "src", "dst")


@query("""WITH RECURSIVE n AS (SELECT p_partkey AS k, row_number() OVER (ORDER BY p_partkey) - 1 AS i FROM part), e AS (SELECT a.k AS a, b.k AS b FROM n a JOIN n b ON abs(a.i - b.i) = 1 AND a.i // 60 = b.i // 60),
r AS (SELECT k, k AS c FROM n UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.k) SELECT k AS p_partkey, min(c) AS component FROM r GROUP BY 1""")
def components_of_chains(spark, d):
    """Chains of sixty parts, each sharing something with the next only: several rounds of contraction."""
    from stallwatch.plans.ordered import numbered

    n = numbered(table(spark, d, "part").select("p_partkey"), [], F.col("p_partkey"), [], "i").withColumn("i", F.col("i") - 1)
    chain, link = F.floor(F.col("i") / 60), F.col("i") % 60
    shared = F.explode(F.array(F.concat_ws("-", chain, link), F.concat_ws("-", chain, link + 1)))
    return G.components(n.select("p_partkey", shared.alias("what")), "p_partkey", "what")


@query("SELECT o_orderkey, min(o_orderkey) OVER (PARTITION BY o_custkey) AS component FROM orders")
def components_by_customer(spark, d):
    return G.components(listings(spark, d), "o_orderkey", "o_custkey")


@query(f"""
SELECT min(o_orderkey) AS component, count(*) AS size, CAST(sum(label) AS BIGINT) AS positives, round(avg(label), 6) AS rate FROM ({LISTINGS_SQL}) GROUP BY o_custkey HAVING count(*) >= 3""")
def rings(spark, d):
    o = listings(spark, d)
    return rounded(G.rings(G.components(o, "o_orderkey", "o_custkey"), o, "o_orderkey", "label", min_size=3), ["rate"])


@query(f"""WITH RECURSIVE m AS (SELECT DISTINCT user_id, k FROM ({LIFECYCLE_SQL})), e AS (SELECT DISTINCT a.user_id AS a, b.user_id AS b FROM m a JOIN m b ON a.k = b.k AND a.user_id <> b.user_id),
r AS (SELECT DISTINCT user_id AS u, user_id AS c FROM m UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.u) SELECT u AS user_id, min(c) AS component FROM r GROUP BY 1""")
def components_by_shared_value(spark, d):
    return G.components(lifecycle(spark, d), "user_id", "k")

"""Graph, clusters, rules, models and explanations on small tables against brute force."""

import itertools
import math
import random
from datetime import datetime, timedelta
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from stallwatch.operators import explain as X
from stallwatch.operators import graph as G
from stallwatch.operators import models as M
from stallwatch.operators import rules as R
from stallwatch.operators.clusters import ClusterFeatures
from stallwatch.operators.windows import identity_history
from stallwatch.registry import FEATURE_ROLES, NODE_ROLES, Registry, Role, Variant, project_variant

T0 = datetime(2024, 1, 1)


def members(spark, data):
    return spark.createDataFrame([(e, i, None if t is None else T0 + timedelta(hours=t)) for e, i, t in data], "entity string, identity string, ts timestamp")


def brute_edges(data, cap):
    start = {}
    for e, _, t in data:
        start[e] = min(start.get(e, t), t)
    out = set()
    for identity in {i for _, i, _ in data if i and i.strip()}:
        ids = sorted({e for e, i, _ in data if i == identity}, key=lambda e: (start[e], e))
        for e in ids:
            out |= {(e, x) for x in [x for x in ids if start[x] > start[e]][:cap]}
    return out


@pytest.mark.parametrize("cap", [1, 3, 100])
def test_sharing_edges_match_a_loop_with_ties_and_a_hub(spark, cap):
    rng = random.Random(cap)
    data = [(f"e{rng.randrange(60)}", rng.choice(["hub", "hub", "a", "b", "", None]), rng.randrange(15)) for _ in range(250)]
    edges = G.sharing_edges(members(spark, data), entity="entity", time="ts", identities={"x": ["identity"]}, cap=cap, slices=5)
    found = edges.collect()
    assert all(r["src_time"] < r["dst_time"] for r in found)
    per_source = edges.groupBy("src").count().agg(F.max("count")).first()[0]
    assert per_source <= cap * 3
    assert {(r["src"], r["dst"]) for r in found} == brute_edges(data, cap)


def test_identity_columns_of_one_kind_are_united_and_empty_input_gives_no_edges(spark):
    df = spark.createDataFrame([("a", "x", None, T0), ("b", None, "x", T0 + timedelta(1))], "entity string, one string, two string, ts timestamp")
    made = G.sharing_edges(df, entity="entity", time="ts", identities={"k": ["one", "two", "absent"]})
    assert [(r["identity_type"], r["src"], r["dst"]) for r in made.collect()] == [("k", "a", "b")]
    assert G.sharing_edges(df.limit(0), entity="entity", time="ts", identities={"k": ["one"]}).count() == 0


def test_components_match_union_find(spark):
    rng = random.Random(9)
    pairs = [(rng.randrange(80), rng.choice([None, *range(45)])) for _ in range(110)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for e, i in pairs:
        find(("e", e))
        if i is not None:
            parent[find(("e", e))] = find(("i", i))
    groups = {}
    for e in {e for e, _ in pairs}:
        groups.setdefault(find(("e", e)), []).append(e)
    want = {e: min(g) for g in groups.values() for e in g}
    got = G.components(spark.createDataFrame(pairs, "e long, i long"), "e", "i")
    assert {r["e"]: r["component"] for r in got.collect()} == want


def test_long_chains_settle_quickly(spark):
    pairs = [(e, i) for i in range(60) for e in (i, i + 1)]
    got = G.components(spark.createDataFrame(pairs, "e long, i long"), "e", "i", max_rounds=12)
    assert got.select("component").distinct().collect() == [(0,)]


def test_history_counts_flags_from_the_moment_they_are_raised(spark):
    h = lambda n: T0 + timedelta(hours=n)
    df = spark.createDataFrame(
        [(0, "a", "x", h(0), h(5)), (1, "b", "x", h(3), None), (2, "c", "x", h(6), None), (3, "a", "x", h(7), h(5)), (4, "d", None, h(8), None), (5, "c", "x", h(6), None)],
        "row int, entity string, identity string, ts timestamp, flag timestamp",
    )
    got = {r["row"]: (r["prior_entities"], r["prior_flagged"]) for r in identity_history(df, identity="identity", entity="entity", time="ts", flag="flag").collect()}
    assert got == {0: (0, 0), 1: (1, 0), 2: (2, 1), 5: (2, 1), 3: (2, 0), 4: (0, 0)}


def test_neighbour_sampling_is_bounded_and_repeatable(spark):
    edges = spark.createDataFrame([("t", f"s{i}", "hub") for i in range(40)] + [("t", f"x{i}", f"s{i % 40}") for i in range(200)], "identity_type string, src string, dst string")
    seeds = spark.createDataFrame([("hub",)], "n string")
    first = {tuple(r) for r in G.sample_neighbours(edges, [15, 3], seeds).collect()}
    assert first == {tuple(r) for r in G.sample_neighbours(edges.repartition(3), [15, 3], seeds).collect()}
    assert sum(r[0] == 1 for r in first) == 15 and all(sum(r[0] == 2 and r[3] == d for r in first) <= 3 for d in {r[3] for r in first})


def test_negative_links_avoid_edges_and_self_pairs(spark):
    nodes = spark.range(30).select(F.col("id").alias("n"))
    edges = nodes.select(F.col("n").alias("src"), ((F.col("n") + 1) % 30).alias("dst"))
    got = G.link_samples(edges, nodes, "n").collect()
    real = {(r["src"], r["dst"]) for r in edges.collect()}
    fake = {(r["src"], r["dst"]) for r in got if r["label"] == 0}
    assert sum(r["label"] for r in got) == 30 and len(fake) == 30 and not fake & real and all(a != b for a, b in fake)


def test_cluster_buckets_and_unseen_identities(spark):
    history = spark.createDataFrame([(f"i{n}",) for n in (1, 2, 4, 5, 9, 10, 101) for _ in range(n)], "`session/device_hash` string")
    model = ClusterFeatures(["session/device_hash", "absent"]).fit(history)
    fresh = spark.createDataFrame([(f"i{n}",) for n in (1, 2, 4, 5, 9, 10, 101)] + [("new",), (None,)], "`session/device_hash` string")
    got = {r["session/device_hash"]: r for r in model.transform(fresh).collect()}
    assert len(got) == 9
    small = {k for k, r in got.items() if r["cf_session_device_is_small_cluster"]}
    power = {k for k, r in got.items() if r["cf_session_device_is_power_user"]}
    assert small == {"i2", "i4"} and power == {"i10", "i101"}
    assert got["i101"]["cf_session_device_cluster_size"] == 100 and got["new"]["cf_session_device_cluster_size"] == 1
    assert got["i2"]["cf_any_small_cluster"] and got["i10"]["cf_power_user_count"] == 1


def test_projected_prefixes_give_the_exact_sets(spark):
    rng = random.Random(3)
    names = [f"f{i:02d}" for i in range(30)]
    rows = [tuple((rng.random() < 0.5 / (1 + i % 6)) if rng.random() > 0.05 else None for i in range(30)) + (rng.choice([0, 1, None]),) for _ in range(400)] + [tuple([True] * 12 + [False] * 18 + [1])] * 150
    df = spark.createDataFrame(rows, ", ".join(f"{n} boolean" for n in names) + ", y int")
    want = {}
    for size in range(1, 5):
        for combo in itertools.combinations(range(30), size):
            hit = [r for r in rows if all(r[i] for i in combo)]
            if len(hit) / len(rows) >= 0.1:
                want[tuple(names[i] for i in combo)] = (size, len(hit), sum(r[-1] or 0 for r in hit), len(rows), sum(r[-1] or 0 for r in rows))
    got = {tuple(r.antecedent): tuple(r)[1:] for r in R.itemset_counts(df, names, "y", min_support=0.1).collect()}
    assert got == want and len(want) > 500
    assert R.itemset_counts(df.limit(0), names, "y").count() == 0 and R.itemset_counts(df, names, "y", min_support=1.1).count() == 0


def test_three_hundred_flags_end(spark):
    names = [f"f{i:03d}" for i in range(300)]
    df = spark.range(3000).select(*[(F.pmod(F.xxhash64("id", F.lit(i)), F.lit(40)) == 0).alias(n) for i, n in enumerate(names)], (F.col("id") % 3 == 0).cast("int").alias("y"))
    out = R.itemset_counts(df, names, "y", min_support=0.001).groupBy("size").count().collect()
    sizes = {r["size"]: r["count"] for r in out}
    assert sizes[1] == 300 and sizes[2] > 1000


def test_itemsets_and_rules_match_enumeration(spark):
    rng = random.Random(2)
    names = ["c", "a", "d", "b", "e"]
    data = []
    for _ in range(300):
        flags = [rng.choice([True, False, None]) for _ in names]
        data.append((*flags, int(bool(flags[0] and flags[1]) or rng.random() < 0.1)))
    df = spark.createDataFrame(data, ", ".join(f"{n} boolean" for n in names) + ", y int")
    base = sum(r[-1] for r in data) / 300
    sets, rules = {}, {}
    for size in range(1, 5):
        for combo in combinations(sorted(names), size):
            hit = [r for r in data if all(r[names.index(c)] for c in combo)]
            if len(hit) / 300 >= 0.03:
                sets[combo] = len(hit)
                confidence = sum(r[-1] for r in hit) / len(hit)
                if len(hit) >= 10 and confidence >= 0.5 and confidence / base >= 2:
                    rules[combo] = confidence
    found = R.frequent_itemsets(df, names, "y", min_support=0.03)
    assert {tuple(r["antecedent"]): r["n"] for r in found.collect()} == sets
    mined = R.class_rules(df, names, "y", min_support=0.03)
    assert {tuple(r["antecedent"]): pytest.approx(r["confidence"]) for r in mined.collect()} == rules and rules
    best = R.top_rules(mined, 1).first()["antecedent"]
    marked = R.rule_features(df, mined, 1)
    assert marked.filter("rule_1_match").count() == sum(all(r[names.index(c)] for c in best) for r in data)


def test_feature_counts_by_role():
    reg = Registry()
    assert (len(reg.of(Role.FLAG)), len(reg.of(Role.CATEGORY)), len(reg.of(*FEATURE_ROLES)), len(reg.of(*NODE_ROLES))) == (18, 25, 65, 36)
    assert len(reg.of(*FEATURE_ROLES - {Role.CATEGORY})) == 40
    assert set(reg.reads(Variant.GRAPH_VECTORS)) > set(reg.reads(Variant.BOOSTED))


def test_a_variant_reads_its_roles_and_patterns(spark):
    df = spark.createDataFrame([(1, 2.0, 0.1, 0.2, 3)], "id int, ip_latitude double, gf_degree double, graph_vec_0 double, other int")
    reads = {v: set(project_variant(df, v)[0].columns) for v in Variant}
    assert reads[Variant.FOREST] == {"id", "ip_latitude"}
    assert reads[Variant.GRAPH_FEATURES] == {"id", "ip_latitude", "gf_degree"} and reads[Variant.GRAPH_VECTORS] == {"id", "ip_latitude", "graph_vec_0"}
    assert "is_fraud" in project_variant(df, Variant.BOOSTED)[1]


@pytest.fixture(scope="module")
def fitted(spark):
    rng = random.Random(1)
    data = []
    for i in range(400):
        a, b, c = rng.random(), rng.choice([None, rng.random()]), rng.choice(["x", "y", "z", None])
        data.append((i, a, b, c, int(a > 0.6 and c != "x" or (b or 0) > 0.9)))
    df = spark.createDataFrame(data, "row_id long, a double, b double, c string, y int").cache()
    return df, M.fit_variant(df, "y", Variant.BOOSTED, numbers=["a", "b"], categories=["c"], maxIter=5, maxDepth=3, subsamplingRate=1.0)


def test_contributions_add_up_to_the_margin(fitted):
    df, model = fitted
    long, base = X.tree_contributions(model, df, "row_id")
    sums = {r["row_id"]: r["s"] for r in long.groupBy("row_id").agg(F.sum("contribution").alias("s")).collect()}
    predicted = {r["row_id"]: r[M.PROBABILITY] for r in model.predict(df).collect()}
    for row, p in predicted.items():
        margin = 0.5 * math.log(p / (1 - p))  # boosted trees turn a margin m into 1 / (1 + exp(-2 m))
        assert sums[row] + base == pytest.approx(margin, abs=1e-6)


def test_shapley_values_match_their_definition(fitted):
    df, model = fitted
    trees, weights = X.tree_leaves(model)
    x = np.array([[r[c] for c in model.inputs] for r in model.prepare(df).limit(3).select(*model.inputs).collect()], dtype=float)
    got, n = X._shap(x, trees, weights), len(model.inputs)

    def value(row, known):
        total = 0.0
        for leaves, w in zip(trees, weights):
            for leaf in leaves:
                share = 1.0
                for f, lo, hi, z in zip(leaf.features, leaf.low, leaf.high, leaf.shares):
                    share *= float(lo < row[f] <= hi) if f in known else z
                total += w * leaf.value * share
        return total

    for row, phi in zip(x, got):
        for j in range(n):
            rest, want = [k for k in range(n) if k != j], 0.0
            for size in range(n):
                for known in combinations(rest, size):
                    weight = math.factorial(size) * math.factorial(n - 1 - size) / math.factorial(n)
                    want += weight * (value(row, {*known, j}) - value(row, set(known)))
            assert phi[j] == pytest.approx(want, abs=1e-9)


def test_a_reloaded_model_scores_alike(spark, fitted, tmp_path):
    df, model = fitted
    model.save(str(tmp_path))
    again = M.FittedModel.load(spark, str(tmp_path))
    assert (again.numbers, again.categories, again.inputs, again.vector) == (model.numbers, model.categories, model.inputs, None)
    want = [r[M.PROBABILITY] for r in model.predict(df).orderBy("row_id").collect()]
    assert [r[M.PROBABILITY] for r in again.predict(df).orderBy("row_id").collect()] == want


def test_unseen_categories_score_as_missing(spark, fitted):
    _, model = fitted
    df = spark.createDataFrame([(1, 0.7, 0.5, "new", 1), (2, 0.7, 0.5, None, 1)], "row_id long, a double, b double, c string, y int")
    a, b = [r[M.PROBABILITY] for r in model.predict(df).orderBy("row_id").collect()]
    assert a == b


def test_categories_are_coded_once_each(spark):
    from stallwatch.operators.joins import category_dictionary, encode_categories

    df = spark.range(50).select("id", F.concat(F.lit("c"), (F.col("id") % 7).cast("string")).alias("c"))
    dictionary = category_dictionary(df.filter("id % 7 <> 3"), ["c"])
    coded = encode_categories(df, dictionary.union(dictionary), ["c"]).orderBy("id").select("id", "c").collect()
    order = {f"c{v}": i for i, v in enumerate(v for v in range(7) if v != 3)}
    assert [r["c"] for r in coded] == [order.get(f"c{i % 7}") for i in range(50)]


def test_samples_of_sharing_edges_see_all_hundred_partners(spark, tmp_path):
    from stallwatch.catalog import sharing

    rows = [(i, 1, float(i), "O", "1-URGENT", 1_000_000_000 + 3600 * i) for i in range(130)] + [(1000 + i, 100 + i, 1.0, "O", "5-LOW", 1_000_000_000) for i in range(400)]
    orders = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_totalprice double, o_orderstatus string, o_orderpriority string, at long")
    orders.selectExpr("* except (at)", "timestamp_seconds(at) AS o_orderdate").write.parquet(f"{tmp_path}/orders.parquet")
    linked = sharing.link_prediction_samples(spark, str(tmp_path)).filter("label = 1")
    assert linked.count() == sum(min(100, 129 - i) for i in range(130))
    near = sharing.sampled_neighbours(spark, str(tmp_path)).filter("hop = 1").collect()
    assert max(r.dst - r.src for r in near) > 20


def test_catalog_models_have_the_operators_own_settings(spark, folder, monkeypatch):
    from stallwatch.catalog import modelling
    from stallwatch.operators import models

    fits, searches = [], []

    class Seen(Exception):
        pass

    def fit(*_, **settings):
        fits.append(settings)
        raise Seen

    monkeypatch.setattr(models, "fit_variant", fit)
    monkeypatch.setattr(models.Search, "run", lambda self, *_, **given: searches.append((self, given)) or spark.createDataFrame([(0, {"a": 1.0}, 0.5)], "trial int, settings map<string, double>, mean_ap double"))
    for query in (modelling.model_variants, modelling.model_with_graph_vectors, modelling.group_ablation, modelling.scored_rows):
        with pytest.raises(Seen):
            query(spark, folder)
    with pytest.raises(Seen):
        modelling._boosted(None)
    assert not [s for s in fits if {"maxIter", "maxDepth", "numTrees", "stepSize", "subsamplingRate"} & set(s)]
    modelling.random_search(spark, folder)
    (search, given), = searches
    assert (search.trials, search.space) == (10, models.SEARCH_SPACE) and list(given["categories"]) == modelling.CATEGORIES


def test_no_row_of_a_split_changes_with_later_events(spark):
    from stallwatch.operators.graph_inputs import GraphInputs, split_inputs
    from stallwatch.operators.labels import Split, SplitColumns

    rng = random.Random(8)
    hours = [rng.randrange(2000) for _ in range(400)]  # a flag is raised at or after its row
    rows = [(i, f"l{rng.randrange(120)}", T0 + timedelta(hours=hours[i]), None if rng.random() < 0.7 else T0 + timedelta(hours=hours[i] + rng.randrange(600)), rng.choice(["a", "b", "c", None]), f"d{rng.randrange(20)}", rng.random() * 100) for i in range(400)]
    schema = "i long, l string, t timestamp, f timestamp, ip string, dev string, price double"
    inputs = GraphInputs(SplitColumns(key="l", time="t", flag="f", tie="i", label="y"), {"ip": ["ip"], "device": ["dev"]}, ["price"])
    split = Split(T0 + timedelta(hours=1000), T0 + timedelta(hours=1600), 7)
    whole = split_inputs(spark.createDataFrame(rows, schema), split, inputs)
    early = split_inputs(spark.createDataFrame([r for r in rows if r[2] <= split.train_end], schema), split, inputs)
    middle = split_inputs(spark.createDataFrame([r for r in rows if r[2] <= split.test_end], schema), split, inputs)
    names = ["i", "y", *whole.history, *whole.clusters, whole.vector]
    flat = lambda v: tuple(round(x, 9) for x in v) if isinstance(v, list) else round(v, 9) if isinstance(v, float) else v  # noqa: E731  sums of floats come in any order
    rows_of = lambda df: sorted((tuple(map(flat, r)) for r in df.select(names).collect()), key=str)
    assert rows_of(whole.train) == rows_of(early.train) == rows_of(middle.train) and whole.train.count() > 100
    assert rows_of(whole.test) == rows_of(middle.test) and whole.test.count() > 50
    assert all(len(r[0]) == whole.vector_size for r in whole.test.select(whole.vector).collect())


@pytest.fixture(scope="module")
def foldable(spark):
    rng = random.Random(6)
    rows = [(fold, role, rng.random(), rng.random(), rng.choice("uv")) for fold in (1, 2) for role, n in (("train", 150), ("test", 80)) for _ in range(n)]
    return spark.createDataFrame([(f, r, a, b, c, int(a + 0.5 * (c == "u") > 0.8)) for f, r, a, b, c in rows], "fold int, role string, a double, b double, c string, y int")


def test_first_trees_are_the_model_of_fewer_rounds(spark, foldable):
    from stallwatch.operators.features import numeric_stages
    from stallwatch.operators.models import WEIGHT, class_weights, classifier_for, staged_probabilities

    rows = numeric_stages(["a", "b"], scale=False)[0].transform(class_weights(foldable.withColumn("label", F.col("y").cast("double")), "label", positive_weight=2.0)).select("label", "features", WEIGHT).repartition(1).cache()
    full = classifier_for(Variant.BOOSTED, 7, maxIter=9, maxDepth=3).fit(rows)
    few = classifier_for(Variant.BOOSTED, 7, maxIter=4, maxDepth=3).fit(rows)
    staged = staged_probabilities(full, rows, [4, 9]).select("staged").collect()
    for r, a, b in zip(staged, few.transform(rows).select("probability").collect(), full.transform(rows).select("probability").collect()):
        assert r.staged[0] == pytest.approx(a.probability[1], abs=1e-9) and r.staged[1] == pytest.approx(b.probability[1], abs=1e-9)


def test_search_scores_every_round_count_of_every_trial(spark, foldable):
    search = M.Search(space={"maxDepth": (2, 3), "maxIter": (2, 6), "positive_weight": (1.0, 3.0)}, trials=3, round_steps=3)
    out = search.run(foldable, "y", numbers=["a", "b"], categories=["c"], folds=[1, 2]).collect()
    assert {(r.trial, r.settings["maxIter"]) for r in out} == {(t, n) for t in range(3) for n in (2.0, 4.0, 6.0)}
    aps = [r.mean_ap for r in out]
    assert aps == sorted(aps, reverse=True) and aps[0] > 0.8
    assert all({"maxDepth", "positive_weight", "maxIter"} == set(r.settings) for r in out)


def test_equal_rows_are_grown_on_once_and_every_row_counts(spark):
    from stallwatch.operators.models import PARTS, ROWS, condensed, snapped

    rng = random.Random(7)
    rows = [(rng.random() * 1000, float(rng.randint(0, 3)), float(rng.random() < 0.4)) for _ in range(5000)]
    df = spark.createDataFrame(rows, "a double, b double, label double")
    few = snapped(df, ["a", "b"])
    values = sorted({r.a for r in few.collect()})
    assert len(values) <= 32 and {r.b for r in few.collect()} == {0.0, 1.0, 2.0, 3.0}
    cuts = [(x + y) / 2 for x, y in zip(values, values[1:])]
    moved = snapped(df.withColumn("was", F.col("a")), ["a", "b"]).collect()
    assert all((r.was <= t) == (r.a <= t) for r in moved for t in cuts)  # every tree sends a row where it sent its old value
    many = df.unionByName(df).unionByName(df)
    whole = condensed(many, ["a", "b"], ["a", "b"])
    assert whole.agg(F.sum(ROWS)).first()[0] == pytest.approx(15000)
    assert whole.count() <= PARTS * few.distinct().count() < 15000
    positives = many.agg(F.sum("label")).first()[0]
    weighted = M.class_weights(whole, "label", rows=F.col(ROWS)).groupBy("label").agg(F.sum(M.WEIGHT).alias("w"))
    assert all(r.w == pytest.approx(7500) for r in weighted.collect()) and 0 < positives < 15000


def test_contributions_are_computed_once_per_cell_and_hold_for_every_row(spark):
    rng = random.Random(11)
    rows = [(i, rng.random(), float(rng.randint(0, 5)) if i % 9 else None) for i in range(1500)]
    df = spark.createDataFrame(rows, "id long, a double, b double").withColumn("y", (F.col("a") + F.coalesce("b", F.lit(3.0)) / 5 > 1).cast("int"))
    model = M.fit_variant(df, "y", Variant.BOOSTED, numbers=["a", "b"], maxIter=3, maxDepth=3)
    trees, weights = X.tree_leaves(model)
    prepared = model.prepare(df)
    assert X._cells(prepared, model.inputs, trees).select("__cell").distinct().count() < 500
    inputs = {r["id"]: [r[c] for c in model.inputs] for r in prepared.collect()}
    ids = sorted(inputs)
    want = dict(zip(ids, X._shap(np.array([inputs[i] for i in ids], dtype=float), trees, weights)))
    got = X.tree_contributions(model, df, "id")[0].collect()
    assert len(got) == 2 * len(rows)
    for r in got:
        at = [k for k, c in enumerate(model.inputs) if c.removesuffix("_missing") == r.feature]
        assert r.contribution == pytest.approx(sum(want[r["id"]][k] for k in at), abs=1e-9)
        assert r.value == inputs[r["id"]][model.inputs.index(r.feature)]


def test_short_vectors_are_averaged_without_sorting(spark):
    rows = [(i, [float(i), float(i * i)]) for i in range(40)]
    edges = [("p" if i % 3 else "q", i, j) for i in range(40) for j in range(i + 1, min(40, i + 6))]
    e, v = spark.createDataFrame(edges, "identity_type string, src long, dst long"), spark.createDataFrame(rows, "id long, v array<double>")
    out = G.neighbour_means(e, v, key="id", vector="v", size=2)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ObjectHashAggregate" not in plan and "SortAggregate" not in plan
    for r in out.collect():
        want = np.zeros(2)
        for kind in "pq":
            near = [rows[s][1] for k, s, t in edges if t == r["id"] and k == kind]
            want += np.mean(near, axis=0) if near else 0
        assert r.hop_1 == pytest.approx(list(want))

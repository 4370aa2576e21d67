"""Entity-sharing graph: nodes, bipartite and time-directed sharing edges, statistics, homophily, components."""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass
from datetime import datetime

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwatch.functions.scalar import utc
from stallwatch.operators.aggregates import entity_profile, impute_median
from stallwatch.operators.windows import first_time, time_encodings
from stallwatch.plans.ordered import ORDER, SLICE, earlier_slices, micros, numbered, running_totals, with_slice
from stallwatch.plans.skew import first_n_per_key, lookup
from stallwatch.registry import ENTITY_COLUMNS, POSITIVE_IDENTITIES, SHARING_IDENTITIES
from stallwatch.session import cut_lineage, shuffle_width, stored


def as_of(df: DataFrame, time: str, cutoff: datetime) -> DataFrame:
    """Only what had happened by the cutoff."""
    return df.filter(F.col(time) <= utc(cutoff))


def _pairs(df: DataFrame, entity: str, columns: dict[str, Sequence[str]], keep: Sequence[str] = ()) -> DataFrame:
    """(entity_id, kind, identity) for every non-blank identity cell."""
    cells = [
        F.struct(F.lit(kind).alias("kind"), F.col(f"`{c}`").cast("string").alias("identity"))
        for kind, names in columns.items()
        for c in names
        if c in df.columns
    ]
    long = df.select(F.col(f"`{entity}`").alias("entity_id"), *keep, F.explode(F.array(*cells)).alias("c"))
    return long.select("entity_id", *keep, "c.*").filter(F.col("entity_id").isNotNull() & (F.trim("identity") != ""))


def nodes(df: DataFrame, entity: str, entity_columns: dict[str, Sequence[str]], *, primary: str = "listing", min_count: int = 1) -> DataFrame:
    """(node_type, node_id, occurrences) for the primary entity and every entity kind."""
    others = _pairs(df, entity, entity_columns).select(F.col("kind").alias("node_type"), F.col("identity").alias("node_id"))
    own = df.filter(F.col(f"`{entity}`").isNotNull()).select(F.lit(primary).alias("node_type"), F.col(f"`{entity}`").cast("string").alias("node_id"))
    counted = own.unionByName(others).groupBy("node_type", "node_id").agg(F.count(F.lit(1)).alias("occurrences"))
    return counted.filter((F.col("node_type") == primary) | (F.col("occurrences") >= min_count))


def used_edges(df: DataFrame, entity: str, entity_columns: dict[str, Sequence[str]]) -> DataFrame:
    """Distinct ``used_<kind>`` edges from the primary entity to the entities it used."""
    pairs = _pairs(df, entity, entity_columns).distinct()
    return pairs.select(
        F.concat(F.lit("used_"), "kind").alias("edge_type"), F.col("entity_id").cast("string").alias("src"), F.col("identity").alias("dst")
    )


def with_reverse(edges: DataFrame) -> DataFrame:
    """Add the opposite of every edge under ``rev_<type>``."""
    back = edges.select(F.concat(F.lit("rev_"), "edge_type").alias("edge_type"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("edge_type", "src", "dst").unionByName(back)


# Positions of an identity's members that travel together; a source reads the few blocks its targets stand in.
BLOCK = 100


def _sharing_links(
    df: DataFrame,
    entity: str,
    time: str,
    identities: dict[str, Sequence[str]],
    cap: int | None,
    multiplicity: bool,
    slices: int | None,
    about: DataFrame | None = None,
) -> DataFrame:
    """(kind, src, src_time, src_*, __ends): a source with an array of some of its targets (dst, dst_time, dst_*), in one row per block.

    Work and shuffle are linear in the members. The tasks are not merged afterwards, as what they hold grows when arrays are unfolded.
    """
    starts = first_time(df, entity, time, "__first").withColumnRenamed(entity, "entity_id")
    told = [] if about is None else [c for c in about.columns if c != entity]
    if about is not None:
        starts = starts.join(about.withColumnRenamed(entity, "entity_id"), "entity_id", "left")
    pairs = _pairs(df, entity, identities)
    pairs = pairs if multiplicity else pairs.distinct()
    members = lookup(pairs, starts, ["entity_id"], "inner").filter(F.col("__first").isNotNull())
    members = stored(members, "members")  # one row per (identity, entity), read for bounds, totals and both edge ends
    keys = ["kind", "identity"]
    group = [*keys, SLICE]
    sliced = with_slice(members, micros("__first"), slices)
    per_slice = sliced.groupBy(*group).agg(F.count(F.lit(1)).alias("__k"))
    carry = per_slice.select(
        *group,
        F.coalesce(F.sum("__k").over(earlier_slices(keys)), F.lit(0)).alias("__c"),
        F.sum("__k").over(Window.partitionBy(*keys)).alias("__n"),
    )
    inside = Window.partitionBy(*group).orderBy(ORDER)
    local = sliced.select(
        "*",
        F.row_number().over(Window.partitionBy(*group).orderBy(ORDER, "entity_id")).alias("__r"),
        F.count(F.lit(1)).over(inside.rangeBetween(Window.unboundedPreceding, Window.currentRow)).alias("__le"),
    )
    placed = local.join(carry, group).select(
        *keys, "entity_id", "__first", *told, (F.col("__r") + F.col("__c")).alias("__rn"), (F.col("__le") + F.col("__c")).alias("__le"), "__n"
    )

    def block(position: Column) -> Column:
        return F.floor((position - 1) / BLOCK)

    end = F.struct("__rn", F.col("entity_id").alias("dst"), F.col("__first").alias("dst_time"), *[F.col(c).alias(f"dst_{c}") for c in told])
    blocks = placed.groupBy(*keys, block(F.col("__rn")).alias("__block")).agg(F.collect_list(end).alias("__ends"))
    first, last = F.col("__le") + 1, F.col("__n") if cap is None else F.least(F.col("__le") + cap, F.col("__n"))
    sources = placed.filter(F.col("__le") < F.col("__n")).select(
        *keys, F.col("entity_id").alias("src"), F.col("__first").alias("src_time"), *[F.col(c).alias(f"src_{c}") for c in told],
        first.alias("__from"), last.alias("__to"), F.explode(F.sequence(block(first), block(last))).alias("__block"),
    )
    spread = sources.repartition(shuffle_width(df.sparkSession), *keys, "__block")
    ends = F.filter("__ends", lambda e: e["__rn"].between(F.col("__from"), F.col("__to")))
    return spread.hint("merge").join(blocks, [*keys, "__block"]).select("kind", "src", "src_time", *[f"src_{c}" for c in told], ends.alias("__ends"))


def sharing_edges(
    df: DataFrame,
    *,
    entity: str,
    time: str,
    identities: dict[str, Sequence[str]],
    cap: int | None = 100,
    multiplicity: bool = False,
    slices: int | None = None,
    about: DataFrame | None = None,
) -> DataFrame:
    """Time-directed edges between entities sharing an identity: (identity_type, src, dst, src_time, dst_time).

    Each source points to at most ``cap`` strictly later entities of the same identity, nearest first by
    (time, id); without a cap, to all of them. Columns of one kind are united. Members are numbered per identity slice by slice, a source names the
    blocks of positions its targets stand in, and an equi-join on (identity, block) fetches them: edges are unfolded after
    the shuffle, never before. ``about`` (one row per entity) gives further columns, which both ends bring along as
    ``src_<name>`` and ``dst_<name>``; so edges need no join to learn them.
    """
    links = _sharing_links(df, entity, time, identities, cap, multiplicity, slices, about)
    told = [] if about is None else [c for c in about.columns if c != entity]
    held = links.select("kind", "src", "src_time", *[f"src_{c}" for c in told], F.explode("__ends").alias("e"))
    return held.select(
        F.col("kind").alias("identity_type"), "src", F.col("e.dst").alias("dst"), "src_time", F.col("e.dst_time").alias("dst_time"),
        *[f"src_{c}" for c in told], *[F.col(f"e.dst_{c}").alias(f"dst_{c}") for c in told],
    )


def sharing_counts(df: DataFrame, *, entity: str, time: str, identities: dict[str, Sequence[str]], cap: int | None = None, slices: int | None = None) -> DataFrame:
    """(identity_type, src, dst, shared): how many identities of a kind make an edge of :func:`sharing_edges` between two entities.

    Without a cap these are all identities that two entities share; then the result grows with the square of an identity's members. Targets are shuffled to their source as arrays and unfolded and counted there.
    """
    links = _sharing_links(df, entity, time, identities, cap, False, slices)
    told = links.select(F.col("kind").alias("identity_type"), "src", F.col("__ends.dst").alias("__dst"))
    near = told.repartition(shuffle_width(df.sparkSession), "identity_type", "src")
    edges = near.select("identity_type", "src", F.explode("__dst").alias("dst"))
    return edges.groupBy("identity_type", "src", "dst").agg(F.count(F.lit(1)).alias("shared"))


@dataclass(frozen=True)
class Graph:
    """A graph as tables: typed nodes, bipartite edges (with their reverses) and time-directed sharing edges."""

    nodes: DataFrame
    used: DataFrame
    sharing: DataFrame


def build_graph(
    df: DataFrame,
    *,
    entity: str,
    time: str,
    cutoff: datetime,
    entity_columns: dict[str, Sequence[str]] = ENTITY_COLUMNS,
    identities: dict[str, Sequence[str]] | None = None,
    cap: int = 100,
    min_count: int = 1,
    reverse: bool = True,
) -> Graph:
    """The heterogeneous graph known at the cutoff. Without any event the tables are empty but typed."""
    known = as_of(df, time, cutoff)
    identities = identities or {c: [c] for c in SHARING_IDENTITIES if c in df.columns}
    used = used_edges(known, entity, entity_columns)
    return Graph(
        nodes(known, entity, entity_columns, min_count=min_count),
        with_reverse(used) if reverse else used,
        sharing_edges(known, entity=entity, time=time, identities=identities, cap=cap),
    )


def listing_graph(
    df: DataFrame, *, entity: str, time: str, cutoff: datetime, identities: Sequence[str] = POSITIVE_IDENTITIES, cap: int = 50
) -> DataFrame:
    """Listing-only sharing edges over chosen identities (by default those whose connectivity raises risk)."""
    return sharing_edges(as_of(df, time, cutoff), entity=entity, time=time, identities={c: [c] for c in identities}, cap=cap)


def graph_statistics(node_table: DataFrame, edge_table: DataFrame, edge_type: str = "edge_type") -> DataFrame:
    """(kind, name, n) for nodes and edges by type, with a total of each."""
    n = node_table.rollup("node_type").agg(F.count(F.lit(1)).alias("n")).select(F.lit("nodes").alias("kind"), F.coalesce("node_type", F.lit("total")).alias("name"), "n")
    e = edge_table.rollup(edge_type).agg(F.count(F.lit(1)).alias("n")).select(F.lit("edges").alias("kind"), F.coalesce(edge_type, F.lit("total")).alias("name"), "n")
    return n.unionByName(e)


def homophily(edges: DataFrame, labels: DataFrame, key: str, label: str, edge_type: str = "identity_type") -> DataFrame:
    """Share of positive-positive, negative-negative and mixed edges per edge type."""
    a = labels.select(F.col(key).alias("src"), F.col(label).cast("int").alias("__a"))
    b = labels.select(F.col(key).alias("dst"), F.col(label).cast("int").alias("__b"))
    sides = lookup(lookup(edges.select(edge_type, "src", "dst"), a, ["src"], "inner"), b, ["dst"], "inner")
    total = F.col("__a") + F.col("__b")
    return sides.groupBy(edge_type).agg(
        F.count(F.lit(1)).alias("edges"),
        F.avg((total == 2).cast("double")).alias("both_positive"),
        F.avg((total == 0).cast("double")).alias("both_negative"),
        F.avg((total == 1).cast("double")).alias("mixed"),
    )


def link_counts(df: DataFrame, *, identities: dict[str, str], entity: str, time: str, row_id: str, seen: DataFrame | None = None) -> DataFrame:
    """Per event and identity kind: distinct other ids seen with the same identity strictly before the event.

    Kinds are stacked, so one history pass counts all of them; ``row_id`` is unique. ``seen`` names the first sightings (kind,
    identity, entity, seen in microseconds) where they are known already, those of ``df`` included; they may be given in parts.
    """
    held = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(f"`{column}`").cast("string").alias("value")) for kind, column in identities.items()])
    long = df.select(F.col(row_id), F.col(entity).alias("__entity"), micros(time).alias("__t"), F.explode(held).alias("__i")).select(
        row_id, "__entity", "__t", F.col("__i.kind").alias("__kind"), F.when(F.col("__i.value").isNotNull(), F.concat_ws("=", "__i.kind", "__i.value")).alias("__identity"),
    )
    named, key = long.filter(F.col("__identity").isNotNull()), ["__identity", "__entity"]
    sightings = named.withColumnRenamed("__t", "__seen") if seen is None else seen.select(F.concat_ws("=", "kind", "identity").alias("__identity"), F.col("entity").alias("__entity"), F.col("seen").alias("__seen"))
    pairs = cut_lineage(sightings.groupBy(*key).agg(F.min("__seen").alias("__seen")))  # narrow, used three times below
    marks = pairs.filter(F.col("__seen").isNotNull()).groupBy("__identity", F.col("__seen").alias("__t")).agg(F.count(F.lit(1)).alias("__new"))
    own = lookup(named, pairs, key, "left").withColumn("__own", (F.col("__seen") < F.col("__t")).cast("int")).drop("__seen", "__entity")
    both = own.withColumn("__is_row", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    shape = named.select("__identity", "__t").unionByName(marks, allowMissingColumns=True)
    before = {"__n": F.coalesce("__new", F.lit(0))}
    counted = running_totals(both, ["__identity"], F.col("__t"), before, before=True, shape=shape, null_keys=False).filter("__is_row")
    found = counted.select(row_id, "__kind", F.coalesce(F.col("__n") - F.col("__own"), F.lit(0)).cast("long").alias("__others"))
    nameless = long.filter(F.col("__identity").isNull()).select(row_id, "__kind", F.lit(0).cast("long").alias("__others"))
    links = [F.max(F.when(F.col("__kind") == kind, F.col("__others"))).alias(f"{kind}_links") for kind in identities]
    return found.unionByName(nameless).groupBy(row_id).agg(*links)


def edges_by_history(edges: DataFrame, rates: DataFrame, key: str, rate: str, above: float = 0.15) -> DataFrame:
    """Edges with an endpoint whose known positive rate exceeds a threshold; ``rates`` holds one row per entity.

    Where the edges are yet to be made, :func:`sharing_edges` brings the rates along (``about``) and :func:`with_risky_end` reads them.
    """
    a = rates.select(F.col(key).alias("src"), F.col(rate).alias("__a"))
    b = rates.select(F.col(key).alias("dst"), F.col(rate).alias("__b"))
    joined = lookup(lookup(edges, a, ["src"], "left"), b, ["dst"], "left")
    return with_risky_end(joined, "__a", "__b", above)


def with_risky_end(edges: DataFrame, src_rate: str, dst_rate: str, above: float = 0.15) -> DataFrame:
    """Edges one of whose ends has a rate above a threshold; null counts as 0. The rates are dropped."""
    rates = [F.coalesce(F.col(c), F.lit(0.0)) for c in (src_rate, dst_rate)]
    return edges.filter(F.greatest(*rates) > above).drop(src_rate, dst_rate)


def listing_node_features(
    df: DataFrame, *, entity: str, time: str, tie: str, maxima: Sequence[str], means: Sequence[str], firsts: Sequence[str], exact: bool = True
) -> DataFrame:
    """One feature row per listing node: role-wise aggregates, medians for gaps, and the time encodings."""
    profile = entity_profile(df, entity, maxima=maxima, means=means, firsts=firsts, order=[time, tie])
    with_time = profile.join(first_time(df, entity, time, "__first"), entity)
    filled = impute_median(with_time, [*maxima, *means, *firsts], approximate_accuracy=None if exact else 10_000)
    return filled.withColumns(time_encodings(with_time, "__first", "event_count")).drop("__first")


# Up to this many dimensions neighbours are averaged by one aggregate each.
FLAT_SIZE = 16


def _mean_vector(column: Column, size: int, weight: Column) -> Column:
    total = F.sum(weight)
    return F.array(*[F.when(total > 0, F.sum(weight * column[i].cast("double")) / total).otherwise(0.0) for i in range(size)])


def neighbour_means(edges: DataFrame, vectors: DataFrame, *, key: str, vector: str, size: int, hops: int = 1, edge_type: str = "identity_type") -> DataFrame:
    """Propagated node vectors: per hop, the mean of in-neighbours per edge type, summed over types.

    Returns one row per node with ``hop_1 .. hop_k``; nodes without in-neighbours get zeros. Means are
    pre-aggregated before the shuffle, so a popular target is no hot spot. Each hop is stored.
    """
    zeros = F.array_repeat(F.lit(0.0), size)
    current = vectors.select(F.col(key), F.col(vector).alias("__v"))
    out = vectors.select(key)
    for hop in range(1, hops + 1):
        pulled = lookup(edges.select(edge_type, "src", F.col("dst").alias(key)), current.select(F.col(key).alias("src"), "__v"), ["src"], "inner")
        if size <= FLAT_SIZE:  # plain averages stay in hash aggregation; vector buffers are sorted beyond 128 groups
            typed = pulled.groupBy(key, edge_type).agg(*[F.avg(F.col("__v")[i].cast("double")).alias(f"__m{i}") for i in range(size)])
            summed = typed.groupBy(key).agg(F.array(*[F.sum(f"__m{i}") for i in range(size)]).alias("__h"))
        else:  # one vector buffer per group, rather than one aggregate per dimension
            typed = pulled.groupBy(key, edge_type).agg(Summarizer.mean(array_to_vector(F.col("__v"))).alias("__m"))
            summed = typed.groupBy(key).agg(vector_to_array(Summarizer.sum(F.col("__m"))).alias("__h"))
        current = vectors.select(key).join(summed, key, "left").select(key, F.coalesce("__h", zeros).alias("__v"))
        current = stored(current, "hop") if hops > 1 else current
        out = out.join(current.withColumnRenamed("__v", f"hop_{hop}"), key)
    return out


def cosine(a: Column, b: Column) -> Column:
    def dot(x: Column, y: Column) -> Column:
        products = F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda acc, v: acc + v)

    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


def similarity_weighted_means(edges: DataFrame, vectors: DataFrame, *, key: str, vector: str, size: int) -> DataFrame:
    """Mean of in-neighbours weighted by their (non-negative) cosine similarity to the target.

    Edges that bring the vectors along (``about`` of :func:`sharing_edges`) need no join.
    """
    if {f"src_{vector}", f"dst_{vector}"} <= set(edges.columns):
        pulled = edges.select("dst", F.col(f"src_{vector}").alias("__s"), F.col(f"dst_{vector}").alias("__d"))
        return _similarity_weighted(pulled, key, size)
    src = vectors.select(F.col(key).alias("src"), F.col(vector).alias("__s"))
    dst = vectors.select(F.col(key).alias("dst"), F.col(vector).alias("__d"))
    pulled = lookup(lookup(edges.select("src", "dst"), src, ["src"], "inner"), dst, ["dst"], "inner")
    return _similarity_weighted(pulled, key, size)


def _similarity_weighted(pulled: DataFrame, key: str, size: int) -> DataFrame:
    weight = F.greatest(F.lit(0.0), cosine(F.col("__s"), F.col("__d")))
    weighted = pulled.select("dst", "__s", weight.alias("__w"))
    return weighted.groupBy(F.col("dst").alias(key)).agg(
        F.sum("__w").alias("weight"), _mean_vector(F.col("__s"), size, F.col("__w")).alias("neighbour_mean")
    )


def drawn_number(seed: int | str, *parts: Column | str) -> Column:
    """A non-negative 60-bit number drawn from a seed and values, by MD5 of their texts, which every engine has."""
    text = F.concat_ws("|", F.lit(str(seed)), *[(F.col(p) if isinstance(p, str) else p).cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 15), 16, 10).cast("long")


def sample_neighbours(edges: DataFrame, fanouts: Sequence[int], seeds: DataFrame, *, edge_type: str = "identity_type", seed: int = 42) -> DataFrame:
    """At most ``fanouts[h]`` in-neighbours per node and edge type at hop h, in a seeded hash order: (hop, edge_type, src, dst)."""
    order = [drawn_number(seed, "src", "dst"), F.col("src")]
    frontier, hops = seeds.select(F.col(seeds.columns[0]).alias("dst")).distinct(), []
    for hop, fanout in enumerate(fanouts, start=1):
        near = lookup(edges.select(edge_type, "src", "dst").distinct(), frontier, ["dst"], "left_semi")
        kept = first_n_per_key(near, ["dst", edge_type], order, fanout)
        hops.append(kept.select(F.lit(hop).alias("hop"), edge_type, "src", "dst"))
        frontier = kept.select(F.col("src").alias("dst")).distinct()
    out = hops[0]
    for more in hops[1:]:
        out = out.unionByName(more)
    return out


def link_samples(edges: DataFrame, node_table: DataFrame, key: str, *, seed: int = 42, spare: int = 3) -> DataFrame:
    """Edges (label 1) and as many seeded random non-edges (label 0) for link prediction.

    Nodes get positions; each edge draws several pairs of positions by hash, fetched by equi-joins. Pairs whose hash is surely too high
    to stay are dropped before pairs are compared; if the others turn out too few, all are compared. Draws that hit an edge or a
    self pair are left out, and of the rest exactly as many stay as there are edges, in hash order. A graph so
    dense that it lacks as many non-edges gives those that the draws found.
    """
    positive = stored(edges.select("src", "dst").distinct(), "edges")  # read for the draws, for what they hit, and in the result
    placed = stored(numbered(node_table.select(key).distinct(), [], drawn_number(seed, key), [F.col(key)], "__rn"), "positions")
    wanted, total = positive.count(), placed.count()

    def draw(salt: int) -> Column:
        return F.pmod(drawn_number(seed + salt, "src", "dst"), F.lit(total)) + 1

    pairs = F.explode(F.array(*[F.struct(draw(2 * k + 1).alias("i"), draw(2 * k + 2).alias("j")) for k in range(spare)]))
    drawn = positive.select(pairs.alias("p")).select(F.col("p.i").alias("__i"), F.col("p.j").alias("__j")).filter("__i <> __j")
    # nodes, fewer than draws, make the tables that draws look up: draws are neither sorted nor kept
    left = placed.select(F.col("__rn").alias("__i"), F.col(key).alias("src")).hint("shuffle_hash")
    right = placed.select(F.col("__rn").alias("__j"), F.col(key).alias("dst")).hint("shuffle_hash")
    negative = drawn.join(left, "__i").join(right, "__j").select("src", "dst")

    def found(below: int | None) -> DataFrame:
        """Different pairs that are no edge, whose drawn number is below the bound."""
        def near(df: DataFrame) -> DataFrame:
            return df if below is None else df.filter(drawn_number(seed, "src", "dst") < below)

        both = near(negative).withColumn("__edge", F.lit(0)).unionByName(near(positive).withColumn("__edge", F.lit(1)))
        kept = both.groupBy("src", "dst").agg(F.max("__edge").alias("__edge")).filter("__edge = 0").select("src", "dst")
        return stored(kept, "drawn").withColumn("__drawn", drawn_number(seed, "src", "dst"))

    below = _enough_below(wanted, spare * wanted, total)
    negatives = found(below)
    if below is not None and negatives.count() < wanted:
        negatives = found(None)
    negative = first_drawn(negatives, "__drawn", ["src", "dst"], wanted)
    return positive.withColumn("label", F.lit(1)).unionByName(negative.drop("__drawn").withColumn("label", F.lit(0)))


def _enough_below(wanted: int, draws: int, nodes: int) -> int | None:
    """A bound below which, very likely, lie the drawn numbers of ``wanted`` different pairs; none where all may be needed.

    Draws that agree, hit an edge or a self pair are estimated from the number of pairs there are.
    """
    pairs = max(1, nodes * (nodes - 1))
    different = pairs * -math.expm1(-draws / pairs) * max(0.0, 1 - wanted / pairs)
    share = 1.02 * (wanted + 6 * math.sqrt(wanted) + 1) / max(1.0, different)
    return int(share * 2**60) if share < 1 else None


def first_drawn(df: DataFrame, drawn: str, ties: Sequence[str], n: int) -> DataFrame:
    """Exactly the first ``n`` rows in (60-bit drawn number, ties) order, without sorting the rest.

    Rows are counted in 4,096 ranges of the number. Ranges before the one that holds row ``n`` stay whole; only that one is numbered.
    """
    share = F.shiftright(F.col(drawn), 48)
    counts = df.groupBy(share.alias("__share")).agg(F.count(F.lit(1)).alias("n")).orderBy("__share").collect()  # at most 4,096 rows
    before, border = 0, None
    for c in counts:
        if before + c["n"] > n:
            border = c["__share"]
            break
        before += c["n"]
    if border is None:
        return df
    last = numbered(df.filter(share == border), [], F.col(drawn), ties, "__rank").filter(F.col("__rank") <= n - before).drop("__rank")
    return df.filter(share < border).unionByName(last)


def components(pairs: DataFrame, entity: str, identity: str, *, max_rounds: int = 50) -> DataFrame:
    """Connected components of entities linked by shared identities: (entity, component), the smallest id naming it.

    Every identity becomes a star around its smallest entity (linear, never all pairs), then alternating
    large-star and small-star rounds (Kiveris et al. 2014) contract the graph in a logarithmic number of
    rounds. Minima are pre-aggregated and sent back by salted lookups; each round is checkpointed.
    """
    known = pairs.filter(F.col(entity).isNotNull()).select(entity, identity).distinct()
    linked = known.filter(F.col(identity).isNotNull())
    centre = linked.groupBy(identity).agg(F.min(entity).alias("v"))
    edges = lookup(linked, centre, [identity], "inner").select(F.col(entity).alias("u"), "v").filter("u <> v").distinct()
    roots = star_forest(edges, max_rounds=max_rounds).select(F.col("u").alias(entity), F.col("v").alias("component"))
    return known.select(entity).distinct().join(roots, entity, "left").withColumn("component", F.coalesce("component", entity))


def star_forest(edges: DataFrame, *, max_rounds: int = 50) -> DataFrame:
    """Edges (u, v) with ``u <> v`` contracted until every node ``u`` points to the smallest node of its component."""
    edges = cut_lineage(edges)
    for _ in range(max_rounds):
        if _is_star_forest(edges):
            return edges
        edges = cut_lineage(_small_star(_large_star(edges)))
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _is_star_forest(edges: DataFrame) -> bool:
    """Whether every node points to one root and no root points on."""
    forked = edges.groupBy("u").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    chained = edges.select(F.col("v").alias("u")).distinct().join(edges, "u", "left_semi")
    return forked.select("u").unionByName(chained).isEmpty()


def _large_star(edges: DataFrame) -> DataFrame:
    """Connect every larger neighbour of a node to the smallest of its neighbourhood."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("__m"))
    return lookup(both, least, ["u"], "inner").filter("v > u").select(F.col("v").alias("u"), F.col("__m").alias("v")).distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Connect a node and its smaller neighbours to the smallest of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    least = down.groupBy("u").agg(F.min("v").alias("__m"))
    spread = lookup(down, least, ["u"], "inner").select(F.col("v").alias("u"), F.col("__m").alias("v"))
    own = least.select("u", F.col("__m").alias("v"))
    return spread.unionByName(own).filter("u <> v").distinct()


def rings(component_table: DataFrame, labels: DataFrame, entity: str, label: str, *, min_size: int = 2) -> DataFrame:
    """Components with at least ``min_size`` entities, their size, positives and positive rate."""
    joined = component_table.join(labels.select(entity, label), entity, "left")
    sized = joined.groupBy("component").agg(
        F.count(F.lit(1)).alias("size"),
        F.sum(F.coalesce(F.col(label), F.lit(0)).cast("long")).alias("positives"),
        F.avg(F.coalesce(F.col(label), F.lit(0)).cast("double")).alias("rate"),
    )
    return sized.filter(F.col("size") >= min_size)

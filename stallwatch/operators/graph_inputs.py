"""Graph, history and cluster inputs of a temporal split, none of which knows what comes after its cutoff."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stallwatch.functions.scalar import log_count, utc
from stallwatch.operators.clusters import ClusterFeatures
from stallwatch.operators.graph import as_of, neighbour_means, sharing_edges
from stallwatch.operators.labels import Split, SplitColumns, temporal_split
from stallwatch.operators.windows import identity_history
from stallwatch.plans.skew import lookup
from stallwatch.session import stored

HISTORY = ("prior_entities", "prior_flagged", "prior_flagged_rate", "days_since_first_seen")
VECTOR = "graph_vector"


@dataclass(frozen=True)
class GraphInputs:
    """Which columns the inputs come from. ``identities`` maps a kind to its columns, ``numbers`` describe a node."""

    columns: SplitColumns
    identities: dict[str, Sequence[str]]
    numbers: Sequence[str]
    cap: int = 100
    hops: int = 2
    clusters: ClusterFeatures | None = None

    @property
    def identity_columns(self) -> list[str]:
        return list(dict.fromkeys(c for columns in self.identities.values() for c in columns))

    @property
    def vector_size(self) -> int:
        return self.hops * (len(self.numbers) + 1)

    @property
    def history_columns(self) -> list[str]:
        return [f"{identity}_{name}" for identity in self.identity_columns for name in HISTORY]

    @property
    def cluster_columns(self) -> list[str]:
        names = [c.replace("/", "_").removesuffix("_hash") for c in self.identity_columns]
        return [f"cf_{n}_{kind}" for n in names for kind in ("is_small_cluster", "is_power_user", "cluster_size")]


@dataclass(frozen=True)
class SplitInputs:
    train: DataFrame
    test: DataFrame
    history: list[str] = field(default_factory=list)
    clusters: list[str] = field(default_factory=list)
    vector: str = VECTOR
    vector_size: int = 0


def node_vectors(events: DataFrame, inputs: GraphInputs, cutoff: datetime) -> DataFrame:
    """(id, graph_vector) of the graph as of ``cutoff``: per hop, the mean description of the ids it shares identities with.

    A node is described by the means of its numbers and the logarithm of its rows. Edges lead from earlier to later ids, so a
    vector is drawn from ids known before; labels take no part.
    """
    c = inputs.columns
    known = as_of(events.filter(F.col(c.key).isNotNull()), c.time, cutoff)
    described = known.groupBy(c.key).agg(*[F.avg(F.col(f"`{n}`").cast("double")).alias(f"__{i}") for i, n in enumerate(inputs.numbers)], F.count(F.lit(1)).alias("__n"))
    parts = [F.coalesce(F.nanvl(f"__{i}", F.lit(None)), F.lit(0.0)) for i in range(len(inputs.numbers))]
    nodes = stored(described.select(c.key, F.array(*parts, log_count(F.col("__n"))).alias("__vector")))
    edges = stored(sharing_edges(known, entity=c.key, time=c.time, identities=inputs.identities, cap=inputs.cap).select("identity_type", "src", "dst"))
    means = neighbour_means(edges, nodes, key=c.key, vector="__vector", size=len(inputs.numbers) + 1, hops=inputs.hops)
    return means.select(c.key, F.concat(*[F.col(f"hop_{h}") for h in range(1, inputs.hops + 1)]).alias(VECTOR))


def with_history(events: DataFrame, inputs: GraphInputs) -> DataFrame:
    """Every event with what was known about each of its identities strictly before it; ``tie`` numbers the rows uniquely.

    Flags are taken to be raised at or after the time of the row that carries them.
    """
    c, out = inputs.columns, events
    for identity in inputs.identity_columns:
        narrow = events.select(*dict.fromkeys([c.tie, c.key, c.time, c.flag, identity]))
        past = identity_history(narrow, identity=identity, entity=c.key, time=c.time, flag=c.flag)
        out = out.join(past.select(c.tie, *[F.col(name).cast("double").alias(f"{identity}_{name}") for name in HISTORY]), c.tie, "left")
    return out


def split_inputs(events: DataFrame, split: Split, inputs: GraphInputs, *, overlap: str = "allow") -> SplitInputs:
    """Both sides of a split with history, cluster features and graph vectors.

    History is point in time. Clusters are counted on the train side. Train rows get vectors of the graph as of ``train_end``, test rows
    those of the graph as of ``test_end``. So no train row changes with events after ``train_end``, and no test row with events after
    ``test_end``. Ids without neighbours get zero vectors.
    """
    c = inputs.columns
    known = stored(with_history(events.filter(F.col(c.time) <= utc(split.test_end)), inputs))
    train, test = temporal_split(known, c, split, overlap=overlap)
    model = (inputs.clusters or ClusterFeatures(inputs.identity_columns)).fit(train)
    sides = []
    for side, cutoff in ((train, split.train_end), (test, split.test_end)):
        zero: Column = F.array_repeat(F.lit(0.0), inputs.vector_size)
        joined = lookup(model.transform(side), node_vectors(events, inputs, cutoff), [c.key], "left")
        sides.append(stored(joined.withColumn(VECTOR, F.coalesce(VECTOR, zero))))
    return SplitInputs(sides[0], sides[1], inputs.history_columns, inputs.cluster_columns, VECTOR, inputs.vector_size)

"""Live link counts: how many other ids an event's identities have been seen with before it.

State is a table of first sightings (kind, identity, entity, seen) in hash buckets, see :mod:`stallwatch.streaming.state`. A keyed
state function would send a popular identity to a single task; here each batch is counted by the same sliced operator as
the batch form, so a hot identity is spread like anything else, a retried batch overwrites its own rows, and lost
executors cost nothing but recomputation.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stallwatch.operators.graph import link_counts
from stallwatch.plans.ordered import micros
from stallwatch.plans.skew import lookup
from stallwatch.streaming.sinks import write_batch
from stallwatch.streaming.state import Sightings


@dataclass(frozen=True)
class LiveLinks:
    """Counts links of streaming events into ``folder/links``, and what each batch read and added into ``folder/reads``.

    With ``ttl_days`` a sighting older than that before a batch's earliest event is forgotten: it counts no more, an id seen again
    enters anew, and the next compaction removes it. Events without a time have no links and leave no sighting.
    """

    folder: str
    identities: dict[str, str]
    entity: str
    time: str
    row_id: str
    ttl_days: float | None = None
    buckets: int = 64
    compact_every: int = 8

    @property
    def state(self) -> Sightings:
        return Sightings(f"{self.folder}/sightings", ("kind", "identity"), "entity", self.buckets, self.compact_every)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        events = batch.select(self.row_id, self.entity, self.time, *self.identities.values()).persist()
        held = F.array(*[F.struct(F.lit(kind).alias("kind"), F.col(f"`{column}`").cast("string").alias("identity")) for kind, column in self.identities.items()])
        long = events.select(F.explode(held).alias("i"), F.col(self.entity).alias("entity"), micros(self.time).alias("seen")).select("i.*", "entity", "seen")
        first = long.filter("identity IS NOT NULL AND seen IS NOT NULL").groupBy("kind", "identity", "entity").agg(F.min("seen").alias("seen"))
        fresh = first.withColumn("bucket", self.state.bucket()).persist()
        earliest = None if self.ttl_days is None else events.agg(F.min(micros(self.time)).alias("t")).first()["t"]
        horizon = None if earliest is None else earliest - int(self.ttl_days * 86_400_000_000)
        near = self.state.read(fresh, batch_id, None if horizon is None else F.lit(horizon))
        known = lookup(near, fresh.select("kind", "identity").distinct(), ["kind", "identity"], "left_semi").persist()
        seen = fresh.select("kind", "identity", "entity", "seen").unionByName(known.select("kind", "identity", "entity", "seen"))
        counts = link_counts(events.filter(F.col(self.row_id).isNotNull()), identities=self.identities, entity=self.entity, time=self.time, row_id=self.row_id, seen=seen)
        write_batch(counts, f"{self.folder}/links", batch_id)
        new = lookup(fresh, known.select("kind", "identity", "entity"), ["kind", "identity", "entity"], "left_anti")
        self.state.append(new.select(*fresh.columns), batch_id)
        write_batch(near.agg(F.count(F.lit(1)).alias("rows_read")), f"{self.folder}/reads", batch_id)  # one narrow column
        self.state.compact(batch.sparkSession, batch_id, fresh.schema, horizon)
        for frame in (events, fresh, known):
            frame.unpersist()

    def start(self, events: DataFrame) -> StreamingQuery:
        return (
            events.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )

"""Events scored as they arrive: parsed, linked, conformed, scored by a fitted model, given reasons, routed.

Every step of a micro-batch writes rows that carry the batch's number and replaces what an earlier attempt left, so a batch
that stopped anywhere is simply run again. The same features and the same scorer serve the stream and the batch form.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stallwatch.functions.scalar import SIGNAL_FACTORS, time_features
from stallwatch.operators.features import conform
from stallwatch.operators.graph import link_counts
from stallwatch.operators.models import PROBABILITY, FittedModel, score_rows
from stallwatch.session import cut_lineage
from stallwatch.sources.ingest import parse_events, rejected, valid
from stallwatch.streaming.ingest import EVENT_KEY
from stallwatch.streaming.links import LiveLinks
from stallwatch.streaming.routing import Router
from stallwatch.streaming.sinks import write_batch

ROW = "event_row"
# Which column of an event names each kind of identity.
IDENTITIES = {"email": "email_hash", "phone": "phone_hash", "ip": "ip_hash", "device": "device_hash"}


def numbered_events(parsed: DataFrame) -> DataFrame:
    """Valid events, repeats dropped, with a row id made of what identifies an event."""
    return valid(parsed).dropDuplicates(EVENT_KEY).withColumn(ROW, F.sha2(F.concat_ws("|", *[F.col(c).cast("string") for c in EVENT_KEY]).cast("binary"), 256))


@dataclass(frozen=True)
class EventScorer:
    """Model inputs of an event and its score; ``numbers`` and ``categories`` are those the model was fitted with."""

    numbers: Sequence[str]
    categories: Sequence[str] = ()
    identities: dict[str, str] = field(default_factory=lambda: dict(IDENTITIES))
    high: float = 0.7
    medium: float = 0.3

    @property
    def links(self) -> list[str]:
        return [f"{kind}_links" for kind in self.identities]

    def features(self, linked: DataFrame) -> DataFrame:
        """Ids, flags, link counts, time features, and exactly the model's columns; a missing one is null, a missing count 0."""
        timed = linked.withColumns(time_features("event_timestamp"))
        flags = [name for name, *_ in SIGNAL_FACTORS]
        ordered = dict.fromkeys([ROW, "insertion_id", "event_timestamp", *flags, *self.links, *self.numbers, *self.categories])
        return conform(timed, list(ordered), [*self.numbers, *self.links])

    def linked(self, events: DataFrame) -> DataFrame:
        """The batch form of the live link counts: every event of a history at once. Events are stored, as they are read six times."""
        events = cut_lineage(events)
        counts = link_counts(events, identities=self.identities, entity="insertion_id", time="event_timestamp", row_id=ROW)
        return events.join(counts, ROW, "left")

    def score(self, model: FittedModel, linked: DataFrame) -> DataFrame:
        """(event_row, insertion_id, event_timestamp, probability, tier, decision, confidence, risk_factors)."""
        rows = self.features(linked)
        signals = {name: F.coalesce(F.col(name).cast("boolean"), F.lit(False)) for name, *_ in SIGNAL_FACTORS}
        links = {kind: F.coalesce(F.col(f"{kind}_links"), F.lit(0)).cast("long") for kind in self.identities}
        scored = score_rows(model, rows, high=self.high, medium=self.medium, signals=signals, links=links)
        return scored.select(ROW, "insertion_id", "event_timestamp", PROBABILITY, "risk_tier", "decision", "confidence", "risk_factors")


@dataclass(frozen=True)
class ScoringStream:
    """Scores raw JSON events (column ``value``) into ``folder``: ``scored``, ``rejected``, the link state, and the router's tables."""

    folder: str
    model: FittedModel
    scorer: EventScorer
    ttl_days: float | None = None

    @property
    def live(self) -> LiveLinks:
        return LiveLinks(self.folder, self.scorer.identities, "insertion_id", "event_timestamp", ROW, self.ttl_days)

    @property
    def router(self) -> Router:
        return Router(self.folder, lambda scored: scored, "event_timestamp", self.scorer.high, self.scorer.medium)

    def process(self, batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        parsed = parse_events(batch).persist()
        write_batch(rejected(parsed), f"{self.folder}/rejected", batch_id)
        events = numbered_events(parsed).persist()
        self.live.process(events, batch_id)
        counts = spark.read.parquet(f"{self.folder}/links").filter(F.col("batch_id") == batch_id).select(ROW, *self.scorer.links)
        write_batch(self.scorer.score(self.model, events.join(counts, ROW, "left")), f"{self.folder}/scored", batch_id)
        scored = spark.read.parquet(f"{self.folder}/scored").filter(F.col("batch_id") == batch_id).drop("batch_id")
        event = F.struct(*[F.col(c) for c in ("event_type", "user_id", "listing_price", "listing_category")])
        told = scored.join(events.select(ROW, event.alias("event")), ROW).withColumnRenamed(PROBABILITY, "fraud_probability")
        self.router.process(told, batch_id)
        for frame in (events, parsed):
            frame.unpersist()

    def start(self, raw: DataFrame) -> StreamingQuery:
        return raw.writeStream.foreachBatch(self.process).option("checkpointLocation", f"{self.folder}/checkpoint").trigger(availableNow=True).start()

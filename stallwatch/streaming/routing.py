"""Scored events to decisions: low and high tiers decide themselves, the middle waits for review."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from stallwatch.functions.scalar import decision, risk_tier
from stallwatch.sources.decisions import append_decisions, append_retrain, decision_rows, read_decisions, review_queue, unknown_decisions
from stallwatch.session import cut_lineage
from stallwatch.streaming.sinks import has_data, write_batch


@dataclass(frozen=True)
class Router:
    """Routes scored events under ``folder``: ``decisions``, ``retrain`` and ``queue``.

    ``score`` turns a micro-batch into rows with ``insertion_id``, ``fraud_probability`` and the time column.
    """

    folder: str
    score: Callable[[DataFrame], DataFrame]
    time: str
    high: float = 0.7
    medium: float = 0.3

    def process(self, batch: DataFrame, batch_id: int) -> None:
        p = F.col("fraud_probability")
        scored = self.score(batch).withColumns({"risk_tier": risk_tier(p, self.high, self.medium), "admin_decision": decision(p, self.high, self.medium)}).persist()
        decided = scored.filter(F.col("admin_decision") != "REVIEW").withColumn("decided_at", F.col(self.time))
        rows = decision_rows(decided).drop("event_row", "decision", "confidence", "risk_factors")
        append_decisions(rows, self.folder, batch_id=batch_id)
        append_retrain(rows, self.folder, batch_id=batch_id)
        waiting = scored.filter(F.col("admin_decision") == "REVIEW").withColumn("queued_at", F.col(self.time))
        write_batch(waiting.select("insertion_id", "fraud_probability", "risk_tier", "queued_at"), f"{self.folder}/queue", batch_id)
        scored.unpersist()

    def start(self, events: DataFrame) -> StreamingQuery:
        return (
            events.writeStream.foreachBatch(self.process)
            .option("checkpointLocation", f"{self.folder}/checkpoint")
            .trigger(availableNow=True)
            .start()
        )

    def pending(self, spark: SparkSession) -> DataFrame:
        """The review queue as it stands: queued and not decided since."""
        queued = spark.read.parquet(f"{self.folder}/queue").drop("batch_id")
        if not has_data(spark, f"{self.folder}/decisions"):
            return review_queue(queued, queued.select("insertion_id", F.col("queued_at").alias("decided_at")).limit(0))
        return review_queue(queued, read_decisions(spark, self.folder))

    def decide(self, spark: SparkSession, decisions: DataFrame, batch_id: int) -> DataFrame:
        """Store human decisions about queued items (insertion_id, admin_decision, admin_id, notes, decided_at).

        Returns those about ids that are not in the queue; nothing is stored for them. Human batches have numbers of their
        own, and what they are checked against is fixed before the first write.
        """
        pending = cut_lineage(self.pending(spark))
        known = decisions.join(pending.select("insertion_id", "fraud_probability", "risk_tier"), "insertion_id")
        unknown = unknown_decisions(decisions, pending)
        rows = decision_rows(cut_lineage(known))
        # the training row first: until the decision is stored the item is still pending, so a retry repeats both
        append_retrain(rows, self.folder, batch_id=batch_id, source="human")
        append_decisions(rows, self.folder, batch_id=batch_id, source="human")
        return unknown

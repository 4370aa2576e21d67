"""Sequential change detectors over ordered error series: ADWIN, DDM, EDDM, Page-Hinkley, and their consensus.

Written from the papers: Bifet & Gavalda 2007, Gama et al. 2004, Baena-Garcia et al. 2006, Page 1954.
Each detector keeps a state of bounded (ADWIN: logarithmic) size, so a series is read batch by batch and
never held whole; ``epoch`` cuts long series into independent stretches that run in parallel.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Adwin:
    """Adaptive window: drops old buckets while two sub-windows differ in mean."""

    def __init__(self, delta: float = 0.002, clock: int = 32, max_buckets: int = 5, min_window: int = 10, min_part: int = 5):
        self.delta, self.clock, self.max_buckets = delta, clock, max_buckets
        self.min_window, self.min_part = min_window, min_part
        self.rows: list[list[tuple[float, float]]] = [[]]  # rows[i]: buckets of 2**i values as (sum, variance mass)
        self.width, self.total, self.spread, self.seen = 0, 0.0, 0.0, 0

    def update(self, x: float) -> bool:
        self.seen += 1
        if self.width:
            mean = self.total / self.width
            self.spread += self.width * (x - mean) ** 2 / (self.width + 1)
        self.width, self.total = self.width + 1, self.total + x
        self.rows[0].append((x, 0.0))
        self._compress()
        if self.seen % self.clock or self.width <= self.min_window:
            return False
        return self._shrink()

    def _compress(self) -> None:
        level = 0
        while len(self.rows[level]) > self.max_buckets:
            size = 2**level
            (s1, v1), (s2, v2) = self.rows[level].pop(0), self.rows[level].pop(0)
            if level + 1 == len(self.rows):
                self.rows.append([])
            self.rows[level + 1].append((s1 + s2, v1 + v2 + (s1 - s2) ** 2 / (2 * size)))
            level += 1

    def _shrink(self) -> bool:
        changed, again = False, True
        while again and self.width > self.min_window:
            again = False
            n0 = s0 = 0.0
            buckets = [(2**i, s) for i in range(len(self.rows) - 1, -1, -1) for s, _ in self.rows[i]]
            variance = max(self.spread / self.width, 0.0)
            bound = math.log(2 * math.log(self.width) / self.delta)
            for size, s in buckets[:-1]:
                n0, s0 = n0 + size, s0 + s
                n1, s1 = self.width - n0, self.total - s0
                if n0 < self.min_part or n1 < self.min_part:
                    continue
                inverse = 1 / (n0 - self.min_part + 1) + 1 / (n1 - self.min_part + 1)
                cut = math.sqrt(2 * inverse * variance * bound) + 2 / 3 * inverse * bound
                if abs(s0 / n0 - s1 / n1) > cut:
                    self._drop_oldest()
                    changed = again = True
                    break
        return changed

    def _drop_oldest(self) -> None:
        level = len(self.rows) - 1
        size = 2**level
        s, v = self.rows[level].pop(0)
        rest = self.width - size
        if rest > 0:
            gap = s / size - (self.total - s) / rest
            self.spread = max(self.spread - v - size * rest * gap * gap / self.width, 0.0)
        else:
            self.spread = 0.0
        self.width, self.total = rest, self.total - s
        while len(self.rows) > 1 and not self.rows[-1]:
            self.rows.pop()


class Ddm:
    """Drift detection method: error rate well above its best level so far. Expects 0/1 errors."""

    def __init__(self, min_instances: int = 30, drift_level: float = 3.0):
        self.min_instances, self.drift_level = min_instances, drift_level
        self._reset()

    def _reset(self) -> None:
        self.n, self.p, self.best_p, self.best_s = 0, 0.0, math.inf, math.inf

    def update(self, error: float) -> bool:
        self.n += 1
        self.p += (error - self.p) / self.n
        s = math.sqrt(max(self.p * (1 - self.p), 0.0) / self.n)
        if self.n < self.min_instances:
            return False
        if 0 < self.p + s <= self.best_p + self.best_s:  # no level to compare with before the first error
            self.best_p, self.best_s = self.p, s
        if self.p + s > self.best_p + self.drift_level * self.best_s:
            self._reset()
            return True
        return False


class Eddm:
    """Early drift detection: the distance between errors shrinks against its best level. Expects 0/1 errors."""

    def __init__(self, min_errors: int = 30, beta: float = 0.9):
        self.min_errors, self.beta = min_errors, beta
        self._reset()

    def _reset(self) -> None:
        self.n = self.last = self.errors = 0
        self.mean = self.mass = self.best = 0.0

    def update(self, error: float) -> bool:
        self.n += 1
        if error < 0.5:
            return False
        self.errors += 1
        distance, self.last = self.n - self.last, self.n
        gap = distance - self.mean
        self.mean += gap / self.errors
        self.mass += gap * (distance - self.mean)
        level = self.mean + 2 * math.sqrt(self.mass / self.errors)
        if self.errors < self.min_errors:
            return False
        if level > self.best:
            self.best = level
            return False
        if level / self.best < self.beta:
            self._reset()
            return True
        return False


class PageHinkley:
    """Cumulative deviation from the running mean leaves its extreme by more than a threshold, either way."""

    def __init__(self, threshold: float = 50.0, alpha: float = 0.9999, delta: float = 0.005, min_instances: int = 30):
        self.threshold, self.alpha, self.delta, self.min_instances = threshold, alpha, delta, min_instances
        self._reset()

    def _reset(self) -> None:
        self.n, self.mean = 0, 0.0
        self.up = self.down = self.low = self.high = 0.0

    def update(self, x: float) -> bool:
        self.n += 1
        self.mean += (x - self.mean) / self.n
        gap = x - self.mean
        self.up = self.alpha * self.up + gap - self.delta
        self.down = self.alpha * self.down + gap + self.delta
        self.low, self.high = min(self.low, self.up), max(self.high, self.down)
        if self.n < self.min_instances:
            return False
        if self.up - self.low > self.threshold or self.high - self.down > self.threshold:
            self._reset()
            return True
        return False


class Consensus:
    """All four detectors on one series; drift when enough agree at the same step."""

    def __init__(self, needed: int = 2, threshold: float = 50.0):
        self.needed = needed
        self.detectors = {"adwin": Adwin(), "ddm": Ddm(), "eddm": Eddm(), "page_hinkley": PageHinkley(threshold)}

    def update(self, x: float) -> list[str]:
        return [name for name, d in self.detectors.items() if d.update(x)]

    def dump(self) -> str:
        """The detectors' state as JSON text."""
        return json.dumps({name: vars(d) for name, d in self.detectors.items()})

    def load(self, text: str | None) -> "Consensus":
        """Take up a dumped state; nothing to take up for a new series."""
        for name, state in json.loads(text or "{}").items():
            vars(self.detectors[name]).update(state)
        return self


DETECTION_SCHEMA = "position long, detectors string, agreeing int, consensus boolean"


def detect_changes(
    df: DataFrame, *, series: str, order: list[str], error: str, needed: int = 2, threshold: float = 50.0, epoch: Column | None = None
) -> DataFrame:
    """Every step at which a detector fires: (series, epoch, position, detectors, agreeing, consensus).

    Rows of a (series, epoch) are sorted by Spark and stream through the detectors in Arrow batches.
    """
    kind = df.schema[series].dataType.simpleString()
    rows = df.select(F.col(series), (epoch.cast("string") if epoch is not None else F.lit("all")).alias("epoch"), *[F.col(c).alias(f"__o{i}") for i, c in enumerate(order)], F.col(error).cast("double").alias("__x"))
    placed = rows.repartition(series, "epoch").sortWithinPartitions(series, "epoch", *[f"__o{i}" for i in range(len(order))])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, watch, position = None, None, 0
        for batch in batches:
            found = []
            for s, e, x in zip(batch[series], batch["epoch"], batch["__x"]):
                if (s, e) != current:
                    current, watch, position = (s, e), Consensus(needed, threshold), 0
                fired = watch.update(0.0 if x is None or x != x else x)
                if fired:
                    found.append((s, e, position, ",".join(fired), len(fired), len(fired) >= needed))
                position += 1
            yield pd.DataFrame(found, columns=[series, "epoch", "position", "detectors", "agreeing", "consensus"])

    return placed.mapInPandas(run, f"{series} {kind}, epoch string, {DETECTION_SCHEMA}")


def detector_counts(changes: DataFrame, series: str) -> DataFrame:
    """How often each detector fired per series, and how often they agreed."""
    names = ("adwin", "ddm", "eddm", "page_hinkley")
    return changes.groupBy(series).agg(
        *[F.count(F.when(F.array_contains(F.split("detectors", ","), n), 1)).alias(n) for n in names],
        F.count(F.when(F.col("consensus"), 1)).alias("consensus"),
    )

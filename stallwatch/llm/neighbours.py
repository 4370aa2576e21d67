"""A quality classifier that votes among nearest neighbours in a latent-semantic space.

Terms are hashed byte pairs of the text and its word shapes, so junk of any language shows; their weights are
sublinear counts times inverse document frequency. A truncated singular value decomposition of the labelled sample
gives the latent space. Labelled vectors are sent to every task (their number is a parameter), which takes exact cosine
products with its documents block by block and lets the nearest vote, weighted by similarity.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwatch.llm.common import held_out, spare, stored, text_bytes

PAIR_BITS = 12
SHAPES = 64
TERMS = (1 << PAIR_BITS) + SHAPES
PIECE = 1 << 20


def term_counts(text: bytes) -> np.ndarray:
    """Weights of hashed byte pairs (ASCII case kept, other bytes too), and of what words look like, for a whole text."""
    out = np.zeros(TERMS, np.float32)
    data = np.frombuffer(text, np.uint8)
    pairs = np.zeros(1 << PAIR_BITS, np.int64)
    for at in range(0, len(data), PIECE):
        part = data[at : at + PIECE + 1].astype(np.uint32)
        if len(part) > 1:
            code = ((part[:-1] << np.uint32(8) | part[1:]) * np.uint32(0x9E3779B1)) >> np.uint32(32 - PAIR_BITS)
            pairs += np.bincount(code, minlength=1 << PAIR_BITS)
    out[: 1 << PAIR_BITS] = np.log1p(pairs)
    words = text.split()
    n = len(words)
    shapes = np.zeros(SHAPES)
    if n:
        lengths = np.fromiter(map(len, words), np.int64, n)
        hashes = np.fromiter(map(zlib.crc32, words), np.int64, n)
        shares = (
            np.mean(hashes[1:] == hashes[:-1]) if n > 1 else 0.0,  # a word said twice in a row
            len(np.unique(hashes)) / n,
            sum(map(bytes.isupper, words)) / n,
            sum(map(bytes.islower, words)) / n,
            np.mean(lengths <= 2),
            np.mean(lengths >= 12),
        )
        for k, share in enumerate(shares):  # each share lights one of eight terms
            shapes[8 * k + min(7, int(8 * share))] = 1
    shapes[48 + min(15, int(np.log2(n + 1)))] = 1
    out[1 << PAIR_BITS :] = shapes * 4
    return out


@dataclass(frozen=True)
class Voters:
    """Inverse document frequencies, the latent axes, and the labelled sample's unit vectors with their labels."""

    idf: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float
    neighbours: int

    def place(self, counts: np.ndarray) -> np.ndarray:
        """Unit vectors in the latent space (zero where a text has none)."""
        weighted = counts * self.idf
        weighted /= np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)
        placed = weighted @ self.axes
        return (placed / np.maximum(np.linalg.norm(placed, axis=1, keepdims=True), 1e-12)).astype(np.float32)

    def scores(self, counts: np.ndarray, block: int = 4096) -> np.ndarray:
        """The similarity-weighted share of label 1 among the nearest; the sample is gone through in blocks."""
        placed = self.place(counts)
        best, votes = np.zeros((len(placed), 0), np.float32), np.zeros((len(placed), 0), np.float32)
        for at in range(0, len(self.vectors), block):
            near = placed @ self.vectors[at : at + block].T
            best = np.concatenate([best, near], axis=1)
            votes = np.concatenate([votes, np.broadcast_to(self.labels[at : at + block], near.shape)], axis=1)
            if best.shape[1] > self.neighbours:
                top = np.argpartition(-best, self.neighbours - 1, axis=1)[:, : self.neighbours]
                best, votes = np.take_along_axis(best, top, 1), np.take_along_axis(votes, top, 1)
        weights = np.maximum(best, 0).astype(np.float64) ** 8 + 1e-9  # nearer ones count more; far from all, all count alike
        if not weights.shape[1]:
            return np.full(len(placed), self.prior)
        return np.clip((weights * votes).sum(1) / weights.sum(1), 0.0, 1.0)


def right_singular(matrix: np.ndarray, axes: int, rounds: int = 4) -> np.ndarray:
    """The leading right singular vectors, as columns, by randomised subspace iteration (Halko, Martinsson and Tropp 2011)."""
    basis = np.random.default_rng(0).standard_normal((matrix.shape[1], axes + 16)).astype(np.float32)
    for _ in range(rounds):
        basis, _ = np.linalg.qr(matrix.T @ (matrix @ basis))
    _, _, turned = np.linalg.svd(matrix @ basis, full_matrices=False)
    return np.ascontiguousarray(basis @ turned[:axes].T).astype(np.float32)


def fit_voters(
    docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "quality", most_labels: int = 5000, axes: int = 64,
    neighbours: int = 15, learn_from=None,
) -> Voters:
    """Voters from at most ``most_labels`` documents labelled 0 or 1, those with the smallest hash of their id.

    That bound holds for what reaches the driver and what is sent to tasks: of rows that share an id one text (the smallest) is learned
    from. Inverse document frequencies are part of this bounded fit and come from the same sample. ``learn_from`` is a condition on the label
    table (default: the CRC of the id's text is not divisible by 5). Null ids and labels are left out; without labels
    every score is 0.5.
    """
    allowed = learn_from if learn_from is not None else ~held_out(id)
    known = labels.filter(allowed).select(F.col(f"`{id}`").cast("long").alias("label_id"), F.col(f"`{label}`").alias("good")).filter("label_id IS NOT NULL AND good IN (0, 1)")
    chosen = stored(known.groupBy("label_id").agg(F.min("good").alias("good")).orderBy(F.xxhash64("label_id"), "label_id").limit(most_labels), "voters")
    named = docs.select(F.col(f"`{id}`").cast("long").alias("label_id"), text_bytes(text).alias("body")).join(F.broadcast(chosen), "label_id")
    rows = named.groupBy("label_id").agg(F.min("good").alias("good"), F.min("body").alias("body"))  # one text per id, chosen before the shuffle

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counts = pa.array([term_counts(body.as_py()).astype(np.float16).tobytes() for body in batch.column("body")], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column("label_id"), batch.column("good"), counts], ["label_id", "good", "counts"])

    found = rows.mapInArrow(count, "label_id bigint, good int, counts binary").collect()  # bounded by most_labels, 8 kB each
    found.sort(key=lambda r: (r["label_id"], r["counts"]))
    if not found:
        return Voters(np.ones(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), np.zeros(0, np.float32), 0.5, neighbours)
    counts = np.stack([np.frombuffer(r["counts"], np.float16) for r in found]).astype(np.float32)
    good = np.array([r["good"] for r in found], np.float32)
    idf = (np.log((1 + len(counts)) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    weighted = counts * idf
    weighted /= np.maximum(np.linalg.norm(weighted, axis=1, keepdims=True), 1e-12)
    made = right_singular(weighted, axes)
    placed = Voters(idf, made, np.zeros((0, 1), np.float32), good, 0.5, neighbours).place(counts)
    return Voters(idf, made, placed, good, float(good.mean()), neighbours)


def with_scores(docs: DataFrame, voters: Voters, *, text: str = "text", rows: int = 256) -> DataFrame:
    """``docs`` without ``text`` but with score, 0 to 1: how likely label 1 is. Null and empty texts are scored like any other.

    Ids, languages and sources never enter a score. Repeated rows score alike, an empty table stays empty, and the new name gets
    underscores in front where a column has it.
    """
    score, body = spare("score", docs.columns), spare("body", docs.columns)
    given = [c for c in docs.columns if c != text]
    frame = docs.select(*[F.col(f"`{c}`") for c in given], text_bytes(text).alias(body))
    # Plain arrays: a worker has no copy of this package, and only the function below carries its code along.
    shared = docs.sparkSession.sparkContext.broadcast(tuple(getattr(voters, f.name) for f in fields(Voters)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(*shared.value)
        for batch in batches:
            made = []
            for at in range(0, batch.num_rows, rows):
                part = batch.column(batch.num_columns - 1).slice(at, rows)
                made.append(voters.scores(np.stack([term_counts(v.as_py()) for v in part])))
            scores = pa.array(np.concatenate(made) if made else np.zeros(0), pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], scores], [*batch.schema.names[:-1], score])

    schema = frame.drop(body).schema.add(score, "double")
    return frame.mapInArrow(run, schema)

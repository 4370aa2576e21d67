"""Token ids as wavelet matrices, one per shard: every file answers access, counting and occurrence lookup by itself.

A shard holds whole documents in ascending id order. Its ids are stored as bit-planes from the highest bit down; after
each plane the ids are stably partitioned by that plane's bit (Claude, Navarro and Ordonez 2015), so following one
position through the planes needs one rank per plane. Planes are packed bits with one running count per 512.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from stallwatch.llm.common import per_row, text_bytes
from stallwatch.llm.tokens import encoder
from stallwatch.session import shuffle_width

MAGIC = b"SWWM\x01"
BLOCK = 512

SHARD_SCHEMA = pa.schema([
    ("part", pa.int32()), ("shard", pa.int64()), ("n_docs", pa.int64()), ("n_tokens", pa.int64()), ("doc_ids", pa.list_(pa.int64())),
    ("doc_tokens", pa.list_(pa.int64())), ("file", pa.binary()),
])
SHARD_DDL = "part int, shard bigint, n_docs bigint, n_tokens bigint, doc_ids array<bigint>, doc_tokens array<bigint>, file binary"


class WaveletMatrix:
    """A sequence of unsigned integers below ``2 ** planes`` with access, rank, select and bulk decoding."""

    def __init__(self, n: int, planes: list[np.ndarray], zeros: list[int]):
        self.n, self.planes, self.zeros = n, planes, zeros
        self.counts: list[np.ndarray] | None = None

    @classmethod
    def build(cls, values: np.ndarray, planes: int) -> WaveletMatrix:
        """Planes from the highest bit down; values are reordered by each bit, zeros first."""
        now, packed, zeros = values, [], []
        for shift in range(planes - 1, -1, -1):
            bit = (now & now.dtype.type(1 << shift)) != 0
            packed.append(np.packbits(bit, bitorder="little"))
            low = now[~bit]
            zeros.append(len(low))
            now = np.concatenate([low, now[bit]])
        return cls(len(values), packed, zeros)

    def to_bytes(self) -> bytes:
        """The whole structure as one compressed file: header, zero counts, running counts and planes."""
        body = b"".join(p.tobytes() for p in self.planes) + b"".join(c.tobytes() for c in self._ranks())
        head = MAGIC + struct.pack("<QB", self.n, len(self.planes)) + struct.pack(f"<{len(self.zeros)}Q", *self.zeros)
        return head + zstandard.ZstdCompressor(level=1).compress(body)

    @classmethod
    def from_bytes(cls, data: bytes) -> WaveletMatrix:
        if data[: len(MAGIC)] != MAGIC:
            raise ValueError("not a wavelet matrix file")
        at = len(MAGIC)
        n, depth = struct.unpack_from("<QB", data, at)
        zeros = list(struct.unpack_from(f"<{depth}Q", data, at + 9))
        body = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[at + 9 + 8 * depth :]), np.uint8)
        width, blocks = (n + 7) // 8, n // BLOCK + 1
        planes = [body[i * width : (i + 1) * width] for i in range(depth)]
        counts = body[depth * width :].view(np.uint32) if depth * width % 4 == 0 else np.frombuffer(body[depth * width :].tobytes(), np.uint32)
        made = cls(n, planes, zeros)
        made.counts = [counts[i * blocks : (i + 1) * blocks] for i in range(depth)]
        return made

    def _ranks(self) -> list[np.ndarray]:
        """For each plane, the number of ones before every 512th position."""
        if self.counts is None:
            made, blocks = [], self.n // BLOCK + 1
            for plane in self.planes:
                ones = np.zeros(blocks * BLOCK // 8, np.uint8)
                ones[: len(plane)] = np.bitwise_count(plane)
                sums = ones.reshape(blocks, -1).sum(1, dtype=np.uint32)
                made.append((np.cumsum(sums, dtype=np.uint32) - sums).astype(np.uint32))
            self.counts = made
        return self.counts

    def _rank1(self, depth: int, i: int) -> int:
        """Ones before position ``i`` of a plane."""
        plane, start = self.planes[depth], i // BLOCK
        whole = int(np.bitwise_count(plane[start * BLOCK // 8 : i // 8]).sum())
        rest = int(plane[i // 8]) & ((1 << (i % 8)) - 1) if i % 8 else 0
        return int(self._ranks()[depth][start]) + whole + rest.bit_count()

    def _bit(self, depth: int, i: int) -> int:
        return int(self.planes[depth][i // 8]) >> (i % 8) & 1

    def _select(self, depth: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) ``bit`` of a plane, by bisection over ranks."""
        lo, hi = 0, self.n
        while lo < hi:
            mid = (lo + hi) // 2
            ones = self._rank1(depth, mid + 1)
            if (ones if bit else mid + 1 - ones) > k:
                hi = mid
            else:
                lo = mid + 1
        return lo

    def access(self, i: int) -> int:
        """The value at position ``i``."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        value = 0
        for depth, zeros in enumerate(self.zeros):
            bit, ones = self._bit(depth, i), self._rank1(depth, i)
            value, i = value << 1 | bit, zeros + ones if bit else i - ones
        return value

    def _narrow(self, value: int, i: int) -> tuple[int, int]:
        """Where the occurrences of ``value`` before ``i`` lie after the last plane: (start, end)."""
        start, end = 0, i
        for depth, zeros in enumerate(self.zeros):
            a, b = self._rank1(depth, start), self._rank1(depth, end)
            if value >> (len(self.zeros) - 1 - depth) & 1:
                start, end = zeros + a, zeros + b
            else:
                start, end = start - a, end - b
        return start, end

    def count(self, value: int, start: int = 0, end: int | None = None) -> int:
        """How often ``value`` occurs in positions [start, end)."""
        if value < 0 or value >> len(self.planes):
            return 0
        end = self.n if end is None else end
        a, b = self._narrow(value, start), self._narrow(value, end)
        return (b[1] - b[0]) - (a[1] - a[0])

    def find(self, value: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of ``value``."""
        if not 0 <= k < self.count(value):
            raise IndexError(k)
        i = self._narrow(value, self.n)[0] + k
        for depth in range(len(self.planes) - 1, -1, -1):
            bit = value >> (len(self.planes) - 1 - depth) & 1
            i = self._select(depth, bit, i - self.zeros[depth] if bit else i)
        return i

    def values(self) -> np.ndarray:
        """All values in order: the partitions are undone from the lowest plane up."""
        now = np.zeros(self.n, np.uint16 if len(self.planes) <= 16 else np.uint32)
        for depth in range(len(self.planes) - 1, -1, -1):
            bit = np.unpackbits(self.planes[depth], count=self.n, bitorder="little").view(bool)
            before = np.empty_like(now)
            before[~bit] = now[: self.zeros[depth]]
            before[bit] = now[self.zeros[depth] :] | now.dtype.type(1 << (len(self.planes) - 1 - depth))
            now = before
        return now


def _tokenised(path: str, end_id: int, rows: int = 512):
    tail = int(end_id).to_bytes(4, "little")

    def packed(body: bytes) -> bytes:
        """Ids below 65,536 travel in two bytes, wider ones in four; the first byte says which."""
        wide = np.frombuffer(encoder(path).ids(body) + tail, "<u4")
        return b"\2" + wide.astype("<u2").tobytes() if wide.max() < 1 << 16 else b"\4" + wide.tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, rows):
                batch = whole.slice(at, rows)
                made = [packed(body) for body in batch.column("body").to_pylist()]
                lengths = pa.array([(len(m) - 1) // m[0] for m in made], pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("part", "id", "tie")), lengths, pa.array(made, pa.binary())], ["part", "id", "tie", "n", "ids"])

    return run


def _shards(shard_tokens: int):
    """Sorted documents to shards: one closes once it holds ``shard_tokens`` ids, and at the end of a part."""

    def close(part: int, shard: int, ids: list[np.ndarray], docs: list[int | None]) -> pa.RecordBatch:
        values = np.concatenate(ids)
        depth = max(1, int(values.max()).bit_length())
        made = WaveletMatrix.build(values.astype(np.uint16) if depth <= 16 else values.astype(np.uint32), depth).to_bytes()
        row = {"part": part, "shard": shard, "n_docs": len(docs), "n_tokens": len(values), "doc_ids": docs, "doc_tokens": list(map(len, ids)), "file": made}
        return pa.RecordBatch.from_pylist([row], SHARD_SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, docs, held, now, shard = [], [], 0, None, 0
        for batch in batches:
            for part, doc, packed in zip(*(batch.column(c).to_pylist() for c in ("part", "id", "ids"))):
                if docs and (part != now or held >= shard_tokens):
                    yield close(now, shard, ids, docs)
                    ids, docs, held, shard = [], [], 0, shard + 1 if part == now else 0
                ids.append(np.frombuffer(packed, f"<u{packed[0]}", offset=1))
                docs.append(doc)
                held, now = held + len(ids[-1]), part
        if docs:
            yield close(now, shard, ids, docs)

    return run


def write_shards(docs: DataFrame, folder: str, tokenizer: str, *, id: str = "doc_id", text: str = "text", end_id: int = 1, shard_tokens: int = 1 << 20) -> None:
    """Tokenise ``text``, append ``end_id`` to each document and write wavelet-matrix shards in ascending ``id`` order.

    Documents are ranged by quantiles of their id into as many parts as there are shuffle partitions; a task streams its
    sorted part into shards of about ``shard_tokens`` ids, so memory holds one shard. Rows that share an id, or have none, are ordered
    by a hash of their text, and an id that fills several parts is spread over them by that hash. Every row of the Parquet table
    is one shard: its place (part, shard), its documents and the compressed ``file``. Shards keep documents whole.
    A null text is an empty one (its only id is ``end_id``); null ids come first; an empty table gives an empty folder table; other
    columns are not read.
    """
    parts = shuffle_width(docs.sparkSession)
    own, body = F.col(f"`{id}`").cast("long"), text_bytes(text)
    ids = docs.select(own.alias("id"))
    seen = ids.agg(F.count("id").alias("known"), F.count(F.lit(1)).alias("rows")).first()
    blank = max(1, parts * (seen["rows"] - seen["known"]) // max(1, seen["rows"]))
    points = ids.select(F.col("id").cast("double").alias("key")).filter("key IS NOT NULL").approxQuantile("key", [i / parts for i in range(1, parts)], 1 / (4 * parts))
    # A bound met m times over is one id that fills about m parts: its rows go to those by their hash.
    bounds = F.array(*[F.lit(int(b)).cast("long") for b in sorted(points)]) if points else F.array().cast("array<bigint>")
    unit = F.shiftrightunsigned("tie", 11) / F.lit(float(1 << 53))
    below, equal = F.size(F.filter(bounds, lambda b: b < F.col("id"))), F.size(F.filter(bounds, lambda b: b == F.col("id")))
    known = F.lit(blank) + below + F.when(equal > 0, 1 + F.floor(unit * equal)).otherwise(0)
    part = F.when(F.col("id").isNull(), F.floor(unit * blank)).otherwise(known).cast("int").alias("part")
    rows = docs.select(own.alias("id"), body.alias("body")).withColumn("tie", F.xxhash64("body")).select(part, "id", "tie", "body")
    tokenised = rows.mapInArrow(_tokenised(tokenizer, end_id), "part int, id bigint, tie bigint, n bigint, ids binary")
    ordered = tokenised.repartition(parts, "part").sortWithinPartitions("part", F.col("id").asc_nulls_first(), "tie", "n", "ids")
    ordered.mapInArrow(_shards(shard_tokens), SHARD_DDL).write.option("compression", "none").parquet(folder)


def read_shards(spark: SparkSession, folder: str) -> DataFrame:
    """One row per shard, as :func:`write_shards` wrote it."""
    return spark.read.schema(SHARD_DDL).parquet(folder)


def shard_starts(shards: DataFrame) -> DataFrame:
    """(part, shard, shard_start): tokens before each shard, from totals of parts and of the shards inside a part."""
    sizes = shards.groupBy("part", "shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per part: bounded by the shuffle width
    starts = sizes.groupBy("part").agg(F.sum("n").alias("n")).select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("part_start"))
    inside = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    placed = sizes.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(starts, "part")
    return placed.select("part", "shard", (F.col("part_start") + F.col("inside")).alias("shard_start"))


def documents_of(shards: DataFrame, *, ids: bool = True) -> DataFrame:
    """One row per document: doc_id, start (tokens of all documents before it), n_tokens, ids_crc32 and, if asked for, ids (4-byte little-endian)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                lengths = np.array(row["doc_tokens"], np.int64)
                ends = np.cumsum(lengths)
                data = memoryview(WaveletMatrix.from_bytes(row["file"]).values().astype("<u4").tobytes())
                cut = [data[4 * a : 4 * b] for a, b in zip((ends - lengths).tolist(), ends.tolist())]
                n = len(cut)
                columns = [
                    pa.array(np.full(n, row["part"], np.int32)), pa.array(np.full(n, row["shard"], np.int64)), pa.array(row["doc_ids"], pa.int64()), pa.array(ends - lengths), pa.array(lengths),
                    pa.array(list(map(zlib.crc32, cut)), pa.int64()), *[pa.array(list(map(bytes, cut)), pa.binary())] * ids,
                ]
                yield pa.RecordBatch.from_arrays(columns, ["part", "shard", "doc_id", "at", "n_tokens", "ids_crc32", *["ids"] * ids])

    read = shards.mapInArrow(run, "part int, shard bigint, doc_id bigint, at bigint, n_tokens bigint, ids_crc32 bigint" + ", ids binary" * ids)
    placed = read.join(shard_starts(shards), ["part", "shard"])
    return placed.select("doc_id", (F.col("shard_start") + F.col("at")).alias("start"), "n_tokens", "ids_crc32", *["ids"] * ids)


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """Global positions of a token, read off each shard's file by rank and select without decoding it."""
    schema = pa.schema([("part", pa.int32()), ("shard", pa.int64()), ("at", pa.int64())])

    def one(row: dict) -> Iterator[dict]:
        matrix = WaveletMatrix.from_bytes(row["file"])
        for k in range(matrix.count(token)):
            yield {"part": row["part"], "shard": row["shard"], "at": matrix.find(token, k)}

    found = shards.mapInArrow(per_row(one, schema), "part int, shard bigint, at bigint")
    return found.join(shard_starts(shards), ["part", "shard"]).select((F.col("shard_start") + F.col("at")).alias("position"))

"""Reversible line deduplication: exact reference counts, with sharded cuckoo filters in front of them.

The index is a folder of Parquet tables, versioned by batch:

``refs``     (k1, k2, doc_id), one row per document that holds a line's key; a 128-bit digest names the key
``counts``   (shard, k1, k2, n_docs, keeper), the exact number of documents and the largest id among them
``filters``  (shard, keys, cells), a cuckoo filter of the keys that ``min_docs`` or more documents hold
``versions`` (version, shards), a row for every version that is complete

Inserting or deleting documents changes references and counts; only keys whose count crosses ``min_docs`` go into or
out of their shard's filter, which a cuckoo filter allows and a Bloom filter does not. Cleaning asks the filters
first, so the exact table is joined with repeated lines only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from stallwatch.llm.common import per_row, spare, text_bytes
from stallwatch.plans.skew import lookup
from stallwatch.session import remove_folder

BLANK = b" \t\n\x0b\x0c\r"
SLOTS = 4
REF_DDL = "k1 bigint, k2 bigint, doc_id bigint"
COUNT_DDL = "shard int, k1 bigint, k2 bigint, n_docs bigint, keeper bigint"
VERSION_DDL = "version bigint, shards int"
FILTER_DDL = "shard int, keys bigint, cells binary"
KEYS = ["k1", "k2"]


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """The line without blanks around it and with A-Z in lower case; None if it is shorter than ``min_chars`` code points."""
    key = line.strip(BLANK).lower()
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return key


def digest(key: bytes) -> tuple[int, int]:
    data = xxhash.xxh3_128_digest(key)
    return int.from_bytes(data[:8], "little", signed=True), int.from_bytes(data[8:], "little", signed=True)


class CuckooFilter:
    """16-bit fingerprints in buckets of four, two buckets each; the second follows from the first and the fingerprint."""

    def __init__(self, cells: np.ndarray, keys: int = 0):
        self.cells, self.keys, self.mask = cells, keys, len(cells) - 1

    @classmethod
    def sized(cls, keys: int) -> CuckooFilter:
        buckets = 1 << max(1, int(np.ceil(np.log2(max(1, keys) / (0.85 * SLOTS)))))
        return cls(np.zeros((buckets, SLOTS), np.uint16))

    @classmethod
    def of(cls, k1: np.ndarray, k2: np.ndarray) -> CuckooFilter:
        size = max(64, len(k1))
        while True:
            made = cls.sized(size)
            if all(made.insert(*place) for place in zip(*made.places(k1, k2))):
                return made
            size *= 2

    @classmethod
    def from_bytes(cls, data: bytes, keys: int) -> CuckooFilter:
        return cls(np.frombuffer(data, "<u2").reshape(-1, SLOTS).copy(), keys)

    def to_bytes(self) -> bytes:
        return self.cells.astype("<u2").tobytes()

    def places(self, k1: np.ndarray, k2: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(fingerprint, first bucket, second bucket) of keys; the shard uses other bits of k1."""
        mark = (k2.astype(np.uint64) >> np.uint64(48)).astype(np.int64)
        mark[mark == 0] = 1
        first = k2.astype(np.int64) & self.mask
        return mark, first, first ^ self._step(mark)

    def _step(self, mark):
        return mark * 0x5BD1E995 & self.mask

    def insert(self, mark: int, first: int, second: int) -> bool:
        """Put a fingerprint in, moving others to their second bucket if need be; False if there is no room."""
        mark, first, second = int(mark), int(first), int(second)
        for bucket in (first, second):
            free = np.flatnonzero(self.cells[bucket] == 0)
            if len(free):
                self.cells[bucket, free[0]] = mark
                self.keys += 1
                return True
        bucket = second
        for turn in range(500):
            slot = turn % SLOTS
            mark, self.cells[bucket, slot] = int(self.cells[bucket, slot]), mark
            bucket ^= self._step(mark)
            free = np.flatnonzero(self.cells[bucket] == 0)
            if len(free):
                self.cells[bucket, free[0]] = mark
                self.keys += 1
                return True
        return False

    def delete(self, mark: int, first: int, second: int) -> None:
        """Take one copy of a fingerprint out; only keys that went in may come out."""
        for bucket in (first, second):
            at = np.flatnonzero(self.cells[bucket] == mark)
            if len(at):
                self.cells[bucket, at[0]] = 0
                self.keys -= 1
                return

    def holds(self, k1: np.ndarray, k2: np.ndarray) -> np.ndarray:
        """Whether each key may be in: no key that went in is missed, and about 1 in 8,000 others passes."""
        mark, first, second = self.places(k1, k2)
        return ((self.cells[first] == mark[:, None]) | (self.cells[second] == mark[:, None])).any(1)


def references(docs: DataFrame, *, id: str = "doc_id", text: str = "text", min_chars: int = 40) -> DataFrame:
    """(k1, k2, doc_id), one row per document row and distinct key. Rows with a null id have none."""
    schema = pa.schema([("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64())])

    def one(row: dict) -> Iterator[dict]:
        keys = {line_key(line, min_chars) for line in row["body"].split(b"\n")}
        for key in keys - {None}:
            k1, k2 = digest(key)
            yield {"k1": k1, "k2": k2, "doc_id": row["doc_id"]}

    rows = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), text_bytes(text).alias("body")).filter(F.col("doc_id").isNotNull())
    return rows.mapInArrow(per_row(one, schema, rows=16384), REF_DDL)


def _build(key: tuple, group: pa.Table) -> pa.Table:
    made = CuckooFilter.of(group["k1"].to_numpy(), group["k2"].to_numpy())
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([made.keys], pa.int64()), "cells": pa.array([made.to_bytes()], pa.binary())})


def _change(key: tuple, held: pa.Table, changes: pa.Table) -> pa.Table:
    """A shard's filter with keys put in (+1) and taken out (-1); null cells if it is full and has to be built anew."""
    rows = held.to_pylist()
    now = CuckooFilter.from_bytes(rows[0]["cells"], rows[0]["keys"]) if rows else CuckooFilter.sized(max(64, len(changes)))
    full = False
    if len(changes):
        up = changes["up"].to_pylist()
        places = list(zip(up, *now.places(changes["k1"].to_numpy(), changes["k2"].to_numpy())))
        for add, *place in sorted(places, key=lambda p: p[0]):  # deletions first
            if not add:
                now.delete(*place)
            elif not full and not now.insert(*place):
                full = True
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "keys": pa.array([now.keys], pa.int64()), "cells": pa.array([None if full else now.to_bytes()], pa.binary())})


def _probe(key: tuple, keys: pa.Table, held: pa.Table) -> pa.Table:
    rows = held.to_pylist()
    if not rows or not len(keys):
        return keys.slice(0, 0).select(KEYS)
    now = CuckooFilter.from_bytes(rows[0]["cells"], rows[0]["keys"])
    return keys.select(KEYS).filter(pa.array(now.holds(keys["k1"].to_numpy(), keys["k2"].to_numpy())))


class LineIndex:
    """The index in ``folder``, which must be shared and writable by all executors.

    Each batch writes the next version: the narrow reference and count tables anew, and the filters by their changes. Texts
    of earlier batches are not read again. A version counts once its row in ``versions`` is there, which is written last, so what
    a stopped batch left behind is overwritten by the next. Opening a folder takes up its newest version, and every change starts
    from it, whoever wrote it; changes must come one after the other. The version before the newest stays for its readers, older
    ones are deleted.
    """

    def __init__(self, spark: SparkSession, folder: str, *, min_chars: int = 40, min_docs: int = 5, shard_keys: int = 1 << 16):
        self.spark, self.folder, self.version, self.shards = spark, folder.rstrip("/"), 0, 1
        self.min_chars, self.min_docs, self.shard_keys = min_chars, min_docs, shard_keys
        self._newest()

    def _newest(self) -> None:
        try:
            known = self.spark.read.schema(VERSION_DDL).parquet(f"{self.folder}/versions").orderBy(F.desc("version")).first()
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            known = None
        if known:
            self.version, self.shards = known["version"], known["shards"]

    def _read(self, name: str, ddl: str) -> DataFrame:
        if not self.version:
            return self.spark.createDataFrame([], ddl)
        return self.spark.read.schema(ddl).parquet(f"{self.folder}/v{self.version}/{name}")

    def _write(self, name: str, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/v{self.version + 1}/{name}"
        df.write.mode("overwrite").parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def refs(self) -> DataFrame:
        return self._read("refs", REF_DDL)

    def counts(self) -> DataFrame:
        return self._read("counts", COUNT_DDL)

    def filters(self) -> DataFrame:
        return self._read("filters", FILTER_DDL)

    def insert(self, docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> None:
        """Add documents. A document already known adds only keys it did not have: references are a set."""
        self._newest()
        new = references(docs, id=id, text=text, min_chars=self.min_chars)
        self._next((self.refs().unionByName(new) if self.version else new).distinct())

    def delete(self, ids: DataFrame, *, id: str = "doc_id") -> None:
        """Take documents out by id: counts, keepers and filters become what they were without them."""
        self._newest()
        gone = ids.select(F.col(f"`{id}`").cast("long").alias("doc_id")).distinct()
        self._next(self.refs().join(gone, "doc_id", "left_anti"))

    def _next(self, refs: DataFrame) -> None:
        refs = self._write("refs", refs)
        # counted before the shuffle, so a line that a third of all documents hold sends one row per task
        totals = refs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n_docs"), F.max("doc_id").alias("keeper"))
        held, shards = refs.count(), self.shards
        while shards * self.shard_keys * 2 < held:
            shards *= 2
        counts = self._write("counts", totals.select(self._shard(shards).alias("shard"), *KEYS, "n_docs", "keeper"))
        often = counts.filter(F.col("n_docs") >= self.min_docs).select("shard", *KEYS)
        if not self.version or shards != self.shards:
            self._write("filters", often.groupBy("shard").applyInArrow(_build, FILTER_DDL))
        else:
            was = self.counts().filter(F.col("n_docs") >= self.min_docs).select("shard", *KEYS)
            up = often.join(was, ["shard", *KEYS], "left_anti").withColumn("up", F.lit(True))
            down = was.join(often, ["shard", *KEYS], "left_anti").withColumn("up", F.lit(False))
            changed = self.filters().groupBy("shard").cogroup(up.unionByName(down).groupBy("shard")).applyInArrow(_change, FILTER_DDL)
            changed = self._write("changed", changed)
            rebuilt = often.join(changed.filter(F.col("cells").isNull()).select("shard"), "shard", "left_semi").groupBy("shard").applyInArrow(_build, FILTER_DDL)
            self._write("filters", changed.filter(F.col("cells").isNotNull()).unionByName(rebuilt))
        self.version, self.shards = self.version + 1, shards
        self.spark.range(1).select(F.lit(self.version).cast("long").alias("version"), F.lit(shards).alias("shards")).coalesce(1).write.mode("append").parquet(f"{self.folder}/versions")
        if self.version > 2:
            remove_folder(self.spark, f"{self.folder}/v{self.version - 2}")

    @staticmethod
    def _shard(shards: int) -> Column:
        return F.pmod("k1", F.lit(shards)).cast("int")

    def drops(self, docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
        """(k1, k2, doc_id): keys that documents have to give up, as another document with a larger id keeps them."""
        refs = references(docs, id=id, text=text, min_chars=self.min_chars)
        asked = refs.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n")).select(self._shard(self.shards).alias("shard"), *KEYS)
        maybe = asked.groupBy("shard").cogroup(self.filters().groupBy("shard")).applyInArrow(_probe, "k1 bigint, k2 bigint")
        exact = self.counts().filter(F.col("n_docs") >= self.min_docs).select(*KEYS, "keeper").join(maybe, KEYS, "left_semi")
        return lookup(refs, exact, KEYS, "inner").filter(F.col("doc_id") != F.col("keeper")).select(*KEYS, "doc_id")

    def clean(self, docs: DataFrame, *, id: str = "doc_id", text: str = "text") -> DataFrame:
        """``docs`` with repeated lines cut from ``text`` except in the keeper, and two more columns, n_lines and n_dropped.

        Other columns pass through; new names get underscores in front where a column has them. A null or empty text is one
        empty line. Rows with a null id neither count nor lose lines. Rows that share an id are one document when
        counting, and each is cut. An empty table stays empty.
        """
        given, held = spare("cut", docs.columns), spare("key_list", docs.columns)
        total, gone = spare("n_lines", docs.columns), spare("n_dropped", docs.columns)
        # at most the distinct lines of one document
        cuts = self.drops(docs, id=id, text=text).groupBy(F.col("doc_id").alias(given)).agg(F.collect_set(F.struct(*KEYS)).alias(held))
        joined = docs.join(cuts, F.col(f"`{id}`").cast("long") == F.col(given), "left").drop(given)
        schema = StructType([*docs.schema.fields, StructField(total, LongType()), StructField(gone, LongType())])
        least = self.min_chars

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                at = batch.schema.get_field_index(text)
                kept, totals, cut = [], [], []
                for value, keys in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                    totals.append(1 + (value or "").count("\n"))
                    if not keys:
                        kept.append(value)
                        cut.append(0)
                        continue
                    wanted = {(k["k1"], k["k2"]) for k in keys}
                    lines = value.encode().split(b"\n")
                    stay = [line for line in lines if (key := line_key(line, least)) is None or digest(key) not in wanted]
                    kept.append(b"\n".join(stay).decode("utf-8", "replace"))
                    cut.append(len(lines) - len(stay))
                columns = batch.columns[:-1]
                columns[at] = pa.array(kept, batch.schema.field(at).type)
                yield pa.RecordBatch.from_arrays([*columns, pa.array(totals, pa.int64()), pa.array(cut, pa.int64())], [*batch.schema.names[:-1], total, gone])

        return joined.mapInArrow(run, schema)


def with_counts(cleaned: DataFrame, columns: list[str], *, text: str = "text", chars: str = "n_chars") -> DataFrame:
    """Of :meth:`LineIndex.clean`, the given columns; ``chars``, where it is one of them, counts the cut text's code points anew."""
    cut = F.col(f"`{cleaned.columns[-1]}`") > 0

    def column(name: str) -> Column:
        own = F.col(f"`{name}`")
        return F.when(cut, F.length(f"`{text}`")).otherwise(own).cast(cleaned.schema[name].dataType).alias(name) if name == chars else own

    return cleaned.select(*[column(c) for c in columns])

"""Small helpers the operators of this package share."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwatch.session import scratch_folder


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the shared folder and read back: lineage ends there, and a lost executor costs a re-read."""
    folder = scratch_folder(df.sparkSession, name)
    df.write.parquet(folder)
    return df.sparkSession.read.schema(df.schema).parquet(folder)


def text_bytes(column: str = "text") -> Column:
    """A text column as UTF-8 bytes, a null text as an empty one."""
    return F.coalesce(F.col(f"`{column}`"), F.lit("")).cast("binary")


def spare(name: str, taken: Iterable[str]) -> str:
    """``name``, with underscores in front until no column of ``taken`` has it."""
    lowered = {c.lower() for c in taken}
    while name.lower() in lowered:
        name = f"_{name}"
    return name


def per_row(fn: Callable[[dict], Iterable[dict]], schema: pa.Schema, rows: int = 2048, size: int = 16 << 20) -> Callable:
    """An Arrow-batch function from ``fn``, which turns one row into any number of rows; output is sent in bounded batches.

    A batch goes out after ``rows`` rows or about ``size`` bytes of text or binary values.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                for made in fn(row):
                    out.append(made)
                    held += sum(len(v) for v in made.values() if isinstance(v, (bytes, str)))
                    if len(out) >= rows or held >= size:
                        yield pa.RecordBatch.from_pylist(out, schema)
                        out, held = [], 0
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def worker_state(name: str, make: Callable[[], object]) -> object:
    """A value that lives as long as the Python worker, so that the tasks a worker runs in turn share it."""
    holder = sys.modules.setdefault("stallwatch_worker_state", types.ModuleType("stallwatch_worker_state"))
    if name not in holder.__dict__:
        holder.__dict__[name] = make()
    return holder.__dict__[name]


def held_out(id: str = "doc_id") -> Column:
    """Every fifth document by the CRC of its id's text: never learned from."""
    return F.coalesce(F.crc32(F.col(f"`{id}`").cast("string").cast("binary")) % 5 == 0, F.lit(False))

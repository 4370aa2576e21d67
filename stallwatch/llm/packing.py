"""Documents cut into token sequences of a fixed length, balanced by attention cost, with next to no padding."""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stallwatch.llm.common import per_row, text_bytes
from stallwatch.llm.tokens import encoder

PIECE_DDL = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
PACKED_SCHEMA = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")] + [("ids", pa.binary())])


def _pieces(path: str, end_id: int, room: int, keep_ids: bool):
    """A document's full sequences, which need no partner, and its rest, whose ids travel along for later cuts."""
    schema = pa.schema([(n, pa.int64()) for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens")] + [("ids", pa.binary())])
    tail = int(end_id).to_bytes(4, "little")

    def one(row: dict) -> Iterator[dict]:
        ids = encoder(path).ids(row["body"]) + tail
        n = len(ids) // 4
        for start in range(0, n, room):
            part = ids[4 * start : 4 * (start + room)]
            length = len(part) // 4
            kept = zstandard.ZstdCompressor(level=1).compress(part) if keep_ids or length < room else None
            yield {"doc_id": row["doc_id"], "start": start, "length": length, "ids_crc32": zlib.crc32(part), "doc_tokens": n, "ids": kept}

    return per_row(one, schema, rows=1024)


def attention_cost(length: np.ndarray | int, linear: float, quadratic: float):
    return linear * length + quadratic * length * length


def assign(lengths: np.ndarray, room: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Parts (piece, start in the piece, length, sequence, offset): descending pieces, each into the cheapest sequence it fits.

    There are just enough sequences for all tokens. A piece that fits in none is cut: the roomiest sequence takes
    what it can hold, and the remainder is placed again. Ties go to the lower number.
    """
    bins = max(1, math.ceil(int(lengths.sum()) / room))
    free, cost = np.full(bins, room, np.int64), np.zeros(bins)
    out, left = [], [(int(i), 0, int(lengths[i])) for i in np.argsort(-lengths, kind="stable")]
    for piece, start, length in left:
        while length:
            fits = np.where(free >= length, cost, np.inf)
            at = int(fits.argmin())
            if not np.isfinite(fits[at]):
                at = int(free.argmax())
            taken = min(length, int(free[at]))
            out.append((piece, start, taken, at, room - int(free[at])))
            free[at] -= taken
            cost[at] += attention_cost(taken, linear, quadratic)
            start, length = start + taken, length - taken
    return out


def _pack(room: int, linear: float, quadratic: float, keep_ids: bool):
    def one_block(key: tuple, group: pa.Table) -> pa.Table:
        rows = group.select(["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"]).sort_by([("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("ids_crc32", "ascending")])
        lengths = rows["length"].to_numpy()
        full = int((lengths >= room).sum())
        doc_ids, starts, crcs, totals, ids = (rows[c].to_pylist() for c in ("doc_id", "start", "ids_crc32", "doc_tokens", "ids"))
        first = key[0].as_py() << 32
        out = {n: [] for n in PACKED_SCHEMA.names}

        def add(i: int, start: int, length: int, crc: int, sequence: int, offset: int, data: bytes | None) -> None:
            for name, value in zip(PACKED_SCHEMA.names, (doc_ids[i], starts[i] + start, length, crc, totals[i], first + sequence, offset, data)):
                out[name].append(value)

        open_ids = zstandard.ZstdDecompressor().decompress
        for i in range(full):
            add(i, 0, room, crcs[i], i, 0, open_ids(ids[i]) if keep_ids else None)
        for j, start, length, sequence, offset in assign(lengths[full:], room, linear, quadratic) if full < len(lengths) else []:
            i, whole = full + j, length == lengths[full + j]
            data = None if whole and not keep_ids else open_ids(ids[i])[4 * start : 4 * (start + length)]
            add(i, start, length, crcs[i] if whole else zlib.crc32(data), full + sequence, offset, data if keep_ids else None)
        return pa.table(out, schema=PACKED_SCHEMA)

    return one_block


def pack(
    docs: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text", room: int = 2048, end_id: int = 1, linear: float = 1.0,
    quadratic: float = 1 / 2048, block_docs: int = 4096, keep_ids: bool = True,
) -> DataFrame:
    """Pack every document into sequences of at most ``room`` tokens: one row per piece.

    A document's ids and ``end_id`` are cut into full sequences and a rest. Pieces are dealt by hash into blocks of about
    ``block_docs`` documents, so a task holds one block; inside a block rests go, longest first, to the sequence of lowest
    ``linear * n + quadratic * n * n`` cost with enough room. A block opens only as many sequences as its tokens need and
    cuts a rest that fits nowhere, so it wastes fewer than ``room`` tokens. Columns: doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset, and ids (4-byte little-endian) unless ``keep_ids`` is false.

    A null or empty text is one ``end_id``; a null id is packed like any other; rows that share an id are separate documents;
    an empty table gives no rows; other columns are not read.
    """
    blocks = max(1, math.ceil(docs.count() / block_docs))
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), text_bytes(text).alias("body"))
    pieces = rows.mapInArrow(_pieces(tokenizer, end_id, room, keep_ids), f"{PIECE_DDL}, ids binary")
    blocked = pieces.withColumn("block", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(blocks)))
    packed = blocked.groupBy("block").applyInArrow(_pack(room, linear, quadratic, keep_ids), f"{PIECE_DDL}, sequence_id bigint, offset bigint, ids binary")
    return packed if keep_ids else packed.drop("ids")

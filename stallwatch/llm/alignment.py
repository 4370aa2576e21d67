"""Cross-tokenizer alignment: which ids of two tokenizers end together, and how often, by inverted pair bitmaps.

Documents get slots in containers of 65,536. Every id pair keeps, per container, a compressed bitmap of the documents that hold it,
in planes: plane k has the documents whose number of links of that pair has bit k set. Tasks write partial bitmaps for a bounded
number of postings; partials are OR-merged per pair and container, so a pair found in every document is spread over all
containers. Bits of all planes together count documents, bits weighted by plane count links. The counts then go back along
the postings: each container adds up the scores of its slots.
"""

from __future__ import annotations

import hashlib
import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stallwatch.llm.common import stored, text_bytes, worker_state
from stallwatch.llm.tokens import byte_letters
from stallwatch.plans.skew import lookup
from stallwatch.session import scratch_folder

SLOTS = 1 << 16
# Beyond this many slots a plane is kept as a deflated bitmap, below as sorted 16-bit slots.
SPARSE = 2048
# Characters on whose classes (letter, number, blank) all builds of Unicode agree.
PLAIN = re.compile("[\x00-ɏ]*")


class ByteLevel:
    """Ids of UTF-8 texts by a byte-level BPE file; strings of special tokens are ordinary text.

    A file whose ids follow its merges says the same as a rank table, which encodes several times faster. That is used for texts of
    Latin characters, and the file's own library for all others and for files of another build.
    """

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        with open(path, encoding="utf-8") as f:
            build = json.load(f)
        vocab, letters = build["model"]["vocab"], {v: k for k, v in byte_letters().items()}
        special = {t["content"] for t in build["added_tokens"]}
        self.pieces = [b""] * (max([*vocab.values(), *(t["id"] for t in build["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.pieces[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        merges = [m if isinstance(m, list) else m.split(" ") for m in build["model"]["merges"]]
        cut = build.get("pre_tokenizer") or {}
        in_order = [vocab["".join(m)] for m in merges] == list(range(256, 256 + len(merges))) and len(vocab) - len(special & set(vocab)) == 256 + len(merges)
        plain = cut.get("type") == "ByteLevel" and cut.get("use_regex", True) and not cut.get("add_prefix_space") and not build.get("normalizer")
        self.ranks = None
        if in_order and plain and not build["model"].get("dropout") and not build["model"].get("ignore_merges"):
            # The word pattern of this kind of file, fixed by it.
            words = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
            self.ranks = tiktoken.Encoding("ranks", pat_str=words, mergeable_ranks={self.pieces[i]: i for t, i in vocab.items() if t not in special}, special_tokens={})

    def ids(self, text: str) -> list[int]:
        if self.ranks and (text.isascii() or PLAIN.fullmatch(text)):
            return self.ranks.encode_ordinary(text)
        return self.tokenizer.encode(text, add_special_tokens=False).ids


class Pieces:
    """Ids of texts by a sentencepiece model, and each id's bytes: U+2581 is a blank, <0xHH> a byte."""

    def __init__(self, path: str):
        self.model = sentencepiece.SentencePieceProcessor(model_file=path)
        self.pieces = []
        for i in range(self.model.get_piece_size()):
            piece = self.model.id_to_piece(i)
            self.pieces.append(bytes([int(piece[3:5], 16)]) if self.model.is_byte(i) else piece.replace("▁", " ").encode())

    def ids(self, text: str) -> list[int]:
        return self.model.encode(text)


@dataclass
class Aligned:
    """A document's tokens of both sides: numbers, the digest of its groups, and its links as packed id pairs."""

    n_a: int
    n_b: int
    n_groups: int
    digest: str
    links: np.ndarray


class Aligner:
    def __init__(self, path_a: str, path_b: str):
        self.a, self.b = ByteLevel(path_a), Pieces(path_b)
        self.size_a, self.size_b = (np.array([len(p) for p in side.pieces], np.int64) for side in (self.a, self.b))
        # What an id adds to the text of the groups: by side, id, and whether it ends its side of a group.
        self.spelled = [b"%d%s" % (i, e) for n, ends in ((len(self.a.pieces), (b",", b"|")), (len(self.b.pieces), (b",", b";"))) for i in range(n) for e in ends]

    def align(self, body: bytes) -> Aligned | None:
        """None without tokens: an empty text, one that is not UTF-8, or one that either side does not give back byte for byte."""
        if not body:
            return None
        try:
            text = body.decode()
        except UnicodeDecodeError:
            return None
        a, b, whole = self.a.ids(" " + text), self.b.ids(text), b" " + body
        if b"".join(map(self.a.pieces.__getitem__, a)) != whole or b"".join(map(self.b.pieces.__getitem__, b)) != whole:
            return None
        ids_a, ids_b = np.array(a, np.int64), np.array(b, np.int64)
        ends_a, ends_b = self.size_a[ids_a].cumsum(), self.size_b[ids_b].cumsum()
        at_a, at_b = np.zeros(len(whole) + 1, bool), np.zeros(len(whole) + 1, bool)
        at_a[ends_a], at_b[ends_b] = True, True
        last_a, last_b = at_b[ends_a], at_a[ends_b]  # every token has bytes, so one token of a side ends at an offset
        group = np.concatenate([2 * (last_a.cumsum() - last_a), 2 * (last_b.cumsum() - last_b) + 1])
        codes = np.concatenate([2 * ids_a + last_a, 2 * (len(self.a.pieces) + ids_b) + last_b])[np.argsort(group, kind="stable")]
        digest = hashlib.sha256(b"".join(map(self.spelled.__getitem__, codes.tolist()))[:-1]).hexdigest()
        return Aligned(len(a), len(b), int(last_a.sum()), digest, ids_a[last_a] << 32 | ids_b[last_b])


WRITTEN = pa.schema(
    [("kind", pa.string()), ("container", pa.int64()), ("slot", pa.int32()), ("doc_id", pa.int64()), *[(n, pa.int64()) for n in ("n_a", "n_b", "n_groups", "n_links")], ("groups_sha256", pa.string()),
     ("pair", pa.int64()), ("plane", pa.int32()), ("bits", pa.binary())]
)
WRITTEN_DDL = "kind string, container bigint, slot int, doc_id bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pair bigint, plane int, bits binary"


def _batch(kind: str, n: int, **columns) -> pa.RecordBatch:
    made = {"kind": pa.array([kind] * n, pa.string())} | {k: v if isinstance(v, pa.Array) else pa.array(v, WRITTEN.field(k).type) for k, v in columns.items()}
    return pa.RecordBatch.from_arrays([made.get(f.name, pa.nulls(n, f.type)) for f in WRITTEN], schema=WRITTEN)


def pack(slots: np.ndarray) -> bytes:
    """Sorted different slots of a container as one compressed value."""
    if len(slots) <= SPARSE:
        return b"\0" + slots.astype("<u2").tobytes()
    bitmap = np.zeros(SLOTS, bool)
    bitmap[slots] = True
    return b"\1" + zlib.compress(np.packbits(bitmap, bitorder="little").tobytes(), 1)


def bitmap_of(packed: bytes) -> np.ndarray:
    """The 65,536 bits in bytes."""
    if packed[0]:
        return np.frombuffer(zlib.decompress(packed[1:]), np.uint8)
    bitmap = np.zeros(SLOTS, bool)
    bitmap[np.frombuffer(packed, "<u2", offset=1)] = True
    return np.packbits(bitmap, bitorder="little")


def slots_of(packed: bytes) -> np.ndarray:
    if packed[0]:
        return np.flatnonzero(np.unpackbits(bitmap_of(packed), bitorder="little"))
    return np.frombuffer(packed, "<u2", offset=1).astype(np.int64)


def either(packed: list[bytes]) -> bytes:
    """The OR of several planes."""
    if len(packed) == 1:
        return packed[0]
    if not any(p[0] for p in packed) and sum(map(len, packed)) <= 2 * SPARSE:
        return pack(np.unique(np.concatenate([np.frombuffer(p, "<u2", offset=1) for p in packed])))
    bits = bitmap_of(packed[0]).copy()
    for more in packed[1:]:
        bits |= bitmap_of(more)
    return pack(np.flatnonzero(np.unpackbits(bits, bitorder="little")))


def popcount(packed: bytes) -> int:
    return int(np.bitwise_count(bitmap_of(packed)).sum()) if packed[0] else len(packed) // 2


def _partials(pairs: np.ndarray, slots: np.ndarray, times: np.ndarray, container: int) -> Iterator[pa.RecordBatch]:
    """Partial planes of a run of postings (slots ascending), one row per pair and plane."""
    order = np.argsort(pairs, kind="stable")
    pairs, slots, times = pairs[order], slots[order], times[order]
    for plane in range(int(times.max()).bit_length()):
        have = (times >> plane) & 1 == 1
        if have.any():
            mine, at = pairs[have], slots[have].astype("<u2")
            starts = np.flatnonzero(np.concatenate([[True], mine[1:] != mine[:-1]]))
            ends = np.append(starts[1:], len(mine))
            data = at.tobytes()
            bits = [b"\0" + data[2 * s : 2 * e] if e - s <= SPARSE else pack(at[s:e]) for s, e in zip(starts.tolist(), ends.tolist())]
            n = len(starts)
            yield _batch("posting", n, container=pa.array(np.full(n, container, np.int64)), pair=pa.array(mine[starts]), plane=pa.array(np.full(n, plane, np.int32)), bits=pa.array(bits, pa.binary()))


def _aligned(path_a: str, path_b: str, most_postings: int, container_docs: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        aligner = worker_state(f"aligner {path_a} {path_b}", lambda: Aligner(path_a, path_b))
        row, container, held, docs = 0, None, ([], [], []), []

        def flush(also_docs: bool) -> Iterator[pa.RecordBatch]:
            if held[0]:
                yield from _partials(*map(np.concatenate, held), container)
                for h in held:
                    h.clear()
            if docs and also_docs:
                names = ("container", "slot", "doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256")
                yield _batch("document", len(docs), **dict(zip(names, map(list, zip(*docs)))))
                docs.clear()

        postings = 0
        for batch in batches:
            for part, doc_id, body in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), (v.as_py() for v in batch.column("body"))):
                here, slot = part << 32 | row // container_docs, row % container_docs
                if here != container or postings >= most_postings or len(docs) >= 4096:
                    yield from flush(True)
                    container, postings = here, 0
                row += 1
                found = aligner.align(body)
                if found is None:
                    docs.append((here, slot, doc_id, 0, 0, 0, 0, ""))
                    continue
                docs.append((here, slot, doc_id, found.n_a, found.n_b, found.n_groups, len(found.links), found.digest))
                pairs, times = np.unique(found.links, return_counts=True)
                for h, values in zip(held, (pairs, np.full(len(pairs), slot, np.uint16), times.astype(np.int32))):
                    h.append(values)
                postings += len(pairs)
        yield from flush(True)

    return run


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by pair, container and plane: each pair's planes in a container, OR-merged and counted."""
    out, current, planes = [], None, {}

    def made() -> tuple:
        merged = [either(planes[k]) if k in planes else b"\0" for k in range(max(planes) + 1)]
        return (*current, merged, popcount(either(merged)), sum(popcount(p) << k for k, p in enumerate(merged)))

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        pair, container, planes, docs, links = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(pair, pa.int64()), pa.array(container, pa.int64()), pa.array(planes, pa.list_(pa.binary())), pa.array(docs, pa.int64()), pa.array(links, pa.int64())],
            ["pair", "container", "planes", "n_docs", "n_links"],
        )

    for batch in batches:
        for pair, container, plane, bits in zip(*(batch.column(c).to_pylist() for c in ("pair", "container", "plane", "bits"))):
            if (pair, container) != current:
                if planes:
                    out.append(made())
                    if len(out) >= 4096:
                        yield batch_of(out)
                        out = []
                current, planes = (pair, container), {}
            planes.setdefault(plane, []).append(bits)
    if planes:
        out.append(made())
    if out:
        yield batch_of(out)


def _scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by container: every slot's scores, from the postings and counts of its pairs."""

    def batch_of(container: int, best: np.ndarray, total: np.ndarray, seen: np.ndarray) -> pa.RecordBatch:
        at = np.flatnonzero(seen)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(at), container, np.int64)), pa.array(at.astype(np.int32)), pa.array(best[at]), pa.array(total[at])], ["container", "slot", "n_best", "count_sum"])

    current, best, total, seen = None, None, None, None
    for batch in batches:
        for container, planes, count, top in zip(*(batch.column(c).to_pylist() for c in ("container", "planes", "count", "top"))):
            if container != current:
                if current is not None:
                    yield batch_of(current, best, total, seen)
                current, best, total, seen = container, np.zeros(SLOTS, np.int64), np.zeros(SLOTS, np.int64), np.zeros(SLOTS, bool)
            for k, packed in enumerate(planes):
                slots = slots_of(packed)
                seen[slots] = True
                total[slots] += count << k
                if top:
                    best[slots] += 1 << k
    if current is not None:
        yield batch_of(current, best, total, seen)


@dataclass(frozen=True)
class Alignment:
    """``documents`` has one row per document, ``pairs`` (a, b, n_docs, n_links, best) one per id pair, ``postings`` the bitmaps.

    documents: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256. postings: pair (a in the upper 32 bits, b in the
    lower), container, planes, n_docs, n_links. ``best`` marks a pair whose count is the highest of its b, ties included.
    """

    documents: DataFrame
    pairs: DataFrame
    postings: DataFrame


def align_tokenizers(
    docs: DataFrame, path_a: str, path_b: str, *, id: str = "doc_id", text: str = "text", most_postings: int = 1 << 19, container_docs: int = SLOTS
) -> Alignment:
    """Align a byte-level BPE file (A, asked for a blank and the text) with a sentencepiece model (B, which adds the blank itself).

    Offsets where tokens of both end cut a document into groups; the last tokens of a group are a link. A task holds at most about
    ``most_postings`` postings of up to ``container_docs`` (at most 65,536) documents. Tokens and partial planes are written once, so a
    lost executor costs a re-read, and no task repeats the encoding.

    Null and empty texts, and texts that either tokenizer does not give back byte for byte, have no tokens: zeros and an empty digest.
    A null id is kept; rows that share an id are separate documents; repeated texts count each time; an empty table gives no rows;
    other columns are not read.
    """
    spark = docs.sparkSession
    rows = docs.select(F.spark_partition_id().alias("part"), F.col(f"`{id}`").cast("long").alias("doc_id"), text_bytes(text).alias("body"))
    folder = scratch_folder(spark, "alignment")
    rows.mapInArrow(_aligned(path_a, path_b, most_postings, min(container_docs, SLOTS)), WRITTEN_DDL).write.parquet(folder)
    written = spark.read.schema(WRITTEN_DDL).parquet(folder)
    partials = written.filter(F.col("kind") == "posting").select("pair", "container", "plane", "bits")
    together = partials.repartition("pair", "container").sortWithinPartitions("pair", "container", "plane")
    postings = stored(together.mapInArrow(_merged, "pair bigint, container bigint, planes array<binary>, n_docs bigint, n_links bigint"), "postings")

    counted = postings.groupBy("pair").agg(F.sum("n_docs").alias("n_docs"), F.sum("n_links").alias("n_links"))
    counts = stored(counted.select("pair", F.shiftright("pair", 32).alias("a"), F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b"), "n_docs", "n_links"), "pair-counts")
    highest = counts.groupBy("b").agg(F.max("n_links").alias("most"))
    pairs = lookup(counts, highest, ["b"], "inner").select("pair", "a", "b", "n_docs", "n_links", (F.col("n_links") == F.col("most")).alias("best"))

    returned = lookup(postings.select("pair", "container", "planes"), pairs.select("pair", F.col("n_links").alias("count"), F.col("best").alias("top")), ["pair"], "inner")
    by_container = returned.select("container", "planes", "count", "top").repartition("container").sortWithinPartitions("container")
    scores = by_container.mapInArrow(_scored, "container bigint, slot int, n_best bigint, count_sum bigint")
    told = written.filter(F.col("kind") == "document").join(scores, ["container", "slot"], "left")
    none = F.lit(0).cast("long")
    documents = told.select(
        "doc_id", "n_a", "n_b", "n_groups", "n_links", F.coalesce("n_best", none).alias("n_best"), F.coalesce("count_sum", none).alias("count_sum"), "groups_sha256"
    )
    return Alignment(documents, pairs.drop("pair"), postings)

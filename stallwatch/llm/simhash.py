"""SimHash near-duplicates: all links within a Hamming radius, found by meeting in the middle."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwatch.llm.common import per_row, spare, stored, text_bytes
from stallwatch.operators.graph import star_forest
from stallwatch.plans.skew import lookup
from stallwatch.session import shuffle_width

CHUNK = 1 << 16


def fingerprint(text: bytes, shingle: int = 3) -> int:
    """64-bit SimHash of a UTF-8 text: A-Z lower-cased, words between ASCII white space, shingles hashed by XXH64 with seed 42.

    Repeated shingles count again. Fewer words than a shingle make one shingle; no words give zero.
    """
    words = text.lower().split()
    if not words:
        return 0
    joined, width = b" ".join(words), min(shingle, len(words))
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    spans = zip(starts[: len(words) - width + 1].tolist(), ends[width - 1 :].tolist())
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(joined[a:b], 42) for a, b in spans], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = hashes[at : at + CHUNK].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = 3) -> DataFrame:
    """(id, fp) per row; fp is the fingerprint's 64 bits as a signed long. A null text is an empty one."""

    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64())])

    def one(row: dict) -> Iterator[dict]:
        fp = fingerprint(row["body"], shingle)
        yield {"id": row["id"], "fp": fp - (1 << 64) if fp >> 63 else fp}

    rows = docs.select(F.col(f"`{id}`").cast("long").alias("id"), text_bytes(text).alias("body"))
    return rows.mapInArrow(per_row(one, schema), "id bigint, fp bigint")


def _variants(fp: Column, flips: int) -> Column:
    """The fingerprint and everything up to ``flips`` flipped bits away."""
    bits = [F.lit(1).cast("long") if i == 0 else F.shiftleft(F.lit(1).cast("long"), i) for i in range(64)]
    masks = [F.lit(0).cast("long")]
    for _ in range(flips):
        masks = masks + [m.bitwiseXOR(b) for m in masks[-1:] for b in bits] if len(masks) == 1 else masks + [a.bitwiseXOR(b) for i, a in enumerate(bits) for b in bits[i + 1 :]]
    return F.explode(F.array(*[fp.bitwiseXOR(m) for m in masks]))


def ball_links(fps: DataFrame, fp: str = "fp", *, radius: int = 2) -> DataFrame:
    """Links (u, v), v < u, that join all distinct fingerprints within ``radius`` (2, or 4) differing bits of each other.

    Every fingerprint is sent to all variants within half the radius. Two fingerprints within the radius share the
    variant halfway between them, and any two that share a variant are within the radius. So the members of a
    variant need no pairs: each links to the smallest of them. A variant has at most 65 members (2,081 for radius
    4), the points of its ball, whatever the data. Links are deduplicated and verified by counting bits.
    """
    if radius not in (2, 4):
        raise ValueError("the radius is 2 or 4: half of it is how many bits each variant may flip")
    # dealt out anew: distinct fingerprints gather in few partitions, and each becomes many rows
    known = fps.select(F.col(f"`{fp}`").alias("u")).filter(F.col("u").isNotNull()).distinct().repartition(shuffle_width(fps.sparkSession))
    sent = known.select("u", _variants(F.col("u"), radius // 2).alias("variant"))
    meeting = sent.withColumn("v", F.min("u").over(Window.partitionBy("variant"))).filter(F.col("u") != F.col("v"))
    return meeting.select("u", "v").distinct().filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= radius)


def _rooted(rows: DataFrame, radius: int) -> DataFrame:
    """(fp, first, root): each distinct fingerprint, its smallest id, and the fingerprint that stands for its component."""
    least = rows.groupBy("fp").agg(F.min("id").alias("first"))
    roots = star_forest(ball_links(rows, radius=radius)).select(F.col("u").alias("fp"), F.col("v").alias("root"))
    return stored(least.join(roots, "fp", "left").select("fp", "first", F.coalesce("root", "fp").alias("root")), "simhash-roots")


def near_duplicates(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits) and component_id, the smallest id reachable over links.

    Documents with equal fingerprints meet first, so copies cost one fingerprint. Null and empty texts have fingerprint
    zero and are linked like any other; a null id belongs to its component but never names it, unless no other id does;
    rows that share an id each get a row, and are not linked by it; an empty table gives no rows; other columns are not read.
    """
    rows = stored(fingerprints(docs, id=id, text=text, shingle=shingle), "simhash")
    placed = _rooted(rows, radius)
    named = placed.groupBy("root").agg(F.min("first").alias("component_id"))
    by_fp = lookup(placed.select("fp", "root"), named, ["root"], "inner").select("fp", "component_id")
    return lookup(rows, by_fp, ["fp"], "inner").select(
        F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id"
    )


def keep_first(docs: DataFrame, *, id: str = "doc_id", text: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id (null ids last), of rows that share it the one of smallest digest.

    Rows are told apart by id and a 128-bit digest of the text, so an id that two different texts carry loses neither; of rows alike
    in both, one stays.
    """
    key, none, d1, d2, n = (spare(c, docs.columns) for c in ("kept_id", "kept_none", "kept_d1", "kept_d2", "kept_n"))
    whole = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    own = F.col(f"`{id}`").cast("long")
    marks = {key: F.coalesce(own, F.lit(0).cast("long")), none: own.isNull(), d1: F.xxhash64(whole), d2: F.xxhash64(F.lit("second"), whole)}
    schema = pa.schema([("id", pa.int64()), ("fp", pa.int64()), ("d1", pa.int64()), ("d2", pa.int64())])

    def one(row: dict) -> Iterator[dict]:
        fp = fingerprint(row["body"], shingle)
        yield {"id": row["id"], "fp": fp - (1 << 64) if fp >> 63 else fp, "d1": row["d1"], "d2": row["d2"]}

    bodies = docs.select(own.alias("id"), text_bytes(text).alias("body"), marks[d1].alias("d1"), marks[d2].alias("d2"))
    rows = stored(bodies.mapInArrow(per_row(one, schema), "id bigint, fp bigint, d1 bigint, d2 bigint"), "simhash")
    placed = _rooted(rows, radius)
    # copies are counted before anything meets: a row per id and text, then the first of each component
    alike = rows.groupBy("fp", "id", "d1", "d2").agg(F.count(F.lit(1)).alias("n"))
    rooted = lookup(alike, placed.select("fp", "root"), ["fp"], "inner")
    first = rooted.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "d1", "d2", "n")).alias("keep")).select("keep.*")
    kept = first.select(F.coalesce("id", F.lit(0).cast("long")).alias(key), F.col("none").alias(none), F.col("d1").alias(d1), F.col("d2").alias(d2), F.col("n").alias(n))
    given = [F.col(f"`{c}`") for c in docs.columns]
    chosen = lookup(docs.withColumns(marks), kept, [key, none, d1, d2], "inner")
    once = chosen.filter(F.col(n) == 1).select(*given)
    again = chosen.filter(F.col(n) > 1).dropDuplicates([key, none, d1, d2]).select(*given)
    return once.unionByName(again)

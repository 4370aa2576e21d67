"""Sharding by extendible hashing: a bucket that is too large splits on its next hash bit, the others stay whole."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwatch.llm.common import spare, stored
from stallwatch.plans.skew import lookup
from stallwatch.session import shuffle_width

BITS = 60


def _bits(value: Column) -> Column:
    """The first 60 bits of the MD5 of a text, as a string of 0 and 1."""
    return F.lpad(F.conv(F.substring(F.md5(value.cast("binary")), 1, 15), 16, 2), BITS, "0")


def key_bits(id: Column, text: Column) -> Column:
    """120 bits: 60 by the id, then 60 by id and text, so that different rows of one id can part."""
    name = F.coalesce(id.cast("string"), F.lit("null"))
    return F.concat(_bits(name), _bits(F.concat_ws(" ", name, text)))


def directory(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame, int]:
    """The buckets of ``rows`` (bits, bytes): (cells, deep, depth).

    A bucket is the shortest prefix whose rows fit ``limit`` bytes or all have the same bits. Bytes are summed once per cell, a
    prefix of ``depth`` bits, chosen so that an average cell is an eighth of the limit; ``cells`` gives each
    cell's prefix and its bucket's bits and bytes. Cells that are still too large, null there, hold huge rows or a hot
    id; ``deep`` resolves them by whole keys, of which there are few.
    """
    total = rows.agg(F.sum("bytes").alias("n")).first()["n"] or 0
    depth = min(BITS, max(0, math.ceil(math.log2(max(1, total / limit))) + 3))

    def merged(parts: DataFrame, *keys: str) -> DataFrame:
        return parts.groupBy(*keys).agg(F.sum("bytes").alias("bytes"), F.min("low").alias("low"), F.max("high").alias("high"))

    def shortest(parts: DataFrame, whole: str, first: int, last: int) -> DataFrame:
        """(whole, length, held): of the shortest prefix of ``whole`` among first..last bits that is a bucket, its bits and bytes."""
        tall = parts.withColumn("length", F.explode(F.sequence(F.lit(first), F.lit(last)))).withColumn("prefix", F.expr(f"substring({whole}, 1, length)"))
        fits = merged(tall, "length", "prefix").filter((F.col("bytes") <= limit) | (F.col("low") == F.col("high")))
        fits = fits.select("length", "prefix", F.col("bytes").alias("held"))
        least = tall.select(whole, "length", "prefix").join(fits, ["length", "prefix"]).groupBy(whole).agg(F.min(F.struct("length", "held")).alias("least"))
        return least.select(whole, "least.length", "least.held")

    keyed = rows.select(F.expr(f"substring(bits, 1, {depth})").alias("cell"), "bytes", F.col("bits").alias("low"), F.col("bits").alias("high"))
    cells = stored(merged(keyed, "cell"), "shard-cells")
    placed = stored(cells.select("cell").join(shortest(cells, "cell", 0, depth), "cell", "left"), "shard-directory")
    large = placed.filter(F.col("length").isNull()).select("cell")
    inside = lookup(rows.withColumn("cell", F.expr(f"substring(bits, 1, {depth})")), large, ["cell"], "left_semi")
    keys = stored(merged(inside.select("bits", "bytes", F.col("bits").alias("low"), F.col("bits").alias("high")), "bits"), "shard-keys")
    return placed, stored(shortest(keys, "bits", depth + 1, 2 * BITS), "shard-deep"), depth


def extendible_shards(docs: DataFrame, limit: int, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with shard (the bucket's hash prefix), shard_depth (its bits), page and bytes (of the text, UTF-8).

    Every shard, that is every (shard, page), holds at most ``limit`` bytes, unless it is one row larger than that. Pages other
    than "" occur only where rows equal in id and text fill more than the limit by themselves: they are numbered in
    as many groups as there are shuffle partitions, and each page takes what fits. Null texts have no bytes, null ids
    share one hash and part by their texts, an empty table stays empty, and new names get underscores in front where a
    column has them.
    """
    shard, deep, page, size = (spare(n, docs.columns) for n in ("shard", "shard_depth", "page", "bytes"))
    bits, cell, got, held = (spare(n, docs.columns) for n in ("bits__", "cell__", "got__", "held__"))
    name, body = F.col(f"`{id}`"), F.coalesce(F.col(f"`{text}`"), F.lit(""))
    marked = docs.select("*", key_bits(name, body).alias(bits), F.octet_length(body).cast("long").alias(size))
    rows = stored(marked.select(F.col(bits).alias("bits"), F.col(size).alias("bytes")), "shard-rows")
    cells, deeper, depth = directory(rows, limit)
    near = cells.select(F.col("cell").alias(cell), F.col("length").alias(f"{got}1"), F.col("held").alias(f"{held}1"))
    far = deeper.select(F.col("bits").alias(bits), F.col("length").alias(f"{got}2"), F.col("held").alias(f"{held}2"))
    first = lookup(marked.withColumn(cell, F.expr(f"substring(`{bits}`, 1, {depth})")), near, [cell], "left")
    found = lookup(first, far, [bits], "left").withColumns({got: F.coalesce(f"{got}1", f"{got}2"), held: F.coalesce(f"{held}1", f"{held}2")})
    # equal rows that overflow their shard together are numbered group by group; a bucket over the limit has one key
    overflow = (F.col(held) > limit) & (F.col(size) < F.col(held))
    group = F.pmod(F.monotonically_increasing_id(), F.lit(shuffle_width(docs.sparkSession)))
    index = F.row_number().over(Window.partitionBy(bits, cell).orderBy(F.lit(0))) - 1
    fitting = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.col(size)))
    paged = found.filter(overflow).withColumn(cell, group.cast("string")).withColumn(page, F.concat_ws(".", F.col(cell), F.floor(index / fitting).cast("string")))
    placed = found.filter(~overflow).withColumn(page, F.lit("")).unionByName(paged)
    given = [F.col(f"`{c}`") for c in docs.columns]
    return placed.select(*given, F.expr(f"substring(`{bits}`, 1, `{got}`)").alias(shard), F.col(got).alias(deep), F.col(page).alias(page), F.col(size).alias(size))


def write_sharded(docs: DataFrame, folder: str, limit: int, *, id: str = "doc_id", text: str = "text") -> None:
    """``docs`` as one Parquet folder per shard and page, the shard's file written by one task."""
    made = extendible_shards(docs, limit, id=id, text=text)
    added = made.columns[len(docs.columns) :]
    made.repartition(added[0], added[2]).drop(added[1], added[3]).write.partitionBy(added[0], added[2]).parquet(folder)

"""Benchmark decontamination: documents that contain test items, by MinHash sketches of the items and exact containment.

Only DataFrame functions. A document that contains a share t of an item's n distinct shingles lacks at most n - ceil(t n) of
them, so it holds one of any n - ceil(t n) + 1. An item's sketch is that many of its smallest shingle hashes (a
bottom-k MinHash). Items are partitioned by size, in powers of two, and k is set for the largest item of a partition, so
no containment is missed whatever the document's length. Every document shingle is looked up in the sketches; what
is found is verified by counting shared shingles as texts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stallwatch.llm.common import spare, stored
from stallwatch.plans.skew import lookup

# Sketch rows (20 bytes each) that may be sent to every task; a larger benchmark's sketches are joined by shuffle.
BROADCAST_ROWS = 1_000_000


def words_of(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), "")


def shingles_of(words: Column, width: int) -> Column:
    """All runs of ``width`` words, joined by spaces."""
    spans = F.transform(F.sequence(F.lit(1), F.size(words) - (width - 1)), lambda i: F.array_join(F.slice(words, i, width), " "))
    return F.when(F.size(words) >= width, spans).otherwise(F.array().cast("array<string>"))


def shingle_hashes(words: Column, width: int) -> Column:
    """64-bit hashes of every run of ``width`` hashes of words."""
    spans = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*[F.get(words, i + k) for k in range(width)]))
    return F.when(F.size(words) >= width, spans).otherwise(F.array().cast("array<bigint>"))


def word_hashes(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def item_shingles(benchmark: DataFrame, *, id: str = "item_id", text: str = "text", width: int = 5) -> DataFrame:
    """(item_id, width, shingle, h, n): distinct shingles of every item and their number. An item of fewer words than ``width`` is one shingle."""
    rows = benchmark.select(F.col(f"`{id}`").cast("long").alias("item_id"), words_of(F.col(f"`{text}`")).alias("words"))
    long = rows.filter(F.size("words") >= width).select("item_id", F.lit(width).alias("width"), F.explode(shingles_of(F.col("words"), width)).alias("shingle"))
    short = rows.filter((F.size("words") > 0) & (F.size("words") < width)).select("item_id", F.size("words").alias("width"), F.array_join("words", " ").alias("shingle"))
    sets = long.unionByName(short).filter(F.col("item_id").isNotNull()).distinct()
    # places beyond a short item's end are null, which a hash passes over
    words = sets.withColumn("hashes", word_hashes(F.split("shingle", " ")))
    hashed = words.withColumn("h", F.xxhash64(*[F.get("hashes", k) for k in range(width)])).drop("hashes")
    return hashed.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy("item_id")))


def _least(n: Column, threshold: float) -> Column:
    """How many of ``n`` shingles make the threshold, in whole numbers: the threshold counts in thousandths."""
    return F.ceil((n * F.lit(round(threshold * 1000))) / F.lit(1000)).cast("int")


def item_sketches(shingles: DataFrame, threshold: float = 0.8) -> DataFrame:
    """(h, item_id, width, least): the smallest hashes of every item, as many as the largest item of its size partition needs."""
    sized = shingles.withColumn("part", F.floor(F.log2("n")).cast("int"))
    slack = F.col("n") - _least(F.col("n"), threshold) + 1
    most = sized.groupBy("part").agg(F.max(slack).alias("k"))  # at most 32 partitions: sizes are 31-bit numbers
    ranked = sized.join(F.broadcast(most), "part").withColumn("rank", F.row_number().over(Window.partitionBy("item_id").orderBy("h", "shingle")))
    return ranked.filter(F.col("rank") <= F.col("k")).select("h", "item_id", "width", _least(F.col("n"), threshold).alias("least"))


def contained_items(
    docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = 5, threshold: float = 0.8
) -> DataFrame:
    """(doc_id, item_id, n_shared, n_shingles): items of which a document contains ``threshold`` or more of the distinct shingles.

    Words are runs of letters and digits in lower case. Null and empty texts contain nothing and are contained nowhere; an item of
    fewer than ``width`` words is one shingle of its own length; null ids are left out; rows that share a document id
    are one document, and items that share an id are one item; empty tables give no rows; other columns are not read.
    """
    shingles = stored(item_shingles(benchmark, id=item_id, text=item_text, width=width), "item-shingles")
    sketches = stored(item_sketches(shingles, threshold), "item-sketches")
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("body")).filter("doc_id IS NOT NULL AND body IS NOT NULL")
    words = rows.select("doc_id", words_of(F.col("body")).alias("spelled")).select("doc_id", word_hashes(F.col("spelled")).alias("words"))
    small = sketches.count() <= BROADCAST_ROWS
    widths = sorted(r["width"] for r in sketches.select("width").distinct().collect())  # at most ``width`` of them
    found = None
    for w in widths:
        wanted = sketches.filter(F.col("width") == w).select("h", "item_id", "least")
        # a document has to have enough shingles for the item
        seen = words.select("doc_id", F.size("words").alias("n_words"), F.explode(shingle_hashes(F.col("words"), w)).alias("h"))
        if not small:
            # each hash once per document is enough here, and the shuffle is by hash
            seen = seen.distinct()
        hits = seen.join(F.broadcast(wanted), "h") if small else lookup(seen, wanted, ["h"], "inner")
        hits = hits.filter(F.col("n_words") >= F.col("least") + (w - 1)).select("doc_id", "item_id", F.lit(w).alias("width"))
        found = hits if found is None else found.unionByName(hits)
    if found is None:
        return docs.sparkSession.createDataFrame([], "doc_id bigint, item_id bigint, n_shared bigint, n_shingles bigint")
    candidates = stored(found.distinct(), "leak-candidates")
    # verification: distinct shingles of candidate documents against those of their candidate items, as texts
    suspects = lookup(rows, candidates.groupBy("doc_id", "width").agg(F.count(F.lit(1)).alias("items")), ["doc_id"], "inner")
    held = None
    for w in widths:
        part = suspects.filter(F.col("width") == w).select("doc_id", words_of(F.col("body")).alias("words")).select("doc_id", F.explode(shingles_of(F.col("words"), w)).alias("shingle"))
        held = part if held is None else held.unionByName(part)
    known = lookup(held, shingles.select("shingle").distinct(), ["shingle"], "left_semi").distinct()
    asked = lookup(candidates.select("doc_id", "item_id"), shingles.select("item_id", "shingle", F.col("n").alias("n_shingles")), ["item_id"], "inner")
    shared = asked.join(known, ["doc_id", "shingle"]).groupBy("doc_id", "item_id").agg(F.count(F.lit(1)).alias("n_shared"), F.first("n_shingles").alias("n_shingles"))
    return shared.filter(F.col("n_shared") >= _least(F.col("n_shingles"), threshold))


def without_leaks(docs: DataFrame, benchmark: DataFrame, *, id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """``docs`` without the documents that contain an item. Rows with a null id stay."""
    mark = spare("leaky", docs.columns)
    leaky = contained_items(docs, benchmark, id=id, text=text, **settings).select(F.col("doc_id").alias(mark)).distinct()
    return docs.join(leaky, F.col(f"`{id}`").cast("long") == F.col(mark), "left_anti")

"""Substring deduplication by hashed units: lines first, then passages of twelve words in what is left of them.

A unit is a line of at least ``least_words`` words or ``least_chars`` code points, or a passage of ``passage_words`` words;
passages start at every word, so whatever run of that many words or more stands earlier is removed to its last word, wherever
it stands. In scripts written without spaces every character is a word, and two of them weigh as much as one other word: a
passage that starts with such text has twice as many. What is below both minimums stays: lines shorter than either that are
not part of a longer repeat (documents of such lines and of fewer than ``passage_words`` words included), and repeats of
fewer words inside longer lines.
Digests of units are grouped over the whole corpus, the earliest occurrence (by document id, then position) stays, and all
others are removed, with their offsets in the original text. Lines go first: a passage inside one line that is removed stands
earlier in that line's first copy and needs no look-up. Of the other passages most occur once and are never sent anywhere:
the seed of a passage is the smallest hash of the ``passage_words - reach`` consecutive words inside it, equal passages have
equal seeds, and neighbours mostly share theirs. Runs of passages with one seed are counted first; only passages whose seed
occurs again are hashed as units.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from stallwatch.llm.common import spare, stored, text_bytes
from stallwatch.plans.skew import lookup

# Thai and Lao, Burmese, Khmer, kana, Chinese characters: a word each.
UNSPACED = "\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3005-\u3007\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff"
WORD = re.compile(rf"[{UNSPACED}]|[^\x20\x09-\x0D{UNSPACED}]+")
ALONE = re.compile(f"[{UNSPACED}]")
MAYBE = re.compile(rb"[\xE0\xE1\xE3-\xE9\xEF\xF0]")  # first bytes of those characters, and of some others
LEAST_CHARS = 40
UNIT_DDL = "k1 bigint, k2 bigint, doc_id bigint, start int, words int"
SEED_DDL = "k1 bigint, doc_id bigint, place bigint"
SPANS_DDL = "doc_id bigint, spans array<struct<start: bigint, end: bigint>>"
LENGTH_BITS = 31  # a place is the first word, shifted by these, and a number of words or passages
LENGTH_MASK = (1 << LENGTH_BITS) - 1
MIX = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xD6E8FEB86659FD93, 0x9FB21C651E98DF25)


def rolled(hashes: np.ndarray, n: int, mix: int) -> np.ndarray:
    """One digest of every ``n`` consecutive hashes, put together from those of powers of two."""
    m = max(0, len(hashes) - n + 1)
    out, done, power, width = None, 0, hashes, 1
    while True:
        if n & width:
            part = power[done : done + m]
            out = part if out is None else _paired(out, part, mix)
            done += width
        width *= 2
        if width > n or not m:
            return np.zeros(0, np.uint64) if out is None or not m else out[:m]
        power = _paired(power[: -(width // 2)], power[width // 2 :], mix)


def _paired(a: np.ndarray, b: np.ndarray, mix: int) -> np.ndarray:
    out = a * np.uint64(mix)
    out ^= b
    out *= np.uint64(MIX[3])
    out ^= out >> np.uint64(29)
    return out


def read_words(text: bytes, least_words: int, least_chars: int = LEAST_CHARS) -> tuple[list[bytes], np.ndarray, list[tuple[int, int]]]:
    """Words in lower case (A-Z), which of them are characters of scripts without spaces, and (first word, number of words) of the lines that are units."""
    words: list[bytes] = []
    alone: list[int] = []
    lines = []
    for line in text.lower().split(b"\n"):
        if MAYBE.search(line):
            found = WORD.findall(line.decode("utf-8", "replace"))
            inside = [w.encode() for w in found]
            single = [i for i, w in enumerate(found) if ALONE.match(w)]
        else:
            inside, single = line.split(), []
        weight = len(inside) - len(single) / 2
        chars = len(line.decode("utf-8", "replace").strip(" \t\x0b\x0c\r")) if len(line) >= least_chars else 0
        if weight >= least_words or chars >= least_chars:
            lines.append((len(words), len(inside)))
        alone += [len(words) + i for i in single]
        words += inside
    marks = np.zeros(len(words), bool)
    marks[alone] = True
    return words, marks, lines


def word_hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))


def passages_at(words: list[bytes], marks: np.ndarray, n: int, mixes: tuple[int, ...]) -> tuple[list[np.ndarray], np.ndarray]:
    """Digests, one array per mix, and lengths of the passages at every word; the length is 0 where the text ends before."""
    hashes, m = word_hashes(words), max(0, len(words) - n + 1)
    keys = [rolled(hashes, n, mix) for mix in mixes]
    size = np.full(m, n)
    if marks.any():
        total = np.append(0, np.cumsum(marks))
        double = 2 * (total[n : n + m] - total[:m]) >= n
        size[double] = 2 * n
        size[double & (np.arange(m) + 2 * n > len(words))] = 0
        for key, mix in zip(keys, mixes):
            wide = rolled(hashes, 2 * n, mix)
            at = np.flatnonzero(size == 2 * n)
            key[at] = wide[at]
    return keys, size


def past_first(keys: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(start, words) of passages with ``keys`` and ``size`` words at the ascending words ``at``.

    One that overlaps the document's first passage with its key (a short phrase said over and over) has only its words after that one.
    """
    _, first, same = np.unique(keys, return_index=True, return_inverse=True)
    begin = at[first[same]]
    over = (at > begin) & (at < begin + size)
    return np.where(over, begin + size, at), np.where(over, at - begin, size)


def units_of(text: bytes, least_words: int, passage_words: int, reach: int, least_chars: int = LEAST_CHARS) -> Iterator[tuple[bytes, int, int]]:
    """(normalised unit, first word, number of words) of a UTF-8 text: words in lower case (A-Z), joined by one space."""
    words, marks, lines = read_words(text, least_words, least_chars)
    for start, n in lines:
        yield b" ".join(words[start : start + n]), start, n
    (keys,), size = passages_at(words, marks, passage_words, MIX[:1])
    at = np.flatnonzero(size)
    starts, sizes = past_first(keys[at], at, size[at])
    for i, start, n in zip(at.tolist(), starts.tolist(), sizes.tolist()):
        yield b" ".join(words[i : i + int(size[i])]), start, n


def seed_runs(words: list[bytes], passage_words: int, reach: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(seed, first passage, number of passages, again) of the runs of neighbouring passages that share a seed."""
    found = rolled(word_hashes(words), passage_words - reach, MIX[2])
    m = max(0, len(words) - passage_words + 1)
    if not m:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
    seed = found[:m]
    for k in range(1, reach + 1):
        seed = np.minimum(seed, found[k : k + m])
    start = np.flatnonzero(np.append(True, seed[1:] != seed[:-1]))
    n = np.diff(np.append(start, m))
    ordered = np.sort(found)
    if not (ordered[1:] == ordered[:-1]).any():  # nothing in this text repeats
        return seed[start], start, n, np.zeros(len(start), bool)
    held = sum((found[k : k + m] == seed).astype(np.int8) for k in range(reach + 1))
    return seed[start], start, n, np.maximum.reduceat(held, start) + (n > reach + 1) > 1


def made_batches(rows: Callable[[dict], tuple], schema: pa.Schema, most: int = 1 << 17) -> Callable:
    """An Arrow-batch function from ``rows``, which turns one row into a column (array or list) per field; output is sent in bounded batches."""

    def sent(parts: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(p[i], f.type) for p in parts]) for i, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, held = [], 0
        for batch in batches:
            for row in batch.to_pylist():
                made = rows(row)
                if len(made[0]):
                    parts.append(made)
                    held += len(made[0])
                if held >= most:
                    yield sent(parts)
                    parts, held = [], 0
        if parts:
            yield sent(parts)

    return run


FIELDS = [("k1", pa.int64()), ("k2", pa.int64()), ("doc_id", pa.int64()), ("start", pa.int32()), ("words", pa.int32())]
SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))


def repeats(found: DataFrame) -> DataFrame:
    """Of units, those that are not the earliest occurrence of their digest. Copies are counted before the shuffle."""
    place = F.struct("doc_id", "start")
    first = found.groupBy("k1", "k2").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("k1", "k2", "first")
    return lookup(found, first, ["k1", "k2"], "inner").filter(place != F.col("first")).select("doc_id", "start", "words")


def spans_of(places: DataFrame, name: str) -> DataFrame:
    """(doc_id, spans) of ``places`` (doc_id, place), sorted and joined where they meet. Written: few and narrow rows."""

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column(1)
            place = held.flatten().to_numpy(zero_copy_only=False)
            row = np.repeat(np.arange(batch.num_rows), held.value_lengths().to_numpy(zero_copy_only=False)) << 32
            start, end = row + (place >> LENGTH_BITS), row + (place >> LENGTH_BITS) + (place & LENGTH_MASK)
            order = np.argsort(start, kind="stable")
            start, end = start[order], np.maximum.accumulate(end[order])
            first = np.flatnonzero(np.append(True, start[1:] > end[:-1])) if len(start) else np.zeros(0, np.int64)
            last = np.append(first[1:], len(start)) - 1
            offsets = np.searchsorted(start[first], np.arange(batch.num_rows + 1) << 32).astype(np.int32)
            low = np.int64((1 << 32) - 1)
            spans = pa.StructArray.from_arrays([pa.array(start[first] & low), pa.array(end[last] & low)], ["start", "end"])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, spans)], ["doc_id", "spans"])

    held = places.groupBy("doc_id").agg(F.collect_list("place").alias("held"))  # of one document
    return stored(held.mapInArrow(joined, SPANS_DDL), name)


def line_units(rows: DataFrame, least_words: int, least_chars: int) -> DataFrame:
    """(k1, k2, doc_id, start, words): a 128-bit digest of every line that is a unit and where it is, in words."""

    def found(row: dict) -> tuple:
        words, _, lines = read_words(row["body"], least_words, least_chars)
        digests = [xxhash.xxh3_128_digest(b" ".join(words[a : a + b])) for a, b in lines]
        keys = np.frombuffer(b"".join(digests), np.int64).reshape(-1, 2)
        at = np.array(lines, np.int32).reshape(-1, 2)
        return keys[:, 0], keys[:, 1], np.full(len(lines), row["doc_id"], np.int64), at[:, 0], at[:, 1]

    return rows.mapInArrow(made_batches(found, pa.schema(FIELDS)), UNIT_DDL)


def passage_units(rows: DataFrame, gone: DataFrame, least_words: int, passage_words: int, reach: int, least_chars: int) -> DataFrame:
    """Like :func:`line_units`, of the passages that can repeat; those inside one span of ``gone`` (removed lines) are left out.

    The words of a text are read again for each of the two uses of the seeds, which is cheaper than storing them.
    """

    def seeds_of(row: dict) -> tuple:
        words, marks, _ = read_words(row["body"], least_words, least_chars)
        seed, start, n, again = seed_runs(words, passage_words, reach)
        if row["spans"]:
            at, to = (np.array([s[k] for s in row["spans"]], np.int64) for k in ("start", "end"))
            line = np.searchsorted(at, start, "right") - 1
            longest = passage_words * (2 if marks.any() else 1)
            left = (line < 0) | (start + n - 1 + longest > to[line])
            seed, start, n, again = seed[left], start[left], n[left], again[left]
        # A run in which equal passages may stand counts twice.
        each = np.where(again, 2, 1)
        return np.repeat(seed.view(np.int64), each), np.full(each.sum(), row["doc_id"], np.int64), np.repeat((start.astype(np.int64) << LENGTH_BITS) | n, each)

    def passages_of(row: dict) -> tuple:
        words, marks, _ = read_words(row["body"], least_words, least_chars)
        (k1, k2), size = passages_at(words, marks, passage_words, MIX[:2])
        wanted = np.zeros(len(k1), bool)
        for run in row["spans"]:
            wanted[run["start"] : run["end"]] = True
        at = np.flatnonzero(wanted & (size > 0))
        start, n = past_first(k1[at], at, size[at])
        return k1[at].view(np.int64), k2[at].view(np.int64), np.full(len(at), row["doc_id"], np.int64), start.astype(np.int32), n.astype(np.int32)

    fields = pa.schema([("k1", pa.int64()), ("doc_id", pa.int64()), ("place", pa.int64())])
    seeds = rows.join(gone, "doc_id", "left").select("doc_id", "body", "spans").mapInArrow(made_batches(seeds_of, fields), SEED_DDL)
    often = seeds.groupBy("k1").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k1")
    again = lookup(seeds, often, ["k1"], "left_semi")
    runs = spans_of(again.select("doc_id", "place"), "runs")
    return rows.join(runs, "doc_id").select("doc_id", "body", "spans").mapInArrow(made_batches(passages_of, pa.schema(FIELDS)), UNIT_DDL)


def removed_words(docs: DataFrame, *, id: str = "doc_id", text: str = "text", least_words: int = 8, passage_words: int = 12, reach: int = 5, least_chars: int = LEAST_CHARS) -> DataFrame:
    """(doc_id, spans): the words of each document, from 0, that belong to a unit of which an earlier occurrence exists. Rows with a null id have none."""
    rows = docs.select(F.col(f"`{id}`").cast("long").alias("doc_id"), text_bytes(text).alias("body")).filter("doc_id IS NOT NULL")
    lines = repeats(stored(line_units(rows, least_words, least_chars), "lines"))
    span = F.struct(F.col("start").cast("long").alias("start"), (F.col("start") + F.col("words")).cast("long").alias("end"))
    gone = stored(lines.groupBy("doc_id").agg(F.sort_array(F.collect_set(span)).alias("spans")), "removed-lines")
    passages = repeats(stored(passage_units(rows, gone, least_words, passage_words, reach, least_chars), "passages"))
    whole = gone.select("doc_id", F.explode("spans").alias("s")).select("doc_id", F.col("s")["start"].alias("start"), (F.col("s")["end"] - F.col("s")["start"]).alias("words"))
    place = F.shiftleft(F.col("start").cast("long"), LENGTH_BITS).bitwiseOR(F.col("words").cast("long")).alias("place")
    return spans_of(whole.select("doc_id", place).unionByName(passages.select("doc_id", place)), "removed-words")


def without_repeats(docs: DataFrame, *, id: str = "doc_id", text: str = "text", least_words: int = 8, passage_words: int = 12, reach: int = 5, least_chars: int = LEAST_CHARS) -> DataFrame:
    """``docs`` with repeated units cut from ``text``, and removed: array<struct<start, end>> in code points of the original text.

    Overlapping units are removed as one span, from its first word to its last; white space around it stays, but a line
    that is removed whole goes with its line break. A null or empty text and a null id keep their row as it is; rows that
    share an id are one document, of which each is cut at the same words; an empty table stays empty; other columns pass
    through, and the new name gets underscores in front where a column has it.
    """
    given, held, gone = (spare(n, docs.columns) for n in ("cut", "unit_list", "removed"))
    cuts = removed_words(docs, id=id, text=text, least_words=least_words, passage_words=passage_words, reach=reach, least_chars=least_chars)
    joined = docs.join(cuts.toDF(given, held), F.col(f"`{id}`").cast("long") == F.col(given), "left").drop(given)
    span = StructType([StructField("start", LongType()), StructField("end", LongType())])
    schema = StructType([*docs.schema.fields, StructField(gone, ArrayType(span))])

    def cut(value: str, places: list[dict]) -> tuple[str, list[dict]]:
        words = [m.span() for m in WORD.finditer(value)]
        kept, at, out = [], 0, []
        for a, b in ((p["start"], min(p["end"], len(words))) for p in places if p["start"] < len(words)):
            start, end = words[a][0], words[b - 1][1]
            out.append({"start": start, "end": end})
            before, after = value[:start].rpartition("\n")[2], value[end:].partition("\n")[0]
            whole = not before.strip(" \t\x0b\x0c\r") and not after.strip(" \t\x0b\x0c\r") and end + len(after) < len(value)
            kept.append(value[at:start])
            at = end + len(after) + 1 if whole else end
        return "".join([*kept, value[at:]]), out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index(text)
            texts, spans = [], []
            for value, places in zip(batch.column(at).to_pylist(), batch.column(batch.num_columns - 1).to_pylist()):
                left, removed = cut(value, places) if value and places else (value, [])
                texts.append(left)
                spans.append(removed)
            columns = batch.columns[:-1]
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, SPANS)], [*batch.schema.names[:-1], gone])

    return joined.mapInArrow(run, schema)

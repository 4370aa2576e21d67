"""Alignment against a plain version with dictionaries, and its bitmaps against sets."""

import collections
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from stallwatch.llm import alignment, queries
from stallwatch.llm.tokens import byte_letters
from tests.llm.helpers import empty_docs, odd_docs, odd_rows

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def tokens(text, a, b, letters):
    """(id, bytes) of both sides, or none."""
    if not text:
        return [], []
    ids = a.encode(" " + text, add_special_tokens=False).ids
    left = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in ids]
    right = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in ((i, b.id_to_piece(i)) for i in b.encode(text))]
    whole = (" " + text).encode()
    return (left, right) if b"".join(t for _, t in left) == whole == b"".join(t for _, t in right) else ([], [])


def plain(rows):
    a, b, letters = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B), {v: k for k, v in byte_letters().items()}
    a.encode_special_tokens = True
    docs, count, holders = [], collections.Counter(), collections.defaultdict(set)
    for row, (doc_id, text) in enumerate(rows):
        sides = []
        for side in tokens(text, a, b, letters):
            at, ends = 0, []
            for i, piece in side:
                at += len(piece)
                ends.append((at, i))
            sides.append(ends)
        cuts = sorted({e for e, _ in sides[0]} & {e for e, _ in sides[1]})
        links = [(i, j) for e, i in sides[0] for f, j in ([] if e not in set(cuts) else [x for x in sides[1] if x[0] == e])] if len(sides[0]) < 3000 else None
        if links is None:
            by = dict(sides[1])
            links = [(i, by[e]) for e, i in sides[0] if e in by]
        groups, low = [], 0
        where = [{c: [] for c in cuts} for _ in sides]
        for side, put in zip(sides, where):
            k = 0
            for e, i in side:
                while e > cuts[k]:
                    k += 1
                put[cuts[k]].append(i)
        text_of = ";".join(",".join(map(str, where[0][c])) + "|" + ",".join(map(str, where[1][c])) for c in cuts)
        count.update(links)
        for link in links:
            holders[link].add(row)
        docs.append((doc_id, len(sides[0]), len(sides[1]), len(cuts), links, hashlib.sha256(text_of.encode()).hexdigest() if cuts else ""))
    most = collections.Counter()
    for (_, j), n in count.items():
        most[j] = max(most[j], n)
    out = [(d, na, nb, g, len(ls), sum(count[x] == most[x[1]] for x in ls), sum(count[x] for x in ls), sha) for d, na, nb, g, ls, sha in docs]
    return collections.Counter(out), {(i, j): (len(holders[i, j]), n, n == most[j]) for (i, j), n in count.items()}


HARD = ["<|endoftext|> </s> <s>", "▁under", "a  b\t\n\n c", "naïve ÀÉß İ ſ", "漢字かな 😀👍🏽", "\x00\x1c\x1f\x85\xa0 x", "é ​﻿", "don't we'll 123 4½", " ", "x" * 3000, "ﬁ ① Ａ"]


@pytest.mark.parametrize("limits", [{}, {"most_postings": 40, "container_docs": 3}])
def test_alignment_equals_the_plain_version(spark, limits):
    rows = [(r[0], r[1]) for r in odd_rows()] + [(100 + i, t) for i, t in enumerate(HARD)]
    df = odd_docs(spark).select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(HARD)], "doc_id bigint, text string"))
    made = alignment.align_tokenizers(df.repartition(3).withColumn("pair", F.lit("x")).withColumn("KIND", F.lit(1)), A, B, **limits)
    documents, pairs = plain(rows)
    assert collections.Counter(map(tuple, made.documents.collect())) == documents
    assert {(r.a, r.b): (r.n_docs, r.n_links, r.best) for r in made.pairs.collect()} == pairs


def test_rank_table_and_file_give_the_same_ids():
    side, rng = alignment.ByteLevel(A), random.Random(4)
    assert side.ranks is not None
    letters = [chr(c) for c in range(0x250)] + [" "] * 200 + list("ab1'st \n\t.") * 30
    for _ in range(3000):
        text = "".join(rng.choices(letters, k=rng.randrange(1, 40)))
        assert side.ids(text) == side.tokenizer.encode(text, add_special_tokens=False).ids


def test_bitmaps_are_sets():
    rng = np.random.default_rng(2)
    sets = [np.unique(rng.integers(0, 1 << 16, n)) for n in (0, 1, 5, 1500, 2048, 2500, 40000)] + [np.arange(1 << 16)]
    for s in sets:
        assert (alignment.slots_of(alignment.pack(s)) == s).all() and alignment.popcount(alignment.pack(s)) == len(s)
        for t in sets:
            assert (alignment.slots_of(alignment.either([alignment.pack(s), alignment.pack(t), alignment.pack(sets[1])])) == np.unique(np.concatenate([s, t, sets[1]]))).all()


def test_empty_table_and_query(spark, folder):
    made = alignment.align_tokenizers(empty_docs(spark), A, B)
    assert made.documents.count() == 0 and made.pairs.count() == 0
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    assert collections.Counter(map(tuple, queries.QUERIES["op13_cross_tokenizer"](spark, folder).collect())) == plain(rows)[0]

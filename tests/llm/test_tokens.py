"""Token ids, wavelet shards and packing: exact round trips."""

import array
import collections
import math
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from stallwatch.llm import packing, wavelet
from stallwatch.llm.tokens import Encoder
from tests.llm.helpers import empty_docs, odd_docs, odd_rows

PATH = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return array.array("I", tokenizer.encode(text or "", add_special_tokens=False).ids + [1]).tobytes()


ODD_TEXTS = [
    "", " \n", "İstanbul ΑΣ ς don't we'll áb é <|endoftext|>x 1234 ab12  x　y naïve² ½ ª K ſ ß ẞ ÿÀ\x1cq", "a\x1cb it's. it's'  x\u0085y é",
    "Thre*** of%%% THE!! was&&& ch|ch -- a_b a-b x's' (535) 555-5022", "😀".encode("utf-16", "surrogatepass").decode("utf-16") + " 漢字 かな",
]


def test_word_wise_ids_equal_those_of_whole_texts(tokenizer, spark, folder):
    encoder = Encoder(PATH, most_words=64)
    assert encoder.by_word
    texts = ODD_TEXTS + [r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    for text in texts:
        assert encoder.ids(text.encode()) + (1).to_bytes(4, "little") == ids_of(tokenizer, text)


def test_other_builds_are_encoded_whole():
    path = public_tokenizers.path("byte_bpe_50k.json")
    encoder = Encoder(path)
    assert not encoder.by_word
    assert encoder.ids(b"two  words") == array.array("I", Tokenizer.from_file(path).encode("two  words", add_special_tokens=False).ids).tobytes()


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5000])
def test_wavelet_matrix_answers_like_the_plain_sequence(n):
    rng = np.random.default_rng(n)
    values = (rng.zipf(1.3, n) % 49408).astype(np.uint16)
    made = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(values, 16).to_bytes())
    assert (made.values() == values).all()
    for i in rng.integers(0, n, 30) if n else []:
        assert made.access(int(i)) == values[i]
    for token in [*values[:5].tolist(), 49000, 1 << 20, -1]:
        where = np.flatnonzero(values == token)
        assert made.count(token) == len(where)
        assert made.count(token, n // 3, n // 2) == ((where >= n // 3) & (where < n // 2)).sum()
        assert [made.find(token, k) for k in range(min(4, len(where)))] == where[:4].tolist()
    with pytest.raises(IndexError):
        made.access(n)


@pytest.mark.parametrize("clash", [False, True])
def test_shards_read_back_exactly(spark, tokenizer, tmp_path, clash):
    wavelet.write_shards(odd_docs(spark, clash), str(tmp_path / "w"), PATH, shard_tokens=64)
    shards = wavelet.read_shards(spark, str(tmp_path / "w"))
    assert shards.count() > 5
    want = sorted(((d, ids_of(tokenizer, t)) for d, t, *_ in odd_rows()), key=lambda r: (r[0] is not None, r[0] or 0, len(r[1])))
    got = sorted(wavelet.documents_of(shards).collect(), key=lambda r: r.start)
    at, every = 0, b""
    for row, (doc, ids) in zip(got, want, strict=True):
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32, bytes(row.ids)) == (doc, at, len(ids) // 4, zlib.crc32(ids), ids)
        at, every = at + row.n_tokens, every + ids
    stream = np.frombuffer(every, "<u4")
    for token in (1, int(collections.Counter(stream.tolist()).most_common(2)[1][0])):
        assert sorted(r.position for r in wavelet.occurrences(shards, token).collect()) == np.flatnonzero(stream == token).tolist()


def test_no_documents_give_no_shards_and_no_pieces(spark, tmp_path):
    wavelet.write_shards(empty_docs(spark), str(tmp_path / "w"), PATH)
    assert wavelet.documents_of(wavelet.read_shards(spark, str(tmp_path / "w"))).count() == 0
    assert packing.pack(empty_docs(spark), PATH).count() == 0


@pytest.mark.parametrize("room, block, clash", [(2048, 4096, False), (64, 4, True), (7, 3, False)])
def test_every_token_is_packed_once_and_gaplessly(spark, tokenizer, room, block, clash):
    rows = packing.pack(odd_docs(spark, clash), PATH, room=room, block_docs=block).collect()
    pieces, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert r.length == len(r.ids) // 4 > 0 and r.ids_crc32 == zlib.crc32(r.ids)
        pieces[r.doc_id, r.doc_tokens].append(r)
        sequences[r.sequence_id].append(r)
    want = collections.defaultdict(list)
    for d, t, *_ in odd_rows():
        want[d, len(ids_of(tokenizer, t)) // 4].append(ids_of(tokenizer, t))
    assert set(pieces) == set(want)
    for key, parts in pieces.items():
        copies = len(want[key])
        joined = b"".join(bytes(p.ids) for p in sorted(parts, key=lambda p: p.start))
        if copies == 1:
            assert joined == want[key][0]
        assert sum(p.length for p in parts) == key[1] * copies
    waste = 0
    for parts in sequences.values():
        parts.sort(key=lambda p: p.offset)
        assert [p.offset for p in parts] == [sum(q.length for q in parts[:i]) for i in range(len(parts))]
        filled = sum(p.length for p in parts)
        assert filled <= room
        waste += room - filled
    blocks = max(1, math.ceil(len(odd_rows()) / block))
    assert waste < room * blocks


def test_cheapest_sequence_first():
    parts = packing.assign(np.array([6, 5, 4, 3]), 10, 1.0, 0.1)
    assert [(p, s) for p, _, _, s, _ in parts] == [(0, 0), (1, 1), (2, 1), (3, 0)]
    assert packing.assign(np.array([7, 7, 6]), 10, 1.0, 0.1)[2:] == [(2, 0, 3, 0, 7), (2, 3, 3, 1, 7)]

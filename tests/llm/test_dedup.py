"""Line, near-duplicate and substring deduplication against brute force."""

import collections
import random
import re

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from stallwatch.llm import lines, simhash, units
from tests.llm.helpers import DOCS, empty_docs, odd_docs, odd_rows, sentence

BLANKS = " \t\n\x0b\x0c\r"


def ascii_lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def brute_lines(rows, min_chars, min_docs):
    held = collections.defaultdict(set)
    for doc, text in rows:
        if doc is not None:
            for line in (text or "").split("\n"):
                held[ascii_lower(line.strip(BLANKS))].add(doc)
    often = {k: max(d) for k, d in held.items() if len(k) >= min_chars and len(d) >= min_docs}
    out = []
    for doc, text in rows:
        every = (text or "").split("\n")
        kept = [x for x in every if doc is None or often.get(ascii_lower(x.strip(BLANKS)), doc) == doc]
        out.append((doc, len(every), len(every) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


def cleaned(index, df):
    made = index.clean(df)
    total, gone = made.columns[-2:]
    return sorted(((r["doc_id"], r[total], r[gone], r["text"] or "") for r in made.collect()), key=str)


@pytest.mark.parametrize("clash", [False, True])
def test_line_dedup_equals_brute_force_on_odd_rows(spark, tmp_path, clash):
    df = odd_docs(spark, clash)
    index = lines.LineIndex(spark, str(tmp_path))
    index.insert(df)
    assert cleaned(index, df) == brute_lines([(d, t) for d, t, *_ in odd_rows()], 40, 5)
    assert index.clean(df).columns[: len(df.columns)] == df.columns


def test_line_dedup_is_incremental_and_reversible(spark, tmp_path):
    rng = random.Random(3)
    pool = [sentence(i, 12) for i in range(40)]
    rows = [(i, "\n".join(rng.choice(pool[:4] if rng.random() < 0.4 else pool) for _ in range(4)), "en", "s", 1) for i in range(60)]
    index = lines.LineIndex(spark, str(tmp_path), min_docs=4, shard_keys=4)
    state = {}
    first, second, third = rows[:30], rows[30:50], rows[50:]
    for step, (put, out) in enumerate([(first, []), (second, []), ([], second), (third, []), (second, [])]):
        if put:
            index.insert(spark.createDataFrame(put, DOCS))
        if out:
            index.delete(spark.createDataFrame(out, DOCS))
        state = {**{d: t for d, t in state.items() if d not in {r[0] for r in out}}, **{r[0]: r[1] for r in put}}
        now = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in state.items()], DOCS)
        assert cleaned(index, now) == brute_lines(list(state.items()), 40, 4), step
        often = index.counts().filter("n_docs >= 4").count()
        assert sum(r["keys"] for r in index.filters().collect()) == often
    assert index.shards > 1


def test_cuckoo_filter_holds_what_went_in_and_forgets_what_came_out():
    rng = np.random.default_rng(1)
    k1, k2 = rng.integers(-(1 << 62), 1 << 62, (2, 5000))
    made = lines.CuckooFilter.of(k1, k2)
    assert made.holds(k1, k2).all() and made.keys == 5000
    assert made.holds(*rng.integers(-(1 << 62), 1 << 62, (2, 20000))).mean() < 0.002
    for place in list(zip(*made.places(k1, k2)))[:2500]:
        made.delete(*place)
    again = lines.CuckooFilter.from_bytes(made.to_bytes(), made.keys)
    assert again.keys == 2500 and again.holds(k1[2500:], k2[2500:]).all() and again.holds(k1[:2500], k2[:2500]).mean() < 0.01


def test_empty_tables(spark, tmp_path):
    index = lines.LineIndex(spark, str(tmp_path))
    index.insert(empty_docs(spark))
    assert index.clean(empty_docs(spark)).count() == 0
    assert index.clean(odd_docs(spark)).filter("n_dropped > 0").count() == 0
    assert simhash.near_duplicates(empty_docs(spark)).count() == 0
    assert units.without_repeats(empty_docs(spark)).count() == 0


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", ascii_lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def test_fingerprints_equal_the_definition():
    for text in ["", " \n", "One", "one two", "A b C d É İ", "x y " * 70000, *[t or "" for _, t, *_ in odd_rows()]]:
        assert simhash.fingerprint(text.encode()) == brute_fingerprint(text)


@pytest.mark.parametrize("radius", [2, 4])
def test_ball_links_give_the_components_of_all_pairs(spark, radius):
    rng = random.Random(radius)
    fps = set()
    for _ in range(25):
        base = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 12)):
            fps.add(base)
            for _ in range(rng.randrange(0, radius + 2)):
                base ^= 1 << rng.randrange(64)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = [(r.u, r.v) for r in simhash.ball_links(spark.createDataFrame([(f,) for f in signed], "fp bigint"), radius=radius).collect()]
    assert all(0 < ((a ^ b) & ((1 << 64) - 1)).bit_count() <= radius for a, b in links)

    def components(pairs):
        root = {f: f for f in signed}

        def find(x):
            while root[x] != x:
                x = root[x]
            return x

        for a, b in pairs:
            root[max(find(a), find(b))] = min(find(a), find(b))
        return {f: find(f) for f in signed}

    every = [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & ((1 << 64) - 1)).bit_count() <= radius]
    assert components(links) == components(every)


@pytest.mark.parametrize("clash", [False, True])
def test_near_duplicates_of_odd_rows(spark, clash):
    got = sorted((str(r.doc_id), r.fingerprint, r.component_id) for r in simhash.near_duplicates(odd_docs(spark, clash)).collect())
    rows = [(d, brute_fingerprint(t or "")) for d, t, *_ in odd_rows()]
    root = list(range(len(rows)))
    for _ in rows:
        for i, (_, a) in enumerate(rows):
            for j, (_, b) in enumerate(rows):
                if (a ^ b).bit_count() <= 2:
                    root[i] = root[j] = min(root[i], root[j])
    named = {k: min((d for (d, _), r in zip(rows, root) if r == k and d is not None), default=None) for k in set(root)}
    assert got == sorted((str(d), f"{f:016x}", named[r]) for (d, f), r in zip(rows, root))
    kept = simhash.keep_first(odd_docs(spark, clash))
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(map(str, named.values()))


def test_one_row_of_each_component_stays_whatever_its_id(spark):
    from tests.llm.helpers import sentence

    a, b, c = sentence(1, 40), sentence(2, 40), sentence(3, 40)
    rows = [(1, a), (2, a), (2, b), (3, c), (3, c), (None, b), (None, None), (4, a + " "), (None, sentence(5, 30)), (None, sentence(6, 30))]
    kept = simhash.keep_first(spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("kept_n", F.lit(1))).collect()
    assert collections.Counter((r.doc_id, r.text) for r in kept) == collections.Counter([(1, a), (2, b), (3, c), (None, None), (None, sentence(5, 30)), (None, sentence(6, 30))])


def test_line_index_lives_on_between_sessions(spark, tmp_path):
    folder, line = str(tmp_path / "index"), "a line of more than forty characters, said again and again"
    docs = spark.createDataFrame([(i, f"{line}\nown {i}") for i in range(8)], "doc_id bigint, text string")
    lines.LineIndex(spark, folder, min_docs=3).insert(docs.filter("doc_id < 2"))
    again = lines.LineIndex(spark, folder, min_docs=3)
    assert again.version == 1 and again.counts().first().n_docs == 2
    again.insert(docs.filter("doc_id >= 2"))
    (tmp_path / "index" / "v3").mkdir()  # what a stopped batch leaves
    third = lines.LineIndex(spark, folder, min_docs=3)
    third.delete(docs.filter("doc_id = 7"))
    assert third.version == 3 and third.counts().first().asDict() | {"shard": 0} == third.counts().first().asDict() and third.counts().first().n_docs == 7
    kept = {r.doc_id: r.text for r in lines.LineIndex(spark, folder, min_docs=3).clean(docs.filter("doc_id < 7")).collect()}
    assert kept == {i: f"own {i}" for i in range(6)} | {6: f"{line}\nown 6"}
    again.insert(docs.filter("doc_id = 7"))  # an older handle goes on from the newest version
    assert again.version == 4 and again.counts().first().n_docs == 8 and not (tmp_path / "index" / "v2").exists()


def brute_units(rows, **settings):
    first = {}
    for doc, text in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        for unit, start, _ in units.units_of((text or "").encode(), **settings):
            first.setdefault(unit, (doc, start))
            first[unit] = min(first[unit], (doc, start))
    out = {}
    for doc, text in rows:
        words = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", text or "")]
        hit = [False] * len(words)
        for unit, start, n in units.units_of((text or "").encode(), **settings) if doc is not None else []:
            if first[unit] != (doc, start):
                hit[start : start + n] = [True] * n
        out[doc] = [words[i] for i, h in enumerate(hit) if h]
    return out


@pytest.mark.parametrize("clash", [False, True])
def test_substring_dedup_equals_brute_force(spark, clash):
    settings = {"least_words": 8, "passage_words": 12, "reach": 5}
    passage = sentence(77, 60)
    extra = [(300 + i, f"{sentence(400 + i, 30 + i)} {passage} {sentence(500 + i, 40)}", "en", "s", 1) for i in range(5)]
    df = odd_docs(spark, clash)
    df = df.unionByName(spark.createDataFrame(extra, DOCS), allowMissingColumns=True)
    rows = [(d, t) for d, t, *_ in [*odd_rows(), *extra]]
    want = brute_units(rows, **settings)
    made = units.without_repeats(df)
    name = made.columns[-1]
    texts = dict(rows)
    for r in made.collect():
        covered = [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", texts[r.doc_id] or "") if any(s["start"] <= m.start() and m.end() <= s["end"] for s in r[name])]
        assert covered == want[r.doc_id]
        if not r[name]:
            assert r.text == texts[r.doc_id]
        else:
            kept = [w for w in re.findall(r"\S+", texts[r.doc_id])]
            assert len(re.findall(r"\S+", r.text)) == len(kept) - len(covered)
        if r.doc_id is not None and r.doc_id > 300 and r.doc_id < 305:
            assert sum(s["end"] - s["start"] for s in r[name]) > 0.5 * len(passage)
        if r.doc_id == 300:
            assert not r[name]


def test_a_copied_passage_is_found_wherever_it_stands():
    found = 0
    for seed in range(300):
        passage = sentence(seed, 51)
        a = set(u for u, *_ in units.units_of(f"{sentence(seed + 1000, 17)} {passage} {sentence(seed + 2000, 9)}".encode(), 8, 12, 5))
        b = set(u for u, *_ in units.units_of(f"{sentence(seed + 3000, 4)}\n{passage}, {sentence(seed + 4000, 23)}".encode(), 8, 12, 5))
        found += bool(a & b)
    assert found == 300


def test_every_word_of_a_pasted_passage_goes(spark):
    rows = []
    for i in range(40):
        passage = sentence(9000 + i, 12 + i)
        rows += [(2 * i, f"{sentence(i + 1000, 17)} {passage} {sentence(i + 2000, 9)}"), (2 * i + 1, f"{sentence(i + 3000, 4)}\n{sentence(i, 3)} {passage.upper()} {sentence(i + 4000, 23)}")]
    run = "alpha beta gamma delta " * 5  # no word of a short cycle has a smaller hash than its neighbours
    rows += [(90, f"{sentence(90, 20)} {run}{sentence(91, 20)}"), (91, f"{sentence(92, 20)} {run}{sentence(93, 20)}"), (92, sentence(94, 5) + " again" * 30)]
    left = {r.doc_id: (r.text, r.removed) for r in units.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    for i in range(40):
        assert not left[2 * i][1]
        assert left[2 * i + 1][0].split() == f"{sentence(i + 3000, 4)} {sentence(i, 3)} {sentence(i + 4000, 23)}".split()
    assert left[91][0].split() == f"{sentence(92, 20)} {sentence(93, 20)}".split()
    assert left[92][0].split() == f"{sentence(94, 5)}{' again' * 12}".split()  # the first passage stays whole


def test_short_lines_of_many_characters_and_text_without_spaces_are_cut(spark):
    rng = random.Random(5)

    def han(n):
        return "".join(chr(rng.randrange(0x4E00, 0x9FA5)) for _ in range(n))

    address, line, passage = "https://example.org/a/rather/long/address/of/one/word", han(30), han(30)
    rows = [
        (1, f"{address}\nfew words\n{sentence(1, 20)}"), (2, f"{address}\nfew words\n{sentence(2, 20)}"),
        (3, address), (4, f"{line}\n{han(9)}"), (5, f"{line}\n{han(9)}"), (6, f"{han(20)}{passage}{han(20)}"), (7, f"{han(15)}{passage}{han(15)}"),
    ]
    left = {r.doc_id: r.text for r in units.without_repeats(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()}
    texts = dict(rows)
    assert left[1] == texts[1] and left[2] == f"few words\n{sentence(2, 20)}" and left[3] == ""
    assert left[4] == texts[4] and left[5] == texts[5].partition("\n")[2]
    assert left[6] == texts[6] and left[7] == texts[7].replace(passage, "")

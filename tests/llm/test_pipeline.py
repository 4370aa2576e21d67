"""The pipeline's stages against brute force, and the registered queries."""

import re
import zlib

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
import corpus_pipeline
from stallwatch.llm import leaks, queries, rules, simhash
from stallwatch.llm.common import stored
from tests.llm.test_dedup import brute_lines
from verify import TABLES, rows as canonical_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    out.append(docs)
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SF), f"test-{name}")
        out.append(docs)
    return out


def texts(df):
    return {r.doc_id: r.text for r in df.collect()}


def test_each_stage_takes_effect_and_keeps_the_columns(spark, stages):
    raw, ruled, lined, distinct, clean, packed = stages
    for df in (ruled, lined, distinct, clean):
        assert df.columns == raw.columns and [f.dataType for f in df.schema] == [f.dataType for f in raw.schema]
    judged = rules.judge(raw, rules.fit_rules(raw, spark.read.parquet(f"{SF}/labels.parquet"))).filter("kept")
    assert texts(ruled) == texts(judged.select(*raw.columns)) and ruled.count() < raw.count()
    want = brute_lines(list(texts(ruled).items()), 40, 5)
    assert texts(lined) == {d: t for d, _, _, t in want} and any(n for _, _, n, _ in want)
    assert all(r.n_chars == len(r.text) for r in lined.collect() if r.text != texts(ruled)[r.doc_id])
    components = {r.doc_id: r.component_id for r in simhash.near_duplicates(lined).collect()}
    assert texts(distinct) == {d: t for d, t in texts(lined).items() if components[d] == d} and distinct.count() < lined.count()
    leaky = {r.doc_id for r in leaks.contained_items(distinct, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert texts(clean) == {d: t for d, t in texts(distinct).items() if d not in leaky}


def test_the_last_stage_packs_all_that_is_left(spark, stages):
    clean, packed = texts(stages[4]), stages[5].collect()
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    total = 0
    for p in packed:
        ids = b"".join(i.to_bytes(4, "little") for i in tokenizer.encode(clean[p.doc_id], add_special_tokens=False).ids + [1])
        assert p.doc_tokens == len(ids) // 4 and zlib.crc32(ids[4 * p.start : 4 * (p.start + p.length)]) == p.ids_crc32
        total += p.length
    assert total == sum({p.doc_id: p.doc_tokens for p in packed}.values()) and {p.doc_id for p in packed} == set(clean)


def test_run_gives_the_rows_of_its_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[5].collect()))


def test_eleven_queries_are_registered():
    names = set(entry.queries())
    assert "pipeline" in names and all(any(re.match(rf"op{n}_", q) for q in names) for n in range(1, 11))
    assert set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_query_equals_its_sql_twin(spark, folder, name):
    import duckdb

    db = duckdb.connect()
    for t in TABLES:
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    df = entry.queries()[name](spark, folder)
    cursor = db.execute(queries.ORACLE[name])
    assert canonical_rows(df.columns, [tuple(r) for r in df.collect()]) == canonical_rows([c[0] for c in cursor.description], cursor.fetchall())

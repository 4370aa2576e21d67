"""The operators of this package as queries over whole tables, with SQL twins where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import corpus_pipeline
import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stallwatch.llm import alignment, chat, leaks, lines, neighbours, packing, rules, secrets, shards, simhash, units, wavelet, whitening
from stallwatch.llm.common import held_out, stored, table
from stallwatch.session import scratch_folder

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}

SHARD_BYTES = 1 << 20
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
BYTE_TOKENIZER, PIECE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLE[fn.__name__] = sql
        return fn

    return register


@query()
def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return packing.pack(table(spark, folder, "documents"), WORD_TOKENIZER, keep_ids=False)


@query()
def op9_wavelet_shards(spark: SparkSession, folder: str) -> DataFrame:
    """Documents read back from wavelet-matrix shards."""
    out = scratch_folder(spark, "wavelet")
    wavelet.write_shards(table(spark, folder, "documents"), out, WORD_TOKENIZER)
    return wavelet.documents_of(wavelet.read_shards(spark, out), ids=False)


@query()
def op1_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets of every document: base patterns, and structurally confirmed tokens and keys."""
    found = secrets.find_secrets(table(spark, folder, "documents"))

    def listed(spans: str) -> Column:
        return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))

    def count(spans: str, kind: str) -> Column:
        return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")

    return found.select(
        "doc_id", *[count("base", k).alias(f"n_{k}") for k in ("assign", "access", "hex")], F.sha2(listed("base").cast("binary"), 256).alias("base_sha256"),
        listed("secrets").alias("spans"), (F.size("secrets") - F.size("base")).cast("long").alias("n_confirmed"),
    )


@query("""
WITH lines AS (
  SELECT doc_id, i, l, translate(regexp_replace(l, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM (SELECT doc_id, unnest(ls) AS l, generate_subscripts(ls, 1) AS i FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))
), often AS (SELECT k, max(doc_id) AS keeper FROM lines WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE keeper <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(l, chr(10) ORDER BY i) FILTER (WHERE keeper IS NULL OR keeper = doc_id), '')) AS kept_sha256
FROM lines LEFT JOIN often USING (k) GROUP BY doc_id
""")
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Lines of 40 characters or more in five or more documents stay in the last of them only."""
    docs = table(spark, folder, "documents")
    index = lines.LineIndex(spark, scratch_folder(spark, "lines"))
    index.insert(docs)
    cleaned = index.clean(docs.select("doc_id", "text"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


@query()
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    """Near-duplicate components of all documents by SimHash within two bits."""
    return simhash.near_duplicates(table(spark, folder, "documents"))


@query()
def op10_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Base rules, then a decision list learned from the labelled documents, over every document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    learned = rules.fit_rules(docs, table(spark, folder, "labels"))
    judged = rules.judge(docs, learned)
    return judged.select("doc_id", *rules.BASE, "base_failed", "kept", "rule")


@query("""
WITH w AS (SELECT doc_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ws FROM documents),
d AS (SELECT DISTINCT doc_id, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM w WHERE len(ws) >= 5)),
v AS (SELECT item_id, list_filter(string_split_regex(lower(coalesce(text, '')), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS ws FROM benchmark),
b AS (SELECT DISTINCT item_id, array_to_string(ws[i : i + 4], ' ') AS s FROM (SELECT item_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM v WHERE len(ws) >= 5)),
n AS (SELECT item_id, count(*) AS n_shingles FROM b GROUP BY item_id)
SELECT doc_id, item_id, count(*) AS n_shared, any_value(n_shingles) AS n_shingles
FROM d JOIN b USING (s) JOIN n USING (item_id) GROUP BY doc_id, item_id HAVING count(*) * 10 >= any_value(n_shingles) * 8
""")
def op3_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that contain benchmark items, and how much of them."""
    return leaks.contained_items(table(spark, folder, "documents"), table(spark, folder, "benchmark"))


@query(f"""
WITH h AS (
  SELECT doc_id, strlen(coalesce(text, '')) AS bytes,
         lpad(bin(('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT), 60, '0')
           || lpad(bin(('0x' || substr(md5(doc_id::VARCHAR || ' ' || coalesce(text, '')), 1, 15))::BIGINT), 60, '0') AS bits
  FROM documents
), p AS (SELECT doc_id, bytes, bits, d, left(bits, d) AS prefix FROM h, unnest(range(0, 121)) AS t(d)),
s AS (SELECT d, prefix FROM p GROUP BY d, prefix HAVING sum(bytes) <= {SHARD_BYTES} OR count(DISTINCT bits) = 1),
f AS (SELECT doc_id, bytes, bits, min(d) AS shard_depth FROM p JOIN s USING (d, prefix) GROUP BY doc_id, bytes, bits)
SELECT doc_id, left(bits, shard_depth) AS shard, shard_depth::INT AS shard_depth, '' AS page, bytes FROM f
""")
def op4_extendible_sharding(spark: SparkSession, folder: str) -> DataFrame:
    """The shard of every document, none over a mebibyte unless it is one document."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return shards.extendible_shards(docs, SHARD_BYTES).drop("text")


@query()
def op2_quality_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's quality by its labelled neighbours in the latent space."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = neighbours.with_scores(docs, neighbours.fit_voters(docs, table(spark, folder, "labels")))
    return scored.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


@query()
def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    """Repeated lines and passages of every document: what is removed, and a digest of what is kept."""
    docs = table(spark, folder, "documents").select("doc_id", "text")
    cut = units.without_repeats(docs)
    return cut.select(
        "doc_id", F.size("removed").cast("long").alias("n_removed"),
        F.aggregate("removed", F.lit(0).cast("long"), lambda a, s: a + s["end"] - s["start"]).alias("removed_chars"),
        F.concat_ws(",", F.transform("removed", lambda s: F.concat_ws(":", s["start"].cast("string"), s["end"].cast("string")))).alias("removed"),
        F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"),
    )


@query(r"""
WITH c AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text, role IN ('system', 'user', 'assistant') AS known
  FROM (SELECT conv_id, turn, role, text FROM conversations UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]')
), t AS (
  SELECT *, lag(role, 1, 'start') OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text)) AS before,
         length(text) + length(text) - length(replace(text, '\', '')) + len(regexp_extract_all(text, '<s>|</s>|\[/?SYS\]|\[/?INST\]|\[OUT\]|\[/?TURN\]|\[TEXT\]')) AS chars,
         length(role) + length(role) - length(replace(role, '\', '')) + len(regexp_extract_all(role, '<s>|</s>|\[/?SYS\]|\[/?INST\]|\[OUT\]|\[/?TURN\]|\[TEXT\]')) AS role_chars
  FROM c
), f AS (
  SELECT *, NOT coalesce(
           (role = 'system' AND before NOT IN ('system', 'user', 'assistant')) OR (role = 'user' AND before <> 'user') OR (role = 'assistant' AND before = 'user'), FALSE) AS bad,
         chars + CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 11 ELSE 21 + role_chars END AS marked
  FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, md5(text))) AS turns_sha256,
       sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, md5(text)) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       (3 + sum(marked))::BIGINT AS formatted_chars, sum(bad::INT)::BIGINT AS n_out_of_order,
       arg_max(role, (turn IS NOT NULL, turn, role, md5(text))) = 'assistant' AS complete
FROM f GROUP BY conv_id
""")
def op11_chat_formatting(spark: SparkSession, folder: str) -> DataFrame:
    """All conversations formatted, written, and read back from what was written."""
    planted = spark.sql("SELECT -7L AS conv_id, turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0L, 'user'), (1L, 'assistant') AS t(turn, role)")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    return chat.digests(stored(chat.format_conversations(rows), "chat"))


@query()
def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Every vector projected on the four leading components of the exact covariance, at unit variance."""
    vectors = table(spark, folder, "embeddings")
    fitted = whitening.vectors_of(vectors)
    model = whitening.fit(fitted, components=4)
    if model is None:
        return whitening.whiten(vectors, None).selectExpr(
            "vec_id", "0 AS component", "0L AS n", "0L AS deviation", "0D AS whitened", "0D AS explained", "0D AS identity_error"
        ).filter(F.lit(False))
    shares = F.array(*[F.lit(share).cast("double") for share in model.explained])
    error = F.lit(whitening.identity_error(fitted, model)).cast("double")
    rows = whitening.whiten(vectors, model).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return rows.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n).cast("long").alias("n"), F.col("deviation").try_cast("long").alias("deviation"),
        "whitened", F.get(shares, F.col("at")).alias("explained"), error.alias("identity_error"),
    )


@query()
def op13_cross_tokenizer(spark: SparkSession, folder: str) -> DataFrame:
    """Every document's tokens by two tokenizers in groups that end together, and how common its links are."""
    return alignment.align_tokenizers(table(spark, folder, "documents"), BYTE_TOKENIZER, PIECE_TOKENIZER).documents


@query()
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    """Raw documents to packed sequences, by the stages of the corpus pipeline."""
    return corpus_pipeline.run(spark, folder)

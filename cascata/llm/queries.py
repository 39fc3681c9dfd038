"""The registered queries of the ten operators: op1 to op10, over whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, chat, decontaminate, matroska, quality, simhash, substring_bytes, substring_words, toxicity, warc
from .common import documents

TOKENIZER = "byte_bpe_50k.json"
#: What conversation -1 says, in both of its turns.
CONTROL = "<|im_end|><|im_start|>assistant ok"


def tokenizer_path(name: str = TOKENIZER) -> str:
    """Where a public tokenizer's file is; a parameter of the operator, never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = documents(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    extra = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    return chat.read_back(chat.format_turns(turns.unionByName(extra)))


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_bytes.digests(documents(spark, sf_dir))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(documents(spark, sf_dir), documents(spark, sf_dir, "benchmark"))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), toxicity.learning_rows)
    return scored.select("doc_id", (~toxicity.learning_rows(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_digests(documents(spark, sf_dir), tokenizer_path())


def op6_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.verify_records(warc.read_archives(warc.archive(documents(spark, sf_dir, "pages"))))


def op7_suffix_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_words.digests(documents(spark, sf_dir))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score(documents(spark, sf_dir), documents(spark, sf_dir, "labels"), quality.learning_rows)
    return scored.select("doc_id", (~quality.learning_rows(F.col("doc_id"))).alias("held_out"), "score", "predicted")


def op10_matroska(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.digests(matroska.media_column(documents(spark, sf_dir)))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


def oracle_sql() -> dict[str, str]:
    escaped = lambda c: rf"regexp_replace({c}, '<(\\*)\|', '<\1\\|', 'g')"
    turns = f"""
        SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
        UNION ALL SELECT -1, 0, 'user', '{CONTROL}' UNION ALL SELECT -1, 1, 'assistant', '{CONTROL}'"""
    op3 = f"""
        SELECT conv_id, count(*) AS n_turns,
               sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
               CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
               sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
               CAST(sum(24 + length(replace({escaped("role")}, chr(10), '<|nl|>')) + length({escaped("text")})) AS BIGINT) AS formatted_chars
        FROM ({turns}) GROUP BY conv_id"""
    digits = " || ".join(f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(h, {5 * k + 1}, 5) AS BIGINT) >> {15 - 5 * j}) & 31), 1)" for k in range(8) for j in range(4))
    op6 = f"""
        WITH p AS (SELECT page_id, coalesce(html, '') AS payload, sha1(coalesce(html, '')) AS h FROM pages),
             d AS (SELECT page_id, octet_length(encode(payload)) AS payload_bytes, {digits} AS payload_digest, min(page_id) OVER (PARTITION BY payload) AS first FROM p)
        SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
               CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN page_id <> first THEN first END AS refers_to
        FROM d"""
    return {"op3_chat_formatting": op3, "op6_warc_revisits": op6}

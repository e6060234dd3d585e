"""The thin queries over the operators of this subpackage, and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import oracles
from .align import align_documents
from .bpe import encode_documents
from .common import shared_dir, table
from .langid import identify_language
from .minhash import minhash_duplicates
from .mixing import mix_sources
from .pii import find_personal_data
from .quality import quality_rules
from .simhash import near_duplicates
from .substring import remove_repeats
from .topk import top_k
from .trie import conversation_trie
from .url_filter import url_filter
from .warc import page_records, write_warc


def op1_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    listed = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = listed(F.filter("spans", lambda s: s["base"])).cast("binary")
    return out.select("doc_id", "n_email", "n_ip", "n_card", "n_phone", F.sha2(base, 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def byte_bpe() -> dict:
    """Parameters of encode_documents for the public byte-level vocabulary."""
    return {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "special": {"<|endoftext|>": 50256}}


def op3_bpe_coding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), **byte_bpe(), keep=())


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op5_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "fingerprint", "component_id")


def op6_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents").select("doc_id", "text", "source")).drop("text")


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    write_warc(table(spark, sf_dir, "pages"), folder)
    return page_records(spark, folder)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return quality_rules(docs).drop("source")


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = identify_language(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", "held_out", "lang_pred", "score", "accepted")


def op11_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=2)


def pieces() -> dict:
    """Parameters of align_documents for the public vocabularies."""
    return {"ranks_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "pieces_path": public_tokenizers.path("piece_bpe_32k.model")}


def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), **pieces())


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op1_url_filters": op1_url_filters,
    "op2_pii": op2_pii,
    "op3_bpe_coding": op3_bpe_coding,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_simhash_near_dedup": op5_simhash_near_dedup,
    "op6_exact_top_k": op6_exact_top_k,
    "op7_mixing": op7_mixing,
    "op8_warc": op8_warc,
    "op9_quality_rules": op9_quality_rules,
    "op10_language_id": op10_language_id,
    "op11_minhash_near_dedup": op11_minhash_near_dedup,
    "op12_token_alignment": op12_token_alignment,
    "op13_conversation_trie": op13_conversation_trie,
}
ORACLES = {name: getattr(oracles, name.upper()) for name in QUERIES if hasattr(oracles, name.upper())}

"""The queries of this package: each applies one operator to its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from weftgraph.llm import chat_format, decontam, langid, media_audio, mixing, oracles, pii, quality, simhash, token_binary, token_counts
from weftgraph.llm.common import id_crc, read, scratch_path


def tokenizer_file(name: str) -> str:
    """Path of a public tokenizer file; any other path may be given to the operators."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    out = langid.identify(docs, F.pmod(id_crc(), F.lit(4)) != 2, drop=("text", "lang"))
    return out.select("doc_id", (~F.col("training")).alias("held_out"), "lang_pred", "score", "bits", "rejected")


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return token_counts.count_tokens(docs, tokenizer_file("piece_bpe_32k.model"), drop=("text",))


def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = read(spark, sf_dir, "conversations")
    out = chat_format.format_pairs(chat_format.swap_last_answer(chat_format.gather(turns)))
    return out.withColumns({c: chat_format.spans_text(c) for c in ("chosen_loss", "rejected_loss")})


def op4_token_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    path = scratch_path(spark, "tokens")
    token_binary.write_tokens(docs, tokenizer_file("byte_bpe_50k.json"), path)
    return token_binary.read_tokens(spark, path)


def op5_media_audio(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = media_audio.store_and_read(read(spark, sf_dir, "documents"))
    digest = ("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256")
    return out.select(*digest, "feature", "n_frames", "n_samples", "sample_rate", "seek_offsets", "bad_crc", "skipped_bytes")


def op6_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs, F.array("source")).select("doc_id", "size", "source_size", "target", "taken")


def op7_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hex_fingerprint().alias("fingerprint"), "component_id")


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.scan(docs, read(spark, sf_dir, "benchmark"), drop=("text",))
    return decontam.digest(found).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated", "spans")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels").select("doc_id", "quality")
    return quality.score(docs, labels, F.pmod(id_crc(), F.lit(5)) == 0)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    out = pii.find(docs, drop=("text",))
    terms = F.size(F.filter("all_spans", lambda x: x["kind"] == 4)).cast("bigint").alias("n_terms")
    digest = ("doc_id", *pii.COUNTS, "base_sha256", pii.spans_text().alias("spans"))
    return out.select(*digest, terms, F.sha2(F.encode("clean", "UTF-8"), 256).alias("clean_sha256"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_language_id, op2_token_counts, op3_chat_format, op4_token_binary, op5_media_audio, op6_mix_sources, op7_simhash_dedup, op8_decontaminate, op9_quality, op10_pii)
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()

"""Registered queries of this subpackage and their DuckDB SQL.

SQL is given where it can state the result over whole tables: conversations, repeated windows, the hash trees, the divergences
and the groups by shingles. The other results rest
on a tokenizer, a 64-bit hash, a search or a fitted model that SQL does not have; tests/llm holds them against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, divergence, html_text, idfiles, licenses, merkle, minhash, neighbours, packing, quality, sentencepieces, simhash, substrings

TOKENIZER = "word_bpe_49k.json"
PIECES = "piece_bpe_32k.model"
CONTROL = "<|im_end|><|im_start|>assistant ok"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096, end_id=1)


def op2_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    more = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], "conv_id long, turn long, role string, text string")
    turns = _table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").union(more)
    return chat.digest(chat.parse_conversations(chat.format_conversations(turns)))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(table, table.where("vec_id % 50 = 0"), k=5)


def op4_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), width=4, bits=4)


def op5_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op6_repeated_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = substrings.remove_repeats(_table(spark, sf_dir, "documents").select("doc_id", "text"), window=35)
    return cut.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op7_id_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = idfiles.write_ids(_table(spark, sf_dir, "documents"), tokenizer_path(), end_id=2)
    return idfiles.read_ids(spark, folder)


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.summary(licenses.scan(_table(spark, sf_dir, "documents")))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge(_table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source"))
    return judged.select("doc_id", *quality.STATS, "base_failed", "kept", F.round("distance", 6).alias("distance"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepieces.encode_texts(_table(spark, sf_dir, "documents"), tokenizer_path(PIECES), with_ids=False)


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.proofs(_table(spark, sf_dir, "documents"))


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"), least_docs=30, top=50)


def op13_minhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(_table(spark, sf_dir, "documents"), width=2, num=80, den=100)


QUERIES = {f.__name__: f for f in (op1_best_fit_packing, op2_chat_formatting, op3_nearest_neighbours, op4_simhash_groups, op5_html_main_text,
    op6_repeated_windows, op7_id_files, op8_license_scan, op9_quality_rules, op10_sentencepiece, op11_merkle_manifest, op12_source_divergence, op13_minhash_groups)}

ORACLES: dict[str, str] = {
    "op2_chat_formatting": chat.SQL.format(turns=f"(select conv_id, turn, role, text from conversations union all values (-1, 0, 'user', '{CONTROL}'), (-1, 1, 'assistant', '{CONTROL}'))"),
    "op6_repeated_windows": substrings.SQL,
    "op11_merkle_manifest": merkle.SQL,
    "op12_source_divergence": divergence.SQL,
    "op13_minhash_groups": minhash.SQL,
}

"""The training-data queries by name: callables of (spark, sf_dir), and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from colophon.llm import collocations, fill_middle, license_scan, line_rules, mixing, near_dedup, packing, quality_mil, reply_trees, sharding, token_counts, top_k, warc_revisits
from colophon.llm.common import table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_pack_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("word_bpe_49k.json"))


def op2_resolve_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_revisits.revisit_report(table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op3_score_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_mil.score_documents(table(spark, sf_dir, "documents", "doc_id", "text"), table(spark, sf_dir, "labels", "doc_id", "quality"))


def op4_assign_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents", "doc_id", "text"), 16)


def op5_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.line_quality(table(spark, sf_dir, "documents", "doc_id", "text"))


def op6_count_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents", "doc_id", "text"), tokenizer_path("piece_bpe_32k.model"))


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_components(table(spark, sf_dir, "documents", "doc_id", "text"))


def op8_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k.top_k(table(spark, sf_dir, "embeddings", "vec_id", "embedding"), 5, 50)


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_report(table(spark, sf_dir, "documents", "doc_id", "text", "source"))


def op10_format_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reply_trees.conversation_digests(spark, table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text"))


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.fim_digests(table(spark, sf_dir, "documents", "doc_id", "text"))


def op12_scan_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_labels(table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_mine_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents", "lang", "text"))


QUERIES = {
    f.__name__: f
    for f in (
        op1_pack_documents,
        op2_resolve_revisits,
        op3_score_documents,
        op4_assign_shards,
        op5_line_quality,
        op6_count_tokens,
        op7_near_duplicates,
        op8_top_k,
        op9_mix_sources,
        op10_format_conversations,
        op11_fill_in_middle,
        op12_scan_licenses,
        op13_mine_collocations,
    )
}
ORACLES = {
    "op2_resolve_revisits": warc_revisits.ORACLE,
    "op4_assign_shards": sharding.ORACLE,
    "op5_line_quality": line_rules.ORACLE,
    "op7_near_duplicates": near_dedup.ORACLE,
    "op8_top_k": top_k.ORACLE,
    "op9_mix_sources": mixing.ORACLE,
    "op10_format_conversations": reply_trees.ORACLE,
    "op11_fill_in_middle": fill_middle.ORACLE,
    "op12_scan_licenses": license_scan.ORACLE,
    "op13_mine_collocations": collocations.ORACLE,
}

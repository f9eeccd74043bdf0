"""One query per operator of this package, with production parameters, over whole tables."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from versight.llm import line_cleaning, quotations, url_filter


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from versight.llm.token_counts import count_tokens

    return count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), limit=512)


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from versight.llm.byte_bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


def op3_line_cleaning(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_cleaning.clean_lines(table(spark, sf_dir, "documents")).drop("clean_text")


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from versight.llm.ngram_jaccard import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents"))


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    from versight.llm.decontamination import leaks

    return leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from versight.llm.personal_data import find_personal_data

    return find_personal_data(table(spark, sf_dir, "documents"))


def op4_warc_bundles(spark: SparkSession, sf_dir: str) -> DataFrame:
    from versight.llm.warc_bundles import archive_folder, read_bundles, write_bundles

    index = write_bundles(table(spark, sf_dir, "pages"), archive_folder(spark))
    ids = {"page_id": F.col("record_id").try_cast("long"), "refers_to": F.col("refers_to").try_cast("long")}
    return read_bundles(index).select(ids["page_id"].alias("page_id"), "payload_bytes", "payload_digest", "record_type", ids["refers_to"].alias("refers_to"))


def op6_url_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge_urls(table(spark, sf_dir, "pages"))


def op2_quotation_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotations.link_quotations(table(spark, sf_dir, "conversations"))


def op5_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    from versight.llm.block_labeller import main_text

    return main_text(table(spark, sf_dir, "pages"))


def op11_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    from versight.llm.tokenizer_alignment import align

    return align(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    from versight.llm.permutation_index import search

    return search(table(spark, sf_dir, "embeddings"), every=100, k=10)


def op13_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    from versight.llm.conversation_trie import conversation_trie

    return conversation_trie(table(spark, sf_dir, "conversations"))


QUERIES = {
    "op13_conversation_trie": op13_conversation_trie,
    "op12_permutation_index": op12_permutation_index,
    "op11_tokenizer_alignment": op11_tokenizer_alignment,
    "op5_main_text": op5_main_text,
    "op2_quotation_links": op2_quotation_links,
    "op6_url_verdicts": op6_url_verdicts,
    "op4_warc_bundles": op4_warc_bundles,
    "op7_personal_data": op7_personal_data,
    "op9_benchmark_leaks": op9_benchmark_leaks,
    "op8_ngram_jaccard": op8_ngram_jaccard,
    "op3_line_cleaning": op3_line_cleaning,
    "op1_token_counts": op1_token_counts,
    "op10_byte_bpe": op10_byte_bpe,
}

ORACLE_SQL: dict[str, str] = {}
ORACLE_SQL["op3_line_cleaning"] = line_cleaning.oracle()
ORACLE_SQL["op6_url_verdicts"] = url_filter.oracle()
ORACLE_SQL["op2_quotation_links"] = quotations.oracle()

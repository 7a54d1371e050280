"""The registered queries of the training-data operators, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table
from .content_sort import content_sort
from .cotrain import score_documents
from .decontaminate import find_leaks
from .fuzzy_lines import dropped_lines
from .golay_simhash import near_groups
from .secret_forest import scan, train
from .soft_mixing import mix
from .sstable import round_trip
from .trie_counts import count_tokens
from .url_tree import judge_urls


def op1_secret_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), train(spark, vocabulary())).withColumnRenamed("id", "doc_id")


def op2_aho_corasick(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_leaks(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "leak.n_words", "leak.n_hit", "leak.n_items", "leak.items_sha256", "leak.contaminated")


def op7_golay_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op9_content_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = content_sort(table(spark, sf_dir, "documents"), keep="largest")
    return found.withColumnRenamed("id", "doc_id")


#: (verdict, host, path)
URL_RULES = [("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/")]


def op8_url_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(table(spark, sf_dir, "pages"), URL_RULES).withColumnRenamed("id", "page_id")


def op3_trie_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"), vocabulary("piece_bpe_32k.model")).withColumnRenamed("id", "doc_id")


def op4_cotraining(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.withColumnRenamed("id", "doc_id")


def op5_fuzzy_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dropped_lines(table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


#: Shares of tokens by language.
MIX_TARGETS = {"en": 0.5, "de": 0.2, "fr": 0.15, "es": 0.15}


def op6_soft_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id"), MIX_TARGETS)
    return found.withColumnRenamed("id", "doc_id").drop("h")


def vocabulary(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op10_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = round_trip(table(spark, sf_dir, "documents"), vocabulary())
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


QUERIES = {
    "op1_secret_forest": op1_secret_forest,
    "op2_aho_corasick": op2_aho_corasick,
    "op3_trie_counts": op3_trie_counts,
    "op4_cotraining": op4_cotraining,
    "op5_fuzzy_lines": op5_fuzzy_lines,
    "op6_soft_mixing": op6_soft_mixing,
    "op7_golay_simhash": op7_golay_simhash,
    "op8_url_tree": op8_url_tree,
    "op9_content_sort": op9_content_sort,
    "op10_sstable": op10_sstable,
}

ORACLE = {
    "op9_content_sort": """
        WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS norm FROM documents),
        g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY norm)
        SELECT n.doc_id, g.keep_id, g.group_size, n.doc_id = g.keep_id AS kept, sha256(n.norm) AS text_sha256 FROM n JOIN g USING (norm)""",
}

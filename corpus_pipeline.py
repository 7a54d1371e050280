"""The training-data pipeline: quality, near-duplicates, leaked tests, mix, token shards.

Every stage takes all rows of the one before it and, but for the last, returns its columns, whatever their names and however
many there are. Null texts count as empty; rows without an id are kept by the stages that compare documents; an empty table
gives an empty one. Repeated rows are rows like others until the near-duplicate stage, which keeps those with the id that
stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import cotrain, decontaminate, golay_simhash, soft_mixing, sstable
from lectern.llm.common import cut, drop_cut, table
from lectern.llm.queries import MIX_TARGETS, vocabulary


def reject_bad(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the co-trained classifier finds bad or toxic go. Without labels none does."""
    return cotrain.keep_good(docs, table(spark, sf_dir, "labels"))


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents connected by a Jaccard similarity of 0.8 over five-word shingles, that with the smallest id stays."""
    return golay_simhash.drop_near_copies(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with any window of ten words of a benchmark item go."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def mix_to_targets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated until languages have their shares of the words; none is lost."""
    return soft_mixing.apply_mix(docs, table(spark, sf_dir, "labels").select("doc_id"), MIX_TARGETS)


def write_token_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all texts in shards, read back: one row for each row of ``docs``."""
    found = sstable.round_trip(docs, vocabulary())
    return found.select(F.col("id").alias("doc_id"), "start", "n_tokens", "ids_crc32")


STAGES = [
    ("quality classifier", reject_bad),
    ("SimHash near-dedup", one_of_each_group),
    ("benchmark decontamination", drop_leaks),
    ("mixing sources to target weights", mix_to_targets),
    ("token-ID output", write_token_shards),
]

#: SQL can't express the classifier, the fingerprint of whole texts, or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, cut(stage(spark, docs, sf_dir), name.split()[0].lower())
        drop_cut(before)  # a stage's table goes once the next one's is written
    return STAGES[-1][1](spark, docs, sf_dir)

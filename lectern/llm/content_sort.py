"""Exact dedup by content sort (DataFrame functions only).

Normalised texts are range-partitioned by sampled splitters, on their first bytes and then a hash, and sorted externally
down to the whole text, so that equal texts lie next to each other; neighbours are compared in full and each run of equals
keeps one row.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import ascii_lower, cut, named, packed


def content_sort(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "smallest",
    normalise: Callable[[Column], Column] = ascii_lower, hot_share: float = 1 / 5000, hot_rows: int = 256, rows_a_salt: int = 200_000,
) -> DataFrame:
    """One row per input row: ``id, keep_id, group_size, kept, text_sha256``.

    A text that makes up ``hot_share`` of all rows (and at least ``hot_rows``) is sorted on (text, salt), so its run is
    cut over ranges, more with more rows; the runs' partial results are merged by an aggregate that combines before its
    shuffle. At most ``1 / hot_share`` texts can be hot, which bounds the list of their hashes and the broadcast of their
    merged rows. Finding them costs one pass that shuffles a hash and a count for each distinct text of a task.

    ``keep``: "smallest" or "largest" id stays. Null text: as empty. Null id: never the id that stays unless its group
    has no other; then ``keep_id`` is null and its rows are kept. Repeated rows with one id are counted apart, and share
    their fate. Other columns are not read. An empty table gives no rows.
    """
    if keep not in ("smallest", "largest"):
        raise ValueError(f"keep: {keep}")
    best = F.min if keep == "smallest" else F.max
    rows = docs.select(named(id_col).alias("id"), normalise(named(text_col)).alias("norm"))
    counts = rows.groupBy(F.xxhash64("norm").alias("h")).agg(F.count("*").alias("n"))
    # a text with a share of hot_share of all rows passes the floor for any total that the counts can have
    total = docs.count()
    floor = max(hot_rows, int(total * hot_share))
    hot = [r.h for r in counts.where(F.col("n") >= floor).select("h").collect()]
    is_hot = F.xxhash64("norm").isin(hot) if hot else F.lit(False)
    salts = max(64, total // rows_a_salt)  # were all rows of one text, a run would have some rows_a_salt of them
    salt = F.when(is_hot, F.pmod(F.xxhash64("id"), F.lit(salts)) + 1).otherwise(F.lit(0))
    # The sampled keys go to the driver, so they are short: the first bytes, and a hash that parts texts which share them.
    dealt = rows.withColumns({"head": F.substring(F.col("norm").cast("binary"), 1, 24), "h": F.xxhash64("norm"), "salt": salt})
    # The window needs rows clustered and sorted by its columns: range partitions of some of them are clustered already.
    run = W.partitionBy("head", "h", "salt", "norm")
    found = dealt.repartitionByRange("head", "h", "salt").select(
        "id", "norm", "salt", best("id").over(run).alias("keep_id"), F.count("*").over(run).alias("group_size")
    ).select("id", "keep_id", "group_size", "salt", F.unhex(F.sha2(F.col("norm").cast("binary"), 256)).alias("sha"))
    if hot:
        found = cut(found, "runs")
        merged = found.where("salt > 0").groupBy("sha").agg(best("id").alias("hot_keep"), F.count("*").alias("hot_size"))
        found = found.join(F.broadcast(merged), "sha", "left").withColumns({  # at most 1 / hot_share rows
            "keep_id": F.when(F.col("hot_size").isNull(), F.col("keep_id")).otherwise(F.col("hot_keep")),
            "group_size": F.coalesce("hot_size", "group_size"),
        })
    return found.select("id", "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), F.lower(F.hex("sha")).alias("text_sha256"))


def drop_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the rows that :func:`content_sort` drops; rows with a null id stay."""
    gone = content_sort(docs, id_col, text_col, **how).where("not kept and id is not null").select("id")
    return packed(docs, id=named(id_col)).join(gone, "id", "left_anti").select("row.*")

"""Running headers, page numbers and footnotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

BAND = 0.09


def in_band(band: float = BAND) -> Column:
    """Whether a line touches the top or bottom margin."""
    return (F.col("y0") < F.col("ph") * band) | (F.col("y1") > F.col("ph") * (1 - band))


def header_pages(lines: DataFrame, band: float = BAND) -> DataFrame:
    """``book_id, header_key, page``: the pages in whose margins each key stands."""
    return lines.where(in_band(band)).select("book_id", T.header_key(F.col("text")).alias("header_key"), "page").distinct()


def repeated_keys(lines: DataFrame, band: float = BAND, least_pages: int = 3, largest_gap: float = 2.0) -> DataFrame:
    """Keys that repeat every page or every other: three pages or more, and a median gap of two at most.

    The window is over one key's pages, without texts; a key of every page of a long book costs it one row a page.
    """
    pages = header_pages(lines, band)
    gap = F.col("page") - F.lag("page").over(W.partitionBy("book_id", "header_key").orderBy("page"))
    per_key = pages.withColumn("gap", gap).groupBy("book_id", "header_key").agg(F.count("*").alias("pages"), F.median("gap").alias("gap"))
    return per_key.where((F.col("pages") >= least_pages) & (F.col("gap") <= largest_gap))


def mark_running_text(lines: DataFrame, band: float = BAND) -> DataFrame:
    """``lines`` with ``is_running``: in a margin, and a page number or a repeated key.

    Only the lines of margins have a key and are joined; the body of a book passes by as it is.
    """
    inside = F.coalesce(in_band(band), F.lit(False))
    margins = lines.where(inside).withColumn("header_key", T.header_key(F.col("text")))
    repeated = repeated_keys(lines, band).select("book_id", "header_key", F.lit(True).alias("repeats"))
    both = margins.join(repeated, ["book_id", "header_key"], "left")
    running = F.coalesce(F.col("header_key").isNotNull() & (T.is_page_number(F.col("text")) | F.coalesce("repeats", F.lit(False))), F.lit(False))
    return both.select(*lines.columns, running.alias("is_running")).unionAll(lines.where(~inside).withColumn("is_running", F.lit(False)))


def strip_running_text(lines: DataFrame, band: float = BAND) -> DataFrame:
    return mark_running_text(lines, band).where("not is_running").drop("is_running")


def removed_counts(lines: DataFrame, band: float = BAND) -> DataFrame:
    """``book_id, kept, removed``."""
    return mark_running_text(lines, band).groupBy("book_id").agg(F.count_if(~F.col("is_running")).alias("kept"), F.count_if("is_running").alias("removed"))


def body_size(lines: DataFrame) -> DataFrame:
    """``book_id, body``: the font size of most characters; of equals, the one that comes first."""
    first = F.min(F.struct("page", "line_no"))
    per_size = lines.groupBy("book_id", "size").agg(F.sum(F.length("text")).alias("chars"), first.alias("first"))
    order = W.partitionBy("book_id").orderBy(F.desc("chars"), F.asc("first"))
    return per_size.withColumn("rank", F.row_number().over(order)).where("rank = 1").select("book_id", F.col("size").alias("body"))


def mark_footnotes(lines: DataFrame, small: float = 0.88, lower: float = 0.6) -> DataFrame:
    """``lines`` with ``is_footnote``: small print in the lower part of a page."""
    both = lines.join(body_size(lines), "book_id", "left")
    return both.select(*lines.columns, ((F.col("size") < F.col("body") * small) & (F.col("y0") > F.col("ph") * lower)).alias("is_footnote"))


def drop_footnotes(lines: DataFrame, **how) -> DataFrame:
    return mark_footnotes(lines, **how).where("not is_footnote").drop("is_footnote")

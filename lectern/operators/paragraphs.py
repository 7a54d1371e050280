"""Paragraphs from lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from . import layout


def in_book():
    return W.partitionBy("book_id").orderBy("page", "line_no")


def by_para():
    return W.partitionBy("book_id").orderBy("para_no")


def starts_paragraph() -> Column:
    """Of an annotated line with ``prev``, ``leading`` and ``indent_style``: whether it begins a paragraph."""
    text, before = F.col("text"), F.col("prev.text")
    indented, style = layout.is_indented(), F.col("indent_style")
    restyled = (F.abs(F.col("size") - F.col("prev.size")) > 1.0) | text.rlike(P.BULLET)
    jumped = (F.col("page") != F.col("prev.page")) | (F.col("base") < F.col("prev.base") - 0.5 * F.col("prev.size"))
    ended = T.ends_sentence(before)
    after_jump = (
        F.when(~ended & style & ~indented, F.lit(False)).when(~ended, ~T.continues_flow(before, text))
        .when(style, indented | layout.is_short(0.3, "prev")).otherwise(F.lit(True))
    )
    below = F.col("base") - F.col("prev.base") > 1.45 * F.col("leading")
    same_column = below | (ended & (indented | (~style & (layout.is_short(line="prev") | (F.col("block") != F.col("prev.block"))))))
    return (
        F.when(F.col("prev").isNull() | T.is_ornament(before) | T.is_ornament(text), F.lit(True))
        .when(restyled, F.lit(True)).when(jumped, after_jump).otherwise(same_column)
    )


def number_paragraphs(lines: DataFrame, default_leading: float = 14.0) -> DataFrame:
    """``lines`` with ``para_no``: a running count of the lines that begin a paragraph, over a book in reading order.

    Lines are read once and dealt twice: by page, for columns and neighbours on a page, and by book, for its leading and
    style and the lines in order. A book is read by one task, with its lines but no more; books are dealt over tasks.
    """
    book = W.partitionBy("book_id")
    rows = layout.annotate_columns(lines).withColumns({"__dy": layout.usable_step(), "next": layout.next_on_page()})
    rows = rows.withColumn("leading", F.coalesce(F.median("__dy").over(book), F.lit(default_leading)))
    start, indented = layout.paragraph_start()
    prev = F.lag(F.struct("text", "x1", "left", "right", "size", "base", "block", "page")).over(in_book())
    known = rows.withColumns({"indent_style": layout.has_indents(F.count_if(start).over(book), F.count_if(indented).over(book)), "prev": prev})
    numbered = known.withColumn("starts", starts_paragraph().cast("int")).withColumn("para_no", F.sum("starts").over(in_book().rowsBetween(W.unboundedPreceding, 0)).cast("int"))
    return numbered.select(*lines.columns, "para_no")


def build_paragraphs(lines: DataFrame) -> DataFrame:
    """``book_id, para_no, page, text``: lines joined, hyphens at their ends undone; the page is that of the first line."""
    ordered = F.array_sort(F.collect_list(F.struct("page", "line_no", "text")))
    groups = number_paragraphs(lines).groupBy("book_id", "para_no").agg(ordered.alias("lines"))
    return groups.select("book_id", "para_no", F.col("lines")[0]["page"].alias("page"), T.join_lines(F.col("lines.text")).alias("text"))


def tidy_paragraphs(paras: DataFrame, urls: bool = False, citations: bool = True) -> DataFrame:
    """``book_id, para_no, page, text, is_break``: tidied; contents lines and empty ones dropped; a short one of symbols
    alone is a break (its text null), a long one is dropped; a drop cap that stands alone is merged into what follows."""
    texts = paras.where(~T.is_dot_leader(F.regexp_replace("text", P.LEADING_BULLET, ""))).withColumn("text", T.tidy(F.col("text"), urls, citations)).where("text <> ''")
    kept = texts.withColumn("is_break", ~T.has_alnum(F.col("text"))).where(~F.col("is_break") | (F.length("text") <= 15))
    return merge_drop_caps(kept.withColumn("text", F.when(~F.col("is_break"), F.col("text"))).select("book_id", "para_no", "page", "text", "is_break"))


def merge_drop_caps(paras: DataFrame) -> DataFrame:
    """A paragraph of one letter goes into the next if that begins in lower case.

    In a run of such letters, what has just received a letter isn't a single letter any more; so the first, third and so on
    of each run are merged into the one after them.
    """
    able = F.coalesce(F.col("text").rlike(r"^\p{L}$") & T.starts_lower(F.lead("text").over(by_para())), F.lit(False))
    marked = paras.withColumn("able", able)
    last_not = F.max(F.when(~F.col("able"), F.col("at"))).over(by_para().rowsBetween(W.unboundedPreceding, 0))
    placed = marked.withColumn("at", F.row_number().over(by_para())).withColumn("run", F.col("at") - F.coalesce(last_not, F.lit(0)))
    gives = placed.withColumn("gives", F.col("able") & (F.col("run") % 2 == 1))
    cap = F.lag(F.when(F.col("gives"), F.struct("text", "page"))).over(by_para())
    merged = gives.withColumn("cap", cap)
    return merged.where("not gives").select(
        "book_id", "para_no", F.coalesce("cap.page", "page").alias("page"), F.when(F.col("cap").isNull(), F.col("text")).otherwise(F.concat("cap.text", "text")).alias("text"), "is_break")

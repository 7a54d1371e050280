"""Totals, previews, chapter marks and the metadata of an audiobook."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

WORDS_A_MINUTE = 150
SPEED_UP = 10  # how much faster than real time synthesis is taken to be


def section_words(sections: DataFrame) -> DataFrame:
    """``book_id, section_no, title, words``; breaks have none."""
    return sections.groupBy("book_id", "section_no", "title").agg(F.sum(F.when(F.col("is_break"), 0).otherwise(T.word_count(F.col("text")))).cast("long").alias("words"))


def book_totals(words: DataFrame) -> DataFrame:
    """``book_id, sections, total_words, hours, eta_minutes`` from :func:`section_words`."""
    hours = F.sum("words") / WORDS_A_MINUTE / 60
    return words.groupBy("book_id").agg(F.count("*").alias("sections"), F.sum("words").alias("total_words"), hours.alias("hours"), F.greatest(hours * 60 / SPEED_UP, F.lit(1.0)).alias("eta_minutes"))


def warnings(totals: DataFrame, books: DataFrame, least_words: int = 40) -> DataFrame:
    """``totals`` with ``low_text`` and ``no_chapters``, by ``books(book_id, is_epub, pages, chapter_source)``."""
    low = ~F.col("is_epub") & (F.col("pages") > 0) & (F.col("total_words") < F.col("pages") * least_words)
    return totals.join(books, "book_id").withColumns({"low_text": low, "no_chapters": F.col("chapter_source") == "fixed"})


def preview(words: DataFrame, first: int = 8) -> DataFrame:
    """The first sections of each book, numbered, titles shortened, with how many ``more`` there are."""
    own = W.partitionBy("book_id")
    ranked = words.withColumns({"number": F.row_number().over(own.orderBy("section_no")), "n": F.count("*").over(own)})
    return ranked.where(F.col("number") <= first).select("book_id", "number", T.shorten(F.col("title"), 43, 40).alias("title"), "words", F.greatest(F.col("n") - first, F.lit(0)).alias("more"))


def latest(log: DataFrame, last: int = 6) -> DataFrame:
    """The last rows of each book's log of chapters, with how many came ``earlier``."""
    own = W.partitionBy("book_id")
    ranked = log.withColumns({"__back": F.row_number().over(own.orderBy(F.desc("section_no"))), "__n": F.count("*").over(own)})
    return ranked.where(F.col("__back") <= last).withColumn("earlier", F.greatest(F.col("__n") - last, F.lit(0))).drop("__back", "__n")


def chapter_marks(chapters: DataFrame) -> DataFrame:
    """``book_id, chapter_no, title, start_ms, end_ms`` from durations ``ms``."""
    end = F.sum("ms").over(W.partitionBy("book_id").orderBy("chapter_no").rowsBetween(W.unboundedPreceding, 0))
    return chapters.withColumn("end_ms", end).select("book_id", "chapter_no", "title", (F.col("end_ms") - F.col("ms")).alias("start_ms"), "end_ms")


def metadata_text(marks: DataFrame, books: DataFrame) -> DataFrame:
    """``book_id, metadata``: an FFMETADATA file for each of ``books(book_id, title, author)``."""
    mark = F.concat(F.lit("\n[CHAPTER]\nTIMEBASE=1/1000\nSTART="), F.col("start_ms").cast("string"), F.lit("\nEND="), F.col("end_ms").cast("string"), F.lit("\ntitle="), T.escape_metadata(F.col("title")), F.lit("\n"))
    ordered = F.array_sort(F.collect_list(F.struct("chapter_no", mark.alias("mark"))))
    body = marks.groupBy("book_id").agg(F.array_join(ordered["mark"], "").alias("marks"))
    title, author = T.escape_metadata(F.col("title")), T.escape_metadata(F.col("author"))
    head = F.concat(F.lit(";FFMETADATA1\ntitle="), title, F.lit("\nartist="), author, F.lit("\nalbum="), title, F.lit("\n"))
    return books.join(body, "book_id", "left").select("book_id", F.concat(head, F.coalesce("marks", F.lit(""))).alias("metadata"))


def concat_list(chapters: DataFrame) -> DataFrame:
    """``book_id, concat_list``: a line for each chapter file ``path`` in order."""
    line = F.concat(F.lit("file '"), F.col("path"), F.lit("'\n"))
    return chapters.groupBy("book_id").agg(F.array_join(F.array_sort(F.collect_list(F.struct("chapter_no", line.alias("line"))))["line"], "").alias("concat_list"))


def total_length(chapters: DataFrame) -> DataFrame:
    """``book_id, total_ms, hours, minutes``."""
    ms = F.sum("ms")
    return chapters.groupBy("book_id").agg(ms.alias("total_ms"), F.floor(ms / 3600000).alias("hours"), F.floor(ms % 3600000 / 60000).alias("minutes"))


def outcome(done: Column | str = "ok") -> tuple[Column, Column]:
    """Counts of books done and failed."""
    ok = F.col(done) if isinstance(done, str) else done
    return F.count_if(ok).alias("done"), F.count_if(~ok).alias("failed")


def tool_report(checks: DataFrame) -> DataFrame:
    """``ok, fatal, warned`` over ``checks(name, status)`` with status ok, warn or fail."""
    return checks.agg(F.count_if(F.col("status") == "ok").alias("ok"), F.coalesce(F.bool_or(F.col("status") == "fail"), F.lit(False)).alias("fatal"), F.count_if(F.col("status") == "warn").alias("warned"))

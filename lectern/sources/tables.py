"""Lines of books from tables of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

LINE_SCHEMA = "book_id string, page int, line_no int, text string, x0 double, y0 double, x1 double, y1 double, size double, base double, block int, ph double"
PARA_SCHEMA = "book_id string, para_no int, page int, text string, is_break boolean"
TOC_SCHEMA = "book_id string, toc_no int, level int, title string, page int"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _pages(texts: DataFrame, book: Column, order: Column, text: Column) -> DataFrame:
    """``book_id, page, before, parts``: each row's lines; pages are numbered from 0 in ``order`` within a book, and
    ``before`` counts the lines that aren't blank of the pages before. What is ranked are numbers; texts stay where they are
    until they meet their page's."""
    rows = texts.select(book.cast("string").alias("book_id"), order.alias("ord"), F.split(text, "\n").alias("parts"))
    sizes = rows.groupBy("book_id", "ord").agg(F.sum(F.size(F.filter("parts", lambda t: F.trim(t) != ""))).alias("filled"))
    by_page = W.partitionBy("book_id").orderBy("ord")
    numbers = sizes.select("book_id", "ord", (F.row_number().over(by_page) - 1).alias("page"), F.coalesce(F.sum("filled").over(by_page.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    found = numbers.select(F.col("book_id").alias("b"), F.col("ord").alias("o"), "page", "before")
    return rows.join(found, rows["book_id"].eqNullSafe(F.col("b")) & rows["ord"].eqNullSafe(F.col("o"))).select("book_id", "page", "before", "parts")


def lines_of(texts: DataFrame, book: Column, order: Column, text: Column, line_height: float = 14.0) -> DataFrame:
    """Lines (``LINE_SCHEMA``) of a table in which each row is a page.

    Pages are numbered from 0 in ``order`` within a book. A line that is blank is dropped, though it takes its room, and a
    page without lines vanishes. As texts have no geometry, a line's place gives it one: lines are ``line_height`` apart;
    of six, one is set far to the left and one in a second column; short lines are set larger; five make a block.
    """
    rows = _pages(texts, book, order, text).select("book_id", "page", F.size("parts").alias("n"), F.posexplode("parts").alias("line_no", "text")).where(F.trim("text") != "")
    at = F.col("line_no")
    x0 = F.when(at % 6 == 0, 72.0).when(at % 6 == 3, 330.0).otherwise(90.0)
    return rows.select(
        "book_id", "page", "line_no", "text", x0.alias("x0"), (at * line_height).alias("y0"), (x0 + F.least(F.length("text"), F.lit(90)) * 3.0).alias("x1"),
        ((at + 1) * line_height).alias("y1"), F.when(F.length("text") < 60, 14.0).otherwise(12.0).alias("size"), ((at + 1) * line_height).alias("base"),
        F.floor(at / 5).cast("int").alias("block"), (F.col("n") * line_height).alias("ph"))


def document_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as books: the source is the book, a document a page."""
    return lines_of(read(spark, sf_dir, "documents"), F.col("source"), F.col("doc_id"), F.col("text"))


def document_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as paragraphs of books (``PARA_SCHEMA``): each line that isn't blank; ``para_no`` follows pages and lines."""
    return paragraphs_of(read(spark, sf_dir, "documents"))


def document_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as sections of books: a document is a section, titled by its number and language."""
    rows = read(spark, sf_dir, "documents").select("source", "doc_id", "lang", "text")
    numbers = rows.select(F.col("source").alias("book_id"), F.col("doc_id").alias("d")).distinct().withColumn("section_no", F.row_number().over(W.partitionBy("book_id").orderBy("d")))
    numbered = rows.join(numbers, rows["source"].eqNullSafe(F.col("book_id")) & rows["doc_id"].eqNullSafe(F.col("d")))
    title = F.concat(F.lit("Part "), F.col("section_no").cast("string"), F.lit(" = "), F.col("lang"))
    parts = numbered.select("book_id", "section_no", title.alias("title"), F.posexplode(F.split("text", "\n")).alias("para_no", "text")).where(F.trim("text") != "")
    return parts.withColumn("is_break", F.lit(False))


def chaptered(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents``, each with a chapter heading for its first line."""
    return read(spark, sf_dir, "documents").withColumn("text", F.concat(F.lit("Chapter "), F.col("doc_id").cast("string"), F.lit("\n"), F.col("text")))


def paragraphs_of(texts: DataFrame) -> DataFrame:
    """A table like ``documents`` as paragraphs of books (``PARA_SCHEMA``): each line that isn't blank; ``para_no`` follows
    pages and lines."""
    pages = _pages(texts, F.col("source"), F.col("doc_id"), F.col("text"))
    rows = pages.select("book_id", "page", "before", F.posexplode(F.filter("parts", lambda t: F.trim(t) != "")).alias("at", "text"))
    return rows.select("book_id", (F.col("before") + F.col("at") + 1).cast("int").alias("para_no"), F.col("page").cast("int").alias("page"), "text", F.lit(False).alias("is_break"))


def outline_of(texts: DataFrame) -> DataFrame:
    """An outline (``TOC_SCHEMA``) of a table like ``documents``, for books whose name ends in an even digit: an entry for each
    page, of level 1 or 2 by turns."""
    own = texts.where(F.right("source", F.lit(1)).isin("0", "2", "4", "6", "8")).select(F.col("source").alias("book_id"), "doc_id").distinct()
    rows = own.withColumn("page", F.row_number().over(W.partitionBy("book_id").orderBy("doc_id")))
    return rows.select("book_id", F.col("page").alias("toc_no"), (F.col("page") % 2 + 1).alias("level"), F.concat(F.lit("Entry "), F.col("doc_id").cast("string")).alias("title"), "page")


def document_layout(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as page layouts (``spans.LAYOUT_SCHEMA``): a line is its text and a raised note number; every fourth is
    rotated, and every third block of a page is a picture."""
    pages = _pages(read(spark, sf_dir, "documents"), F.col("source"), F.col("doc_id"), F.col("text"))
    at = lambda i: (i * 14 + 10).cast("double")

    def span(text: Column, size: float, flags: int, x: Column, y: Column) -> Column:
        return F.struct(text.alias("text"), F.lit(size).alias("size"), F.lit(flags).alias("flags"), F.array(x, y).alias("origin"))

    def line(text: Column, i: Column) -> Column:
        box = F.array(F.lit(72.0), at(i) - 10, F.lit(300.0), at(i) + 2)
        turned = F.when(i % 4 == 3, F.array(F.lit(0.0), F.lit(1.0))).otherwise(F.array(F.lit(1.0), F.lit(0.0)))
        return F.struct(turned.alias("dir"), box.alias("bbox"), F.array(span(text, 12.0, 0, F.lit(72.0), at(i)), span(F.lit("12"), 7.0, 1, F.lit(300.0), at(i) - 4)).alias("spans"))

    block = lambda own, i: F.struct(F.when(i % 3 == 2, 1).otherwise(0).alias("type"), F.array(own).alias("lines"))
    return pages.select("book_id", "page", (F.size("parts") * 14.0).cast("double").alias("ph"), F.transform(F.transform("parts", line), block).alias("blocks"))

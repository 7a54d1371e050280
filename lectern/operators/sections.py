"""Chapters: from an outline, from headings, or of fixed size; echoed titles; final touches.

Sections are long-form: ``book_id, section_no, title, para_no, text, is_break``, section 0 being what comes before the first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T
from . import chunks

FRONT = "Front matter"
COLUMNS = ["book_id", "section_no", "title", "para_no", "text", "is_break"]


def by_para():
    return W.partitionBy("book_id").orderBy("para_no")


def so_far():
    return by_para().rowsBetween(W.unboundedPreceding, 0)


def para_words() -> Column:
    """Words of a paragraph; a break counts as one."""
    return F.when(F.col("is_break"), F.lit(1)).otherwise(T.word_count(F.col("text"))).cast("long")


def outline_starts(toc: DataFrame, first: int | Column = 0, last: int | Column | None = None) -> DataFrame:
    """``book_id, page, title``: where sections start, by the outline ``toc`` (its pages count from 1).

    The smallest level with five entries or more is taken, else the level with most (of equals the first to occur), which
    needs two. Of titles on one page the smallest stays. A book whose outline is no use has no row.
    """
    rows = toc.select("book_id", "toc_no", "level", (F.col("page") - 1).alias("page"), T.collapse(F.col("title")).alias("title"))
    usable = rows.where((F.col("title") != "") & (F.col("page") >= first) & (F.lit(True) if last is None else F.col("page") <= last))
    levels = usable.groupBy("book_id", "level").agg(F.count("*").alias("n"), F.min("toc_no").alias("at"))
    most = F.max_by("level", F.struct("n", -F.col("at")))
    chosen = levels.groupBy("book_id").agg(F.coalesce(F.min(F.when(F.col("n") >= 5, F.col("level"))), F.when(F.max("n") >= 2, most)).alias("level"))
    return usable.join(chosen, ["book_id", "level"]).groupBy("book_id", "page").agg(F.min("title").alias("title"))


def _carried(paras: DataFrame, toc: DataFrame, first: int, last: int | None) -> DataFrame:
    """``paras`` with ``own(section_no, title)``, the last start at or before their page, null before all, and ``outlined``,
    whether their book has starts. Both are merged in page order and the title carried forward: an as-of join with one
    shuffle."""
    starts = outline_starts(toc, first, last)
    numbered = starts.withColumn("section_no", F.row_number().over(W.partitionBy("book_id").orderBy("page")))
    of_start = numbered.select("book_id", "page", F.struct("section_no", "title").alias("start"))
    both = of_start.unionByName(paras, allowMissingColumns=True)
    order = W.partitionBy("book_id").orderBy("page", F.col("para_no").asc_nulls_first()).rowsBetween(W.unboundedPreceding, 0)
    placed = both.withColumns({"own": F.last("start", ignorenulls=True).over(order), "outlined": F.max(F.col("start").isNotNull()).over(W.partitionBy("book_id"))})
    return placed.where("para_no is not null").drop("start")


def sections_from_outline(paras: DataFrame, toc: DataFrame, first: int = 0, last: int | None = None) -> DataFrame:
    """Each paragraph goes to the last start at or before its page; those before all starts are front matter. A book without
    starts has no row."""
    placed = _carried(paras.select("book_id", "page", "para_no", "text", "is_break"), toc, first, last).where("outlined")
    sections = placed.select("book_id", F.coalesce("own.section_no", F.lit(0)).alias("section_no"), F.coalesce("own.title", F.lit(FRONT)).alias("title"), "para_no", "text", "is_break")
    return drop_title_echo(sections)


def _is_heading(text: Column) -> Column:
    return (F.length(text) <= 80) & ~T.is_dot_leader(text) & (text.rlike(P.CHAPTER) | text.rlike(P.NAMED_HEADING))


def _is_bare(text: Column) -> Column:
    """A chapter heading of which nothing but its number is left."""
    return _is_heading(text) & text.rlike(P.CHAPTER) & (T.strip(F.regexp_extract(text, P.CHAPTER, 1)) == "")


def heading_candidates(paras: DataFrame) -> DataFrame:
    """``paras`` with ``candidate``, ``consumed`` (it is the subtitle of a bare heading before it), ``heading`` and ``words``.

    Only a bare chapter heading consumes, and a chapter heading is never consumed, so the row before decides.
    """
    text = F.col("text")
    before = F.lag("text").over(by_para())
    subtitle = ~F.col("is_break") & (text != "") & (F.length(text) <= 70) & ~T.ends_sentence(text) & ~text.rlike(P.CHAPTER)
    consumed = F.coalesce(_is_bare(before) & subtitle, F.lit(False))
    marked = paras.withColumn("consumed", consumed).withColumn("candidate", ~F.col("consumed") & F.coalesce(~F.col("is_break") & _is_heading(text), F.lit(False)))
    after = F.lead(F.struct("consumed", "text")).over(by_para())
    heading = F.when(F.col("candidate"), F.when(F.coalesce(after["consumed"], F.lit(False)), T.heading_title(text, after["text"])).otherwise(text))
    return marked.withColumn("heading", heading).withColumn("words", para_words())


def _headed(paras: DataFrame, min_words: int) -> DataFrame:
    """``paras`` with ``head(section_no, title)``, ``found`` (accepted headings of the book) and ``of_heading`` (it is one).

    Words between candidates are differences of a running sum.
    """
    marked = heading_candidates(paras)
    body = F.when(~F.col("candidate") & ~F.col("consumed"), F.col("words")).otherwise(0)
    spans = marked.withColumn("span", F.sum(F.col("candidate").cast("int")).over(so_far()))
    own = W.partitionBy("book_id", "span")
    kept = spans.withColumn("kept", F.col("candidate") & (F.sum(body).over(own) >= min_words))
    number = F.sum(F.col("kept").cast("int")).over(so_far()).cast("int")
    title = F.coalesce(F.last(F.when(F.col("kept"), F.col("heading")), ignorenulls=True).over(so_far()), F.lit(FRONT))
    of_heading = F.col("kept") | (F.col("consumed") & F.coalesce(F.lag("kept").over(by_para()), F.lit(False)))
    placed = kept.withColumns({"head_no": number, "head_title": title, "found": F.sum(F.col("kept").cast("int")).over(W.partitionBy("book_id")), "of_heading": of_heading})
    return placed.select(*paras.columns, F.struct(F.col("head_no").alias("section_no"), F.col("head_title").alias("title")).alias("head"), "found", "of_heading")


def sections_from_headings(paras: DataFrame, min_words: int = 80) -> DataFrame:
    """Sections at headings with ``min_words`` before the next candidate; books with fewer than two have no row.

    A rejected heading stays as text.
    """
    placed = _headed(paras, min_words).where("found >= 2 and not of_heading")
    return placed.select("book_id", "head.section_no", "head.title", "para_no", "text", "is_break")


def sections_of_size(paras: DataFrame, limit: int = 6000) -> DataFrame:
    """Sections of up to ``limit`` words, "Section 1" and so on."""
    bins = chunks.word_budget(paras.select("book_id", "para_no", para_words().alias("words")), limit)
    both = paras.join(bins, ["book_id", "para_no"])
    return both.select("book_id", F.col("bin").alias("section_no"), F.concat(F.lit("Section "), F.col("bin").cast("string")).alias("title"), "para_no", "text", "is_break")


def choose_sections(paras: DataFrame, toc: DataFrame, min_words: int = 80, limit: int = 6000) -> DataFrame:
    """Sections of each book by its outline, else its headings, else of fixed size, with ``chapter_source``; sections
    without text dropped. All three are worked out over the same rows, and each book takes one: the paragraphs are read
    once, and once more, as numbers, to be packed."""
    placed = _carried(_headed(paras.select("book_id", "page", "para_no", "text", "is_break"), min_words), toc, 0, None)
    way = F.when(F.col("outlined"), "outline").when(F.col("found") >= 2, "headings").otherwise("fixed")
    known = placed.withColumn("chapter_source", way).where((F.col("chapter_source") != "headings") | ~F.col("of_heading"))
    bins = chunks.word_budget(known.where("chapter_source = 'fixed'").select("book_id", "para_no", para_words().alias("words")), limit)
    both = known.join(bins, ["book_id", "para_no"], "left")
    pick = lambda outline, heading, fixed: F.when(F.col("outlined"), outline).when(F.col("found") >= 2, heading).otherwise(fixed)
    number = pick(F.coalesce("own.section_no", F.lit(0)), F.col("head.section_no"), F.col("bin"))
    title = pick(F.coalesce("own.title", F.lit(FRONT)), F.col("head.title"), F.concat(F.lit("Section "), F.col("bin").cast("string")))
    rows = both.select("book_id", number.alias("section_no"), title.alias("title"), "para_no", "text", "is_break", "chapter_source")
    return drop_empty_sections(drop_title_echo(rows, where=F.col("chapter_source") == "outline"))


def drop_empty_sections(sections: DataFrame) -> DataFrame:
    own = W.partitionBy("book_id", "section_no")
    filled = F.coalesce(~F.col("is_break") & (T.strip(F.col("text")) != ""), F.lit(False))
    return sections.withColumn("__filled", F.max(filled).over(own)).where("__filled").drop("__filled")


def is_echo(title: Column, text: Column, is_break: Column) -> Column:
    """Whether a short paragraph only repeats the title, or is a bare number."""
    own, of_title = T.norm(text), T.norm(title)
    short = ~is_break & (F.length(text) < 100) & ~T.ends_sentence(text)
    return F.coalesce(short & (text.rlike(P.BARE_NUMBER) | ((own != "") & (of_title.contains(own) | own.contains(of_title)))), F.lit(False))


def drop_title_echo(sections: DataFrame, places: int = 3, where: Column | None = None) -> DataFrame:
    """Sections without echoes of their title at their beginning; front matter, and what isn't of ``where``, is left as it is.

    An echo is dropped while fewer than ``places`` other paragraphs have stayed before it.
    """
    own = W.partitionBy("book_id", "section_no").orderBy("para_no")
    echo = is_echo(F.col("title"), F.col("text"), F.col("is_break"))
    marked = sections.withColumn("__echo", echo & (F.col("section_no") > 0) & (F.lit(True) if where is None else where))
    stayed = F.coalesce(F.sum(F.when(F.col("__echo"), 0).otherwise(1)).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return marked.withColumn("__stayed", stayed).where(~F.col("__echo") | (F.col("__stayed") >= places)).drop("__echo", "__stayed")


def finalize(sections: DataFrame, max_words: int, skip_front: bool = False, keep_all: bool = False) -> DataFrame:
    """Sections without breaks at their ends, or without text; front matter and contents, notes and the like dropped unless
    kept; those of more than ``max_words`` split into parts, whose titles say so. Sections are numbered anew from 1."""
    own = W.partitionBy("book_id", "section_no")
    at = F.when(~F.col("is_break"), F.col("para_no"))
    inner = sections.withColumns({"__a": F.min(at).over(own), "__b": F.max(at).over(own)}).where("para_no between __a and __b").drop("__a", "__b")
    if skip_front:
        inner = inner.where(F.col("title") != FRONT)
    if not keep_all:
        inner = inner.where(~T.strip(F.col("title")).rlike(P.DROP_TITLE))
    key = F.concat_ws("\u0000", "book_id", F.col("section_no").cast("string"))
    counted = inner.withColumn("words", para_words()).withColumn("total", F.sum("words").over(own)).withColumn("__key", key)
    large = counted.where(F.col("total") > max_words)
    bins = chunks.word_budget(large.select(F.col("__key").alias("book_id"), "para_no", "words"), max_words).withColumnRenamed("book_id", "__key")
    parts = counted.join(bins, ["__key", "para_no"], "left")
    title = F.when(F.col("bin").isNull(), F.col("title")).otherwise(T.part_title(F.col("title"), F.col("bin")))
    number = F.dense_rank().over(W.partitionBy("book_id").orderBy("section_no", F.coalesce("bin", F.lit(1))))
    return parts.select("book_id", number.alias("section_no"), title.alias("title"), "para_no", "text", "is_break")

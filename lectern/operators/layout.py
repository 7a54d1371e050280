"""Leading, text columns and indent style, from the places of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T


def in_page():
    """Window over a page's lines in order. Windows are made by functions, as they need a session."""
    return W.partitionBy("book_id", "page").orderBy("line_no")


def on_page(*more: str):
    return W.partitionBy("book_id", "page", *more)


def usable_step() -> Column:
    """Distance to the next baseline on the page, if both lines are of one size and neighbours; else null."""
    step, size = F.lead("base").over(in_page()) - F.col("base"), F.lead("size").over(in_page())
    return F.when((step > 0) & (step < 2.5 * F.col("size")) & (F.abs(F.col("size") - size) < 0.5), step)


def typical_leading(lines: DataFrame, default: float = 14.0) -> DataFrame:
    """``book_id, leading``: median distance of neighbouring baselines of one size on a page."""
    steps = lines.select("book_id", usable_step().alias("dy"))
    return steps.groupBy("book_id").agg(F.coalesce(F.median("dy"), F.lit(default)).alias("leading"))


def is_body() -> Column:
    """A line of more than 25 characters; any line of a page that has none."""
    long = F.length("text") > 25
    return long | (F.count_if(long).over(on_page()) == 0)


def body_lines(lines: DataFrame) -> DataFrame:
    """Lines of more than 25 characters; all lines of a page that has none."""
    return lines.withColumn("__body", is_body()).where("__body").drop("__body")


def with_page_edges(lines: DataFrame) -> DataFrame:
    """``lines`` with ``__body``, ``__span`` and ``__lefts``: the page's width and the left edges of its one or two columns.

    Left ends, rounded to three points, are ranked by their lines of body text, of equals by the first; beside the top one
    counts the first of the next three that is far from it and has a quarter of its lines. Windows over a page, no join.
    """
    rows = lines.withColumns({"__body": is_body(), "__at": F.bround(F.col("x0") / 3).cast("double") * 3})
    in_body = lambda c: F.when(F.col("__body"), c)
    rows = rows.withColumns({
        "__span": F.max(in_body(F.col("x1"))).over(on_page()) - F.min(in_body(F.col("x0"))).over(on_page()),
        "__n": F.count_if("__body").over(on_page("__at")), "__first": F.min(in_body(F.col("line_no"))).over(on_page("__at")),
    })
    place = F.struct("__n", (-F.col("__first")).alias("back"), F.col("__at").alias("left"))
    rows = rows.withColumns({"__top": F.max(in_body(place)).over(on_page()), "__rank": F.dense_rank().over(on_page().orderBy(F.desc("__n"), F.asc_nulls_last("__first")))})
    far = F.col("__body") & (F.col("__rank") <= 4) & (F.abs(F.col("__at") - F.col("__top.left")) > 0.3 * F.col("__span")) & (F.col("__n") >= 0.25 * F.col("__top.__n"))
    rows = rows.withColumn("__second", F.max(F.when(far, place)).over(on_page())["left"])
    lefts = F.array_sort(F.array_compact(F.array(F.col("__top.left"), F.col("__second"))))
    return rows.withColumn("__lefts", lefts).drop("__at", "__n", "__first", "__top", "__rank", "__second")


def column_edges(lines: DataFrame) -> DataFrame:
    """``book_id, page, span, lefts``: the left edges of a page's one or two columns, in order."""
    return with_page_edges(lines).groupBy("book_id", "page").agg(F.first("__span").alias("span"), F.first("__lefts").alias("lefts"))


def _column_of(x0: Column, lefts: Column) -> Column:
    return F.coalesce(F.array_max(F.filter(lefts, lambda c: c <= x0 + 2)), F.array_min(lefts))


def annotate_columns(lines: DataFrame) -> DataFrame:
    """``lines`` with the ``left`` and ``right`` edge of the column that each stands in.

    The right edge is the element at floor(0.9 * (n - 1)) of the sorted right ends of the column's body lines.
    """
    placed = with_page_edges(lines).withColumn("left", _column_of(F.col("x0"), F.col("__lefts")))
    ends = F.sort_array(F.collect_list(F.when(F.col("__body"), F.col("x1"))).over(on_page("left")))
    right = F.get(ends, F.floor(F.lit(0.9) * (F.size(ends) - 1)).cast("int"))
    return placed.select(*lines.columns, "left", F.coalesce(right, F.col("left") + F.col("__span")).alias("right"))


def is_indented(line: str = "") -> Column:
    """Of a line with edges; ``line`` names a struct that holds it."""
    c = (lambda n: F.col(f"{line}.{n}")) if line else F.col
    return c("x0") > c("left") + 0.9 * c("size")


def is_short(share: float = 0.12, line: str = "") -> Column:
    c = (lambda n: F.col(f"{line}.{n}")) if line else F.col
    return c("x1") < c("right") - share * (c("right") - c("left"))


def paragraph_start() -> tuple[Column, Column]:
    """Of an annotated line with ``leading`` and ``next`` (of the line after it on the page): whether the next line begins a
    paragraph for sure, and whether it is indented then."""
    dy = F.col("next.base") - F.col("base")
    start = T.ends_sentence(F.col("text")) & is_short(0.3) & (dy > 0) & (dy <= 1.45 * F.col("leading"))
    return start, start & is_indented("next")


def next_on_page() -> Column:
    return F.lead(F.struct("x0", "left", "size", "base")).over(in_page())


def has_indents(starts: Column, indented: Column, least_starts: int = 5, share: float = 0.6) -> Column:
    return (starts >= least_starts) & (indented >= share * starts)


def indent_style(annotated: DataFrame, leading: DataFrame, least_starts: int = 5, share: float = 0.6) -> DataFrame:
    """``book_id, starts, indented, indent_style``: whether paragraphs begin with an indent, judged after lines that end one."""
    pairs = annotated.join(leading, "book_id").withColumn("next", next_on_page())
    start, indented = paragraph_start()
    counts = pairs.groupBy("book_id").agg(F.count_if(start).alias("starts"), F.count_if(indented).alias("indented"))
    return counts.withColumn("indent_style", has_indents(F.col("starts"), F.col("indented"), least_starts, share))

"""Lines from a page layout of blocks, lines and spans, as document libraries give it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import patterns as P
from ..functions import text as T

SPAN = "struct<text:string,size:double,flags:int,origin:array<double>>"
LAYOUT_SCHEMA = f"book_id string, page int, ph double, blocks array<struct<type:int,lines:array<struct<dir:array<double>,bbox:array<double>,spans:array<{SPAN}>>>>>"


def dominant_span(spans: Column) -> Column:
    """The span with the longest stripped text, the first of equals; null if all are blank. Has its place as ``at``.
    A superscript note number is so only if there is nothing else, however short the line that it stands in."""
    placed = F.transform(spans, lambda s, i: F.struct(F.length(T.strip(s["text"])).alias("n"), (-i).alias("back"), s.alias("span"), i.alias("at")))
    filled = F.filter(placed, lambda x: x["n"] > 0)
    plain = F.filter(filled, lambda x: ~F.coalesce((x["span"]["flags"].bitwiseAND(1) == 1) & x["span"]["text"].rlike(P.FOOTNOTE_MARK), F.lit(False)))
    best = F.aggregate(F.when(F.size(plain) > 0, plain).otherwise(filled), F.lit(None).cast(f"struct<n:int,back:int,span:{SPAN},at:int>"), lambda a, x: F.when(a.isNull() | (x["n"] > a["n"]), F.struct(x["n"].cast("int").alias("n"), x["back"].cast("int").alias("back"), x["span"].alias("span"), x["at"].cast("int").alias("at"))).otherwise(a))
    return best


def is_footnote_mark(span: Column, main: Column) -> Column:
    """A raised or superscript span of digits and note signs."""
    raised = span["origin"][1] < main["origin"][1] - 0.15 * main["size"]
    marked = (T.strip(span["text"]) != "") & span["text"].rlike(P.FOOTNOTE_MARK)
    return marked & ((span["flags"].bitwiseAND(1) == 1) | ((span["size"] < 0.8 * main["size"]) & raised))


def line_text(spans: Column, best: Column) -> Column:
    """The spans in a row, but for footnote marks and a blank right after a drop cap; not cleaned yet."""
    main = best["span"]

    def add(state: Column, item: Column) -> Column:
        span, at = item["span"], item["at"]
        text = T.strip(span["text"])
        mark = (at != best["at"]) & is_footnote_mark(span, main)
        skip = mark | (state["cap"] & (text == ""))
        cap = text.rlike(r"^\p{L}$") & (span["size"] >= 1.4 * main["size"])
        return F.when(skip, state).otherwise(F.struct(F.concat(state["out"], span["text"]).alias("out"), F.coalesce(cap, F.lit(False)).alias("cap")))

    numbered = F.transform(spans, lambda s, i: F.struct(s.alias("span"), i.alias("at")))
    return F.aggregate(numbered, F.struct(F.lit("").alias("out"), F.lit(False).alias("cap")), add, lambda s: s["out"])


def lines_from_layout(pages: DataFrame) -> DataFrame:
    """``LINE_SCHEMA`` rows of ``LAYOUT_SCHEMA`` pages: text blocks only, no rotated or blank lines."""
    blocks = pages.select("book_id", "page", "ph", F.posexplode("blocks").alias("block", "b")).where("b.type = 0")
    raw = blocks.select("book_id", "page", "ph", "block", F.posexplode("b.lines").alias("in_block", "l")).where(~(F.abs(F.coalesce(F.get("l.dir", F.lit(1)), F.lit(0.0))) > 0.5))
    main = raw.withColumn("best", dominant_span(F.col("l.spans"))).where("best is not null")
    text = T.clean_chars(T.soft_hyphen_tail(line_text(F.col("l.spans"), F.col("best"))))
    box = F.col("l.bbox")
    rows = main.select(
        "book_id", "page", (F.col("block") * 100_000 + F.col("in_block")).cast("int").alias("line_no"), text.alias("text"), box[0].alias("x0"), box[1].alias("y0"), box[2].alias("x1"), box[3].alias("y1"),
        F.bround("best.span.size", 1).alias("size"), F.col("best.span.origin")[1].alias("base"), "block", "ph")
    return rows.where("text <> ''")

"""Packing: word budgets and chunks for narration.

Both are folds over an order, in which each step depends on how full the bin is; no window expresses that. A book's rows are
folded in one go, over small rows or within a section's array of texts.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def word_budget(counts: DataFrame, limit: int) -> DataFrame:
    """``book_id, para_no, bin`` from ``book_id, para_no, words``: bins, numbered from 1, of up to ``limit`` words in order;
    a paragraph with more stands alone. Only numbers go to Python, a book at a time."""

    def fold(book: pd.DataFrame) -> pd.DataFrame:
        book = book.sort_values("para_no", kind="stable")
        bins, number, full = [], 1, None
        for w in book["words"].tolist():
            if full is not None and full + w > limit:
                number, full = number + 1, 0
            full = (full or 0) + w
            bins.append(number)
        return pd.DataFrame({"book_id": book["book_id"], "para_no": book["para_no"], "bin": bins})

    return counts.groupBy("book_id").applyInPandas(fold, "book_id string, para_no int, bin int")


def budget_bins(words: Column, limit: int) -> Column:
    """The same as an array of bin numbers for an array of counts, within an expression; for arrays of hundreds, as it
    rebuilds its result at each step."""
    start = F.struct(F.lit(0).cast("long").alias("full"), F.array().cast("array<int>").alias("bins"))

    def step(state: Column, w: Column) -> Column:
        last = F.when(F.size(state["bins"]) == 0, 1).otherwise(F.get(state["bins"], F.size(state["bins"]) - 1))
        over = (F.size(state["bins"]) > 0) & (state["full"] + w > limit)
        return F.struct(F.when(over, w).otherwise(state["full"] + w).cast("long").alias("full"), F.concat(state["bins"], F.array(F.when(over, last + 1).otherwise(last).cast("int"))).alias("bins"))

    return F.aggregate(words, start, step, lambda s: s["bins"])


_SENTENCE = re.compile(r"(?<=[.?!])\s+")
_CLAUSE = re.compile(r"(?<=[,;:–—])\s+")


def _pack(parts: Iterator[str], limit: int) -> Iterator[str]:
    """Parts joined by spaces while they fit; the space is reckoned even for the first."""
    held = ""
    for part in parts:
        if len(held) + len(part) + 1 <= limit:
            held = f"{held} {part}".strip()
        else:
            if held:
                yield held
            held = part
    if held:
        yield held


def _pieces(sentence: str, limit: int) -> Iterator[str]:
    """A sentence; if it is too long its clauses, packed; of a clause that is too long its words, packed. Order is kept."""
    if len(sentence) <= limit:
        yield sentence
        return
    short: list[str] = []
    for clause in _CLAUSE.split(sentence):
        if len(clause) <= limit:
            short.append(clause)
            continue
        yield from _pack(iter(short), limit)
        short = []
        yield from _pack(iter(clause.split()), limit)
    yield from _pack(iter(short), limit)


def narration_chunks(paras: list[str | None], limit: int = 350) -> list[str]:
    """Chunks of at most ``limit`` characters, but for single longer words, from paragraphs in order; None is a break, at
    which a chunk ends. No word is lost or moved."""
    out: list[str] = []
    run: list[str] = []
    for para in [*paras, None]:
        if para is not None:
            run.append(para)
            continue
        sentences = (s.strip() for p in run for s in _SENTENCE.split(p))
        out += _pack((piece for s in sentences if s for piece in _pieces(s, limit)), limit)
        run = []
    return out


def narration_column(paras: Column, limit: int = 350) -> Column:
    """:func:`narration_chunks` of an array of texts, in Arrow batches."""

    @F.arrow_udf("array<string>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([narration_chunks(x.as_py() or [], limit) for x in batch], pa.list_(pa.string()))

    return of(paras)


def chunk_sections(sections: DataFrame, limit: int = 350) -> DataFrame:
    """``book_id, section_no, title, chunk_no, text`` of sections in long form. ``chunk_no`` counts from 0."""
    ordered = F.array_sort(F.collect_list(F.struct("para_no", F.when(~F.col("is_break"), F.col("text")).alias("text"))))
    whole = sections.groupBy("book_id", "section_no", "title").agg(ordered.alias("paras"))
    parts = whole.select("book_id", "section_no", "title", narration_column(F.col("paras.text"), limit).alias("chunks"))
    return parts.select("book_id", "section_no", "title", F.posexplode("chunks").alias("chunk_no", "text"))

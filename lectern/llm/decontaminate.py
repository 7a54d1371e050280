"""Benchmark decontamination with one Aho-Corasick automaton over normalised test items.

Text is normalised by lower-casing A-Z and cutting it into words; items become windows of consecutive words. Any window of
``window`` words holds a block of half as many that starts at a multiple of its length in the item, so the automaton has the
items' blocks only: a node for each word of an item instead of ``window``. A text is scanned once; a block that is met is
extended both ways along its item, and a run of ``window`` words or more is a hit. Word positions map back to offsets of the
original text.
"""

from __future__ import annotations

import hashlib
from array import array
from bisect import bisect_right
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import UPPER, kept_by_worker, named, packed

#: A-Z to a-z; other ASCII bytes that aren't of a word to a space. Offsets stay as they are.
_TABLE = bytes(b + 32 if chr(b) in UPPER else b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else 0x20 for b in range(256))

RESULT = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<struct<start:long,end:long>>"


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


class Matcher:
    """An automaton over the blocks of ``items`` (item id as a string, text), for windows of ``window`` words.

    Items of equal words are one sequence. ``flat`` holds the numbers of all sequences' words, -1 between sequences; a text's
    words that no item has are 0. A block's value: its length, its places in ``flat`` and the sequences that are this block
    alone because they are shorter than a window.
    """

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        self.window, self.block = window, (window + 1) // 2
        self.numbers: dict[bytes, int] = {}
        sequences: dict[tuple[int, ...], set[str]] = {}
        for item, text in items:
            if words := words_of(text):
                sequences.setdefault(tuple([self.numbers.setdefault(w, len(self.numbers) + 1) for w in words]), set()).add(item)
        self.flat, self.starts, self.owners = array("l", [-1]), [], []
        blocks: dict[tuple[int, ...], tuple[int, list[int], list[int]]] = {}
        for k, (words, owners) in enumerate(sequences.items()):
            start = len(self.flat)
            self.starts.append(start)
            self.owners.append(tuple(owners))
            self.flat.extend(words)
            self.flat.append(-1)
            if len(words) < window:
                blocks.setdefault(words, (len(words), [], []))[2].append(k)
            else:
                for i in range(0, len(words) - self.block + 1, self.block):
                    part = words[i : i + self.block]
                    blocks.setdefault(part, (len(part), [], []))[1].append(start + i)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for part, value in blocks.items():
            self.automaton.add_word(part, value)
        self.any = bool(blocks)
        if self.any:
            self.automaton.make_automaton()

    def scan(self, text: str | None) -> tuple[int, list[list[int]], set[str]]:
        """Number of words; hit runs as [first word, end word), apart and in order; ids of the items met."""
        words = words_of(text)
        hits: set[tuple[int, int]] = set()
        met: set[int] = set()
        if self.any:
            get, flat, n = self.numbers.get, self.flat, len(words)
            own = tuple([get(w, 0) for w in words])
            done: dict[int, int] = {}  # by how far the item's words lie from the text's: end of the last run
            for last, (length, places, alone) in self.automaton.iter(own):
                first, end = last - length + 1, last + 1
                if alone:
                    hits.add((first, end))
                    met.update(alone)
                for at in places:
                    shift = at - first
                    if done.get(shift, 0) >= end:
                        continue
                    a, b = first, end
                    while a and own[a - 1] == flat[a - 1 + shift]:
                        a -= 1
                    while b < n and own[b] == flat[b + shift]:
                        b += 1
                    done[shift] = b
                    if b - a >= self.window:
                        hits.add((a, b))
                        met.add(bisect_right(self.starts, at) - 1)
        runs: list[list[int]] = []
        for a, b in sorted(hits):
            if runs and a <= runs[-1][1]:
                runs[-1][1] = max(b, runs[-1][1])
            else:
                runs.append([a, b])
        return len(words), runs, {i for k in met for i in self.owners[k]}

    def spans(self, text: str, runs: list[list[int]]) -> list[tuple[int, int]]:
        """Character offsets in the original text of runs of words."""
        raw = text.encode("utf-8", "surrogatepass")
        flat = np.frombuffer(raw.translate(_TABLE), np.uint8) != 0x20
        edge = np.diff(np.concatenate(([0], flat.view(np.int8), [0])))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        chars = np.cumsum(np.concatenate(([0], (np.frombuffer(raw, np.uint8) & 0xC0) != 0x80)))
        return [(int(chars[starts[a]]), int(chars[ends[b - 1]])) for a, b in runs]


def digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode("utf-8", "surrogatepass")).hexdigest()


def _items(items: DataFrame, item_id: str, item_text: str, max_bytes: int) -> list[tuple[str, str | None]]:
    """All items, once their size is known to be below the bound."""
    rows = items.select(named(item_id).cast("string").alias("i"), named(item_text).alias("t")).where("i is not null and t is not null")
    size = rows.agg(F.sum(F.octet_length("i") + F.octet_length("t"))).first()[0] or 0
    if size > max_bytes:
        raise ValueError(f"items of {size} bytes; one automaton takes max_bytes={max_bytes}. Raise it where a Python worker has about 25 bytes of memory for each, or scan for one list after another")
    return [(r.i, r.t) for r in rows.collect()]


def leak_column(text: Column, items: list[tuple[str, str | None]], window: int, session: SparkSession) -> Column:
    """:data:`RESULT` for each text."""
    shared = session.sparkContext.broadcast(items)
    key = ("matcher", hashlib.sha256(repr((sorted(items), window)).encode("utf-8", "surrogatepass")).hexdigest())
    kind = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))])

    @F.arrow_udf(f"struct<{', '.join(f.replace(' ', ':', 1) for f in RESULT.split(', '))}>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        matcher = kept_by_worker(key, lambda: Matcher(shared.value, window))
        none = digest(set())
        for texts in batches:
            out = []
            for t in texts:
                t = t.as_py()
                n, runs, met = matcher.scan(t)
                out.append((n, sum(b - a for a, b in runs), len(met), digest(met) if met else none, bool(runs), [{"start": a, "end": b} for a, b in matcher.spans(t, runs)] if runs else []))
            yield pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*out)) or [[]] * 6, kind)], fields=list(kind))

    return of(text)


def find_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = 10, max_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` with a struct column ``leak`` (:data:`RESULT`) appended, or ``leak_`` and so on if that name is taken in any case.

    The items are sent to the executors and form one automaton in each Python worker. That is sized by the items, not by the
    documents: ``max_bytes`` bounds them, and more is an error rather than a part of them. No row is shuffled.

    Null text has no words. An item of fewer words than a window is one window; null items and items without words match
    nothing. Repeated items count once by their id. An empty ``items`` finds nothing.
    """
    name, taken = "leak", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return docs.select("*", leak_column(named(text_col), _items(items, item_id, item_text, max_bytes), window, docs.sparkSession).alias(name))


def drop_leaks(docs: DataFrame, items: DataFrame, text_col: str = "text", max_share: float = 0.0, item_id: str = "item_id", item_text: str = "text", window: int = 10, max_bytes: int = 16 << 20) -> DataFrame:
    """``docs`` without those of whose words more than ``max_share`` are hit; for nulls and odd items see :func:`find_leaks`."""
    leak = leak_column(named(text_col), _items(items, item_id, item_text, max_bytes), window, docs.sparkSession)
    return packed(docs, leak=leak).where(F.col("leak.n_hit") <= max_share * F.col("leak.n_words")).select("row.*")

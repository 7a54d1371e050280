"""Links between rows that share a bucket of fuzzy keys, without trying all pairs of a bucket.

Operators deal each node to several keys; nodes that share a key are candidates, a cheap test on what is carried beside the
key and the caller's own test on the nodes' texts decide. What is asked for is the connected groups, so a pair whose nodes
are already connected need not be tried; every other pair of a bucket is.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import Any, NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_cut, release, smallest_reachable


class Test(NamedTuple):
    """A test of pairs, of columns in a join and of rows in a Python worker; both have the same result."""

    columns: Callable[..., Column]
    rows: Callable[..., Any]


def _side(rows: DataFrame, prefix: str) -> DataFrame:
    return rows.select(F.col("key"), *(F.col(c).alias(f"{prefix}{'' if c == 'node' else c}") for c in rows.columns if c != "key"))


def _merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """``roots(node, root)`` after ``links(a, b)`` between nodes: only the roots that they join are linked anew."""
    left, right = roots.select(F.col("node").alias("a"), F.col("root").alias("ra")), roots.select(F.col("node").alias("b"), F.col("root").alias("rb"))
    bridges = cut(links.join(left, "a").join(right, "b").select(F.col("ra").alias("a"), F.col("rb").alias("b")).distinct(), "bridges")
    joined = bridges.select(F.col("a").alias("node")).union(bridges.select(F.col("b").alias("node"))).distinct()
    above = smallest_reachable(joined, bridges).select(F.col("node").alias("root"), F.col("root").alias("above"))
    out = cut(roots.join(above, "root", "left").select("node", F.coalesce("above", "root").alias("root")), "roots")
    drop_cut(bridges, roots)
    return out


SIEVE = 1 << 26  # bits, one for each value of a key's lower bits: 8 MB, whatever the number of keys


def sieve_of(keys: DataFrame) -> np.ndarray:
    """A bit for each value of the lower bits that ``keys(key)`` have. At most 2**20 words come to the driver."""
    place = F.col("key").bitwiseAND(F.lit(SIEVE - 1).cast("long"))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place.bitwiseAND(F.lit(63).cast("long")).cast("int"))
    words = keys.groupBy(F.shiftrightunsigned(place, 6).alias("at")).agg(F.bit_or(bit).alias("bits")).toArrow()
    out = np.zeros(SIEVE >> 6, np.uint64)
    out[words["at"].to_numpy()] = words["bits"].to_numpy().astype(np.int64).view(np.uint64)
    return out


def in_sieve(sieve: np.ndarray, keys: np.ndarray) -> np.ndarray:
    low = keys.view(np.uint64) & np.uint64(SIEVE - 1)
    return (sieve[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1)).astype(bool)


#: Keys that a task sorts at once, and ranges of keys that it deals them to.
SORTED, RANGES = 1 << 20, 1 << 12


def _dealt(keys: Iterable[np.ndarray]) -> Iterator[pa.RecordBatch]:
    """``range, keys``: a row for each range of keys, with all of ``SORTED`` or so that fall into it."""

    def deal() -> pa.RecordBatch:
        own = np.sort(np.concatenate(held).view(np.uint64))
        ends = np.concatenate(([0], np.cumsum(np.bincount((own // np.uint64((1 << 64) // RANGES)).astype(np.int64), minlength=RANGES))))
        packed = pa.Array.from_buffers(pa.binary(), RANGES, [None, pa.py_buffer((8 * ends).astype(np.int32)), pa.py_buffer(own.astype("<u8"))])
        filled = np.flatnonzero(np.diff(ends))
        return pa.RecordBatch.from_arrays([pa.array(filled), packed.take(pa.array(filled))], ["range", "keys"])

    held, n = [], 0
    for more in keys:
        held.append(more)
        n += len(more)
        if n >= SORTED:
            yield deal()
            held, n = [], 0
    if n:
        yield deal()


def _sizes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``key, n`` of the keys that are there more than once; rows come by range."""

    def counted() -> pa.RecordBatch:
        own = np.sort(np.frombuffer(b"".join(held), "<u8"))
        starts = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))
        n = np.diff(starts, append=len(own))
        return pa.RecordBatch.from_arrays([pa.array(own[starts[n > 1]].view(np.int64)), pa.array(n[n > 1])], ["key", "n"])

    held, size, last = [], 0, None
    for batch in batches:
        for at, packed in zip(batch.column(0).to_pylist(), batch.column(1)):
            if at != last and size >= 8 * SORTED:
                yield counted()
                held, size = [], 0
            last = at
            held.append(packed.as_buffer())
            size += len(held[-1])
    if held:
        yield counted()


def shared_keys(rows: DataFrame, keys_of: Callable[[Iterator[pa.RecordBatch]], Iterable[np.ndarray]]) -> DataFrame:
    """``key, n`` of the keys that ``keys_of`` gives for ``rows`` more than once. Keys are hashes of 64 bits and most are there
    once, so they travel in sorted runs, thousands to a row, and are counted in Python."""
    dealt = rows.mapInArrow(lambda batches: _dealt(keys_of(batches)), "range long, keys binary")
    return dealt.repartition("range").sortWithinPartitions("range").mapInArrow(_sizes, "key long, n long")


#: Nodes of a crowd that meet in one task: a crowd of more is cut into blocks, and each two blocks meet.
BLOCK = 1024


def _links_within(near: Callable, alike: Callable, batch: int = 256) -> Callable[[pa.Table], pa.Table]:
    """Links that connect what is connected among the nodes of two blocks, or of one: every pair that shares a key is
    tried, unless its nodes have been connected before."""

    def of(table: pa.Table) -> pa.Table:
        node, root, f1, f2, block = (table.column(c).to_numpy().copy() for c in ("node", "root", "f1", "f2", "block"))
        own = table.column("own").combine_chunks()
        sizes = own.value_lengths().to_numpy()
        keys = np.unique(own.flatten().to_numpy(), return_inverse=True)[1]
        ends = np.cumsum(sizes)
        order = np.argsort(keys, kind="stable")
        members = np.split(np.repeat(np.arange(len(node)), sizes)[order], np.flatnonzero(np.diff(keys[order])) + 1)
        other = block != block.min()
        place, test, found = np.arange(len(node)), None, []
        for v in np.flatnonzero(~other) if other.any() else place:
            share = np.zeros(len(node), bool)
            for k in keys[ends[v] - sizes[v] : ends[v]]:
                share[members[k]] = True
            left = np.flatnonzero(share & (root != root[v]) & (other if other.any() else place > v))
            left = left[near(f1[v], f2[v], f1[left], f2[left])]
            while len(left):
                if test is None:
                    test = alike(table.column("text").to_pylist())
                for j in left[:batch][test(v, left[:batch])]:
                    if root[j] != root[v]:
                        found.append((node[v], node[j]))
                        root[root == root[j]] = root[v]
                left = left[batch:]
                left = left[root[left] != root[v]]
        a, b = np.array(found, np.int64).reshape(-1, 2).T
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    return of


def _crowds(rows: DataFrame, roots: DataFrame, small: int) -> DataFrame | None:
    """``node, crowd`` of the nodes that are best met by crowd; None if no bucket is crowded.

    Buckets of over ``small`` nodes that hold several groups, and that share nodes, are a crowd. Meeting all of it brings
    its nodes once for each block of ``BLOCK``; meeting bucket by bucket brings the nodes of each. Copies share most of
    their buckets, so the first is less for them. Strangers share few, and as rows grow, chains of their buckets take in
    a good part of all nodes; the second is less for those.
    """
    held = rows.where(F.col("n") > small).select("key", "node", "n").join(roots, "node")
    several = held.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.min("node").alias("a")).where("low < high").select("key", "a")
    hung = cut(held.select("key", "node", "n").join(several, "key"), "hung")
    if not hung.limit(1).count():
        drop_cut(hung)
        return None
    crowds = cut(smallest_reachable(hung.select("node").distinct(), hung.select("a", F.col("node").alias("b"))).select("node", F.col("root").alias("crowd")), "crowds")
    met = hung.where("node = a").select("node", (F.col("n") * F.ceil(F.col("n") / BLOCK)).alias("rows"))
    apart = met.join(crowds, "node").groupBy("crowd").agg(F.sum("rows").alias("apart"))
    whole = crowds.groupBy("crowd").agg((F.count("*") * F.ceil(F.count("*") / BLOCK)).alias("whole"))
    out = cut(crowds.join(whole.join(apart, "crowd").where("whole <= apart").select("crowd"), "crowd").select("node", "crowd"), "met-whole")
    drop_cut(hung, crowds)
    return out


def _crowd_links(crowded: DataFrame, apart: DataFrame, near: Test, alike: Test, texts_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Links ``(a, b)`` within each crowd of ``crowded``, by all keys that its nodes have there, and within each bucket of
    ``apart``."""
    # f1 and f2 may differ by key: a node has a row for each of them, with the keys that they go with
    crowd = crowded.groupBy("node", "f1", "f2").agg(F.first("root").alias("root"), F.first("crowd").alias("crowd"), F.collect_list("key").alias("own"))
    blocks = crowd.groupBy("crowd").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    by_crowd = crowd.join(blocks, "crowd").withColumn("whole", F.lit(True))
    by_bucket = apart.select(F.col("key").alias("crowd"), "node", "root", "f1", "f2", F.array("key").alias("own"), F.ceil(F.col("n") / BLOCK).alias("blocks"), F.lit(False).alias("whole"))
    dealt = by_crowd.select(by_bucket.columns).union(by_bucket).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))
    wanted = crowded.select("node").union(apart.select("node")).distinct()
    texts = texts_of(cut(wanted, "wanted"))
    met = dealt.join(texts, "node").withColumn("with", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    units = met.select("whole", "crowd", F.least("block", "with").alias("low"), F.greatest("block", "with").alias("high"), "node", "root", "f1", "f2", "block", "own", "text")
    links = cut(units.groupBy("whole", "crowd", "low", "high").applyInArrow(_links_within(near.rows, alike.rows), "a long, b long").distinct(), "crowd-links")
    drop_cut(texts)
    return links


def connected(
    keys: DataFrame, near: Test, texts_of: Callable[[DataFrame], DataFrame], alike: Test,
    small: int = 64, rounds: int = 1, sifted: Callable[[np.ndarray], DataFrame] | None = None, sizes: DataFrame | None = None,
) -> DataFrame:
    """``node, root`` of the nodes of ``keys(key, node, f1, f2)`` that are linked to any other; ``root`` is the least of them.

    Two nodes are linked if they share a key, ``near`` holds for their ``f1`` and ``f2``, and ``alike`` for their texts;
    ``texts_of`` gets ``node``, distinct, and gives ``node, text``. ``near.columns("a", "b")`` is over ``af1, af2, bf1,
    bf2``, and ``near.rows`` over one node's two numbers and others' arrays of them; ``alike.columns`` is over two columns of texts,
    and ``alike.rows`` gets a list of texts and gives a test of the place of one and an array of others' places.

    First, in ``rounds`` turns, each node is compared with one leader: of the buckets it is in, the node that has most company over all its
    keys, the middle of a family of copies as a rule. Then no pair of different groups is left out. In buckets of up to
    ``small`` nodes such pairs are joined. The nodes of larger buckets that still hold several groups go to tasks that
    hold up to two blocks of ``BLOCK`` nodes, with their texts: by crowds of buckets or bucket by bucket, whichever brings
    fewer rows (:func:`_crowds`). Each two blocks of a crowd, or of a bucket, meet once, and what a task has connected it
    doesn't compare again. So a crowd that isn't of one family costs as many cheap comparisons as it has pairs, but rows
    only by nodes and blocks.

    Where few nodes share a key, ``sifted`` saves most of a shuffle: it gets a sieve of the shared keys and gives all columns
    of those that may be in it (:func:`in_sieve`); ``keys(key)`` is enough then, and isn't read if ``sizes`` has what
    :func:`shared_keys` gives. A full sieve lets all pass, which is as right and saves nothing.
    """
    size = sizes if sizes is not None else keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    if sifted is not None:
        size = cut(size, "sizes")
        keys = sifted(sieve_of(size))
    # Spark takes the keys for as many rows as nodes and would send all of them through the driver to every executor
    shared = cut(keys.join(size.hint("merge"), "key"), "shared")
    drop_cut(size)
    release(keys.sparkSession)
    company = shared.groupBy("node").agg(F.sum("n").alias("company"))
    rows = cut(shared.join(company, "node"), "company")
    drop_cut(shared)
    roots = cut(rows.select("node", F.col("node").alias("root")).distinct(), "roots")
    release(keys.sparkSession)

    def linked(pairs: DataFrame) -> DataFrame:
        wanted = pairs.select(F.col("a").alias("node")).union(pairs.select(F.col("b").alias("node"))).distinct()
        texts = texts_of(cut(wanted, "wanted"))
        a, b = texts.select(F.col("node").alias("a"), F.col("text").alias("text_a")), texts.select(F.col("node").alias("b"), F.col("text").alias("text_b"))
        links = cut(pairs.join(a, "a").join(b, "b").where(alike.columns(F.col("text_a"), F.col("text_b"))).select("a", "b"), "links")
        drop_cut(texts)
        return links

    tried = None
    for turn in range(rounds):
        order = F.col("company") if turn == 0 else F.xxhash64("node", F.lit(turn))  # later turns try others
        state = rows.select("key", "node", "f1", "f2", order.alias("order"))
        state = state if turn == 0 else state.join(roots, "node")
        leader = _side(state.groupBy("key").agg(F.max(F.struct("order", *(c for c in state.columns if c not in ("key", "order")))).alias("m")).select("key", "m.*"), "a")
        met = leader.join(_side(state.drop("order"), "b"), "key").where("a <> b" if turn == 0 else "aroot <> broot").where(near.columns("a", "b"))
        pairs = met.groupBy("b").agg(F.max(F.struct("aorder", "a")).alias("best")).select(F.least("best.a", "b").alias("a"), F.greatest("best.a", "b").alias("b")).distinct()
        pairs = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = pairs if tried is None else tried.union(pairs)
        links = linked(pairs)
        roots = _merged(roots, links)
        drop_cut(links)
        release(keys.sparkSession)
    # all that is left: pairs of different groups
    crowds = _crowds(rows, roots, small)
    placed = roots.withColumn("crowd", F.lit(None).cast("long")) if crowds is None else roots.join(crowds, "node", "left")
    state = cut(rows.drop("company").join(placed, "node"), "state")
    drop_cut(rows)
    release(keys.sparkSession)
    several = state.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), (F.count("crowd") == F.count("*")).alias("full"), F.min("crowd").alias("c"), F.max("crowd").alias("d"))
    # all of a bucket is of one crowd: its pairs meet there
    several = several.where("low < high").where("(full and c = d) is not true").select("key")
    links = None
    if crowds is not None:
        links = _crowd_links(state.where("crowd is not null"), state.where("crowd is null").where(F.col("n") > small).join(several, "key"), near, alike, texts_of)
        drop_cut(crowds)
    few = cut(state.where(F.col("n") <= small).drop("n").join(several, "key"), "few")
    pairs = _side(few, "a").join(_side(few, "b"), "key").where("a < b and aroot <> broot and (acrowd <=> bcrowd and acrowd is not null) = false").where(near.columns("a", "b")).select("a", "b").distinct()
    pairs = cut(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"), "pairs")
    found = linked(pairs)
    roots = _merged(roots, found if links is None else found.union(links))
    drop_cut(state, few, pairs, found)
    release(keys.sparkSession)
    grouped = roots.groupBy("root").agg(F.count("*").alias("n")).where("n > 1").select("root")
    return roots.join(grouped, "root").select("node", "root")

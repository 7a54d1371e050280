"""What several operators share: scratch tables, name-safe inputs, what Python workers keep, components.

Scratch tables live under the folder that the session names in ``spark.checkpoint.dir``. Every executor can read that
folder, so a lost executor costs only the tasks that it ran.
"""

from __future__ import annotations

import atexit
import gc
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()


def scratch_root(spark: SparkSession) -> str:
    """The shared folder for intermediate tables. Where the session names none, a temporary one serves a local master
    (tests); on a cluster that would lose rows unseen, so it is an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = _temporary.get(spark.sparkContext.applicationId)
        if not root:
            root = _temporary[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="lectern-scratch-")
    return root.rstrip("/")


_temporary: dict[str, str] = {}
_written: list[tuple[SparkSession, str]] = []


def scratch_path(spark: SparkSession, label: str) -> str:
    path = f"{scratch_root(spark)}/lectern-{label}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: later stages start from files, not from its lineage."""
    spark = df.sparkSession
    path = scratch_path(spark, label)
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    return out


def drop_cut(*frames: DataFrame) -> None:
    """Delete tables of :func:`cut` that no lazy plan will read again."""
    for df in frames:
        path = getattr(df, "_lectern_path", None)
        if path:
            delete(df.sparkSession, path)


def release(spark: SparkSession) -> None:
    """Let go of plans that are done with: Spark deletes their shuffle files once the driver has collected them."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


#: Up to so many small rows are broadcast, where their number has been counted.
FEW = 200_000


def if_few(rows: DataFrame, few: int = FEW) -> DataFrame:
    """``rows`` marked for a broadcast if they have been counted and are few; else as they are, to be shuffled."""
    return F.broadcast(rows) if rows.count() <= few else rows


@atexit.register
def _sweep() -> None:
    for spark, path in _written:
        try:
            if spark.sparkContext._jsc is not None:
                delete(spark, path)
        except Exception:  # the JVM has gone; the folder's owner cleans up
            return


def named(name: str) -> Column:
    """The column of just that name, whatever marks it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def packed(docs: DataFrame, **columns: Column) -> DataFrame:
    """Whole rows as one struct ``row``, and ``columns`` beside it: no name of theirs can meet one of an input column.

    ``select("row.*")`` takes the rows apart again.
    """
    return docs.select(F.struct("*").alias("row"), *(c.alias(name) for name, c in columns.items()))


_kept: dict[tuple, Any] = {}


def kept_by_worker(key: tuple, build: Callable[[], Any]) -> Any:
    """What ``build`` made for ``key`` in this Python worker. Workers outlive their tasks and are shared by the stages of a
    job, so a worker keeps one such thing, that of the last stage."""
    if key not in _kept:
        _kept.clear()
        _kept[key] = build()
    return _kept[key]


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only; null counts as the empty text. A text of ASCII alone takes the way that is faster."""
    text = F.coalesce(text, F.lit(""))
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Up to so many links, where they have been counted, are gone through by one task: 16 MB, in arrays.
ONE_TASK = 500_000


def _least_of_component(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``node, root`` of links ``u, v``, by labels that are pulled down over links and then over labels."""
    parts = [[c.to_numpy(zero_copy_only=False) for c in b.columns] for b in batches if b.num_rows]
    if not parts:
        return
    u, v = (np.concatenate([p[k] for p in parts]) for k in (0, 1))
    nodes, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = at[: len(u)], at[len(u) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        for side in (a, b):
            np.minimum.at(new, side, low)
            np.minimum.at(new, label[side], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(nodes[label])], ["node", "root"])


def smallest_reachable(nodes: DataFrame, links: DataFrame, max_rounds: int = 60, one_task: int = ONE_TASK) -> DataFrame:
    """Connected components: ``nodes(node)`` and undirected ``links(a, b)`` give ``(node, root)``, root the least node reachable.

    Alternates large-star and small-star steps. Each keeps every component connected and hangs it ever more directly on
    its least node, so the number of rounds grows with the logarithm of the longest chain, and a round costs one or two
    shuffles of the links. Links are never collected; a hub's links meet only in ``min`` (combined before the shuffle)
    and in a join that AQE may split. Up to ``one_task`` links of long nodes are gone through by one task instead, with the
    same result.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "links")
    size = edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
    if 0 < size[0] <= one_task and dict(edges.dtypes)["u"] == "bigint":
        roots = edges.select("u", "v").coalesce(1).mapInArrow(_least_of_component, "node long, root long")
        return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))
    for _ in range(max_rounds):
        if not size[0]:
            break
        # large star: every neighbour above a node is hung on the least node of its neighbourhood
        both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("m", "u").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        # small star: a node and the nodes below it are hung on the least of those
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        new = cut(small, "links")
        now = new.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first()
        drop_cut(edges)
        edges = new
        if now == size:
            break
        size = now
    else:
        raise RuntimeError("components did not settle; raise max_rounds")
    roots = edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))
    return nodes.join(roots, "node", "left").select("node", F.coalesce("root", "node").alias("root"))

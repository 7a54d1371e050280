"""SimHash near-dedup by Golay-code fuzzy hashing.

A 64-bit fingerprint is cut into three segments of 22, 21 and 21 bits, each padded to a word of the perfect binary Golay
code (23, 12). Two fingerprints with at most two differing bits agree in full on one segment at least (pigeonhole), and
the next segment differs in two bits at most. A word's fuzzy keys are the codewords to which it and its 23 neighbours
decode: one, or six when it lies on the edge of a sphere. Two words at distance two have a common neighbour and so a
common key. The join key is (which segment, its bits, a fuzzy key of the next one): 34 bits.

Documents with a given share of equal shingles differ in far more bits. For these, :func:`similar_groups` takes 128 bits:
five whole words of the code, of which one has an error in five at most of all (pigeonhole), and with each the remaining
bits in seven runs of 15; candidates are verified by the Jaccard similarity of the texts' shingles.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import Test, connected
from .common import cut, if_few, named, packed, release, smallest_reachable

SEED = 42
SEGMENTS = ((42, 22), (21, 21), (0, 21))  # (lowest bit, width)
POLYNOMIAL = 0b110001110101  # x^11 + x^10 + x^6 + x^5 + x^4 + x^2 + 1 generates the code


def fingerprint(text: str | None, shingle: int = 3) -> int:
    """64-bit SimHash of whole ``text``, as unsigned: A-Z lower-cased, words between ASCII white space, word shingles."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    grams = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    n = max(1, len(words) - shingle + 1)
    hashes = np.fromiter((xxhash.xxh64_intdigest(g, SEED) for g in grams), np.uint64, n)
    ones = np.zeros(64, np.int64)
    for i in range(0, n, 1 << 15):
        bits = np.unpackbits(hashes[i : i + (1 << 15)].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprint_column(text: Column, shingle: int = 3) -> Column:
    """:func:`fingerprint` as a signed long, in Arrow batches."""

    @F.arrow_udf("long")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array(np.array([fingerprint(t.as_py(), shingle) for t in texts], np.uint64).view(np.int64))

    return of(text)


@lru_cache(1)
def _corrections() -> np.ndarray:
    """For each of the 2,048 syndromes, the pattern of up to three errors that has it."""
    table = np.zeros(2048, np.int64)
    one = [1 << i for i in range(23)]
    for e in [0, *one, *(a | b for a in one for b in one if a < b), *(a | b | c for a in one for b in one if a < b for c in one if b < c)]:
        table[int(syndrome(np.array([e]))[0])] = e
    return table


def syndrome(words: np.ndarray) -> np.ndarray:
    """Remainder of each 23-bit word on division by the generator polynomial."""
    rest = words.astype(np.int64)
    for bit in range(22, 10, -1):
        rest = rest ^ (((rest >> bit) & 1) * (POLYNOMIAL << (bit - 11)))
    return rest


def codeword_index(words: np.ndarray) -> np.ndarray:
    """12-bit index of the codeword to which each word decodes (always within three bits: the code is perfect)."""
    return (words ^ _corrections()[syndrome(words)]) >> 11


def fuzzy_keys(words: np.ndarray) -> np.ndarray:
    """One row per word: the sorted indexes that it and its 23 neighbours decode to; repeats are -1."""
    flips = np.array([0, *(1 << i for i in range(23))], np.int64)
    found = np.sort(codeword_index(words[:, None] ^ flips), axis=1)
    found[:, 1:][found[:, 1:] == found[:, :-1]] = -1
    return found


def join_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every join key of the unsigned fingerprints."""
    parts = [((prints >> np.uint64(low)) & np.uint64((1 << width) - 1)).astype(np.int64) for low, width in SEGMENTS]
    rows, keys = [], []
    for i, exact in enumerate(parts):
        near = fuzzy_keys(parts[(i + 1) % 3])
        row, column = np.nonzero(near >= 0)
        rows.append(row)
        keys.append((np.int64(i) << 40) | (exact[row] << 12) | near[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for i in range(0, len(fp), 8192):
            own = fp[i : i + 8192]
            row, key = join_keys(own.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(own[row])], ["key", "fp"])


def _emit_midpoints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    flips = np.array([0, *(1 << i for i in range(64))], np.uint64).view(np.int64)
    for batch in batches:
        fp = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
        for i in range(0, len(fp), 4096):
            own = fp[i : i + 4096]
            yield pa.RecordBatch.from_arrays([pa.array((own[:, None] ^ flips).ravel()), pa.array(np.repeat(own, 65))], ["key", "fp"])


def links(prints: DataFrame, bucket_max: int = 512) -> DataFrame:
    """Links ``(a, b)`` that join every two distinct fingerprints ``fp`` with at most two differing bits.

    Buckets of the Golay keys with up to ``bucket_max`` fingerprints are joined with themselves and each pair is verified
    in the join, so a fingerprint meets a bounded number of others. Fingerprints of a larger bucket go another way, with
    as many rows as fingerprints: each is dealt to itself and its 64 neighbours. Two fingerprints share such a point just
    when they differ in two bits at most, a point has at most 65 of them, and each is linked to the least one.
    """
    keys = cut(prints.select("fp").mapInArrow(_emit_keys, "key long, fp long"), "golay")
    size = keys.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = keys.join(size, "key")
    small = shared.where(F.col("n") <= bucket_max).select("key", "fp")
    a, b = small.select("key", F.col("fp").alias("a")), small.select("key", F.col("fp").alias("b"))
    pairs = a.join(b, (a.key == b.key) & (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)).select("a", "b")
    if size.where(F.col("n") > bucket_max).limit(1).count():
        crowded = shared.where(F.col("n") > bucket_max).select("fp").distinct()
        points = crowded.mapInArrow(_emit_midpoints, "key long, fp long")
        least = points.groupBy("key").agg(F.min("fp").alias("a"), F.collect_list("fp").alias("all")).where(F.size("all") > 1)
        pairs = pairs.union(least.select("a", F.explode("all").alias("b")).where("a <> b"))
    return pairs.distinct()


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, bucket_max: int = 512) -> DataFrame:
    """One row per input row: ``id, fp`` (long), ``component_id``, the smallest id reachable over links.

    Copies collapse to one fingerprint before anything is joined. Null and blank texts have fingerprint zero and link
    like others. Null ids are passed over for ``component_id`` unless the whole group has none. Repeated rows stay apart
    in the result. Other columns are not read. An empty table gives no rows.
    """
    rows = cut(docs.select(named(id_col).alias("id"), fingerprint_column(named(text_col), shingle).alias("fp")), "prints")
    prints = cut(rows.groupBy("fp").agg(F.min("id").alias("least")), "distinct-prints")
    found = cut(links(prints, bucket_max), "links")
    touched = found.select(F.col("a").alias("node")).union(found.select(F.col("b").alias("node"))).distinct()
    roots = cut(smallest_reachable(touched, found), "roots")
    group = prints.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = group.groupBy("root").agg(F.min("least").alias("component_id"))
    of_print = group.join(least, "root").select("fp", "component_id")
    return rows.join(of_print, "fp").select("id", "fp", "component_id")


WORDS, EXACT = 5, 15  # whole Golay words of a wide fingerprint, bits that must agree beside one


def text_words(text: str | None) -> list[bytes]:
    """A-Z lower-cased, between ASCII white space."""
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def wide_fingerprint(words: list[bytes], shingle: int = 2) -> bytes:
    """128-bit SimHash of word shingles; fewer words: of the whole sequence; none: zero."""
    if not words:
        return bytes(16)
    grams = [b" ".join(words)] if len(words) < shingle else list(map(b" ".join, zip(*(words[i:] for i in range(shingle)))))
    ones = np.zeros(128, np.int64)
    for i in range(0, len(grams), 1 << 14):
        hashes = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, grams[i : i + (1 << 14)])), np.uint8).reshape(-1, 16)
        ones += np.unpackbits(hashes, axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(grams)).tobytes()


def wide_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, key) of every join key of fingerprints given as rows of 16 bytes: which word, which run, its bits, a fuzzy key."""
    bits = np.unpackbits(prints, axis=1).astype(np.int64)
    rows, keys = [], []
    for i in range(WORDS):
        near = fuzzy_keys(bits[:, 23 * i : 23 * i + 23] @ (1 << np.arange(23)))
        row, column = np.nonzero(near >= 0)
        rest = np.delete(bits, np.s_[23 * i : 23 * i + 23], axis=1)
        for j in range(rest.shape[1] // EXACT):
            exact = rest[:, EXACT * j : EXACT * (j + 1)] @ (1 << np.arange(EXACT))
            rows.append(row)
            keys.append(np.int64(i * 8 + j) << 40 | exact[row] << 12 | near[row, column])
    return np.concatenate(rows), np.concatenate(keys)


def _emit_wide_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        node, f1, f2 = (c.to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
        for i in range(0, len(node), 1024):
            part = slice(i, i + 1024)
            row, key = wide_keys(np.stack([f1[part], f2[part]], axis=1).astype("<i8").view(np.uint8))
            yield pa.RecordBatch.from_arrays([pa.array(key), *(pa.array(c[part][row]) for c in (node, f1, f2))], ["key", "node", "f1", "f2"])


def _prints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 512):
            part = batch.slice(i, 512)
            found = bytearray()
            for text in part.column(1):
                words = text_words(text.as_py())
                found += xxhash.xxh3_128_digest(b" ".join(words)) + wide_fingerprint(words)
            four = np.frombuffer(bytes(found), "<i8").reshape(-1, 4)
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), *(pa.array(np.ascontiguousarray(four[:, k])) for k in range(4))], ["id", "x", "h1", "h2", "f1", "f2"])


def jaccard(a: set, b: set) -> float:
    """Of two sets; of two empty ones 1."""
    both = len(a & b)
    return both / (len(a) + len(b) - both) if a or b else 1.0


def shingles(text: str | None, size: int) -> set[tuple[bytes, ...]]:
    words = text_words(text)
    return set(zip(*(words[i:] for i in range(size)))) if len(words) >= size else {tuple(words)} if words else set()


def similar_column(a: Column, b: Column, shingle: int, least: float) -> Column:
    """Whether the texts' shingle sets have a Jaccard similarity of ``least`` or more."""

    @F.arrow_udf("boolean")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        sets = lru_cache(8)(lambda t: shingles(t, shingle))  # the middle of a family comes again and again
        for left, right in batches:
            yield pa.array([jaccard(sets(x.as_py()), sets(y.as_py())) >= least for x, y in zip(left, right)], pa.bool_())

    return of(a, b)


def similar_rows(shingle: int, least: float):
    """The same for a list of texts, as a test of one's place and others' places: first by hashes of the shingles, then, for
    those that come near ``least``, by the shingles."""

    def of(texts: list[str]):
        sets = lru_cache(64)(lambda k: shingles(texts[k], shingle))
        own = [np.fromiter({xxhash.xxh3_64_intdigest(b" ".join(g)) for g in shingles(t, shingle)}, np.uint64) for t in texts]
        sizes = np.array([len(x) for x in own])
        values, codes = np.unique(np.concatenate(own), return_inverse=True)
        starts, mark = np.cumsum(sizes) - sizes, np.zeros(len(values), bool)

        def test(v: int, js: np.ndarray) -> np.ndarray:
            mine = codes[starts[v] : starts[v] + sizes[v]]
            mark[mine] = True
            ends = np.cumsum(sizes[js])
            hits = np.concatenate(([0], np.cumsum(mark[codes[np.arange(ends[-1]) + np.repeat(starts[js] - ends + sizes[js], sizes[js])]])))
            mark[mine] = False
            both = hits[ends] - hits[ends - sizes[js]]
            maybe = both >= (least - 0.01) * (sizes[v] + sizes[js] - both)
            return np.array([ok and jaccard(sets(v), sets(j)) >= least for ok, j in zip(maybe.tolist(), js.tolist())], bool)

        return test

    return of


def similar_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, least: float = 0.8, radius: int = 20) -> DataFrame:
    """One row per input row: ``id, component_id``, the smallest id reachable over links.

    Two texts link if the Jaccard similarity of their sets of ``shingle``-word shingles is ``least`` or more. Candidates
    share a fuzzy key of 128-bit fingerprints (of two-word shingles, which a changed word disturbs less) and differ in
    ``radius`` bits at most; texts of equal words are one node. The similarity is exact; that a similar pair shares a key
    is likely, not sure. Measured against all pairs: see the README.

    Null and blank texts have no words and are alike. Null ids are passed over for ``component_id`` unless the whole group
    has none. Repeated rows stay apart in the result. Other columns are not read. An empty table gives no rows.
    """
    kind = dict(docs.dtypes)[id_col]
    raw = docs.select(named(id_col).alias("id"), named(text_col).alias("text"), F.xxhash64(named(text_col)).alias("x"))
    rows = cut(raw.mapInArrow(_prints, f"id {kind}, x long, h1 long, h2 long, f1 long, f2 long"), "prints")
    nodes = cut(rows.groupBy("h1", "h2").agg(F.min("id").alias("least"), F.min(F.struct("id", "x")).alias("one"), F.min("f1").alias("f1"), F.min("f2").alias("f2")).withColumn("node", F.monotonically_increasing_id()), "nodes")
    release(docs.sparkSession)
    keys = nodes.select("node", "f1", "f2").mapInArrow(_emit_wide_keys, "key long, node long, f1 long, f2 long")

    def texts_of(wanted: DataFrame) -> DataFrame:
        one = nodes.join(wanted, "node").select("node", F.col("one.id").alias("one_id"), F.col("one.x").alias("one_x"))
        found = raw.join(if_few(cut(one, "one")), raw["id"].eqNullSafe(F.col("one_id")) & (raw["x"] == F.col("one_x")))
        return cut(found.select("node", "text").dropDuplicates(["node"]), "texts")

    def near(a: str, b: str) -> Column:
        return F.bit_count(F.col(f"{a}f1").bitwiseXOR(F.col(f"{b}f1"))) + F.bit_count(F.col(f"{a}f2").bitwiseXOR(F.col(f"{b}f2"))) <= radius

    def near_rows(f1: np.int64, f2: np.int64, f1s: np.ndarray, f2s: np.ndarray) -> np.ndarray:
        return sum(np.bitwise_count((x ^ xs).view(np.uint64)).astype(int) for x, xs in ((f1, f1s), (f2, f2s))) <= radius

    roots = connected(keys, Test(near, near_rows), texts_of, Test(lambda a, b: similar_column(a, b, shingle, least), similar_rows(shingle, least)))
    group = nodes.select("node", "h1", "h2", "least").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = group.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.select("id", "h1", "h2").join(group.join(smallest, "root").select("h1", "h2", "component_id"), ["h1", "h2"]).select("id", "component_id")


def drop_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one document, the one with the smallest id, of each group of :func:`similar_groups`; rows without an id
    stay."""
    gone = similar_groups(docs, id_col, text_col, **how).where("id <> component_id").select("id").distinct()
    return packed(docs, id=named(id_col)).join(gone, "id", "left_anti").select("row.*")

"""Fuzzy line dedup.

Normalised lines get a SimHash in eight blocks of 32 bits. A line's features (words, and for short lines runs of three
bytes) are dealt to the blocks by their own hashes, and a block is the SimHash of its features. So a changed word
disturbs two blocks at most, the one it leaves and the one it comes to, and lines with up to three changed words agree on
two blocks at least (pigeonhole). Lines that share a block, extended by the next ones while it holds few characters, are
verified by edit similarity, and of each connected group of lines one occurrence stays, the first by document id and line
number.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .buckets import Test, connected, in_sieve, shared_keys
from .common import cut, if_few, named, packed, release

BLOCKS = 8
#: Characters that the blocks of a key must hold.
HOLD = 12
#: Bits of 32 in which the SimHashes of whole lines may differ; strangers differ in 16 or so.
RADIUS = 12
#: Words are the features of lines with this many or more; runs of three bytes those of lines with up to so many words.
WORDS_FROM, RUNS_TO = 6, 9
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64


def normalise(line: str) -> bytes:
    """Lower case; runs of ASCII white space are one space; none at the ends; UTF-8."""
    return b" ".join(line.lower().encode("utf-8", "surrogatepass").split())


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of the base and of its inverse, as many as the longest buffer so far needs."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)
        self.of_byte = _mixed(np.arange(1, 257, dtype=np.uint64))

    def hashes(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hash of each slice of ``buf``: a polynomial in the base over its bytes, from prefix sums, mixed."""
        if len(self.up) <= len(buf):
            n = 1 << len(buf).bit_length()
            grown = [np.full(n, base % (1 << 64), np.uint64) for base in (_BASE, pow(_BASE, -1, 1 << 64))]
            for g in grown:
                g[0] = 1
            self.up, self.down = (np.multiply.accumulate(g) for g in grown)
        sums = np.zeros(len(buf) + 1, np.uint64)
        np.cumsum(self.of_byte[buf] * self.up[: len(buf)], out=sums[1:])
        return _mixed((sums[ends] - sums[starts]) * self.down[starts])


#: Bits of a byte, and of half a byte, each as a counter of its own in one number.
_EIGHT = sum((np.arange(256, dtype=np.uint64) >> np.uint64(q) & np.uint64(1)) << np.uint64(8 * q) for q in range(8))
_FOUR = sum((np.arange(16, dtype=np.uint64) >> np.uint64(q) & np.uint64(1)) << np.uint64(16 * q) for q in range(4))
#: Lines whose features are told apart in one sort: a line's number has 20 bits there.
_SORTED = 1 << 20


def _ones(bits: np.ndarray, starts: np.ndarray, most: int) -> np.ndarray:
    """For runs of numbers of 32 bits that begin at ``starts`` and have ``most`` members at most: how many have each bit."""
    octets = bits.astype("<u4").view(np.uint8).reshape(-1, 4)
    if most < 1 << 8:
        return np.stack([np.add.reduceat(_EIGHT[octets[:, j]], starts) for j in range(4)], axis=1).astype("<u8").view(np.uint8)
    if most < 1 << 16:
        halves = [octets[:, j // 2] >> 4 * (j % 2) & 15 for j in range(8)]
        return np.stack([np.add.reduceat(_FOUR[half], starts) for half in halves], axis=1).astype("<u8").view("<u2")
    return np.add.reduceat(np.unpackbits(octets, axis=1, bitorder="little"), starts, axis=0, dtype=np.int64)


def _majority(ones: np.ndarray, count: np.ndarray) -> np.ndarray:
    return np.packbits(ones > (count // 2)[:, None], axis=1, bitorder="little").view("<u4").ravel()


def simhash_blocks(lines: np.ndarray, hashes: np.ndarray, held: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For features given by line, in ascending order, hash and characters: each line's eight blocks (n x 8, of 32 bits), how many characters
    they hold, and the SimHash of 32 bits of the line as a whole. A bit is set if it is in over half of the block's features; a feature that a line repeats counts once, else
    a block would be that of the commonest word in it. A feature's characters count up to 511."""
    if n > _SORTED:
        at = int(np.searchsorted(lines, _SORTED))
        parts = simhash_blocks(lines[:at], hashes[:at], held[:at], _SORTED), simhash_blocks(lines[at:] - _SORTED, hashes[at:], held[at:], n - _SORTED)
        return tuple(np.concatenate(own) for own in zip(*parts))
    out, sums, whole = np.zeros(n * BLOCKS, np.uint32), np.zeros(n * BLOCKS, np.int64), np.zeros(n, np.uint32)
    if len(lines):
        # line, block, bits, characters: one sort brings equal features together, and those of a block
        told = lines.astype(np.uint64) << np.uint64(44) | hashes >> np.uint64(61) << np.uint64(41)
        told |= (hashes & np.uint64(0xFFFFFFFF)) << np.uint64(9) | np.minimum(held, 511).astype(np.uint64)
        told.sort()
        told = told[np.concatenate(([True], told[1:] != told[:-1]))]
        group = (told >> np.uint64(41)).astype(np.int64)
        starts = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1])))
        count, group = np.diff(starts, append=len(told)), group[starts]
        ones = _ones((told >> np.uint64(9)).astype(np.uint32), starts, int(count.max()))
        out[group] = _majority(ones, count)
        sums[group] = np.add.reduceat((told & np.uint64(511)).astype(np.int64), starts)
        line = group // BLOCKS
        starts = np.flatnonzero(np.concatenate(([True], line[1:] != line[:-1])))
        wide = np.uint16 if ones.dtype == np.uint8 else np.int64
        whole[line[starts]] = _majority(np.add.reduceat(ones, starts, axis=0, dtype=wide), np.add.reduceat(count, starts))
    return out.reshape(n, BLOCKS), sums.reshape(n, BLOCKS), whole


def _binaries(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """Binary values of ``sizes`` bytes that stand one after another in ``data``."""
    ends = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(sizes), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data))])


def _bytes_of(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of binary values without nulls, one after another, and their sizes."""
    column = column.cast(pa.large_binary())
    ends = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    return np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8), np.diff(ends)


def _lines_of(texts: list[str | None], powers: Powers) -> tuple[np.ndarray, ...]:
    """Of all lines that aren't blank, in order: text, number, 128-bit hash, characters, and blocks with what they hold, by
    words and by runs of bytes (zeros where a line has no such features)."""
    raw = "\n".join([t.lower() if t else "" for t in texts]).encode("utf-8", "surrogatepass")
    buf = np.frombuffer(raw, np.uint8)
    first_line = np.cumsum([0, *(t.count("\n") + 1 if t else 1 for t in texts)])  # lower-casing makes no line feed
    spaces = _SPACE[buf]
    edge = np.diff(np.concatenate(([True], spaces, [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    breaks = np.flatnonzero(buf == 10)
    line = np.searchsorted(breaks, starts)
    used, own = np.unique(line, return_inverse=True)
    n = len(used)
    letters = np.cumsum(np.concatenate(([0], (buf & 0xC0) != 0x80)))
    sizes = letters[ends] - letters[starts]
    words = np.bincount(own, minlength=n)
    chars = np.bincount(own, sizes, n).astype(np.int64) + words - 1
    left, right = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(raw)]))
    bytes_of = np.bincount(own, ends - starts, n).astype(np.int64)
    tidy = (right - left)[used] == bytes_of + words - 1  # no space too many
    if any(mark in raw for mark in (b"\t", b"\v", b"\f", b"\r")):
        tidy[:] = False
    plain = [raw[a:b] if ok else b" ".join(raw[a:b].split()) for a, b, ok in zip(left[used].tolist(), right[used].tolist(), tidy.tolist())]
    digests = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, plain)), "<i8").reshape(-1, 2)
    enough = words[own] >= WORDS_FROM
    by_words = simhash_blocks(own[enough], powers.hashes(buf, starts, ends)[enough], sizes[enough] + 1, n)
    short = np.flatnonzero(words <= RUNS_TO)
    padded = np.frombuffer(b"".join([b" %b " % plain[k] for k in short.tolist()]) + b"  ", np.uint8).astype(np.uint64)
    at = np.repeat(short, bytes_of[short] + words[short] + 1)
    runs = padded[:-2] | padded[1:-1] << np.uint64(8) | padded[2:] << np.uint64(16)
    whole = at[:-2] == at[2:] if len(at) > 2 else np.zeros(0, bool)  # a run lies in one line
    at, runs = at[: len(whole)][whole], runs[: len(whole)][whole]
    by_runs = simhash_blocks(at, _mixed(runs + np.uint64(1 << 40)), np.full(len(at), 3), n)
    text_no = np.searchsorted(first_line, used, side="right") - 1
    return text_no, used - first_line[text_no], digests, chars, by_words, by_runs, plain


def _parts(batch: pa.RecordBatch, column: int, most: int = 1 << 18) -> Iterator[pa.RecordBatch]:
    """Slices with texts of some ``most`` characters together, a text at least."""
    sizes = np.array([len(t) if t else 0 for t in batch.column(column).to_pylist()]) if batch.num_rows else []
    at = 0
    while at < batch.num_rows:
        end = at + max(1, int(np.searchsorted(np.cumsum(sizes[at:]), most)))
        yield batch.slice(at, end - at)
        at = end


def line_table(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``id, line_no, h1, h2, chars, sig`` of every line that isn't blank; (``h1``, ``h2``) is a 128-bit hash of the normalised
    line, ``sig`` its SimHash by words or by runs, or both: a letter, 32-bit blocks, a byte for what each holds,
    and the SimHash of the whole line."""
    kind = dict(docs.dtypes)[id_col]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            for part in _parts(batch, 1):
                text_no, number, digests, chars, by_words, by_runs, _ = _lines_of(part.column(1).to_pylist(), powers)
                if not len(number):
                    continue
                sets = [np.concatenate((np.full((len(number), 1), letter, np.uint8), blocks.astype("<u4").view(np.uint8), np.minimum(held, 255).astype(np.uint8), whole.astype("<u4")[:, None].view(np.uint8)), axis=1) for letter, (blocks, held, whole) in zip(b"wr", (by_words, by_runs))]
                has = np.stack([held.any(axis=1) for _, held, _ in (by_words, by_runs)], axis=1)
                sig = _binaries(np.stack(sets, axis=1)[has], has.sum(axis=1) * sets[0].shape[1])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(text_no)), pa.array(number), *(pa.array(np.ascontiguousarray(digests[:, k])) for k in (0, 1)), pa.array(chars), sig],
                    ["id", "line_no", "h1", "h2", "chars", "sig"])

    return docs.select(named(id_col).alias("id"), named(text_col).alias("text")).mapInArrow(emit, f"id {kind}, line_no long, h1 long, h2 long, chars long, sig binary")


def block_keys(blocks: np.ndarray, held: np.ndarray, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, key): for each block that holds anything, its hash, with those of the next blocks until they hold ``HOLD``."""
    rows, keys = [], []
    for i in range(BLOCKS):
        key = _mixed(blocks[:, i].astype(np.uint64) + np.uint64((salt * BLOCKS + i + 1) << 32))
        have = held[:, i].astype(np.int64)
        for j in range(1, BLOCKS):
            more = have < HOLD
            k = (i + j) % BLOCKS
            key = np.where(more, _mixed(key ^ (blocks[:, k].astype(np.uint64) + np.uint64(j << 40))), key)
            have = have + np.where(more, held[:, k], 0)
        row = np.flatnonzero(held[:, i])
        rows.append(row)
        keys.append(key[row])
    return np.concatenate(rows), np.concatenate(keys)


def _emit_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    width = 5 * BLOCKS + 5
    for batch in batches:
        for at in range(0, batch.num_rows, 4096):
            part = batch.slice(at, 4096)
            node, chars = (part.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            raw, sizes = _bytes_of(part.column(2))
            own, raw = np.repeat(np.arange(len(sizes)), sizes // width), raw.reshape(-1, width)
            for salt, letter in enumerate(b"wr"):
                of = raw[:, 0] == letter
                row, key = block_keys(np.ascontiguousarray(raw[of, 1 : 4 * BLOCKS + 1]).view("<u4"), raw[of, 4 * BLOCKS + 1 : 5 * BLOCKS + 1], salt)
                line = own[of][row]
                whole = np.ascontiguousarray(raw[of, 5 * BLOCKS + 1 :]).view("<u4").ravel().astype(np.int64)[row]
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), *(pa.array(c) for c in (node[line], chars[line], whole))], ["key", "node", "f1", "f2"])


def edit_distance(a: str, b: str, most: int) -> int:
    """Levenshtein distance, or ``most + 1`` if it is larger. Bit-parallel over what differs between common ends."""
    n = min(len(a), len(b))
    if abs(len(a) - len(b)) > most:
        return most + 1
    low, high = 0, n
    while low < high:  # longest common prefix, by halves
        mid = (low + high + 1) // 2
        if a[:mid] == b[:mid]:
            low = mid
        else:
            high = mid - 1
    a, b = a[low:], b[low:]
    low, high = 0, min(len(a), len(b))
    while low < high:
        mid = (low + high + 1) // 2
        if a[len(a) - mid :] == b[len(b) - mid :]:
            low = mid
        else:
            high = mid - 1
    a, b = a[: len(a) - low], b[: len(b) - low]
    if not a or not b:
        return min(most + 1, len(a) + len(b))
    has: dict[str, int] = {}
    for i, c in enumerate(a):
        has[c] = has.get(c, 0) | 1 << i
    full, last = (1 << len(a)) - 1, 1 << (len(a) - 1)
    up, down, score = full, 0, len(a)
    for left, c in zip(range(len(b) - 1, -1, -1), b):
        eq = has.get(c, 0)
        x = eq | down
        flat = (((eq & up) + up) ^ up) | eq
        rise, fall = down | (full & ~(flat | up)), up & flat
        if rise & last:
            score += 1
        elif fall & last:
            score -= 1
        if score - left > most:
            return most + 1
        rise = (rise << 1 | 1) & full
        fall = fall << 1 & full
        up, down = fall | (full & ~(x | rise)), rise & x
    return min(score, most + 1)


#: Numbers of words that two lines skip to meet again, the fewest first.
_SKIPS = sorted(((p, q) for p in range(7) for q in range(7) if p or q), key=lambda s: (max(s), abs(s[0] - s[1])))


def aligned(x: list[str], y: list[str], most: int) -> bool:
    """Whether two lines' words, gone through side by side, show that the distance is ``most`` or less. Where they differ, they
    meet again at the next two equal words, and what lies between is changed as a whole: never less than the distance."""
    i = j = cost = 0
    n, m = len(x), len(y)
    while True:
        for p, q in zip(x[i:], y[j:]) if i or j else zip(x, y):
            if p != q:
                break
            i += 1
            j += 1
        p, q = n - i, m - j  # all that is left, unless they meet before
        if p and q:
            p, q = next((s for s in _SKIPS if (two := x[i + s[0] : i + s[0] + 2]) and two == y[j + s[1] : j + s[1] + 2]), (p, q))
        cost += max(sum(map(len, x[i : i + p])) + p, sum(map(len, y[j : j + q])) + q)
        i, j = i + p, j + q
        if cost > most or i == n and j == m:
            return cost <= most


def similar(a: str, b: str, least: float) -> bool:
    """Whether 1 - distance / longer length is ``least`` or more.

    If the words between the common ends can be changed one by one, or all together, or by what lies between common words,
    within the bound, that is enough; else the distance decides.
    """
    longer = max(len(a), len(b))
    most = int((1 - least) * longer + 1e-9)
    if longer - min(len(a), len(b)) > most:
        return False
    x, y = a.split(" "), b.split(" ")
    if len(x) == len(y) and sum(max(len(p), len(q)) for p, q in zip(x, y) if p != q) <= most:
        return True
    head = 0
    for p, q in zip(x, y):
        if p != q:
            break
        head += 1
    tail = 0
    for p, q in zip(reversed(x[head:]), reversed(y[head:])):
        if p != q:
            break
        tail += 1
    x, y = x[head : len(x) - tail], y[head : len(y) - tail]
    if max(sum(map(len, x)) + len(x), sum(map(len, y)) + len(y)) <= most:
        return True
    return aligned(x, y, most) or edit_distance(a, b, most) <= most


def _texts(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame) -> DataFrame:
    """``node, text`` of the wanted ``node, id, line_no, h1, h2``: lines are taken from their documents by number, and told by
    their hash where rows share an id."""
    kind = wanted.schema["id"].dataType.simpleString()
    lines = wanted.groupBy("id").agg(F.collect_list(F.struct("node", "line_no", "h1", "h2")).alias("own"))

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 0):
                rows = []
                for text, own in zip(part.column(0), part.column(1)):
                    parts = (text.as_py() or "").split("\n")
                    for w in own.as_py():
                        plain = normalise(parts[w["line_no"]]) if w["line_no"] < len(parts) else b""
                        if xxhash.xxh3_128_digest(plain) == struct.pack("<qq", w["h1"], w["h2"]):
                            rows.append((w["node"], plain.decode("utf-8", "surrogatepass")))
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.string())], ["node", "text"])

    rows = docs.select(named(id_col).alias("doc"), named(text_col).alias("text"))
    held = rows.join(if_few(cut(lines, "wanted-lines")), rows["doc"].eqNullSafe(F.col("id").cast(kind)))
    return held.select("text", "own").mapInArrow(emit, "node long, text string").dropDuplicates(["node"])


PAIR_BINS = 256
#: Up to so many nodes, of one long or two each, are broadcast.
FEW_NODES = 1_000_000


def pair_counts(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Sizes of texts, and how often each pair of neighbouring characters is in each, by a hash of the pair."""
    sizes = np.array([len(t) for t in texts], np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    place = np.repeat(np.arange(len(texts)) * PAIR_BINS, sizes)
    pairs = (chars[:-1] * np.uint32(0x9E3779B1) ^ chars[1:] * np.uint32(0x85EBCA6B)) >> np.uint32(24)
    found = np.bincount((place[:-1] + pairs)[place[:-1] == place[1:]], minlength=len(texts) * PAIR_BINS)
    return sizes, found.reshape(-1, PAIR_BINS).astype(np.int32 if sizes.max(initial=0) >> 15 else np.int16)


def enough_in_common(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], least: float) -> np.ndarray:
    """Where texts with these sizes and counts may be similar: an edit takes away two of a text's pairs of characters at most."""
    longer = np.maximum(a[0], b[0])
    return np.minimum(a[1], b[1]).sum(axis=1, dtype=int) >= longer - 1 - 2 * ((1 - least) * longer + 1e-9).astype(int)


def similar_pairs(left: list[str], right: list[str], least: float, at_once: int = 512) -> list[bool]:
    """:func:`similar` for each two texts; those that have too few pairs of characters in common aren't compared further."""
    found = []
    for at in range(0, len(left), at_once):
        a, b = left[at : at + at_once], right[at : at + at_once]
        maybe = enough_in_common(pair_counts(a), pair_counts(b), least)
        found += [ok and similar(x, y, least) for ok, x, y in zip(maybe.tolist(), a, b)]
    return found


def similar_column(a: Column, b: Column, least: float) -> Column:
    @F.arrow_udf("boolean")
    def of(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for left, right in batches:
            yield pa.array(similar_pairs(left.to_pylist(), right.to_pylist(), least), pa.bool_())

    return of(a, b)


def similar_rows(least: float):
    """:func:`similar` for a list of texts, as a test of one's place and others' places."""

    def of(texts: list[str]):
        sizes, pairs = pair_counts(texts)

        def test(v: int, js: np.ndarray) -> np.ndarray:
            maybe = enough_in_common((sizes[v], pairs[v]), (sizes[js], pairs[js]), least)
            return np.array([ok and similar(texts[v], texts[j], least) for ok, j in zip(maybe.tolist(), js.tolist())], bool)

        return test

    return of


def _repeated(docs: DataFrame, id_col: str, text_col: str, least: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Lines ``id, line_no, h1, h2``; ``h1, h2, first, n`` of different lines, their first occurrence and the number of all;
    ``h1, h2, first`` of those that go with all their occurrences, as a line of their group that stays comes before."""
    signed = cut(line_table(docs, id_col, text_col), "signed-lines")
    # numbers are made while the table is written, so they are fixed from then on
    distinct = signed.groupBy("h1", "h2").agg(F.min(F.struct("id", "line_no")).alias("first"), F.min("chars").alias("chars"), F.min("sig").alias("sig"), F.count("*").alias("n"))
    distinct = cut(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct-lines")
    lines = signed.select("id", "line_no", "h1", "h2")
    release(docs.sparkSession)
    signed, schema = distinct.select("node", "chars", "sig"), "key long, node long, f1 long, f2 long"

    def only_keys(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:  # to be counted; most are of one line
        return (batch.column(0).to_numpy() for batch in _emit_keys(batches))

    def sifted(sieve: np.ndarray) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(sieve)

        def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in _emit_keys(batches):
                yield batch.filter(pa.array(in_sieve(shared.value, batch.column(0).to_numpy())))

        return signed.mapInArrow(emit, schema)

    def near(a: str, b: str) -> Column:  # the distance is the difference in length at least
        return (F.least(f"{a}f1", f"{b}f1") >= least * F.greatest(f"{a}f1", f"{b}f1") - 1e-6) & (F.bit_count(F.col(f"{a}f2").bitwiseXOR(F.col(f"{b}f2"))) <= RADIUS)

    def near_rows(f1: np.int64, f2: np.int64, f1s: np.ndarray, f2s: np.ndarray) -> np.ndarray:
        return (np.minimum(f1, f1s) >= least * np.maximum(f1, f1s) - 1e-6) & (np.bitwise_count((f2 ^ f2s).view(np.uint64)) <= RADIUS)

    def texts_of(wanted: DataFrame) -> DataFrame:
        spots = distinct.join(if_few(wanted, FEW_NODES), "node").select("node", "first.id", "first.line_no", "h1", "h2")
        return cut(_texts(docs, id_col, text_col, spots), "texts")

    roots = cut(connected(signed, Test(near, near_rows), texts_of, Test(lambda a, b: similar_column(a, b, least), similar_rows(least)), sifted=sifted, sizes=shared_keys(signed, only_keys)), "roots")
    # a line that has no link is a group of its own
    linked = distinct.select("node", "h1", "h2", "first").join(if_few(roots, FEW_NODES), "node")
    first = linked.groupBy("root").agg(F.min("first").alias("stays"))
    other = cut(linked.join(first, "root").where("first <> stays").select("h1", "h2", "first"), "other")
    return lines, distinct.select("h1", "h2", "first", "n"), other


def line_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """One row for every line that isn't blank: ``id, line_no, kept``; one occurrence of each connected group is kept.

    Lines are equal when their normalised forms are; such copies count as one line from the first shuffle on, combined
    before it. Different lines link when they share a key of their SimHash blocks and their edit similarity is ``least`` or
    more. That a similar pair shares a key is sure for up to three changed words of a line whose blocks hold enough, else
    likely, and so is that their SimHashes differ in ``RADIUS`` bits at most; recall against all pairs is measured in the tests and stated in the README.

    Null text has no lines. Null ids come before all others in choosing what is kept. Repeated rows repeat their lines, of
    which one occurrence is kept, though both rows' line bears its number; see :func:`dedup_lines`.
    """
    lines, distinct, other = _repeated(docs, id_col, text_col, least)
    placed = lines.join(distinct.drop("n"), ["h1", "h2"]).join(other.select("h1", "h2", F.lit(True).alias("other")), ["h1", "h2"], "left")
    return placed.select("id", "line_no", (F.struct("id", "line_no").eqNullSafe(F.col("first")) & F.col("other").isNull()).alias("kept"))


def dropped_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: float = 0.8) -> DataFrame:
    """``id, n_lines, dropped``: lines that aren't blank, and the sorted numbers of those that go, for each id.

    Only lines that may go, those with copies and those of a group that another line stands for, are looked up.
    """
    lines, distinct, other = _repeated(docs, id_col, text_col, least)
    going = distinct.where("n > 1").select("h1", "h2", "first", F.lit(False).alias("all")).union(other.select("h1", "h2", "first", F.lit(True)))
    gone = lines.join(going.hint("shuffle_hash"), ["h1", "h2"]).where(F.col("all") | ~F.struct("id", "line_no").eqNullSafe(F.col("first")))
    gone = gone.groupBy(F.col("id").alias("of")).agg(F.sort_array(F.collect_set("line_no")).alias("dropped"))
    counted = docs.select(named(id_col).alias("id"), F.lit(0).alias("n")).union(lines.select("id", F.lit(1)))
    totals = counted.groupBy("id").agg(F.sum("n").alias("n_lines"))
    return totals.join(gone, F.col("id").eqNullSafe(F.col("of")), "left").select("id", "n_lines", F.coalesce("dropped", F.array().cast("array<long>")).alias("dropped"))


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` without the dropped lines in ``text_col``. Blank lines stay. Rows with a repeated id lose the same lines."""
    gone = dropped_lines(docs, id_col, text_col, **how).where(F.size("dropped") > 0).select(F.col("id").alias("gone_id"), "dropped")
    both = packed(docs, id=named(id_col), text=named(text_col)).join(gone, F.col("id").eqNullSafe(F.col("gone_id")), "left")
    kept = F.array_join(F.filter(F.split("text", "\n"), lambda line, i: ~F.array_contains(F.col("dropped"), i.cast("long"))), "\n")
    text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept)
    return both.withColumn("row", F.col("row").withField("`" + text_col.replace("`", "``") + "`", text)).select("row.*")

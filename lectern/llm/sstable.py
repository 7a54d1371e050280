"""Token ids in sorted-string-table shards.

A shard is one file of sections, each followed by a newline byte (so that Spark's own text writer, with its commit
protocol, can put it into any store): data blocks, a sparse block index, a Bloom filter, a footer.

    block   'B', raw length u32, crc32 of raw u32, zstd(raw); raw is entries in key order, each
            varint shared prefix with the key before, varint rest of key, varint value length, rest of key, value
    index   'I', zstd of: varint key length, first key, varint offset, varint length, for each block
    filter  'F', number of hashes u8, bits
    footer  FOOTER, of fixed size

A key is a null flag and the id, big-endian with its sign flipped, so bytes sort as ids do and null comes first. A value is
the ids of one document, each u16 or u32, little-endian.
"""

from __future__ import annotations

import bisect
import re
import struct
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, kept_by_worker, named, scratch_path

MAGIC = b"LECSST01"
#: index offset, index length, filter offset, filter length, documents, ids, shard number, bytes per id, magic
FOOTER = struct.Struct("<QQQQQQIH8s")
HASHES, BITS_PER_KEY = 7, 10


def key_bytes(ident: int | None) -> bytes:
    return b"\0" + bytes(8) if ident is None else b"\1" + (ident + (1 << 63)).to_bytes(8, "big")


def key_ident(key: bytes) -> int | None:
    return None if key[0] == 0 else int.from_bytes(key[1:], "big") - (1 << 63)


def put_varint(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def get_varint(raw: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = raw[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


def _probes(keys: list[bytes], bits: int) -> np.ndarray:
    h = np.array([xxhash.xxh3_64_intdigest(k) for k in keys], np.uint64)
    step = (h >> np.uint64(32)) | np.uint64(1)
    return ((h[:, None] + np.arange(HASHES, dtype=np.uint64) * step[:, None]) % np.uint64(bits)).astype(np.int64)


class ShardWriter:
    """Sections of one shard, from entries in key order."""

    def __init__(self, number: int, width: int, block_bytes: int):
        self.number, self.width, self.block_bytes = number, width, block_bytes
        self.raw, self.first, self.last = bytearray(), b"", b""
        self.index, self.keys, self.at, self.tokens = bytearray(), bytearray(), 0, 0
        self.press = zstandard.ZstdCompressor(level=1)

    def _section(self, payload: bytes) -> bytes:
        self.at += len(payload) + 1
        return payload

    def add(self, ident: int | None, value: bytes) -> Iterator[bytes]:
        key = key_bytes(ident)
        if key < self.last:
            raise ValueError("keys out of order")
        if self.raw and len(self.raw) + len(value) > self.block_bytes:
            yield self._block()
        if not self.raw:
            self.first, shared = key, 0
        else:
            shared = next((i for i in range(len(key)) if key[i] != self.last[i]), len(key))
        for n in (shared, len(key) - shared, len(value)):
            put_varint(self.raw, n)
        self.raw += key[shared:] + value
        self.last = key
        self.keys += key
        self.tokens += len(value) // self.width

    def _block(self) -> bytes:
        payload = b"B" + struct.pack("<II", len(self.raw), zlib.crc32(self.raw)) + self.press.compress(bytes(self.raw))
        put_varint(self.index, len(self.first))
        self.index += self.first
        put_varint(self.index, self.at)
        put_varint(self.index, len(payload))
        self.raw = bytearray()
        return self._section(payload)

    def finish(self) -> Iterator[bytes]:
        if self.raw:
            yield self._block()
        index_at, index = self.at, b"I" + self.press.compress(bytes(self.index))
        yield self._section(index)
        keys = [bytes(self.keys[i : i + 9]) for i in range(0, len(self.keys), 9)]
        bits = np.zeros(max(64, -(-len(keys) * BITS_PER_KEY // 8) * 8), np.uint8)
        for i in range(0, len(keys), 65536):
            bits[_probes(keys[i : i + 65536], len(bits)).ravel()] = 1
        filter_at, packed = self.at, b"F" + bytes([HASHES]) + np.packbits(bits, bitorder="little").tobytes()
        yield self._section(packed)
        yield FOOTER.pack(index_at, len(index), filter_at, len(packed), len(keys), self.tokens, self.number, self.width, MAGIC)


class Shard:
    """Reads one shard's bytes; a lookup touches the filter, the index and one block (or a few, for a repeated key)."""

    def __init__(self, data: bytes):
        end = len(data) - 1 - FOOTER.size
        self.data = data
        self.index_at, self.index_len, self.filter_at, self.filter_len, self.documents, self.tokens, self.number, self.width, magic = FOOTER.unpack_from(data, end)
        if magic != MAGIC:
            raise ValueError("not a shard")
        raw, at = zstandard.ZstdDecompressor().decompressobj().decompress(data[self.index_at + 1 : self.index_at + self.index_len]), 0
        self.firsts, self.blocks = [], []
        while at < len(raw):
            n, at = get_varint(raw, at)
            self.firsts.append(raw[at : at + n])
            offset, at = get_varint(raw, at + n)
            length, at = get_varint(raw, at)
            self.blocks.append((offset, length))

    def block(self, k: int) -> Iterator[tuple[bytes, bytes]]:
        offset, length = self.blocks[k]
        size, crc = struct.unpack_from("<II", self.data, offset + 1)
        raw = zstandard.ZstdDecompressor().decompress(self.data[offset + 9 : offset + length], max_output_size=size)
        if len(raw) != size or zlib.crc32(raw) != crc:
            raise ValueError(f"block {k} is damaged")
        at, key = 0, b""
        while at < size:
            shared, at = get_varint(raw, at)
            rest, at = get_varint(raw, at)
            n, at = get_varint(raw, at)
            key = key[:shared] + raw[at : at + rest]
            at += rest
            yield key, raw[at : at + n]
            at += n

    def entries(self) -> Iterator[tuple[int | None, np.ndarray]]:
        for k in range(len(self.blocks)):
            for key, value in self.block(k):
                yield key_ident(key), np.frombuffer(value, f"<u{self.width}")

    def may_hold(self, ident: int | None) -> bool:
        packed = np.frombuffer(self.data, np.uint8, self.filter_len - 2, self.filter_at + 2)
        at = _probes([key_bytes(ident)], len(packed) * 8)[0]
        return bool(((packed[at >> 3] >> (at & 7)) & 1).all())

    def get(self, ident: int | None) -> list[np.ndarray]:
        """The values of a key, in file order; several for a repeated key."""
        if not self.blocks or not self.may_hold(ident):
            return []
        key, found = key_bytes(ident), []
        for k in range(max(0, bisect.bisect_left(self.firsts, key) - 1), len(self.blocks)):
            if self.firsts[k] > key:
                break
            found += [np.frombuffer(v, f"<u{self.width}") for own, v in self.block(k) if own == key]
        return found


#: Letters of ASCII and Latin-1, then ASCII punctuation without the apostrophe: a chunk whose pre-tokens are those two.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]*)([!-&(-/:-@\[-`{-~]*)")


def _byte_letters() -> dict[int, str]:
    """Byte-level pre-tokenisation writes each byte as one printable character: itself, or the next one above 255."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordEncoder:
    """Encodes whole texts chunk by chunk, a chunk being what stands between spaces and line feeds, and keeps the chunks.

    White space ends every pre-token of this tokenizer and nothing composes across it, so the ids of a text are those of
    its chunks in order. A plain chunk's pre-tokens go straight to the library's model; any other chunk goes through the
    whole tokenizer. The two caches together are emptied when they hold ``room`` bytes, counted with ``ENTRY`` bytes of
    overhead each, and a chunk of over ``LONG`` characters is never kept: memory is bounded whatever the texts are.
    """

    ENTRY, LONG = 200, 64

    def __init__(self, path: str, room: int = 128 << 20):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.width = 2 if self.whole.get_vocab_size() <= 1 << 16 else 4
        self.kind = {2: "H", 4: "I"}[self.width]
        self.letters, self.room, self.held = _byte_letters(), room, 0
        self.chunks: dict[str, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        packed = array(self.kind, ids)
        if sys.byteorder != "little":
            packed.byteswap()
        return packed.tobytes()

    def _keep(self, cache: dict[str, bytes], text: str, found: bytes) -> bytes:
        if len(text) <= self.LONG:
            self.held += self.ENTRY + len(text) + len(found)
            if self.held > self.room:
                self.chunks.clear()
                self.parts.clear()
                self.held = 0
            cache[text] = found
        return found

    def _part(self, part: str) -> bytes:
        if not part:
            return b""
        found = self.parts.get(part)
        if found is None:
            mapped = part if part.isascii() else "".join(map(self.letters.__getitem__, part.encode()))
            found = self._keep(self.parts, part, self._pack([t.id for t in self.model.tokenize(mapped)]))
        return found

    def _chunk(self, chunk: str) -> bytes:
        if m := _PLAIN.fullmatch(chunk):
            found = self._part(m[1].lower()) + self._part(m[2])
        else:
            found = self._pack(self.whole.encode(chunk, add_special_tokens=False).ids)
        return self._keep(self.chunks, chunk, found)

    def encode(self, text: str | None, end: int | None = None) -> bytes:
        """Little-endian ids of ``text``, ``end`` appended."""
        get, slow = self.chunks.get, self._chunk
        ids = [get(c) or slow(c) if c else b"" for c in (text or "").replace("\n", " ").split(" ")]
        if end is not None:
            ids.append(self._pack([end]))
        return b"".join(ids)


def write_shards(docs: DataFrame, path: str, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end: int | None = 2, shard_bytes: int = 32 << 20, block_bytes: int = 64 << 10) -> None:
    """Encode every whole text and write shards of about ``shard_bytes`` of text, in ascending order of id, to ``path``.

    Splitters are sampled on (id, hash of text), so that rows which share one id spread over several shards. Null text:
    as empty. Null ids come first. Repeated ids keep all their rows, ordered by text. An empty table gives no shard.
    """
    rows = docs.select(named(id_col).cast("long").alias("id"), F.coalesce(named(text_col), F.lit("")).alias("text"), F.xxhash64(named(text_col)).alias("h"))
    total = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = max(1, -(-total // shard_bytes))

    def sections(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = kept_by_worker(("encoder", tokenizer), lambda: WordEncoder(tokenizer))
        section = lambda x: pa.RecordBatch.from_arrays([pa.array([x], pa.binary())], ["section"])
        writer = None
        for batch in batches:
            for ident, text in zip(batch.column(0), batch.column(1)):
                writer = writer or ShardWriter(TaskContext.get().partitionId(), own.width, block_bytes)
                yield from map(section, writer.add(ident.as_py(), own.encode(text.as_py(), end)))
        if writer:
            yield from map(section, writer.finish())

    order = [F.col("id").asc_nulls_first(), F.col("h").asc()]
    dealt = rows.repartitionByRange(count, *order).sortWithinPartitions(*order, "text").select("id", "text")
    dealt.mapInArrow(sections, "section binary").select(F.col("section").cast("string").alias("value")).write.option("lineSep", "\n").text(path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for content in batch.column(0):
            if not (data := content.as_py()):
                continue
            shard = Shard(data)
            rows, start = [], 0
            for ident, ids in shard.entries():
                rows.append((shard.number, ident, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                start += len(ids)
            cols = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["shard", "id", "local_start", "n_tokens", "ids_crc32"])


def read_shards(spark: SparkSession, path: str) -> DataFrame:
    """One row per stored document: ``id, start, n_tokens, ids_crc32, shard``. ``start``: ids of all documents before it.

    Only the shards' totals meet in one place, to be summed up: a row a shard. A null id, and each row of a repeated id, has a
    row of its own, in the order of :func:`write_shards`; no shard gives no row.
    """
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    rows = cut(files.mapInArrow(_read, "shard long, id long, local_start long, n_tokens long, ids_crc32 long"), "entries")
    before = W.orderBy("shard").rowsBetween(W.unboundedPreceding, -1)
    bases = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(bases, "shard").select("id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32", "shard")


def round_trip(docs: DataFrame, tokenizer: str, path: str | None = None, **how) -> DataFrame:
    """Write shards to ``path`` (a scratch folder if not given) and read them back: a row for each row of ``docs``, nulls,
    empty texts and repeated ids as :func:`write_shards` says. Other columns are not read."""
    spark = docs.sparkSession
    path = path or scratch_path(spark, "shards")
    write_shards(docs, path, tokenizer, **how)
    return read_shards(spark, path)

"""Incremental ingestion: new book files become paragraphs once each; the stream's checkpoint knows which are done."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources import documents

FILES = "path string, modificationTime timestamp, length long, content binary"


def ingest_new_books(spark: SparkSession, books_dir: str, out_dir: str, checkpoint: str) -> StreamingQuery:
    """Decode the EPUBs that have come to ``books_dir`` since the last call and append their paragraphs to ``out_dir``.

    Runs through what is there and stops. Each batch is written by the file sink, exactly once.
    """
    files = spark.readStream.format("binaryFile").schema(FILES).option("pathGlobFilter", "*.epub").load(books_dir)
    paras = documents.book_paragraphs(documents.decode_books(files))
    return paras.writeStream.format("parquet").option("path", out_dir).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

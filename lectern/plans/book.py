"""From books to narration: the whole plan, many books in one job."""

from __future__ import annotations

import time
import urllib.request
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import chapters, chunks, denoise, paragraphs, sections
from ..sources import sinks

ATTEMPTS = 5


def paragraphs_from_lines(lines: DataFrame) -> DataFrame:
    """Running text stripped, paragraphs built and tidied."""
    return paragraphs.tidy_paragraphs(paragraphs.build_paragraphs(denoise.strip_running_text(lines)))


def plan_books(lines: DataFrame, toc: DataFrame, min_words: int = 80, limit: int = 6000, max_chars: int = 350) -> dict[str, DataFrame]:
    """Paragraphs, sections, chunks, totals and warnings of all books in ``lines``. Nothing runs yet."""
    paras = paragraphs_from_lines(lines)
    found = sections.choose_sections(paras, toc, min_words, limit)
    words = chapters.section_words(found)
    totals = chapters.book_totals(words)
    pages = lines.groupBy("book_id").agg((F.max("page") + 1).alias("pages"))
    source = found.groupBy("book_id").agg(F.first("chapter_source").alias("chapter_source"))
    books = source.join(pages, "book_id").select("book_id", F.lower("book_id").endswith(".epub").alias("is_epub"), "pages", "chapter_source")
    return {"paragraphs": paras, "sections": found, "chunks": chunks.chunk_sections(found, max_chars), "words": words, "totals": totals, "warnings": chapters.warnings(totals, books)}


def with_retries(call: Callable[..., bytes], *args, attempts: int = ATTEMPTS, pause: Callable[[float], None] = time.sleep) -> bytes | None:
    """What ``call`` returns; after each failure but the last a pause of 1, 2, 3, 4 seconds; then None."""
    for n in range(1, attempts + 1):
        try:
            return call(*args)
        except Exception:
            if n < attempts:
                pause(float(n))
    return None


def http_synthesiser(endpoint: str, model: str = "kokoro", timeout: float = 120.0) -> Callable[[str, str], bytes]:
    """Asks a speech service; ``endpoint`` may lack the end of its path. Address and body are made by the column functions
    that hold their rules; what it is called with is theirs."""

    def speak(url: str, body: str) -> bytes:
        request = urllib.request.Request(url, body.encode(), T.REQUEST_HEADERS, method="POST")
        with urllib.request.urlopen(request, timeout=timeout) as answer:
            return answer.read()

    speak.arguments = lambda text, voice, speed: [T.speech_url(F.lit(endpoint)), T.speech_payload(text, F.lit(model), voice, speed)]
    return speak


def synthesise(parts: DataFrame, speak: Callable[..., bytes], voice: str = "af_heart", speed: float = 1.0, tasks: int | None = None) -> DataFrame:
    """``parts(book_id, section_no, chunk_no, text)`` with ``audio``, null where every attempt failed.

    ``speak`` gets text, voice and speed, or what its own ``arguments`` makes columns of from these. All chunks of all books
    are one stage, dealt over ``tasks``; how many run at once is up to the cluster.
    """
    asked = getattr(speak, "arguments", lambda *plain: plain)(F.col("text"), F.lit(voice), F.lit(speed))
    call = lambda *args: speak(*args)

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sound = [with_retries(call, *x.as_py().values()) for x in batch.column("asked")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sound, pa.binary())], [*batch.schema.names[:-1], "audio"])

    rows = parts.select("book_id", "section_no", "chunk_no", "text", F.struct(*(a.alias(f"a{i}") for i, a in enumerate(asked))).alias("asked"))
    rows = rows.repartition(tasks, "book_id", "section_no", "chunk_no") if tasks else rows
    return rows.mapInArrow(of, "book_id string, section_no int, chunk_no int, text string, audio binary")


def narrate(plan: dict[str, DataFrame], speak: Callable[..., bytes], voice: str = "af_heart", speed: float = 1.0, tasks: int | None = None) -> DataFrame:
    """``book_id, section_no, title, audio, ms, failed, status``: a row for each chapter of every book.

    A book goes whole or not at all: if any of its chunks failed, all its chapters are ``failed``, without audio; ``failed``
    says how many chunks of the chapter. Chunks are synthesised in one pass, once each. Synthesis is dear, so write the
    result once and read it from there.
    """
    titles = plan["chunks"].select("book_id", "section_no", "title").distinct()
    audio = sinks.chapter_audio(synthesise(plan["chunks"], speak, voice, speed, tasks))
    whole = F.sum("failed").over(W.partitionBy("book_id")) == 0
    rows = audio.withColumn("whole", whole).join(titles, ["book_id", "section_no"])
    sound = F.when(F.col("whole"), F.col("audio"))
    return rows.select("book_id", "section_no", "title", sound.alias("audio"), T.fallback_duration_ms(F.octet_length(sound)).alias("ms"), "failed", F.when(F.col("whole"), "done").otherwise("failed").alias("status"))


def batch_status(narrated: DataFrame) -> DataFrame:
    """``book_id, status, chapters, failed_chunks, ms`` from :func:`narrate`."""
    return narrated.groupBy("book_id").agg(F.first("status").alias("status"), F.count("*").alias("chapters"), F.sum("failed").alias("failed_chunks"), F.sum("ms").alias("ms"))


def batch_outcome(status: DataFrame) -> DataFrame:
    """``done, failed``: books of :func:`batch_status`."""
    done, failed = chapters.outcome(F.col("status") == "done")
    return status.agg(done.alias("done"), failed.alias("failed"))


def package(narrated: DataFrame, fmt: str = "m4b", author: str = "Unknown", encoders: dict[str, Callable[[list[bytes], str], bytes]] | None = None) -> DataFrame:
    """``book_id, file_name, file, metadata`` of the books that are done: chapters in order with chapter marks, by the encoder
    of ``fmt``: one of ``encoders``, else of ``sinks.PACKAGERS``."""
    done = narrated.where("status = 'done'").withColumn("chapter_no", F.row_number().over(W.partitionBy("book_id").orderBy("section_no")))
    marks = chapters.chapter_marks(done)
    books = done.select("book_id").distinct().select("book_id", T.clean_stem(F.col("book_id")).alias("title"), F.lit(author).alias("author"))
    return sinks.packaged(done, chapters.metadata_text(marks, books), fmt, encoders)

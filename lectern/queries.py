"""The registered queries of the document operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import literals
from .functions import audio
from .functions import text as T
from .operators import chapters, chunks, denoise, layout, library, paragraphs, sections
from .sources import documents, sinks, spans
from .sources.tables import chaptered, document_layout, document_lines, document_paragraphs, document_sections, outline_of, paragraphs_of, read


def longs(df: DataFrame) -> DataFrame:
    """Integers of every width as long, so that results have one type whatever made them."""
    return df.select(*(F.col(c).cast("long").alias(c) if kind in ("int", "smallint", "tinyint") else F.col(c) for c, kind in df.dtypes))


def _paras(spark: SparkSession) -> DataFrame:
    rows = literals.frame(spark, "paras").withColumn("is_break", F.col("text") == "***")
    return rows.withColumn("text", F.when(~F.col("is_break"), F.col("text")))


def _digest(sections_: DataFrame) -> DataFrame:
    return sections_.select("book_id", "section_no", "title", "para_no", "text", "is_break")


def kept_lines(spark: SparkSession, d: str) -> DataFrame:
    return longs(denoise.removed_counts(document_lines(spark, d)))


def header_pages(spark: SparkSession, d: str) -> DataFrame:
    return longs(denoise.header_pages(document_lines(spark, d)).groupBy("book_id").agg(F.count("*").alias("key_pages"), F.countDistinct("header_key").alias("keys")))


def repeated_keys(spark: SparkSession, d: str) -> DataFrame:
    return longs(denoise.repeated_keys(document_lines(spark, d)))


def page_numbers(spark: SparkSession, d: str) -> DataFrame:
    lines = document_lines(spark, d)
    return lines.groupBy("book_id").agg(F.count_if(T.is_page_number(F.col("text"))).alias("page_numbers"), F.count_if(denoise.in_band()).alias("in_band"), F.count_if(T.is_ornament(F.col("text"))).alias("ornaments"))


def body_size(spark: SparkSession, d: str) -> DataFrame:
    return denoise.body_size(document_lines(spark, d))


def footnotes(spark: SparkSession, d: str) -> DataFrame:
    return denoise.mark_footnotes(document_lines(spark, d), small=1.0).groupBy("book_id").agg(F.count_if("is_footnote").alias("footnotes"), F.count("*").alias("lines"))


def typical_leading(spark: SparkSession, d: str) -> DataFrame:
    return layout.typical_leading(document_lines(spark, d))


def column_edges(spark: SparkSession, d: str) -> DataFrame:
    edges = layout.column_edges(document_lines(spark, d))
    return longs(edges.select("book_id", "page", "span", F.col("lefts")[0].alias("left_1"), F.get("lefts", F.lit(1)).alias("left_2")))


def annotated_columns(spark: SparkSession, d: str) -> DataFrame:
    lines = layout.annotate_columns(document_lines(spark, d))
    return longs(lines.groupBy("book_id", "page", "left").agg(F.max("right").alias("right"), F.count("*").alias("lines")))


def indent_style(spark: SparkSession, d: str) -> DataFrame:
    lines = document_lines(spark, d)
    return longs(layout.indent_style(layout.annotate_columns(lines), layout.typical_leading(lines)))


def paragraph_starts(spark: SparkSession, d: str) -> DataFrame:
    numbered = paragraphs.number_paragraphs(document_lines(spark, d))
    return longs(numbered.groupBy("book_id", "page").agg(F.min("para_no").alias("first_para"), F.max("para_no").alias("last_para")))


def built_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    built = paragraphs.build_paragraphs(document_lines(spark, d))
    return longs(built.select("book_id", "para_no", "page", F.length("text").alias("chars"), F.md5("text").alias("md5")))


def tidy_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    rows = literals.frame(spark, "texts").select(F.col("n").alias("para_no"), F.concat(F.lit("book"), F.col("n").cast("string")).alias("book_id"), F.lit(0).alias("page"), F.col("t").alias("text"))
    return longs(paragraphs.tidy_paragraphs(rows))


def drop_caps(spark: SparkSession, d: str) -> DataFrame:
    return longs(paragraphs.merge_drop_caps(literals.frame(spark, "drop_caps").withColumn("is_break", F.lit(False))))


def document_words(spark: SparkSession, d: str) -> DataFrame:
    return longs(read(spark, d, "documents").select("doc_id", T.word_count(F.col("text")).alias("words"), F.length(T.norm(F.col("text"))).alias("norm_chars"), T.ends_sentence(F.col("text")).alias("ends_sentence")))


def text_functions(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    return longs(literals.frame(spark, "texts").select(
        "n", T.header_key(t).alias("header_key"), T.norm(t).alias("norm"), T.is_page_number(t).alias("is_page_number"), T.ends_sentence(t).alias("ends_sentence"), T.is_ornament(t).alias("is_ornament"),
        T.is_dot_leader(t).alias("is_dot_leader"), T.word_count(t).alias("words"), T.tidy(t, urls=True).alias("tidied"), T.escape_metadata(t).alias("metadata"), T.escape_xml(t).alias("xml"), T.shorten(t, 12, 9).alias("short")))


def stem_functions(spark: SparkSession, d: str) -> DataFrame:
    s = F.col("stem")
    return longs(literals.frame(spark, "stems").select("n", T.clean_stem(s).alias("clean"), T.display_title(T.clean_stem(s)).alias("title")))


def headings(spark: SparkSession, d: str) -> DataFrame:
    found = sections.heading_candidates(_paras(spark))
    return longs(found.select("book_id", "para_no", "candidate", "consumed", "heading", "words"))


def outline_starts(spark: SparkSession, d: str) -> DataFrame:
    return longs(sections.outline_starts(literals.frame(spark, "toc"), 0, 3))


def outline_sections(spark: SparkSession, d: str) -> DataFrame:
    return longs(_digest(sections.sections_from_outline(_paras(spark), literals.frame(spark, "toc"), 0, 3)))


def heading_sections(spark: SparkSession, d: str) -> DataFrame:
    return longs(_digest(sections.sections_from_headings(_paras(spark), 5)))


def fixed_sections(spark: SparkSession, d: str) -> DataFrame:
    found = sections.sections_of_size(document_paragraphs(spark, d), 6000)
    return longs(found.groupBy("book_id", "section_no", "title").agg(F.min("para_no").alias("first_para"), F.count("*").alias("paras")))


def chosen_sections(spark: SparkSession, d: str) -> DataFrame:
    found = sections.choose_sections(_paras(spark), literals.frame(spark, "toc"), 5, 9)
    return longs(found.groupBy("book_id", "chapter_source").agg(F.countDistinct("section_no").alias("sections"), F.count("*").alias("paras")))


def finalized_sections(spark: SparkSession, d: str) -> DataFrame:
    found = sections.sections_from_headings(_paras(spark), 5)
    return longs(_digest(sections.finalize(found, 9, skip_front=True)))


def narration_chunks(spark: SparkSession, d: str) -> DataFrame:
    found = chunks.chunk_sections(document_sections(spark, d))
    return longs(found.groupBy("book_id", "section_no").agg(F.count("*").alias("chunks"), F.max(F.length("text")).alias("longest"), F.sum(F.length("text")).alias("chars")))


def conversation_bins(spark: SparkSession, d: str) -> DataFrame:
    rows = read(spark, d, "conversations").select("conv_id", "turn", T.word_count(F.coalesce("text", F.lit(""))).alias("w"))
    ordered = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "w"))).alias("turns"))
    bins = ordered.select("conv_id", chunks.budget_bins(F.col("turns.w"), 200).alias("bins"))
    return longs(bins.select("conv_id", F.size("bins").alias("turns"), F.array_max("bins").alias("bins"), F.aggregate("bins", F.lit(0), lambda a, b: a + b).alias("sum")))


def section_totals(spark: SparkSession, d: str) -> DataFrame:
    totals = chapters.book_totals(chapters.section_words(document_sections(spark, d)))
    return longs(totals.select("book_id", "sections", "total_words", F.round("hours", 6).alias("hours"), F.round("eta_minutes", 6).alias("eta_minutes")))


def section_preview(spark: SparkSession, d: str) -> DataFrame:
    return longs(chapters.preview(chapters.section_words(document_sections(spark, d))))


def latest_sections(spark: SparkSession, d: str) -> DataFrame:
    return longs(chapters.latest(chapters.section_words(document_sections(spark, d))))


def _durations(spark: SparkSession, d: str) -> DataFrame:
    """Chapters as long as reading their words aloud takes; a stand-in for audio."""
    words = chapters.section_words(document_sections(spark, d))
    return words.select("book_id", F.col("section_no").alias("chapter_no"), "title", (F.col("words") * 400).alias("ms"))


def chapter_marks(spark: SparkSession, d: str) -> DataFrame:
    return longs(chapters.chapter_marks(_durations(spark, d)))


def chapter_metadata(spark: SparkSession, d: str) -> DataFrame:
    rows = _durations(spark, d)
    books = rows.select("book_id").distinct().select("book_id", F.concat(F.lit("Book; "), "book_id").alias("title"), F.lit("Unknown").alias("author"))
    return chapters.metadata_text(chapters.chapter_marks(rows), books).select("book_id", F.length("metadata").cast("long").alias("chars"), F.md5("metadata").alias("md5"))


def literal_metadata(spark: SparkSession, d: str) -> DataFrame:
    rows = literals.frame(spark, "chapters")
    books = rows.select("book_id").distinct().select("book_id", F.concat("book_id", F.lit("=1")).alias("title"), F.lit("x#y").alias("author"))
    return chapters.metadata_text(chapters.chapter_marks(rows), books)


def total_lengths(spark: SparkSession, d: str) -> DataFrame:
    return longs(chapters.total_length(literals.frame(spark, "chapters")))


def length_labels(spark: SparkSession, d: str) -> DataFrame:
    return longs(literals.frame(spark, "chapters").select("book_id", "chapter_no", T.duration_label(F.col("ms")).alias("label"), T.size_label(F.col("ms") * 1000).alias("size"), T.fallback_duration_ms(F.col("ms")).alias("fallback_ms")))


def concat_lists(spark: SparkSession, d: str) -> DataFrame:
    rows = literals.frame(spark, "chapters").withColumn("path", F.format_string("/tmp/chapter_%03d.mp3", "chapter_no"))
    return chapters.concat_list(rows)


def plain_texts(spark: SparkSession, d: str) -> DataFrame:
    return sinks.plain_text(document_sections(spark, d)).select("book_id", F.length("text").cast("long").alias("chars"), F.md5("text").alias("md5"))


def chapter_markup(spark: SparkSession, d: str) -> DataFrame:
    return longs(sinks.chapter_markup(document_sections(spark, d)).select("book_id", "section_no", F.length("markup").alias("chars"), F.md5("markup").alias("md5")))


def _library(spark: SparkSession) -> DataFrame:
    return library.with_audio(library.books_of(literals.frame(spark, "files")), literals.frame(spark, "audio"))


def library_listing(spark: SparkSession, d: str) -> DataFrame:
    return longs(library.numbered(_library(spark)).select("number", "name", "is_epub", "size_mb", "clean_stem", "title", "ready_file"))


def pending_books(spark: SparkSession, d: str) -> DataFrame:
    return library.pending(_library(spark)).select("name", "title")


def library_counts(spark: SparkSession, d: str) -> DataFrame:
    return library.library_counts(_library(spark))


def library_search(spark: SparkSession, d: str) -> DataFrame:
    return library.search(_library(spark), "ROAD").select("name", "title")


def voice_models(spark: SparkSession, d: str) -> DataFrame:
    return library.models(spark)


def resolved_voices(spark: SparkSession, d: str) -> DataFrame:
    return longs(library.resolve_voices(literals.frame(spark, "requests")).select("n", "voice_id"))


def checked_requests(spark: SparkSession, d: str) -> DataFrame:
    return longs(library.check_requests(literals.frame(spark, "requests")).select("n", "status", "reason", "voice_id"))


def request_payloads(spark: SparkSession, d: str) -> DataFrame:
    rows = literals.frame(spark, "requests")
    return longs(rows.select("n", T.speech_url(F.lit("http://127.0.0.1:8001/v1/")).alias("url"), T.mime_type(F.col("response_format")).alias("mime"), T.clamp_speed(F.col("speed")).alias("speed"), T.is_local_endpoint(F.lit("http://127.0.0.1:8001/v1")).alias("local")))


def html_paragraphs(spark: SparkSession, d: str) -> DataFrame:
    found = documents.html_paragraphs(read(spark, d, "pages"))
    return found.groupBy("book_id").agg(F.count("*").alias("paras"), F.sum(F.length("text")).alias("chars"), F.count_if("is_break").alias("breaks"))


def epub_round_trip(spark: SparkSession, d: str) -> DataFrame:
    found = document_sections(spark, d)
    books = found.select("book_id").distinct().select("book_id", F.col("book_id").alias("title"), F.lit("Unknown").alias("author"))
    files = sinks.epubs(found, books).select(F.concat("book_id", F.lit(".epub")).alias("path"), F.col("epub").alias("content"))
    back = documents.decode_books(files)
    return longs(back.select("book_id", "title", "author", "pages", "error", F.size("texts").alias("paras"), F.size("toc").alias("entries")))


def wav_lengths(spark: SparkSession, d: str) -> DataFrame:
    """A sample a millisecond, so that lengths of an hour stay small."""
    tone = F.transform(F.sequence(F.lit(1), F.col("ms").cast("int")), lambda i: (i % 3 - 1).cast("float"))
    rows = literals.frame(spark, "chapters").select("book_id", "chapter_no", audio.encoded(tone, rate=1000).alias("wav"))
    return longs(rows.select("book_id", "chapter_no", F.octet_length("wav").alias("bytes"), audio.wav_duration_ms(F.col("wav")).alias("ms")))


def document_headings(spark: SparkSession, d: str) -> DataFrame:
    found = sections.heading_candidates(paragraphs_of(chaptered(spark, d)))
    return found.groupBy("book_id").agg(F.count_if("candidate").alias("candidates"), F.count_if("consumed").alias("consumed"), F.sum("words").alias("words"), F.md5(F.array_join(F.array_sort(F.collect_list("heading")), "|")).alias("headings"))


def _spans_of(found: DataFrame) -> DataFrame:
    return longs(found.groupBy("book_id", "section_no", "title").agg(F.min("para_no").alias("first_para"), F.count("*").alias("paras"), F.sum(F.length("text")).alias("chars")))


def document_heading_sections(spark: SparkSession, d: str) -> DataFrame:
    return _spans_of(sections.sections_from_headings(paragraphs_of(chaptered(spark, d)), 80))


def document_outline_sections(spark: SparkSession, d: str) -> DataFrame:
    docs = chaptered(spark, d)
    return _spans_of(sections.sections_from_outline(paragraphs_of(docs), outline_of(docs)))


def document_chosen_sections(spark: SparkSession, d: str) -> DataFrame:
    docs = read(spark, d, "documents")
    found = sections.choose_sections(paragraphs_of(docs), outline_of(docs), 80, 6000)
    return longs(found.groupBy("book_id", "chapter_source").agg(F.countDistinct("section_no").alias("sections"), F.count("*").alias("paras")))


def document_finalized(spark: SparkSession, d: str) -> DataFrame:
    return _spans_of(sections.finalize(sections.sections_from_headings(paragraphs_of(chaptered(spark, d)), 80), 400))


def document_tidied(spark: SparkSession, d: str) -> DataFrame:
    found = paragraphs.tidy_paragraphs(document_paragraphs(spark, d).select("book_id", "para_no", "page", "text"))
    return longs(found.groupBy("book_id").agg(F.count("*").alias("paras"), F.count_if("is_break").alias("breaks"), F.sum(F.length("text")).alias("chars")))


def layout_lines(spark: SparkSession, d: str) -> DataFrame:
    found = spans.lines_from_layout(document_layout(spark, d))
    return longs(found.groupBy("book_id", "page").agg(F.count("*").alias("lines"), F.sum(F.length("text")).alias("chars"), F.max("size").alias("size"), F.max("base").alias("base")))


def low_text_warnings(spark: SparkSession, d: str) -> DataFrame:
    totals = chapters.book_totals(chapters.section_words(document_sections(spark, d)))
    books = totals.select("book_id", F.lit(False).alias("is_epub"), (F.col("sections") * 6).alias("pages"), F.when(F.col("sections") % 2 == 0, "fixed").otherwise("outline").alias("chapter_source"))
    return longs(chapters.warnings(totals, books).select("book_id", "total_words", "pages", "low_text", "no_chapters"))


def batch_outcomes(spark: SparkSession, d: str) -> DataFrame:
    totals = chapters.book_totals(chapters.section_words(document_sections(spark, d)))
    done, failed = chapters.outcome(F.col("total_words") % 2 == 0)
    return totals.agg(done.alias("done"), failed.alias("failed"))


def tool_reports(spark: SparkSession, d: str) -> DataFrame:
    status = F.when(F.col("n") % 3 == 0, "ok").when(F.col("n") % 3 == 1, "warn").otherwise("fail")
    return chapters.tool_report(literals.frame(spark, "requests").select(F.col("voice").alias("name"), status.alias("status")))


def answer_functions(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("t")
    book, voice = T.split_target(t)
    answer, tail = T.clean_answer(F.concat(F.lit(" '"), t, F.lit("' "))), T.soft_hyphen_tail(F.concat(t, F.lit("­ ")))
    clean, title = T.clean_chars(F.concat(t, F.lit("x²​  y"))), T.fallback_title(t, F.lit("my_book's end"))
    return longs(literals.frame(spark, "texts").select("n", answer.alias("answer"), book.alias("book"), voice.alias("voice"), tail.alias("tail"), clean.alias("clean"), title.alias("title")))


def pcm_samples(spark: SparkSession, d: str) -> DataFrame:
    return longs(literals.frame(spark, "requests").select("n", T.pcm16(F.col("speed") / 3 - 0.5).alias("sample")))


QUERIES = {f.__name__: f for f in (
    kept_lines, header_pages, repeated_keys, page_numbers, body_size, footnotes, typical_leading, column_edges, annotated_columns, indent_style, paragraph_starts, built_paragraphs, tidy_paragraphs, drop_caps,
    document_words, text_functions, stem_functions, headings, outline_starts, outline_sections, heading_sections, fixed_sections, chosen_sections, finalized_sections, narration_chunks, conversation_bins,
    section_totals, section_preview, latest_sections, chapter_marks, chapter_metadata, literal_metadata, total_lengths, length_labels, concat_lists, plain_texts, chapter_markup, library_listing, pending_books,
    library_counts, library_search, voice_models, resolved_voices, checked_requests, request_payloads, html_paragraphs, epub_round_trip, wav_lengths, pcm_samples,
    document_headings, document_heading_sections, document_outline_sections, document_chosen_sections, document_finalized, document_tidied, layout_lines, low_text_warnings, batch_outcomes, tool_reports, answer_functions,
)}

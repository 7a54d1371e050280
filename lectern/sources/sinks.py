"""What is written: EPUB bytes, plain text, chapter audio."""

from __future__ import annotations

import base64
import io
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import audio
from ..functions import text as T


def _ordered(sections: DataFrame, body: Column) -> DataFrame:
    """``book_id, section_no, title, parts``: a section's paragraphs in order, each as ``body`` puts it."""
    return sections.groupBy("book_id", "section_no", "title").agg(F.transform(F.array_sort(F.collect_list(F.struct("para_no", body.alias("x")))), lambda s: s["x"]).alias("parts"))


def chapter_markup(sections: DataFrame) -> DataFrame:
    """``book_id, section_no, title, markup``: a heading, a ``p`` for each paragraph, an ``hr`` for each break."""
    para = F.when(F.col("is_break"), "<hr/>").otherwise(F.concat(F.lit("<p>"), T.escape_xml(F.col("text")), F.lit("</p>")))
    head = F.concat(F.lit("<h1>"), T.escape_xml(F.col("title")), F.lit("</h1>"))
    return _ordered(sections, para).select("book_id", "section_no", "title", F.array_join(F.concat(F.array(head), "parts"), "\n").alias("markup"))


def epub_bytes(title: str, author: str, lang: str, chapters: list[tuple[str, str]]) -> bytes:
    """An EPUB of (title, markup) chapters, with navigation for old and new readers, itself not in the spine."""
    out = io.BytesIO()
    esc = lambda s: s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")
    names = [f"chapter_{i:03d}.xhtml" for i in range(1, len(chapters) + 1)]
    ident = f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_OID, title + author)}"
    page = lambda head, body: f'<?xml version="1.0" encoding="utf-8"?>\n<html xmlns="http://www.w3.org/1999/xhtml" xmlns:epub="http://www.idpf.org/2007/ops" lang="{lang}"><head><title>{esc(head)}</title></head><body>{body}</body></html>'
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        def put(name: str, text: str, how=zipfile.ZIP_DEFLATED) -> None:
            z.writestr(zipfile.ZipInfo(name, (1980, 1, 1, 0, 0, 0)), text, how)

        put("mimetype", "application/epub+zip", zipfile.ZIP_STORED)
        put("META-INF/container.xml", '<?xml version="1.0"?><container version="1.0" xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="EPUB/content.opf" media-type="application/oebps-package+xml"/></rootfiles></container>')
        for name, (head, markup) in zip(names, chapters):
            put(f"EPUB/{name}", page(head, markup))
        links = "".join(f'<li><a href="{n}">{esc(t)}</a></li>' for n, (t, _) in zip(names, chapters))
        put("EPUB/nav.xhtml", page(title, f'<nav epub:type="toc"><ol>{links}</ol></nav>'))
        points = "".join(f'<navPoint id="n{i}" playOrder="{i}"><navLabel><text>{esc(t)}</text></navLabel><content src="{n}"/></navPoint>' for i, (n, (t, _)) in enumerate(zip(names, chapters), 1))
        put("EPUB/toc.ncx", f'<?xml version="1.0" encoding="utf-8"?><ncx xmlns="http://www.daisy.org/z3986/2005/ncx/" version="2005-1"><head><meta name="dtb:uid" content="{ident}"/></head><docTitle><text>{esc(title)}</text></docTitle><navMap>{points}</navMap></ncx>')
        items = "".join(f'<item id="c{i}" href="{n}" media-type="application/xhtml+xml"/>' for i, n in enumerate(names, 1))
        spine = "".join(f'<itemref idref="c{i}"/>' for i in range(1, len(names) + 1))
        put("EPUB/content.opf", f'<?xml version="1.0" encoding="utf-8"?><package xmlns="http://www.idpf.org/2007/opf" unique-identifier="id" version="3.0"><metadata xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:identifier id="id">{ident}</dc:identifier><dc:title>{esc(title)}</dc:title><dc:creator>{esc(author)}</dc:creator><dc:language>{lang}</dc:language></metadata><manifest>{items}<item id="nav" href="nav.xhtml" properties="nav" media-type="application/xhtml+xml"/><item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/></manifest><spine toc="ncx">{spine}</spine></package>')
    return out.getvalue()


def epubs(sections: DataFrame, books: DataFrame, lang: str = "en") -> DataFrame:
    """``book_id, epub`` bytes of ``sections`` and ``books(book_id, title, author)``. A book is held by one task."""
    chapters = chapter_markup(sections).groupBy("book_id").agg(F.array_sort(F.collect_list(F.struct("section_no", "title", "markup"))).alias("chapters"))
    rows = books.select("book_id", F.col("title").alias("t"), F.col("author").alias("a")).join(chapters, "book_id")

    @F.arrow_udf("binary")
    def pack(batches: Iterator[tuple[pa.Array, pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for titles, authors, whole in batches:
            yield pa.array([epub_bytes(t.as_py() or "", a.as_py() or "Unknown", lang, [(c["title"], c["markup"]) for c in w.as_py()]) for t, a, w in zip(titles, authors, whole)], pa.binary())

    return rows.select("book_id", pack("t", "a", "chapters").alias("epub"))


def plain_text(sections: DataFrame) -> DataFrame:
    """``book_id, text``: titles and paragraphs with blank lines between, ``* * *`` for breaks, one more line after a section."""
    para = F.concat(F.when(F.col("is_break"), "* * *").otherwise(F.col("text")), F.lit("\n\n"))
    parts = _ordered(sections, para).withColumn("section", F.concat("title", F.lit("\n\n"), F.array_join("parts", ""), F.lit("\n")))
    return parts.groupBy("book_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("section_no", "section"))), lambda s: s["section"]), "").alias("text"))


def write_text(sections: DataFrame, path: str) -> None:
    plain_text(sections).select("text").write.text(path)


def chapter_audio(chunks: DataFrame) -> DataFrame:
    """``book_id, section_no, audio, failed``: chunks' audio in order; null, with the number of failed chunks, if any failed."""
    whole = chunks.groupBy("book_id", "section_no").agg(F.array_sort(F.collect_list(F.struct("chunk_no", "audio"))).alias("parts"), F.count_if(F.col("audio").isNull()).alias("failed"))
    return whole.select("book_id", "section_no", F.when(F.col("failed") == 0, audio.joined(F.col("parts.audio"))).alias("audio"), "failed")


#: Encoders of whole books by format: they get the chapters' audio in order and the metadata text, and give a file's bytes.
PACKAGERS: dict[str, Callable[[list[bytes], str], bytes]] = {}


def packaged(chapters: DataFrame, metadata: DataFrame, fmt: str, encoders: dict[str, Callable[[list[bytes], str], bytes]] | None = None) -> DataFrame:
    """``book_id, file_name, file, metadata`` of ``chapters(book_id, chapter_no, audio)`` and ``metadata(book_id, metadata)``.
    A book is held by one task."""
    encode = (encoders or {}).get(fmt) or PACKAGERS.get(fmt)
    if encode is None:
        raise ValueError(f"no encoder for {fmt}; put one into PACKAGERS")

    @F.arrow_udf("binary")
    def pack(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for sound, texts in batches:
            yield pa.array([encode(parts.as_py(), text.as_py()) for parts, text in zip(sound, texts)], pa.binary())

    whole = chapters.groupBy("book_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("chapter_no", "audio"))), lambda c: c["audio"]).alias("parts"))
    name = F.concat(T.clean_stem(F.col("book_id")), F.lit(f".{fmt}"))
    return whole.join(metadata, "book_id").select("book_id", name.alias("file_name"), pack("parts", "metadata").alias("file"), "metadata")


def write_files(files: DataFrame, folder: str, name_col: str, data_col: str) -> int:
    """Write each row's bytes to a file of ``folder``, in any store that Spark can write to; the number of files.

    Bytes come through the driver, a file at a time, and a file has its name only when it is whole. For a few books; more
    are better written as a table.
    """
    spark = files.sparkSession
    part = files.select(F.col(name_col).alias("name"), F.base64(F.col(data_col)).alias("data"))
    jvm = spark.sparkContext._jvm
    root = jvm.org.apache.hadoop.fs.Path(folder)
    store = root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    store.mkdirs(root)
    n = 0
    for row in part.toLocalIterator():  # a file at a time, as executors have no handle on the store
        out = store.create(jvm.org.apache.hadoop.fs.Path(root, f".{row['name']}.part"), True)
        out.write(bytearray(base64.b64decode(row["data"])))
        out.close()
        store.delete(jvm.org.apache.hadoop.fs.Path(root, row["name"]), False)
        store.rename(jvm.org.apache.hadoop.fs.Path(root, f".{row['name']}.part"), jvm.org.apache.hadoop.fs.Path(root, row["name"]))
        n += 1
    return n

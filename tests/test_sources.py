from pyspark.sql import functions as F

from lectern.sources import documents, sinks, spans
from lectern.streaming import ingest

SECTION = "book_id string, section_no int, title string, para_no int, text string, is_break boolean"
ROWS = [("A", 1, "One & two", 0, "x < y", False), ("A", 1, "One & two", 1, None, True), ("A", 2, "Three", 0, "last.", False)]


def _epub(spark):
    df = spark.createDataFrame(ROWS, SECTION)
    books = spark.createDataFrame([("A", "Title", "Somebody")], "book_id string, title string, author string")
    return sinks.epubs(df, books)


def test_epub_round_trip(spark):
    files = _epub(spark).select(F.lit("/x/A.epub").alias("path"), F.col("epub").alias("content"))
    assert files.select(F.octet_length("content")).first()[0] > 500
    book = documents.decode_books(files)
    row = book.first()
    assert (row.title, row.author, row.pages, row.error) == ("Title", "Somebody", 2, None)
    got = [(r.page, r.text, r.is_break) for r in documents.book_paragraphs(book).orderBy("para_no").collect()]
    assert got == [(0, "One & two", False), (0, "x < y", False), (0, None, True), (1, "Three", False), (1, "last.", False)]
    assert [(r.title, r.page) for r in documents.book_outline(book).orderBy("toc_no").collect()] == [("One & two", 1), ("Three", 2)]


def test_broken_files_stop_nothing(spark):
    df = spark.createDataFrame([("a.epub", b"junk"), ("b.pdf", b"%PDF"), ("c.epub", None)], "path string, content binary")
    assert all(r.error for r in documents.decode_books(df).collect())


def test_markup_and_text(spark):
    df = spark.createDataFrame(ROWS, SECTION)
    marks = {r.section_no: r.markup for r in sinks.chapter_markup(df).collect()}
    assert marks[1] == "<h1>One &amp; two</h1>\n<p>x &lt; y</p>\n<hr/>"
    assert sinks.plain_text(df).first().text == "One & two\n\nx < y\n\n* * *\n\n\nThree\n\nlast.\n\n\n"


def test_html():
    got = documents.html_blocks("<head><title>t</title></head><nav><p>no</p></nav><p>a <b>b</b>&amp;c<br>d</p><hr><div>e<script>x</script></div>f")
    assert got == [("p", "a b&c d"), ("break", ""), ("div", "e"), ("p", "f")]


def test_html_references_need_their_semicolon():
    assert documents.html_blocks("<p>a &amp;&amp</p><p>b &ampc; &copy 1 &#65 &lt;&#65;&#x42;</p>&") == [("p", "a &&amp"), ("p", "b &ampc; &copy 1 &#65 <AB"), ("p", "&")]


def test_a_note_number_is_no_text_of_a_short_line(spark):
    span = lambda text, size, flags, y: {"text": text, "size": size, "flags": flags, "origin": [0.0, y]}
    line = lambda *own: {"dir": [1.0, 0.0], "bbox": [0.0, 0.0, 9.0, 9.0], "spans": list(own)}
    lines = [line(span("A", 12.0, 0, 24.0), span("12", 7.0, 1, 20.0)), line(span("12", 7.0, 1, 40.0))]
    pages = spark.createDataFrame([("b", 0, 100.0, [{"type": 0, "lines": lines}])], spans.LAYOUT_SCHEMA)
    assert [(r.text, r.size, r.base) for r in spans.lines_from_layout(pages).orderBy("line_no").collect()] == [("A", 12.0, 24.0), ("12", 7.0, 40.0)]


def test_spans(spark):
    def span(text, size=12.0, flags=0, y=100.0):
        return (text, size, flags, [0.0, y])

    ok, bbox = [1.0, 0.0], [72.0, 90.0, 500.0, 104.0]
    blocks = [(0, [(ok, bbox, [span("T", 30.0), span(" "), span("he cat sat"), span("3", 7.0, 0, 90.0), span("*", 12.0, 1)]), ([0.0, 1.0], bbox, [span("rotated")]), (ok, bbox, [span("  ")]), (ok, bbox, [span("exam­")])]), (1, [(ok, bbox, [span("image")])])]
    df = spark.createDataFrame([("A", 0, 792.0, blocks)], spans.LAYOUT_SCHEMA)
    got = [(r.text, r.size, r.base) for r in spans.lines_from_layout(df).orderBy("line_no").collect()]
    assert got == [("The cat sat", 12.0, 100.0), ("exam-", 12.0, 100.0)]


def test_chapter_audio(spark):
    df = spark.createDataFrame([("A", 1, 1, b"b"), ("A", 1, 0, b"a"), ("A", 2, 0, None)], "book_id string, section_no int, chunk_no int, audio binary")
    got = {r.section_no: (r.audio and bytes(r.audio), r.failed) for r in sinks.chapter_audio(df).collect()}
    assert got == {1: (b"ab", 0), 2: (None, 1)}


def test_ingest_takes_each_file_once(spark, tmp_path):
    books, out, check = (str(tmp_path / d) for d in ("books", "out", "check"))
    (tmp_path / "books").mkdir()
    data = bytes(_epub(spark).first().epub)
    for name in ("a", "b"):
        (tmp_path / "books" / f"{name}.epub").write_bytes(data)
        ingest.ingest_new_books(spark, books, out, check).awaitTermination()
    rows = spark.read.parquet(out).groupBy("book_id").count().collect()
    assert {(r.book_id, r["count"]) for r in rows} == {("a.epub", 5), ("b.epub", 5)}


def test_an_outline_from_navigation_alone():
    import io
    import zipfile

    made = sinks.epub_bytes("T", "A", "en", [("One", "<h1>One</h1><p>a</p>"), ("Two", "<h1>Two</h1><p>b</p>")])
    out = io.BytesIO()
    with zipfile.ZipFile(io.BytesIO(made)) as old, zipfile.ZipFile(out, "w") as new:
        for name in old.namelist():
            text = old.read(name)
            if name.endswith("content.opf"):
                text = text.replace(b'<item id="ncx" href="toc.ncx" media-type="application/x-dtbncx+xml"/>', b"")
            if name.endswith("nav.xhtml"):
                text = text.replace(b"Two</a></li>", b"Two</a><ol><li><a href=\"chapter_002.xhtml#x\">Two,  a</a></li></ol></li>")
            if not name.endswith("toc.ncx"):
                new.writestr(name, text)
    toc = documents.read_epub(out.getvalue())["toc"]
    assert [(t["level"], t["title"], t["page"]) for t in toc] == [(1, "One", 1), (1, "Two", 2), (2, "Two, a", 2)]


def test_layout_readers(spark):
    def block(y, x, text):
        return {"type": 0, "lines": [{"dir": [1.0, 0.0], "bbox": [x, y, x + 100.0, y + 12.0], "spans": [{"text": text, "size": 12.0, "flags": 0, "origin": [x, y + 10.0]}]}]}

    def read(data):
        if not data:
            raise ValueError("locked")
        return [{"page": 0, "ph": 800.0, "blocks": [block(90.0, 72.0, "below"), block(40.0, 300.0, "right"), block(40.0, 72.0, data.decode())]}]

    files = spark.createDataFrame([("/b/A.pdf", bytearray(b"left")), ("/b/B.PDF", bytearray(b"")), ("/b/C.txt", bytearray(b"x"))], "path string, content binary")
    for sort, want in ((False, ["below", "right", "left"]), (True, ["left", "right", "below"])):
        pages, errors = documents.decode_layouts(files, {".pdf": read}, sort)
        assert [r.text for r in spans.lines_from_layout(pages).orderBy("line_no").collect()] == want
    assert {(r.book_id, r.error) for r in errors.collect()} == {("B.PDF", "ValueError: locked"), ("C.txt", "no reader for this format")}


def test_packaged_books_and_files(spark, tmp_path):
    rows = spark.createDataFrame([("My_Book", 2, bytearray(b"bb")), ("My_Book", 1, bytearray(b"a"))], "book_id string, chapter_no int, audio binary")
    meta = spark.createDataFrame([("My_Book", ";FFMETADATA1")], "book_id string, metadata string")
    found = sinks.packaged(rows, meta, "m4b", {"m4b": lambda parts, text: b"|".join(parts) + text.encode()})
    row = found.first()
    assert (row.file_name, bytes(row.file)) == ("My_Book.m4b", b"a|bb;FFMETADATA1")
    assert sinks.write_files(found, f"file://{tmp_path}/out", "file_name", "file") == 1 and (tmp_path / "out" / "My_Book.m4b").read_bytes() == bytes(row.file)
    assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.startswith(".")] == ["My_Book.m4b"]
    import pytest

    with pytest.raises(ValueError, match="no encoder"):
        sinks.packaged(rows, meta, "mp3")


def test_settings(spark):
    from lectern.config import settings

    assert settings(spark).service == "http://127.0.0.1:8001/v1" and settings(spark).max_input_chars == 20_000
    spark.conf.set("spark.lectern.port", "9000")
    try:
        assert settings(spark).service == "http://127.0.0.1:9000/v1"
    finally:
        spark.conf.unset("spark.lectern.port")

import pytest
from pyspark.sql import functions as F

from lectern.operators import chapters, chunks, denoise, layout, library, paragraphs, sections
from lectern.plans import book
from lectern.sources.tables import LINE_SCHEMA, PARA_SCHEMA, TOC_SCHEMA


def lines(spark, rows):
    """rows: (book, page, line_no, text) and maybe changes of the geometry."""
    out = []
    for b, page, n, text, *more in rows:
        g = dict(x0=72.0, y0=100.0 + 14 * n, x1=500.0, y1=112.0 + 14 * n, size=12.0, base=110.0 + 14 * n, block=0, ph=792.0) | (more[0] if more else {})
        out.append((b, page, n, text, *g.values()))
    return spark.createDataFrame(out, LINE_SCHEMA)


def test_header_repeats(spark):
    top = dict(y0=10.0, y1=20.0)
    rows = [("A", p, 0, "Header 1", top) for p in (0, 2, 4)] + [("A", p, 1, "Rare", top) for p in (0, 10, 20)] + [("A", p, 2, "Twice", top) for p in (0, 1)] + [("A", 0, 3, "12", top), ("A", 0, 4, "12"), ("A", 0, 5, "Header 1")]
    df = lines(spark, rows)
    assert [r.header_key for r in denoise.repeated_keys(df).collect()] == ["header #"]
    assert sorted(r.text for r in denoise.strip_running_text(df).collect()) == sorted(["Rare"] * 3 + ["Twice"] * 2 + ["12", "Header 1"])
    assert denoise.removed_counts(df).first().removed == 4


def test_footnotes_and_body_size(spark):
    df = lines(spark, [("A", 0, 0, "long body line of text"), ("A", 0, 1, "small", dict(size=8.0, y0=700.0)), ("A", 0, 2, "small", dict(size=8.0, y0=100.0))])
    assert denoise.body_size(df).first().body == 12.0 and denoise.drop_footnotes(df).count() == 2
    tie = lines(spark, [("A", 0, 1, "abcd", dict(size=9.0)), ("A", 0, 0, "abcd")])
    assert denoise.body_size(tie).first().body == 12.0


def test_layout(spark):
    body = "a line of more than twenty-five characters"
    df = lines(spark, [("A", 0, i, body, dict(x1=float(i + 1))) for i in range(4)])
    marked = layout.annotate_columns(df).collect()
    assert {(r.left, r.right) for r in marked} == {(72.0, 3.0)}
    two = lines(spark, [("A", 0, i, body) for i in range(4)] + [("A", 0, 4 + i, body, dict(x0=301.0, x1=520.0)) for i in range(3)])
    assert layout.column_edges(two).first().lefts == [72.0, 300.0]
    assert layout.typical_leading(two).first().leading == 14.0 and layout.typical_leading(lines(spark, [("B", 0, 0, "x")])).first().leading == 14.0


def test_paragraphs(spark):
    long = "a line of more than twenty-five characters"
    rows = [("A", 0, 0, long), ("A", 0, 1, "that ends here.", dict(x1=200.0)), ("A", 0, 2, "Another one begins " + long), ("A", 0, 3, "and is hyphen-"), ("A", 0, 4, "ated over lines"), ("A", 0, 5, "* * *"), ("A", 0, 6, "After, it goes"), ("A", 1, 0, "on over a page " + long), ("A", 1, 1, "• a bullet")]
    got = [(r.page, r.text) for r in paragraphs.build_paragraphs(lines(spark, rows)).orderBy("para_no").collect()]
    assert got == [(0, long + " that ends here."), (0, "Another one begins " + long + " and is hyphenated over lines"), (0, "* * *"), (0, "After, it goes on over a page " + long), (1, "• a bullet")]
    tidied = paragraphs.tidy_paragraphs(paragraphs.build_paragraphs(lines(spark, rows))).orderBy("para_no").collect()
    assert [r.text for r in tidied][2:] == [None, "After, it goes on over a page " + long, "a bullet"] and tidied[2].is_break


def test_drop_caps_pair_from_the_left(spark):
    df = spark.createDataFrame([("A", i, i, t, False) for i, t in enumerate(["T", "he cat", "a", "b", "c", "dog", "X", "Yes"])], PARA_SCHEMA)
    got = [(r.page, r.text) for r in paragraphs.merge_drop_caps(df).orderBy("para_no").collect()]
    assert got == [(0, "The cat"), (2, "ab"), (4, "cdog"), (6, "X"), (7, "Yes")]


def paras(spark, texts, book_id="A"):
    return spark.createDataFrame([(book_id, i, page, None if t == "***" else t, t == "***") for i, (page, t) in enumerate(texts)], PARA_SCHEMA)


def test_outline_level(spark):
    toc = spark.createDataFrame([("A", i, 1, f"t{i}", i + 1) for i in range(2)] + [("A", 9 + i, 2, f"u{i}", i + 1) for i in range(5)], TOC_SCHEMA)
    assert {r.title for r in sections.outline_starts(toc).collect()} == {f"u{i}" for i in range(5)}
    few = spark.createDataFrame([("A", 0, 1, "only", 1)], TOC_SCHEMA)
    assert sections.outline_starts(few).count() == 0


def test_heading_sections_keep_rejected_headings(spark):
    df = paras(spark, [(0, "Chapter 1"), (0, "Start"), (0, "one two three four"), (0, "Chapter 2"), (0, "x."), (0, "Chapter 3"), (0, "***"), (1, "five six seven eight")])
    got = [(r.section_no, r.title, r.text) for r in sections.sections_from_headings(df, 4).orderBy("para_no").collect()]
    assert got == [(1, "Chapter 1: Start", "one two three four"), (1, "Chapter 1: Start", "Chapter 2"), (1, "Chapter 1: Start", "x."), (2, "Chapter 3", None), (2, "Chapter 3", "five six seven eight")]


def test_title_echo(spark):
    rows = [("A", 1, "The Start", i, t, False) for i, t in enumerate(["1", "THE START!", "a b", "start", "body.", "start"])]
    df = spark.createDataFrame(rows, "book_id string, section_no int, title string, para_no int, text string, is_break boolean")
    # "1" goes; the second ends a sentence; "a b" is no echo, "start" is one; then three have stayed
    assert [r.text for r in sections.drop_title_echo(df).orderBy("para_no").collect()] == ["THE START!", "a b", "body.", "start"]


@pytest.mark.parametrize("counts, limit, want", [([2, 1, 3], 3, [1, 1, 2]), ([9, 1, 9], 3, [1, 2, 3]), ([0, 0], 1, [1, 1]), ([5], 1, [1])])
def test_word_budget(spark, counts, limit, want):
    df = spark.createDataFrame([("A", i, w) for i, w in enumerate(counts)], "book_id string, para_no int, words long")
    assert [r.bin for r in chunks.word_budget(df, limit).orderBy("para_no").collect()] == want
    arrays = spark.createDataFrame([(counts,)], "w array<long>")
    assert arrays.select(chunks.budget_bins(F.col("w"), limit)).first()[0] == want


def test_narration_chunks():
    assert chunks.narration_chunks(["aa, bb cc dd ee ff gg hh, zz"], 10) == ["aa,", "bb cc dd", "ee ff gg", "hh, zz"]
    parts = chunks.narration_chunks(["This is a sentence. " * 100])
    assert len(parts) > 1 and all(0 < len(p) <= 350 for p in parts)
    assert chunks.narration_chunks(["a.", None, "b."]) == ["a.", "b."] and chunks.narration_chunks(["a.", "b."]) == ["a. b."]
    text = ["word " * 50 + "verylong" * 60 + ", and; so - on: " * 30, None, "End?  Yes!"]
    assert " ".join(chunks.narration_chunks(text, 40)).split() == " ".join(t for t in text if t).split()


def test_chapter_marks(spark):
    df = spark.createDataFrame([("A", 1, "x", 1000), ("A", 2, "y", 2500)], "book_id string, chapter_no int, title string, ms long")
    assert [(r.start_ms, r.end_ms) for r in chapters.chapter_marks(df).orderBy("chapter_no").collect()] == [(0, 1000), (1000, 3500)]


def test_library(spark, tmp_path):
    names = {"books": ["Alpha.pdf", "Beta.epub", "notes.txt", ".hidden.pdf", "One [draft].epub"], "audio": ["Beta.m4b"]}
    for folder, files in names.items():
        (tmp_path / folder).mkdir()
        for f in files:
            (tmp_path / folder / f).write_bytes(b"x")
    got = library.numbered(library.scan(spark, str(tmp_path / "books"), str(tmp_path / "audio"))).orderBy("number").collect()
    assert [(r.name, r.ready_file) for r in got if not r.name.startswith("One")] == [("Alpha.pdf", None), ("Beta.epub", "Beta.m4b")] and len(got) == 3
    assert library.scan(spark, str(tmp_path / "missing")).count() == 0


def test_voices(spark):
    df = spark.createDataFrame([("bella",), (" GEORGE ",), ("af_heart",), ("am_echo",), (" who ",)], "voice string")
    assert [r.voice_id for r in library.resolve_voices(df).collect()] == ["af_bella", "bm_george", "af_heart", "am_echo", "who"]
    assert library.models(spark).count() == 28 and library.voice_keys(spark).count() == 54


def test_retries():
    pauses, calls = [], []

    def broken(x):
        calls.append(x)
        raise OSError

    assert book.with_retries(broken, 1, pause=pauses.append) is None and pauses == [1.0, 2.0, 3.0, 4.0] and len(calls) == 5


def test_whole_plan(spark):
    long = "a line of more than twenty-five characters which goes on."
    rows = []
    for p in range(3):
        rows += [("A", p, 0, "My Header", dict(y0=40.0, y1=50.0)), ("A", p, 1, f"Chapter {p + 1}", dict(size=20.0))]
        rows += [("A", p, 2 + i, long) for i in range(10)] + [("A", p, 20, str(p), dict(y0=780.0, y1=790.0))]
    plan = book.plan_books(lines(spark, rows), spark.createDataFrame([], TOC_SCHEMA), min_words=20)
    texts = " ".join(r.text for r in plan["chunks"].collect())
    assert "My Header" not in texts and "twenty-five" in texts
    assert plan["sections"].select("chapter_source", "title").distinct().count() == 3
    for name in ("paragraphs", "chunks", "totals", "warnings"):
        steps = plan[name]._jdf.queryExecution().sparkPlan().toString()
        assert steps.count("Scan") < 30, name
    assert [(r.pages, r.low_text, r.no_chapters) for r in plan["warnings"].collect()] == [(3, False, False)]


def _chunks(spark):
    rows = [(b, s, f"Part {s}", c, f"{b} says {s} {c}") for b in ("A", "B") for s in (1, 2) for c in range(3)]
    return spark.createDataFrame(rows, "book_id string, section_no int, title string, chunk_no int, text string")


def test_narration_speaks_each_chunk_once(spark, tmp_path):
    log = tmp_path / "calls"

    def speak(text, voice, speed):
        with open(log, "a") as f:
            f.write(text + "\n")
        if text == "B says 2 1":
            raise OSError("no voice")
        return text.encode()

    monkey = book.with_retries
    book.with_retries = lambda call, *args: monkey(call, *args, attempts=1)
    try:
        got = book.narrate({"chunks": _chunks(spark)}, speak).collect()
    finally:
        book.with_retries = monkey
    calls = log.read_text().split("\n")[:-1]
    assert len(set(calls)) == 12 and all(calls.count(c) == 1 for c in set(calls) - {"B says 2 1"})
    assert {(r.book_id, r.section_no, r.status, r.failed, r.audio is None) for r in got} == {("A", 1, "done", 0, False), ("A", 2, "done", 0, False), ("B", 1, "failed", 0, True), ("B", 2, "failed", 1, True)}
    whole = next(r for r in got if (r.book_id, r.section_no) == ("A", 2))
    assert bytes(whole.audio) == b"A says 2 0A says 2 1A says 2 2" and whole.ms == int(len(whole.audio) / 8000 * 1000)


def test_status_outcome_and_package(spark):
    narrated = spark.createDataFrame([("A", 1, "One", bytearray(b"x" * 8000), 1000, 0, "done"), ("A", 3, "Three", bytearray(b"y" * 8000), 1000, 0, "done"), ("B", 1, "One", None, None, 2, "failed")], "book_id string, section_no int, title string, audio binary, ms long, failed long, status string")
    status = book.batch_status(narrated)
    assert {(r.book_id, r.status, r.chapters, r.failed_chunks, r.ms) for r in status.collect()} == {("A", "done", 2, 0, 2000), ("B", "failed", 1, 2, None)}
    assert tuple(book.batch_outcome(status).first()) == (1, 1)
    made = book.package(narrated, "mp3", encoders={"mp3": lambda parts, text: b"".join(parts)}).collect()
    assert [(r.book_id, r.file_name, len(r.file)) for r in made] == [("A", "A.mp3", 16000)] and "START=1000\nEND=2000\ntitle=Three" in made[0].metadata


def test_http_synthesiser(spark):
    import http.server
    import json
    import threading

    asked = []

    class Service(http.server.BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            asked.append((self.path, body["model"], body["input"], body["voice"], body["response_format"], body["speed"]))
            self.send_response(200)
            self.end_headers()
            self.wfile.write(b"sound")

        def log_message(self, *args):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Service)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    try:
        speak = book.http_synthesiser(f"http://127.0.0.1:{server.server_port}/v1/")
        got = book.synthesise(_chunks(spark).limit(1), speak, "af_bella", 1.5).collect()
    finally:
        server.shutdown()
    assert bytes(got[0].audio) == b"sound" and asked == [("/v1/audio/speech", "speaches-ai/Kokoro-82M-v1.0-ONNX", got[0].text, "af_bella", "mp3", 1.5)]


def own_chunks(paras, limit):
    """Narration chunks by the rules, each step on its own: sentences, clauses of long ones, words of long clauses."""
    import re

    def fill(parts):
        out = [""]
        for p in parts:
            if len(out[-1]) + len(p) + 1 <= limit:
                out[-1] = (out[-1] + " " + p).strip()
            else:
                out.append(p)
        return [x for x in out if x]

    def pieces(sentence):
        if len(sentence) <= limit:
            return [sentence]
        groups = [[]]
        for clause in re.split(r"(?<=[,;:–—])\s+", sentence):
            if len(clause) <= limit:
                groups[-1].append(clause)
            else:
                groups += [clause.split(), []]
        return [x for g in groups for x in fill(g)]

    return fill(p for para in paras for s in re.split(r"(?<=[.?!])\s+", para) if s.strip() for p in pieces(s.strip()))


def test_narration_chunks_of_the_table(spark, sf_dir):
    """The registered query against the rules, on every document of the smallest tables."""
    from lectern.queries import QUERIES

    texts = {}
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy("source", "doc_id").collect():
        texts.setdefault(r.source, []).append([x for x in (r.text or "").split("\n") if x.strip(" ")])
    want = {(b, i + 1): own_chunks(paras, 350) for b, docs in texts.items() for i, paras in enumerate(docs)}
    got = {(r.book_id, r.section_no): (r.chunks, r.longest, r.chars) for r in QUERIES["narration_chunks"](spark, sf_dir).collect()}
    assert got == {k: (len(v), max(map(len, v)), sum(map(len, v))) for k, v in want.items() if v}

"""Small literal tables for what no supplied table holds, rendered for Spark and for other SQL engines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

HEX32 = "a" * 32
TEXTS = [
    "Page 12", "page 7 ", "- 12 -", "xiv", "12 of 300", "civil", "[ 3 ]", "Page 12345", "He said so.", "He said “so.”", "and then,", "* * *", "~", "CHAPTER One: The Start", "Chapter 2",
    "1. First point", "• dot", "Preface", "Author's note", "Contents .... 12", "Contents . . . . 3", "See [12, 3-5] and [7].", "space , before ; marks", "http://a.b/c?d=e x", "", "   ",
    "Copyright page", "About the authors", "twenty-one", "A", "b", "It's DON'T", "a=b;c#d\\e", "x & y <z>",
]
STEMS = [f"My Book -- {HEX32} -- Some Site", "a/b:c*d", "///", "the_long-road home", "Vol. 1.2"]
FILES = [("Alpha.pdf", 3145728), ("Beta.epub", 1048576), ("notes.txt", 10), (".hidden.pdf", 99), ("gamma_rays-of light.EPUB", 5242880), ("Short.pdf", 1000), ("The Long Road.epub", 777)]
AUDIO = [("Beta.m4b", 1), ("Beta.mp3", 1), ("gamma_rays-of light and dark.m4a", 1), ("Short2.mp3", 1), ("Long Road.mp3", 1), ("The Long Road.mp3", 1), ("e Long Road.m4b", 1)]
REQUESTS = [
    (1, "Hello", "bella", 1.0, "mp3"), (2, "Hello", " GEORGE ", 4.0, "wav"), (3, "Hello", "nobody", 1.0, "mp3"), (4, "   ", "af_heart", 1.0, "mp3"), (5, "Hello", "af_heart", 9.0, "mp3"),
    (6, "Hello", "am_echo", 0.25, "ogg"), (7, "Hello", "santa", 1.5, "pcm"),
]
#: book, number, page, text ("***" is a break)
PARAS = [
    ("A", 1, 0, "By somebody"), ("A", 2, 0, "Chapter 1"), ("A", 3, 0, "The Start"), ("A", 4, 0, "one two three four five six."), ("A", 5, 1, "***"), ("A", 6, 1, "seven eight nine ten."),
    ("A", 7, 1, "Chapter 2: Next"), ("A", 8, 1, "short."), ("A", 9, 2, "Chapter 3: Last"), ("A", 10, 2, "a b c d e f g h i j."), ("A", 11, 3, "Epilogue"), ("A", 12, 3, "k l m n o p q r s."),
    ("B", 1, 0, "no headings here."), ("B", 2, 1, "none at all."), ("C", 1, 0, "Part I"), ("C", 2, 0, "PART II"), ("C", 3, 1, "one two three four five six seven eight nine."),
    ("D", 1, 0, "Preface"), ("D", 2, 0, "words that go on and on and on, and on."), ("D", 3, 1, "Chapter twenty-one"), ("D", 4, 1, "It ends here."), ("D", 5, 2, "more words that go on and on and on here."),
]
TOC = [
    ("A", 1, 1, "One", 1), ("A", 2, 1, "Two", 3), ("A", 3, 2, "a", 1), ("A", 4, 2, "b", 1), ("A", 5, 2, " The  Start ", 2), ("A", 6, 2, "c", 3), ("A", 7, 2, "Epilogue", 4), ("A", 8, 2, "gone", 99),
    ("B", 1, 1, "Only", 2), ("D", 1, 1, "Preface", 1), ("D", 2, 1, "Chapter twenty-one", 2), ("D", 3, 1, "  ", 2),
]
DROP_CAPS = [("A", 1, 0, "T"), ("A", 2, 0, "he cat"), ("A", 3, 0, "a"), ("A", 4, 1, "b"), ("A", 5, 1, "c"), ("A", 6, 1, "dog"), ("A", 7, 2, "X"), ("A", 8, 2, "Yes"), ("B", 1, 0, "z")]
CHAPTERS = [("A", 1, "One = 1", 1000), ("A", 2, "Two; #2", 2500), ("A", 3, "Three\nmore", 3600000), ("B", 1, "Only", 59999)]
TABLES = {
    "texts": ("n, t", [(i, t) for i, t in enumerate(TEXTS)]), "stems": ("n, stem", [(i, s) for i, s in enumerate(STEMS)]), "files": ("name, bytes", FILES), "audio": ("name, bytes", AUDIO),
    "requests": ("n, input, voice, speed, response_format", REQUESTS), "paras": ("book_id, para_no, page, text", PARAS), "toc": ("book_id, toc_no, level, title, page", TOC),
    "drop_caps": ("book_id, para_no, page, text", DROP_CAPS), "chapters": ("book_id, chapter_no, title, ms", CHAPTERS),
}
SCHEMAS = {
    "texts": "n int, t string", "stems": "n int, stem string", "files": "name string, bytes long", "audio": "name string, bytes long", "requests": "n int, input string, voice string, speed double, response_format string",
    "paras": "book_id string, para_no int, page int, text string", "toc": "book_id string, toc_no int, level int, title string, page int", "drop_caps": "book_id string, para_no int, page int, text string",
    "chapters": "book_id string, chapter_no int, title string, ms long",
}


def frame(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame(TABLES[name][1], SCHEMAS[name])


def sql(name: str) -> str:
    """``name(columns) AS (VALUES ...)``, for a WITH clause."""
    columns, rows = TABLES[name]

    def value(x) -> str:
        if isinstance(x, str):
            return " || chr(10) || ".join("'" + part.replace("'", "''") + "'" for part in x.split("\n"))
        return f"CAST({x} AS DOUBLE)" if isinstance(x, float) else str(x)

    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(value, r)) + ")" for r in rows) + ")"

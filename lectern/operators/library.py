"""The library: books, their audio, voices, requests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T

#: Voices by code, and which of them the client's catalogue describes.
VOICES = {
    "American Female": "af_heart af_bella af_sky af_nicole af_sarah af_alloy af_aoede af_jessica af_river af_kore",
    "American Male": "am_adam am_michael am_echo am_eric am_fenrir am_liam am_onyx am_puck am_santa",
    "British Female": "bf_emma bf_alice bf_isabella bf_lily",
    "British Male": "bm_george bm_daniel bm_fable bm_lewis",
}
CATALOGUE = "af_heart af_bella af_sky af_sarah af_nicole am_adam am_michael am_onyx bf_emma bm_george"
DEFAULT_VOICE = "af_heart"
AUDIO_EXTENSIONS = ("m4b", "m4u", "m4a", "mp3")
FORMATS = ("mp3", "opus", "aac", "flac", "wav", "pcm")
MAX_INPUT = 20000
# End of fixed values.

BOOK_NAME = r"(?i)^[^.].*\.(pdf|epub)$"


def voices(spark: SparkSession) -> DataFrame:
    """``code, alias, category, in_catalogue``: one row for each voice."""
    listed = CATALOGUE.split()
    rows = [(code, code.split("_")[1], category, code in listed) for category, codes in VOICES.items() for code in codes.split()]
    return spark.createDataFrame(rows, "code string, alias string, category string, in_catalogue boolean")


def voice_keys(spark: SparkSession) -> DataFrame:
    """``key, code``: every code and alias."""
    known = voices(spark)
    return known.select(F.col("code").alias("key"), "code").union(known.select(F.col("alias").alias("key"), "code"))


def resolve_voices(requests: DataFrame, column: str = "voice") -> DataFrame:
    """``requests`` with ``voice_id``: the code of a voice by code or alias, any case; what is unknown stays, stripped.

    The table of voices has 54 rows.
    """
    keys = voice_keys(requests.sparkSession)
    both = requests.join(F.broadcast(keys), F.lower(T.strip(F.col(column))) == F.col("key"), "left")
    return both.select(*requests.columns, F.coalesce("code", T.strip(F.col(column))).alias("voice_id"))


def models(spark: SparkSession) -> DataFrame:
    """What the speech service lists: itself and its voices."""
    ids = spark.createDataFrame([("kokoro",)], "id string").union(voices(spark).select("code"))
    return ids.select("id", F.lit("model").alias("object"), F.lit(1_700_000_000).cast("long").alias("created"), F.lit("kokoro-metal").alias("owned_by"))


def check_requests(requests: DataFrame, max_input: int = MAX_INPUT) -> DataFrame:
    """``requests(input, voice, speed, response_format)`` with ``status`` and ``reason``: 422 for what the schema refuses, 400
    for an unknown voice or blank text, 200 else."""
    keys = voice_keys(requests.sparkSession).withColumnRenamed("code", "__code")
    both = requests.join(F.broadcast(keys), F.lower(T.strip(F.col("voice"))) == F.col("key"), "left")
    speed_ok = F.coalesce(F.col("speed").between(0.25, 4.0) & ~F.isnan("speed"), F.lit(False))
    reason = (
        F.when(F.col("input").isNull() | (F.length("input") > max_input), "input").when(~speed_ok, "speed")
        .when(~F.coalesce(F.col("response_format").isin(*FORMATS), F.lit(False)), "response_format").when(F.col("__code").isNull(), "unknown voice").when(T.strip(F.col("input")) == "", "empty text")
    )
    status = F.when(reason.isNull(), 200).when(reason.isin("unknown voice", "empty text"), 400).otherwise(422)
    return both.select(*requests.columns, status.alias("status"), reason.alias("reason"), F.when(reason.isNull(), F.col("__code")).alias("voice_id"))


def file_stem(name: Column) -> Column:
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def books_of(files: DataFrame) -> DataFrame:
    """``name, is_epub, size_mb, clean_stem, title`` of the books among ``files(name, bytes)``: PDF and EPUB, not hidden."""
    stem = T.clean_stem(file_stem(F.col("name")))
    return files.where(F.col("name").rlike(BOOK_NAME)).select(
        "name", F.lower("name").endswith(".epub").alias("is_epub"), T.megabytes(F.col("bytes")).alias("size_mb"), stem.alias("clean_stem"), T.display_title(stem).alias("title"))


def _grams(text: Column, n: int) -> Column:
    """Every substring of ``n`` characters; none for a shorter text."""
    return F.when(F.length(text) >= n, F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def audio_matches(books: DataFrame, audio: DataFrame) -> DataFrame:
    """``name, audio_name, extension, exact``: audio files that may be a book's.

    A file counts if its stem is the book's, or, being longer than six characters, contains it or is contained. Containment
    is found by equality: the first seven characters of what is contained are a seven-character part of what contains it; a
    book's stem of fewer characters is itself such a part, of its own length.
    """
    sound = audio.select(F.col("name").alias("audio_name"), file_stem(F.col("name")).alias("audio_stem"), F.regexp_extract("name", r"\.([^.]+)$", 1).alias("extension")).where(F.col("extension").isin(*AUDIO_EXTENSIONS))
    stems = books.select("name", "clean_stem")
    exact = stems.join(sound, F.col("clean_stem") == F.col("audio_stem"))
    long = sound.where(F.length("audio_stem") > 6)
    a = stems.select("*", F.explode(F.array_distinct(_grams(F.col("clean_stem"), 7))).alias("gram")).join(long.withColumn("gram", F.substring("audio_stem", 1, 7)), "gram").where(F.col("clean_stem").contains(F.col("audio_stem")))
    b_key = F.substring("clean_stem", 1, 7)
    parts = F.flatten(F.array(*(_grams(F.col("audio_stem"), n) for n in range(1, 8))))
    b = stems.withColumn("gram", b_key).join(long.select("*", F.explode(F.array_distinct(parts)).alias("gram")), "gram").where(F.col("audio_stem").contains(F.col("clean_stem")))
    columns = ["name", "audio_name", "extension", F.col("clean_stem").eqNullSafe(F.col("audio_stem")).alias("exact")]
    return exact.select(*columns).union(a.select(*columns)).union(b.select(*columns)).distinct()


def with_audio(books: DataFrame, audio: DataFrame) -> DataFrame:
    """``books`` with ``ready_file``: of a book's audio files the one whose extension comes first, then the exact one, then
    the first by name; null if there is none."""
    rank = F.array_position(F.array(*map(F.lit, AUDIO_EXTENSIONS)), F.col("extension"))
    best = audio_matches(books, audio).groupBy("name").agg(F.min_by("audio_name", F.struct(rank, ~F.col("exact"), "audio_name")).alias("ready_file"))
    return books.join(best, "name", "left")


def pending(library: DataFrame) -> DataFrame:
    return library.where("ready_file is null")


def numbered(library: DataFrame) -> DataFrame:
    """In order of lower-case names, numbered from 1. A listing: it is sorted whole."""
    return library.withColumn("number", F.row_number().over(W.orderBy(F.lower("name"), "name")))


def search(library: DataFrame, wanted: str) -> DataFrame:
    """Books whose title or name contains ``wanted``, any case."""
    low = F.lower(F.lit(wanted))
    return library.where(F.lower("title").contains(low) | F.lower("name").contains(low))


def library_counts(library: DataFrame) -> DataFrame:
    return library.agg(F.count("*").alias("found"), F.count("ready_file").alias("converted"), F.count_if(F.col("ready_file").isNull()).alias("pending"))


def scan(spark: SparkSession, books_dir: str, audio_dir: str | None = None) -> DataFrame:
    """The library in two folders of any store; a folder that isn't there is empty. File contents aren't read."""
    def listing(path: str | None) -> DataFrame:
        jvm = spark.sparkContext._jvm
        if path:
            p = jvm.org.apache.hadoop.fs.Path(path)
            if p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p):
                files = spark.read.format("binaryFile").load(path).select("path", "length")
                return files.select(F.regexp_extract(F.try_url_decode(F.regexp_replace("path", r"\+", "%2B")), r"([^/]+)$", 1).alias("name"), F.col("length").alias("bytes"))
        return spark.createDataFrame([], "name string, bytes long")

    return with_audio(books_of(listing(books_dir)), listing(audio_dir))

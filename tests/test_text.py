import unicodedata

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lectern.functions import audio
from lectern.functions import text as T


def one(spark, fn, *values):
    df = spark.createDataFrame([values], ", ".join(f"c{i} {'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'string'}" for i, v in enumerate(values)))
    return df.select(fn(*(F.col(c) for c in df.columns))).first()[0]


@pytest.mark.parametrize("fn, value, want", [
    (T.clean_stem, "My Book -- " + "a" * 32 + " -- Some Site", "My Book"), (T.clean_stem, "a/b:c*d", "abcd"), (T.clean_stem, "///", "///"),
    (T.header_key, "Page 12", "page #"), (T.header_key, "page 7 ", "page #"),
    (T.is_page_number, "- 12 -", True), (T.is_page_number, "xiv", True), (T.is_page_number, "12 of 300", True), (T.is_page_number, "civil", True), (T.is_page_number, "chapter", False),
    (T.clean_chars, "a\nb", "ab"), (T.clean_chars, "ﬁx", "fix"), (T.clean_chars, "x²", "x"), (T.clean_chars, "a­b​c  d\te", "abc d e"), (T.clean_chars, "m² (², )³", "m (2, )"),
    (T.soft_hyphen_tail, "exam­", "exam-"), (T.escape_metadata, "Title\n[CHAPTER]\nSTART=0", "Title [CHAPTER] START\\=0"), (T.escape_metadata, "a=b;c#d\\e", "a\\=b\\;c\\#d\\\\e"),
    (T.title_case, "don't stop_now", "Don'T Stop_Now"), (T.display_title, "a_b-c ", "a b c"), (T.speech_url, "http://h/v1/", "http://h/v1/audio/speech"), (T.speech_url, "http://h", "http://h/v1/audio/speech"),
    (T.speech_url, "http://h/x/audio/speech/", "http://h/x/audio/speech"), (T.is_local_endpoint, "http://127.0.0.1:8001/v1", True), (T.is_local_endpoint, "http://gpu-box.example:8001/v1", False), (T.is_local_endpoint, "http://[::1]:8001/v1", True),
    (T.mime_type, "opus", "audio/ogg"), (T.mime_type, "x", "audio/mpeg"), (T.clean_answer, " '/a\\ b' ", "/a b"), (T.ends_sentence, "He said “so.”)  ", True), (T.ends_sentence, "", False), (T.starts_lower, "ªx", True),
    (T.word_count, " a b  c ", 3), (T.duration_label, 60000, "1.0 min"), (T.duration_label, 2500, "2 sec"), (T.fallback_duration_ms, 8001, 1000), (T.clamp_speed, 99.0, 4.0), (T.clamp_speed, 0.01, 0.25),
    (T.clamp_speed, float("nan"), None), (T.clamp_speed, float("inf"), None), (T.pcm16, -2.0, -32767), (T.pcm16, 0.5, 16383),
])
def test_scalar(spark, fn, value, want):
    assert one(spark, fn, value) == want


@pytest.mark.parametrize("parts, want", [(["exam-", "ple"], "example"), (["Anglo-", "Saxon"], "Anglo-Saxon"), (["T", "he cat"], "The cat"), (["a", "B"], "a B"), (["-", "x"], "- x"), ([], ""), (["one", "two", "three"], "one two three")])
def test_join_lines(spark, parts, want):
    df = spark.createDataFrame([(parts,)], "p array<string>")
    assert df.select(T.join_lines(F.col("p"))).first()[0] == want


def test_continues_flow(spark):
    assert one(spark, T.continues_flow, "goes on,", "And so") and one(spark, T.continues_flow, "goes on", "and so") and not one(spark, T.continues_flow, "It ends.", "and so")
    assert not one(spark, T.continues_flow, "goes on", "And so")


def test_split_target(spark):
    df = spark.createDataFrame([("book:bella:x",), ("book",)], "t string")
    assert [tuple(r) for r in df.select(*T.split_target(F.col("t"))).collect()] == [("book", "bella:x"), ("book", None)]


def test_nulls(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert list(df.select(T.clean_chars(F.col("t")), T.word_count(F.col("t")), T.norm(F.col("t"))).first())[0] is None


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=30), min_size=1, max_size=40))
def test_nfkc_and_words_as_python(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "n int, t string")
    got = df.select("n", T.nfkc(F.col("t")).alias("k")).orderBy("n").collect()
    assert [r.k for r in got] == [unicodedata.normalize("NFKC", t) for t in texts]


def test_audio(spark):
    import numpy as np

    data = audio.wav_bytes(np.array([0, 1, -1, 2], np.float32))
    assert data[:4] == b"RIFF" and data[-8:] == np.array([0, 32767, -32767, 32767], "<i2").tobytes()
    with pytest.raises(ValueError):
        audio.encode(np.zeros(1), "aac")
    df = spark.createDataFrame([([b"a", None, b"bc"],)], "p array<binary>")
    assert bytes(df.select(audio.joined(F.col("p"))).first()[0]) == b"abc"

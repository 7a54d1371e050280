"""Text functions: each takes and returns columns. Null in, null out, unless said otherwise."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P

SPACES = r"(?U)\s+"


def strip(t: Column) -> Column:
    """Without white space (of Unicode) at both ends."""
    return F.regexp_replace(t, r"(?U)^\s+|\s+$", "")


def rstrip(t: Column) -> Column:
    return F.regexp_replace(t, r"(?U)\s+$", "")


def collapse(t: Column) -> Column:
    """Runs of white space are one space; none at the ends."""
    return F.btrim(F.regexp_replace(t, SPACES, " "))


def header_key(t: Column) -> Column:
    """What repeats of a running header have in common: lower case, each number one ``#``."""
    return strip(F.regexp_replace(F.lower(t), r"(?U)\d+", "#"))


def norm(t: Column) -> Column:
    """Lower-case words, single spaces between them."""
    return F.btrim(F.regexp_replace(F.lower(t), r"(?U)\W+", " "))


def is_page_number(t: Column) -> Column:
    return F.btrim(t, F.lit(P.PAGE_NUMBER_TRIM)).rlike(P.PAGE_NUMBER)


def ends_sentence(t: Column) -> Column:
    bare = F.rtrim(rstrip(t), F.lit(P.CLOSERS))
    return (F.length(bare) > 0) & F.substring(bare, -1, 1).isin(*P.SENTENCE_ENDS)


def starts_lower(t: Column) -> Column:
    return t.rlike(r"^\p{IsLowercase}")


def continues_flow(before: Column, after: Column) -> Column:
    """Whether ``after``, at the top of a page or column, carries on the sentence of ``before``."""
    return ~ends_sentence(before) & (starts_lower(after) | F.substring(rstrip(before), -1, 1).isin(*P.FLOW_ENDS))


def has_alnum(t: Column) -> Column:
    return t.rlike("[A-Za-z0-9]")


def is_ornament(t: Column) -> Column:
    """A short line without letter or digit, such as ``* * *``."""
    return (F.length(t) <= 15) & ~has_alnum(t)


def is_dot_leader(t: Column) -> Column:
    return t.rlike(P.DOT_LEADER)


def nfkc(t: Column) -> Column:
    """Unicode compatibility composition: the one text function that Spark has no built-in for."""

    @F.arrow_udf("string")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([None if (s := x.as_py()) is None else s if s.isascii() else unicodedata.normalize("NFKC", s) for x in batch], pa.string())

    return of(t)


def clean_chars(t: Column) -> Column:
    """Superscript notes go; NFKC; invisible and control characters go, line feeds too, but no tab; spaces collapse."""
    composed = nfkc(F.regexp_replace(t, P.SUPERSCRIPT, ""))
    return collapse(F.regexp_replace(F.regexp_replace(composed, P.INVISIBLE, ""), r"[\p{C}&&[^\t]]", ""))


def soft_hyphen_tail(t: Column) -> Column:
    return F.regexp_replace(rstrip(t), r"\x{00AD}$", "-")


def words(t: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(t, SPACES), lambda w: w != "")


def word_count(t: Column) -> Column:
    return F.size(words(t)).cast("long")


def join_lines(parts: Column) -> Column:
    """One paragraph of an array of lines. A lone capital is glued to what follows in lower case; a hyphen at a line's end
    goes before a lower-case letter and stays, without a space, before any other; otherwise a space."""

    def add(so_far: Column, line: Column) -> Column:
        hyphen = so_far.rlike(r"\p{L}-$")
        return (
            F.when(so_far == "", line)
            .when(so_far.rlike(r"^\p{L}$") & starts_lower(line), F.concat(so_far, line))
            .when(hyphen & starts_lower(line), F.concat(F.regexp_replace(so_far, "-$", ""), line))
            .when(hyphen, F.concat(so_far, line))
            .otherwise(F.concat_ws(" ", so_far, line))
        )

    return F.aggregate(parts, F.lit(""), add)


def tidy(t: Column, urls: bool = False, citations: bool = True) -> Column:
    """Without a leading bullet, URLs and ``[12, 3-5]`` if asked, or space before punctuation."""
    t = F.regexp_replace(t, P.LEADING_BULLET, "")
    if urls:
        t = F.regexp_replace(t, P.URL, "")
    if citations:
        t = F.regexp_replace(t, P.CITATION, "")
    t = F.regexp_replace(t, r"(?U)\s+([,.;:!?])", "$1")
    return strip(F.regexp_replace(t, r"(?U)\s{2,}", " "))


def clean_stem(stem: Column) -> Column:
    """A file name's stem without a download suffix and without characters that file systems dislike."""
    cut = F.regexp_replace(stem, P.BOOK_ID_SUFFIX, "")
    safe = strip(F.regexp_replace(cut, "(?U)[^\\w\\s\\-_.,()'\"]", ""))
    return F.coalesce(F.nullif(safe, F.lit("")), cut)


def display_title(stem: Column) -> Column:
    return strip(F.translate(stem, "_-", "  "))


def title_case(t: Column) -> Column:
    """The first of each run of letters in upper case, the others in lower case: ``don't`` gives ``Don'T``."""
    runs = F.regexp_extract_all(t, F.lit(r"(\p{L}+|[^\p{L}]+)"))
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)), F.lower(F.substring(r, 2, 1 << 30)))), "")


def fallback_title(title: Column, stem: Column) -> Column:
    """Stripped title; else one made of the stem. Never null for a stem."""
    return F.coalesce(F.nullif(strip(title), F.lit("")), title_case(F.replace(stem, F.lit("_"), F.lit(" "))))


def fallback_author(author: Column) -> Column:
    return F.coalesce(F.nullif(strip(author), F.lit("")), F.lit("Unknown"))


def escape_metadata(t: Column) -> Column:
    """For an FFMETADATA file: line ends are spaces; ``= ; # \\`` bear a backslash."""
    one_line = F.regexp_replace(F.regexp_replace(t, r"(\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}])$", ""), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]", " ")
    return F.regexp_replace(one_line, r"([=;#\\])", r"\\$1")


def escape_xml(t: Column) -> Column:
    t = F.replace(t, F.lit("&"), F.lit("&amp;"))
    return F.replace(F.replace(t, F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def shorten(t: Column, longest: int, kept: int) -> Column:
    return F.when(F.length(t) > longest, F.concat(F.substring(t, 1, kept), F.lit("..."))).otherwise(t)


def part_title(title: Column, n: Column) -> Column:
    return F.concat(title, F.lit(" (part "), n.cast("string"), F.lit(")"))


def heading_title(heading: Column, subtitle: Column) -> Column:
    return F.concat_ws(": ", heading, subtitle)


def duration_label(ms: Column) -> Column:
    return F.when(ms >= 60000, F.format_string("%.1f min", ms / 1000 / 60)).otherwise(F.format_string("%.0f sec", F.bround(ms / 1000, 0)))


def size_label(n_bytes: Column) -> Column:
    return F.format_string("%.1f MB", n_bytes / (1024 * 1024))


def split_target(t: Column) -> tuple[Column, Column]:
    """``book:voice`` at its first colon; the voice is null without one."""
    parts = F.split(t, ":", 2)
    return parts[0], F.get(parts, F.lit(1))


def clean_answer(t: Column) -> Column:
    """A path as typed: without quotes around it, escaped spaces plain."""
    return F.replace(F.btrim(strip(t), F.lit("'\"")), F.lit("\\ "), F.lit(" "))


def mime_type(fmt: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in {"mp3": "audio/mpeg", "wav": "audio/wav", "pcm": "audio/pcm", "opus": "audio/ogg", "flac": "audio/flac", "aac": "audio/aac"}.items() for x in pair))
    return F.coalesce(F.try_element_at(table, fmt), F.lit("audio/mpeg"))


# Fixed values of the speech service's interface: headers, names that stand for the model, the end of its path.
REQUEST_HEADERS = {"Content-Type": "application/json", "Connection": "close"}
MODEL_NAMES = ("hexgrad/Kokoro-82M", "kokoro", "Kokoro-82M")
SERVED_MODEL = "speaches-ai/Kokoro-82M-v1.0-ONNX"
SPEECH_PATH = "/audio/speech"


def speech_url(endpoint: Column) -> Column:
    base = F.rtrim(endpoint, F.lit("/"))
    return F.when(base.endswith(SPEECH_PATH), base).otherwise(F.concat(base, F.when(base.contains("/v1"), "").otherwise("/v1"), F.lit(SPEECH_PATH)))


def is_local_endpoint(url: Column) -> Column:
    host = F.lower(F.regexp_replace(F.coalesce(F.try_parse_url(url, F.lit("HOST")), F.lit("127.0.0.1")), r"^\[|\]$", ""))
    return host.isin("localhost", "127.0.0.1", "::1")


def speech_payload(text: Column, model: Column, voice: Column, speed: Column) -> Column:
    """The JSON body of a request to the speech service."""
    served = F.when(model.isin(*MODEL_NAMES), SERVED_MODEL).otherwise(model)
    return F.to_json(F.struct(served.alias("model"), text.alias("input"), voice.alias("voice"), F.lit("mp3").alias("response_format"), speed.alias("speed")))


def clamp_speed(speed: Column) -> Column:
    """Within 0.25 and 4; null for NaN and infinities."""
    return F.when(F.isnan(speed) | F.abs(speed).isin(float("inf")), None).otherwise(F.least(F.lit(4.0), F.greatest(F.lit(0.25), speed)))


def megabytes(n_bytes: Column) -> Column:
    return n_bytes / (1024 * 1024)


def fallback_duration_ms(n_bytes: Column) -> Column:
    """Length of an MP3 that can't be probed, at 64 kbit a second."""
    return (n_bytes / F.lit(8000.0) * 1000).cast("long")


def pcm16(sample: Column) -> Column:
    """A sample in [-1, 1] as a 16-bit integer, cut off towards zero."""
    return (F.greatest(F.least(sample, F.lit(1.0)), F.lit(-1.0)) * 32767).cast("smallint")

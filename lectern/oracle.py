"""SQL for the registered queries, for an engine with DuckDB's dialect. Patterns are RE2's, without lookbehind."""

from __future__ import annotations

from . import literals
from .functions import patterns as P
from .operators.library import AUDIO_EXTENSIONS, VOICES


def q(s: str) -> str:
    """A string literal."""
    return "'" + s.replace("'", "''") + "'"


CHAPTER = rf"(?i)^(?:chapter|part|book|section)\s+(?:\d+|[ivxlc]+|(?:{P.NUMBER_WORDS})(?:[- ](?:{P.NUMBER_WORDS}))*)\b[\s:.\-–—]*(.*)$"
BARE = rf"(?i)^(?:chapter\s+)?(?:\d+|[ivxlc]+|(?:{P.NUMBER_WORDS}))\.?$"
PAGE = r"(?i)^(?:page\s+)?(?:\d{1,4}|[ivxlc]{1,6})(?:\s*(?:of|/)\s*\d{1,4})?$"
NAMED = P.NAMED_HEADING.replace("(?iu)", "(?i)")
DROP = P.DROP_TITLE.replace("(?iu)", "(?i)")
DOTS = r"(?:\.\s?){4,}\s*\d*\s*$"
BULLET = rf"^(?:[{P.BULLETS}]|\d{{1,2}}[.)])\s+"


def matches(t: str, pattern: str) -> str:
    return f"regexp_matches({t}, {q(pattern)})"


def sub(t: str, pattern: str, by: str) -> str:
    return f"regexp_replace({t}, {q(pattern)}, {q(by)}, 'g')"


def ends(t: str) -> str:
    last = ", ".join(q(c) for c in P.SENTENCE_ENDS)
    return f"(right(rtrim({sub(t, chr(92) + 's+$', '')}, {q(P.CLOSERS)}), 1) IN ({last}))"


def lower_start(t: str) -> str:
    return matches(t, r"^\p{Ll}")


def flows(before: str, after: str) -> str:
    last = ", ".join(q(c) for c in P.FLOW_ENDS)
    return f"(NOT {ends(before)} AND ({lower_start(after)} OR right({sub(before, chr(92) + 's+$', '')}, 1) IN ({last})))"


def ornament(t: str) -> str:
    return f"(length({t}) <= 15 AND NOT {matches(t, '[A-Za-z0-9]')})"


def key(t: str) -> str:
    return sub(sub(f"lower({t})", r"\d+", "#"), r"^\s+|\s+$", "")


def norm(t: str) -> str:
    """Runs of what is no letter, mark, number or underscore are one space."""
    return "trim(" + sub(f"lower({t})", r"[^\p{L}\p{M}\p{N}_]+", " ") + ")"


def page_number(t: str) -> str:
    return matches(f"trim({t}, {q(P.PAGE_NUMBER_TRIM)})", PAGE)


def words(t: str) -> str:
    return f"len(list_filter(regexp_split_to_array({t}, {q(chr(92) + 's+')}), lambda w: w <> ''))"


def tidy(t: str, urls: bool = False) -> str:
    t = sub(t, rf"^[{P.BULLETS}]\s*", "")
    if urls:
        t = sub(t, r"(?:https?://|www\.)\S+", "")
    t = sub(sub(t, r"\[\d+(?:\s*[,–-]\s*\d+)*\]", ""), r"\s+([,.;:!?])", r"\1")
    return sub(sub(t, r"\s{2,}", " "), r"^\s+|\s+$", "")


def metadata(t: str) -> str:
    return sub(sub(t, r"\n", " "), r"([=;#\\])", r"\\\1")


def xml(t: str) -> str:
    return f"replace(replace(replace({t}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


LINES = """
    d AS (SELECT source AS book_id, dense_rank() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS page, string_split(text, chr(10)) AS parts FROM documents),
    d2 AS (SELECT book_id, page, len(parts) AS n, unnest(range(len(parts))) AS line_no, unnest(parts) AS text FROM d),
    lines AS (SELECT book_id, page, line_no, text, CAST(CASE line_no % 6 WHEN 0 THEN 72 WHEN 3 THEN 330 ELSE 90 END AS DOUBLE) AS x0, CAST(line_no * 14 AS DOUBLE) AS y0,
        CAST(CASE line_no % 6 WHEN 0 THEN 72 WHEN 3 THEN 330 ELSE 90 END + least(length(text), 90) * 3 AS DOUBLE) AS x1, CAST((line_no + 1) * 14 AS DOUBLE) AS y1,
        CAST(CASE WHEN length(text) < 60 THEN 14 ELSE 12 END AS DOUBLE) AS size, CAST((line_no + 1) * 14 AS DOUBLE) AS base, line_no // 5 AS block, CAST(n * 14 AS DOUBLE) AS ph
        FROM d2 WHERE trim(text) <> '')"""
IN_BAND = "(y0 < ph * CAST(0.09 AS DOUBLE) OR y1 > ph * (1 - CAST(0.09 AS DOUBLE)))"
KEYS = f"""
    keyed AS (SELECT *, CASE WHEN {IN_BAND} THEN {key('text')} END AS header_key FROM lines),
    hp AS (SELECT DISTINCT book_id, header_key, page FROM keyed WHERE header_key IS NOT NULL),
    gaps AS (SELECT *, page - lag(page) OVER (PARTITION BY book_id, header_key ORDER BY page) AS gap FROM hp),
    rep AS (SELECT book_id, header_key, count(*) AS pages, median(gap) AS gap FROM gaps GROUP BY ALL HAVING count(*) >= 3 AND median(gap) <= 2)"""
LEADING = """
    pairs AS (SELECT book_id, size, lead(base) OVER w - base AS dy, lead(size) OVER w AS next_size FROM lines WINDOW w AS (PARTITION BY book_id, page ORDER BY line_no)),
    lead_t AS (SELECT book_id, coalesce(median(dy) FILTER (dy > 0 AND dy < 2.5 * size AND abs(size - next_size) < 0.5), CAST(14 AS DOUBLE)) AS gap_of FROM pairs GROUP BY book_id)"""
EDGES = """
    b0 AS (SELECT *, count(*) FILTER (length(text) > 25) OVER (PARTITION BY book_id, page) AS nl FROM lines),
    body AS (SELECT * FROM b0 WHERE length(text) > 25 OR nl = 0),
    spans AS (SELECT book_id, page, max(x1) - min(x0) AS span FROM body GROUP BY ALL),
    hist AS (SELECT book_id, page, round_even(x0 / 3, 0) * 3 AS lft, count(*) AS n, min(line_no) AS f FROM body GROUP BY ALL),
    top AS (SELECT *, row_number() OVER (PARTITION BY book_id, page ORDER BY n DESC, f) AS r FROM hist),
    one AS (SELECT book_id, page, lft AS l1, n AS n1 FROM top WHERE r = 1),
    two AS (SELECT t.book_id, t.page, min_by(lft, r) AS l2 FROM top t JOIN one USING (book_id, page) JOIN spans USING (book_id, page)
        WHERE r BETWEEN 2 AND 4 AND abs(lft - l1) > CAST(0.3 AS DOUBLE) * span AND n >= 0.25 * n1 GROUP BY ALL),
    edges AS (SELECT book_id, page, span, CASE WHEN l2 < l1 THEN l2 ELSE l1 END AS left_1, CASE WHEN l2 < l1 THEN l1 ELSE l2 END AS left_2 FROM one JOIN spans USING (book_id, page) LEFT JOIN two USING (book_id, page))"""
ANNOTATED = f"""{EDGES},
    placed AS (SELECT l.*, span, CASE WHEN left_2 <= x0 + 2 THEN left_2 ELSE left_1 END AS lft FROM lines l JOIN edges USING (book_id, page)),
    p1 AS (SELECT *, count(*) FILTER (length(text) > 25) OVER (PARTITION BY book_id, page) AS nl FROM placed),
    ends AS (SELECT book_id, page, lft, list_sort(list(x1))[CAST(floor(CAST(0.9 AS DOUBLE) * (count(*) - 1)) AS BIGINT) + 1] AS e FROM p1 WHERE length(text) > 25 OR nl = 0 GROUP BY ALL),
    annotated AS (SELECT p.*, coalesce(e, lft + span) AS rgt FROM placed p LEFT JOIN ends USING (book_id, page, lft))"""
INDENTED = "(x0 > lft + 0.9 * size)"
STYLE = f"""{LEADING}, {ANNOTATED},
    nexts AS (SELECT a.*, gap_of, lead(x0) OVER w AS nx0, lead(lft) OVER w AS nlft, lead(size) OVER w AS nsize, lead(base) OVER w - base AS dy FROM annotated a JOIN lead_t USING (book_id) WINDOW w AS (PARTITION BY book_id, page ORDER BY line_no)),
    starts AS (SELECT *, coalesce({ends('text')} AND x1 < rgt - CAST(0.3 AS DOUBLE) * (rgt - lft) AND dy > 0 AND dy <= 1.45 * gap_of, false) AS st FROM nexts),
    style AS (SELECT book_id, count(*) FILTER (st) AS starts, count(*) FILTER (st AND nx0 > nlft + 0.9 * nsize) AS indented,
        count(*) FILTER (st) >= 5 AND count(*) FILTER (st AND nx0 > nlft + 0.9 * nsize) >= 0.6 * count(*) FILTER (st) AS indent_style FROM starts GROUP BY book_id)"""
NUMBERED = f"""{STYLE},
    prevs AS (SELECT a.*, gap_of, indent_style AS sty, {', '.join(f'lag({c}) OVER w AS p_{c}' for c in 'text x1 lft rgt size base block page'.split())} FROM annotated a JOIN lead_t USING (book_id) JOIN style USING (book_id)
        WINDOW w AS (PARTITION BY book_id ORDER BY page, line_no)),
    marked AS (SELECT *, CASE WHEN p_text IS NULL OR {ornament('p_text')} OR {ornament('text')} THEN true
        WHEN abs(size - p_size) > 1 OR {matches('text', BULLET)} THEN true
        WHEN page <> p_page OR base < p_base - 0.5 * p_size THEN CASE WHEN NOT {ends('p_text')} AND sty AND NOT {INDENTED} THEN false WHEN NOT {ends('p_text')} THEN NOT {flows('p_text', 'text')}
            WHEN sty THEN {INDENTED} OR p_x1 < p_rgt - CAST(0.3 AS DOUBLE) * (p_rgt - p_lft) ELSE true END
        ELSE base - p_base > 1.45 * gap_of OR ({ends('p_text')} AND ({INDENTED} OR (NOT sty AND (p_x1 < p_rgt - CAST(0.12 AS DOUBLE) * (p_rgt - p_lft) OR block <> p_block)))) END AS st FROM prevs),
    numbered AS (SELECT *, CAST(sum(CAST(st AS INT)) OVER (PARTITION BY book_id ORDER BY page, line_no ROWS UNBOUNDED PRECEDING) AS BIGINT) AS para_no FROM marked)"""
FOLD = f"""list_reduce(list(text ORDER BY page, line_no), lambda a, x: CASE WHEN a = '' THEN x WHEN {matches('a', '^' + chr(92) + 'p{L}$')} AND {lower_start('x')} THEN a || x
    WHEN {matches('a', chr(92) + 'p{L}-$')} THEN CASE WHEN {lower_start('x')} THEN regexp_replace(a, '-$', '') || x ELSE a || x END ELSE a || ' ' || x END)"""
SECTIONS = f"""
    s0 AS (SELECT source AS book_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS section_no, lang, string_split(text, chr(10)) AS parts FROM documents),
    s1 AS (SELECT book_id, section_no, 'Part ' || section_no || ' = ' || lang AS title, unnest(range(len(parts))) AS para_no, unnest(parts) AS text FROM s0),
    secs AS (SELECT * FROM s1 WHERE trim(text) <> ''),
    sw AS (SELECT book_id, section_no, title, CAST(sum({words('text')}) AS BIGINT) AS words FROM secs GROUP BY ALL)"""
MARKS = "SELECT book_id, chapter_no, title, CAST(sum(ms) OVER w - ms AS BIGINT) AS start_ms, CAST(sum(ms) OVER w AS BIGINT) AS end_ms FROM {} WINDOW w AS (PARTITION BY book_id ORDER BY chapter_no ROWS UNBOUNDED PRECEDING)"
LINE_BREAK = "chr(10)"
MARK = f"string_agg(chr(10) || '[CHAPTER]' || chr(10) || 'TIMEBASE=1/1000' || chr(10) || 'START=' || start_ms || chr(10) || 'END=' || end_ms || chr(10) || 'title=' || {metadata('title')} || chr(10), '' ORDER BY chapter_no)"


def head(title: str, author: str) -> str:
    return f"';FFMETADATA1' || chr(10) || 'title=' || {title} || chr(10) || 'artist=' || {author} || chr(10) || 'album=' || {title} || chr(10)"


HEADING = f"(length(text) <= 80 AND NOT {matches('text', DOTS)} AND ({matches('text', CHAPTER)} OR {matches('text', NAMED)}))"
BARE_HEADING = f"(length(text) <= 80 AND NOT {matches('text', DOTS)} AND {matches('text', CHAPTER)} AND trim(regexp_extract(text, {q(CHAPTER)}, 1)) = '')"
PARAS = f"""{literals.sql('paras')},
    ps AS (SELECT book_id, para_no, page, CASE WHEN text <> '***' THEN text END AS text, text = '***' AS is_break FROM paras),
    h1 AS (SELECT *, coalesce({BARE_HEADING}, false) AS bare, coalesce({HEADING}, false) AS heads, CASE WHEN is_break THEN 1 ELSE {words('text')} END AS words FROM ps),
    h2 AS (SELECT *, coalesce(lag(bare) OVER w AND NOT is_break AND text <> '' AND length(text) <= 70 AND NOT {ends('text')} AND NOT {matches('text', CHAPTER)}, false) AS consumed FROM h1 WINDOW w AS (PARTITION BY book_id ORDER BY para_no)),
    h3 AS (SELECT *, heads AND NOT consumed AS candidate FROM h2),
    cands AS (SELECT *, CASE WHEN candidate THEN text || CASE WHEN coalesce(lead(consumed) OVER w, false) THEN ': ' || lead(text) OVER w ELSE '' END END AS heading FROM h3 WINDOW w AS (PARTITION BY book_id ORDER BY para_no))"""
HEADING_SECTIONS = f"""{PARAS},
    g1 AS (SELECT *, sum(CAST(candidate AS INT)) OVER (PARTITION BY book_id ORDER BY para_no ROWS UNBOUNDED PRECEDING) AS span FROM cands),
    g2 AS (SELECT *, candidate AND sum(CASE WHEN candidate OR consumed THEN 0 ELSE words END) OVER (PARTITION BY book_id, span) >= 5 AS kept FROM g1),
    g3 AS (SELECT *, CAST(sum(CAST(kept AS INT)) OVER o AS BIGINT) AS section_no, coalesce(last_value(CASE WHEN kept THEN heading END IGNORE NULLS) OVER o, 'Front matter') AS title,
        sum(CAST(kept AS INT)) OVER (PARTITION BY book_id) AS found, kept OR (consumed AND coalesce(lag(kept) OVER (PARTITION BY book_id ORDER BY para_no), false)) AS of_heading
        FROM g2 WINDOW o AS (PARTITION BY book_id ORDER BY para_no ROWS UNBOUNDED PRECEDING)),
    hs AS (SELECT book_id, section_no, title, para_no, text, is_break, words FROM g3 WHERE found >= 2 AND NOT of_heading)"""
STARTS = f"""{literals.sql('toc')},
    t1 AS (SELECT book_id, toc_no, level, page - 1 AS page, trim({sub('title', chr(92) + 's+', ' ')}) AS title FROM toc),
    t2 AS (SELECT * FROM t1 WHERE title <> '' AND page BETWEEN 0 AND 3),
    lv AS (SELECT book_id, level, count(*) AS n, min(toc_no) AS f FROM t2 GROUP BY ALL),
    ch AS (SELECT book_id, coalesce(min(level) FILTER (n >= 5), CASE WHEN max(n) >= 2 THEN arg_max(level, n * 1000 - f) END) AS level FROM lv GROUP BY book_id),
    st AS (SELECT book_id, page, min(title) AS title FROM t2 JOIN ch USING (book_id, level) GROUP BY ALL)"""
OWN, TITLE = norm("text"), norm("title")
OUTLINE = f"""{STARTS}, {PARAS},
    s2 AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY page) AS no FROM st),
    o1 AS (SELECT p.book_id, p.para_no, p.text, p.is_break, coalesce(max(no), 0) AS section_no, coalesce(arg_max(title, no), 'Front matter') AS title FROM ps p LEFT JOIN s2 ON s2.book_id = p.book_id AND s2.page <= p.page
        WHERE p.book_id IN (SELECT book_id FROM st) GROUP BY ALL),
    o2 AS (SELECT *, section_no > 0 AND coalesce(NOT is_break AND length(text) < 100 AND NOT {ends('text')} AND ({matches('text', BARE)} OR ({OWN} <> '' AND (contains({TITLE}, {OWN}) OR contains({OWN}, {TITLE})))), false) AS echo FROM o1),
    o3 AS (SELECT *, coalesce(sum(CASE WHEN echo THEN 0 ELSE 1 END) OVER (PARTITION BY book_id, section_no ORDER BY para_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS stayed FROM o2),
    os AS (SELECT book_id, section_no, title, para_no, text, is_break FROM o3 WHERE NOT echo OR stayed >= 3)"""


def bins(list_: str, limit: int) -> str:
    """Bin numbers of a list of word counts, as a list, by a fold with a struct as its state."""
    first = f"{{'w': {list_}[1], 'bins': [1]}}"
    rest = f"list_transform({list_}[2:], lambda x: {{'w': x, 'bins': [1]}})"
    return f"""(list_reduce(list_concat([{first}], {rest}), lambda a, x: {{'w': CASE WHEN a.w + x.w > {limit} THEN x.w ELSE a.w + x.w END, 'bins': list_append(a.bins, a.bins[len(a.bins)] + CASE WHEN a.w + x.w > {limit} THEN 1 ELSE 0 END)}})).bins"""


FIXED = f"""{LINES},
    n1 AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY page, line_no) AS para_no, {words('text')} AS w FROM lines),
    n2 AS (SELECT book_id, list(para_no ORDER BY para_no) AS ps, list(w ORDER BY para_no) AS ws FROM n1 GROUP BY book_id),
    n3 AS (SELECT book_id, unnest(ps) AS para_no, unnest({bins('ws', 6000)}) AS bin FROM n2)"""
ranks = " ".join(f"WHEN {q(e)} THEN {i}" for i, e in enumerate(AUDIO_EXTENSIONS))
CLEAN = f"""coalesce(nullif(trim({sub(sub('stem', r'(?i)' + chr(92) + 's*--' + chr(92) + 's*[a-f0-9]{32}' + chr(92) + 's*--.*', ''), '[^' + chr(92) + 'p{L}' + chr(92) + 'p{N}' + chr(92) + 's' + chr(92) + "-_.,()'" + chr(34) + ']', '')}), ''), stem)"""
LIBRARY = f"""{literals.sql('files')}, {literals.sql('audio')},
    bk0 AS (SELECT *, regexp_replace(name, '\\.[^.]*$', '') AS stem FROM files WHERE regexp_matches(name, '(?i)^[^.].*\\.(pdf|epub)$')),
    bk AS (SELECT name, lower(name) LIKE '%.epub' AS is_epub, bytes / CAST(1048576 AS DOUBLE) AS size_mb, {CLEAN} AS clean_stem FROM bk0),
    au AS (SELECT name AS audio_name, regexp_replace(name, '\\.[^.]*$', '') AS astem, regexp_extract(name, '\\.([^.]+)$', 1) AS ext FROM audio),
    best AS (SELECT bk.name, audio_name, row_number() OVER (PARTITION BY bk.name ORDER BY CASE ext {ranks} END, astem <> clean_stem, audio_name) AS r FROM bk JOIN au
        ON ext IN ('m4b', 'm4u', 'm4a', 'mp3') AND (astem = clean_stem OR (length(astem) > 6 AND (contains(clean_stem, astem) OR contains(astem, clean_stem))))),
    lib AS (SELECT bk.*, trim(translate(clean_stem, '_-', '  ')) AS title, audio_name AS ready_file FROM bk LEFT JOIN best ON best.name = bk.name AND r = 1)"""
VOICE_ROWS = ", ".join(f"({q(c)}, {q(c.split('_')[1])})" for codes in VOICES.values() for c in codes.split())
VOICE = f"v(code, alias) AS (VALUES {VOICE_ROWS}), vk AS (SELECT code AS k, code FROM v UNION ALL SELECT alias, code FROM v)"
REASON = f"""CASE WHEN length(input) > 20000 THEN 'input' WHEN NOT speed BETWEEN 0.25 AND 4 THEN 'speed' WHEN response_format NOT IN ('mp3', 'opus', 'aac', 'flac', 'wav', 'pcm') THEN 'response_format'
    WHEN code IS NULL THEN 'unknown voice' WHEN trim(input) = '' THEN 'empty text' END"""
T = literals.sql("texts")
FINAL = f"""{HEADING_SECTIONS},
    f1 AS (SELECT *, min(CASE WHEN NOT is_break THEN para_no END) OVER o AS a, max(CASE WHEN NOT is_break THEN para_no END) OVER o AS b FROM hs WINDOW o AS (PARTITION BY book_id, section_no)),
    f2 AS (SELECT *, sum(words) OVER (PARTITION BY book_id, section_no) AS total FROM f1 WHERE para_no BETWEEN a AND b AND title <> 'Front matter' AND NOT {matches('trim(title)', DROP)}),
    f3 AS (SELECT book_id, section_no, list(para_no ORDER BY para_no) AS ps, list(words ORDER BY para_no) AS ws FROM f2 WHERE total > 9 GROUP BY ALL),
    f4 AS (SELECT book_id, section_no, unnest(ps) AS para_no, unnest({bins('ws', 9)}) AS bin FROM f3)"""

# The same over whole tables: lines of documents as paragraphs, each document under a heading of its own.
CHAPTERED = LINES.replace("FROM documents)", "FROM (SELECT source, doc_id, 'Chapter ' || doc_id || chr(10) || text AS text FROM documents))")
TABLE_PARAS = "paras AS (SELECT book_id, row_number() OVER (PARTITION BY book_id ORDER BY page, line_no) AS para_no, page, text FROM lines)"
TABLE_TOC = """e0 AS (SELECT source AS book_id, doc_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS page FROM documents WHERE right(source, 1) IN ('0', '2', '4', '6', '8')),
    toc AS (SELECT book_id, page AS toc_no, page % 2 + 1 AS level, 'Entry ' || doc_id AS title, page FROM e0)"""


def of_tables(ctes: str, lines: str = CHAPTERED) -> str:
    """CTEs over literals, over the tables instead, with the limits that queries of tables have."""
    found = ctes.replace(literals.sql("paras"), f"{lines}, {TABLE_PARAS}").replace(literals.sql("toc"), TABLE_TOC)
    for old, new in (("page BETWEEN 0 AND 3", "page >= 0"), (">= 5 AS kept", ">= 80 AS kept"), ("total > 9", "total > 400"), ("> 9 THEN", "> 400 THEN"), ("AND title <> 'Front matter' AND NOT", "AND NOT"), ("n * 1000 - f", "n * 1000000 - f")):
        found = found.replace(old, new)
    return found


SPAN_DIGEST = "SELECT book_id, CAST(section_no AS BIGINT) AS section_no, title, CAST(min(para_no) AS BIGINT) AS first_para, count(*) AS paras, CAST(sum(length(text)) AS BIGINT) AS chars FROM {} GROUP BY ALL"
MARKUP = "html"
for tag in ("script", "style", "nav", "footer", "header", "head", "aside", "noscript"):
    MARKUP = sub(MARKUP, rf"(?is)<{tag}(?:\s[^>]*)?>.*?</{tag}>", "<p>")
for old, new in ((r"(?s)<!--.*?-->", ""), (r"\s+", " "), (r"(?i)<br\s*/?>", " "), (r"(?i)</?(?:p|h[1-6]|li|blockquote|div|td|pre|dd|dt|hr)(?:\s[^>]*)?/?>", "\n"), (r"<[^>]*>", "")):
    MARKUP = sub(MARKUP, old, new)
MARKUP = f"replace(replace(replace({MARKUP}, '&quot;', chr(34)), '&lt;', '<'), '&amp;', '&')"
SOFT = q("'" + chr(34))


ORACLE = {
    "kept_lines": f"""WITH {LINES}, {KEYS} SELECT book_id, count(*) FILTER (NOT gone) AS kept, count(*) FILTER (gone) AS removed FROM (
        SELECT k.book_id, k.header_key IS NOT NULL AND ({page_number('text')} OR rep.header_key IS NOT NULL) AS gone FROM keyed k LEFT JOIN rep USING (book_id, header_key)) GROUP BY book_id""",
    "header_pages": f"WITH {LINES}, {KEYS} SELECT book_id, count(*) AS key_pages, count(DISTINCT header_key) AS keys FROM hp GROUP BY book_id",
    "repeated_keys": f"WITH {LINES}, {KEYS} SELECT * FROM rep",
    "page_numbers": f"WITH {LINES} SELECT book_id, count(*) FILTER ({page_number('text')}) AS page_numbers, count(*) FILTER ({IN_BAND}) AS in_band, count(*) FILTER ({ornament('text')}) AS ornaments FROM lines GROUP BY book_id",
    "body_size": f"""WITH {LINES}, z AS (SELECT book_id, size, sum(length(text)) AS c, min(page * 1000000 + line_no) AS f FROM lines GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY c DESC, f) AS r FROM z)
        SELECT book_id, size AS body FROM r WHERE r = 1""",
    "footnotes": f"""WITH {LINES}, z AS (SELECT book_id, size, sum(length(text)) AS c, min(page * 1000000 + line_no) AS f FROM lines GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY c DESC, f) AS r FROM z)
        SELECT l.book_id, count(*) FILTER (l.size < r.size AND y0 > ph * CAST(0.6 AS DOUBLE)) AS footnotes, count(*) AS lines FROM lines l JOIN r ON r.book_id = l.book_id AND r.r = 1 GROUP BY l.book_id""",
    "typical_leading": f"WITH {LINES}, {LEADING} SELECT book_id, gap_of AS \"leading\" FROM lead_t",
    "column_edges": f"WITH {LINES}, {EDGES} SELECT * FROM edges",
    "annotated_columns": f"WITH {LINES}, {ANNOTATED} SELECT book_id, page, lft AS left, max(rgt) AS right, count(*) AS lines FROM annotated GROUP BY ALL",
    "indent_style": f"WITH {LINES}, {STYLE} SELECT * FROM style",
    "paragraph_starts": f"WITH {LINES}, {NUMBERED} SELECT book_id, page, min(para_no) AS first_para, max(para_no) AS last_para FROM numbered GROUP BY ALL",
    "built_paragraphs": f"WITH {LINES}, {NUMBERED}, b AS (SELECT book_id, para_no, min(page) AS page, {FOLD} AS text FROM numbered GROUP BY ALL) SELECT book_id, para_no, page, length(text) AS chars, md5(text) AS md5 FROM b",
    "tidy_paragraphs": f"""WITH {T}, a AS (SELECT 'book' || n AS book_id, n AS para_no, 0 AS page, {tidy('t')} AS text FROM texts WHERE NOT {matches(sub('t', rf'^[{P.BULLETS}]' + chr(92) + 's*', ''), DOTS)})
        SELECT book_id, CAST(para_no AS BIGINT) AS para_no, CAST(page AS BIGINT) AS page, CASE WHEN {matches('text', '[A-Za-z0-9]')} THEN text END AS text, NOT {matches('text', '[A-Za-z0-9]')} AS is_break FROM a WHERE text <> '' AND ({matches('text', '[A-Za-z0-9]')} OR length(text) <= 15)""",
    "document_words": f"SELECT doc_id, {words('text')} AS words, length({norm('text')}) AS norm_chars, {ends('text')} AS ends_sentence FROM documents",
    "text_functions": f"""WITH {T} SELECT CAST(n AS BIGINT) AS n, {key('t')} AS header_key, {norm('t')} AS norm, {page_number('t')} AS is_page_number, {ends('t')} AS ends_sentence, {ornament('t')} AS is_ornament, {matches('t', DOTS)} AS is_dot_leader,
        {words('t')} AS words, {tidy('t', True)} AS tidied, {metadata('t')} AS metadata, {xml('t')} AS xml, CASE WHEN length(t) > 12 THEN t[1:9] || '...' ELSE t END AS short FROM texts""",
    "stem_functions": f"WITH {literals.sql('stems')} SELECT CAST(n AS BIGINT) AS n, {CLEAN} AS clean, trim(translate({CLEAN}, '_-', '  ')) AS title FROM stems",
    "headings": f"WITH {PARAS} SELECT book_id, CAST(para_no AS BIGINT) AS para_no, candidate, consumed, heading, CAST(words AS BIGINT) AS words FROM cands",
    "outline_starts": f"WITH {STARTS} SELECT book_id, CAST(page AS BIGINT) AS page, title FROM st",
    "outline_sections": f"WITH {OUTLINE} SELECT book_id, section_no, title, CAST(para_no AS BIGINT) AS para_no, text, is_break FROM os",
    "heading_sections": f"WITH {HEADING_SECTIONS} SELECT book_id, section_no, title, CAST(para_no AS BIGINT) AS para_no, text, is_break FROM hs",
    "fixed_sections": f"WITH {FIXED} SELECT book_id, CAST(bin AS BIGINT) AS section_no, 'Section ' || bin AS title, min(para_no) AS first_para, count(*) AS paras FROM n3 GROUP BY ALL",
    "chosen_sections": f"""WITH {OUTLINE}, {HEADING_SECTIONS.split(PARAS + ',', 1)[1]},
        r1 AS (SELECT * FROM cands WHERE book_id NOT IN (SELECT book_id FROM os) AND book_id NOT IN (SELECT book_id FROM hs)),
        r2 AS (SELECT book_id, list(para_no ORDER BY para_no) AS p, list(words ORDER BY para_no) AS ws FROM r1 GROUP BY book_id), r3 AS (SELECT book_id, unnest(p) AS para_no, unnest({bins('ws', 9)}) AS section_no FROM r2),
        al AS (SELECT book_id, 'outline' AS chapter_source, section_no, text FROM os UNION ALL SELECT book_id, 'headings', section_no, text FROM hs WHERE book_id NOT IN (SELECT book_id FROM os)
            UNION ALL SELECT book_id, 'fixed', section_no, text FROM r3 JOIN r1 USING (book_id, para_no)),
        fl AS (SELECT *, max(CAST(text IS NOT NULL AND trim(text) <> '' AS INT)) OVER (PARTITION BY book_id, section_no) AS f FROM al)
        SELECT book_id, chapter_source, count(DISTINCT section_no) AS sections, count(*) AS paras FROM fl WHERE f = 1 GROUP BY ALL""",
    "finalized_sections": f"""WITH {FINAL} SELECT f2.book_id, dense_rank() OVER (PARTITION BY f2.book_id ORDER BY f2.section_no, coalesce(bin, 1)) AS section_no, CASE WHEN bin IS NULL THEN title ELSE title || ' (part ' || bin || ')' END AS title,
        CAST(f2.para_no AS BIGINT) AS para_no, text, is_break FROM f2 LEFT JOIN f4 USING (book_id, section_no, para_no)""",
    "conversation_bins": f"""WITH w AS (SELECT conv_id, list({words("coalesce(text, '')")} ORDER BY turn) AS ws FROM conversations GROUP BY conv_id), b AS (SELECT conv_id, {bins('ws', 200)} AS bins FROM w)
        SELECT conv_id, len(bins) AS turns, CAST(list_max(bins) AS BIGINT) AS bins, CAST(list_sum(bins) AS BIGINT) AS sum FROM b""",
    "section_totals": f"WITH {SECTIONS} SELECT book_id, count(*) AS sections, CAST(sum(words) AS BIGINT) AS total_words, round(sum(words) / CAST(150 AS DOUBLE) / 60, 6) AS hours, round(greatest(sum(words) / CAST(150 AS DOUBLE) / 60 * 60 / 10, 1), 6) AS eta_minutes FROM sw GROUP BY book_id",
    "section_preview": f"""WITH {SECTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY section_no) AS number, count(*) OVER (PARTITION BY book_id) AS n FROM sw)
        SELECT book_id, number, CASE WHEN length(title) > 43 THEN title[1:40] || '...' ELSE title END AS title, words, greatest(n - 8, 0) AS more FROM r WHERE number <= 8""",
    "latest_sections": f"""WITH {SECTIONS}, r AS (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY section_no DESC) AS b, count(*) OVER (PARTITION BY book_id) AS n FROM sw)
        SELECT book_id, section_no, title, words, greatest(n - 6, 0) AS earlier FROM r WHERE b <= 6""",
    "chapter_marks": f"WITH {SECTIONS}, c AS (SELECT book_id, section_no AS chapter_no, title, words * 400 AS ms FROM sw) {MARKS.format('c')}",
    "chapter_metadata": f"""WITH {SECTIONS}, c AS (SELECT book_id, section_no AS chapter_no, title, words * 400 AS ms FROM sw), m AS ({MARKS.format('c')}),
        x AS (SELECT book_id, {head("'Book" + chr(92) + "; ' || book_id", "'Unknown'")} || {MARK} AS metadata FROM m GROUP BY book_id) SELECT book_id, length(metadata) AS chars, md5(metadata) AS md5 FROM x""",
    "literal_metadata": f"""WITH {literals.sql('chapters')}, m AS ({MARKS.format('chapters')}) SELECT book_id, {head("book_id || '" + chr(92) + "=1'", "'x" + chr(92) + "#y'")} || {MARK} AS metadata FROM m GROUP BY book_id""",
    "total_lengths": f"WITH {literals.sql('chapters')} SELECT book_id, CAST(sum(ms) AS BIGINT) AS total_ms, CAST(sum(ms) // 3600000 AS BIGINT) AS hours, CAST(sum(ms) % 3600000 // 60000 AS BIGINT) AS minutes FROM chapters GROUP BY book_id",
    "length_labels": f"""WITH {literals.sql('chapters')} SELECT book_id, CAST(chapter_no AS BIGINT) AS chapter_no, CASE WHEN ms >= 60000 THEN printf('%.1f min', ms / CAST(60000 AS DOUBLE)) ELSE printf('%.0f sec', round_even(ms / CAST(1000 AS DOUBLE), 0)) END AS label,
        printf('%.1f MB', CAST(ms AS BIGINT) * 1000 / CAST(1048576 AS DOUBLE)) AS size, CAST(floor(ms / CAST(8000 AS DOUBLE) * 1000) AS BIGINT) AS fallback_ms FROM chapters""",
    "concat_lists": f"WITH {literals.sql('chapters')} SELECT book_id, string_agg('file ''/tmp/chapter_' || lpad(CAST(chapter_no AS VARCHAR), 3, '0') || '.mp3''' || chr(10), '' ORDER BY chapter_no) AS concat_list FROM chapters GROUP BY book_id",
    "plain_texts": f"""WITH {SECTIONS}, a AS (SELECT book_id, section_no, title || chr(10) || chr(10) || string_agg(text || chr(10) || chr(10), '' ORDER BY para_no) || chr(10) AS t FROM secs GROUP BY book_id, section_no, title),
        b AS (SELECT book_id, string_agg(t, '' ORDER BY section_no) AS t FROM a GROUP BY book_id) SELECT book_id, length(t) AS chars, md5(t) AS md5 FROM b""",
    "chapter_markup": f"""WITH {SECTIONS}, a AS (SELECT book_id, section_no, '<h1>' || {xml('title')} || '</h1>' || string_agg(chr(10) || '<p>' || {xml('text')} || '</p>', '' ORDER BY para_no) AS m FROM secs GROUP BY book_id, section_no, title)
        SELECT book_id, section_no, length(m) AS chars, md5(m) AS md5 FROM a""",
    "library_listing": f"WITH {LIBRARY} SELECT row_number() OVER (ORDER BY lower(name), name) AS number, * FROM lib",
    "pending_books": f"WITH {LIBRARY} SELECT name, title FROM lib WHERE ready_file IS NULL",
    "library_counts": f"WITH {LIBRARY} SELECT count(*) AS found, count(ready_file) AS converted, count(*) - count(ready_file) AS pending FROM lib",
    "library_search": f"WITH {LIBRARY} SELECT name, title FROM lib WHERE contains(lower(title), 'road') OR contains(lower(name), 'road')",
    "voice_models": f"WITH {VOICE}, i AS (SELECT 'kokoro' AS id UNION ALL SELECT code FROM v) SELECT id, 'model' AS object, CAST(1700000000 AS BIGINT) AS created, 'kokoro-metal' AS owned_by FROM i",
    "resolved_voices": f"WITH {VOICE}, {literals.sql('requests')} SELECT CAST(n AS BIGINT) AS n, coalesce(code, trim(voice)) AS voice_id FROM requests LEFT JOIN vk ON k = lower(trim(voice))",
    "checked_requests": f"""WITH {VOICE}, {literals.sql('requests')}, c AS (SELECT n, code, {REASON} AS reason FROM requests LEFT JOIN vk ON k = lower(trim(voice)))
        SELECT CAST(n AS BIGINT) AS n, CAST(CASE WHEN reason IS NULL THEN 200 WHEN reason IN ('unknown voice', 'empty text') THEN 400 ELSE 422 END AS BIGINT) AS status, reason, CASE WHEN reason IS NULL THEN code END AS voice_id FROM c""",
    "request_payloads": f"""WITH {literals.sql('requests')} SELECT CAST(n AS BIGINT) AS n, 'http://127.0.0.1:8001/v1/audio/speech' AS url, CASE response_format WHEN 'wav' THEN 'audio/wav' WHEN 'pcm' THEN 'audio/pcm' ELSE 'audio/mpeg' END AS mime,
        least(4, greatest(CAST(0.25 AS DOUBLE), speed)) AS speed, true AS local FROM requests""",
    "pcm_samples": f"WITH {literals.sql('requests')} SELECT CAST(n AS BIGINT) AS n, CAST(trunc(greatest(least(speed / 3 - CAST(0.5 AS DOUBLE), 1), -1) * 32767) AS BIGINT) AS sample FROM requests",
    "drop_caps": f"""WITH {literals.sql('drop_caps')}, a AS (SELECT *, coalesce(regexp_matches(text, '^\\p{{L}}$') AND regexp_matches(lead(text) OVER w, '^\\p{{Ll}}'), false) AS able, row_number() OVER w AS pos FROM drop_caps WINDOW w AS (PARTITION BY book_id ORDER BY para_no)),
        b AS (SELECT *, able AND (pos - coalesce(max(CASE WHEN NOT able THEN pos END) OVER (PARTITION BY book_id ORDER BY para_no ROWS UNBOUNDED PRECEDING), 0)) % 2 = 1 AS gives FROM a),
        c AS (SELECT *, lag(CASE WHEN gives THEN text END) OVER w AS cap, lag(CASE WHEN gives THEN page END) OVER w AS cap_page FROM b WINDOW w AS (PARTITION BY book_id ORDER BY para_no))
        SELECT book_id, CAST(para_no AS BIGINT) AS para_no, CAST(coalesce(cap_page, page) AS BIGINT) AS page, coalesce(cap, '') || text AS text, false AS is_break FROM c WHERE NOT gives""",
    "wav_lengths": f"WITH {literals.sql('chapters')} SELECT book_id, CAST(chapter_no AS BIGINT) AS chapter_no, CAST(44 + 2 * ms AS BIGINT) AS bytes, CAST(ms AS BIGINT) AS ms FROM chapters",
    "epub_round_trip": f"""WITH {SECTIONS} SELECT book_id || '.epub' AS book_id, book_id AS title, 'Unknown' AS author, count(DISTINCT section_no) AS pages, CAST(NULL AS VARCHAR) AS error,
        count(*) + count(DISTINCT section_no) AS paras, count(DISTINCT section_no) AS entries FROM secs GROUP BY book_id""",
    "html_paragraphs": f"""WITH a AS (SELECT CAST(page_id AS VARCHAR) AS book_id, unnest(string_split({MARKUP}, chr(10))) AS text FROM pages), b AS (SELECT book_id, trim({sub('text', chr(92) + 's+', ' ')}) AS text FROM a)
        SELECT book_id, count(*) AS paras, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(0 AS BIGINT) AS breaks FROM b WHERE text <> '' GROUP BY book_id""",
    "document_headings": f"""WITH {of_tables(PARAS)} SELECT book_id, count(*) FILTER (candidate) AS candidates, count(*) FILTER (consumed) AS consumed, CAST(sum(words) AS BIGINT) AS words,
        md5(coalesce(string_agg(heading, '|' ORDER BY heading), '')) AS headings FROM cands GROUP BY book_id""",
    "document_heading_sections": f"WITH {of_tables(HEADING_SECTIONS)} {SPAN_DIGEST.format('hs')}",
    "document_outline_sections": f"WITH {of_tables(OUTLINE)} {SPAN_DIGEST.format('os')}",
    "document_finalized": f"""WITH {of_tables(FINAL).replace(bins('ws', 9), bins('ws', 400))}, ff AS (SELECT f2.book_id, dense_rank() OVER (PARTITION BY f2.book_id ORDER BY f2.section_no, coalesce(bin, 1)) AS section_no,
        CASE WHEN bin IS NULL THEN title ELSE title || ' (part ' || bin || ')' END AS title, f2.para_no, text FROM f2 LEFT JOIN f4 USING (book_id, section_no, para_no)) {SPAN_DIGEST.format('ff')}""",
    "document_chosen_sections": f"""WITH {of_tables(OUTLINE, LINES)},
        r2 AS (SELECT book_id, list(para_no ORDER BY para_no) AS p, list(words ORDER BY para_no) AS ws FROM cands WHERE book_id NOT IN (SELECT book_id FROM os) GROUP BY book_id), r3 AS (SELECT book_id, unnest(p) AS para_no, unnest({bins('ws', 6000)}) AS section_no FROM r2),
        al AS (SELECT book_id, 'outline' AS chapter_source, section_no FROM os UNION ALL SELECT book_id, 'fixed', section_no FROM r3) SELECT book_id, chapter_source, count(DISTINCT section_no) AS sections, count(*) AS paras FROM al GROUP BY ALL""",
    "document_tidied": f"""WITH {LINES}, {TABLE_PARAS}, a AS (SELECT book_id, {tidy('text')} AS text FROM paras WHERE NOT {matches(sub('text', rf'^[{P.BULLETS}]' + chr(92) + 's*', ''), DOTS)}), b AS (SELECT *, NOT {matches('text', '[A-Za-z0-9]')} AS br FROM a WHERE text <> '')
        SELECT book_id, count(*) AS paras, count(*) FILTER (br) AS breaks, CAST(sum(CASE WHEN NOT br THEN length(text) END) AS BIGINT) AS chars FROM b WHERE NOT br OR length(text) <= 15 GROUP BY book_id""",
    "layout_lines": f"""WITH {LINES}, a AS (SELECT book_id, page, line_no, trim({sub('text', chr(92) + 's+', ' ')}) AS text FROM lines WHERE line_no % 4 <> 3 AND line_no % 3 <> 2)
        SELECT book_id, page, count(*) AS lines, CAST(sum(length(text)) AS BIGINT) AS chars, CAST(12 AS DOUBLE) AS size, CAST(max(line_no) * 14 + 10 AS DOUBLE) AS base FROM a GROUP BY ALL""",
    "low_text_warnings": f"""WITH {SECTIONS}, t AS (SELECT book_id, count(*) AS n, CAST(sum(words) AS BIGINT) AS total_words FROM sw GROUP BY book_id) SELECT book_id, total_words, n * 6 AS pages, total_words < n * 6 * 40 AS low_text, n % 2 = 0 AS no_chapters FROM t""",
    "batch_outcomes": f"WITH {SECTIONS}, t AS (SELECT book_id, sum(words) AS w FROM sw GROUP BY book_id) SELECT count(*) FILTER (w % 2 = 0) AS done, count(*) FILTER (w % 2 <> 0) AS failed FROM t",
    "tool_reports": f"WITH {literals.sql('requests')} SELECT count(*) FILTER (n % 3 = 0) AS ok, bool_or(n % 3 = 2) AS fatal, count(*) FILTER (n % 3 = 1) AS warned FROM requests",
    "answer_functions": f"""WITH {T} SELECT CAST(n AS BIGINT) AS n, trim(trim({q(" '")} || t || {q("' ")}), {SOFT}) AS answer, split_part(t, ':', 1) AS book, CASE WHEN contains(t, ':') THEN t[strpos(t, ':') + 1:] END AS voice, t || '-' AS tail,
        trim({sub("t || 'x  y'", chr(92) + 's+', ' ')}) AS clean, coalesce(nullif(trim({sub('t', '^' + chr(92) + 's+|' + chr(92) + 's+$', '')}), ''), {q("My Book'S End")}) AS title FROM texts""",
}

"""Patterns and word lists that decide results, for Java's regular expressions."""

# They must equal those of the engine whose results are matched.
NUMBER_WORDS = "one|two|three|four|five|six|seven|eight|nine|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety|hundred"
CHAPTER = rf"(?iu)^(?:chapter|part|book|section)(?U:\s+)(?:(?U:\d+)|[ivxlc]+|(?:{NUMBER_WORDS})(?:[- ](?:{NUMBER_WORDS}))*)(?U:\b)[\s:.\-–—]*(.*)$"
NAMED_HEADING = r"(?iu)^(prologue|epilogue|preface|foreword|introduction|afterword|conclusion|author'?s note|acknowledg(?:e)?ments)$"
BARE_NUMBER = rf"(?iu)^(?:chapter(?U:\s+))?(?:(?U:\d+)|[ivxlc]+|(?:{NUMBER_WORDS}))\.?$"
DROP_TITLE = r"(?iu)^(index|bibliography|references|notes|endnotes|footnotes|copyright(?: page)?|table of contents|contents|title page|colophon|about the authors?|also by\b.*)$"
PAGE_NUMBER = r"(?iu)^(?:page(?U:\s+))?(?:(?U:\d){1,4}|[ivxlc]{1,6})(?:(?U:\s*)(?:of|/)(?U:\s*)(?U:\d){1,4})?$"
BULLETS = "•▪◦‣■□●○·"
BULLET = rf"^(?:[{BULLETS}]|(?U:\d){{1,2}}[.)])(?U:\s+)"
LEADING_BULLET = rf"^[{BULLETS}](?U:\s*)"
DOT_LEADER = r"(?U)(?:\.\s?){4,}\s*\d*\s*$"
SUPERSCRIPT = "(?<=[A-Za-z.,;:)”\"'’])[²³¹⁰-⁹]+"
FOOTNOTE_MARK = r"(?U)^[\d,*†‡§\s\-–]+$"
URL = r"(?U)(?:https?://|www\.)\S+"
CITATION = r"(?U)\[\d+(?:\s*[,–-]\s*\d+)*\]"
INVISIBLE = r"[\x{00AD}\x{200B}\x{200C}\x{200D}\x{2060}\x{FEFF}]"
PAGE_NUMBER_TRIM = " -–—•·|[]()"
CLOSERS = "\"”’')]»*"
SENTENCE_ENDS = ".?!…:"
FLOW_ENDS = ",;-–—"
BOOK_ID_SUFFIX = r"(?iu)(?U:\s*)--(?U:\s*)[a-f0-9]{32}(?U:\s*)--.*"
# End of fixed values.

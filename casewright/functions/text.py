"""Column functions over text.  Patterns use (?U) so that Java's classes are Unicode's, and (?d) so that only \\n ends a line."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the document format.
BOILERPLATE_TITLES = (
    "table of contents", "contents", "toc", "introduction", "intro", "revision history", "revisions", "document revision history",
    "change history", "version history", "document history", "record of changes", "list of figures", "list of tables", "appendix", "appendices",
)
APPENDIX_NUMBER = r"(?iU)^appendix\s+[a-z0-9]+\s*[.:]\s*"
LEADING_NUMBER = r"(?U)^\d+(?:\.\d+)*\.?\s*"
CHAPTER_NUMBER = r"(?iU)^(?:chapter|section|part)\s+\d+[.:]\s*"
APPENDIX_FORM = r"(?U)^appendix(\s+[a-z0-9]{1,8})?$"
APPENDIX_TOPIC = r"(?iU)^appendix(\s+[a-z0-9]{1,8})?\s*:"
SIGNAL = (
    r"(?iU)\b(expected\s+(results?|behaviors?|outcomes?)|procedure|precondition|test\s+cases?|verification|actual\s+result"
    r"|test\s+(objective|description|steps?)|given\s+when\s+then)\b"
)
STEP_MENTION = r"(?iU)\bsteps?\s*[:\d]"
STEP_LINE = r"(?mUd)^\s*(\d+|[a-z])[.)]\s+\S"
LABEL_LINE = r"(?imUd)^(expected|steps?|procedure|action|result)s?\s*:"
CASE_MENTION = r"(?iU)\bTC[-_]\d"
CASE_ID = r"(?iU)(?<![A-Za-z0-9])VZ_TC_[A-Za-z0-9_.-]+_\d+(?![A-Za-z0-9])"
TOC_LINE = r"(?Ud)\S.*\.{4,}\s*\d+\s*$"
HEADING = r"(?Ud)^(#{1,6})\s+(.*)$"
#: Unicode white space and the four separators below it.
SPACE = r"[\s\x1c-\x1f]"
SPACES = "".join(map(chr, [*range(0x09, 0x0E), *range(0x1C, 0x21), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
LINE_BREAKS = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"
TRUNCATED = "\n\n[... truncated for model context ...]"


def strip(x: Column) -> Column:
    """Without white space at the ends; reads no more than these ends."""
    return F.btrim(x, F.lit(SPACES))


def is_blank(x: Column) -> Column:
    """Whether nothing but white space is there; looks no further than the first other character."""
    return ~x.rlike(rf"(?U)[^{SPACE[1:-1]}]")


def heading_level(line: Column) -> Column:
    """1 to 6, or null where the line is no heading."""
    return F.nullif(F.length(F.regexp_extract(line, HEADING, 1)), F.lit(0))


def heading_title(line: Column) -> Column:
    """The stripped title, or null where the line is no heading."""
    return F.when(heading_level(line).isNotNull(), strip(F.regexp_extract(line, HEADING, 2)))


def normal_title(title: Column) -> Column:
    """A title without numbering, in lower case and single spaces."""
    x = strip(title)
    for pattern in (APPENDIX_NUMBER, LEADING_NUMBER, CHAPTER_NUMBER):
        x = F.regexp_replace(x, pattern, "")
    return F.lower(strip(F.regexp_replace(x, rf"(?U){SPACE}+", " ")))


def is_boilerplate(title: Column) -> Column:
    """Whether a heading of this title opens front or back matter."""
    n = normal_title(title)
    named = n.isin(*BOILERPLATE_TITLES) | n.startswith("toc ") | n.rlike(r"(?U)\btable of contents\b") | n.rlike(r"(?U)\b(revision|change|version)\s+history\b")
    return named | n.rlike(APPENDIX_FORM) | n.rlike(APPENDIX_TOPIC) | strip(title).rlike(APPENDIX_TOPIC)


def is_toc_line(line: Column) -> Column:
    """Dot leaders and a page number; pipes count as spaces.  The dots are looked for first, for the pattern backtracks."""
    return F.contains(line, F.lit("....")) & F.regexp_replace(line, r"\|", " ").rlike(TOC_LINE)


def suggests_cases(body: Column) -> Column:
    """Whether a section's body looks like test cases."""
    s = strip(body)
    piped = F.size(F.filter(F.split(s, "\n"), lambda x: F.contains(x, F.lit("|")))) >= 2
    found = reduce(Column.__or__, [s.rlike(p) for p in (SIGNAL, STEP_MENTION, STEP_LINE, LABEL_LINE, CASE_MENTION)])
    return F.when(s == "", False).otherwise(found | piped)


def case_id(title: Column) -> Column:
    """The first VZ_TC_ id in a title, or null."""
    return F.nullif(F.regexp_extract(title, CASE_ID, 0), F.lit(""))


def truncated(text: Column, most: int = 120_000) -> Column:
    return F.when(F.char_length(text) > most, F.concat(F.substring(text, 1, most), F.lit(TRUNCATED))).otherwise(text)


def ellipsis(text: Column, most: int = 220) -> Column:
    """One line of at most ``most`` characters, the last of them an ellipsis if it was cut."""
    s = strip(F.regexp_replace(F.coalesce(text, F.lit("")), "\n", " "))
    return F.when(F.char_length(s) > most, F.concat(F.substring(s, 1, most - 1), F.lit("…"))).otherwise(s)


def short_title(title: Column, most: int = 480) -> Column:
    return F.when(F.char_length(title) > most, F.concat(F.substring(title, 1, most - 3), F.lit("…"))).otherwise(title)


def strip_fence(text: Column) -> Column:
    """Without a code fence around the text: the first line goes, and the last if it is nothing but the fence."""
    s = strip(text)
    lines = F.split(s, "\n")
    rest = F.slice(lines, F.lit(2), F.size(lines) - 1)
    closed = F.size(rest).between(1, 1 << 30) & (strip(F.element_at(rest, -1)) == "```")
    inner = F.when(F.size(rest) == 0, F.lit("")).when(closed, F.array_join(F.slice(rest, F.lit(1), F.size(rest) - 1), "\n")).otherwise(F.array_join(rest, "\n"))
    return F.when(s.startswith("```"), strip(inner)).otherwise(s)


def cells(row: Column) -> Column:
    """The stripped cells of a pipe row that are not empty."""
    return F.filter(F.transform(F.split(row, r"\|"), strip), lambda c: c != "")


def pipe_rows(table: Column) -> Column:
    """An array of rows of cells as lines of cells parted by pipes."""
    cell = lambda c: strip(F.regexp_replace(F.coalesce(c, F.lit("")), "\n", " "))
    return F.array_join(F.transform(table, lambda r: F.array_join(F.transform(r, cell), " | ")), "\n")


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"[^/]*$", 0)


def extension(path: Column) -> Column:
    """The last dot and what follows, in lower case; empty without, and for names that only start with a dot."""
    return F.lower(F.regexp_extract(base_name(path), r"^\.*[^.].*?(\.[^.]*)$", 1))


def stem(path: Column) -> Column:
    name = base_name(path)
    return F.when(extension(path) == "", name).otherwise(F.regexp_replace(name, r"\.[^.]*$", ""))


def safe_stem(path: Column) -> Column:
    """A stem of letters, digits, _ - and . for saving; null for what is no docx or pdf, or no name."""
    name = base_name(F.coalesce(path, F.lit("")))
    clean = F.substring(F.btrim(F.regexp_replace(stem(name), r"(?U)[^\w\-.]+", "_"), F.lit("._-")), 1, 120)
    bad = (name == "") | F.contains(name, F.lit("..")) | (name == ".") | ~extension(name).isin(".docx", ".pdf")
    return F.when(~bad, F.when(clean == "", "document").otherwise(clean))


def redacted(headers: Column) -> Column:
    """A map of headers without the token of a bearer authorisation."""
    secret = lambda k, v: (F.lower(k) == "authorization") & F.lower(v).startswith("bearer ")
    return F.transform_values(headers, lambda k, v: F.when(secret(k, v), F.lit("Bearer <redacted>")).otherwise(v))


def is_retryable(error: Column) -> Column:
    """Whether a failed call is worth another try: an overloaded or unreachable server, or a time-out."""
    marks = ("HTTP error 429", "HTTP error 500", "HTTP error 502", "HTTP error 503", "HTTP error 504", "timed out", "Temporary failure", "Could not reach LLM server")
    return F.coalesce(reduce(Column.__or__, [F.contains(error, F.lit(m)) for m in marks]), F.lit(False))


def is_retryable_batch(error: Column) -> Column:
    """As :func:`is_retryable`, with request time-outs and broken JSON."""
    return is_retryable(error) | F.coalesce(F.contains(error, F.lit("HTTP error 408")) | F.contains(error, F.lit("not valid JSON")), F.lit(False))

import pytest
from pyspark.sql import functions as F

from casewright.functions import text as X


def column(spark, values, f, kind="string"):
    rows = spark.createDataFrame(list(enumerate(values)), f"i int, x {kind}")
    return [r[0] for r in rows.select(f(F.col("x")), "i").orderBy("i").collect()]


def test_strip(spark):
    assert column(spark, ["  a ", "  b\n\t", "\x1cc\x1f", "", None], X.strip) == ["a", "b", "c", "", None]


def test_headings(spark):
    lines = ["# A", "###### B ", "####### C", "#D", "#   ", "## ", "x # y", "# | Step | Expected"]
    assert column(spark, lines, X.heading_level) == [1, 6, None, None, 1, 2, None, 1]
    assert column(spark, lines, X.heading_title) == ["A", "B", None, None, "", "", None, "| Step | Expected"]


def test_normal_titles(spark):
    titles = ["3. Contents", "Appendix A: Glossary", "Chapter 1: TOC", "3D model", " 1.2.3.  The   Scope "]
    assert column(spark, titles, X.normal_title) == ["contents", "glossary", "toc", "d model", "the scope"]


@pytest.mark.parametrize(
    ("title", "expected"),
    [("3. Contents", True), ("Appendix A: X", True), ("Appendix A. Glossary", False), ("Appendix A - Glossary", False), ("Appendix glossary", True), ("Introduction and scope", False), ("Chapter 1: TOC", True), ("toc of all", True), ("The revision  history", True), ("", False), ("APPENDICES", True)],
)
def test_boilerplate(spark, title, expected):
    assert column(spark, [title], X.is_boilerplate) == [expected]


def test_toc_lines(spark):
    lines = ["Scope .... 3", "Scope ... 3", "a | b .....|12 ", "....5", "Step 1 ....... done", "x.... ٣"]
    assert column(spark, lines, X.is_toc_line) == [True, False, True, False, False, True]


def test_suggests_cases(spark):
    bodies = ["", "  \n", "Expected results follow", "preconditions", "precondition", "Steps: 1", "1. go", "A. go", "a) go", "Results :", "see tc-1", "a|b", "a|b\nc|d", "a|b\nc"]
    assert column(spark, bodies, X.suggests_cases) == [False, False, True, False, True, True, True, False, True, True, True, False, True, False]


def test_case_id(spark):
    titles = ["x VZ_TC_A_1 y", "vz_tc_a.b-c_22", "AVZ_TC_A_1", "VZ_TC_A_1b", "VZ_TC_A", None]
    assert column(spark, titles, X.case_id) == ["VZ_TC_A_1", "vz_tc_a.b-c_22", None, None, None, None]


def test_fences(spark):
    texts = ['{"a":1}', '```json\n{"a":1}\n```', '```\n{"a":1}', "```", "  ```x\ny\n``` ", "a ``` b", "```\n```"]
    assert column(spark, texts, X.strip_fence) == ['{"a":1}', '{"a":1}', '{"a":1}', "", "y", "a ``` b", ""]


def test_truncation_and_ellipsis(spark):
    assert column(spark, ["abc", "abcd"], lambda c: X.truncated(c, 3)) == ["abc", "abc" + X.TRUNCATED]
    assert column(spark, ["a\nb", "x" * 221, None], X.ellipsis) == ["a b", "x" * 219 + "…", ""]
    assert column(spark, ["x" * 481], X.short_title) == ["x" * 477 + "…"]


def test_names(spark):
    paths = ["/a/B c.PDF", "x.docx", ".docx", "a..b.pdf", "a.txt", None, "…?.pdf", "é-ü.docx"]
    assert column(spark, paths, X.safe_stem) == ["B_c", "x", None, None, None, None, "document", "é-ü"]


def test_cells_and_redaction(spark):
    assert column(spark, ["| a | | b|", "x"], X.cells) == [["a", "b"], ["x"]]
    got = column(spark, [{"Authorization": "bearer abc", "authorization": "Basic x", "Accept": "Bearer y"}], X.redacted, "map<string,string>")
    assert got == [{"Authorization": "Bearer <redacted>", "authorization": "Basic x", "Accept": "Bearer y"}]


def test_retryable(spark):
    errors = ["HTTP error 503: x", "HTTP error 408", "not valid JSON", "timed out", None]
    assert column(spark, errors, X.is_retryable) == [True, False, False, True, False]
    assert column(spark, errors, X.is_retryable_batch) == [True, True, True, True, False]


def test_strip_takes_all_white_space_of_the_ends_and_nothing_else(spark):
    chars = [chr(c) for c in [*range(0xD800), *range(0xE000, 0xFFFF)]]
    rows = spark.createDataFrame([(c, c + "a " + c) for c in chars], "c string, t string")
    space = F.col("c").rlike("(?U)^[\\s\\x1c-\\x1f]$")
    wrong = (X.is_blank(F.col("c")) != space) | (X.strip(F.col("t")) != F.when(space, "a").otherwise(F.col("t"))) | ((X.strip(F.col("c")) == "") != space)
    assert rows.where(wrong | wrong.isNull()).count() == 0

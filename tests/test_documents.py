import json
import random

import pytest
from pyspark.sql import functions as F

import model
from casewright.functions import text as X
from casewright.operators import merge, prep, replies, report, sections, template
from casewright.operators.lines import to_lines, with_headings
from casewright.plans import jobs
from casewright.sources import work

SAMPLE = """Sample Test Plan
# Table of Contents
Registration ........ 3
# Introduction
To be ignored
## Purpose
Ignored as well
# Test Cases
## User Registration TC_001_REGISTER
Checks sign-up.
Preconditions:
Database is up.
Applicability: All roles
# | Step | Expected Result
1 | open | shown

## User Logout TC_005_LOGOUT
Checks log-out.
Test Steps:
Step | Expected
1 | leave | left

# Appendix
Nothing"""


def docs(spark, *texts):
    return spark.createDataFrame([(i, f"f{i}.docx", t) for i, t in enumerate(texts)], "doc_id long, file_name string, doc_text string")


def test_prepared_sample(spark):
    row = prep.prepared(docs(spark, SAMPLE)).first()
    assert row.removed_titles == ["Table of Contents", "Introduction", "Appendix"]
    assert row.stripped and not row.fallback and row.chars_before == len(SAMPLE) and row.chars_after == len(row.prepared_text)
    assert row.prepared_text.startswith("Sample Test Plan\n# Test Cases\n") and "Ignored" not in row.prepared_text


def test_fallback_then_toc(spark):
    rows = {r.doc_id: r for r in prep.prepared(docs(spark, "# Contents\na .... 1", "", "# TOC\nx\n# Intro", "a .... 1")).collect()}
    assert rows[0].fallback and rows[0].prepared_text == "# Contents" and rows[0].removed_titles == ["Contents"]
    assert not rows[1].fallback and rows[1].prepared_text == ""
    assert rows[2].prepared_text == "# TOC\nx\n# Intro" and rows[2].removed_titles == ["TOC", "Intro"]
    assert rows[3].prepared_text == "" and not rows[3].stripped


def test_skipping_equals_the_model(spark):
    rnd = random.Random(7)
    kinds = ["x", "# A", "## B", "### C", "# Intro", "## TOC", "### Contents", "#### Appendix"]
    texts = ["\n".join(rnd.choice(kinds) for _ in range(rnd.randint(1, 14))) for _ in range(400)]
    got = {}
    for r in prep.mark_boilerplate(to_lines(docs(spark, *texts))).select("doc_id", "pos", "skipped").collect():
        got.setdefault(r.doc_id, {})[r.pos] = r.skipped
    for i, t in enumerate(texts):
        lines = [(len(x.split(" ")[0]) if x.startswith("#") else None, x.split(" ")[-1] in ("Intro", "TOC", "Contents", "Appendix")) for x in t.split("\n")]
        assert [got[i][p] for p in range(len(lines))] == model.skip(lines), t


def titles(rows):
    return [(r.title, r.body) for r in rows.orderBy("doc_id", "section_no").collect()]


def test_sections_by_heading(spark):
    cut = lambda text, *a, **k: titles(sections.by_headings(with_headings(to_lines(docs(spark, text))), *a, **k))
    assert cut("pre\n## A\na\n### B\nb\n# C\nc", "2") == [("(preamble)", "pre"), ("A", "a\n### B\nb\n# C\nc")]
    assert cut("no heading\r\nhere ") == [("(preamble)", "no heading\r\nhere")]
    assert cut("#   \n\n# \nbody\n# T\n", "1") == [("(preamble)", "body"), ("T", "")]
    assert cut("## A\n# | Step | Expected\n1 | x") == [("(preamble)", "## A"), ("| Step | Expected", "1 | x")]
    assert cut("## A\n# | Step | Expected\n1 | x", ignore_table_headings=True) == [("A", "# | Step | Expected\n1 | x")]
    assert cut("####### x\n###### y\nz") == [("(preamble)", "####### x"), ("y", "z")]
    with pytest.raises(ValueError, match="Invalid heading level"):
        cut("x", "7")


def test_sections_by_pattern(spark):
    patterns = sections.pattern_hints(spark, "# comment\n\n  ^TC-\\d+ \n")
    assert patterns == ["^TC-\\d+"]
    lines = to_lines(docs(spark, "a\n  TC-1 x\nb\n\nTC-2" + "y" * 900, "nothing"))
    got = titles(sections.by_patterns(lines, patterns))
    assert got[:2] == [("(preamble)", "a"), ("TC-1 x", "b")] and len(got[2][0]) == 800 and got[3] == ("(preamble)", "nothing")
    assert [r.doc_id for r in sections.unmatched_documents(lines, patterns).collect()] == [1]
    with pytest.raises(ValueError, match="Invalid section regex"):
        sections.pattern_hints(spark, "(")


def test_actions_plan_and_placeholders(spark):
    text = "# VZ_TC_A_1\n# Story\nonce\n# Case\nSteps: 1\n# Empty"
    cut = sections.with_action(sections.by_headings(with_headings(to_lines(docs(spark, text)))))
    assert [r.action for r in cut.orderBy("section_no").collect()] == ["placeholder", "skip", "extract", "drop"]
    plan = sections.section_plan(cut).first()
    assert (plan.n_extract, plan.n_skip, plan.n_placeholder, plan.n_drop) == (1, 1, 1, 1) and plan.skipped_titles == ["Story"]
    row = sections.placeholder_cases(cut.join(docs(spark, text), "doc_id")).first()
    assert (row.test_id, row.test_name, row.case_no) == ("VZ_TC_A_1", "VZ_TC_A_1", 0) and row.description == sections.EMPTY_SECTION


def test_template_sample(spark):
    rows = template.template_cases(docs(spark, SAMPLE, "no ids\n## Heading")).orderBy("section_no").collect()
    assert [(r.test_id, r.test_name, r.template) for r in rows] == [("TC_001_REGISTER", "User Registration", "Underscore-ID Test Plan"), ("TC_005_LOGOUT", "User Logout", "Underscore-ID Test Plan")]
    assert rows[0].description == "Checks sign-up." and rows[0].preconditions == "Database is up.\nApplicability: All roles"
    assert rows[0].steps_expected == "# | Step | Expected Result\n1 | open | shown" and rows[1].steps_expected == "Step | Expected\n1 | leave | left"
    assert [r.template for r in template.with_template(docs(spark, "## a\n", "## X A_1 ", "### X A_1", "x\r## B C_2")).orderBy("doc_id").collect()] == [None, template.UNDERSCORE.name, None, template.UNDERSCORE.name]


def test_template_equals_the_model(spark):
    rnd = random.Random(3)
    kinds = ["", "text", "Preconditions", "Steps:", "a | b", "Step | Result", "1 | x | y", " | ", "more text"]
    bodies = [[rnd.choice(kinds) for _ in range(rnd.randint(0, 12))] for _ in range(300)]
    got = {r.doc_id: r for r in template.underscore_cases(docs(spark, *("\n".join(["## T A_1", *b]) for b in bodies))).collect()}
    for i, b in enumerate(bodies):
        assert (got[i].description, got[i].preconditions, got[i].steps_expected) == model.section(b), b


def cases(spark, rows):
    return spark.createDataFrame([(0, n, i, t, t, t, t) for n, (i, t) in enumerate(rows)], "doc_id int, n int, test_id string, description string, preconditions string, procedure_steps string, expected_results string")


def test_merging_equals_the_model(spark):
    rnd = random.Random(5)
    for _ in range(5):
        rows = [(rnd.choice(["A", "B", ""]), rnd.choice(["x", " ", "", "y\n"])) for _ in range(30)]
        got = merge.merge_runs(cases(spark, rows), ["doc_id"], ["n"]).orderBy("n").collect()
        assert [(r.test_id, r.description) for r in got] == model.merge(rows) and sum(r.run_rows for r in got) == 30


def test_merging_over_ranges_equals_the_model(spark):
    rnd = random.Random(6)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        for ids in (["A", "B", ""], ["A"], ["A"] * 60 + ["B"], ["A", None]):  # runs of a few rows, and over several ranges
            rows = [(rnd.choice(ids), rnd.choice(["x", " ", "", "y\n"])) for _ in range(300)]
            got = merge.merge_runs_in_ranges(cases(spark, rows).repartition(3), ["doc_id"], ["n"])
            plain = sorted(model.merge(rows), key=lambda r: r[0] or "")
            told = got.orderBy("n").collect()
            assert [(r.test_id, r.description) for r in told] == model.merge(rows) and sum(r.run_rows for r in told) == 300, plain
            flagged = merge.flag_scattered_in_ranges(got, ["doc_id"], 300).orderBy("n").collect()
            assert [tuple(r) for r in flagged] == [tuple(r) for r in merge.flag_scattered(got, ["doc_id"], ["n"]).orderBy("n").collect()]
        two = cases(spark, rows).unionByName(cases(spark, rows).withColumn("doc_id", F.lit(None).cast("int")))
        assert merge.merge_runs_in_ranges(two, ["doc_id"], ["n"]).count() == 2 * len(told)
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_warnings_need_no_texts_and_tasks_follow_the_rows(spark, monkeypatch):
    rnd = random.Random(8)
    rows = cases(spark, [(rnd.choice(["A", "B", "", None]), "x") for _ in range(300)]).withColumn("doc_id", F.col("n") % 9)
    told = lambda df: sorted((r.doc_id, r.test_id, r.n_rows, r.first.n) for r in merge.scattered_warnings(df, ["doc_id"], ["n"]).collect())
    starts = merge.run_starts(rows, ["doc_id"], ["n"], 7)
    assert starts.columns == ["doc_id", "n", "test_id"] and "hashpartitioning(doc_id#" in (plan := starts._jdf.queryExecution().toString()) and ", 7)" in plan
    assert told(starts) == told(merge.merge_runs(rows, ["doc_id"], ["n"])) == told(merge.merge_runs(rows, ["doc_id"], ["n"], tasks=5)) != []
    monkeypatch.setattr(work, "TASK_ROWS", 10)
    assert work.tasks_for(rows) == 31 and work.tasks_for(rows.limit(0)) == spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("batch", [1, 7, 10_000])
def test_merging_in_ranges_over_arrow_batches(spark, batch):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rnd = random.Random(batch)
        rows = [("A" if 40 < i < 90 else rnd.choice(["A", "B", "", None]), rnd.choice(["x", " ", "", "y\n", "\u2003", "ü"])) for i in range(150)]
        scoped = cases(spark, rows).withColumn("doc_id", F.when(F.col("n") > 20, F.col("n").cast("int") / 50).cast("int"))
        scoped = scoped.withColumns({"preconditions": F.nullif("preconditions", F.lit("x")), "more": F.array("n")})
        got, plain = (sorted(map(tuple, df.select(sorted(df.columns)).collect()), key=repr) for df in (merge.merge_runs_in_ranges(scoped, ["doc_id"], ["n"]), merge.merge_runs(scoped, ["doc_id"], ["n"])))
        assert got == plain and len(got) < 120
        placed = []
        merge.merge_runs_in_ranges(scoped, ["doc_id"], ["n"], keep=lambda df: placed.append(df) or work.kept(df))
        assert "MapInArrow" in placed[0]._jdf.queryExecution().executedPlan().toString() and "Window" not in placed[0]._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_jobs_over_a_request_and_whole_documents(spark):
    two = docs(spark, "## Case TC_1_A\nfirst\nSteps:\n1 | go", "## Case TC_1_A\nsecond\nSteps:\n2 | stop\n## Case TC_2_B\nlast\nSteps:\n3 | x")
    assert jobs.by_template(two).cases.count() == 3
    got = jobs.by_template(two, request=True).cases.orderBy("doc_id", "section_no").collect()
    assert [(r.test_id, r.description, r.run_rows) for r in got] == [("TC_1_A", "first\nsecond", 2), ("TC_2_B", "last", 1)]

    def caller(payloads):
        return [json.dumps({"test_cases": [{"test_id": "X", "description": str("Section: " in p)}]}) for p in payloads]

    got = jobs.by_model(two.unionByName(docs(spark, " ").withColumn("doc_id", F.lit(9))), caller, "m", whole=True)
    assert [(r.doc_id, r.section_no, r.test_id, r.description) for r in got.cases.orderBy("doc_id").collect()] == [(r.doc_id, 0, "X", "False") for r in two.orderBy("doc_id").collect()]


def test_scattered(spark):
    merged = merge.merge_runs(cases(spark, [("A", "1"), ("A", "2"), ("B", "3"), ("A", "4"), ("", "5"), ("", "6")]), ["doc_id"], ["n"])
    got = {r.n: r.description for r in merge.flag_scattered(merged, ["doc_id"], ["n"]).collect()}
    assert got == {0: merge.NOTE + "A\n\n1\n2", 2: "3", 3: merge.NOTE + "A\n\n4", 4: "5", 5: "6"}
    warned = merge.scattered_warnings(merged, ["doc_id"], ["n"]).collect()
    assert [(w.test_id, w.n_rows, w.first.n) for w in warned] == [("A", 2, 0)]


def test_template_job(spark):
    text = SAMPLE.replace("TC_005_LOGOUT", "TC_001_REGISTER")
    got = jobs.by_template(docs(spark, text)).cases.collect()
    assert len(got) == 1 and got[0].run_rows == 2 and got[0].description == "Checks sign-up.\nChecks log-out." and got[0].expected_results == ""


def test_model_job(spark):
    asked = []

    def caller(payloads):
        import json

        if any("boom" in p for p in payloads):
            raise RuntimeError("HTTP error 503")
        return ['```json\n{"test_cases":[{"test_id":"T","description":%s}]}\n```' % len(json.loads(p)["messages"]) for p in payloads]

    text = "# One\nSteps: 1\n# VZ_TC_Z_9\n# Two\nSteps: boom\n# Three\nSteps: 3"
    got = jobs.by_model(docs(spark, text), caller, "m", keep=lambda df: df.cache())
    rows = sorted((r.section_no, r.test_id, r.description) for r in got.cases.collect())
    assert rows[0][:2] == (1, "T") and rows[1][:2] == (2, "VZ_TC_Z_9") and rows[2][:2] == (4, "T") and rows[0][2].startswith(merge.NOTE)
    errors = got.errors.collect()
    assert [(e.section_no, e.message) for e in errors] == [(3, 'Section "Two": HTTP error 503')] and not asked


def test_a_model_job_asks_once_for_all_its_tables(spark, tmp_path):
    def caller(payloads):
        with open(tmp_path / "asked", "a") as f:
            f.writelines("asked\n" for _ in payloads)
        return ['{"test_cases":[{"test_id":"T"}]}' for _ in payloads]

    got = jobs.by_model(docs(spark, "# One\nSteps: 1\n# Two\nSteps: 2"), caller, "m")
    assert (got.cases.count(), got.raw.count(), got.errors.count(), got.details.count()) == (1, 2, 0, 1)  # both have one id, side by side
    assert (tmp_path / "asked").read_text() == "asked\n" * 2


def parsed(spark, *contents):
    rows = spark.createDataFrame([(0, i, c, None) for i, c in enumerate(contents)], "doc_id int, section_no int, content string, error string")
    return {r.section_no: r for r in replies.with_cases(rows).collect()}


def test_parsing(spark):
    got = parsed(spark, '{"test_cases":[{"test_id":null,"test_name":1.0,"description":true,"preconditions":["a",{"b":"é"}],"file_name":" "},3]}', "", "[1]", "{", '{"a":1}', '{"test_cases":{}}', '{"test_cases":[],"test_cases":[{"test_id":"b"}]}', None)
    assert got[0].error is None and got[0].cases[0].asDict() == {"file_name": "", "test_id": "", "test_name": "1.0", "description": "True", "preconditions": '["a", {"b": "é"}]', "procedure_steps": "", "expected_results": ""}
    assert [got[i].error for i in (1, 2, 4, 5, 7)] == [replies.EMPTY, replies.NOT_OBJECT, replies.NO_CASES, replies.NOT_ARRAY, replies.EMPTY] and got[3].error.startswith(replies.INVALID)
    assert got[6].cases[0].test_id == "b"


def test_no_reply_stops_the_job(spark):
    deep = parsed(spark, "[" * 200_000, '{"test_cases":[{"test_id":"a\\ud800b","description":["\\udfff"],"test_name":"\\ud83d\\ude00"}]}', '{"test_cases":[{"test_id":' + "9" * 5000 + "}]}", "\x00")
    assert all(deep[i].error.startswith(replies.INVALID) for i in (0, 2, 3))
    assert (deep[1].cases[0].test_id, deep[1].cases[0].description, deep[1].cases[0].test_name) == ("a?b", '["?"]', "😀")


def test_calls_that_give_exceptions(spark):
    asked = spark.createDataFrame([(0, i, f"p{i}") for i in range(6)], "doc_id int, section_no int, payload string")
    caller = lambda payloads: [ValueError("HTTP error 429") if p == "p3" else p.upper() for p in payloads]
    got = {r.section_no: (r.content, r.error) for r in replies.call(asked, caller, 2).collect()}
    assert got == {i: (f"P{i}", None) for i in (0, 1, 2, 4, 5)} | {3: (None, "HTTP error 429")}


def test_replies_without_choices(spark):
    rows = spark.createDataFrame([(0, '{"choices":[]}'), (1, "{}"), (2, '{"choices":[{"message":{"content":" x "}}]}'), (3, '{"choices":[{"message":{}}]}')], "i int, reply string")
    got = {r.i: (r.content, r.error) for r in rows.select("i", replies.completion_content(F.col("reply")).alias("content"), replies.completion_error(F.col("reply")).alias("error")).collect()}
    assert got == {0: ("", replies.NO_CHOICES), 1: ("", replies.NO_CHOICES), 2: ("x", None), 3: ("", None)}


def test_null_documents_are_empty_ones(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "# A\nx")], "doc_id int, doc_text string")
    assert {r.doc_id: (r.prepared_text, r.chars_before) for r in prep.prepared(rows).collect()} == {1: ("", 0), 2: ("", 0), 3: ("# A\nx", 5)}
    assert {r.doc_id for r in prep.prepared_lines(rows).collect()} == {1, 2, 3} == {r.doc_id for r in sections.shallowest_level(with_headings(to_lines(rows))).collect()}


def test_details_by_section(spark):
    text = "# Introduction\nno\n# One\nSteps: 1\n# VZ_TC_Z_9\n# Two\nSteps: boom"
    caller = lambda payloads: [ValueError("x") if "boom" in p else '{"test_cases":[]}' for p in payloads]
    rows = docs(spark, text, "# Contents\nonly")
    got = jobs.by_model(rows, caller, "m", keep=lambda df: df.cache())
    told = {r.doc_id: r for r in got.details.collect()}
    assert (told[0].section_calls, told[0].placeholders, told[0].removed_headings, told[0].prep_fallback, told[0].truncated) == (2, 1, ["Introduction"], False, False)
    assert told[0].doc_chars == len(text) - len("# Introduction\nno\n") and (told[1].section_calls, told[1].prep_fallback) == (0, True)


def test_streamed_replies(spark):
    lines = ["data: {\"choices\":[{\"delta\":{\"content\":\"a\"}},{\"message\":{\"content\":\"b\"}}]}", ": ping", "", "data: nonsense", 'data: {"choices":[{"delta":{"content":null}}]}', 'data:  {"choices":[{"delta":{"content":"c"}}]} ', "data: [DONE]", 'data: {"choices":[{"delta":{"content":"late"}}]}']
    rows = spark.createDataFrame([("r", i, x) for i, x in enumerate(lines)] + [("empty", 0, "event: x")], "request_id string, seq int, line string")
    assert {r.request_id: r.content for r in replies.assembled(rows).collect()} == {"r": "abc", "empty": ""}


def test_requests(spark):
    import json

    chunk = spark.createDataFrame([(0, 1, "f.docx", "T", "body"), (0, 2, "f.docx", None, "long body")], "doc_id int, section_no int, file_name string, title string, body string")
    rows = replies.requests(chunk, "m", " hint ", most=5).orderBy("section_no").collect()
    first = json.loads(rows[0].payload)
    assert first["messages"][1]["content"] == "Filename: f.docx\nSection: T\n\nUser hints about identifiers / section titles (from human): hint\n\n--- Document text ---\n\nbody"
    assert first["temperature"] == 0.2 and first["response_format"] == {"type": "json_object"} and not rows[0].truncated
    assert rows[1].truncated and rows[1].doc_char_count == 9 and json.loads(rows[1].payload)["messages"][1]["content"].endswith("long " + X.TRUNCATED)


def test_reports(spark):
    inputs = spark.createDataFrame([(0, "a", "T", None, None), (1, "b", None, "no_template", "x"), (2, "c", "T", None, None), (3, "d", "T", None, None)], "doc_id int, file_name string, template string, reason string, detail string")
    rows = spark.createDataFrame([(0,), (0,), (3,)], "doc_id int")
    errors = spark.createDataFrame([(2, 1, "late"), (2, 0, "early")], "doc_id int, section_no int, message string")
    results = report.file_results(inputs, rows, errors)
    got = {r.doc_id: (r.n_rows, r.ok, r.reason, r.detail) for r in results.collect()}
    assert got == {0: (2, True, None, None), 1: (0, False, "no_template", "x"), 2: (0, False, "llm_error", "early"), 3: (1, True, None, None)}
    status = report.with_status(results.withColumn("exists", F.col("doc_id") == 3))
    assert report.batch_summary(status).first().asDict() == {"written": 1, "skipped": 1, "not_written": 0, "failures": 2}
    with pytest.raises(RuntimeError, match="2 documents failed"):
        report.batch_summary(status, strict=True)
    assert {r.phase for r in report.failure_records(status).collect()} == {"extract"}

import json
import random

from pyspark.sql import functions as F

import model
from casewright.functions import schemas
from casewright.sources import files, pages, sinks, word
from casewright.streaming import events
from tests_docx import docx, p, tc

NESTED = f"<w:tbl><w:tr>{tc(p('x'))}{tc(p('y'))}</w:tr><w:tr>{tc(p('z'))}</w:tr></w:tbl>"
BODY = (
    p("Plan", "T") + p("Login TC_1_A", "H2") + p("  ") + p("Checks.<w:tab/>")
    + f"<w:tbl><w:tr>{tc(p('Step'))}{tc(p('Result'), '<w:gridSpan w:val=\"2\"/>')}</w:tr><w:tr>{tc(p('1') + p('go') + NESTED)}{tc(p('m'), '<w:vMerge w:val=\"restart\"/>')}{tc(p(''))}</w:tr><w:tr>{tc(p('2'))}{tc(p(''), '<w:vMerge/>')}{tc(p('k'))}</w:tr></w:tbl>"
    + p("End")
)


def test_word(spark, tmp_path):
    (tmp_path / "A.DOCX").write_bytes(docx(BODY))
    (tmp_path / "bad.docx").write_bytes(b"no zip")
    (tmp_path / "c.txt").write_bytes(b"x")
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "d.pdf").write_bytes(b"y")
    found = files.discover(spark, str(tmp_path))
    assert [r.path.rsplit("/", 1)[1] for r in files.in_order(found).orderBy("doc_ord").collect()] == ["A.DOCX", "bad.docx"]
    assert files.discover(spark, str(tmp_path), recursive=True).count() == 3
    got = {r.path.rsplit("/", 1)[1]: r for r in word.word_texts(word.word_blocks(found)).collect()}
    assert got["A.DOCX"].doc_text == "Plan\n## Login TC_1_A\nChecks.\nStep | Result | Result\n1 go x | y; z | m | \n2 | m | k\n\nEnd" and got["A.DOCX"].error is None
    assert "BadZipFile" in got["bad.docx"].error


def test_admission(spark):
    rows = spark.createDataFrame([("/i/a.PDF", 1), ("/i/b.docx", (50 << 20) + 1), ("/i/c.txt", 1), ("/i/d", 1)], "path string, length long")
    got = files.admitted(rows).orderBy("path").collect()
    assert [(r.kind, r.reason) for r in got] == [("ok", None), ("bad", "exception"), ("bad", "unsupported"), ("bad", "unsupported")]


def test_output_names(spark):
    rows = spark.createDataFrame([("/i/a.pdf",), ("/i/a.DOCX",), ("/i/b",)], "path string")
    named = rows.withColumn("out_name", files.output_name(F.col("path")))
    assert sorted(r.out_name for r in named.collect()) == ["a.xlsx", "a.xlsx", "b.xlsx"] and files.collisions(named).count() == 2
    assert sorted(r[0] for r in rows.select(files.output_name(F.col("path"), True)).collect()) == ["a_docx.xlsx", "a_pdf.xlsx", "b_bin.xlsx"]
    done = spark.createDataFrame([("a.xlsx",)], "out_name string")
    assert files.not_done(named, done).count() == 1 and files.not_done(named, done, force=True).count() == 3


def test_pages(spark):
    rows = [(1, 0, 9.001, 0.0, 1, "text", " low ", None), (1, 0, 9.0, 1.0, 2, "text", "right", None), (1, 0, 1.0, 0.0, 3, "table", None, [["a", None], ["b\nc", " d "]]), (1, 1, 0.0, 0.0, 1, "text", "  ", None), (1, 2, 0.0, 0.0, 1, "text", "last", None)]
    blocks = spark.createDataFrame(rows, "doc_id long, page int, top double, left double, block_no int, kind string, text string, cells array<array<string>>")
    assert pages.page_documents(blocks).first().doc_text == "a | \nb c | d\n\nlow\nright\n\nlast"


def case_rows(spark, *names):
    rows = [(n, 0, 1, i, *(f"{c}{i}" for c in schemas.CASE_FIELDS[:-1]), None) for i, n in enumerate(names)]
    return spark.createDataFrame(rows, "out_name string, doc_ord int, section_no int, case_no int, " + ", ".join(f"{c} string" for c in schemas.CASE_FIELDS))


def test_outputs_replace_only_their_own(spark, tmp_path):
    path = str(tmp_path / "out")
    sinks.write_outputs(case_rows(spark, "a.xlsx", "a.xlsx", "b.xlsx"), path)
    sinks.write_outputs(case_rows(spark, "a.xlsx"), path)
    got = spark.read.option("header", "true").csv(path)
    assert sorted(r.out_name for r in got.collect()) == ["a.xlsx", "b.xlsx"] and set(schemas.LABELS.values()) < set(got.columns)


def test_logs_append(spark, tmp_path):
    path = str(tmp_path / "log")
    calls = spark.createDataFrame([({"Authorization": "Bearer secret"}, 3)], "headers map<string,string>, rows int")
    for _ in range(2):
        sinks.append_json(sinks.audit_rows(calls), path)
    got = spark.read.json(path).collect()
    assert len(got) == 2 and got[0].headers.Authorization == "Bearer <redacted>" and got[0].time_utc.endswith("Z")


FEED = [
    {"job_id": "two", "seq": 1, "type": "result", "template": "x"}, {"job_id": "two", "seq": 2, "type": "result", "template": "y"},
    {"job_id": "late", "seq": 1, "type": "result", "template": "x"}, {"job_id": "late", "seq": 2, "type": "error", "message": "m"}, {"job_id": "late", "seq": 3, "type": "error", "message": "n"},
    {"job_id": "none", "seq": 1, "type": "progress", "data": {"step": "llm_section_done", "cumulative_rows": 4}}, {"job_id": "none", "seq": 2, "type": "odd"}, {"job_id": "bare", "seq": 1, "type": "error"},
]


def write_feed(path, rows):
    path.mkdir(exist_ok=True)
    (path / f"{len(list(path.iterdir()))}.json").write_text("\n\n".join(json.dumps(r) for r in rows))


def folded(rows):
    return {r.job_id: (r.status, r.message, r.result and r.result.template) for r in rows}


EXPECTED = {"two": ("done", None, "y"), "late": ("failed", "m", None), "none": ("incomplete", events.INCOMPLETE, None), "bare": ("failed", events.FAILED, None)}


def test_fold_batch_and_progress(spark, tmp_path):
    write_feed(tmp_path / "feed", FEED)
    feed = events.read_events(spark, str(tmp_path / "feed"))
    assert folded(events.fold_jobs(feed).collect()) == EXPECTED
    got = events.job_progress(feed).collect()
    assert [(r.job_id, r.sections_done, r.sections_failed, r.cumulative_rows) for r in got] == [("none", 1, 0, 4)]


def test_fold_stream(spark, tmp_path):
    seen = {}

    def sink(batch, _):
        seen.update(folded(batch.collect()))

    for half in (FEED[::2], FEED[1::2]):
        write_feed(tmp_path / "feed", half)
        events.run_available(events.fold_jobs(events.stream_events(spark, str(tmp_path / "feed"))), sink, str(tmp_path / "state"))
    assert seen == EXPECTED


def test_new_files_only(spark, tmp_path):
    folder, seen = tmp_path / "in", []
    folder.mkdir()
    for name in ("a.docx", "b.PDF"):
        (folder / name).write_bytes(b"x")
        events.extract_new_files(spark, str(folder), lambda batch: seen.append(sorted(r.path.rsplit("/", 1)[1] for r in batch.collect())), str(tmp_path / "state"))
    assert [n for n in seen if n] == [["a.docx"], ["b.PDF"]]


def test_order_of_all_files_by_ranges(spark):
    paths = [f"/p/{i * 7919 % 500:03}.docx" for i in range(500)]
    rows = spark.createDataFrame([(p,) for p in paths], "path string").repartition(7)
    got = {r.path: r.doc_ord for r in files.in_order(rows).collect()}
    assert got == {p: i + 1 for i, p in enumerate(sorted(paths))}
    assert files.in_order(rows.limit(0)).collect() == []


def test_texts_that_were_extracted_before(spark, tmp_path):
    (tmp_path / "a.txt").write_text("# A\nb é\n", "utf-8")
    (tmp_path / "b.txt").write_text("one line")
    got = {r.path.rsplit("/", 1)[1]: r.doc_text for r in files.read_texts(spark, str(tmp_path)).collect()}
    assert got == {"a.txt": "# A\nb é\n", "b.txt": "one line"}


def test_pages_equal_the_model(spark):
    rnd = random.Random(7)
    rows, expected = [], {}
    for doc in range(40):
        blocks = []
        for n in range(rnd.randint(1, 12)):
            what = [[rnd.choice(["a", " b ", None, "c\nd"]) for _ in range(2)] for _ in range(rnd.randint(1, 2))] if rnd.random() < 0.3 else rnd.choice(["word", " two words ", "  ", "\n", "x\ny"])
            blocks.append((rnd.randint(0, 2), rnd.choice([0.0, 1.004, 1.001, 7.5]), rnd.choice([0.0, 2.5]), n, what))
        expected[doc] = model.pages(blocks)
        rows += [(doc, p, t, x, n, "table" if isinstance(w, list) else "text", None if isinstance(w, list) else w, w if isinstance(w, list) else None) for p, t, x, n, w in blocks]
    df = spark.createDataFrame(rows, "doc_id long, page int, top double, left double, block_no int, kind string, text string, cells array<array<string>>")
    got = {r.doc_id: r.doc_text for r in pages.page_documents(df).collect()}
    assert got == {d: t for d, t in expected.items() if t}

import json
import os

import pytest

from casewright.plans import batch
from casewright.plans.batch import Options, run_folder
from casewright.sources import clustered
from casewright.sources.commits import committed, latest
from tests_docx import docx, p


def plan(folder, name, *cases):
    body = "".join(p(f"Case {c}", "H2") + p("Told.") + p("Steps:") + p("1 | go") for c in cases)
    (folder / name).write_bytes(docx(body))


def test_folder_with_templates(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    plan(source, "a.docx", "TC_1_A", "TC_1_A", "TC_2_B")
    (source / "bad.docx").write_bytes(b"no zip")
    (source / "c.pdf").write_bytes(b"%PDF")
    (source / "d.docx").write_bytes(docx(p("no ids here")))
    (source / "e.docx").write_bytes(docx(p("  ")))
    first = run_folder(spark, str(source), out).first().asDict()
    assert first == {"written": 1, "skipped": 0, "not_written": 0, "failures": 4}
    rows = spark.read.option("header", "true").option("multiLine", "true").csv(f"{out}/rows").collect()
    assert [(r["Test ID"], r["Description"], r["Procedure / steps"], r.out_name) for r in rows] == [("TC_1_A", "Told.\nTold.", "1 | go\n1 | go", "a.xlsx"), ("TC_2_B", "Told.", "1 | go", "a.xlsx")]
    failed = {r.file: (r.phase, r.reason) for r in committed(spark, out, "failures").collect()}
    assert failed == {"bad.docx": ("unexpected", "exception"), "c.pdf": ("extract", "unsupported"), "d.docx": ("extract", "no_template"), "e.docx": ("extract", "empty_text")}
    plan(source, "f.docx", "TC_9_Z")
    again = run_folder(spark, str(source), out).first().asDict()
    assert again == {"written": 1, "skipped": 1, "not_written": 0, "failures": 4}
    assert spark.read.option("header", "true").csv(f"{out}/rows").select("out_name").distinct().count() == 2
    with pytest.raises(RuntimeError, match="4 documents failed"):
        run_folder(spark, str(source), out, Options(strict=True, force=True))


def test_folder_with_a_model(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    plan(source, "a.docx", "TC_1_A", "TC_2_B")

    def caller(payloads):
        said = [json.loads(x)["messages"][1]["content"] for x in payloads]
        return [json.dumps({"test_cases": [{"test_id": s.split("Case ")[1].split()[0]}]}) for s in said]

    got = run_folder(spark, str(source), out, Options(caller=caller, model="m", level="2")).first()
    assert got.written == 1 and got.failures == 0
    rows = spark.read.option("header", "true").csv(f"{out}/rows").collect()
    assert sorted(r["Test ID"] for r in rows) == ["TC_1_A", "TC_2_B"] and {r["File Name"] for r in rows} == {"a.docx"}
    told = committed(spark, out, "results").first()
    assert (told.n_rows, told.section_calls, told.placeholders, told.truncated, told.prep_fallback, told.status) == (2, 2, 0, False, False, "written")


def rows_of(spark, out):
    return sorted((r.out_name, r["Test ID"], r["File Name"]) for r in spark.read.option("header", "true").option("multiLine", "true").csv(f"{out}/rows").collect())


def test_outputs_of_one_name(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    for folder in ("w", "x", "y"):
        (source / folder).mkdir(parents=True)
    (source / "w" / "a.docx").write_bytes(b"no zip")
    plan(source / "x", "a.docx", "TC_1_A", "TC_2_A")
    plan(source / "y", "a.docx", "TC_1_B", "TC_2_B")
    plan(source / "y", "b.docx", "TC_3_B")
    got = run_folder(spark, str(source), out, Options(recursive=True)).first().asDict()
    assert got == {"written": 2, "skipped": 1, "not_written": 0, "failures": 1}
    assert rows_of(spark, out) == [("a.xlsx", "TC_1_A", "a.docx"), ("a.xlsx", "TC_2_A", "a.docx"), ("b.xlsx", "TC_3_B", "b.docx")]
    read = [x.read_text() for x in (tmp_path / "out" / "rows" / "out_name=a.xlsx").iterdir() if x.name.startswith("part")]
    assert len(read) == 1 and read[0].index("TC_1_A") < read[0].index("TC_2_A")
    assert sorted((r.file, r.phase, r.reason) for r in committed(spark, out, "failures").collect()) == [("a.docx", "output", "name_taken"), ("a.docx", "unexpected", "exception")]
    again = run_folder(spark, str(source), out, Options(recursive=True)).first().asDict()
    assert again == {"written": 0, "skipped": 4, "not_written": 0, "failures": 0}


def untouched(path):
    """Sets back when a file was last read; any read shows where the file system tells."""
    os.utime(path, (0, 1))


def was_read(path):
    return os.stat(path).st_atime > 0


def test_resume_opens_only_what_is_new(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    plan(source, "a.docx", "TC_1_A")
    plan(source, "b %20 é.docx", "TC_2_B")
    untouched(source / "a.docx")
    run_folder(spark, str(source), out)
    if not was_read(source / "a.docx"):
        pytest.skip("this file system does not tell when files are read")
    plan(source, "c.docx", "TC_3_C")
    for f in source.iterdir():
        untouched(f)
    assert run_folder(spark, str(source), out).first().asDict() == {"written": 1, "skipped": 2, "not_written": 0, "failures": 0}
    assert sorted(f.name for f in source.iterdir() if was_read(f)) == ["c.docx"]
    assert run_folder(spark, str(source), out).first().asDict() == {"written": 0, "skipped": 3, "not_written": 0, "failures": 0}


def test_bins_and_numbers_by_path(spark, tmp_path, monkeypatch):
    from casewright.sources import listed

    monkeypatch.setattr(listed, "TASK_BYTES", 10 << 20)
    rows = [(f"/p/{i * 7919 % 200:03}.docx", 4 << 20) for i in range(200)]
    got = sorted(listed.numbered(spark.createDataFrame(rows, "path string, length long").repartition(3)).collect(), key=lambda r: r.path)
    assert [r.doc_ord for r in got] == list(range(1, 201)) and [r.bin for r in got] == [i * 5 // 10 for i in range(200)]


def test_stream_of_new_word_files(spark, tmp_path):
    from casewright.sources import word
    from casewright.sources.listed import stream_word_blocks
    from casewright.streaming.events import run_available

    source, seen = tmp_path / "in", []
    (source / "sub").mkdir(parents=True)
    for name in ("a.docx", "b.DOCX", "c.txt", "sub/d.docx"):
        plan(source, name, "TC_1_A")
        (source / "_hidden.docx").write_bytes(b"x")
        blocks = stream_word_blocks(spark, str(source), str(tmp_path / "log"), recursive=True)
        run_available(blocks, lambda batch, _: seen.append({r.path.rsplit("/", 1)[1]: r.doc_text.count("\n") for r in word.word_texts(batch).collect()}), str(tmp_path / "state"), "append")
    assert [x for x in seen if x] == [{"a.docx": 3}, {"b.DOCX": 3}, {"d.docx": 3}]


def test_pdf_files_given_as_blocks(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for name in ("a.pdf", "b.pdf", "c.pdf"):
        (source / name).write_bytes(b"%PDF")
    rows = [(f"file:{source}/a.pdf", 0, float(i), 0.0, i, "text", t, None) for i, t in enumerate(["## Case TC_1_A", "Told.", "Steps:"])]
    rows += [(f"file:{source}/a.pdf", 1, 0.0, 0.0, 0, "table", None, [["1", "go"]]), (f"file:{source}/b.pdf", 0, 0.0, 0.0, 0, "text", "  ", None)]
    blocks = spark.createDataFrame(rows, "path string, page int, top double, left double, block_no int, kind string, text string, cells array<array<string>>")
    got = run_folder(spark, str(source), out, blocks=blocks).first().asDict()
    assert got == {"written": 1, "skipped": 0, "not_written": 0, "failures": 2} and rows_of(spark, out) == [("a.xlsx", "TC_1_A", "a.pdf")]
    assert {r.file: r.reason for r in committed(spark, out, "failures").collect()} == {"b.pdf": "empty_text", "c.pdf": "unsupported"}


def test_a_lost_run_leaves_nothing_visible(spark, tmp_path, monkeypatch):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    plan(source, "a.docx", "TC_1_A")
    with monkeypatch.context() as m:
        m.setattr(batch.commits, "commit", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            run_folder(spark, str(source), out)
    assert [committed(spark, out, t) for t in batch.commits.TABLES] == [None] * len(batch.commits.TABLES) and not (tmp_path / "out" / "rows").exists()
    assert len(list((tmp_path / "out" / "cases").iterdir())) == 1
    with monkeypatch.context() as m:  # and one that is lost after it was committed is exported by the next
        m.setattr(batch.sinks, "write_outputs", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError, match="killed"):
            run_folder(spark, str(source), out)
    assert len(list((tmp_path / "out" / "cases").iterdir())) == 1  # the first one's was swept away
    assert [r.test_id for r in latest(spark, out).collect()] == ["TC_1_A"] and not (tmp_path / "out" / "rows").exists()
    assert run_folder(spark, str(source), out).first().skipped == 1 and rows_of(spark, out) == [("a.xlsx", "TC_1_A", "a.docx")]
    plan(source, "a.docx", "TC_2_B")
    run_folder(spark, str(source), out, Options(force=True))
    assert [r.test_id for r in latest(spark, out).collect()] == ["TC_2_B"] and committed(spark, out, "cases").count() == 2


def test_messages_audit_and_whole_documents_of_a_run(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    plan(source, "a.docx", "TC_1_A")
    plan(source, "b.docx", "TC_2_B")
    (source / "c.docx").write_bytes(b"no zip")

    def caller(payloads):
        return [ValueError("HTTP error 503") if "b.docx" in p else json.dumps({"test_cases": [{"test_id": t} for t in ("X", "Y", "X")]}) for p in payloads]

    got = run_folder(spark, str(source), out, Options(caller=caller, model="m", whole=True, request=True, headers={"Authorization": "Bearer secret"})).first()
    assert (got.written, got.failures) == (1, 2)
    told = [r.message for r in committed(spark, out, "messages").orderBy("place").collect()]
    assert told[0] == 'b.docx: Section "": HTTP error 503' and told[1].startswith("c.docx: BadZipFile") and "'X' has non-contiguous" in told[2] and len(told) == 3
    audit = committed(spark, out, "audit").orderBy("doc_id").collect()
    assert [(r.event, r.error) for r in audit] == [("response", None), ("error", "HTTP error 503")] and {r.headers["Authorization"] for r in audit} == {"Bearer <redacted>"}


def test_the_feed_of_a_run_folds_to_its_summary(spark, tmp_path):
    from casewright.operators import ledger
    from casewright.streaming.events import fold_jobs, job_progress, read_events

    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    plan(source, "a.docx", "TC_1_A", "TC_2_B", "TC_3_C")
    plan(source, "b.docx", "TC_4_D")
    (source / "c.docx").write_bytes(b"no zip")

    def ask(payload):
        if "TC_2_B" in payload:
            raise OSError("HTTP error 503")
        if "b.docx" in payload:
            raise ValueError("HTTP error 400")
        return json.dumps({"test_cases": [{"test_id": "X"}, {"test_id": "Y"}]})

    got = run_folder(spark, str(source), out, Options(caller=ledger.each(ask), model="m", level="2")).first()
    feed = read_events(spark, f"{out}/events").cache()
    jobs = {r.job_id.rsplit("/", 1)[1]: r for r in fold_jobs(feed).collect()}
    assert {k: r.status for k, r in jobs.items()} == {"a.docx": "done", "b.docx": "failed", "c.docx": "failed"} and (got.written, got.failures) == (1, 2)
    assert [x.test_id for x in jobs["a.docx"].result.rows] == ["X", "Y", "X", "Y"] and len(jobs["a.docx"].result.errors) == 1 and jobs["a.docx"].result.file_results[0].rows == 4
    assert "HTTP error 400" in jobs["b.docx"].message and jobs["c.docx"].message.startswith("BadZipFile")
    told = {r.job_id.rsplit("/", 1)[1]: r[1:] for r in job_progress(feed).collect()}
    assert told == {"a.docx": (2, 1, 5, 4), "b.docx": (0, 1, 0, None)}
    mine = [(r.seq, r.type, r.data and (r.data.step, r.data["index"], r.data.total, r.data.cumulative_rows)) for r in feed.where("job_id LIKE '%a.docx'").orderBy("seq").collect()]
    assert [m[0] for m in mine] == list(range(1, 10)) and [m[1] for m in mine] == ["progress"] * 8 + ["result"]
    assert [m[2] for m in mine[:8]] == [("llm_section_done", 1, 3, 2), *[("llm_retry", 2, 3, None)] * 5, ("llm_section_error", 2, 3, None), ("llm_section_done", 3, 3, 4)]


def test_documents_are_read_from_few_files_by_the_index(spark, tmp_path):
    rows = [(f"d{i % 50:02}.xlsx", i % 50, i // 50, 0, f"t{i}") for i in range(500)] + [("hot.xlsx", 99, n, 0, f"h{n}") for n in range(1000)]
    df = spark.createDataFrame(rows, "out_name string, doc_id long, section_no int, case_no int, text string").repartition(7)
    folder, index = str(tmp_path / "cases"), str(tmp_path / "index")
    clustered.write(df, folder, index, rows_a_file=300)
    files = [x for x in os.listdir(folder) if x.endswith(".parquet")]
    assert 2 <= len(files) <= 5  # by rows, not by documents
    entries = spark.read.parquet(index).collect()
    assert sum(e.n_rows for e in entries) == 1500 and len({e.file for e in entries if e.out_name == "hot.xlsx"}) >= 2
    for e in entries:  # rows from first_row on are that document's and no others
        mine = [r for r in spark.read.parquet(f"{folder}/{e.file}").coalesce(1).collect()][e.first_row : e.first_row + e.n_rows] if e.out_name in ("d07.xlsx", "hot.xlsx") else []
        assert {r.out_name for r in mine} <= {e.out_name} and mine == sorted(mine, key=lambda r: r.section_no)
    clustered.write(df.limit(0), str(tmp_path / "none"), str(tmp_path / "no index"))
    assert spark.read.parquet(str(tmp_path / "no index")).count() == 0


def test_a_run_without_folders_is_read_by_document(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    for name in ("a", "b", "c"):
        plan(source, f"{name}.docx", f"TC_{name.upper()}_1", f"TC_{name.upper()}_2")
    assert run_folder(spark, str(source), out, Options(folders=False)).first().written == 3
    assert not (tmp_path / "out" / "rows").exists()
    got = clustered.document(spark, out, "b.xlsx")
    assert [r.test_id for r in got.collect()] == ["TC_B_1", "TC_B_2"] and len(got.inputFiles()) == 1
    assert clustered.document(spark, out, "none.xlsx") is None and clustered.document(spark, str(tmp_path / "new"), "b.xlsx") is None
    plan(source, "b.docx", "TC_B_9")
    run_folder(spark, str(source), out, Options(folders=False, force=True))
    assert [r.test_id for r in clustered.document(spark, out, "b.xlsx").collect()] == ["TC_B_9"]

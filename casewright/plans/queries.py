"""One query for each operator, over the derived views."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.functions import text as X
from casewright.functions.schemas import CASE_FIELDS, TEXT_FIELDS
from casewright.operators import ledger, merge, prep, replies, report, sections, template
from casewright.operators.lines import to_lines, with_headings
from casewright.plans import jobs, views
from casewright.sources import clustered, files, pages, sinks, words
from casewright.sources.work import kept, shared_folder, tasks_for
from casewright.streaming import events

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
PATTERNS = ["^## Check item", "VZ_TC_A_", "^# Area [0-9]+$"]
TRUNCATE_AT = 120_000
#: Words of a task: their searches hold several orders of them at once.
PAGE_WORDS = 150_000
LINE_ORDER = ["l_linenumber", "l_partkey", "test_id"]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_headings(views.plan_lines(spark, sf_dir)).where("level IS NOT NULL")


@query
def heading_parse(spark, sf_dir):
    return _headings(spark, sf_dir).select("doc_id", "pos", "level", "title")


@query
def heading_normalize(spark, sf_dir):
    return _headings(spark, sf_dir).select("doc_id", "pos", X.normal_title(F.col("title")).alias("norm"))


@query
def boilerplate_flag(spark, sf_dir):
    return _headings(spark, sf_dir).select("doc_id", "pos", X.is_boilerplate(F.col("title")).alias("boilerplate"))


@query
def prep_lines(spark, sf_dir):
    return prep.prepared_lines(views.plan_docs(spark, sf_dir)).select("doc_id", "pos", "line")


@query
def prep_text_meta(spark, sf_dir):
    got = prep.prepared(views.plan_docs(spark, sf_dir))
    return got.select("doc_id", F.md5(F.encode("prepared_text", "utf-8")).alias("text_md5"), "chars_before", "chars_after", F.array_join("removed_titles", " ; ").alias("removed"), "fallback", "stripped")


@query
def toc_lines(spark, sf_dir):
    return views.plan_lines(spark, sf_dir).where(X.is_toc_line(F.col("line"))).select("doc_id", "pos")


@query
def removed_titles(spark, sf_dir):
    return prep.mark_boilerplate(to_lines(views.plan_docs(spark, sf_dir))).where("opens").select("doc_id", "pos", "title")


@query
def shallowest_level(spark, sf_dir):
    return sections.shallowest_level(with_headings(views.plan_lines(spark, sf_dir)))


@query
def sections_by_heading(spark, sf_dir):
    return sections.by_headings(prep.prepared_lines(views.plan_docs(spark, sf_dir)))


def _at_level_3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sections.with_action(sections.by_headings(with_headings(to_lines(views.plan_docs(spark, sf_dir))), "3"))


@query
def sections_by_pattern(spark, sf_dir):
    return sections.by_patterns(to_lines(views.plan_docs(spark, sf_dir)), sections.pattern_hints(spark, "# comment\n" + "\n".join(PATTERNS)))


@query
def pattern_misses(spark, sf_dir):
    return sections.unmatched_documents(to_lines(views.plan_docs(spark, sf_dir)), PATTERNS[1:2])


@query
def section_action(spark, sf_dir):
    return _at_level_3(spark, sf_dir).select("doc_id", "section_no", "title", "action")


@query
def section_plan(spark, sf_dir):
    got = sections.section_plan(_at_level_3(spark, sf_dir))
    return got.select("doc_id", "n_extract", "n_skip", "n_placeholder", "n_drop", F.array_join("skipped_titles", " ; ").alias("skipped"), F.array_join("placeholder_titles", " ; ").alias("placed"))


@query
def placeholder_rows(spark, sf_dir):
    named = _at_level_3(spark, sf_dir).join(views.plan_docs(spark, sf_dir).select("doc_id", "file_name"), "doc_id")
    return sections.placeholder_cases(named).select("doc_id", "section_no", *CASE_FIELDS)


@query
def whole_document_mode(spark, sf_dir):
    got = sections.with_action(sections.whole_documents(views.plan_docs(spark, sf_dir)))
    return got.select("doc_id", "section_no", F.char_length("body").cast("long").alias("n_chars"), "action")


@query
def truncate_docs(spark, sf_dir):
    text = X.truncated(F.col("doc_text"), TRUNCATE_AT)
    return views.plan_docs(spark, sf_dir).select("doc_id", F.md5(F.encode(text, "utf-8")).alias("text_md5"), (F.char_length("doc_text") > TRUNCATE_AT).alias("truncated"), F.char_length("doc_text").cast("long").alias("n_chars"))


@query
def ellipsis(spark, sf_dir):
    return views.plan_docs(spark, sf_dir).select("doc_id", X.ellipsis(F.col("doc_text")).alias("message"))


@query
def template_match(spark, sf_dir):
    return template.with_template(views.plan_docs(spark, sf_dir)).select("doc_id", "template")


@query
def template_unmatched(spark, sf_dir):
    return template.with_template(views.plan_docs(spark, sf_dir)).where("template IS NULL").select("doc_id", "file_name", F.lit("no_template").alias("reason"))


@query
def template_rows(spark, sf_dir):
    got = template.template_cases(views.plan_docs(spark, sf_dir))
    return got.select("doc_id", "section_no", "file_name", "test_id", "test_name", "description", "preconditions", "steps_expected")


@query
def merge_runs(spark, sf_dir):
    raw = template.as_cases(template.template_cases(views.plan_docs(spark, sf_dir)))
    return merge.merge_runs(raw, ["doc_id"], jobs.ORDER).select("doc_id", "section_no", *CASE_FIELDS, "run_rows")


def _merged_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = views.merge_rows(spark, sf_dir)
    return merge.merge_runs(rows, ["l_orderkey"], LINE_ORDER, tasks=tasks_for(rows))


@query
def merge_runs_lineitem(spark, sf_dir):
    return _merged_lineitem(spark, sf_dir)


@query
def scattered_duplicates(spark, sf_dir):
    return merge.flag_scattered(_merged_lineitem(spark, sf_dir), ["l_orderkey"], LINE_ORDER).select("l_orderkey", "l_linenumber", "l_partkey", "test_id", "description")


@query
def scattered_warnings(spark, sf_dir):
    rows = views.merge_rows(spark, sf_dir)
    starts = merge.run_starts(rows, ["l_orderkey"], LINE_ORDER, tasks_for(rows))
    got = merge.scattered_warnings(starts, ["l_orderkey"], LINE_ORDER)
    return got.select("l_orderkey", "test_id", "n_rows", F.col("first.l_linenumber").alias("first"), "warning")


def _merged_request(spark: SparkSession, sf_dir: str, *text_fields: str) -> DataFrame:
    """All rows merged as one request, with these of the text fields; made of tables that are written, so it may be read again."""
    rows = views.merge_rows(spark, sf_dir).select("l_orderkey", *LINE_ORDER, *text_fields).withColumn("request", F.lit(1))
    return merge.merge_runs_in_ranges(rows, ["request"], ["l_orderkey", *LINE_ORDER], text_fields)


@query
def merge_runs_request(spark, sf_dir):
    return _merged_request(spark, sf_dir, *TEXT_FIELDS)


@query
def scattered_request(spark, sf_dir):
    rows = _merged_request(spark, sf_dir, "description")
    return merge.flag_scattered_in_ranges(rows, ["request"], rows.count()).select("l_orderkey", "l_linenumber", "l_partkey", "test_id", "description")


@query
def scattered_warnings_request(spark, sf_dir):
    got = merge.scattered_warnings(_merged_request(spark, sf_dir), ["request"], ["l_orderkey", *LINE_ORDER])
    return got.select("test_id", "n_rows", F.col("first.l_orderkey").alias("first_order"), F.col("first.l_linenumber").alias("first_line"), "warning")


def _results(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = template.with_template(views.plan_docs(spark, sf_dir))
    admitted = files.admitted(docs.select("doc_id", "template", F.col("file_name").alias("path"), F.char_length("doc_text").cast("long").alias("length")))
    inputs = admitted.select("doc_id", F.col("doc_id").alias("doc_ord"), "file_name", "template", F.coalesce("reason", F.when(F.col("template").isNull(), "no_template")).alias("reason"), F.coalesce("detail", F.when(F.col("template").isNull(), "No matching template")).alias("detail"))
    rows = template.template_cases(docs.drop("template"))
    return report.file_results(inputs, rows.select("doc_id"))


@query
def file_results(spark, sf_dir):
    return _results(spark, sf_dir).select("doc_id", "file_name", "template", "n_rows", "ok", "reason")


@query
def templates_used(spark, sf_dir):
    return report.templates_used(_results(spark, sf_dir).withColumn("scope", F.col("doc_id") % 10), ["scope"])


def _with_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.with_status(_results(spark, sf_dir).withColumn("exists", F.col("doc_id") % 3 == 0))


@query
def batch_summary(spark, sf_dir):
    return report.batch_summary(_with_status(spark, sf_dir))


@query
def document_status(spark, sf_dir):
    return _with_status(spark, sf_dir).select("doc_id", "status")


@query
def failure_log(spark, sf_dir):
    return report.failure_records(_with_status(spark, sf_dir))


def _unworded() -> Column:
    """Messages without what a JSON parser says in its own words."""
    return F.regexp_replace("message", "not valid JSON: .*", "not valid JSON")


@query
def error_messages(spark, sf_dir):
    results = _results(spark, sf_dir).withColumn("scope", F.lit(1))
    parsed = _parsed(spark, sf_dir)
    failed = replies.section_errors(parsed).withColumn("message", _unworded()).join(parsed.select("doc_id", "section_no", "file_name"), ["doc_id", "section_no"])
    raw = template.as_cases(template.template_cases(views.plan_docs(spark, sf_dir)))
    warned = merge.scattered_warnings(merge.merge_runs(raw, ["doc_id"], jobs.ORDER), ["doc_id"], jobs.ORDER)
    warned = warned.select(F.lit(1).alias("scope"), F.struct(F.col("doc_id").alias("doc_ord")).alias("first"), "warning")
    got = report.messages(results, failed.select(F.lit(1).alias("scope"), F.col("doc_id").alias("doc_ord"), "section_no", "file_name", "message"), warned)
    return got.select("place.*", "message")


@query
def build_requests(spark, sf_dir):
    got = replies.requests(jobs.planned_sections(views.plan_docs(spark, sf_dir)).where("action = 'extract'"), "model-a", "VZ_TC_*", most=TRUNCATE_AT)
    said = F.get_json_object("payload", "$.messages[1].content")
    return got.select("doc_id", "section_no", F.md5(F.encode(said, "utf-8")).alias("content_md5"), F.get_json_object("payload", "$.response_format.type").alias("format"), "truncated", "doc_char_count")


@query
def assemble_stream(spark, sf_dir):
    return replies.assembled(views.sse_lines(spark, sf_dir))


@query
def completion_content(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    reply = F.when(F.col("turn") % 5 == 4, F.lit('{"choices":[]}')).otherwise(F.to_json(F.struct(F.array(F.struct(F.struct(F.concat(F.lit("  "), "text").alias("content")).alias("message"))).alias("choices"))))
    return rows.select("conv_id", "turn", replies.completion_content(reply).alias("content"), replies.completion_error(reply).alias("error"))


@query
def strip_fence(spark, sf_dir):
    return views.reply_rows(spark, sf_dir).select("doc_id", "section_no", X.strip_fence(F.col("content")).alias("content"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replies.with_cases(views.reply_rows(spark, sf_dir))


@query
def parse_cases(spark, sf_dir):
    return replies.case_rows(_parsed(spark, sf_dir)).select("doc_id", "section_no", "case_no", *CASE_FIELDS)


@query
def partial_failures(spark, sf_dir):
    got = replies.section_errors(_parsed(spark, sf_dir))
    return got.select("doc_id", "section_no", _unworded().alias("message"))


@query
def retryable_requests(spark, sf_dir):
    calls = views.failed_calls(spark, sf_dir)
    return calls.select("request_id", X.is_retryable(F.col("error")).alias("retryable"), X.is_retryable_batch(F.col("error")).alias("retryable_batch"))


@query
def resubmit_requests(spark, sf_dir):
    calls = views.failed_calls(spark, sf_dir)
    return replies.to_resubmit(calls.select("request_id"), calls, ["request_id"])


def flaky_caller(payloads: list[str]):
    """Stands in for a server: some payloads always meet a busy one, some are refused."""
    for p in payloads:
        yield {0: TimeoutError("HTTP error 503: busy"), 1: ValueError("HTTP error 400: refused")}.get(len(p) % 7) or f"{len(p)} {p[:20]}"


@query
def call_ledger(spark, sf_dir):
    asked = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", F.col("text").alias("payload"))
    return ledger.call_once(asked, flaky_caller, shared_folder(spark), ["conv_id", "turn"])


@query
def running_totals(spark, sf_dir):
    counted = _parsed(spark, sf_dir).select("doc_id", "section_no", F.coalesce(F.size("cases"), F.lit(0)).cast("long").alias("n_rows"))
    return replies.running_totals(counted.withColumn("n_rows", F.greatest("n_rows", F.lit(0).cast("long"))))


@query
def admission(spark, sf_dir):
    return files.admitted(views.input_files(spark, sf_dir)).select("p_partkey", "file_name", "suffix", "kind", "reason")


@query
def input_order(spark, sf_dir):
    got = files.in_order(views.input_files(spark, sf_dir).withColumn("scope", F.col("p_partkey") % 50).dropDuplicates(["scope", "path"]), ["scope"])
    return got.select("scope", "path", "doc_ord")


@query
def input_order_of_all(spark, sf_dir):
    return files.in_order(views.input_files(spark, sf_dir).select("path").distinct())


@query
def output_names(spark, sf_dir):
    p = F.col("path")
    return views.input_files(spark, sf_dir).select("p_partkey", files.output_name(p).alias("out_name"), files.output_name(p, True).alias("long_name"))


@query
def output_collisions(spark, sf_dir):
    return files.collisions(views.input_files(spark, sf_dir).withColumn("out_name", files.output_name(F.col("path")))).select("p_partkey", "out_name", "same_name")


@query
def resume_anti_join(spark, sf_dir):
    inputs = views.input_files(spark, sf_dir).withColumn("out_name", F.concat(files.output_name(F.col("path")), F.col("p_partkey").cast("string")))
    return files.not_done(inputs, inputs.where("p_partkey % 3 = 0")).select("p_partkey", "out_name")


@query
def safe_stem(spark, sf_dir):
    p = F.col("path")
    name = F.concat(F.lit("..x/ "), F.regexp_replace(X.stem(p), "[aeiou]", "é!"), X.extension(p))
    return views.input_files(spark, sf_dir).select("p_partkey", X.safe_stem(name).alias("stem"))


@query
def empty_texts(spark, sf_dir):
    docs = views.plan_docs(spark, sf_dir).withColumn("doc_text", F.when(F.col("doc_id") % 7 == 0, F.lit(" \n\t ")).otherwise(F.col("doc_text")))
    return files.empty_texts(docs).select("doc_id", "file_name", "reason")


@query
def table_to_pipe(spark, sf_dir):
    blocks = views.page_blocks(spark, sf_dir).where("kind = 'table'")
    return blocks.select("doc_id", "block_no", X.pipe_rows(F.col("cells")).alias("pipe_text"))


@query
def page_assembly(spark, sf_dir):
    return pages.page_documents(views.page_blocks(spark, sf_dir))


@query
def page_words(spark, sf_dir):
    said, tables, sizes = views.page_words(spark, sf_dir)
    return pages.page_texts(words.word_blocks(said, tables, sizes, tasks_for(said, PAGE_WORDS)))


@query
def export_rows(spark, sf_dir):
    raw = template.as_cases(template.template_cases(views.plan_docs(spark, sf_dir)))
    return sinks.export_rows(raw, "doc_id", "section_no")


@query
def clustered_outputs(spark, sf_dir):
    cases = template.as_cases(template.template_cases(views.plan_docs(spark, sf_dir))).withColumn("out_name", files.output_name(F.col("file_name"), True))
    folder = shared_folder(spark)
    clustered.write(kept(cases), f"{folder}/cases", f"{folder}/index", rows_a_file=20_000)
    index = spark.read.parquet(f"{folder}/index")
    rows = spark.read.parquet(f"{folder}/cases").select(F.col("_metadata.file_name").alias("file"), F.col("_metadata.row_index").alias("row"), "out_name", "section_no")
    told = index.groupBy(F.col("out_name").alias("owner")).agg(F.sum("n_rows").alias("n_rows"))
    read = clustered.at(rows, index).groupBy("owner").agg(F.count("*").alias("n_read"), F.min("section_no").alias("first_no"), F.max("section_no").alias("last_no"), F.bool_and(F.col("owner") == F.col("out_name")).alias("own"))
    return told.join(read, "owner", "left").withColumnRenamed("owner", "out_name")


@query
def documents_with_rows(spark, sf_dir):
    rows = template.template_cases(views.plan_docs(spark, sf_dir))
    return views.plan_docs(spark, sf_dir).join(rows.select("doc_id"), "doc_id", "left_semi").select("doc_id", "file_name")


@query
def redact_headers(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", "event_type")
    name = F.when(F.col("event_id") % 2 == 0, "Authorization").otherwise("X-Trace")
    value = F.concat(F.when(F.col("event_id") % 3 == 0, "Bearer ").otherwise("Basic "), F.col("event_type"))
    clean = X.redacted(F.create_map(name, value, F.lit("Accept"), F.lit("Bearer json")))
    return rows.select("event_id", clean[name].alias("first"), clean["Accept"].alias("second"))


@query
def job_fold(spark, sf_dir):
    got = events.fold_jobs(views.job_events(spark, sf_dir), F.col("seq"))
    return got.select("job_id", "status", "message", "result")


@query
def job_progress(spark, sf_dir):
    feed = spark.read.parquet(f"{sf_dir}/events.parquet")
    step = F.expr("CASE event_type WHEN 'view' THEN 'llm_section_done' WHEN 'click' THEN 'llm_section_error' WHEN 'signup' THEN 'llm_retry' ELSE 'other' END")
    data = F.struct(step.alias("step"), F.when(F.col("event_type") == "view", F.col("event_id") % 100).alias("cumulative_rows"))
    return events.job_progress(feed.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), F.lit("progress").alias("type"), data.alias("data")))


@query
def pipeline_template(spark, sf_dir):
    return jobs.by_template(views.plan_docs(spark, sf_dir)).cases.select("doc_id", "section_no", *CASE_FIELDS, "run_rows")


def offline_caller(payloads: list[str]) -> list[str]:
    """Stands in for a model: one case a section, named after the section's first line."""
    import json

    out = []
    for p in payloads:
        body = json.loads(p)["messages"][1]["content"].split("--- Document text ---\n\n", 1)[1]
        out.append(json.dumps({"test_cases": [{"test_id": f"S{len(body) % 5}", "test_name": body.split("\n", 1)[0], "description": len(body)}]}))
    return out


@query
def pipeline_sections(spark, sf_dir):
    got = jobs.by_model(views.plan_docs(spark, sf_dir), offline_caller, "offline", level="3")
    return got.cases.select("doc_id", "section_no", *CASE_FIELDS, "run_rows")


@query
def file_results_by_section(spark, sf_dir):
    docs = views.plan_docs(spark, sf_dir)
    got = jobs.by_model(docs, offline_caller, "offline", level="3")
    none = F.lit(None).cast("string")
    inputs = docs.select("doc_id", "file_name", F.lit("LLM (offline)").alias("template"), none.alias("reason"), none.alias("detail"))
    out = report.file_results(inputs, got.raw.select("doc_id"), got.errors, got.details)
    return out.select("doc_id", "file_name", "template", "n_rows", "n_errors", "ok", "doc_chars", F.array_join("removed_headings", " ; ").alias("removed"), "prep_fallback", "section_calls", "placeholders", "truncated")

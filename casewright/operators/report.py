"""What a run tells: results by file, messages, status and totals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.functions.schemas import CASE_FIELDS, EVENTS
from casewright.operators.lines import joined


def section_details(prepared: DataFrame, planned: DataFrame, answered: DataFrame) -> DataFrame:
    """doc_id, doc_chars, removed_headings, prep_fallback, section_calls, placeholders and truncated.

    ``prepared``: see prep.prepared; ``planned``: doc_id and action of each section; ``answered``: doc_id and truncated
    of each request with a good reply.  A document is truncated if one of its answered requests was.
    """
    plan = planned.groupBy("doc_id").agg(F.count_if(F.col("action") == "extract").alias("section_calls"), F.count_if(F.col("action") == "placeholder").alias("placeholders"))
    cut = answered.groupBy("doc_id").agg(F.max("truncated").alias("truncated"))
    out = prepared.select("doc_id", F.col("chars_after").alias("doc_chars"), F.col("removed_titles").alias("removed_headings"), F.col("fallback").alias("prep_fallback"))
    out = out.join(plan, "doc_id", "left").join(cut, "doc_id", "left")
    none = F.lit(0).cast("long")
    return out.withColumns({"section_calls": F.coalesce("section_calls", none), "placeholders": F.coalesce("placeholders", none), "truncated": F.coalesce("truncated", F.lit(False))})


def file_results(inputs: DataFrame, rows: DataFrame, errors: DataFrame | None = None, details: DataFrame | None = None) -> DataFrame:
    """inputs with n_rows, n_errors, ok, reason and detail; rows are counted before runs are merged.

    ``inputs``: doc_id, file_name, template and reject reason and detail (null if none); ``rows``: doc_id, once for
    each row; ``errors``: doc_id, section_no, message; ``details``: more columns by doc_id, see :func:`section_details`.
    """
    counts = rows.groupBy("doc_id").agg(F.count("*").alias("n_rows"))
    out = inputs.join(counts, "doc_id", "left").withColumn("n_rows", F.coalesce("n_rows", F.lit(0)))
    if errors is not None:
        failed = errors.groupBy("doc_id").agg(F.count("*").alias("n_errors"), F.min(F.struct("section_no", "message"))["message"].alias("first_error"))
        out = out.join(failed, "doc_id", "left").withColumn("n_errors", F.coalesce("n_errors", F.lit(0)))
    else:
        out = out.withColumns({"n_errors": F.lit(0).cast("long"), "first_error": F.lit(None).cast("string")})
    out = out.withColumns({"reason": F.coalesce("reason", F.when((F.col("n_rows") == 0) & (F.col("n_errors") > 0), "llm_error")), "detail": F.coalesce("detail", "first_error")})
    out = out.drop("first_error").withColumn("ok", F.col("reason").isNull())
    return out if details is None else out.join(details, "doc_id", "left")


def templates_used(results: DataFrame, scope: list[str]) -> DataFrame:
    """scope and templates: the distinct templates in the order in which they were first used, joined by a middle dot."""
    first = results.where("template IS NOT NULL").groupBy(*scope, "template").agg(F.min("doc_ord").alias("pos"))
    return first.groupBy(*scope).agg(joined(F.col("template"), F.struct("pos", "template").alias("pos"), " · ").alias("templates"))


def messages(files: DataFrame, sections: DataFrame, warnings: DataFrame) -> DataFrame:
    """scope, place, message: messages of files, of sections with their file before them, then warnings of duplicates.

    ``files``: scope, doc_ord, file_name, detail; ``sections``: scope, doc_ord, section_no, file_name, message;
    ``warnings``: scope, first (a struct that begins with doc_ord), warning.
    """
    none = F.lit(0).cast("int")
    place = lambda kind, doc, section: F.struct(F.lit(kind).alias("kind"), doc.cast("int").alias("doc_ord"), section.cast("int").alias("section_no")).alias("place")
    own = files.where("detail IS NOT NULL").select("scope", place(0, F.col("doc_ord"), none), F.concat("file_name", F.lit(": "), "detail").alias("message"))
    part = sections.select("scope", place(0, F.col("doc_ord"), F.col("section_no") + 1), F.concat("file_name", F.lit(": "), "message").alias("message"))
    last = warnings.select("scope", place(1, F.col("first.doc_ord"), none), F.col("warning").alias("message"))
    return own.unionByName(part).unionByName(last)


def with_status(results: DataFrame, skip_empty_rows: bool = False) -> DataFrame:
    """Adds status: skipped (its output is there already), failed, empty, not_written or written.

    ``results``: exists, ok, n_rows.  A document without rows is a failure only with ``skip_empty_rows``.
    """
    status = F.when(F.col("exists"), "skipped").when(~F.col("ok"), "failed").when(F.col("n_rows") == 0, "empty" if skip_empty_rows else "not_written").otherwise("written")
    return results.withColumn("status", status)


def batch_summary(results: DataFrame, strict: bool = False) -> DataFrame:
    """written, skipped, empty and failures over (status); with ``strict``, a failure ends the job."""
    count = lambda *s: F.count_if(F.col("status").isin(*s))
    out = results.agg(count("written").alias("written"), count("skipped").alias("skipped"), count("not_written").alias("not_written"), count("failed", "empty").alias("failures"))
    if strict and (n := out.first()["failures"]):
        raise RuntimeError(f"{n} documents failed")
    return out


def failure_records(results: DataFrame) -> DataFrame:
    """file, phase, reason, detail of the documents that failed: in extraction, for want of rows, or unexpectedly.

    A document that is skipped because its output's name is taken by another one of the run is recorded too.
    """
    phase = F.when(F.col("status") == "empty", "rows").when(F.col("status") == "skipped", "output").when(F.col("reason") == "exception", "unexpected").otherwise("extract")
    return results.where("status IN ('failed', 'empty') OR status = 'skipped' AND reason = 'name_taken'").select(F.col("file_name").alias("file"), phase.alias("phase"), "reason", "detail")


def job_events(results: DataFrame, cases: DataFrame, errors: DataFrame | None = None, sections: DataFrame | None = None) -> DataFrame:
    """The feed of a run, as EVENTS: each document that was not skipped is a job, its path is the id.

    A job tells of each try of each section that was asked, in order (llm_retry, then llm_section_done with the rows so far
    or llm_section_error), and ends with its result or, if its status is a failure, with an error.  ``results``: see
    :func:`with_status`, with path; ``cases``: doc_id, section_no, case_no and the fields of a case; ``errors``: doc_id, section_no,
    message; ``sections``: doc_id, section_no, title, error, attempt (tries) and n_rows.  A document is the largest group.
    """
    jobs = results.where("status <> 'skipped'").withColumn("job_id", F.col("path"))
    fields = {f.name: f.dataType for f in EVENTS}
    event = lambda **own: [(own[n] if n in own else F.lit(None)).cast(t).alias(n) for n, t in fields.items()]

    def progress(**own: Column) -> Column:
        return F.struct(*((own[f.name] if f.name in own else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields["data"]))

    listed = lambda df, what, name: df.groupBy("doc_id").agg(F.sort_array(F.collect_list(what)).alias(name))
    rows = listed(cases, F.struct("section_no", "case_no", F.struct(*CASE_FIELDS).alias("x")), "_rows")
    done = jobs.join(rows, "doc_id", "left")
    if errors is not None:
        done = done.join(listed(errors, F.struct("section_no", F.col("message").alias("x")), "_errors"), "doc_id", "left")
    else:
        done = done.withColumn("_errors", F.lit(None).cast("array<struct<section_no:int,x:string>>"))
    if sections is not None:
        done = done.join(sections.groupBy("doc_id").agg(F.sum("attempt").alias("_told")), "doc_id", "left")
    else:
        done = done.withColumn("_told", F.lit(None).cast("long"))
    bad = F.col("status").isin("failed", "empty")
    values = lambda c, t: F.when(~bad, F.coalesce(F.transform(c, lambda s: s["x"]), F.array().cast(t)))
    told = F.when(~bad, F.array(F.struct(F.col("file_name").alias("filename"), "template", F.col("n_rows").alias("rows"), "ok", "reason", "detail")))
    last = done.select(*event(
        job_id=F.col("job_id"), seq=F.coalesce("_told", F.lit(0)) + 1, type=F.when(bad, "error").otherwise("result"), message=F.when(bad, F.coalesce("detail", "reason", F.lit("No rows were found"))),
        rows=values(F.col("_rows"), fields["rows"]), errors=values(F.col("_errors"), T.ArrayType(T.StringType())), template=F.when(~bad, F.col("template")), file_results=told,
    ))
    if sections is None:
        return last
    inside = Window.partitionBy("doc_id").orderBy("section_no")
    part = sections.withColumns({"n_rows": F.coalesce("n_rows", F.lit(0)).cast("long"), "index": F.row_number().over(inside), "total": F.count("*").over(Window.partitionBy("doc_id"))})
    so_far = inside.rowsBetween(Window.unboundedPreceding, 0)
    part = part.withColumns({"cumulative": F.sum("n_rows").over(so_far), "_after": F.sum("attempt").over(so_far)})
    tries = part.withColumn("nth", F.explode(F.sequence(F.lit(1), F.col("attempt")))).join(jobs.select("doc_id", "job_id", "file_name"), "doc_id")
    again, good = F.col("nth") < F.col("attempt"), F.col("error").isNull()
    own = progress(
        step=F.when(again, "llm_retry").when(good, "llm_section_done").otherwise("llm_section_error"), file=F.col("file_name"), title=F.col("title"), error=F.when(~again, F.col("error")), index=F.col("index"), total=F.col("total"),
        rows_in_section=F.when(~again & good, F.col("n_rows")), cumulative_rows=F.when(~again & good, F.col("cumulative")),
    )
    return last.unionByName(tries.select(*event(job_id=F.col("job_id"), seq=F.col("_after") - F.col("attempt") + F.col("nth"), type=F.lit("progress"), data=own)))

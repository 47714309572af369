"""Whole jobs, from documents to merged cases."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from casewright.functions import text as X
from casewright.operators import ledger, merge, prep, replies, report, sections, template
from casewright.sources.work import kept


@dataclass(frozen=True)
class Extraction:
    """cases: merged and flagged; raw: as they were found; warnings; errors, plan, details, calls and what each section gave where a model was asked."""

    cases: DataFrame
    raw: DataFrame
    warnings: DataFrame
    errors: DataFrame | None = None
    sections: DataFrame | None = None
    details: DataFrame | None = None
    calls: DataFrame | None = None
    told: DataFrame | None = None


ORDER = ["section_no", "case_no"]


def _merged(raw: DataFrame, request: bool = False, keep: Callable[[DataFrame], DataFrame] = kept, **more: DataFrame) -> Extraction:
    """Runs are merged within each document, or over all documents of a ``request`` in the order of doc_id, without a task that sees them all."""
    if not request:
        rows = merge.merge_runs(raw, ["doc_id"], ORDER)
        return Extraction(merge.flag_scattered(rows, ["doc_id"], ORDER), raw, merge.scattered_warnings(rows, ["doc_id"], ORDER), **more)
    scope, order = ["_request"], ["doc_id", *ORDER]
    rows = keep(merge.merge_runs_in_ranges(raw.withColumn("_request", F.lit(0)), scope, order, keep=keep))
    cases = merge.flag_scattered_in_ranges(rows, scope, rows.count())
    return Extraction(cases.drop("_request"), raw, merge.scattered_warnings(rows, scope, order).drop("_request"), **more)


def by_template(docs: DataFrame, templates: list[template.Template] | None = None, request: bool = False, keep: Callable[[DataFrame], DataFrame] = kept) -> Extraction:
    """Cases of (doc_id, file_name, doc_text) by rule-based templates; the text is taken as it is.  ``request``: all documents are one."""
    return _merged(template.as_cases(template.template_cases(docs, templates)), request, keep)


def planned_sections(docs: DataFrame, level: str = "auto", patterns: list[str] | None = None, whole: bool = False) -> DataFrame:
    """The sections of prepared documents with file_name and action; all on one exchange by document.

    ``whole``: each prepared document is one section without a title, which is asked whatever it looks like unless it is blank.
    """
    if whole:
        cut = sections.whole_documents(prep.prepared(docs), "prepared_text")
        asked = cut.withColumn("action", F.when(X.is_blank(F.col("body")), "drop").otherwise("extract"))
        return asked.join(docs.select("doc_id", "file_name"), "doc_id")
    lines = prep.prepared_lines(docs)
    cut = sections.by_patterns(lines, patterns) if patterns else sections.by_headings(lines, level)
    return sections.with_action(cut).join(docs.select("doc_id", "file_name"), "doc_id")


def by_model(docs: DataFrame, caller: Callable[[list[str]], list[str]], model: str, level: str = "auto", patterns: list[str] | None = None, hints: str = "", tasks: int | None = None, keep: Callable[[DataFrame], DataFrame] = kept, whole: bool = False, request: bool = False, calls: str | None = None) -> Extraction:
    """Cases from the replies of ``caller`` to the sections that look like cases, and placeholders for empty ones.

    ``whole``: documents are not cut into sections; ``request``: all documents are one scope of merging.
    ``calls``: a folder of answers, see ledger.call_once: failures worth it are tried again, and what was answered is not asked again.
    ``keep`` is given sections, replies and what was parsed of them and has to write and reread them, so that no document is cut,
    no call made and no reply parsed twice: cases, errors and details all read them.
    """
    planned = keep(planned_sections(docs, level, patterns, whole))
    asked = replies.requests(planned.where("action = 'extract'"), model, hints)
    answered = keep(ledger.call_once(asked, caller, calls, tasks=tasks) if calls else replies.call(asked, caller, tasks).withColumn("attempt", F.lit(1)))
    parsed = keep(replies.with_cases(answered).join(planned.select("doc_id", "section_no", "title", "file_name"), ["doc_id", "section_no"]))
    raw = replies.case_rows(parsed).unionByName(sections.placeholder_cases(planned))
    good = parsed.where("error IS NULL").select("doc_id", "section_no")
    details = report.section_details(prep.prepared(docs), planned, asked.select("doc_id", "section_no", "truncated").join(good, ["doc_id", "section_no"]))
    return _merged(raw, request, kept, errors=replies.section_errors(parsed), sections=planned, details=details, calls=answered, told=parsed.select("doc_id", "section_no", "title", "error", "attempt", F.when(F.col("error").isNull(), F.size("cases")).alias("n_rows")))

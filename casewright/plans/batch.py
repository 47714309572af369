"""The batch job: a folder of documents to one output for each, with resume, a failure log and a summary."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from casewright.functions import text as X
from casewright.operators import report, template
from casewright.plans import jobs
from casewright.sources import clustered, commits, files, listed, pages, sinks, word
from casewright.sources.work import kept

#: Paths that are sent to all tasks.
MOST_SENT = 100_000


@dataclass(frozen=True)
class Options:
    """What a run does; ``caller`` asks a model section by section, without it templates are used."""

    recursive: bool = False
    force: bool = False
    by_suffix: bool = False
    strict: bool = False
    skip_empty_rows: bool = False
    templates: list[template.Template] | None = None
    caller: Callable[[list[str]], list[str]] | None = None
    model: str = ""
    level: str = "auto"
    patterns: list[str] | None = None
    hints: str = ""
    tasks: int | None = None
    #: A document is asked as a whole, without sections; runs of one id are merged over all documents of the run.
    whole: bool = False
    request: bool = False
    #: What the caller sends beside payloads; the audit has it without tokens.
    headers: dict[str, str] = field(default_factory=dict)
    #: Export a folder for each document; without, for very many documents, read them by sources.clustered.document.
    folders: bool = True


def read_folder(spark: SparkSession, source: str, options: Options, only: DataFrame | None = None, blocks: DataFrame | None = None) -> DataFrame:
    """doc_id, path, file_name, out_name, reason, detail and doc_text of the files of a folder; doc_id is the place by path.

    With ``only`` (path), files that it does not have are neither opened nor numbered.  Files are listed without their
    bytes and opened by the tasks that parse them, see sources.listed.  ``blocks``: positioned blocks of pdf files, see
    page_documents, with path for doc_id.
    """
    found = files.listed(spark, source, options.recursive)
    if only is not None:
        found = found.join(F.broadcast(only) if only.limit(MOST_SENT + 1).count() <= MOST_SENT else only, "path", "left_semi")
    about = kept(files.admitted(listed.numbered(found)).withColumn("out_name", files.output_name(F.col("path"), options.by_suffix)))
    texts = word.word_texts(listed.read_listed(about.where("kind = 'ok' AND suffix = '.docx'")))
    if blocks is not None:
        read = pages.page_documents(blocks.withColumnRenamed("path", "doc_id")).withColumnRenamed("doc_id", "path")
        given = blocks.select("path").distinct().join(read, "path", "left")
        texts = texts.unionByName(given.select("path", F.coalesce("doc_text", F.lit("")).alias("doc_text"), F.lit(None).cast("string").alias("error")))
    rows = about.join(texts, "path", "left")
    unread = (F.col("kind") == "ok") & (F.col("suffix") == ".pdf") & F.col("doc_text").isNull()
    reason = F.coalesce("reason", F.when(F.col("error").isNotNull(), "exception"), F.when(unread, "unsupported"), F.when(X.is_blank(F.coalesce("doc_text", F.lit(""))), "empty_text"))
    detail = F.coalesce("detail", "error", F.when(unread, "Give positioned blocks of this file to page_documents"), F.when(reason == "empty_text", "No text could be extracted"))
    return rows.select(F.col("doc_ord").alias("doc_id"), "path", "file_name", "out_name", reason.alias("reason"), detail.alias("detail"), "doc_text")


def one_of_each_name(inputs: DataFrame) -> DataFrame:
    """``inputs`` (path, out_name, reason, detail): of good documents of one out_name all but the first by path are "name_taken"."""
    nth = F.row_number().over(Window.partitionBy("out_name").orderBy(F.col("reason").isNotNull(), "path"))
    taken = F.col("reason").isNull() & (F.col("_nth") > 1)
    first = F.concat(F.lit("Output "), "out_name", F.lit(" belongs to another document of this run"))
    marked = inputs.withColumn("_nth", nth).withColumns({"detail": F.when(taken, first).otherwise(F.col("detail")), "_taken": taken})
    return marked.withColumn("reason", F.when(F.col("_taken"), "name_taken").otherwise(F.col("reason"))).drop("_nth", "_taken")


def _messages(inputs: DataFrame, got: jobs.Extraction, request: bool) -> DataFrame:
    """place and message of files, sections and duplicates, in the order in which they are told."""
    named = inputs.select("doc_id", "file_name")
    told = inputs.select(F.lit(0).alias("scope"), F.col("doc_id").alias("doc_ord"), "file_name", "detail")
    failed = got.errors if got.errors is not None else inputs.limit(0).select("doc_id", F.lit(0).alias("section_no"), F.lit("").alias("message"))
    failed = failed.join(named, "doc_id").select(F.lit(0).alias("scope"), F.col("doc_id").alias("doc_ord"), "section_no", "file_name", "message")
    doc = F.col("first.doc_id") if request else F.col("doc_id")
    warned = got.warnings.select(F.lit(0).alias("scope"), F.struct(doc.alias("doc_ord")).alias("first"), "warning")
    return report.messages(told, failed, warned).select("place", "message")


def export(spark: SparkSession, output: str, run: str, folders: bool = True) -> None:
    """Writes a committed run's documents, one folder each if ``folders``, and its feed as JSON lines, and says so in the log; doing it again changes nothing."""
    if folders:
        sinks.write_outputs(spark.read.parquet(f"{output}/cases/run={run}"), f"{output}/rows")
    spark.read.parquet(f"{output}/feed/run={run}").write.mode("overwrite").json(f"{output}/events/run={run}")
    commits.commit(spark, output, run, exported=True)


def run_folder(spark: SparkSession, source: str, output: str, options: Options = Options(), blocks: DataFrame | None = None) -> DataFrame:
    """Extract the documents of ``source`` that ``output`` does not have yet; returns the counts of the run.

    A run stages its cases (few files, sorted by document, with an index, see sources.clustered), results, failures, messages, audit, feed (see report.job_events) and manifest (what is done) below ``output``, and one entry of
    the log makes all of them visible; read them with sources.commits.  After that ``rows`` (one folder for each
    document) and ``events`` (the feed as streaming.events reads it) are exported, and a later run exports what a lost one could not.  What was never
    committed is swept away.  work: texts and replies of this run, so that nothing is read twice; calls: answers of
    the caller as they come, which a run after a lost one takes over instead of asking again.  Documents
    without rows are tried again.  Of documents whose outputs have one name the first by path that can be read is taken;
    the others are skipped with a record: ``by_suffix`` tells a docx and a pdf apart.  ``blocks``: see :func:`read_folder`.
    """
    commits.sweep(spark, output)
    for r in commits.commits(spark, output).where("NOT exported").collect():
        export(spark, output, r.run, options.folders)
    manifest = commits.committed(spark, output, "manifest")
    done = manifest.select("out_name").distinct() if manifest is not None else spark.createDataFrame([], "out_name string")
    run, steps = uuid.uuid4().hex, []

    def keep(df: DataFrame) -> DataFrame:
        steps.append(f"{output}/work/{len(steps)}")
        df.write.mode("overwrite").parquet(steps[-1])
        return spark.read.schema(df.schema).parquet(steps[-1])

    inputs_found = files.listed(spark, source, options.recursive).select("path").withColumn("out_name", files.output_name(F.col("path"), options.by_suffix))
    todo = files.not_done(inputs_found, done, options.force).select("path")
    texts = keep(read_folder(spark, source, options, None if options.force else todo, blocks))
    if options.caller is None:
        named = template.with_template(texts.where("reason IS NULL").select("doc_id", "doc_text"), options.templates).select("doc_id", "template")
        inputs = texts.drop("doc_text").join(named, "doc_id", "left").withColumn("reason", F.coalesce("reason", F.when(F.col("template").isNull(), "no_template")))
    else:
        inputs = texts.drop("doc_text").withColumn("template", F.when(F.col("reason").isNull(), F.lit(f"LLM ({options.model})")))
    inputs = keep(one_of_each_name(inputs))
    good = texts.join(inputs.where("reason IS NULL").select("doc_id"), "doc_id", "left_semi").select("doc_id", "file_name", "doc_text")
    if options.caller is None:
        got = jobs.by_template(good, options.templates, options.request, keep)
    else:
        got = jobs.by_model(good, options.caller, options.model, options.level, options.patterns, options.hints, options.tasks, keep, options.whole, options.request, calls=f"{output}/calls")
        calls = got.calls.select("doc_id", "section_no", F.when(F.col("error").isNull(), "response").otherwise("error").alias("event"), "error", F.char_length("content").alias("reply_chars"))
        headers = F.create_map(*(F.lit(x) for pair in options.headers.items() for x in pair)) if options.headers else F.lit(None).cast("map<string,string>")
        commits.stage(sinks.audit_rows(calls.withColumn("headers", headers)), output, "audit", run)
    cases = keep(got.cases.join(inputs.select("doc_id", "out_name"), "doc_id"))
    clustered.write(cases, f"{output}/cases/run={run}", f"{output}/index/run={run}")
    results = report.file_results(inputs, got.raw.select("doc_id"), got.errors, got.details)
    exists = F.coalesce(F.col("reason") == "name_taken", F.lit(False))
    results = keep(report.with_status(results.withColumn("exists", exists), options.skip_empty_rows))
    commits.stage(results.drop("exists"), output, "results", run)
    commits.stage(report.failure_records(results), output, "failures", run)
    commits.stage(_messages(inputs, got, options.request), output, "messages", run)
    commits.stage(report.job_events(results, cases.drop("out_name"), got.errors, got.told), output, "feed", run)
    commits.stage(results.where("status = 'written'").select("out_name", "path"), output, "manifest", run)
    commits.commit(spark, output, run)
    commits.delete(spark, f"{output}/calls")
    export(spark, output, run, options.folders)
    skipped = inputs_found.join(todo, "path", "left_anti").select(F.lit("skipped").alias("status"))
    return report.batch_summary(results.select("status").unionByName(skipped), options.strict)

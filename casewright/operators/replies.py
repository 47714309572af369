"""Requests to a model, and case rows from its replies."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from casewright.functions import text as X
from casewright.functions.schemas import CASE, CASE_FIELDS, REPLY_CHOICES

# The errors that callers tell apart.
EMPTY, INVALID = "LLM returned empty content.", "Model output was not valid JSON: "
NO_CASES, NOT_ARRAY, NOT_OBJECT = 'JSON must contain a "test_cases" array.', '"test_cases" must be an array.', "JSON must be an object."
NO_CHOICES = "LLM returned no choices."
TEMPERATURE = 0.2
#: What a reply has to be for :func:`with_cases` to take it: the fields of a case, all strings.
PROMPT = (
    "Return one JSON object, no other text. Its key test_cases holds an array with an object for each test case of the user's text, each with these string fields: "
    + ", ".join(CASE_FIELDS)
    + ". A field that the text does not fill is an empty string; what is done goes to procedure_steps, what should follow to expected_results. Hints in the message tell what identifiers look like."
)


def requests(chunks: DataFrame, model: str, hints: str = "", json_mode: bool = True, most: int = 120_000) -> DataFrame:
    """Adds payload (JSON), truncated and doc_char_count to (doc_id, section_no, file_name, title, body)."""
    section = F.when(F.coalesce("title", F.lit("")) != "", F.concat(F.lit("Section: "), F.col("title"), F.lit("\n\n"))).otherwise("")
    # fixed values: the parts of the message, as callers know them
    hint = f"User hints about identifiers / section titles (from human): {hints.strip()}\n\n" if hints.strip() else ""
    content = F.concat(F.lit("Filename: "), F.col("file_name"), F.lit("\n"), section, F.lit(hint), F.lit("--- Document text ---\n\n"), X.truncated(F.col("body"), most))
    message = lambda role, text: F.struct(F.lit(role).alias("role"), text.alias("content"))
    parts = [F.lit(model).alias("model"), F.array(message("system", F.lit(PROMPT)), message("user", content)).alias("messages"), F.lit(TEMPERATURE).alias("temperature")]
    if json_mode:
        parts.append(F.struct(F.lit("json_object").alias("type")).alias("response_format"))
    return chunks.withColumns({"payload": F.to_json(F.struct(*parts)), "truncated": F.char_length("body") > most, "doc_char_count": F.char_length("body").cast("long")})


def call(requested: DataFrame, caller: Callable[[list[str]], list[str | Exception]], tasks: int | None = None) -> DataFrame:
    """doc_id, section_no, content and error, from ``caller``, which maps payloads to replies, batch by batch.

    Payloads are spread over ``tasks`` by their section, for calls differ in length.  A caller may give an exception in
    place of a reply.  A batch whose call raises is called one by one, for its replies are lost; each call that fails has
    its error in place of content: nothing stops the job.
    """
    spread = ["doc_id", "section_no"]
    dealt = requested.repartition(tasks, *spread) if tasks else requested.repartition(*spread)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            try:
                content = list(caller(b.payload.tolist()))
                if len(content) != len(b):
                    raise ValueError("as many replies as requests are expected")
                error = [str(c) if isinstance(c, Exception) else None for c in content]
                content = [None if isinstance(c, Exception) else c for c in content]
            except Exception:
                content, error = [], []
                for p in b.payload:
                    try:
                        content.append(caller([p])[0])
                        error.append(None)
                    except Exception as e:
                        content.append(None)
                        error.append(str(e))
            yield pd.DataFrame({"doc_id": b.doc_id, "section_no": b.section_no, "content": content, "error": error})

    kinds = {f.name: f.dataType.simpleString() for f in requested.schema}
    return dealt.select(*spread, "payload").mapInPandas(run, f"doc_id {kinds['doc_id']}, section_no {kinds['section_no']}, content string, error string")


def reply_parts(lines: DataFrame) -> DataFrame:
    """request_id, seq, done and part of each line: whether it is [DONE], or what it adds to the reply, null if nothing."""
    data = F.when(F.col("line").startswith("data: "), X.strip(F.substring("line", 7, 1 << 30)))
    rows = lines.select("request_id", F.col("seq").cast("long").alias("seq"), data.alias("data"))
    choices = F.from_json("data", REPLY_CHOICES)["choices"]
    said = F.flatten(F.transform(choices, lambda c: F.array(c["delta"]["content"], c["message"]["content"])))
    part = F.array_join(F.filter(said, lambda x: x.isNotNull()), "")
    return rows.select("request_id", "seq", F.coalesce(F.col("data") == "[DONE]", F.lit(False)).alias("done"), part.alias("part"))


def assembled(lines: DataFrame) -> DataFrame:
    """request_id and content of streamed replies, from (request_id, seq, line): what comes before [DONE], in order."""
    done = F.min(F.when(F.col("done"), F.col("seq"))).over(Window.partitionBy("request_id"))
    rows = reply_parts(lines).withColumn("_done", done).where("_done IS NULL OR seq < _done")
    pieces = F.sort_array(F.collect_list(F.when(F.col("part").isNotNull(), F.struct("seq", "part"))))
    got = rows.groupBy("request_id").agg(F.array_join(F.transform(pieces, lambda s: s["part"]), "").alias("content"))
    return lines.select("request_id").distinct().join(got, "request_id", "left").select("request_id", F.coalesce("content", F.lit("")).alias("content"))


def completion_content(reply: Column) -> Column:
    """The content of a reply in one piece; empty without choices."""
    return F.coalesce(X.strip(F.get_json_object(reply, "$.choices[0].message.content")), F.lit(""))


def completion_error(reply: Column) -> Column:
    """The error of a reply in one piece that has no choices, or null."""
    return F.when(F.get_json_object(reply, "$.choices[0]").isNull(), F.lit(NO_CHOICES))


def _text(value: Any) -> str:
    """A value of the JSON as text; halves of surrogate pairs, which no column can hold, become question marks."""
    if value is None:
        return ""
    text = json.dumps(value, ensure_ascii=False) if isinstance(value, (list, dict)) else str(value).strip()
    return text.encode("utf-8", "replace").decode("utf-8")


def _cases(content: str | None, unfenced: str | None) -> tuple[str | None, list[dict[str, str]]]:
    if not (content or "").strip():
        return EMPTY, []
    try:
        parsed = json.loads(unfenced)
    except ValueError as e:
        return INVALID + str(e), []
    except RecursionError:
        return INVALID + "nested too deeply", []
    if not isinstance(parsed, dict):
        return NOT_OBJECT, []
    found = parsed.get("test_cases")
    if found is None:
        return NO_CASES, []
    if not isinstance(found, list):
        return NOT_ARRAY, []
    try:
        return None, [{k: _text(x.get(k)) for k in CASE_FIELDS} for x in found if isinstance(x, dict)]
    except RecursionError:
        return INVALID + "nested too deeply", []


@F.pandas_udf(T.StructType([T.StructField("error", T.StringType()), T.StructField("cases", T.ArrayType(CASE))]))
def parse_cases(content: pd.Series, unfenced: pd.Series) -> pd.DataFrame:
    """error and cases of each reply, with Python's JSON rules for values that are no strings."""
    return pd.DataFrame([_cases(c, u) for c, u in zip(content, unfenced)], columns=["error", "cases"])


def with_cases(replies: DataFrame) -> DataFrame:
    """Adds cases, and the error of the reply where its call had none, to (doc_id, section_no, content, error)."""
    got = replies.withColumn("_p", parse_cases("content", X.strip_fence(F.col("content"))))
    return got.withColumns({"error": F.coalesce("error", "_p.error"), "cases": F.when(F.col("error").isNull(), F.col("_p.cases"))}).drop("_p")


def case_rows(parsed: DataFrame, file_name: str = "file_name") -> DataFrame:
    """A row for each case of the good replies; the reply's file name, or else the document's."""
    rows = parsed.where("error IS NULL").select("doc_id", "section_no", F.col(file_name).alias("_file"), F.posexplode("cases").alias("case_no", "c"))
    name = F.coalesce(F.nullif(X.strip(F.col("c.file_name")), F.lit("")), F.col("_file"))
    return rows.select("doc_id", "section_no", (F.col("case_no") + 1).alias("case_no"), name.alias("file_name"), *(F.col(f"c.{c}").alias(c) for c in CASE_FIELDS[1:]))


def section_errors(parsed: DataFrame) -> DataFrame:
    """doc_id, section_no and message of each section that failed."""
    message = F.concat(F.lit('Section "'), X.short_title(F.coalesce("title", F.lit(""))), F.lit('": '), F.col("error"))
    return parsed.where("error IS NOT NULL").select("doc_id", "section_no", message.alias("message"))


def to_resubmit(requested: DataFrame, results: DataFrame, keys: list[str]) -> DataFrame:
    """The requests without a good result whose failure is worth another try."""
    good = results.where("error IS NULL").select(*keys)
    again = results.where(X.is_retryable(F.col("error"))).select(*keys).distinct()
    return requested.join(good, keys, "left_anti").join(again, keys, "left_semi")


def running_totals(sections: DataFrame) -> DataFrame:
    """Adds section_index and cumulative_rows to (doc_id, section_no, n_rows)."""
    w = Window.partitionBy("doc_id").orderBy("section_no")
    return sections.withColumns({"section_index": F.row_number().over(w), "cumulative_rows": F.sum("n_rows").over(w.rowsBetween(Window.unboundedPreceding, 0))})

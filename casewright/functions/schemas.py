"""Schemas of the tables that jobs exchange.  No schema is inferred from data."""

from pyspark.sql import types as T


def _strings(*names: str) -> list[T.StructField]:
    return [T.StructField(n, T.StringType()) for n in names]


CASE_FIELDS = ("file_name", "test_id", "test_name", "description", "preconditions", "procedure_steps", "expected_results")
#: Fields that runs of one test id join; labels of the export.
TEXT_FIELDS = CASE_FIELDS[3:]
LABELS = dict(zip(CASE_FIELDS, ("File Name", "Test ID", "Test Name", "Description", "Preconditions / Applicability", "Procedure / steps", "Expected results")))
CASE = T.StructType(_strings(*CASE_FIELDS))
CASES = T.StructType([*_strings("request_id"), T.StructField("doc_ord", T.IntegerType()), T.StructField("section_no", T.IntegerType()), T.StructField("case_no", T.IntegerType()), *CASE.fields])
BLOCKS = T.StructType([*_strings("path"), T.StructField("block_no", T.IntegerType()), *_strings("kind", "style"), T.StructField("level", T.IntegerType()), *_strings("text"), T.StructField("cells", T.ArrayType(T.ArrayType(T.StringType())))])
PAGE_BLOCKS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("page", T.IntegerType()), *[T.StructField(n, T.DoubleType()) for n in ("top", "left", "bottom")], *_strings("kind", "text"), T.StructField("cells", T.ArrayType(T.ArrayType(T.StringType())))])
FILES = T.StructType([*_strings("path"), T.StructField("modificationTime", T.TimestampType()), T.StructField("length", T.LongType()), T.StructField("content", T.BinaryType())])
FILE_RESULT = T.StructType([*_strings("filename", "template"), T.StructField("rows", T.LongType()), T.StructField("ok", T.BooleanType()), *_strings("reason", "detail")])
PROGRESS = T.StructType([*_strings("step", "file", "title", "error"), *[T.StructField(n, T.LongType()) for n in ("index", "total", "rows_in_section", "cumulative_rows")]])
EVENTS = T.StructType([*_strings("job_id"), T.StructField("seq", T.LongType()), *_strings("type"), T.StructField("data", PROGRESS), *_strings("message"), T.StructField("rows", T.ArrayType(CASE)), T.StructField("errors", T.ArrayType(T.StringType())), *_strings("template"), T.StructField("file_results", T.ArrayType(FILE_RESULT))])
FAILURES = T.StructType([*_strings("file", "phase", "reason", "detail"), T.StructField("errors", T.ArrayType(T.StringType())), *_strings("error")])
REPLY_CHOICES = "choices array<struct<delta:struct<content:string>,message:struct<content:string>>>"

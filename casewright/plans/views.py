"""Plan documents, replies and job feeds derived by rule from the general tables, so that queries have inputs of their size."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


PLAN_CASE = """CASE (doc_id*7 + pos*5) % 29
  WHEN 0 THEN '# Introduction'
  WHEN 1 THEN concat('## Check item TC_', CAST(doc_id AS VARCHAR(20)), '_', CAST(pos AS VARCHAR(20)))
  WHEN 2 THEN '# 1. Revision History'
  WHEN 3 THEN 'Preconditions:'
  WHEN 4 THEN 'Test Steps:'
  WHEN 5 THEN 'Step | Expected Result'
  WHEN 6 THEN '1 | open page | page shown'
  WHEN 7 THEN concat('Scope ........ ', CAST(pos AS VARCHAR(20)))
  WHEN 8 THEN concat('# Area ', CAST(pos AS VARCHAR(20)))
  WHEN 9 THEN concat('### Detail VZ_TC_A_', CAST(pos AS VARCHAR(20)))
  WHEN 10 THEN ''
  WHEN 11 THEN '# Appendix A: Glossary'
  WHEN 12 THEN concat('## Check item TC_', CAST(doc_id AS VARCHAR(20)), '_X')
  WHEN 13 THEN '2 | submit form | saved'
  WHEN 14 THEN concat('## Check item TC_', CAST(doc_id AS VARCHAR(20)), '_X')
  ELSE raw END"""
REPLY_CASE = """CASE conv_id % 6
  WHEN 0 THEN concat('{"test_cases":[{"test_id":"TC_', CAST(conv_id AS VARCHAR(20)), '","test_name":" name ', CAST(turn AS VARCHAR(20)), ' ","description":"d"}]}')
  WHEN 1 THEN concat('```json', chr(10), '{"test_cases":[{"test_id":"TC_', CAST(conv_id AS VARCHAR(20)), '","file_name":"f.docx"},{"test_id":"TC_X","procedure_steps":"s"}]}', chr(10), '```')
  WHEN 2 THEN concat('{"test_cases": [', CAST(turn AS VARCHAR(20)))
  WHEN 3 THEN concat('{"cases":', CAST(turn AS VARCHAR(20)), '}')
  WHEN 4 THEN '{"test_cases":"none"}'
  ELSE '' END"""
FAILED_CASE = """CASE event_id % 7 WHEN 0 THEN 'HTTP error 429' WHEN 1 THEN 'HTTP error 400' WHEN 2 THEN 'HTTP error 503: busy'
  WHEN 3 THEN 'the call timed out' WHEN 4 THEN 'Model output was not valid JSON: x' WHEN 5 THEN 'Could not reach LLM server' ELSE NULL END"""
PATH_CASE = """concat('/in/', replace(p_name, ' ', '_'), CASE p_partkey % 4 WHEN 0 THEN '.docx' WHEN 1 THEN '.pdf' WHEN 2 THEN '.PDF' ELSE '.txt' END)"""
FILE_CASE = "concat('plan_', CAST(doc_id AS VARCHAR(20)), CASE doc_id % 4 WHEN 0 THEN '.docx' WHEN 1 THEN '.pdf' WHEN 2 THEN '.PDF' ELSE '.txt' END)"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def plan_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return docs.select("doc_id", F.posexplode(F.split("text", "\n")).alias("pos", "raw")).select("doc_id", "pos", F.expr(PLAN_CASE).alias("line"))


def plan_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, file_name and doc_text; rebuilt in the row, without a shuffle."""
    docs = _table(spark, sf_dir, "documents")
    lines = F.expr(f"array_join(transform(split(text, '\\n'), (raw, pos) -> {PLAN_CASE}), '\\n')")
    return docs.select("doc_id", F.expr(FILE_CASE).alias("file_name"), lines.alias("doc_text"))


def reply_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").where("role = 'assistant'")
    file_name = F.expr("concat('conv_', CAST(conv_id AS VARCHAR(20)), '.docx')")
    return rows.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("section_no"), F.expr(REPLY_CASE).alias("content"), F.lit(None).cast("string").alias("error"), file_name.alias("file_name"), F.expr("concat('Section ', CAST(turn AS VARCHAR(20)))").alias("title"))


def sse_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("request_id"), "turn")
    line = F.expr("""concat('data: {"choices":[{"delta":{"content":"t', CAST(turn AS VARCHAR(20)), '"}}]}')""")
    said = rows.select("request_id", F.col("turn").alias("seq"), line.alias("line"))
    ends = rows.groupBy("request_id").agg(F.max("turn").alias("m"))
    done = ends.select("request_id", (F.col("m") + 1).alias("seq"), F.lit("data: [DONE]").alias("line"))
    stray = ends.select("request_id", (F.col("m") + 2).alias("seq"), F.lit('data: {"choices":[{"delta":{"content":"late"}}]}').alias("line"))
    return said.unionByName(done).unionByName(stray)


def job_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.expr("CASE event_type WHEN 'purchase' THEN 'result' WHEN 'error' THEN CASE WHEN user_id % 3 = 0 THEN 'error' ELSE 'progress' END ELSE 'progress' END")
    return _table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), kind.alias("type"), F.expr("concat('failed at ', CAST(event_id AS VARCHAR(20)))").alias("message"))


def failed_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), F.expr(FAILED_CASE).alias("error"))


def input_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "part").select("p_partkey", F.expr(PATH_CASE).alias("path"), (F.col("p_partkey") * 65536).alias("length"))


def merge_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of lineitem as case rows: scope l_orderkey, order l_linenumber, l_partkey, test_id."""
    text = F.expr("CASE WHEN l_linenumber % 3 = 0 THEN ' ' ELSE CAST(l_partkey AS VARCHAR(20)) END")
    return _table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_returnflag").alias("test_id"), *(text.alias(c) for c in ("description", "preconditions", "procedure_steps", "expected_results")))


def page_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    text = F.expr("CASE WHEN l_linenumber % 5 = 0 THEN '  ' ELSE concat(' part ', CAST(l_partkey AS VARCHAR(20)), ' ') END")
    table = F.array(F.array(F.lit("id"), F.lit(" flag ")), F.array(F.expr("CAST(l_partkey AS VARCHAR(20))"), F.col("l_returnflag")))
    return rows.select(
        F.col("l_orderkey").alias("doc_id"), F.expr("l_linenumber % 2").cast("int").alias("page"), F.col("l_quantity").cast("double").alias("top"), F.col("l_discount").cast("double").alias("left"), F.expr("l_partkey * 8 + l_linenumber").cast("int").alias("block_no"),
        F.when(F.col("l_linenumber") % 4 == 3, "table").otherwise("text").alias("kind"), F.when(F.col("l_linenumber") % 4 != 3, text).alias("text"), F.when(F.col("l_linenumber") % 4 == 3, table).alias("cells"),
    )


def page_words(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Words, tables and page sizes of suppliers' pages of lineitem rows: every 12th part is a table, every 7th supplier has no size."""
    rows = _table(spark, sf_dir, "lineitem").where("l_suppkey IS NOT NULL AND l_linenumber IS NOT NULL")
    number = (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("long")
    x, y = F.expr("CAST((l_orderkey * 31 + l_partkey) % 500 AS DOUBLE)"), F.expr("CAST((l_orderkey * 7 + l_partkey * 13) % 720 AS DOUBLE)")
    page, table = [F.col("l_suppkey").alias("doc_id"), F.col("l_linenumber").alias("page")], F.col("l_partkey") % 12 == 0
    cells = F.array(F.array(F.lit("id"), F.lit(" flag ")), F.array(F.expr("CAST(l_partkey AS VARCHAR(20))"), F.col("l_returnflag")))
    words = rows.where(~table).select(*page, x.alias("x0"), y.alias("top"), (x + 20).alias("x1"), (y + 8).alias("bottom"), number.alias("word_no"), F.expr("CASE WHEN l_orderkey % 9 = 0 THEN ' ' ELSE concat(' w', CAST(l_partkey AS VARCHAR(20))) END").alias("text"))
    height = F.expr("CAST(l_orderkey % 60 AS DOUBLE)")
    tables = rows.where(table).select(*page, x.alias("x0"), y.alias("top"), (x + 90).alias("x1"), (y + height).alias("bottom"), number.alias("table_no"), cells.alias("cells"))
    sizes = rows.where("l_suppkey % 7 <> 0").select(*page).distinct().select("*", F.lit(480.0).alias("width"), F.lit(700.0).alias("height"))
    return words, tables, sizes

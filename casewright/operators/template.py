"""Rule-based extraction of cases by templates."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from casewright.functions import text as X
from casewright.functions.schemas import CASE_FIELDS
from casewright.operators.lines import joined

# Fixed values of the template: labels, and words that tell a table of steps (found anywhere in a cell, so longer forms need no entry).
PRECONDITION_LABELS = ("preconditions", "precondition", "applicability", "prerequisites")
STEP_LABELS = ("steps", "test steps", "steps and expected results", "expected results", "procedure", "test procedure")
PROCEDURE_WORDS = ("step", "action", "expect", "result", "outcome", "procedure", "actual", "pass", "fail", "criteria", "description", "verification", "input", "output")
UNDERSCORE_ID = r"(?U)\b([A-Z][A-Z0-9]*(?:_[A-Z0-9]+){1,})\s*$"
HEADING_2 = r"(?Ud)^## .+$"


@dataclass(frozen=True)
class Template:
    """A kind of document: which texts are of it, and how their cases are found.

    ``matches`` maps the text column to a condition, ``extract`` documents (doc_id, file_name, doc_text) to rows
    (doc_id, section_no, file_name, test_id, test_name, description, preconditions, steps_expected).
    """

    name: str
    matches: Callable[[Column], Column]
    extract: Callable[[DataFrame], DataFrame]


def has_underscore_ids(text: Column) -> Column:
    """Whether a line starts with ## and ends with an id of capitals and underscores."""
    return F.exists(F.split(text, X.LINE_BREAKS), lambda x: x.startswith("## ") & x.rlike(UNDERSCORE_ID))


def underscore_cases(docs: DataFrame) -> DataFrame:
    """The cases of documents whose ## headings end in ids; sections of other ## headings go with their bodies.

    In a section, lines describe until a precondition label, tell preconditions until a step label or a table, and are
    dropped from then on; tables count if they begin after a step label or table, or if their first row has a word of
    procedures.
    """
    by_doc = Window.partitionBy("doc_id").orderBy("pos")
    rows = docs.select("doc_id", "file_name", F.posexplode(F.split("doc_text", "\n")).alias("pos", "line")).withColumn("opens", F.col("line").rlike(HEADING_2))
    rows = rows.withColumn("file_name", F.when(F.col("opens"), F.col("file_name"))).repartition("doc_id")  # only headings carry the name
    rows = rows.withColumn("section_no", F.sum(F.col("opens").cast("int")).over(by_doc))
    head = X.strip(F.regexp_replace(X.strip(F.col("line")), "^#+", ""))
    own = Window.partitionBy("doc_id", "section_no")
    rows = rows.where("section_no > 0").withColumn("head", F.max(F.when(F.col("opens"), head)).over(own)).where(F.col("head").rlike(UNDERSCORE_ID))
    rows = rows.select("doc_id", "section_no", "head", "file_name", F.when(F.col("opens"), F.lit("")).otherwise(F.col("line")).alias("line"), "pos")
    rows = rows.select("doc_id", "section_no", "head", "file_name", "pos", F.posexplode(F.split("line", X.LINE_BREAKS)).alias("part", "raw")).withColumn("s", X.strip(F.col("raw")))

    label = F.regexp_replace(F.lower("s"), ":+$", "")
    kind = F.when(F.col("s") == "", "blank").when(label.isin(*PRECONDITION_LABELS), "pre").when(label.isin(*STEP_LABELS), "step").when(F.contains("s", F.lit("|")) & (F.char_length("s") > 2), "row").otherwise("text")
    rows = rows.withColumn("kind", kind)
    event = F.when(F.col("kind") == "pre", "preconditions").when(F.col("kind").isin("step", "row"), "body")
    w = Window.partitionBy("doc_id", "section_no").orderBy("pos", "part")
    before = F.coalesce(F.last(event, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit("description"))
    rows = rows.withColumns({"state": before, "run": F.count_if(F.col("kind") != "row").over(w)})
    place = F.struct("pos", "part").alias("pos")
    text = lambda state: joined(F.when((F.col("kind") == "text") & (F.col("state") == state), F.col("s")), place)
    # one aggregation by run of table rows, then one by section; the exchange by document serves both
    runs = rows.groupBy("doc_id", "section_no", "head", F.when(F.col("kind") == "row", F.col("run")).alias("run")).agg(
        F.max("file_name").alias("file_name"), joined(F.when(F.col("kind") == "row", F.col("s")), place).alias("table"), F.min(F.when(F.col("kind") == "row", F.struct("pos", "part", "s", "state"))).alias("first"), text("description").alias("d"), text("preconditions").alias("p")
    )
    procedure = F.exists(X.cells(F.col("first.s")), lambda c: X.strip(F.lower(c)).rlike("|".join(PROCEDURE_WORDS)))
    kept = F.when(F.col("run").isNotNull() & ((F.col("first.state") == "body") | procedure), F.col("table"))
    done = runs.groupBy("doc_id", "section_no", "head").agg(
        F.max("file_name").alias("file_name"), F.max(F.when(F.col("run").isNull(), F.col("d"))).alias("description"), F.max(F.when(F.col("run").isNull(), F.col("p"))).alias("preconditions"), joined(kept, F.col("run").alias("pos"), "\n\n").alias("steps_expected")
    )
    return done.select(
        "doc_id", "file_name", F.col("section_no").cast("int").alias("section_no"), F.regexp_extract("head", UNDERSCORE_ID, 1).alias("test_id"), X.strip(F.regexp_replace("head", UNDERSCORE_ID, "")).alias("test_name"), F.coalesce("description", F.lit("")).alias("description"), F.coalesce("preconditions", F.lit("")).alias("preconditions"), "steps_expected"
    )


UNDERSCORE = Template("Underscore-ID Test Plan", has_underscore_ids, underscore_cases)
TEMPLATES: list[Template] = [UNDERSCORE]


def with_template(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """Adds template: the name of the first template that matches, or null."""
    found = [F.when(t.matches(F.col("doc_text")), F.lit(t.name)) for t in (TEMPLATES if templates is None else templates)]
    return docs.withColumn("template", F.coalesce(*found) if found else F.lit(None).cast("string"))


def template_cases(docs: DataFrame, templates: list[Template] | None = None) -> DataFrame:
    """The rows of every document under the template that takes it; documents without one give none."""
    templates = TEMPLATES if templates is None else templates
    named = with_template(docs, templates)
    out = None
    for t in templates:
        rows = t.extract(named.where(F.col("template") == t.name).drop("template")).withColumn("template", F.lit(t.name))
        out = rows if out is None else out.unionByName(rows)
    return out


def as_cases(rows: DataFrame) -> DataFrame:
    """Template rows in the columns of the export: a table that is not parted goes to procedure_steps."""
    fixed = {"procedure_steps": F.col("steps_expected"), "expected_results": F.lit("")}
    return rows.select("doc_id", "section_no", F.lit(1).alias("case_no"), *(fixed.get(c, F.col(c)).alias(c) for c in CASE_FIELDS))

"""A corpus pipeline: language, toxicity, near duplicates, benchmark leaks, and the mix of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from casewright.llm.common import small, table, written
from casewright.llm.decontaminate import without_leaks
from casewright.llm.jaccard import near_groups
from casewright.llm.language import identify
from casewright.llm.mixing import mixed_words
from casewright.llm.toxicity import TOXIC_AT, toxicity_score


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts in no language that the corpus declares, null and letterless ones included.

    What is decided depends on text, declaration and source alone, so rejected rows are told by these.
    """
    key = F.struct(F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"), "lang", "source")
    found = identify(docs.select(key.alias("key"), "text", "lang", "source"), declared=F.col("lang"), host=F.col("source"), id_col="key")
    rejected = small(written(found.where("NOT accepted").select("key").distinct(), "rejected"))
    return docs.select(F.struct("*").alias("row"), key.alias("key")).join(rejected, "key", "left_anti").select("row.*")


def not_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that score as toxic."""
    return docs.where(toxicity_score(docs, table(spark, sf_dir, "labels")) < TOXIC_AT)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates (five words, similarity 0.8) the row with the smallest id.

    Rows are told apart by id and text (128 bits of it), so different texts of one id stay, and rows without id are
    compared as well; they come last in their group.  Of rows with the same id and text one stays, the same in reruns.
    """
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", F.xxhash64("text").alias("h1"), F.xxhash64(F.lit(1), "text").alias("h2"))
    groups = written(near_groups(docs.select(key.alias("key"), "text"), size=5, percent=80, id_col="key"), "groups")
    others = small(written(groups.where("key <> component_id").select("key").distinct(), "others"))
    again = written(groups.where("n_shingles > 0 AND key = component_id").groupBy("key").count().where("count > 1").select("key"), "again")
    kept = docs.select(F.struct("*").alias("row"), key.alias("key")).join(others, "key", "left_anti")
    if not again.isEmpty():
        again = small(again)
        once = kept.join(again, "key", "left_semi").groupBy("key").agg(F.min_by("row", F.xxhash64("row")).alias("row"))
        kept = kept.join(again, "key", "left_anti").select("row").unionByName(once.select("row"))
    return kept.select("row.*")


def not_in_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that hold an item of the benchmark."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What the mix of sources takes of each document."""
    return mixed_words(docs)


STAGES = [
    ("language_id", known_language),
    ("toxicity", not_toxic),
    ("ngram_jaccard", one_of_each_group),
    ("decontamination", not_in_benchmark),
    ("source_mixing", mixed),
]
#: No stage but the sizes can be expressed in SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)

"""A log of committed runs: what a run wrote is seen from one atomic entry on, all of it or nothing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

COMMITS = "run string, at timestamp, exported boolean"
#: Tables that a run stages, by run; the cases of a document are those of its latest run.
TABLES = ("cases", "index", "results", "failures", "messages", "audit", "feed", "manifest")


def _children(spark: SparkSession, folder: str) -> list[tuple[str, object, object]]:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    system = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return [(s.getPath().getName(), s.getPath(), system) for s in system.listStatus(path)] if system.exists(path) else []


def qualified(spark: SparkSession, folder: str) -> str:
    """The folder with its file system, as tasks need it that do not read by Spark."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()


def delete(spark: SparkSession, folder: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def stage(df: DataFrame, output: str, what: str, run: str) -> None:
    """Writes a run's rows of a table; nobody sees them yet."""
    df.write.mode("overwrite").parquet(f"{output}/{what}/run={run}")


def commit(spark: SparkSession, output: str, run: str, exported: bool = False) -> None:
    """The entry that makes a run visible, or says that it is exported: one row in one file, which appears as a whole."""
    entry = spark.range(1).select(F.lit(run).alias("run"), F.current_timestamp().alias("at"), F.lit(exported).alias("exported"))
    entry.coalesce(1).write.mode("append").parquet(f"{output}/commits")


def commits(spark: SparkSession, output: str) -> DataFrame:
    """run, at (when it was committed) and exported, of the committed runs: a row a run."""
    if not _children(spark, f"{output}/commits"):
        return spark.createDataFrame([], COMMITS)
    return spark.read.schema(COMMITS).parquet(f"{output}/commits").groupBy("run").agg(F.min("at").alias("at"), F.max("exported").alias("exported"))


def committed(spark: SparkSession, output: str, what: str) -> DataFrame | None:
    """The rows of a table that committed runs wrote, with run; None if no run has."""
    runs = [r.run for r in commits(spark, output).select("run").collect()]  # a row a run of the job
    paths = [f"{output}/{what}/run={r}" for r in runs if _children(spark, f"{output}/{what}/run={r}")]
    return spark.read.option("basePath", f"{output}/{what}").parquet(*paths).withColumn("run", F.col("run").cast("string")) if paths else None


def latest(spark: SparkSession, output: str, what: str = "cases") -> DataFrame | None:
    """As :func:`committed`, but of each out_name only what its latest committed run wrote."""
    rows, done = committed(spark, output, what), committed(spark, output, "manifest")
    if rows is None or done is None:
        return None
    last = Window.partitionBy("out_name").orderBy(F.desc("at"), F.desc("run"))
    owner = done.select("out_name", "run").join(F.broadcast(commits(spark, output)), "run").withColumn("_n", F.row_number().over(last)).where("_n = 1")
    return rows.join(owner.select("out_name", "run"), ["out_name", "run"], "left_semi")


def sweep(spark: SparkSession, output: str) -> list[str]:
    """Deletes what runs staged that never were committed, and gives their names.  One run writes to an output at a time."""
    known = {f"run={r.run}" for r in commits(spark, output).select("run").collect()}
    gone = []
    for what in TABLES:
        for name, path, system in _children(spark, f"{output}/{what}"):
            if name.startswith("run=") and name not in known:
                system.delete(path, True)
                gone.append(name[4:])
    return sorted(set(gone))

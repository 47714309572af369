import random

import pytest
from pyspark.sql import functions as F

from casewright.operators import scan


@pytest.fixture(autouse=True)
def many_ranges(spark):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def plain(rows, reverse=False):
    out, sums = {}, {}
    for k, o, v in sorted(rows, key=lambda r: r[1], reverse=reverse):
        sums[k] = sums.get(k, 0) + v
        out[k, o] = sums[k]
    return out


@pytest.mark.parametrize("descending", [False, True])
def test_sums_run_over_ranges(spark, descending):
    rnd = random.Random(5)
    keys = ["a"] * 8 + ["b", None, "c"]  # one key has most rows, so it takes several ranges
    rows = [(rnd.choice(keys), i, rnd.randint(-5, 9)) for i in range(3000)]
    df = spark.createDataFrame(rows, "k string, o long, v long").repartition(5)
    order = F.col("o").desc() if descending else F.col("o")
    got = scan.running_sums(df, ["k"], [order], {"total": F.col("v"), "n": F.lit(1)}).collect()
    assert {(r.k, r.o): r.total for r in got} == plain(rows, descending) and len(got) == len(rows)
    assert {(r.k, r.o): r.n for r in got} == plain([(k, o, 1) for k, o, _ in rows], descending)
    placed = scan.in_ranges(df, ["k"], ["o"])
    assert placed.where("k = 'a'").select("_range").distinct().count() > 2
    assert scan.running_sums(df.limit(0), ["k"], ["o"], {"n": F.lit(1)}).collect() == []

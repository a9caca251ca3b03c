"""What jobs leave on disk between their steps."""

import time
from pathlib import Path
from urllib.parse import urlparse

from pyspark.sql import functions as F

from pagemill.llm.components import component_roots
from pagemill.session import cut_lineage

CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shuffle_files(spark):
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()
    return {f for top in folders for f in Path(top).rglob("shuffle_*")}


def left(spark, before):
    for _ in range(50):  # they are removed in the background
        if not (new := shuffle_files(spark) - before):
            break
        time.sleep(0.1)
    return new


def test_a_step_leaves_no_shuffle_files(spark):
    before, set_to = shuffle_files(spark), spark.conf.get(CLEANUP, "false")
    rows = spark.range(10_000).groupBy((F.col("id") % 97).alias("k")).count()
    step = cut_lineage(rows, "scratch-test")
    assert not left(spark, before)
    assert spark.conf.get(CLEANUP, "false") == set_to
    assert step.agg(F.sum("count")).first()[0] == 10_000


def test_components_keep_one_round(spark):
    home = Path(urlparse(spark.conf.get("spark.checkpoint.dir")).path, "pagemill")
    before, shuffles = set(home.glob("components-*")), shuffle_files(spark)
    path = [(i, i + 1) for i in range(40)]  # takes several rounds
    roots = component_roots(spark.createDataFrame([*path, (100, 101)], "a long, b long"))
    assert not left(spark, shuffles)
    (own,) = set(home.glob("components-*")) - before
    assert len(list(own.iterdir())) == 1
    assert {r["node"]: r["root"] for r in roots.collect()} == {**{i: 0 for i in range(1, 41)}, 101: 100}

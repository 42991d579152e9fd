from __future__ import annotations

import ast
import pathlib

import pytest
from pyspark.sql import functions as F

from quillon.errors import NoSharedFolder
from quillon.operators.index import build_postings
from quillon.operators.search import Collection
from quillon.plans.workspace import bucketed, filesystem, materialise, remove, scope, scratch_path, shared_root

ROOT = pathlib.Path(__file__).resolve().parent.parent


def test_scratch_is_in_the_shared_folder(spark):
    path = scratch_path(spark, "probe")
    spark.range(3).write.parquet(path)
    fs, where = filesystem(spark, path)
    assert fs.exists(where)
    remove(spark, path)
    assert not fs.exists(where) and scratch_path(spark, "probe") != path


def test_materialise_cuts_the_plan(spark):
    made = materialise(spark.range(10).withColumn("x", F.rand()))
    assert made.collect() == made.collect() and "Range" not in made._jdf.queryExecution().toString()


def test_bucketed_joins_without_exchange(spark):
    a = bucketed(spark.range(100).withColumnRenamed("id", "k"), "k", "probe_a")
    b = bucketed(spark.range(50).withColumnRenamed("id", "k"), "k", "probe_b")
    joined = a.join(b.hint("merge"), "k")
    assert joined.count() == 50
    assert "Exchange" not in joined._jdf.queryExecution().executedPlan().toString()


def test_scopes_remove_what_was_made_inside(spark):
    kept = scratch_path(spark, "kept")
    spark.range(3).write.parquet(kept)
    with scope(spark):
        made = materialise(spark.range(100).withColumn("x", F.rand()))
        inner = bucketed(made, "id", "inner")
        assert inner.count() == made.count() == 100 and spark.catalog.listTables() == []
        files = [f for frame in (inner,) for f in frame.inputFiles()]
        checkpoint = made._jdf.logicalPlan().rdd().getCheckpointFile().get()
        assert all(filesystem(spark, f)[0].exists(filesystem(spark, f)[1]) for f in [*files, checkpoint])
    assert not any(filesystem(spark, f)[0].exists(filesystem(spark, f)[1]) for f in [*files, checkpoint])
    assert spark.read.parquet(kept).count() == 3


def test_a_cluster_needs_a_shared_folder():
    from types import SimpleNamespace

    def session(master, setting=None):
        context = SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda _: setting), getCheckpointDir=lambda: None)
        return SimpleNamespace(sparkContext=context)

    for master in ("spark://host:7077", "yarn", "local-cluster[3,2,1024]", "k8s://host"):
        with pytest.raises(NoSharedFolder):
            shared_root(session(master))
        assert shared_root(session(master, "hdfs://host/shared/")) == "hdfs://host/shared"


def test_pages_read_few_buckets(spark, tmp_path):
    docs = spark.range(2000).select(F.col("id").alias("seq"), F.col("id").cast("string").alias("id"), F.lit("word").alias("t"), (F.col("id") % 7).cast("double").alias("n"))
    found = Collection(docs, {"t": "text", "n": "number"}).prepare(str(tmp_path / "d"), 16).with_index(str(tmp_path / "i"))
    page = found.docs.where(F.col("seq").isin([3, 4]))
    assert page.count() == 2 and page.rdd.getNumPartitions() == 1 < found.docs.rdd.getNumPartitions()  # tasks are made of the buckets' files
    assert "Exchange" not in build_postings(found.with_tokens(), found.searchable)._jdf.queryExecution().executedPlan().toString()
    assert found.index.sizes == {"t": (2000, 2000)} and [r.tf for r in found.index.point("t", "word", 5).collect()] == [1]


def test_nothing_imports_the_corpus_subpackage():
    for path in (ROOT / "quillon").rglob("*.py"):
        if "llm" in path.parts:
            continue
        for node in ast.walk(ast.parse(path.read_text())):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else [node.module or ""] if isinstance(node, ast.ImportFrom) else []
            assert not any(n.startswith("quillon.llm") for n in names), path


def test_no_local_checkpoints():
    for path in (ROOT / "quillon").rglob("*.py"):
        assert ".localCheckpoint(" not in path.read_text()

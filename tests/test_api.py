import os

import pytest
from pyspark.sql import functions as F

from tagloom.api import Engine, run_sync
from tagloom.plans.relations import relation

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="no tables")


def engine(spark):
    get = lambda n: relation(spark, SF, n)
    vectors = get("vectors")
    tags = vectors.select("memory_id", "tag_id")
    return Engine({"memories": get("memories"), "memory_tags": tags, "tags": get("event_tags"), "tag_events": get("tag_events"), "hits": get("hits"), "vectors": vectors.drop("tag_id"), "tensor": get("tensor"), "results": get("results")})


def test_tools(spark):
    e = engine(spark)
    assert e.dispatch("get_trends", limit=5).count() == 5
    space = e.dispatch("get_phase_space")
    assert space.count() == e.relations["tags"].count()
    q = e.relations["vectors"].filter("memory_id < 2").select(F.col("memory_id").alias("query_id"), "embedding")
    top = e.dispatch("retrieve_memories", queries=q, k=3).filter("rank = 1").collect()
    assert {(r["query_id"], r["memory_id"]) for r in top} == {(0, 0), (1, 1)}
    with pytest.raises(KeyError):
        e.dispatch("none")


def test_sync(spark, tmp_path):
    paths = run_sync(engine(spark), str(tmp_path))
    assert spark.read.parquet(paths["phase_space"]).count() > 0
    assert spark.read.parquet(paths["tag_relational_tensor"]).count() > 0

"""The plan of near_pairs against its SQL."""

from tagloom.plans import relations as R


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString() + df._jdf.queryExecution().executedPlan().toString()


def test_near_pairs_by_bands(spark, tmp_path):
    ids = [*range(-20, 40), 5, 5, 13, 100, 108, 109, 1000, None]
    rows = [(i, n % 4 if n % 9 else None) for n, i in enumerate(ids)]
    spark.createDataFrame(rows, "vec_id long, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = R.relation(spark, str(tmp_path), "near_pairs")
    want = spark.sql(R.RELATIONS["near_pairs"])
    assert got.dtypes == want.dtypes and want.count() > 100
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    assert "NestedLoop" not in plan_of(got) and "Cartesian" not in plan_of(got)

"""Reuse of stored tables."""

import shutil

from gridrun.sources.cache import cached, content_key


def test_cached_tables(spark, tmp_path):
    built = []
    data = spark.createDataFrame([(1, "a"), (2, None), (2, None)], "k long, `odd name` string")

    def get(df, **params):
        return cached(spark, "t", {"in": df}, params, lambda: built.append(1) or df.selectExpr("k + 1 as k"), str(tmp_path))

    assert sorted(r.k for r in get(data, p=1).collect()) == [2, 3, 3] and len(built) == 1
    assert sorted(r.k for r in get(data.repartition(3).orderBy("k", ascending=False), p=1).collect()) == [2, 3, 3] and len(built) == 1
    get(data, p=2)
    get(data.where("k = 1"), p=1)
    get(data.dropDuplicates(), p=1)
    get(data.limit(0), p=1)
    assert len(built) == 5 and get(data.limit(0), p=1).count() == 0
    path = next(p for p in tmp_path.iterdir() if p.name.endswith(content_key({"in": data}, {"p": 1})))
    (path / "_SUCCESS").unlink()
    shutil.rmtree(path / "_temporary", ignore_errors=True)
    assert sorted(r.k for r in get(data, p=1).collect()) == [2, 3, 3] and len(built) == 6

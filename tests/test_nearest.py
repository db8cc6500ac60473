"""Block-wise nearest rows against expressions over all pairs, on odd rows."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmesh.operators import nearest, retrieval
from quillmesh.plans import retrieval_queries


def _odd(spark):
    rng = random.Random(11)
    rows = [(i, [rng.choice([0.0, 1.0, -1.0, rng.gauss(0, 1)]) for _ in range(4)]) for i in range(120)]
    rows += [(200 + i, [1.0, 2.0, 3.0, 4.0]) for i in range(30)] + [(300 + i, [0.5, 0.25, 0.0, 0.0]) for i in range(20)]
    rows += [(400, None), (401, []), (402, [0.0] * 4), (403, [1.0, None, 2.0, 3.0]), (404, [math.nan, 1.0, 1.0, 1.0]), (405, [math.inf, 1.0, 1.0, 1.0]), (406, [1.0, 2.0]), (407, [1e-200] * 4), (408, [1e200] * 4), (409, [2.0, 1.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>")


@pytest.mark.parametrize("limit", [1, 5, 25, 500])
def test_cosine_lists_are_those_of_all_pairs(spark, limit):
    e = _odd(spark)
    asked = e.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")).filter("query_id % 10 < 6")
    key = lambda df: sorted((r.query_id, r.vec_id, repr(r.score)) for r in df.collect())
    every = retrieval.by_cosine(e, asked, limit=None)
    for per_block in (7, 4096):
        assert key(retrieval.by_cosine(e, asked, limit=limit, per_block=per_block)) == key(retrieval._first(every, "vec_id", limit))


def test_pairs_do_not_become_rows(spark, data):
    plan = retrieval_queries.ret_cosine_top40(spark, data)._jdf.queryExecution().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan
    plan = retrieval_queries.ret_recall_at_k(spark, data)._jdf.queryExecution().optimizedPlan().toString()
    assert "datasetA" not in plan  # the join of all pairs in a bucket, with both vectors


def test_recall_is_that_of_the_join_of_buckets(spark, data):
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector
    from pyspark.sql import Window

    from quillmesh.sources.tables import load

    e = load(spark, data, "embeddings").select("vec_id", array_to_vector(F.col("embedding").cast("array<double>")).alias("v"))
    model = BucketedRandomProjectionLSH(inputCol="v", outputCol="h", bucketLength=2.0, numHashTables=4, seed=7).fit(e)
    near = model.approxSimilarityJoin(e.filter("vec_id % 100 = 0"), e, 1.6, "dist").select(F.col("datasetA.vec_id").alias("query_id"), F.col("datasetB.vec_id").alias("vec_id"), "dist").filter("query_id <> vec_id")
    found = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("dist", "vec_id"))).filter("rank <= 40")
    want = retrieval.recall_at(retrieval_queries._neighbours(spark, data), found).first()
    assert retrieval_queries.ret_recall_at_k(spark, data).first() == want


def test_rounding_is_that_of_spark(spark):
    rng = random.Random(2)
    x = [rng.uniform(-1, 1) for _ in range(300)] + [round(rng.uniform(-1, 1), 7) for _ in range(300)] + [0.0, -0.0, 1.0, 0.1234565, -0.0000005, math.nan]
    want = [r[0] for r in spark.createDataFrame([(i, v) for i, v in enumerate(x)], "i int, v double").orderBy("i").select(F.round("v", 6)).collect()]
    assert [repr(v) for v in nearest.rounded(np.array(x)).tolist()] == [repr(v + 0.0) for v in want]

from pyspark.sql import functions as F

from wardstone.functions import features as X
from wardstone.operators import training as T
from wardstone.plans import learning


def test_strongest_buckets_equal_the_window_over_all_cells(spark):
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (4, "a a b . c"), (5, "x " * 3000), (6, "Ü ß , .")], "doc_id long, text string")
    weights = learning.closed_form_weights(spark).where("bucket % 3 <> 0")
    got = odd.select("doc_id", F.posexplode(X.strongest(weights, 5)(F.col("text")))).selectExpr("doc_id", "pos + 1 AS rank", "col.bucket", "col.contribution")
    want = T.top_features(X.hashed(odd, "text", "doc_id"), weights, "doc_id").select("doc_id", "rank", "bucket", "contribution")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_the_query_sorts_and_shuffles_no_cells(spark):
    plan = learning.top_features(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Join" not in plan and int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) < 10_000

import numpy as np
import pytest
from pyspark.sql import functions as F

from wardstone.operators import metrics as M
from wardstone.operators import ranklog as R


def rows(seed):
    rng = np.random.default_rng(seed)
    near = 0.5 + rng.integers(0, 40, 300) * 2.0**-52  # scores that part in their last bits alone
    score = np.r_[rng.random(300).round(2), near, -rng.random(60), [0.0, -0.0, 1e300, -1e300, 5e-324] * 8]
    out = [(i, f"g{i % 3}" if i % 10 else None, float(s) if i % 37 else None, int(rng.random() < 0.4)) for i, s in enumerate(score)]
    return [*out, (9001, "only benign", 0.5, 0), (9002, "only attacks", 0.5, 1), (9003, "unscored", None, 0)]


@pytest.mark.parametrize("keys", [(), ("g",)])
def test_equals_the_sorted_metrics_day_by_day(spark, tmp_path, keys):
    df = spark.createDataFrame(rows(3), "id long, g string, v double, y int")
    path, attack = str(tmp_path / "log"), F.col("y") == 1
    for day in range(4):
        R.add_day(df.where(F.col("id") % 4 == day), path, str(day), attack, "v", keys)
        R.add_day(df.where(F.col("id") % 4 == 0), path, "0", attack, "v", keys)  # comes again
        so_far = df.where(F.col("id") % 4 <= day)
        state = R.read_log(spark, path, keys)
        got = {tuple(r[k] for k in keys): r.auc for r in R.auc(state, keys).collect()}
        want = {tuple(r[k] for k in keys): r.auc for r in M.roc_auc(so_far.where("v is not null"), attack, "v", keys).collect()}
        assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in got)
    for rate in (0.0, 0.01, 0.2, 1.0):
        got = {tuple(r[k] for k in keys): (r.n, r.boundary) for r in R.threshold(state, rate, keys).collect()}
        want = {tuple(r[k] for k in keys): (r.n, r.boundary) for r in M.threshold_at_fpr(df.where("y = 0"), "v", rate, keys).collect()}
        assert all(got[k] == want[k] for k in want) and all(b is None for k, (_, b) in got.items() if k not in want and k != (None,))  # sorting leaves out the null group


def test_keys_order_as_scores_and_come_back(spark):
    v = [-np.inf, -1e300, -2.0, -5e-324, -0.0, 0.0, 5e-324, 1e-9, 0.5, 1.0, np.inf, None]
    got = spark.createDataFrame([(i, x) for i, x in enumerate(v)], "i int, v double").select("i", "v", R.score_key("v").alias("k")).select("i", "v", "k", R.score_of("k").alias("back")).orderBy("i").collect()
    keys = [r.k for r in got[:-1]]
    assert keys == sorted(keys) and len(set(keys)) == len(keys) - 1 and got[-1].k is None
    assert all(r.v == r.back for r in got)


def test_empty_logs(spark):
    none = R.counts(spark.createDataFrame([], "v double, y int"), F.col("y") == 1, "v")
    assert R.threshold(none, 0.1).collect() == [] and [r.auc for r in R.auc(none).collect()] in ([], [0.0])

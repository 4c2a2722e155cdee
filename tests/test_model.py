"""Forest, scaler, percentiles and evaluation."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from logtide.operators import evaluate, iforest, scaler
from logtide.operators.quantiles import percentiles, value_ranks
from logtide.schemas import FEATURE_COLUMNS
from logtide.session import scratch_path
from logtide.sources import tables


def labelled_rows(n=3000, odd=150, seed=5):
    """Bulk traffic and shifted outliers."""
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        rows.append((i, 1, int(rng.integers(0, 24)), float(np.clip(rng.normal(180, 40), 10, 500)), int(rng.choice([0, 1, 2])),
                     int(rng.choice([0, 1, 2], p=[0.1, 0.8, 0.1])), int(rng.integers(10, 200)), int(rng.integers(0, 5))))
    for i in range(n, n + odd):
        rows.append((i, -1, int(rng.integers(0, 5)), float(np.clip(rng.normal(6000, 1500), 3000, 9e4)), 4,
                     int(rng.choice([3, 4])), int(rng.integers(800, 3000)), int(rng.integers(0, 5))))
    return rows


@pytest.fixture(scope="module")
def data(spark):
    names = ", ".join(f"{c} {'double' if c == 'response_time_ms' else 'int'}" for c in FEATURE_COLUMNS)
    df = spark.createDataFrame(labelled_rows(), f"id bigint, true_label int, {names}")
    return df.select("id", "true_label", F.struct(*FEATURE_COLUMNS).alias("features"))


@pytest.fixture(scope="module")
def model(data):
    return iforest.fit_iforest(data, "id")


def test_average_path():
    assert iforest.average_path(1) == 0 and iforest.average_path(2) == 1
    assert float(iforest.average_path(256)) == pytest.approx(2 * (math.log(255) + 0.5772156649) - 2 * 255 / 256)


def test_tree_shape(model):
    per_tree = model.nodes.groupBy("tree").agg(
        F.max("samples").alias("rows"), F.sum(F.when(F.col("feature") < 0, F.col("samples"))).alias("leaf_rows")
    )
    rows = per_tree.collect()
    assert len(rows) == 100
    assert {r["rows"] for r in rows} == {256} and {r["leaf_rows"] for r in rows} == {256}
    deepest = model.nodes.filter("feature >= 0").agg(F.max("path")).first()[0]
    assert deepest < 8


def test_same_model_for_any_partitioning(data):
    a = iforest.fit_iforest(data.coalesce(1), "id", trees=10)
    b = iforest.fit_iforest(data.repartition(8), "id", trees=10)
    for x, y in zip(a.nodes.orderBy("tree", "node").collect(), b.nodes.orderBy("tree", "node").collect(), strict=True):
        # averages may differ in the last digit with the order of addition
        assert tuple(x) == pytest.approx(tuple(y), abs=1e-9)
    assert a.meta["offset"] == pytest.approx(b.meta["offset"], abs=1e-9)


def test_sampling_keeps_trees_apart(spark):
    rows = spark.range(200_000).select(F.col("id"), F.col("id").cast("double").alias("x"))
    picked = iforest.tree_samples(rows, ["x"], "id", 20, 256, 200_000, 1)
    sizes = picked.groupBy("tree").agg(F.count("*").alias("n"), F.count_distinct("x").alias("d"), F.avg("x").alias("m"))
    found = sizes.collect()
    assert {(r["n"], r["d"]) for r in found} == {(256, 256)}
    assert abs(np.mean([r["m"] for r in found]) - 100_000) < 6_000
    assert picked.select("x").distinct().count() > 3_500


def test_contamination_share(data, model):
    scored = iforest.score(data, model)
    share = scored.agg(F.avg(F.col("is_anomaly").cast("double"))).first()[0]
    assert share == pytest.approx(0.05, abs=0.005)
    odd = scored.groupBy("true_label").agg(F.avg("anomaly_score").alias("m"))
    mean = {r["true_label"]: r["m"] for r in odd.collect()}
    assert mean[-1] < mean[1]


def test_quality_gate(data, model):
    scored = iforest.score(data, model)
    report = evaluate.quality_gate(evaluate.classification_metrics(scored)).first()
    assert report["passed"], report


def test_threshold_is_used(data, model):
    scored = iforest.score(data, model, threshold=-0.05)
    assert scored.filter("is_anomaly <> (anomaly_score < -0.05)").filter("abs(anomaly_score + 0.05) > 1e-6").count() == 0
    assert scored.select("threshold_used").distinct().collect()[0][0] == -0.05


def test_model_versions(spark, data, model):
    root = scratch_path(spark, "models")
    tables.save_model(model, root, "v1")
    model2 = iforest.fit_iforest(data, "id", trees=5, scaled=False)
    tables.save_model(model2, root, "v2")
    again = tables.load_model(spark, f"{root}/v1")
    assert again.meta["offset"] == model.meta["offset"] and again.scaler.count() == 6
    newest = tables.newest_model(spark, root)
    assert newest.meta["version"] == "v2" and newest.scaler is None
    bad = scratch_path(spark, "bad")
    spark.createDataFrame([('{"algorithm": "other"}',)], "value string").write.text(f"{bad}/meta")
    with pytest.raises(TypeError):
        tables.load_model(spark, bad)


def test_scaler_constant_feature(spark):
    df = spark.createDataFrame([(1.0, 5.0), (3.0, 5.0)], "a double, b double")
    rows = {r["feature"]: (r["mean"], r["scale"]) for r in scaler.fit_scaler(df, ["a", "b"], None).collect()}
    assert rows == {"a": (2.0, 1.0), "b": (5.0, 1.0)}


def test_split_is_exact(spark):
    df = spark.range(1000).select(F.col("id"), F.when(F.col("id") % 10 == 0, -1).otherwise(1).alias("y"))
    found = scaler.stratified_split(df, "y", "id", 0.2).groupBy("y").agg(F.count_if("is_test").alias("t"))
    assert {r["y"]: r["t"] for r in found.collect()} == {-1: 20, 1: 180}


@pytest.mark.parametrize("width", [1e-3, 1.0, 1e6])
def test_percentiles(spark, width):
    rng = np.random.default_rng(3)
    values = np.concatenate([rng.normal(0, 5, 500), np.zeros(300)])
    df = spark.createDataFrame([(float(v),) for v in values], "x double")
    row = percentiles(df, "x", {"a": 0.0, "b": 0.05, "c": 0.5, "d": 0.9, "e": 1.0}, width).first()
    want = np.percentile(values, [0, 5, 50, 90, 100])
    assert [row[c] for c in "abcde"] == pytest.approx(list(want), abs=1e-9)


def test_ranks(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.5), ("b", 9.0)], "g string, x double")
    rows = {(r["g"], r["x"]): (r["n"], r["n_before"], r["n_all"]) for r in value_ranks(df, "x", by=["g"]).collect()}
    assert rows == {("a", 1.0): (2, 0, 3), ("a", 2.5): (1, 2, 3), ("b", 9.0): (1, 0, 1)}


def test_one_class(spark):
    df = spark.createDataFrame([(1, 1, 0.1), (1, 1, 0.2)], "true_label int, prediction int, anomaly_score double")
    m = evaluate.classification_metrics(df).first()
    assert (m["precision"], m["recall"], m["f1_score"], m["true_negative"]) == (0.0, 0.0, 0.0, 2)
    assert evaluate.roc_auc(df).first()["roc_auc"] is None


def test_auc_with_ties(spark):
    rows = [(-1, 0.1), (-1, 0.2), (1, 0.2), (1, 0.3)]
    df = spark.createDataFrame(rows, "true_label int, anomaly_score double")
    assert evaluate.roc_auc(df).first()["roc_auc"] == 0.875


def test_report(spark):
    rows = [(-1, -1, -0.2)] * 3 + [(1, -1, -0.1)] + [(1, 1, 0.2)] * 6
    df = spark.createDataFrame(rows, "true_label int, prediction int, anomaly_score double")
    r = evaluate.evaluation_report(df).first()
    assert r["metrics"]["precision"] == 0.75 and r["metrics"]["recall"] == 1.0
    assert r["dataset"]["total_samples"] == 10 and len(r["classification_report"]) == 5
    approx = evaluate.score_distribution(df, approx=True).first()
    assert approx["p50"] == pytest.approx(0.2)


def test_tree_samples_leave_out_rows_before_their_hashes_are_listed(spark):
    """The rows of a tree are those of its smallest hashes, and rows that no tree takes do not reach the listing."""
    rows = spark.range(4000).select(F.col("id").cast("string").alias("log_id"), F.col("id").cast("double").alias("a"))
    found = iforest.tree_samples(rows, ["a"], "log_id", 3, 4, 4000, 42)
    listed = found._jdf.queryExecution().optimizedPlan().toString()
    assert listed.index("Generate") < listed.index("exists(")
    for tree in range(3):
        hashed = rows.select("a", F.xxhash64(F.lit(43), F.lit(tree), "log_id").alias("h")).orderBy("h").limit(4).collect()
        got = found.where(F.col("tree") == tree).orderBy("pos").collect()
        assert [r["a"] for r in got] == [r["a"] for r in hashed]


def test_mean_path_of_every_row():
    rng = np.random.default_rng(3)
    x = rng.random((1100, 3))
    nodes = [(t, *node) for t in range(4) for node in iforest.grow_tree(x[:64], np.random.default_rng(t))]
    table = pd.DataFrame(nodes, columns=[f.name for f in iforest.NODES.fields])
    x[5, 1] = np.nan
    found = iforest.mean_path(x, iforest._arrays(table))
    for i in (*range(40), 511, 512, 1099):
        paths = []
        for _, tree in table.groupby("tree"):
            tree = tree.set_index("node")
            at = 0
            while tree.loc[at, "feature"] >= 0:
                at = tree.loc[at, "left" if x[i, tree.loc[at, "feature"]] <= tree.loc[at, "split"] else "right"]
            paths.append(tree.loc[at, "path"])
        assert found[i] == pytest.approx(np.mean(paths), abs=1e-12)

"""Isolation Forest (Liu, Ting, Zhou, ICDM 2008): trees grown and rows scored inside Spark tasks.

The score of a row is ``s = 2 ** (-E[h] / c(psi))``, ``h`` being its path length in a tree. The decision score
is ``-s - offset``; the offset is the contamination percentile of ``-s`` over the training rows, so about that
share of them is below zero.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logtide.operators.quantiles import percentiles
from logtide.operators.scaler import fit_scaler, scale_columns
from logtide.schemas import FEATURE_COLUMNS
from logtide.session import materialise

EULER = 0.5772156649
MAX_NODES = 4_000_000

NODES = T.StructType(
    [
        T.StructField("tree", T.IntegerType()),
        T.StructField("node", T.IntegerType()),
        T.StructField("feature", T.IntegerType()),
        T.StructField("split", T.DoubleType()),
        T.StructField("left", T.IntegerType()),
        T.StructField("right", T.IntegerType()),
        T.StructField("samples", T.IntegerType()),
        T.StructField("path", T.DoubleType()),
    ]
)


def average_path(n):
    """Expected path length of an unsuccessful search among ``n`` rows."""
    n = np.asarray(n, dtype=float)
    safe = np.maximum(n, 3.0)
    long = 2.0 * (np.log(safe - 1.0) + EULER) - 2.0 * (safe - 1.0) / safe
    return np.where(n > 2, long, np.where(n == 2, 1.0, 0.0))


def grow_tree(x: np.ndarray, rng: np.random.Generator) -> list[tuple]:
    """Nodes (node, feature, split, left, right, samples, path) of one random tree; a leaf has feature -1."""
    limit = int(np.ceil(np.log2(max(len(x), 2))))
    nodes: list[tuple] = []
    todo = [(np.arange(len(x)), 0, 0)]
    made = 1
    while todo:
        rows, node, depth = todo.pop()
        low, high = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(high > low)
        if depth >= limit or len(rows) <= 1 or len(usable) == 0:
            path = depth + float(average_path(len(rows)))
            nodes.append((node, -1, 0.0, -1, -1, len(rows), path))
            continue
        feature = int(rng.choice(usable))
        split = float(rng.uniform(low[feature], high[feature]))
        goes_left = x[rows, feature] <= split
        left, right = made, made + 1
        made += 2
        nodes.append((node, feature, split, left, right, len(rows), float(depth)))
        todo += [(rows[goes_left], left, depth + 1), (rows[~goes_left], right, depth + 1)]
    return nodes


@dataclass
class ForestModel:
    """Node, scaler and metadata tables. All are bounded by trees * samples, never by the data."""

    nodes: DataFrame
    scaler: DataFrame | None
    meta: dict = field(default_factory=dict)
    arrays: Broadcast | None = None
    training_scores: DataFrame | None = None  # (id, raw) of the training rows, while the model is at hand

    def release(self) -> None:
        """Drop the node arrays from the executors, as when a newer version takes over."""
        if self.arrays is not None:
            self.arrays.unpersist()
            self.arrays = None

    @property
    def columns(self) -> list[str]:
        return self.meta["features"]


def hash_bound(share: float) -> int:
    """Largest 64-bit hash among the lowest ``share`` of all hashes."""
    return 2**63 - 1 if share >= 1.0 else int(-(2**63) + share * (2**64 - 1))


def tree_samples(rows: DataFrame, columns: list[str], id_col: str, trees: int, psi: int, n: int, seed: int):
    """(tree, pos, features): for each tree ``psi`` rows without repeats, chosen by seeded hash.

    A row is a candidate of a tree if its hash for that tree is under a bound that leaves about 2*psi+64 candidates
    per tree; the ``psi`` smallest are taken. Every tree draws from all rows, and only candidates are shuffled. Rows that
    are no tree's candidate, nearly all of a large table, are left out before a hash per tree is put into an array.
    """
    bound = hash_bound(min(1.0, (2 * psi + 64) / max(n, 1)))
    every = F.sequence(F.lit(0), F.lit(trees - 1))

    def row_hash(t: Column) -> Column:
        return F.xxhash64(F.lit(seed + 1), t, F.col(id_col))

    picks = F.transform(every, lambda t: F.struct(t.alias("tree"), row_hash(t).alias("h")))
    candidates = rows.where(F.exists(every, lambda t: row_hash(t) <= bound)).select(
        *columns, F.col(id_col), F.explode(F.filter(picks, lambda p: p["h"] <= bound)).alias("p")
    ).select("p.tree", "p.h", *columns, F.col(id_col).cast("string").alias("_id"))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("h", "_id"))
    return candidates.withColumn("pos", rank).filter(F.col("pos") <= psi).drop("h", "_id")


def grow_forest(samples: DataFrame, columns: list[str], seed: int) -> DataFrame:
    """Node table, one task group of at most ``psi`` rows per tree."""

    def grow(pdf: pd.DataFrame) -> pd.DataFrame:
        tree = int(pdf["tree"].iloc[0])
        x = pdf.sort_values("pos")[columns].to_numpy(dtype=float)
        nodes = grow_tree(x, np.random.default_rng([seed, tree]))
        out = pd.DataFrame(nodes, columns=[f.name for f in NODES.fields[1:]])
        out.insert(0, "tree", tree)
        return out

    return samples.groupBy("tree").applyInPandas(grow, NODES)


def fit_iforest(
    df: DataFrame,
    id_col: str,
    columns: list[str] = FEATURE_COLUMNS,
    struct: str | None = "features",
    trees: int = 100,
    max_samples: int | str = "auto",
    contamination: float = 0.05,
    seed: int = 42,
    scaled: bool = True,
) -> ForestModel:
    """Fit scaler, trees and offset. Repeatable: the rows of a tree depend on seed and row id, not on partitions.

    ``df`` is read three times (scaler and row count, tree samples, offset), so give it as a stored table.
    """
    spark = df.sparkSession
    fitted = fit_scaler(df, columns, struct).collect()
    n = fitted[0]["n"]
    if not n:
        raise ValueError("no training rows")
    psi = min(256 if max_samples == "auto" else int(max_samples), n)
    if scaled:
        exprs = scale_columns(fitted, struct)
        scaler = spark.createDataFrame(
            [(r["feature"], r["mean"], r["scale"]) for r in fitted], "feature string, mean double, scale double"
        )
    else:
        exprs = {c: F.col(f"{struct}.{c}" if struct else c).cast("double") for c in columns}
        scaler = None
    rows = df.select(F.col(id_col), *[e.alias(c) for c, e in exprs.items()])
    nodes = grow_forest(tree_samples(rows, columns, id_col, trees, psi, n, seed), columns, seed)
    nodes = spark.createDataFrame(nodes.toArrow())  # at most trees * (2 * psi - 1) rows
    meta = {
        "algorithm": "IsolationForest",
        "trees": trees,
        "contamination": contamination,
        "max_samples": psi,
        "seed": seed,
        "features": columns,
        "training_rows": n,
        "offset": 0.0,
    }
    model = ForestModel(nodes, scaler, meta)
    # the percentile reads the scores twice, so they are stored rather than computed again
    raw = rows.select(F.col(id_col), raw_score(model, [F.col(c) for c in columns]).alias("raw"))
    raw = model.training_scores = materialise(raw, "scores")
    meta["offset"] = forest_offset(raw, contamination).first()["offset"]
    return model


def forest_offset(scores: DataFrame, contamination: float, score: str = "raw") -> DataFrame:
    """Offset: the contamination percentile of ``-s`` over the training rows."""
    return percentiles(scores, score, {"offset": contamination}, band_width=2.0**-20).select("offset")


def _arrays(nodes: pd.DataFrame) -> dict[str, np.ndarray]:
    """Node table as dense (tree, node) arrays; a leaf points to itself."""
    shape = (int(nodes["tree"].max()) + 1, int(nodes["node"].max()) + 1)
    where = (nodes["tree"].to_numpy(), nodes["node"].to_numpy())
    leaf = (nodes["feature"] < 0).to_numpy()

    def dense(values, kind):
        out = np.zeros(shape, dtype=kind)
        out[where] = values
        return out

    own = nodes["node"].to_numpy()
    return {
        "feature": dense(np.where(leaf, 0, nodes["feature"]), np.int32),
        "split": dense(np.where(leaf, np.inf, nodes["split"]), np.float64),
        "left": dense(np.where(leaf, own, nodes["left"]), np.int32),
        "right": dense(np.where(leaf, own, nodes["right"]), np.int32),
        "path": dense(nodes["path"], np.float64),
    }


def mean_path(x: np.ndarray, forest: dict[str, np.ndarray], block: int = 512) -> np.ndarray:
    """Average path length of each row. The rows of a block go down all trees together, one level at a step."""
    trees, width = forest["feature"].shape
    base = np.arange(trees) * width
    # both children of a node side by side, so that a step looks up one number
    children = np.stack([forest["left"] + base[:, None], forest["right"] + base[:, None]], axis=-1).astype(np.intp).ravel()
    feature = forest["feature"].ravel().astype(np.intp)
    split, path = forest["split"].ravel(), forest["path"].ravel()
    out = np.empty(len(x))
    for lo in range(0, len(x), block):
        some = x[lo : lo + block]
        values = some.ravel()
        row = (np.arange(len(some)) * some.shape[1])[:, None]
        at = np.repeat(base[None, :], len(some), axis=0)
        while True:
            goes_left = values.take(row + feature.take(at)) <= split.take(at)
            step = children.take(2 * at + ~goes_left)
            if np.array_equal(step, at):
                break
            at = step
        out[lo : lo + block] = path.take(at).mean(axis=1)
    return out


def raw_score(model: ForestModel, inputs: list[Column], max_nodes: int = MAX_NODES) -> Column:
    """``-s`` of a row, in (-1, 0).

    The node arrays are broadcast once per model. A forest has at most trees * (2 * samples - 1) nodes, whatever the
    data; one of more than ``max_nodes`` (about 30 bytes each) is refused.
    """
    if model.arrays is None:
        pdf = model.nodes.limit(max_nodes + 1).toPandas()
        if len(pdf) > max_nodes:
            raise ValueError(f"the forest has more than max_nodes={max_nodes} nodes")
        spark: SparkSession = model.nodes.sparkSession
        model.arrays = spark.sparkContext.broadcast(_arrays(pdf))
    forest = model.arrays
    norm = float(average_path(model.meta["max_samples"])) or 1.0

    @F.pandas_udf(T.DoubleType())
    def score(*cols: pd.Series) -> pd.Series:
        x = np.column_stack([c.to_numpy(dtype=float) for c in cols])
        return pd.Series(-np.exp2(-mean_path(x, forest.value) / norm))

    return score(*inputs)


def score(df: DataFrame, model: ForestModel, threshold: float = 0.0, struct: str | None = "features") -> DataFrame:
    """Add anomaly_score (6 digits), prediction (-1 or 1), is_anomaly and threshold_used."""
    if model.scaler is not None:
        exprs = scale_columns(model.scaler.collect(), struct)
        inputs = [exprs[c] for c in model.columns]
    else:
        inputs = [F.col(f"{struct}.{c}" if struct else c).cast("double") for c in model.columns]
    return _decide(df.withColumn("_raw", raw_score(model, inputs)), model, threshold)


def score_training_rows(df: DataFrame, model: ForestModel, id_col: str, threshold: float = 0.0) -> DataFrame:
    """``score`` of the rows that the model has just been fitted on, from the scores stored then; ids are unique."""
    if model.training_scores is None:
        raise ValueError("the model was loaded, not fitted here")
    return _decide(df.join(model.training_scores.withColumnRenamed("raw", "_raw"), id_col), model, threshold)


def _decide(df: DataFrame, model: ForestModel, threshold: float) -> DataFrame:
    decision = F.col("_raw") - F.lit(float(model.meta["offset"]))
    return (
        df.withColumn("_d", decision)
        .withColumns(
            {
                "anomaly_score": F.bround("_d", 6),
                "prediction": F.when(F.col("_d") < 0, -1).otherwise(1),
                "is_anomaly": F.col("_d") < threshold,
                "threshold_used": F.lit(float(threshold)),
            }
        )
        .drop("_raw", "_d")
    )


def model_status(model: ForestModel, threshold: float = 0.0) -> DataFrame:
    """One row describing the loaded model."""
    row = {
        "status": "loaded",
        "model_type": model.meta["algorithm"],
        "n_estimators": int(model.meta["trees"]),
        "contamination": float(model.meta["contamination"]),
        "n_features": len(model.columns),
        "trained_at": model.meta.get("trained_at"),
        "anomaly_threshold": float(threshold),
    }
    schema = (
        "status string, model_type string, n_estimators int, contamination double, n_features int, "
        "trained_at string, anomaly_threshold double"
    )
    return model.nodes.sparkSession.createDataFrame([row], schema)

"""Simple models that show whether a label is given away, or can't be learnt at all."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pulsegrid.operators import windows
from pulsegrid.operators.splits import auc
from pulsegrid.operators.windows import back

#: AUC outside these limits is reported.
TOO_GOOD, NO_SIGNAL = 0.999, 0.52


def model_auc(train: DataFrame, test: DataFrame, features: list[str], label: str, kind: str = "logistic", seed: int = 1) -> DataFrame:
    """(positives, negatives, auc) of a model fitted on ``train`` and scored on ``test``; missing values become medians.

    ``kind`` is logistic, forest, or isolation, which never sees labels: it scores how far a row of ``test`` stands apart.
    A score follows from the features alone, so rows that share them are counted first, and scored once.
    """
    counted = windows.written(test.groupBy(*features, label).agg(F.count(F.lit(1)).alias("_n")))
    if kind == "isolation":
        apart = counted.transform(isolation_forest(test, features, seed=seed))
        return auc(apart.select(F.round("isolation_score", 6).alias("p"), F.col(label).cast("boolean").alias("y"), "_n"), "p", "y", weight="_n")
    filled = [f"{f}_filled" for f in features]
    fill = Imputer(inputCols=features, outputCols=filled, strategy="median").fit(train)
    join = VectorAssembler(inputCols=filled, outputCol="features")
    ready = lambda df: join.transform(fill.transform(df)).withColumn("y", F.col(label).cast("double"))
    chosen = LogisticRegression(labelCol="y", regParam=0.01) if kind == "logistic" else RandomForestClassifier(labelCol="y", numTrees=20, maxDepth=5, seed=seed)
    scored = chosen.fit(ready(train)).transform(ready(counted))
    p = scored.select(F.round(vector_to_array("probability")[1], 6).alias("p"), (F.col("y") > 0.5).alias("y"), "_n")
    return auc(p, "p", "y", weight="_n")


#: Trees of an isolation forest, and rows that each of them is grown on.
TREES, TREE_ROWS = 100, 256


def grow_tree(x: np.ndarray, rng: np.random.Generator, most: int) -> list[tuple[int, float, int, int, float]]:
    """Nodes (feature, cut, left, right, path length): random cuts until rows are alone or the tree is ``most`` deep.

    A leaf has feature -1, and the mean path that its rows would still take.
    """
    nodes: list[tuple[int, float, int, int, float]] = []

    def grow(rows: np.ndarray, depth: int) -> int:
        at = len(nodes)
        nodes.append((-1, 0.0, -1, -1, depth + mean_path(len(rows))))
        spread = np.ptp(rows, axis=0) if len(rows) else np.zeros(x.shape[1])
        if depth < most and len(rows) > 1 and spread.any():
            f = int(rng.choice(np.flatnonzero(spread)))
            cut = float(rng.uniform(rows[:, f].min(), rows[:, f].max()))
            left, right = grow(rows[rows[:, f] <= cut], depth + 1), grow(rows[rows[:, f] > cut], depth + 1)
            nodes[at] = (f, cut, left, right, 0.0)
        return at

    grow(x, 0)
    return nodes


def mean_path(n: int) -> float:
    """Mean length of an unsuccessful search among ``n`` keys."""
    return 2 * (np.log(n - 1) + 0.5772156649) - 2 * (n - 1) / n if n > 2 else float(n == 2)


def isolation_scores(df: DataFrame, features: list[str], column: str = "isolation_score", seed: int = 1) -> DataFrame:
    """``df`` with an isolation-forest score of 0 to 1, higher for rows that few random cuts set apart.

    Trees are grown on a hashed sample of at most TREES x TREE_ROWS rows; every row is scored.  Missing values count
    as the sample's median.
    """
    return df.transform(isolation_forest(df, features, column, seed))


def isolation_forest(df: DataFrame, features: list[str], column: str = "isolation_score", seed: int = 1) -> Callable[[DataFrame], DataFrame]:
    """The forest grown on a hashed sample of ``df``, as a function that adds the score to rows with the same features."""
    light = df.select(*[F.col(f).cast("double").alias(f) for f in features])
    rows = light.orderBy(F.xxhash64(F.lit(seed), *features)).limit(TREES * TREE_ROWS).toPandas().to_numpy(float)  # bounded
    middle = np.array([np.nanmedian(c) if np.isfinite(c).any() else 0.0 for c in rows.T]) if len(rows) else np.zeros(len(features))
    rows = np.where(np.isfinite(rows), rows, middle)
    rng = np.random.default_rng(seed)
    size = min(TREE_ROWS, max(len(rows), 1))
    most = int(np.ceil(np.log2(max(size, 2))))
    forest = [np.array(grow_tree(rows[rng.choice(len(rows), size, replace=False)], rng, most)) for _ in range(TREES)] if len(rows) else []
    whole = mean_path(size) or 1.0

    @F.pandas_udf("double")
    def score(*columns: pd.Series) -> pd.Series:
        x = np.stack([c.to_numpy(float) for c in columns], axis=1)
        x = np.where(np.isfinite(x), x, middle)
        length = np.zeros(len(x))
        for tree in forest:
            at = np.zeros(len(x), int)
            while (inner := np.flatnonzero(tree[at, 0] >= 0)).size:
                node = tree[at[inner]]
                left = x[inner, node[:, 0].astype(int)] <= node[:, 1]
                at[inner] = np.where(left, node[:, 2], node[:, 3]).astype(int)
            length += tree[at, 4]
        return pd.Series(2.0 ** -(length / max(len(forest), 1) / whole))

    return lambda rows: rows.withColumn(column, score(*[F.col(f).cast("double") for f in features]))


def feature_aucs(df: DataFrame, features: list[str], label: str) -> DataFrame:
    """(feature, positives, negatives, auc): no single feature may tell the label apart without error."""
    long = df.select(F.col(label).cast("boolean").alias("y"), *[F.col(f).cast("double").alias(f) for f in features]).unpivot(["y"], features, "feature", "value")
    return auc(long, "value", "y", ["feature"])


def warnings(aucs: DataFrame) -> DataFrame:
    """The rows whose AUC is suspicious, with the reason; null AUCs (one class only) are left out."""
    a = F.greatest(F.col("auc"), 1 - F.col("auc"))
    reason = F.when(a >= TOO_GOOD, "label given away").when(a <= NO_SIGNAL, "no signal")
    return aucs.withColumn("reason", reason).filter(F.col("reason").isNotNull())


def key_auc(df: DataFrame, key: str, label: str) -> DataFrame:
    """(positives, negatives, auc) of a key alone: each row scored by the share of the label under its key, less the row itself.

    Without the row a key that says nothing stays near one half.
    """
    y = F.col(label).cast("double")
    per = df.groupBy(key, label).agg(F.count(F.lit(1)).alias("n"))
    total = per.groupBy(key).agg(F.sum("n").alias("all"), F.sum(F.when(F.col(label), F.col("n")).otherwise(0)).alias("ones"))
    scored = back(per, total, [key]).filter("`all` > 1").select((F.col("ones") / F.col("all")).alias("p"), F.col(label).alias("y"), "n")
    return auc(scored, "p", "y", weight="n")


def key_entropy(df: DataFrame, key: str, label: str) -> DataFrame:
    """(key, n, share): how far a key alone (person, hour of day) decides the label."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("share"))

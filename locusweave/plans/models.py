"""Projections and models fitted with Spark ML."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import PCA, PCAModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression, IsotonicRegressionModel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from locusweave.operators.aggregates import prevalence_weight


def fit_projection(embeddings: DataFrame, k: int, vec: str = "vec") -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, components (k rows) and explained variance of the embeddings.

    The work is one distributed Gram matrix; what reaches the driver is d by d, whatever the rows.
    """
    vectors = embeddings.select(array_to_vector(F.col(vec).cast("array<double>")).alias("v"))
    model: PCAModel = PCA(k=k, inputCol="v", outputCol="p").fit(vectors)
    mean = column_means(embeddings, vec)
    return mean, model.pc.toArray().T, float(model.explainedVariance.toArray().sum())


def column_means(embeddings: DataFrame, vec: str = "vec") -> np.ndarray:
    """Mean vector by a distributed aggregate per coordinate."""
    from pyspark.ml.stat import Summarizer

    vectors = embeddings.select(array_to_vector(F.col(vec).cast("array<double>")).alias("v"))
    return vectors.select(Summarizer.mean(F.col("v")).alias("m")).first()["m"].toArray()


def project_embeddings(embeddings: DataFrame, mean: Sequence[float], components: Sequence[Sequence[float]], vec: str = "vec", out: str = "projected") -> DataFrame:
    """Adds ``(v - mean) . components^T``; one matrix product per Arrow batch."""
    mu, basis = np.asarray(mean, dtype=np.float64), np.asarray(components, dtype=np.float64).T

    @F.pandas_udf(ArrayType(DoubleType()))
    def project(v: pd.Series) -> pd.Series:
        if v.empty:
            return pd.Series([], dtype=object)
        return pd.Series(list((np.stack(v.to_numpy()).astype(np.float64) - mu) @ basis))

    return embeddings.withColumn(out, project(vec))


def interaction_features(pairs: DataFrame, scalars: Sequence[str] = ("dist_kb", "contact", "abc"), out: str = "features") -> DataFrame:
    """Element and gene vectors, their absolute difference and product, and the scalars."""
    e, g = F.col("elem_vec").cast("array<double>"), F.col("gene_vec").cast("array<double>")
    parts = F.concat(
        e, g, F.zip_with(e, g, lambda a, b: F.abs(a - b)), F.zip_with(e, g, lambda a, b: a * b),
        F.array(*[F.col(s).cast("double") for s in scalars]),
    )
    return pairs.withColumn(out, array_to_vector(parts))


def link_model(features: DataFrame, reg: float = 1e-3, max_iter: int = 50) -> LogisticRegressionModel:
    """Link probability from all rows."""
    return LogisticRegression(
        featuresCol="features", labelCol="link", regParam=reg, maxIter=max_iter, probabilityCol="link_prob",
        rawPredictionCol="link_raw", predictionCol="link_pred",
    ).fit(features)


def sign_model(features: DataFrame, reg: float = 1e-3, max_iter: int = 50) -> LogisticRegressionModel:
    """Probability of repression from confident linked pairs, the rarer class weighted up."""
    rows = features.where("mask_sign")
    weight = prevalence_weight(rows, F.col("y_rep") == 1).first()["class_weight"]
    weighted = rows.withColumn("_w", F.when(F.col("y_rep") == 1, float(weight if weight is not None else 1.0)).otherwise(1.0))
    return LogisticRegression(
        featuresCol="features", labelCol="y_rep", weightCol="_w", regParam=reg, maxIter=max_iter,
        probabilityCol="rep_prob", rawPredictionCol="rep_raw", predictionCol="rep_pred",
    ).fit(weighted)


def score_pairs(features: DataFrame, *models: LogisticRegressionModel) -> DataFrame:
    """Adds ``link_score`` and ``rep_score``, the class-1 probabilities of the given models."""
    scored = PipelineModel(list(models)).transform(features)
    for prob, name in (("link_prob", "link_score"), ("rep_prob", "rep_score")):
        if prob in scored.columns:
            scored = scored.withColumn(name, vector_to_array(prob)[1])
    return scored


def distance_prior(pairs: DataFrame, distance: str = "abs_distance", label: str = "link") -> IsotonicRegressionModel:
    """Non-increasing link probability by distance.

    Rows are merged to one weighted point per distinct distance first. The fit is unchanged, and
    its input is bounded by the window, not by the number of pairs.
    """
    points = pairs.groupBy(F.col(distance).cast("double").alias("x")).agg(
        F.avg(F.col(label).cast("double")).alias("y"), F.count(F.lit(1)).cast("double").alias("w")
    )
    return IsotonicRegression(featuresCol="x", labelCol="y", weightCol="w", isotonic=False).fit(points)


# ---- how good a fit is ---------------------------------------------------------------------------------------


def _summed_outer(rows: DataFrame, cols: Sequence[str], first: int) -> tuple[int, np.ndarray]:
    """Rows, and the sum over them of the products of the first ``first`` numbers of the joined vectors with all of them and with 1.

    Each Arrow batch becomes one small matrix, summed per place; what comes back is bounded by the dimensions.
    """
    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            if len(part):
                x = np.hstack([np.stack(part[c].to_numpy()).astype(np.float64).reshape(len(part), -1) for c in cols])
                m = x[:, :first].T @ np.hstack([x, np.ones((len(x), 1))])
                i, j = np.indices(m.shape)
                yield pd.DataFrame({"i": i.ravel(), "j": j.ravel(), "v": m.ravel(), "n": len(x)})

    found = rows.select(*cols).mapInPandas(run, "i int, j int, v double, n long").groupBy("i", "j").agg(F.sum("v").alias("v"), F.sum("n").alias("n")).collect()
    if not found:
        return 0, np.zeros((first, 1))
    out = np.zeros((first, 1 + max(r["j"] for r in found)))
    for r in found:
        out[r["i"], r["j"]] = r["v"]
    return found[0]["n"], out


def projection_check(embeddings: DataFrame, mean: Sequence[float], components: Sequence[Sequence[float]], vec: str = "vec") -> DataFrame:
    """One row that tells whether a projection is made of leading directions of the data.

    ``total_variance`` is what the projected part and the rest have together; the parts of a principal projection are
    uncorrelated with one another and with the rest, their variance falls, and none of the rest's coordinates
    varies more than the first part. All come from one pass over the rows.
    """
    k, basis = len(components), np.asarray(components, dtype=np.float64)
    mu = np.asarray(mean, dtype=np.float64)
    parts = project_embeddings(embeddings, mean, components, vec, "_p")

    @F.pandas_udf(ArrayType(DoubleType()))
    def rest(v: pd.Series, p: pd.Series) -> pd.Series:
        return pd.Series(list(np.stack(v.to_numpy()).astype(np.float64) - mu - np.stack(p.to_numpy()) @ basis)) if len(v) else pd.Series([], dtype=object)

    n, m = _summed_outer(parts.withColumn("_r", rest(vec, "_p")), ["_p", "_r"], k + len(mu))
    m = m / max(n, 1)
    covariance = m[:, :-1] - np.outer(m[:, -1], m[:, -1])
    variance = np.diag(covariance)
    off = np.abs(covariance[:k] - np.pad(np.diag(variance[:k]), ((0, 0), (0, len(mu)))))
    scale = float(variance.sum()) or 1.0
    return embeddings.sparkSession.createDataFrame([(
        n, k, float(variance.sum()), bool(off.max() <= 1e-9 * scale), bool((np.diff(variance[:k]) <= 1e-12 * scale).all()), bool(variance[k:].max() <= variance[0]),
        bool(np.abs(m[:k, -1]).max() <= 1e-9 * scale ** 0.5),
    )], "n long, n_components long, total_variance double, uncorrelated boolean, falling boolean, rest_is_smaller boolean, centred boolean")


def fit_check(features: DataFrame, model: LogisticRegressionModel, label: str, weight: Column | None = None, within: float = 1e-3) -> DataFrame:
    """One row that tells whether a logistic fit is where its penalised loss is least: ``n, n_positive, optimal``.

    There the loss's gradient is zero: for each feature, scaled by its spread as the penalty is, the mean of residual times
    value plus the penalty's slope; for the intercept the mean residual. ``optimal`` allows ``within``.
    """
    w = F.lit(1.0) if weight is None else weight
    scored = features.select("features", F.col(label).cast("double").alias("y"), w.cast("double").alias("w"))
    chance = vector_to_array(F.col(model.getProbabilityCol()))[1]
    rows = model.transform(scored).select(vector_to_array("features").alias("x"), F.array("w", F.col("w") * (chance - F.col("y")), "y").alias("g"))
    n, m = _summed_outer(rows, ["g", "x"], 3)
    total, count = m[0, -1], max(n, 1)
    slope = m[1, 3:-1] / total
    # Spread of each feature under the weights.
    squares = rows.select(F.transform("x", lambda v: v * v).alias("x"), F.array(F.col("g")[0]).alias("g"))
    _, q = _summed_outer(squares, ["g", "x"], 1)
    mean = m[0, 3:-1] / total
    spread = np.sqrt(np.maximum(q[0, 1:-1] / total - mean ** 2, 0) * count / max(count - 1, 1))
    gradient = np.append(np.where(spread > 0, slope / np.where(spread > 0, spread, 1) + model.getRegParam() * model.coefficients.toArray() * spread, 0), m[1, -1] / total)
    return features.sparkSession.createDataFrame([(n, int(round(m[2, -1])), bool(np.abs(gradient).max() <= within))], "n long, n_positive long, optimal boolean")

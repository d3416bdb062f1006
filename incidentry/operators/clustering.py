"""K-means clusters with principal components to draw them by."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.ml.clustering import KMeans, KMeansModel
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from incidentry.functions.common import finite_or_zero, numeric_columns
from incidentry.models.features import feature_frame
from incidentry.operators.rules import safe_cluster_columns
from incidentry.session import settle


def numeric_frame(df: DataFrame, row_id: str, columns: Sequence[str] | None = None) -> DataFrame:
    """Id and numeric columns; null and non-finite values become 0."""
    names = list(columns) if columns else [name for name in numeric_columns(df) if name != row_id]
    return df.select(row_id, *[finite_or_zero(f"`{name}`").alias(name) for name in names])


def cluster_features(df: DataFrame, row_id: str = "incident_id", names_from: DataFrame | None = None) -> DataFrame:
    """Features a clustering may see. Raw incident rows get the full feature frame first, its names from ``names_from`` if given."""
    if "incident_date" in df.columns:
        df = feature_frame(df, names_from=names_from).frame
    return numeric_frame(df, row_id, safe_cluster_columns([n for n in numeric_columns(df) if n != row_id]))


def best_kmeans(vectors: DataFrame, k: int, starts: int = 10, seed: int = 42) -> KMeansModel:
    """Lowest cost of several random starts."""
    fits = (KMeans(k=k, seed=seed + start, featuresCol="vector", predictionCol="cluster").fit(vectors) for start in range(starts))
    return min(fits, key=lambda model: model.summary.trainingCost)


def _components(vectors: DataFrame, k: int) -> DataFrame:
    """Projection of centred vectors; each component's largest loading is made positive."""
    centred = StandardScaler(inputCol="vector", outputCol="_centred", withMean=True, withStd=False).fit(vectors)
    rows = centred.transform(vectors)
    model = PCA(k=k, inputCol="_centred", outputCol="_projected").fit(rows)
    loadings = model.pc.toArray()
    signs = np.sign(loadings[np.abs(loadings).argmax(axis=0), range(k)])
    values = vector_to_array("_projected")
    return model.transform(rows).select(
        "*", *[(values[i] * float(signs[i] or 1.0)).alias(f"pc{i + 1}") for i in range(k)]
    )


def clusters(
    frame: DataFrame,
    row_id: str = "incident_id",
    k: int = 4,
    components: int = 2,
    scaled: bool = False,
    starts: int = 10,
    seed: int = 42,
) -> DataFrame:
    """Cluster and principal components of every row. The vectors are stored once, and all starts read them from there."""
    names = [name for name in frame.columns if name != row_id]
    vectors = VectorAssembler(inputCols=names, outputCol="vector").transform(frame).select(row_id, "vector")
    vectors = settle(vectors)
    if scaled:
        vectors = settle(standard_vectors(vectors), plain=True)  # dense, and kept in memory by split
    model = best_kmeans(vectors, k, starts, seed)
    columns = [f"pc{i + 1}" for i in range(components)]
    return model.transform(_components(vectors, components)).select(row_id, "cluster", *columns)


def standard_vectors(vectors: DataFrame, column: str = "vector") -> DataFrame:
    """Mean 0 and population deviation 1 (the scaler itself uses the sample deviation)."""
    count = vectors.count()
    scaler = StandardScaler(inputCol=column, outputCol="_scaled", withMean=True, withStd=True).fit(vectors)
    factor = float(np.sqrt(count / (count - 1))) if count > 1 else 1.0
    values = F.transform(vector_to_array("_scaled"), lambda v: v * factor)
    return scaler.transform(vectors).withColumn(column, array_to_vector(values)).drop("_scaled")

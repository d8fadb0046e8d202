"""Topics and clusters on MLlib."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import Pipeline
from pyspark.ml.clustering import LDA, BisectingKMeans, KMeans
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from inkwell.operators.features import as_vector, pca, tfidf_stages
from inkwell.operators.models import kept


def cluster_vectors(df: DataFrame, vector_col: str, k: int = 2, restarts: int = 10, seed: int = 0, kind: str = "kmeans"):
    """Best k-means of several seeds by training cost, or a bisecting hierarchy.

    Re-aimed: agglomerative linkage is quadratic, so ``kind='hierarchy'`` splits
    top-down instead of merging bottom-up.
    """
    if kind == "hierarchy":
        return BisectingKMeans(featuresCol=vector_col, predictionCol="cluster", k=k, seed=seed).fit(df)
    models = [
        KMeans(featuresCol=vector_col, predictionCol="cluster", k=k, seed=seed + i).fit(df) for i in range(restarts)
    ]
    return min(models, key=lambda m: m.summary.trainingCost)


def topics_from_vectors(
    df: DataFrame, key_col: str, array_col: str, k: int = 13, dims: int = 5, min_size: int = 30,
    reach: float = 3.0, seed: int = 0,
) -> DataFrame:
    """``(key, topic, distance)`` with -1 for outliers.

    Re-aimed: PCA and k-means replace neighbour embedding and density clustering.
    A row is an outlier when its cluster has fewer than ``min_size`` rows or when
    it lies farther than ``reach`` times the cluster's root mean square distance.
    """
    vectors = as_vector(df.select(key_col, array_col), array_col, "_v")
    reduced = pca(vectors, "_v", dims, "_low").transform(vectors)
    model = KMeans(featuresCol="_low", predictionCol="cluster", k=k, seed=seed).fit(reduced)
    centres = F.array(*[F.array(*[F.lit(float(x)) for x in c]) for c in model.clusterCenters()])
    point = vector_to_array("_low")
    squared = F.aggregate(
        F.zip_with(point, F.get(centres, F.col("cluster")), lambda a, b: (a - b) * (a - b)),
        F.lit(0.0), lambda total, x: total + x,
    )
    placed = model.transform(reduced).select(key_col, "cluster", F.sqrt(squared).alias("distance"))
    sizes = placed.groupBy("cluster").agg(
        F.count(F.lit(1)).alias("_n"), F.sqrt(F.avg(F.col("distance") * F.col("distance"))).alias("_rms")
    )
    outlier = (F.col("_n") < min_size) | (F.col("distance") > reach * F.col("_rms"))
    return placed.join(F.broadcast(sizes), "cluster").select(  # sizes: at most k rows
        key_col, F.when(outlier, -1).otherwise(F.col("cluster")).alias("topic"), "distance"
    )


def cluster_sweep(df: DataFrame, key_col: str, array_col: str, dims: Sequence[int] = (3, 5, 8, 10), k: int = 13, min_size: int = 30) -> DataFrame:
    """Topics found and outlier share per number of reduced dimensions."""
    out = None
    for d in dims:
        placed = topics_from_vectors(df, key_col, array_col, k, d, min_size)
        row = placed.agg(
            F.lit(d).alias("dims"), F.count_distinct(F.when(F.col("topic") >= 0, F.col("topic"))).alias("topics"),
            F.avg((F.col("topic") == -1).cast("double")).alias("outlier_share"),
        )
        out = row if out is None else out.unionByName(row)
    return out


def lda_topics(
    df: DataFrame, key_col: str, text_col: str, k: int = 10, vocab_size: int = 1000, n_max: int = 4,
    min_df: float = 2, max_df: float = 0.98, stop: Sequence[str] = (), max_iter: int = 10, seed: int = 0,
    top_words: int = 10,
) -> tuple[DataFrame, DataFrame]:
    """``(assignments (key, topic, weight), words (topic, rank, term, weight))``."""
    stages = tfidf_stages(text_col, "_tfidf", n_max=n_max, min_df=min_df, max_df=max_df, vocab_size=vocab_size, stop=stop)
    with kept(df.select(key_col, text_col)) as texts:  # read once for each length of n-grams
        pipeline = Pipeline(stages=stages).fit(texts)
        weighted = pipeline.transform(texts).select(key_col, "_tfidf")
        with kept(weighted) as rows:  # every round of the model draws from all rows
            model = LDA(k=k, maxIter=max_iter, seed=seed, featuresCol="_tfidf").fit(rows)
    mix = vector_to_array("topicDistribution")
    assigned = model.transform(weighted).select(
        key_col, (F.array_position(mix, F.array_max(mix)) - 1).cast("int").alias("topic"), F.array_max(mix).alias("weight")
    )
    terms = pipeline.stages[0].vocabulary.table
    described = model.describeTopics(top_words).select(
        "topic", F.posexplode(F.arrays_zip("termIndices", "termWeights")).alias("rank", "_t")
    )
    words = described.join(terms, F.col("_t.termIndices") == F.col("id")).select(
        "topic", (F.col("rank") + 1).alias("rank"), "term", F.col("_t.termWeights").alias("weight")
    )
    return assigned, words

"""Learned preferences, clusters and maps with spark.ml. Vectors come as array columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.clustering import KMeans
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.vectors import unit
from ..sources.scratch import written
from . import perceptron
from .density import density_clusters
from .perceptron import Perceptron
from .places import numbered


def both_classes(rows: DataFrame) -> tuple[int, int]:
    pos, neg = rows.agg(F.count_if(F.col("label") == 1), F.count_if(F.col("label") == 0)).first()
    if not pos or not neg:
        raise ValueError("training needs positive and negative rows")
    return pos, neg


def balanced(rows: DataFrame, weight: str | None = None) -> DataFrame:
    """Adds ``w``: n / (2 * class size), times a weight of the row's own."""
    pos, neg = both_classes(rows)
    own = F.lit(1.0) if weight is None else F.coalesce(weight, F.lit(1.0))
    return rows.withColumn("w", F.when(F.col("label") == 1, (pos + neg) / (2 * pos)).otherwise((pos + neg) / (2 * neg)) * own)


def fit_logistic(rows: DataFrame, weight: str | None = None, max_iter: int = 1000):
    """Balanced logistic regression with unit penalty: regParam is one over the summed weights."""
    data = balanced(rows, weight).select(array_to_vector(F.col("vec")).alias("features"), F.col("label").cast("double").alias("label"), "w")
    total = data.agg(F.sum("w")).first()[0]
    return LogisticRegression(maxIter=max_iter, tol=1e-8, regParam=1.0 / total, standardization=False, weightCol="w").fit(data)


def fit_perceptron(rows: DataFrame, hidden: int = 128, seed: int = 0, steps: int = 100, weight: str | None = None) -> Perceptron:
    """One hidden layer of rectified units with an L2 penalty; classes are balanced by the rows' weights."""
    return perceptron.fit(balanced(rows, weight), hidden, weight="w", seed=seed, steps=steps)


def fit_auto(rows: DataFrame, least: int = 200):
    """A perceptron from ``least`` rows on, logistic regression below."""
    return fit_perceptron(rows) if rows.count() >= least else fit_logistic(rows)


def predict(model, rows: DataFrame, into: str = "p") -> DataFrame:
    """The probability of class 1; all columns stay."""
    if isinstance(model, Perceptron):
        return model.predict(rows, into)
    made = model.transform(rows.withColumn("_features", array_to_vector(F.col("vec"))).withColumnRenamed("_features", "features"))
    return made.withColumn(into, vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")


def cv_auc(rows: DataFrame, key: str = "point_id", folds: int = 5) -> float:
    """Mean area under the ROC curve over stratified folds, fewer if a class is small."""
    pos, neg = both_classes(rows)
    k = min(folds, pos, neg)
    if k < 2:
        raise ValueError("each class needs two rows")
    folded = numbered(rows, "label", F.xxhash64(key), key, into="fold").withColumn("fold", F.col("fold") % k)
    scores = []
    for i in range(k):
        model = fit_logistic(folded.where(F.col("fold") != i))
        out = model.transform(folded.where(F.col("fold") == i).select(array_to_vector(F.col("vec")).alias("features"), F.col("label").cast("double").alias("label")))
        scores.append(BinaryClassificationEvaluator().evaluate(out))
    return sum(scores) / k


def kmeans(rows: DataFrame, k: int, seed: int = 0):
    return KMeans(k=k, seed=seed).fit(rows.select(array_to_vector(F.col("vec")).alias("features")))


def kmeans_centres(rows: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """(vec): unit centres."""
    centres = [(list(map(float, c)),) for c in kmeans(rows, k, seed).clusterCenters()]
    return rows.sparkSession.createDataFrame(centres, "vec array<double>").select(unit(F.col("vec")).alias("vec"))


def project(points: DataFrame) -> DataFrame:
    """Adds x and y in 0..1: the two main axes, each scaled over all points; on a diagonal if there are fewer than three."""
    points = written(points, "points")  # the axes take several passes
    n = points.count()
    if n < 3:
        order = F.row_number().over(W.orderBy("item_key")) - 1
        return points.withColumn("x", order / max(1, n - 1)).withColumn("y", order / max(1, n - 1))
    data = points.withColumn("features", array_to_vector(F.col("vec")))
    flat = PCA(k=2, inputCol="features", outputCol="flat").fit(data).transform(data).withColumn("flat", vector_to_array("flat"))
    flat = flat.withColumns({"x": F.col("flat")[0], "y": F.col("flat")[1]})
    return scaled_to_one(flat, "x", "y").select(*points.columns, "x", "y")


def scaled_to_one(rows: DataFrame, *columns: str) -> DataFrame:
    """The columns scaled to 0..1 over all rows, one half where they have no span."""
    ends = rows.agg(*[f(c).alias(f"_{n}_{c}") for c in columns for n, f in (("lo", F.min), ("hi", F.max))])

    def scaled(c: str):
        span = F.col(f"_hi_{c}") - F.col(f"_lo_{c}")
        return F.when(span > 0, (F.col(c) - F.col(f"_lo_{c}")) / span).otherwise(0.5)

    return rows.crossJoin(F.broadcast(ends)).withColumns({c: scaled(c) for c in columns}).select(*rows.columns)


def cluster(points: DataFrame, seed: int = 0, method: str = "density") -> DataFrame:
    """Adds ``c``: density clusters of at least max(10, n / 200) points, -1 for noise; where there are none, and with
    ``method`` "kmeans", k-means with k = min(12, max(2, n / 50)). One cluster if there are fewer than six points."""
    points = written(points, "points")
    n = points.count()
    if n < 6:
        return points.withColumn("c", F.lit(0))
    if method == "density":
        found = written(density_clusters(points, max(10, n // 200)), "clusters")
        if not found.where("c >= 0").isEmpty():
            return found
    model = kmeans(points, min(12, max(2, n // 50)), seed)
    return model.transform(points.withColumn("features", array_to_vector(F.col("vec")))).withColumn("c", F.col("prediction").cast("int")).drop("features", "prediction")


def nearest_on_map(points: DataFrame, x: float, y: float, within: float | None = None) -> DataFrame:
    """The point nearest to a place of the map, with its ``distance``; none if that is more than ``within``."""
    rows = points.withColumn("distance", F.hypot(F.col("x") - x, F.col("y") - y)).where("distance IS NOT NULL")
    rows = rows if within is None else rows.where(F.col("distance") <= within)
    return rows.orderBy("distance", "item_key").limit(1)


def map_records(points: DataFrame, representatives: DataFrame, liking: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """(item_key, t, x, y, c, taste) from (item_key, vec, x, y, c), the items' representative samples (item_key, t), and
    ``liking``, which adds ``p`` to rows with vec; without it, and for items it has no value for, taste is 0."""
    liked = points.withColumn("p", F.lit(0.0)) if liking is None else liking(points)
    taste = F.round(F.coalesce("p", F.lit(0.0)), 3).alias("taste")
    rows = liked.join(representatives.select("item_key", F.round("t", 2).alias("t")), "item_key")
    return rows.select("item_key", "t", F.round("x", 4).alias("x"), F.round("y", 4).alias("y"), "c", taste)


def cluster_summary(clustered: DataFrame, vocabulary: DataFrame, dim: int = 64, terms: int = 3) -> DataFrame:
    """(c, n, cx, cy, label): size, centre and best terms of each cluster; noise (-1) has none."""
    from ..functions.vectors import mean_of
    from .search import top_terms

    rows = clustered.where("c <> -1").groupBy("c").agg(F.count(F.lit(1)).alias("n"), F.avg("x").alias("cx"), F.avg("y").alias("cy"), mean_of(F.col("vec"), dim).alias("_m"))
    best = top_terms(rows.select("c", unit(F.col("_m")).alias("vec")), vocabulary, ["c"], terms)
    label = best.groupBy("c").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]), ", ").alias("label"))
    return rows.drop("_m").join(label, "c", "left")


def save(model, path: str, profile: str, dim: int, kind: str) -> None:
    """The model, and beside it one row (kind, profile, dim) that ``load`` checks."""
    if isinstance(model, Perceptron):
        model.save(SparkSession.active(), f"{path}/model")
    else:
        model.write().overwrite().save(f"{path}/model")
    SparkSession.active().createDataFrame([(kind, profile, dim)], "kind string, profile string, dim int").coalesce(1).write.mode("overwrite").json(f"{path}/about")


def load(spark: SparkSession, path: str, profile: str, dim: int):
    about = spark.read.schema("kind string, profile string, dim int").json(f"{path}/about").first()
    if (about.profile, about.dim) != (profile, dim):
        raise ValueError(f"the model is for {about.profile} with {about.dim} dimensions")
    if about.kind == "perceptron":
        return Perceptron.load(spark, f"{path}/model")
    return {"logistic": LogisticRegressionModel}[about.kind].load(f"{path}/model")


def saved(spark: SparkSession, folder: str) -> DataFrame:
    """(name, kind, profile, dim) of the models saved under a folder, by name; none without it."""
    from ..sources.stores import _files

    schema = "kind string, profile string, dim int"
    at, files = _files(spark, folder)
    if not files.exists(at) or not len(files.listStatus(at)):
        return spark.createDataFrame([], f"name string, {schema}")
    rows = spark.read.schema(schema).json(f"{folder}/*/about")
    return rows.select(F.element_at(F.split(F.input_file_name(), "/"), -3).alias("name"), "kind", "profile", "dim").orderBy("name")


def delete(spark: SparkSession, path: str) -> bool:
    """Removes a saved model; says whether there was one."""
    from ..sources.stores import _files

    at, files = _files(spark, f"{path}/about")
    return bool(files.exists(at) and files.delete(at.getParent(), True))

"""Vector columns: norms, cosines, centroids, nearest earlier vectors, directions, and probes on MLlib."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    return F.try_divide(dot(a, b), norm(a) * norm(b))


def scaled(v: Column, by: Column) -> Column:
    return F.transform(v, lambda x: x.cast("double") * by)


def added(h: Column, v: Column, alpha: float) -> Column:
    """h + alpha * v, element by element."""
    return F.zip_with(h, v, lambda x, y: x + alpha * y)


def centroids(rows: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, n, centroid): means by dimension, combined before the shuffle; then one row of dimensions a group."""
    parts = rows.select(group, F.posexplode(vector).alias("i", "x")).groupBy(group, "i").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count("*").alias("n"))
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("i", "m"))), lambda s: s["m"])  # as many as the vector has dimensions
    return parts.groupBy(group).agg(F.max("n").alias("n"), ordered.alias("centroid"))


def pair_cosines(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(a, b, cos), a < b: of a small table such as one centroid a category."""
    one = vectors.select(F.col(key).alias("a"), F.col(vector).alias("va"))
    two = vectors.select(F.col(key).alias("b"), F.col(vector).alias("vb"))
    return one.join(two, F.col("a") < F.col("b")).select("a", "b", cosine(F.col("va"), F.col("vb")).alias("cos"))


def status_by_similarity(rows: DataFrame, group: str, order: str, vector: str, repeated: float = 0.90, revised: float = 0.70) -> DataFrame:
    """(group, order, best, antecedent, status): each vector's most similar earlier one in its group, the earliest of equals.

    A group is a trace: pairs grow with the square of its length, not of the table.
    """
    one = rows.select(group, F.col(order).alias("sid"), F.col(vector).alias("v"))
    two = rows.select(group, F.col(order).alias("earlier"), F.col(vector).alias("w"))
    sims = one.join(two, group).where("earlier < sid").select(group, "sid", "earlier", cosine(F.col("v"), F.col("w")).alias("cos"))
    best = sims.groupBy(group, "sid").agg(F.max("cos").alias("best"), F.max_by("earlier", F.struct("cos", -F.col("earlier"))).alias("antecedent"))
    joined = one.select(group, "sid").join(best, [group, "sid"], "left")
    status = F.when(F.col("best") >= repeated, "repeated").when(F.col("best") >= revised, "revised").otherwise("novel")
    return joined.select(group, "sid", "best", F.when(status != "novel", F.col("antecedent")).alias("antecedent"), status.alias("status"))


def group_folds(rows: DataFrame, stratum: str, group: str, folds: int = 5) -> DataFrame:
    """(stratum, group, fold): groups of each stratum dealt in turn, in order of a hash."""
    groups = rows.select(stratum, group).distinct().withColumn("h", F.md5(F.col(group).cast("string")))
    return groups.withColumn("fold", (F.row_number().over(Window.partitionBy(stratum).orderBy("h", group)) - 1) % folds).drop("h")


def strategy_distances(rows: DataFrame, label: str, strategy: str, vector: str, least: int = 5) -> DataFrame:
    """(label, one, two, cos, distance): centroids of a label under each two strategies with at least `least` vectors: cosine and Euclidean distance."""
    both = rows.withColumn("_k", F.struct(F.col(label).alias("label"), F.col(strategy).alias("strategy")))
    each = centroids(both, "_k", vector).where(F.col("n") >= least).select("_k.label", "_k.strategy", "centroid")
    one, two = each.toDF("label", "one", "v"), each.toDF("label", "two", "w")
    gap = F.zip_with("v", "w", lambda x, y: x - y)
    pairs = one.join(two, "label").where("one < two")  # a label has as many centroids as there are strategies
    return pairs.select("label", "one", "two", (dot(F.col("v"), F.col("w")) / (norm(F.col("v")) * norm(F.col("w")) + 1e-10)).alias("cos"), norm(gap).alias("distance"))


class Probe:
    """A standardised, balanced multinomial logistic regression with an L2 penalty."""

    def __init__(self, train: DataFrame, vector: str, label: str, c: float, iterations: int):
        """train: rows with a vector and a whole-number label. Its scales are those of the training rows."""
        from pyspark.ml import Pipeline
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import StandardScaler

        self.vector, self.label, self.iterations = vector, label, iterations
        data = self._data(train)
        weights = data.groupBy("label").agg(F.count("*").alias("k")).withColumn("weight", F.sum("k").over(Window.partitionBy()) / (F.count("*").over(Window.partitionBy()) * F.col("k"))).drop("k")
        data = data.join(F.broadcast(weights), "label").repartition(train.sparkSession.sparkContext.defaultParallelism).cache()  # a row a label
        n = data.count()
        scale = StandardScaler(withMean=True, inputCol="raw", outputCol="features")
        self.model = Pipeline(stages=[scale, LogisticRegression(family="multinomial", weightCol="weight", regParam=1 / (c * n), standardization=False, maxIter=iterations)]).fit(data)
        self.rounds = self.model.stages[1].summary.totalIterations
        data.unpersist()

    @property
    def converged(self) -> bool:
        return self.rounds < self.iterations

    def _data(self, rows: DataFrame) -> DataFrame:
        from pyspark.ml.functions import array_to_vector

        return rows.withColumn("label", F.col(self.label).cast("double")).withColumn("raw", array_to_vector(F.col(self.vector)))

    def said(self, rows: DataFrame) -> DataFrame:
        """rows with a (true label) and b (predicted one)."""
        return self.model.transform(self._data(rows)).withColumn("a", F.col("label").cast("bigint")).withColumn("b", F.col("prediction").cast("bigint")).drop("raw", "features", "rawPrediction", "probability", "prediction", "label")


def cross_validated(rows: DataFrame, vector: str, label: str, fold: str, test_fold: int = 0, c: float = 0.01, iterations: int = 100) -> DataFrame:
    """(split, fold, macro_f1, weighted_f1, accuracy): each training fold predicted from the others, their mean and population deviation, and the test fold predicted from all of them."""
    from tracelode.operators.agreement import overall_scores

    train = rows.where(F.col(fold) != test_fold)
    folds = sorted(r[0] for r in train.select(fold).distinct().collect())  # a row a fold
    runs = [("validation", k, train.where(F.col(fold) != k)) for k in folds] + [("test", test_fold, train)]
    found = []
    for split, k, rest in runs:
        r = overall_scores(Probe(rest, vector, label, c, iterations).said(rows.where(F.col(fold) == k))).first()
        found.append((split, int(k), r.macro_f1, r.weighted_f1, r.accuracy))
    scores = rows.sparkSession.createDataFrame(found, "split string, fold bigint, macro_f1 double, weighted_f1 double, accuracy double")
    valid = scores.where("split = 'validation'")
    summed = [valid.agg(*[f(m).alias(m) for m in ("macro_f1", "weighted_f1", "accuracy")]).select(F.lit(name).alias("split"), F.lit(None).cast("bigint").alias("fold"), "macro_f1", "weighted_f1", "accuracy") for name, f in (("mean", F.avg), ("deviation", F.stddev_pop))]
    return scores.unionByName(summed[0]).unionByName(summed[1])

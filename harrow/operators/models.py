"""Word and length features, linear baselines and their evaluation."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from harrow.functions.measures import word_count
from harrow.operators import metrics
from harrow.staging import staged


def word_terms(df: DataFrame, text: str, into: str = "terms", lengths: tuple[int, ...] = (1, 2)) -> DataFrame:
    """``df`` with its texts' words of two characters or more, and their n-grams, repeats kept."""
    words = F.regexp_extract_all(F.lower(F.coalesce(F.col(text), F.lit(""))), F.lit(r"(?U)(\b\w\w+\b)"), F.lit(1))
    out = df.withColumn("_words", words)

    def grams(n: int) -> Column:  # a function's second parameter would be the position
        cut = F.transform(F.sequence(F.lit(1), F.size("_words") - (n - 1)), lambda i: F.array_join(F.slice("_words", i, n), " "))
        return F.when(F.size("_words") >= n, cut).otherwise(F.array().cast("array<string>"))

    return out.withColumn(into, F.flatten(F.array(*[grams(n) for n in lengths]))).drop("_words")


class TermWeights:
    """Sublinear tf-idf of length 1 over a fitted vocabulary: (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1)."""

    def __init__(self, least_df: int = 2, most_df: float = 0.98, features: int = 100_000, lengths: tuple[int, ...] = (1, 2)):
        self.least_df, self.most_df, self.features, self.lengths = least_df, most_df, features, lengths

    def fit(self, df: DataFrame, text: str) -> TermWeights:
        import math

        terms = word_terms(df, text, lengths=self.lengths).select(F.sort_array("terms").alias("_s"))
        n = terms.count()
        # Sorted, a text's terms say by themselves which is its first, so that one pass counts terms and texts.
        each = F.transform("_s", lambda t, i: F.struct(t.alias("t"), F.when(i == 0, 1).when(t != F.get("_s", i - 1), 1).otherwise(0).alias("d")))
        counts = terms.select(F.inline(each)).groupBy("t").agg(F.count("*").alias("n"), F.sum("d").alias("df"))
        some = counts.where((F.col("df") >= self.least_df) & (F.col("df") <= max(self.least_df, math.floor(self.most_df * n))))
        known = some.orderBy(F.col("n").desc(), "t").limit(self.features).select("t", "df").collect()  # at most ``features`` words
        self.counts = CountVectorizerModel.from_vocabulary([r["t"] for r in known], inputCol="terms", outputCol="_tf")
        self.idf = [math.log((1 + n) / (1 + r["df"])) + 1 for r in known]
        return self

    def transform(self, df: DataFrame, text: str, into: str = "features") -> DataFrame:
        """``df``, written with the weights of its texts: a vector's numbers are reckoned in the JVM and read back as one."""
        table = df.sparkSession.createDataFrame([(self.idf,)], "_idf array<double>")  # one row, broadcast
        counted = self.counts.transform(word_terms(df, text, lengths=self.lengths)).withColumn("_v", F.unwrap_udt("_tf"))
        counted = counted.join(F.broadcast(table)).withColumn("_w", F.zip_with("_v.values", "_v.indices", lambda n, i: (1 + F.log(n)) * F.get("_idf", i)))
        counted = counted.withColumn("_norm", F.sqrt(F.aggregate("_w", F.lit(0.0), lambda s, x: s + x * x)))
        vector = F.struct(F.col("_v.type").alias("type"), F.col("_v.size").alias("size"), F.col("_v.indices").alias("indices"), F.transform("_w", lambda x: x / F.col("_norm")).alias("values"))
        plain = counted.select(*[F.col(f"`{c}`") for c in df.columns if c != into], vector.alias(into))
        fields = [StructField(into, VectorUDT()) if f.name == into else f for f in plain.schema.fields]
        return staged(plain, "weights", StructType(fields))


def balanced_weights(df: DataFrame, label: str, into: str = "weight") -> DataFrame:
    """Weights under which both classes count alike."""
    sizes = df.groupBy(label).agg(F.count("*").alias("_n"))
    row = sizes.agg(F.sum("_n").alias("_all"), F.count("*").alias("_classes"))
    out = df.join(F.broadcast(sizes), label).join(F.broadcast(row))
    return out.withColumn(into, F.col("_all") / (F.col("_classes") * F.col("_n"))).drop("_n", "_all", "_classes")


def logistic(df: DataFrame, label: str = "label", c: float = 1.0, weight: str | None = None, steps: int = 100):
    """L2 logistic regression; ``c`` is the inverse of the penalty, as a sum over rows."""
    model = LogisticRegression(featuresCol="features", labelCol=label, regParam=1.0 / (c * max(1, df.count())), maxIter=steps, standardization=False)
    return (model.setWeightCol(weight) if weight else model).fit(df)


def linear_svm(df: DataFrame, label: str = "label", c: float = 1.0, steps: int = 100):
    """Linear SVM."""
    return LinearSVC(featuresCol="features", labelCol=label, regParam=1.0 / (c * max(1, df.count())), maxIter=steps, standardization=False).fit(df)


def length_baseline(df: DataFrame, text: str, label: str = "label") -> PipelineModel:
    """How much the number of words alone says about the label."""
    counted = df.withColumn("_words", word_count(text).cast("double"))
    stages = [VectorAssembler(inputCols=["_words"], outputCol="features"), LogisticRegression(featuresCol="features", labelCol=label)]
    return Pipeline(stages=stages).fit(counted)


def positive_score(predictions: DataFrame, into: str = "fake_probability") -> DataFrame:
    """Probability of class 1, or the signed distance if there is none."""
    source = "probability" if "probability" in predictions.columns else "rawPrediction"
    return predictions.withColumn(into, vector_to_array(source)[1])


def evaluated(predictions: DataFrame, label: str = "label", score: str = "fake_probability") -> DataFrame:
    """All metrics of scored predictions in one row."""
    counts = metrics.scores(metrics.confusion(predictions.withColumn("prediction", F.col("prediction").cast("int")), label, "prediction"))
    return counts.join(F.broadcast(metrics.roc_auc(predictions, label, score)))


def top_features(vocabulary: list[str], coefficients: list[float], session, n: int = 30) -> DataFrame:
    """The ``n`` terms that speak most for each class."""
    rows = session.createDataFrame(list(zip(vocabulary, map(float, coefficients), strict=True)), "term string, weight double")
    real = rows.orderBy("weight", "term").limit(n).withColumn("class", F.lit("real"))
    return real.unionByName(rows.orderBy(F.col("weight").desc(), "term").limit(n).withColumn("class", F.lit("fake")))

"""Models on encoded features and their quality by window."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import boosting
from .distance import auc
from .encode import dense

LOWER_IS_BETTER = ("logloss", "brier", "rmse", "mae")


def classification_metrics(scored: DataFrame, keys: list[str], score: str = "score", label: str = "label", tiny: float = 1e-15) -> DataFrame:
    """accuracy, logloss, brier, roc_auc and pr_auc (average precision) of binary scores by group.

    The last three and logloss are null unless both classes occur.
    """
    p, y = F.greatest(F.least(F.col(score), F.lit(1 - tiny)), F.lit(tiny)), F.col(label).cast("double")
    both = F.min(y) < F.max(y)
    base = scored.groupBy(*keys).agg(
        F.avg(((F.col(score) >= 0.5).cast("int") == F.col(label)).cast("double")).alias("accuracy"), F.when(both, -F.avg(F.when(y == 1, F.log(p)).otherwise(F.log(1 - p)))).alias("logloss"), F.when(both, F.avg((F.col(score) - y) ** 2)).alias("brier")
    )
    steps = scored.groupBy(*keys, score).agg(F.count(F.lit(1)).alias("c"), F.sum(y).alias("tp"))
    down = Window.partitionBy(*keys).orderBy(F.desc(score)).rowsBetween(Window.unboundedPreceding, 0)
    curve = steps.withColumn("precision", F.sum("tp").over(down) / F.sum("c").over(down))
    ap = curve.groupBy(*keys).agg((F.sum(F.col("tp") * F.col("precision")) / F.nullif(F.sum("tp"), F.lit(0.0))).alias("ap"), F.sum("tp").alias("np"), F.sum("c").alias("n"))
    ap = ap.select(*keys, F.when((F.col("np") > 0) & (F.col("np") < F.col("n")), F.col("ap")).alias("pr_auc"))
    return base.join(auc(scored, keys, score, label).withColumnRenamed("auc", "roc_auc"), keys, "left").join(ap, keys, "left")


def multiclass_auc(scored: DataFrame, keys: list[str], scores: str = "scores", label: str = "label") -> DataFrame:
    """Macro mean of one-against-rest AUC; ``scores`` is array<double> by class number."""
    each = scored.select(*keys, label, F.posexplode(scores).alias("class", "score")).withColumn("own", (F.col("class") == F.col(label)).cast("int"))
    return auc(each, [*keys, "class"], "score", "own").groupBy(*keys).agg(F.avg("auc").alias("roc_auc_ovr"))


def multiclass_metrics(scored: DataFrame, keys: list[str], scores: str = "scores", label: str = "label", tiny: float = 1e-15) -> DataFrame:
    """accuracy, logloss and roc_auc_ovr of probabilities by class number, by group. Rows without a label don't count."""
    rows = scored.where(F.col(label).isNotNull())
    best = F.array_position(scores, F.array_max(scores)) - 1
    chance = F.greatest(F.least(F.coalesce(F.get(scores, F.col(label).cast("int")), F.lit(0.0)), F.lit(1 - tiny)), F.lit(tiny))
    base = rows.groupBy(*keys).agg(F.avg((best == F.col(label)).cast("double")).alias("accuracy"), (-F.avg(F.log(chance))).alias("logloss"))
    return base.join(multiclass_auc(rows, keys, scores, label), keys, "left")


def measured(scored: DataFrame, keys: list[str], task: str, classes: int = 2) -> DataFrame:
    """The metrics of a task by group: of regression, of two classes or of more."""
    if task == "regression":
        return regression_metrics(scored, keys)
    return classification_metrics(scored, keys) if classes <= 2 else multiclass_metrics(scored, keys)


#: Classes that a target may have.
MOST_CLASSES = 1000


def class_numbers(train: DataFrame, target: str) -> tuple[Column, int]:
    """(label, number of classes): the target as the place of its value among the sorted training values, from 0; null for others."""
    values = sorted(r[0] for r in train.select(target).where(F.col(target).isNotNull()).distinct().limit(MOST_CLASSES + 1).collect())
    if not values or len(values) > MOST_CLASSES:
        raise ValueError(f"{target} has {'no' if not values else 'too many'} classes")
    if len(values) == 1 and values[0] in (0, 1):
        return F.col(target).cast("int"), 2
    return F.nullif(F.array_position(F.array(*map(F.lit, values)), F.col(target)), F.lit(0)).cast("int") - 1, len(values)


def regression_metrics(scored: DataFrame, keys: list[str], predicted: str = "predicted", actual: str = "actual") -> DataFrame:
    """rmse, mae and r2 by group; r2 is null where the target is constant."""
    e = F.col(predicted) - F.col(actual)
    sst = F.var_pop(actual) * F.count(F.lit(1))
    return scored.groupBy(*keys).agg(F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (1 - F.sum(e * e) / F.nullif(sst, F.lit(0.0))).alias("r2"))


def primary_metric(row: dict, task: str) -> str:
    """The first of roc_auc, roc_auc_ovr and accuracy that validation has; rmse for regression."""
    if task == "regression":
        return "rmse"
    return next((m for m in ("roc_auc", "roc_auc_ovr") if row.get(m) is not None), "accuracy")


def quality_drop(metric: str, reference, current):
    """How much worse ``current`` is, as a column; null where either is."""
    return current - reference if metric in LOWER_IS_BETTER else reference - current


def balanced(train: DataFrame, label: str = "label") -> DataFrame:
    """Add w = n / (classes * n of the row's class)."""
    counts = train.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))  # one row a class
    total = counts.agg(F.sum("__c").alias("n"), F.count(F.lit(1)).alias("k")).first()
    return train.join(F.broadcast(counts), label).withColumn("w", F.lit(float(total["n"])) / (F.lit(total["k"]) * F.col("__c"))).drop("__c")


def fit_model(train: DataFrame, name: str, task: str, seed: int = 42, features: str = "features", label: str = "label"):
    """A function that adds score (probability of the last class) and scores, or predicted for regression, to rows with features.

    linear: balanced logistic regression (C = 1) or ridge (alpha = 1). Other names are those of boosting.PRESETS: boosted trees that
    grow by best leaf (hist_gbdt, gbdt; lightgbm with balanced classes and a share of the features), by level (xgboost), or
    symmetrically (catboost).
    """
    if name in boosting.PRESETS:
        fitted = boosting.fit(train, task, boosting.PRESETS[name], seed, features, label)
        return lambda df: boosting.predict(df, fitted, task, features)
    if name != "linear":
        raise ValueError(f"unknown model: {name}")
    vec = lambda df: dense(df.withColumn("__d", F.col(features)), "__d").withColumn("__v", array_to_vector("__d")).drop("__d")
    if task == "regression":
        n, s = train.agg(F.count(F.lit(1)), F.stddev_pop(label)).first()
        model = LinearRegression(featuresCol="__v", labelCol=label, solver="normal", standardization=False, regParam=(s or 1.0) / n, predictionCol="predicted").fit(vec(train))
        return lambda df: model.transform(vec(df)).drop("__v")
    rows = balanced(train, label)
    total = rows.agg(F.sum("w")).first()[0]
    fitted = LogisticRegression(featuresCol="__v", labelCol=label, weightCol="w", regParam=1 / total, standardization=False, maxIter=200).fit(vec(rows))
    return lambda df: fitted.transform(vec(df)).withColumn("scores", vector_to_array("probability")).withColumn("score", F.col("scores")[F.size("scores") - 1]).drop("__v", "rawPrediction", "probability", "prediction")

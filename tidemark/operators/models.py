"""Models on Spark: preparation fitted on training rows, and logistic and ridge regressions by aggregated steps.

Rows never leave the executors. A fit's normal equations are sums, so the driver sees a matrix of the features' size
for each model, and many models of one shape (folds, permutations) are fitted side by side in one job a step.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .distribution import medians

def prepared(df: DataFrame, features: list[str], train: Column) -> DataFrame:
    """Nulls become the median of the training rows, then each feature is scaled by their mean and population deviation."""
    q = {r["column"]: r["median"] for r in medians(df.where(train), [], features).collect()}  # a row for each feature
    filled = df.withColumns({c: F.coalesce(F.col(c).cast("double"), F.lit(q.get(c))) for c in features})
    m = filled.where(train).agg(*(F.avg(c).alias(f"{c}_mean") for c in features), *(F.stddev_pop(c).alias(f"{c}_std") for c in features)).first()
    return filled.withColumns({c: (F.col(c) - m[f"{c}_mean"]) / (m[f"{c}_std"] or 1.0) for c in features})


def _sums(rows: DataFrame, model: str, x: list[Column], values: dict[str, Column]) -> list:
    """Per model, the sums of all given columns; as many rows as models come to the driver."""
    return rows.groupBy(model).agg(*(F.sum(c).alias(k) for k, c in values.items())).collect()


def logistic(rows: DataFrame, model: str, features: list[str], label: str, weight: str | None = None, penalty: float = 1.0, steps: int = 12) -> DataFrame:
    """model, beta: binary logistic regressions, one for each value of `model`, with the loss summed over rows and
    penalty / 2 times the squared coefficients without the intercept, by Newton's method.

    Each step is one aggregate of gradients and Hessians over all rows of all models. A model whose rows have one
    label alone gets an intercept that says so.
    """
    spark, k = rows.sparkSession, len(features) + 1
    x = [F.lit(1.0), *(F.col(c).cast("double") for c in features)]
    y, w = F.col(label).cast("double"), F.col(weight).cast("double") if weight else F.lit(1.0)
    # Every step reads the rows again; what a lost executor held is made anew.
    rows = rows.select(model, *features, label, *([weight] if weight else [])).persist(StorageLevel.MEMORY_AND_DISK)
    names = [r[0] for r in rows.select(model).distinct().collect()]  # as many as there are models
    betas = {m: np.zeros(k) for m in names}
    kind = rows.schema[model].dataType.simpleString()
    ridge = np.diag([1e-9] + [penalty] * (k - 1))
    try:
        betas = _stepped(rows, model, kind, x, y, w, betas, ridge, steps)
    finally:
        rows.unpersist()
    return spark.createDataFrame([(m, b.tolist()) for m, b in betas.items()], f"{model} {kind}, beta array<double>")


def _stepped(rows: DataFrame, model: str, kind: str, x: list[Column], y: Column, w: Column, betas: dict, ridge: np.ndarray, steps: int) -> dict:
    """Coefficients after Newton's steps; each is one aggregate."""
    spark, k = rows.sparkSession, len(x)
    for _ in range(steps):
        table = spark.createDataFrame([(m, b.tolist()) for m, b in betas.items()], f"{model} {kind}, beta array<double>")
        met = rows.join(F.broadcast(table), model)
        score = sum((F.get("beta", i) * c for i, c in enumerate(x)), F.lit(0.0))
        met = met.withColumn("p", 1 / (1 + F.exp(-F.least(F.greatest(score, F.lit(-30.0)), F.lit(30.0)))))
        values = {f"g{i}": w * (y - F.col("p")) * c for i, c in enumerate(x)}
        values |= {f"h{i}_{j}": w * F.col("p") * (1 - F.col("p")) * x[i] * x[j] for i in range(k) for j in range(i, k)}
        moved = 0.0
        for r in _sums(met, model, x, values):
            b = betas[r[model]]
            g = np.array([r[f"g{i}"] for i in range(k)]) - ridge @ b
            h = np.array([[r[f"h{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) + ridge
            step = np.clip(np.linalg.solve(h, g), -5, 5)
            betas[r[model]] = b + step
            moved = max(moved, float(np.abs(step).max()))
        if moved < 1e-8:
            break
    return betas


def probability(features: list[str], beta: str = "beta") -> Column:
    score = F.get(beta, 0) + sum((F.get(beta, i) * F.col(c) for i, c in enumerate(features, 1)), F.lit(0.0))
    return 1 / (1 + F.exp(-score))


def ridge(rows: DataFrame, model: str, features: list[str], target: str, penalty: float = 1.0) -> DataFrame:
    """model, beta: ridge regressions, one for each value of `model`, from one aggregate; the intercept has no penalty.

    Features count as scaled by the deviation of the model's own rows, as a scaler before the fit would do.
    """
    spark, k = rows.sparkSession, len(features)
    x, y = [F.col(c).cast("double") for c in features], F.col(target).cast("double")
    values = {"n": F.lit(1.0), "y": y} | {f"x{i}": c for i, c in enumerate(x)} | {f"y{i}": y * c for i, c in enumerate(x)}
    values |= {f"x{i}_{j}": x[i] * x[j] for i in range(k) for j in range(i, k)}
    out = []
    for r in _sums(rows, model, x, values):
        n, mx, my = r["n"], np.array([r[f"x{i}"] for i in range(k)]) / r["n"], r["y"] / r["n"]
        xx = np.array([[r[f"x{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)]) - n * np.outer(mx, mx)
        xy = np.array([r[f"y{i}"] for i in range(k)]) - n * mx * my
        sd = np.sqrt(np.maximum(np.diag(xx) / n, 0))
        sd[sd == 0] = 1
        b = np.linalg.solve(xx / np.outer(sd, sd) + penalty * np.eye(k), xy / sd) / sd
        out.append((r[model], [float(my - b @ mx), *b.tolist()]))
    return spark.createDataFrame(out, f"{model} {rows.schema[model].dataType.simpleString()}, beta array<double>")


def linear(features: list[str], beta: str = "beta") -> Column:
    return F.get(beta, 0) + sum((F.get(beta, i) * F.col(c) for i, c in enumerate(features, 1)), F.lit(0.0))


def softmax(train: DataFrame, features: list[str], label: str, classes: list[str], weight: str | None = None, balanced: bool = False) -> Callable[[DataFrame], DataFrame]:
    """Multinomial logistic regression with a squared penalty of a half (a cost of 1 for the summed loss), by Spark's
    own solver; gives a function that adds prediction and probability, aligned with `classes`.

    balanced: each class weighs as much as any other. Classes that training lacks have probability 0.
    """
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    counts = {r[label]: r["count"] for r in train.groupBy(label).count().collect()}
    met = [c for c in classes if counts.get(c)]
    code = F.create_map(*(F.lit(v) for i, c in enumerate(met) for v in (c, float(i))))
    total = sum(counts[c] for c in met)
    own = F.create_map(*(F.lit(v) for c in met for v in (c, total / (len(met) * counts[c]) if balanced else 1.0)))
    w = F.element_at(own, F.col(label)) * (F.col(weight) if weight else F.lit(1.0))
    gather = VectorAssembler(inputCols=features, outputCol="its_features")
    rows = gather.transform(train.where(F.col(label).isin(met)).withColumn("its_label", F.element_at(code, F.col(label))).withColumn("its_weight", w))
    mass = rows.agg(F.sum("its_weight")).first()[0]
    solver = LogisticRegression(featuresCol="its_features", labelCol="its_label", weightCol="its_weight", regParam=1.0 / mass, elasticNetParam=0.0, standardization=False, family="multinomial", maxIter=200, tol=1e-9, probabilityCol="its_p", rawPredictionCol="its_raw", predictionCol="its_prediction")
    fitted = solver.fit(rows)

    def predict(df: DataFrame) -> DataFrame:
        found = fitted.transform(gather.transform(df)).withColumn("its_p", vector_to_array("its_p"))
        p = F.array(*(F.get("its_p", met.index(c)) if c in met else F.lit(0.0) for c in classes))
        best = F.element_at(F.array(*map(F.lit, met)), (F.col("its_prediction") + 1).cast("int"))
        return found.withColumn("prediction", best).withColumn("probability", p).drop("its_features", "its_raw", "its_p", "its_prediction")

    return predict

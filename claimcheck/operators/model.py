"""Random forests on tables."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from claimcheck.functions.columns import categorical_columns, numeric_columns, quoted


def task_of(df: DataFrame, target: str) -> str:
    """"regression" for a numeric target, 0 and 1 included; "classification" for any other."""
    return "regression" if isinstance(df.schema[target].dataType, NumericType) else "classification"


def train_test_split(df: DataFrame, key: str, share: float = 0.8, seed: int = 42) -> DataFrame:
    """``df`` with ``split``: a row's part depends on its key alone, not on partitions or order."""
    part = F.pmod(F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(key).cast("string"))), 1, 8), 16, 10).cast("long"), F.lit(1000))
    return df.withColumn("split", F.when(part < int(share * 1000), "train").otherwise("test"))


def forest(df: DataFrame, target: str, features: list[str], trees: int = 100, seed: int = 42, depth: int = 5) -> PipelineModel:
    """A fitted pipeline: texts indexed by alphabet, missing numbers imputed by the mean, a forest on all of it."""
    task = task_of(df, target)
    numbers, texts = [c for c in features if c in numeric_columns(df)], [c for c in features if c in categorical_columns(df)]
    steps = [StringIndexer(inputCol=c, outputCol=f"{c}_index", stringOrderType="alphabetAsc", handleInvalid="keep") for c in texts]
    if numbers:
        steps.append(Imputer(inputCols=numbers, outputCols=[f"{c}_full" for c in numbers], strategy="mean"))
    steps.append(VectorAssembler(inputCols=[f"{c}_full" for c in numbers] + [f"{c}_index" for c in texts], outputCol="features"))
    levels = df.agg(*[F.count_distinct(quoted(c)).alias(f"n{i}") for i, c in enumerate(texts)]).first() if texts else ()
    widest = max([32, *[n + 2 for n in levels]])  # the levels, missing values and unknown ones
    if task == "regression":
        steps.append(RandomForestRegressor(labelCol=target, numTrees=trees, seed=seed, maxDepth=depth, maxBins=widest))
    else:
        steps += [StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc"), RandomForestClassifier(labelCol="label", numTrees=trees, seed=seed, maxDepth=depth, maxBins=widest)]
    return Pipeline(stages=steps).fit(df)


def score_r2(actual: Column, predicted: Column) -> Column:
    """Aggregate: the share of the variance that the predictions explain."""
    error = F.sum((actual - predicted) * (actual - predicted))
    return 1 - error / (F.var_pop(actual) * F.count(actual))


def score_accuracy(actual: Column, predicted: Column) -> Column:
    """Aggregate: the share of predictions that are right."""
    return F.avg(F.when(actual == predicted, 1.0).otherwise(0.0))


def save_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)

"""Categories of any number of levels as numbers for models: means of the target by level, out of fold.

A row's own target is never in its feature: rows are dealt into folds, and a row of one fold gets the mean over
the others. Means are drawn towards that of all rows by ``PRIOR`` rows' worth, so that rare levels say little and
a level of one row says nothing. Levels and their sums are tables: no list of levels is on the driver or in the
model. Levels with over a thousandth of the rows, a thousand at most, are joined by broadcast; of the others none
is large, so that the shuffle of their join is even.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import Imputer, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from claimcheck.functions.columns import categorical_columns, free_name, numeric_columns, quoted
from claimcheck.operators.model import task_of
from claimcheck.sources.scratch import saved

FOLDS, PRIOR = 5, 20.0
#: A level with this share of the rows is joined by broadcast; so there are 1 / HEAVY of these at most.
HEAVY = 0.001


def fold_of(key: str, folds: int = FOLDS) -> Column:
    return F.pmod(F.xxhash64(F.lit(11), quoted(key)), F.lit(folds)).cast("int")


def level_sums(df: DataFrame, column: str, targets: list[Column], fold: Column) -> DataFrame:
    """(level, fold, n, sums): rows and sums of each target by level and fold; a row without a target doesn't count, without a level is of the level null."""
    known = [t.cast("double") for t in targets]
    return df.where(known[0].isNotNull()).groupBy(quoted(column).cast("string").alias("level"), fold.alias("fold")).agg(F.count("*").alias("n"), F.array(*[F.sum(t) for t in known]).alias("sums"))


def encoding(sums: DataFrame, width: int = 1, folds: int = FOLDS, prior: float = PRIOR) -> tuple[DataFrame, list[float]]:
    """(level, heavy, means): for each fold the means without it, and last those over all rows; and the means of all levels."""
    every = sums.agg(F.sum("n"), *[F.sum(F.col("sums")[i]) for i in range(width)]).first()
    total, means = every[0] or 0, [(x or 0.0) / (every[0] or 1) for x in every[1:]]
    parts = [F.coalesce(F.sum(F.when(F.col("fold") != f, x)), F.lit(0.0)) for f in range(folds) for x in (F.col("n").cast("double"), *[F.col("sums")[i] for i in range(width)])]
    whole = [F.sum(x) for x in (F.col("n").cast("double"), *[F.col("sums")[i] for i in range(width)])]
    flat = [*parts, *whole]
    wanted = []
    for f in range(folds + 1):
        n, *own = flat[f * (width + 1) : (f + 1) * (width + 1)]
        wanted.append(F.array(*[(x + F.lit(prior * m)) / (n + F.lit(prior)) for x, m in zip(own, means)]))
    return sums.groupBy("level").agg(F.sum("n").alias("n"), F.array(*wanted).alias("means")).select("level", (F.col("n") > HEAVY * total).alias("heavy"), "means"), means


def encoded(df: DataFrame, column: str, table: DataFrame, means: list[float], at: Column, name: str) -> DataFrame:
    """``df`` with ``name``: the means of each row's level at place ``at`` (its fold, or the last); unknown levels have the means of all."""
    common, rare = free_name(df, "_common"), free_name(df, "_rare")
    level = F.coalesce(F.concat(F.lit("="), quoted(column).cast("string")), F.lit(""))
    for heavy, own in ((True, common), (False, rare)):
        some = table.where(F.col("heavy") == heavy).select(F.coalesce(F.concat(F.lit("="), "level"), F.lit("")).alias("_level"), F.col("means").alias(own))
        df = df.join(F.broadcast(some) if heavy else some, (level if heavy else F.when(quoted(common).isNull(), level)) == F.col("_level"), "left").drop("_level")
    means_of = F.coalesce(F.get(F.coalesce(common, rare), at), F.array(*[F.lit(m) for m in means]))
    return df.withColumn(name, means_of).drop(common, rare)


@dataclass
class EncodedForest:
    """A forest on numbers and on encoded texts; the encodings are tables."""

    model: PipelineModel
    texts: dict[str, tuple[DataFrame, list[float]]]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with ``prediction``; for rows that the forest wasn't fitted on."""
        kept = df.columns
        for column, (table, means) in self.texts.items():
            df = encoded(df, column, table, means, F.lit(FOLDS), f"{column}_means")
        df = _spread(df, self.texts)
        found = self.model.transform(df)
        return found.select(*map(quoted, kept), *[c for c in ("label", "prediction") if c in found.columns and c not in kept])


def _spread(df: DataFrame, texts: dict[str, tuple[DataFrame, list[float]]]) -> DataFrame:
    for column, (_, means) in texts.items():
        df = df.withColumns({f"{column}_mean{i}": F.get(quoted(f"{column}_means"), F.lit(i)) for i in range(len(means))})
    return df


def encoded_forest(df: DataFrame, target: str, features: list[str], key: str, trees: int = 100, seed: int = 42, depth: int = 5, most_classes: int = 32) -> EncodedForest:
    """A random forest whose text features may have any number of levels; ``key`` deals rows into folds.

    For a numeric target a text is one number, its out-of-fold mean; for classes it is the share of each of the
    most frequent ``most_classes`` classes but one. Missing numbers become the mean.
    """
    regression = task_of(df, target) == "regression"
    numbers, names = [c for c in features if c in numeric_columns(df)], [c for c in features if c in categorical_columns(df)]
    if regression:
        targets = [quoted(target)]
    else:
        classes = [r[0] for r in df.where(quoted(target).isNotNull()).groupBy(quoted(target)).count().orderBy(F.desc("count"), quoted(target)).limit(most_classes).collect()]
        targets = [F.when(quoted(target).isNotNull(), (quoted(target) == c).cast("double")) for c in classes[: max(1, len(classes) - 1)]] or [F.lit(None).cast("double")]
    texts, rows = {}, df
    for c in names:
        table, means = encoding(saved(level_sums(df, c, targets, fold_of(key)), "levels"), len(targets))
        texts[c] = saved(table, "encoding"), means
        rows = encoded(rows, c, *texts[c], fold_of(key), f"{c}_means")
    rows = _spread(rows, texts)
    steps = [Imputer(inputCols=numbers, outputCols=[f"{c}_full" for c in numbers], strategy="mean")] if numbers else []
    steps.append(VectorAssembler(inputCols=[f"{c}_full" for c in numbers] + [f"{c}_mean{i}" for c in names for i in range(len(texts[c][1]))], outputCol="features"))
    if regression:
        steps.append(RandomForestRegressor(labelCol=target, numTrees=trees, seed=seed, maxDepth=depth))
    else:
        steps += [StringIndexer(inputCol=target, outputCol="label", stringOrderType="alphabetAsc", handleInvalid="skip"), RandomForestClassifier(labelCol="label", numTrees=trees, seed=seed, maxDepth=depth)]
    return EncodedForest(Pipeline(stages=steps).fit(rows.where(quoted(target).isNotNull())), texts)

"""Forecasters: baselines by column, and gradient-boosted trees with missing-value flags."""

from __future__ import annotations

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .attribution import contributions, spark_trees


def baseline(rows: DataFrame, column: str) -> DataFrame:
    """The forecast that a feature column is: lag_1h for the last value, at_168h for the same hour last week."""
    return rows.withColumn("predicted", F.col(column))


class GradientForecaster:
    """Boosted trees on declared features; nulls become 0 with a flag of their own, since Spark's trees have no missing branch."""

    def __init__(self, names: list[str], target: str = "target", rounds: int = 20, depth: int = 5, seed: int = 7):
        self.names, self.target, self.rounds, self.depth, self.seed = names, target, rounds, depth, seed
        self.model: PipelineModel | None = None

    def _inputs(self, rows: DataFrame) -> DataFrame:
        cols = {f"_x_{n}": F.coalesce(F.col(n).cast("double"), F.lit(0.0)) for n in self.names}
        return rows.withColumns(cols | {f"_m_{n}": F.col(n).isNull().cast("double") for n in self.names})

    def fit(self, rows: DataFrame) -> GradientForecaster:
        inputs = [f"_{k}_{n}" for k in "xm" for n in self.names]
        stages = [VectorAssembler(inputCols=inputs, outputCol="_features"), GBTRegressor(featuresCol="_features", labelCol=self.target, predictionCol="predicted", maxIter=self.rounds, maxDepth=self.depth, seed=self.seed)]
        self.model = Pipeline(stages=stages).fit(self._inputs(rows.filter(F.col(self.target).isNotNull())))
        return self

    def predict(self, rows: DataFrame) -> DataFrame:
        return self.model.transform(self._inputs(rows)).drop("_features", *[f"_{k}_{n}" for k in "xm" for n in self.names])

    def save(self, path: str) -> None:
        self.model.write().overwrite().save(path)

    def attribution(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """(keys, base_value, predicted, feature, contribution): exact additive contributions; a value's and its flag's are one."""
        inputs = [f"_{k}_{n}" for k in "xm" for n in self.names]
        return contributions(self._inputs(rows), spark_trees(self.model.stages[-1]), inputs, keys, {c: c[3:] for c in inputs})

    def occlusion(self, rows: DataFrame) -> DataFrame:
        """Change of each prediction when one feature is missing: (row columns, feature, contribution)."""
        base = self.predict(rows).withColumnRenamed("predicted", "_whole")
        parts = [self.predict(base.withColumn("_kept", F.col(n)).withColumn(n, F.lit(None).cast("double"))).withColumn(n, F.col("_kept")).drop("_kept").withColumn("feature", F.lit(n)) for n in self.names]
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out.withColumn("contribution", F.col("_whole") - F.col("predicted")).drop("predicted").withColumnRenamed("_whole", "predicted")

    def importance(self, rows: DataFrame, sample: int = 1500, repeats: int = 5) -> DataFrame:
        """Mean rise of the absolute error, at least 0, when a feature is shuffled among a bounded sample (repeats times)."""
        key = F.xxhash64(*[F.col(n) for n in self.names], F.col(self.target))
        some = rows.orderBy(key).limit(sample).withColumn("_i", F.row_number().over(Window.orderBy(key)))  # at most sample rows
        error = F.avg(F.abs(F.col("predicted") - F.col(self.target)))
        parts = [self.predict(some).select(F.lit("").alias("feature"), F.lit(0).alias("repeat"), "predicted", self.target)]
        for n in self.names:
            for k in range(repeats):
                from_ = some.select(F.col(n).alias("_moved"), F.row_number().over(Window.orderBy(F.xxhash64(F.lit(self.seed), F.lit(n), F.lit(k), "_i"), "_i")).alias("_i"))
                moved = some.join(F.broadcast(from_), "_i").withColumn(n, F.col("_moved")).drop("_moved")
                parts.append(self.predict(moved).select(F.lit(n).alias("feature"), F.lit(k).alias("repeat"), "predicted", self.target))
        both = parts[0]
        for p in parts[1:]:
            both = both.unionByName(p)
        errors = both.groupBy("feature", "repeat").agg(error.alias("e"))
        whole = errors.filter("feature = ''").select(F.col("e").alias("whole"))
        rises = errors.filter("feature <> ''").crossJoin(F.broadcast(whole))  # one row
        return rises.groupBy("feature").agg(F.greatest(F.lit(0.0), F.avg(F.col("e") - F.col("whole"))).alias("importance"))


def factor_shares(contributions: DataFrame, factors: DataFrame, by: list[str]) -> DataFrame:
    """Contributions (by, feature, contribution) as factors of each row: signed sum, share of the absolute sums, rank.

    factors: (feature, factor), one factor for each feature.  Rows with no contribution at all have shares of 0.
    """
    g = contributions.join(F.broadcast(factors), "feature").groupBy(*by, "factor").agg(F.sum("contribution").alias("contribution"))
    every = Window.partitionBy(*by)  # as many rows as factors
    share = F.coalesce(F.try_divide(F.abs("contribution"), F.sum(F.abs("contribution")).over(every)), F.lit(0.0))
    return g.withColumn("share", share).withColumn("rank", F.row_number().over(every.orderBy(F.desc(F.abs("contribution")), "factor")))

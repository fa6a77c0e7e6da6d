"""The engagement model: preparing, fitting over time-ordered folds, choosing, scoring with reasons."""

from __future__ import annotations

import json
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml import Estimator, Model, Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import Imputer, OneHotEncoder, StandardScaler, StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.param import Param, Params, TypeConverters
from pyspark.ml.param.shared import HasInputCols
from pyspark.ml.util import DefaultParamsReadable, DefaultParamsWritable
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

CATEGORICAL = ["platform", "content_type", "day_of_week", "hour_bucket"]
NUMERIC = ["is_video", "caption_length", "hashtag_count"]
FLOOR, OVER_DUMMY = 0.60, 0.05


class _Fills(HasInputCols, DefaultParamsReadable, DefaultParamsWritable):
    """Columns of categories whose missing values are filled in place."""

    def __init__(self, inputCols: list[str] | None = None):
        super().__init__()
        if inputCols is not None:
            self._set(inputCols=inputCols)


class ModeFiller(_Fills, Estimator):
    """Learns the most frequent value of each column; of equals the least."""

    def _fit(self, dataset: DataFrame) -> ModeFillerModel:
        columns = self.getInputCols()
        row = dataset.agg(*[F.mode(c, True).alias(c) for c in columns]).first()
        return ModeFillerModel(columns, {c: row[c] for c in columns if row[c] is not None})


class ModeFillerModel(_Fills, Model):
    """Fills with the values that were learned; these are saved with the model."""

    fills: Param = Param(Params._dummy(), "fills", "value by column, as JSON", typeConverter=TypeConverters.toString)

    def __init__(self, inputCols: list[str] | None = None, fills: dict[str, str] | None = None):
        super().__init__(inputCols)
        self._set(fills=json.dumps(fills or {}))

    def _transform(self, dataset: DataFrame) -> DataFrame:
        return dataset.fillna(json.loads(self.getOrDefault(self.fills)))


def preprocessing(categorical: list[str] = CATEGORICAL, numeric: list[str] = NUMERIC) -> list:
    """Stages fitted anew in each fold: mode for missing categories, one-hot of known values, median for missing numbers, scaling."""
    return [
        ModeFiller(categorical),
        StringIndexer(inputCols=categorical, outputCols=[f"{c}_i" for c in categorical], handleInvalid="keep"),
        OneHotEncoder(inputCols=[f"{c}_i" for c in categorical], outputCols=[f"{c}_v" for c in categorical], handleInvalid="keep"),
        Imputer(inputCols=numeric, outputCols=[f"{c}_f" for c in numeric], strategy="median"),
        VectorAssembler(inputCols=[f"{c}_f" for c in numeric], outputCol="numbers"),
        StandardScaler(inputCol="numbers", outputCol="scaled", withMean=True),
        VectorAssembler(inputCols=[*[f"{c}_v" for c in categorical], "scaled"], outputCol="features"),
    ]


def balanced(df: DataFrame, label: str = "label") -> DataFrame:
    """Rows with a weight by which both classes weigh the same."""
    n = df.agg(F.count("*").alias("n"), F.sum(label).alias("pos")).first()
    pos, neg = max(1, n["pos"] or 0), max(1, n["n"] - (n["pos"] or 0))
    return df.withColumn("weight", F.when(F.col(label) == 1, n["n"] / (2 * pos)).otherwise(n["n"] / (2 * neg)))


def logistic(c: float, rows: int) -> Pipeline:
    return Pipeline(stages=[*preprocessing(), LogisticRegression(labelCol="label", weightCol="weight", regParam=1.0 / (c * max(1, rows)))])


def forest(trees: int = 200, depth: int = 3, seed: int = 42) -> Pipeline:
    return Pipeline(stages=[*preprocessing(), RandomForestClassifier(labelCol="label", weightCol="weight", numTrees=trees, maxDepth=depth, seed=seed)])


def boosted(rounds: int = 200, rate: float = 0.01, seed: int = 42) -> Pipeline:
    return Pipeline(stages=[*preprocessing(), GBTClassifier(labelCol="label", weightCol="weight", maxIter=rounds, stepSize=rate, maxDepth=3, seed=seed)])


def _typed(df: DataFrame) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in NUMERIC})


def dummy_scores(df: DataFrame, train: DataFrame, seed: int = 42) -> DataFrame:
    """A random guess by the classes' shares: the floor of any model."""
    share = train.agg(F.avg("label")).first()[0] or 0.0
    return df.withColumn("p", F.when(F.rand(seed) < share, 1.0).otherwise(0.0))


def oof_predict(pipeline: Pipeline, df: DataFrame, n_splits: int = 5) -> DataFrame:
    """Out-of-fold scores: each fold (column ``fold``) is scored by a model of all earlier ones."""
    out = None
    for k in range(1, n_splits + 1):
        before = df.filter(F.col("fold") < k)
        model = pipeline.fit(balanced(_typed(before)))
        part = with_probability(model, df.filter(F.col("fold") == k))
        out = part if out is None else out.unionByName(part)
    return out


def with_probability(model: PipelineModel, df: DataFrame) -> DataFrame:
    scored = model.transform(_typed(df)).withColumn("p", vector_to_array("probability")[1])
    return scored.select(*df.columns, "p", *(["features"] if "features" in scored.columns else []))


def _confusion(p: Column, threshold: Column) -> list[Column]:
    hit, pos = p >= threshold, F.col("label") == 1
    count = lambda c: F.count(F.when(c, 1))
    return [count(hit & pos).alias("tp"), count(hit & ~pos).alias("fp"), count(~hit & pos).alias("fn"), count(~hit & ~pos).alias("tn")]


def _rates() -> Column:
    over = lambda a, b: F.col(a) / F.when(F.col(a) + F.col(b) > 0, F.col(a) + F.col(b))
    return (over("tp", "fn") + over("tn", "fp")) / 2


def ranked_auc(scored: DataFrame, by: str) -> DataFrame:
    """Area under the curve by group: the share of pairs of both classes in right order, ties by half.

    Scores are compared at six places, so a group's window runs over at most a million counts, not rows.
    """
    counts = scored.groupBy(by, F.round("p", 6).alias("_p")).agg(F.count(F.when(F.col("label") == 1, 1)).alias("pos"), F.count(F.when(F.col("label") != 1, 1)).alias("neg"))
    below = F.coalesce(F.sum("neg").over(Window.partitionBy(by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = counts.withColumn("right", F.col("pos") * (below + F.col("neg") / 2))
    pairs = F.sum("pos").cast("double") * F.sum("neg")
    return counts.groupBy(by).agg(F.round(F.sum("right") / F.when(pairs > 0, pairs), 6).alias("auc"))


def metrics(scored: DataFrame, threshold: float, by: str) -> DataFrame:
    """Balanced accuracy, confusion counts, Brier score and AUC by group, and of all with a null group (label, p)."""
    both = scored.select(F.explode(F.array(F.col(by).cast("string"), F.lit(None).cast("string"))).alias(by), "label", "p") if by else scored
    brier = F.round(F.avg((F.col("p") - F.col("label")) ** 2), 6).alias("brier")
    counted = both.groupBy(by).agg(*_confusion(F.col("p"), F.lit(threshold)), brier).withColumn("balanced_accuracy", F.round(_rates(), 6))
    area = ranked_auc(both, by).withColumnRenamed(by, "_by")  # a row for each group
    return counted.join(area, F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by")


def threshold_table(scored: DataFrame) -> DataFrame:
    """Balanced accuracy at each threshold from 0.05 to 0.95 in steps of 0.01.

    Rows are first counted by the last step that they reach, so the table of 91 steps joins at most
    92 counts, not the scores.
    """
    reached = F.greatest(F.lit(4), F.least(F.lit(95), F.floor(F.round(F.col("p") * 100, 9)))).cast("int")
    counts = scored.groupBy(reached.alias("reached")).agg(F.count(F.when(F.col("label") == 1, 1)).alias("pos"), F.count(F.when(F.col("label") != 1, 1)).alias("neg"))
    steps = scored.sparkSession.range(5, 96).select(F.col("id").cast("int").alias("step"))
    both = steps.crossJoin(F.broadcast(counts))  # 91 times at most 92 rows
    hit = F.col("reached") >= F.col("step")
    total = lambda c, on: F.sum(F.when(on, F.col(c)).otherwise(0))
    by = both.groupBy("step").agg(total("pos", hit).alias("tp"), total("neg", hit).alias("fp"), total("pos", ~hit).alias("fn"), total("neg", ~hit).alias("tn"))
    return by.select("step", F.round(_rates(), 6).alias("balanced_accuracy"))


def best_threshold(scored: DataFrame) -> float:
    """The lowest of the best thresholds."""
    best = threshold_table(scored).orderBy(F.desc("balanced_accuracy"), "step").first()
    return best["step"] / 100


def select_model(accuracies: dict[str, float], dummy: float) -> tuple[str, bool]:
    """(the best by out-of-fold accuracy, whether it clears the floor and the dummy)."""
    name = max(accuracies, key=lambda k: (accuracies[k], k))
    return name, accuracies[name] >= FLOOR and accuracies[name] >= dummy + OVER_DUMMY


def candidates(kind: str, n: int, rows: int, seed: int = 42) -> list[tuple[dict, Pipeline]]:
    """(parameters, pipeline) of ``n`` draws: C on a log grid from 0.001 to 100, trees and depths, rounds and rates."""
    import random

    draw = random.Random(f"{kind} {seed}")
    out = []
    for _ in range(n):
        if kind == "logistic":
            c = 10 ** draw.uniform(-3, 2)
            out.append(({"c": c}, logistic(c, rows)))
        elif kind == "forest":
            own = {"trees": draw.choice((100, 200, 400)), "depth": draw.choice((3, 5, 8))}
            out.append((own, forest(**own, seed=seed)))
        else:
            own = {"rounds": draw.choice((50, 100, 200)), "rate": draw.choice((0.01, 0.03, 0.1))}
            out.append((own, boosted(**own, seed=seed)))
    return out


def accuracy(scored: DataFrame, threshold: float = 0.5) -> float:
    """Balanced accuracy of all of ``scored`` (label, p); 0 where a class is missing."""
    row = scored.agg(*_confusion(F.col("p"), F.lit(threshold))).select(_rates().alias("a")).first()
    return row["a"] or 0.0


def search(tried: list[tuple[dict, Pipeline]], df: DataFrame, n_splits: int = 5, at_once: int = 8) -> tuple[dict, Pipeline, float]:
    """The draw of the best balanced accuracy on out-of-fold scores; the first of equals.

    Each fold's rows are prepared and cached once, and draws and folds are fitted ``at_once`` at a time; what
    comes back of a fit are four counts, and these are added up by draw as ``accuracy`` does by rows.
    """
    folds = [(balanced(_typed(df.filter(F.col("fold") < k))).persist(), df.filter(F.col("fold") == k).persist()) for k in range(1, n_splits + 1)]

    def counts(job: tuple[int, int]) -> tuple[int, dict[str, int]]:
        (_, pipeline), (before, part) = tried[job[0]], folds[job[1]]
        scored = with_probability(pipeline.copy().fit(before), part)
        return job[0], scored.agg(*_confusion(F.col("p"), F.lit(0.5))).first().asDict()

    try:
        with ThreadPool(at_once) as pool:
            done = pool.map(inheritable_thread_target(df.sparkSession)(counts), [(i, k) for i in range(len(tried)) for k in range(n_splits)], chunksize=1)
    finally:
        for rows in (rows for fold in folds for rows in fold):
            rows.unpersist()
    found = []
    for i, (own, pipeline) in enumerate(tried):
        tp, fp, fn, tn = (sum(c[name] for j, c in done if j == i) for name in ("tp", "fp", "fn", "tn"))
        found.append((own, pipeline, (tp / (tp + fn) + tn / (tn + fp)) / 2 if tp + fn and tn + fp else 0.0))
    return max(found, key=lambda f: f[2])


def report(pipeline: Pipeline, train: DataFrame, test: DataFrame, dummy: float, n_splits: int = 5) -> dict:
    """The chosen model judged: threshold by out-of-fold scores, then the test rows once.

    Returns the threshold, both balanced accuracies, whether the test clears the floor and the
    dummy, and the test's metrics by platform and of all.
    """
    oof = oof_predict(pipeline, train, n_splits)
    threshold = best_threshold(oof)
    model = pipeline.fit(balanced(_typed(train)))
    scored = with_probability(model, test)
    at = accuracy(scored, threshold)
    return {"threshold": threshold, "oof": accuracy(oof, threshold), "test": at, "passes": at >= FLOOR and at >= dummy + OVER_DUMMY, "metrics": metrics(scored, threshold, "platform")}


def refit(pipeline: Pipeline, df: DataFrame, path: str, threshold: float) -> PipelineModel:
    """The model of all rows with parameters as they are, fills included, written to ``path`` with its threshold beside it."""
    model = pipeline.fit(balanced(_typed(df)))
    model.write().overwrite().save(f"{path}/model")
    df.sparkSession.createDataFrame([(float(threshold),)], "threshold double").write.mode("overwrite").json(f"{path}/threshold")
    return model


def load_model(spark: SparkSession, path: str) -> tuple[PipelineModel, float]:
    """What ``refit`` wrote: the model, which fills, encodes and scores as in training, and its threshold."""
    return PipelineModel.load(f"{path}/model"), spark.read.json(f"{path}/threshold").first()["threshold"]


def feature_names(scored: DataFrame) -> list[str]:
    groups = scored.schema["features"].metadata["ml_attr"]["attrs"]
    return [a["name"] for a in sorted((a for g in groups.values() for a in g), key=lambda a: a["idx"])]


def feature_effects(model: PipelineModel, df: DataFrame, k: int = 10) -> list[tuple[str, float]]:
    """The k features of the largest effect, by size: coefficients or importances."""
    last = model.stages[-1]
    values = last.coefficients if hasattr(last, "coefficients") else last.featureImportances
    names = feature_names(model.transform(_typed(df.limit(1))))
    return sorted(zip(names, map(float, values.toArray()), strict=True), key=lambda x: (-abs(x[1]), x[0]))[:k]


def score_with_reasons(model: PipelineModel, df: DataFrame, threshold: float, k: int = 5) -> DataFrame:
    """Probability, label, and the k largest non-zero contributions (coefficient times value) of each row."""
    scored = model.transform(_typed(df))
    coefficients = F.array(*[F.lit(float(c)) for c in model.stages[-1].coefficients.toArray()])
    names = F.array(*[F.lit(n) for n in feature_names(scored)])
    parts = F.zip_with(vector_to_array("features"), coefficients, lambda v, c: v * c)
    reasons = F.filter(F.arrays_zip(parts.alias("effect"), names.alias("name")), lambda r: r["effect"] != 0)
    sized = F.transform(reasons, lambda r: F.struct(F.abs(r["effect"]).alias("size"), r["effect"].alias("effect"), r["name"].alias("name")))
    p = vector_to_array("probability")[1]
    return scored.select(*df.columns, p.alias("p"), (p >= threshold).cast("int").alias("predicted"), F.slice(F.sort_array(sized, asc=False), 1, k).alias("reasons"))

"""Models over pair features, calibration and the measures of candidates, routes and misses."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.er import PAIR


def labelled(rows: DataFrame, truth: DataFrame) -> DataFrame:
    return rows.join(truth.select(*PAIR, F.lit(1.0).alias("label")), PAIR, "left").na.fill(0.0, ["label"])


def gbt_scores(features: DataFrame, truth: DataFrame, trees: int = 10, depth: int = 4) -> DataFrame:
    """Gradient-boosted trees on retrieved pairs only, positives weighted by the class ratio; p per pair."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array

    rows = labelled(features, truth)
    pos, n = rows.agg(F.sum("label"), F.count("*")).first()
    weight = (n - (pos or 0)) / max(1.0, pos or 0)
    rows = rows.withColumn("weight", F.when(F.col("label") == 1, weight).otherwise(1.0))
    names = [c for c in features.columns if c not in PAIR]
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="x"), GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, subsamplingRate=0.8, seed=7)])
    got = model.fit(rows).transform(rows)
    return got.select(*PAIR, F.round(F.get(vector_to_array("probability"), F.lit(1)), 6).alias("p"), "label")


def calibrated(scores: DataFrame, truth: DataFrame) -> DataFrame:
    """Platt (logistic) and isotonic calibration of p, per pair."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    rows = VectorAssembler(inputCols=["p"], outputCol="features").transform(labelled(scores, truth))
    platt = LogisticRegression(labelCol="label").fit(rows).transform(rows)
    platt = platt.select(*PAIR, "p", "label", "features", F.get(vector_to_array("probability"), F.lit(1)).alias("platt"))
    both = IsotonicRegression(labelCol="label").fit(rows).transform(platt)
    return both.select(*PAIR, "p", "label", F.round("platt", 6).alias("platt"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "prediction")), 6).alias("isotonic"))


def candidate_recall(s1: DataFrame, truth: DataFrame, pairs: DataFrame) -> DataFrame:
    found = truth.join(pairs.select(*PAIR, F.lit(1).alias("hit")), PAIR, "left").agg(F.count("*").alias("n_true"), F.count("hit").alias("n_found"))
    volume = pairs.agg(F.count("*").alias("n_candidates")).crossJoin(s1.agg(F.count("*").alias("n")))
    both = found.crossJoin(volume)
    recall = F.when(F.col("n_true") == 0, 1.0).otherwise(F.col("n_found") / F.col("n_true"))
    return both.select("n_true", "n_found", "n_candidates", F.round(recall, 6).alias("recall"), F.round(F.col("n_candidates") / F.col("n"), 6).alias("per_query"))


def route_benchmark(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """Per route: pairs, true pairs, and how many of either no other route finds."""
    h = hits.distinct()
    n = h.groupBy(*PAIR).agg(F.count("*").alias("c"))
    j = h.join(n, PAIR).join(truth.select(*PAIR, F.lit(1).alias("t")), PAIR, "left")
    alone = F.col("c") == 1
    return j.groupBy("route").agg(F.count("*").alias("volume"), F.count("t").alias("found"), F.count_if(alone).alias("only_here"), F.count_if(alone & F.col("t").isNotNull()).alias("found_only_here"))


def candidate_distribution(s1: DataFrame, pairs: DataFrame) -> DataFrame:
    c = s1.join(pairs.groupBy("s1_id").agg(F.count("*").alias("c")), "s1_id", "left").na.fill(0, ["c"])
    at = lambda q: F.round(F.percentile("c", q), 6)
    return c.agg(
        F.count("*").alias("n"), F.round(F.avg("c"), 6).alias("mean"), at(0.5).alias("median"), at(0.75).alias("p75"), at(0.9).alias("p90"), at(0.95).alias("p95"), at(0.99).alias("p99"),
        F.max("c").alias("most"), F.round(F.avg((F.col("c") == 0).cast("double")), 6).alias("zero_share"),
    )


def recall_funnel(truth: DataFrame, pairs: DataFrame, scores: DataFrame, picks: DataFrame, threshold: float) -> DataFrame:
    """True pairs by the first stage that loses them."""
    j = truth.join(pairs.select(*PAIR, F.lit(1).alias("got")), PAIR, "left").join(scores.select(*PAIR, "p"), PAIR, "left").join(picks.select(*PAIR, F.lit(1).alias("picked")), PAIR, "left")
    stage = F.when(F.col("got").isNull(), "1 not retrieved").when(F.col("p") < threshold, "2 below threshold").when(F.col("picked").isNull(), "3 not picked").otherwise("4 linked")
    return j.groupBy(stage.alias("stage")).agg(F.count("*").alias("n"))


def missed_pairs(truth: DataFrame, pairs: DataFrame, parsed: DataFrame) -> DataFrame:
    """True pairs that no route finds, by the first thing they share."""
    from lodestar.operators.er import join_records

    j = join_records(truth.join(pairs.select(*PAIR), PAIR, "left_anti"), parsed)
    q, t = lambda c: F.col(f"q.{c}"), lambda c: F.col(f"t.{c}")
    kind = F.when(q("n") == t("n"), "same name").when(F.arrays_overlap(q("name_tokens"), t("name_tokens")), "shared token").when(F.arrays_overlap(q("postals"), t("postals")), "shared postal")
    kind = kind.when(q("building") == t("building"), "shared building").when(q("country") != t("country"), "other country").otherwise("nothing shared")
    return j.select(*PAIR, kind.alias("category"))


def split_fit(features: DataFrame, truth: DataFrame, part: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(training, other) rows of features with label; part: s1_id, part, where `train` is what models may see."""
    rows = labelled(features, truth).join(part.select("s1_id", "part"), "s1_id")
    return rows.where("part = 'train'").drop("part"), rows.where("part <> 'train'").drop("part")


def feature_names(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c not in (*PAIR, "label", "part", "weight")]


def fit_trees(train: DataFrame, names: list[str], trees: int = 10, depth: int = 4, weighted: bool = True, seed: int = 7):
    """A pipeline of assembler and gradient-boosted trees on rows with label; positives weighted by the class ratio."""
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    pos, n = train.agg(F.sum("label"), F.count("*")).first()
    weight = (n - (pos or 0)) / max(1.0, pos or 0) if weighted else 1.0
    train = train.withColumn("weight", F.when(F.col("label") == 1, weight).otherwise(1.0))
    stages = [VectorAssembler(inputCols=names, outputCol="x"), GBTClassifier(featuresCol="x", labelCol="label", weightCol="weight", maxIter=trees, maxDepth=depth, subsamplingRate=0.8, featureSubsetStrategy="0.8", seed=seed)]
    return Pipeline(stages=stages).fit(train)


def scored(model, rows: DataFrame, name: str = "p") -> DataFrame:
    from pyspark.ml.functions import vector_to_array

    return model.transform(rows).withColumn(name, F.round(F.get(vector_to_array("probability"), F.lit(1)), 6)).drop("x", "rawPrediction", "probability", "prediction")


def ensemble(train: DataFrame, rows: DataFrame, first: float = 0.65) -> DataFrame:
    """Two boosted models, one deep and weighted, one shallow and plain; p is `first` of the one and the rest of the other."""
    names = feature_names(train)
    a = scored(fit_trees(train, names, 10, 5, True, 7), rows, "a")
    both = scored(fit_trees(train, names, 20, 3, False, 11), a, "b")
    return both.select(*PAIR, "label", F.round(first * F.col("a") + (1 - first) * F.col("b"), 6).alias("p"))


def importances(model, names: list[str]) -> DataFrame:
    """Gain-like importance of every feature."""
    from pyspark.sql import SparkSession

    gains = model.stages[-1].featureImportances.toArray().tolist()
    return SparkSession.getActiveSession().createDataFrame([(n, round(float(g), 6)) for n, g in zip(names, gains, strict=True)], "feature string, importance double")


def pruner_curve(train: DataFrame, rows: DataFrame, thresholds: tuple[float, ...] = (0.01, 0.02, 0.05, 0.1, 0.2)) -> DataFrame:
    """A small model that drops pairs below a threshold: recall lost and share of pairs removed, by threshold."""
    p = scored(fit_trees(train, feature_names(train), 10, 4), rows)
    pos = F.sum("label")
    sums = [F.struct(F.lit(t).alias("threshold"), (F.sum(F.when(F.col("p") < t, F.col("label")).otherwise(0.0)) / pos).alias("recall_loss"), F.avg((F.col("p") < t).cast("double")).alias("reduction")) for t in thresholds]
    rows = p.agg(F.array(*sums).alias("x")).select(F.explode("x").alias("x"))
    return rows.select("x.threshold", F.round(F.coalesce("x.recall_loss", F.lit(0.0)), 6).alias("recall_loss"), F.round("x.reduction", 6).alias("reduction"))


#: Feature sets of the ablation: all names that start with one of the prefixes.
ABLATION = {"name only": ("name_",), "address only": ("addr_",), "name and address": ("name_", "addr_"), "structure": ("country_", "postal_", "building_", "numeric_", "first_word"), "all": ("",)}


def ablation(train: DataFrame, rows: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Average precision and pairs over the threshold of a model on each set of features, on rows it wasn't fitted to."""
    from lodestar.operators.audit import probability_measures

    out = None
    for name, prefixes in ABLATION.items():
        used = [c for c in feature_names(train) if c.startswith(prefixes)]
        p = scored(fit_trees(train, used, 5, 3), rows)
        one = probability_measures(p, p.where("label = 1")).select(F.lit(name).alias("features"), F.lit(len(used)).alias("n_features"), "roc_auc", "average_precision", "brier")
        out = one if out is None else out.unionByName(one)
    return out


def save_model(model, path: str) -> None:
    """Writes a fitted pipeline with the names of its columns."""
    model.write().overwrite().save(path)


def load_model(path: str):
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)


def calibrated_apart(scores: DataFrame, truth: DataFrame, part: DataFrame) -> DataFrame:
    """Platt and isotonic calibration fitted on the training part's pairs and applied to all others."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.functions import vector_to_array
    from pyspark.ml.regression import IsotonicRegression

    train, rest = split_fit(scores.select(*PAIR, "p"), truth, part)
    wide = VectorAssembler(inputCols=["p"], outputCol="features")
    train, rest = wide.transform(train), wide.transform(rest)
    platt = LogisticRegression(labelCol="label").fit(train).transform(rest)
    platt = platt.select(*PAIR, "p", "label", "features", F.get(vector_to_array("probability"), F.lit(1)).alias("platt"))
    both = IsotonicRegression(labelCol="label").fit(train).transform(platt)
    return both.select(*PAIR, "p", "label", F.round("platt", 6).alias("platt"), F.round(F.greatest(F.lit(0.0), F.least(F.lit(1.0), "prediction")), 6).alias("isotonic"))

"""Forests: cost-weighted classifiers of links, path classifiers, inference, importance, evaluation."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hopwarden.operators.accuracy import confusion
from hopwarden.session import cut_lineage

#: Trees and depths of the link and path forests, share of rows a link forest sees, cost weights.
TREES, DEPTH, PATH_DEPTH, ROWS = 100, 12, 15, 0.9
WEIGHTS = tuple(range(1, 11))
#: Feature families whose models are kept: all four, or all without paths.
KEPT = (frozenset({"aspath", "bidirectionality", "peeringdb", "topological"}), frozenset({"bidirectionality", "peeringdb", "topological"}))


def train(rows: DataFrame, features: list[str], weight: float = 1.0, *, trees: int = TREES, depth: int = DEPTH, subset: str = "log2", share: float = ROWS, seed: int = 1) -> PipelineModel:
    """A forest on (features, label 0/1); `weight` is the cost of calling a legitimate link suspicious."""
    costed = rows.fillna(1.0, features).withColumn("w", F.when(F.col("label") == 0, float(weight)).otherwise(1.0))
    seen = costed.sample(fraction=share, seed=seed) if share < 1 else costed
    forest = RandomForestClassifier(numTrees=trees, maxDepth=depth, featureSubsetStrategy=subset, weightCol="w", labelCol="label", featuresCol="x", seed=seed)
    return Pipeline(stages=[VectorAssembler(inputCols=features, outputCol="x"), forest]).fit(seen)


def train_all(rows: DataFrame, features: list[str], weights: tuple[int, ...] = WEIGHTS, **settings: object) -> dict[int, PipelineModel]:
    """A model per cost weight; the rows are read once."""
    kept = rows.persist()
    try:
        return {w: train(kept, features, w, **settings) for w in weights}
    finally:
        kept.unpersist()


def cached_models(rows: DataFrame, features: list[str], families: list[str], place: str, weights: tuple[int, ...] = WEIGHTS, *, override: bool = False, **settings: object) -> dict[int, PipelineModel]:
    """The models of train_all, read from `place` (a day's shared folder) where they are there, else trained, and saved there for KEPT families."""
    spark = rows.sparkSession
    at = {w: f"{place}/{','.join(sorted(families))}_{w}" for w in weights}

    def saved(where: str) -> bool:
        done = spark._jvm.org.apache.hadoop.fs.Path(f"{where}.done")  # written last, so half a model is none
        return done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done)

    there = {w for w in weights if not override and saved(at[w])}
    made = train_all(rows, features, tuple(w for w in weights if w not in there), **settings) if len(there) < len(at) else {}
    if frozenset(families) in KEPT:
        for w, model in made.items():
            done = spark._jvm.org.apache.hadoop.fs.Path(f"{at[w]}.done")
            files = done.getFileSystem(spark._jsc.hadoopConfiguration())
            files.delete(done, False)
            model.write().overwrite().save(at[w])
            files.create(done, True).close()
    return {w: made[w] if w in made else PipelineModel.load(at[w]) for w in weights}


def infer(rows: DataFrame, models: dict[int, PipelineModel], features: list[str]) -> DataFrame:
    """The rows with label, proba (of that label) and sensitivity, once per model. The models' features must all be there."""
    missing = set(features) - set(rows.columns)
    if missing:
        raise ValueError(f"features not given: {sorted(missing)}")
    kept = [c for c in rows.columns if c not in features and c not in ("label", "proba", "sensitivity")]
    parts = []
    for w, model in models.items():
        p = vector_to_array("probability")
        done = model.transform(rows.drop("label").fillna(1.0, features))
        parts.append(done.select(*kept, F.col("prediction").cast("int").alias("label"), F.array_max(p).alias("proba"), F.lit(w).alias("sensitivity")))
    return reduce(DataFrame.unionByName, parts)


def path_scores(train_rows: DataFrame, rows: DataFrame, sets: dict[str, list[str]], seed: int = 1, trees: int = TREES) -> DataFrame:
    """The rows with P(label 1) of a forest per feature set ('degree', 'cone', 'cone&degree')."""
    out = rows
    for name, features in sets.items():
        model = train(train_rows, features, trees=trees, depth=PATH_DEPTH, subset="sqrt", share=1.0, seed=seed)
        scored = model.transform(out.fillna(0, features))
        out = scored.withColumn(name, vector_to_array("probability")[1]).drop("x", "rawPrediction", "probability", "prediction")
    return out


def importance(model: PipelineModel, features: list[str]) -> dict[str, float]:
    return dict(zip(features, model.stages[-1].featureImportances.toArray().tolist()))


def permutation_importance(model: PipelineModel, rows: DataFrame, features: list[str], seed: int = 1) -> dict[str, float]:
    """Loss of accuracy when a feature's values are dealt out anew: both sides are numbered within hash buckets and joined.

    A value that finds no partner keeps its place.
    """

    def accuracy(df: DataFrame) -> float:
        return model.transform(df).agg(F.avg((F.col("prediction") == F.col("label")).cast("double"))).first()[0] or 0.0

    numbered = cut_lineage(rows.fillna(1.0, features).withColumn("__id", F.monotonically_increasing_id()))
    base, buckets, out = accuracy(numbered), F.lit(max(8, rows.sparkSession.sparkContext.defaultParallelism)), {}

    def dealt(df: DataFrame, salt: str) -> DataFrame:
        h = F.xxhash64(F.lit(seed), F.lit(salt), "__id")
        keyed = df.withColumn("__b", F.pmod(h, buckets)).withColumn("__h", h)
        return keyed.withColumn("__r", F.row_number().over(Window.partitionBy("__b").orderBy("__h"))).drop("__h")

    for f in features:
        other = dealt(numbered, f"to {f}").select("__b", "__r", F.col(f).alias("__other"))
        mixed = dealt(numbered, f"from {f}").join(other, ["__b", "__r"], "left").withColumn(f, F.coalesce("__other", f))
        out[f] = base - accuracy(mixed)
    return out


def evaluate(rows: DataFrame, features: list[str], seed: int = 1, trees: int = TREES) -> DataFrame:
    """Confusion matrix of a forest trained on 70 % of the rows and tried on the rest."""
    known, new = rows.fillna(1.0, features).randomSplit([0.7, 0.3], seed)
    model = train(known, features, share=1.0, seed=seed, trees=trees)
    return confusion(model.transform(new).withColumn("predicted", F.col("prediction").cast("int")), [])

"""Classifier training, tuning, calibration and explanation on Spark ML."""

from __future__ import annotations

import json
import math
import random
from collections.abc import Callable
from dataclasses import asdict, dataclass, replace
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskloom.config import MIN_ROWS_PER_DOMAIN_MODEL, SEED, BoosterSpec
from riskloom.operators import metrics, splits
from riskloom.operators.matrix import without_prefix
from riskloom.operators.selection import class_weight
from riskloom.session import materialize

LABEL = "hallucination_label"
#: gamma is a loss reduction summed over a node's rows, minInfoGain a mean per row: taken as that of a node of 1,000 rows.
GAIN_PER_GAMMA = 1 / 1000
#: A fit has some hundred short stages, so its tasks get about as many rows as pay for their start.
ROWS_PER_TASK = 100_000


@dataclass
class RiskModel:
    """A fitted booster with the columns it reads."""

    model: GBTClassificationModel
    columns: list[str]
    label: str
    spec: BoosterSpec

    def predict(self, df: DataFrame) -> DataFrame:
        """Add ``p`` (probability of label 1) and ``pred`` (at 0.5)."""
        given = df.columns
        scored = self.model.transform(assemble(df, self.columns))
        p = vector_to_array(F.col("probability")).getItem(1)
        return scored.select(*given, p.alias("p")).withColumn("pred", (F.col("p") >= 0.5).cast("int"))

    def importance(self, spark: SparkSession, top: int | None = None) -> DataFrame:
        """feature, importance; one row per column the model reads."""
        rows = sorted(zip(self.columns, self.model.featureImportances.toArray().tolist()), key=lambda r: (-r[1], r[0]))
        return spark.createDataFrame(rows[:top], "feature string, importance double")

    def save(self, path: str) -> None:
        self.model.write().save(f"{path}/model")
        meta = {"columns": self.columns, "label": self.label, "spec": asdict(self.spec)}
        session = SparkSession.active()
        session.createDataFrame([(json.dumps(meta),)], "value string").coalesce(1).write.text(f"{path}/meta")


def load_model(spark: SparkSession, path: str) -> RiskModel:
    meta = json.loads(spark.read.text(f"{path}/meta").first().value)
    ranges = {k: tuple(v) for k, v in meta["spec"].pop("ranges").items()}
    return RiskModel(GBTClassificationModel.load(f"{path}/model"), meta["columns"], meta["label"],
                     BoosterSpec(**meta["spec"], ranges=ranges))


def assemble(df: DataFrame, columns: list[str], out: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=columns, outputCol=out, handleInvalid="error").transform(df)


def booster(spec: BoosterSpec, label: str, seed: int = SEED, validated: bool = True) -> GBTClassifier:
    est = GBTClassifier(
        featuresCol="features", labelCol=label, weightCol="weight", maxDepth=spec.max_depth, stepSize=spec.step_size,
        maxIter=spec.n_trees, subsamplingRate=spec.subsample, featureSubsetStrategy=str(spec.column_sample),
        minInstancesPerNode=spec.min_child, minInfoGain=spec.gamma * GAIN_PER_GAMMA, seed=seed)
    # small steps gain less than the default tolerance from tree to tree; stop only where the held part gets worse
    return est.setValidationIndicatorCol("is_validation")._set(validationTol=0.0) if validated else est


def training_frame(df: DataFrame, columns: list[str], ids: list[str], label: str, spec: BoosterSpec) -> DataFrame:
    """Vectors, label, class weight and the validation flag, written once for the many passes of boosting."""
    flagged = splits.validation_split(df.select(*ids, label, *columns), ids, label)
    weight = class_weight(df, label, spec.weight_multiplier).select("weight").scalar()
    ready = assemble(flagged, columns).select(
        *ids, F.col(label).cast("double").alias(label), "features", "is_validation",
        F.when(F.col(label) == 1, weight).otherwise(1.0).alias("weight"))
    return materialize(ready, "training")


def train(df: DataFrame, columns: list[str], ids: list[str], label: str = LABEL,
          spec: BoosterSpec = BoosterSpec(), seed: int = SEED) -> RiskModel:
    """Boosted trees with early stopping on an inner fifth of the rows."""
    return RiskModel(booster(spec, label, seed).fit(training_frame(df, columns, ids, label, spec)),
                     list(columns), label, spec)


def training_matrix(df: DataFrame, columns: list[str], ids: list[str], label: str, spec: BoosterSpec,
                    by: str | None = None) -> DataFrame:
    """Columns, label, class weight and validation flag of the training rows, written once for many fits.

    ``by`` names groups that are fitted alone: class weights and validation rows are those of the group.
    """
    keys = [by] if by else []
    flagged = splits.validation_split(df.select(*dict.fromkeys([*ids, *keys, label, *columns])), ids, label, by=by)
    weights = class_weight(df, label, spec.weight_multiplier, keys).select(*keys, F.col("weight").alias("_w"))
    weighted = flagged.join(weights, by, "left") if by else flagged.withColumn("_w", weights.scalar())
    weight = F.when(F.col(label) == 1, F.col("_w")).otherwise(1.0)
    return materialize(weighted.withColumns({"weight": weight, label: F.col(label).cast("double")}).drop("_w"), "matrix")


def _side_by_side(spark: SparkSession, jobs: list[Callable], parallelism: int) -> list:
    """Results of the jobs in their order; at most ``parallelism`` of them run at a time."""
    if not jobs:
        return []
    with ThreadPool(min(parallelism, len(jobs))) as pool:
        return pool.map(lambda job: job(), [inheritable_thread_target(spark)(job) for job in jobs], chunksize=1)


def fit_many(stored: DataFrame, jobs: dict[str, tuple[Column | None, list[str]]], label: str,
             spec: BoosterSpec = BoosterSpec(), parallelism: int = 4, seed: int = SEED) -> dict[str, RiskModel]:
    """A model for each job, which is a condition on the rows (or None) and the columns to read.

    ``stored`` is a ``training_matrix``: each fit reads it once, its own rows and columns only.  Its tasks follow the number
    of its rows, not that of the matrix's files, since every level of every tree starts them again.
    """
    def job(rows: Column | None, columns: list[str]) -> Callable:
        def fit() -> RiskModel:
            own = stored if rows is None else stored.filter(rows)
            ready = assemble(own, columns).select(label, "features", "is_validation", "weight").coalesce(max(1, math.ceil(own.count() / ROWS_PER_TASK)))
            return RiskModel(booster(spec, label, seed).fit(ready), list(columns), label, spec)

        return fit

    return dict(zip(jobs, _side_by_side(stored.sparkSession, [job(*j) for j in jobs.values()], parallelism)))


def trial_specs(n_trials: int, base: BoosterSpec = BoosterSpec(), seed: int = SEED) -> list[BoosterSpec]:
    """Seeded random draws from the tuning ranges; the learning rate is drawn on a log scale."""
    rng = random.Random(seed)
    out = []
    for _ in range(n_trials):
        drawn = {}
        for name, (lo, hi) in base.ranges.items():
            if name == "step_size":
                drawn[name] = math.exp(rng.uniform(math.log(lo), math.log(hi)))
            elif isinstance(lo, int):
                drawn[name] = rng.randint(lo, hi)
            else:
                drawn[name] = rng.uniform(lo, hi)
        out.append(replace(base, **drawn))
    return out


def tune(df: DataFrame, columns: list[str], ids: list[str], label: str = LABEL, n_trials: int = 20,
         base: BoosterSpec = BoosterSpec(), parallelism: int = 4, seed: int = SEED) -> tuple[BoosterSpec, list[float]]:
    """Best spec by mean AUROC over stratified folds, and the score of every trial.

    Vectors and folds are written once.  Class weights are those of the rows that a model is fitted on.
    """
    vectors = assemble(df.select(*ids, F.col(label).cast("double").alias(label), *columns), columns).select(*ids, label, "features")
    folded = materialize(splits.stratified_folds(vectors, ids, label, seed=seed), "folds")
    sizes = class_weight(folded, label, by=["fold"]).collect()  # one row a fold, five at most
    neg, pos = sum(r["negatives"] for r in sizes), sum(r["positives"] for r in sizes)
    specs = trial_specs(n_trials, base, seed)
    judge = BinaryClassificationEvaluator(labelCol=label)

    def job(spec: BoosterSpec, held) -> Callable:
        rest = pos - held["positives"]
        weight = spec.weight_multiplier * ((neg - held["negatives"]) / rest if rest else 1.0)

        def score() -> float:
            part = folded.filter(F.col("fold") != held["fold"]).withColumn("weight", F.when(F.col(label) == 1, weight).otherwise(1.0))
            model = booster(spec, label, seed, validated=False).fit(part)
            return judge.evaluate(model.transform(folded.filter(F.col("fold") == held["fold"])))

        return score

    found = _side_by_side(df.sparkSession, [job(s, held) for s in specs for held in sizes], parallelism)
    scores = [sum(found[i * len(sizes):(i + 1) * len(sizes)]) / len(sizes) for i in range(len(specs))]
    best = max(range(len(specs)), key=lambda i: scores[i])
    return specs[best], scores


def scored_set(model: RiskModel, df: DataFrame, name: str, domain: str | None = None) -> DataFrame:
    """model, domain, y, p, pred of a test set."""
    dom = F.col(domain) if domain else F.lit("all")
    return model.predict(df).select(F.lit(name).alias("model"), dom.alias("domain"),
                                    F.col(model.label).cast("int").alias("y"), "p", "pred")


def ablation(df: DataFrame, groups: dict[str, list[str]], ids: list[str], label: str = LABEL,
             spec: BoosterSpec = BoosterSpec(), parallelism: int = 4) -> DataFrame:
    """Metrics of one model per feature group, best AUROC first.

    Features that the frame lacks are ignored and empty groups skipped.  Training and test rows are written once and
    the models fitted side by side.
    """
    from riskloom.sources.readers import union_all

    present = {t: [c for c in names if c in df.columns] for t, names in groups.items()}
    jobs = {t: (None, cols) for t, cols in present.items() if cols}
    columns = [*dict.fromkeys(c for cols in present.values() for c in cols)]
    train_rows, test_rows = splits.route_split(df.select(*dict.fromkeys([*ids, label, *columns, *(["split"] if "split" in df.columns else [])])), ids, label)
    models = fit_many(training_matrix(train_rows, columns, ids, label, spec), jobs, label, spec, parallelism)
    held = materialize(test_rows, "held")
    scored = union_all([scored_set(model, held, title) for title, model in models.items()])
    sizes = F.create_map(*[x for t, cols in present.items() for x in (F.lit(t), F.lit(len(cols)))])
    return metrics.metrics_bundle(scored).withColumn("n_features", sizes[F.col("model")]) \
        .orderBy(F.col("auroc").desc_nulls_last(), "model")


def domain_plan(df: DataFrame, label: str = LABEL, min_rows: int = MIN_ROWS_PER_DOMAIN_MODEL, domain: str = "domain") -> DataFrame:
    """domain, n_rows, n_least (rows of the smaller class), fit: how a domain's model is split, or why it has none.

    ``random`` is the unstratified fallback, for a class of a single row, which can't be in both parts.
    """
    sizes = df.groupBy(domain).agg(F.count("*").alias("n_rows"), F.least(F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1)).alias("n_least"))
    how = F.when(F.col("n_rows") < min_rows, "too few rows").when(F.col("n_least") == 0, "one class") \
        .when(F.col("n_least") == 1, "random").otherwise("stratified")
    return sizes.withColumn("fit", how)


@dataclass
class DomainFits:
    """Models by domain, scored test rows of all of them (None if there are none), and the ``domain_plan`` they follow."""

    models: dict[str, RiskModel]
    scored: DataFrame | None
    plan: DataFrame

    def importance(self, spark: SparkSession) -> DataFrame | None:
        """feature, importance, domain of every model."""
        from riskloom.sources.readers import union_all

        parts = [m.importance(spark).withColumn("domain", F.lit(d)) for d, m in self.models.items()]
        return union_all(parts) if parts else None


def domain_models(df: DataFrame, columns: list[str], ids: list[str], label: str = LABEL,
                  spec: BoosterSpec = BoosterSpec(), min_rows: int = MIN_ROWS_PER_DOMAIN_MODEL,
                  domain: str = "domain", parallelism: int = 4) -> DomainFits:
    """One model per domain with enough rows and both classes, fitted side by side over one stored matrix.

    A ``split`` column is followed; without one every domain is split on its own.
    """
    from riskloom.sources.readers import union_all

    cols = without_prefix(columns)
    stored = materialize(df.select(*dict.fromkeys([*ids, domain, label, *cols, *(["split"] if "split" in df.columns else [])])), "domains")
    plan = domain_plan(stored, label, min_rows, domain)
    how = {r[domain]: r["fit"] for r in plan.filter(F.col("fit").isin("stratified", "random")).orderBy(domain).collect()}
    how.pop(None, None)  # rows without a domain are in the plan, but no model is theirs
    if not how:
        return DomainFits({}, None, plan)
    routed = stored.filter(F.col(domain).isin(*how))
    if "split" not in df.columns:
        alone = [d for d, fit in how.items() if fit == "random"]
        routed = splits.stratified_split(stored.filter(F.col(domain).isin(*(set(how) - set(alone)))), ids, label, [domain])
        if alone:
            routed = routed.unionByName(splits.random_split(stored.filter(F.col(domain).isin(*alone)), ids, [domain]))
        routed = materialize(routed, "routed")
    train_rows, test_rows = splits.route_split(routed, ids, label)
    matrix = training_matrix(train_rows, cols, ids, label, spec, domain)
    models = fit_many(matrix, {d: (F.col(domain) == d, cols) for d in how}, label, spec, parallelism)
    scored = union_all([scored_set(m, test_rows.filter(F.col(domain) == d), "domain_model", domain) for d, m in models.items()])
    return DomainFits(models, scored, plan)


def permutation_importance(model: RiskModel, df: DataFrame, ids: list[str], seed: int = SEED,
                           rows_per_block: int = 4096) -> DataFrame:
    """AUROC lost when one feature is shuffled, all features in one pass.

    Rows fall into random blocks by a hash of the id.  Within a block a feature
    takes the value of the next row in hash order, the last that of the first: a
    random permutation that no task needs more than one block for.
    """
    label = model.label
    h = splits.hash_text(seed, *[F.col(i) for i in ids])
    n_rows = df.agg(F.count("*")).scalar()
    blocks = F.greatest(F.lit(1), F.floor(n_rows / rows_per_block))
    base = df.select(F.col(label).cast("int").alias("y"), *model.columns, h.alias("_h"))
    base = base.withColumn("_b", F.pmod(F.conv(F.substring("_h", 1, 8), 16, 10).cast("bigint"), blocks))
    order = Window.partitionBy("_b").orderBy("_h")
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    moved = base.select("y", *model.columns, *[
        F.coalesce(F.lead(c).over(order), F.first(c).over(whole)).alias(f"_s_{c}") for c in model.columns])
    variants = [F.struct(F.lit("").alias("feature"), *[F.col(c).alias(c) for c in model.columns])]
    for c in model.columns:
        variants.append(F.struct(F.lit(c).alias("feature"), *[
            (F.col(f"_s_{c}") if k == c else F.col(k)).alias(k) for k in model.columns]))
    long = moved.select("y", F.explode(F.array(*variants)).alias("_v")).select("y", "_v.*")
    scored = model.predict(long).select("feature", "y", "p")
    cells = metrics.score_cells(scored, ["feature"])
    area = metrics.auroc(cells, ["feature"])
    full = area.agg(F.max(F.when(F.col("feature") == "", F.col("auroc")))).scalar()
    return area.filter(F.col("feature") != "").select("feature", (full - F.col("auroc")).alias("importance"))


def calibrate_platt(fit_on: DataFrame, apply_to: DataFrame) -> DataFrame:
    """Logistic regression of y on the score p; replaces ``p``."""
    source = fit_on.select(F.col("y").cast("double").alias("label"), "p")
    lr = LogisticRegression(featuresCol="v", labelCol="label", regParam=0.0)
    model = lr.fit(materialize(assemble(source, ["p"], "v").select("label", "v"), "platt"))
    given = apply_to.columns
    scored = model.transform(assemble(apply_to, ["p"], "v")).withColumn(
        "_p", vector_to_array(F.col("probability")).getItem(1))
    return scored.select(*[F.col("_p").alias("p") if c == "p" else F.col(c) for c in given])


def calibrate_isotonic(fit_on: DataFrame, apply_to: DataFrame) -> DataFrame:
    """Isotonic regression of y on the score p; replaces ``p``.

    Equal scores fold to a weighted mean first, so the fit sees distinct scores.
    """
    cells = fit_on.groupBy("p").agg(F.avg(F.col("y").cast("double")).alias("label"),
                                    F.count("*").cast("double").alias("weight"))
    ir = IsotonicRegression(featuresCol="p", labelCol="label", weightCol="weight", predictionCol="_p")
    model = ir.fit(materialize(cells, "isotonic"))
    given = apply_to.columns
    scored = model.transform(apply_to)
    return scored.select(*[F.col("_p").alias("p") if c == "p" else F.col(c) for c in given])

"""End-to-end plans."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.config import K_BEST, MIN_ROWS_PER_DOMAIN_MODEL, BoosterSpec
from riskloom.functions.prompts import format_prompt, parse_options
from riskloom.operators import clustering, context, labelers, matrix, metrics, modeling, responses, selection, splits, stats
from riskloom.operators import uncertainty as U
from riskloom.plans.views import Views
from riskloom.session import is_stored, materialize


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Label money answers, split by class, report class rates per split and domain."""
    from riskloom.plans.label_queries import split_rate_gap

    return split_rate_gap(Views(spark, sf_dir))


def prepare(df: DataFrame, limit: int | None = None, style: str = "simple") -> DataFrame:
    """Processed prompts: an optional seeded sample, then the formatted prompt, then pruning."""
    from riskloom.sources.readers import prune_columns

    if limit:
        df = splits.sample_limit(df, ["prompt_id"], limit)
    options = parse_options(F.col("options")) if "options" in df.columns else None
    documents = F.col("documents") if "documents" in df.columns else None
    formatted = format_prompt(F.col("prompt"), F.col("domain"), style, options, documents)
    return prune_columns(df.withColumn("formatted_prompt", formatted))


@dataclass
class RunResult:
    """Lazy tables and the fitted model of one run; ``unruled`` counts answered prompts of domains without a rule."""

    labelled: DataFrame
    unruled: DataFrame
    features: DataFrame
    model: modeling.RiskModel
    scored: DataFrame
    metrics: DataFrame


def run(prompts: DataFrame, samples: DataFrame, tokens: DataFrame, vectors: DataFrame, gazetteer: DataFrame,
        similarity: str = "grams", mcq: bool = False, tune_trials: int = 0, fit_on: str = "train",
        spec: BoosterSpec = BoosterSpec()) -> RunResult:
    """Prompts and stored answers to labels, features, a model and its metrics.

    ``tokens`` are those of each prompt's primary answer, ``vectors`` one per
    sample.  ``fit_on='all'`` sets fill values and feature choice on all rows, as
    the published pipeline did; the default keeps the test rows out.
    """
    primary = responses.primary_responses(samples)
    labelled = labelers.label_responses(prompts, primary, similarity)
    labelled = materialize(splits.stratified_split(labelled, ["prompt_id"], check=True), "labelled")
    entropy = U.cluster_entropy(clustering.cluster_weights(vectors))
    letters = U.letter_features(samples) if mcq else None
    first = U.first_token(tokens) if mcq else None
    epistemic = U.epistemic_features(prompts, entropy, tokens, letters, first)
    entities = context.extract_entities(prompts.select("prompt_id", "prompt"), gazetteer)
    contextual = context.contextual_features(prompts.select("prompt_id", "prompt"), entities)
    raw = materialize(matrix.feature_matrix(labelled, epistemic, contextual), "matrix")
    columns = matrix.feature_columns(raw)

    def basis(df: DataFrame) -> DataFrame | None:
        return df.filter(F.col("split") == "train") if fit_on == "train" else None

    filled = matrix.impute(raw, columns, "mean", basis(raw))
    filled = materialize(matrix.impute_residual(filled, columns, basis(filled)), "filled")
    rows = filled if fit_on == "all" else filled.filter(F.col("split") == "train")
    chosen = selection.select_features(rows, columns, modeling.LABEL, k_best=K_BEST)
    train, test = splits.route_split(filled, ["prompt_id"])
    if tune_trials:
        spec, _ = modeling.tune(train, chosen, ["prompt_id"], n_trials=tune_trials, base=spec)
    model = modeling.train(train, chosen, ["prompt_id"], spec=spec)
    scored = modeling.scored_set(model, test, "test").unionByName(modeling.scored_set(model, train, "train"))
    return RunResult(labelled, labelers.unruled_domains(prompts, primary), filled, model, scored, metrics.metrics_bundle(scored))


@dataclass
class Answers:
    """Tables of the research questions over one matrix; those of domain models are None where no domain has enough rows."""

    ablation: DataFrame
    domain_plan: DataFrame
    domain_metrics: DataFrame | None
    importance_variation: DataFrame | None
    importance_grid: DataFrame | None
    semantic_vs_naive: DataFrame
    tests: DataFrame
    rates: DataFrame
    chi_square: DataFrame
    proportions: DataFrame
    terciles: DataFrame
    trend: DataFrame
    document: DataFrame


def research_questions(features: DataFrame, ids: list[str] | None = None, label: str = modeling.LABEL, spec: BoosterSpec = BoosterSpec(),
                       min_rows: int = MIN_ROWS_PER_DOMAIN_MODEL, parallelism: int = 4, top: int = 20) -> Answers:
    """Every research question over one feature matrix, such as ``run(...).features``.

    The matrix is written once if it isn't a stored table yet; models by feature group and by domain are fitted over it,
    and the tests of domains, features and rarity read the same rows.
    """
    ids = ids or ["prompt_id"]
    stored = features if is_stored(features) else materialize(features, "matrix")
    columns = matrix.feature_columns(stored)
    ablation = materialize(modeling.ablation(stored, matrix.feature_groups(columns), ids, label, spec, parallelism), "ablation")
    fits = modeling.domain_models(stored, columns, ids, label, spec, min_rows, parallelism=parallelism)
    importance = fits.importance(stored.sparkSession)
    tests = stats.correlation_test(stored, columns, label)
    rates, chi = stats.domain_rates(stored, label), stats.chi_square(stored, label)
    trend = stats.rarity_trend(stored, label)
    return Answers(
        ablation, fits.plan, metrics.metrics_bundle(fits.scored) if fits.models else None,
        stats.importance_variation(importance) if fits.models else None,
        stats.importance_by_domain(importance, top=top) if fits.models else None,
        stats.semantic_vs_naive(ablation, matrix.GROUP_TITLES["semantic"], matrix.GROUP_TITLES["naive"], ["domain"]), tests, rates, chi,
        stats.pairwise_proportions(stored, label), stats.rarity_terciles(stored, label), trend,
        summary_document(ablation, rates, chi, tests, trend, top))


def summary_document(bundle: DataFrame, rates: DataFrame, chi: DataFrame, tests: DataFrame, trend: DataFrame,
                     top: int = 20) -> DataFrame:
    """One nested JSON document of finished result tables, each a few rows long."""
    def rows(df: DataFrame, name: str):
        return df.agg(F.sort_array(F.collect_list(F.struct(*df.columns))).alias(name))

    parts = [rows(bundle, "ablation_study"), rows(rates, "domain_stats"), rows(chi, "domain_comparison"),
             rows(tests.orderBy(F.abs("pearson_r").desc_nulls_last(), "feature").limit(top), "top_correlated_features"),
             rows(trend, "knowledge_overshadowing")]
    first = parts[0]
    return first.select(F.to_json(F.struct(
        F.col("ablation_study"), *[p.scalar().alias(p.columns[0]) for p in parts[1:]])).alias("document"))

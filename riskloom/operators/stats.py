"""Correlation, independence and proportion tests as aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskloom.config import SEMANTIC_GAIN, VARIATION_FLAG
from riskloom.functions.distributions import chi2_p_value, normal_p_value, t_p_value
from riskloom.operators.ranking import exact_quantiles, running_totals
from riskloom.operators.selection import label_cells


def _with_t(df: DataFrame) -> DataFrame:
    """Add ``t`` for a correlation ``r`` over ``n`` rows; NULL when |r| = 1 or n < 3."""
    left = 1.0 - F.col("r") * F.col("r")
    return df.withColumn("t", F.when((left > 0) & (F.col("n") > 2), F.col("r") * F.sqrt((F.col("n") - 2) / left)))


def pearson(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """feature, n, r, t of every feature against the label in one aggregation."""
    aggs = []
    for c in columns:
        x = F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
        aggs += [F.corr(x, F.col(label).cast("double")).alias(f"r_{c}"), F.count(x).alias(f"n_{c}")]
    wide = df.agg(*aggs)
    rows = [F.struct(F.lit(c).alias("feature"), F.col(f"n_{c}").alias("n"), F.col(f"r_{c}").alias("r")) for c in columns]
    return _with_t(wide.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*"))


def spearman(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Rank correlation with average ranks for ties.

    A binary label has two ranks, so it correlates as it stands.  Ranks come from
    running counts of distinct values and are centred before squaring.
    """
    cells = label_cells(df, columns, label)
    ranked = running_totals(cells, ["feature"], [F.col("x")], {"n": F.col("n"), "pos": F.col("pos")})
    total, hits = F.col("total_n").cast("double"), F.col("total_pos").cast("double")
    dev = (F.col("cum_n") - (F.col("n") - 1) / 2.0) - (total + 1) / 2.0
    cov = F.sum(dev * (F.col("pos") - F.col("n") * hits / total))
    spread = F.sum(F.col("n") * dev * dev)
    y_spread = F.max(hits * (total - hits) / total)
    return _with_t(ranked.groupBy("feature").agg(
        F.max("total_n").alias("n"),
        F.when((spread > 0) & (y_spread > 0), cov / F.sqrt(spread * y_spread)).alias("r")))


CORRELATIONS = {"pearson": pearson, "spearman": spearman, "pointbiserial": pearson}


def feature_correlations(df: DataFrame, columns: list[str], label: str, method: str = "pearson") -> DataFrame:
    """feature, r; strongest first."""
    if method not in CORRELATIONS:
        raise ValueError(f"unknown method {method!r}")
    return CORRELATIONS[method](df, columns, label).select("feature", "r").orderBy(F.abs("r").desc_nulls_last(), "feature")


def correlation_test(df: DataFrame, columns: list[str], label: str) -> DataFrame:
    """Pearson, Spearman and point-biserial r and p, with significance flags."""
    p = pearson(df, columns, label)
    s = spearman(df, columns, label).select("feature", F.col("r").alias("spearman_r"), F.col("t").alias("_st"))
    out = p.join(s, "feature").select(
        "feature", "n", F.col("r").alias("pearson_r"), t_p_value(F.col("t"), F.col("n") - 2).alias("pearson_p"),
        "spearman_r", t_p_value(F.col("_st"), F.col("n") - 2).alias("spearman_p"))
    return out.select(
        "*", F.col("pearson_r").alias("pointbiserial_r"), F.col("pearson_p").alias("pointbiserial_p"),
        (F.col("pearson_p") < 0.05).alias("significant_005"), (F.col("pearson_p") < 0.01).alias("significant_001")) \
        .orderBy(F.abs("pearson_r").desc_nulls_last(), "feature")


def correlation_matrix(df: DataFrame, columns: list[str]) -> DataFrame:
    """feature_a, feature_b, r for every ordered pair, from one aggregation."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1:]]
    wide = df.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"{a}|{b}") for a, b in pairs])

    def row(a: str, b: str, r: Column) -> Column:
        return F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), r.alias("r"))

    rows = [row(c, c, F.lit(1.0)) for c in columns]
    for a, b in pairs:
        rows += [row(a, b, F.col(f"`{a}|{b}`")), row(b, a, F.col(f"`{a}|{b}`"))]
    return wide.select(F.explode(F.array(*rows)).alias("_r")).select("_r.*")


# --- domains -------------------------------------------------------------------

def domain_rates(df: DataFrame, label: str, domain: str = "domain") -> DataFrame:
    return df.groupBy(domain).agg(F.avg(label).alias("rate"), F.count("*").alias("n")).orderBy(F.col("rate").desc(), domain)


def crosstab(df: DataFrame, label: str, domain: str = "domain") -> DataFrame:
    return df.groupBy(domain).agg(F.count_if(F.col(label) == 0).alias("label_0"),
                                  F.count_if(F.col(label) == 1).alias("label_1"))


def expected_counts(table: DataFrame, domain: str = "domain") -> DataFrame:
    """The crosstab with expected counts; margins come from its own few rows."""
    whole = Window.partitionBy(F.lit(0))
    t0, t1 = F.sum("label_0").over(whole), F.sum("label_1").over(whole)
    rows, total = F.col("label_0") + F.col("label_1"), t0 + t1
    return table.select(domain, "label_0", "label_1", (rows * t0 / total).alias("expected_0"),
                        (rows * t1 / total).alias("expected_1"), F.count("*").over(whole).alias("n_domains"))


def chi_square(df: DataFrame, label: str, domain: str = "domain") -> DataFrame:
    """chi_square, dof, p_value, significant; Yates' correction when dof is 1."""
    exp = expected_counts(crosstab(df, label, domain), domain)

    def part(got: str, want: str) -> Column:
        gap = F.abs(F.col(got) - F.col(want))
        yates = F.when(F.col("n_domains") == 2, gap - F.least(F.lit(0.5), gap)).otherwise(gap)
        return F.when(F.col(want) > 0, yates * yates / F.col(want)).otherwise(0.0)

    out = exp.agg(F.sum(part("label_0", "expected_0") + part("label_1", "expected_1")).alias("chi_square"),
                  (F.count("*") - 1).alias("dof"))
    out = out.withColumn("p_value", chi2_p_value(F.col("chi_square"), F.col("dof")))
    return out.withColumn("significant", F.col("p_value") < 0.05)


def domain_pairs(rates: DataFrame, domain: str = "domain") -> DataFrame:
    """domain1 < domain2 with both sides' columns.

    ``rates`` holds one row per configured domain, so the list is short.
    """
    others = [c for c in rates.columns if c != domain]
    item = F.struct(domain, *others)
    listed = rates.agg(F.sort_array(F.collect_list(item)).alias("_all"))
    first = listed.select("_all", F.posexplode("_all").alias("_i", "_a"))
    both = first.select("_a", F.explode(F.slice("_all", F.col("_i") + 2, F.size("_all"))).alias("_b"))
    return both.select(F.col(f"_a.{domain}").alias("domain1"), F.col(f"_b.{domain}").alias("domain2"),
                       *[F.col(f"_a.{c}").alias(f"{c}1") for c in others], *[F.col(f"_b.{c}").alias(f"{c}2") for c in others])


def pairwise_proportions(df: DataFrame, label: str, domain: str = "domain", always: bool = False) -> DataFrame:
    """Pooled two-sided z for every domain pair, if the overall test is significant."""
    counts = df.groupBy(domain).agg(F.sum(F.col(label).cast("bigint")).alias("hits"), F.count("*").alias("n"))
    pairs = domain_pairs(counts, domain)
    pooled = (F.col("hits1") + F.col("hits2")) / (F.col("n1") + F.col("n2"))
    error = F.sqrt(pooled * (1 - pooled) * (1 / F.col("n1") + 1 / F.col("n2")))
    z = F.when(error > 0, (F.col("hits1") / F.col("n1") - F.col("hits2") / F.col("n2")) / error)
    out = pairs.select("domain1", "domain2", z.alias("z_statistic"))
    out = out.withColumn("p_value", normal_p_value(F.col("z_statistic")))
    out = out.withColumn("significant", F.col("p_value") < 0.05)
    if always:
        return out
    overall = chi_square(df, label, domain).select("significant").scalar()
    return out.filter(overall)


# --- rarity ----------------------------------------------------------------------

# Names of the three groups.
TERCILES = ["Low Rarity (Popular)", "Medium Rarity", "High Rarity (Rare)"]


def rarity_terciles(df: DataFrame, label: str, rarity: str = "avg_entity_rarity",
                    n_entities: str = "num_entities") -> DataFrame:
    """Rate and size per third of the rarity, right-closed; equal edges give fewer groups."""
    some = df.filter(F.col(n_entities) > 0)
    edges = exact_quantiles(some.select(F.col(rarity).alias("x")), [], [1 / 3, 2 / 3])
    cut = edges.agg(F.struct(F.min("at").alias("a"), F.max("at").alias("b")).alias("s")).scalar()
    x = F.col(rarity)
    group = F.when(x <= cut.getField("a"), 0).when(x <= cut.getField("b"), 1).otherwise(2)
    names = F.array(*[F.lit(t) for t in TERCILES])
    return some.groupBy(group.alias("tercile")).agg(F.avg(label).alias("rate"), F.count("*").alias("n")).select(
        "tercile", F.element_at(names, F.col("tercile") + 1).alias("rarity_group"), "rate", "n")


def rarity_trend(df: DataFrame, label: str, rarity: str = "avg_entity_rarity",
                 n_entities: str = "num_entities") -> DataFrame:
    """Correlation of rarity and label; supported when positive and p < .05."""
    got = pearson(df.filter(F.col(n_entities) > 0), [rarity], label)
    out = got.select("n", "r", "t", t_p_value(F.col("t"), F.col("n") - 2).alias("p_value"))
    return out.withColumn("supported", (F.col("r") > 0) & (F.col("p_value") < 0.05))


# --- importance across domains ---------------------------------------------------

def importance_variation(importance: DataFrame) -> DataFrame:
    """Spread of each feature's importance over at least two domains, widest first."""
    out = importance.groupBy("feature").agg(
        F.avg("importance").alias("mean_importance"), F.stddev_pop("importance").alias("std_importance"),
        F.min("importance").alias("min_importance"), F.max("importance").alias("max_importance"),
        F.count("*").alias("num_domains")).filter(F.col("num_domains") >= 2)
    cv = F.when(F.col("mean_importance") > 0, F.col("std_importance") / F.col("mean_importance")).otherwise(0.0)
    return out.select(
        "feature", "mean_importance", "std_importance", cv.alias("coefficient_variation"), "min_importance",
        "max_importance", (F.col("max_importance") - F.col("min_importance")).alias("importance_range"),
        "num_domains", (cv > VARIATION_FLAG).alias("varies_across_domains")) \
        .orderBy(F.col("coefficient_variation").desc(), "feature")


def importance_by_domain(importance: DataFrame, domains: list[str] | None = None, top: int | None = None) -> DataFrame:
    """feature by domain grid with the row mean; the ``top`` features by that mean.

    Without ``domains`` every domain of the table is a column (one name a domain reaches the driver); a list that
    leaves one of them out raises, since its importances would be lost.
    """
    present = sorted(r.domain for r in importance.select("domain").distinct().collect() if r.domain is not None)
    if domains is not None and (missing := set(present) - set(domains)):
        raise ValueError(f"domains {sorted(missing)} are not in the list")
    domains = domains or present
    wide = importance.groupBy("feature").pivot("domain", domains).agg(F.first("importance"))
    cols = [F.col(f"`{d}`") for d in domains]
    seen = [F.when(c.isNotNull(), 1).otherwise(0) for c in cols]
    mean = sum((F.coalesce(c, F.lit(0.0)) for c in cols[1:]), F.coalesce(cols[0], F.lit(0.0))) / sum(seen[1:], seen[0])
    out = wide.withColumn("row_mean", mean)
    return out if top is None else out.orderBy(F.col("row_mean").desc(), "feature").limit(top)


def semantic_vs_naive(results: DataFrame, semantic: str, naive: str, keys: list[str]) -> DataFrame:
    """AUROC of two named models side by side, the gain and whether it passes the bar."""
    pick = lambda name: F.max(F.when(F.col("model") == name, F.col("auroc")))
    both = results.groupBy(*keys).agg(pick(naive).alias("naive_auroc"), pick(semantic).alias("semantic_auroc"))
    gain = F.col("semantic_auroc") - F.col("naive_auroc")
    return both.filter(gain.isNotNull()).select(
        *keys, "naive_auroc", "semantic_auroc", gain.alias("improvement"),
        (100.0 * gain / F.col("naive_auroc")).alias("improvement_pct"), (gain > SEMANTIC_GAIN).alias("supported"))

"""Statistics and hypothesis tests (survey 2.10)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom.operators import context, metrics, stats
from riskloom.plans.eval_queries import _AUC, all_scored, r6
from riskloom.plans.feature_queries import found
from riskloom.plans.label_queries import math_labels
from riskloom.plans.registry import query
from riskloom.plans.views import VIEW_SQL, Views
from riskloom.session import materialize

COLS = Views.FEATURES


def _t_p_sql(t, dof):
    """Two-sided p of Student's t by its finite series in the angle atan(t / sqrt(dof))."""
    th = f"atan(abs({t}) / sqrt({dof}))"
    even = (f"sin({th}) * list_sum(list_transform(range(CAST({dof} // 2 AS BIGINT)), "
            f"lambda k: exp(lgamma(k + 0.5) - lgamma(k + 1.0)) / sqrt(pi()) * pow(cos({th}), 2 * k)))")
    odd = (f"2 / pi() * ({th} + sin({th}) * coalesce(list_sum(list_transform(range(CAST(({dof} - 1) // 2 AS BIGINT)), "
           f"lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1.0) - lgamma(k + 1.5)) * pow(cos({th}), 2 * k + 1))), 0))")
    return f"1 - CASE WHEN ({dof}) % 2 = 0 THEN {even} ELSE {odd} END"


_PEARSON = """pe AS (SELECT feature, count(*) AS n, corr(x, y) AS r FROM v_long GROUP BY 1),
    pt AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM pe)"""
_SPEARMAN = """rk AS (SELECT feature, rank() OVER (PARTITION BY feature ORDER BY x) + (count(*) OVER (PARTITION BY feature, x) - 1) / 2.0 AS rx,
      rank() OVER (PARTITION BY feature ORDER BY y) + (count(*) OVER (PARTITION BY feature, y) - 1) / 2.0 AS ry FROM v_long),
    sp AS (SELECT feature, count(*) AS n, corr(rx, ry) AS r FROM rk GROUP BY 1),
    st AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM sp)"""


@query("pearson_test", f"""WITH {_PEARSON} SELECT feature, n, round(r, 6) AS r, round(t, 5) AS t, round({_t_p_sql('t', '(n - 2)')}, 6) AS p_value FROM pt""", ("v_long",))
def pearson_test(v):
    got = stats.pearson(v.features, COLS, "y")
    return got.select("feature", "n", *r6("r"), F.round("t", 5).alias("t"),
                      F.round(stats.t_p_value(F.col("t"), F.col("n") - 2), 6).alias("p_value"))


@query("spearman_test", f"""WITH {_SPEARMAN} SELECT feature, n, round(r, 6) AS r, round(t, 5) AS t, round({_t_p_sql('t', '(n - 2)')}, 6) AS p_value FROM st""", ("v_long",))
def spearman_test(v):
    got = stats.spearman(v.features, COLS, "y")
    return got.select("feature", "n", *r6("r"), F.round("t", 5).alias("t"),
                      F.round(stats.t_p_value(F.col("t"), F.col("n") - 2), 6).alias("p_value"))


@query("pointbiserial_test", """SELECT feature, round((avg(x) FILTER (WHERE y = 1) - avg(x) FILTER (WHERE y = 0)) / stddev_pop(x)
      * sqrt(count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0) / (count(*)::DOUBLE * count(*))), 6) AS r FROM v_long GROUP BY 1""", ("v_long",))
def pointbiserial_test(v):
    return stats.CORRELATIONS["pointbiserial"](v.features, COLS, "y").select("feature", *r6("r"))


@query("significance_flags", f"""WITH {_PEARSON}, q AS (SELECT *, {_t_p_sql('t', '(n - 2)')} AS p FROM pt)
    SELECT feature, round(r, 6) AS pearson_r, p < 0.05 AS significant_005, p < 0.01 AS significant_001 FROM q""", ("v_long",))
def significance_flags(v):
    return stats.correlation_test(v.features, COLS, "y").select("feature", *r6("pearson_r"), "significant_005", "significant_001")


@query("feature_correlations", f"""WITH {_PEARSON}, {_SPEARMAN} SELECT 'pearson' AS method, feature, round(r, 6) AS r FROM pe
    UNION ALL SELECT 'spearman', feature, round(r, 6) FROM sp""", ("v_long",))
def feature_correlations(v):
    parts = [stats.feature_correlations(v.features, COLS, "y", m).select(F.lit(m).alias("method"), "feature", *r6("r"))
             for m in ("pearson", "spearman")]
    return parts[0].unionByName(parts[1])


@query("correlation_matrix", """SELECT a.feature AS feature_a, b.feature AS feature_b, round(corr(a.x, b.x), 6) AS r
    FROM v_long a JOIN v_long b USING (doc_id) GROUP BY 1, 2""", ("v_long",))
def correlation_matrix(v):
    return stats.correlation_matrix(v.features, COLS).select("feature_a", "feature_b", *r6("r"))


@query("domain_rates", "SELECT domain, round(avg(hallucination_label), 6) AS rate, count(*) AS n FROM v_math_labels GROUP BY 1", ("v_math_labels",))
def domain_rates(v):
    return stats.domain_rates(math_labels(v), "hallucination_label").select("domain", *r6("rate"), "n")


@query("crosstab", """SELECT domain, count(*) FILTER (WHERE hallucination_label = 0) AS label_0, count(*) FILTER (WHERE hallucination_label = 1) AS label_1
    FROM v_math_labels GROUP BY 1""", ("v_math_labels",))
def crosstab(v):
    return stats.crosstab(math_labels(v), "hallucination_label")


# labels whose rate depends on the priority, so that the pairwise tests run
VIEW_SQL["v_tilted"] = ((), """
    SELECT o_orderpriority AS domain, CAST(o_orderkey % 10 < 3 + CAST(substr(o_orderpriority, 1, 1) AS INTEGER) AS INTEGER) AS y FROM orders""")
_CHI = """WITH c AS (SELECT domain, y, count(*) AS o FROM v_tilted GROUP BY 1, 2),
    g AS (SELECT d.domain, k.y, coalesce(o, 0) AS o FROM (SELECT DISTINCT domain FROM c) d CROSS JOIN (SELECT DISTINCT y FROM c) k LEFT JOIN c USING (domain, y)),
    e AS (SELECT *, sum(o) OVER (PARTITION BY domain) * sum(o) OVER (PARTITION BY y) / sum(o) OVER () AS x FROM g),
    chi AS (SELECT sum((o - x) ** 2 / x) AS chi_square, count(DISTINCT domain) - 1 AS dof FROM e)"""


def tilted(v):
    level = F.substring("o_orderpriority", 1, 1).cast("int")
    return v.table("orders").select(F.col("o_orderpriority").alias("domain"),
                                    (F.col("o_orderkey") % 10 < 3 + level).cast("int").alias("y"))


@query("chi_square", f"""{_CHI} SELECT round(chi_square, 5) AS chi_square, dof, round(exp(-chi_square / 2) * (1 + chi_square / 2), 6) AS p_value,
      exp(-chi_square / 2) * (1 + chi_square / 2) < 0.05 AS significant FROM chi""", ("v_tilted",))
def chi_square(v):
    return stats.chi_square(tilted(v), "y").select(F.round("chi_square", 5).alias("chi_square"), "dof", *r6("p_value"), "significant")


@query("chi_square_yates", """WITH c AS (SELECT l_linestatus AS d, l_returnflag = 'R' AS y, count(*) AS o FROM lineitem GROUP BY ALL),
    e AS (SELECT *, sum(o) OVER (PARTITION BY d) * sum(o) OVER (PARTITION BY y) / sum(o) OVER () AS x FROM c)
    SELECT round(sum((abs(o - x) - least(0.5::DOUBLE, abs(o - x))) ** 2 / x), 5) AS chi_square, 1::BIGINT AS dof FROM e""")
def chi_square_yates(v):
    li = v.table("lineitem").select(F.col("l_linestatus").alias("domain"), (F.col("l_returnflag") == "R").cast("int").alias("y"))
    return stats.chi_square(li, "y").select(F.round("chi_square", 5).alias("chi_square"), "dof")


@query("expected_counts", f"""{_CHI} SELECT domain, CAST(sum(o) FILTER (WHERE y = 0) AS BIGINT) AS label_0, CAST(sum(o) FILTER (WHERE y = 1) AS BIGINT) AS label_1,
      round(sum(x) FILTER (WHERE y = 0), 6) AS expected_0, round(sum(x) FILTER (WHERE y = 1), 6) AS expected_1 FROM e GROUP BY 1""", ("v_tilted",))
def expected_counts(v):
    return stats.expected_counts(stats.crosstab(tilted(v), "y")).select("domain", "label_0", "label_1", *r6("expected_0", "expected_1"))


@query("pairs_domains", """SELECT a.domain AS domain1, b.domain AS domain2 FROM (SELECT DISTINCT domain FROM v_tilted) a
    JOIN (SELECT DISTINCT domain FROM v_tilted) b ON a.domain < b.domain""", ("v_tilted",))
def pairs_domains(v):
    return stats.domain_pairs(tilted(v).select("domain").distinct()).select("domain1", "domain2")


_ERF = "2 / sqrt(pi()) * exp(-{x} * {x}) * list_sum(list_transform(range(200), lambda k: exp(k * ln(2) + (2 * k + 1) * ln({x}) - (lgamma(2 * k + 2.0) - k * ln(2) - lgamma(k + 1.0)))))"


@query("pairwise_proportions", f"""{_CHI}, r AS (SELECT domain, sum(y) AS h, count(*) AS n FROM v_tilted GROUP BY 1),
    z AS (SELECT a.domain AS domain1, b.domain AS domain2, (a.h / a.n - b.h / b.n) / sqrt((a.h + b.h) / (a.n + b.n) * (1 - (a.h + b.h) / (a.n + b.n)) * (1 / a.n + 1 / b.n)) AS z
      FROM r a JOIN r b ON a.domain < b.domain WHERE (SELECT exp(-chi_square / 2) * (1 + chi_square / 2) < 0.05 FROM chi))
    SELECT domain1, domain2, round(z, 5) AS z_statistic, abs(z) > 1.959963984540054 AS significant FROM z""", ("v_tilted",))
def pairwise_proportions(v):
    return stats.pairwise_proportions(tilted(v), "y").select("domain1", "domain2", F.round("z_statistic", 5).alias("z_statistic"), "significant")


VIEW_SQL["v_rare"] = (("v_entity", "v_rarity"), """
    SELECT e.prompt, CAST(e.n_pos * 3 > e.n_rows AS INTEGER) AS y, length(e.prompt) * r.mean AS rarity, r.num_entities FROM v_entity e JOIN v_rarity r ON r.prompt = e.prompt""")


def rare(v):
    r = context.entity_rarity(found(v), "prompt")
    y = (F.col("n_pos") * 3 > F.col("n_rows")).cast("int")
    return v.entity_prompts.join(r, "prompt").select(
        "prompt", y.alias("y"), (F.length("prompt") * F.col("avg_entity_rarity")).alias("avg_entity_rarity"), "num_entities")


@query("rarity_terciles", """WITH q AS (SELECT quantile_cont(round(rarity, 9), 1/3) AS a, quantile_cont(round(rarity, 9), 2/3) AS b FROM v_rare)
    SELECT CAST(CASE WHEN round(rarity, 9) <= a THEN 0 WHEN round(rarity, 9) <= b THEN 1 ELSE 2 END AS INTEGER) AS tercile,
      ['Low Rarity (Popular)', 'Medium Rarity', 'High Rarity (Rare)'][CASE WHEN round(rarity, 9) <= a THEN 0 WHEN round(rarity, 9) <= b THEN 1 ELSE 2 END + 1] AS rarity_group,
      round(avg(y), 6) AS rate, count(*) AS n FROM v_rare, q GROUP BY 1, 2""", ("v_rare",))
def rarity_terciles(v):
    df = materialize(rare(v).withColumn("avg_entity_rarity", F.round("avg_entity_rarity", 9)), "rarity")
    return stats.rarity_terciles(df, "y").select("tercile", "rarity_group", *r6("rate"), "n")


@query("rarity_trend", f"""WITH a AS (SELECT count(*) AS n, corr(rarity, y) AS r FROM v_rare), b AS (SELECT *, r * sqrt((n - 2) / (1 - r * r)) AS t FROM a)
    SELECT n, round(r, 6) AS r, round(t, 4) AS t, r > 0 AND ({_t_p_sql('t', '(n - 2)')}) < 0.05 AS supported FROM b""", ("v_rare",))
def rarity_trend(v):
    return stats.rarity_trend(rare(v), "y").select("n", *r6("r"), F.round("t", 4).alias("t"), "supported")


def importance(v):
    """Mean share of each feature per language, standing in for model importances."""
    from riskloom.operators.matrix import long_features

    long = long_features(v.features, COLS, ["domain"])
    return long.groupBy("domain", "feature").agg(F.avg("x").alias("importance"))


_IMP = "imp AS (SELECT domain, feature, avg(x) AS importance FROM v_long GROUP BY 1, 2)"


@query("importance_variation", f"""WITH {_IMP}, s AS (SELECT feature, avg(importance) AS m, stddev_pop(importance) AS sd, min(importance) AS lo, max(importance) AS hi, count(*) AS n FROM imp GROUP BY 1)
    SELECT feature, round(m, 6) AS mean_importance, round(sd, 6) AS std_importance, round(sd / m, 6) AS coefficient_variation, round(lo, 6) AS min_importance,
      round(hi, 6) AS max_importance, round(hi - lo, 6) AS importance_range, n AS num_domains, sd / m > 0.3 AS varies_across_domains FROM s""", ("v_long",))
def importance_variation(v):
    d = ["mean_importance", "std_importance", "coefficient_variation", "min_importance", "max_importance", "importance_range"]
    return stats.importance_variation(importance(v)).select("feature", *r6(*d), "num_domains", "varies_across_domains")


_LANGS = ["de", "en", "es", "fr"]


@query("importance_by_domain", f"""WITH {_IMP} SELECT feature, {', '.join(f"round(max(importance) FILTER (WHERE domain = '{d}'), 6) AS {d}" for d in _LANGS)},
      round(avg(importance), 6) AS row_mean FROM imp GROUP BY 1 ORDER BY row_mean DESC LIMIT 4""", ("v_long",))
def importance_by_domain(v):
    return stats.importance_by_domain(importance(v), top=4).select("feature", *r6(*_LANGS, "row_mean"))


@query("semantic_vs_naive", f"""WITH {_AUC}, s AS (SELECT domain, max(auroc) FILTER (WHERE model = 'discount') AS n, max(auroc) FILTER (WHERE model = 'discount_tax') AS s FROM auc GROUP BY 1)
    SELECT domain, round(n, 6) AS naive_auroc, round(s, 6) AS semantic_auroc, round(s - n, 6) AS improvement, round(100 * (s - n) / n, 4) AS improvement_pct, s - n > 0.05 AS supported
    FROM s WHERE s IS NOT NULL AND n IS NOT NULL""", ("v_all_scored",))
def semantic_vs_naive(v):
    area = metrics.auroc(metrics.score_cells(all_scored(v)))
    got = stats.semantic_vs_naive(area, "discount_tax", "discount", ["domain"])
    return got.select("domain", *r6("naive_auroc", "semantic_auroc", "improvement"), F.round("improvement_pct", 4).alias("improvement_pct"), "supported")


@query("results_summary", f"""WITH {_AUC}, {_CHI[5:]}, {_PEARSON}, a AS (SELECT count(*) AS n, corr(rarity, y) AS r FROM v_rare)
    SELECT 'ablation_study' AS part, model || '/' || domain AS name, round(auroc, 5) AS value FROM auc
    UNION ALL SELECT 'domain_stats', domain, round(avg(y), 5) FROM v_tilted GROUP BY domain
    UNION ALL SELECT 'domain_comparison', 'chi_square', round(chi_square, 4) FROM chi
    UNION ALL SELECT 'top_correlated_features', feature, round(r, 5) FROM pt
    UNION ALL SELECT 'knowledge_overshadowing', 'r', round(r, 5) FROM a""", ("v_all_scored", "v_tilted", "v_long", "v_rare"))
def results_summary(v):
    from riskloom.plans.pipeline import summary_document

    tests = stats.correlation_test(v.features, COLS, "y")
    document = summary_document(metrics.metrics_bundle(all_scored(v)), stats.domain_rates(tilted(v), "y"),
                                stats.chi_square(tilted(v), "y"), tests, stats.rarity_trend(rare(v), "y"))
    read = document.select(
        F.from_json(F.get_json_object("document", "$.ablation_study"), "array<struct<model:string,domain:string,auroc:double>>").alias("a"),
        F.from_json(F.get_json_object("document", "$.domain_stats"), "array<struct<domain:string,rate:double>>").alias("d"),
        F.from_json(F.get_json_object("document", "$.domain_comparison"), "array<struct<chi_square:double>>").alias("c"),
        F.from_json(F.get_json_object("document", "$.top_correlated_features"), "array<struct<feature:string,pearson_r:double>>").alias("t"),
        F.from_json(F.get_json_object("document", "$.knowledge_overshadowing"), "array<struct<r:double>>").alias("k"))

    def part(title, field, name, value, digits=5):
        return F.transform(F.col(field), lambda x: F.struct(F.lit(title).alias("part"), name(x).alias("name"), F.round(value(x), digits).alias("value")))

    rows = F.concat(
        part("ablation_study", "a", lambda x: F.concat_ws("/", x["model"], x["domain"]), lambda x: x["auroc"]),
        part("domain_stats", "d", lambda x: x["domain"], lambda x: x["rate"]),
        part("domain_comparison", "c", lambda x: F.lit("chi_square"), lambda x: x["chi_square"], 4),
        part("top_correlated_features", "t", lambda x: x["feature"], lambda x: x["pearson_r"]),
        part("knowledge_overshadowing", "k", lambda x: F.lit("r"), lambda x: x["r"]))
    return read.select(F.explode(rows).alias("_r")).select("_r.*")

"""Uncertainty features (survey 2.7), context, matrix and selection (2.8)."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskloom import config as cfg
from riskloom.functions import features as X
from riskloom.functions import logprobs as LP
from riskloom.functions import text as tx
from riskloom.operators import clustering, context, matrix, selection
from riskloom.operators import tokens as TK
from riskloom.operators import uncertainty as U
from riskloom.plans.eval_queries import r6
from riskloom.plans.label_queries import labelled
from riskloom.plans.registry import query
from riskloom.plans.views import VIEW_SQL
from riskloom.session import fresh_path
from riskloom.sources import readers as R

_SUFFIX = "+ 1e-10::DOUBLE"

VIEW_SQL["v_tok"] = (("v_logprobs",), """
    SELECT prompt_id, count(*) AS n, avg(logprob) AS mean, min(logprob) AS lo, max(logprob) AS hi, stddev_pop(logprob) AS sd,
      max(logprob) + ln(sum(exp(logprob))) - max(logprob) AS mass FROM v_logprobs GROUP BY 1""")
VIEW_SQL["v_letters"] = (("v_mcq_letters",), f"""
    WITH c AS (SELECT prompt_id, letter, count(*) AS m FROM v_mcq_letters GROUP BY 1, 2),
    t AS (SELECT prompt_id, sum(m) AS total, coalesce(sum(m) FILTER (WHERE letter IS NOT NULL), 0) AS parsed FROM c GROUP BY 1)
    SELECT c.prompt_id, CASE WHEN any_value(parsed) > 0 THEN max(m) FILTER (WHERE letter IS NOT NULL) / any_value(parsed) ELSE 0.0 END AS consistency,
      CAST(count(letter) AS INTEGER) AS uniq, any_value(parsed) / any_value(total) AS ratio,
      CAST(coalesce(max(m) FILTER (WHERE letter IS NOT NULL), 0) AS BIGINT) AS mode,
      CASE WHEN any_value(parsed) > 0 THEN sum(-(m / parsed) * log2(m / parsed {_SUFFIX})) FILTER (WHERE letter IS NOT NULL) ELSE 2.0 END AS bits
    FROM c JOIN t USING (prompt_id) GROUP BY 1""")
# the stored vectors are far apart, so a prompt's clusters are its distinct vectors
VIEW_SQL["v_clusters"] = (("v_vectors",), """
    SELECT prompt_id, CASE WHEN sample_id <= prompt_id % 5 THEN 0 ELSE prompt_id % 5 + 1 END AS cluster_id, sample_id FROM v_vectors""")


def _entropy_sql(source):
    return f"""s AS (SELECT prompt_id, cluster_id, count(*) AS c FROM {source} GROUP BY 1, 2),
    n AS (SELECT prompt_id, sum(c) AS n FROM s GROUP BY 1),
    ent AS (SELECT prompt_id, CASE WHEN count(*) = 1 THEN 0.0::DOUBLE ELSE sum(-(c / n) * log2(c / n {_SUFFIX})) END AS bits,
      CAST(any_value(n) AS BIGINT) AS num_samples, count(*) AS k, any_value(n) / count(*) AS avg_size, CAST(max(c) AS BIGINT) AS max_size
    FROM s JOIN n USING (prompt_id) GROUP BY 1)"""


# --- 2.7 ---------------------------------------------------------------------

@query("pairs_within_prompt", """SELECT a.prompt_id, a.sample_id, count(*) FILTER (WHERE b.sample_id < a.sample_id) AS partners_before,
      count(*) FILTER (WHERE b.sample_id > a.sample_id) AS partners_after, CAST(count(*) * (count(*) - 1) / 2 AS BIGINT) AS prompt_pairs
    FROM v_samples a JOIN v_samples b USING (prompt_id) GROUP BY 1, 2""", ("v_samples",))
def pairs_within_prompt(v):
    return U.partner_counts(v.samples.select("prompt_id", "sample_id"))


def _pair_sql():
    from riskloom.plans.label_queries import _overlap, _terms

    return f"""WITH t AS (SELECT prompt_id, sample_id, {_terms('text')} AS w FROM v_samples)
    SELECT a.prompt_id, max(n.n) AS n_samples, round(avg((({_overlap('a.w', 'b.w')}) + ({_overlap('b.w', 'a.w')})) / 2), 6) AS mean_similarity
    FROM t a JOIN t b ON a.prompt_id = b.prompt_id AND a.sample_id < b.sample_id
    JOIN (SELECT prompt_id, count(*) AS n FROM v_samples GROUP BY 1) n ON n.prompt_id = a.prompt_id GROUP BY 1
    UNION ALL SELECT prompt_id, 1, NULL FROM v_samples GROUP BY 1 HAVING count(*) = 1"""


@query("pair_similarity", _pair_sql(), ("v_samples",))
def pair_similarity(v):
    st = v.samples.select("prompt_id", "sample_id", tx.terms(F.col("text")).alias("terms"))
    return U.term_pair_similarity(st).select("prompt_id", "n_samples", *r6("mean_similarity"))


@query("pair_similarity_vectors", """SELECT a.label AS prompt_id, any_value(n.n) AS n_samples, round(avg(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 6) AS mean_similarity
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id
    JOIN (SELECT label, count(*) AS n FROM embeddings GROUP BY 1) n ON n.label = a.label GROUP BY 1""")
def pair_similarity_vectors(v):
    e = v.table("embeddings").select(F.col("label").alias("prompt_id"), F.col("embedding").alias("vector"))
    return U.vector_pair_similarity(e).select("prompt_id", "n_samples", *r6("mean_similarity"))


@query("cluster_samples", "SELECT prompt_id, sample_id, cluster_id FROM v_clusters", ("v_clusters",))
def cluster_samples(v):
    return clustering.cluster_samples(v.vectors)


VIEW_SQL["v_merging"] = ((), """
    SELECT a.vec_id AS prompt_id, CAST(a.embedding AS DOUBLE[]) AS e, CAST(b.embedding AS DOUBLE[]) AS f
    FROM embeddings a JOIN embeddings b ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings)""")
_MERGED_SQL = """WITH mixed AS (SELECT prompt_id, e, f, list_transform(range(1, len(e) + 1), lambda i: e[i] + 0.1::DOUBLE * f[i]) AS em,
      list_transform(range(1, len(e) + 1), lambda i: f[i] + 0.1::DOUBLE * e[i]) AS fm FROM v_merging),
    across AS (SELECT prompt_id, (list_cosine_similarity(e, f) * 4 + list_cosine_similarity(e, fm) * 2 + list_cosine_similarity(em, f) * 2
      + list_cosine_similarity(em, fm)) / 9 AS sim FROM mixed)
    SELECT prompt_id, s::BIGINT AS sample_id, CASE WHEN s < 3 OR sim >= 0.7 THEN 0 ELSE 3 END::BIGINT AS cluster_id
    FROM across, (SELECT unnest(range(6)) AS s)"""


def merging_vectors(v):
    """Six samples a vector: it, its double and it with a tenth of its successor; then the same of the successor."""
    n = v.table("embeddings").agg(F.count("*")).scalar()
    e = v.table("embeddings").select(F.col("vec_id").alias("prompt_id"), F.col("embedding").cast("array<double>").alias("e"))
    nxt = e.select(F.col("prompt_id").alias("next_id"), F.col("e").alias("f"))
    both = e.withColumn("next_id", (F.col("prompt_id") + 1) % n).join(nxt, "next_id")

    def three(a, b, first):
        mixed = F.zip_with(a, b, lambda x, y: x + y * 0.1)
        return [F.struct(F.lit(first + i).cast("bigint").alias("sample_id"), x.alias("vector"))
                for i, x in enumerate([F.col(a), F.transform(a, lambda x: x * 2), mixed])]

    rows = F.explode(F.array(*three("e", "f", 0), *three("f", "e", 3)))
    return both.select("prompt_id", rows.alias("_s")).select("prompt_id", "_s.*")


@query("cluster_samples_merged", _MERGED_SQL, ("v_merging",))
def cluster_samples_merged(v):
    return clustering.cluster_samples(merging_vectors(v))


@query("cluster_samples_merged_rounds", _MERGED_SQL, ("v_merging",))
def cluster_samples_merged_rounds(v):
    """Every prompt through the distributed rounds."""
    return clustering.cluster_samples(merging_vectors(v), local_limit=0)


@query("cluster_entropy", f"""WITH {_entropy_sql('(SELECT label AS prompt_id, vec_id % 7 AS cluster_id FROM embeddings)')}
    SELECT prompt_id, round(bits, 6) AS semantic_entropy, num_samples, k AS num_semantic_clusters FROM ent""")
def cluster_entropy(v):
    c = v.table("embeddings").select(F.col("label").alias("prompt_id"), (F.col("vec_id") % 7).alias("cluster_id"))
    return U.cluster_entropy(c).select("prompt_id", *r6("semantic_entropy"), "num_samples", "num_semantic_clusters")


@query("semantic_entropy", f"""WITH {_entropy_sql('v_clusters')} SELECT prompt_id, round(bits, 6) AS semantic_entropy, num_samples,
      k AS num_semantic_clusters, round(avg_size, 6) AS avg_cluster_size, max_size AS max_cluster_size FROM ent""", ("v_clusters",))
def semantic_entropy(v):
    return U.cluster_entropy(clustering.cluster_weights(v.vectors)).select(
        "prompt_id", *r6("semantic_entropy"), "num_samples", "num_semantic_clusters", *r6("avg_cluster_size"), "max_cluster_size")


def token_arrays(v):
    """event_id, tokens, top: arrays per event, some given as top lists, some with gaps."""
    lp = -F.col("value") / 100
    return v.table("events").select(
        "event_id",
        F.when(F.col("event_id") % 3 != 0, F.array(lp, F.lit(float("nan")), lp * 2, F.lit(None).cast("double"))).alias("tokens"),
        F.array(F.create_map(F.lit("a"), lp, F.lit("b"), lp - 1), F.create_map(F.lit("c"), lp * 3, F.lit("d"), lp / 2)).alias("top"))


_TOKS = """t AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN [-value / 100, -value / 100 * 2]
      ELSE [greatest(-value / 100, -value / 100 - 1), greatest(-value / 100 * 3, -value / 100 / 2)] END AS a FROM events)"""


@query("logprob_normalize", f"""WITH {_TOKS} SELECT event_id, CAST(len(a) AS INTEGER) AS n, round(a[1], 6) AS first, round(a[2], 6) AS second,
      round(-(list_max(a) + ln(list_sum(list_transform(a, lambda x: exp(x - list_max(a)))))), 6) AS energy FROM t""")
def logprob_normalize(v):
    got = token_arrays(v).select("event_id", LP.token_logprobs(F.col("tokens"), F.col("top")).alias("a"))
    return got.select("event_id", F.size("a").alias("n"), F.round(F.element_at("a", 1), 6).alias("first"),
                      F.round(F.element_at("a", 2), 6).alias("second"), F.round(LP.energy(F.col("a")), 6).alias("energy"))


@query("sample_tokens", """WITH t AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN [-value / 100, NULL, -value / 100 * 2]
      ELSE [greatest(-value / 100, -value / 100 - 1), greatest(-value / 100 * 3, -value / 100 / 2)] END AS a FROM events),
    u AS (SELECT event_id, unnest(a) AS logprob, generate_subscripts(a, 1) - 1 AS pos FROM t)
    SELECT event_id, CAST(pos AS INTEGER) AS pos, round(logprob, 6) AS logprob FROM u WHERE logprob IS NOT NULL""")
def sample_tokens(v):
    """Stored samples, written and read with the samples' schema, to one row a token."""
    stored = token_arrays(v).select(F.col("event_id").cast("string").alias("prompt_id"), F.col("tokens").alias("logprobs"), F.col("top").alias("top_logprobs"))
    path = fresh_path(v.spark, "samples")
    stored.write.parquet(path)
    tokens = TK.token_table(R.scan_samples(v.spark, path), ["prompt_id"])
    return tokens.select(F.col("prompt_id").cast("bigint").alias("event_id"), "pos", *r6("logprob"))


def _entropy_of(p, q):
    m = f"({p} + {q})"
    return f"""CASE WHEN {m} > 1 THEN -({p} / {m} * ln({p} / {m}) + {q} / {m} * ln({q} / {m}))
      WHEN {m} < 1 THEN -({p} * ln({p}) + {q} * ln({q}) + (1 - {m}) * ln(1 - {m})) ELSE -({p} * ln({p}) + {q} * ln({q})) END"""


@query("top_k_entropy_lists", f"""WITH t AS (SELECT event_id, exp(-value / 100) AS a, exp(-value / 100 - 1) AS b, exp(-value / 100 * 3) AS c, exp(-value / 100 / 2) AS d FROM events)
    SELECT event_id, round(({_entropy_of('a', 'b')} + {_entropy_of('c', 'd')}) / 2, 6) AS top_k_entropy FROM t""")
def top_k_entropy_lists(v):
    top = TK.top_table(token_arrays(v), ["event_id"], top="top")
    return TK.top_k_entropy(top, "event_id").select("event_id", *r6("top_k_entropy"))


@query("semantic_energy", """SELECT prompt_id, round(-mass, 6) AS by_logsumexp, round(-mean, 6) AS by_mean, round(-lo, 6) AS by_min FROM v_tok""", ("v_tok",))
def semantic_energy(v):
    return U.token_stats(v.logprobs).select("prompt_id", *[
        F.round(U.semantic_energy(m), 6).alias(f"by_{m}") for m in ("logsumexp", "mean", "min")])


@query("logprob_stats", """SELECT prompt_id, n AS n_tokens, round(mean, 6) AS mean_logprob, round(lo, 6) AS min_logprob, round(hi, 6) AS max_logprob,
      round(sd, 6) AS std_logprob FROM v_tok""", ("v_tok",))
def logprob_stats(v):
    return U.token_stats(v.logprobs).select("prompt_id", "n_tokens", *r6("mean_logprob", "min_logprob", "max_logprob", "std_logprob"))


@query("max_prob", "SELECT prompt_id, round(exp(hi), 6) AS naive_max_prob FROM v_tok", ("v_tok",))
def max_prob(v):
    return U.token_features(v.logprobs).select("prompt_id", *r6("naive_max_prob"))


@query("perplexity", "SELECT prompt_id, round(exp(-mean), 6) AS naive_perplexity FROM v_tok", ("v_tok",))
def perplexity(v):
    return U.token_features(v.logprobs).select("prompt_id", *r6("naive_perplexity"))


@query("top_k_entropy", "SELECT prompt_id, 0.0::DOUBLE AS naive_top_k_entropy FROM v_tok", ("v_tok",))
def top_k_entropy(v):
    return U.token_features(v.logprobs).select("prompt_id", "naive_top_k_entropy")


@query("mcq_letter_consistency", """SELECT prompt_id, round(consistency, 6) AS mcq_letter_consistency, uniq AS mcq_num_unique_letters,
      round(ratio, 6) AS mcq_parseable_ratio, mode AS mcq_mode_letter_count FROM v_letters""", ("v_letters",))
def mcq_letter_consistency(v):
    return U.letter_features(v.mcq).select("prompt_id", *r6("mcq_letter_consistency"), "mcq_num_unique_letters",
                                           *r6("mcq_parseable_ratio"), "mcq_mode_letter_count")


@query("mcq_letter_entropy", "SELECT prompt_id, round(bits, 6) AS mcq_letter_entropy FROM v_letters", ("v_letters",))
def mcq_letter_entropy(v):
    return U.letter_features(v.mcq).select("prompt_id", *r6("mcq_letter_entropy"))


@query("mcq_first_token", """SELECT prompt_id, round(logprob, 6) AS mcq_first_token_logprob, round(exp(logprob), 6) AS mcq_first_token_prob
    FROM v_logprobs WHERE pos = 0""", ("v_logprobs",))
def mcq_first_token(v):
    return U.first_token(v.logprobs).select("prompt_id", *r6("mcq_first_token_logprob", "mcq_first_token_prob"))


_EPI = f"""{_entropy_sql('(SELECT prompt_id, vec_id AS cluster_id FROM v_sample_vectors)')},
    epi AS (SELECT p.prompt_id, round(bits, 6) AS semantic_entropy, k AS num_semantic_clusters, round(avg_size, 6) AS avg_cluster_size,
      round(-mass, 6) AS semantic_energy, round(mean, 6) AS mean_logprob, round(lo, 6) AS min_logprob, round(sd, 6) AS std_logprob,
      round(exp(hi), 6) AS naive_max_prob, round(exp(-mean), 6) AS naive_perplexity, CASE WHEN mean IS NOT NULL THEN 0.0::DOUBLE END AS naive_top_k_entropy
    FROM v_prompts p LEFT JOIN ent ON ent.prompt_id = p.prompt_id LEFT JOIN v_tok t ON t.prompt_id = p.prompt_id)"""
_EPI_DOUBLES = [c for c in cfg.EPISTEMIC_COLUMNS if c != "num_semantic_clusters"]


def epistemic(v, mcq=False):
    entropy = U.cluster_entropy(clustering.cluster_weights(v.sample_vectors))
    letters = U.letter_features(v.mcq) if mcq else None
    first = U.first_token(v.logprobs) if mcq else None
    return U.epistemic_features(v.prompts, entropy, v.logprobs, letters, first)


def _rounded(df, doubles):
    return df.select(*[F.round(c, 6).alias(c) if c in doubles else F.col(c) for c in df.columns])


@query("epistemic_features", f"""WITH {_EPI} SELECT epi.*, round(consistency, 6) AS mcq_letter_consistency, uniq AS mcq_num_unique_letters,
      round(ratio, 6) AS mcq_parseable_ratio, mode AS mcq_mode_letter_count, round(l.bits, 6) AS mcq_letter_entropy,
      round(logprob, 6) AS mcq_first_token_logprob, round(exp(logprob), 6) AS mcq_first_token_prob
    FROM epi LEFT JOIN v_letters l USING (prompt_id) LEFT JOIN v_logprobs f ON f.prompt_id = epi.prompt_id AND f.pos = 0""",
       ("v_prompts", "v_sample_vectors", "v_tok", "v_letters"))
def epistemic_features(v):
    return _rounded(epistemic(v, mcq=True), _EPI_DOUBLES + [
        "mcq_letter_consistency", "mcq_parseable_ratio", "mcq_letter_entropy", "mcq_first_token_logprob", "mcq_first_token_prob"])


# --- 2.8 ---------------------------------------------------------------------

VIEW_SQL["v_found"] = (("v_entity", "v_gazetteer"), """
    SELECT e.prompt, g.text_normalized, g.label, 1 AS n FROM v_entity e
    JOIN v_gazetteer g ON contains(' ' || lower(e.prompt) || ' ', ' ' || g.text_normalized || ' ')""")
_FREQ = f"""CASE WHEN text_normalized IN ({', '.join(f"'{w}'" for w in cfg.COMMON_ENTITIES)}) THEN 0.8
      WHEN length(text_normalized) <= 5 THEN 0.6 WHEN length(text_normalized) <= 10 THEN 0.4 ELSE 0.2 END::DOUBLE"""
VIEW_SQL["v_rarity"] = (("v_found",), f"""
    SELECT prompt, avg(-ln(f + 1)) AS mean, max(-ln(f + 1)) AS hi, min(-ln(f + 1)) AS lo, count(*) AS num_entities,
      count(*) FILTER (WHERE f < 0.25) AS num_rare_entities,
      {', '.join(f"CAST(max(CAST(label = '{t}' AS INTEGER)) AS INTEGER) AS entity_type_{t}" for t in cfg.ENTITY_TYPES)}
    FROM (SELECT *, {_FREQ} AS f FROM v_found) GROUP BY 1""")


def found(v):
    keyed = v.entity_prompts.select(F.col("prompt").alias("key"), "prompt")
    return context.extract_entities(keyed, v.gazetteer, key="key").withColumnRenamed("key", "prompt")


@query("extract_entities", "SELECT prompt, text_normalized, label FROM v_found", ("v_found",))
def extract_entities(v):
    return found(v).select("prompt", "text_normalized", "label")


@query("entity_frequency", f"SELECT text_normalized, label, {_FREQ} AS frequency FROM v_gazetteer", ("v_gazetteer",))
def entity_frequency(v):
    return v.gazetteer.select("text_normalized", "label", X.entity_frequency(F.col("text_normalized")).alias("frequency"))


@query("entity_rarity", """SELECT prompt, round(mean, 6) AS avg_entity_rarity, round(hi, 6) AS max_entity_rarity, round(lo, 6) AS min_entity_rarity,
      num_entities, num_rare_entities FROM v_rarity""", ("v_rarity",))
def entity_rarity(v):
    return context.entity_rarity(found(v), "prompt").select(
        "prompt", *r6("avg_entity_rarity", "max_entity_rarity", "min_entity_rarity"), "num_entities", "num_rare_entities")


@query("entity_type_flags", f"SELECT prompt, {', '.join(f'entity_type_{t}' for t in cfg.ENTITY_TYPES)} FROM v_rarity", ("v_rarity",))
def entity_type_flags(v):
    return context.entity_rarity(found(v), "prompt").select("prompt", *[f"entity_type_{t}" for t in cfg.ENTITY_TYPES])


@query("entity_filter", "SELECT label, count(*) AS n FROM v_found GROUP BY 1", ("v_found",))
def entity_filter(v):
    kept = context.entity_rarity(found(v), "prompt").filter(F.col("num_entities") > 0)
    return found(v).join(kept.select("prompt"), "prompt", "left_semi").groupBy("label").agg(F.count("*").alias("n"))


_LEX = r"""lex AS (SELECT key, text, regexp_extract_all(text, '[\p{L}\p{N}]+') AS t FROM lexsrc)"""
_LEXCOLS = """CAST(len(t) AS INTEGER) AS token_count, round(CASE WHEN len(t) > 0 THEN len(list_distinct(list_transform(t, lambda x: lower(x)))) / len(t) ELSE 0 END, 6) AS unique_token_ratio,
      round(CASE WHEN len(t) > 0 THEN length(array_to_string(t, '')) / len(t) ELSE 0 END, 6) AS avg_word_length"""


@query("lexical_features", f"""WITH lexsrc AS (SELECT doc_id AS key, text FROM documents), {_LEX} SELECT key AS doc_id, {_LEXCOLS},
      round(CASE WHEN len(t) > 0 THEN len(list_distinct(list_transform(t, lambda x: lower(x)))) / len(t) ELSE 0 END, 6) AS lexical_diversity FROM lex""")
def lexical_features(v):
    d = v.table("documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    cols = X.lexical(F.col("t"))
    return d.select("doc_id", *[(F.round(c, 6) if n != "token_count" else c).alias(n) for n, c in cols.items()])


def _qword(e):
    spots = ", ".join(f"{{'at': CASE WHEN instr(lower({e}), '{w}') > 0 THEN instr(lower({e}), '{w}') ELSE 2147483647 END, 'rank': {i}, 'word': '{w}'}}"
                      for i, w in enumerate(cfg.QUESTION_WORDS))
    return f"list_sort([{spots}])[1]"


@query("question_type", f"""SELECT doc_id, CASE WHEN q.at < 2147483647 THEN q.word ELSE 'other' END AS question_type
    FROM (SELECT doc_id, {_qword('text')} AS q FROM documents)""")
def question_type(v):
    return v.table("documents").select("doc_id", X.question_word(F.col("text")).alias("question_type"))


def word_entities(v):
    return context.extract_entities(v.prompts.select("prompt_id", "prompt"), v.word_gazetteer)


_PUNCT_SQL = tx.PUNCT.replace("'", "''")
VIEW_SQL["v_ctx"] = (("v_prompts", "v_word_gazetteer"), f"""
    WITH toks AS (SELECT prompt_id, unnest(list_transform(list_filter(regexp_split_to_array(lower(prompt), '{tx.SPACE}+'), lambda x: x <> ''),
        lambda x: regexp_replace(x, '^{_PUNCT_SQL}+|{_PUNCT_SQL}+$', '', 'g'))) AS text_normalized FROM v_prompts),
    hit AS (SELECT prompt_id, label, {_FREQ} AS f FROM toks JOIN v_word_gazetteer USING (text_normalized)),
    rar AS (SELECT prompt_id, avg(-ln(f + 1)) AS mean, max(-ln(f + 1)) AS hi, min(-ln(f + 1)) AS lo, count(*) AS num_entities,
      count(*) FILTER (WHERE f < 0.25) AS num_rare_entities,
      {', '.join(f"CAST(max(CAST(label = '{t}' AS INTEGER)) AS INTEGER) AS entity_type_{t}" for t in cfg.ENTITY_TYPES)} FROM hit GROUP BY 1),
    lexsrc AS (SELECT prompt_id AS key, prompt AS text FROM v_prompts), {_LEX},
    q AS (SELECT prompt_id, CASE WHEN s.at < 2147483647 THEN s.word ELSE 'other' END AS word FROM (SELECT prompt_id, {_qword('prompt')} AS s FROM v_prompts))
    SELECT p.prompt_id, round(coalesce(mean, 0), 6) AS avg_entity_rarity, round(coalesce(hi, 0), 6) AS max_entity_rarity,
      round(coalesce(lo, 0), 6) AS min_entity_rarity, coalesce(num_entities, 0) AS num_entities, coalesce(num_rare_entities, 0) AS num_rare_entities,
      {', '.join(f"coalesce(entity_type_{t}, 0) AS entity_type_{t}" for t in cfg.ENTITY_TYPES)},
      l.* EXCLUDE (key), l.unique_token_ratio AS lexical_diversity,
      {', '.join(f"CAST(q.word = '{w}' AS INTEGER) AS qtype_{w}" for w in cfg.QUESTION_WORDS + ['other'])}
    FROM v_prompts p LEFT JOIN rar USING (prompt_id) JOIN (SELECT key, {_LEXCOLS} FROM lex) l ON l.key = p.prompt_id JOIN q USING (prompt_id)""")
_CTX_DOUBLES = ["avg_entity_rarity", "max_entity_rarity", "min_entity_rarity", "unique_token_ratio", "avg_word_length", "lexical_diversity"]


def contextual(v):
    return context.contextual_features(v.prompts.select("prompt_id", "prompt"), word_entities(v))


@query("contextual_features", "SELECT * FROM v_ctx", ("v_ctx",))
def contextual_features(v):
    return _rounded(contextual(v), _CTX_DOUBLES)


VIEW_SQL["v_domain_names"] = ((), """
    SELECT c_custkey, CASE c_custkey % 7 WHEN 0 THEN 'Medicine' WHEN 1 THEN 'math word problems' WHEN 2 THEN 'FINANCE' WHEN 3 THEN 'IS' WHEN 4 THEN 'Psychology'
      WHEN 5 THEN 'Logistics' ELSE c_mktsegment END AS domain FROM customer""")


def _domain_case(e):
    return "CASE " + " ".join(f"WHEN contains(lower({e}), '{d.lower()}') THEN '{d}'" for d in cfg.DOMAINS) + " END"


@query("domain_encode", f"""SELECT c_custkey, {', '.join(f"CAST(coalesce({_domain_case('domain')} = '{d}', false) AS INTEGER) AS domain_{d}" for d in cfg.DOMAINS)},
      CAST(coalesce(list_position({cfg.DOMAINS!r}, domain), 0) - 1 AS INTEGER) AS domain_label FROM v_domain_names""", ("v_domain_names",))
def domain_encode(v):
    k = F.col("c_custkey") % 7
    name = F.col("c_mktsegment")
    for i, d in enumerate(["Medicine", "math word problems", "FINANCE", "IS", "Psychology", "Logistics"]):
        name = F.when(k == i, d).otherwise(name)
    df = v.table("customer").select("c_custkey", name.alias("domain"))
    return matrix.encode_domain(matrix.encode_domain(df), "label").drop("domain")


def full_matrix(v):
    return matrix.feature_matrix(labelled(v), epistemic(v), contextual(v))


def _matrix_sql():
    from riskloom.plans.label_queries import _LABELS

    return f"""WITH {_EPI}, {_LABELS}
    SELECT m.prompt_id, m.domain, m.hallucination_label, epi.* EXCLUDE (prompt_id), v_ctx.* EXCLUDE (prompt_id),
      {', '.join(f"CAST(m.domain = '{d}' AS INTEGER) AS domain_{d}" for d in cfg.DOMAINS)}
    FROM rows_ m JOIN epi USING (prompt_id) JOIN v_ctx USING (prompt_id)"""


@query("feature_matrix", _matrix_sql(), ("v_prompts", "v_sample_vectors", "v_tok", "v_ctx", "v_pairs", "v_options"))
def feature_matrix(v):
    return _rounded(full_matrix(v), _EPI_DOUBLES + _CTX_DOUBLES).drop("ground_truth", "primary_response")


COLS = ["f_chars", "f_unique", "f_gap", "f_none"]


def _impute_sql(fill):
    return f"""SELECT doc_id, {', '.join(f'round(coalesce({c}, {fill(c)}), 6) AS {c}' for c in COLS)} FROM v_features"""


def _filled(v, method):
    return _rounded(matrix.impute(v.features.select("doc_id", *COLS), COLS, method), COLS)


@query("impute_mean", _impute_sql(lambda c: f"(SELECT avg({c}) FROM v_features)"), ("v_features",))
def impute_mean(v):
    return _filled(v, "mean")


@query("impute_median", _impute_sql(lambda c: f"(SELECT median({c}) FROM v_features)"), ("v_features",))
def impute_median(v):
    return _filled(v, "median")


@query("impute_zero", _impute_sql(lambda c: "0"), ("v_features",))
def impute_zero(v):
    return _filled(v, "zero")


@query("drop_missing", "SELECT doc_id, round(f_chars, 6) AS f_chars, round(f_gap, 6) AS f_gap FROM v_features WHERE f_gap IS NOT NULL", ("v_features",))
def drop_missing(v):
    return _rounded(matrix.impute(v.features.select("doc_id", "f_chars", "f_gap"), ["f_chars", "f_gap"], "drop"), COLS)


@query("impute_residual", _impute_sql(lambda c: f"coalesce((SELECT median({c}) FROM v_features), 0)"), ("v_features",))
def impute_residual(v):
    return _rounded(matrix.impute_residual(v.features.select("doc_id", *COLS), COLS), COLS)


_ALL = ["f_chars", "f_words", "f_unique", "f_digits", "f_punct", "f_flat", "f_none"]


@query("variance_filter", " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(var_pop({c}), 6) AS variance, coalesce(var_pop({c}) > 0, false) AS kept FROM v_features" for c in _ALL), ("v_features",))
def variance_filter(v):
    return selection.variances(v.features, _ALL).select("feature", *r6("variance"), "kept")


_PLACE = "CAST(row_number() OVER (ORDER BY score DESC, feature) AS INTEGER) AS place, row_number() OVER (ORDER BY score DESC, feature) <= 3 AS selected"


def _scored(v, method):
    got = selection.score_features(v.features, _ALL, "y", method, k_best=3)
    return got.select("feature", F.round("score", 6).alias("score"), "place", "selected")


@query("feature_select", f"""WITH r AS (SELECT *, floor(10 * (rank() OVER (PARTITION BY feature ORDER BY x) - 1) / count(*) OVER (PARTITION BY feature)) AS bin FROM v_long),
    t AS (SELECT feature, bin, count(*) AS n, sum(y) AS pos FROM r GROUP BY 1, 2),
    g AS (SELECT feature, sum(n) AS total, sum(pos) AS tpos FROM t GROUP BY 1),
    s AS (SELECT feature, greatest(sum(CASE WHEN pos > 0 THEN pos / total * ln(pos * total / (n * tpos)) ELSE 0 END
        + CASE WHEN n > pos THEN (n - pos) / total * ln((n - pos) * total / (n * (total - tpos))) ELSE 0 END), 0) AS score FROM t JOIN g USING (feature) GROUP BY 1)
    SELECT feature, round(score, 6) AS score, {_PLACE} FROM s""", ("v_long",))
def feature_select(v):
    return _scored(v, "mutual_info")


@query("feature_select_f", f"""WITH a AS (SELECT feature, count(*) AS n, avg(x) AS m, sum(CASE WHEN y = 1 THEN 1 ELSE 0 END) AS n1, avg(x) FILTER (WHERE y = 1) AS m1, avg(x) FILTER (WHERE y = 0) AS m0,
      var_pop(x) FILTER (WHERE y = 1) AS v1, var_pop(x) FILTER (WHERE y = 0) AS v0 FROM v_long GROUP BY 1),
    s AS (SELECT feature, (n1 * (m1 - m) ** 2 + (n - n1) * (m0 - m) ** 2) / ((n1 * v1 + (n - n1) * v0) / (n - 2)) AS score FROM a)
    SELECT feature, round(score, 6) AS score, {_PLACE} FROM s""", ("v_long",))
def feature_select_f(v):
    return _scored(v, "f_classif")


@query("feature_select_chi2", f"""WITH a AS (SELECT feature, sum(x) AS s, sum(x) FILTER (WHERE y = 1) AS s1, avg(y) AS q FROM v_long GROUP BY 1),
    s AS (SELECT feature, (s1 - s * q) ** 2 / (s * q) + ((s - s1) - s * (1 - q)) ** 2 / (s * (1 - q)) AS score FROM a)
    SELECT feature, round(score, 6) AS score, {_PLACE} FROM s""", ("v_long",))
def feature_select_chi2(v):
    return _scored(v, "chi2")


@query("class_weight", """SELECT count(*) FILTER (WHERE y = 0) AS negatives, count(*) FILTER (WHERE y = 1) AS positives,
      round(count(*) FILTER (WHERE y = 0) / count(*) FILTER (WHERE y = 1), 6) AS weight FROM v_features""", ("v_features",))
def class_weight(v):
    return selection.class_weight(v.features, "y").select("negatives", "positives", *r6("weight"))

"""Prompt, sample, token and score tables derived from the driver's tables.

``Views`` builds them with Spark; ``VIEW_SQL`` states the same definitions as
plain SQL for the checks.  All of them cover the whole tables.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskloom.config import DOMAINS
from riskloom.operators.ranking import positions


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    # --- prompts and samples ------------------------------------------------
    @cached_property
    def prompts(self) -> DataFrame:
        """prompt_id, conv_id, domain, prompt, ground_truth."""
        conv = self.table("conversations")
        bench = self.table("benchmark")
        first = (conv.filter(F.col("role") == "user").groupBy("conv_id")
                 .agg(F.min_by("text", "turn").alias("prompt")))
        n_items = bench.agg(F.count("*")).scalar()
        keyed = first.withColumn("item_id", F.col("conv_id") % n_items)
        truth = bench.select("item_id", F.col("text").alias("ground_truth"))
        names = F.array(*[F.lit(d) for d in DOMAINS])
        return keyed.join(truth, "item_id").select(
            F.concat(F.lit("conv_"), F.col("conv_id")).alias("prompt_id"), "conv_id",
            F.element_at(names, (F.col("conv_id") % 5 + 1).cast("int")).alias("domain"),
            "prompt", "ground_truth")

    @cached_property
    def samples(self) -> DataFrame:
        """prompt_id, conv_id, sample_id, text: assistant turns in order."""
        turns = self.table("conversations").filter(F.col("role") == "assistant")
        ranked = positions(turns, ["conv_id"], [F.col("turn")], "sample_id")
        return ranked.select(F.concat(F.lit("conv_"), F.col("conv_id")).alias("prompt_id"),
                             "conv_id", "sample_id", "text")

    @cached_property
    def logprobs(self) -> DataFrame:
        """prompt_id, pos, logprob: one row per token."""
        ranked = positions(self.table("events").select("user_id", "ts", "event_id", "value"), ["user_id"],
                           [F.col("ts"), F.col("event_id")], "pos")
        return ranked.select(F.concat(F.lit("conv_"), F.col("user_id")).alias("prompt_id"),
                             "pos", (-F.col("value") / 100).alias("logprob"))

    @cached_property
    def mcq(self) -> DataFrame:
        """prompt_id, event_id, text, correct_index: multiple-choice answers."""
        e = self.table("events")
        texts = ["B", "The answer is C", "(D) since the rest fail", "I think it is 3", "Answer: A"]
        pick = F.element_at(F.array(*[F.lit(t) for t in texts]), (F.col("event_id") % 5 + 1).cast("int"))
        return e.select(F.concat(F.lit("conv_"), F.col("user_id")).alias("prompt_id"), "event_id",
                        pick.alias("text"), (F.col("user_id") % 4).cast("int").alias("correct_index"),
                        (-F.col("value") / 100).alias("logprob"))

    @cached_property
    def numeric(self) -> DataFrame:
        """id, prompt, response, truth: money answers."""
        o = self.table("orders")
        money = F.col("o_totalprice").cast("decimal(18,2)")
        moved = (money + ((F.col("o_orderkey") % 3) * 5000).cast("decimal(18,2)")).cast("decimal(18,2)")
        truth = (F.when(F.col("o_orderkey") % 7 == 0, F.lit(None))
                 .when(F.col("o_orderkey") % 7 == 1, F.concat(moved.cast("string"), F.lit(" million")))
                 .otherwise(moved.cast("string")))
        ask = F.when(F.col("o_orderkey") % 5 == 0, F.lit("What was the total, in thousands?")) \
            .otherwise(F.lit("What was the total?"))
        unit = F.when(F.col("o_orderkey") % 5 == 0, F.lit(" thousand")).otherwise(F.lit(""))
        return o.select(F.col("o_orderkey").alias("id"), ask.alias("prompt"),
                        F.concat(F.lit("The total is $"), money.cast("string"), unit).alias("response"),
                        truth.alias("truth"), F.col("o_orderpriority").alias("domain"))

    @cached_property
    def options(self) -> DataFrame:
        """The prompts with option literals, option index and sometimes documents."""
        word = lambda i: F.element_at(F.split("ground_truth", " "), i)
        literal = F.concat(F.lit("{'1': '"), word(1), F.lit("', '0': \""), word(2),
                           F.lit("\", '2': 'none', 'correct answer': '"), word(1), F.lit("'}"))
        docs = (F.when(F.col("conv_id") % 3 == 0, F.lit(None)).when(F.col("conv_id") % 3 == 1, F.lit("  "))
                .otherwise(F.col("ground_truth")))
        return self.prompts.select("*", literal.alias("options"),
                                   (F.col("conv_id") % 4).cast("int").alias("correct_index"), docs.alias("documents"))

    # --- vectors ------------------------------------------------------------
    @cached_property
    def vectors(self) -> DataFrame:
        """prompt_id, sample_id, vector: five samples per stored vector.

        The first ``1 + id % 5`` samples copy it, the rest copy its successor.
        """
        e = self.table("embeddings").select("vec_id", "embedding")
        n = self.table("embeddings").agg(F.count("*")).scalar()
        other = e.select(F.col("vec_id").alias("next_id"), F.col("embedding").alias("next_vector"))
        pair = e.withColumn("next_id", (F.col("vec_id") + 1) % n).join(other, "next_id")
        return pair.select("vec_id", "embedding", "next_vector",
                           F.explode(F.sequence(F.lit(0), F.lit(4))).alias("sample_id")).select(
            F.col("vec_id").alias("prompt_id"), "sample_id",
            F.when(F.col("sample_id") <= F.col("vec_id") % 5, F.col("embedding"))
            .otherwise(F.col("next_vector")).alias("vector"))

    @cached_property
    def sample_vectors(self) -> DataFrame:
        """prompt_id, sample_id, vector for the conversation samples.

        Samples 2k and 2k+1 of a prompt share a vector.
        """
        e = self.table("embeddings").select("vec_id", F.col("embedding").alias("vector"))
        n = self.table("embeddings").agg(F.count("*")).scalar()
        keyed = self.samples.withColumn(
            "vec_id", (F.col("conv_id") * 3 + F.floor(F.col("sample_id") / 2)) % n)
        return keyed.join(e, "vec_id").select("prompt_id", "sample_id", "vector")

    # --- scored sets --------------------------------------------------------
    @cached_property
    def scored(self) -> DataFrame:
        d = self.table("documents").select("doc_id", "lang", "n_chars")
        lab = self.table("labels").select("doc_id", (1 - F.col("quality")).alias("y"))
        p = F.round(F.col("n_chars") / (F.col("n_chars") + 1500.0), 4)
        return d.join(lab, "doc_id").select(
            F.lit("length").alias("model"), F.col("lang").alias("domain"), F.col("doc_id").alias("id"),
            "y", p.alias("p")).withColumn("pred", (F.col("p") >= 0.5).cast("int"))

    @cached_property
    def scored_big(self) -> DataFrame:
        """Two models over every line item; many equal scores."""
        li = self.table("lineitem")
        models = F.array(
            F.struct(F.lit("discount_tax").alias("model"),
                     F.least(F.lit(1.0), F.round(F.col("l_discount") * 5 + F.col("l_tax") * 5, 4)).alias("p")),
            F.struct(F.lit("discount").alias("model"), F.round(F.col("l_discount") * 10, 4).alias("p")))
        y = (F.col("l_returnflag") == "R").cast("int")
        return (li.select(F.explode(models).alias("m"), y.alias("y"), F.col("l_linestatus").alias("domain"))
                .select("m.model", "domain", "y", "m.p")
                .withColumn("pred", (F.col("p") >= 0.5).cast("int")))

    # --- features -----------------------------------------------------------
    @cached_property
    def features(self) -> DataFrame:
        """doc_id, y, domain, source and numeric text features of labelled documents.

        ``f_gap`` has missing values, ``f_none`` is always missing, ``f_flat`` constant.
        """
        d = self.table("documents")
        lab = self.table("labels").select("doc_id", (1 - F.col("quality")).alias("y"))
        n = F.length("text").cast("double")
        toks = F.split(F.col("text"), " ")
        feats = d.select(
            "doc_id", F.col("lang").alias("domain"), "source",
            n.alias("f_chars"),
            F.size(toks).cast("double").alias("f_words"),
            (F.size(F.array_distinct(toks)) / F.size(toks)).alias("f_unique"),
            (F.length(F.regexp_replace("text", "[^0-9]", "")) / n).alias("f_digits"),
            (F.length(F.regexp_replace("text", "[^.,;:!?]", "")) / n).alias("f_punct"),
            F.when(F.col("doc_id") % 4 != 0, F.length("text").cast("double") / F.size(toks)).alias("f_gap"),
            F.lit(None).cast("double").alias("f_none"), F.lit(1.0).alias("f_flat"))
        return lab.join(feats, "doc_id")

    FEATURES = ["f_chars", "f_words", "f_unique", "f_digits", "f_punct"]

    # --- entities -----------------------------------------------------------
    @cached_property
    def entity_prompts(self) -> DataFrame:
        """prompt, n_rows: each distinct shipping question, how often it occurs,
        and how many of those rows were returned."""
        li = self.table("lineitem").select("l_partkey", "l_suppkey", "l_returnflag")
        part = self.table("part").select(F.col("p_partkey").alias("l_partkey"), "p_name")
        supp = self.table("supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name", "s_nationkey")
        nation = self.table("nation").select(F.col("n_nationkey").alias("s_nationkey"), "n_name", "n_regionkey")
        region = self.table("region").select(F.col("r_regionkey").alias("n_regionkey"), "r_name")
        # fold the fact table to key pairs first: fewer rows meet the dimensions
        pairs = li.groupBy("l_partkey", "l_suppkey").agg(
            F.count("*").alias("n_rows"), F.count_if(F.col("l_returnflag") == "R").alias("n_pos"))
        text = F.concat(F.lit("How much "), F.col("p_name"), F.lit(" does "), F.col("s_name"),
                        F.lit(" of "), F.col("n_name"), F.lit(" in "), F.col("r_name"), F.lit(" ship"))
        return (pairs.join(part, "l_partkey").join(supp, "l_suppkey")
                .join(nation, "s_nationkey").join(region, "n_regionkey")
                .groupBy(text.alias("prompt"))
                .agg(F.sum("n_rows").alias("n_rows"), F.sum("n_pos").alias("n_pos")))

    @cached_property
    def gazetteer(self) -> DataFrame:
        """text_normalized, label: every name in the dimension tables once."""
        def names(table: str, column: str, label: str) -> DataFrame:
            return self.table(table).select(F.trim(F.lower(F.col(column))).alias("text_normalized"),
                                            F.lit(label).alias("label"))

        return (names("nation", "n_name", "GPE").unionByName(names("region", "r_name", "LOC"))
                .unionByName(names("supplier", "s_name", "ORG"))
                .unionByName(names("part", "p_name", "PRODUCT")).distinct())

    @cached_property
    def word_gazetteer(self) -> DataFrame:
        """text_normalized, label: the opening word of every benchmark passage."""
        b = self.table("benchmark")
        first = F.lower(F.regexp_extract(F.col("text"), r"[\p{L}\p{N}]+", 0))
        kinds = F.array(*[F.lit(k) for k in ("PERSON", "ORG", "GPE", "LOC", "PRODUCT", "EVENT")])
        kind = F.element_at(kinds, (F.col("item_id") % 6 + 1).cast("int"))
        return (b.select(first.alias("text_normalized"), kind.alias("label"))
                .filter(F.col("text_normalized") != "")
                .groupBy("text_normalized").agg(F.min("label").alias("label")))

    # --- nested corpus ------------------------------------------------------
    CHUNK = 20

    @cached_property
    def order_places(self) -> DataFrame:
        """Orders with the document they belong to and their place in it.

        A document holds at most ``CHUNK`` orders of one customer, so no customer,
        however busy, becomes one row.
        """
        o = self.table("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority")
        ranked = positions(o, ["o_custkey"], [F.col("o_orderkey")], "place")
        return ranked.withColumn("doc", F.concat(
            F.lit("c"), F.col("o_custkey"), F.lit("_"), F.floor(F.col("place") / self.CHUNK)))

    @cached_property
    def nested(self) -> DataFrame:
        """One row per document: a table of cells, paragraphs and questions."""
        cell = F.col("o_orderkey").cast("string")
        row = F.struct("o_orderkey", F.array(cell, "o_orderstatus", "o_orderpriority").alias("cells"))
        para = F.struct("o_orderkey", (F.col("o_orderkey") % 3).cast("int").alias("order"),
                        F.concat(F.lit("Order "), cell, F.lit(" is "), F.col("o_orderstatus")).alias("text"))
        ask = F.struct("o_orderkey", F.concat(F.lit("Status of "), cell, F.lit("?")).alias("question"),
                       F.col("o_orderstatus").alias("answer"),
                       F.when(F.col("o_orderkey") % 2 == 0, "span").otherwise("arithmetic").alias("answer_type"))
        per = self.order_places.groupBy("doc").agg(
            F.sort_array(F.collect_list(row)).alias("rows"), F.sort_array(F.collect_list(para)).alias("paras"),
            F.sort_array(F.collect_list(ask)).alias("asks"))
        return per.select(
            "doc",
            F.struct(F.concat(F.lit("t_"), F.col("doc")).alias("uid"),
                     F.transform("rows", lambda r: r["cells"]).alias("table")).alias("table"),
            F.transform("paras", lambda x: F.struct(x["order"].alias("order"), x["text"].alias("text"))).alias("paragraphs"),
            F.transform("asks", lambda x: F.struct(x["question"].alias("question"), x["answer"].alias("answer"),
                                                   x["answer_type"].alias("answer_type"))).alias("questions"))


_DOMAIN_LIST = "['Medicine','Math','Finance','IS','Psychology']"
_MCQ_LIST = "['B','The answer is C','(D) since the rest fail','I think it is 3','Answer: A']"

# name -> (views it builds on, SQL)
VIEW_SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "v_prompts": ((), f"""
        SELECT 'conv_' || f.conv_id AS prompt_id, f.conv_id, {_DOMAIN_LIST}[f.conv_id % 5 + 1] AS domain,
               f.prompt, b.text AS ground_truth
        FROM (SELECT conv_id, arg_min(text, turn) AS prompt FROM conversations
              WHERE role = 'user' GROUP BY conv_id) f
        JOIN benchmark b ON b.item_id = f.conv_id % (SELECT count(*) FROM benchmark)"""),
    "v_samples": ((), """
        SELECT 'conv_' || conv_id AS prompt_id, conv_id,
               row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS sample_id, text
        FROM conversations WHERE role = 'assistant'"""),
    "v_logprobs": ((), """
        SELECT 'conv_' || user_id AS prompt_id,
               row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos,
               -value / 100 AS logprob FROM events"""),
    "v_mcq": ((), f"""
        SELECT 'conv_' || user_id AS prompt_id, event_id, {_MCQ_LIST}[event_id % 5 + 1] AS text,
               CAST(user_id % 4 AS INTEGER) AS correct_index, -value / 100 AS logprob FROM events"""),
    "v_mcq_letters": (("v_mcq",), """
        SELECT *, CASE WHEN text = 'I think it is 3' THEN NULL WHEN text = 'B' THEN 'B'
                       WHEN text LIKE 'The%' THEN 'C' WHEN text LIKE '(D)%' THEN 'D' ELSE 'A' END AS letter
        FROM v_mcq"""),
    "v_numeric": ((), """
        SELECT o_orderkey AS id,
               CASE WHEN o_orderkey % 5 = 0 THEN 'What was the total, in thousands?'
                    ELSE 'What was the total?' END AS prompt,
               'The total is $' || CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR)
                 || CASE WHEN o_orderkey % 5 = 0 THEN ' thousand' ELSE '' END AS response,
               CASE WHEN o_orderkey % 7 = 0 THEN NULL
                    ELSE CAST(CAST(CAST(o_totalprice AS DECIMAL(18,2))
                         + CAST((o_orderkey % 3) * 5000 AS DECIMAL(18,2)) AS DECIMAL(18,2)) AS VARCHAR)
                         || CASE WHEN o_orderkey % 7 = 1 THEN ' million' ELSE '' END END AS truth,
               o_orderpriority AS domain
        FROM orders"""),
    "v_vectors": ((), """
        SELECT a.vec_id AS prompt_id, s.sample_id,
               CASE WHEN s.sample_id <= a.vec_id % 5 THEN a.embedding ELSE b.embedding END AS vector
        FROM embeddings a JOIN embeddings b
          ON b.vec_id = (a.vec_id + 1) % (SELECT count(*) FROM embeddings),
          (SELECT unnest(range(5)) AS sample_id) s"""),
    "v_sample_vectors": (("v_samples",), """
        SELECT s.prompt_id, s.sample_id, e.vec_id, e.embedding AS vector FROM v_samples s
        JOIN embeddings e ON e.vec_id = (s.conv_id * 3 + s.sample_id // 2) % (SELECT count(*) FROM embeddings)"""),
    "v_places": ((), """
        SELECT *, 'c' || o_custkey || '_' || (place // 20) AS doc, o_orderkey % 3 AS para_order FROM (
          SELECT o_orderkey, o_custkey, o_orderstatus, o_orderpriority,
            row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS place FROM orders)"""),
    "v_docs": (("v_places",), """
        SELECT doc,
          string_agg('Order ' || o_orderkey || ' is ' || o_orderstatus, chr(10) || chr(10) ORDER BY para_order, o_orderkey) AS para_text,
          string_agg(o_orderkey || ' | ' || o_orderstatus || ' | ' || o_orderpriority, chr(10) ORDER BY o_orderkey) AS table_text
        FROM v_places GROUP BY doc"""),
    "v_questions": (("v_places", "v_docs"), """
        SELECT p.doc || '_q' || (row_number() OVER (PARTITION BY p.doc ORDER BY o_orderkey) - 1) AS id,
          'Status of ' || o_orderkey || '?' AS question, o_orderstatus AS answer,
          para_text || chr(10) || chr(10) || 'TABLE:' || chr(10) || table_text AS context, 't_' || p.doc AS table_uid,
          CASE WHEN o_orderkey % 2 = 0 THEN 'span' ELSE 'arithmetic' END AS answer_type
        FROM v_places p JOIN v_docs d ON d.doc = p.doc"""),
    "v_options": (("v_prompts",), """
        SELECT *, replace('{~1~: ~' || string_split(ground_truth, ' ')[1] || '~, ~0~: "' || string_split(ground_truth, ' ')[2]
          || '", ~2~: ~none~, ~correct answer~: ~' || string_split(ground_truth, ' ')[1] || '~}', '~', chr(39)) AS options,
          CAST(conv_id % 4 AS INTEGER) AS correct_index,
          CASE WHEN conv_id % 3 = 0 THEN NULL WHEN conv_id % 3 = 1 THEN '  ' ELSE ground_truth END AS documents
        FROM v_prompts"""),
    "v_scored": ((), """
        SELECT 'length' AS model, d.lang AS domain, d.doc_id AS id, 1 - l.quality AS y,
               round(d.n_chars / (d.n_chars + 1500.0), 4) AS p,
               CAST(round(d.n_chars / (d.n_chars + 1500.0), 4) >= 0.5 AS INTEGER) AS pred
        FROM documents d JOIN labels l USING (doc_id)"""),
    "v_scored_big": ((), """
        SELECT *, CAST(p >= 0.5 AS INTEGER) AS pred FROM (
          SELECT 'discount_tax' AS model, l_linestatus AS domain, CAST(l_returnflag = 'R' AS INTEGER) AS y,
                 least(1.0, round(l_discount * 5 + l_tax * 5, 4)) AS p FROM lineitem
          UNION ALL
          SELECT 'discount', l_linestatus, CAST(l_returnflag = 'R' AS INTEGER),
                 round(l_discount * 10, 4) FROM lineitem)"""),
    "v_all_scored": (("v_scored", "v_scored_big"), """
        SELECT model, domain, y, p, pred FROM v_scored_big
        UNION ALL SELECT model, domain, y, p, pred FROM v_scored"""),
    "v_features": ((), r"""
        SELECT d.doc_id, 1 - l.quality AS y, d.lang AS domain, d.source,
               CAST(length(d.text) AS DOUBLE) AS f_chars,
               CAST(len(string_split(d.text, ' ')) AS DOUBLE) AS f_words,
               len(list_distinct(string_split(d.text, ' '))) / len(string_split(d.text, ' ')) AS f_unique,
               length(regexp_replace(d.text, '[^0-9]', '', 'g')) / length(d.text) AS f_digits,
               length(regexp_replace(d.text, '[^.,;:!?]', '', 'g')) / length(d.text) AS f_punct,
               CASE WHEN d.doc_id % 4 <> 0 THEN length(d.text) / len(string_split(d.text, ' ')) END AS f_gap,
               CAST(NULL AS DOUBLE) AS f_none, CAST(1.0 AS DOUBLE) AS f_flat
        FROM documents d JOIN labels l USING (doc_id)"""),
    "v_long": (("v_features",), """
        SELECT doc_id, y, domain, unnest(['f_chars','f_words','f_unique','f_digits','f_punct']) AS feature,
               unnest([f_chars, f_words, f_unique, f_digits, f_punct]) AS x
        FROM v_features"""),
    "v_entity": ((), """
        SELECT 'How much ' || p_name || ' does ' || s_name || ' of ' || n_name || ' in ' || r_name || ' ship' AS prompt,
               CAST(count(*) AS BIGINT) AS n_rows, CAST(count(*) FILTER (WHERE l_returnflag = 'R') AS BIGINT) AS n_pos
        FROM lineitem JOIN part ON p_partkey = l_partkey JOIN supplier ON s_suppkey = l_suppkey
        JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey
        GROUP BY 1"""),
    "v_gazetteer": ((), """
        SELECT trim(lower(n_name)) AS text_normalized, 'GPE' AS label FROM nation
        UNION SELECT trim(lower(r_name)), 'LOC' FROM region
        UNION SELECT trim(lower(s_name)), 'ORG' FROM supplier
        UNION SELECT trim(lower(p_name)), 'PRODUCT' FROM part"""),
    "v_word_gazetteer": ((), r"""
        SELECT lower(regexp_extract(text, '[\p{L}\p{N}]+', 0)) AS text_normalized,
               min(['PERSON','ORG','GPE','LOC','PRODUCT','EVENT'][item_id % 6 + 1]) AS label
        FROM benchmark WHERE regexp_extract(text, '[\p{L}\p{N}]+', 0) <> '' GROUP BY 1"""),
}

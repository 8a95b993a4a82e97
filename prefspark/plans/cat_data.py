"""Checked queries: sources, preparation, scoring and pairs (S, P, A20, W3, ...)."""

from __future__ import annotations

from pyspark.sql import functions as F

from prefspark.functions import text as tx
from prefspark.operators import pairs, prep
from prefspark.plans import views as V
from prefspark.plans.registry import register
from prefspark.plans.views import with_views

WC = "CAST(len(regexp_extract_all({t}, '\\S+')) AS INTEGER)"


def wc(t: str = "text") -> str:
    return WC.format(t=t)


# ------------------------------------------------------------------ P1
@register("p1_length_filter", with_views(f"""
SELECT id, source, {wc()} AS n_words FROM v_samples
WHERE text IS NULL OR {wc()} BETWEEN 10 AND 512""", "v_samples"))
def p1_length_filter(spark, sf):
    s = prep.length_filter(V.v_samples(spark, sf))
    return s.select("id", "source", tx.word_count("text").alias("n_words"))


# ------------------------------------------------------------------ A20
@register("a20_dedup_first", with_views("""
SELECT id, source, lang FROM v_samples
WHERE id IN (SELECT min(id) FROM v_samples GROUP BY text)""", "v_samples"))
def a20_dedup_first(spark, sf):
    return prep.dedup_first(V.v_samples(spark, sf), "text", "id").select("id", "source", "lang")


# ------------------------------------------------------------------ K2
@register("k2_cap_first", with_views("""
SELECT id, source FROM v_samples ORDER BY id LIMIT 5000""", "v_samples"))
def k2_cap_first(spark, sf):
    return prep.cap_first(V.v_samples(spark, sf), 5000, "id").select("id", "source")


# ------------------------------------------------------------------ P2
@register("p2_prepare_samples", with_views(f"""
WITH f AS (SELECT * FROM v_samples WHERE text IS NULL OR {wc()} BETWEEN 10 AND 512),
d AS (SELECT * FROM f WHERE id IN (SELECT min(id) FROM f GROUP BY text))
SELECT id, source, lang, {wc()} AS n_words FROM d ORDER BY id LIMIT 5000""", "v_samples"))
def p2_prepare_samples(spark, sf):
    s = prep.prepare_samples(V.v_samples(spark, sf), max_samples=5000)
    return s.select("id", "source", "lang", tx.word_count("text").alias("n_words"))


# ------------------------------------------------------------------ P15
@register("p15_split_flag", with_views("""
SELECT id, CASE WHEN substr(md5(CAST(id AS VARCHAR)), 1, 2) < '1a' THEN 'validation' ELSE 'train' END AS split,
       count(*) OVER (PARTITION BY substr(md5(CAST(id AS VARCHAR)), 1, 2) < '1a') AS split_rows
FROM v_samples""", "v_samples"))
def p15_split_flag(spark, sf):
    s = prep.split_flag(V.v_samples(spark, sf), key=prep.md5_split_key("id"))
    n = s.groupBy("split").agg(F.count(F.lit(1)).alias("split_rows"))
    return s.select("id", "split").join(n, "split")


# ------------------------------------------------------------------ P15 (hash form)
@register("p15_split_hash")
def p15_split_hash(spark, sf):
    """Default hash split; checked rows-only (DuckDB has no xxhash64)."""
    s = prep.split_flag(V.v_samples(spark, sf))
    return s.groupBy("split").agg(F.count(F.lit(1)).alias("n"))


# ------------------------------------------------------------------ W14
@register("w14_curriculum_stage", with_views(f"""
WITH s AS (SELECT id, {wc()} AS difficulty FROM v_samples),
r AS (SELECT id, difficulty, percent_rank() OVER (ORDER BY difficulty) AS pr FROM s)
SELECT id, difficulty, round(pr, 6) AS pct_rank,
       CASE WHEN pr <= 0.25 THEN 1 WHEN pr <= 0.5 THEN 2 WHEN pr <= 0.75 THEN 3 WHEN pr <= 1.0 THEN 4 END AS stage
FROM r""", "v_samples"))
def w14_curriculum_stage(spark, sf):
    s = V.v_samples(spark, sf).select("id", tx.word_count("text").alias("difficulty"))
    return prep.curriculum_stage(s, "difficulty").select("id", "difficulty", "pct_rank", "stage")


# ------------------------------------------------------------------ W13 / P16
@register("w13_conversation_pairs", with_views("""
WITH t AS (
  SELECT conv_id, turn, role, text,
         lead(role) OVER (PARTITION BY conv_id ORDER BY turn) AS next_role,
         lead(text) OVER (PARTITION BY conv_id ORDER BY turn) AS next_text,
         count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS history_turns,
         coalesce(string_agg(text, chr(10) ORDER BY turn) OVER (PARTITION BY conv_id ORDER BY turn
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS history
  FROM v_turns)
SELECT conv_id, turn, text AS prompt, next_text AS response, history_turns, history
FROM t WHERE role = 'user' AND next_role = 'assistant'""", "v_turns"))
def w13_conversation_pairs(spark, sf):
    t = V.v_turns(spark, sf)
    return prep.with_history(prep.conversation_pairs(t), prep.conversation_texts(t))


@register("w13_history_offsets", with_views("""
WITH t AS (
  SELECT conv_id, turn, role, text, lead(role) OVER w AS next_role, lead(text) OVER w AS next_text,
         count(*) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS history_turns,
         greatest(coalesce(sum(length(text) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - 1, 0) AS history_chars
  FROM v_turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
SELECT conv_id, turn, text AS prompt, next_text AS response, history_turns, CAST(history_chars AS BIGINT) AS history_chars
FROM t WHERE role = 'user' AND next_role = 'assistant'""", "v_turns"))
def w13_history_offsets(spark, sf):
    """The pairs with their history by reference: linear in a conversation."""
    return prep.conversation_pairs(V.v_turns(spark, sf))


# ------------------------------------------------------------------ P14
@register("p14_feedback_prompt", with_views("""
SELECT conv_id, turn, length('Evaluate the following response:' || chr(10) || text || chr(10) || chr(10)
       || 'Provide a score from 1-10 and brief feedback:') AS prompt_chars,
       md5('Evaluate the following response:' || chr(10) || text || chr(10) || chr(10)
       || 'Provide a score from 1-10 and brief feedback:') AS prompt_md5
FROM v_turns WHERE role = 'assistant'""", "v_turns"))
def p14_feedback_prompt(spark, sf):
    t = V.v_turns(spark, sf).filter(F.col("role") == "assistant")
    p = tx.feedback_prompt("text")
    return t.select("conv_id", "turn", F.length(p).cast("bigint").alias("prompt_chars"), F.md5(p).alias("prompt_md5"))


# ------------------------------------------------------------------ F23
@register("f23_first_int_score", with_views("""
SELECT conv_id, turn,
       coalesce(CAST(nullif(regexp_extract(text, '\\d+', 0), '') AS DOUBLE) / 10, 0.5) AS ai_score
FROM v_turns""", "v_turns"))
def f23_first_int_score(spark, sf):
    t = V.v_turns(spark, sf)
    return t.select("conv_id", "turn", tx.first_int_score("text").alias("ai_score"))


# ------------------------------------------------------------------ F24
@register("f24_quality_metrics", with_views(f"""
SELECT id, round(least({wc()} / 50.0, 1.0), 6) AS helpfulness,
       CAST(0.8 AS DOUBLE) AS harmlessness, CAST(0.7 AS DOUBLE) AS truthfulness
FROM v_samples""", "v_samples"))
def f24_quality_metrics(spark, sf):
    s = V.v_samples(spark, sf).withColumn("m", tx.quality_metrics("text"))
    return s.select("id", F.col("m")["helpfulness"].alias("helpfulness"),
                    F.col("m")["harmlessness"].alias("harmlessness"),
                    F.col("m")["truthfulness"].alias("truthfulness"))


SCORE_SQL = f"0.7 * least({wc('response')} / 50.0, 1.0) + 0.3 * harmlessness"


# ------------------------------------------------------------------ F25
@register("f25_multi_objective_reward", with_views(f"""
SELECT prompt, resp_idx, round({SCORE_SQL}, 6) AS score FROM v_responses""", "v_responses"))
def f25_multi_objective_reward(spark, sf):
    r = pairs.score_responses(V.v_responses(spark, sf), harmlessness="harmlessness")
    return r.select("prompt", "resp_idx", "score")


# ------------------------------------------------------------------ F26
@register("f26_weighted_reward", with_views("""
SELECT prompt, resp_idx, round(helpfulness * (1.0 / 2), 6) AS weighted_reward
FROM v_responses""", "v_responses"))
def f26_weighted_reward(spark, sf):
    r = V.v_responses(spark, sf)
    return r.select("prompt", "resp_idx",
                    tx.weighted_reward("helpfulness", [0.7, 0.3]).alias("weighted_reward"))


# ------------------------------------------------------------------ P17
@register("p17_objective_vector", with_views("""
SELECT prompt, resp_idx,
       CASE WHEN helpfulness >= harmlessness THEN 1.0 ELSE 0.0 END AS is_helpfulness,
       CASE WHEN helpfulness >= harmlessness THEN 0.0 ELSE 1.0 END AS is_harmlessness
FROM v_responses""", "v_responses"))
def p17_objective_vector(spark, sf):
    r = V.v_responses(spark, sf).withColumn(
        "label", F.when(F.col("helpfulness") >= F.col("harmlessness"), "helpfulness")
                  .otherwise("harmlessness"))
    v = tx.objective_vector("label", ["helpfulness", "harmlessness"])
    return r.select("prompt", "resp_idx", v[0].alias("is_helpfulness"), v[1].alias("is_harmlessness"))


PAIRS_SQL = f"""
WITH f AS (SELECT * FROM v_responses WHERE response IS NULL OR {wc('response')} BETWEEN 10 AND 512),
d AS (SELECT * FROM f WHERE resp_idx IN (SELECT min(resp_idx) FROM f GROUP BY response)),
s AS (SELECT prompt, resp_idx, response, {SCORE_SQL} AS score FROM d)
SELECT prompt,
       arg_max(response, (score, -resp_idx)) AS chosen,
       arg_min(response, (score, -resp_idx)) AS rejected,
       round(arg_max(score, (score, -resp_idx)), 6) AS chosen_score,
       round(arg_min(score, (score, -resp_idx)), 6) AS rejected_score
FROM s GROUP BY prompt HAVING count(*) >= 2"""


def flagship(spark, sf):
    """documents + labels -> length filter -> dedup -> score -> best/worst pair per source."""
    r = V.v_responses(spark, sf)
    r = prep.length_filter(r, "response")
    r = prep.dedup_first(r, "response", "resp_idx")
    r = pairs.score_responses(r, harmlessness="harmlessness")
    return pairs.preference_pairs(r)


# ------------------------------------------------------------------ W3 / K1 (flagship)
@register("w3_preference_pairs", with_views(PAIRS_SQL, "v_responses"))
def w3_preference_pairs(spark, sf):
    return flagship(spark, sf)


# ------------------------------------------------------------------ K1
@register("k1_rank_feedback", with_views(f"""
SELECT prompt, resp_idx, round({SCORE_SQL}, 6) AS score,
       row_number() OVER (PARTITION BY prompt ORDER BY {SCORE_SQL} DESC, resp_idx) AS rank
FROM v_responses""", "v_responses"))
def k1_rank_feedback(spark, sf):
    r = pairs.score_responses(V.v_responses(spark, sf), harmlessness="harmlessness")
    return pairs.rank_feedback(r).select("prompt", "resp_idx", "score", F.col("rank").cast("bigint"))


# ------------------------------------------------------------------ J7 / X2
@register("j7_attach_feedback", with_views("""
SELECT prompt, resp_idx, d.text AS feedback_doc,
       coalesce(CAST(nullif(regexp_extract(d.text, '\\d+', 0), '') AS DOUBLE) / 10, 0.5) AS ai_score
FROM v_responses r JOIN documents d ON d.doc_id = r.resp_idx + 1""", "v_responses"))
def j7_attach_feedback(spark, sf):
    """Judge output arrives as a separate table keyed by (prompt, resp_idx);
    here the next document plays the judge's reply."""
    r = V.v_responses(spark, sf)
    d = V.table(spark, sf, "documents")
    fb = (r.select("prompt", "resp_idx")
           .join(d, F.col("doc_id") == F.col("resp_idx") + 1)
           .select("prompt", "resp_idx", F.col("text").alias("feedback_doc")))
    return (pairs.attach_feedback(r.select("prompt", "resp_idx"), fb)
                 .withColumn("ai_score", tx.first_int_score("feedback_doc")))


# ------------------------------------------------------------------ X2 (judge hook)
JUDGE_LEN = ("length('Evaluate the following response:' || chr(10) || response || chr(10) || chr(10)"
             " || 'Provide a score from 1-10 and brief feedback:')")


@register("x2_ai_feedback", with_views(f"""
SELECT prompt, count(*) AS n, round(avg(CAST({JUDGE_LEN} % 10 + 1 AS DOUBLE) / 10), 6) AS mean_ai_score
FROM v_responses GROUP BY prompt""", "v_responses"))
def x2_ai_feedback(spark, sf):
    """Batch judge over every response via mapInPandas; the stub judge replies
    "Score: <len % 10 + 1>/10", so its mean score has a SQL twin."""
    r = V.v_responses(spark, sf).select("prompt", "resp_idx", "response")
    out = pairs.ai_feedback(r)
    return out.groupBy("prompt").agg(F.count(F.lit(1)).alias("n"), F.avg("ai_score").alias("mean_ai_score"))


# ------------------------------------------------------------------ X3
@register("x3_fan_out", with_views("""
SELECT prompt, g.resp_idx, count(*) AS n
FROM (SELECT DISTINCT prompt FROM v_responses) p, range(0, 4) g(resp_idx)
GROUP BY prompt, g.resp_idx""", "v_responses"))
def x3_fan_out(spark, sf):
    p = V.v_responses(spark, sf).select("prompt").distinct()
    return (pairs.fan_out(p, 4).withColumn("resp_idx", F.col("resp_idx").cast("bigint"))
                 .groupBy("prompt", "resp_idx")
                 .agg(F.count(F.lit(1)).alias("n")))


# ------------------------------------------------------------------ A22
@register("a22_objective_balance", with_views("""
SELECT prompt, CASE WHEN stddev_pop(helpfulness) / nullif(avg(helpfulness), 0) IS NULL THEN 1.0
       ELSE least(1.0, greatest(0.0, 1.0 - stddev_pop(helpfulness) / nullif(avg(helpfulness), 0))) END AS balance
FROM v_responses GROUP BY prompt""", "v_responses"))
def a22_objective_balance(spark, sf):
    r = V.v_responses(spark, sf)
    return pairs.objective_balance(r, ["prompt"], "helpfulness")


# ------------------------------------------------------------------ S1
@register("s1_load_dataset", """
SELECT lang, count(*) AS n, count(DISTINCT source) AS sources FROM documents GROUP BY lang""")
def s1_load_dataset(spark, sf):
    """A dataset registered by short name and loaded with its column map."""
    from prefspark.sources import datasets
    datasets.register_dataset("documents", datasets.DatasetSpec(
        "documents.parquet", columns={"doc_id": "id", "text": "text", "lang": "lang", "source": "source"}))
    d = datasets.load_dataset(spark, "documents", sf)
    return d.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("source").alias("sources"))


# ------------------------------------------------------------------ K6
@register("k6_eval_subset", with_views("""
SELECT id, source FROM v_samples WHERE substr(md5(CAST(id AS VARCHAR)), 1, 2) < '1a'
ORDER BY id LIMIT 1000""", "v_samples"))
def k6_eval_subset(spark, sf):
    """Evaluation cap (1000) on the validation split."""
    s = prep.split_flag(V.v_samples(spark, sf), key=prep.md5_split_key("id"))
    return prep.cap_first(s.filter(F.col("split") == "validation"), 1000, "id").select("id", "source")


# ------------------------------------------------------------------ P16
@register("p16_select_keys", with_views("""
SELECT conv_id, turn, text AS prompt, next_text AS chosen, coalesce(next2_text, '') AS rejected FROM (
  SELECT conv_id, turn, role, text, lead(text) OVER w AS next_text, lead(text, 2) OVER w AS next2_text,
         lead(role) OVER w AS next_role
  FROM v_turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn))
WHERE role = 'user' AND next_role = 'assistant'""", "v_turns"))
def p16_select_keys(spark, sf):
    """Key selection: the user turn is the prompt, the answer the chosen
    response and the turn after it the rejected one."""
    from pyspark.sql import Window
    w = Window.partitionBy("conv_id").orderBy("turn")
    t = (V.v_turns(spark, sf)
         .withColumn("a", F.lead("text").over(w))
         .withColumn("b", F.coalesce(F.lead("text", 2).over(w), F.lit("")))
         .withColumn("next_role", F.lead("role").over(w))
         .filter((F.col("role") == "user") & (F.col("next_role") == "assistant")))
    return prep.select_keys(t, "text", "a", "b", keep=("conv_id", "turn"))


# ------------------------------------------------------------------ X1
@register("x1_reward_model", with_views(f"""
SELECT id, round({wc()} / 100.0, 6) AS model_reward FROM v_samples""", "v_samples"))
def x1_reward_model(spark, sf):
    """Caller's reward model as an iterator pandas UDF (stand-in model)."""
    from prefspark.functions.udf import model_reward
    s = V.v_samples(spark, sf)
    return s.select("id", model_reward("text").alias("model_reward"))


# ------------------------------------------------------------------ S11
@register("s11_save_generations", with_views("""
SELECT source AS run_id, count(*) AS n, CAST(sum(length(text)) AS BIGINT) AS chars, count(DISTINCT id) AS ids
FROM v_samples GROUP BY source""", "v_samples"))
def s11_save_generations(spark, sf):
    """Samples appended in two steps to a table partitioned by run, and read
    back."""
    import uuid

    from prefspark.session import checkpoint_dir
    from prefspark.sources import sinks
    out = f"{checkpoint_dir(spark).rstrip('/')}/generations-{uuid.uuid4().hex}"
    s = V.v_samples(spark, sf).select(F.col("source").alias("run_id"), "id", "text")
    for part in (0, 1):
        sinks.save_generations(s.where(F.col("id") % 2 == part), out)
    back = spark.read.parquet(out)
    return back.groupBy("run_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.char_length("text")).alias("chars"),
                                      F.count_distinct("id").alias("ids"))

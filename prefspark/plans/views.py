"""Views that map the driver tables onto this package's data model.

Each view exists twice: as a DataFrame builder (what the operators consume)
and as DuckDB SQL (used inside the oracle queries).  Both read whole tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.plans.scan import row_index


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Scan one table."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def v_samples(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(F.col("doc_id").alias("id"), "text", "source", "lang")


def v_turns(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


def v_responses(spark, sf_dir) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    lab = table(spark, sf_dir, "labels")
    return (d.join(lab, "doc_id")
             .select(F.col("source").alias("prompt"), F.col("doc_id").alias("resp_idx"),
                     F.col("text").alias("response"),
                     F.col("quality").cast("double").alias("helpfulness"),
                     (F.lit(1) - F.col("toxic")).cast("double").alias("harmlessness")))


def v_tokens(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    a = e.alias("a")
    b = e.select((F.col("vec_id") - 1).alias("b_id"), F.col("embedding").alias("reference_logits"))
    c = e.select((F.col("vec_id") - 2).alias("c_id"), F.col("embedding").alias("target_logits"))
    return (a.join(b, F.col("a.vec_id") == F.col("b_id"))
             .join(c, F.col("a.vec_id") == F.col("c_id"))
             .select(F.floor(F.col("vec_id") / 10).cast("bigint").alias("seq_id"),
                     (F.col("vec_id") % 10).alias("pos"),
                     F.col("label").alias("action"),
                     F.col("embedding").alias("policy_logits"),
                     "reference_logits", "target_logits",
                     (F.col("label").cast("double") / 10).alias("reward")))


def v_pairs(spark, sf_dir) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    b = e.select((F.col("vec_id") - 1).alias("b_id"), F.col("embedding").alias("reference_logits"))
    return (e.join(b, F.col("vec_id") == F.col("b_id"))
             .select(F.floor(F.col("vec_id") / 20).cast("bigint").alias("pair_id"),
                     F.when(F.floor(F.col("vec_id") / 10) % 2 == 0, "chosen")
                      .otherwise("rejected").alias("side"),
                     (F.col("vec_id") % 10).alias("pos"),
                     F.col("label").alias("token_id"),
                     F.col("embedding").alias("policy_logits"), "reference_logits"))


def v_passes(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        (F.col("vec_id") % 100).alias("pos"),
        F.floor(F.col("vec_id") / 100).cast("bigint").alias("pass"),
        F.col("embedding").alias("logits"))


def v_steps(spark, sf_dir, with_tokens: bool = False) -> DataFrame:
    """One run per user, steps in time order.  ``with_tokens`` adds the
    token count of each step read from the JSON ``props`` (key ``k``)."""
    extra = [F.get_json_object("props", "$.k").cast("bigint").alias("tokens")] if with_tokens else []
    ev = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("run_id"), F.col("event_type").alias("phase"), "ts",
        "event_id", F.col("value").alias("reward_mean"), *extra)
    return row_index(ev, ["run_id"], ["ts", "event_id"], "step")


def v_runs(spark, sf_dir) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.col("l_returnflag").alias("algorithm"), F.col("l_linestatus").alias("dataset"),
        F.col("l_linenumber").cast("string").alias("model_size"),
        F.concat_ws("_", "l_returnflag", "l_linestatus", F.col("l_linenumber").cast("string"),
                    F.col("l_orderkey").cast("string")).alias("experiment_name"),
        (F.col("l_extendedprice") / 100000).alias("reward_mean"),
        F.col("l_quantity").alias("duration_hours"),
        F.col("l_discount").alias("kl_divergence"), F.col("l_tax").alias("entropy"),
        F.col("l_partkey").alias("total_steps"))


def v_outcomes(spark, sf_dir) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("algorithm"),
        F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 1)
         .alias("return_code"),
        (F.col("o_orderstatus") == "P").alias("timed_out"),
        F.col("o_totalprice").alias("duration"), F.col("o_orderdate").alias("started_at"))


def v_predictions(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "labels").select(
        "doc_id", F.col("quality").alias("target"), (F.lit(1) - F.col("toxic")).alias("prediction"))


# ---------------------------------------------------------------- DuckDB SQL
SQL = {
    "v_samples": "SELECT doc_id AS id, text, source, lang FROM documents",
    "v_turns": "SELECT conv_id, turn, role, text FROM conversations",
    "v_responses": """SELECT d.source AS prompt, d.doc_id AS resp_idx, d.text AS response,
       CAST(l.quality AS DOUBLE) AS helpfulness, CAST(1 - l.toxic AS DOUBLE) AS harmlessness
FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
    "v_tokens": """SELECT CAST(floor(a.vec_id / 10) AS BIGINT) AS seq_id, a.vec_id % 10 AS pos, a.label AS action,
       a.embedding AS policy_logits, b.embedding AS reference_logits,
       c.embedding AS target_logits, CAST(a.label AS DOUBLE) / 10 AS reward
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
     JOIN embeddings c ON c.vec_id = a.vec_id + 2""",
    "v_pairs": """SELECT CAST(floor(a.vec_id / 20) AS BIGINT) AS pair_id,
       CASE WHEN floor(a.vec_id / 10) % 2 = 0 THEN 'chosen' ELSE 'rejected' END AS side,
       a.vec_id % 10 AS pos, a.label AS token_id, a.embedding AS policy_logits, b.embedding AS reference_logits
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""",
    "v_passes": """SELECT vec_id % 100 AS pos, CAST(floor(vec_id / 100) AS BIGINT) AS pass, embedding AS logits
FROM embeddings""",
    "v_steps": """SELECT user_id AS run_id, event_type AS phase, ts, event_id, value AS reward_mean,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS step
FROM events""",
    "v_runs": """SELECT l_returnflag AS algorithm, l_linestatus AS dataset, CAST(l_linenumber AS VARCHAR(10)) AS model_size,
       concat_ws('_', l_returnflag, l_linestatus, CAST(l_linenumber AS VARCHAR(10)),
                 CAST(l_orderkey AS VARCHAR(20))) AS experiment_name,
       l_extendedprice / 100000 AS reward_mean, l_quantity AS duration_hours,
       l_discount AS kl_divergence, l_tax AS entropy, l_partkey AS total_steps
FROM lineitem""",
    "v_steps_tok": """SELECT user_id AS run_id, event_type AS phase, ts, event_id, value AS reward_mean,
       CAST(json_extract_string(props, '$.k') AS BIGINT) AS tokens,
       CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS BIGINT) AS step
FROM events""",
    "v_outcomes": """SELECT o_orderkey AS id, o_orderpriority AS algorithm,
       CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 1 END AS return_code,
       o_orderstatus = 'P' AS timed_out, o_totalprice AS duration, o_orderdate AS started_at
FROM orders""",
    "v_predictions": "SELECT doc_id, quality AS target, 1 - toxic AS prediction FROM labels",
}


def with_views(body: str, *names: str) -> str:
    """Prefix ``body`` with ``WITH`` clauses for the named views."""
    ctes = ",\n".join(f"{n} AS (\n{SQL[n]}\n)" for n in names)
    body = body.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"

"""Checked queries: vector core and policy objectives (F1-F22, J4-J6, P13, P22,
A12-A14, A17, A18, A23, X4)."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from prefspark.functions import vec
from prefspark.functions.special import uniform_sql
from prefspark.operators import objectives as obj
from prefspark.plans import sqlvec as S
from prefspark.plans import views as V
from prefspark.plans.registry import register, round_half_away
from prefspark.plans.views import with_views


def _r(expr: str, name: str) -> str:
    return f"round({expr}, 6) AS {name}"


# ------------------------------------------------------------------ F1
@register("f1_log_softmax", with_views(f"""
WITH {S.token_ctes('v_tokens', {'p': 'policy_logits'})}
SELECT seq_id, pos, {_r('list_sum(list_transform(lp_p, lambda v: exp(v)))', 'prob_sum')},
       {_r('list_max(lp_p)', 'max_logp')}, {_r('lp_p[1]', 'first_logp')}
FROM tm""", "v_tokens"))
def f1_log_softmax(spark, sf):
    t = V.v_tokens(spark, sf).withColumn("lp", vec.log_softmax("policy_logits"))
    return t.select("seq_id", "pos",
                    F.aggregate(F.transform("lp", lambda v: F.exp(v)), F.lit(0.0), lambda a, x: a + x)
                    .alias("prob_sum"),
                    F.array_max("lp").alias("max_logp"), F.col("lp")[0].alias("first_logp"))


# ------------------------------------------------------------------ F2
@register("f2_kl_divergence", with_views(f"""
WITH {S.token_ctes('v_tokens', {'p': 'policy_logits', 'q': 'reference_logits'})}
SELECT seq_id, {_r(f"avg({S.kl('p', 'q')})", 'kl_divergence')} FROM tm GROUP BY seq_id""", "v_tokens"))
def f2_kl_divergence(spark, sf):
    t = V.v_tokens(spark, sf)
    return t.groupBy("seq_id").agg(
        F.avg(vec.kl_divergence("policy_logits", "reference_logits")).alias("kl_divergence"))


# ------------------------------------------------------------------ F2 (numpy form)
@register("f2_kl_divergence_numpy", with_views(f"""
WITH {S.token_ctes('v_tokens', {'p': 'policy_logits', 'q': 'reference_logits'})}
SELECT seq_id, {_r(f"avg({S.kl('p', 'q')})", 'kl_divergence')} FROM tm GROUP BY seq_id""", "v_tokens"))
def f2_kl_divergence_numpy(spark, sf):
    t = obj.with_token_metrics(V.v_tokens(spark, sf), form="numpy")
    return t.groupBy("seq_id").agg(F.avg("m.kl").alias("kl_divergence"))


# ------------------------------------------------------------------ F3
@register("f3_entropy", with_views(f"""
WITH {S.token_ctes('v_tokens', {'p': 'policy_logits'})}
SELECT seq_id, {_r(f"avg({S.entropy('p')})", 'entropy')} FROM tm GROUP BY seq_id""", "v_tokens"))
def f3_entropy(spark, sf):
    t = V.v_tokens(spark, sf)
    return t.groupBy("seq_id").agg(F.avg(vec.entropy("policy_logits")).alias("entropy"))


# ------------------------------------------------------------------ F4 / J5
@register("f4_importance_ratio", with_views(f"""
WITH {S.token_ctes('v_tokens', {'p': 'policy_logits', 'q': 'reference_logits'})}
SELECT seq_id, pos, {_r(S.gather('p', 'action'), 'logp')},
       {_r(f"exp({S.gather('p', 'action')} - {S.gather('q', 'action')})", 'ratio')}
FROM tm""", "v_tokens"))
def f4_importance_ratio(spark, sf):
    t = obj.with_token_metrics(V.v_tokens(spark, sf))
    return t.select("seq_id", "pos", F.col("m.logp").alias("logp"),
                    F.exp(F.col("m.logp") - F.col("m.logp_ref")).alias("ratio"))


# ------------------------------------------------------------------ J5
@register("j5_gather_action", with_views("""
WITH e AS (SELECT seq_id, pos, action, unnest(policy_logits) AS x,
                  generate_subscripts(policy_logits, 1) - 1 AS vocab_id FROM v_tokens)
SELECT seq_id, pos, round(CAST(x AS DOUBLE), 6) AS action_logit FROM e WHERE vocab_id = action""", "v_tokens"))
def j5_gather_action(spark, sf):
    """The taken action's score, read from its array in place; actions outside
    the vocabulary have none."""
    t = V.v_tokens(spark, sf)
    score = vec.gather(F.col("policy_logits"), F.col("action")).cast("double").alias("action_logit")
    return t.where((F.col("action") >= 0) & (F.col("action") < F.size("policy_logits"))).select("seq_id", "pos", score)


def _step_sql(o: obj.Objective, name_cols: list[str] | None = None) -> str:
    arrays = {"p": "policy_logits", "q": "reference_logits"}
    if o.off_policy:
        arrays["t"] = "target_logits"
    if o.kl_weight is not None:
        arrays["v"] = "target_logits"
    e = o.clip_epsilon
    iw = (f"least({o.iw_max}, greatest({o.iw_min}, exp({S.gather('p', 'action')} - {S.gather('t', 'action')})))"
          if o.off_policy else "1.0")
    per = (f"per AS (SELECT seq_id AS step, reward, {S.kl('p', 'q')} AS kl, {S.entropy('p')} AS ent, "
           f"{S.l2('p', 'q')} AS l2, exp({S.gather('p', 'action')} - {S.gather('q', 'action')}) AS ratio, "
           f"CAST({iw} AS DOUBLE) AS iw"
           + (f", {S.kl('p', 'v')} AS vikl, {S.abs_diff('p', 'v')} AS absd, len(lp_p) AS vocab"
              if o.kl_weight is not None else "") + " FROM tm)")
    aggs = [f"-avg(least(iw * ratio * reward, iw * least({1 + e}, greatest({1 - e}, ratio)) * reward)) AS policy_loss",
            "avg(ent) AS entropy", "avg(kl) AS kl_divergence", "avg(reward) AS reward_mean",
            "stddev_samp(reward) AS reward_std",
            f"avg(CASE WHEN abs(ratio - 1) > {e} THEN 1.0 ELSE 0.0 END) AS clip_fraction",
            "CAST(0.0 AS DOUBLE) AS value_loss"]
    outs = ["policy_loss", "entropy", "kl_divergence", "reward_mean", "reward_std", "clip_fraction",
            "value_loss"]
    total = f"policy_loss + value_loss - {o.entropy_coef} * entropy + {o.kl_coef} * kl_divergence"
    if o.alpha is not None:
        aggs += [f"{o.alpha} * avg(l2) AS grpo_regularization_loss",
                 "sqrt(sum(reward * reward)) AS advantage_norm"]
        outs += ["grpo_regularization_loss", "advantage_norm"]
        total += " + grpo_regularization_loss"
    if o.off_policy:
        aggs.append("avg(iw) AS importance_weight")
        outs.append("importance_weight")
    if o.kl_weight is not None:
        aggs += ["avg(vikl) AS vi_loss", "sum(absd) / sum(vocab) AS uncertainty"]
        outs += ["vi_loss", "uncertainty"]
        total += f" + {o.kl_weight} * vi_loss"
    g = f"g AS (SELECT step, {', '.join(aggs)} FROM per GROUP BY step)"
    sel = [_r(c, c) for c in outs] + [_r(total, "total_loss")]
    if o.kl_weight is not None:
        sel.append(_r("-policy_loss - vi_loss", "elbo"))
    if name_cols is not None:
        sel = [s for s in sel if s.split(" AS ")[-1] in name_cols]
    return with_views(f"WITH {S.token_ctes('v_tokens', arrays)},\n{per},\n{g}\n"
                      f"SELECT step, {', '.join(sel)} FROM g", "v_tokens")


def _steps(spark, sf, algo):
    t = V.v_tokens(spark, sf).withColumnRenamed("seq_id", "step")
    if algo == "grpo_vi":
        t = t.withColumn("variational_logits", F.col("target_logits"))
    return obj.step_metrics(t, algo)


def _reg_step(name, algo, cols=None):
    o = obj.objective(algo)

    @register(name, _step_sql(o, cols))
    def q(spark, sf):
        g = _steps(spark, sf, algo)
        return g.select("step", *cols) if cols else g
    q.__doc__ = f"Step metrics of {algo}"
    return q


# F12 PPO, F13 GRPO, F14 off-policy GRPO, F15 variational GRPO, F18 RLAIF
_reg_step("f12_ppo_step", "ppo")
_reg_step("f13_grpo_step", "grpo")
_reg_step("f14_grpo_offpolicy_step", "grpo_offpolicy")
_reg_step("f15_grpo_vi_step", "grpo_vi")
_reg_step("f18_rlaif_step", "rlaif")
# with coefficients of its own, which no other algorithm shares
_reg_step("f18_rlaif_coefficients", replace(obj.RLAIF, clip_epsilon=0.1, entropy_coef=0.03, kl_coef=0.35))
# Components on their own
_reg_step("f5_clipped_surrogate", "ppo", ["policy_loss"])
_reg_step("f6_offpolicy_weight", "grpo_offpolicy", ["importance_weight", "policy_loss"])
_reg_step("f7_l2_regularizer", "grpo", ["grpo_regularization_loss"])
_reg_step("f16_uncertainty", "grpo_vi", ["uncertainty"])
_reg_step("f17_elbo", "grpo_vi", ["elbo"])
_reg_step("a12_step_reward_stats", "ppo", ["reward_mean", "reward_std"])
_reg_step("a13_clip_fraction", "ppo", ["clip_fraction"])
_reg_step("a17_advantage_norm", "grpo", ["advantage_norm"])


# ------------------------------------------------------------------ F20
@register("f20_eval_metrics", with_views(f"""
WITH {S.token_ctes('v_tokens', {'p': 'policy_logits', 'q': 'reference_logits', 'v': 'target_logits'})}
SELECT seq_id AS step, {_r(f"avg({S.kl('p', 'q')})", 'kl_divergence')}, {_r('avg(reward)', 'reward_mean')},
       {_r('stddev_samp(reward)', 'reward_std')}, {_r(f"avg({S.kl('p', 'v')})", 'vi_kl')},
       {_r(f"sum({S.abs_diff('p', 'v')}) / sum(len(lp_p))", 'uncertainty')}
FROM tm GROUP BY seq_id""", "v_tokens"))
def f20_eval_metrics(spark, sf):
    t = V.v_tokens(spark, sf).withColumnRenamed("seq_id", "step")
    return obj.eval_metrics(t, variational="target_logits")


# ------------------------------------------------------------------ J4
@register("j4_align_scores", with_views(f"""
WITH pol AS (SELECT CAST(floor(vec_id / 10) AS BIGINT) AS seq_id, vec_id % 10 AS pos, embedding AS policy_logits FROM embeddings),
ref AS (SELECT CAST(floor((vec_id - 1) / 10) AS BIGINT) AS seq_id, (vec_id - 1) % 10 AS pos, embedding AS reference_logits FROM embeddings WHERE vec_id >= 1),
j AS (SELECT pol.seq_id, pol.pos, policy_logits, reference_logits FROM pol JOIN ref USING (seq_id, pos)),
{S.token_ctes('j', {'p': 'policy_logits', 'q': 'reference_logits'})}
SELECT seq_id, pos, {_r(S.kl('p', 'q'), 'kl')} FROM tm""", "v_tokens"))
def j4_align_scores(spark, sf):
    """Policy and reference scores arrive as separate tables; align them by an
    equi-join on (sequence, position)."""
    e = V.table(spark, sf, "embeddings")
    pol = e.select(F.floor(F.col("vec_id") / 10).cast("bigint").alias("seq_id"),
                   (F.col("vec_id") % 10).alias("pos"), F.col("embedding").alias("policy_logits"))
    ref = e.filter(F.col("vec_id") >= 1).select(
        F.floor((F.col("vec_id") - 1) / 10).cast("bigint").alias("seq_id"),
        ((F.col("vec_id") - 1) % 10).alias("pos"), F.col("embedding").alias("reference_logits"))
    j = pol.join(ref, ["seq_id", "pos"])
    return j.select("seq_id", "pos", vec.kl_divergence("policy_logits", "reference_logits").alias("kl"))


# ------------------------------------------------------------------ F22
@register("f22_argmax_label", """
SELECT vec_id, list_position(embedding, list_max(embedding)) - 1 AS argmax, label FROM embeddings""")
def f22_argmax_label(spark, sf):
    e = V.table(spark, sf, "embeddings")
    return e.select("vec_id", vec.argmax0("embedding").cast("int").alias("argmax"), "label")


# ------------------------------------------------------------------ F21
_GUMBEL = f"list_transform(lp_p, lambda v, i: v - ln(-ln({uniform_sql("CAST(seq_id AS VARCHAR) || '-' || CAST(pos AS VARCHAR) || '-' || CAST(i - 1 AS VARCHAR)")})))"


@register("f21_sample_action", with_views(f"""
WITH {S.token_ctes('v_tokens', {'p': 'policy_logits'})},
g AS (SELECT seq_id, pos, {_GUMBEL} AS g FROM tm)
SELECT seq_id, pos, list_position(g, list_max(g)) - 1 AS sampled FROM g""", "v_tokens"))
def f21_sample_action(spark, sf):
    """Reproducible Gumbel-max draw per token."""
    t = V.v_tokens(spark, sf)
    return t.select("seq_id", "pos", obj.sample_action("policy_logits", ["seq_id", "pos"]).cast("int").alias("sampled"))


# ------------------------------------------------------------------ DPO family
def _pair_sql_ctes() -> str:
    shifted = """sh AS (SELECT *, CASE WHEN lead(side) OVER w = side THEN lead(token_id) OVER w END AS target
FROM v_pairs WINDOW w AS (PARTITION BY pair_id ORDER BY side, pos))"""
    per = f"""per AS (SELECT pair_id, side, pos, target, target IS NOT NULL AND target <> 0 AS valid,
  {S.kl('p', 'q')} AS kl, {S.entropy('p')} AS ent, {S.gather('p', 'target')} AS lp, {S.gather('q', 'target')} AS lq FROM tm)"""
    pair = """pr AS (SELECT pair_id,
  sum(CASE WHEN side = 'chosen' AND valid THEN lp END) / nullif(count(CASE WHEN side = 'chosen' AND valid THEN 1 END), 0) AS chosen_logp,
  sum(CASE WHEN side = 'rejected' AND valid THEN lp END) / nullif(count(CASE WHEN side = 'rejected' AND valid THEN 1 END), 0) AS rejected_logp,
  sum(CASE WHEN side = 'chosen' AND valid THEN lq END) / nullif(count(CASE WHEN side = 'chosen' AND valid THEN 1 END), 0) AS chosen_ref_logp,
  sum(CASE WHEN side = 'rejected' AND valid THEN lq END) / nullif(count(CASE WHEN side = 'rejected' AND valid THEN 1 END), 0) AS rejected_ref_logp,
  sum(CASE WHEN side = 'chosen' THEN kl END) AS kl_chosen_sum, count(CASE WHEN side = 'chosen' THEN 1 END) AS n_chosen,
  sum(CASE WHEN side = 'rejected' THEN kl END) AS kl_rejected_sum, count(CASE WHEN side = 'rejected' THEN 1 END) AS n_rejected,
  sum(ent) AS entropy_sum
FROM per GROUP BY pair_id),
pr2 AS (SELECT *, chosen_logp - chosen_ref_logp AS chosen_log_ratio, rejected_logp - rejected_ref_logp AS rejected_log_ratio FROM pr)"""
    return (f"{shifted},\n{S.token_ctes('sh', {'p': 'policy_logits', 'q': 'reference_logits'})},\n"
            f"{per},\n{pair}")


def _pairs(spark, sf):
    return obj.dpo_pair_table(V.v_pairs(spark, sf))


# ------------------------------------------------------------------ J6 / P13
@register("j6_shift_targets", with_views("""
SELECT pair_id, side, pos,
       CAST(CASE WHEN lead(side) OVER w = side THEN lead(token_id) OVER w END AS DOUBLE) AS target
FROM v_pairs WINDOW w AS (PARTITION BY pair_id ORDER BY side, pos)""", "v_pairs"))
def j6_shift_targets(spark, sf):
    t = obj.sequence_logprobs(V.v_pairs(spark, sf), ["pair_id", "side"], partition=["pair_id"])
    # nullable id as double: NULL then reads the same in every client
    return t.select("pair_id", "side", "pos", F.col("__target").cast("double").alias("target"))


@register("p13_pad_mask", with_views("""
WITH sh AS (SELECT pair_id, side, CASE WHEN lead(side) OVER w = side THEN lead(token_id) OVER w END AS target
FROM v_pairs WINDOW w AS (PARTITION BY pair_id ORDER BY side, pos))
SELECT pair_id, side, count(CASE WHEN target IS NOT NULL AND target <> 0 THEN 1 END) AS n_valid,
       count(CASE WHEN target = 0 THEN 1 END) AS n_pad
FROM sh GROUP BY pair_id, side""", "v_pairs"))
def p13_pad_mask(spark, sf):
    t = obj.sequence_logprobs(V.v_pairs(spark, sf), ["pair_id", "side"], partition=["pair_id"])
    return t.groupBy("pair_id", "side").agg(
        F.count(F.when(F.col("__valid"), 1)).alias("n_valid"),
        F.count(F.when(F.col("__target") == 0, 1)).alias("n_pad"))


# ------------------------------------------------------------------ F8
@register("f8_sequence_logprob", with_views(f"""
WITH {_pair_sql_ctes()}
SELECT pair_id, {_r('chosen_logp', 'chosen_logp')}, {_r('rejected_logp', 'rejected_logp')},
       {_r('chosen_ref_logp', 'chosen_ref_logp')}, {_r('rejected_ref_logp', 'rejected_ref_logp')}
FROM pr2""", "v_pairs"))
def f8_sequence_logprob(spark, sf):
    return _pairs(spark, sf).select("pair_id", "chosen_logp", "rejected_logp", "chosen_ref_logp",
                                    "rejected_ref_logp")


SIGMOID = "(ln(1 + exp(-abs(0.1 * m))) + greatest(-(0.1 * m), 0.0))"
HINGE = "greatest(0.0, 1.0 - 0.1 * m)"


# ------------------------------------------------------------------ F9 / F10
@register("f9_dpo_sigmoid_loss", with_views(f"""
WITH {_pair_sql_ctes()},
mm AS (SELECT pair_id, chosen_log_ratio - rejected_log_ratio AS m FROM pr2)
SELECT pair_id, {_r(SIGMOID, 'loss')} FROM mm""", "v_pairs"))
def f9_dpo_sigmoid_loss(spark, sf):
    p = _pairs(spark, sf)
    m = F.col("chosen_log_ratio") - F.col("rejected_log_ratio")
    return p.select("pair_id", obj.dpo_loss(m, 0.1, "sigmoid").alias("loss"))


@register("f10_dpo_hinge_loss", with_views(f"""
WITH {_pair_sql_ctes()},
mm AS (SELECT pair_id, chosen_log_ratio - rejected_log_ratio AS m FROM pr2)
SELECT pair_id, {_r(HINGE, 'loss')} FROM mm""", "v_pairs"))
def f10_dpo_hinge_loss(spark, sf):
    p = _pairs(spark, sf)
    m = F.col("chosen_log_ratio") - F.col("rejected_log_ratio")
    return p.select("pair_id", obj.dpo_loss(m, 0.1, "hinge").alias("loss"))


def _dpo_step_sql(cols: list[str] | None = None, loss=SIGMOID, kl_pen: float = 0.0, ent_pen: float = 0.0) -> str:
    allc = {
        "dpo_loss": f"avg({loss})",
        "kl_divergence": "(sum(kl_chosen_sum) / sum(n_chosen) + sum(kl_rejected_sum) / sum(n_rejected)) / 2",
        "entropy": "sum(entropy_sum) / (sum(n_chosen) + sum(n_rejected))",
        "chosen_rewards": "avg(chosen_log_ratio)", "rejected_rewards": "avg(rejected_log_ratio)",
        "reward_diff": "avg(m)",
        "policy_accuracy": "avg(CASE WHEN chosen_log_ratio > rejected_log_ratio THEN 1.0 ELSE 0.0 END)",
        "reference_loss": "CAST(0.0 AS DOUBLE)",
    }
    g = ", ".join(f"{v} AS {k}" for k, v in allc.items())
    outs = list(allc) + ["total_loss"]
    sel = [_r(c, c) for c in allc] + [_r(f"dpo_loss + reference_loss + {kl_pen} * kl_divergence - {ent_pen} * entropy", "total_loss")]
    if cols:
        sel = [s for s, c in zip(sel, outs) if c in cols]
    return with_views(f"""WITH {_pair_sql_ctes()},
mm AS (SELECT *, chosen_log_ratio - rejected_log_ratio AS m, CAST(floor(pair_id / 4) AS BIGINT) AS step FROM pr2),
g AS (SELECT step, {g} FROM mm GROUP BY step)
SELECT step, {', '.join(sel)} FROM g""", "v_pairs")


def _dpo_steps(spark, sf, **kw):
    p = _pairs(spark, sf).withColumn("step", F.floor(F.col("pair_id") / 4).cast("bigint"))
    return obj.dpo_step_metrics(p, **kw)


@register("f19_dpo_step", _dpo_step_sql())
def f19_dpo_step(spark, sf):
    return _dpo_steps(spark, sf)


@register("f11_dpo_kl", _dpo_step_sql(["kl_divergence"]))
def f11_dpo_kl(spark, sf):
    return _dpo_steps(spark, sf).select("step", "kl_divergence")


@register("a14_policy_accuracy", _dpo_step_sql(["policy_accuracy"]))
def a14_policy_accuracy(spark, sf):
    return _dpo_steps(spark, sf).select("step", "policy_accuracy")


@register("a23_pair_margins", _dpo_step_sql(["chosen_rewards", "rejected_rewards", "reward_diff"]))
def a23_pair_margins(spark, sf):
    return _dpo_steps(spark, sf).select("step", "chosen_rewards", "rejected_rewards", "reward_diff")


@register("p22_dpo_penalties", _dpo_step_sql(["dpo_loss", "kl_divergence", "entropy", "total_loss"], HINGE, 0.1, 0.05))
def p22_dpo_penalties(spark, sf):
    return _dpo_steps(spark, sf, loss_type="hinge", kl_penalty=0.1, entropy_penalty=0.05).select(
        "step", "dpo_loss", "kl_divergence", "entropy", "total_loss")


# ------------------------------------------------------------------ X4 registry
def _x4_sql() -> str:
    parts = [f"SELECT '{a}' AS algorithm, step, total_loss FROM ({_step_sql(o, ['total_loss'])})"
             for a, o in obj.ALGORITHMS.items()]
    parts.append(f"SELECT 'dpo' AS algorithm, step, total_loss FROM ({_dpo_step_sql(['total_loss'])})")
    return "\nUNION ALL\n".join(parts)


@register("x4_algorithm_registry", _x4_sql())
def x4_algorithm_registry(spark, sf):
    """Objective chosen by name for every algorithm, stacked; unknown names
    raise."""
    tokens = V.v_tokens(spark, sf).withColumnRenamed("seq_id", "step").withColumn("variational_logits", F.col("target_logits"))
    pairs = V.v_pairs(spark, sf).withColumn("step", F.floor(F.col("pair_id") / 4).cast("bigint"))
    out = None
    for a in obj.REGISTRY:
        g = obj.train_step(a, pairs if a == "dpo" else tokens).select(F.lit(a).alias("algorithm"), "step", "total_loss")
        out = g if out is None else out.unionByName(g)
    return out


# ------------------------------------------------------------------ A18
@register("a18_ensemble_uncertainty", with_views("""
WITH e AS (SELECT pos, pass, CAST(unnest(logits) AS DOUBLE) AS x, generate_subscripts(logits, 1) AS v FROM v_passes),
pe AS (SELECT pos, v, avg(x) AS mean_logit, var_samp(x) AS var FROM e GROUP BY pos, v)
SELECT pos, round(avg(var), 6) AS uncertainty, round(avg(mean_logit), 6) AS mean_of_mean_logits, count(*) AS vocab,
       list(round(mean_logit, 6) ORDER BY v) AS mean_logits
FROM pe GROUP BY pos""", "v_passes"))
def a18_ensemble_uncertainty(spark, sf):
    u = obj.variational_uncertainty(V.v_passes(spark, sf))
    return u.withColumn("mean_logits", F.transform("mean_logits", lambda x: round_half_away(x)))

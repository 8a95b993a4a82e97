"""Policy objectives evaluated offline over token tables.

Input: one row per (sequence, position) with logit arrays for the policy and
reference (optionally target / variational) models, the taken action and the
reward of the token's sequence.  Each algorithm is one grouped aggregate per
step returning every loss component; the per-position vector math runs once
per row (:func:`prefspark.functions.vec.token_metrics`) and the aggregate is
partial map-side, so a step with many tokens is not one task.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefspark.functions.special import uniform
from prefspark.functions.vec import entropy_of, gather, kl_of, let, log_softmax, token_metrics_any


@dataclass(frozen=True)
class Objective:
    """Coefficients of one algorithm.  ``None`` switches a term off."""
    clip_epsilon: float = 0.2
    entropy_coef: float = 0.01
    kl_coef: float = 0.2
    alpha: float | None = None          # GRPO L2 regulariser
    off_policy: bool = False            # importance weights from a target model
    kl_weight: float | None = None      # variational KL weight
    iw_min: float = 0.1
    iw_max: float = 10.0


# Our defaults (the run configs define none of these sections).
PPO = Objective(clip_epsilon=0.2, entropy_coef=0.01, kl_coef=0.2)
GRPO = Objective(clip_epsilon=0.2, entropy_coef=0.01, kl_coef=0.04, alpha=0.1)
GRPO_OFFPOLICY = Objective(clip_epsilon=0.2, entropy_coef=0.01, kl_coef=0.04, alpha=0.1,
                           off_policy=True)
GRPO_VI = Objective(clip_epsilon=0.2, entropy_coef=0.01, kl_coef=0.04, alpha=0.1, kl_weight=1.0)
RLAIF = Objective(clip_epsilon=0.2, entropy_coef=0.01, kl_coef=0.2)

ALGORITHMS = {"ppo": PPO, "grpo": GRPO, "grpo_offpolicy": GRPO_OFFPOLICY, "grpo_vi": GRPO_VI,
              "rlaif": RLAIF}


def objective(algo: str | Objective) -> Objective:
    """The objective registered under ``algo`` (default ``ppo``); an unknown
    name is an error."""
    if isinstance(algo, Objective):
        return algo
    name = (algo or "ppo").lower()
    if name not in ALGORITHMS:
        raise ValueError(f"unknown algorithm {name!r}; known: {sorted(ALGORITHMS)}")
    return ALGORITHMS[name]


def with_token_metrics(tokens: DataFrame, policy="policy_logits", reference="reference_logits",
                       action="action", target=None, variational=None, form="jvm",
                       mask: str | None = None) -> DataFrame:
    """Add struct column ``m`` with the per-position quantities.  ``mask``
    names an attention-mask column; masked-out positions are dropped (the
    default keeps every position, like the reference)."""
    df = tokens if mask is None else tokens.filter(F.col(mask) != 0)
    m = token_metrics_any(form, policy, reference, action, target, variational)
    return df.withColumn("m", m)


def _clip(ratio: Column, eps: float) -> Column:
    return F.least(F.lit(1 + eps), F.greatest(F.lit(1 - eps), ratio))


def step_metrics(tokens: DataFrame, algo: str | Objective = "ppo", step: list[str] | str = "step",
                 reward: str = "reward", form: str = "jvm", mask: str | None = None,
                 policy="policy_logits", reference="reference_logits", action="action",
                 target="target_logits", variational="variational_logits") -> DataFrame:
    """All loss components of one training step for PPO, GRPO, off-policy GRPO,
    variational GRPO and RLAIF (``algo``), grouped by ``step``."""
    o = objective(algo)
    keys = [step] if isinstance(step, str) else list(step)
    t = with_token_metrics(tokens, policy, reference, action,
                           target if o.off_policy else None,
                           variational if o.kl_weight is not None else None, form, mask)
    ratio = F.exp(F.col("m.logp") - F.col("m.logp_ref"))
    r = F.col(reward)
    if o.off_policy:
        iw = F.least(F.lit(o.iw_max), F.greatest(F.lit(o.iw_min),
                                                 F.exp(F.col("m.logp") - F.col("m.logp_target"))))
    else:
        iw = F.lit(1.0)
    surrogate = F.least(iw * ratio * r, iw * _clip(ratio, o.clip_epsilon) * r)
    t = t.select(*keys, r.alias("__r"), F.col("m.kl").alias("__kl"),
                 F.col("m.entropy").alias("__ent"), F.col("m.l2").alias("__l2"),
                 surrogate.alias("__sur"), iw.alias("__iw"),
                 (F.abs(ratio - 1) > o.clip_epsilon).cast("double").alias("__clip"),
                 F.col("m.vi_kl").alias("__vikl"), F.col("m.abs_diff").alias("__absd"),
                 F.col("m.vocab").alias("__vocab"))
    aggs = [
        (-F.avg("__sur")).alias("policy_loss"),
        F.avg("__ent").alias("entropy"),
        F.avg("__kl").alias("kl_divergence"),
        F.avg("__r").alias("reward_mean"),
        F.stddev_samp("__r").alias("reward_std"),
        F.avg("__clip").alias("clip_fraction"),
    ]
    if o.alpha is not None:
        aggs += [F.avg("__l2").alias("__l2m"), F.sqrt(F.sum(F.col("__r") * F.col("__r"))).alias("advantage_norm")]
    if o.off_policy:
        aggs.append(F.avg("__iw").alias("importance_weight"))
    if o.kl_weight is not None:
        aggs += [F.avg("__vikl").alias("vi_loss"),
                 (F.sum("__absd") / F.sum("__vocab")).alias("uncertainty")]
    g = t.groupBy(*keys).agg(*aggs)
    extra = {"value_loss": F.lit(0.0)}
    total = (F.col("policy_loss") - F.lit(o.entropy_coef) * F.col("entropy")
             + F.lit(o.kl_coef) * F.col("kl_divergence"))        # + value loss (zero)
    if o.alpha is not None:
        extra["grpo_regularization_loss"] = F.lit(o.alpha) * F.col("__l2m")
        total = total + F.lit(o.alpha) * F.col("__l2m")
    if o.kl_weight is not None:
        total = total + F.lit(o.kl_weight) * F.col("vi_loss")
        extra["elbo"] = -F.col("policy_loss") - F.col("vi_loss")
    extra["total_loss"] = total + F.lit(0.0)
    g = g.withColumns(extra)
    return g.drop("__l2m") if o.alpha is not None else g


def eval_metrics(tokens: DataFrame, step="step", reward="reward", variational: str | None = None,
                 form: str = "jvm", policy="policy_logits", reference="reference_logits",
                 action="action") -> DataFrame:
    """Evaluation-step metrics: KL and reward mean/std (the variational form
    adds ``vi_kl`` and ``uncertainty``)."""
    keys = [step] if isinstance(step, str) else list(step)
    t = with_token_metrics(tokens, policy, reference, action, None, variational, form)
    aggs = [F.avg("m.kl").alias("kl_divergence"), F.avg(reward).alias("reward_mean"),
            F.stddev_samp(reward).alias("reward_std")]
    if variational is not None:
        aggs += [F.avg("m.vi_kl").alias("vi_kl"),
                 (F.sum("m.abs_diff") / F.sum("m.vocab")).alias("uncertainty")]
    return t.groupBy(*keys).agg(*aggs)


# ------------------------------------------------------------------ DPO
def sequence_logprobs(tokens: DataFrame, seq: list[str], pos: str = "pos", token: str = "token_id",
                      policy="policy_logits", reference="reference_logits", pad_id: int = 0,
                      partition: list[str] | None = None) -> DataFrame:
    """Per-position rows for the shifted sequence log-prob: logits at ``pos``
    score the token at ``pos + 1`` (the last position has no target).

    ``partition`` (a prefix of ``seq``) sets the window's shuffle key so the
    next aggregate on it needs no second exchange; the window never crosses a
    sequence boundary.
    """
    part = partition or seq
    order = [c for c in seq if c not in part] + [pos]
    w = Window.partitionBy(*part).orderBy(*order)
    same = F.lit(True)
    for c in seq:
        if c not in part:
            same = same & (F.lead(c).over(w) == F.col(c))
    nxt = F.when(same, F.lead(token).over(w))
    t = tokens.withColumn("__target", nxt)
    m = let(log_softmax(policy), lambda lp: let(log_softmax(reference), lambda lq: F.struct(
        kl_of(lp, lq).alias("kl"), entropy_of(lp).alias("entropy"), gather(lp, F.col("__target")).alias("lp"),
        gather(lq, F.col("__target")).alias("lq"))))
    return t.withColumn("m", m).withColumn(
        "__valid", F.col("__target").isNotNull() & (F.col("__target") != pad_id))


def dpo_pair_table(pairs: DataFrame, pair: str = "pair_id", side: str = "side", pos: str = "pos",
                   token: str = "token_id", pad_id: int = 0, reduction: str = "mean",
                   extra_keys: list[str] | None = None, **kw) -> DataFrame:
    """One row per preference pair: mean (or summed) shifted log-probs of
    chosen and rejected under policy and reference, their log ratios and the
    per-side KL sums.  A side whose targets are all padding gives NULL."""
    keys = [pair] + (extra_keys or [])
    t = sequence_logprobs(pairs, keys + [side], pos, token, pad_id=pad_id, partition=keys, **kw)

    def side_agg(s: str, col: str) -> Column:
        cond = (F.col(side) == s) & F.col("__valid")
        tot = F.sum(F.when(cond, F.col(f"m.{col}")))
        if reduction == "sum":
            return tot
        return F.try_divide(tot, F.count(F.when(cond, F.lit(1))).cast("double"))

    g = t.groupBy(*keys).agg(
        side_agg("chosen", "lp").alias("chosen_logp"), side_agg("rejected", "lp").alias("rejected_logp"),
        side_agg("chosen", "lq").alias("chosen_ref_logp"), side_agg("rejected", "lq").alias("rejected_ref_logp"),
        F.sum(F.when(F.col(side) == "chosen", F.col("m.kl"))).alias("kl_chosen_sum"),
        F.count(F.when(F.col(side) == "chosen", F.lit(1))).alias("n_chosen"),
        F.sum(F.when(F.col(side) == "rejected", F.col("m.kl"))).alias("kl_rejected_sum"),
        F.count(F.when(F.col(side) == "rejected", F.lit(1))).alias("n_rejected"), F.sum("m.entropy").alias("entropy_sum"))
    return (g.withColumn("chosen_log_ratio", F.col("chosen_logp") - F.col("chosen_ref_logp"))
             .withColumn("rejected_log_ratio", F.col("rejected_logp") - F.col("rejected_ref_logp")))


def dpo_loss(margin: Column, beta: float = 0.1, loss_type: str = "sigmoid") -> Column:
    """Per-pair DPO loss for ``margin = chosen_log_ratio - rejected_log_ratio``."""
    x = F.lit(beta) * margin
    if loss_type == "sigmoid":
        # -log(sigmoid(x)) computed stably
        return F.log1p(F.exp(-F.abs(x))) + F.greatest(-x, F.lit(0.0))
    if loss_type == "hinge":
        return F.greatest(F.lit(0.0), F.lit(1.0) - x)
    raise ValueError(f"unsupported DPO loss type {loss_type!r} (sigmoid or hinge)")


def dpo_step_metrics(pair_rows: DataFrame, step: str = "step", beta: float = 0.1,
                     loss_type: str = "sigmoid", kl_penalty: float = 0.0, entropy_penalty: float = 0.0) -> DataFrame:
    """DPO metrics per step from :func:`dpo_pair_table` rows.  The total loss
    adds ``kl_penalty * KL`` and takes off ``entropy_penalty`` times the mean
    entropy of the policy over the positions of both sides (P22); the
    reference loss is zero."""
    margin = F.col("chosen_log_ratio") - F.col("rejected_log_ratio")
    p = pair_rows.withColumn("__loss", dpo_loss(margin, beta, loss_type)).withColumn("__margin", margin)
    g = p.groupBy(step).agg(
        F.avg("__loss").alias("dpo_loss"),
        ((F.sum("kl_chosen_sum") / F.sum("n_chosen") + F.sum("kl_rejected_sum") / F.sum("n_rejected")) / 2)
        .alias("kl_divergence"),
        (F.sum("entropy_sum") / (F.sum("n_chosen") + F.sum("n_rejected"))).alias("entropy"),
        F.avg("chosen_log_ratio").alias("chosen_rewards"),
        F.avg("rejected_log_ratio").alias("rejected_rewards"),
        F.avg("__margin").alias("reward_diff"),
        F.avg((F.col("chosen_log_ratio") > F.col("rejected_log_ratio")).cast("double"))
        .alias("policy_accuracy"))
    g = g.withColumn("reference_loss", F.lit(0.0))
    total = (F.col("dpo_loss") + F.col("reference_loss") + F.lit(kl_penalty) * F.col("kl_divergence")
             - F.lit(entropy_penalty) * F.col("entropy"))
    return g.withColumn("total_loss", total)


@dataclass(frozen=True)
class PairObjective:
    """Parameters of DPO, which reads preference pairs instead of rollouts."""

    beta: float = 0.1
    loss_type: str = "sigmoid"
    kl_penalty: float = 0.0
    entropy_penalty: float = 0.0


DPO = PairObjective()
#: all objectives by name
REGISTRY = {**ALGORITHMS, "dpo": DPO}


def train_step(algo: str | Objective | PairObjective, rows: DataFrame, step: str = "step", **kw) -> DataFrame:
    """Step metrics of the objective registered under ``algo`` (default
    ``ppo``; an unknown name is an error).  ``rows`` are tokens with scores, for
    DPO token rows of preference pairs that carry ``step``."""
    o = algo if isinstance(algo, (Objective, PairObjective)) else REGISTRY.get((algo or "ppo").lower())
    if o is None:
        raise ValueError(f"unknown algorithm {algo!r}; known: {sorted(REGISTRY)}")
    if isinstance(o, Objective):
        return step_metrics(rows, o, step, **kw)
    pairs = dpo_pair_table(rows, extra_keys=[step], **kw)
    return dpo_step_metrics(pairs, step, o.beta, o.loss_type, o.kl_penalty, o.entropy_penalty)


def variational_uncertainty(passes: DataFrame, pos: list[str] | str = "pos", logits: str = "logits",
                            vocab_chunk: int | None = None) -> DataFrame:
    """Ensemble mean logits (one array by vocabulary entry, and their mean)
    and variance over passes, the variance averaged over the vocabulary (``var_samp`` over passes per entry, then mean).

    Long form: explode (pos, vocab) entries and aggregate with partial
    aggregates, so many passes of one position are not one task.
    """
    keys = [pos] if isinstance(pos, str) else list(pos)
    e = passes.select(*keys, F.posexplode(F.col(logits).cast("array<double>")).alias("__v", "__x"))
    per_entry = e.groupBy(*keys, "__v").agg(F.avg("__x").alias("mean_logit"),
                                           F.var_samp("__x").alias("__var"))
    return per_entry.groupBy(*keys).agg(F.avg("__var").alias("uncertainty"),
                                        F.avg("mean_logit").alias("mean_of_mean_logits"),
                                        F.count(F.lit(1)).alias("vocab"),
                                        F.transform(F.array_sort(F.collect_list(F.struct("__v", "mean_logit"))),
                                                    lambda e: e["mean_logit"]).alias("mean_logits"))


def sample_action(logits, seed_cols: list[str], seed: int = 0) -> Column:
    """Reproducible draw from softmax(logits) by the Gumbel-max trick with
    hash-derived uniforms (0-based index)."""
    def body(lp):
        key = F.concat_ws("-", *[F.col(c).cast("string") for c in seed_cols])
        g = F.transform(lp, lambda v, i: v - F.log(-F.log(uniform(F.concat(key, F.lit("-"), i.cast("string")), seed))))
        return let(g, lambda gg: F.array_position(gg, F.array_max(gg)) - 1)
    return let(log_softmax(logits), body)

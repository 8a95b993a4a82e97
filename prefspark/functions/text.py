"""Text scoring expressions (all JVM-side, no Python per row)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that must equal the reference for the same results.
FEEDBACK_PROMPT_PREFIX = "Evaluate the following response:\n"
FEEDBACK_PROMPT_SUFFIX = "\n\nProvide a score from 1-10 and brief feedback:"
DEFAULT_SCORE = 0.5          # judge text holds no integer
HELPFULNESS_WORDS = 50.0     # helpfulness = min(words / 50, 1)
HARMLESSNESS_CONST = 0.8
TRUTHFULNESS_CONST = 0.7


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def word_count(text) -> Column:
    """Number of whitespace-separated words (Python ``len(s.split())``)."""
    return F.regexp_count(_c(text), F.lit(r"\S+")).cast("int")


def feedback_prompt(response) -> Column:
    """Judge prompt built around a response."""
    return F.concat(F.lit(FEEDBACK_PROMPT_PREFIX), _c(response), F.lit(FEEDBACK_PROMPT_SUFFIX))


def first_int_score(feedback, default: float = DEFAULT_SCORE, clamp: bool = False) -> Column:
    """First run of digits in the judge's text divided by 10, else ``default``.

    Cast to double (not int) so long digit runs cannot overflow.
    """
    digits = F.regexp_extract(_c(feedback), r"\d+", 0)
    score = F.when(digits != "", digits.cast("double") / 10.0).otherwise(F.lit(default))
    score = F.coalesce(score, F.lit(default))
    if clamp:
        score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), score))
    return score


def helpfulness(response) -> Column:
    return F.least(word_count(response) / F.lit(HELPFULNESS_WORDS), F.lit(1.0))


def quality_metrics(response, harmlessness=None, truthfulness=None) -> Column:
    """``map<string,double>`` of helpfulness / harmlessness / truthfulness.

    The two constants may be replaced by caller columns.
    """
    harm = _c(harmlessness) if harmlessness is not None else F.lit(HARMLESSNESS_CONST)
    truth = _c(truthfulness) if truthfulness is not None else F.lit(TRUTHFULNESS_CONST)
    return F.create_map(F.lit("helpfulness"), helpfulness(response),
                        F.lit("harmlessness"), harm.cast("double"),
                        F.lit("truthfulness"), truth.cast("double"))


def weights_map(weights: dict[str, float]) -> Column:
    if not weights:
        return F.create_map().cast("map<string,double>")
    kv = []
    for k, v in weights.items():
        kv += [F.lit(k), F.lit(float(v))]
    return F.create_map(*kv)


def multi_objective_reward(metrics, weights: dict[str, float]) -> Column:
    """``sum(w * m)`` over metric names present in both the weights and the map."""
    m = _c(metrics)
    total = F.lit(0.0)
    for k, w in weights.items():
        total = total + F.coalesce(F.lit(float(w)) * m.getItem(k), F.lit(0.0))
    return total


def _unit(key: Column, seed: int) -> Column:
    # uniform in (0, 1) from a 64-bit hash: reproducible under any partitioning
    return (F.pmod(F.xxhash64(key, F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / float(1 << 52)


def placeholder_reward(key, seed: int = 0) -> Column:
    """Standard-normal stand-in reward when no reward model is given
    (Box-Muller over two hash-derived uniforms of the row key)."""
    k = _c(key)
    u1, u2 = _unit(k, seed), _unit(k, seed + 1)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * 3.141592653589793) * u2)


def compute_rewards(reward=None, weights: list[float] | None = None, key=None, seed: int = 0) -> Column:
    """Reward column (a model's score, or the placeholder when ``reward`` is
    None) scaled by the mean of the weights."""
    r = _c(reward) if reward is not None else placeholder_reward(key, seed)
    return weighted_reward(r, weights)


def weighted_reward(reward, weights: list[float] | None) -> Column:
    """``r * sum(w)/len(w)`` when weights are given and their total is positive."""
    r = _c(reward)
    if not weights:
        return r
    total = float(sum(weights))
    if total <= 0:
        return r
    return r * F.lit(total / len(weights))


def objective_vector(label, objectives: list[str]) -> Column:
    """One-hot ``array<double>`` for an objective label (P17)."""
    lab = _c(label)
    return F.array(*[F.when(lab == o, 1.0).otherwise(0.0) for o in objectives])

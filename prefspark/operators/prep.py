"""Preference-data preparation: length filter, dedup, cap, split, curriculum,
conversation pairing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.functions.text import word_count
from prefspark.functions.vec import let
from prefspark.plans.recurrence import bounded_frame, halo_window
from prefspark.plans.scan import STEP_WIDTH, Running, running

# Fixed defaults (preparation section of the run configs).
MIN_WORDS = 10
MAX_WORDS = 512
VALIDATION_RATIO = 0.1
CURRICULUM_BOUNDS = (0.25, 0.5, 0.75, 1.0)


def length_filter(df: DataFrame, text_col: str = "text", min_words: int = MIN_WORDS,
                  max_words: int = MAX_WORDS) -> DataFrame:
    """Keep rows with ``min <= words <= max`` (inclusive); a NULL text passes.

    The word count is bound once (``let``): a plain BETWEEN would run the
    regex over the whole text twice.
    """
    inside = let(word_count(text_col), lambda n: n.between(min_words, max_words))
    return df.filter(F.col(text_col).isNull() | inside)


def dedup_first(df: DataFrame, key: str = "text", order: str = "id") -> DataFrame:
    """Keep the first row (smallest ``order``) for each distinct ``key``.

    One aggregate with map-side partial ``min_by``: a key repeated in a third
    of all rows collapses to one row per task before the shuffle, and the key
    travels through the shuffle once (it is not repeated in the kept struct).
    Rows are grouped by 64-bit hash plus exact text equality.
    """
    others = [c for c in df.columns if c != key]
    # group by (64-bit hash, text): the sort-based aggregate orders by the
    # hash first and compares whole texts only between real copies
    kept = (df.groupBy(F.xxhash64(key).alias("__h"), key)
              .agg(F.min_by(F.struct(*others), F.col(order)).alias("__first")))
    return kept.select(*[F.col(key) if c == key else F.col(f"__first.{c}").alias(c)
                         for c in df.columns])


def cap_first(df: DataFrame, n: int | None, order: str = "id") -> DataFrame:
    """First ``n`` rows in input (``order``) order; ``None`` keeps all."""
    if n is None:
        return df
    return df.orderBy(order).limit(int(n))


def prepare_samples(df: DataFrame, *, text_col: str = "text", order: str = "id",
                    filter_by_length: bool = True, min_words: int = MIN_WORDS,
                    max_words: int = MAX_WORDS, remove_duplicates: bool = True,
                    max_samples: int | None = None) -> DataFrame:
    """Filter -> dedup -> cap, each step gated by its flag."""
    out = df
    if filter_by_length:
        out = length_filter(out, text_col, min_words, max_words)
    if remove_duplicates:
        out = dedup_first(out, text_col, order)
    return cap_first(out, max_samples, order)


def md5_split_key(id_col: str = "id", cutoff: str = "1a") -> Column:
    """Portable stable split test: validation when the first two hex digits of
    ``md5(id)`` sort below ``cutoff`` (``'1a'`` = 26/256, about 10%).  Any
    engine with md5 computes the same membership."""
    return F.substring(F.md5(F.col(id_col).cast("string")), 1, 2) < F.lit(cutoff)


def split_flag(df: DataFrame, key: Column | None = None, ratio: float = VALIDATION_RATIO,
               id_col: str = "id", seed: int = 42, name: str = "split") -> DataFrame:
    """Stable train/validation split as a column.

    By default a row is in validation when ``pmod(xxhash64(id, seed), 1000)``
    falls below ``ratio * 1000``; ``key`` overrides the membership test.
    """
    if key is None:
        key = F.pmod(F.xxhash64(F.col(id_col), F.lit(seed)), F.lit(1000)) < int(round(ratio * 1000))
    return df.withColumn(name, F.when(key, F.lit("validation")).otherwise(F.lit("train")))


def curriculum_stage(df: DataFrame, difficulty: str, bounds=CURRICULUM_BOUNDS,
                     name: str = "stage") -> DataFrame:
    """Stage = 1-based index of the first bound >= percent rank of ``difficulty``.

    Percent rank is computed without a global window: count rows per distinct
    difficulty, take a skew-safe running count over the distinct values, and
    join the rank back on the value.
    """
    counts = df.groupBy(difficulty).agg(F.count(F.lit(1)).alias("__n"))
    ranked = running(counts, [], [difficulty], {"__below": Running("sum", "__n", inclusive=False),
                                                "__total": Running("sum", "__n", whole=True)}).select(
        difficulty,
        F.when(F.col("__total") <= 1, F.lit(0.0))
         .otherwise(F.coalesce(F.col("__below"), F.lit(0)) / (F.col("__total") - 1))
         .alias("pct_rank"))
    stage = F.lit(None).cast("int")
    for i, b in reversed(list(enumerate(bounds, start=1))):
        stage = F.when(F.col("pct_rank") <= F.lit(float(b)), F.lit(i)).otherwise(stage)
    ranked = ranked.withColumn(name, stage)
    return df.join(ranked, on=difficulty, how="left")


def conversation_pairs(turns: DataFrame, conv: str = "conv_id", turn: str = "turn",
                       role: str = "role", text: str = "text") -> DataFrame:
    """(prompt, response, history_turns, history_chars) for every user turn
    directly followed by an assistant turn.

    The history of a turn is the beginning of its conversation's text (all
    texts joined by line ends, see :func:`conversation_texts`), so it is given
    by its length and the result is linear in the conversation.  Positions come
    from a running sum and neighbours from a bounded frame, both in chunks, so
    no task holds a whole conversation."""
    chars = F.coalesce(F.char_length(text) + 1, F.lit(0)).cast("long")
    placed = running(turns.withColumn("__chars", chars), [conv], [turn], {
        "history_turns": Running("count", inclusive=False), "__start": Running("sum", "__chars", inclusive=False)}, width=STEP_WIDTH)
    placed = placed.withColumn("history_turns", F.coalesce("history_turns", F.lit(0)).cast("long"))
    ahead = halo_window([conv], "history_turns")
    both = bounded_frame(placed, [conv], "history_turns", 0, 1, {"__next_role": F.lead(role).over(ahead), "__next_text": F.lead(text).over(ahead)})
    return both.where((F.col(role) == "user") & (F.col("__next_role") == "assistant")).select(
        conv, turn, F.col(text).alias("prompt"), F.col("__next_text").alias("response"), "history_turns",
        F.greatest(F.coalesce("__start", F.lit(0)) - 1, F.lit(0)).cast("long").alias("history_chars"))


def conversation_texts(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", text: str = "text") -> DataFrame:
    """(conv, conversation): the turns' texts joined by line ends, one row per
    conversation."""
    parts = F.array_sort(F.collect_list(F.when(F.col(text).isNotNull(), F.struct(F.col(turn).alias("t"), F.col(text).alias("x")))))
    return turns.groupBy(conv).agg(F.array_join(parts["x"], "\n").alias("conversation"))


def with_history(pairs: DataFrame, texts: DataFrame, conv: str = "conv_id") -> DataFrame:
    """The pairs with their ``history`` written out (quadratic in the length
    of a conversation)."""
    cut = F.expr("substring(conversation, 1, int(history_chars))")
    return pairs.join(texts, conv).withColumn("history", cut).drop("conversation", "history_chars")


def select_keys(df: DataFrame, prompt: str = "prompt", chosen: str = "chosen",
                rejected: str = "rejected", keep: tuple = ()) -> DataFrame:
    """Pick the prompt / chosen / rejected columns of a preference dataset by
    the configured key names (completion format); the conversation format goes
    through :func:`conversation_pairs`."""
    return df.select(*keep, F.col(prompt).alias("prompt"), F.col(chosen).alias("chosen"),
                     F.col(rejected).alias("rejected"))

"""Benchmark decontamination by winnowing, in DataFrame functions only.

Fingerprints of a text: hash all runs of GRAM words, keep the minimum of every
SLIDE consecutive hashes.  A shared span of GRAM + SLIDE - 1 = WINDOW words
holds a full slide, so both sides keep the same fingerprint from it: every
shared window meets in the join of fingerprints.  A match fixes a diagonal
(document place minus item place); it is extended over the whole item, word by
word, and the windows that agree entirely are hits, so hash collisions can't
add any.  Items shorter than a window are their own single run of words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from prefspark.llm.common import saved

WINDOW = 13
GRAM, SLIDE = 8, 6  # GRAM + SLIDE - 1 == WINDOW
#: fingerprints keep their place in the low bits (2**27 words don't fit a row of Spark's)
PLACE_BITS = 27
PLACE = (1 << PLACE_BITS) - 1

_AZ = ("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: bytes that aren't 0-9, a-z or beyond ASCII separate words
_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Lower-cased words; null has none."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), *_AZ), _SPLIT), lambda w: w != "")


def _shifted(name: str, by: int) -> str:
    # slice() starts at 1 and must not start beyond the end
    return f"slice({name}, {by + 1}, greatest(size({name}) - {by}, 0))"


def _runs(df: DataFrame, of: str, length: int, out: str) -> DataFrame:
    """Hashes of all runs of ``length`` entries of array ``of``."""
    n = f"greatest(size({of}) - {length - 1}, 0)"
    if length == 8:  # three doubling steps instead of eight look-ups per run
        df = df.withColumn("_g2", F.expr(f"zip_with({of}, {_shifted(of, 1)}, (x, y) -> xxhash64(x, y))"))
        df = df.withColumn("_g4", F.expr(f"zip_with(_g2, {_shifted('_g2', 2)}, (x, y) -> xxhash64(x, y))"))
        df = df.withColumn(out, F.expr(f"slice(zip_with(_g4, {_shifted('_g4', 4)}, (x, y) -> xxhash64(x, y)), 1, {n})"))
        return df.drop("_g2", "_g4")
    return df.withColumn(out, F.expr(
        f"case when {n} = 0 then cast(array() as array<bigint>) "
        f"else transform(sequence(1, {n}), i -> xxhash64(slice({of}, i, {length}))) end"))


def _placed(name: str) -> str:
    return f"transform({name}, (x, i) -> (x & {~PLACE}) | cast(i as bigint))"


def fingerprints(df: DataFrame, short: list[int]) -> DataFrame:
    """Add ``fps``: placed fingerprints of column ``words``, with a tag for
    the run length (0: winnowed); ``short`` lists the item lengths below the
    window."""
    df = df.withColumn("_h", F.expr("transform(words, w -> xxhash64(w))"))
    df = _runs(df, "_h", GRAM, "_g").withColumn("_g", F.expr(_placed("_g")))
    df = df.withColumn("_m2", F.expr(f"zip_with(_g, {_shifted('_g', 1)}, (x, y) -> least(x, y))"))
    df = df.withColumn("_m4", F.expr(f"zip_with(_m2, {_shifted('_m2', 2)}, (x, y) -> least(x, y))"))
    # the windows of four that start two later complete a slide of six
    df = df.withColumn("_m6", F.expr(f"zip_with(_m4, {_shifted('_m4', 2)}, (x, y) -> least(x, y))"))
    kinds = [F.expr("transform(array_distinct(_m6), x -> struct(0 as run, x as fp))")]
    for length in short:
        df = _runs(df, "_h", length, f"_s{length}")
        kinds.append(F.expr(f"transform({_placed(f'_s{length}')}, x -> struct({length} as run, x as fp))"))
    return df.withColumn("fps", F.concat(*kinds)).drop("_h", "_g", "_m2", "_m4", "_m6", *(f"_s{x}" for x in short))


def _exploded(df: DataFrame, *keep: str) -> DataFrame:
    # outer: a plain explode would copy the whole expression of fps into a filter
    return df.select(*keep, F.explode_outer("fps").alias("f")).where("f is not null").select(
        *keep, F.col("f.run").alias("run"), F.col("f.fp").bitwiseAND(F.lit(~PLACE)).alias("hash"),
        F.col("f.fp").bitwiseAND(F.lit(PLACE)).alias("place"))


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", item_col: str = "item_id",
                  text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated, hits,
    text_hash) for every row of ``docs``; ``hits`` holds the hit words' places
    as runs (start, length), ``text_hash`` is xxhash64 of the text.

    A window is WINDOW consecutive words of an item (the whole item if it has
    fewer); a word is hit inside any occurrence of a window.  ``contaminated``:
    n_hit > 0 and 20 n_hit >= n_words.  Null or wordless texts have no words
    and no hits, and such items no windows.  An item without id hits words like
    any other, but is neither counted nor listed.  Rows with equal ids and texts
    get equal results; an empty benchmark hits nothing.
    """
    spark = docs.sparkSession
    items = saved(bench.select(F.col(item_col).alias("item_id"), words(F.col(text_col)).alias("words"))
                  .where("size(words) > 0").distinct(), "decontam-items")
    sizes = items.select(F.least(F.size("words"), F.lit(WINDOW)).alias("n")).distinct()
    short = sorted(r["n"] for r in sizes.where(F.col("n") < WINDOW).collect())  # 12 lengths at most
    item_fps = fingerprints(items, short)
    item_fps = _exploded(item_fps, "item_id", "words").where(
        (F.col("run") == 0) & (F.size("words") >= WINDOW) | (F.col("run") == F.size("words")))
    item_fps = saved(item_fps.select("item_id", "run", "hash", F.col("place").alias("item_place")), "decontam-item-fps")

    base = docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
                       F.col(text_col).alias("text"))
    worded = base.select("doc_id", "text_hash", words(F.col("text")).alias("words"))
    # item_fps was written, so the planner broadcasts it only at a measured size
    found = _exploded(fingerprints(worded, short), "doc_id", "text_hash").join(item_fps, ["run", "hash"])
    lines = saved(found.select("doc_id", "text_hash", "item_id", (F.col("place") - F.col("item_place")).alias("shift"))
                  .distinct(), "decontam-diagonals")

    key = ["doc_id", "text_hash"]
    same = [worded[c].eqNullSafe(lines[c]) for c in key]
    both = lines.join(worded.withColumnRenamed("words", "dw"), same).select(
        lines["doc_id"], lines["text_hash"], "item_id", "shift", "dw").join(
        items.withColumnRenamed("words", "iw").withColumn("_i", F.col("item_id")).drop("item_id"),
        F.col("item_id").eqNullSafe(F.col("_i")))
    # places of the item that agree with the document on this diagonal
    agree = F.expr("transform(iw, (w, i) -> coalesce(get(dw, cast(i + shift as int)) = w, false))")
    width = f"least({WINDOW}, size(iw))"
    both = both.withColumn("eq", agree).withColumn("starts", F.expr(
        f"filter(sequence(0, size(iw) - {width}), i -> forall(slice(eq, i + 1, {width}), x -> x))"))
    hits = both.where("size(starts) > 0").select(*key, "item_id", F.explode_outer(F.expr(
        f"array_distinct(flatten(transform(starts, i -> sequence(i + shift, i + shift + {width} - 1))))")).alias("place"))
    hits = saved(hits.distinct(), "decontam-hits")
    places = hits.select(*key, "place").distinct().groupBy(*key).agg(
        F.count("*").alias("n_hit"), F.array_sort(F.collect_list("place")).alias("p"))
    # runs of consecutive places
    places = places.withColumn("first", F.expr("filter(p, (x, i) -> i = 0 or p[i - 1] < x - 1)")).withColumn(
        "last", F.expr("filter(p, (x, i) -> i = size(p) - 1 or p[i + 1] > x + 1)")).select(
        *key, "n_hit", F.expr("zip_with(first, last, (a, b) -> struct(a as start, b - a + 1 as length))").alias("hits"))
    named = hits.select(*key, F.col("item_id").cast("string").alias("i")).distinct().groupBy(*key).agg(
        F.count("i").alias("n_items"), F.array_join(F.array_sort(F.collect_list("i")), ",").alias("items"))
    named = named.toDF("_doc_id", "_text_hash", "n_items", "items")
    found = places.join(named, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key]).drop(*key)
    counted = worded.select(*key, F.size("words").cast("long").alias("n_words"))
    n_hit = F.coalesce("n_hit", F.lit(0)).cast("long")
    return counted.join(found, [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in key], "left").select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"),
        ((n_hit > 0) & (n_hit * 20 >= F.col("n_words"))).alias("contaminated"), "hits", "text_hash")

"""The corpus pipeline: language ID, near-duplicates, benchmark
decontamination, secret scan and packing, each stage on all that the one
before kept.

Rows are told apart by (doc_id, hash of the text), so null and repeated ids
are judged by their own text.  Columns beyond those of ``documents`` pass
through all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from prefspark.llm import decontam, jaccard, langid, packing, secrets
from prefspark.llm.common import saved, table


#: bits of the filter that tells most kept rows without a shuffle (8 MB, the
#: bound of its broadcast), and of one of its rows
FILTER_BITS, ROW_BITS = 1 << 26, 1 << 15


def _without(docs: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """Rows of ``docs`` not named in ``gone`` (doc_id, text_hash).

    A bitmap of hashed keys, of fixed size and so safe to broadcast, shows of
    most rows that they stay; their texts don't move.  Only rows whose bit is
    set (those to go and a few others; more as the bitmap fills) are shuffled
    and compared exactly."""
    key = F.pmod(F.xxhash64("_id", "_hash"), F.lit(FILTER_BITS))
    gone = saved(gone.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).distinct(), name)
    bits = gone.select(key.alias("_k")).groupBy(F.floor(F.col("_k") / ROW_BITS).alias("_row")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.pmod("_k", F.lit(ROW_BITS)) + 1)).alias("_bits"))
    bits = saved(bits, f"{name}-bits")
    # others' columns go by place, so none can clash
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    doc_id, text = (F.col(f"c{docs.columns.index(c)}") for c in ("doc_id", "text"))
    keyed = plain.withColumns({"_id": doc_id.cast("long"), "_hash": F.xxhash64(text)})
    keyed = keyed.withColumn("_k", key).withColumn("_row", F.floor(F.col("_k") / ROW_BITS))
    keyed = keyed.join(F.broadcast(bits), "_row", "left")
    bit = F.pmod("_k", F.lit(ROW_BITS))
    byte = F.conv(F.hex(F.substr("_bits", (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    maybe = F.coalesce(F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(bit, F.lit(8)))), F.lit(2)) == 1, F.lit(False))
    keyed = keyed.withColumn("_maybe", maybe)
    same = F.col("_id").eqNullSafe(F.col("g_id")) & (F.col("_hash") == F.col("g_hash"))
    # always the same way of joining, whatever the size
    left = keyed.where("_maybe").join(gone.toDF("g_id", "g_hash").hint("merge"), same, "left_anti")
    both = keyed.where("not _maybe").select(*plain.columns).union(left.select(*plain.columns))
    return both.toDF(*docs.columns)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts that are null, have no letter or look like none of the
    languages of the labelled rows: the likeness to the nearest landmark is
    under half of what the first percentile of the labelled sample has.  Short
    texts and unlearned languages close to a learned one may pass.  Without labelled rows all of those with
    letters stay."""
    model = langid.train(docs)
    if not model.classes:
        return docs.where(F.col("text").rlike(r"\p{L}"))
    # other columns go by place, so none can clash with the prediction's
    plain = docs.toDF(*[c if c == "text" else f"c{i}" for i, c in enumerate(docs.columns)])
    out = langid.predict(plain, model, keep_text=True)
    out = out.where((F.col("lang_pred") != "und") & (F.col("likeness") >= model.floor))
    return out.select(*[F.col("text" if c == "text" else f"c{i}").alias(c) for i, c in enumerate(docs.columns)])


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the row with the smallest id of each group of near-duplicates;
    one of a group's rows that share this id; and rows of groups without any
    id.  Rows with the same id in different groups all stay."""
    groups = saved(jaccard.jaccard_groups(docs), "pipeline-groups")
    named = groups.where("component_id is not null")
    kept = _without(docs, named.where("doc_id is null or doc_id <> component_id"), "pipeline-copies")
    again = saved(named.where("doc_id = component_id").groupBy("doc_id").count().where("count > 1").select("doc_id"), "pipeline-repeated")
    if again.isEmpty():
        return kept
    first = named.where("doc_id = component_id").join(again, "doc_id", "left_semi")
    # without shingles a row is alike only to rows of the same text
    first = saved(first.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"),
                               F.col("group_key").alias("_group"), F.when(F.col("group_key").isNull(), F.col("text_hash")).alias("_alone")).distinct(),
                  "pipeline-firsts")
    same = (kept["doc_id"] == F.col("_id")) & F.xxhash64(kept["text"]).eqNullSafe(F.col("_hash"))
    once = kept.join(first, same).dropDuplicates(["_id", "_group", "_alone"]).select(*docs.columns)
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).union(once)


def winnowing_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops texts of which a twentieth or more are hit words."""
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    return _without(docs, found.where("contaminated"), "pipeline-contaminated")


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Masks the secrets found; the documents stay."""
    out = secrets.redact(docs, secrets.scan(docs))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs all texts into sequences, one row per piece."""
    import public_tokenizers
    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json")).drop("row", "ids")


STAGES = [
    ("language_id", language_id),
    ("ngram_jaccard_join", ngram_jaccard_join),
    ("winnowing_decontamination", winnowing_decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]

#: learned stages can't be expressed in SQL; tests/llm checks the rows instead
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to ``documents``; each result is written and reread."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)

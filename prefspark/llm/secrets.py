"""Secret scan: candidate strings, and a random forest that removes false
positives, in DataFrame functions and Spark ML only.

Candidates are runs of 16 or more key characters, JWTs with their dots, and
shorter values with a digit that are assigned to a key word.  Features: length and
character shares, runs of character kinds, mean log probability of the
character transitions, share covered by dictionary words (both learned from
the words of all documents), the path the document comes from and the words
next to the candidate.  The forest is fitted on labelled findings.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from prefspark.llm.common import sample_rows, saved

_KEYS = r"(?i:secret|token|passw(?:or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|credential|private[_-]?key|auth)"
_JWT = r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{6,}(?:\.[A-Za-z0-9_-]{6,})?"
#: 6 or more characters, one a digit, right after a key word's assignment; the
#: first look-behind is cheap and fails at most places
_SHORT = (r"(?<=[=:>]\s{0,2}[\x22\x27]?)(?<=" + _KEYS + r"[\w-]{0,16}[\x22\x27]?\s{0,2}(?:=>|:=|[:=])\s{0,2}[\x22\x27]?)"
          r"(?=[^\s\x22\x27,;]{0,64}[0-9])[A-Za-z0-9+/_!@#$%^&*~-]{6,}")
CANDIDATE = _JWT + r"|[A-Za-z0-9+/_-]{16,}={0,2}|" + _SHORT
#: formats that are secrets whatever stands before them
KNOWN = (r"^((AKIA|ASIA)[A-Z0-9]{16}|gh[pousr]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|[sr]k_(live|test)_[A-Za-z0-9]{16,}"
         r"|xox[abprs]-[A-Za-z0-9-]{10,}|glpat-[A-Za-z0-9_-]{20,}|AIza[A-Za-z0-9_-]{35}|npm_[A-Za-z0-9]{36}|" + _JWT + ")$")
#: a dictionary word occurs in this many documents
DICTIONARY_DOCS = 3
#: the fit reads at most this many findings of each label
TRAIN_PER_LABEL = 5000
TREES, DEPTH, SEED = 20, 6, 7

_KEY_WORD = (r"(?i)(secret|token|passw(or)?d|passphrase|pwd|api[_-]?key|access[_-]?key|credential|private[_-]?key|auth)"
             r"[\w-]*[\"']?\s*(=>|:=|[:=])\s*[\"']?$")
FEATURES = ["length", "digits", "uppers", "lowers", "runs", "transition", "dictionary", "path_depth", "path_sample",
            "key_word", "assigned", "quoted", "prose_before", "prose_after", "known"]


def findings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """All candidates of whole texts, saved: (fid, doc_id, text_hash, start,
    candidate, before, after, path); ``start`` counts characters from 0.
    Null and empty texts have none; rows with equal ids keep apart rows."""
    path = F.col(path_col).cast("string") if path_col in docs.columns else F.lit(None).cast("string")
    t = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), path.alias("path"),
                    F.xxhash64(F.col(text_col)).alias("text_hash"), F.monotonically_increasing_id().alias("row"))
    t = t.withColumn("pieces", F.split("text", CANDIDATE, -1)).withColumn("cands", F.expr(f"regexp_extract_all(text, r'{CANDIDATE}', 0)"))

    def at(k, of="pieces", side="right", n=48):
        return f"coalesce({side}(try_element_at({of}, if(i + {k + 1} > 0, i + {k + 1}, 99999999)), {n}), '')"
    # the text around by place, over the neighbouring candidates (of 6 characters or more)
    before = "right(concat(" + ", ".join(f"{at(-k)}, {at(-k, 'cands')}" for k in range(8, 0, -1)) + f", {at(0)}), 48)"
    after = "left(concat(" + ", ".join(f"{at(k, side='left', n=24)}, {at(k, 'cands', 'left', 24)}" for k in range(1, 5)) + "), 24)"
    t = t.withColumn("found", F.expr(f"""transform(cands, (c, i) -> struct(
        c as candidate, length(pieces[i]) as gap, {before} as before, {after} as after))"""))
    # outer: a plain posexplode would evaluate both expressions again in a filter
    t = t.select("doc_id", "text_hash", "path", "row", F.posexplode_outer("found").alias("pos", "f")).where("f is not null")
    t = t.select("doc_id", "text_hash", "path", "row", "pos", "f.*")
    # the candidates of one text, which fit a task as the text does
    w = Window.partitionBy("row").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    t = t.withColumn("start", F.sum(F.col("gap") + F.length("candidate")).over(w) - F.length("candidate"))
    return saved(t.drop("row", "pos", "gap").withColumn("fid", F.monotonically_increasing_id()), "secret-findings")


def dictionary(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """(word, docs): lower-cased words of 3 to 24 letters in enough documents."""
    words = F.array_distinct(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), r"[^\p{L}]+"))
    each = docs.select(F.explode_outer(words).alias("word")).where("length(word) between 3 and 24")
    return saved(each.groupBy("word").agg(F.count("*").alias("docs")).where(F.col("docs") >= DICTIONARY_DOCS), "secret-words")


def _pairs(text) -> F.Column:
    """All two neighbouring characters of the digit-folded text."""
    return F.regexp_extract_all(F.regexp_replace(F.lower(text), "[0-9]", "0"), F.lit("(?=(..))"), F.lit(1))


def _per_candidate(found: DataFrame, words: DataFrame) -> DataFrame:
    """(candidate, transition, dictionary) of the distinct candidates."""
    cands = found.select("candidate").distinct()
    pairs = words.select("docs", F.explode_outer(_pairs(F.concat(F.lit(" "), "word", F.lit(" ")))).alias("pair"))
    pairs = pairs.groupBy("pair").agg(F.sum("docs").alias("c"))
    first = F.substring("pair", 1, 1)
    logp = F.log10(F.col("c") / F.sum("c").over(Window.partitionBy(first)))  # one row per pair of letters
    table = saved(pairs.withColumn("logp", logp).select("pair", "logp"), "secret-pairs")
    steps = cands.select("candidate", F.explode_outer(_pairs(F.col("candidate"))).alias("pair")).join(table, "pair", "left")
    steps = steps.groupBy("candidate").agg(F.avg(F.coalesce("logp", F.lit(-6.0))).alias("transition"))
    parts = cands.select("candidate", F.explode_outer(F.regexp_extract_all(F.lower("candidate"), F.lit(r"\p{L}{3,}"), F.lit(0))).alias("word"))
    cover = parts.join(words.select("word"), "word").groupBy("candidate").agg(F.sum(F.length("word")).alias("covered"))
    return steps.join(cover, "candidate", "left").select(
        "candidate", "transition", (F.coalesce("covered", F.lit(0)) / F.length("candidate")).alias("dictionary"))


def with_features(found: DataFrame, docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Add the forest's features to saved findings; the dictionary and the
    transitions come from all texts of ``docs``."""
    per = _per_candidate(found, dictionary(docs, text_col))
    n = F.length("candidate")

    def share(chars: str):
        return (n - F.length(F.regexp_replace("candidate", chars, ""))) / n
    path = F.coalesce("path", F.lit(""))
    return found.join(per, "candidate").select(
        found["*"], n.cast("double").alias("length"), share("[0-9]").alias("digits"), share("[A-Z]").alias("uppers"),
        share("[a-z]").alias("lowers"),
        (F.size(F.regexp_extract_all("candidate", F.lit("[A-Z]+|[a-z]+|[0-9]+|[^A-Za-z0-9]+"), F.lit(0))) / n).alias("runs"),
        "transition", "dictionary", (F.size(F.split(path, "/")) - 1).cast("double").alias("path_depth"),
        path.rlike(r"(?i)test|example|sample|fixture|docs?/").cast("double").alias("path_sample"),
        F.col("before").rlike(_KEY_WORD).cast("double").alias("key_word"),
        F.col("before").rlike(r"[:=]\s*[\"']?$").cast("double").alias("assigned"),
        F.col("before").rlike(r"[\"']$").cast("double").alias("quoted"),
        F.col("before").rlike(r"(^|\s)\p{L}+[,.]?\s$").cast("double").alias("prose_before"),
        F.col("after").rlike(r"^[,.]?\s\p{L}+(\s|$)").cast("double").alias("prose_after"),
        F.col("candidate").rlike(KNOWN).cast("double").alias("known"))


def weak_label():
    """Label of a finding from its format alone: 1 for known formats, and for
    strings with digits that are assigned to a key word; 0 otherwise."""
    named = (F.col("key_word") > 0) & (F.col("digits") > 0) & (F.col("dictionary") < 0.5)
    return ((F.col("known") > 0) | named).cast("int")


def train(featured: DataFrame, label_col: str = "label"):
    """Random forest on at most TRAIN_PER_LABEL findings of each label (0, 1);
    None if only one label occurs.  ``featured``: saved, with ``fid``."""
    chosen = sample_rows(featured.where(F.col(label_col).isin(0, 1)), label_col, TRAIN_PER_LABEL, key="fid")
    rows = featured.join(chosen.select("fid"), "fid").select("fid", F.col(label_col).cast("double").alias("y"), *FEATURES)
    rows = saved(rows.orderBy("fid").coalesce(1), "secret-train")  # a bounded sample in a fixed order
    if rows.select("y").distinct().count() < 2:
        return None
    rows = VectorAssembler(inputCols=FEATURES, outputCol="_x").transform(rows)
    return RandomForestClassifier(featuresCol="_x", labelCol="y", probabilityCol="_p", rawPredictionCol="_r", predictionCol="_y",
                                  numTrees=TREES, maxDepth=DEPTH, seed=SEED).fit(rows)


def score(featured: DataFrame, model, default: float = 0.0) -> DataFrame:
    """Add (probability, is_secret); without a model all get ``default``.
    A known format is a secret whatever the forest says."""
    if model is None:
        out = featured.withColumn("probability", F.lit(float(default)))
    else:
        x = VectorAssembler(inputCols=FEATURES, outputCol="_x").transform(featured)
        out = model.transform(x).withColumn("probability", vector_to_array("_p")[1]).drop("_x", "_p", "_r", "_y")
    return out.withColumn("is_secret", (F.col("probability") >= 0.5) | (F.col("known") > 0))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source") -> DataFrame:
    """Findings with features, probability and is_secret, trained on the
    weakly labelled findings of ``docs`` itself.  If all findings have the
    same label, it is the answer for all."""
    found = findings(docs, id_col, text_col, path_col)
    featured = saved(with_features(found, docs, text_col).withColumn("label", weak_label()), "secret-features")
    model = train(featured)
    default = 0.0 if model is not None else (featured.agg(F.max("label")).first()[0] or 0.0)
    return score(featured, model, default)


def redact(docs: DataFrame, scanned: DataFrame, id_col: str = "doc_id", text_col: str = "text", mask: str = "<SECRET>") -> DataFrame:
    """``docs`` with every found secret replaced by ``mask`` at its place; the
    same characters elsewhere in the text stay."""
    names = docs.columns
    bad = saved(scanned.where("is_secret").groupBy(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash")).agg(
        F.sort_array(F.collect_set(F.struct(F.col("start").cast("int").alias("start"), F.length("candidate").alias("n")))).alias("_found")),
        "secret-redact")
    hit = docs[id_col].eqNullSafe(F.col("_id")) & (F.xxhash64(docs[text_col]) == F.col("_hash"))
    # the clean stretches between the places, joined by the mask
    ends = F.concat(F.transform("_found", lambda f: f["start"]), F.array(F.length(text_col)))
    starts = F.concat(F.array(F.lit(0)), F.transform("_found", lambda f: f["start"] + f["n"]))
    clean = F.array_join(F.zip_with(starts, ends, lambda a, b: F.substring(F.col(text_col), a + 1, b - a)), mask)
    out = docs.join(bad, hit, "left").withColumn(text_col, F.when(F.col("_found").isNotNull(), clean).otherwise(F.col(text_col)))
    return out.select(*names)

"""The training-data operators: brute force, round trips, held-out accuracy,
and the defined results for nulls, empty and long texts, ties, repeated rows,
empty tables and clashing columns."""

import hashlib
import math
import os
import sys
import tracemalloc
import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

import public_tokenizers  # noqa: E402
from prefspark.llm import (decontam, jaccard, langid, lm, neardup, packing, secrets, sharding, toxicity,  # noqa: E402
                           warc)
from prefspark.llm.wordhash import WINDOW, hash_words  # noqa: E402

SF = "/root/testdata/sf0.001"
VOCAB = public_tokenizers.path("word_bpe_49k.json")
PROSE = "the quick brown fox jumps over the lazy dog and then it sleeps under a large old tree near our house"
LONG = " ".join(f"w{i % 977} x{i % 31}" for i in range(40_000))
ROWS = [
    (1, PROSE, "en", "src/a"), (2, PROSE.upper(), "en", "src/a"), (3, PROSE + " today", "en", "tests/b"),
    (4, None, None, None), (5, "", "en", "src/a"), (6, "  \n\t ", "en", "src/a"), (7, "hi", "en", "src/a"),
    (8, "hi", "en", "src/a"), (8, "hi", "en", "src/a"), (None, "a row without an id but with words", "en", "src/a"),
    (9, LONG, "en", "src/a"), (10, "- 123 456 !!! 789", None, "src/a"), (11, "née Été ñ 東京 \x1c x y", "fr", "src/a"),
    (12, 'config token = "0123456789abcdef0123456789abcdef01234567" end', "en", "src/a"), (13, "x" * 50_000, "en", "src/a"),
]
SCHEMA = "doc_id long, text string, lang string, source string"
#: names that operators use themselves
CLASH = ["words", "fps", "row", "owner", "score", "toxic", "rid", "held", "candidate", "cell", "length", "n", "shard", "label"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for c in CLASH:
        df = df.withColumn(c, F.lit(c))
    return df


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df):
    return [tuple(r) for r in df.collect()]


def key(r):
    return (r[0] is None, r[0] or 0, *map(str, r[1:]))


def test_hash_words_equals_split_across_windows():
    texts = ["a b", "", "a", " Ab\tb\n", "x" * (WINDOW + 5), "y " * WINDOW, "Ab"]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    h, wo = hash_words(np.frombuffer(b"".join(raw), np.uint8), off)
    got, names = {}, [w for t in texts for w in brute.words(t)]
    assert np.diff(wo).tolist() == [len(brute.words(t)) for t in texts]
    for w, x in zip(names, h.tolist()):
        assert got.setdefault(w, x) == x
    assert len(set(got.values())) == len(got)


def test_jaccard_edges(docs, none):
    want = brute.jaccard([(r[0], r[1]) for r in ROWS])
    got = sorted(rows(jaccard.jaccard_groups(docs).select("doc_id", "n_shingles", "component_id")), key=key)
    assert got == sorted([(r[0], *want[i]) for i, r in enumerate(ROWS)], key=key)
    assert rows(jaccard.jaccard_groups(none)) == []


def test_jaccard_borderline_and_large_groups(spark):
    base = [f"b{i}" for i in range(60)]
    texts = []
    for i in range(150):  # copies with one to four edits, and exact ones
        w = list(base)
        for j in range(i % 5):
            w[(7 * i + 13 * j) % 60] = f"e{i}_{j}"
        texts.append((i, " ".join(w)))
    texts += [(1000 + i, " ".join([f"q{i // 2}_{k}" for k in range(45)] + [f"z{i}"] * (i % 2) * 12)) for i in range(20)]
    want = brute.jaccard(texts)
    got = {r[0]: (r[1], r[2]) for r in rows(jaccard.jaccard_groups(spark.createDataFrame(texts, "doc_id long, text string")))}
    assert got == {doc: want[i] for i, (doc, _) in enumerate(texts)}


def test_decontamination(spark, docs, none):
    items = [(1, PROSE), (2, "hi"), (3, None), (4, "..."), (5, "jumps over the lazy dog"), (5, "jumps over the lazy dog"),
             (6, "née été")]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("words", F.lit(1))
    got = sorted(rows(decontam.contamination(docs, bench).select("doc_id", "n_words", "n_hit", "n_items", "contaminated")), key=key)
    want = []
    for r in ROWS:
        n, h, found = brute.hits(r[1], items)
        want.append((r[0], n, h, len(found), h > 0 and 20 * h >= n))
    assert got == sorted(want, key=key)
    assert rows(decontam.contamination(none, bench)) == []
    assert all(r["n_hit"] == 0 for r in decontam.contamination(docs, bench.where("false")).collect())


def test_decontamination_spans(spark):
    out = decontam.contamination(spark.createDataFrame([(1, "q " + PROSE + " r")], "doc_id long, text string"),
                                 spark.createDataFrame([(1, PROSE)], "item_id long, text string")).first()
    assert [tuple(x) for x in out["hits"]] == [(1, len(PROSE.split()))]


@pytest.mark.parametrize("size,limit", [(4096, 512), (16, 2)])
def test_packing_round_trip(docs, none, size, limit):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(VOCAB)
    packed = packing.pack_documents(docs, VOCAB, size=size, limit=limit, with_ids=True)
    got = packed.toPandas()
    place = got.sort_values(["sequence_id", "offset"])
    assert (place.groupby("sequence_id").length.cumsum() - place.length == place.offset).all()
    assert place.groupby("sequence_id").length.sum().max() <= size
    seqs = {r["sequence_id"]: bytes(r["ids"]) for r in packing.sequences(packed).collect()}
    texts = sorted([tok.encode(r[1] or "", add_special_tokens=False).ids + [1] for r in ROWS])
    back = []
    for _, g in got.groupby("row"):
        g = g.sort_values("piece")
        ids = b"".join(seqs[s][4 * o:4 * (o + n)] for s, o, n in zip(g.sequence_id, g.offset, g.length))
        assert [zlib.crc32(seqs[s][4 * o:4 * (o + n)]) for s, o, n in zip(g.sequence_id, g.offset, g.length)] == g.ids_crc32.tolist()
        back.append(np.frombuffer(ids, "<u4").tolist())
    assert sorted(back) == texts
    assert rows(packing.pack_documents(none, VOCAB)) == []


def test_open_bins_take_the_best_fit():
    bins = packing.OpenBins(10, 2)
    assert [bins.place(n) for n in (6, 7, 3, 4, 9, 5, 1)] == [(0, 0), (1, 0), (1, 7), (0, 6), (2, 0), (3, 0), (2, 9)]
    for n in (6, 5, 4):
        bins.place(n)
    assert bins.count <= 2


@pytest.mark.parametrize("held", ["doc_id % 3 = 0", "true", "false"])
def test_language_model(docs, none, held):
    got = sorted(rows(lm.score_texts(docs, F.expr(held))), key=key)
    flags = [{"true": True, "false": False}.get(held, r[0] is not None and r[0] % 3 == 0) for r in ROWS]
    total, want = brute.language_model([r[1] for r in ROWS], flags, lm.KAPPA, lm.BETA)
    want = sorted([(r[0], h, n, k, total, b, s) for r, h, (n, k, b, s) in zip(ROWS, flags, want)], key=key)
    for g, w in zip(got, want, strict=True):
        assert g[:5] == w[:5]
        assert math.isclose(g[5], w[5], rel_tol=1e-9, abs_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9, abs_tol=1e-9)
    assert rows(lm.score_texts(none, F.lit(False))) == []


def test_language_id(spark, docs, none):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = langid.train(real.where("doc_id % 5 <> 0"))
    out = langid.predict(real.where("doc_id % 5 = 0"), model)
    assert out.where("lang = lang_pred").count() >= 0.97 * out.count()
    got = langid.predict(docs, model)
    assert got.count() == len(ROWS)
    assert {r["doc_id"] for r in got.where("lang_pred = 'und'").collect()} == {4, 5, 6, 10}
    assert got.where("score < 0 or score > 1").isEmpty()
    empty = langid.train(none)
    assert {r["lang_pred"] for r in langid.predict(docs, empty).collect()} == {"und"}
    assert rows(langid.predict(none, model)) == []


def test_toxicity(spark, docs, none):
    real, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    some = labels.where("doc_id % 2 = 0")
    model = toxicity.train(real, some)
    assert (np.diff(model.theta) > 0).all()
    out = toxicity.score(real, model).join(labels.where("doc_id % 2 = 1").select("doc_id", F.col("toxic").alias("y")), "doc_id")
    hit, miss, wrong, fine = (out.where(f"y = {y} and toxic = {t}").count() for y, t in ((1, True), (1, False), (0, True), (0, False)))
    assert hit >= 0.75 * (hit + miss) and wrong <= 0.02 * (wrong + fine)
    assert toxicity.score(docs, model).count() == len(ROWS)
    assert rows(toxicity.score(none, model)) == []
    nothing = toxicity.train(docs, labels.where("false"))
    assert toxicity.score(docs, nothing).where("toxic").isEmpty()


def test_sharding(docs, none):
    for limit in (200, 1 << 20):
        got = sharding.assign_shards(docs, limit)
        assert sorted(r[1] for r in rows(got)) == sorted(len((r[1] or "").encode()) for r in ROWS)
        full = got.groupBy("shard").agg(F.sum("n_bytes").alias("b"), F.count("*").alias("n"))
        assert full.where(f"b > {limit} and n > 1").isEmpty()
    assert rows(sharding.assign_shards(none)) == []


def test_sharding_splits_equal_keys(spark):
    same = spark.range(300).select(F.lit(5).cast("long").alias("doc_id"), F.lit("abcdefghij").alias("text"))
    got = sharding.assign_shards(same, 500).groupBy("shard").agg(F.sum("n_bytes").alias("b"), F.max("depth").alias("d"))
    assert got.agg(F.max("b")).first()[0] <= 500 and got.agg(F.min("d")).first()[0] > sharding.KEY_BITS


def test_write_shards(spark, docs, tmp_path):
    sharding.write_shards(docs, str(tmp_path / "s"), 200)
    assert spark.read.parquet(str(tmp_path / "s")).count() == len(ROWS)
    # equal and null keys keep the limit too
    same = spark.range(400).select(F.when(F.col("id") % 2 == 0, 5).alias("doc_id"), F.lit("ten bytes!").alias("text"), "id")
    sharding.write_shards(same, str(tmp_path / "t"), 500)
    sizes = spark.read.parquet(str(tmp_path / "t")).groupBy("shard").agg(F.sum(F.octet_length("text")).alias("b"), F.count("*").alias("n")).collect()
    assert max(r["b"] for r in sizes) <= 500 and sum(r["n"] for r in sizes) == 400


def test_merkle_audit(spark):
    pages = spark.createDataFrame([(i % 40 if i else None, f"http://x/{i}", None if i == 3 else "" if i == 4 else "<p>" + "y" * i)
                                   for i in range(100)], "page_id long, url string, html string")
    replica = F.expr("case when url in ('http://x/7', 'http://x/90') then concat(html, '!') else html end")
    out = warc.fixity_audit(pages, replica)
    assert out.count() == 100 and {r["page_id"] for r in out.where("damaged").collect()} == {7, 10}
    place = out.select("file", "offset", "n_bytes").toPandas().sort_values(["file", "offset"])
    assert (place.groupby("file").n_bytes.cumsum() - place.n_bytes == place.offset).all()
    # the replica's records lie at its own offsets
    own = out.select("file", "replica_offset", "replica_bytes").toPandas().sort_values(["file", "replica_offset"])
    assert (own.groupby("file").replica_bytes.cumsum() - own.replica_bytes == own.replica_offset).all()
    assert own.replica_bytes.sum() == place.n_bytes.sum() + 2
    assert rows(warc.fixity_audit(pages.where("false"), replica)) == []


def test_merkle_audit_over_several_files(spark, monkeypatch):
    """More records than a file takes; one longer record hides none behind it."""
    monkeypatch.setattr(warc, "FILE_RECORDS", 64)
    pages = spark.range(0, 1000, 1, 7).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), F.lit("body").alias("html"))
    out = warc.fixity_audit(pages, F.expr("case when page_id % 250 = 3 then 'longer body' when page_id % 250 = 4 then 'bodY' else html end"))
    assert {r["page_id"] for r in out.where("damaged").collect()} == {i + k for i in (0, 250, 500, 750) for k in (3, 4)}
    assert out.groupBy("file").count().agg(F.max("count"), F.min("count"), F.count("*")).first()[:] == (64, 1000 % 64, 16)


def test_merkle_audit_finds_missing_records(spark):
    a = spark.range(5000).select(F.col("id").alias("ordinal"), (F.col("id") * 10).alias("offset"), F.lit(10).cast("long").alias("length"),
                                 F.sha2(F.col("id").cast("string"), 256).alias("hash"))
    b = a.where("ordinal <> 4321").withColumn("hash", F.when(F.col("ordinal") == 17, F.lit("x")).otherwise(F.col("hash")))
    assert sorted(r[0] for r in rows(warc.audit(a, b, 2))) == [17, 4321]
    assert rows(warc.audit(a, a, 2)) == []


def test_secrets(docs, none):
    found = secrets.findings(docs)
    at = {r["doc_id"]: (r["start"], r["candidate"]) for r in found.where("doc_id = 12").collect()}
    assert at == {12: (16, "0123456789abcdef0123456789abcdef01234567")}
    out = secrets.scan(docs)
    assert {r["doc_id"] for r in out.where("is_secret").collect()} == {12}
    clean = secrets.redact(docs, out)
    assert clean.columns == docs.columns and clean.count() == len(ROWS)
    assert clean.where("doc_id = 12").first()["text"] == 'config token = "<SECRET>" end'
    assert secrets.scan(none).count() == 0 and secrets.redact(none, secrets.scan(none)).count() == 0


def test_secrets_behind_long_key_names(spark):
    rng = np.random.default_rng(5)

    def made(n, chars="abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"):
        return "".join(rng.choice(list(chars), n - 1)) + "7"
    texts, want = [], []
    for _ in range(20):
        for form in ('aws_secret_access_key = "{}"', "AWS_SECRET_ACCESS_KEY={}", "my_service_password_value: {}"):
            want.append(made(40))
            texts.append("see " + form.format(want[-1]) + " there")
    for token in ("ghp_" + made(36), "sk_live_" + made(24), "eyJ" + made(20) + "." + made(30) + "." + made(40), "ASIA" + made(16, "ABCDEFGH")):
        want.append(token)
        texts.append(f"we found {token} in a log")
    want.append("hunter2x")
    texts.append("password=hunter2x and more")
    clean = ["the function compute_running_average_of_values is in src/common/helpers/strings", "the token: described below, the password is long"] * 20
    df = spark.createDataFrame(list(enumerate(texts + clean)), "doc_id long, text string")
    out = {r["doc_id"]: r["text"] for r in secrets.redact(df, secrets.scan(df)).collect()}
    assert [out[i] for i in range(len(texts))] == [t.replace(s, "<SECRET>") for t, s in zip(texts, want)]
    assert [out[len(texts) + i] for i in range(len(clean))] == clean


def test_secrets_against_planted(spark):
    real = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    planted = r"AKIA[A-Z0-9]{16}|password=[0-9a-f]{16,}|token = \"[0-9a-f]{40}"
    clean = secrets.redact(real, secrets.scan(real))
    assert real.where(F.col("text").rlike(planted)).count() > 5
    assert clean.where(F.col("text").rlike(planted)).isEmpty()
    assert clean.join(real.withColumnRenamed("text", "t"), "doc_id").where(~F.col("t").rlike(planted)).where("text <> t").isEmpty()


def test_near_duplicates(spark):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 16))
    data = []
    for i in range(900):
        v = centres[i % 40] + (0 if i % 7 == 0 else 0.2) * rng.normal(size=16)
        data.append((i, [float(x) for x in np.float32(v)], None if i == 50 else i % 2))
    data += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] * 16, 1), (2003, [None] * 16, 1), (2004, [1.0], 1), (2005, [], 1),
             (7, data[7][1], 1), (None, data[8][1], 0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").withColumn("node", F.lit(0))
    old = neardup.SHARD
    neardup.SHARD = 150
    try:
        out = neardup.near_duplicates(df)
        got = {r["vec_id"]: r for r in out.collect()}
        assert out.count() == len(data)
        assert neardup.audit_recall(df, out, every=1) >= 0.9
    finally:
        neardup.SHARD = old
    good = [d for d in data if d[0] is not None and d[0] < 2000 and d[2] is not None]
    x = np.array([d[1] for d in good])
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    lab = np.array([d[2] for d in good])
    link = ((x @ x.T) >= neardup.COSINE) & (lab[:, None] == lab)
    for i, d in enumerate(good):
        assert got[d[0]]["n_links"] <= link[i].sum() - 1
        assert got[d[0]]["kept"] == (got[d[0]]["component_id"] == d[0])
    for i in (2000, 2001, 2002, 2003, 2005, 50):
        assert got[i]["n_links"] == 0 and got[i]["component_id"] == i and got[i]["kept"]
    assert neardup.near_duplicates(df.where("false")).count() == 0


def tight_groups(groups, each, noise=0.02, seed=1):
    """``groups`` of ``each`` distinct near copies, and nothing else."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, 64))
    centres /= np.linalg.norm(centres, axis=1, keepdims=True)
    return np.repeat(centres, each, 0) + noise * rng.normal(size=(groups * each, 64))


def near_frame(spark, x):
    return spark.createDataFrame([(i, v.tolist(), 1) for i, v in enumerate(x)], "vec_id long, embedding array<double>, label int")


def exact_links(x):
    """(links, smallest row of the component) of each row, by brute force."""
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    link = (x @ x.T) >= neardup.COSINE
    comp = np.arange(len(x))
    while True:
        low = np.array([comp[row].min() for row in link])
        if (low == comp).all():
            return link.sum(1) - 1, comp
        comp = low


@pytest.mark.parametrize("groups,each", [(20, 100), (2, 1000)])
def test_near_duplicates_in_tight_groups_alone(spark, groups, each):
    x = tight_groups(groups, each)
    got = sorted(rows(neardup.near_duplicates(near_frame(spark, x))))
    links, comp = exact_links(x)
    assert [r[1] for r in got] == links.tolist() and [r[2] for r in got] == comp.tolist()


def test_near_duplicates_in_a_tight_group_above_a_shard(spark, monkeypatch):
    monkeypatch.setattr(neardup, "SHARD", 40)
    x = np.vstack([tight_groups(1, 3000), tight_groups(6, 30, seed=2)])
    nodes = near_frame(spark, x).selectExpr("vec_id as node", "embedding as vec", "label")
    cells = neardup._shards(nodes)
    assert cells.where("home").count() == len(x) and cells.count() <= 3 * len(x)
    got = sorted(rows(neardup.near_duplicates(near_frame(spark, x))))
    links, comp = exact_links(x)
    assert [r[1] for r in got] == links.tolist() and [r[2] for r in got] == comp.tolist()


def test_near_duplicates_compares_exactly_what_the_search_misses(spark, monkeypatch):
    monkeypatch.setattr(neardup, "_search", lambda x, links, start, queries: iter([(queries[:0], queries[:0])]))
    x = tight_groups(3, 40)
    got = sorted(rows(neardup.near_duplicates(near_frame(spark, x))))
    search = neardup._search_shard(pd.DataFrame({"node": range(len(x)), "home": True, "copies": 1, "vec": list(x)}))
    links, comp = exact_links(x)
    assert [r[1] for r in got] == links.tolist() and search["linked"].tolist() == links.tolist()
    assert search["peer"].tolist() == comp.tolist()


def test_pipeline_against_brute_force(spark):
    import corpus_pipeline as C
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(VOCAB)
    real = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = [(d, t) for d, t in real if any(c.isalpha() for c in t or "")]
    groups = brute.jaccard(kept)
    kept = [(d, t) for i, (d, t) in enumerate(kept) if groups[i][1] == d]
    kept = [(d, t) for d, t in kept if not (lambda n, h, _: h > 0 and 20 * h >= n)(*brute.hits(t, items))]
    import re
    planted = re.compile(r"AKIA[A-Z0-9]{16}|(?<=password=)[0-9a-f]{16,}|(?<=token = \")[0-9a-f]{40}")
    want = {d: len(tok.encode(planted.sub("<SECRET>", t), add_special_tokens=False).ids) + 1 for d, t in kept}
    got = C.run(spark, SF).groupBy("doc_id").agg(F.sum("length")).collect()
    assert {r[0]: r[1] for r in got} == want


def test_language_stage_rejects_foreign_text(spark):
    import corpus_pipeline as C
    rng = np.random.default_rng(0)
    real = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang").where(F.col("text").rlike(r"\p{L}"))
    bad = ["東京は日本の首都であり、世界最大の都市の一つです。" * 4, "Москва является столицей России и крупнейшим городом страны. " * 4, "Москва",
           "القاهرة هي عاصمة مصر وأكبر مدنها " * 4, "!!! ### 123 $$ q 99 @@ 5", "".join(rng.choice(list("bcdfghjklmnpqrstvwxz "), 300))]
    fine = ["hello there", "guten Tag", PROSE]
    more = spark.createDataFrame([(10 ** 9 + i, t, None) for i, t in enumerate(bad + fine)], "doc_id long, text string, lang string")
    got = C.language_id(spark, real.union(more), SF)
    assert {r[0] for r in got.where("lang is null").select("text").collect()} == set(fine)
    assert got.where("lang is not null").count() == real.count()


def test_pipeline_keeps_unrelated_texts_of_one_id(spark):
    import corpus_pipeline as C
    other = " ".join(f"word{i} thing{i}" for i in range(30))
    texts = [(5, PROSE), (5, other), (5, other), (5, other + " end"), (6, PROSE), (7, "short text")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted(rows(C.ngram_jaccard_join(spark, df, SF)))
    assert [g[0] for g in got] == [5, 5, 7]
    assert sorted(g[1].split()[0] for g in got) == ["short", "the", "word0"]


def test_pipeline_edges(spark, docs, none):
    import corpus_pipeline as C
    for table in (docs.withColumn("n_chars", F.length("text").cast("long")), none):
        cur = table
        for _, stage in C.STAGES[:-1]:
            cur = stage(spark, cur, SF)
            assert cur.columns == table.columns
        C.STAGES[-1][1](spark, cur, SF).count()


def test_sample_keeps_values_with_few_repeated_ids(spark):
    from prefspark.llm.common import sample_rows
    rows = spark.range(60_000).select((F.col("id") % 3).alias("doc_id"), F.lit("xx").alias("lang"))
    rows = rows.union(spark.range(100_000, 140_000).select("id", F.lit("yy")))
    got = sample_rows(rows, "lang", 300).groupBy("lang").count().collect()
    assert {r[0]: r[1] for r in got} == {"xx": 3, "yy": 300}


def test_language_of_three_repeated_ids_is_learned(spark):
    """Rows that share an id and a label count once in the fit."""
    docs = spark.range(5000).select((F.col("id") % 3).alias("doc_id"), F.lit("la").alias("lang"),
                                    F.concat(F.lit("lorem ipsum dolor sit amet "), F.col("id") % 7).alias("text"))
    docs = docs.union(spark.range(10, 60).select("id", F.lit("en"), F.lit(PROSE)))
    model = langid.train(docs)
    assert model.classes == ["en", "la"] and len(model.landmarks) == 3 + 32
    assert {r["lang_pred"] for r in langid.predict(docs.where("doc_id < 3"), model).collect()} == {"la"}


def test_both_labels_of_one_id_mean_toxic(spark):
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(0, 1)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(i, "vile awful words" if i % 2 or i == 0 else "kind and gentle words") for i in range(40)], "doc_id long, text string")
    out = {r["doc_id"]: r["toxic"] for r in toxicity.score(docs, toxicity.train(docs, labels)).collect()}
    assert out[0] and out[1] and not out[2]


@pytest.mark.parametrize("size", [1e-200, 1e160, 1e300, 5e-310])
def test_embeddings_of_extreme_lengths_link(spark, size):
    rows = [(1, [size, size / 2], 7), (2, [size, size / 2], 7), (3, [1.0, 0.5], 7), (4, [-size, size / 2], 7), (5, [0.0, 0.0], 7),
            (6, [float("inf"), 1.0], 7)]
    out = neardup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int"))
    assert {r["vec_id"]: r["n_links"] for r in out.collect()} == {1: 2, 2: 2, 3: 2, 4: 0, 5: 0, 6: 0}


def test_an_item_without_id_hits_words_but_is_not_counted(spark):
    text = " ".join(f"w{k}" for k in range(13))
    docs = spark.createDataFrame([(1, f"before {text} after"), (2, "clean words"), (3, "lone")], "doc_id long, text string")
    bench = spark.createDataFrame([(None, text), (7, text), (None, "lone")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontam.contamination(docs, bench).collect()}
    sha = {k: hashlib.sha256(v.encode()).hexdigest() for k, v in {1: "7", 2: "", 3: ""}.items()}
    assert {k: (r["n_hit"], r["n_items"], r["contaminated"], r["items_sha256"]) for k, r in got.items()} == {
        1: (13, 1, True, sha[1]), 2: (0, 0, False, sha[2]), 3: (1, 0, True, sha[3])}


def test_adjacency_lists_of_overlapping_shards_are_united(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(90, 6))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    cells = {"a": list(range(60)), "b": list(range(30, 90)), "c": [40]}
    frame = spark.createDataFrame([(c, 7 * i, x[i].tolist()) for c, rows_ in cells.items() for i in rows_],
                                  "cell string, node long, vec array<double>")
    want = {}
    for rows_ in cells.values():
        for i, near in zip(rows_, neardup._prune(x[rows_])):
            want.setdefault(7 * i, set()).update(7 * rows_[k] for k in near)
    got = {r["node"]: r["near"] for r in neardup._united(frame).collect()}
    assert {k: set(v) for k, v in got.items()} == want and all(len(v) == len(set(v)) for v in got.values())
    # a cell keeps the links between its own rows, also those that only another cell found
    part = np.arange(30, 60)
    links = neardup._graph(x[part], 7 * part, [np.array(got[7 * i]) for i in part])
    inside = {(i, j) for i in range(30) for j in range(30) if 7 * part[j] in want[7 * part[i]]}
    assert inside | {(j, i) for i, j in inside} <= {(i, int(j)) for i in range(30) for j in links[i]}


def test_secrets_are_masked_at_their_place_only(spark):
    text = "password=hunter2 then xhunter2y and order hunter27, née secret: 'q9z8-x7'\n"
    docs = spark.createDataFrame([(1, text), (2, "xhunter2y"), (3, None)], "doc_id long, text string")
    found = spark.createDataFrame([(1, 9, "hunter2", True), (1, text.index("q9z8"), "q9z8-x7", True), (1, 22, "xhunter2y", False)],
                                  "doc_id long, start long, candidate string, is_secret boolean")
    found = found.withColumn("text_hash", F.xxhash64(F.lit(text)))
    out = {r["doc_id"]: r["text"] for r in secrets.redact(docs, found).collect()}
    assert out == {1: "password=<SECRET> then xhunter2y and order hunter27, née secret: '<SECRET>'\n", 2: "xhunter2y", 3: None}


def test_packing_in_several_rounds(spark, monkeypatch):
    """Many tasks, whose open sequences are packed again: whole, gapless, and
    close to the lower bound."""
    monkeypatch.setattr(packing, "PIECES_PER_TASK", 100)
    monkeypatch.setattr(packing, "MERGE", 3)
    rng = np.random.default_rng(3)
    sizes = [int(x) for x in rng.integers(1, 900, 4000)] + [4096] * 5
    pieces = spark.createDataFrame([(i, i, 0, n) for i, n in enumerate(sizes)], "doc_id long, row long, piece int, length long").repartition(8)
    got = packing.pack_pieces(pieces, limit=16).toPandas()
    assert sorted(got["length"]) == sorted(sizes) and got["row"].is_unique
    for _, seq in got.groupby("sequence_id"):
        seq = seq.sort_values("offset")
        assert seq["offset"].tolist() == [0, *np.cumsum(seq["length"])[:-1]] and seq["length"].sum() <= 4096
    assert got["sequence_id"].nunique() <= 1.02 * sum(sizes) / 4096 + 1


def _joined(texts):
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])])


def _most_mb(run):
    """MB that ``run`` holds at its peak beyond what it found."""
    tracemalloc.start()
    try:
        run()
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_shingles_and_grams_of_a_batch_hold_little_memory():
    data, off = _joined([" ".join(f"w{(i * 7 + j) % 9973}" for j in range(400)) for i in range(1800)])
    assert off[-1] > 4_000_000
    list(jaccard.shingle_sets(data[:100], np.array([0, 100]), 5))  # the power tables stay
    assert _most_mb(lambda: [None for _ in jaccard.shingle_sets(data, off, 5)]) < 16
    few = int(np.searchsorted(off, 2_000_000))
    assert _most_mb(lambda: langid.presence(data, off[:few + 1])) < few * langid.DIM / 1e6 + 32


def test_shingles_and_grams_do_not_depend_on_slices(monkeypatch):
    texts = ["", PROSE, "x" * (WINDOW + 5) + " one two", PROSE * 3, " ", "née Été ñ 東京", "w " * 700, PROSE.upper()] * 3
    data, off = _joined(texts)
    whole = list(jaccard._shingle_sets(data, off, 5))
    grams = langid.presence(data, off)
    monkeypatch.setattr(jaccard, "HASH_BYTES", 200)
    monkeypatch.setattr(langid, "PIECE_BYTES", 97)
    parts = list(jaccard.shingle_sets(data, off, 5))
    assert len(parts) == len(texts) and all(np.array_equal(a, b) for a, b in zip(whole, parts))
    assert np.array_equal(grams, langid.presence(data, off))


def test_word_cache_ends_with_another_modules_task():
    def pieces():
        batch = pa.RecordBatch.from_pydict({"doc_id": [1], "row": [1], "text": [PROSE]})
        return [b.to_pydict() for b in packing._pieces(iter([batch]), VOCAB, 1, 4096, True)]
    first = pieces()
    assert packing.word_ids.cache_info().currsize == 1
    assert pieces() == first
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text_hash": [1], "text": [PROSE]})
    list(jaccard._catalogue(iter([batch]), 5, 0.002))
    assert packing.word_ids.cache_info().currsize == 0
    assert pieces() == first


def test_jaccard_tasks_hold_one_bucket_each(spark):
    dealt = jaccard._by_task(spark.range(150).select(F.pmod("id", F.lit(50)).cast("int").alias("bucket")), 50)
    held = dealt.groupBy(F.spark_partition_id().alias("task")).agg(F.collect_set("bucket").alias("held")).collect()
    assert len(held) == 50 and all(len(r.held) == 1 for r in held)

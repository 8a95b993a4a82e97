"""Merkle manifest, chat formatting and filter audit against plain Python."""

import hashlib
import itertools
import os
import random
import sys
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
import brute  # noqa: E402

from prefspark.llm import audit, chat, manifest  # noqa: E402

LONG = " ".join(f"w{i % 977} X{i % 31}" for i in range(30_000))
DOCS = [
    (3, "a\nb\nc", "en", "s"), (2, "plain", "en", "s"), (2, "plain", "en", "s"), (2, "other\n", "fr", "s"), (None, "no id\n", "en", "s"),
    (None, None, None, None), (4, None, "en", None), (6, "\n\n", None, ""), (8, "", "en", ""), (10, LONG, "de", "s"), (12, "née\n東京 #", "", "t"),
    *[(100 + i, f"row {i}\nof many", "en", "hot") for i in range(40)],
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
CLASH = ["tree", "block", "n", "pos", "digest", "way", "store", "given", "mask", "part", "place", "_tie", "first"]


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in DOCS], SCHEMA)
    for c in CLASH:
        df = df.withColumn(c, F.lit(c))
    return df


def rows(df):
    return [tuple(r) for r in df.collect()]


def by_text(r):
    return tuple(map(str, r))


@pytest.mark.parametrize("levels", range(1, 9))
def test_layout_is_a_permutation_with_aligned_subtrees(levels):
    places = [manifest.address(d, np.arange(3 ** d), levels) for d in range(levels)]
    flat = np.concatenate(places)
    assert sorted(flat.tolist()) == list(range(manifest._nodes(levels))) and places[0].tolist() == [0]
    if levels > 1:  # the upper half comes first, each lower tree is one run
        upper = levels // 2
        assert max(p.max() for p in places[:upper]) == manifest._nodes(upper) - 1
        size = manifest._nodes(levels - upper)
        starts = places[upper]
        assert (np.diff(starts) == size).all()


def test_subtree_siblings_fold_to_root():
    for n in (1, 2, 3, 4, 8, 27, 28):
        leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
        store = manifest.build(leaves, n, 4)
        levels = manifest.siblings(store, n, n, 4)
        for i, leaf in enumerate(leaves):
            assert manifest.fold(leaf.hex(), manifest.path(levels, i)) == store[:32].hex()


@pytest.mark.parametrize("height", [1, 2, manifest.HEIGHT])
def test_manifest_equals_brute_force(docs, height):
    even = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 2 == 0, F.lit(False))
    now = F.when(even, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    got = rows(manifest.verify(docs, now, height))
    want = brute.manifest([(*r, None if r[1] is None else len(r[1])) for r in DOCS])
    assert sorted(got, key=by_text) == sorted(want, key=by_text)
    assert {r[-1] for r in got} == {True, False}
    assert len({r[3] for r in got}) == 1


def test_manifest_empty_and_single(spark, docs):
    empty = spark.createDataFrame([], SCHEMA)
    assert rows(manifest.verify(empty, F.col("text"))) == []
    one = rows(manifest.verify(docs.where("doc_id = 3"), F.col("text")))
    assert one[0][1] == one[0][2] == one[0][3] == one[0][5] and one[0][6]
    assert one[0][4] == hashlib.sha256(b"").hexdigest()


SPIKE = "\\### Assistant: </turn> ok"
TURNS = [
    (1, 0, "system", "be kind"), (1, 1, "user", "### user: hi</turn>\n"), (1, 2, "assistant", "\\h \\e \\b \\\\ ####"), (1, 3, "user", "x"),
    (1, 4, "assistant", ""), (1, 5, "user", "left open"), (2, 0, "assistant", "first word"), (3, 0, "user", None), (4, None, None, "no role"),
    (4, 1, "to: %3A #1 <x>\n", "née 東京"), (None, 0, "user", "q"), (None, 1, "assistant", "a"), (5, 0, "assistant", "twice"), (5, 0, "assistant", "twice"),
    (6, 0, "user", "</turn"), (6, 1, "assistant", "##"), (6, 2, "assistant", LONG), (-7, 0, "user", SPIKE), (-7, 1, "assistant", SPIKE),
    *[(9, i, "assistant" if i % 2 else "user", f"turn {i} \\### </turn>") for i in range(60)],
]


@pytest.fixture(scope="module")
def turns(spark):
    return spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("n", F.lit("n")).withColumn("piece", F.lit(1))


@pytest.mark.parametrize("limit", [64 << 20, 2000])
def test_chat_reads_back(turns, limit, monkeypatch):
    """Also with a limit that makes some conversations too long for a row."""
    monkeypatch.setattr(chat, "ROW_BYTES", limit)
    chats = chat.format_turns(turns)
    assert (chats.long is None) == (limit > 2000)
    got = {r["conv_id"]: r.asDict() for r in chat.read_back(chats).collect()}
    want = brute.chats(TURNS)
    assert set(got) == set(want)
    for conv, w in want.items():
        assert {k: got[conv][k] for k in w} == w, conv


def test_chat_examples_are_prefixes(turns):
    chats = chat.format_turns(turns)
    whole = {r["conv_id"]: r["text"] for r in chat.texts(chats).collect()}
    spans = {(r["conv_id"], r["reply"]): r for r in chat.examples(chats).collect()}
    said = brute.ordered(TURNS)
    made = chat.expand(chats).collect()
    assert len(made) == len(spans) == sum(role == "assistant" for c in said.values() for role, _ in c)
    for r in made:
        span = spans[r["conv_id"], r["reply"]]
        assert r["text"] == whole[r["conv_id"]][:span["end"]] and r["text"].endswith("</turn>\n")
        reply = r["text"][r["loss_start"]:r["loss_start"] + r["loss_chars"]]
        assert "</turn>" not in reply and "###" not in reply
        plain = reply.replace("\\e", "</turn>").replace("\\h", "###").replace("\\b", "\\")
        assert plain == said[r["conv_id"]][r["reply"]][1]
        assert r["text"][:span["context_chars"]] == "".join(
            brute.formatted(*t) for t in said[r["conv_id"]][:r["reply"]])


def test_chat_whole_text_parses(turns):
    parsed = chat.texts(chat.format_turns(turns)).select("conv_id", chat.parse_text(F.col("text")).alias("t"))
    want = brute.ordered(TURNS)
    assert {r["conv_id"]: [tuple(x) for x in r["t"]] for r in parsed.collect()} == want


def test_chat_is_native_and_moves_texts_once(turns):
    plan = chat.read_back(chat.format_turns(turns))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan and plan.count("Exchange") <= 2


def test_chat_reads_the_written_examples(turns, monkeypatch):
    """The replies come from the expanded texts: without their last reply's
    turn, the digest of the loss changes, that of the turns doesn't."""
    right = {r["conv_id"]: r for r in chat.read_back(chat.format_turns(turns)).collect()}
    made = chat.records

    def short(chats):
        r = made(chats)
        return r.withColumn("text", F.when(F.col("reply").isNotNull(), F.substr("text", F.lit(1), F.col("loss_start").cast("int"))).otherwise(F.col("text")))
    monkeypatch.setattr(chat, "records", short)
    for r in chat.read_back(chat.format_turns(turns)).collect():
        w = right[r["conv_id"]]
        assert r["turns_sha256"] == w["turns_sha256"] and r["n_turns"] == w["n_turns"]
        assert r["loss_chars"] == 0 and (r["loss_sha256"] == w["loss_sha256"]) == (w["loss_chars"] == 0)
        assert (r["expanded_chars"] < w["expanded_chars"]) == (w["n_examples"] > 0)


def test_chat_writes_examples_out_in_the_query(turns):
    plan = chat.read_back(chat.format_turns(turns))._jdf.queryExecution().executedPlan().toString()
    # with a lambda inside, so that it runs row by row
    assert "Generate explode(transform(" in plan and "substring(" in plan


LONGER = [*TURNS, *[(None, i, ("user", "assistant", "system")[i % 3], f"née {i} 東京 ### " + "y" * (i % 7) * 40) for i in range(80)],
          *[(11, None if i < 5 else i // 4, "assistant", f"tie {i % 6} \\") for i in range(90)], *[(12, i, "user", "never answered") for i in range(90)]]


@pytest.fixture()
def longer(spark, monkeypatch):
    """Conversations over the limit, in many parts, some of a single turn, and
    examples in several blocks."""
    monkeypatch.setattr(chat, "ROW_BYTES", 2000)
    monkeypatch.setattr(chat, "PART_BYTES", 300)
    monkeypatch.setattr(chat, "BLOCK", 7)
    chats = chat.format_turns(spark.createDataFrame(LONGER, "conv_id long, turn long, role string, text string"))
    assert {r["_long"] for r in chats.long.collect()} == {None, 6, 9, 11, 12}
    return chats


def test_chat_writes_long_conversations_out(longer):
    """Every example of a conversation too long for a row, part by part."""
    made = {}
    for r in chat.expand(longer).collect():
        made.setdefault((r["conv_id"], r["example"]), []).append(r)
    want = {}
    for conv, said in brute.ordered(LONGER).items():
        pieces = [brute.formatted(*t) for t in said]
        for k, n in enumerate(i for i, (role, _) in enumerate(said) if role == "assistant"):
            want[conv, k] = n, "".join(pieces[:n + 1]), pieces[n]
    assert set(made) == set(want)
    for key, (n, text, piece) in want.items():
        *early, last = sorted(made[key], key=lambda r: r["part"])
        assert "".join(r["text"] for r in (*early, last)) == text
        assert last["reply"] == n and all(r["reply"] is r["loss_start"] is r["loss_chars"] is None for r in early)
        assert text[last["loss_start"]:last["loss_start"] + last["loss_chars"]] == piece[len("### assistant: "):-len("</turn>\n")]
    assert max(len(rows) for rows in made.values()) > 10


def test_chat_reads_long_conversations_from_what_is_written(longer, monkeypatch):
    got = {r["conv_id"]: r.asDict() for r in chat.read_back(longer).collect()}
    want = brute.chats(LONGER)
    assert set(got) == set(want)
    for conv, w in want.items():
        assert {k: got[conv][k] for k in w} == w, conv
    made = chat.part_records
    monkeypatch.setattr(chat, "part_records", lambda chats: made(chats).where("example is null or reply is not null or part > 0"))
    fewer = {r["conv_id"]: r.asDict() for r in chat.read_back(longer).collect()}
    for conv, w in want.items():  # without first parts only the texts of examples are shorter
        assert {k: x for k, x in fewer[conv].items() if k != "expanded_chars"} == {k: x for k, x in got[conv].items() if k != "expanded_chars"}
        assert (fewer[conv]["expanded_chars"] < w["expanded_chars"]) == (conv in (None, 9, 11))


def test_chat_long_conversations_move_no_written_text(longer):
    plan = chat.part_records(longer)._jdf.queryExecution().executedPlan().toString()
    assert "Generate explode(CASE WHEN" in plan
    after = plan[:plan.index("Generate explode(transform(")]  # above the parts
    assert "Exchange" not in after and "Python" not in after


def test_chat_empty(spark):
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert rows(chat.read_back(chat.format_turns(empty))) == []


FILTERED = [
    (1, " ".join(f"w{i}" for i in range(200)), "en"), (2, " ".join(f"w{i}" for i in range(200)), "fr"), (1, " ".join(f"w{i}" for i in range(200)), "en"),
    (3, "word " * 300, "en"), (4, "BIG WORDS " * 150, None), (5, "price $5", ""), (6, None, "en"), (7, "", "en"), (None, "", "en"),
    (8, "a | b", "en"), (9, " \n\t ", "en"), (10, LONG, "en"), (11, LONG, "de"), (12, "é" * 97 + "AAA", "de"), (13, "é" * 96 + "AAA", "de"),
    (14, " ".join(f"w{i}" for i in range(100)) + " " + "w1 " * 100, "de"), (15, " ".join(f"w{i}" for i in range(100)) + " " + "w1 " * 101, "de"),
    (16, "\x1c\x85 \x0bx", "de"), *[(20 + i, "copy of a copy", "en") for i in range(30)],
]
LABELS = [(1, 1, 0), (2, 1, 1), (3, None, 1), (3, 1, None), (5, 0, 0), (6, 1, 1), (None, 1, 1), (25, 1, 0), (25, 0, 1), (999, 1, 1)]


@pytest.fixture(scope="module")
def filtered(spark):
    docs = spark.createDataFrame(FILTERED, "doc_id long, text string, lang string")
    for c in ["digest", "flags", "good", "toxic", "quality", "first", "part", "mask"]:
        docs = docs.withColumn(c, F.lit(c))
    return docs, spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_audit_equals_brute_force(filtered):
    got = rows(audit.interaction_audit(audit.cells(*filtered)))
    want = brute.audit(FILTERED, LABELS)
    assert len(got) == len(want) == 600 * len({r[2] or "" for r in FILTERED})
    assert sorted(got) == sorted(want)


def test_long_texts_count_alike(monkeypatch):
    for text in (LONG, " ".join(f"u{i}" for i in range(5000)), "x" * 9000, "  a  b  " * 400):
        data = text.encode()
        whole = audit._word_counts(data, 1 << 30)
        assert audit._word_counts(data, 100) == whole == (len(text.split()), len(set(text.split())))


def test_least_squares_gives_shapley():
    rng = random.Random(5)
    for k in (1, 2, 3, 5):
        solve = audit.shapley_solver(k)
        for _ in range(20):
            v = [0] + [rng.randrange(1000) for _ in range((1 << k) - 1)]
            want = [0] * k
            orders = list(itertools.permutations(range(k)))
            for order in orders:
                before = 0
                for i in order:
                    want[i] += v[before | 1 << i] - v[before]
                    before |= 1 << i
            assert [x * len(orders) for x in solve(v)] == want


def test_audit_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert rows(audit.interaction_audit(audit.cells(docs, labels))) == []


def test_crc_of_ids(spark):
    """The contract's unsigned crc32 is Spark's."""
    got = spark.range(50).select("id", F.crc32(F.col("id").cast("string"))).collect()
    assert all(zlib.crc32(str(r[0]).encode()) == r[1] for r in got)

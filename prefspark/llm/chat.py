"""Chat formatting by prefix-target expansion: every assistant turn becomes an
example of its own, with all preceding turns as context and only that reply
trainable.

Every turn is formatted once, as

    ### <role>: <text></turn>\n

Control strings inside a text are written as backslash codes (a backslash as
``\\b``, ``###`` as ``\\h``, ``</turn>`` as ``\\e``), so neither marker occurs in
an escaped text, and undoing the codes in the opposite order gives the text
back whatever it holds.  Roles are percent-coded where they hold ``%``, ``:``,
``#``, ``<`` or a line end.

The examples of a conversation are prefixes of one formatted text.
:func:`expand` writes each one out with its loss span, and :func:`read_back`
reads replies from these texts.  They are quadratic in the number of replies,
so only one is held at a time, cut in the task that has the text, and none is
shuffled.  A conversation too long for one row is held in parts, each a row of
whole turns, and its examples are written out part by part.  :func:`examples`
gives them by reference: (context end, loss start, loss length) in code points.
Only DataFrame functions are used, but for the digest of conversations too long
for one row.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prefspark.llm.common import column, record_batch, saved, shuffle_parts, task
from prefspark.plans.scan import STEP_WIDTH, Running, running

HEAD, COLON, END = "### ", ": ", "</turn>\n"
TRAINED_ROLE = "assistant"
#: fixed values of the template: string and its code, in the order of escaping
TEXT_CODES = (("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\e"))
ROLE_CODES = (("%", "%25"), (":", "%3A"), ("#", "%23"), ("<", "%3C"), ("\n", "%0A"))
#: bytes of a conversation that one row or window may hold; longer ones are
#: placed in chunks, written out and read back in parts
ROW_BYTES = 64 << 20
#: bytes of a part, up to the beginning of its last turn
PART_BYTES = 1 << 20
#: numbers of later examples that one row makes at once
BLOCK = 1 << 12


def _coded(c: Column, codes) -> Column:
    for plain, code in codes:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def _decoded(c: Column, codes) -> Column:
    for plain, code in reversed(codes):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


@dataclass(frozen=True)
class Chats:
    """Formatted conversations: one row per turn, and the ids (``_long``) of
    those over ``ROW_BYTES`` with their number of replies (``_replies``), None
    if there are none."""

    turns: DataFrame
    long: DataFrame | None

    def short_turns(self) -> DataFrame:
        return self.turns if self.long is None else self.turns.join(self.long, _same(self.turns, self.long), "left_anti")

    def long_turns(self) -> DataFrame:
        return self.turns.join(self.long, _same(self.turns, self.long)).drop("_long")


def _same(rows: DataFrame, long: DataFrame) -> Column:
    return rows["conv_id"].eqNullSafe(long["_long"])


def format_turns(conversations: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role",
                 text_col: str = "text") -> Chats:
    """One row per turn: (conv_id, n, start, piece, chars, loss_start,
    loss_chars, end_byte, loss_bytes, replies).  ``piece`` is the formatted
    turn, the ``n``-th (from 0) of its conversation, at code point ``start`` of
    the conversation's text.  Replies have a loss span there (of the escaped
    text alone); for other turns it is null.  ``end_byte`` and ``loss_bytes``
    are the turn's end and the span's length in UTF-8, ``replies`` counts the
    replies up to this turn.

    Turns are ordered by number (nulls first), equal numbers by role and
    text; repeated rows are turns of their own.  A null role or text reads as
    empty, a null id is one conversation without id.  Other columns are
    ignored; an empty table gives no rows.

    Texts move once, to the task of their conversation.  Conversations over
    ``ROW_BYTES`` (found by a sum over the table) are cut into chunks
    instead."""
    rows = conversations.select(F.col(id_col).cast("long").alias("conv_id"), F.col(turn_col).cast("long").alias("turn"),
                                F.coalesce(F.col(role_col).cast("string"), F.lit("")).alias("role"),
                                F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    role, text = _coded(F.col("role"), ROLE_CODES), _coded(F.col("text"), TEXT_CODES)
    rows = rows.select("conv_id", "turn", (F.col("role") == TRAINED_ROLE).alias("trained"),
                       F.concat(F.lit(HEAD), role, F.lit(COLON), text, F.lit(END)).alias("piece"),
                       (F.char_length(role) + len(HEAD) + len(COLON)).cast("long").alias("head"), F.octet_length(text).cast("long").alias("text_bytes"))
    rows = rows.withColumns({"chars": F.char_length("piece").cast("long"), "bytes": F.octet_length("piece").cast("long")})
    reply = F.when(F.col("trained"), 1)
    sizes = rows.groupBy("conv_id").agg(F.sum("bytes").alias("bytes"), F.count(reply).alias("_replies"))
    long = saved(sizes.where(F.col("bytes") > ROW_BYTES).select(F.col("conv_id").alias("_long"), "_replies"), "chat-long")
    long = None if long.isEmpty() else long
    short = rows if long is None else rows.join(long, _same(rows, long), "left_anti")
    # equal numbers: the piece begins with the role, so it orders by both
    before = Window.partitionBy("conv_id").orderBy("turn", "piece").rowsBetween(Window.unboundedPreceding, -1)
    placed = short.withColumns({"n": F.count(F.lit(1)).over(before), "start": F.sum("chars").over(before), "at": F.sum("bytes").over(before),
                                "told": F.count(reply).over(before)})
    if long is not None:
        cut = running(rows.join(long, _same(rows, long), "left_semi"), ["conv_id"], ["turn", "piece"], {
            "n": Running("count", inclusive=False), "start": Running("sum", "chars", inclusive=False),
            "at": Running("sum", "bytes", inclusive=False), "told": Running("count", reply, inclusive=False)}, width=STEP_WIDTH)
        placed = placed.unionByName(cut)
    start = F.coalesce("start", F.lit(0)).cast("long")
    return Chats(placed.select(
        "conv_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), start.alias("start"), "piece", "chars",
        F.when(F.col("trained"), start + F.col("head")).alias("loss_start"),
        F.when(F.col("trained"), F.col("chars") - F.col("head") - len(END)).alias("loss_chars"),
        (F.coalesce("at", F.lit(0)) + F.col("bytes")).cast("long").alias("end_byte"), F.when(F.col("trained"), F.col("text_bytes")).alias("loss_bytes"),
        (F.coalesce("told", F.lit(0)) + F.col("trained").cast("long")).cast("long").alias("replies")), long)


def examples(chats: Chats) -> DataFrame:
    """One row per reply: its example is the first ``end`` code points of the
    conversation's text, of which the first ``context_chars`` are the
    preceding turns and ``loss_chars`` from ``loss_start`` on are trainable."""
    return chats.turns.where("loss_start is not null").select(
        "conv_id", F.col("n").alias("reply"), F.col("start").alias("context_chars"), "loss_start", "loss_chars",
        (F.col("start") + F.col("chars")).alias("end"))


def _held(turns: DataFrame, *by: str) -> DataFrame:
    """Turns of a group as one text, with the spans of the examples that end
    there and the number of replies up to its end."""
    parts = F.array_sort(F.collect_list(F.struct("n", "piece")))
    cut = F.struct(F.col("n").alias("reply"), "end_byte", "loss_start", "loss_chars", "loss_bytes")
    return turns.groupBy(*by).agg(
        F.array_join(parts["piece"], "").alias("text"), F.array_sort(F.collect_list(F.when(F.col("loss_start").isNotNull(), cut))).alias("cuts"),
        F.max("replies").alias("upto"), F.min(F.col("end_byte") - F.octet_length("piece")).alias("at"))


def texts(chats: Chats) -> DataFrame:
    """(conv_id, text, cuts): each conversation of at most ``ROW_BYTES`` as
    one formatted text, with the spans of its examples."""
    return _held(chats.short_turns(), "conv_id").select("conv_id", "text", "cuts")


def parts(chats: Chats) -> DataFrame:
    """(conv_id, part, text, cuts, upto, at, replies): the conversations over
    ``ROW_BYTES`` in parts of whole turns, each with the spans of the examples
    that end in it, the replies up to its end, its first byte and the
    conversation's replies.  Part numbers rise; one long turn may span some."""
    at = F.col("end_byte") - F.octet_length("piece")
    turns = chats.long_turns().withColumns({"part": F.floor(at / PART_BYTES).cast("long")})
    # a fixed number of tasks: the work is far larger than the texts, by whose size they would be merged
    dealt = turns.repartition(shuffle_parts(turns.sparkSession), "conv_id", "part")
    return _held(dealt, "conv_id", "part", "_replies").withColumnRenamed("_replies", "replies")


def _nulls(*names: str) -> list[Column]:
    return [F.lit(None).cast("long").alias(c) for c in names]


def _own(first: Column, at: Column) -> Column:
    """The examples that end in a text, numbered from ``first``, and a closing
    record of the whole text; places are counted from the text's beginning."""
    whole = F.struct(*_nulls("reply"), (at + F.octet_length("text")).cast("long").alias("end_byte"), *_nulls("loss_start", "loss_chars", "loss_bytes"))

    def placed(c, i):
        end = c["end_byte"] - at
        return F.struct(F.when(c["reply"].isNotNull(), first + i).alias("example"), c["reply"], end.alias("end_byte"), c["loss_start"], c["loss_chars"],
                        (end - len(END) - c["loss_bytes"]).alias("loss_byte"), c["loss_bytes"])
    # the lambda keeps explode out of generated code, which would hold all rows
    # of a conversation at once; this way they come one by one
    return F.transform(F.concat("cuts", F.array(whole)), placed)


def _later(first: Column, last: Column) -> Column:
    """Examples ``first`` to ``last``, which hold the whole text and go on."""
    return F.transform(F.sequence(first, last), lambda e: F.struct(
        e.alias("example"), *_nulls("reply"), F.octet_length("text").cast("long").alias("end_byte"),
        *_nulls("loss_start", "loss_chars", "loss_byte", "loss_bytes")))


def _written(held: DataFrame, cuts: Column) -> DataFrame:
    cut = held.select("conv_id", "part", F.col("text").cast("binary").alias("bytes"), F.explode(cuts).alias("c"))
    return cut.select("conv_id", "c.example", "c.reply", "part", F.expr("substring(bytes, 1, int(c.end_byte))").cast("string").alias("text"),
                      "c.loss_start", "c.loss_chars", "c.loss_byte", "c.loss_bytes")


def records(chats: Chats) -> DataFrame:
    """(conv_id, example, reply, part, text, loss_start, loss_chars, loss_byte,
    loss_bytes): all examples of the conversations of at most ``ROW_BYTES``
    written out, numbered from 0, and per conversation a closing record, without
    example, reply or loss, of its whole text (turns after the last reply are in
    no example).  The loss span is given in code points and in bytes; texts are
    cut by bytes, as code points are counted from the beginning each time.
    Part is 0."""
    zero = F.lit(0).cast("long")
    return _written(texts(chats).withColumn("part", zero), _own(zero, zero))


def part_records(chats: Chats) -> DataFrame:
    """The same of the conversations over ``ROW_BYTES``, examples and closing
    record in parts: the texts of an example's parts, in order, are its text.
    ``reply`` and the loss are in its last part alone, ``loss_byte`` counted
    from the beginning of that part."""
    upto, block = F.col("upto"), F.col("block")
    # block -1: what ends in the part; the others: examples that end in later parts
    blocks = F.transform(F.sequence(F.lit(-1).cast("long"), F.floor((F.col("replies") - upto - 1) / BLOCK).cast("long")), lambda b: F.struct(b.alias("b")))
    held = parts(chats).withColumn("_b", F.explode(blocks)).withColumn("block", F.col("_b")["b"])
    first = upto + block * BLOCK
    return _written(held, F.when(block < 0, _own(upto - F.size("cuts"), F.col("at"))).otherwise(
        _later(first, F.least(first + (BLOCK - 1), F.col("replies") - 1))))


def expand(chats: Chats) -> DataFrame:
    """(conv_id, example, reply, part, text, loss_start, loss_chars): the
    example texts written out.  Their size is quadratic in the number of
    replies, so each conversation's text is held once and cut per example.
    Those of conversations over ``ROW_BYTES`` come in parts (see
    :func:`part_records`); the others have one."""
    made = records(chats) if chats.long is None else records(chats).unionByName(part_records(chats))
    return made.where("example is not null").drop("loss_byte", "loss_bytes")


def parse_turn(piece: Column) -> tuple[Column, Column]:
    """(role, text) read from a formatted turn."""
    body = F.substr(piece, F.lit(len(HEAD) + 1), F.char_length(piece) - len(HEAD) - len(END))
    role = F.substring_index(body, COLON, 1)
    text = F.substr(body, F.char_length(role) + len(COLON) + 1)
    return _decoded(role, ROLE_CODES), _decoded(text, TEXT_CODES)


def parse_text(text: Column) -> Column:
    """Array of (role, text) read from a conversation's whole formatted text."""
    pieces = F.filter(F.split(text, END), lambda p: p != "")

    def turn(piece):
        role, body = parse_turn(F.concat(piece, F.lit(END)))
        return F.struct(role.alias("role"), body.alias("text"))
    return F.transform(pieces, turn)


_READ = ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars", "n_examples", "expanded_chars"]
_SUMS = ["n_turns", "loss_chars", "formatted_chars", "n_examples", "expanded_chars"]
_DIGEST = pa.schema([(c, pa.string() if c.endswith("sha256") else pa.int64()) for c in _READ])


@task
def _stream_digests(batches):
    """Digests and sums of parts in order of (conversation, part), without
    gathering."""
    conv, turns, loss, sums = None, None, None, None

    def ended():
        got = dict(zip(_SUMS, sums), conv_id=conv, turns_sha256=turns.hexdigest(), loss_sha256=loss.hexdigest())
        return record_batch(_DIGEST, [tuple(got[c] for c in _READ)])
    for batch in batches:
        for c, said, trained, *counts in zip(*(column(batch, x) for x in ["conv_id", "said", "trained", *_SUMS])):
            if turns is None or c != conv:
                if turns is not None:
                    yield ended()
                conv, turns, loss, sums = c, hashlib.sha256(), hashlib.sha256(), [0] * len(_SUMS)
            turns.update(said.encode())
            loss.update(trained.encode())
            sums = [a + b for a, b in zip(sums, counts)]
    if turns is not None:
        yield ended()


def _given(made: DataFrame) -> DataFrame:
    """What records give, without their texts (an aggregate may sort its
    input): their length, the turns of closing records, the loss of examples."""
    reply, chars = F.col("reply"), F.char_length("text").cast("long")
    span = F.expr("substring(cast(text as binary), int(loss_byte) + 1, int(loss_bytes))").cast("string")
    return made.select("conv_id", "part", "example", "reply", chars.alias("chars"), F.when(F.col("example").isNull(), parse_text(F.col("text"))).alias("turns"),
                       F.when(reply.isNotNull(), _decoded(span, TEXT_CODES)).alias("trained"))


def _said() -> Column:
    return F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")


def read_back(chats: Chats) -> DataFrame:
    """Per conversation what its written examples and its closing record give
    back: (conv_id, n_turns, turns_sha256, loss_chars, loss_sha256,
    formatted_chars, n_examples, expanded_chars).

    ``formatted_chars`` counts the conversation's formatted text once,
    ``expanded_chars`` the texts of all its examples.  A conversation over
    ``ROW_BYTES``, whose text no row should hold, is digested part by part in a
    Python worker; all others by SQL functions alone."""
    reply = F.col("reply")
    given = _given(records(chats)).select(
        "conv_id", "reply", "chars", F.when(reply.isNull(), F.size("turns").cast("long")).alias("n_turns"),
        F.when(reply.isNull(), F.sha2(_said(), 256)).alias("turns_sha256"), "trained")
    told = F.array_sort(F.collect_list(F.when(reply.isNotNull(), F.struct("reply", "trained"))))
    short = given.groupBy("conv_id").agg(
        F.max("n_turns").alias("n_turns"), F.max("turns_sha256").alias("turns_sha256"),
        F.coalesce(F.sum(F.char_length("trained")), F.lit(0)).cast("long").alias("loss_chars"),
        F.sha2(F.array_join(told["trained"], ""), 256).alias("loss_sha256"),
        F.max(F.when(reply.isNull(), F.col("chars"))).alias("formatted_chars"), F.count("reply").alias("n_examples"),
        F.coalesce(F.sum(F.when(reply.isNotNull(), F.col("chars"))), F.lit(0)).cast("long").alias("expanded_chars")).select(*_READ)
    return short if chats.long is None else short.union(_read_long(chats))


def _read_long(chats: Chats) -> DataFrame:
    """The same of the conversations over ``ROW_BYTES``: each part by itself,
    in the task that writes it, then the parts in order."""
    whole = F.col("example").isNull()
    given = _given(part_records(chats)).select(
        "conv_id", "part", "example", "reply", "chars", F.when(whole, F.size("turns").cast("long")).alias("n_turns"),
        F.when(whole, _said()).alias("said"), "trained")
    told = F.array_sort(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "trained"))))
    by_part = given.groupBy("conv_id", "part").agg(
        F.max("n_turns").alias("n_turns"), F.max("said").alias("said"), F.array_join(told["trained"], "").alias("trained"),
        F.coalesce(F.sum(F.char_length("trained")), F.lit(0)).cast("long").alias("loss_chars"), F.max(F.when(whole, F.col("chars"))).alias("formatted_chars"),
        F.count("reply").alias("n_examples"), F.coalesce(F.sum(F.when(~whole, F.col("chars"))), F.lit(0)).cast("long").alias("expanded_chars"))
    ordered = by_part.repartition(shuffle_parts(by_part.sparkSession), "conv_id").sortWithinPartitions("conv_id", "part")
    return ordered.mapInArrow(_stream_digests, ", ".join(f"{c} {'string' if c.endswith('sha256') else 'long'}" for c in _READ))

"""Best-fit packing of tokenized texts into fixed-length training sequences.

Bounded-space online best-fit: pieces arrive in a hash order; each goes to the
open sequence whose free space is the smallest that holds it.  The open
sequences are keyed by free space in one bitset (an integer of 4097 bits), so
the best fit is one shift and one lowest-set-bit; beyond the fixed number of
open sequences the fullest closes.  Every packing task holds only its open
sequences and streams its pieces, which are spread by hash, so a hot source or
many equal texts can't gather in one task.  Tasks pack in parallel; what is in
the sequences still open at their ends is packed again by a sixteenth as many
tasks, longest pieces first, until one bounded task is left.
"""

from __future__ import annotations

import array
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from prefspark.llm.common import column, record_batch, saved, task, worker_cache

SEQUENCE = 4096
OPEN = 512
#: pieces per packing task of the first round
PIECES_PER_TASK = 20_000
#: tasks whose open sequences one task of the next round packs again
MERGE = 16
#: words kept per Python worker with their ids (bounds its memory)
CACHE_WORDS = 200_000
#: words of these letters only are one pre-token each, which the model splits itself
_PLAIN = re.compile("[a-zß-öø-ÿÀ-ÖØ-Þ]+")

_PIECE = pa.schema([("doc_id", pa.int64()), ("row", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()),
                    ("length", pa.int64()), ("ids_crc32", pa.int64()), ("ids", pa.binary())])


class WordIds(dict):
    """Word -> its ids as little-endian uint32 bytes, encoded when first met.

    The vocabulary's pre-tokenizer never joins text across blanks or line
    ends, and folds A-Z, so the ids of a text are those of its blank-separated
    lower-cased words in order.  A full stop or comma behind a letter is a
    token of its own.  Words met again (by a table of hashes) are kept, up to
    ``CACHE_WORDS``; others are encoded each time.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        super().__init__({b"": b""})
        self.met = bytearray(1 << 22)
        tokenizer = Tokenizer.from_file(path)
        self.encode, self.split = tokenizer.encode, tokenizer.model.tokenize
        # how the pre-tokenizer spells each letter
        letters = [chr(c) for c in (*range(97, 123), *range(0xDF, 0x100)) if _PLAIN.match(chr(c))]
        self.spelt = {ord(c): tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters}
        self.marks = {m: self._ids(m) for m in (b".", b",")}

    def _ids(self, word: bytes) -> bytes:
        text = word.decode()
        if _PLAIN.fullmatch(text):
            ids = [t.id for t in self.split(text.lower().translate(self.spelt))]
        else:
            ids = self.encode(text, add_special_tokens=False).ids
        return array.array("I", ids).tobytes()

    def __missing__(self, word: bytes) -> bytes:
        mark = self.marks.get(word[-1:])
        ids = self[word[:-1]] + mark if mark and word[-2:-1].isalpha() else self._ids(word)
        place = hash(word) & 0x3FFFFF
        if not self.met[place]:
            self.met[place] = 1
        elif len(self) < CACHE_WORDS and len(word) <= 64:
            self[word] = ids
        return ids

    def text(self, text: bytes) -> bytes:
        # a special token's string keeps its case: only the exact one counts
        words = (text if b"<|" in text else text.lower()).replace(b"\n", b" ").split(b" ")
        return b"".join(map(self.__getitem__, words))


@worker_cache
def word_ids(path: str) -> WordIds:
    """One cache per Python worker, kept from task to task of this module."""
    return WordIds(path)


@task
def _pieces(batches, path: str, end_id: int, size: int, with_ids: bool):
    ids_of = word_ids(path).text
    end = np.array([end_id], "<u4").tobytes()
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index("text"))
        docs, rows = column(batch, "doc_id"), column(batch, "row")
        for lo in range(0, len(docs), 256):
            out = []
            for doc, row, text in zip(docs[lo:lo + 256], rows[lo:lo + 256], texts[lo:lo + 256]):
                ids = ids_of(text.as_buffer().to_pybytes()) + end
                for k in range(0, len(ids), 4 * size):
                    part = ids[k:k + 4 * size]
                    out.append((doc, row, k // (4 * size), k // 4, len(part) // 4, zlib.crc32(part), part if with_ids else None))
            yield record_batch(_PIECE, out)


def tokenize_pieces(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
                    size: int = SEQUENCE, with_ids: bool = False) -> DataFrame:
    """One row per piece of at most ``size`` tokens of each whole text and its
    end id: (doc_id, row, piece, start, length, ids_crc32, ids); ``row`` names
    the input row, so rows with equal ids stay apart.  A null or empty text is
    its end id alone.  ``ids`` (uint32, little-endian) only ``with_ids``."""
    base = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
                       F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    return base.mapInArrow(lambda it: _pieces(it, path, end_id, size, with_ids),
                           "doc_id long, row long, piece int, start long, length long, ids_crc32 long, ids binary")


class OpenBins:
    """At most ``limit`` open bins of ``size`` units, keyed by free space.
    Bins that close, full or as the fullest beyond the limit, are listed in
    ``closed``."""

    def __init__(self, size: int, limit: int):
        self.size, self.limit = size, limit
        self.bits, self.by_free, self.count, self.next, self.closed = 0, {}, 0, 0, []

    def _put(self, bin_id: int, free: int) -> None:
        if free <= 0:
            self.closed.append(bin_id)
            return
        self.by_free.setdefault(free, []).append(bin_id)
        self.bits |= 1 << free
        self.count += 1
        if self.count > self.limit:
            self.closed.append(self._take((self.bits & -self.bits).bit_length() - 1))

    def _take(self, free: int) -> int:
        bins = self.by_free[free]
        bin_id = bins.pop()
        if not bins:
            del self.by_free[free]
            self.bits &= ~(1 << free)
        self.count -= 1
        return bin_id

    def place(self, length: int) -> tuple[int, int]:
        """(bin, offset) of a piece of 1 to ``size`` units."""
        fits = self.bits >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            bin_id = self._take(free)
        else:
            bin_id, free = self.next, self.size
            self.next += 1
        self._put(bin_id, free - length)
        return bin_id, self.size - free


@task
def _place(batches, size: int, limit: int, turn: int, last: bool):
    """Rows with (sequence_id, offset) as their sequences close; those of the
    sequences left open without, but for the last round."""
    base, bins = (turn << 21 | TaskContext.get().partitionId()) << 32, OpenBins(size, limit)
    held, schema, out = {}, None, []

    def made():
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
    for batch in batches:
        at = batch.schema.get_field_index("length")
        schema = schema or batch.schema.append(pa.field("sequence_id", pa.int64())).append(pa.field("offset", pa.int64()))
        for row in zip(*(c.to_pylist() for c in batch.columns)):
            bin_id, offset = bins.place(row[at])
            held.setdefault(bin_id, []).append((*row, base + bin_id, offset))
            for bin_id in bins.closed:
                out += held.pop(bin_id)
            bins.closed.clear()
            if len(out) >= 4096:
                yield made()
                out = []
    for rows in held.values():
        out += rows if last else [(*r[:-2], None, None) for r in rows]
    if out:
        yield made()


def pack_pieces(pieces: DataFrame, size: int = SEQUENCE, limit: int = OPEN) -> DataFrame:
    """Add (sequence_id, offset) to a saved table of pieces (column
    ``length``, 1 to ``size``).  Pieces arrive in hash order (later rounds:
    longest first), which is the same when a task is run again; sequences are
    gapless from 0 and ids are unique.  A task holds the pieces of its open
    sequences, of ``limit * size`` units at most."""
    tasks = max(1, -(-pieces.count() // PIECES_PER_TASK))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema)
    keys, turn, packed = [F.xxhash64("row", "piece"), F.col("row"), F.col("piece")], 0, None
    while True:
        spread = pieces.repartition(tasks, "row", "piece").sortWithinPartitions(*([F.col("length").desc()] if turn else []), *keys)
        placed = saved(spread.mapInArrow(lambda it, k=turn, last=tasks == 1: _place(it, size, limit, k, last),
                                         f"{fields}, sequence_id long, offset long"), f"pack-{turn}")
        closed = placed.where("sequence_id is not null")
        packed = closed if packed is None else packed.union(closed)
        if tasks == 1:
            return packed
        pieces, tasks, turn = placed.where("sequence_id is null").select(*pieces.columns), -(-tasks // MERGE), turn + 1


def pack_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1,
                   size: int = SEQUENCE, limit: int = OPEN, with_ids: bool = False) -> DataFrame:
    """Pack all texts: one row per piece (see :func:`tokenize_pieces`) with
    its sequence and offset.  Only texts over ``size`` tokens are cut.  An
    empty table gives no rows."""
    pieces = saved(tokenize_pieces(docs, path, id_col, text_col, end_id, size, with_ids), "pack-pieces")
    return pack_pieces(pieces, size, limit)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, length, ids) from pieces packed ``with_ids``: the tokens
    of each sequence in order (at most ``size`` of them, so groups are small)."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), parts.alias("p")).select(
        "sequence_id", "length", F.expr("aggregate(p, cast('' as binary), (s, x) -> concat(s, x.ids))").alias("ids"))

"""Best-fit packing planned over a histogram of lengths.

Documents become tokens and are cut into pieces where they are longer than a sequence.  Only the
counts of each length (at most ``capacity`` numbers) reach the driver, where best-fit runs over counts:
equal open sequences are kept as ranges, so the plan has a row for each range, not for each document.
Pieces then take their planned slot by joining on their rank within their length.  The rank is the
count of that length in earlier tasks plus a running number inside the task, so no length is sorted or
gathered in one place.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, lean

CAPACITY = 4096
#: Id that closes every document.
END = 1
#: Words whose ids a worker remembers, and the longest of them; beyond it the memory starts anew.
MEMO, LONGEST = 200_000, 64
#: Plans of up to so many rows (about 40 bytes each) are broadcast.
PLAN_ROWS = 200_000

_loaded: dict = {}
_PLAIN = re.compile(r"([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)")
#: Characters that str.split() takes for blanks besides the ASCII ones.
_CONTROL = re.compile(r"[\x1c-\x1f]")
_BLANKS = re.compile(r"[^\x20\x09-\x0D]+")


class Encoder:
    """Token ids of whole texts as little-endian 32-bit bytes, word by word with a memory.

    The tokenizer never joins characters across ASCII blanks, so a text's ids are those of its words.
    Letters and the punctuation after them are separate units too; a word of that plain form goes to
    the tokenizer's merge model directly, every other word through the whole tokenizer.  Whether a
    tokenizer is of this kind is tried out on loading; one that is not encodes whole words or whole texts itself.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.memo: dict[str, bytes] = {}
        self.units: dict[str, bytes] = {}
        self.model = self.tokenizer.model
        # Byte-level alphabet: printable bytes stand for themselves, the others for 256, 257, ...
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}

        direct = lambda w: (lambda m: self._unit(m[1].lower()) + (self._unit(m[2]) if m[2] else b""))(_PLAIN.fullmatch(w))
        probes = ["Hello", "WORLDS", "q", "naïve", "ÀÉÎÕÜß", "Straße,", "END!!!", "it.)", "antidisestablishment", "xqzjk;"]
        try:
            self.plain = all(direct(w) == self._whole(w) for w in probes)
        except Exception:  # noqa: BLE001 - a model without this interface is used as a whole
            self.plain = False
        texts = ["Hello  world\n\tit's 12 cafés , ok", " a b", "x\r\ny ", "..  .. 日本 語"]
        self.by_word = all(self._whole(t) == b"".join(map(self._whole, _BLANKS.findall(t))) for t in texts)
        self.units.clear()

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _unit(self, unit: str) -> bytes:
        found = self.units.get(unit)
        if found is None:
            if len(self.units) > MEMO or len(unit) > LONGEST:
                self.units.clear()
            text = unit if unit.isascii() else "".join(map(self.alphabet.__getitem__, unit.encode()))
            found = self.units[unit] = np.array([t.id for t in self.model.tokenize(text)], "<u4").tobytes()
        return found

    def __call__(self, text: str) -> bytes:
        if not self.by_word:
            return self._whole(text)
        words = text.split() if text.isascii() and not _CONTROL.search(text) else _BLANKS.findall(text)
        memo = self.memo
        found = list(map(memo.get, words))
        if None in found:
            if len(memo) > MEMO:
                memo.clear()
            other = []
            for w in words:
                if w not in memo:
                    if self.plain and (m := _PLAIN.fullmatch(w)):
                        letters, marks = m[1].lower(), m[2]
                        memo[w] = self._unit(letters) + (self._unit(marks) if marks else b"")
                    else:
                        other.append(w)
            other = list(dict.fromkeys(other))
            for w, e in zip(other, self.tokenizer.encode_batch_fast(other, add_special_tokens=False)):
                memo[w] = np.array(e.ids, "<u4").tobytes()
            found = list(map(memo.__getitem__, words))
            for w in words:
                if len(w) > LONGEST:
                    memo.pop(w, None)
        return b"".join(found)


def encoder(path: str) -> Encoder:
    import os

    os.environ["RAYON_NUM_THREADS"] = "1"
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    if path not in _loaded:
        _loaded[path] = Encoder(path)
    return _loaded[path]


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """One row for each piece: key, piece, start, length, ids_crc32 and (task, rank) for the plan.

    A null text is an empty one: a single piece that holds the closing id.  Repeated rows give
    repeated pieces, each with its own slot.
    """

    def run(batches):
        encode, task = encoder(path), TaskContext.get().partitionId()
        ranks: dict[int, int] = defaultdict(int)
        end = np.array([END], "<u4").tobytes()
        for batch in batches:
            rows = []
            for one, text in zip(batch.column(key).to_pylist(), batch.column("text")):
                ids = encode(text.as_py() or "") + end
                for k, at in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[at : at + 4 * capacity]
                    n = len(part) // 4
                    rows.append((one, k, at // 4, n, zlib.crc32(part), task, ranks[n]))
                    ranks[n] += 1
            kinds = [batch.schema.field(key).type, pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            cols = list(zip(*rows)) if rows else [[]] * 7
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds)],
                [key, "piece", "start", "length", "ids_crc32", "task", "local"],
            )

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, "text").mapInArrow(
        lean(run), f"`{key}` {kind}, piece int, start long, length long, ids_crc32 long, task int, local long"
    )


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit, longest first, over counts.

    Returns (length, first_rank, last_rank, each, first_sequence, offset): ranks first..last-1 of a
    length go to sequences from first_sequence on, ``each`` to a sequence, the first of them at offset.
    """
    rows: list[tuple[int, int, int, int, int, int]] = []
    open_: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room left -> ranges (first, number)
    rooms: list[int] = []
    fresh = 0

    def put(room: int, first: int, number: int) -> None:
        if room and number:
            if room not in open_ or not open_[room]:
                bisect.insort(rooms, room)
            open_[room].append((first, number))

    for length in sorted(counts, reverse=True):
        left, rank = counts[length], 0
        while left:
            at = bisect.bisect_left(rooms, length)
            if at == len(rooms):
                each = capacity // length
                number, first, room = max(1, left // each), fresh, capacity
                fresh += number
            else:
                room = rooms[at]
                each = room // length
                first, held = open_[room].pop()
                number = min(held, max(1, left // each))
                if not open_[room]:
                    rooms.pop(at)
                put(room, first + number, held - number)
            took = min(left, number * each)
            per = min(each, took)
            rows.append((length, rank, rank + took, per, first, capacity - room))
            put(room - per * length, first, number)
            rank, left = rank + took, left - took
    return rows


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, key: str = "doc_id") -> DataFrame:
    """Pack whole texts of ``docs(key, text)``; one row for each piece with its sequence and offset.

    An empty table gives no rows.  Extra columns are ignored.
    """
    spark = docs.sparkSession
    made = cut(pieces(docs, path, capacity, key))
    by_task = made.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = by_task.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    counts = {r["length"]: r["n"] for r in made.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    rows = plan(counts, capacity)
    names = "p_length long, first_rank long, last_rank long, each long, first_sequence long, p_offset long"
    slots = spark.createDataFrame(rows, names)
    if len(rows) <= PLAN_ROWS:
        slots = F.broadcast(slots)
    ranked = made.join(bases, ["task", "length"]).withColumn("rank", F.col("base") + F.col("local"))
    at = F.col("rank") - F.col("first_rank")
    on = (F.col("length") == F.col("p_length")) & (F.col("rank") >= F.col("first_rank")) & (F.col("rank") < F.col("last_rank"))
    return ranked.join(slots, on).select(
        key, "piece", "start", "length", "ids_crc32",
        (F.col("first_sequence") + F.floor(at / F.col("each"))).alias("sequence_id"),
        (F.col("p_offset") + at % F.col("each") * F.col("length")).alias("offset"),
    )

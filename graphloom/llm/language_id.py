"""Language identification by prediction by partial matching over bytes.

One variable-order byte context tree per language, fitted once and then frozen: a context keeps the
counts of the bytes that followed it, method C gives the escape probability, and a byte's exact code
length under a language is the product of the escapes from its longest known context down to the
order that has seen it.  The union of all trees is flattened into two tables (history -> context row,
(row, byte) -> code length per language), so scoring a text is two gathers for each byte and a sum.
"""

from __future__ import annotations

import pickle
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SLICE_BYTES, bytes_of, crc_of_id, lean, slices

ORDER = 3
#: Bound of the training sample, in documents of each language.
SAMPLE = 600
#: Bytes that follow a new text's start are predicted as after a line feed.
START = 0x0A


def _grams(order: int):
    """(lang, order, gram, n) of a partition's texts: every (k+1)-byte window, k = 0..order."""

    def run(batches):
        held: dict = {}
        for batch in batches:
            langs = batch.column("lang").to_pylist()
            for lo, hi in slices(batch, "text"):
                raw, off = bytes_of(batch.column("text").slice(lo, hi - lo))
                raw = LOWER[raw]
                for i in range(hi - lo):
                    code = _windows(raw[off[i] : off[i + 1]], order)
                    for k in range(order + 1):
                        u, n = np.unique(code & np.uint32((1 << 8 * (k + 1)) - 1), return_counts=True)
                        c = held.setdefault((langs[lo + i], k), Counter())
                        c.update(dict(zip(u.tolist(), n.tolist())))
        rows = [(l, k, g, n) for (l, k), c in held.items() for g, n in c.items()]
        cols = list(zip(*rows)) if rows else [[]] * 4
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["lang", "k", "gram", "n"])

    return run


def _windows(raw: np.ndarray, order: int) -> np.ndarray:
    """For each byte, itself (low byte) and the ``order`` before it, as one number (order <= 3)."""
    padded = np.concatenate([np.full(order, START, np.uint8), raw]).astype(np.uint32)
    n = len(raw)
    code = padded[order : order + n].copy()
    for j in range(1, order + 1):
        code |= padded[order - j : order - j + n] << np.uint32(8 * j)
    return code


class Model:
    """Frozen statistics of all languages, flattened for scoring."""

    def __init__(self, langs: list[str], order: int, counts: dict):
        """counts: (language, k) -> {window of k context bytes and the byte: n}."""
        self.langs, self.order = sorted(l for l in langs if counts.get((l, 0))), order
        size = len(self.langs)
        # Bytes no language has seen share one class.
        seen = sorted({g & 255 for l in self.langs for g in counts.get((l, 0), ())})
        self.alphabet = a = len(seen) + 1
        self.cls = np.zeros(256, np.int32)
        self.cls[seen] = np.arange(1, a)
        # Rows: every context of any language, by length; row 0 is the empty context.
        row: dict[tuple[int, int], int] = {(0, 0): 0}
        for k in range(1, order + 1):
            for c in sorted({g >> 8 for l in self.langs for g in counts.get((l, k), ())}):
                row[(k, c)] = len(row)
        base = np.log2(256.0)
        cost = np.full((len(row), a, size), base, np.float32)
        for s, lang in enumerate(self.langs):
            by: dict[tuple[int, int], dict[int, int]] = {}
            for k in range(order + 1):
                for g, n in counts.get((lang, k), {}).items():
                    by.setdefault((k, g >> 8), {})[int(self.cls[g & 255])] = n
            for (k, c), at in row.items():  # shorter contexts first
                own = by.get((k, c))
                below = cost[row[(k - 1, c & ((1 << 8 * (k - 1)) - 1))], :, s] if k else np.full(a, base, np.float32)
                if not own:
                    cost[at, :, s] = below  # never seen here: the next shorter context speaks
                    continue
                total, kinds = sum(own.values()), len(own)
                escape = -np.log2(kinds / (total + kinds))
                cost[at, :, s] = below + escape
                for b, n in own.items():
                    cost[at, b, s] = -np.log2(n / (total + kinds))
        self.cost = cost.reshape(len(row) * a, size)
        # History of `order` byte classes -> row of its longest known suffix.
        self.of = np.zeros((a,) * order, np.int32)
        for (k, c), at in row.items():  # longer contexts overwrite shorter ones
            if k:
                hist = [int(self.cls[(c >> 8 * j) & 255]) for j in reversed(range(k))]
                self.of[(slice(None),) * (order - k) + tuple(hist)] = at
        self.of = self.of.reshape(-1)

    def lengths(self, raw: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Exact code length in bits of each row under each language."""
        size, rows = len(self.langs), len(off) - 1
        out = np.zeros((rows, size))
        full = np.flatnonzero(np.diff(off))
        if not len(full):
            return out
        k, a = self.order, self.alphabet
        # A line feed stands before every row, as in training.
        gap = np.full(len(raw) + k * len(full), self.cls[START], np.int32)
        shift = np.repeat(k * np.arange(1, len(full) + 1), np.diff(off)[full])
        at = np.arange(len(raw)) + shift
        gap[at] = self.cls[LOWER[raw]]
        ctx = np.zeros(len(raw), np.int64)
        for j in range(k, 0, -1):
            ctx = ctx * a + gap[at - j]
        index = self.of[ctx].astype(np.int64) * a + gap[at]
        for s in range(size):
            out[full, s] = np.add.reduceat(self.cost[:, s][index], off[:-1][full], dtype=np.float64)
        return out


def fit(docs: DataFrame, order: int = ORDER, sample: int = SAMPLE) -> Model:
    """Fit on ``docs(doc_id, text, lang)``: at most about ``sample`` documents of each language.

    The documents are chosen by a hash of id and text, equal rows teach once.  Rows whose text or lang is null teach
    nothing; a language whose texts are all empty is not learned.  The gram counts are summed by Spark; what
    reaches the driver is bounded by the sample, not by the table.
    """
    known = docs.where("text is not null and lang is not null").select("doc_id", "text", "lang")
    shares = {r["lang"]: min(1.0, sample / r["n"]) for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    # By id and text, so that documents that share an id (or have none) are drawn one by one.
    unit = F.pmod(F.xxhash64("doc_id", "text", F.lit(11)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    keep = F.lit(False)
    for lang, share in shares.items():
        keep |= (F.col("lang") == lang) & (unit < share)
    grams = known.where(keep).distinct().mapInArrow(lean(_grams(order)), "lang string, k int, gram long, n long")
    counts: dict = {}
    for lang, k, gram, n in grams.groupBy("lang", "k", "gram").agg(F.sum("n").alias("n")).toLocalIterator():
        counts.setdefault((lang, k), {})[gram] = n
    return Model(list(shares), order, counts)


def predict(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """``keep`` columns with ``lang_pred`` and ``score`` (share of the best language, 0 to 1).

    Null texts, texts without a letter and every text under an empty model give ``und`` and 0.
    Repeated rows stay repeated; a text of any length is scored whole; ties go to the first language
    by code point.
    """
    import regex

    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    schema = ", ".join(f"`{c}` {kinds[c].simpleString()}" for c in keep) + ", lang_pred string, score double"

    def run(batches):
        m: Model = pickle.loads(sent.value)
        letter = regex.compile(r"\p{L}")
        names = np.array([*m.langs, "und"], object)
        for batch in batches:
            for lo, hi in slices(batch, "text", SLICE_BYTES // 2):
                part = batch.slice(lo, hi - lo)
                texts = part.column("text")
                known = np.array([bool(t) and letter.search(t) is not None for t in texts.to_pylist()], bool)
                if not m.langs:
                    known[:] = False
                best, score = np.full(len(known), len(m.langs)), np.zeros(len(known))
                if known.any():
                    bits = m.lengths(*bytes_of(texts))
                    first = bits.argmin(axis=1)
                    gap = np.minimum(bits - bits.min(axis=1, keepdims=True), 1000.0)
                    share = 1.0 / np.exp2(-gap).sum(axis=1)
                    best, score = np.where(known, first, best), np.where(known, share, 0.0)
                yield pa.RecordBatch.from_arrays(
                    [*[part.column(c) for c in keep], pa.array(names[best].tolist(), pa.string()), pa.array(score)],
                    [*keep, "lang_pred", "score"],
                )

    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(lean(run), schema)


def identify(docs: DataFrame, order: int = ORDER, sample: int = SAMPLE) -> DataFrame:
    """The query: learn from documents with crc32(doc_id) mod 3 <> 1, predict all of them.

    A row without a doc_id is not held out and teaches nothing.  Rows that share an id are drawn and told one by
    one.  An empty table gives an empty result; columns besides doc_id, text and lang are ignored.
    """
    fold = F.pmod(crc_of_id(F.col("doc_id")), F.lit(3))
    model = fit(docs.where(fold != 1), order, sample)
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(F.pmod(crc_of_id(F.col("doc_id")), F.lit(3)) == 1, F.lit(False)).alias("held_out"), "lang_pred", "score")


__all__ = ["ORDER", "SAMPLE", "Model", "fit", "identify", "predict"]

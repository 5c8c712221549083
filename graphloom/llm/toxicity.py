"""Toxicity by compression distance: zstandard with an ordinary and a toxic dictionary.

A text is cut into overlapping windows of two neighbouring words.  Every window is compressed twice, once
with each dictionary, and the bytes that the toxic one saves are the window's distance.  How many windows
pass each of a few distances is what a logistic curve, calibrated on the training documents, turns into
the score.

zstandard's own trainer makes all dictionaries, with the same budget for both sides:

* A background dictionary, from half of the ordinary training documents, stands at the end of both sides, so
  that ordinary words cost the same.  Windows that it already explains teach neither side anything more.
* The ordinary side is trained on windows of the other half.
* The toxic side is trained on windows of toxic documents.  Most of these are ordinary words too, so training
  goes in rounds: the toxic documents are split in two halves, a dictionary from one half is tried on the
  windows of the other, and only windows that it makes clearly shorter than the ordinary side does stay for
  the next round, which has a smaller budget.

A window stands between the halves of a fixed carrier that both dictionaries hold, so that even a short
one is worth a compressed block.

Both dictionaries end with the same background and carrier.  A window in which neither side's own part can be
matched, and no long run of what they share, costs both sides the same bytes.  Its distance is 0 without
compressing it, once the training windows have shown that this holds (``Contrast``); all others are compressed.
"""

from __future__ import annotations

import hashlib
import pickle
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import zstandard as zs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import crc_of_id, lean, sample_by_hash
from .common import cut as cut_

#: Words of a window.
WINDOW = 2
#: Windows that are compressed in one call; texts and windows whose result a task remembers.
AT_ONCE, REMEMBERED, HELD = 4096, 100_000, 200_000
#: Characters of a text that are cut into windows at once, and of short texts that are cut together.
PART, TOGETHER = 1 << 20, 1 << 17
#: Bounds of the training sample, in documents of each label and in windows of each label.
SAMPLE, SAMPLE_WINDOWS = 1000, 400_000
#: Bytes of the background, and budget of both sides with the saving that keeps a window, round by round.
BACKGROUND, ROUNDS = 8_192, ((12_288, 3), (8_192, 4), (4_096, 4), (1_536, 4))
#: Segment and shortest match of the trainer; splits in halves that are tried, and segments in the last round.
SEGMENT, MATCH, SPLITS, LAST = 16, 8, 4, (12, 16, 20, 24)
#: Share of the windows that the background explains best and that teach nothing.
EXPLAINED = 0.7
#: Distances at which windows are counted; share of toxic documents that the curve assumes.
STEPS, PRIOR = (2, 3, 4, 5), 0.3
CUT = 0.3
#: The carrier: both dictionaries end with it, and every window stands between its halves.
HEAD, TAIL = b"0123456789@ABCDEFGHI", b"<> ZYXWVUTSRQPONMLKJ"
_BLANK = re.compile(r"\s")
#: Bytes of the runs by which matches are found, and distance of the short runs' places in a dictionary.
SHORT, LONG, EVERY = 4, 8, 3
#: Bytes of a window from which on it is always compressed; bits of the tables of short and long runs.
WIDE, BITS = 1000, (20, 22)


def windows(text: str | None, step: int = 1, n: int = WINDOW, head: str = " ", tail: str = " ") -> list[bytes]:
    """Windows of n words between head and tail, lower-cased, from every ``step``-th word on; a shorter text is one window."""
    words = (text or "").lower().split()
    if step == 1 and n == 2 and len(words) > 1:
        return [f"{head}{a} {b}{tail}".encode() for a, b in zip(words, words[1:])]
    last = max(1, len(words) - n + 1) if step == 1 else len(words)
    return [f"{head}{' '.join(words[i : i + n])}{tail}".encode() for i in range(0, last, step)] if words else []


def _places(text: str) -> tuple[bytes, np.ndarray, np.ndarray]:
    """The words of a text between single blanks, and where in them each of its windows starts and ends."""
    words = text.lower().split()
    raw = f" {' '.join(words)} ".encode()
    blanks, n = np.flatnonzero(np.frombuffer(raw, np.uint8) == 32), min(WINDOW, len(words))
    return (raw, blanks[:-n], blanks[n:] + 1) if n else (raw, blanks[:0], blanks[:0])


def parts(text: str) -> Iterator[str]:
    """A long text in pieces of two words or more that end before a blank, each but the first led by the last word of the piece before."""
    if len(text) <= PART:
        yield text
        return
    at, held, any_ = 0, "", False
    while at < len(text):
        found = _BLANK.search(text, at + PART)
        end = found.start() if found else len(text)
        piece = f"{held} {text[at:end]}" if held else text[at:end]
        at = end
        if len(piece.split(None, 1)) > 1:
            any_, held = True, piece.rsplit(None, 1)[-1]
            yield piece
        else:
            held = piece.strip()
    if not any_:
        yield held


def train_dictionary(samples: list[bytes], size: int, segment: int = SEGMENT) -> bytes:
    """Content of a dictionary that zstandard trains on the samples; samples that are too few to train on stand for themselves."""
    try:
        return zs.train_dictionary(size, samples, k=segment, d=MATCH).as_bytes()[-size:]
    except zs.ZstdError:
        held, left = [], size
        for s in dict.fromkeys(samples):
            if len(s) <= left:
                held.append(s)
                left -= len(s)
        return b"".join(held)


def compressor(content: bytes):
    """Function from windows, with their carrier or without, to their compressed lengths with a dictionary."""
    held = zs.ZstdCompressionDict(content + HEAD + TAIL, dict_type=zs.DICT_TYPE_RAWCONTENT)
    how = zs.ZstdCompressionParameters(
        format=zs.FORMAT_ZSTD1_MAGICLESS, window_log=17, hash_log=14, chain_log=14, search_log=1, min_match=4, target_length=0,
        strategy=zs.STRATEGY_DFAST, write_content_size=0, write_checksum=0, write_dict_id=0,
    )
    held.precompute_compress(compression_params=how)
    engine = zs.ZstdCompressor(dict_data=held, compression_params=how)

    def lengths(cut: list[bytes], carried: bool = False) -> np.ndarray:
        out = []
        for at in range(0, len(cut), AT_ONCE):
            part = cut[at : at + AT_ONCE]
            packed = engine.multi_compress_to_buffer(part if carried else [HEAD + w + TAIL for w in part], threads=1)
            out += map(len, packed)
        return np.array(out, np.int64)

    return lengths


class Contrast:
    """Tells windows that two dictionaries with one common end may compress to different lengths from those that they can't.

    Matches begin at a run of 4 or of 8 bytes that is found again in the dictionary.  Of the short ones every third
    place can be found, and of equal runs the last; of the long ones each place, but runs that share a slot of the table may
    hide each other.  So the sides agree on a window without a short run that is found in the part before the
    common end, without a long run of that part, and without a long run of the common end that one side may hide.
    Runs are looked up in tables of hashes, where a false alarm only has a window compressed.
    """

    def __init__(self, ordinary: bytes, toxic: bytes):
        common = next((i for i, (a, b) in enumerate(zip(reversed(ordinary), reversed(toxic))) if a != b), min(len(ordinary), len(toxic)))
        own = [x[: len(x) - common] for x in (ordinary, toxic)]
        #: Runs over the border of window and carrier are not looked up, so no side may hold any; short runs' places have to agree.
        self.able = common >= LONG and (len(ordinary) - len(toxic)) % EVERY == 0 and not any(x in y for x in (HEAD[-1:] + b" ", b" " + TAIL[:1]) for y in (ordinary, toxic))
        if not self.able:
            return
        short, long, late = set(), set(), set()
        for x, mine in zip((ordinary, toxic), own):
            n, whole = len(mine), x + HEAD + TAIL
            late |= {x[i : i + SHORT] for i in range(n + -n % EVERY, len(x) - SHORT + 1, EVERY)}
            short |= {whole[i : i + SHORT] for i in range(0, n, EVERY)}
            long |= {whole[i : i + LONG] for i in range(len(whole) - LONG + 1)}
        # A match at the very start of the common end goes on backwards into the part before it.
        short = (short - late) | {x[n - 1 : n + SHORT - 1] for x, n in zip((ordinary, toxic), map(len, own)) if n}
        self.tables = []
        for runs, width, bits in ((short, SHORT, BITS[0]), (long, LONG, BITS[1])):
            table = np.zeros(1 << bits, bool)
            for run in runs:
                table[self._slots(np.frombuffer(run, np.uint8), width, bits)] = True
            self.tables.append((table, width, bits))

    @staticmethod
    def _slots(raw: np.ndarray, width: int, bits: int) -> np.ndarray:
        """Slot of the run at every place of raw, from an odd multiple of its bytes read as a number."""
        kind = np.dtype(f"<u{width}")
        runs = np.ndarray(len(raw) - width + 1, kind, raw, 0, (1,))
        return (runs * kind.type(0x9E3779B97F4A7C15 & ((1 << 8 * width) - 1))) >> kind.type(8 * width - bits)

    def between(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Whether the sides may differ on each window raw[start:end]."""
        if not self.able:
            return np.ones(len(starts), bool)
        seen, found = np.frombuffer(raw, np.uint8), ends - starts >= WIDE
        for table, width, bits in self.tables:
            if len(seen) >= width:
                places = np.flatnonzero(table[self._slots(seen, width, bits)])
                found |= np.searchsorted(places, starts) < np.searchsorted(places, ends - (width - 1))
        return found


def _some(texts: list[str], most: int) -> list[list[bytes]]:
    """Training windows text by text, thinned by their hash where there are more than ``most``."""
    cut = [windows(t, WINDOW) for t in texts]
    n = sum(map(len, cut))
    if n <= most:
        return cut
    edge = int(most / n * (1 << 32))
    return [[w for w in x if int.from_bytes(hashlib.blake2b(w, digest_size=4).digest(), "big") < edge] for x in cut]


def _rank_share(a: np.ndarray, b: np.ndarray) -> float:
    """How often a value of a is above one of b; ties count half."""
    b = np.sort(b)
    return float((np.searchsorted(b, a, "left") + np.searchsorted(b, a, "right")).mean() / 2 / len(b))


class Model:
    """Both dictionaries and the curve that is calibrated with them; untrained without texts of both labels."""

    def __init__(self, ordinary: bytes = b"", toxic: bytes = b""):
        self.ordinary, self.toxic = ordinary, toxic
        #: Whether windows are left out that ``Contrast`` rules out: not before training windows have shown that it is right.
        self.skips = False
        self.weights = np.zeros(2 * len(STEPS) + 2)

    @classmethod
    def trained(cls, toxic: list[str], ordinary: list[str]) -> Model:
        """All steps in one process, on texts of both labels."""
        toxic, ordinary = [t for t in toxic if t.split()], [t for t in ordinary if t.split()]
        if len(toxic) < 2 or len(ordinary) < 2:
            return cls()
        model = max((cls.attempt(toxic, ordinary, split) for split in range(SPLITS)), key=lambda x: x[0])[1]
        model.calibrate(*(np.array([model.features(t) for t in texts]) for texts in (toxic, ordinary)))
        return model

    @classmethod
    def attempt(cls, toxic: list[str], ordinary: list[str], split: int) -> tuple[float, Model]:
        """The pair of dictionaries from one split in halves that tells training documents (some 200 of each label) apart best, and how well."""
        bad, plain = _some(toxic, SAMPLE_WINDOWS), _some(ordinary, SAMPLE_WINDOWS)
        best, tried = (-1.0, cls()), [cut[:: max(1, len(cut) // 200)] for cut in (bad, plain)]
        side = [i >> split & 1 for i in range(max(len(bad), len(plain)))]
        background, rest, chosen = cls._sides(bad, plain, side)
        for segment in LAST:
            model = cls(*(train_dictionary(s, ROUNDS[-1][0], segment).rjust(ROUNDS[-1][0], b"\0") + background for s in (rest, chosen)))
            saved = [[model._saved(x) for x in cut] for cut in tried]
            model.skips = model._holds([w for cut in tried for x in cut for w in x], np.concatenate([d for cut in saved for d in cut]))
            seen = [np.array([model._features([d]) for d in cut]) for cut in saved]
            weights = model._curve(*seen)
            best = max(best, (_rank_share(*(x @ weights for x in seen)), model), key=lambda x: x[0])
        return best

    def calibrate(self, toxic: np.ndarray, ordinary: np.ndarray) -> None:
        """The curve from the features of training texts of both labels."""
        self.weights = self._curve(toxic, ordinary)

    @staticmethod
    def _sides(bad: list[list[bytes]], plain: list[list[bytes]], side: list[int]) -> tuple[bytes, list[bytes], list[bytes]]:
        """Background dictionary and the windows that the ordinary and the toxic side are trained on at last."""
        background = train_dictionary([w for x, s in zip(plain, side) if s for w in x], BACKGROUND, 2 * SEGMENT)
        cost = compressor(background)
        rest = [w for x, s in zip(plain, side) if not s for w in x]
        each = cost(rest)
        edge = np.quantile(each, EXPLAINED)
        rest = [w for w, n in zip(rest, each) if n > edge] or rest
        kept = [[w for w, n in zip(x, cost(x)) if n > edge] for x in bad]
        for size, least in ROUNDS:
            ordinary = compressor(train_dictionary(rest, size) + background)
            halves = [[w for x, s in zip(kept, side) if s == f for w in x] or [w for x, s in zip(bad, side) if s == f for w in x] for f in (0, 1)]
            toxic = [compressor(train_dictionary(h, size) + background) for h in halves]
            kept = [[w for w, n in zip(x, ordinary(x) - toxic[1 - s](x)) if n >= least] for x, s in zip(bad, side)]
        return background, rest, [w for x in kept for w in x] or [w for x in bad for w in x]

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k[0] != "_"}

    def distances(self, text: str | None) -> np.ndarray:
        """Bytes that the toxic dictionary saves over the ordinary one, window by window."""
        return np.concatenate([np.zeros(0, np.int64), *self._pieces(text)])

    def _pieces(self, text: str | None) -> Iterator[np.ndarray]:
        """The distances of a text part by part, so that no more than a part's windows are held."""
        return (self._between(*_places(part)) for part in parts(text or ""))

    def _between(self, raw: bytes, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The distance of each window raw[start:end]."""
        if not hasattr(self, "_known"):
            self._known: dict[bytes, int] = {}
        known, distances = self._known, np.zeros(len(starts), np.int64)
        at = np.flatnonzero(self._contrast().between(raw, starts, ends)) if self.skips else np.arange(len(starts))
        cut = [HEAD + raw[a:b] + TAIL for a, b in zip(starts[at].tolist(), ends[at].tolist())]
        found = list(map(known.get, cut))
        # Windows come again and again; only those that the task does not remember are compressed.
        new = list({w: None for w, d in zip(cut, found) if d is None})
        if new:
            if len(known) + len(new) > HELD:
                known.clear()
            fresh = dict(zip(new, self._saved(new, True).tolist()))
            found = [fresh[w] if d is None else d for w, d in zip(cut, found)]
            if len(new) <= HELD:
                known.update(fresh)
        distances[at] = found
        return distances

    def _contrast(self) -> Contrast:
        if not hasattr(self, "_runs"):
            self._runs = Contrast(self.ordinary, self.toxic)
        return self._runs

    def _holds(self, cut: list[bytes], saved: np.ndarray) -> bool:
        """Whether every window that ``Contrast`` rules out is as long with both dictionaries."""
        ends = np.cumsum([len(w) for w in cut])
        return not saved[~self._contrast().between(b"".join(cut), np.r_[0, ends[:-1]], ends)].any()

    def _saved(self, cut: list[bytes], carried: bool = False) -> np.ndarray:
        if not hasattr(self, "_pair"):
            self._pair = compressor(self.ordinary), compressor(self.toxic)
        ordinary, toxic = self._pair
        return ordinary(cut, carried) - toxic(cut, carried)

    def features(self, text: str | None) -> np.ndarray:
        return self._features(self._pieces(text))

    @staticmethod
    def _features(pieces: Iterable[np.ndarray]) -> np.ndarray:
        count, total, n = np.zeros(len(STEPS)), 0, 0
        for d in pieces:
            count += [(d >= s).sum() for s in STEPS]
            total, n = total + d.sum(), n + len(d)
        n = max(n, 1)
        return np.r_[1.0, 10 * count / n, np.log1p(count), total / n]

    @staticmethod
    def _curve(toxic: np.ndarray, ordinary: np.ndarray) -> np.ndarray:
        """Weights of the logistic curve, by Newton's method with a little ridge."""
        x = np.vstack([toxic, ordinary])
        y = np.r_[np.ones(len(toxic)), np.zeros(len(ordinary))]
        weigh = np.where(y == 1, PRIOR / len(toxic), (1 - PRIOR) / len(ordinary))
        w = np.zeros(x.shape[1])
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
            grad = x.T @ (weigh * (p - y)) + 1e-4 * w
            w -= np.linalg.solve((x * (weigh * p * (1 - p))[:, None]).T @ x + 1e-4 * np.eye(len(w)), grad)
        return w

    def score(self, text: str | None) -> float:
        return self.scores([text])[0]

    def scores(self, texts: list[str | None]) -> list[float]:
        """The scores of several texts; neighbours of up to ``TOGETHER`` characters are compressed together."""
        if not self.toxic:
            return [0.0] * len(texts)
        out, held, size = [], [], 0
        for t in texts:
            size += len(t or "")
            if held and size > TOGETHER:
                out += self._features_of(held)
                held, size = [], len(t or "")
            held.append(t or "")
        return [float(1 / (1 + np.exp(-np.clip(x @ self.weights, -30, 30)))) for x in out + (self._features_of(held) if held else [])]

    def _features_of(self, texts: list[str]) -> list[np.ndarray]:
        if len(texts) == 1:
            return [self.features(texts[0])]
        raws, starts, ends = zip(*map(_places, texts))
        before = np.cumsum([0, *map(len, raws)])
        shift = np.repeat(before[:-1], list(map(len, starts)))
        found = self._between(b"".join(raws), np.concatenate(starts) + shift, np.concatenate(ends) + shift)
        return [self._features([d]) for d in np.split(found, np.cumsum([len(x) for x in starts])[:-1])]


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Model:
    """Fit on ``docs(doc_id, text)`` with ``labels(doc_id, toxic)``: about ``sample`` documents of each label.

    The bounded sample is chosen by a hash of doc_id, and by a hash of the text where many texts share
    an id.  Null texts and labels other than 0 and 1 teach nothing, nor do rows without an id; a document
    labelled more than once counts as toxic if any of its labels is; equal rows teach once.  The sample is sent to
    one task for each split in halves, which train and try dictionaries; the curve's features are made in tasks
    as well, and only they, one row for each training document, and the dictionaries come back.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    shares = {r["toxic"]: min(1.0, sample / r["n"]) for r in known.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    unit = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(23)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    keep = F.lit(False)
    for label, share in shares.items():
        keep |= (F.col("toxic") == label) & (unit < share)
    few = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(known.where(keep)), "doc_id").distinct()
    few = cut_(sample_by_hash(few, "text", 4 * sample))
    rows = [(r["toxic"], r["text"]) for r in few.orderBy("doc_id", "text").toLocalIterator() if r["text"].split()]
    sides = [t for y, t in rows if y == 1], [t for y, t in rows if y == 0]
    if min(map(len, sides)) < 2:
        return Model()
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast(pickle.dumps(sides))

    def attempts(batches):
        for batch in batches:
            for split in batch.column(0).to_pylist():
                apart, model = Model.attempt(*pickle.loads(sent.value), split)
                yield pa.RecordBatch.from_arrays([pa.array([split]), pa.array([apart]), pa.array([pickle.dumps(model)])], ["split", "apart", "model"])

    tried = spark.range(0, SPLITS, 1, SPLITS).mapInArrow(attempts, "split long, apart double, model binary").collect()
    model: Model = pickle.loads(max(tried, key=lambda r: (r["apart"], -r["split"]))["model"])

    def features(batches):
        for batch in batches:
            seen = [model.features(t) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("toxic"), pa.array([x.tolist() for x in seen], pa.list_(pa.float64()))], ["toxic", "x"])

    kind = few.schema["toxic"].dataType.simpleString()
    spread = few.where(F.length(F.trim("text")) > 0).repartition(16, "doc_id", "text").select("toxic", "text")
    seen = spread.mapInArrow(lean(features), f"toxic {kind}, x array<double>").collect()
    # In a fixed order, so that sums do not depend on the tasks'.
    model.calibrate(*(np.array(sorted(r["x"] for r in seen if r["toxic"] == y)) for y in (1, 0)))
    return model


def rate(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id`` and ``score`` of every row of ``docs(doc_id, text)``; whole texts, rows stay repeated.

    A null or empty text has no window, and every such text the same low score; an untrained model gives
    0.  A text of one word is one window; a long one is cut into windows part by part.  An empty table gives an empty result, extra columns are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(model))

    def run(batches):
        m: Model = pickle.loads(sent.value)
        known: dict[bytes, float] = {}
        for batch in batches:
            texts = batch.column("text").to_pylist()
            # Copies of a text are scored once for as long as the task remembers them.
            keys = [hashlib.blake2b((t or "").encode(), digest_size=16).digest() for t in texts]
            if len(known) > REMEMBERED:
                known.clear()
            new = {k: t for k, t in zip(keys, texts) if k not in known}
            known.update(zip(new, m.scores(list(new.values()))))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([known[k] for k in keys], pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """The query: learn from labelled documents with crc32(doc_id) mod 4 <> 2, score all documents.

    A row without a doc_id is not held out (and has no label to learn from).
    """
    fold = F.pmod(crc_of_id(F.col("doc_id")), F.lit(4))
    model = fit(docs.where(fold != 2), labels.where(fold != 2), sample)
    return rate(docs, model).select(
        "doc_id", F.coalesce(F.pmod(crc_of_id(F.col("doc_id")), F.lit(4)) == 2, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= CUT).cast("int").alias("predicted"),
    )

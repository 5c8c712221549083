"""Personal data by fixed patterns and a skip-chain conditional random field.

Patterns give the base spans.  The field labels the candidate tokens of a document (runs that hold a
digit or an @; every other token is outside by definition) with a kind or none.  Its factors: shape and
context features of a token, the step from the token before, and skip edges that tie a token to the
previous ones with the same letters and digits, or with the same trailing digits, wherever they stand.
Loopy sum-product messages run over chain and skip edges until they settle.  A repeated phone number
without its plus sign, say, takes the label of its well-formed twin.  Base spans are observed labels.

All weights are fitted by pseudo-likelihood on a bounded sample of documents, labelled by the patterns.
Since a corpus holds few twins, every sampled document is extended by a drawn token: either a well-formed one
and a twin of it whose marks are changed (labelled alike), or a broken one alone, once or twice (labelled
none).  Shape alone cannot tell these apart, so what the skip edges are worth is learned from them.
"""

from __future__ import annotations

import hashlib
import pickle
import random
import re
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, sample_by_hash

KINDS = ("email", "ip", "card", "phone")
LABELS = ("none", *KINDS)
#: Bound of the training sample in documents; message rounds; probability from which a token is a span.
SAMPLE, ROUNDS, LEAST = 2000, 30, 0.6
#: Characters of a document that teach at most.
TRAIN_CHARS = 10_000
#: Least number of drawn tokens in training.
DRAWN = 1500

#: Letters and digits that a token needs for skip edges.
LEAST_KEY = 6

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
#: Candidate tokens besides words around an @: numbers with their separators.
_NUMBER = re.compile(r"[+(]{0,2}[0-9](?:[\x20().\-/]{0,2}[0-9])*+")
_HOST = re.compile(r"[A-Za-z0-9.-]+")
_PARTS = re.compile(r"[0-9]+")
_NOT_KEY = re.compile(r"[^a-z0-9@]")
_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c)
        if i & 1:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[int, int]]:
    """As the pattern's leftmost matches, in one pass over the @ signs (no @ can be part of a local part)."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        m = _DOMAIN.match(text, at + 1)
        if m:
            begin = at
            while begin > done and text[begin - 1] in _LOCAL_CHARS:
                begin -= 1
            if begin < at:
                out.append((begin, m.end()))
                done = m.end()
        at = text.find("@", max(at + 1, done))
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the four patterns, by kind as listed and then by start; failing matches are dropped."""
    out = [("email", a, b) for a, b in _emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 8 <= sum(map(str.isdigit, m[0])) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def candidates(text: str, begin: int, end: int) -> list[tuple[int, int]]:
    """Candidate tokens of text[begin:end], from left to right, in one pass whatever their length."""
    out, done, at = [], begin, text.find("@", begin, end)
    while at >= 0:
        m = _HOST.match(text, at + 1, end)
        if m:
            a = at
            while a > done and text[a - 1] in _LOCAL_CHARS:
                a -= 1
            out += [n.span() for n in _NUMBER.finditer(text, done, a)]
            out.append((a, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done), end)
    return out + [n.span() for n in _NUMBER.finditer(text, done, end)]


class Tokens:
    """Candidate tokens of one text with features, chain steps and skip edges."""

    def __init__(self, text: str, base: list[tuple[str, int, int]]):
        self.spans, self.label, self.words = [], [], []
        taken = sorted((a, b, kind) for kind, a, b in base)
        # Base spans are tokens themselves; the gaps between them give the others.
        at = 0
        for a, b, kind in [*taken, (len(text), len(text), "")]:
            if a > at or not kind:
                for x, y in candidates(text, at, a):
                    self._add(text, x, y, -1)
            if kind and a >= at:
                self._add(text, a, b, LABELS.index(kind))
            at = max(at, b)
        self.edges = self._edges()

    def _add(self, text: str, a: int, b: int, label: int) -> None:
        self.spans.append((a, b))
        self.label.append(label)
        token = text[a:b]
        key = _NOT_KEY.sub("", token.lower())
        digits = sum(c.isdigit() for c in token)
        self.words.append((
            key, digits, "@" in token, token.count("."), token[:1] == "+", "(" in token,
            text[max(0, a - 12) : a].lower(), key[-7:] if digits >= 7 and "@" not in token else "",
            16 <= digits <= 19 and key.isdigit() and luhn(key),
            len(parts := _PARTS.findall(token)) == 4 and all(len(p) <= 3 and int(p) <= 255 for p in parts),
        ))

    def features(self, i: int) -> list[int]:
        """Active features: digits by range, marks, dots, the word before, whether the digits have a card's check, whether they are four bytes."""
        key, digits, mail, dots, plus, paren, before, _, valid, four = self.words[i]
        out = [0, 1 + min(digits, 20), 22 + mail, 24 + min(dots, 4), 29 + plus, 31 + paren]
        word = before.split()
        return [*out, 33 + (hash_word(word[-1]) % 64 if word else 64), 98 + valid, 100 + four]

    N_FEATURES = 102

    def _edges(self) -> list[tuple[int, int, int]]:
        """(i, j, kind): 0 chain, 1 same letters and digits, 2 same trailing digits.  Each token looks back to the last alike one, so edges grow with the tokens."""
        out, last, tail = [], {}, {}
        for i, w in enumerate(self.words):
            if i:
                out.append((i - 1, i, 0))
            if len(w[0]) >= LEAST_KEY:
                if w[0] in last:
                    out.append((last[w[0]], i, 1))
                elif w[7] and w[7] in tail:
                    out.append((tail[w[7]], i, 2))
                last[w[0]] = i
                if w[7]:
                    tail[w[7]] = i
        return out


def hash_word(word: str) -> int:
    return int.from_bytes(hashlib.blake2b(word.encode(), digest_size=4).digest(), "little")


def drawn_token(kind: str, rng: random.Random) -> str:
    """A random well-formed token of a kind."""
    digits = lambda n: "".join(rng.choice("0123456789") for _ in range(n))
    word = lambda a, b: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(a, b)))
    if kind == "email":
        return f"{word(2, 8)}.{word(2, 9)}@{word(3, 9)}.{rng.choice(['com', 'org', 'net', 'de', 'info'])}"
    if kind == "ip":
        return ".".join(str(rng.randint(1, 255)) for _ in range(4))
    if kind == "card":
        body = rng.choice("3456") + digits(rng.choice([14, 14, 14, 16, 17]))
        whole = next(body + c for c in "0123456789" if luhn(body + c))
        mark = rng.choice([" ", "-", ""])
        return mark.join(whole[i : i + 4] for i in range(0, len(whole), 4))
    mark = rng.choice([" ", "-"])
    return f"+{rng.choice('123456789')}{digits(rng.randint(0, 1))}{mark}{digits(rng.randint(2, 3))}{mark}{digits(3)}{mark}{digits(4)}"


def broken(kind: str, token: str, rng: random.Random) -> str:
    """The token with its marks changed so that its pattern does not hold."""
    if kind == "email":
        local, host = token.split("@")
        return f"{local.replace('.', rng.choice(['', '-', '_']))}@{host.replace('.', rng.choice(['', '-']))}"
    if kind == "ip":
        return token.replace(".", rng.choice(["-", "/", ". "]))
    if kind == "card":
        whole = "".join(filter(str.isdigit, token))
        return rng.choice([".", "/", "--"]).join(whole[i : i + 4] for i in range(0, len(whole), 4))
    shape = rng.choice(["bare", "slash", "local"])
    if shape == "bare":
        return token[1:]
    if shape == "slash":
        return re.sub("[ -]", "/", token[1:])
    return "0" + re.split("[ -]", token, maxsplit=1)[1]


def look_alike(kind: str, token: str, rng: random.Random) -> str:
    """A token of the kind's form that its checks refuse."""
    if kind == "email":
        return token.split(".com")[0].rpartition(".")[0] or token
    if kind == "ip":
        return token.rpartition(".")[0] + f".{rng.randint(256, 999)}"
    if kind == "card":
        return token[:-1] + str((int(token[-1]) + rng.randint(1, 9)) % 10)
    return token[1:] + "".join(rng.choice("0123456789") for _ in range(rng.randint(3, 6)))


def extended(text: str, kind: str, case: int, rng: random.Random) -> tuple[str, dict[int, int]]:
    """The text with drawn tokens, and the label of each twin by its start.

    case 0: a well-formed token and its broken twin; 1: a broken one alone; 2: a broken one or a look-alike twice.
    """
    token = drawn_token(kind, rng)
    twin = broken(kind, token, rng) if case < 2 or rng.random() < 0.5 else look_alike(kind, token, rng)
    words = text.split(" ")
    at = rng.randint(0, len(words))
    first = {0: [token], 1: [], 2: [twin]}[case]
    head = " ".join([*words[:at], *first, *words[at:], rng.choice(["and", "or", "see", "call", "of", ""])]) + " "
    whole = head + twin + rng.choice(["", ".", " again"])
    inside = any(a < len(head) + len(twin) and b > len(head) for _, a, b in base_spans(whole))
    return whole, {len(head): LABELS.index(kind)} if case == 0 and not inside else {}


class Field:
    """Weights: unary (feature, label) and one matrix (label, label) for each kind of edge."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray):
        self.unary, self.pair = unary, pair

    @classmethod
    def fit(cls, texts: list[str], steps: int = 1500, seed: int = 17) -> Field:
        """Pseudo-likelihood by gradient ascent: each token given the labels of its neighbours."""
        n, rng = len(LABELS), random.Random(seed)
        rows: list[tuple[list[int], list[tuple[int, int]], int]] = []
        for i in range(max(len(texts), DRAWN) if texts else 0):
            text = texts[i % len(texts)]
            if len(text) > TRAIN_CHARS:  # A drawn part: the design matrix has a row for each token.
                at = rng.randrange(len(text) - TRAIN_CHARS)
                text = text[at : at + TRAIN_CHARS]
            if i >= len(texts):  # A small sample is used again, in parts of 100 words.
                words = text.split(" ")
                at = rng.randrange(len(words))
                text = " ".join(words[at : at + 100])
            text, twins = extended(text, KINDS[i % len(KINDS)], i // len(KINDS) % 3, rng)
            tok = Tokens(text, base_spans(text))
            label = [max(0, y) or twins.get(a, 0) for y, (a, _) in zip(tok.label, tok.spans)]
            near = defaultdict(list)
            for i, j, k in tok.edges:
                near[i].append((k, label[j]))
                near[j].append((k, label[i]))
            rows += [(tok.features(i), near[i], y) for i, y in enumerate(label)]
        field = cls(np.zeros((Tokens.N_FEATURES, n)), np.zeros((3, n, n)))
        if not rows:
            return field
        x = np.zeros((len(rows), Tokens.N_FEATURES + 3 * n), np.float32)
        target = np.eye(n)[[r[2] for r in rows]]
        for i, (active, near, _) in enumerate(rows):
            x[i, active] = 1
            for k, other in near:
                x[i, Tokens.N_FEATURES + k * n + other] += 1
        # Equal rows count together: plain numbers are many and much alike.
        x, at = np.unique(x, axis=0, return_inverse=True)
        counts = np.zeros((len(x), n))
        np.add.at(counts, at.reshape(-1), target)
        total = counts.sum(axis=1, keepdims=True)
        w, speed, square = np.zeros((x.shape[1], n)), np.zeros((x.shape[1], n)), np.zeros((x.shape[1], n))
        for step in range(1, steps + 1):  # Adam
            z = x @ w
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            grad = x.T @ (counts - total * p) / len(rows) - 1e-5 * w
            speed, square = 0.9 * speed + 0.1 * grad, 0.999 * square + 0.001 * grad**2
            w += 0.05 * (speed / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        field.unary = w[: Tokens.N_FEATURES]
        pair = w[Tokens.N_FEATURES :].reshape(3, n, n)
        field.pair = (pair + pair.transpose(0, 2, 1)) / 2
        return field

    def marginals(self, tok: Tokens, rounds: int = ROUNDS) -> np.ndarray:
        """Loopy sum-product over chain and skip edges; base labels are observed."""
        n, size = len(LABELS), len(tok.spans)
        unary = np.zeros((size, n))
        for i in range(size):
            unary[i] = self.unary[tok.features(i)].sum(axis=0)
            if tok.label[i] >= 0:
                unary[i] = -50.0
                unary[i, tok.label[i]] = 0.0
        if not tok.edges:
            e = np.exp(unary - unary.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)
        one = np.array([(i, j) for i, j, _ in tok.edges])
        src, dst = np.r_[one[:, 0], one[:, 1]], np.r_[one[:, 1], one[:, 0]]
        factor = np.exp(self.pair)[np.tile([k for _, _, k in tok.edges], 2)]
        back = np.r_[np.arange(len(one), 2 * len(one)), np.arange(len(one))]
        msg = np.zeros((len(src), n))  # logarithms
        for _ in range(rounds):
            belief = unary.copy()
            np.add.at(belief, dst, msg)
            out = belief[src] - msg[back]
            e = np.exp(out - out.max(axis=1, keepdims=True))
            new = np.log(np.einsum("ei,eij->ej", e, factor))
            new -= new.max(axis=1, keepdims=True)
            settled = np.abs(new - msg).max() < 1e-4
            msg = 0.5 * msg + 0.5 * new
            if settled:
                break
        belief = unary.copy()
        np.add.at(belief, dst, msg)
        e = np.exp(belief - belief.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)


def added_spans(text: str, base: list[tuple[str, int, int]], field: Field, least: float = LEAST) -> list[tuple[str, int, int]]:
    """Spans that the field adds: tokens with a skip edge, labelled surely enough.

    A token without a skip edge is left to the patterns.
    """
    if not base and len(text) < 2 * LEAST_KEY:
        return []
    tok = Tokens(text, base)
    live = {i for a, b, k in tok.edges if k for i in (a, b)}
    if all(tok.label[i] >= 0 for i in live):
        return []
    p = field.marginals(tok)
    out = []
    for i in sorted(live):
        best = int(p[i].argmax())
        if tok.label[i] < 0 and best and p[i, best] >= least:
            out.append((LABELS[best], *tok.spans[i]))
    return out


def digest(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate(KINDS)}
    return ",".join(f"{k}:{a}:{b}" for k, a, b in sorted(spans, key=lambda s: (order[s[0]], s[1], s[2])))


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with every span, overlaps joined, replaced by [KIND]."""
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"[{kind.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def fit(docs: DataFrame, sample: int = SAMPLE) -> Field:
    """Fit on about ``sample`` different documents that hold a digit or an @, chosen by a hash of id and text.

    Of a text longer than ``TRAIN_CHARS`` a drawn part of that length teaches, so the fit is bounded in characters.
    A table without such documents gives a field that adds nothing.
    """
    few = sample_by_hash(docs.where(F.col("text").rlike("[0-9@]")).select("doc_id", "text"), ("doc_id", "text"), sample)
    return Field.fit([r["text"] for r in few.orderBy("doc_id", "text").toLocalIterator()])


def find(docs: DataFrame, field: Field, least: float = LEAST, redacted: bool = True, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``keep`` columns, counts and digest of the base spans, all spans, their number beyond the base and, if asked, the redacted text.

    A null text is an empty one.  Repeated rows stay repeated, also with a null id.  Offsets are code points,
    end exclusive; a text of any length is searched whole, in time that grows with it.  An empty table gives
    an empty result; columns besides ``keep`` and text are ignored.
    """
    sent = docs.sparkSession.sparkContext.broadcast(pickle.dumps(field))

    def run(batches):
        f: Field = pickle.loads(sent.value)
        for batch in batches:
            rows = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                base = base_spans(text)
                added = added_spans(text, base, f, least)
                spans = base + added
                counts = [sum(s[0] == k for s in base) for k in KINDS]
                rows.append((*counts, hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans), len(added), *([redact(text, spans)] if redacted else [])))
            kinds = [*[pa.int64()] * 4, pa.string(), pa.string(), pa.int64(), *[pa.string()] * redacted]
            cols = list(zip(*rows)) if rows else [[]] * len(kinds)
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in keep), *(pa.array(c, t) for c, t in zip(cols, kinds))],
                [*keep, *(f"n_{k}" for k in KINDS), "base_sha256", "spans", "n_added", *["redacted"] * redacted],
            )

    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(*dict.fromkeys([*keep, "text"])).mapInArrow(lean(run), f"{kept}, {counts}, base_sha256 string, spans string, n_added long" + ", redacted string" * redacted)


def search(docs: DataFrame) -> DataFrame:
    """The query: spans of all documents, without the redacted text."""
    return find(docs, fit(docs), redacted=False)

"""Toxicity by a linear-chain conditional random field over words.

Two states, plain and toxic. Only documents carry labels, so words of a bounded sample of labelled documents are
labelled from them first: words and word beginnings that occur in toxic documents far more than in clean ones mark
tokens of toxic documents. The field learns weights for those words and beginnings and for the four transitions by
gradient ascent on the likelihood of the labelled tokens. Forward-backward marginals then tag any text, and a logistic
model turns a document's marginals into its score.

Words without a weight of their own all emit alike, so a run of g such words between two others is one power of a 2 x 2
matrix: marginals at all words with weights are exact, at the cost of those words alone.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words

#: Bounds of the sample that the model is fitted on: labelled rows of each class, and characters of a row that may be in it.
SAMPLE_ROWS, SAMPLE_CHARS = 3000, 20_000
STEMS = (4, 5, 6)
WINDOW = 9
SPANS = "array<struct<first:int,start:int,stop:int,p:double>>"
SCHEMA = f"score double, spans {SPANS}"


class Model(NamedTuple):
    weights: dict[bytes, float]  # of whole words, and of beginnings as b"len:beginning"
    bias: float  # of the toxic state, at every word
    trans: tuple[float, float, float, float]  # log potentials plain>plain, plain>toxic, toxic>plain, toxic>toxic
    score: tuple[float, ...]  # logistic weights of features()
    prior: float  # score of a text without any marked word


def features(ps: list[float], n: int) -> list[float]:
    total = sum(ps)
    return [1.0, max(ps, default=0.0), np.log1p(total), total / max(1, n) ** 0.5]


def _keys(w: bytes) -> list[bytes]:
    return [w, *(b"%d:%s" % (k, w[:k]) for k in STEMS if len(w) > k)]


def _mined(docs: list[tuple[list[bytes], int]], least: int = 4, ratio: float = 20.0) -> set[bytes]:
    """Words and beginnings that mark toxic documents: in `least` or more, and `ratio` times as frequent there."""
    size = [sum(y == k for _, y in docs) for k in (0, 1)]
    if not all(size):
        return set()
    keys = lambda ws: {k for w in set(ws) for k in _keys(w)}
    toxic: Counter = Counter()
    for ws, y in docs:
        if y:
            toxic.update(keys(ws))
    toxic = Counter({k: n for k, n in toxic.items() if n >= least})
    clean: Counter = Counter()  # of what toxic documents hold: the rest tells nothing
    for ws, y in docs:
        if not y:
            clean.update(k for k in keys(ws) if k in toxic)
    return {k for k, n in toxic.items() if (n / size[1]) / ((clean[k] + 0.5) / size[0]) >= ratio}


def _forward_backward(emit: np.ndarray, trans: np.ndarray):
    """Marginals (n, T) of the toxic state, expected transitions (2, 2) and log partition (n) of sequences of emissions (n, T)."""
    n, t = emit.shape
    m = np.exp(trans)
    e = np.stack([np.ones_like(emit), np.exp(emit)], 2)
    a, b, scale = np.empty((n, t, 2)), np.ones((n, t, 2)), np.empty((n, t))
    for i in range(t):
        x = e[:, 0] if i == 0 else (a[:, i - 1] @ m) * e[:, i]
        scale[:, i] = x.sum(1)
        a[:, i] = x / scale[:, i, None]
    for i in range(t - 2, -1, -1):
        b[:, i] = ((b[:, i + 1] * e[:, i + 1]) @ m.T) / scale[:, i + 1, None]
    pair = np.einsum("nti,ij,ntj,ntj,nt->ij", a[:, :-1], m, e[:, 1:], b[:, 1:], 1 / scale[:, 1:])
    return a[:, :, 1] * b[:, :, 1], pair, np.log(scale).sum(1)


def fit(rows: list[tuple[bytes | None, int]], share: float, steps: int = 150, rate: float = 0.1) -> Model:
    """A model from (UTF-8 text, 0 or 1) rows; share is the share of toxic rows among all labelled ones."""
    one: dict[bytes, bytes] = {}  # one object a word
    docs = [([one.setdefault(w, w) for w in words(t)], y) for t, y in rows]
    marks = _mined(docs)
    if not marks:
        return Model({}, 0.0, (0.0, 0.0, 0.0, 0.0), (0.0,) * 4, share)
    index = {k: i for i, k in enumerate(sorted(marks))}
    seqs: list[list[tuple[int, ...]]] = []
    tags: list[list[int]] = []
    for ws, y in docs:
        hits = [i for i, w in enumerate(ws) if any(k in marks for k in _keys(w))]
        centres = {i // WINDOW for i in hits} | ({len(ws) // 2 // WINDOW} if ws else set())
        for c in sorted(centres):
            part = ws[c * WINDOW : (c + 1) * WINDOW]
            fs = [tuple(index[k] for k in _keys(w) if k in index) for w in part] + [()] * (WINDOW - len(part))
            seqs.append(fs)
            tags.append([int(bool(y and f)) for f in fs])
    at = np.array([(s, t, f) for s, q in enumerate(seqs) for t, fs in enumerate(q) for f in fs], int).reshape(-1, 3)
    y = np.array(tags, float)
    pairs = np.array([[((y[:, :-1] == i) & (y[:, 1:] == j)).sum() for j in (0, 1)] for i in (0, 1)], float)
    theta = np.zeros(len(index) + 5)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    for step in range(1, steps + 1):
        emit = np.full(y.shape, theta[-5])
        np.add.at(emit, (at[:, 0], at[:, 1]), theta[at[:, 2]])
        p, expected, _ = _forward_backward(emit, theta[-4:].reshape(2, 2))
        grad = np.empty_like(theta)
        gap = y - p
        grad[:-5] = np.bincount(at[:, 2], gap[at[:, 0], at[:, 1]], len(index))
        grad[-5] = gap.sum()
        grad[-4:] = (pairs - expected).ravel()
        grad = grad / len(seqs) - 1e-4 * theta
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        theta += rate * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-8)
    weights = {k: float(theta[i]) for k, i in index.items()}
    model = Model(weights, float(theta[-5]), tuple(theta[-4:].tolist()), (0.0,) * 4, share)
    tagger = Tagger(model)
    x = np.array([features([q for _, _, _, q in tagger.spans(ws)], len(ws)) for ws, _ in docs])
    z = np.array([t for _, t in docs], float)
    w = np.where(z == 1, share / max(1e-9, z.mean()), (1 - share) / max(1e-9, 1 - z.mean()))
    beta = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps, with a small pull to zero
        q = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        h = (x * (w * q * (1 - q))[:, None]).T @ x + 1e-2 * np.eye(len(beta))
        beta += np.linalg.solve(h, x.T @ (w * (z - q)) - 1e-2 * beta)
    return model._replace(score=tuple(beta.tolist()), prior=float(1 / (1 + np.exp(-np.clip(beta[0], -30, 30)))))


class Tagger:
    """Marginals and scores by a model; remembers words' weights up to a bound."""

    def __init__(self, model: Model, room: int = 100_000):
        self.model, self.room, self.known = model, room, {}
        self.trans = np.exp(np.array(model.trans).reshape(2, 2))
        plain = self.trans @ np.diag([1.0, np.exp(model.bias)])
        # A power is a sum of two matrices, each with an eigenvalue's power: exact for a run of any length.
        mid, half = np.trace(plain) / 2, np.sqrt(((plain[0, 0] - plain[1, 1]) / 2) ** 2 + plain[0, 1] * plain[1, 0])
        self.ratio = (mid - half) / (mid + half)
        self.lasting, self.fading = (plain - (mid - half) * np.eye(2)) / (2 * half), ((mid + half) * np.eye(2) - plain) / (2 * half)
        self.powers: dict[int, np.ndarray] = {}

    def run(self, gap: int) -> np.ndarray:
        """What `gap` words without weights do, but for a factor: only proportions matter."""
        if (x := self.powers.get(gap)) is None:
            x = self.lasting + self.ratio**gap * self.fading
            if gap < 1000:
                self.powers[gap] = x
        return x

    def weight(self, w: bytes) -> float:
        """0.0 for a word without any weight of its own."""
        get = self.model.weights.get
        x = sum(get(k, 0.0) for k in _keys(w))
        if len(self.known) > self.room:
            self.known.clear()
        self.known[w] = x
        return x

    def spans(self, ws: list[bytes]) -> list[tuple[int, int, int, float]]:
        """(word, byte start, byte stop in the words joined by one blank, marginal) of all words with a weight."""
        known = self.known
        xs = list(map(known.get, ws))
        if None in xs:
            xs = [self.weight(w) if x is None else x for w, x in zip(ws, xs, strict=True)]
        at = [i for i, x in enumerate(xs) if x]
        if not at:
            return []
        bias = self.model.bias
        steps, emits, before = [], [], -1
        for i in at:
            gap = i - before - 1
            if before < 0:
                first = np.array([1.0, np.exp(bias)])
                steps.append(np.ones(2) if not gap else (first @ self.run(gap - 1)) @ self.trans)
            else:
                steps.append(self.run(gap) @ self.trans)
            emits.append(np.array([1.0, np.exp(min(30.0, bias + xs[i]))]))
            before = i
        ahead = []
        for s, e in zip(steps, emits, strict=True):
            x = (s if not ahead else ahead[-1] @ s) * e
            ahead.append(x / x.sum())
        back = self.run(len(ws) - 1 - at[-1]) @ np.ones(2)
        ps = []
        for k in range(len(at) - 1, -1, -1):
            x = ahead[k] * back
            ps.append(float(x[1] / x.sum()))
            if k:
                back = steps[k] @ (emits[k] * back)
                back = back / back.sum()
        ps.reverse()
        out, pos, start = [], 0, 0
        for i, p in zip(at, ps, strict=True):
            start += sum(map(len, ws[pos:i])) + i - pos
            out.append((i, start, start + len(ws[i]), p))
            pos = i
        return out

    def score(self, ws: list[bytes], spans) -> float:
        if not spans:
            return self.model.prior
        x = sum(a * b for a, b in zip(self.model.score, features([p for *_, p in spans], len(ws)), strict=True))
        return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text: str = "text", label: str = "toxic", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Model:
    """Fit on at most `rows` labelled documents of each class of at most `chars` characters, first by a hash of their ids.

    Held-out rows are to be taken off labels before. Several labels of one id: the largest. Ids without a document,
    null labels and null ids are no rows. Without rows of both classes the model scores everything alike: by the share
    of toxic labels, or 0 without any.
    """
    known = labels.where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(F.col(id_col).cast("long").alias("__id")).agg(F.max(F.col(label)).cast("int").alias("__y"))
    n = {r["__y"]: r["count"] for r in known.groupBy("__y").count().collect()}  # two rows
    sample = None
    for y in (0, 1):
        part = known.where(F.col("__y") == y).orderBy(F.xxhash64("__id"), "__id").limit(rows)
        sample = part if sample is None else sample.unionByName(part)
    # At most 2 * rows ids are broadcast, and at most that many texts of bounded length are gathered.
    picked = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text).cast("binary").alias("t")).where(F.length("t") <= chars)
    picked = picked.join(F.broadcast(sample), "__id").groupBy("__id").agg(F.min("t").alias("t"), F.max("__y").alias("y"))
    got = picked.toArrow().sort_by("__id")
    return fit(list(zip(got["t"].to_pylist(), got["y"].to_pylist(), strict=True)), n.get(1, 0) / max(1, sum(n.values())))


def score_documents(docs: DataFrame, model: Model, text: str = "text", out: str = "toxicity") -> DataFrame:
    """docs with a struct column (SCHEMA): score, and the words tagged toxic (marginal of 0.5 or more) with their offsets.

    first is the word's number from 0, start and stop are byte offsets in the lower-cased words joined by one blank.
    Null and empty texts get the score of a text without any marked word. Every row stays; whole texts are read, however
    long; repeated rows and ties each get the same score; an empty table gives no rows. A column named `out` is
    replaced, others are left alone.
    """

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        tagger = Tagger(model)
        for x in batches:
            scores, spans = [], []
            for t in x:
                found = tagger.spans(ws := words(t))
                scores.append(tagger.score(ws, found))
                spans.append([{"first": i, "start": a, "stop": b, "p": p} for i, a, b, p in found if p >= 0.5])
            yield pd.DataFrame({"score": scores, "spans": spans})

    return docs.withColumn(out, run(F.col(text).cast("binary")))


def held_out(c):
    """Rows never learnt from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))

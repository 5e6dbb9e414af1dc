"""Secret scan: three fixed patterns, and a character convolutional network over every other candidate.

A candidate is a run of key characters that is long and mixed enough to be a credential. The network reads it with the
characters around it: embedded characters, one convolution, maxima over the candidate and over its surroundings and the
mean over the candidate, one logistic unit. It is trained on labelled findings: credentials and harmless look-alikes
placed into texts of a bounded sample of documents, and the candidates that these documents hold themselves, labelled by
the fixed patterns. Platt's method calibrates its scores on findings that it has not seen, and the threshold is the
highest one that keeps the wanted recall there.
"""

from __future__ import annotations

import hashlib
import random
import re
import string
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The patterns whose matches are findings at once, by kind, with the least length of what they find.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
ASSIGNED, KINDS = 6, ("assign", "access", "hex", "network")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
_LETTER, _DIGIT = re.compile("[A-Za-z]"), re.compile("[0-9]")
#: Runs of at least so many characters are candidates without a digit or a letter, too.
LONG = 20

#: Characters left of, in and right of the part of a candidate that one window shows.
LEFT, CORE, RIGHT = 24, 48, 8
WIDTH = LEFT + CORE + RIGHT
ALPHABET = string.ascii_lowercase + string.digits + " \n\"'`:=+/_.-@#$%&*()[]{}<>,;!?|~^\\"
SYMBOLS = len(ALPHABET) + 2  # 0: nothing there; the last: any other character
_CODE = np.full(0x80, SYMBOLS - 1, np.uint8)
for _i, _c in enumerate(ALPHABET):
    _CODE[ord(_c)] = _CODE[ord(_c.upper())] = _i + 1
DIM, SPAN, FILTERS = 10, 5, 24

#: Bounds of what the network is trained on: documents of the sample, characters of one, findings made of each label.
SAMPLE_DOCS, SAMPLE_CHARS, FINDINGS = 4000, 20_000, 3000
RECALL = 0.95

SPANS = "array<struct<kind:string,start:int,stop:int,score:double>>"
SCHEMA = f"n_assign long, n_access long, n_hex long, n_candidates long, base_sha256 string, spans {SPANS}"


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind's number, stop) of the fixed patterns' matches, in code points, sorted; matches of one kind do not overlap."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGNED]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text)]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, stop) of all runs that may be credentials."""
    out = []
    for m in CANDIDATE.finditer(text):
        run = m[0]
        if len(run) >= LONG or (_DIGIT.search(run) and _LETTER.search(run)):
            out.append(m.span())
    return out


def windows(text: str, start: int, stop: int) -> list[np.ndarray]:
    """What the network sees of a candidate: one window for every CORE characters of it, so that long ones are read whole.

    A window has WIDTH codes; 0x80 marks the candidate's own characters and 0x100 upper case.
    """
    out = []
    for a in range(start, stop, CORE):
        b = min(stop, a + CORE)
        raw = np.frombuffer(text[max(0, a - LEFT) : b + RIGHT].encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.where(raw < 0x80, _CODE[np.minimum(raw, 0x7F)], SYMBOLS - 1).astype(np.int16)
        codes[(raw >= 65) & (raw <= 90)] |= 0x100
        lead = a - max(0, a - LEFT)
        own = np.arange(len(raw)) - lead
        lo, hi = start - a, stop - a
        codes[(own >= lo) & (own < hi)] |= 0x80
        w = np.zeros(WIDTH, np.int16)
        w[LEFT - lead : LEFT - lead + len(raw)] = codes
        out.append(w)
    return out


class Model(NamedTuple):
    """Weights; a and b calibrate the logit, threshold applies to the calibrated score, recall is what it kept on unseen findings."""

    embed: np.ndarray  # (SYMBOLS, DIM)
    conv: np.ndarray  # (SPAN * (DIM + 2), FILTERS)
    bias: np.ndarray  # (FILTERS,)
    dense: np.ndarray  # (3 * FILTERS + 1,)
    a: float = 1.0
    b: float = 0.0
    threshold: float = 0.5
    recall: float = 0.0


def _forward(m: Model, x: np.ndarray):
    """Logits of windows x (n, WIDTH), with what the gradient needs."""
    sym, own = x & 0x7F, ((x & 0x80) != 0).astype(np.float32)
    e = np.concatenate([m.embed[sym], own[..., None], ((x & 0x100) != 0).astype(np.float32)[..., None]], 2)
    pad = np.pad(e, ((0, 0), (SPAN // 2, SPAN // 2), (0, 0)))
    cols = np.lib.stride_tricks.sliding_window_view(pad, SPAN, axis=1).transpose(0, 1, 3, 2).reshape(len(x), WIDTH, -1)
    h = np.maximum(cols @ m.conv + m.bias, 0)
    inside = own[..., None]
    top_in, top_out = (h * inside).argmax(1), (h * (1 - inside)).argmax(1)
    n = np.maximum(inside.sum(1), 1)
    f = np.concatenate([np.take_along_axis(h * inside, top_in[:, None], 1)[:, 0], np.take_along_axis(h * (1 - inside), top_out[:, None], 1)[:, 0], (h * inside).sum(1) / n, np.ones((len(x), 1), np.float32)], 1)
    return f @ m.dense, (sym, cols, h, inside, top_in, top_out, n, f)


def logits(m: Model, x: np.ndarray, many: int = 2048) -> np.ndarray:
    return np.concatenate([_forward(m, x[i : i + many])[0] for i in range(0, len(x), many)]) if len(x) else np.zeros(0, np.float32)


def _gradient(m: Model, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> list[np.ndarray]:
    z, (sym, cols, h, inside, top_in, top_out, n, f) = _forward(m, x)
    dz = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y) * w / len(x)).astype(np.float32)
    df = dz[:, None] * m.dense
    dh = np.zeros_like(h)
    k = FILTERS
    rows, cells = np.arange(len(x))[:, None], np.arange(k)[None]
    dh[rows, top_in, cells] += df[:, :k] * inside[rows, top_in, 0]
    np.add.at(dh, (rows, top_out, cells), df[:, k : 2 * k] * (1 - inside)[rows, top_out, 0])
    dh += df[:, None, 2 * k : 3 * k] * inside / n[:, None]
    dh *= h > 0
    dconv = np.einsum("nls,nlf->sf", cols, dh, optimize=True)
    dcols = (dh @ m.conv.T).reshape(len(x), WIDTH, SPAN, DIM + 2)[..., :DIM]
    dembed = np.zeros_like(m.embed)
    half = SPAN // 2
    for j in range(SPAN):
        lo, hi = max(0, j - half), WIDTH + min(0, j - half)  # position i reads character i + j - half
        np.add.at(dembed, sym[:, lo:hi], dcols[:, lo - (j - half) : hi - (j - half), j])
    return [dembed, dconv, dh.sum((0, 1)), f.T @ dz]


def fit(x: np.ndarray, y: np.ndarray, groups: np.ndarray, recall: float = RECALL, epochs: int = 10, batch: int = 64, rate: float = 0.004, seed: int = 7) -> Model:
    """A network from windows x and labels y. Rows whose group modulo 4 is 3 calibrate it and set the threshold; it never trains on them.

    Without rows of both labels on both sides the model's threshold is above every score: it adds nothing.
    """
    rng = np.random.default_rng(seed)
    m = Model(
        rng.normal(0, 0.3, (SYMBOLS, DIM)).astype(np.float32), rng.normal(0, 0.15, (SPAN * (DIM + 2), FILTERS)).astype(np.float32),
        np.zeros(FILTERS, np.float32), rng.normal(0, 0.1, 3 * FILTERS + 1).astype(np.float32), threshold=2.0,
    )
    test = groups % 4 == 3
    if any(len(set(y[s])) < 2 for s in (test, ~test)):
        return m
    xs, ys = x[~test], y[~test].astype(np.float32)
    weight = np.where(ys == 1, 0.5 / ys.mean(), 0.5 / (1 - ys.mean())).astype(np.float32)
    first, second, step = [np.zeros_like(p) for p in m[:4]], [np.zeros_like(p) for p in m[:4]], 0
    for epoch in range(epochs):
        order = rng.permutation(len(xs))
        for i in range(0, len(xs), batch):
            pick, step = order[i : i + batch], step + 1
            for p, g, u, v in zip(m[:4], _gradient(m, xs[pick], ys[pick], weight[pick]), first, second, strict=True):
                g = g + 1e-4 * p
                u += 0.1 * (g - u)
                v += 0.01 * (g * g - v)
                p -= rate * (0.3 if epoch * 2 >= epochs else 1.0) * (u / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
    z, yt = logits(m, x[test]).astype(float), y[test].astype(float)
    a, b = 1.0, 0.0
    n1, n0 = yt.sum(), len(yt) - yt.sum()
    goal = np.where(yt == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))  # Platt's targets
    d = np.stack([z, np.ones_like(z)], 1)
    for _ in range(30):  # Newton steps, with a small pull to (1, 0)
        p = 1 / (1 + np.exp(-np.clip(d @ [a, b], -30, 30)))
        hess = (d * (p * (1 - p))[:, None]).T @ d + 1e-3 * np.eye(2)
        a, b = np.array([a, b]) - np.linalg.solve(hess, d.T @ (p - goal) + 1e-3 * np.array([a - 1, b]))
    p = 1 / (1 + np.exp(-np.clip(a * z + b, -30, 30)))
    mine = np.sort(p[yt == 1])
    at = int(np.floor((1 - recall) * len(mine)))  # so many of the unseen findings may be missed
    return m._replace(a=float(a), b=float(b), threshold=float(mine[at]), recall=float((p[yt == 1] >= mine[at]).mean()))


def scores(m: Model, x: np.ndarray) -> np.ndarray:
    """Calibrated scores, 0 to 1."""
    return 1 / (1 + np.exp(-np.clip(m.a * logits(m, x).astype(float) + m.b, -30, 30)))


def _credential(r: random.Random) -> str:
    pick = lambda chars, n: "".join(r.choices(chars, k=n))
    alnum = string.ascii_letters + string.digits
    make = (
        lambda: pick("0123456789abcdef", r.choice((16, 18, 20, 32, 40, 64))),
        lambda: pick("0123456789ABCDEF", r.choice((24, 32, 40))),
        lambda: "AKIA" + pick(string.ascii_uppercase + string.digits, 16),
        lambda: r.choice(("ghp_", "gho_", "sk_live_", "pk_live_", "xoxb-", "glpat-", "SG.", "AIza")) + pick(alnum + "_-", r.randint(20, 40)),
        lambda: pick(alnum, r.randint(16, 44)),
        lambda: pick(alnum + "+/", r.choice((22, 32, 42, 64, 86))) + r.choice(("", "=", "==")),
        lambda: ".".join(("eyJ" + pick(alnum + "_-", r.randint(15, 30)), "eyJ" + pick(alnum + "_-", r.randint(20, 60)), pick(alnum + "_-", 43))),
        lambda: pick(alnum + "_.-", r.randint(9, 16)),
    )
    while not _DIGIT.search(x := r.choice(make)()) or not _LETTER.search(x) or not CANDIDATE.fullmatch(x):
        pass
    return x


def _harmless(r: random.Random, words: list[str]) -> str:
    word, digits = lambda: r.choice(words), lambda a, b: "".join(r.choices(string.digits, k=r.randint(a, b)))
    make = (
        lambda: f"{word()}.{word()}.{digits(1, 3)}", lambda: f"{word()}_{word()}_{digits(1, 4)}", lambda: f"/{word()}/{word()}/{word()}{digits(1, 2)}.txt",
        lambda: f"www.{word()}{digits(1, 2)}.example.com", lambda: f"{word()}-{word()}-{word()}-{digits(1, 2)}", lambda: f"2024-{digits(2, 2)}-{digits(2, 2)}T{digits(2, 2)}",
        lambda: f"v{digits(1, 2)}.{digits(1, 2)}.{digits(1, 3)}-beta{digits(1, 1)}", lambda: word().capitalize() + word().capitalize() + word().capitalize() + digits(1, 2), lambda: r.choice("-=_.") * r.randint(20, 60),
        lambda: word() * 4, lambda: f"{word()}{digits(2, 3)}.{word()}{digits(1, 2)}.example.com", lambda: word() + word() + word() + digits(2, 4), lambda: digits(20, 24),
    )
    while not (x := candidates(made := r.choice(make)())) or x[0] != (0, len(made)):
        pass
    return made


def findings(texts: list[str], n: int = FINDINGS, seed: int = 7) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows, labels and groups: n credentials and n look-alikes placed into texts, and the texts' own candidates, labelled by the fixed patterns.

    A group is one placed finding or one text, so that no text's candidates are on both sides of a split.
    """
    r = random.Random(seed)
    pool = [w for t in texts for w in re.findall("[a-z]{3,8}", t[:2000].lower())] or ["some", "words", "here"]
    leads = ("", "", "", 'key = "', "password: ", "secret=", "auth ", "Bearer ", "credentials: ", 'token = "', "pwd=", "access key ", "passphrase is ", "client_secret=")
    harmless = ("", "", "", "see ", "file ", "from ", 'name = "', "version ", "id: ", "host=", "mail ")
    x, y, groups = [], [], []

    def add(text: str, start: int, stop: int, label: int, group: int):
        ws = windows(text, start, stop)
        x.extend(ws)
        y.extend([label] * len(ws))
        groups.extend([group] * len(ws))

    for i in range(2 * n):
        secret = i % 2
        made = _credential(r) if secret else _harmless(r, pool)
        lead = r.choice(leads if secret else harmless)
        t = r.choice(texts) if texts else ""
        at = r.randrange(len(t) + 1) if t else 0
        before, after = t[max(0, at - 40) : at] + " " + lead, ('"' if lead.endswith('"') else r.choice((" ", "\n", ", ", ". X"))) + t[at : at + 20]
        add(before + made + after, len(before), len(before) + len(made), secret, i // 2)
    for i, t in enumerate(texts):
        base = base_spans(t)
        for a, b in candidates(t):
            add(t, a, b, int(any(s < b and a < e for s, _, e in base)), n + i)
    return (np.stack(x) if x else np.zeros((0, WIDTH), np.int16)), np.array(y, int), np.array(groups, int)


def train(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rows: int = SAMPLE_DOCS, chars: int = SAMPLE_CHARS, made: int = FINDINGS, recall: float = RECALL) -> Model:
    """Fit on findings in at most `rows` documents of at most `chars` characters, first by a hash of their ids.

    Null ids and null texts are no part of the sample; of repeated ids the smallest text. An empty table leaves only the
    placed findings. The same documents give the same model, however they are partitioned.
    """
    ids = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("__id")).distinct().orderBy(F.xxhash64("__id"), "__id").limit(rows)
    picked = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__t")).where(F.length("__t") <= chars)
    # At most `rows` ids are broadcast, and at most that many texts of bounded length are gathered.
    got = picked.join(F.broadcast(ids), "__id").groupBy("__id").agg(F.min("__t").alias("__t")).toArrow().sort_by("__id")
    return fit(*findings(got["__t"].to_pylist(), made), recall)


def _scan(texts: list[str | None], m: Model) -> Iterator[tuple]:
    found, shown, owner = [], [], []
    for k, t in enumerate(texts):
        t = t or ""
        base, mine = base_spans(t), candidates(t)
        found.append((base, mine))
        for j, (a, b) in enumerate(mine):
            ws = windows(t, a, b)
            shown += ws
            owner += [(k, j)] * len(ws)
    best: dict[tuple[int, int], float] = {}
    if shown:
        for at, p in zip(owner, scores(m, np.stack(shown)).tolist(), strict=True):
            best[at] = max(p, best.get(at, 0.0))
    for k, (base, mine) in enumerate(found):
        spans, reach, ahead = [(a, kind, b, 1.0) for a, kind, b in base], 0, iter(base)
        nxt = next(ahead, None)
        for j, (a, b) in enumerate(mine):  # both in order of their starts
            while nxt is not None and nxt[0] < b:
                reach, nxt = max(reach, nxt[2]), next(ahead, None)
            if best[k, j] >= m.threshold and reach <= a:
                spans.append((a, 3, b, best[k, j]))
        spans.sort()
        digest = hashlib.sha256(",".join(f"{KINDS[kind]}:{a}:{b}" for a, kind, b in base).encode()).hexdigest()
        n = [sum(kind == i for _, kind, _ in base) for i in range(3)]
        yield (*n, len(mine), digest, [{"kind": KINDS[kind], "start": a, "stop": b, "score": p} for a, kind, b, p in spans])


def find_secrets(docs: DataFrame, model: Model, text: str = "text", out: str = "secrets") -> DataFrame:
    """docs with a struct column (SCHEMA): counts of the fixed patterns' matches, a digest of their places, and all spans.

    Spans are code points, end exclusive, by start and then kind in the order of KINDS; base ones all stay, with score 1,
    and the network adds candidates of at least its threshold that overlap none of them. Of a long candidate every CORE
    characters are one window, and its score is the highest. Every row stays; null and empty texts hold nothing; texts
    of any length are read whole, in time that grows with their length; repeated rows each get the same answer; an empty
    table gives no rows. A column named `out` is replaced, others are left alone. No shuffle.
    """

    @F.pandas_udf(SCHEMA)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for x in batches:
            rows = [row for i in range(0, len(x), 1000) for row in _scan(x.iloc[i : i + 1000].tolist(), model)]
            yield pd.DataFrame(rows, columns=["n_assign", "n_access", "n_hex", "n_candidates", "base_sha256", "spans"])

    return docs.withColumn(out, run(F.col(text)))

"""Secret scan: fixed patterns against a reader of their definition, the network's gradient, its held-out findings, odd rows."""

import hashlib
import random
import string

import numpy as np
import pytest
from texts import VOCABULARY, prose

from mailsonde.llm import secrets

WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
GROUP = set(string.ascii_letters + string.digits + "+/_.=-")
LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def run_of(t, i, chars):
    j = i
    while j < len(t) and t[j] in chars:
        j += 1
    return j


def brute_base(t):
    """The three definitions, read character by character."""
    out, low = [], t.translate(LOWER)
    i = 0
    while i < len(t):
        w = next((w for w in WORDS if low.startswith(w, i)), None)
        end = None
        if w:
            j = i + len(w)
            for j in [j + 1, j] if t[j : j + 1] in ("'", '"') else [j]:
                k = run_of(t, j, " ")
                if t[k : k + 1] and t[k] in ":=":
                    k = run_of(t, k + 1, " ")
                    k += t[k : k + 1] in ("'", '"')
                    if (stop := run_of(t, k, GROUP)) > k:
                        end = stop
                        if stop - k >= 6:
                            out.append((i, 0, stop))
                        break
        i = end or i + 1
    for kind, start, chars, least in ((1, "AKIA", set(string.ascii_uppercase + string.digits), 20), (2, "", set("0123456789abcdef"), 24)):
        i = 0
        while i < len(t):
            j = run_of(t, i + len(start), chars) if t.startswith(start, i) else i
            if j > i + len(start):
                if j - i >= least:
                    out.append((i, kind, j))
                i = j
            else:
                i += 1
    return sorted(out)


def odd_text(r):
    bits = [*WORDS, "PassWord", "API_key", "ſecret", "toKen", "'", '"', " ", "  ", ":", "=", "==", "abc", "abcdef", "AKIA", "A" * 7, "0123456789abcdef", "f" * 11, "é", "\n", ".", "x-y/z+", "AKIAAKIA0000"]
    return "".join(r.choice(bits) for _ in range(r.randint(1, 40)))


def test_base_spans_are_the_definitions():
    r = random.Random(3)
    seen = set()
    for _ in range(6000):
        t = odd_text(r)
        got = secrets.base_spans(t)
        assert got == brute_base(t), t
        seen |= {k for _, k, _ in got}
    assert seen == {0, 1, 2}


@pytest.fixture(scope="module")
def model():
    r = random.Random(1)
    texts = [prose(r, 60) + f' token = "{r.getrandbits(160):040x}" ' + prose(r, 20) for _ in range(40)] + [prose(r, 80) for _ in range(100)]
    return secrets.fit(*secrets.findings(texts, 1200))


def test_gradient_of_the_network():
    r = random.Random(2)
    x, y, _ = secrets.findings([prose(r, 50)], 6)
    rng = np.random.default_rng(1)
    m = secrets.Model(rng.normal(0, 0.3, (secrets.SYMBOLS, secrets.DIM)), rng.normal(0, 0.2, (secrets.SPAN * (secrets.DIM + 2), secrets.FILTERS)), rng.normal(0, 0.1, secrets.FILTERS), rng.normal(0, 0.3, 3 * secrets.FILTERS + 1))
    found = secrets._gradient(m, x, y.astype(float), np.ones(len(x)))
    loss = lambda: float(np.mean(np.logaddexp(0, z := secrets._forward(m, x)[0]) - y * z))
    for p, g in zip(m[:4], found, strict=True):
        for at in np.argsort(-np.abs(g), axis=None)[:3]:
            i, was = np.unravel_index(at, g.shape), p[np.unravel_index(at, g.shape)]
            p[i] = was + 1e-7
            up = loss()
            p[i] = was - 1e-7
            down = loss()
            p[i] = was
            assert g[i] == pytest.approx((up - down) / 2e-7, rel=2e-3, abs=1e-6)


def test_network_on_findings_it_never_saw(model):
    r = random.Random(99)
    x, y, g = secrets.findings([prose(r, 90) for _ in range(50)], 400, seed=1234)
    p = secrets.scores(model, x)
    assert model.recall >= secrets.RECALL
    assert (p[y == 1] >= model.threshold).mean() >= 0.9
    assert (p[y == 0] >= model.threshold).mean() <= 0.02
    assert abs(p.mean() - y.mean()) < 0.05  # calibrated
    again = secrets.fit(*secrets.findings([prose(random.Random(5), 50)], 60))
    assert again.threshold == secrets.fit(*secrets.findings([prose(random.Random(5), 50)], 60)).threshold


def test_nothing_to_learn_from_adds_nothing():
    x, y, g = secrets.findings([], 3)
    m = secrets.fit(x[:0], y[:0], g[:0])
    t = "aB3" * 20
    assert [s for *_, s in secrets._scan([t, None], m)] == [[], []]


def test_find_secrets_on_odd_rows(make, spark, model):
    key = "zQ8vT2mK9xLp4RwY7nBc5JdF1hGs6A"
    long = "".join(random.Random(8).choices(string.ascii_letters + string.digits, k=5000))
    rows = [
        (None, "no id password=abcdef1"), (1, None), (2, ""), (3, "Äö" * 100_000 + " secret: abcdef9"), (4, f"the key is {key} here"), (4, f"the key is {key} here"),
        (5, f"plain {' '.join(VOCABULARY)} www.mail2.example.com 2024-01-02"), (6, f"see {long} end"), (7, f'token = "{"ab" * 20}" and {key}'),
    ]
    got = secrets.find_secrets(make(rows), model).select("doc_id", "text", "secrets.*").collect()
    assert len(got) == len(rows)
    for r in got:
        t = r["text"] or ""
        base = brute_base(t)
        named = [(s["start"], secrets.KINDS.index(s["kind"]), s["stop"]) for s in r["spans"]]
        assert named == sorted(named) and [x for x in named if x[1] < 3] == base
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(k == i for _, k, _ in base) for i in range(3))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{secrets.KINDS[k]}:{a}:{b}" for a, k, b in base).encode()).hexdigest()
        extra = [x for x in named if x[1] == 3]
        assert all(b <= s or e <= a for a, _, b in extra for s, _, e in base)
        found = {t[a:b] for a, _, b in extra}
        assert found == {4: {key}, 6: {long}, 7: {key}}.get(r["doc_id"], set()), r["doc_id"]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert secrets.find_secrets(empty, secrets.train(empty, made=20)).count() == 0


def test_training_does_not_depend_on_partitions(make):
    r = random.Random(4)
    rows = [(i, prose(r, 30) + (f" api_key: {r.getrandbits(128):032x}" if i % 3 == 0 else "")) for i in range(60)]
    a = secrets.train(make(rows), made=40)
    b = secrets.train(make([*rows[::-1], (None, "x"), (70, None)]).repartition(5), made=40)
    assert a.threshold == b.threshold and (a.dense == b.dense).all()

"""Merge path and token alignment against plain loops over the libraries' own tokens."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from texts import prose

from mailsonde.llm import alignment


@pytest.fixture(scope="module")
def both():
    return alignment.pair(*alignment.default_vocabularies())


def test_points_on_the_merge_path():
    r = random.Random(2)
    for _ in range(300):
        a, b = (np.array(sorted(r.sample(range(40), r.randint(0, 20))), np.int64) for _ in range(2))
        piece = r.randint(1, 9)
        order = sorted([(x, 0) for x in a] + [(x, 1) for x in b])  # on ties a first
        i, j = alignment.split_path(a, b, piece)
        assert len(i) == len(range(0, len(a) + len(b), piece)) + 1
        for d, x, y in zip([*range(0, len(a) + len(b), piece), len(a) + len(b)], i, j, strict=True):
            assert (x, y) == (sum(s == 0 for _, s in order[:d]), sum(s == 1 for _, s in order[:d]))


def test_pieces_of_any_size_give_one_alignment():
    r = random.Random(3)
    for _ in range(300):
        n = r.randint(1, 60)
        a, b = (np.array(sorted({*r.sample(range(1, n + 1), r.randint(0, n)), n})) for _ in range(2))
        ranges = [list(zip([0, *x], x, strict=False)) for x in (a.tolist(), b.tolist())]
        want, group = [], 0
        for i, (s, e) in enumerate(ranges[0]):
            want += [(i, j) for j, (t, f) in enumerate(ranges[1]) if max(s, t) < min(e, f)]
        common = sorted(set(a) & set(b))
        for piece in (1, 2, 3, 7, 1000):
            ia, jb, group = alignment.align(a, b, piece)
            assert list(zip(ia.tolist(), jb.tolist(), strict=True)) == want
            assert group.tolist() == [sum(c < e for c in common) for e in np.minimum(a[ia], b[jb])]


def brute(texts, p):
    """The contract's columns by loops, for (doc_id, text) rows."""
    rows, pairs = [], Counter()
    for d, t in texts:
        a, b = (p.a.encode(f" {t}", add_special_tokens=False).ids, p.b.encode(t)) if t else ([], [])
        raw = f" {t}".encode()
        if any(b"".join(of[i] for i in x) != raw for of, x in ((p.bytes_a, a), (p.bytes_b, b))):
            a, b = [], []
        spans = []
        for of, ids in ((p.bytes_a, a), (p.bytes_b, b)):
            at, mine = 0, []
            for i in ids:
                mine.append((at, at + len(of[i])))
                at += len(of[i])
            spans.append(mine)
        links = [(x, y) for x, (s, e) in zip(a, spans[0], strict=True) for y, (u, v) in zip(b, spans[1], strict=True) if max(s, u) < min(e, v)]
        groups = []
        if a:
            start = 0
            for cut in sorted({e for _, e in spans[0]} & {e for _, e in spans[1]}):
                groups.append("|".join(",".join(str(i) for i, (s, e) in zip(ids, of, strict=True) if start <= s and e <= cut) for ids, of in ((a, spans[0]), (b, spans[1]))))
                start = cut
        pairs.update(set(links))
        rows.append((d, len(a), len(b), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest() if a else ""))
    best = defaultdict(int)
    for (x, _), n in pairs.items():
        best[x] = max(best[x], n)
    return sorted((str(d), na, nb, ng, len(ls), sum(pairs[x] == best[x[0]] for x in ls), sum(pairs[x] for x in ls), h) for d, na, nb, ng, ls, h in rows)


ODD = [
    (None, "no id"), (1, None), (2, ""), (3, "  \n "), (4, "Ä Ö it's"), (4, "Ä Ö it's"), (5, "x" * 3000), (6, "\0\t a\x7fb"), (7, "<|endoftext|> <s> </s> x"), (8, "▁under scores"),
    (9, "é́ ﬁ   x　y  z \x1c w"), (10, "日本語 テスト 😀 😀"), (11, " lead  and tail  "), (12, "a <0x41> b\r\n c"), (13, "don't 'll we're 12,5"),
]


@pytest.mark.parametrize("common", [1_000_000, 7, 0])
def test_alignment(make, both, common):
    r = random.Random(6)
    rows = ODD + [(100 + i, prose(r, r.randint(1, 40)) + r.choice([".", "\n", " (x) "])) for i in range(25)]
    got = alignment.alignment(make(rows), common=common)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((str(r[0]), *r[1:]) for r in got.collect()) == brute(rows, both)


def test_memory_of_pieces_and_long_texts(both):
    r = random.Random(7)
    texts = [prose(r, 400) for _ in range(5)] + [prose(r, 30_000)]
    small = alignment.Pair(*alignment.default_vocabularies(), room=10)
    got = [list(map(np.ndarray.tolist, x)) for x in small(iter(texts))]
    assert got == [list(map(np.ndarray.tolist, x)) for x in both(iter(texts))]
    assert got[0] == [both.a.encode(f" {texts[0]}", add_special_tokens=False).ids, both.b.encode(texts[0])]
    one, many = (alignment.aligned(list(both(iter(texts))), both, piece) for piece in (1 << 20, 100))
    assert [x[:5] for x in one] == [x[:5] for x in many]


def test_other_vocabularies_get_whole_texts(tmp_path, both):
    import json

    a, b = alignment.default_vocabularies()
    with open(a) as f:
        told = json.load(f)
    told["pre_tokenizer"]["use_regex"] = False  # tokens may go over blanks
    (path := tmp_path / "a.json").write_text(json.dumps(told))
    other = alignment.Pair(str(path), b)
    assert both.cuts and not other.cuts
    texts = ["of the new york city", "a  b\nc it's", ""]
    for t, (x, y) in zip(texts, other(iter(texts)), strict=True):
        assert x.tolist() == (other.a.encode(f" {t}", add_special_tokens=False).ids if t else []) and y.tolist() == both.b.encode(t)


def test_empty_table(spark):
    assert alignment.alignment(spark.createDataFrame([], "doc_id long, text string")).count() == 0

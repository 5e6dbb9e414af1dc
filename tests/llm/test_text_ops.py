"""License scan, HTML extraction, decontamination, toxicity, repeated passages."""

import re

import pytest
from texts import prose

from mailsonde.llm import decontaminate, html_extract, licenses, queries, substring_dedup, toxicity
from mailsonde.llm.common import words

ODD = [(None, "no id"), (1, None), (2, ""), (3, "  \n "), (4, "Ä Ö"), (4, "Ä Ö"), (5, "x" * 300_000), (6, "\0\t a\x7fb")]
RULE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_words(t):
    return RULE.findall((t or "").translate(FOLD))


def test_words_agree():
    for _, t in [*ODD, (0, "A1ß!É..Zz~{}@[`^ İ")]:
        assert [w.decode() for w in words(None if t is None else t.encode())] == brute_words(t)


def brute_base(t):
    ws, hits, labels = brute_words(t), [], set()
    for p, label in licenses.BASE.items():
        q = p.split()
        for i in range(len(ws) - len(q) + 1):
            if ws[i : i + len(q)] == q:
                hits.append(i)
                labels.add(label)
    return len(ws), len(hits), min(hits, default=None), max(hits, default=None), ",".join(sorted(labels))


def test_license_scan(make):
    rows = [*ODD, (10, "Under the MIT License; mit LICENSE"), (11, "GNU General-Public License cc by"), (12, "Licensd under the Apache Licence, Version 2"), (13, "emit license"), (14, "gnu general public license " * 3000)]
    got = licenses.scan_licenses(make(rows)).select("doc_id", "text", "license.*").collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == brute_base(r["text"])
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(filter(None, r["labels"].split(",")))
    fuzzy = next(r for r in got if r["doc_id"] == 12)
    assert fuzzy["base_labels"] == "" and fuzzy["labels"] == "apache" and 0.9 < fuzzy["score"] < 1 and fuzzy["spans"][0]["edits"] == 2
    assert licenses.scan_licenses(make([])).count() == 0


def test_pigeonhole_finds_what_the_pattern_finds(rnd):
    import regex

    s = licenses.Scanner()
    for n, raw, _, rule in s.notices:
        for _ in range(30):
            t = bytearray(raw)
            for _ in range(rnd.randint(0, n.edits)):
                i = rnd.randrange(len(t))
                t[i : i + rnd.randint(0, 1)] = bytes([rnd.choice(b"abz ")]) * rnd.randint(0, 1)
            text = b" start " + bytes(t) + b" end "
            assert bool(regex.search(rule.pattern, text)) == any(x[0] == n.label and x[4] == len(raw) for x in s.fuzzy(text))


def edit_spans(text, raw, k):
    """Spans within k edits by an edit-distance table: of those that overlap the fewest edits first, then the first start."""
    found = []
    for a in range(len(text)):
        row = list(range(len(raw) + 1))
        for b in range(a, min(len(text), a + len(raw) + k)):
            new = [row[0] + 1]
            for j, c in enumerate(raw):
                new.append(min(row[j] + (text[b] != c), row[j + 1] + 1, new[j] + 1))
            row = new
            if row[-1] <= k:
                found.append((row[-1], a, b + 1))
    kept = []
    for e, a, b in sorted(found):
        if all(b <= x or a >= y for _, x, y in kept):
            kept.append((e, a, b))
    return kept


def test_spans_agree_with_edit_distances(rnd):
    s = licenses.Scanner(notices=[licenses.Notice("mozilla public license", "mpl", 2)])
    for _ in range(25):
        parts = [rnd.choice([b"mozilla public license", b"mozila public license", b"mozilla publik licence", b"mozlla publc license", b"some words", b"public", b"license mozilla"]) for _ in range(rnd.randint(1, 6))]
        text = b" " + b" ".join(parts) + b" "
        got, want = s.fuzzy(text), edit_spans(text, b"mozilla public license", 2)
        assert len(got) == len(want) and sum(x[3] for x in got) == sum(e for e, *_ in want)
        for _, a, b, e, _ in got:
            assert any(e == f and a < y and x < b for f, x, y in want)


def test_a_text_of_near_notices_takes_linear_time():
    import time

    s, text = licenses.Scanner(), b" " + b"mozilla publik licens " * 45_000
    began = time.process_time()
    assert len([x for x in s.fuzzy(text) if x[0] == "mpl"]) == 45_000
    assert time.process_time() - began < 3


def test_inexact_notices_next_to_each_other_are_all_found(rnd):
    s = licenses.Scanner()
    spans = lambda text, label: [text[a:b] for x, a, b, *_ in s.fuzzy(text) if x == label]
    assert len(spans(b" mozila public license mozilla public license x ", "mpl")) == 2
    for _ in range(20):
        copies = [rnd.choice([b"mozilla public license", b"mozila public license", b"mozilla publik licence", b"mozilla publicc license"]) for _ in range(rnd.randint(2, 9))]
        text = b" " + b" ".join(copies) + b" "
        got = spans(text, "mpl")
        assert len(got) == len(copies) and all(c[2:-2] in g for c, g in zip(copies, got, strict=True))


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body><!-- c -->
<nav><a href=x>Home</a></nav><header><p>The head of the site</p></header><div class="cookie-notice"><p>This is a notice that we use cookies on the site.</p></div>
%s
<aside><p>The side of the page is not the text of it.</p></aside><form>Your name <input><p>and the rest of the form</p></form>
<section id="comments"><p>I think that this is the best text of them all.</p></section><footer>&copy; all of the rest</footer></body></html>"""


def test_html_main_text(make, spark):
    article = "<article><h1>A &amp; B</h1><p>One\n two&nbsp;<b>three</b><p>Four<br>five</p><ul><li>Six</li></ul><p></p></article>"
    assert html_extract.main_text(PAGE % article) == "A & B\nOne two three\nFour five\nSix"
    plain = "<div><h2>Head</h2><p>" + "it is the way of the world and all that is in it, " * 4 + "</p><p>Short.</p></div><div><a href=1>one link</a> <a href=2>two links</a></div>"
    assert html_extract.main_text(PAGE % plain).split("\n")[0] == "Head" and html_extract.main_text(PAGE % plain).endswith("\nShort.")
    wrapped = '<form><div class="page with-sidebar"><header><main><p>One.</p><article class="comment"><p>Two.</p></article></main></header></div></form>'
    assert html_extract.main_text(wrapped) == "One."
    for odd in (None, "", "<", "<p", "<p class='x>y", "</p></div>", "&lt;p&gt;", "<!--", "<script>", "a" * 100_000, "<div>" * 5000):
        html_extract.main_text(odd)
    pages = spark.createDataFrame([(1, "u", PAGE % article), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    got = sorted((r["page_id"], r["main_text"]) for r in html_extract.extract_text(pages).collect())
    assert got == [(1, "A & B\nOne two three\nFour five\nSix"), (2, ""), (2, "")]
    clash = pages.selectExpr("*", "'x' AS text", "1 AS n_chars", "'y' AS main_text")
    assert html_extract.extract_text(clash).columns == clash.columns and html_extract.extract_text(clash.limit(0)).count() == 0


def test_tags_of_any_length():
    for n in (10, 5000, 200_000):
        for quote in "\"'":
            page = f"<article><p data-x={quote}{'x' * n} > menu secret=1{quote} class=y>One.</p></article>"
            assert html_extract.main_text(page) == "One.", n
    assert html_extract.main_text("<article><p class=it's>Don't.</p><p title=\"a>b\">It's.</p></article>") == "Don't.\nIt's."
    assert html_extract.main_text('<article><p title="never closed>One.</p><p>Two.</p></article>') == "One.\nTwo."
    import time

    for odd in ('<p a="' * 100_000, "<p a='x' b=\"" * 100_000 + ">", "<p a=\"b>" * 100_001, "<" * 300_000):
        began = time.process_time()
        html_extract.main_text(odd)
        assert time.process_time() - began < 5


def brute_labels(blocks, rules=html_extract.Rules()):
    """Pass 2 by its definition: every decided block is looked at for every undecided one."""
    first = [html_extract.first_pass(b, rules) for b in blocks]
    texts = {b.part for b, x in zip(blocks, first, strict=True) if x == 1}
    out = []
    for i, b in enumerate(blocks):
        if first[i]:
            out.append(first[i] == 1)
            continue
        away = lambda j: abs(i - j) + (rules.list_away if first[j] < 0 and blocks[j].article and not blocks[j].boiler else 0)
        seen = [j for j, x in enumerate(first) if x and (blocks[j].part == b.part or b.part not in texts)]
        before = min([(away(j), -j) for j in seen if j < i], default=None)
        after = min([(away(j), j) for j in seen if j > i], default=None)
        pick = before if before and (not after or before[0] <= after[0]) else after
        label = first[abs(pick[1])] if pick else -1
        if b.title and after and first[after[1]] == 1 or b.article and b.part not in texts:
            label = 1
        out.append(label == 1)
    return out


def test_second_pass_agrees_with_brute_force(rnd):
    stop, rare = "the way of all that is in it and ", "grobnik vilmox scurd tranell "
    def block():
        text = rnd.choice([stop * 5, rare * 5, (stop + rare * 3) * 3, "Short.", stop + rare])
        n = len(text.strip())
        return html_extract.Block(text.strip(), rnd.choice([0, 0, 0, n]), rnd.random() < 0.15, rnd.random() < 0.5, rnd.random() < 0.2, rnd.random() < 0.3, rnd.randrange(3))

    seen = set()
    for _ in range(400):
        blocks = [block() for _ in range(rnd.randint(1, 14))]
        if any(html_extract.first_pass(b) == 1 for b in blocks):
            got = html_extract.classify(blocks)
            assert got == brute_labels(blocks)
            seen.update(x for b, x in zip(blocks, got, strict=True) if not html_extract.first_pass(b))
    assert seen == {True, False}


def test_main_text_without_an_article(rnd):
    """Densities and neighbours alone: the same page with and without the marks of an article."""
    body = "<h1>Head</h1><p>" + "it is the way of the world and all that is in it, " * 4 + "</p><p>Short.</p><ul><li>One item.</li><li>Another.</li></ul><p>" + "so that we may say what it was to them and to us, " * 4 + "</p>"
    menu = "<ul>" + "".join(f"<li><a href={i}>Entry {i}</a></li>" for i in range(6)) + "</ul>"
    want = html_extract.main_text(PAGE % f"<article>{body}</article>")
    assert want.startswith("Head\n") and "Another." in want
    assert html_extract.main_text(PAGE % f"<div>{menu}</div><div>{body}</div><div>{menu}</div>") == want
    own = f'<article><header class="post-header"><h2>Its head</h2></header>{body}<p><a href=1>A paragraph that is a link</a></p>{menu}<p>The end.</p></article>'
    text = html_extract.main_text(PAGE % own)
    assert text.startswith("Its head\n") and "A paragraph that is a link" in text and text.endswith("The end.") and "Entry" not in text


@pytest.mark.parametrize("odd", ["<a" * 100_000, "<a" * 100_000 + ">", "</p>" * 100_000, "</i>" * 100_000, "<a \"'>" * 50_000, "<a '" * 100_000 + ">", "<script>" * 50_000, "<b hidden>" * 50_000 + "</i>" * 50_000, "<" * 200_000, "<!--" * 50_000])
def test_broken_pages_take_linear_time(odd):
    import time

    html_extract.main_text(odd[:1000])
    began = time.process_time()
    html_extract.main_text(odd)
    assert time.process_time() - began < 3


def brute_hits(t, items, n=10):
    ws, hit, found = brute_words(t), set(), set()
    for i, x in items:
        q = brute_words(x)
        k = min(n, len(q))
        grams = {tuple(q[j : j + k]) for j in range(len(q) - k + 1)} if q else set()
        for j in range(len(ws) - k + 1 if k else 0):
            if tuple(ws[j : j + k]) in grams:
                hit.update(range(j, j + k))
                found.add(str(i))
    return len(ws), len(hit), sorted(found)


@pytest.mark.parametrize("limit", [100_000, 0])
def test_decontamination(make, spark, rnd, limit):
    items = [(7, prose(rnd, 25)), (10, prose(rnd, 12)), (9, "Just three WORDS"), (11, None), (12, "!!"), (13, "ba"), (14, prose(rnd, 10))]
    items.append((15, items[0][1]))
    rows = [*ODD, (20, "x " + "".join(c.upper() if c.isascii() else c for c in items[0][1]) + " y"), (21, " ".join(items[0][1].split()[3:14])), (22, "a just, three.words just three words"), (23, prose(rnd, 3) + " " + items[1][1] + " " + items[1][1]), (24, " ".join(items[0][1].split()[:9]))]
    bench = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "1 AS len", "1 AS hash")
    got = decontaminate.contamination(make(rows), bench, set_limit=limit).collect()
    want = sorted((str(i), *brute_hits(t, items)) for i, t in rows)
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_hit"], list(r["items"])) for r in got) == want
    assert all(r["contaminated"] == (r["n_hit"] > 0) and r["n_items"] == len(r["items"]) for r in got)
    docs = make(rows)
    left = decontaminate.decontaminated(docs, bench, set_limit=limit)
    assert left.columns == docs.columns and left.count() == sum(w[2] == 0 for w in want)
    cut = {r["doc_id"]: r["text"] for r in decontaminate.without_spans(docs, bench, set_limit=limit).collect()}
    assert cut[20] == "x y" and cut[4] == "Ä Ö" and cut[1] is None


def test_decontamination_of_nothing(make, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r["n_hit"] for r in decontaminate.contamination(make([(1, "a b")]), none).collect()] == [0]
    assert decontaminate.contamination(make([]), none).count() == 0


def test_toxicity_learns_and_tags(make, spark, rnd):
    bad = ["grobnik", "vilmox", "scurd"]
    rows, labels = [], []
    for i in range(240):
        ws = prose(rnd, rnd.randint(20, 60)).split()
        if toxic := i % 4 == 0:
            for _ in range(3):
                ws.insert(rnd.randrange(len(ws)), rnd.choice(bad) + rnd.choice(["", "eu", "ix"]))
        rows.append((i, " ".join(ws)))
        labels.append((i, 1, int(toxic)))
    docs, marks = make(rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    from pyspark.sql import functions as F

    model = toxicity.train(docs, marks.where(~toxicity.held_out(F.col("doc_id"))))
    got = toxicity.score_documents(docs, model, out="tox").select("doc_id", "text", toxicity.held_out(F.col("doc_id")).alias("h"), "tox").collect()
    held = [r for r in got if r["h"]]
    assert len(held) > 40 and all((r["tox"]["score"] >= 0.3) == (r["doc_id"] % 4 == 0) for r in held)
    for r in got:
        joined = " ".join(brute_words(r["text"])).encode()
        assert all(joined[s["start"] : s["stop"]].decode().startswith(tuple(bad)) for s in r["tox"]["spans"])
    odd = toxicity.score_documents(make(ODD), model, out="tox").collect()
    assert len(odd) == len(ODD) and all(0 <= r["tox"]["score"] < 0.3 for r in odd)


def test_marginals_agree_with_the_whole_chain(rnd):
    import numpy as np

    model = toxicity.Model({b"bad": 3.0, b"3:wor": 2.0}, -2.0, (0.5, -0.7, -0.2, 0.9), (0.0,) * 4, 0.1)
    tagger = toxicity.Tagger(model)
    model2 = model._replace(weights={b"bad": 3.0, b"5:worse": 2.0})
    tagger = toxicity.Tagger(model2)
    for _ in range(40):
        ws = [rnd.choice([b"ok", b"fine", b"bad", b"worser"]) if rnd.random() < 0.4 else b"ok" for _ in range(rnd.randint(1, 40))]
        emit = np.array([[model2.bias + {b"bad": 3.0, b"worser": 2.0}.get(w, 0.0) for w in ws]])
        p, _, _ = toxicity._forward_backward(emit, np.array(model2.trans).reshape(2, 2))
        for i, a, b, q in tagger.spans(ws):
            assert abs(q - p[0, i]) < 1e-9 and b" ".join(ws)[a:b] == ws[i]


def test_toxicity_without_labels(make, spark):
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    docs = make([(1, "a b"), (2, None)])
    model = toxicity.train(docs, none)
    assert [r["x"]["score"] for r in toxicity.score_documents(docs, model, out="x").collect()] == [0.0, 0.0]


def test_toxicity_is_fitted_on_all_marked_words():
    rows = [(b"bad " * 60 + b"late", 1) for _ in range(20)] + [(b"all is fine here", 0) for _ in range(20)]
    assert toxicity.fit(rows, 0.5).weights[b"late"] > 0.5


def brute_sentences(t):
    """Word lists: cut after marks and lines, and, beyond 40 words, after words whose hash has four zero bits or at 40 words."""
    import xxhash

    out = []
    for ws in filter(None, map(brute_words, re.split(r"(?<=[.!?])(?=[ \t\r\f\v\n])|(?<=\n)", t or ""))):
        long, piece = len(ws) > 40, []
        for w in ws:
            if long and (len(piece) == 40 or (len(piece) > 1 and xxhash.xxh3_64_intdigest(piece[-1].encode()) & 15 == 0)):
                out.append(piece)
                piece = []
            piece.append(w)
        out.append(piece)
    return out


def every_run_removed(rows):
    """Sentences of runs seen at an earlier (id, place), over all runs of two or more sentences and 20 or more words."""
    seen, gone = {}, {}
    for d, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        ws = brute_sentences(t)
        for i in range(len(ws)):
            for j in range(i + 2, len(ws) + 1):
                if sum(map(len, ws[i:j])) >= 20 and seen.setdefault(str(ws[i:j]), (d, i)) != (d, i):
                    gone.setdefault(d, set()).update(range(i, j))
    return gone


def sentences_of(rnd, *sizes):
    return " ".join(" ".join(f"w{rnd.randrange(10**9)}" for _ in range(n)) + "." for n in sizes)


def test_repeated_passages(make, rnd):
    def text(n):
        return " ".join(prose(rnd, rnd.randint(4, 12)).capitalize() + "." for _ in range(n))

    passage, long = text(8), prose(rnd, 90, [f"u{i}" for i in range(500)]).capitalize()
    rows = [(1, text(6) + " " + passage + " É. " + text(5)), (2, text(4) + "\n" + passage + "\n" + text(4)), (3, text(9)), (4, passage), (5, text(5) + " " + passage + " " + text(2) + " " + passage), (6, long), (7, text(3) + " Ö " + long + " ß")]
    odd = [(i and 100 + i, t) for i, t in ODD if i != 4]
    docs = make(rows + odd)
    out = substring_dedup.remove_repeats(docs)
    got = {r["doc_id"]: r for r in out.collect()}
    gone = every_run_removed(rows + odd)
    assert {i for i, r in got.items() if r["repeats"]["n_removed"]} == set(gone) == {2, 4, 5, 7}
    for i, r in got.items():
        assert r["repeats"]["n_removed"] == len(gone.get(i, ()))
        left = [w for k, s in enumerate(brute_sentences(r["text"])) if k not in gone.get(i, ()) for w in s]
        assert brute_words(r["repeats"]["text"]) == left and (gone.get(i) or r["repeats"]["text"] == r["text"])
    assert got[4]["repeats"]["text"] == "" and got[4]["repeats"]["sources"] == [1] and got[7]["repeats"]["sources"] == [6]
    assert passage not in got[2]["repeats"]["text"] and got[1]["repeats"]["n_removed"] == 0 and got[None]["repeats"]["n_removed"] == 0
    assert set(docs.columns) == set(out.columns) and substring_dedup.remove_repeats(make([])).count() == 0


def test_repeated_passages_are_removed_whole(make, rnd, monkeypatch):
    rows, sizes = [], (1, 2, 5, 9, 15, 25, 45)
    for passage in [(40, 15, 10), (10, 10, 2, 12), (2, 12, 10, 10), (17, 17), (50,), (20, 19), (1,) * 40, (1, 1, 60, 1, 1), (130,)] + [rnd.choices(sizes, k=rnd.randint(1, 9)) for _ in range(60)]:
        p = sentences_of(rnd, *passage)
        for _ in range(2):
            rows.append((len(rows), " ".join([sentences_of(rnd, *rnd.choices((3, 8, 30), k=rnd.randint(0, 3))), p, sentences_of(rnd, *rnd.choices((3, 8, 30), k=rnd.randint(0, 3)))])))
        if rnd.random() < 0.3:
            rows.append((len(rows), p + " " + sentences_of(rnd, 4, 30) + " " + p))
    gone = every_run_removed(rows)
    assert len(gone[1]) >= 3 and len(rows) > 100
    for hot in (10_000, 1):  # every run, or none, is joined where it lies
        monkeypatch.setattr(substring_dedup, "HOT", hot)
        got = {r["doc_id"]: r["repeats"]["n_removed"] for r in substring_dedup.remove_repeats(make(rows)).collect()}
        assert {i: n for i, n in got.items() if n} == {i: len(x) for i, x in gone.items()}


def test_texts_of_a_repeated_id_keep_their_own_spans(make, rnd):
    a, b = sentences_of(rnd, 20, 20), sentences_of(rnd, 25, 25)
    rows = [(1, a), (1, b), (2, "Zero. " + b), (2, a + " One."), (2, a + " One.")]
    got = sorted((r["doc_id"], r["repeats"]["text"].strip()) for r in substring_dedup.remove_repeats(make(rows)).collect())
    assert got == sorted([(1, a), (1, b), (2, "Zero."), (2, "One."), (2, "One.")])


def test_every_query_is_named():
    assert [re.fullmatch(r"op(\d+)_[a-z0-9_]+", q)[1] for q in queries.queries()] == [str(i) for i in range(1, 11)]

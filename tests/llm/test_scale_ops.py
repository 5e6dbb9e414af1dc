"""Mixing, token files, near duplicates of vectors and texts, archives, the pipeline."""

import base64
import gzip
import hashlib
import random
import struct
import zlib
from pathlib import Path

import numpy as np
import pytest
from texts import prose
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

import corpus_pipeline
from mailsonde.llm import embedding_dedup, graph, minhash_dedup, mixing, token_store, toxicity, warc
from mailsonde.llm.common import file_system, space_words, words, work_dir

ODD = [(None, "no id"), (1, None), (2, ""), (3, "  \n "), (4, "Ä Ö"), (4, "Ä Ö"), (5, "word " * 60_000)]


def fill(sizes, share=1.5, cap=2.0, cycle=(3, 1, 2)):
    """Water-filling by its definition: clamp, share out again, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: cycle[i % 3] for i, s in enumerate(names)}
    left, free, out = share * sum(sizes.values()), set(names), {}
    while free:
        level = left / sum(weight[s] for s in free)
        over = [s for s in free if level * weight[s] > cap * sizes[s]]
        if not over:
            return out | {s: level * weight[s] for s in free}
        for s in over:
            out[s] = cap * sizes[s]
            left -= out[s]
            free.discard(s)
    return out


def test_mixing(make, rnd):
    rows = [(i, prose(rnd, rnd.randint(0, 80)), rnd.choice(["b", "a", "Z", None, "é"])) for i in range(600)] + [(1000 + i, prose(rnd, 5), "tiny") for i in range(4)] + [(2000, "", "void")] + [(i, t, "a") for i, t in ODD]
    docs = make(rows)
    got = mixing.plan_mix(docs).collect()
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + len(space_words((t or "").encode()))
    want, taken, most = fill(sizes), {}, {}
    by_id = {}
    for r in got:
        by_id.setdefault(r["id"], r["source"])
        taken[r["source"]] = taken.get(r["source"], 0) + r["taken"]
        most[r["source"]] = max(most.get(r["source"], 0), r["size"])
        assert abs(r["target"] - want[r["source"]]) < 1e-6 and r["source_size"] == sizes[r["source"]] and r["taken"] <= 2 * r["size"]
    assert len(got) == len(rows) and all(abs(taken[s] - want[s]) <= most[s] / 2 + 1e-9 for s in sizes)
    key = lambda rs: sorted(map(str, rs))
    assert key(got) == key(mixing.plan_mix(docs.repartition(7)).collect())
    assert mixing.plan_mix(make([])).count() == 0
    whole = make([r for r in rows if r[0] is not None and r[0] >= 6])
    mix = mixing.mixed(whole)
    plan = mixing.plan_mix(whole).where("size > 0").agg(F.sum("times")).first()[0]
    assert mix.columns == whole.columns and mix.count() == plan


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=700))
def test_directly_addressable_codes(ids):
    raw = np.array(ids, "<u4")
    seg = token_store.Segment(b"".join(token_store.segment_bytes([(5, raw.tobytes()), (None, b"")])))
    assert seg.all().tolist() == ids and [seg[i] for i in range(len(ids))] == ids
    assert seg.doc_id.tolist() == [5, 0] and seg.has_id.tolist() == [1, 0]
    with pytest.raises(IndexError):
        seg[len(ids)]


def test_token_files(make):
    from tokenizers import Tokenizer

    rows = [*ODD, (-3, "Zuerst!! It's 42's... É.\x1c x́,  y\tz"), (99, "last"), (50, None)]
    rows = [r for r in rows if r[0] != 4] + [(4, "Ä Ö"), (4, "Ä Ö")]
    tok = Tokenizer.from_file(token_store.default_vocabulary())
    got = token_store.token_store(make(rows), segment_ids=50).orderBy("start").collect()
    at = 0
    for r, (d, t) in zip(got, sorted(rows, key=lambda x: (x[0] is None, x[0] or 0)), strict=True):
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 2]
        assert (r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) == (d, at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert token_store.token_store(make([])).count() == 0


def test_special_tokens_are_matched_as_written():
    from tokenizers import Tokenizer

    tok, encode = Tokenizer.from_file(token_store.default_vocabulary()), token_store.Encoder(token_store.default_vocabulary(), None)
    texts = ["a <|ENDOFTEXT|> b", "A <|endoftext|> B", "A<|EndOfText|>B C\n<|StartOfText|>", "X<|startoftext|>Y<|STARTOFTEXT|>!", "<|end OFTEXT|>", "<|ENDOFTEXT|>" * 3]
    for t, (_, ids) in zip(texts, encode((None, t.encode()) for t in texts), strict=True):
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == tok.encode(t, add_special_tokens=False).ids


def test_a_vocabulary_with_another_pattern_gets_whole_texts(tmp_path):
    import json

    from tokenizers import Tokenizer

    with open(token_store.default_vocabulary()) as f:
        told = json.load(f)
    told["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] = r"\S+ \S+|\S+"  # words in twos: a blank cuts nothing
    (path := tmp_path / "other.json").write_text(json.dumps(told))
    encode, tok = token_store.Encoder(str(path), None), Tokenizer.from_file(str(path))
    assert not encode.cuts and token_store.Encoder(token_store.default_vocabulary(), None).cuts
    for t in ("one two three", "A b\nc d", ""):
        ((_, ids),) = encode([(1, t.encode())])
        assert list(struct.unpack(f"<{len(ids) // 4}I", ids)) == tok.encode(t, add_special_tokens=False).ids


def brute_components(n, links):
    label = list(range(n))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def test_components(spark):
    r = random.Random(3)
    links = [(i, i + 1) for i in range(200, 260)] + [(0, i) for i in range(1, 60)] + [(r.randrange(300, 400), r.randrange(300, 400)) for _ in range(70)] + [(5, 5)]
    want = brute_components(400, links)
    got = graph.components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {x["id"] for x in got} == {v for e in links if e[0] != e[1] for v in e} and all(x["component"] == want[x["id"]] for x in got)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_similar_vectors(spark, monkeypatch):
    g = np.random.default_rng(1)
    base = g.standard_normal((60, 16))
    rows = [(i, v.tolist()) for i, v in enumerate(base)]
    rows += [(100 + i, (base[i % 3] + 0.25 * g.standard_normal(16)).tolist()) for i in range(90)]
    rows += [(300, (base[0] * 1e-30).tolist()), (301, (base[0] * 1e30).tolist()), (302, None), (303, [0.0] * 16), (304, [float("nan")] + [1.0] * 15), (305, [None] + [1.0] * 15), (306, []), (307, [1.0]), (308, [2.0]), (309, [float("inf")] * 16)]
    rows += [(0, base[0].tolist()), (None, base[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").selectExpr("*", "1 AS id", "2 AS block", "3 AS n")
    ok = [(i, np.array(v) / np.abs(v).max()) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)]
    links, count, ids = [], {}, sorted({i for i, _ in rows if i is not None})
    for k, (i, v) in enumerate(ok):
        for j, w in ok[:k]:
            if i != j and len(v) == len(w) and v @ w / np.sqrt((v @ v) * (w @ w)) >= 0.95:
                links.append((ids.index(i), ids.index(j)))
                count[i], count[j] = count.get(i, 0) + 1, count.get(j, 0) + 1
    label = brute_components(len(ids), links)
    for chunk in (4096, 20):
        got = embedding_dedup.similar_vectors(df, chunk=chunk).collect()
        assert len(got) == len(rows)
        for r in got:
            i = r["vec_id"]
            want = (None, 0) if i is None else (ids[label[ids.index(i)]], count.get(i, 0))
            assert (r["component_id"], r["n_links"]) == want and r["kept"] == (i is None or want[0] == i)
    assert sum(count.values()) > 300 and embedding_dedup.similar_vectors(df.limit(0)).count() == 0


def test_similar_short_vectors(spark):
    g = np.random.default_rng(3)
    for dims in (1, 2, 3):
        x = g.standard_normal((300, dims))
        df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
        x /= np.sqrt((x * x).sum(1, keepdims=True))
        want = (x @ x.T >= 0.95).sum(1) - 1
        got = {r["vec_id"]: r["n_links"] for r in embedding_dedup.similar_vectors(df).collect()}
        assert [got[i] for i in range(300)] == want.tolist()


def shingles(t, n, split):
    ws = split((t or "").encode())
    return {tuple(ws[i : i + n]) for i in range(max(1, len(ws) - n + 1))} if ws else set()


@pytest.mark.parametrize(("n", "split"), [(2, space_words), (5, words)])
def test_near_duplicates(make, rnd, n, split, monkeypatch):
    rows = [*ODD, (30, "one"), (31, "ONE"), (32, "one two"), (33, "a b c"), (None, "a b c")]
    for b in range(6):
        base = prose(rnd, 60 + 20 * b, [f"w{i}" for i in range(400)]).split()
        for v in range(14):
            ws = list(base)
            for _ in range(rnd.randint(0, 2 + b)):
                ws[rnd.randrange(len(ws))] = f"z{rnd.randrange(999)}"
            rows.append((100 * (b + 1) + v, " ".join(ws)))
    rows.append((901, next(t for i, t in rows if i == 103)))
    monkeypatch.setattr(minhash_dedup, "GROUP", 700)
    docs = make(rows)
    got = minhash_dedup.near_duplicates(docs, n=n, by_letters=split is words).collect()
    ids = sorted({i for i, _ in rows if i is not None})
    sets = {i: shingles(t, n, split) for i, t in rows if i is not None}
    links = [(ids.index(i), ids.index(j)) for i in ids for j in ids if j < i and sets[i] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    label = brute_components(len(ids), links)
    assert len(got) == len(rows)
    for r in got:
        i = r["doc_id"]
        if i is None:
            assert r["component_id"] is None and r["kept"]
        else:
            assert (r["component_id"], r["kept"], r["n_shingles"]) == (ids[label[ids.index(i)]], label[ids.index(i)] == ids.index(i), len(sets[i]))
    left = minhash_dedup.deduplicated(docs, n=n, by_letters=split is words)
    assert left.columns == docs.columns and left.count() == sum(r["kept"] for r in got)
    assert minhash_dedup.near_duplicates(make([])).count() == 0


def test_each_text_of_a_repeated_id_keeps_its_links(make, monkeypatch):
    base = {k: [f"{k}{i}" for i in range(50)] for k in "abcdef"}
    near = lambda k, i: " ".join([*base[k][:i], "z", *base[k][i + 1 :]])
    own = lambda k: " ".join(base[k])
    rows = [(1, own("a")), (1, own("b")), (2, near("a", 7)), (3, near("b", 9)), (4, own("c")), (5, own("d")), (6, own("c")), (6, own("d")), (6, own("d")), (7, near("d", 30)), (8, own("e")), (9, near("e", 40)), (9, own("f")), (10, near("f", 4)), (11, "x y z")]
    monkeypatch.setattr(minhash_dedup, "GROUP", 100)
    got = minhash_dedup.near_duplicates(make(rows), n=2).collect()
    assert len(got) == len(rows)
    want = {1: 1, 2: 1, 3: 1, 4: 4, 5: 4, 6: 4, 7: 4, 8: 8, 9: 8, 10: 8, 11: 11}
    assert {(r["doc_id"], r["component_id"]) for r in got} == set(want.items())


def test_bucket_comparison_is_whole(spark, rnd, monkeypatch):
    """Whatever the star misses, chunks of a bucket find: all sets in one bucket, all in components of their own."""
    monkeypatch.setattr(minhash_dedup, "GROUP", 300)
    sets = {i: np.unique(np.array([rnd.randrange(60) for _ in range(rnd.randint(20, 120))], np.uint64)) for i in range(60)}
    sets |= {100 + i: np.unique(np.append(sets[i], np.uint64(99))) for i in range(0, 60, 3)}
    df = spark.createDataFrame([(i, s.tobytes()) for i, s in sets.items()], "id long, s binary")
    buckets = spark.createDataFrame([(1, i, len(s), i, 5) for i, s in sets.items()], "key long, rep long, n long, k long, chunks int")
    ids = sorted(sets)
    links = [(ids.index(i), ids.index(j)) for i in ids for j in ids if j < i and 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
    found = [(ids.index(r["a"]), ids.index(r["b"])) for r in minhash_dedup.links_within(buckets, df, 80).collect()]
    assert brute_components(len(ids), found) == brute_components(len(ids), links) and links


def test_steps_after_the_signatures_write_few_files(spark, make):
    """A table of few rows is one file, whatever the number of shuffle partitions: each file costs its executor processes.

    Signatures and the comparison within buckets stay as parallel as their inputs.
    """
    base = [[f"{k}{i}" for i in range(40)] for k in range(9)]
    rows = [(10 * k + v, " ".join([*base[k][: 4 * v], f"z{v}", *base[k][4 * v + 1 :]])) for k in range(9) for v in range(9)]
    here, conf = Path(file_system(work_dir(spark))[1]), {"spark.sql.shuffle.partitions": "24", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, were = set(here.glob("*")), {k: spark.conf.get(k) for k in conf}
    try:
        for k, v in conf.items():
            spark.conf.set(k, v)
        got = minhash_dedup.near_duplicates(make(rows), n=2).collect()
    finally:
        for k, v in were.items():
            spark.conf.set(k, v)
    assert {(r["doc_id"], r["component_id"]) for r in got} == {(i, i // 10 * 10) for i, _ in rows}
    files = {p.name: len(list(p.glob("part-*"))) for p in set(here.glob("*")) - before}
    assert len(files) > 10 and all(n == 1 for name, n in files.items() if not name.startswith(("signatures", "more-links"))), files


def test_verified_is_exact_at_the_bound(spark):
    sets = {1: range(-5, 85), 2: range(5, 85), 3: range(-5, 67), 4: range(-5, 66), 5: [], 6: [], 7: range(1000, 1090)}
    df = spark.createDataFrame([(i, bytes([i]), list(s)) for i, s in sets.items()], "id long, digest binary, s array<long>")
    pairs = spark.createDataFrame([(a, bytes([a]), b, bytes([b])) for a in sets for b in sets if a < b], "a long, da binary, b long, db binary")
    want = {(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len({*sets[a]} & {*sets[b]}) >= 80 * len({*sets[a]} | {*sets[b]})}
    assert want == {(1, 2), (1, 3), (3, 4)}
    found = minhash_dedup.verified(pairs, df, 80)
    assert {(r["a"], r["b"]) for r in found.collect()} == want
    assert "MapInArrow" not in found._jdf.queryExecution().toString()  # no batches of pairs: a row at a time


def test_loser_tree_merges():
    r = random.Random(2)
    for k in range(9):
        runs = [sorted((r.randrange(30), i) for i in range(r.randrange(8))) for _ in range(k)]
        assert list(warc.LoserTree([iter(x) for x in runs])) == sorted(x for run in runs for x in run)


@pytest.mark.parametrize("fan_in", [64, 2])
def test_archive(spark, tmp_path, monkeypatch, fan_in):
    monkeypatch.setattr(warc, "PART", 4)
    monkeypatch.setattr(warc, "FAN_IN", fan_in)
    monkeypatch.setattr(warc, "SLICE", 500)
    r = random.Random(4)
    rows = [(i, f"http://{r.choice(['a.org', 'www.b.net:8080', 'c.example'])}/p{r.randrange(5)}", r.choice(["<p>same</p>", "", None, f"<p>é {i}</p>", "x" * 5000])) for i in range(90)]
    rows += [(7, "http://a.org/again", "<p>same</p>"), (200, None, "<p>lone</p>"), (None, "odd url\r\n", "<p>same</p>"), (201, "http://x.org/\r\nEvil: 1", "q")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS id", "'x' AS key").repartition(5)
    marks = warc.write_archives(df, f"file://{tmp_path}/w")
    index = warc.merge_runs(marks, per_range=5)
    lines = index.orderBy("segment", "position").collect()
    keys = [(x["key"], x["ts"], warc._sort_key(x["id"])) for x in lines]
    assert keys == sorted(keys) and len(lines) == len(rows) and len({x["segment"] for x in lines}) > 3
    got = warc.read_archives(index).collect()
    least = {}
    for i, _, h in rows:
        if i is not None:
            least[h or ""] = min(i, least.get(h or "", i))
    want = []
    for i, _, h in rows:
        body = (h or "").encode()
        first = least.get(h or "")
        kind = "revisit" if i is not None and i > first else "response"
        want.append((str(i), len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), kind, str(first if kind == "revisit" else None)))
    assert sorted((str(x["page_id"]), x["payload_bytes"], x["payload_digest"], x["record_type"], str(x["refers_to"])) for x in got) == sorted(want)
    for f in (tmp_path / "w").glob("*.warc.gz"):
        assert gzip.decompress(f.read_bytes()).startswith(b"WARC/1.1\r\n")
    assert warc.archive(df.limit(0)).count() == 0
    assert warc.url_key("HTTP://www.Example.ORG:80/A?b#c") == "org,example)/a?b"


def test_pipeline_stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns, name
        ids = [r["doc_id"] for r in out.select("doc_id").collect()]
        if name == "near copies":
            sets = {r["doc_id"]: shingles(r["text"], 5, words) for r in out.select("doc_id", "text").collect()}
            clean = [s for s in sets.values() if s]
            assert not any(10 * len(a & b) >= 8 * len(a | b) for i, a in enumerate(clean) for b in clean[:i])
        if name != "mix":
            assert len(ids) == len(set(ids)) and n * 0.5 < len(ids) <= n
        docs, n = spark.createDataFrame(out.collect(), out.schema), len(ids)
    tokens = corpus_pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert len(tokens) == n and sum(r["n_tokens"] for r in tokens) == max(r["start"] + r["n_tokens"] for r in tokens)


def test_pipeline_stages_on_odd_rows(make, spark):
    """Nulls, empty and long texts, repeated rows, columns with names that operators use, and empty tables, in every stage."""
    sf = "/root/testdata/sf0.001"
    leak = spark.read.parquet(f"{sf}/benchmark.parquet").first()["text"]
    rows = [*ODD, (20, "one two three four five six seven"), (20, "one two three four five six seven"), (21, "one two three four five six seven"), (22, f"before {leak} after"), (23, "a plain text of its own")]
    docs, empty = make(rows), make([]).limit(0)
    key = lambda df: sorted((str(r["doc_id"]), str(r["text"])[:50]) for r in df.select("doc_id", "text").collect())
    everything = key(docs)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns, name
        got = key(out)
        if name == "toxicity":
            assert got == everything
        elif name == "near copies":
            assert got == [x for x in everything if x[0] != "21"]
        elif name == "benchmark":
            assert got == [x for x in everything if x[0] != "22"]
        else:
            assert set(got) <= set(everything) and not {"1", "2", "3"} & {i for i, _ in got}
        assert stage(spark, empty, sf).columns == docs.columns and stage(spark, empty, sf).count() == 0, name
    tokens = corpus_pipeline.STAGES[-1][1]
    assert sorted(str(r["doc_id"]) for r in tokens(spark, docs, sf).collect()) == sorted(i for i, _ in everything) and tokens(spark, empty, sf).count() == 0


def test_toxicity_quality_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    model = toxicity.train(docs, labels.where(~toxicity.held_out(F.col("doc_id"))))
    scored = toxicity.score_documents(docs.join(labels, "doc_id").where(toxicity.held_out(F.col("doc_id"))), model, out="x").select("toxic", "x.score").collect()
    hit = sum(r["score"] >= 0.3 and r["toxic"] == 1 for r in scored)
    flagged, toxic = sum(r["score"] >= 0.3 for r in scored), sum(r["toxic"] == 1 for r in scored)
    assert hit / toxic > 0.9 and hit / flagged > 0.9

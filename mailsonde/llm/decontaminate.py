"""Benchmark decontamination by a hash set of normalised test n-grams, in DataFrame functions only.

Scan: each document's windows are tested in place, first by the hash of their first words, then by that of all of them,
against the set of the benchmark's window hashes. Verify: places that pass carry their words to a join on the window's
text itself, so a hash collision never counts. Then the hit words' spans are merged per document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import NOT_WORD, lower_ascii, stored

SPAN, HEAD = 10, 3


def word_array(c):
    return F.filter(F.split(lower_ascii(F.coalesce(c, F.lit(""))), NOT_WORD), lambda w: w != "")


def _hash(words, first, n: int):
    return F.xxhash64(*[F.get(words, first + i) for i in range(n)])


def windows(benchmark: DataFrame, item: str = "item_id", text: str = "text", span: int = SPAN) -> DataFrame:
    """(len, text, head, hash, items) of every distinct window: `span` words in a row, or all of a shorter item's words."""
    ws = benchmark.select(F.col(item).cast("string").alias("item"), word_array(F.col(text)).alias("w")).where(F.size("w") > 0)
    ws = ws.withColumn("len", F.least(F.size("w"), F.lit(span)))
    each = ws.select("item", "len", "w", F.explode(F.sequence(F.lit(1), F.size("w") - F.col("len") + 1)).alias("at"))
    each = each.select("item", "len", F.slice("w", F.col("at"), F.col("len")).alias("w"))
    cases = [(n, F.col("len") == n) for n in range(1, span + 1)]
    head = F.coalesce(*[F.when(is_n, _hash(F.col("w"), F.lit(0), min(n, HEAD))) for n, is_n in cases])
    full = F.coalesce(*[F.when(is_n, _hash(F.col("w"), F.lit(0), n)) for n, is_n in cases])
    each = each.select("item", "len", F.array_join("w", " ").alias("text"), head.alias("head"), full.alias("hash"))
    return each.groupBy("len", "text", "head", "hash").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _places(words, n: int):
    """0 .. size - n: where windows of n words start."""
    last = F.size(words) - n
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def _text(words, first, n: int):
    return F.array_join(F.slice(words, first + 1, F.lit(n)), " ")


def _found(words, n: int, heads: list[int], hashes: list[int]):
    """Array of struct(at, len, text) of the windows of n words whose hashes are in the set."""
    k = min(n, HEAD)
    at = F.filter(_places(words, n), lambda i: _hash(words, i, k).isin(heads))
    if n > k:
        at = F.filter(at, lambda i: _hash(words, i, n).isin(hashes))
    return F.transform(at, lambda i: F.struct(i.alias("at"), F.lit(n).alias("len"), _text(words, i, n).alias("text")))


def _candidates(words, grams: dict[int, tuple[list[int], list[int]]]):
    found = [_found(words, n, *sets) for n, sets in sorted(grams.items())]
    return F.concat(*found) if found else F.array().cast("array<struct<at:int,len:int,text:string>>")


def _all_windows(words, n: int):
    return F.transform(_places(words, n), lambda i: F.struct(i.alias("at"), F.lit(n).alias("len"), _hash(words, i, n).alias("hash"), _text(words, i, n).alias("text")))


def find_hits(docs: DataFrame, key, benchmark: DataFrame, text: str = "text", carry: str | None = None, item: str = "item_id", item_text: str = "text", span: int = SPAN, set_limit: int = 100_000) -> DataFrame:
    """Per value of key: __key, n_words, spans (merged hit spans as word [start, stop)), n_hit, items, and the column carry.

    key names a row, or is a function of its text, so that equal texts are one. Up to set_limit distinct windows, their
    hashes go into the plan as a constant set, and the join that verifies is a broadcast; beyond it, candidates come
    from a shuffled join of all document windows with the benchmark's. Only keys, counts and candidate windows are
    shuffled. A null text has no words; an item without words has no window; with no documents or items there are no hits.
    Texts are read whole; the windows of one, however long, are one row's work. Rows of one key are one: they tell the
    same hits. docs is read for key, text and carry alone, so columns named __key or __carry in it only clash if they are
    meant themselves; items of equal text are told together, sorted as text.
    """
    grams = stored(windows(benchmark, item, item_text, span), "windows")
    small = grams.limit(set_limit + 1).count() <= set_limit
    kept = F.col(carry) if carry else F.lit(None).cast("string")
    base = docs.select(key.alias("__key"), kept.alias("__carry"), word_array(F.col(text)).alias("w"))
    if small:
        sets: dict[int, tuple[list[int], list[int]]] = {}
        for r in grams.select("len", "head", "hash").collect():  # at most set_limit rows
            h = sets.setdefault(r["len"], (set(), set()))
            h[0].add(r["head"])
            h[1].add(r["hash"])
        found = base.select("__key", "__carry", F.size("w").alias("n_words"), F.explode_outer(_candidates(F.col("w"), {n: (sorted(a), sorted(b)) for n, (a, b) in sets.items()})).alias("c"))
        found = found.select("__key", "__carry", "n_words", "c.at", "c.len", "c.text")
        joined = found.join(F.broadcast(grams.select("len", "text", "items")), ["len", "text"], "left")
    else:
        lens = [r["len"] for r in grams.select("len").distinct().collect()]  # at most `span` rows
        each = base.select("__key", "__carry", F.size("w").alias("n_words"), F.explode_outer(F.concat(*[_all_windows(F.col("w"), n) for n in lens])).alias("c"))
        each = each.select("__key", "__carry", "n_words", "c.*")
        # All rows stay, so that documents are told once; what is not the benchmark's own text has no items.
        known = grams.select("len", "hash", F.col("text").alias("__known"), "items")
        joined = each.join(known, ["len", "hash"], "left").withColumn("items", F.when(F.col("text") == F.col("__known"), F.col("items")))
    hit = F.when(F.col("items").isNotNull(), F.struct("at", (F.col("at") + F.col("len")).alias("stop")))
    spans = joined.groupBy("__key").agg(F.first("__carry").alias("__carry"), F.max("n_words").alias("n_words"), F.array_sort(F.collect_set(hit)).alias("raw"), F.collect_set("items").alias("sets"))
    merged = F.aggregate(
        "raw",
        F.array().cast("array<struct<at:int,stop:int>>"),
        lambda a, x: F.when((F.size(a) > 0) & (F.get(a, F.size(a) - 1)["stop"] >= x["at"]), F.concat(F.slice(a, 1, F.size(a) - 1), F.array(F.struct(F.get(a, F.size(a) - 1)["at"].alias("at"), F.greatest(F.get(a, F.size(a) - 1)["stop"], x["stop"]).alias("stop"))))).otherwise(F.concat(a, F.array(x))),
    )
    return spans.select(
        "__key",
        "__carry",
        F.col("n_words").cast("long").alias("n_words"),
        merged.alias("spans"),
        F.aggregate("raw", F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), lambda a, x: F.struct((a["n"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["at"], a["end"]))).alias("n"), F.greatest(a["end"], x["stop"]).alias("end")))["n"].alias("n_hit"),
        F.array_sort(F.array_distinct(F.flatten("sets"))).alias("items"),
    )


def contamination(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """Per row of docs: id, n_words, n_hit, n_items, items, items_sha256, contaminated.

    Repeated rows count each for itself, null ids keep null; null and empty texts have no words and no hits, texts of any
    length are read whole. An empty table gives no rows, an empty benchmark no hits. Other columns are not read. Rows are
    told apart by their place in the scan, so docs must be a table, or anything that gives the same rows in the same order
    when a part of it is computed again.
    """
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text).alias("__text"))
    found = find_hits(rows, F.monotonically_increasing_id(), benchmark, "__text", "__id", **how)
    items = F.array_join("items", ",")
    return found.select(F.col("__carry").alias(id_col), "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), "items", F.sha2(items, 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"), "spans")


def _named(docs: DataFrame, text: str) -> DataFrame:
    """docs with a key that is the text's alone: it is the same however often and in whatever order docs are computed."""
    return docs.withColumn("__name", F.sha2(F.coalesce(F.col(text), F.lit("")), 256))


def decontaminated(docs: DataFrame, benchmark: DataFrame, text: str = "text", drop_share: float = 0.0, **how) -> DataFrame:
    """docs without contaminated documents: those whose hit words exceed drop_share of all their words (0: any hit).

    Rows are judged by their texts alone, so repeated rows and equal texts stay or go together; null and empty texts
    stay. An empty benchmark drops nothing, an empty table gives no rows. docs must not have a column __name.
    """
    named = _named(docs, text)
    found = find_hits(named, F.col("__name"), benchmark, text, **how)
    bad = found.where((F.col("n_hit") > 0) & (F.col("n_hit") > F.col("n_words") * F.lit(drop_share))).select(F.col("__key").alias("__name"))
    return named.join(bad, "__name", "left_anti").select(*docs.columns)


def without_spans(docs: DataFrame, benchmark: DataFrame, text: str = "text", **how) -> DataFrame:
    """docs with hit words cut out of the text: the words that stay, with whatever stood before each of them.

    Texts without hits stay as they are, null and empty ones too; a text that is all hits keeps what follows its last
    word. Repeated rows each stay; an empty table gives no rows. docs must not have columns __name or __spans.
    """
    named = _named(docs, text)
    found = find_hits(named, F.col("__name"), benchmark, text, **how).select(F.col("__key").alias("__name"), F.col("spans").alias("__spans"))
    joined = named.join(found, "__name")
    # Each word with the characters before it, in the text as it was; what follows the last word is kept.
    parts = F.regexp_extract_all(F.col(text), F.lit(r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"), F.lit(0))
    left = F.filter(parts, lambda _, i: ~F.exists("__spans", lambda s: (i >= s["at"]) & (i < s["stop"])))
    tail = F.regexp_extract(F.col(text), r"([\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*)\z", 1)
    cut = F.when(F.size("__spans") > 0, F.concat(F.array_join(left, ""), tail)).otherwise(F.col(text))
    return joined.select(*[cut.alias(c) if c == text else F.col(c) for c in docs.columns])

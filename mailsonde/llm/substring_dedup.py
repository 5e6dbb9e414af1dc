"""Repeated passages: sliding runs of sentences, hashed and joined over all documents."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _WORDS, stored

#: A sentence ends after a full stop, question or exclamation mark before white space, or after a line break.
ENDS = re.compile(rb"(?<=[.!?])(?=[ \t\r\f\v\n])|(?<=\n)")
WORD = re.compile(rb"[^ ]+")
#: A run has so many sentences and words at least; sentences of more than LONGEST words are cut, after one word in CUT.
SENTENCES, WORDS, LONGEST, CUT = 2, 20, 40, 16
#: Runs that make up more than one in HOT of all are joined without a shuffle: there are fewer than HOT of them.
HOT = 10_000


def cut(data: bytes | None) -> Iterator[tuple[int, int, list[bytes]]]:
    """(start, stop, words) of the sentences that have words; what lies between goes with the one before.

    Text without marks has no sentences to slide over, so one of more than LONGEST words is cut further: where a word's
    hash says so, which is at the same words in every copy, and at LONGEST words in any case.
    """
    import xxhash

    held = None
    at = 0
    for part in ENDS.split(data or b""):
        plain = part.translate(_WORDS)
        ws = plain.split()
        if not ws:
            held = held and (held[0], at + len(part), held[2])
        elif len(ws) <= LONGEST:
            if held:
                yield held
            held = at, at + len(part), ws
        else:
            start, piece = 0, []
            for m in WORD.finditer(plain):
                if len(piece) >= LONGEST or (len(piece) > 1 and xxhash.xxh3_64_intdigest(piece[-1]) % CUT == 0):
                    if held:
                        yield held
                    held, start, piece = (at + start, at + m.start(), piece), m.start(), []
                piece.append(m[0])
            if held:
                yield held
            held = at + start, at + len(part), piece
        at += len(part)
    if held:
        yield held


def runs(parts: list[tuple[int, int, list[bytes]]], k: int = SENTENCES, least: int = WORDS) -> Iterator[tuple[int, int, bytes]]:
    """(first, count, text) of each sentence's shortest run of k or more sentences and `least` or more words, from it on and up to it.

    A sentence of a longer run lies in the shortest run up to it if the longer one's part up to it is enough, and
    otherwise in the shortest run from the longer one's first sentence on: these two kinds cover all that any run
    covers. What text is a run of which kind depends on the text alone. Ordered by first and count, each place once.
    """
    ns = [len(ws) for *_, ws in parts]
    joined = [b" ".join(ws) for *_, ws in parts]
    stop, total = 0, 0  # where the shortest run from a sentence on ends: never before that of the sentence before

    def shortest(i: int) -> int | None:
        nonlocal stop, total
        total -= ns[i - 1] if i else 0
        while stop < len(ns) and not (stop - i >= k and total >= least):
            total += ns[stop]
            stop += 1
        return stop if stop - i >= k and total >= least else None

    j = shortest(0) if parts else None
    for i in range(len(parts)):
        if j is None:
            return
        after = shortest(i + 1) if i + 1 < len(parts) else None
        # A run is the shortest up to its last sentence if the next sentence's run ends after that.
        for end in range(j, max(j, after - 1 if after else len(parts)) + 1):
            yield i, end - i, b"\n".join(joined[i:end])
        j = after


def repeated_runs(rows: DataFrame) -> DataFrame:
    """(id, th, first, end, src) of those of hashed_runs() that are not the first of their kind; src is the document of the first.

    A run's first place is the least (id, sentence): a document knows which of its own runs come again, and the least id
    is told by an aggregate that is combined before it is shuffled. Rows of a run that very many documents share find it
    where they lie, and are dealt out evenly among the others.
    """
    kinds = rows.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("id").alias("src")).where("n > 1")
    kinds = stored(kinds, "repeated-runs")
    common = F.col("n") * HOT > rows.count()
    hot = kinds.where(common).select("h1", "h2", F.col("src").alias("hot"))
    marked = rows.join(F.broadcast(hot), ["h1", "h2"], "left").drop("offsets")
    spread = F.when(F.col("hot").isNull(), F.col("h1")).otherwise(F.xxhash64("id", "place"))
    rest = kinds.where(~common).select("h1", "h2", "src").alias("k")
    found = marked.withColumn("h", spread).drop("h1").alias("r").join(rest, (F.col("r.h") == F.col("k.h1")) & (F.col("r.h2") == F.col("k.h2")), "left")
    found = found.select("id", "th", "place", F.coalesce("hot", "src").alias("src")).where(F.col("src").isNotNull() & ((F.col("id") > F.col("src")) | (F.col("place") % 2 == 1)))
    first, count = F.shiftright("place", 32).cast("int"), F.shiftright("place", 1).bitwiseAND(F.lit(2**31 - 1)).cast("int")
    return found.select("id", "th", first.alias("first"), (first + count).alias("end"), "src")


def hashed_runs(docs: DataFrame, id_col: str, text: str, k: int, least: int) -> DataFrame:
    """(id, th, place, h1, h2, offsets) of every run: th is the text's hash, h1 and h2 are the run's; a text's first run has the offsets.

    place holds the first sentence, the number of them, and whether the run comes again in its text. offsets are the
    sentences' starts in bytes and, last, the end of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        name = xxhash.xxh3_128_digest
        rows: list[tuple] = []

        def made() -> pa.RecordBatch:
            *cols, h, offsets = zip(*rows, strict=True)
            x = np.frombuffer(b"".join(h), "<i8").reshape(-1, 2)
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array(x[:, 0].copy()), pa.array(x[:, 1].copy()), pa.array(offsets, pa.list_(pa.int32()))], ["id", "th", "place", "h1", "h2", "offsets"])

        for b in batches:
            for d, th, t in zip(*b.columns, strict=True):  # a text at a time
                d, th, parts, seen = d.as_py(), th.as_py(), list(cut(t.as_py())), set()
                for i, n, x in runs(parts, k, least):
                    h = name(x)
                    rows.append((d, th, i << 32 | n << 1 | (h in seen), h, None if seen else [*(p[0] for p in parts), parts[-1][1]]))
                    seen.add(h)
                    if len(rows) >= 20_000:
                        yield made()
                        rows.clear()
        if rows:
            yield made()

    source = docs.select(F.col(id_col).cast("long").alias("id"), F.xxhash64(text).alias("th"), F.col(text).cast("binary").alias("t")).where("id is not null and length(t) > 0")
    return stored(source.mapInArrow(run, "id long, th long, place long, h1 long, h2 long, offsets array<int>"), "runs")


def repeated_passages(docs: DataFrame, id_col: str = "doc_id", text: str = "text", sentences: int = SENTENCES, least_words: int = WORDS) -> DataFrame:
    """Per text with repeated passages: id, th (the text's hash), n_removed (sentences), spans (bytes to remove, in order, disjoint), sources (ids that have them first).

    Null ids and texts, and texts too short for a run, have none. Rows that share an id are the same
    document: they take nothing from each other.
    """
    rows = hashed_runs(docs, id_col, text, sentences, least_words)
    rep = repeated_runs(rows)
    # Overlapping and adjoining runs are one span; the window holds one text's runs.
    order = Window.partitionBy("id", "th").orderBy("first", F.desc("end"))
    reach = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    span = F.sum(F.coalesce((F.col("first") > reach).cast("int"), F.lit(0))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    merged = rep.withColumn("span", span).groupBy("id", "th", "span").agg(F.min("first").alias("first"), F.max("end").alias("end"), F.collect_set("src").alias("src"))
    by = merged.groupBy("id", "th").agg(F.sum(F.col("end") - F.col("first")).alias("n_removed"), F.array_sort(F.collect_list(F.struct("first", "end"))).alias("s"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("src")))).alias("sources"))
    offsets = rows.where("offsets is not null").select("id", "th", "offsets").dropDuplicates(["id", "th"])
    at = lambda i: F.get("offsets", i)
    spans = F.transform("s", lambda x: F.struct(at(x["first"]).alias("start"), at(x["end"]).alias("stop")))
    return by.join(offsets, ["id", "th"]).select("id", "th", "n_removed", spans.alias("spans"), "sources")


def without(text, spans):
    """The text without the bytes of ordered, disjoint spans."""
    gap = lambda data, a, b: F.substring(data, a + 1, b - a).cast("string")
    before = lambda i: F.when(i == 0, F.lit(0)).otherwise(F.get(spans, i - 1)["stop"])
    left = lambda data: F.concat(F.array_join(F.transform(spans, lambda s, i: gap(data, before(i), s["start"])), ""), gap(data, F.get(spans, F.size(spans) - 1)["stop"], F.length(data)))
    return F.transform(F.array(text.cast("binary")), left)[0]


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with the column `repeats` (n_removed, sources, text): text is what stays of the whole text.

    Every row is kept: a text wholly repeated becomes empty, a null text stays null, rows with a null id keep theirs.
    Equal passages of one document stay at their first place; of several documents, at the least id. Repeated rows all
    get the same answer. Texts of any length are read whole, one at a time, and cut inside the JVM. An empty table gives
    no rows. Other columns are left alone, but for one named repeats, which this replaces.
    """
    found = stored(repeated_passages(docs, id_col, text, **how), "repeats")
    found = found.select(F.col("id").alias("__id"), F.col("th").alias("__th"), F.struct("n_removed", "spans", "sources").alias("__found"))
    joined = docs.join(found, (docs[id_col].cast("long") == found["__id"]) & (F.xxhash64(docs[text]) == found["__th"]), "left")
    left = F.when(F.col("__found").isNull(), docs[text]).otherwise(without(docs[text], F.col("__found.spans")))
    n, sources = F.coalesce("__found.n_removed", F.lit(0).cast("long")), F.coalesce("__found.sources", F.array().cast("array<long>"))
    return joined.select(*[docs[c] for c in docs.columns if c != "repeats"], F.struct(n.alias("n_removed"), sources.alias("sources"), left.alias("text")).alias("repeats"))

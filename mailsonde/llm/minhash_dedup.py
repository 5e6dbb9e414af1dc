"""Near-duplicates of documents: circulant MinHash, banding, exact Jaccard on full shingle sets.

Circulant MinHash takes all signature coordinates from two permutations of the 32-bit numbers: sigma spreads the
shingles, and coordinate k is the least value of pi(sigma(x) + k), that is, pi shifted circularly by k.

The bands' buckets are never expanded into all pairs. In each bucket every member is first held against one centre: the
member that meets most others over all bands, for a base text and its variants nearly always the base. Exact checks on
these links give components. Buckets that then still hold different components are compared in chunks, which return
only what joins components. So every pair that shares a bucket is checked, or its ends are known to be connected.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, space_words, stored
from .common import words as all_words
from .graph import components

#: At a Jaccard similarity of 0.8 a pair shares no band with a chance of 7e-6, at 0.9 of 1e-12.
BANDS, ROWS = 30, 5
#: Shingles of a chunk of a bucket.
GROUP = 400_000
#: Documents for each task that writes a table of the steps after the signatures: 450 000 band keys, some 25 MB.
DOCS = 15_000
_C1, _C2, _C3, _C4 = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53))
_U33, _U31 = np.uint64(33), np.uint64(31)


def _mix64(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U33)) * _C3
    x = (x ^ (x >> _U33)) * _C4
    return x ^ (x >> _U33)


def _permute32(x: np.ndarray, m1: int, m2: int) -> np.ndarray:
    """A bijection of the 32-bit numbers, for odd m1 and m2."""
    x = (x ^ (x >> np.uint32(16))) * np.uint32(m1)
    x = (x ^ (x >> np.uint32(13))) * np.uint32(m2)
    return x ^ (x >> np.uint32(16))


class Shingler:
    """Sorted distinct 64-bit hashes of a text's word n-grams; word hashes are remembered up to a bound."""

    def __init__(self, n: int, split=space_words, room: int = 50_000):
        import xxhash

        self.n, self.split, self.room, self.hash, self.known = n, split, room, xxhash.xxh3_64_intdigest, {}

    def __call__(self, data: bytes | None) -> np.ndarray:
        ws, known = self.split(data), self.known
        if not ws:
            return np.zeros(0, np.uint64)
        hs = list(map(known.get, ws))
        if None in hs:
            if len(known) > self.room:
                known.clear()
            for i, h in enumerate(hs):
                if h is None:
                    hs[i] = known[ws[i]] = self.hash(ws[i])
        a = np.array(hs, np.uint64)
        n = min(self.n, len(a))
        x = np.full(len(a) - n + 1, n, np.uint64)  # a shorter text is one shingle, unlike any of n words
        for i in range(n):
            x = _mix64(x * _C1 + a[i : len(a) - n + 1 + i] * _C2 + (x << _U31))
        return np.unique(x)


def band_keys(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """64-bit keys (sets, bands) of the circulant MinHash signatures of non-empty sets."""
    x = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    base = _permute32((x ^ (x >> np.uint64(32))).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    keys = np.empty((len(sets), bands), np.uint64)
    for b in range(bands):
        key = np.full(len(sets), b + 1, np.uint64)
        for r in range(rows):
            k = b * rows + r
            least = np.minimum.reduceat(_permute32(base + np.uint32(k), 0x85EBCA6B, 0xC2B2AE35), starts)
            key = _mix64(key * _C1 + least.astype(np.uint64))
        keys[:, b] = key
    return keys


def signatures(docs: DataFrame, id_col: str, text: str, n: int, by_letters: bool, bands: int, rows: int) -> DataFrame:
    """(id, n_shingles, digest, keys); digest names the set itself, keys are the bands'. Both are null for empty sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingle = Shingler(n, all_words if by_letters else space_words)

        def out(ids, sets):
            full = [s for s in sets if len(s)]
            keys = iter(band_keys(full, bands, rows).view(np.int64).tolist() if full else [])
            digests = [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets]
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array([len(s) for s in sets], pa.int64()), pa.array(digests, pa.binary()), pa.array([next(keys) if len(s) else None for s in sets], pa.list_(pa.int64()))],
                ["id", "n_shingles", "digest", "keys"],
            )

        for b in batches:
            ids, sets, held = [], [], 0
            for d, t in zip(*b.columns, strict=True):  # a text at a time
                s = shingle(t.as_py())
                ids.append(d.as_py())
                sets.append(s)
                if (held := held + len(s)) > 60_000:  # what fits a core's cache
                    yield out(ids, sets)
                    ids, sets, held = [], [], 0
            if ids:
                yield out(ids, sets)

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary").alias("t")).mapInArrow(run, "id long, n_shingles long, digest binary, keys array<long>")


def shingle_sets(docs: DataFrame, n: int, by_letters: bool) -> DataFrame:
    """(id, digest, s) of docs (id, t): s is the sorted set of hashes, as signed numbers; digest names it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        shingle = Shingler(n, all_words if by_letters else space_words)
        for b in batches:
            sets = [shingle(t.as_py()) for t in b.column(1)]
            lists = pa.ListArray.from_arrays(np.cumsum([0, *map(len, sets)], dtype=np.int32), np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), lists], ["id", "digest", "s"])

    return docs.mapInArrow(run, "id long, digest binary, s array<long>")


def verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of those (a, da, b, db) with 100 * intersection >= percent * union, on the full sets that da and db name.

    A pair is compared at a time, as a row: what a task holds does not grow with the pairs of a batch.
    """
    left = pairs.join(sets.select(F.col("id").alias("a"), F.col("digest").alias("da"), F.col("s").alias("sa")), ["a", "da"])
    pair = left.join(sets.select(F.col("id").alias("b"), F.col("digest").alias("db"), F.col("s").alias("sb")), ["b", "db"])
    # The same bound, with the intersection counted once; empty sets meet no bound.
    both, total = F.size(F.array_intersect("sa", "sb")).cast("long"), (F.size("sa") + F.size("sb")).cast("long")
    return pair.where(both * (100 + percent) >= F.greatest(total * percent, F.lit(1))).select("a", "b")


def links_within(buckets: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) that connect different components k of the same bucket, for buckets (key, rep, n, k, chunks).

    A bucket is dealt into chunks of about GROUP shingles, and each pair of its chunks is compared by one task, on full
    sets: every pair of documents of different components is checked. Of the links it finds a task returns those that
    join components it has not joined yet, so its rows are fewer than its documents.
    """
    who = [c for c in ("rep", "digest") if c in buckets.columns]  # digest tells sets of one id apart
    dealt = buckets.withColumn("c", F.pmod(F.xxhash64(*who), "chunks").cast("int"))
    # Chunk c takes part in the pairs (c, j) and (i, c).
    others = F.sequence(F.lit(0), F.col("chunks") - 1)
    dealt = dealt.select("key", *who, "k", "c", F.explode(others).alias("o"))
    dealt = dealt.select("key", *who, "k", F.least("c", "o").alias("i"), F.greatest("c", "o").alias("j"))
    # Sets join last, and only for pairs of chunks that hold different components.
    useful = dealt.groupBy("key", "i", "j").agg(F.min("k").alias("lo"), F.max("k").alias("hi")).where("lo < hi").select("key", "i", "j")
    rows = dealt.join(useful, ["key", "i", "j"]).join(sets.withColumnRenamed("id", "rep"), who).select("key", "i", "j", "rep", "k", "s")

    def compare(table: pa.Table) -> pa.Table:
        reps, ks = np.asarray(table["rep"]), np.asarray(table["k"])
        s = table["s"].combine_chunks()
        if pa.types.is_binary(s.type):  # packed
            sizes, flat = np.asarray(pc.binary_length(s)).astype(np.int64) // 8, np.frombuffer(b"".join(s.to_pylist()), np.int64)
        else:
            sizes, flat = np.asarray(pc.list_value_length(s)).astype(np.int64), np.asarray(s.flatten())
        starts = np.cumsum(sizes) - sizes
        values, index = np.unique(flat, return_inverse=True)
        names, own, counts = np.unique(ks, return_inverse=True, return_counts=True)
        root, out, mark = list(range(len(names))), [], np.zeros(len(values), bool)

        def find(x: int) -> int:
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for x in np.flatnonzero(own != counts.argmax()):  # the largest component's members are met by all others
            mine = index[starts[x] : starts[x] + sizes[x]]
            mark[mine] = True
            both = np.add.reduceat(mark[index], starts, dtype=np.int64)
            mark[mine] = False
            for y in np.flatnonzero((100 * both >= percent * (sizes + sizes[x] - both)) & (own != own[x])):
                p, q = find(own[x]), find(own[y])
                if p != q:
                    root[p] = q
                    out.append((int(reps[x]), int(reps[y])))
        cols = list(zip(*out, strict=True)) or [[], []]
        return pa.table([pa.array(c, pa.int64()) for c in cols], ["a", "b"])

    return rows.groupBy("key", "i", "j").applyInArrow(compare, "a long, b long")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n: int = 5, percent: int = 80, by_letters: bool = False, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Per row of docs: id, n_shingles, component_id (smallest id reachable over links), kept (id = component_id).

    Links join documents whose sets of distinct word n-grams (shorter texts: all words as one) have a Jaccard
    similarity of percent / 100 or more. Null and empty texts have the empty set and link with nothing. Equal sets are
    one vertex from the start, whatever their number. Rows that share an id are one document, which has the links of all
    its texts; rows with a null id keep a null component and stay. Texts of any length are read whole, one at a time: a
    set's hashes are sorted in one task. Ties do not arise: a component is named by its smallest id, links count by
    integers. An empty table gives no rows. Other columns are not read.
    """
    text_rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text).cast("binary").alias("t"))
    sig = stored(signatures(docs, id_col, text, n, by_letters, bands, rows), "signatures")
    few = 1 + sig.count() // DOCS
    classes = stored(sig.where("digest is not null and id is not null").groupBy("digest").agg(F.min("id").alias("rep"), F.first("n_shingles").alias("n"), F.count("*").alias("rows")), "classes", few)
    own = sig.alias("s").join(classes.alias("c"), (F.col("s.digest") == F.col("c.digest")) & (F.col("s.id") == F.col("c.rep")))
    own = own.select("rep", "s.digest", "n", "keys").dropDuplicates(["rep", "digest"])
    members = own.select("rep", "digest", "n", F.explode("keys").alias("key"))
    shared = members.groupBy("key").agg(F.count("*").alias("m")).where("m > 1")
    members = stored(members.join(shared, "key").select("key", "rep", "digest", "n", "m"), "buckets", few)

    centre = members.groupBy("rep", "digest").agg(F.sum("m").alias("met"))
    ranked = members.join(centre, ["rep", "digest"]).groupBy("key").agg(F.max(F.struct("met", (-F.col("rep")).alias("minus"), "digest", "n")).alias("c"))
    ends = F.struct("rep", "digest", "n"), F.struct((-F.col("c.minus")).alias("rep"), "c.digest", "c.n")
    star = members.join(ranked, "key").select(F.least(*ends).alias("x"), F.greatest(*ends).alias("y"))
    star = star.select(F.col("x.rep").alias("a"), F.col("x.digest").alias("da"), F.col("y.rep").alias("b"), F.col("y.digest").alias("db"), F.least("x.n", "y.n").alias("lo"), F.greatest("x.n", "y.n").alias("hi"))
    # Sets whose sizes alone keep the similarity below the bound need no check: intersection <= lo, union >= hi.
    allowed = F.col("lo") * 100 >= F.col("hi") * percent
    tried = stored(star.where((F.col("a") < F.col("b")) & allowed).select("a", "da", "b", "db").distinct(), "star-pairs", few)

    ends = broadcast_if_small(members.select("rep").distinct())
    sets = stored(shingle_sets(text_rows.join(ends, text_rows["id"] == ends["rep"], "left_semi"), n, by_letters), "sets", few)
    # An id with several texts joins their classes.
    several = sig.where("digest is not null and id is not null").groupBy("id").agg(F.min("digest").alias("lo"), F.max("digest").alias("hi")).where("lo < hi").select("id")
    several = stored(several, "ids-of-several-texts", few)
    same = sig.select("id", "digest").join(several, "id").join(classes, "digest").where("rep < id").select(F.col("rep").alias("a"), F.col("id").alias("b")).distinct()
    links = stored(verified(tried, sets, percent).unionByName(same), "links", few)
    found = stored(components(links), "components", few)

    placed = members.join(found, members["rep"] == found["id"], "left").select("key", "rep", "digest", "n", F.coalesce("component", "rep").alias("k"))
    split = placed.groupBy("key").agg(F.min("k").alias("lo"), F.max("k").alias("hi"), F.ceil(F.sum("n") / GROUP).cast("int").alias("chunks")).where("lo < hi").select("key", "chunks")
    more = stored(links_within(placed.join(split, "key"), sets, percent), "more-links")
    if not more.isEmpty():
        found = components(links.unionByName(more))

    # A row that is alone in its class and has no link names itself.
    named = classes.join(found, classes["rep"] == found["id"], "left").where("rows > 1 or component is not null")
    named = broadcast_if_small(named.select("digest", F.coalesce("component", "rep").alias("component")))
    out = sig.drop("keys").join(named, "digest", "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("component", "id"))
    return out.select(F.col("id").alias(id_col), "n_shingles", component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))


def deduplicated(docs: DataFrame, id_col: str = "doc_id", text: str = "text", **how) -> DataFrame:
    """docs with one document of each group: the one of smallest id. All rows of a kept id, and rows without id, stay.

    Null and empty texts are in no group and stay; an empty table gives no rows. docs must not have a column __gone.
    """
    gone = near_duplicates(docs, id_col, text, **how).where(~F.col("kept")).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[id_col] == gone["__gone"], "left_anti")

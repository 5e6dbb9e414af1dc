"""Cross-tokenizer alignment by merge-path partitioning.

The ends of A's tokens and of B's tokens are two sorted lists of byte offsets. Merging them cuts the bytes into stretches,
each the overlap of one A token and one B token; where both lists hold the same offset, a group ends. A merge is a path
through the grid of both lists: binary searches along diagonals of the grid find points of that path at equal distances,
so the pieces between them hold equal work and are merged independently. A piece reports its overlaps and the groups
that end in it; groups are stitched by counting ends, so one that crosses pieces is one group.

Counts over all documents: each document's distinct linked id pairs are summed by pair. The most common pairs, up to a
stated number, are then looked up in a broadcast array; the rare rest joins in a shuffle, where no key is common.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored

#: Steps of the merge in one piece, tokens of documents that are merged together, and pairs that are broadcast at most.
PIECE, TOGETHER, COMMON = 1 << 16, 1_000_000, 1_000_000
#: A blank between two characters that are no white space: no token of A or B goes on over its left side.
_CUT = re.compile(r"(?<=\S) (?=\S)")
#: Latin letters and marks after them, which A's step before its model cuts apart and leaves whole; and that step.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]*)")
_STEPS = None, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}
PARTS = "doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def split_path(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray]:
    """Points (i, j) of the merge path of sorted a and b, one every `piece` steps, first and last included; on ties a goes first."""
    d = np.append(np.arange(0, len(a) + len(b), piece), len(a) + len(b))
    lo, hi = np.maximum(0, d - len(b)), np.minimum(d, len(a))
    while (lo < hi).any():  # all diagonals are searched at once
        mid = (lo + hi) // 2
        open_ = lo < hi
        take = np.zeros(len(d), bool)
        take[open_] = a[mid[open_]] <= b[d[open_] - mid[open_] - 1]  # a[mid] comes before b[d - mid - 1]: the path goes further in a
        lo = np.where(open_ & take, mid + 1, lo)
        hi = np.where(open_ & ~take, mid, hi)
    return lo, d - lo


def merge_piece(a: np.ndarray, b: np.ndarray, i: slice, j: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(A token, B token, whether a group ends there) of each stretch that ends in the piece a[i], b[j].

    A tie whose a lies before the piece was reported there already; one whose b lies after it is reported here.
    """
    mine, other = a[i], b[j]
    if len(other) and i.start and a[i.start - 1] == other[0]:
        other = other[1:]
        j = slice(j.start + 1, j.stop)
    ends = np.concatenate([mine, other])
    ends.sort(kind="stable")
    ends = ends[np.concatenate([[True], ends[1:] != ends[:-1]])] if len(ends) else ends
    ia, jb = i.start + np.searchsorted(mine, ends), j.start + np.searchsorted(other, ends)
    return ia, jb, (a[np.minimum(ia, len(a) - 1)] == ends) & (b[np.minimum(jb, len(b) - 1)] == ends)


def align(a: np.ndarray, b: np.ndarray, piece: int = PIECE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Links (A token, B token, group) of two lists of ends that close at the same offset, pieces stitched."""
    at, to = split_path(a, b, piece)
    parts, groups = [], 0
    for i0, i1, j0, j1 in zip(at, at[1:], to, to[1:], strict=False):
        ia, jb, closed = merge_piece(a, b, slice(i0, i1), slice(j0, j1))
        number = groups + np.cumsum(closed) - closed
        parts.append((ia, jb, number))
        groups += int(closed.sum())
    if not parts:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


class Pair:
    """Both tokenizers behind a memory of about `room` pieces between cuts."""

    def __init__(self, a: str, b: str, room: int = 400_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.a, self.b, self.room = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b), room
        self.a.encode_special_tokens = True
        shown = {ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0]: c.encode() for c in map(chr, range(0x80))}
        for lead in range(0xC2, 0xF5):  # bytes beyond ASCII, from characters that hold them
            for tail in range(0x80, 0xC0):
                raw = bytes((lead, tail, 0x80, 0x80)[: 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4])
                try:
                    text = raw.decode()
                except UnicodeDecodeError:
                    continue
                shown.update(zip(ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(text)[0][0], (bytes([x]) for x in raw), strict=True))
        vocab = self.a.get_vocab(with_added_tokens=True)
        self.bytes_a = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.bytes_a[i] = b"".join(shown.get(c) or c.encode() for c in token)
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(x[3:5], 16)]) if self.b.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(names)]
        self.size_a, self.size_b = (np.array([len(x) for x in y], np.int64) for y in (self.bytes_a, self.bytes_b))
        self.text_a, self.text_b = (np.array([str(i).encode() for i in range(len(y))]) for y in (self.bytes_a, self.bytes_b))
        steps = json.loads(self.a.to_str())
        self.plain = (steps["normalizer"], steps["pre_tokenizer"]) == _STEPS
        # A's own step begins a token at each cut; pieces of B that hold a blank after something else would go over it.
        self.cuts = self.plain and not any(re.search("[^▁]▁", x) for x in names)
        self.shown = {i: "".join(k for x in chr(i).encode() for k, v in shown.items() if v[0] == x) for i in range(0xC0, 0x100)}
        self.marks: dict[str, list[int]] = {"": []}
        self.known: dict[str, tuple[bytes, bytes, bool]] = {}

    def ids_a(self, new: list[str]) -> list[list[int]]:
        """A's ids of pieces with a blank before each; plain words go to its model at once."""
        out, rest = [], []
        for x in new:
            if self.plain and (m := _PLAIN.fullmatch(x)):
                if m[2] not in self.marks:
                    if len(self.marks) > 10_000:
                        self.marks = {"": []}
                    self.marks[m[2]] = [t.id for t in self.a.model.tokenize(m[2])]
                out.append([t.id for t in self.a.model.tokenize("Ġ" + (m[1] if m[1].isascii() else m[1].translate(self.shown)))] + self.marks[m[2]])
            else:
                out.append(None)
                rest.append(f" {x}")
        coded = iter(self.a.encode_batch_fast(rest, add_special_tokens=False))
        return [next(coded).ids if x is None else x for x in out]

    def learn(self, new: list[str]) -> None:
        got_b = self.b.encode(new, num_threads=1)
        for x, e, y in zip(new, self.ids_a(new), got_b, strict=True):
            raw = f" {x}".encode()
            whole = b"".join(map(self.bytes_a.__getitem__, e)) == raw == b"".join(map(self.bytes_b.__getitem__, y))
            self.known[x] = array("I", e).tobytes(), array("I", y).tobytes(), whole

    def __call__(self, texts: Iterator[str | None], many: int = 200_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """A's and B's ids of each text with a blank before it; none where the tokens do not give its bytes back."""
        held, size = [], 0
        for t in texts:
            held.append((t, (_CUT.split(t) if self.cuts else [t]) if t else []))
            if (size := size + len(held[-1][1])) >= many:
                yield from self._coded(held)
                held, size = [], 0
        yield from self._coded(held)

    def _coded(self, held: list[tuple[str | None, list[str]]]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        known = self.known
        new = list({x for _, pieces in held for x in pieces if x not in known})
        for i in range(0, len(new), 50_000):
            self.learn(new[i : i + 50_000])
        known = self.known
        for t, pieces in held:
            got = list(map(known.__getitem__, pieces))
            ids = [np.frombuffer(b"".join([x[k] for x in got]), "<u4").astype(np.int64) for k in (0, 1)]
            if not all([x[2] for x in got]):
                raw = f" {t}".encode()
                if not all(b"".join(map(of.__getitem__, x.tolist())) == raw for of, x in zip((self.bytes_a, self.bytes_b), ids, strict=True)):
                    ids = [np.zeros(0, np.int64)] * 2
            yield ids[0], ids[1]
        if len(known) > self.room:  # frequent pieces came early: the earlier half stays
            self.known = dict(islice(known.items(), self.room // 2))


@lru_cache(2)
def pair(a: str, b: str) -> Pair:
    """One for all tasks of a Python worker."""
    return Pair(a, b)


def default_vocabularies() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


def _written(names_a: np.ndarray, names_b: np.ndarray, ga: np.ndarray, gb: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, end of each group in them) of `a1,a2|b1;...;` over all groups; ga and gb are the tokens' groups."""
    na, nb = np.bincount(ga, minlength=groups), np.bincount(gb, minlength=groups)
    width = max(names_a.dtype.itemsize, names_b.dtype.itemsize)
    cells = np.zeros((len(ga) + len(gb), width + 1), np.uint8)
    before = lambda n, g: (np.cumsum(n) - n)[g]
    at_a, at_b = np.arange(len(ga)) + before(nb, ga), np.arange(len(gb)) + np.cumsum(na)[gb]
    for at, names, sep in ((at_a, names_a, b","), (at_b, names_b, b",")):
        cells[at, : names.dtype.itemsize] = names.view(np.uint8).reshape(len(names), -1)
        cells[at, width] = sep[0]
    cells[at_a[np.cumsum(na) - 1], width] = b"|"[0]
    cells[at_b[np.cumsum(nb) - 1], width] = b";"[0]
    sizes = (cells != 0).sum(1)
    return cells[cells != 0], np.cumsum(sizes)[np.cumsum(na + nb) - 1]


def aligned(ids: list[tuple[np.ndarray, np.ndarray]], p: Pair, piece: int = PIECE) -> list[tuple]:
    """(n_a, n_b, n_groups, n_links, groups_sha256, pairs, times) of each text's ids; texts follow each other on one line of bytes, merged as one."""
    a, b = (np.concatenate([x[k] for x in ids] or [np.zeros(0, np.int64)]) for k in (0, 1))
    out = [(0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32))] * len(ids)
    if not len(a):
        return out
    ia, jb, group = align(np.cumsum(p.size_a[a]), np.cumsum(p.size_b[b]), piece)
    groups = int(group[-1]) + 1
    ga, gb = np.empty(len(a), np.int64), np.empty(len(b), np.int64)
    ga[ia], gb[jb] = group, group
    raw, ends = _written(p.text_a[a], p.text_b[b], ga, gb, groups)
    full = [k for k, x in enumerate(ids) if len(x[0])]
    n_a, n_b = (np.array([len(ids[k][side]) for k in full]) for side in (0, 1))
    last = np.cumsum(n_a) - 1
    g_end = ga[last] + 1
    g_start = np.concatenate([[0], g_end[:-1]])
    l_end = np.searchsorted(group, g_end)
    l_start = np.concatenate([[0], l_end[:-1]])
    key = a[ia] << 32 | b[jb]
    for k, na, nb, g0, g1, l0, l1 in zip(full, n_a.tolist(), n_b.tolist(), g_start, g_end, l_start, l_end, strict=True):
        r0 = ends[g0 - 1] if g0 else 0
        pairs, times = np.unique(key[l0:l1], return_counts=True)
        out[k] = (na, nb, int(g1 - g0), int(l1 - l0), hashlib.sha256(raw[r0 : ends[g1 - 1] - 1]).hexdigest(), pairs, times.astype(np.int32))
    return out


def _lists(xs: list[np.ndarray], kind: pa.DataType) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(xs) if xs else [], kind))


def align_documents(docs: DataFrame, a: str | None = None, b: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """A row a document (PARTS): counts, the groups' digest, and its distinct linked pairs (A id << 32 | B id) with how often each is linked.

    Null, empty and unreproducible texts have zeros and no pairs. Texts of any length are read whole; a batch's tokens
    are merged at most TOGETHER at a time, or one text's. Repeated rows each stay; an empty table gives no rows; other
    columns are not read, so no name clashes.
    """
    a, b = a or default_vocabularies()[0], b or default_vocabularies()[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = pair(a, b)

        def flush(held, ids):
            rows = list(zip(*aligned(ids, p), strict=True))
            return pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), *(pa.array(x, pa.int64()) for x in rows[:4]), pa.array(rows[4], pa.string()), _lists(rows[5], pa.int64()), _lists(rows[6], pa.int32())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"])

        held, ids, size = [], [], 0
        for batch in batches:
            for d, x in zip(batch.column(0), p(t.as_py() for t in batch.column(1)), strict=True):
                held.append(d.as_py())
                ids.append(x)
                if (size := size + len(x[0]) + len(x[1])) >= TOGETHER or len(held) >= 10_000:
                    yield flush(held, ids)
                    held, ids, size = [], [], 0
        if held:
            yield flush(held, ids)

    return docs.select(F.col(id_col).cast("long").alias("i"), F.col(text).cast("string").alias("t")).mapInArrow(run, PARTS)


def _looked_up(parts: DataFrame, common) -> DataFrame:
    """parts with n_best and count_sum over the common pairs, and the others as struct arrays; common is broadcast (pairs sorted, count, best)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, count, best = (np.frombuffer(x, k) for x, k in zip(common.value, ("<i8", "<i8", "u1"), strict=True))
        for batch in batches:
            pairs, times = batch.column("pairs"), batch.column("times")
            key, n, ends = pairs.flatten().to_numpy(), times.flatten().to_numpy(), pairs.value_lengths().to_numpy().cumsum()
            at = np.minimum(np.searchsorted(known, key), max(0, len(known) - 1))
            hit = known[at] == key if len(known) else np.zeros(len(key), bool)
            sums = [np.concatenate([[0], np.cumsum(np.where(hit, n * of[at], 0) if len(known) else np.zeros(len(key), np.int64))])[np.concatenate([[0], ends])] for of in (best.astype(np.int64), count)]
            keep = np.split(~hit, ends[:-1]) if len(ends) else []
            rest = [_lists([x[k] for x, k in zip(np.split(v, ends[:-1]), keep, strict=True)] if len(ends) else [], kind) for v, kind in ((key, pa.int64()), (n, pa.int32()))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(6)), *(pa.array(np.diff(s), pa.int64()) for s in sums), *rest], [*batch.schema.names[:6], "n_best", "count_sum", "pairs", "times"])

    return parts.mapInArrow(run, PARTS.replace("pairs", "n_best long, count_sum long, pairs"))


def alignment(docs: DataFrame, a: str | None = None, b: str | None = None, id_col: str = "doc_id", text: str = "text", common: int = COMMON) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256 of every row of docs.

    n_best counts links whose pair's count is the highest of its A id (ties included), count_sum adds the counts over
    links; a pair's count is the number of documents (rows) that hold it. At most `common` pairs, the most frequent, go
    to every task (17 bytes each); the rest joins by a shuffle. Edge cases as in align_documents().
    """
    spark = docs.sparkSession
    parts = stored(align_documents(docs, a, b, id_col, text).withColumn("row", F.monotonically_increasing_id()), "aligned")
    counts = parts.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count("*").alias("n"))
    counts = stored(counts, "pair-counts")
    tops = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("top"))
    ranked = stored(counts.withColumn("a", F.shiftright("pair", 32)).join(tops, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("best")), "pair-ranks")
    # The common pairs are those counted more often than some bound, so what is left over is rare: no key of the join is hot.
    levels = ranked.groupBy("n").agg(F.count("*").alias("k")).orderBy(F.desc("n")).limit(common + 1)
    floor, held = 0, 0
    for r in levels.toLocalIterator():
        if held + r["k"] > common:
            floor = r["n"]
            break
        held += r["k"]
    got = ranked.where(F.col("n") > floor).toArrow()
    got = got.sort_by("pair")
    sent = spark.sparkContext.broadcast(tuple(got[c].to_numpy().astype(k).tobytes() for c, k in (("pair", "<i8"), ("n", "<i8"), ("best", "u1"))))
    found = _looked_up(parts.drop("row"), sent) if not floor else None
    if found is not None:
        return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
    found = stored(_looked_up(parts.drop("row"), sent).withColumn("row", F.monotonically_increasing_id()), "aligned-rest")
    rest = found.select("row", F.explode(F.arrays_zip("pairs", "times")).alias("x")).select("row", F.col("x.pairs").alias("pair"), F.col("x.times").alias("times"))
    rest = rest.join(ranked.where(F.col("n") <= floor), "pair").groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("b"), F.sum(F.col("times") * F.col("n")).alias("s"))
    return found.join(rest, "row", "left").select("doc_id", "n_a", "n_b", "n_groups", "n_links", (F.col("n_best") + F.coalesce("b", F.lit(0))).alias("n_best"), (F.col("count_sum") + F.coalesce("s", F.lit(0))).alias("count_sum"), "groups_sha256")

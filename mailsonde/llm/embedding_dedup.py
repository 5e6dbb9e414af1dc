"""Near-duplicate vectors by a subspace pigeonhole join.

Unit vectors with a cosine of c are at squared distance 2 - 2c. A fixed rotation spreads that evenly over the
coordinates; these are split into blocks, and if all of a pair's distance is within the bound, that of one block is
within its share. So each block is range-joined under that share, and the union of candidates is verified on whole
vectors in double precision: no pair is missed.

The range join of a block cuts its space into cells, half its radius wide, one coordinate after the other, and only
where a cell still holds more than a chunk: the more vectors, the more coordinates tell them apart. Two cells are
compared unless the gaps between them add up to the radius. A task compares two cells as one matrix product over the
block's coordinates; whole vectors are read only where that finds candidates. It reports the verified links as link
counts per vector and a spanning forest, never as pairs. Equal vectors are one from the start, whatever their number.
"""

from __future__ import annotations

from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import file_system, new_path, stored, write_whole
from .graph import components

BLOCKS, CHUNK, STRIP = 4, 1024, 1024
#: Comparisons of a task, and what reading a chunk counts as.
TASK, LOAD = 4e8, 2e5
#: Rounding of block distances in double and in single precision; candidates are verified, so a little more is only a little more work.
SLACK, SLACK32 = 1e-6, 1e-5
#: Cells are this share of a block's radius wide; in units of a cell, partners' gaps have squares that sum to less than REACH.
WIDTH, REACH = 0.5, 4


def rotation(dims: int, seed: int = 7) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dims, dims)))
    return q * np.sign(np.diag(r))


def block_slices(dims: int, blocks: int) -> list[slice]:
    cuts = [dims * i // blocks for i in range(blocks + 1)]
    return [slice(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a]


def _unit(raw: np.ndarray) -> np.ndarray:
    x = raw.astype(np.float64)
    x /= np.abs(x).max(1, keepdims=True)  # keeps squares of very large and very small components in range
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Component numbers of n vertices under links (a, b)."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


class Chunk:
    """Vectors of one cell, from a file: id i64[n] | rows i32[n] (negative: all of one id) | block's rotated coordinates f32[n, k] | vectors[n, dims]."""

    def __init__(self, name: str, n: int, dims: int, width: int, kind: str):
        self.name, self.n, self.dims, self.kind = name, n, dims, kind
        data = self._read(0, head := n * (12 + 4 * width))
        self.ids, rows = np.frombuffer(data, "<i8", n), np.frombuffer(data, "<i4", n, 8 * n)
        self.rows, self.times = np.abs(rows), np.maximum(1, -rows)  # rows of one id count their links together
        self.block = np.frombuffer(data, "<f4", n * width, 12 * n).reshape(n, width)
        norms = (self.block * self.block).sum(1, keepdims=True)
        one = np.ones_like(norms)
        # One product of the two gives squared distances.
        self.left, self.right = np.hstack([-2 * self.block, norms, one]), np.hstack([self.block, one, norms])
        self.head, self._whole = head, None

    def _read(self, at: int, size: int) -> bytes:
        fs, path = file_system(self.name)
        with fs.open_input_file(path) as f:
            return f.read_at(size, at)

    def whole(self) -> tuple[np.ndarray, np.ndarray]:
        """Unit vectors and what the rotation makes of them, in double precision."""
        if self._whole is None:
            size = self.n * self.dims * np.dtype(self.kind).itemsize
            x = _unit(np.frombuffer(self._read(self.head, size), self.kind).reshape(self.n, self.dims))
            self._whole = x, x @ rotation(self.dims)
        return self._whole

    @staticmethod
    def parts(ids: np.ndarray, rows: np.ndarray, raw: list[bytes], dims: int, s: slice, kind: str) -> list[bytes]:
        x = np.frombuffer(b"".join(raw), kind).reshape(len(ids), dims)
        return [ids.astype("<i8").tobytes(), rows.astype("<i4").tobytes(), (_unit(x) @ rotation(dims))[:, s].astype("<f4").tobytes(), *raw]


def compare(a: Chunk, b: Chunk, block: int, slices: list[slice], cosine: float) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, links of each, root id of each) over the links between two chunks, or within one, that belong to this block."""
    budget = (2 - 2 * cosine) / len(slices) + SLACK
    edge = budget - SLACK / 2
    for at in range(0, a.n, STRIP):
        i, j = np.nonzero(a.left[at : at + STRIP] @ b.right.T <= np.float32(budget + SLACK32))
        i += at
        ok = a.ids[i] != b.ids[j]
        if a is b:
            ok &= i < j
        i, j = i[ok], j[ok]
        if not len(i):
            continue
        (xa, ra), (xb, rb) = a.whole(), b.whole()
        keep = []
        for k in range(0, len(i), 65_536):
            p, q = i[k : k + 65_536], j[k : k + 65_536]
            # Many blocks may find a pair: the first whose share it keeps has it.
            for other in range(block + 1):
                e = ra[p, slices[other]] - rb[q, slices[other]]
                near = (e * e).sum(1) <= edge
                mine = near if other == block else ~near
                p, q = p[mine], q[mine]
            linked = (xa[p] * xb[q]).sum(1) >= cosine
            keep.append((p[linked], q[linked]))
        i, j = (np.concatenate(c) for c in zip(*keep, strict=True))
        if len(i):
            ids, ends = np.unique(np.concatenate([a.ids[i], b.ids[j]]), return_inverse=True)
            weights = np.concatenate([a.times[i] * b.rows[j], b.times[j] * a.rows[i]])
            yield ids, np.bincount(ends, weights, len(ids)).astype(np.int64), ids[_roots(len(ids), ends[: len(i)], ends[len(i) :])]


def _cells(places: DataFrame, chunk: int) -> DataFrame:
    """places (block, depth, path, and what else) with `cell`, the shortest beginning of path that at most `chunk` rows share, and `chunks` to cut it into.

    A round cuts the cells that are still too large along one more coordinate; each reads and writes only their rows.
    """
    key, done, live, depth = ["dims", "block", "cell"], None, places, 0
    while True:
        depth += 1
        live = live.withColumn("cell", F.slice("path", 1, depth))
        sizes = live.groupBy(*key).agg(F.count("*").alias("n"))
        placed = stored(live.join(sizes, key).withColumn("last", (F.col("n") <= chunk) | (F.size("path") <= depth)), f"cells-{depth}")
        ready = placed.where("last").withColumn("chunks", F.ceil(F.col("n") / chunk).cast("int")).drop("n", "last", "path")
        done = ready if done is None else done.unionByName(ready)
        live = placed.where("not last").drop("n", "last", "cell")
        if live.isEmpty():
            return done


def similar_vectors(vectors: DataFrame, id_col: str = "vec_id", vector: str = "embedding", cosine: float = 0.95, blocks: int = BLOCKS, chunk: int = CHUNK) -> DataFrame:
    """Per row of vectors: id, n_links (other ids' vectors at the cosine or above), component_id, kept (id = component_id).

    Null, empty and zero vectors, and vectors with null or non-finite components, link with nothing. Vectors of
    different lengths never link. Rows that share an id do not link with each other, share one component, and each link
    of theirs counts. Rows with a null id have no links and stay. An empty table gives no rows. The cosine is that of
    vectors scaled to length 1 in double precision. Vectors of any length are taken whole; other columns are not read.
    """
    single = dict(vectors.dtypes)[vector] == "array<float>"
    kind, column = ("<f4", "array<float>") if single else ("<f8", "array<double>")
    kept = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(vector).cast(column).alias("v"))

    def sound(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            lists = batch.column(1)
            dims = np.asarray(lists.value_lengths().fill_null(0))
            flat = np.asarray(lists.flatten().to_numpy(zero_copy_only=False), kind)  # null components become NaN
            ids, starts = np.asarray(batch.column(0)), np.cumsum(dims) - dims
            for n in np.unique(dims[dims > 0]):
                at = np.flatnonzero(dims == n)
                x = flat[starts[at][:, None] + np.arange(n)]
                good = np.isfinite(x).all(1) & (x != 0).any(1)
                at, x = at[good], np.ascontiguousarray(x[good])
                if not len(at):
                    continue
                names = np.frombuffer(b"".join(xxhash.xxh3_128_digest(y) for y in _unit(x)), "<i8").reshape(-1, 2)
                yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(np.full(len(at), n, np.int32)), pa.array(names[:, 0].copy()), pa.array(names[:, 1].copy()), pa.array([y.tobytes() for y in x], pa.binary())], ["id", "dims", "h1", "h2", "raw"])

    good = kept.where("id is not null and v is not null").mapInArrow(sound, "id long, dims int, h1 long, h2 long, raw binary")
    good = stored(good, "vectors")
    # Equal vectors are one class, named by its least id; those of an id with several rows are classes of their own.
    several = good.groupBy("id").agg(F.count("*").alias("m")).where("m > 1").select("id", F.col("id").alias("own"))
    members = good.drop("raw").join(several, "id", "left")
    named = stored(members.groupBy("h1", "h2", "own").agg(F.min("id").alias("rep"), F.count("*").cast("int").alias("m")), "classes")
    first = good.join(named.select("rep", "h1", "h2", "own", "m"), (F.col("id") == F.col("rep")) & (good["h1"] == named["h1"]) & (good["h2"] == named["h2"]))
    first = stored(first.select("rep", good["h1"], "dims", F.when(F.col("own").isNull(), F.col("m")).otherwise(-F.col("m")).alias("m"), "raw").dropDuplicates(["rep", "h1"]), "class-vectors")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rep, h1, dims, raw = batch.column(0), batch.column(1), np.asarray(batch.column(2)), batch.column(3).to_pylist()
            for n in np.unique(dims):
                at = np.flatnonzero(dims == n)
                r = _unit(np.frombuffer(b"".join(raw[i] for i in at), kind).reshape(len(at), n)) @ rotation(int(n))
                slices = block_slices(int(n), blocks)
                width = ((2 - 2 * cosine) / len(slices) + SLACK) ** 0.5 * WIDTH  # short vectors have fewer blocks
                for k, s in enumerate(slices):
                    path = np.floor(r[:, s] / width).astype(np.int32)
                    cells = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * path.shape[1]), pa.array(path.ravel()))
                    yield pa.RecordBatch.from_arrays([rep.take(pa.array(at)), h1.take(pa.array(at)), pa.array(np.full(len(at), n, np.int32)), pa.array(np.full(len(at), k, np.int32)), cells], ["rep", "h1", "dims", "block", "path"])

    places = first.select("rep", "h1", "dims", "raw").mapInArrow(place, "rep long, h1 long, dims int, block int, path array<int>")
    cells = _cells(stored(places, "places"), chunk)
    dealt = cells.withColumn("salt", F.pmod(F.xxhash64("rep", "block"), "chunks").cast("int")).select("rep", "h1", "block", "cell", "salt").join(first, ["rep", "h1"])
    path = new_path(vectors.sparkSession, "vector-chunks")

    def write(table: pa.Table) -> pa.Table:
        dims, block, cell, salt = (table[k][0].as_py() for k in ("dims", "block", "cell", "salt"))
        name, s = f"{path}/{dims}_{block}_{'_'.join(map(str, cell))}_{salt}.bin", block_slices(dims, blocks)[block]
        write_whole(name, Chunk.parts(np.asarray(table["rep"]), np.asarray(table["m"]), table["raw"].to_pylist(), dims, s, kind))
        return pa.table([pa.array([dims], pa.int32()), pa.array([block], pa.int32()), pa.array([cell], pa.list_(pa.int32())), pa.array([name]), pa.array([len(table)], pa.int32())], ["dims", "block", "cell", "file", "n"])

    # Chunks are files in the shared folder: each is read by the tasks that compare it, and no vector is shuffled again.
    written = dealt.groupBy("dims", "block", "cell", "salt").applyInArrow(write, "dims int, block int, cell array<int>, file string, n int")
    chunks = stored(written.withColumn("c0", F.col("cell")[0]), "chunks")
    near = [F.lit(i) for i in range(int(REACH**0.5) + 1)]
    left = chunks.withColumn("to", F.explode(F.transform(F.array(*near), lambda i: F.col("c0") + i))).alias("l")
    meet = (F.col("l.dims") == F.col("r.dims")) & (F.col("l.block") == F.col("r.block")) & (F.col("l.to") == F.col("r.c0"))
    gaps = F.zip_with("l.cell", "r.cell", lambda x, y: F.coalesce(F.greatest(F.abs(x - y) - 1, F.lit(0)), F.lit(0)))
    apart = F.aggregate(gaps, F.lit(0), lambda s, g: s + g * g)
    pairs = left.join(chunks.alias("r"), meet).where((apart < REACH) & ((F.col("l.to") > F.col("l.c0")) | (F.col("l.file") <= F.col("r.file"))))
    pairs = stored(pairs.select("l.dims", "l.block", F.col("l.file").alias("file"), F.col("l.n").alias("n"), F.col("r.file").alias("file2"), F.col("r.n").alias("n2")), "chunk-pairs")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: OrderedDict[str, Chunk] = OrderedDict()

        def load(name: str, n: int, dims: int, s: slice) -> Chunk:
            held[name] = held.pop(name, None) or Chunk(name, n, dims, s.stop - s.start, kind)
            while len(held) > 32:
                held.popitem(last=False)
            return held[name]

        for batch in batches:
            for r in batch.to_pylist():
                slices = block_slices(r["dims"], blocks)
                a, b = (load(r[f], r[n], r["dims"], slices[r["block"]]) for f, n in (("file", "n"), ("file2", "n2")))
                for found in compare(a, b, r["block"], slices, cosine):
                    yield pa.RecordBatch.from_arrays([pa.array(z, pa.int64()) for z in found], ["rep", "n", "root"])

    # Tasks of about the same number of comparisons; pairs of one cell go to few of them, which keep what they have read.
    work_done = pairs.agg(F.sum(F.col("n").cast("double") * F.col("n2") + LOAD)).first()[0] or 0
    tasks = int(work_done / TASK) + 1
    dealt = pairs.repartition(tasks, "file", F.pmod(F.xxhash64("file2"), F.lit(4))).sortWithinPartitions("file", "file2")
    found = stored(dealt.mapInArrow(work, "rep long, n long, root long"), "links")
    counts = found.groupBy("rep").agg(F.sum("n").alias("n"))
    groups = components(found.select(F.col("rep").alias("a"), F.col("root").alias("b")))
    each = members.join(named, (members["h1"] == named["h1"]) & (members["h2"] == named["h2"]) & members["own"].eqNullSafe(named["own"])).select("id", members["own"], "rep", "m")
    each = each.join(counts, "rep", "left").join(groups, each["rep"] == groups["id"], "left").select(each["id"], "own", "rep", "m", "n", "component")
    # An id's classes of its own all have its name; their links are counted together.
    alone = each.where("own is null").select("id", (F.coalesce("n", F.lit(0)) + F.col("m") - 1).alias("n"), F.coalesce("component", "rep").alias("component"))
    shared = each.where("own is not null").groupBy("id").agg(F.first("n").alias("n"), F.first(F.coalesce("component", "rep")).alias("component"))
    both = alone.unionByName(shared)
    out = kept.select("id").join(both, "id", "left")
    component = F.coalesce("component", "id")
    return out.select(F.col("id").alias(id_col), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("id") == component, F.lit(True)).alias("kept"))

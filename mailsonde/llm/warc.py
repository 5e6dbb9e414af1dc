"""WARC archives of pages, and their index by an external merge.

Each writing task appends gzip members, one a record, to its archive and keeps what it wrote as a capture run: index
lines sorted by (URL key, timestamp, id, place), in a file of fixed-size parts, each with a mark. A pass merges up to
FAN_IN runs into one: their marks, in order, cut the keys into ranges of so many parts, and for each range a task merges
the runs' parts that reach into it with a loser tree, opening a part at a time. Passes go on until one run is left; its
ranges, in order, are the globally ordered capture history. A task holds the lines of one range, whatever the size.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from datetime import UTC, datetime, timedelta
from itertools import islice

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import file_system, new_path, stored, write_whole

#: Lines of a part, runs of a merge, parts that a range begins, bytes of an archive that a task reads.
PART, FAN_IN, MARKS, SLICE = 1000, 64, 16, 8 << 20
EPOCH = datetime(2024, 1, 1, tzinfo=UTC)
LINES = "key string, ts string, id long, file string, offset long, length long"


def url_key(url: str | None) -> str:
    """Host labels in reverse order, then the path and query, all lower-cased: pages of a site sort together."""
    m = re.match(r"(?:[a-z][a-z0-9+.-]*:)?//(?:[^/@]*@)?([^/:?#]*)(?::(\d+))?([^#]*)", (url or "").lower())
    if not m:
        return (url or "").lower()
    host = m[1].removeprefix("www.")
    port = f":{m[2]}" if m[2] and m[2] not in ("80", "443") else ""
    return ",".join(reversed(host.split("."))) + port + ")" + (m[3] or "/")


def record(kind: str, ident: int | None, url: str | None, when: str, payload: bytes, digest: str, refers: int | None, full: int) -> bytes:
    """One record, uncompressed. A revisit has the HTTP header alone; its Content-Length is that of the payload it stands for."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {full}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:x-page:{'' if ident is None else ident}>", f"WARC-Date: {when}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:x-page:{refers}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    """(WARC header, HTTP header, payload) of a record."""
    head, rest = data.split(b"\r\n\r\n", 1)
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    if len(block) != int(fields["Content-Length"]) or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("a record is cut short")
    http, payload = block.split(b"\r\n\r\n", 1)
    return fields, dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:]), payload


class LoserTree:
    """Merges sorted iterators: the tree's inner nodes keep losers, so each row costs one way from a leaf to the root."""

    def __init__(self, sources: Iterable[Iterator[tuple]]):
        self.sources = list(sources)
        self.heads = [next(s, None) for s in self.sources]
        n = self.n = max(1, len(self.sources))
        self.losers = [-1] * n
        winners = [-1] * n + list(range(len(self.sources)))
        for node in range(n - 1, 0, -1):
            a, b = winners[2 * node], winners[2 * node + 1]
            winners[node], self.losers[node] = (a, b) if self._before(a, b) else (b, a)
        self.winner = winners[1] if n > 1 else 0

    def _before(self, a: int, b: int) -> bool:
        x, y = self.heads[a], self.heads[b]
        return y is None or (x is not None and (x, a) <= (y, b))

    def __iter__(self) -> Iterator[tuple]:
        while self.sources and (row := self.heads[w := self.winner]) is not None:
            yield row
            self.heads[w] = next(self.sources[w], None)
            node = (w + self.n) // 2
            while node:
                if self._before(self.losers[node], w):
                    self.losers[node], w = w, self.losers[node]
                node //= 2
            self.winner = w


MARK = "run long, ord long, file string, key string, offset long, length long"


def mark_rows(run: int, first: int, file: str, marks: list[tuple[str, int, int]]) -> pa.RecordBatch:
    """Rows of MARK; ord is their order in the run."""
    keys, offsets, lengths = zip(*marks, strict=True)
    cols = [run] * len(marks), range(first, first + len(marks)), [file] * len(marks), keys, offsets, lengths
    kinds = pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64()
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["run", "ord", "file", "key", "offset", "length"])


def _sort_key(ident: int | None) -> tuple[bool, int]:
    return (ident is not None, ident or 0)


def write_run(uri: str, lines: Iterable[tuple]) -> list[tuple[str, int, int]]:
    """Write sorted lines (key, ts, (has id, id), ...) in compressed parts; returns marks (a part's first line, offset, length), the last of them the last line's, of length 0."""
    marks, at, last = [], 0, None
    lines = iter(lines)

    def parts() -> Iterator[bytes]:
        nonlocal at, last
        while some := list(islice(lines, PART)):
            data = zlib.compress("\n".join(map(json.dumps, some)).encode(), 1)
            marks.append((json.dumps(some[0]), at, len(data)))
            at, last = at + len(data), some[-1]
            yield data

    write_whole(uri, parts())
    return [*marks, (json.dumps(last), at, 0)] if marks else []


def as_line(x: str) -> tuple:
    key, ts, ident, *rest = json.loads(x)
    return key, ts, tuple(ident), *rest


def read_parts(parts: Iterable[tuple[str, int, int]], lo: tuple | None, hi: tuple | None) -> Iterator[tuple]:
    """Lines with lo <= line < hi of parts (file, offset, length) in order; a part is opened, read and closed at a time. None: no bound."""
    for uri, offset, length in parts:
        fs, path = file_system(uri)
        with fs.open_input_file(path) as f:
            data = f.read_at(length, offset)
        for x in map(as_line, zlib.decompress(data).decode().split("\n")):
            if (lo is None or x >= lo) and (hi is None or x < hi):
                yield x


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url: str = "url", html: str = "html", ts: str | None = None, least_bytes: int = 0, level: int = 1) -> DataFrame:
    """Write pages as WARC files and capture runs under path; returns a row a mark of each run: (run, ord, file, key, offset, length).

    Equal payloads of least_bytes or more: the record of smallest id is a response, others are revisits of it. Where
    rows share that id as well, or have none, all without a smaller id to refer to are responses. Without a column ts a
    page was captured its id in seconds after EPOCH. Firsts are found over digests alone; where revisits are too many to
    be sent to all tasks, pages are shuffled once by id. A task's files are written whole under
    names that hold the attempt: one that runs beside another, over rows in another order, leaves the other's files alone,
    and marks name those of the attempt that counted.
    """
    body = F.coalesce(F.col(html), F.lit("")).cast("binary")
    when = F.date_format(F.col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'") if ts else F.lit(None).cast("string")
    rows = pages.select(F.col(id_col).cast("long").alias("id"), F.col(url).alias("url"), body.alias("body"), when.alias("ts"))
    sized = rows.select("id", F.sha1("body").alias("h"), F.length("body").alias("n")).where(F.col("n") >= least_bytes)
    firsts = stored(sized.groupBy("h", "n").agg(F.min("id").alias("first"), F.count("*").alias("m")).where("m > 1").select("h", "n", "first"), "first-payloads")
    later = stored(sized.join(firsts, ["h", "n"]).where("id > first").select("id", "h", "first").distinct(), "revisits")
    # Ids of revisits go to the pages, not payloads to the ids: sides of the join are told apart by size when it runs.
    marked = rows.withColumn("h", F.sha1("body")).join(later, ["id", "h"], "left").select("id", "url", "body", "ts", "first")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, attempt = TaskContext.get().partitionId(), TaskContext.get().taskAttemptId()
        name, run, lines = f"{path}/pages-{task:06d}-{attempt}.warc.gz", f"{path}/run-{task:06d}-{attempt}.idx", []

        def members() -> Iterator[bytes]:
            at = 0
            for b in batches:
                for ident, link, payload, at_time, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
                    at_time = at_time or (EPOCH + timedelta(seconds=(ident or 0) % 10**9)).strftime("%Y-%m-%dT%H:%M:%SZ")
                    data = gzip.compress(record("response" if first is None else "revisit", ident, link, at_time, payload, digest, first, len(payload)), level, mtime=0)
                    lines.append((url_key(link), re.sub(r"\D", "", at_time), _sort_key(ident), name, at, len(data)))
                    at += len(data)
                    yield data

        write_whole(name, members())
        if lines:
            lines.sort()
            yield mark_rows(task, 0, run, write_run(run, lines))

    return stored(marked.mapInArrow(write, MARK), "run-marks")


def ranges(marks: DataFrame, per_range: int = MARKS) -> DataFrame:
    """(into, range, lo, hi, run, ord, file, offset, length): the parts that reach into each range of the run that theirs are merged into.

    A range begins at every so many of the marks in order, so ranges are even whatever the keys are, a host's or a
    single URL's included. Marks are put in order by range partitioning; only each partition's number of ranges is
    summed up. A part reaches up to the range of its run's next mark.
    """
    spark = marks.sparkSession
    get = lambda i, kind="string": F.get_json_object("key", f"$[{i}]").cast(kind)
    order = F.struct(get(0).alias("a"), get(1).alias("b"), get("2][1", "long").alias("c"), get(3).alias("d"), get(4, "long").alias("e"))
    sized = marks.withColumns({"into": F.floor(F.col("run") / FAN_IN), "k": order})
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    placed = stored(sized.repartitionByRange(tasks, "into", "k").withColumn("pid", F.spark_partition_id()), "ordered-marks")
    at = F.row_number().over(Window.partitionBy("pid", "into").orderBy("k", "run", "ord")) - 1
    local = stored(placed.withColumn("at", at).withColumns({"local": F.floor(F.col("at") / per_range), "starts": F.col("at") % per_range == 0}).drop("k", "at"), "marks-by-range")
    counts = local.groupBy("into", "pid").agg((F.max("local") + 1).alias("n"))
    before = F.sum("n").over(Window.partitionBy("into").orderBy("pid").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("into", "pid", F.coalesce(before, F.lit(0)).alias("before"))  # a row a partition
    numbered = stored(local.join(counts, ["into", "pid"]).withColumn("range", F.col("local") + F.col("before")), "numbered-marks")
    lo = numbered.where("starts").select("into", "range", F.col("key").alias("lo"))
    bounds = lo.join(lo.select("into", (F.col("range") - 1).alias("range"), F.col("lo").alias("hi")), ["into", "range"], "left")
    bounds = bounds.withColumn("lo", F.when(F.col("range") > 0, F.col("lo")))
    upto = F.coalesce(F.lead("range").over(Window.partitionBy("run").orderBy("ord")), "range")
    reach = numbered.withColumn("upto", upto).where("length > 0")
    parts = reach.select("into", F.explode(F.sequence("range", "upto")).alias("range"), "run", "ord", "file", "offset", "length")
    return parts.join(bounds, ["into", "range"])


def merge_runs(marks: DataFrame, path: str | None = None, per_range: int = MARKS) -> DataFrame:
    """The global index: (segment, position, LINES) with rows in (segment, position) order sorted by key, timestamp, id.

    Runs are merged FAN_IN at a time, into runs of the next pass, and the last of them into rows; a line is read once a
    pass, but for parts at the ends of ranges. No marks: no rows.
    """
    path = path or new_path(marks.sparkSession, "merged")

    def merged(table: pa.Table) -> tuple[int, int, Iterator[tuple]]:
        into, number = table["into"][0].as_py(), table["range"][0].as_py()
        lo, hi = (x and as_line(x) for x in (table["lo"][0].as_py(), table["hi"][0].as_py()))
        runs: dict[int, list] = {}
        for r in sorted(table.select(["run", "ord", "file", "offset", "length"]).to_pylist(), key=lambda r: (r["run"], r["ord"])):
            runs.setdefault(r["run"], []).append((r["file"], r["offset"], r["length"]))
        return into, number, iter(LoserTree([read_parts(x, lo, hi) for _, x in sorted(runs.items())]))

    def dealt(marks: DataFrame) -> DataFrame:
        parts = stored(ranges(marks, per_range), "range-parts")
        n = max(1, parts.select("into", "range").distinct().count())
        return parts.repartition(min(n, 10_000), "into", "range").groupBy("into", "range")

    level = 0
    while (last := marks.agg(F.max("run")).first()[0] or 0) >= FAN_IN:
        level += 1
        folder = f"{path}/pass-{level}"

        def to_run(table: pa.Table) -> pa.Table:
            from pyspark import TaskContext

            into, number, lines = merged(table)
            name = f"{folder}/run-{into}-{number:09d}-{TaskContext.get().taskAttemptId()}.idx"
            found = write_run(name, lines)
            return pa.Table.from_batches([mark_rows(into, number << 32, name, found)] if found else [], mark_rows(0, 0, "", [("", 0, 0)]).schema)

        marks = stored(dealt(marks).applyInArrow(to_run, MARK), f"run-marks-{level}")

    def to_rows(table: pa.Table) -> pa.Table:
        _, number, lines = merged(table)
        rows = [(number, i, key, ts, ident[1] if ident[0] else None, *rest) for i, (key, ts, ident, *rest) in enumerate(lines)]
        cols = list(zip(*rows, strict=True)) or [[]] * 8
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], ["segment", "position", "key", "ts", "id", "file", "offset", "length"])

    return stored(dealt(marks).applyInArrow(to_rows, f"segment long, position long, {LINES}"), "index")


def read_archives(index: DataFrame, id_col: str = "page_id") -> DataFrame:
    """Read every indexed record back, in its archive's order: id, payload_bytes, payload_digest, record_type, refers_to, url, key, ts, segment, position.

    Responses' payloads are measured and digested again and must agree with their headers; revisits stand for the
    payload that their headers tell of. html is the payload of a response.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, f, out = None, None, []
        for b in batches:
            for r in b.to_pylist():
                if r["file"] != name:
                    fs, path = file_system(name := r["file"])
                    f = fs.open_input_file(path)
                f.seek(r["offset"])
                fields, http, payload = parse(gzip.decompress(f.read(r["length"])))
                digest, size = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(http["Content-Length"])
                if fields["WARC-Type"] == "response" and (size, digest) != (len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode()):
                    raise ValueError(f"{name}: the record at {r['offset']} does not agree with its header")
                number = lambda k: int(x) if (x := fields.get(k, "")[12:-1]) else None
                out.append((number("WARC-Record-ID"), size, digest, fields["WARC-Type"], number("WARC-Refers-To"), r["key"], r["ts"], r["segment"], r["position"]))
            cols = zip(*out, strict=True) if out else [[]] * 9
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, KINDS, strict=True)], NAMES)
            out = []

    KINDS = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64())
    NAMES = [id_col, "payload_bytes", "payload_digest", "record_type", "refers_to", "url_key", "ts", "segment", "position"]
    # An archive is cut where its offsets pass SLICE, so that one large file is read by several tasks; index rows say nothing of the bytes.
    tasks = int((index.agg(F.sum("length")).first()[0] or 0) / SLICE) + 1
    by = index.withColumn("slice", F.floor(F.col("offset") / SLICE)).repartition(tasks, "file", "slice").sortWithinPartitions("file", "offset")
    return by.select("file", "offset", "length", "key", "ts", "segment", "position").mapInArrow(read, f"{id_col} long, payload_bytes long, payload_digest string, record_type string, refers_to long, url_key string, ts string, segment long, position long")


def archive(pages: DataFrame, path: str | None = None, **how) -> DataFrame:
    """Write pages, merge the runs' index and read all records back; see the functions above.

    Every row of pages is a record: null html is an empty payload, a null URL has an empty key, null ids sort first and
    never are revisits; repeated rows are records each, ordered by their places in the archives. Payloads of any length
    are written whole. Other columns are not read. No pages: no rows.
    """
    return read_archives(merge_runs(write_archives(pages, path or new_path(pages.sparkSession, "warc"), **how)), how.get("id_col", "page_id"))

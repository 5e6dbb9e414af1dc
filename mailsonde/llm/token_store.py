"""Token ids in directly addressable codes: any id is read without decoding a block.

A file (a segment of consecutive documents) holds

    magic "DAC1" | levels u32 | bits u32 | docs u64 | ids u64
    doc_id i64[docs] | has_id u8[docs] | end u64[docs]       (end: ids up to and with this document's)
    for each level: count u64, chunks u8[count], bitmap u64[ceil(count/64)], rank u32[ceil(count/512) + 1]

all little-endian. Level 0 has the low `bits` bits of each id; its bitmap says which ids go on, and the i-th id that goes
on has its next chunk at the same rank in level 1, and so on. rank[j] counts the set bits before bit 512 j.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import _FOLD, broadcast_if_small, file_system, new_path, stored, write_whole

MAGIC, BITS, SPAN = b"DAC1", 8, 512


def encode_levels(ids: np.ndarray, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, bitmap, rank) of each level, for unsigned ids."""
    out, rest = [], ids.astype(np.uint32)
    while True:
        more = (rest >> bits) != 0
        chunks = (rest & ((1 << bits) - 1)).astype(np.uint8)
        flags = np.zeros(-(-len(rest) // 64) * 64, np.uint8)
        flags[: len(rest)] = more
        ones = np.add.reduceat(flags, np.arange(0, len(flags), SPAN), dtype=np.uint32) if len(flags) else np.zeros(0, np.uint32)
        rank = np.concatenate([np.zeros(1, np.uint32), np.cumsum(ones, dtype=np.uint32)])
        out.append((chunks, np.packbits(flags, bitorder="little").view("<u8"), rank))
        rest = rest[more] >> bits
        if not len(rest):
            return out


class Segment:
    """Reads one file's bytes."""

    def __init__(self, data: bytes):
        if data[:4] != MAGIC:
            raise ValueError("not a token segment")
        n_levels, self.bits, docs, self.n_ids = struct.unpack_from("<IIQQ", data, 4)
        at = 28

        def take(kind: str, n: int) -> np.ndarray:
            nonlocal at
            x = np.frombuffer(data, kind, n, at)
            at += x.nbytes
            return x

        self.doc_id, self.has_id, self.end = take("<i8", docs), take("u1", docs), take("<u8", docs)
        self.levels = []
        for _ in range(n_levels):
            (n,) = take("<u8", 1)
            self.levels.append((take("u1", int(n)), take("<u8", -(-int(n) // 64)), take("<u4", -(-int(n) // SPAN) + 1)))

    def __getitem__(self, i: int) -> int:
        """The i-th id, by one look at each of its levels."""
        if not 0 <= i < self.n_ids:
            raise IndexError(i)
        out, shift = 0, 0
        for chunks, bitmap, rank in self.levels:
            out |= int(chunks[i]) << shift
            word, bit = divmod(i, 64)
            if not int(bitmap[word]) >> bit & 1:
                return out
            first = i // SPAN * (SPAN // 64)
            ones = sum(int(x).bit_count() for x in bitmap[first:word]) + (int(bitmap[word]) & ((1 << bit) - 1)).bit_count()
            i, shift = int(rank[i // SPAN]) + ones, shift + self.bits
        raise ValueError("the last level goes on")

    def all(self) -> np.ndarray:
        """Every id, as u32."""
        out, pick = np.zeros(self.n_ids, "<u4"), None
        for k, (chunks, bitmap, _) in enumerate(self.levels):
            at = slice(None) if pick is None else pick
            out[at] |= chunks.astype("<u4") << np.uint32(k * self.bits)
            go = np.unpackbits(bitmap.view("u1"), count=len(chunks), bitorder="little").astype(bool)
            pick = np.flatnonzero(go) if pick is None else pick[go]
        return out


def segment_bytes(docs: list[tuple[int | None, bytes]], bits: int = BITS) -> Iterator[bytes]:
    """A file's parts, from (doc_id, ids as little-endian u32)."""
    ids = np.frombuffer(b"".join(x for _, x in docs), "<u4")
    levels = encode_levels(ids, bits)
    yield MAGIC + struct.pack("<IIQQ", len(levels), bits, len(docs), len(ids))
    yield np.array([d or 0 for d, _ in docs], "<i8").tobytes()
    yield np.array([d is not None for d, _ in docs], "u1").tobytes()
    yield np.cumsum([len(x) // 4 for _, x in docs], dtype="<u8").tobytes()
    for chunks, bitmap, rank in levels:
        yield struct.pack("<Q", len(chunks))
        yield chunks.tobytes()
        yield bitmap.tobytes()
        yield rank.tobytes()


#: Lower-case Latin letters, which the rules before the model leave whole, and marks after them, which they cut off.
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([!-/:-@\[-`{-~]*)")
#: The steps before the model under which all this holds, patterns and all; a vocabulary with any other gets whole texts.
_STEPS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)


class Encoder:
    """The tokenizer behind a memory of at most `room` pieces.

    The vocabulary's rules lower-case, and never join characters across a blank or a line break, so a text's ids are
    those of its pieces between these two; any other white space stays inside a piece and is left to the tokenizer.
    Plain words go to its model at once, other new pieces of many documents through all steps together. Pieces are
    lower-cased before, but for those that would hold a special token then: it is matched as it is written. A vocabulary
    with other steps gets whole texts.
    """

    def __init__(self, path: str, end: int | None, room: int = 600_000):  # about 0.12 GB
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tokenizer, self.room, self.known = Tokenizer.from_file(path), room, {b"": b""}
        self.end = b"" if end is None else struct.pack("<I", end)
        steps = json.loads(self.tokenizer.to_str())
        self.cuts = (steps["normalizer"], steps["pre_tokenizer"]) == _STEPS
        self.special = [x["content"].encode().translate(_FOLD) for x in steps["added_tokens"] if not x["normalized"]]
        # The model reads bytes under printable names, as its own step before gives them.
        self.names = {ord(c): ByteLevel(add_prefix_space=False, use_regex=False).pre_tokenize_str(c)[0][0] for c in map(chr, range(0xDF, 0x100)) if c != "÷"}

    def pieces(self, pieces: list[bytes]) -> list[bytes]:
        if len(self.known) > self.room:  # frequent pieces came early: the earlier half stays
            self.known = dict(islice(self.known.items(), self.room // 2))
        ids = list(map(self.known.get, pieces))
        if None in ids:
            gaps = [i for i, x in enumerate(ids) if x is None]
            new = list({pieces[i] for i in gaps})
            rest = []
            for p in new:
                m = _PLAIN.fullmatch(p) if self.cuts else None
                if m:
                    self.known[p] = self.plain(m[1]) + (self.known.get(m[2]) or self.whole(m[2]))
                else:
                    rest.append(p)
            coded = self.tokenizer.encode_batch_fast([p.decode() for p in rest], add_special_tokens=False)
            self.known.update((p, array("I", e.ids).tobytes()) for p, e in zip(rest, coded, strict=True))
            for i in gaps:
                ids[i] = self.known[pieces[i]]
        return ids

    def cut(self, text: bytes) -> list[bytes]:
        folded = (text := text.replace(b"\n", b" ")).translate(_FOLD)
        out = folded.split(b" ")
        if any(x in folded for x in self.special):
            out = [raw if any(x in p for x in self.special) else p for raw, p in zip(text.split(b" "), out, strict=True)]
        return out

    def plain(self, word: bytes) -> bytes:
        if (ids := self.known.get(word)) is None:
            found = self.tokenizer.model.tokenize(word.decode().translate(self.names))
            ids = self.known[word] = array("I", [t.id for t in found]).tobytes()
        return ids

    def whole(self, piece: bytes) -> bytes:
        ids = self.known[piece] = array("I", self.tokenizer.encode(piece.decode(), add_special_tokens=False).ids).tobytes()
        return ids

    def __call__(self, texts: Iterable[tuple[int | None, bytes | None]], many: int = 200_000) -> Iterator[tuple[int | None, bytes]]:
        """(id, ids as little-endian u32) of each (id, UTF-8 text)."""
        held, some = [], []
        for d, t in texts:
            mine = self.cut(t or b"") if self.cuts else [t or b""]
            held.append((d, len(mine)))
            some += mine
            if len(some) >= many:
                yield from self._cut(held, some)
                held, some = [], []
        yield from self._cut(held, some)

    def _cut(self, held: list[tuple[int | None, int]], some: list[bytes]) -> Iterator[tuple[int | None, bytes]]:
        ids = [x for a in range(0, len(some), 200_000) for x in self.pieces(some[a : a + 200_000])]
        at = 0
        for d, n in held:
            yield d, b"".join(ids[at : at + n]) + self.end
            at += n


@lru_cache(2)
def encoder(path: str, end: int | None) -> Encoder:
    """One for all tasks of a Python worker, so that its memory of pieces outlives a task."""
    return Encoder(path, end)


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def write_tokens(docs: DataFrame, path: str, vocabulary: str | None = None, end: int | None = 2, segment_ids: int = 2_000_000, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode every whole text and write segments in ascending doc_id order; returns a row a file: (file, docs, ids).

    Range partitioning by id alone (its samples go to the driver: ids, no texts) gives each task a run of doc_ids, sorted; a task cuts its run into segments of about segment_ids
    ids, never inside a document, named so that file names sort as their documents. A task's files are written whole
    under names that depend only on the task, so a task run again overwrites its own. Null ids come last; null texts
    are empty; repeated ids stay, ordered by text. An empty table writes nothing. Other columns are not read, so no name of
    theirs clashes.
    """
    vocabulary = vocabulary or default_vocabulary()

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, encode = TaskContext.get().partitionId(), encoder(vocabulary, end)
        coded = encode((d.as_py(), t.as_py()) for b in batches for d, t in zip(*b.columns, strict=True))  # a text at a time
        done, made = False, []
        while not done:
            part, size = [], 0
            for d, x in coded:
                part.append((d, x))
                if (size := size + len(x) // 4) >= segment_ids:
                    break
            else:
                done = True
            if part:
                name = f"{path}/part-{task:06d}-{len(made):06d}.dac"
                write_whole(name, segment_bytes(part))
                made.append((name, len(part), size))
        if made:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*made, strict=True)], ["file", "docs", "ids"])

    ordered = docs.select(F.col(id_col).alias("i"), F.col(text).cast("binary").alias("t")).repartitionByRange(F.asc_nulls_last("i")).sortWithinPartitions(F.asc_nulls_last("i"), F.asc("t"))
    return stored(ordered.mapInArrow(write, "file string, docs long, ids long"), "token-files")


def read_tokens(files: DataFrame) -> DataFrame:
    """Per document of the files (file, ids): doc_id, file, first (ids before it in the file), n_tokens, ids_crc32, first_id, last_id.

    first_id and last_id are read by random access, and checked against the full decoding.
    """

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name in b.column(0).to_pylist():
                fs, path = file_system(name)
                with fs.open_input_file(path) as f:
                    seg = Segment(f.read())
                ids, at, rows = seg.all(), 0, []
                raw = memoryview(ids.tobytes())
                for d, known, stop in zip(seg.doc_id.tolist(), seg.has_id.tolist(), seg.end.tolist(), strict=True):
                    ends = (seg[at], seg[stop - 1]) if stop > at else (None, None)
                    if stop > at and ends != (ids[at], ids[stop - 1]):
                        raise ValueError(f"{name}: random access and decoding differ at {at}")
                    rows.append((d if known else None, name, at, stop - at, zlib.crc32(raw[4 * at : 4 * stop]), *ends))
                    at = stop
                rest = iter(rows)
                while some := list(islice(rest, 10_000)):
                    cols = list(zip(*some, strict=True))
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), *[pa.int64()] * 5), strict=True)], ["doc_id", "file", "first", "n_tokens", "ids_crc32", "first_id", "last_id"])

    n = max(1, files.count())
    return files.select("file").repartition(n, "file").mapInArrow(read, "doc_id long, file string, first long, n_tokens long, ids_crc32 long, first_id long, last_id long")


def token_store(docs: DataFrame, path: str | None = None, vocabulary: str | None = None, **how) -> DataFrame:
    """Write docs and read the files back: doc_id, start, n_tokens, ids_crc32 and the rest of read_tokens().

    start is the sum of the ids in all earlier files (a running sum over one row a file) plus first.
    """
    files = write_tokens(docs, path or new_path(docs.sparkSession, "tokens"), vocabulary, **how)
    before = F.coalesce(F.sum("ids").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = files.select("file", before.alias("before"))
    # One row a file goes to every task, behind a check of their number; never the documents' rows.
    return read_tokens(files).join(broadcast_if_small(starts, files), "file").select("doc_id", (F.col("before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "first_id", "last_id")

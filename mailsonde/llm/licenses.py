"""License scan: exact phrases, and fuzzy search for short notices.

Fuzzy part: a notice that may hold k edits is cut into k + 1 pieces; whatever place matches it within k edits holds one
piece unchanged (pigeonhole). Exact finds of the pieces give candidate places, and there the regex library's
bounded-error matching decides and reports the span and the edits.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import words

#: Phrases that are counted exactly, with their labels.
BASE = {"gnu general public license": "gpl", "apache license": "apache", "cc by": "cc-by", "mit license": "mit"}


class Notice(NamedTuple):
    text: str  # normalised words, joined by one space
    label: str
    edits: int  # insertions, deletions and substitutions of characters that a match may hold


#: Short notices of public licences.
NOTICES = (
    Notice("licensed under the apache license version", "apache", 3),
    Notice("this work is licensed under the gnu general public license", "gpl", 5),
    Notice("gnu lesser general public license", "lgpl", 3),
    Notice("gnu affero general public license", "agpl", 3),
    Notice("this program is free software you can redistribute it and or modify it", "gpl", 5),
    Notice("released under the mit license", "mit", 2),
    Notice("permission is hereby granted free of charge to any person obtaining a copy", "mit", 5),
    Notice("redistribution and use in source and binary forms with or without modification", "bsd", 5),
    Notice("mozilla public license", "mpl", 2),
    Notice("licensed under cc by", "cc-by", 1),
    Notice("creative commons attribution", "cc-by", 2),
    Notice("this is free and unencumbered software released into the public domain", "unlicense", 5),
)

#: Windows whose best match a worker remembers, of each notice.
ROOM = 20_000
SPANS = "array<struct<label:string,start:int,stop:int,edits:int>>"
SCHEMA = f"n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans {SPANS}"


def _pieces(text: bytes, k: int) -> list[tuple[int, bytes]]:
    cuts = [len(text) * i // (k + 1) for i in range(k + 2)]
    return [(a, text[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)]


class Scanner:
    """Compiled notices; one per Python worker."""

    def __init__(self, base=BASE, notices=NOTICES):
        import regex

        self.base = [(f" {p} ".encode(), label) for p, label in base.items()]
        self.notices = []
        for n in notices:
            raw = n.text.encode()
            rule = regex.compile(b"(?b)(?:%s){e<=%d}" % (regex.escape(raw), n.edits))
            self.notices.append((n, raw, _pieces(raw, n.edits), rule))
        self.known: list[dict] = [{} for _ in self.notices]

    def best(self, k: int, window: bytes) -> tuple[int, int, int] | None:
        """(start, stop, edits) of notice k's best match in a window of bounded length; remembered up to a bound."""
        known = self.known[k]
        if window not in known:
            if len(known) >= ROOM:
                known.clear()
            m = self.notices[k][3].search(window)
            known[window] = m and (m.start(), m.end(), sum(m.fuzzy_counts))
        return known[window]

    def fuzzy(self, text: bytes) -> list[tuple[str, int, int, int, int]]:
        """(label, start, stop, edits, length) in the normalised text; of matches of one notice that overlap, that of fewest edits, then the first."""
        found = []
        for k, (n, raw, pieces, _) in enumerate(self.notices):
            starts = set()
            for at, piece in pieces:
                i = text.find(piece)
                while i >= 0:
                    starts.add(i - at)
                    i = text.find(piece, i + 1)
            # Any match around an unchanged piece lies in that piece's window.
            matches = set()
            for i in starts:
                a = max(0, i - n.edits)
                if m := self.best(k, text[a : max(0, i + len(raw) + n.edits)]):
                    matches.add((m[2], a + m[0], a + m[1]))
            kept: list[tuple[int, int, int]] = []
            for edits, a, b in sorted(matches):
                at = bisect_left(kept, (a,))
                if (at == 0 or kept[at - 1][1] <= a) and (at == len(kept) or kept[at][0] >= b):
                    kept.insert(at, (a, b, edits))
            found += [(n.label, a, b, edits, len(raw)) for a, b, edits in kept]
        return sorted(found, key=lambda x: (x[1], x[2], x[0]))

    def scan(self, data: bytes | None):
        ws = words(data)
        text = b" " + b" ".join(ws) + b" "
        starts, labels, n_base = [], set(), 0
        for phrase, label in self.base:
            i, first, last = text.find(phrase), -1, -1
            while i >= 0:
                first, last, n_base = (i if first < 0 else first), i, n_base + 1
                labels.add(label)
                i = text.find(phrase, i + 1)
            if first >= 0:
                starts += [text.count(b" ", 0, first), text.count(b" ", 0, last)]
        spans = self.fuzzy(text) if len(ws) > 1 else []
        score = 1.0 if labels else max((1 - e / n for _, _, _, e, n in spans), default=0.0)
        return (
            len(ws), n_base, min(starts, default=None), max(starts, default=None),
            ",".join(sorted(labels)), ",".join(sorted(labels | {x[0] for x in spans})), score,
            [dict(zip(("label", "start", "stop", "edits"), x, strict=False)) for x in spans],
        )


def scan_licenses(docs: DataFrame, text: str = "text", base=None, notices=NOTICES) -> DataFrame:
    """docs with a struct column `license` (SCHEMA): counts and word places of base phrases, labels, score and fuzzy spans.

    Spans are byte offsets in the normalised text (lower-cased words joined and framed by one space). Every row is
    kept; null and empty texts have no words, no labels, score 0; an empty table gives no rows. Texts of any length are
    scanned whole, in time that grows with their length; of overlapping matches of one notice as good as each other the
    first stays; repeated rows each get the same answer. A column `license` is replaced, others are left alone. No
    shuffle.
    """
    base = dict(base or BASE)

    @F.pandas_udf(SCHEMA)
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        s = Scanner(base, notices)
        for x in batches:
            yield pd.DataFrame([s.scan(t) for t in x], columns=["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]).astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.withColumn("license", scan(F.col(text).cast("binary")))

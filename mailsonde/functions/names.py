"""Host names and addresses in one canonical form, so that comparisons are equalities of text.

Names: mapped as lookups map them (full-width dots, compatibility forms and case folded), label by label in ASCII, with
bootstring code for labels beyond it. Addresses: as RFC 5952 writes them. Both run on the distinct values of an Arrow batch.
"""

from __future__ import annotations

import ipaddress
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

DOTS = re.compile("[.。．｡]")
#: Joiners and variation marks that mapping deletes; the sharp s and final sigma stay letters of their own.
DELETED = re.compile("[­​⁠﻿︀-️]")
KEPT = {"ß", "ς", "‌", "‍"}
PLAIN = re.compile(r"[a-z0-9_*-]+")
LONGEST_LABEL, LONGEST_NAME = 63, 253


def canonical_label(label: str) -> str | None:
    """One label in ASCII; None if it is none."""
    folded = "".join(c if c in KEPT else unicodedata.normalize("NFKC", c).casefold() for c in DELETED.sub("", label))
    folded = unicodedata.normalize("NFC", folded)
    if folded.startswith("xn--") and folded.isascii():
        try:  # what a coded label stands for must code back to it
            told = folded[4:].encode().decode("punycode")
            return folded if not told.isascii() and "xn--" + told.encode("punycode").decode() == folded and len(folded) <= LONGEST_LABEL else None
        except (UnicodeError, ValueError, OverflowError):
            return None
    if folded.isascii():
        return folded if PLAIN.fullmatch(folded) and len(folded) <= LONGEST_LABEL else None
    if any(unicodedata.category(c)[0] not in "LNM" and c not in "-·‌‍" for c in folded):
        return None
    coded = "xn--" + folded.encode("punycode").decode()
    return coded if len(coded) <= LONGEST_LABEL else None


def canonical_name(text: str | None) -> str | None:
    """The name without a final dot; None for what is no name, empty ones and addresses included."""
    if text is None or not (text := text.strip()) or canonical_address(text):
        return None
    labels = DOTS.split(text)
    if labels[-1] == "":
        labels = labels[:-1]
    found = [canonical_label(x) for x in labels]
    out = None if not found or None in found else ".".join(found)
    return out if out and len(out) <= LONGEST_NAME else None


def canonical_address(text: str | None) -> str | None:
    """An IPv4 or IPv6 address as text; brackets go, zones stay; None for anything else, octal-looking octets included."""
    if text is None:
        return None
    try:
        return str(ipaddress.ip_address(text.strip().removeprefix("[").removesuffix("]")))
    except ValueError:
        return None


def _mapped(f):
    @F.pandas_udf("string")
    def run(x: pd.Series) -> pd.Series:
        known = {v: f(v) for v in x.dropna().unique()}
        return x.map(known).astype(object).where(x.notna(), None)

    return run


def canonical_names(text: Column) -> Column:
    """canonical_name of a column; null where that is None."""
    return _mapped(canonical_name)(text)


def canonical_addresses(text: Column) -> Column:
    return _mapped(canonical_address)(text)


def canonical_hosts(text: Column) -> Column:
    """Names and addresses in their canonical forms; what is neither stays as it is, so that nothing is lost."""
    return _mapped(lambda v: canonical_address(v) or canonical_name(v) or v)(text)

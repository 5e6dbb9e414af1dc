"""Main text of HTML pages by two-pass block rules.

Pass 1 splits a page into blocks and classifies each by link density, length and stop-word density; what the markup says
of its surroundings is one more feature, which decides for menus, footers and the like, and lowers the stop words that a
block inside an article needs. Pass 2 gives blocks that stay undecided (short ones, and middling ones) the label of the
nearest decided neighbours in the same part of the page: the one before if both are as near.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Frequent function words of English, French, German and Spanish.
STOP_WORDS = frozenset(
    """a about after all also an and are as at be been but by can for from had has have he her his i if in into is it its more not of on
    one or our she so than that the their them then there these they this to up was we were what when which who will with would you your
    au aux avec ce ces cette comme dans de des du elle en est et il ils la le les leur mais ne nous on ou par pas pour plus qu que qui sa
    sans se ses son sont sur un une vous
    als am auch auf aus bei bin bis das dass dem den der des die durch ein eine einem einen einer er es für hat ich im ist kann man mit
    nach nicht noch nur oder sein sich sie sind so über um und unter vom von vor war was wie wird zu zum zur
    al como con cuando del desde donde el ella ellos entre era esta este esto ha hay la las lo los más muy no o para pero por porque que
    se ser si sin sobre su sus también un una y ya""".split()
)
#: Elements whose text is never shown as main text.
HIDDEN = frozenset("script style noscript template svg math canvas iframe object audio video select textarea button datalist head title".split())
RAW = frozenset("script style textarea title noscript iframe".split())
BOILER = frozenset("nav header footer aside form menu dialog fieldset".split())
#: Those of them that may also wrap a whole page.
SOFT = frozenset("form header fieldset".split())
BLOCKS = frozenset(
    """address article aside blockquote body button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form
    h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre section select summary table tbody td textarea
    tfoot th thead title tr ul""".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Words in class, id and role that name other parts of a page.
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert\w*|sponsor\w*|promo\w*|banner\w*|nav|navbar|navigation|menu\w*|breadcrumbs?|sidebar\w*|side|widget\w*|"
    r"footer|header|masthead|cookie\w*|consent|notice|gdpr|popup|modal|overlay|newsletter|subscribe|signup|login|comments?|"
    r"comment-?list|replies|reply|disqus|share|sharing|social|related|recommended|pagination|pager|toolbar|search|copyright|legal|"
    r"contentinfo|complementary|search|alertdialog)(?:$|[\s_-])"
)
#: Names of page layouts and of an article's own parts, not of other parts; names that make even an article another part.
LAYOUT = re.compile(r"\b(?:with|has|no|without)[-_]\w+|\b(?:post|article|entry|story|content|section)[-_](?:header|title|notice|banner|legal|side)\b")
OTHERS = re.compile(r"(?:^|[\s_-])(?:comments?|replies|reply|related|recommended|ad|ads|advert\w*|sponsor\w*|promo\w*)(?:$|[\s_-])")
#: Words of NAMED that an article's own parts may bear.
OWN = re.compile(r"(?:^|(?<=[\s_-]))(?:header|notice|side|search|legal|copyright|banner\w*|overlay|login|signup)(?=$|[\s_-])")
NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)")
#: What ends a tag, or begins a quoted value, inside which nothing does.
TAG_STEP = re.compile(r"""=\s*(["'])|>""")
ATTR = re.compile(r"""(?:^|\s)(class|id|role|hidden|aria-hidden|style)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
WHITE = re.compile(r"\s+")
WORD = re.compile(r"\w+")


class Rules(NamedTuple):
    """Thresholds of pass 1; lengths are in characters, densities are shares of characters and of words."""

    max_link: float = 0.35
    short: int = 70
    long: int = 100
    stop_low: float = 0.12
    stop_high: float = 0.25
    list_away: int = 50  # how much farther away lists of links inside an article seem to its short blocks


class Block(NamedTuple):
    text: str
    linked: int = 0  # characters inside links
    boiler: bool = False  # markup says it is another part of the page
    article: bool = False  # inside article or main
    title: bool = False  # a heading
    listed: bool = False  # in a list or a table
    part: int = 0  # number of the innermost article, menu, footer and so on


def tokens(page: str) -> Iterator[tuple[str, str, bool, str]]:
    """(text, "", ..) and ("", tag, closing, attributes) in order, in time that grows with the page's length; comments and declarations go."""
    at, last, gone = 0, page.rfind(">"), set()

    def tag_end(at: int) -> int:
        """Where the tag's > is: not one inside quotes. A quote that is never closed is none; after one of a kind, no other of it is looked for."""
        while m := TAG_STEP.search(page, at):
            if not m[1]:
                return m.start()
            close = -1 if m[1] in gone else page.find(m[1], m.end())
            if close < 0:
                gone.add(m[1])
            at = m.end() if close < 0 else close + 1
        return last  # the page ends inside quotes

    while at < len(page):
        lt = page.find("<", at)
        if lt < 0 or lt > last:
            yield page[at:], "", False, ""
            return
        if lt > at:
            yield page[at:lt], "", False, ""
        if page.startswith("<!--", lt):
            end = page.find("-->", lt + 4)
            at = end + 3 if end >= 0 else len(page)
        elif page[lt + 1] in "!?":
            at = page.find(">", lt) + 1
        elif m := NAME.match(page, lt):
            end = max(tag_end(m.end()), m.end())
            tag, close = m[2].lower(), bool(m[1])
            yield "", tag, close, page[m.end() : end]
            at = end + 1
            if tag in RAW and not close and page[end - 1] != "/":
                stop = re.compile(f"</{tag}(?=[\\s/>])", re.I).search(page, at)
                at = stop.start() if stop else len(page)
        else:
            yield "<", "", False, ""
            at = lt + 1


class Open(NamedTuple):
    """An open element, and what holds inside it."""

    tag: str = ""
    hidden: bool = False
    boiler: int = 0  # 2: another part; 1: one if it wraps no article
    article: bool = False
    listed: bool = False
    part: int = 0


def split_blocks(page: str) -> list[Block]:
    """The page's visible blocks in order. Markup that is left open or crossed is taken as browsers do: roughly."""
    out: list[Block] = []
    stack, opened, parts = [Open()], Counter(), 0
    buf: list[str] = []
    linked, links, heading = 0, 0, False

    def flush() -> None:
        nonlocal linked
        if buf:
            text = WHITE.sub(" ", html.unescape("".join(buf))).strip()
            if text:
                x = stack[-1]
                out.append(Block(text, min(linked, len(text)), x.boiler > 0, x.article, heading, x.listed, x.part))
            buf.clear()
        linked = 0

    for text, tag, close, attrs in tokens(page):
        if not tag:
            if not stack[-1].hidden:
                buf.append(text)
                if links:
                    linked += len(text)
            continue
        if tag in BLOCKS:
            flush()
            heading = not close and len(tag) == 2 and tag[0] == "h" and tag != "hr"
        elif tag == "br":
            buf.append("\n")
        if tag == "a":
            links = max(0, links - 1) if close else links + 1
            continue
        if close:
            if opened[tag]:
                i = len(stack) - 1
                while stack[i].tag != tag and (tag in BLOCKS or stack[i].tag not in BLOCKS):
                    i -= 1
                if stack[i].tag == tag:
                    opened.subtract(x.tag for x in stack[i:])
                    del stack[i:]
            continue
        if tag in VOID:
            continue
        own = {k.lower(): v.strip("\"'").lower() for k, v in ATTR.findall(attrs)} if attrs.strip(" /") else {}
        hidden = tag in HIDDEN or "hidden" in own or own.get("aria-hidden") == "true" or "display:none" in own.get("style", "").replace(" ", "")
        if tag == "p" and stack[-1].tag == "p":  # a new paragraph ends the one before
            opened["p"] -= 1
            stack.pop()
        up, main = stack[-1], tag in ("article", "main")
        names = LAYOUT.sub("", " ".join(own.get(k, "") for k in ("class", "id", "role")))
        if up.article:
            names = OWN.sub("", names)
        named = bool(names.strip() and tag not in ("html", "body") and (OTHERS if main else NAMED).search(names))
        soft = tag in SOFT and not (up.article and tag == "header")
        boiler = 2 if named or (tag in BOILER and tag not in SOFT) else int(soft)
        kept = 0 if main and up.boiler == 1 else up.boiler  # some sites wrap the whole page in a form or header
        if tag in BLOCKS or tag in HIDDEN or hidden or boiler:
            if main or boiler > kept:
                parts += 1
            stack.append(Open(tag, up.hidden or hidden, max(kept, boiler), up.article or main, up.listed or tag in ("li", "td", "dd"), parts if main or boiler > kept else up.part))
            opened[tag] += 1
    flush()
    return out


def first_pass(b: Block, rules: Rules = Rules()) -> int:
    """1: main text, -1: not, 0: undecided."""
    n = len(b.text)
    if b.boiler:
        return -1
    if b.linked > rules.max_link * n:  # a paragraph of an article may be one link; an item of a list is in a list of links
        return 0 if b.article and not b.listed else -1
    if n < rules.short or b.title:
        return 0
    ws = WORD.findall(b.text.lower())
    stop = sum(w in STOP_WORDS for w in ws) / max(1, len(ws))
    if stop >= (rules.stop_low if b.article else rules.stop_high):
        return 1 if n >= rules.long else 0
    return 0 if b.article or stop >= rules.stop_low else -1


def classify(blocks: list[Block], rules: Rules = Rules()) -> list[bool]:
    """Which blocks are main text: pass 1, then pass 2.

    A page without any decided text (its language has no stop words here) is told by length and links alone. A part of
    the page without any decided text of its own asks the whole page, but an article's short blocks then stay: what
    is marked as one may consist of them. A heading belongs to the text below it.
    """
    first = [first_pass(b, rules) for b in blocks]
    if 1 not in first:
        first = [1 if not b.boiler and not b.title and len(b.text) >= rules.long and b.linked <= rules.max_link * len(b.text) else x for b, x in zip(blocks, first, strict=True)]
    has_text = {b.part for b, x in zip(blocks, first, strict=True) if x == 1}
    far = 2 * len(blocks) + 2 * rules.list_away + 2

    def nearest(order) -> list[tuple[int, int]]:
        """(distance, label) of the decided block nearest in this order: in the same part if that has text, else anywhere."""
        out, seen, any_seen = [(far, -1)] * len(blocks), {}, None
        for step, i in enumerate(order):
            b = blocks[i]
            if first[i]:
                away = rules.list_away if first[i] < 0 and b.article and not b.boiler else 0
                here = (step - away, first[i])
                old = seen.get(b.part)
                seen[b.part] = here if old is None or here[0] >= old[0] else old
                any_seen = here if any_seen is None or here[0] >= any_seen[0] else any_seen
            near = seen.get(b.part) if b.part in has_text else any_seen
            if near:
                out[i] = (step - near[0], near[1])
        return out

    n = len(blocks)
    before, after = nearest(range(n)), nearest(range(n - 1, -1, -1))
    out = []
    for i, x in enumerate(first):
        if x == 0:
            (p, a), (q, b) = before[i], after[i]
            x = a if p <= q else b
            if (blocks[i].title and b == 1) or (blocks[i].article and blocks[i].part not in has_text):
                x = 1
        out.append(x == 1)
    return out


def main_text(page: str | None, rules: Rules = Rules()) -> str:
    if not page:
        return ""
    blocks = split_blocks(page)
    return "\n".join(b.text for b, good in zip(blocks, classify(blocks, rules), strict=True) if good)


def extract_text(pages: DataFrame, html_col: str = "html", out: str = "main_text", rules: Rules = Rules()) -> DataFrame:
    """pages with a string column of the main text; every row stays.

    Null and empty pages, and pages without any main text, give an empty string; an empty table gives no rows. Pages of
    any length are read whole, one at a time, in time that grows with their length; ties of pass 2 go to the block
    before; repeated rows give equal answers. A column named `out` is replaced, others are left alone. No shuffle.
    """

    @F.pandas_udf("string")
    def extract(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series([main_text(t, rules) for t in x], dtype=object)

    return pages.withColumn(out, extract(F.col(html_col)))

"""HTML extraction by line-block distribution.

Markup is stripped to lines: every tag of a block element ends one, so that
structure leaves empty lines, as source lines of pure markup do. Elements that
never hold main text (menus, headers, footers, sidebars, notices, adverts,
forms, scripts, comments) are taken out first and leave one empty line.

The text lengths of a sliding window of lines are summed. Where the sum rises
from nothing is a foot; the text begins at the foot of the first surge, a rise
to the page's own mean of such sums (or into its marked article), and ends
where the last surge dives to nothing. Everything between is kept, lists of
links too. What lies before or after and never surges is kept as well, however
far off (headings, last lines), unless all of it is links or a line of
copyright; before and after the lines of prose, outside an article, lists and
runs of lines that are mostly links are menus, and go.

Defined cases: null and empty pages have empty text, and so have pages of
noise alone; unclosed and crossed tags are closed by the next tag that ends
them, an open ``head`` by the first tag that cannot stand in it; a page cut
within a tag or script loses that piece only; pages of any length are read
whole, in time that grows with their length; equal stretches all stay; repeated
rows give equal rows; null ids and addresses pass through; an empty table gives
no rows; only the named columns are read, so others cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cadenza.llm.common import map_arrow

#: Comments and declarations; tags (end, name, attributes); text. Every alternative matches in one pass from where it begins.
_PIECE = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attributes>(?:=\s*(?:\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))|[^>])*+)(?:>|\Z)"
    r"|(?P<text>[^<]+|<)",
    re.S,
)
#: Fixed values of HTML: elements that part blocks, that part words only, that have no content, whose content is no markup, and what may stand in a head.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul caption".split())
SPACES = frozenset("br td th wbr option".split())
LISTS = frozenset("ul ol dl dir".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = {tag: re.compile(rf"</{tag}(?=[\s/>])[^>]*(?:>|\Z)", re.I) for tag in "script style noscript template svg iframe textarea title".split()}
IN_HEAD = frozenset("head base link meta title script style noscript template".split())
#: Elements that hold no main text, and words of class, id and role that say so.
NOISE = frozenset("head nav aside footer form button select menu dialog".split())
NOISE_WORDS = frozenset(
    "ad ads advert adverts advertisement advertisements advertising sponsor sponsored banner promo promotion cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe subscription signup "
    "nav navbar navigation menu menubar breadcrumb breadcrumbs pagination pager toc header masthead topbar footer bottombar sidebar aside widget widgets related recommended share sharing social "
    "comment comments commentlist disqus reply replies respond login search skip contentinfo complementary".split()
)
#: Words at the end of a name that say how or where an element lies, not what it holds; words that deny what they go with; and what has headers of its own.
PLACES = frozenset("area bar block body box card col column container content feed group inner item items layer left link links list outer panel region right row section slot thread unit widget wrap wrapper zone".split())
DENIED = frozenset("no not non has have with without hide free".split())
TITLED = frozenset("article chapter content entry post section story text".split())
_ATTRIBUTE = re.compile(r"""(?<![\w-])(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_NAME = re.compile(r"[A-Z]?[^\W\d_A-Z]+|[A-Z]+(?![^\W\d_A-Z])")
CONTENT = frozenset(("article", "main"))
#: Words that mark a page's header, which within an article belongs to the text.
HEADER = frozenset(("header", "masthead", "banner"))
_RIGHTS = re.compile(r"\s*(?:©|\(c\)|copyright\b|all rights\b)", re.I)


def _is_noise_name(words: list[str], in_content: bool) -> bool:
    """Whether the words of a name, as ``post-comments`` or ``advertBox``, begin or end with one of noise."""
    if not words or words[0] in DENIED or words[-1] in DENIED:
        return False
    end = len(words)
    while end > 1 and words[end - 1] in PLACES:
        end -= 1
    ends = {words[0], words[end - 1]}
    if ends & HEADER and (in_content or (words[0] in TITLED and words[end - 1] in HEADER)):
        return False
    return not NOISE_WORDS.isdisjoint(ends)


def _marks_noise(attributes: str, in_content: bool) -> bool:
    """Whether a name in class, id or role is one of noise."""
    return any(_is_noise_name([w.lower() for w in _NAME.findall(name)], in_content) for value in _ATTRIBUTE.findall(attributes) for name in value.strip("\"'").split())


class _Suspect:
    """An element that is noise by its class, id or role, or a form, unless it turns out to hold what the page is about."""

    def __init__(self, outer: _Suspect | None) -> None:
        self.outer, self.chars, self.holds, self.dropped = outer, 0, False, False


class _Page:
    """Lines of a page, tag by tag."""

    def __init__(self) -> None:
        self.out: list[tuple[str, int, bool, int, _Suspect | None]] = []
        self.stack: list[tuple[str, bool, _Suspect | None]] = []
        self.open: Counter[str] = Counter()
        self.noise = self.content = self.link = self.lists = self.number = self.linked = self.total = 0
        self.suspect: _Suspect | None = None
        self.suspects: list[_Suspect] = []
        self.words: list[str] = []

    def line(self) -> None:
        text = " ".join("".join(self.words).split())
        self.out.append((text, self.linked, self.content > 0, self.number if self.lists else 0, self.suspect))
        self.total += len(text)
        if self.suspect:
            self.suspect.chars += len(text)
        self.words.clear()
        self.linked = 0

    def text(self, text: str) -> None:
        if not self.noise:
            text = unescape(text)
            self.words.append(text)
            if self.link:
                self.linked += len("".join(text.split()))

    def pop(self) -> None:
        name, was_noise, was = self.stack.pop()
        self.open[name] -= 1
        if was:
            self.line()
            self.suspect = was.outer
        self.noise -= was_noise
        self.content -= name in CONTENT
        self.link -= name == "a"
        self.lists -= name in LISTS

    def tag(self, tag: str, end: bool, attributes: str) -> None:
        if self.open["head"] and not end and tag not in IN_HEAD:
            while self.open["head"]:
                self.pop()
        if not self.noise:
            if tag in BLOCKS:
                self.line()
            elif tag in SPACES:
                self.words.append(" ")
        if end:
            if self.open[tag]:
                while self.stack[-1][0] != tag:
                    self.pop()
                self.pop()
            return
        if tag in VOID or attributes.endswith("/"):
            return
        if tag in BLOCKS and self.stack and self.stack[-1][0] == "p":
            self.pop()
        is_noise = (tag in NOISE and tag != "form") or (tag == "header" and not self.content)
        marked = not self.noise and not is_noise and tag not in ("body", "html") and bool(attributes) and _marks_noise(attributes, self.content > 0)
        own = None
        if not self.noise and not is_noise:
            if tag in CONTENT:
                if self.suspect and not marked:
                    self.suspect.holds = True
            elif marked or tag == "form":
                self.line()
                own = self.suspect = _Suspect(self.suspect)
                self.suspects.append(own)
        self.stack.append((tag, is_noise, own))
        self.open[tag] += 1
        self.noise += is_noise
        self.content += tag in CONTENT
        self.link += tag == "a"
        if tag in LISTS:
            self.number += not self.lists
            self.lists += 1

    def lines(self) -> list[tuple[str, int, bool, int]]:
        self.line()
        for own in reversed(self.suspects):
            if own.outer:
                own.outer.chars += own.chars
                own.outer.holds |= own.holds
        marked = any(inside and text and (not within or within.holds) for text, _, inside, _, within in self.out)
        for own in self.suspects:
            own.dropped = (own.outer is not None and own.outer.dropped) or not (own.holds or (not marked and 4 * own.chars > 3 * self.total))
        lines = [tuple(line) for *line, _ in self.out]
        return _taken_out(lines, [bool(within and within.dropped) for *_, within in self.out])


def _taken_out(lines: list[tuple[str, int, bool, int]], gone: list[bool]) -> list[tuple[str, int, bool, int]]:
    """lines without those that are gone; one empty line stands for a stretch of these and the empty ones around it."""
    kept: list[tuple[str, int, bool, int]] = []
    hole = False
    for line, out in zip(lines, gone):
        if out and not hole:
            while kept and not kept[-1][0]:
                kept.pop()
            kept.append(("", 0, False, 0))
            hole = True
        elif not out and (line[0] or not hole):
            kept.append(line)
            hole = False
    return kept


def lines_of(html: str) -> list[tuple[str, int, bool, int]]:
    """``(text, characters in links, within an article, number of the list or 0)`` of each line.

    An element that holds an article, or over three quarters of the text of a page without one, is no noise but by its tag.
    """
    page, at = _Page(), 0
    while piece := _PIECE.match(html, at):
        at = piece.end()
        if (text := piece["text"]) is not None:
            page.text(text)
        elif piece["tag"] is not None:
            tag = piece["tag"].lower()
            if tag in RAW and not piece["end"]:
                if not (tag == "svg" and piece["attributes"].endswith("/")):
                    close = RAW[tag].search(html, at)
                    at = close.end() if close else len(html)
            else:
                page.tag(tag, bool(piece["end"]), piece["attributes"])
    return page.lines()


def _window_sums(length: np.ndarray, window: int) -> np.ndarray:
    """The sum of the window that ends at each line, and of those that end after the last."""
    return np.convolve(length, np.ones(window, int))


def _menus(lines: list[tuple[str, int, bool, int]], window: int, least: int = 3) -> list[bool]:
    """Of each line, whether it is part of a menu: outside articles, a list or a run of ``least`` lines or more that is mostly links.

    Between lines of prose none is; after them a list needs ``least`` items, before them two.
    """
    prose = np.array([len(text) if 2 * linked <= len(text) else 0 for text, linked, *_ in lines])
    sums = _window_sums(prose, window)
    reached = np.flatnonzero(sums >= sums[sums > 0].mean()) if prose.any() else []
    high = [i for end in reached for i in range(max(0, end - window + 1), min(end + 1, len(lines))) if prose[i]]
    first, last = (min(high), max(high)) if high else (len(lines), len(lines))
    lists: dict[int, list[int]] = {}
    runs: list[list[int]] = [[]]
    for i, (text, linked, inside, number) in enumerate(lines):
        if not text or first <= i <= last:
            continue
        if number and not inside:
            lists.setdefault(number, []).append(i)
        if not number and not inside and 2 * linked > len(text):
            runs[-1].append(i)
        elif runs[-1]:
            runs.append([])
    out = [False] * len(lines)
    for items in lists.values():
        linked, chars = (sum(v) for v in zip(*((lines[i][1], len(lines[i][0])) for i in items)))
        if 2 * linked > chars and len(items) >= (2 if items[0] < first else least):
            runs.append(items)
        else:
            runs.append([])
    for run in runs:
        if len(run) >= least or (run and lines[run[0]][3]):
            for i in run:
                out[i] = True
    return out


def main_text(html: str | None, window: int = 3) -> str:
    """The text between surge and dive points."""
    lines = lines_of(html or "")
    lines = _taken_out(lines, _menus(lines, window)) if lines else lines
    length = np.array([len(text) for text, *_ in lines])
    if not length.any():
        return ""
    sums = _window_sums(length, window)
    edge = np.diff(np.concatenate([[0], (sums > 0).astype(np.int8), [0]]))
    feet, dives = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - window + 1
    surge = sums[sums > 0].mean()
    inside = np.array([within and n > 0 for (_, _, within, _), n in zip(lines, length.tolist())])
    high = [sums[a : b + window - 1].max() >= surge or inside[a:b].any() for a, b in zip(feet, dives)]
    first, last = high.index(True), len(high) - 1 - high[::-1].index(True)
    kept: list[str] = []
    for n, (a, b) in enumerate(zip(feet, dives)):
        stretch = [line for line in lines[a:b] if line[0]]
        if first <= n <= last or not all(2 * linked > len(text) or _RIGHTS.match(text) for text, linked, *_ in stretch):
            kept += (text for text, *_ in stretch)
    return "\n\n".join(kept)


def extract(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """``page_id, url, text, n_chars`` of every page."""
    rows = pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html"))

    def make():
        def each(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts = [main_text(h) for h in batch.column("html").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=["page_id", "url", "text", "n_chars"])

        return each

    return map_arrow(rows, make, rows.select("page_id", "url", F.lit("").alias("text"), F.lit(0).cast("long").alias("n_chars")).schema, rows=500)

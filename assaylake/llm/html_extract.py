"""Main text of web pages: parser events, text-to-tag ratios, Gaussian smoothing and threshold clustering.

The standard library's parser streams events. Text between the tags that begin or end a block is a line; its ratio is
its text's length by the number of tags in and around it. Lines inside what can't be content (menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles, comments) have the ratio 0. What only its class, id or role or a form
tells to be no content is content all the same where it holds a marked article or most of the page's ratio mass. Ratios are smoothed with a Gaussian, and
lines over a share of the spread are clusters. Where a page marks articles, its content is those marked elements that
clusters are in, whole; else it runs over the heaviest region of clusters, the regions beside it, and the elements that hold most of them.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import table
from .memory import lean

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead title tr ul".split()
)
DROPPED = frozenset("script style noscript template head title nav header footer aside button select textarea iframe menu dialog svg math object canvas audio video map".split())
CLOSES_P = BLOCKS - {"body", "html", "head"}
NAMED = re.compile(
    r"ads?|advert\w*|banner|breadcrumbs?|comments?|cookies?|consent|disqus|footer|header|masthead|menu|modal|nav|navbar|navigation|newsletter|notice|popup|promo|related|reply|replies|respond|share|sharing|sidebar|social|sponsor\w*|subscribe|toolbar|widget",
    re.IGNORECASE,
)
#: Before a listed word, these say what an element has or lacks, not what it is.
STATES = frozenset("with has have no without not".split())
UNENDED = re.compile(r"<[a-zA-Z/!?]")
ROLES = frozenset("navigation banner contentinfo complementary search menu menubar alert dialog".split())
SIGMA, REACH = 1.0, 3
SPREAD = 0.5
MAIN = ("article", "main")
#: Elements whose paragraphs are their own.
APART = (*MAIN, "td", "th", "li", "div", "section", "body")
HOLDERS = frozenset("article body center div form main section td".split())
#: What an element has to hold of the ratio mass of its page to be content whatever its class says; a whole token says more than a part of one.
MOST, WHOLE = 0.5, 0.9


def named(value: str) -> float:
    """What share of the page's ratio mass a class or id outweighs: 0 where it tells nothing."""
    out = 0.0
    for token in value.split():
        parts = re.split("[_-]+", token)
        if any(NAMED.fullmatch(x) and (not i or parts[i - 1].lower() not in STATES) for i, x in enumerate(parts)):
            out = max(out, WHOLE if NAMED.fullmatch(token) else MOST)
    return out


class Lines(HTMLParser):
    """Lines of a page: text, tags, whether they can be content, and the article and main elements they are in.

    An element that its name, its role or a form alone tells to be no content is a guess; those in `spared` (their numbers) are
    content. `guessed` has, of each guess, the share that it outweighs, the ratio mass and the marked articles in it.

    What is open is held by the innermost of each kind and what that is in, so a page costs as many steps as it has tags, however
    deep they are.
    """

    def __init__(self, spared: frozenset[int] = frozenset()):
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, bool, int, int, int]] = []  # tag, dropped with all in it, number of a marked element, of a holder, and of a guess
        self.lines: list[tuple[str, int, bool, tuple[int, ...], int]] = []
        self.holders = 0
        self.above: dict[int, int] = {}  # the holder that a holder is in
        self.marked: list[str] = []
        self.outer: list[dict[str, int]] = []  # of a marked element, by kind, the outermost that it is or is in
        self.around: list[int] = []  # the guess that a guess is in, or -1
        self.at: dict[str, list[int]] = {}  # by tag, places in open
        self.within: dict[str, list[int]] = {"mark": [-1], "home": [0], "guess": [-1]}  # open numbers, the innermost last
        self.text: list[str] = []
        self.lost: list[tuple[int, int]] = []  # the guess that text is in, and its length
        self.tags = 0
        self.dropped = 0  # open elements that are no content
        self.sure = 0  # those of them that are no guess
        self.spared = spared
        self.guessed: list[list] = []
        self.mass = 0.0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        """What begins with <![ ends at the next >, as browsers have it; the library stops the parser at unknown words."""
        end = self.rawdata.find(">", i + 3)
        return end + 1 if end >= 0 else -1

    def _line(self) -> None:
        text = " ".join("".join(self.text).split())
        for guess, size in [*self.lost, (-1, len(text) if not self.dropped else 0)]:
            share = size / max(1, self.tags)
            self.mass += share
            if guess >= 0:
                self.guessed[guess][1] += share
        if text or self.tags:
            self.lines.append((text, self.tags, not self.dropped, self.within["mark"][-1], self.within["home"][-1]))
        self.text, self.lost, self.tags = [], [], 0

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag in BLOCKS:
            self._line()
            if tag in CLOSES_P and any(t == "p" for t, *_ in self.open[-8:]):
                self._close("p")
        elif tag == "br" and not self.dropped:
            self.text.append(" ")
        self.tags += 1
        if tag in VOID:
            return
        drop, role, guess = tag in DROPPED, False, MOST if tag == "form" else 0.0
        for name, value in attrs:
            if value and name in ("class", "id"):
                if tag not in ("html", "body"):
                    guess = max(guess, named(value))
            elif value and name == "role":
                drop, role = drop or value.lower() in ROLES, role or value.lower() == "main"
                guess = max(guess, MOST if value.lower() == "form" else 0.0)
            elif name == "hidden" or name == "aria-hidden" and value == "true":
                drop = True
        kind = "main" if role else tag
        if tag == "header" and any(self.at.get(t) for t in MAIN):
            drop = False  # an article's own, with its title
        self.sure += drop
        number, which = -1, -1
        if guess and not drop and not self.sure:
            which = len(self.guessed)
            self.guessed.append([guess, 0.0, 0])
            self.around.append(self.within["guess"][-1])
        if kind in MAIN and not self.sure and which < 0 and self.within["guess"][-1] >= 0:
            self.guessed[self.within["guess"][-1]][2] += 1
        sure, drop = drop, drop or guess > 0 and which not in self.spared
        if kind in MAIN and not drop and not self.dropped:
            number, inside = len(self.marked), self.within["mark"][-1]
            self.marked.append(kind)
            self.outer.append({kind: number} | (self.outer[inside] if inside >= 0 else {}))
        if tag in HOLDERS:
            self.holders += 1
            self.above[self.holders] = self.within["home"][-1]
        for name, k, there in (("mark", number, number >= 0), ("home", self.holders, tag in HOLDERS), ("guess", which, which >= 0)):
            if there:
                self.within[name].append(k)
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append((tag, drop, number, self.holders if tag in HOLDERS else 0, -2 if sure else which))
        self.dropped += drop

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def _close(self, tag: str) -> None:
        k = self.at[tag][-1] if self.at.get(tag) else -1
        if k < 0 or tag == "p" and any(self.at[t][-1] > k for t in APART if self.at.get(t)):
            return  # nothing to close, or a paragraph outside the element that this is in
        while len(self.open) > k:
            own, drop, number, home, which = self.open.pop()
            self.at[own].pop()
            self.dropped -= drop
            self.sure -= which == -2
            for name, there in (("mark", number >= 0), ("home", home > 0), ("guess", which >= 0)):
                if there:
                    self.within[name].pop()

    def settle(self) -> None:
        """What a guess holds, the guess that it is in holds too."""
        for k in range(len(self.guessed) - 1, -1, -1):
            if self.around[k] >= 0:
                for i in (1, 2):
                    self.guessed[self.around[k]][i] += self.guessed[k][i]

    def handle_endtag(self, tag: str) -> None:
        if tag in BLOCKS:
            self._line()
        self.tags += 1
        if tag not in VOID:
            self._close(tag)

    def handle_data(self, data: str) -> None:
        if not self.dropped:
            self.text.append(data)
        if not self.sure and self.within["guess"][-1] >= 0:
            self.lost.append((self.within["guess"][-1], len(" ".join(data.split()))))


def smoothed(ratios: np.ndarray) -> np.ndarray:
    kernel = np.exp(-0.5 * (np.arange(-REACH, REACH + 1) / SIGMA) ** 2)
    weight = np.convolve(np.ones(len(ratios)), kernel)[REACH:-REACH]
    return np.convolve(ratios, kernel)[REACH:-REACH] / weight


def parsed(html: str, spared: frozenset[int] = frozenset()) -> Lines:
    parser = Lines(spared)
    parser.feed(html)
    if UNENDED.match(parser.rawdata):
        parser.rawdata = ""  # a tag or comment that the page's end cuts off is no text
    parser.close()
    parser._line()
    parser.settle()
    return parser


def main_text(html: str | None) -> list[str]:
    """The blocks of a page's main text, in page order; none for null or where there is no text."""
    if not html:
        return []
    parser = parsed(html)
    spared = {k for k, (share, mass, articles) in enumerate(parser.guessed) if articles or mass > share * parser.mass}
    if spared:
        parser = parsed(html, frozenset(spared))
    if not any(t and ok for t, _, ok, *_ in parser.lines) and parser.guessed and max(m for _, m, _ in parser.guessed) > 0:
        # Where nothing else is left, what only its name tells to be no content is content.
        most = max(m for _, m, _ in parser.guessed)
        parser = parsed(html, frozenset(spared | {k for k, (_, m, _) in enumerate(parser.guessed) if m == most}))
    lines = parser.lines
    ratios = np.array([len(t) / max(1, n) if ok else 0.0 for t, n, ok, *_ in lines])
    if not len(lines) or not ratios.any():
        return []
    smooth = smoothed(ratios)
    dense = smooth >= SPREAD * ratios.std()
    mass = np.where(dense, ratios, 0.0)
    for kind in MAIN:
        weights: dict[int, float] = {}
        clustered: set[int] = set()
        top = [parser.outer[k].get(kind, -1) if k >= 0 else -1 for _, _, _, k, _ in lines]
        for m, (t, _, ok, *_), own in zip(mass, lines, top, strict=True):
            if own >= 0:
                weights[own] = weights.get(own, 0.0) + m + (1e-9 if ok and t else 0.0)
                if m > 0:
                    clustered.add(own)
        if weights and max(weights.values()) > 0:
            kept = clustered or {max(weights, key=lambda k: (weights[k], -k))}
            return [t for (t, _, ok, *_), own in zip(lines, top, strict=True) if ok and t and own in kept]
    at = np.flatnonzero(dense & (ratios > 0))
    if not len(at):
        at = np.flatnonzero(ratios > 0)
    # Clusters a few lines apart are one region.
    regions = np.split(at, np.flatnonzero(np.diff(at) > 2 * REACH) + 1)
    homes = []
    for region in regions:
        weight: dict[int, float] = {}
        for k in region:
            weight[lines[k][4]] = weight.get(lines[k][4], 0.0) + ratios[k]
        homes.append(max(weight, key=weight.get))
    # The heaviest region counts, and those in the same element as its own, in that element's siblings, parent or children.
    heaviest = homes[max(range(len(regions)), key=lambda i: ratios[regions[i]].sum())]
    near = lambda h: h == heaviest or parser.above.get(h) in (heaviest, parser.above.get(heaviest, 0)) or h == parser.above.get(heaviest)
    ends: dict[int, list[int]] = {}
    for k, (t, _, ok, _, home) in enumerate(lines):
        if ok and t:
            ends.setdefault(home, [k, k])[1] = k
    step = np.zeros(len(lines) + 1, dtype=np.int64)
    for region, home in zip(regions, homes, strict=True):
        if near(home):
            # The element that holds most of a region is content from its first line to its last.
            step[min(region[0], ends[home][0])] += 1
            step[max(region[-1], ends[home][1]) + 1] -= 1
    return [t for k, (t, _, ok, *_) in zip(np.cumsum(step), lines, strict=False) if k and ok and t]


RESULT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64()), ("n_blocks", pa.int64())])
RESULT_SQL = "page_id long, url string, text string, n_chars long, n_blocks long"


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, len(whole), 500):
            batch = whole.slice(k, 500)
            blocks = [main_text(x.as_py()) for x in batch.column("html")]
            texts = ["\n\n".join(b) for b in blocks]
            yield pa.RecordBatch.from_arrays([batch.column("page_id"), batch.column("url").cast(pa.string()), pa.array(texts, pa.string()), pa.array(list(map(len, texts)), pa.int64()), pa.array(list(map(len, blocks)), pa.int64())], schema=RESULT)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars, n_blocks of each row of pages (page_id, url, html; others unread).

    A null, empty or textless page has the empty text; null ids and urls stay; rows that repeat give as many rows.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(lean(_extract), RESULT_SQL)


def op3_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))

"""Main text of web pages by line-block distribution.

Markup is stripped into lines, a line for each block element and an empty one for a block without text. Lines of boilerplate
elements (navigation, page headers, footers, asides, forms, scripts, and blocks whose class, id or role says menu, advert,
notice, comment and the like) keep their place but lose their text. Such a class or id is a whole name (or one made only of such
words and of QUALIFIERS); it strips neither the only article or main element nor, unless it can't be said of a wrapper
(ALWAYS), a block that holds most of the page's text. A stripped stretch is one line, however many blocks it has.

A line weighs as many characters as it has, none if most of them are links, and ARTICLE times as many inside an article or main
element. The weights, summed over windows of WINDOW lines, form a distribution along the page. Text surges where the sum rises
above zero and dives where a whole window holds nothing; a stretch counts only if its highest sum reaches 1 / SURGE of the
page's highest. These stretches are the article's core, the innermost container that holds HOME of their weight is the article's
element, and all lines in it are its text, but for lists of links (a window or more of them outside paragraphs, unless it is
an article or main element). Text outside is kept where it surges by itself, as are headings right before, and paragraphs in
the body if no container holds the core. So the distribution decides on
every page, and tags only weigh.

Null and empty pages have empty texts; so do pages whose every line is boilerplate. Broken markup (unclosed tags, quotes or
sections, a page cut off anywhere) is read to its end. Repeated rows are rows of their own; other columns are not read. Nothing is cut or capped.
An empty table gives no rows.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phonoweave.llm.common import small_batches

#: Lines in a window.
WINDOW = 4
#: A stretch surges if its highest sum is at least one in so many of the page's highest.
SURGE = 4
#: Weight of a character inside an article or main element, and the share of the core's weight that its element holds.
ARTICLE, HOME = 64, 0.9
#: Fixed values of HTML: elements that start a new line, and elements without content.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript template iframe svg object select option button label canvas audio video".split())
CUT = frozenset("nav header footer aside form menu head dialog".split()) | RAW
CONTAINERS = frozenset("article center div main section td".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
PARAGRAPHS = frozenset("p blockquote pre".split()) | HEADINGS
CLOSED_BY_BLOCK = frozenset(["p"])
CUES = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promoted sponsor sponsored sidebar nav navbar navigation menu menubar breadcrumb breadcrumbs header masthead footer cookie cookies consent notice notices alert popup modal newsletter subscribe signup login search share sharing social related recommended comment comments respond disqus replies pagination pager widget toolbar skip".split()
)
#: Words that leave a compound name a cue, and cues that strip a block however much it holds.
QUALIFIERS = frozenset("site global list box block bar area wrapper container section links inner top bottom left right".split())
ALWAYS = frozenset(
    "ad ads adv advert adverts advertisement advertising banner promo promoted sponsor sponsored breadcrumb breadcrumbs cookie cookies consent newsletter comment comments respond disqus replies pagination pager".split()
)
ARTICLES = frozenset(["article", "main"])
ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog".split())
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*?)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s>]+))?""")
RAW_END = {name: re.compile(rf"</{name}\s*>", re.I) for name in ("script", "style", "textarea", "title")}
BLANKS = re.compile(r"\s+")


def _cue(attributes: str, block: bool) -> int:
    """0 without a cue, 1 with one, 2 if it may be said of a wrapper too."""
    level = 0
    for name, value in ATTRIBUTE.findall(attributes):
        value, name = value.strip("\"'").lower(), name.lower()
        if name == "hidden" and value != "until-found" or name == "aria-hidden" and value == "true" or name == "role" and value in ROLES:
            return 1
        if block and name in ("class", "id"):
            for whole in value.split():
                parts = set(re.split(r"[_\-]+", whole))
                if parts & CUES and parts <= CUES | QUALIFIERS:
                    if parts & ALWAYS:
                        return 1
                    level = 2
    return level


class _Page:
    """Lines of a page, and its block elements in the order of their start; element 0 is the page itself."""

    def __init__(self):
        self.lines: list[tuple[str, int, int]] = []  # text (empty where stripped), characters in links, element
        self.tags, self.parents, self.spans = [""], [0], [(0, 0)]  # spans: an element's first line, and the one after its last
        self.near = [0]  # the innermost container, 0 for the body
        self.cues, self.inside = [0], [False]  # inside: an article or main element, or in one

    def open(self, name: str, parent: int, cue: int) -> int:
        e = len(self.tags)
        self.tags.append(name)
        self.parents.append(parent)
        self.spans.append((len(self.lines), 0))
        self.near.append(e if name in CONTAINERS else self.near[parent])
        self.cues.append(cue)
        self.inside.append(self.inside[parent] or name in ARTICLES)
        return e

    def close(self, e: int) -> None:
        self.spans[e] = self.spans[e][0], len(self.lines)

    def strip(self) -> None:
        """Make each stripped element with a cue one empty line."""
        if not any(self.cues):
            return
        n = len(self.tags)
        chars, articles = [0] * n, [0] * n
        for text, links, e in self.lines:
            chars[e] += max(0, len(text) - links)
        for e in range(n - 1, 0, -1):
            chars[self.parents[e]] += chars[e]
        cued = [c > 0 and not (c == 2 and 2 * chars[e] > chars[0]) for e, c in enumerate(self.cues)]
        # Cues inside an article strip at once; of those around articles, the outer ones that leave no article don't count.
        within, depth = [False] * n, [0] * n
        for e in range(1, n):
            up = self.parents[e]
            within[e] = within[up] or cued[e] and self.inside[up]
            depth[e] = depth[up] + (cued[e] and not self.inside[up])
        least = None
        for text, _, e in self.lines:
            if text and self.inside[e] and not within[e]:
                articles[e] += len(text)
                least = depth[e] if least is None else min(least, depth[e])
        for e in range(n - 1, 0, -1):
            articles[self.parents[e]] += articles[e]
        top = [0] * n  # the outermost stripped element
        for e in range(1, n):
            up = self.parents[e]
            spared = not self.inside[up] and articles[e] > 0 and depth[e] <= least
            top[e] = top[up] or (e if cued[e] and not spared else 0)
        lines, at, last = [], [], 0
        for text, links, e in self.lines:
            at.append(len(lines))
            if not top[e]:
                lines.append((text, links, e))
            elif top[e] != last:
                lines.append(("", 0, e))
            last = top[e]
        at.append(len(lines))
        self.lines, self.spans = lines, [(at[a], at[b]) for a, b in self.spans]


def _lines(page: str) -> _Page:
    out = _Page()
    open_: list[tuple[str, bool, int]] = []  # element, whether it started a stripped stretch, its number (of the block around it for others)
    there: Counter[str] = Counter()  # how many of each element are open
    cut = linked = 0
    marked = False  # whether the stripped stretch has its line
    text: list[str] = []
    links = 0

    def flush(empty: bool = False) -> None:
        nonlocal links, marked
        line = BLANKS.sub(" ", html.unescape("".join(text))).strip()
        if line or cut and not marked or empty and not cut:
            out.lines.append((line, links, open_[-1][2] if open_ else 0))
            marked = marked or cut > 0 and not line
        text.clear()
        links = 0

    def close(k: int) -> None:
        nonlocal cut, linked
        while len(open_) > k:
            name, stripped, number = open_.pop()
            there[name] -= 1
            if name in BLOCKS:
                out.close(number)
            cut -= stripped
            linked -= name == "a"

    at = 0
    while at < len(page):
        found = TOKEN.search(page, at)
        if found is None:
            if not cut:
                text.append(page[at:])
            break
        if found.start() > at and not cut:
            piece = page[at : found.start()]
            text.append(piece)
            if linked:
                links += len(piece)
        at = found.end()
        if found.group(2) is None:
            if found.group().startswith("<![CDATA[") and not cut:
                text.append(found.group()[9:].removesuffix("]]>"))
            continue
        name, closing, attributes = found.group(2).lower(), found.group(1), found.group(3) or ""
        if closing:
            if name in BLOCKS:
                # A block that ends without a line of its own is an empty one.
                flush(bool(open_) and open_[-1][0] == name and out.spans[open_[-1][2]][0] == len(out.lines))
            for k in range(len(open_) - 1, -1, -1) if there[name] else ():
                if open_[k][0] == name:
                    close(k)
                    break
                if name not in BLOCKS and open_[k][0] in BLOCKS:
                    break  # an inline end tag doesn't close the block around it
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in BLOCKS:
            flush()
            if open_ and open_[-1][0] not in BLOCKS or open_ and open_[-1][0] == "p":
                for k in range(len(open_) - 1, -1, -1):  # a block ends an open paragraph, with what is in it
                    if open_[k][0] in CLOSED_BY_BLOCK:
                        close(k)
                        break
                    if open_[k][0] in BLOCKS:
                        break
        if name in VOID or attributes.rstrip().endswith("/"):
            continue
        if name in RAW_END and (end := RAW_END[name].search(page, at)):
            at = end.end()
            continue
        cue = _cue(attributes, name in BLOCKS) if name not in CUT and name not in ("html", "body", "main") else 0
        number = open_[-1][2] if open_ else 0
        stripped = name in CUT and not (name == "header" and out.inside[number]) or cue > 0 and name not in BLOCKS
        if name in BLOCKS:
            number = out.open(name, number, cue)
        open_.append((name, stripped, number))
        there[name] += 1
        marked = marked and cut > 0
        cut += stripped
        linked += name == "a"
    flush()
    close(0)
    out.strip()
    return out


def stretches(weights: list[int]) -> list[tuple[int, int, int]]:
    """(highest sum, surge, dive) of each stretch: from a line that weighs up to the last one before a window that holds nothing."""
    sums = [sum(weights[k : k + WINDOW]) for k in range(len(weights))]
    found, k = [], 0
    while k < len(weights):
        if not weights[k]:
            k += 1
            continue
        surge = last = k
        while k < len(weights) and sums[k]:
            last = k if weights[k] else last
            k += 1
        found.append((max(sums[surge : last + 1]), surge, last + 1))
    return found


def _home(page: _Page, weights: list[int], core: list[tuple[int, int, int]]) -> int:
    """The innermost container with HOME of the core's weight, or the article or main element around it; 0 for the body."""
    held: dict[int, int] = {}
    total = 0
    for k in (k for _, surge, dive in core for k in range(surge, dive) if weights[k]):
        e = page.near[page.lines[k][2]]
        total += weights[k]
        while e:
            held[e] = held.get(e, 0) + weights[k]
            e = page.near[page.parents[e]]
    least = HOME * total
    home = max((e for e, w in held.items() if w >= least), default=0)  # of nested elements the innermost has the highest number
    if page.inside[home]:
        while page.tags[home] not in ARTICLES:
            home = page.parents[home]
    return home


def main_text(page: str | None) -> str:
    """Blocks of the article in page order, joined by a blank line."""
    parsed = _lines(page or "")
    lines = parsed.lines
    linked = [2 * links > len(text) for text, links, _ in lines]
    weights = [0 if linked[k] else len(text) * (ARTICLE if parsed.inside[e] else 1) for k, (text, _, e) in enumerate(lines)]
    found = stretches(weights)
    if not found:
        return ""
    level = max(high for high, _, _ in found) / SURGE
    core = [s for s in found if s[0] >= level]
    home = _home(parsed, weights, core)
    first, last = parsed.spans[home] if home else (0, 0)
    kept = [first <= k < last for k in range(len(lines))]
    outside = [0 if kept[k] else w for k, w in enumerate(weights)]
    for high, surge, dive in stretches(outside):
        if high >= level:
            for k in range(surge, dive):
                kept[k] = kept[k] or outside[k] > 0 or linked[k]
    if home:
        k = first - 1
        while k >= 0 and (parsed.tags[lines[k][2]] in HEADINGS or not lines[k][0]) and first - k <= WINDOW:
            kept[k] = True
            k -= 1
    if not parsed.inside[home] and parsed.tags[home] not in ARTICLES:
        _links(parsed, linked, kept, not home, core[0][1], core[-1][2])
    return "\n\n".join(text for k, (text, _, _) in enumerate(lines) if kept[k] and text)


def _links(page: _Page, linked: list[bool], kept: list[bool], loose: bool, begin: int, end: int) -> None:
    """Drop lists of links; loose: the core stands in the body itself, and so do paragraphs beside it."""
    lines, run = page.lines, 0
    for k, (_, _, element) in enumerate(lines):
        run = run if linked[k] and k and linked[k - 1] else k  # where the run of lines of links begins
        paragraph, in_body = page.tags[element] in PARAGRAPHS or not element or page.tags[element] in ("body", "html"), not page.near[element]
        if linked[k]:
            short = not any(all(linked[j : j + WINDOW]) for j in range(max(run, k - WINDOW + 1), k + 1) if j + WINDOW <= len(lines))
            kept[k] = (paragraph or short) and (kept[k] or begin <= k < end) or page.tags[element] in PARAGRAPHS and loose and in_body
        elif loose and in_body and paragraph:
            kept[k] = True


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every page."""
    small_batches(pages.sparkSession)

    def run(batches):
        for batch in batches:
            texts = [main_text(p) for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")

"""Main text of web pages by line-block distribution.

A page is cut in lines, one for each block of its markup. A line's length counts its text outside links and outside
regions that are never content (menus, forms, scripts, adverts, comments and the like have length 0). The sum of lengths
over sliding windows of lines surges where the main text begins and dives where it ends; the lines between the surge and
the dive are kept, widened to the ends of the element that holds the run, so that a short first or last paragraph or a
heading next to the run is not cut. Where an article with its siblings, or a main element, has most of the page's text,
that is the holder; else it is found from the heaviest run. All runs that surge within the same holder are kept; nothing is
kept outside it.

Defined results: null, empty and text-free pages give an empty text; unclosed and stray tags are read as browsers do,
roughly; rows that repeat give a row each; an empty table gives an empty result; other columns pass through untouched, but
columns of the outputs' names are replaced.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from lanternfold.llm.common import quoted, with_results

#: Lines on each side of a line that its block sums, and the block sum from which text surges.
BLOCK_LINES, SURGE_CHARS = 2, 25

#: HTML elements by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe object svg math canvas select".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html "
    "legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul video audio".split()
)
CLOSES_P = BLOCKS - {"body", "html", "head"}
NEVER = frozenset("nav footer aside form button head menu dialog audio video fieldset label search".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Words of class, id and role values that mark a region that is no content.
NOISE = re.compile(
    r"(?:^|[\s_-])(?:nav|navbar|navigation|navi|menu|menus|submenu|breadcrumbs?|sidebar|side-?bar|aside|footer|site-?footer|page-?footer|masthead|topbar|toolbar|banner|"
    r"ads?|adverts?|advertisement|advertising|adsense|ad-?(?:box|slot|unit|banner|wrapper|container)|sponsor(?:ed|s)?|promo(?:s|tion|tions)?|cookies?|cookie-?(?:notice|banner|consent|bar)|consent|gdpr|notices?|alert|popup|modal|overlay|"
    r"comments?|comment-?(?:list|form|section|thread)|commentlist|disqus|replies|respond|discussion|reader-?comments|responses|related|recommended|recommendations|share|sharing|social|"
    r"newsletter|subscribe|subscription|signup|login|search|searchform|widgets?|pagination|pager|copyright|legal|disclaimer|skip|skip-?link|contentinfo|complementary|toc|tags?|tag-?cloud)(?=$|[\s_-])"
)
#: Elements of running text: a word of their class marks them only if it is the whole class, as a topic may be named so too.
RUNNING = frozenset("p blockquote pre li dd dt td th figcaption".split())
NOISE_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
#: What starts, and what can be, a holder of main text whatever its class says.
HOLDERS = frozenset("article main".split())

_TOKEN = re.compile(r"<!--.*?(?:--!?>|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_BLANK = re.compile(r"\s+")


@dataclass
class Element:
    name: str
    noise: bool
    link: bool
    number: int
    parent: Element | None
    holder: bool = False


@dataclass
class Line:
    text: list[str] = field(default_factory=list)
    linked: int = 0
    noise: bool = False
    heading: bool = False
    at: Element | None = None

    def joined(self) -> str:
        return _BLANK.sub(" ", "".join(self.text)).strip()


def _marked_noise(name: str, attributes: str) -> tuple[bool, bool]:
    """Whether an element's own marks say that it is no content; whether it is hidden."""
    if name in NEVER:
        return True, False
    noise = hidden = False
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key in ("class", "id") and name not in ("body", "html", *HOLDERS, *HEADINGS):
            plain = _CAMEL.sub("-", value).lower()
            noise |= any(NOISE.fullmatch(x) for x in plain.split()) if name in RUNNING else bool(NOISE.search(plain))
        elif key == "role":
            noise |= value.lower() in NOISE_ROLES
        elif key == "itemprop":
            noise |= value.lower() in ("comment", "breadcrumb")
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value.lower())):
            hidden = True
    return noise, hidden


def lines_of(page: str) -> list[Line]:
    """The page's lines in order, one for each block with text."""
    lines: list[Line] = []
    line = Line()
    number = 0
    top = Element("", False, False, 0, None)
    stack = [top]

    def flush() -> None:
        nonlocal line
        if line.text and line.joined():
            lines.append(line)
        line = Line()

    def write(raw: str) -> None:
        here = stack[-1]
        text = html.unescape(raw)
        if not line.text or (line.at is not None and line.at.noise != here.noise):
            if line.text and line.joined():
                flush()
            line.at, line.noise = here, here.noise
            line.heading = any(e.name in HEADINGS for e in stack[-3:])
        line.text.append(text)
        if here.link:
            line.linked += len(_BLANK.sub(" ", text).strip())

    pos, end = 0, len(page)
    while pos < end:
        m = _TOKEN.search(page, pos)
        if not m:
            write(page[pos:])
            break
        if m.start() > pos:
            write(page[pos : m.start()])
        pos = m.end()
        if m[2] is None:
            continue
        name = m[2].lower()
        if m[1]:
            if name == "p" and not any(e.name == "p" for e in stack):
                flush()
                continue
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name == name), 0)
            if name not in BLOCKS and depth and any(e.name in BLOCKS for e in stack[depth + 1 :]):
                # an inline element cannot close a block: what is inside goes on without it
                stack[depth].link = False
                stack[depth].name = ""
                continue
            if depth:
                if any(e.name in BLOCKS for e in stack[depth:]):
                    flush()
                del stack[depth:]
            elif name in BLOCKS:
                flush()
            continue
        if name == "br":
            write(" ")
            continue
        if name in RAW:
            close = re.compile(rf"</{re.escape(name)}\s*>", re.I).search(page, pos)
            if not m[0].endswith("/>"):
                pos = close.end() if close else (end if name in ("script", "style", "title", "textarea", "template") else pos)
            continue
        if name in VOID:
            if name in BLOCKS:
                flush()
            elif name in ("img", "wbr", "input"):
                write("" if name == "wbr" else " ")
            continue
        if name in BLOCKS:
            flush()
        if name in CLOSES_P:
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name in ("p", "td", "th", "li", "div", "section", "article", "body")), 0)
            if depth and stack[depth].name == "p":
                del stack[depth:]
        if name in ("li", "dt", "dd", "tr", "td", "th", "option"):
            same = ("dt", "dd") if name in ("dt", "dd") else ("td", "th") if name in ("td", "th") else (name,)
            depth = next((i for i in range(len(stack) - 1, 0, -1) if stack[i].name in (*same, "ul", "ol", "dl", "table", "select")), 0)
            if depth and stack[depth].name in same:
                del stack[depth:]
        noise, hidden = _marked_noise(name, m[3])
        here = stack[-1]
        # a page's header is no content; the header of an article holds its title
        if name == "header" and not any(e.name in HOLDERS for e in stack):
            noise = True
        number += 1
        stack.append(Element(name, here.noise or noise or hidden, here.link or name == "a", number, here, name in HOLDERS))
    flush()
    return lines


def _lengths(lines: list[Line]) -> list[int]:
    """A line's text length outside links; 0 in regions that are no content."""
    return [0 if x.noise else max(0, len(x.joined()) - x.linked) for x in lines]


def main_lines(lines: list[Line]) -> list[int]:
    """The numbers of the lines of the main text, by line-block distribution."""
    if not lines:
        return []
    length = _lengths(lines)
    n = len(lines)
    # blocks are summed over the whole page: the runs say where text is, holders only widen and clip them
    block = [sum(length[max(0, k - BLOCK_LINES) : k + BLOCK_LINES + 1]) for k in range(n)]
    # a line without text of its own starts no run, whatever stands next to it
    top = max((block[k] for k in range(n) if length[k]), default=0)
    if not top:
        return []
    surge = min(SURGE_CHARS, top)
    runs: list[list[int]] = []
    k = 0
    while k < n:
        if block[k] >= surge and length[k]:
            first = k
            while k + 1 < n and block[k + 1] >= surge:
                k += 1
            runs.append([first, k])
        k += 1
    inside = _held(lines, length)
    if inside:
        # a run is clipped to the holder's lines and widened to the ends of their stretch: the title and short last lines
        hit = {k for a, b in runs for k in range(a, b + 1) if inside[k] and length[k]}
        runs = [r for r in _stretches(inside) if not hit.isdisjoint(range(r[0], r[1] + 1))]
    else:
        inside = [True] * n
        heaviest = max(runs, key=lambda r: sum(length[r[0] : r[1] + 1]))
        parents = _ancestors(lines[max(range(heaviest[0], heaviest[1] + 1), key=lambda k: length[k])])
        common = _holding(lines, length, heaviest, parents)
        runs = [_widened(lines, r, common) for r in runs if r is heaviest or all(common in _ancestors(lines[k]) for k in (r[0], r[1]))]
    kept = sorted({k for a, b in runs for k in range(a, b + 1)})
    return [k for k in kept if not lines[k].noise and inside[k] and not _link_list(lines[k])]


def _held(lines: list[Line], length: list[int]) -> list[bool]:
    """For each line whether it is in the holder of main text, the article with its siblings or the main element that has most of the page's text; empty without one."""
    holders = [_holder(x) for x in lines]
    weight: dict[int, int] = {}
    for h, x in zip(holders, length, strict=True):
        if h:
            weight[h] = weight.get(h, 0) + x
    best = max(weight, key=lambda h: (weight[h], -h), default=0)
    return [h == best for h in holders] if best and 2 * weight[best] > sum(length) else []


def _stretches(inside: list[bool]) -> list[list[int]]:
    """First and last of each stretch of lines in a row that are inside."""
    n = len(inside)
    firsts = [k for k in range(n) if inside[k] and not (k and inside[k - 1])]
    lasts = [k for k in range(n) if inside[k] and not (k + 1 < n and inside[k + 1])]
    return [list(x) for x in zip(firsts, lasts, strict=True)]


def _link_list(line: Line) -> bool:
    """Whether all of a line is links: a menu entry, not text."""
    return line.linked > 0 and line.linked >= len(line.joined()) and line.at is not None and any(e in _names(line.at) for e in ("ul", "ol", "table"))


def _names(element: Element | None) -> list[str]:
    out = []
    while element is not None:
        out.append(element.name)
        element = element.parent
    return out


def _ancestors(line: Line) -> list[int]:
    out, e = [], line.at
    while e is not None:
        out.append(e.number)
        e = e.parent
    return out


def _holder(line: Line) -> int:
    """A number for the outermost article and its siblings, else the innermost main element, that a line lies in; 0 without one."""
    found, e = 0, line.at
    main = 0
    while e is not None:
        if e.name == "article":
            found = -1 - (e.parent.number if e.parent else 0)
        elif e.name == "main" and not main:
            main = e.number
        e = e.parent
    return found or main


def _holding(lines: list[Line], length: list[int], run: list[int], parents: list[int]) -> int:
    """The innermost ancestor of a run's longest line that holds nine tenths of the run's text."""
    total = sum(length[run[0] : run[1] + 1])
    for number in parents:
        if 10 * sum(length[k] for k in range(run[0], run[1] + 1) if number in _ancestors(lines[k])) >= 9 * total:
            return number
    return 0


def _widened(lines: list[Line], run: list[int], common: int) -> list[int]:
    """A run with the short lines next to it inside its holder; lines of the run outside the holder are cut from its ends."""
    first, last = run
    while first < last and common not in _ancestors(lines[first]) and not lines[first].heading:
        first += 1
    while last > first and common not in _ancestors(lines[last]):
        last -= 1
    while first and not lines[first - 1].noise and (common in _ancestors(lines[first - 1]) and common or lines[first - 1].heading):
        first -= 1
    while last + 1 < len(lines) and not lines[last + 1].noise and common and common in _ancestors(lines[last + 1]):
        last += 1
    return [first, last]


def main_text(page: str | None) -> str:
    """A page's main text: its blocks in page order, joined by line feeds."""
    if not page:
        return ""
    lines = lines_of(page)
    return "\n".join(lines[k].joined() for k in main_lines(lines))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with text and n_chars."""

    def worker() -> Callable[[list[str]], list[pa.Array]]:
        def make(found: list[str]) -> list[pa.Array]:
            texts = [main_text(x) for x in found]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return make

    return with_results(pages, quoted(html_col).cast("string"), [html_col], [("text", "string"), ("n_chars", "long")], worker)

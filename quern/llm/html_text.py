"""Main-text extraction by tag-path ratios.

A page is read into blocks of text, each with its root-to-leaf path of block elements (tags and classes).
Elements that can't hold the article are set aside: scripts and the like, menus, headers, footers and
comments by tag or role, and by whole names in class and id. Names and forms don't count if the element wraps
the article: if it holds more than half of the page's text and every h1, article and main element. Over the
other blocks, text length and punctuation are summed per path; the ratios per block are smoothed over the paths in page order and fused by their
product, weighted by the path's share of the text.

A heading, a short line or a list in the article has a low ratio of its own. So a container takes the best
ratio of the paths of its own blocks, and passes it on to the containers around and inside it, less at
each step: little less inside an article or main element, much less outside, least of all through the body. A
block is content if its path's ratio or its container's reaches the threshold. The last h1
before the content is its title, unless the content has one.

Defined cases: null and empty html, or a page without text, give an empty text; broken markup is
read as browsers do as far as it matters here (unclosed elements and quotes, stray ends, unclosed comments);
a null url stays null; repeated rows return repeated; an empty table gives no rows; other columns
are ignored. The time is in proportion to the page's length, however deep its elements lie.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quern.llm.common import slices

TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(?:[!?]|/(?![a-zA-Z]))[^>]*+(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s=/>\"']++)(?:\s*+=\s*+(\"[^\"]*+\"|'[^']*+'|[^\s>]++))?+")
NONE_SHOWN = re.compile(r"display\s*:\s*none")
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
PUNCTUATION = re.compile(r"[.,;:!?…。，；：！？、]")

RAW = frozenset("script style noscript template iframe textarea title svg math object select canvas audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
#: Elements that never hold the article, and roles and names that mean the same.
ASIDE = frozenset("nav footer aside menu dialog button fieldset head".split())
ASIDE_ROLES = frozenset("navigation contentinfo complementary search menu menubar dialog alertdialog alert banner".split())
ASIDE_NAMES = frozenset("comment comments disqus replies".split())
#: Elements that are a part of an article's text and never all of it.
PARTS = frozenset("p pre blockquote figure figcaption h1 h2 h3 h4 h5 h6 hgroup ul ol li dl dt dd table caption colgroup thead tbody tfoot tr th td address details summary".split())
ROOTS = frozenset("html body main article".split())
ARTICLES = frozenset(("article", "main"))
#: Elements that mark where an article is.
MARKS = frozenset(("h1", "article", "main"))
#: Whole names in class or id that tell what isn't the article.
NAMES = frozenset(
    "ad ads adsense advert adverts advertisement advertising aside banner breadcrumb breadcrumbs captcha consent cookie cookies disclaimer footer form gdpr header hidden login "
    "menu modal nav navbar navigation newsletter notice notices pagination pager popup promo promoted promotion related reply search share sharing sidebar signup skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Those that tell it as the first or last part of a name as well, unless the name says that there is none or some.
PART_NAMES = frozenset("ad ads advert advertisement adsense breadcrumb breadcrumbs comments cookie cookies footer menu modal nav navbar newsletter notice notices pagination popup promo related share sharing sidebar social sponsored subscribe".split())
#: First or last parts of a name that surely tell of reader comments, unless the other end is one of those that only speak of them.
COMMENTS = frozenset(("comment", "comments", "disqus"))
SPEAKS_OF = frozenset("count counts link links number open closed on off status enabled disabled allowed".split())
ABOUT = frozenset("no has have with without is not".split())
#: What an opening tag closes: the nearest of these, looked for up to the given elements.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "option": ("option", "select")}
CLOSES = {k: (tuple(a.split()), tuple(b.split())) for k, (a, b) in CLOSES.items()}
P_SCOPE = tuple("div article section main body td th li table blockquote html".split())
RAW_ENDS = {tag: re.compile(rf"</{tag}\b[^>]*+(?:>|\Z)", re.I) for tag in RAW}

#: The kernel that smooths ratios over neighbouring paths, and the share of the best ratio that is content.
KERNEL, THRESHOLD = (0.15, 0.7, 0.15), 0.35
#: What is left of a ratio one container further: inside an article, outside, and to or from the body.
INSIDE, OUTSIDE, THROUGH_BODY = 0.85, 0.55, 0.3


def named_aside(values: list[str]) -> bool:
    """Whether a class or id has a whole name, or a telling part of one, that isn't the article's."""
    for name in values:
        low = name.lower()
        if low in NAMES:
            return True
        parts = [x.lower() for x in PART.findall(name)]
        if len(parts) > 1 and parts[0] not in ABOUT and (parts[0] in PART_NAMES or parts[-1] in PART_NAMES):
            return True
    return False


def reader_comments(values: list[str]) -> bool:
    """Whether a class or id is that of reader comments: as a whole, or as the first or last part of a name."""
    for name in values:
        parts = [x.lower() for x in PART.findall(name)]
        if name.lower() in ASIDE_NAMES or len(parts) > 1 and (parts[0] in COMMENTS and parts[-1] not in SPEAKS_OF or parts[-1] in COMMENTS and ABOUT.isdisjoint(parts)):
            return True
    return False


class Page:
    """The page's block elements (numbered, parents first) and its blocks of text."""

    def __init__(self, html: str):
        #: By element: tag, parent, path, container, set aside surely, set aside if small, inside an article.
        self.tag, self.parent, self.path, self.container, self.sure, self.small, self.inside = [""], [0], [0], [0], [False], [False], [False]
        self.paths: dict[tuple[int, str], int] = {(-1, ""): 0}
        #: By block: its text and its element.
        self.texts: list[str] = []
        self.of: list[int] = []
        self._read(html)

    def _element(self, parent: int, tag: str, names: list[str], role: str, hidden: bool) -> int:
        self.tag.append(tag)
        self.parent.append(parent)
        self.path.append(self.paths.setdefault((self.path[parent], f"{tag} {' '.join(names)}"), len(self.paths)))
        number = len(self.tag) - 1
        self.container.append(self.container[parent] if tag in PARTS else number)
        self.inside.append(self.inside[parent] or self.tag[parent] in ARTICLES)
        root = tag in ROOTS
        self.sure.append(not root and (tag in ASIDE or tag == "header" and not self.inside[-1] or role in ASIDE_ROLES or reader_comments(names)))
        self.small.append(hidden or not root and (tag == "form" or named_aside(names)))
        return number

    def _read(self, html: str) -> None:
        stack: list[tuple[str, int, bool]] = []  # tag, element (that of its parent for inline ones), inline and set aside
        places: dict[str, list[int]] = {}  # where each tag stands in the stack
        pieces: list[str] = []
        at = element = dropped = 0  # dropped: open inline elements that are set aside

        def flush() -> None:
            if pieces:
                text = " ".join(unescape("".join(pieces)).split())
                pieces.clear()
                if text:
                    self.texts.append(text)
                    self.of.append(element)

        def cut(place: int) -> None:
            nonlocal element, dropped
            while len(stack) > place:
                tag, _, gone = stack.pop()
                places[tag].pop()
                dropped -= gone
            element = stack[-1][1] if stack else 0

        def last(tags: tuple[str, ...]) -> int:
            return max((places[t][-1] for t in tags if places.get(t)), default=-1)

        while m := TAG.search(html, at):
            if m.start() > at and not dropped:
                pieces.append(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                if tag not in INLINE:
                    flush()
                if places.get(tag):
                    cut(places[tag][-1])
                continue
            if tag in RAW:
                if tag not in ("svg", "math") or not m[3].endswith("/"):
                    end = RAW_ENDS[tag].search(html, at)
                    at = end.end() if end else len(html)
                continue
            if tag in VOID:
                if tag in ("br", "wbr", "img"):
                    pieces.append(" ")
                else:
                    flush()
                continue
            names, role, hidden = _attributes(m[3])
            if tag in INLINE:
                gone = hidden or named_aside(names)
                dropped += gone
            else:
                flush()
                names_of, upto = CLOSES.get(tag, (("p",), P_SCOPE))
                place = last(names_of)
                if place > last(upto):
                    cut(place)
                gone, element = False, self._element(element, tag, names, role, hidden)
            places.setdefault(tag, []).append(len(stack))
            stack.append((tag, element, gone))
        if not dropped:
            pieces.append(html[at:])
        flush()

    def kept(self) -> list[int]:
        """The blocks that aren't set aside."""
        held = [0] * len(self.tag)
        sure = [False] * len(self.tag)
        for e in range(1, len(self.tag)):
            sure[e] = sure[self.parent[e]] or self.sure[e]
        for text, e in zip(self.texts, self.of, strict=True):
            held[e] += len(text) * (not sure[e])
        marks = [tag in MARKS and not gone for tag, gone in zip(self.tag, sure, strict=True)]
        for e in range(len(self.tag) - 1, 0, -1):
            held[self.parent[e]] += held[e]
            marks[self.parent[e]] += marks[e]
        for e in range(1, len(self.tag)):
            wraps = 2 * held[e] > held[0] and marks[e] == marks[0]
            sure[e] = sure[e] or sure[self.parent[e]] or self.small[e] and not wraps
        return [i for i, e in enumerate(self.of) if not sure[e]]


def _attributes(text: str) -> tuple[list[str], str, bool]:
    """The names in class and id, the role, and whether the element is hidden."""
    names: list[str] = []
    role, hidden = "", False
    if text:
        for key, value in ATTRIBUTE.findall(text):
            key, value = key.lower(), unescape(value.strip("\"'"))
            if key in ("class", "id"):
                names += value.split()
            elif key == "role":
                role = value.strip().lower()
            elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and NONE_SHOWN.search(value.lower()):
                hidden = True
    return names, role, hidden


def path_ratios(blocks: list[tuple[int, str]]) -> dict[int, float]:
    """The smoothed and fused ratio of each path, from (path, text) blocks in page order."""
    order = list(dict.fromkeys(p for p, _ in blocks))
    at = {p: i for i, p in enumerate(order)}
    n, chars, marks = np.zeros((3, len(order)))
    for p, text in blocks:
        i = at[p]
        n[i] += 1
        chars[i] += len(text)
        marks[i] += len(PUNCTUATION.findall(text))
    smooth = lambda x: np.convolve(np.pad(x, 1, mode="edge"), KERNEL, "valid")
    fused = np.sqrt(smooth(chars / n) * smooth((1 + marks) / n)) * np.sqrt(chars / chars.sum())
    return dict(zip(order, fused.tolist(), strict=True))


def spread(page: Page, own: dict[int, float]) -> list[float]:
    """Each container's ratio: its own or what others pass on to it, less at each step."""
    best = [own.get(e, 0.0) for e in range(len(page.tag))]
    up = [page.container[page.parent[e]] for e in range(len(page.tag))]
    left = [INSIDE if page.inside[e] else THROUGH_BODY if page.tag[up[e]] in ("", "html", "body") else OUTSIDE for e in range(len(page.tag))]
    for e in range(len(page.tag) - 1, 0, -1):
        if page.container[e] == e:
            best[up[e]] = max(best[up[e]], left[e] * best[e])
    for e in range(1, len(page.tag)):
        if page.container[e] == e:
            best[e] = max(best[e], left[e] * best[up[e]])
    return best


def main_text(html: str | None) -> str:
    page = Page(html or "")
    kept = page.kept()
    if not kept:
        return ""
    ratios = path_ratios([(page.path[page.of[i]], page.texts[i]) for i in kept])
    own: dict[int, float] = {}
    for i in kept:
        e = page.of[i]
        own[page.container[e]] = max(own.get(page.container[e], 0.0), ratios[page.path[e]])
    passed, least = spread(page, own), THRESHOLD * max(ratios.values())
    chosen = [max(ratios[page.path[page.of[i]]], passed[page.container[page.of[i]]]) >= least for i in kept]
    first = chosen.index(True)
    titles = [page.tag[page.of[i]] == "h1" for i in kept]
    if not any(t and c for t, c in zip(titles, chosen, strict=True)) and any(titles[:first]):
        chosen[max(k for k in range(first) if titles[k])] = True
    return "\n".join(page.texts[i] for i, c in zip(kept, chosen, strict=True) if c)


def extract_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars of every row of ``pages``."""

    def extracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "html"):
            found = [main_text(h) for h in batch.column("html").to_pylist()]
            yield pa.record_batch([batch.column("page_id"), batch.column("url"), pa.array(found, pa.string()), pa.array([len(x) for x in found], pa.int64())], names=["page_id", "url", "text", "n_chars"])

    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return rows.mapInArrow(extracted, "page_id long, url string, text string, n_chars long")

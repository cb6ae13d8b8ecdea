"""Main text of web pages by tag-path ratios.

A page is read once into blocks of text, each with its root-to-leaf tag path: the block-level tags above it, with their classes. Text
length, punctuation and link text are added up per path. Each path's ratios (length and punctuation per block) are smoothed over the
neighbours in page order and averaged back per path; the two are fused into one score, lowered by the share of link text and raised
where the path goes through an article or main element. Blocks of the paths over a threshold, which is taken from the scores' own spread,
are content nodes. The deepest element that holds most of their text is the article: all its blocks are kept, but for paths that are mostly
links. Where no element but the whole page holds them, the content nodes are kept, what stands between two of them in the same element,
headings before them, and the rest of an article or main element that has one.

Elements that are never article text (scripts, navigation, buttons, hidden parts) are not read; pictures and the like in a sentence do not end it.
Forms, and what class or id call an advert, a notice, a sidebar, reader comments and so on, are left out, unless they hold most of the page's text, as a
wrapper does. Links alone after the last content node of an article go, too.

Nulls and edge cases: null and empty pages, and pages without content, give the empty text; unclosed and misnested tags, comments and
references are read as browsers do; text of any length and depth is read whole, in linear time; an empty table gives an empty table; repeated
rows are extracted each; any other columns stay.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glyphlake.llm.words import slices

# Element names by what they do to text.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
INLINE |= frozenset("math menclose mfenced mfrac mi mn mo mover mpadded mphantom mroot mrow ms mspace msqrt mstyle msub msubsup msup mtable mtd mtext mtr munder munderover semantics".split())
RAW = frozenset("script style textarea title noscript iframe noframes noembed xmp template".split())
NEVER = frozenset("head nav aside dialog menu footer".split())
# Never article text, too, but they may stand within a sentence, which goes on after them.
HOLES = frozenset("annotation audio button canvas datalist object option select svg video".split())
CONTENT = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar".split())
# Words in class or id. They tell if only words of these sets stand beside them ("site-header", but not "entry-header").
HINTS = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored promo promotion cookie cookies consent gdpr sidebar sidebars nav navbar navigation breadcrumb breadcrumbs comment comments disqus newsletter subscribe pagination popup".split())
WEAK = frozenset("banner notice notices alert aside widget widgets menu footer header masthead reply replies share sharing social related recommended recommendations subscription signup login search modal overlay pager toolbar copyright legal".split())
BESIDE = frozenset("has no is the user users reader readers visitor visitors post thread policy by us our your about slot unit google site page global top bottom left right main list item items box wrapper wrap container inner outer section block area bar links link button buttons form text content body title posts stories articles icons media primary secondary sticky fixed js".split())
REMARKS = frozenset("comment comments reply replies disqus".split())
#: An opening tag that ends elements still open: what it ends, and where looking for them stops.
CLOSES = {"li": ("li", "ul ol menu"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"), "tr": ("tr td th", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"), "tbody": ("tr td th thead tbody", "table"), "tfoot": ("tr td th thead tbody", "table"), "option": ("option", "select"), "optgroup": ("option optgroup", "select")}
CLOSES = {k: (frozenset(a.split()), frozenset(b.split())) for k, (a, b) in CLOSES.items()}
SCOPE = frozenset("table td th caption html template".split()) | HOLES

MARKUP = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</[^a-zA-Z][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+(?=>|\Z)|[^>]*+)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"([^\s\"'<>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
ENDS = {tag: re.compile(rf"</{tag}(?=[\s/>]|\Z)[^>]*(?:>|\Z)", re.I) for tag in RAW}
PUNCTUATION = re.compile(r"[.,;:!?…。，、！？]")

#: A path is content from this part of the scores' standard deviation on, and never below this part of the best score.
SPREAD, PART = 1.0, 0.2
#: Factor of paths through an article or main element.
MARKED = 4.0
#: Part of the content nodes' text that the article's element holds, and text of a wider element, in parts of its own, that it does not exceed.
MOST, WIDER = 0.75, 1.25
#: Part of a page's text (of that in article and main elements, if there are any) from which a hinted element is a wrapper, and the same for readers' remarks.
WRAPPER, REMARK_WRAPPER = 0.5, 0.9
#: Share of link text from which a path is a list of links, and from which it is nothing else.
LINKS, ONLY_LINKS = 0.5, 0.9


def _never(tag: str, attributes: str, inside: bool) -> bool:
    """Whether an element is never article text; inside: it is in an article or main element."""
    if tag in NEVER or (tag == "header" and not inside):
        return True
    if not attributes or tag in ("html", "body"):
        return False
    for m in ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "role" and value.lower() in ROLES):
            return True
        if key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _last(places: dict[str, list[int]], tags: frozenset[str]) -> int:
    """Place in the stack of the innermost open element of these, or -1."""
    return max((places[t][-1] for t in tags if places.get(t)), default=-1)


def _classes(attributes: str) -> tuple[str, bool, bool]:
    """The class, and whether class or id hint at what is no article: in an article or main element, and in others."""
    name, remark, hint = "", False, False
    for m in ATTRIBUTE.finditer(attributes):
        if m[1].lower() in ("class", "id"):
            value = m[2] or m[3] or m[4] or ""
            name = value if m[1].lower() == "class" else name
            for token in value.split():
                words = {x.lower() for x in NAME.findall(token)}
                # Other words beside them ("law-comment", "navigation-methods") name a subject of the text.
                if words <= HINTS | WEAK | BESIDE:
                    remark |= bool(words & REMARKS)
                    hint |= bool(words & (HINTS | WEAK))
    return name, remark, hint


class Page:
    """A page read once. blocks: text, path, element, length of link text, whether in an article or main element, leaf tag.

    Paths, elements and hinted elements are numbers; `parents` and `hinted` give the number above each.
    """

    def __init__(self, html: str):
        self.blocks: list[tuple[str, int, int, int, bool, str]] = []
        self.paths: dict[tuple[int, str], int] = {}
        self.parents: list[int] = [-1]
        self.hinted: list[int] = [-1]
        self.remarks: list[bool] = [False]  # of hinted elements
        self.articles: list[int] = [-1]  # of elements: the article or main element around each
        self.hint_of: list[int] = []  # of each block
        self.stack: list[tuple[str, bool, bool, int, int, int]] = [("", False, False, 0, 0, 0)]  # tag, unwanted, in an article, path, element, hinted element
        self.places: dict[str, list[int]] = defaultdict(list)  # of open elements in the stack, by tag
        self.whole = {0}  # html and body elements
        self.text: list[str] = []
        self.linked = self.links = 0
        at, n = 0, len(html)
        while at < n:
            m = MARKUP.search(html, at)
            if not m:
                self.add(html[at:])
                break
            if m.start() > at:
                self.add(html[at : m.start()])
            at = m.end()
            if m[2]:
                tag = m[2].lower()
                if m[1]:
                    self.close(tag)
                else:
                    self.open(tag, m[3] or "")
                    if tag in RAW:
                        end = ENDS[tag].search(html, at)
                        at = end.end() if end else n
        self.flush()

    def add(self, text: str) -> None:
        if not self.stack[-1][1]:
            self.text.append(text)
            if self.links:
                self.linked += len(text)

    def flush(self) -> None:
        if self.text:
            text = " ".join(unescape("".join(self.text)).split())
            if text:
                tag, _, marked, path, element, hinted = self.stack[-1]
                self.blocks.append((text, path, element, min(self.linked, len(text)), marked, tag))
                self.hint_of.append(hinted)
            self.text = []
        self.linked = 0

    def pop_to(self, k: int) -> None:
        if k == len(self.stack):
            return
        if self.stack[k][0] not in HOLES and not self.stack[k - 1][1]:
            self.flush()
        for x in self.stack[k:]:
            self.places[x[0]].pop()
        del self.stack[k:]

    def open(self, tag: str, attributes: str) -> None:
        if tag in RAW:
            return
        if tag in INLINE:
            self.links += tag == "a"
            return
        if tag == "br":
            self.add("\n")
            return
        if tag in VOID:
            if tag == "hr":
                self.flush()
            return
        _, unwanted, inside, path, element, hinted = self.stack[-1]
        if tag in HOLES:
            self.push(tag, True, inside, path, element, hinted)
            return
        if not unwanted:
            self.flush()
            self.links = 0
        if tag == "body" and len(self.stack) > 1:
            self.pop_to(2 if self.stack[1][0] == "html" else 1)
        ends, stops = CLOSES.get(tag, (frozenset("p"), SCOPE))
        if tag in HEADINGS:
            ends = ends | HEADINGS
        k = _last(self.places, ends)
        if k > _last(self.places, stops):
            self.pop_to(k)
        _, unwanted, inside, path, element, hinted = self.stack[-1]
        unwanted = unwanted or _never(tag, attributes, inside)
        name, remark, hint = _classes(attributes) if attributes and tag not in ("html", "body") and not unwanted else ("", False, False)
        if remark if tag in CONTENT else hint or tag == "form":  # a form may be the frame of a page
            self.hinted.append(hinted)
            self.remarks.append(remark)
            hinted = len(self.hinted) - 1
        path = self.paths.setdefault((path, f"{tag}.{name}"), len(self.paths) + 1)
        marks = tag in CONTENT and not remark
        self.parents.append(element)
        self.articles.append(len(self.parents) - 1 if marks and (tag == "article" or not inside) else self.articles[element])
        self.push(tag, unwanted, inside or marks, path, len(self.parents) - 1, hinted)
        if tag in ("html", "body"):
            self.whole.add(len(self.parents) - 1)

    def push(self, tag: str, *rest) -> None:
        self.places[tag].append(len(self.stack))
        self.stack.append((tag, *rest))

    def close(self, tag: str) -> None:
        if tag in INLINE:
            if tag == "a" and self.links:
                self.links -= 1
            return
        if self.places.get(tag):
            self.pop_to(self.places[tag][-1])

    def container(self, element: int) -> bool:
        """Whether it is a part of the page, not the whole."""
        return element not in self.whole

    def wanted(self) -> list[tuple[str, int, int, int, bool, str]]:
        """The blocks without those below hinted elements, unless these hold most of the text."""
        size, marked = [0] * len(self.hinted), [0] * len(self.hinted)
        for b, h in zip(self.blocks, self.hint_of, strict=True):
            size[h] += len(b[0])
            marked[h] += len(b[0]) * b[4]
        for h in range(len(size) - 1, 0, -1):
            size[self.hinted[h]] += size[h]
            marked[self.hinted[h]] += marked[h]
        held = marked if marked[0] else size
        out = [False] * len(size)
        for h in range(1, len(size)):
            out[h] = out[self.hinted[h]] or held[h] <= (REMARK_WRAPPER if self.remarks[h] else WRAPPER) * held[0]
        return [b for b, h in zip(self.blocks, self.hint_of, strict=True) if not out[h]]


def path_scores(size: np.ndarray, marks: np.ndarray, links: np.ndarray, marked: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Fused score and share of link text per path, from what each block has; at: the path of each block."""
    count = np.bincount(at)

    def smoothed(x: np.ndarray) -> np.ndarray:
        ratio = (np.bincount(at, x) / count)[at]
        wide = np.concatenate([ratio[:1], ratio, ratio[-1:]])
        return np.bincount(at, 0.25 * wide[:-2] + 0.5 * wide[1:-1] + 0.25 * wide[2:]) / count

    share = np.bincount(at, links) / np.maximum(np.bincount(at, size), 1)
    inside = np.bincount(at, marked) / count
    return smoothed(size) * (1 + smoothed(marks)) * (1 - share) * (1 + (MARKED - 1) * inside), share


def content(html: str | None) -> str:
    """The main text of a page."""
    page = Page(html) if html else None
    blocks = page.wanted() if page else []
    if not blocks:
        return ""
    size = np.array([len(b[0]) for b in blocks], float)
    marked = np.array([b[4] for b in blocks], float)
    _, at = np.unique([b[1] for b in blocks], return_inverse=True)
    score, share = path_scores(size, np.array([len(PUNCTUATION.findall(b[0])) for b in blocks], float), np.array([b[3] for b in blocks], float), marked, at)
    floor = min(max(SPREAD * score.std(), PART * score.max()), score.max())
    chosen = (score >= floor)[at]
    # The deepest element around chosen blocks with most of their text; elements are numbered so that parents come first.
    up, holder = page.parents, [max(page.parents[b[2]], 0) for b in blocks]
    held, whole = np.zeros(len(up)), np.zeros(len(up))
    np.add.at(held, holder, size * chosen)
    np.add.at(whole, holder, size)
    depth, inside = [0] * len(up), [False] * len(up)
    for e in range(len(up) - 1, 0, -1):
        held[up[e]] += held[e]
        whole[up[e]] += whole[e]
    for e in range(1, len(up)):
        depth[e] = depth[up[e]] + 1
    article = max(np.flatnonzero(held >= MOST * held[0]).tolist(), key=lambda e: depth[e])
    if page.articles[article] > 0:
        article = page.articles[article]
    while article and page.container(up[article]) and page.articles[article] < 0 and whole[up[article]] <= WIDER * whole[article]:
        article = up[article]
    for e in range(len(up)):
        inside[e] = e == article or (e > 0 and inside[up[e]])
    if article and page.container(article):
        kept = np.array([inside[b[2]] and bool(chosen[k] or b[4] or share[at[k]] < LINKS) for k, b in enumerate(blocks)])
        # Nothing but links after the last content node: where to go next, not what the article says.
        after = np.flatnonzero(chosen & kept)
        kept[[k for k in range(int(after[-1]) + 1 if len(after) else len(blocks), len(blocks)) if share[at[k]] > ONLY_LINKS]] = False
        first = int(kept.argmax())
        if first and kept[first] and not marked[first] and blocks[first - 1][5] in HEADINGS:
            kept[first - 1] = True
        return "\n\n".join(b[0] for k, b in enumerate(blocks) if kept[k])
    kept = chosen.copy()
    last: dict[int, int] = {}
    for k in np.flatnonzero(chosen).tolist():
        above = up[blocks[k][2]]
        if above in last:
            between = range(last[above] + 1, k)
            kept[[j for j in between if up[blocks[j][2]] == above and share[at[j]] < LINKS]] = True
        last[above] = k
    for k in range(len(blocks) - 2, -1, -1):
        if blocks[k][5] in HEADINGS and kept[k + 1]:
            kept[k] = True
    if (chosen & (marked > 0)).any():
        kept |= marked > 0
    return "\n\n".join(b[0] for k, b in enumerate(blocks) if kept[k])


def extracted(pages: DataFrame, html: str = "html") -> DataFrame:
    """The table without the html, and with `text`."""
    names = [n for n in pages.columns if n not in (html, "text")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [content(h) for h in b.column(len(names)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[: len(names)], pa.array(texts, pa.string())], names=[*names, "text"])

    fields = "".join(f"`{n}` {pages.schema[n].dataType.simpleString()}, " for n in names)
    return pages.select(*names, html).mapInArrow(run, f"{fields}text string")


def op3_tag_path_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html")
    return extracted(pages).withColumn("n_chars", F.length("text").cast("long"))

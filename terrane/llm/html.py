"""Main text of web pages by tag-path ratios.

A page is read once into elements and text nodes. The path of a node is the chain of its open elements. For each path of
the page the text length and the punctuation marks of its nodes are summed and divided by their number; both ratios are
smoothed over the page's nodes, fused to one score and averaged over the path again. Paths that score at least the
deviation of all scores are content. Elements whose tag, role, class or id says that they are no part of an article are
ruled out first. The article is the smallest region around nearly all content nodes; inside it headings and short
paragraphs of other paths stay, and lists of mere links go.
"""

from __future__ import annotations

import re
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..shipping import map_arrow
from .words import text_chunks

#: Elements without content, elements whose content is no markup, inline elements that end with a block,
#: blocks, and elements that are never part of an article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes plaintext".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split())
BLOCKS = frozenset("address article aside blockquote body center caption dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
OUTSIDE = frozenset("aside button canvas dialog embed fieldset footer form head iframe input label math menu nav noembed noframes noscript object search select style script svg template textarea title xmp".split())
#: Roles, and words of classes and ids, of what is not an article.
ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
WORDS = frozenset("ad ads adsense advert advertisement advertising advertisements adverts aside banner breadcrumb breadcrumbs comment comments consent cookie cookies copyright disclaimer disqus footer gdpr header legal login masthead menu modal nav navbar navigation newsletter notice notices overlay pager pagination popup promo promotion promotions recommended related replies reply respond search share sharing sidebar signup skip social sponsor sponsored sponsors subscribe subscription teaser toolbar trending widget widgets".split())
#: Words of classes and ids of an article's own parts.
ARTICLE = frozenset("article body content entry main page post story text".split())
#: With these a "header" is the article's own, as in "entry-header".
TITLED = frozenset("article content entry post story".split())
#: What an open element is ended by, where its end tag may be left out, and how far up is looked.
ENDED_BY = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "tbody": ("tr", "td", "th", "thead", "tbody"), "tfoot": ("tr", "td", "th", "thead", "tbody")}
BARRIER = {"li": ("ul", "ol", "menu"), "dt": ("dl",), "dd": ("dl",), "tr": ("table",), "td": ("table",), "th": ("table",), "option": ("select",), "tbody": ("table",), "tfoot": ("table",)}

#: Shares of the content that a part of a region must hold to be the region, and of links that make a block a mere link.
MOST, LINKED = 0.8, 0.6
KERNEL = np.array([0.25, 0.5, 0.25])

_TAG = re.compile(r"<(?:!--|(/?)([A-Za-z][^\s/>]*)|[!?]|/[^A-Za-z])")
_QUOTED = re.compile(r"(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>")
_ATTRIBUTE = re.compile(r"\b(class|id|role|hidden|style|aria-hidden)\b(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
_MARK = re.compile(r"[.,;:!?…。、，；：！？¿¡]")
_SPACE = re.compile(r"\s")


class Page:
    """Elements (parent, tag, ruled out, article-like) and text nodes (element, block, text) of one page, in page order."""

    def __init__(self, html: str):
        self.parent, self.tag, self.out, self.named, self.label = [-1], [""], [False], [False], [""]
        self.nodes: list[tuple[int, int, str]] = []
        self.stack = [0]
        self.places: dict[str, list[int]] = {}
        self.block = 0
        self._read(html)

    def _open(self, tag: str, attributes: str) -> None:
        found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in _ATTRIBUTE.finditer(attributes)} if attributes.strip() else {}
        name = f"{found.get('class', '')} {found.get('id', '')}"
        words = {w.lower() for w in _WORD.findall(name)} if name != " " else set()
        top = self.stack[-1]
        hidden = "hidden" in found or found.get("aria-hidden", "").lower() == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", found.get("style", ""), re.I)
        out = tag in OUTSIDE or found.get("role", "").lower() in ROLES or bool(hidden)
        if tag == "header":
            out = out or not (self.places.get("article") or self.places.get("main"))
        elif tag in ("article", "main"):
            out = out or bool(words & {"comment", "reply", "teaser"})
        elif tag not in ("html", "body") and not re.fullmatch("h[1-6]", tag):
            bad = words & WORDS
            out = out or bool(bad and not (bad <= {"header"} and words & TITLED))
        self.parent.append(top)
        self.tag.append(tag)
        self.out.append(out)
        self.named.append(tag in ("article", "main") or found.get("role", "").lower() in ("main", "article") or bool(words & ARTICLE))
        self.label.append(tag + ("." + ".".join(sorted(words)) if words and tag not in INLINE else ""))
        self.places.setdefault(tag, []).append(len(self.stack))
        self.stack.append(len(self.tag) - 1)

    def _pop(self) -> None:
        self.places[self.tag[self.stack.pop()]].pop()

    def _nearest(self, names: tuple) -> int:
        """The place in the stack of the innermost open element of ``names``, 0 for none."""
        return max((at[-1] for at in (self.places.get(n) for n in names) if at), default=0)

    def _close(self, names: tuple, barrier: tuple = ()) -> None:
        """End the nearest open element of ``names`` and all inside it, unless an element of ``barrier`` is nearer."""
        at = self._nearest(names)
        if at and at > self._nearest(barrier):
            while len(self.stack) > at:
                self._pop()

    def _text(self, text: str) -> None:
        if text:
            self.nodes.append((self.stack[-1], self.block, unescape(text) if "&" in text else text))

    def _read(self, html: str) -> None:
        at, end, quoted = 0, len(html), True
        while at < end:
            m = _TAG.search(html, at)
            if m is None:
                self._text(html[at:])
                return
            self._text(html[at : m.start()])
            at = m.end()
            if m[2] is None:
                # "<!-->" and "<!--->" are whole comments; one without an end takes the rest of the page
                close = html.find(">", at) if m[0] != "<!--" or html.startswith((">", "->"), at) else html.find("-->", at)
                at = end if close < 0 else html.find(">", close) + 1
                continue
            # a quote that is never closed ends the search for quotes; a tag without an end is left out with all that follows
            body = _QUOTED.match(html, at) if quoted else None
            if body is None:
                quoted, close = False, html.find(">", at)
            else:
                close = body.end() - 1
            if close < 0:
                return
            tag, attributes, at = m[2].lower(), html[at:close], close + 1
            if tag in BLOCKS:
                self.block += 1
            if m[1]:
                self._close((tag,), ("td", "th", "table") if tag in INLINE else ("table",) if tag not in ("table", "body", "html", "div", "article", "section", "main") else ())
                continue
            if tag in BLOCKS:
                self._close(("p",), ("table", "td", "th", "button", "object", "caption"))
                while self.tag[self.stack[-1]] in INLINE and self.tag[self.stack[-1]] != "a" and tag != "hr":
                    # an inline element that was left open does not go on in the next block
                    self._pop()
                if tag in ENDED_BY:
                    for _ in range(3 if tag in ("tr", "tbody", "tfoot") else 1):
                        self._close(ENDED_BY[tag], BARRIER[tag])
            if tag == "br":
                self._text(" ")
            elif tag in VOID:
                continue
            elif tag in RAW:
                stop = re.compile(rf"</{tag}[\s/>]", re.I).search(html, at) if tag != "plaintext" else None
                at = stop.start() if stop else end
            elif not (attributes.rstrip().endswith("/") and tag in ("svg", "path", "math")):
                self._open(tag, attributes)


def _ratios(paths: np.ndarray, length: np.ndarray, marks: np.ndarray) -> np.ndarray:
    """A score for each path: length and punctuation a node, smoothed along the page's nodes, fused by their product."""
    n = np.bincount(paths)
    by_length, by_marks = np.bincount(paths, length) / n, np.bincount(paths, marks) / n

    def smooth(x):
        return np.convolve(np.pad(x, 1, mode="edge"), KERNEL, "valid")

    fused = smooth(by_length[paths]) * (smooth(by_marks[paths]) + 0.1)
    return np.bincount(paths, np.sqrt(fused)) / n


def main_text(html: str | None) -> tuple[str, int, int]:
    """(main text, paths, content paths) of one page; see ``extract``."""
    page = Page(html or "")
    parent, tag = page.parent, page.tag
    count = len(tag)
    # an element is ruled out with all inside it, unless the page's article is in it
    holds = [False] * count
    for e in range(count - 1, 0, -1):
        if not page.out[e] and tag[e] in ("article", "main"):
            holds[e] = True
        holds[parent[e]] = holds[parent[e]] or holds[e]
    gone, linked, path = [False] * count, [False] * count, [0] * count
    known: dict = {}
    for e in range(1, count):
        up = parent[e]
        gone[e] = gone[up] or (page.out[e] and not (holds[e] and tag[e] not in OUTSIDE))
        linked[e] = linked[up] or tag[e] == "a"
        path[e] = known.setdefault((path[up], page.label[e]), len(known) + 1)
    nodes = [(e, b, t) for e, b, t in page.nodes if not gone[e]]
    real = [(e, b, t) for e, b, t in nodes if not t.isspace()]
    if not real:
        return "", 0, 0
    length = np.array([len(t) - len(_SPACE.findall(t)) for _, _, t in real], float)
    marks = np.array([len(_MARK.findall(t)) for _, _, t in real], float)
    _, own = np.unique([path[e] for e, _, _ in real], return_inverse=True)
    score = _ratios(own, length, marks)
    # a path of mere links weighs little
    if len(score) > 1:
        score[np.bincount(own, [not linked[e] for e, _, _ in real]) == 0] *= 0.1
    threshold = min(float(np.std(score)), float(score.max()))
    content = score >= threshold
    weight, blocks = [0.0] * count, [set() for _ in range(count)]
    for (e, b, _), o, n in zip(real, own, length.tolist()):
        weight[e] += n if content[o] else 0.0
        blocks[e].add(b)
    for e in range(count - 1, 0, -1):
        weight[parent[e]] += weight[e]
        if len(blocks[parent[e]]) < 2:
            blocks[parent[e]] |= blocks[e]
    inner: list[list[int]] = [[] for _ in range(count)]
    for e in range(1, count):
        inner[parent[e]].append(e)
    region = 0
    while not (tag[region] in ("article", "main") and not any(holds[e] and weight[e] >= MOST * weight[region] for e in inner[region])):
        below = [e for e in inner[region] if weight[e] >= MOST * weight[region] and (len(blocks[e]) > 1 or tag[e] in ("html", "body", "article", "main")) and tag[e] not in INLINE | {"p", "li", "ul", "ol", "dl", "pre", "blockquote"}]
        if not below or (page.named[region] and not holds[region] and not page.named[below[0]] and tag[region] not in ("html", "body")):
            break
        region = below[0]
    inside, held = [False] * count, list(range(count))
    inside[region] = True
    for e in range(1, count):
        inside[e] = inside[e] or inside[parent[e]]
        held[e] = held[parent[e]] if tag[e] in INLINE or tag[e] == "li" else e
    kept: dict[int, list] = {}
    links: dict[int, list] = {}
    holder: dict[int, int] = {}
    for e, b, t in nodes:
        if not inside[e]:
            continue
        kept.setdefault(b, []).append(t)
        n = len(t) - len(_SPACE.findall(t))
        at = links.setdefault(b, [0, 0])
        at[0] += n
        at[1] += n if linked[e] else 0
        holder.setdefault(b, held[e])
    # a list of three or more mere links is a menu
    mere: dict[int, list] = {}
    for b, (n, n_linked) in links.items():
        if n:
            mere.setdefault(holder[b], []).append(n_linked >= LINKED * n)
    menus = {e for e, group in mere.items() if len(group) >= 3 and all(group)}
    out = []
    for b in sorted(kept):
        if holder[b] in menus:
            continue
        text = " ".join("".join(kept[b]).split())
        if text:
            out.append(text)
    return "\n\n".join(out), len(score), int(content.sum())


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars, paths, content_paths) of pages (page_id, url, html).

    ``text`` is the article without menus, page headers, footers, sidebars, notices, adverts, forms, scripts, styles, hidden
    parts, markup and reader comments: character references decoded, white space inside a block one space, blocks in page
    order joined by an empty line; nothing of the article is dropped or cut. White space is what Unicode calls so.

    Null or empty html and pages without text give ''. Repeated rows and ids give a row each; null ids and urls stay. A
    page of any length is read in one pass and held alone with its text nodes. Unclosed and stray tags, comments and quotes
    are allowed. Other columns are ignored. No rows give no rows. No shuffle.
    """

    def run(batches):
        for batch in batches:
            for first, last, html in text_chunks(batch.column(2)):
                found = [main_text(h) for h in html]
                text = [t for t, _, _ in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64()), pa.array([n for _, n, _ in found], pa.int32()), pa.array([n for _, _, n in found], pa.int32())], ["page_id", "url", "text", "n_chars", "paths", "content_paths"])

    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema}
    return map_arrow(rows, run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars long, paths int, content_paths int")

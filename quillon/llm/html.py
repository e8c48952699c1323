"""Main text of web pages by tag-path ratios.

A page becomes its text nodes in order, each with the path of tag names from the
root to it. Text length and punctuation are summed by path and divided by the
path's number of nodes; both ratios are smoothed over the sequence of nodes and
multiplied. Nodes of at least the threshold (a share of the mean weighted by
length) are content, and the deepest element that holds all of them, or the
article or main around it, is the page's article: short headings and paragraphs
in it belong to it too, and so do headings beside it. Where content stands both in
an article and outside any, what is outside counts only if its element holds
content. Elements that
their tag or class says are furniture (menus, notices, adverts, forms, comments
...) take no part. Where the class word also has everyday uses (share, related,
alert ...) and the element is in an article or main, the path scores decide: it
stays if most of its text is content or it holds the title. A form stays if it
holds most of the page, as where it wraps all of it; class words inside code don't
count. Nor do menus take part: blocks outside an article or main that hold two
links or more of few words each, no heading and no word outside the links, and
stand before or after all content. A link counts with the block it stands in, so
links in sentences, headings and lists of the article are kept.

White space inside a block becomes one space; blocks are joined by a line feed.
`br` counts as white space. Nothing else is dropped and nothing is capped.

Defined results: null, empty or text-free html gives an empty text; html cut off
anywhere is read as far as it goes; repeated rows are extracted each; extra
columns are ignored.
"""

from __future__ import annotations

import html as entities
import re
from collections import Counter, defaultdict
from collections.abc import Callable
from itertools import takewhile

import numpy as np
from pyspark.sql import DataFrame

from quillon.llm.common import Texts, arrow_map, pick

TAG = re.compile(r"""<(?:!--(?:>|->|.*?(?:--!?>|\Z))|[!?][^>]*+(?:>|\Z)|(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+>|[^>]*+(?:>|\Z)))""", re.S)
NAMES = re.compile(r"""\b(?:class|id|role|aria-label)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
RAW = {"script", "style", "noscript", "template", "textarea", "title", "svg", "math", "iframe", "object", "canvas", "xmp", "noembed", "noframes"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
FURNITURE = {"nav", "footer", "aside", "button", "select", "dialog", "menu", "head", "fieldset", "label", "option", "video", "audio", "map"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "cite", "code", "data", "del", "dfn", "em", "font", "i", "ins", "kbd", "mark", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "ruby", "rt", "rp", "img", "br", "wbr"}
#: Words of class, id or role that mark furniture.
MARKS = set("ad ads advert adverts advertisement advertising adsense adbox adslot banner breadcrumb breadcrumbs comment comments cookie cookies consent disqus dropdown footer gdpr masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination pager popup promo promotion related reply replies respond share sharing sidebar signup social sponsor sponsored subscribe subscription toc toolbar widget widgets alert complementary contentinfo search login header topbar skip".split())
#: Of MARKS, those that say nothing by themselves of an element in an article.
DOUBTED = {"alert", "header", "login", "notice", "notices", "related", "replies", "reply", "respond", "search", "share", "sharing", "skip", "social", "toc", "toolbar", "widget", "widgets"}
#: "with-sidebar" isn't a sidebar, and "post-header" isn't the page's header.
UNMARKED = {"has", "hide", "no", "with", "without"}
TITLED = {"article", "content", "entry", "post", "story"}
#: An open element of these ends when one of the named tags begins.
ENDS = {"p": {"address", "article", "aside", "blockquote", "div", "dl", "fieldset", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr", "main", "nav", "ol", "p", "pre", "section", "table", "ul", "figure"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
HOLDS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "p": {"table", "button", "td", "th", "article", "section", "div", "body", "blockquote", "li"}, "option": {"select"}}
LEAVES = {"h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "ul", "ol", "dl", "figure", "hgroup"}
WHOLE = {"article", "main", "body", "section"}
DECLARED = {"article", "main"}
CODE = {"pre", "code"}
WATCHED = DECLARED | CODE | {"a"}
DEPTH = 512
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements that are never a menu by themselves.
NO_MENU = INLINE | HEADINGS | {"", "html", "body", "article", "main", "li", "dt", "dd", "tr", "td", "th"}
MENU_WORDS = 4
WORD = re.compile(r"\w+")
PUNCTUATION = re.compile(r"[.,;:!?\u2026\u3001\u3002\uff0c\uff01\uff1f\u00bf\u00a1]")
SHARE = 0.3


def _words(rest: str) -> set[str]:
    """The furniture words in a start tag's class, id and role."""
    found = set()
    for m in NAMES.finditer(rest):
        before = ""
        for w in re.split(r"[^a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", "-", m[1]).lower()):
            if w in MARKS and before not in UNMARKED and not (w == "header" and before in TITLED):
                found.add(w)
            before = w
    return found


def _marked(tag: str, rest: str, inside: bool, code: bool) -> bool | None:
    """Whether a start tag opens furniture; None if the path scores must say. A header inside an article or main holds its headings and stays."""
    if tag == "form":
        return None
    if tag in FURNITURE or tag == "header" and not inside:
        return True
    if tag in ("html", "body", "main", "article") or len(rest) < 3:
        return False
    if re.search(r"\bhidden\b(?!\s*=\s*[\"']?until)", re.sub(r"\"[^\"]*\"|'[^']*'", "", rest)) or re.search(r"display\s*:\s*none", rest, re.I):
        return True
    words = set() if code else _words(rest)
    return None if inside and words and words <= DOUBTED else bool(words)


def nodes(html: str) -> tuple[list[tuple[tuple[int, ...], str, int, bool, str]], dict[int, str]]:
    """(elements from the root, tag path, block, whether in a link, text) of each text node outside furniture, and the tags of elements in doubt."""
    out: list = []
    doubted: dict[int, str] = {}
    stack: list[tuple[str, tuple[int, ...], bool, str, frozenset[str]]] = [("", (0,), False, "", frozenset())]  # tag, elements, furniture, path, tags that matter below
    made, block, at, n = 0, 0, 0, len(html)
    while at < n:
        m = TAG.search(html, at)
        text = html[at : m.start()] if m else html[at:]
        if text and not stack[-1][2]:
            if text.isspace():
                if out and out[-1][2] == block:
                    out.append((out[-1][0], out[-1][1], block, out[-1][3], " "))
            else:
                out.append((stack[-1][1], stack[-1][3], block, "a" in stack[-1][4], text))
        if not m:
            break
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if tag == "br":
            if not stack[-1][2] and out and out[-1][2] == block:
                out.append((out[-1][0], out[-1][1], block, out[-1][3], " "))
            continue
        block += tag not in INLINE
        if m[1]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] == tag:
                    del stack[k:]
                    break
                if tag in INLINE and stack[k][0] not in INLINE:
                    break
        elif tag in RAW:
            if not m[3].endswith("/>") or tag not in ("svg", "math"):
                close = re.compile(rf"</{tag}\b[^>]*>?", re.I).search(html, at)
                at = close.end() if close else n
        elif tag not in VOID:
            for k in range(len(stack) - 1, 0, -1):
                open_tag = stack[k][0]
                if tag in ENDS.get(open_tag, ()):
                    del stack[k:]
                    break
                if any(open_tag in HOLDS[x] for x in ENDS if tag in ENDS[x] and x in HOLDS) and open_tag not in ENDS:
                    break
            if tag == "body":  # what a head left open ends here
                del stack[1 + (len(stack) > 1 and stack[1][0] == "html") :]
            made += 1
            _, elements, furniture, path, around = stack[-1]
            marked = _marked(tag, m[3], not DECLARED.isdisjoint(around), not CODE.isdisjoint(around))
            if marked is None and not furniture:
                doubted[made] = tag
            if len(stack) > DEPTH:  # deeper elements stand side by side, as in browsers
                stack.pop()
                elements, path = stack[-1][1], stack[-1][3]
            stack.append((tag, (*elements, made), furniture or bool(marked), f"{path}/{tag}{' ?' if marked is None else ''}", around | {tag} if tag in WATCHED else around))
    return out, doubted


def _smooth(x: np.ndarray) -> np.ndarray:
    weights = np.array([0.25, 0.5, 0.25])
    return np.convolve(np.pad(x, 1, mode="edge"), weights, "valid")


def _menus(found: list, real: list[int], tags: dict[int, list[str]]) -> set[int]:
    """The text nodes in menus, wherever they stand on the page."""
    if not any(found[k][3] for k in real):
        return set()
    words: Counter = Counter()
    links: dict[int, set[int]] = defaultdict(set)
    other = set()
    for k in real:
        elements, _, _, link, text = found[k]
        n = len(WORD.findall(text))
        if not HEADINGS.isdisjoint(tags[k]) or n and not link:
            other.update(elements)
        elif link:
            for e in elements:
                words[e] += n
                links[e].add(elements[tags[k].index("a")])
    menus = {e for e, x in links.items() if e not in other and len(x) > 1 and words[e] < MENU_WORDS * len(x)}
    return {k for k in real if DECLARED.isdisjoint(tags[k]) and any(e in menus and t not in NO_MENU for e, t in zip(found[k][0], tags[k], strict=True))}


def _linked(found: list, real: list[int], tags: dict[int, list[str]]) -> np.ndarray:
    """Whether most of the text of a node's block element is links."""
    sums: dict[int, np.ndarray] = defaultdict(lambda: np.zeros(2))
    of = [next((e for e, t in zip(found[k][0][::-1], tags[k][::-1], strict=True) if t not in INLINE), 0) for k in real]
    for k, e in zip(real, of, strict=True):
        size = len(found[k][4].strip())
        sums[e] += (size, size * found[k][3])
    return np.array([sums[e][1] > 0.5 * sums[e][0] for e in of])


def _article(found: list, real: list[int], tags: dict[int, list[str]], chosen: list[int]) -> set[int]:
    """The elements whose text is the page's: they hold every chosen node."""
    first = found[chosen[0]][0]
    at = min(sum(1 for _ in takewhile(lambda x: x[0] == x[1], zip(first, found[k][0], strict=False))) for k in chosen) - 1
    elements, path = first, tags[chosen[0]]
    direct = {found[k][0][-1] for k in real}
    while at and path[at] not in WHOLE and (path[at] in ENDS or path[at] in INLINE or path[at] in LEAVES or elements[at] in direct):
        at -= 1  # a paragraph that holds all the text has the article around it
    at = max((d for d in range(at + 1) if path[d] in DECLARED), default=at)
    beside: dict[int, set[int]] = defaultdict(set)  # by parent, headings before the content
    for k in real:
        if k >= chosen[0]:
            break
        d = next((d for d, t in enumerate(tags[k]) if t in HEADINGS), 0)
        if d:
            beside[found[k][0][d - 1 - (tags[k][d - 1] == "hgroup")]].add(found[k][0][d])
    at = min((d for d in range(at) if elements[d] in beside and path[d] not in ("", "html", "body")), default=at)  # a heading's section is whole
    if any(t in DECLARED for t in path[: at + 1]):
        kept = {elements[at]}
    else:
        kept, around = set(), set()
        for k in chosen:
            d = next((d for d, t in enumerate(tags[k]) if t in DECLARED), 0)
            if d:
                kept.add(found[k][0][d])
                around.update(found[k][0][:d])
        if not kept:
            kept = {elements[at]}
        else:
            for k in chosen:
                if kept.isdisjoint(found[k][0]):
                    d = len(tags[k]) - 1
                    while d > at + 1 and found[k][0][d - 1] not in around:
                        d -= 1
                    kept.add(found[k][0][d])
                    around.update(found[k][0][:d])
            at = len(elements)
    for e in set(elements[:at]) & set(beside):
        kept |= beside[e]
    return kept


def _scored(found: list, real: list[int], tags: dict[int, list[str]], smooth: Callable[[np.ndarray], np.ndarray] = _smooth) -> tuple[np.ndarray, set[int]]:
    """Whether each text node is content by the ratios of its path, and the nodes in menus."""
    sums: dict[str, np.ndarray] = defaultdict(lambda: np.zeros(3))
    for k in real:
        _, path, _, _, text = found[k]
        sums[path] += (1, len(text.strip()), len(PUNCTUATION.findall(text)))
    length = np.array([sums[found[k][1]][1] / sums[found[k][1]][0] for k in real])
    marks = np.array([sums[found[k][1]][2] / sums[found[k][1]][0] for k in real])
    own = np.array([len(found[k][4].strip()) for k in real], float)
    menus = _menus(found, real, tags)
    linked = _linked(found, real, tags) | np.array([k in menus for k in real])
    fused = np.sqrt(smooth(length) * (smooth(marks) + 0.5)) * ~linked
    content = (fused >= SHARE * np.average(fused, weights=own)) & ~linked if fused.any() else np.array([k not in menus for k in real])
    return content, menus


def _refused(found: list, real: list[int], tags: dict[int, list[str]], doubted: dict[int, str]) -> set[int]:
    """The elements in doubt that are furniture: forms first, then what its own paths' scores, unsmoothed, don't speak for."""
    size: Counter = Counter()
    for k in real:
        n = len(found[k][4].strip())
        size[0] += n
        size.update(dict.fromkeys(doubted.keys() & set(found[k][0]), n))
    refused = {e for e, tag in doubted.items() if tag == "form" and 2 * size[e] <= size[0]}
    left = [k for k in real if refused.isdisjoint(found[k][0])]
    others = {e for e, tag in doubted.items() if tag != "form"}
    if not left or not others:
        return refused
    good: Counter = Counter()
    for k, content in zip(left, _scored(found, left, tags, lambda x: x)[0], strict=True):
        for e in others & set(found[k][0]):
            if "h1" in tags[k]:
                good[e] = size[0]
            elif content:
                good[e] += len(found[k][4].strip())
    return refused | {e for e in others if 2 * good[e] <= size[e]}


def main_text(html: str | None) -> str:
    found, doubted = nodes(html) if html else ([], {})
    found = [(e, p, b, a, entities.unescape(t)) for e, p, b, a, t in found]
    split = {path: [t.partition(" ")[0] for t in path.split("/")] for path in {x[1] for x in found}}
    tags = {k: split[x[1]] for k, x in enumerate(found)}
    real = [k for k, x in enumerate(found) if x[4].strip()]
    refused = _refused(found, real, tags, doubted) if doubted else set()
    real = [k for k in real if refused.isdisjoint(found[k][0])]
    if not real:
        return ""
    content, menus = _scored(found, real, tags)
    chosen = [k for k, x in zip(real, content, strict=True) if x]
    if not chosen:
        return ""
    kept = _article(found, real, tags, chosen)
    blocks: dict[int, list[str]] = {}
    drop = {k for k in menus if not chosen[0] < k < chosen[-1]}
    for k, (elements, _, block, _, text) in enumerate(found):
        if k not in drop and not kept.isdisjoint(elements) and refused.isdisjoint(elements):
            blocks.setdefault(block, []).append(text)
    lines = (" ".join("".join(x).split()) for x in blocks.values())
    return "\n".join(x for x in lines if x)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of each page."""

    def work(batch):
        for i, j, data, offsets in Texts(batch["html"]).chunks(8 << 20):
            raw = data.tobytes()
            text = [main_text(raw[a:z].decode()) for a, z in zip(offsets[:-1], offsets[1:], strict=True)]
            yield {"page_id": batch["page_id"].slice(i, j - i), "url": batch["url"].slice(i, j - i), "text": text, "n_chars": list(map(len, text))}

    return arrow_map(pick(pages, "page_id", "url", "html"), work, "page_id long, url string, text string, n_chars long")


def op8_html_extraction(spark, sf_dir: str) -> DataFrame:
    return extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))

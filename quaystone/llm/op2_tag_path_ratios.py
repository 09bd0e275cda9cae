"""HTML extraction by tag-path ratios.

A tolerant scanner turns a page into text blocks, each with its root-to-leaf path of tags and class names.  Text
length, punctuation and linked characters are summed per path; a path's text ratio (characters a tag) and
punctuation ratio (marks a tag) are smoothed over its neighbours in page order, fused (their product, less the
linked share) and compared with a share of the page's spread.  Paths above the threshold are content.  Blocks of
other paths are kept where the structure ties them to content: headings beside content paths, what lies between
content blocks, and, inside a declared article, lists, quotes and other siblings of content; paths of links are
not.  A declared article (``article``, ``main``) bounds the page if it holds a content path.  Elements that are
never article (navigation, headers, footers, asides, forms, scripts, adverts, comments ... by tag, class, id or
role) and hidden ones do not count, unless they hold the declared article themselves.

Defined cases: null or empty html, or a page without content, gives an empty text; unclosed and misnested
tags close implicitly; pages and paths of any length are read whole, in time linear in the page; repeated rows
give equal rows; an empty table gives an empty result; other columns are carried on request, text and n_chars
are replaced.
"""

from __future__ import annotations

import html as html_lib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import texts_of, with_text_columns

VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "xmp", "noembed", "noframes"}
#: Elements that are never part of the article.
DROP = {"nav", "header", "footer", "aside", "form", "button", "select", "option", "menu", "dialog", "head", "object", "audio", "video", "canvas", "label", "fieldset"} | RAW
#: Words of class, id or role that name boilerplate, and words that say no more than what kind of box it is.
BOILERPLATE = re.compile(
    r"ads?|advert\w*|sponsor\w*|promo\w*|banner|nav\w*|menu\w*|breadcrumb\w*|sidebar\w*|side|footer\w*|header|masthead|comment\w*|disqus|respond|reply|"
    r"cookie\w*|consent\w*|notice\w*|newsletter\w*|subscri\w*|share\w*|social\w*|related\w*|recommend\w*|popup\w*|modal\w*|login\w*|toolbar\w*|pagination|pager|widget\w*|"
    r"navigation|complementary|contentinfo|search|alert\w*|toc|skip\w*",
    re.I,
)
NEUTRAL = re.compile(
    r"\d*|\w|site|page|global|main|top|bottom|left|right|first|last|primary|secondary|mobile|desktop|box\w*|bar|block|wrap\w*|container|list\w*|links?|buttons?|btns?|icons?|inner|outer|area|section|panel|items?|"
    r"form|sign\w*|unit|slot|posts?|articles?|stor(?:y|ies)|content|media|tools?|text|row|col\w*|group|thread|policy|feed|bottom|sticky|fixed|js|the|more|to",
    re.I,
)
#: Elements of running text: one word of their class is often about the text, not about its place.
RUNNING = {"p", "h1", "h2", "h3", "h4", "h5", "h6", "blockquote", "pre", "li", "dd", "dt", "td", "th", "figure", "figcaption", "span", "b", "i", "em", "strong", "mark", "a"}
ABOUT = {"side", "header", "toc", "search", "reply", "respond", "share", "shares", "notice", "alert", "banner", "menu", "skip", "related"}
#: Names that say what a wrapper has beside its content.
BESIDE = re.compile(r"^(?:has|no|with|without)[_-]", re.I)
BLOCK = {
    "address", "article", "blockquote", "body", "center", "dd", "details", "div", "dl", "dt", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "hr", "html", "li",
    "main", "ol", "p", "pre", "section", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul", "caption", "hgroup", "search", "figcaption",
} | DROP
#: What an opening tag closes first, up to the element that bounds it.
CLOSES = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}
TABLE = {"table", "tbody", "thead", "tfoot", "tr", "html", "body"}
ROOTS = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
#: Containers of running text: their blocks count as siblings of the container.
FLOW = {"blockquote", "ul", "ol", "dl", "table", "tbody", "thead", "tfoot", "tr", "figure", "hgroup", "li", "dd", "details", "pre"}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*(?:\"|\Z)|'[^']*(?:'|\Z))*)(?:>|\Z)",
    re.S,
)
ATTRIBUTE = re.compile(r"""([^\s"'<>/=]+)(?:\s*=\s*(?:"([^"]*)(?:"|\Z)|'([^']*)(?:'|\Z)|([^\s"'>]+)))?""")
TELLING = re.compile(r"class|id|role|style|hidden", re.I)
INVISIBLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PUNCTUATION = re.compile(r"[.,;:!?…。，、；：！？¿¡]")
SPACE = re.compile(r"\s+")


def attributes(raw: str) -> dict[str, str]:
    """Attributes by lower-case name, the first of a name; none where no telling one can be there."""
    found: dict[str, str] = {}
    if TELLING.search(raw):
        for name, *values in ATTRIBUTE.findall(raw):
            found.setdefault(name.lower(), next(filter(None, values), ""))
    return found


def named_boilerplate(name: str, element: str) -> bool:
    """Whether a whole class, id or role names boilerplate: each of its words does, or is neutral, and one at least does."""
    words = re.split(r"[_-]+", name)
    if len(words) == 1:
        return bool(BOILERPLATE.fullmatch(name)) and not (element in RUNNING and name.lower() in ABOUT)
    telling = [bool(BOILERPLATE.fullmatch(w)) for w in words]
    return any(telling) and all(t or NEUTRAL.fullmatch(w) for t, w in zip(telling, words, strict=True))


def boilerplate(attrs: dict[str, str], element: str) -> bool:
    if "hidden" in attrs or attrs.get("aria-hidden", "").lower() == "true" or INVISIBLE.search(attrs.get("style", "")):
        return True
    names = " ".join(attrs.get(k, "") for k in ("class", "id", "role")).split()
    return any(named_boilerplate(n, element) and not BESIDE.match(n) for n in names)


class Page:
    """Blocks of a page: text, path, characters in links, whether a content root holds it.

    Paths are nodes of a tree, so that a block costs the same at any depth: ``parent`` and ``tag`` by node.
    """

    def __init__(self, page: str):
        self.parent, self.tag, self.nodes = [-1], [""], {}
        self.text: list[str] = []
        self.path: list[int] = []
        self.linked: list[int] = []
        self.rooted: list[bool] = []
        self.suspect: list[int] = []  # innermost element named as boilerplate
        self.above, self.pardoned = [-1], [True]  # of such elements: the next one outside, holds a content root
        self.read(page)
        bad = [False] * len(self.above)
        for k in range(1, len(bad)):
            bad[k] = not self.pardoned[k] or bad[self.above[k]]
        kept = [i for i, k in enumerate(self.suspect) if not bad[k]]
        for name in ("text", "path", "linked", "rooted"):
            setattr(self, name, [getattr(self, name)[i] for i in kept])

    def node(self, parent: int, tag: str, classes: str) -> int:
        label = " ".join([tag, *sorted({re.sub(r"\d+", "", c) for c in classes.split()})])
        k = self.nodes.setdefault((parent, label), len(self.parent))
        if k == len(self.parent):
            self.parent.append(parent)
            self.tag.append(tag)
        return k

    def read(self, page: str) -> None:
        stack: list[tuple[str, bool, int, int]] = []  # element, never content, path outside, suspect outside
        open_at: dict[str, list[int]] = {}
        block_at: list[int] = []
        buffer: list[str] = []
        at_node = linked = dropped = roots = suspect = 0

        def flush() -> None:
            nonlocal linked
            if buffer:
                if text := SPACE.sub(" ", html_lib.unescape("".join(buffer))).strip():
                    self.text.append(text)
                    self.path.append(at_node)
                    self.linked.append(linked)
                    self.rooted.append(roots > 0)
                    self.suspect.append(suspect)
                buffer.clear()
            linked = 0

        def close(to: int) -> None:
            nonlocal at_node, dropped, roots, suspect
            while len(stack) > to:
                name, never, at_node, suspect = stack.pop()
                dropped -= never
                roots -= name in ROOTS
                open_at[name].pop()
                if name in BLOCK:
                    block_at.pop()

        def last(names) -> int:
            return max((open_at[x][-1] for x in names if open_at.get(x)), default=-1)

        at, n = 0, len(page)
        while at < n:
            m = TOKEN.search(page, at)
            if not dropped:
                piece = page[at : m.start() if m else n]
                buffer.append(piece)
                if open_at.get("a"):
                    linked += len(piece)
            if not m:
                break
            at = m.end()
            name = (m[2] or "").lower()
            if not name:
                continue
            if m[1]:
                k, inner = last([name]), block_at[-1] if block_at else -1
                bound = CLOSES[name][1] if name in CLOSES else () if name in TABLE else ("td", "th", "caption")
                if k < 0 or (name not in BLOCK and k < inner) or k < last(bound):
                    continue  # nothing to close, or an inline element outside the innermost block, or one outside a list or cell
                if name in BLOCK:
                    flush()
                close(k)
                continue
            if name in BLOCK:
                flush()
                # a block ends an open paragraph with whatever inline element hangs in it
                if name not in ("html", "body") and block_at and stack[block_at[-1]][0] == "p":
                    close(block_at[-1])
            elif name == "br" and not dropped:
                buffer.append(" ")
            shut, bound = CLOSES.get(name, ((), ()))
            if shut and (k := last(shut)) > last(bound):
                close(k)
            ends_itself = m[3].endswith("/")
            if name in VOID or ends_itself and (name not in BLOCK or name == "svg"):
                continue
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}\b[^>]*(?:>|\Z)", re.I).search(page, at)
                at = end.end() if end else n
                continue
            attrs = attributes(m[3]) if m[3] else {}
            stack.append((name, name in DROP, at_node, suspect))
            open_at.setdefault(name, []).append(len(stack) - 1)
            dropped += name in DROP
            if name in ROOTS:
                roots += 1
                k = suspect
                while k and not self.pardoned[k]:
                    self.pardoned[k] = True
                    k = self.above[k]
            elif name not in ("html", "body") and boilerplate(attrs, name):
                self.above.append(suspect)
                self.pardoned.append(False)
                suspect = len(self.above) - 1
            if name in BLOCK:
                block_at.append(len(stack) - 1)
                at_node = self.node(at_node, name, attrs.get("class", ""))
        flush()


def scores(paths: np.ndarray, length: np.ndarray, marks: np.ndarray, linked: np.ndarray, window: int) -> np.ndarray:
    """Fused ratio of each path; ``paths`` numbers the blocks' paths in order of first appearance."""
    tags, total = np.bincount(paths), np.bincount(paths, weights=length)
    text, punctuation = total / tags, np.bincount(paths, weights=marks) / tags
    kernel = np.ones(2 * window + 1) / (2 * window + 1)
    smooth = lambda x: np.convolve(np.pad(x, window, mode="edge"), kernel, mode="valid")
    return smooth(text) * (1 + smooth(punctuation)) * (1 - np.minimum(1, np.bincount(paths, weights=linked) / total))


def content(page: str, *, share: float = 0.5, window: int = 1) -> str:
    """Main text of a page."""
    p = Page(page)
    if not p.text:
        return ""
    length, linked, rooted = np.array([len(t) for t in p.text]), np.array(p.linked), np.array(p.rooted)
    marks, path = np.array([len(PUNCTUATION.findall(t)) for t in p.text]), np.array(p.path)

    def chosen(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Blocks of content paths and of link paths among ``of``."""
        _, first, k = np.unique(path[of], return_index=True, return_inverse=True)
        order = np.argsort(np.argsort(first))
        k = order[k]
        fused = scores(k, length[of], marks[of], linked[of], window)
        links = np.bincount(k, weights=linked[of]) > 0.5 * np.bincount(k, weights=length[of])
        return ((fused > 0) & (fused >= share * fused.std()) & ~links)[k], links[k]

    of = np.arange(len(path))
    good, links = chosen(of)
    bounded = bool((good & rooted).any())
    if bounded and not rooted.all():
        of = np.flatnonzero(rooted)
        good, links = chosen(of)
    if not good.any():
        return ""
    parents = {p.parent[k] for k in path[of[good]].tolist()}

    def beside(k: int) -> bool:
        while p.tag[p.parent[k]] in FLOW:
            k = p.parent[k]
        return p.parent[k] in parents

    inside = np.flatnonzero(good)
    kept = []
    for j, i in enumerate(of.tolist()):
        k = p.path[i]
        heading = p.tag[k] in HEADINGS and p.parent[k] in parents
        if good[j] or heading or not links[j] and (inside[0] < j < inside[-1] or bounded and beside(k)):
            kept.append(p.text[i])
    return "\n\n".join(kept)


def extract(pages: DataFrame, *, keep: list[str] | None = None) -> DataFrame:
    """``pages`` with text and n_chars; html itself is carried only if kept."""

    def factory():
        def fn(batch):
            made = [content(h.decode()) for h in texts_of(batch.column("html"))]
            return [pa.array(made, pa.string()), pa.array([len(t) for t in made], pa.int64())]

        return fn

    fields = [T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]
    return with_text_columns(pages, fields, factory, keep, text="html")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return extract(table(spark, sf_dir, "pages"), keep=["page_id", "url"])
